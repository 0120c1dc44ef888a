"""Commands: run (verify a change), schema (write the source schema)."""

from __future__ import annotations

import argparse
import os
import sys
from contextlib import nullcontext
from pathlib import Path

from planproof import report as rp
from planproof.plans import generate, schema
from planproof.plans.compare import Report, run
from planproof.plans.project import load
from planproof.session import local
from planproof.sources import dbml, files, sinks


def made_sources(spark, head, config, base=None):
    """Sources for both branches, generated from the resolved schema: frames by uid, those that are others on base, what is
    guessed, what differs, warnings, rows."""
    mine = schema.resolve(spark, head)
    if config.schema_file:
        mine.schema = dbml.parse(Path(config.schema_file).read_text())
    reshaped: set[str] = set()
    added: dict[tuple[str, str], set[str]] = {}
    by_uid = {s.uid: mine.names[s.uid] for s in head.sources.values()}
    if base is not None:
        theirs = schema.resolve(spark, base)
        odd = schema.reshaped(mine.schema, theirs.schema)
        reshaped = {u for u, t in by_uid.items() if t in odd}
        for (u, c), shape in theirs.shapes.items():
            added[mine.names.get(u, ""), c] = {p for p in mine.shapes.get((u, c), {}) if p and p not in shape}
            mine.shapes[u, c] = {**shape, **mine.shapes.get((u, c), {})}
    shapes = {(mine.names[u], c): s for (u, c), s in mine.shapes.items()}
    specs = schema.generator(mine.schema, shapes, {by_uid[s.uid]: s.loader for s in head.sources.values() if s.loader})
    tables = generate.tables(spark, specs, config.rows_for, config.seed, config.rows)
    frames = {u: tables[t] for u, t in by_uid.items() if t in tables}
    older = generate.as_on_base(specs, added)
    sizes = {t: config.rows_for.get(t, config.rows) for t in tables}
    on_base = {u: generate.one_table(spark, t, older[t], sizes[t], sizes, config.seed) for u, t in by_uid.items() if t in older}
    for s in head.sources.values():
        if s.uid not in frames:
            frames[s.uid] = generate.empty_stand_in(spark, s.columns or {"id": None})
    warnings = generate.warnings(specs) + [f"{u}: no columns are known" for u in mine.without] + mine.conflicts
    if config.schema_file:
        lacking, spare = schema.unmatched(tables, by_uid)
        warnings += [f"{u}: no table of {config.schema_file} serves it, so it is empty" for u in lacking] + [f"{t}: no source reads this table of {config.schema_file}" for t in spare]
    return frames, on_base, mine.guessed, reshaped, warnings, sizes


def verify(spark, args) -> Report:
    config = files.load_config(args.config)
    root = Path(args.repo_root) / config.project_dir
    if lacking := sorted(n for n in files.env_names(str(root)) if n not in os.environ):
        raise files.ConfigError(f"the project reads environment variables that are not set: {', '.join(lacking)}")
    head = load(str(root), config.vars)
    config.dialect = config.dialect or files.profile_dialect(str(root), head.profile)
    with files.worktree(args.repo_root, args.base_ref) if args.base_ref else nullcontext() as tree:
        base = load(str(Path(tree) / config.project_dir), config.vars) if tree else None
        with sinks.timed("sources", args.quiet):
            frames, on_base, guessed, reshaped, warnings, sizes = made_sources(spark, head, config, base)
        with sinks.timed("branches", args.quiet):
            out = run(spark, head, base, frames, config, guessed, reshaped, on_base)
    out.warnings, out.tables = warnings, sizes
    return out


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="planproof")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    for name in ("--base-ref", "--config", "--comment-file", "--summary-file"):
        r.add_argument(name)
    r.add_argument("--repo-root", default=".")
    r.add_argument("--fail-on-error", action=argparse.BooleanOptionalAction, default=None)
    r.add_argument("--quiet", action="store_true")
    s = sub.add_parser("schema")
    s.add_argument("--config")
    s.add_argument("--repo-root", default=".")
    s.add_argument("--output", default="schema.dbml")
    s.add_argument("--force", action="store_true")
    args = top.parse_args(argv)
    spark = local()
    config = files.load_config(args.config)
    if args.command == "schema":
        if Path(args.output).exists() and not args.force:
            print(f"{args.output} exists; --force replaces it", file=sys.stderr)
            return 1
        found = schema.resolve(spark, load(str(Path(args.repo_root) / config.project_dir), config.vars))
        sinks.write_text(dbml.write(schema.annotated(found)), args.output)
        return 0
    try:
        out = verify(spark, args)
    except Exception as e:
        out = Report(fatal=f"{type(e).__name__}: {e}")
    text = rp.markdown(out)
    print(text)
    if args.comment_file:
        sinks.write_text(text, args.comment_file)
    if args.summary_file:
        sinks.write_json(rp.summary(out), args.summary_file)
    fail = config.fail_on_error if args.fail_on_error is None else args.fail_on_error
    return int(fail and not out.passed)


if __name__ == "__main__":
    sys.exit(main())
