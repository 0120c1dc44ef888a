"""The report as text and as data."""

from __future__ import annotations

import math
import re

from planproof.operators.judge import RANK
from planproof.plans.compare import MetricDiff, ModelDiff, Report

# How much of a report stands open.
OPEN_TESTS, NAMES, METRICS, MESSAGE_LINES, STEADY = 3, 5, 3, 20, 6
SCHEMA_VERSION = 2
TITLES = dict(zip(RANK, ("Nothing changed", "Passed", "Passed with warnings", "Failed", "Could not run")))


def number(v: object) -> str:
    """NULL as null; whole numbers grouped; below 1 four decimals, else two."""
    if v is None:
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_tuple"):
        return str(v)
    f = float(v)
    if math.isnan(f) or math.isinf(f):
        return str(f)
    if f == int(f):
        return f"{int(f):,}"
    return f"{f:,.4f}" if abs(f) < 1 else f"{f:,.2f}"


def delta(base: object, head: object) -> str:
    """Percent of |base| with sign; from 0 the difference; a dash without one side."""
    if base is None or head is None:
        return "–"
    b, h = float(base), float(head)
    if b == 0:
        return ("+" if h >= 0 else "-") + number(abs(h))
    return f"{(h - b) / abs(b) * 100:+.1f}%"


def share(part: float, whole: float) -> str:
    return f"{part / whole * 100:.0f}%" if whole else "–"


# Error classes in plain words; the parameters are Spark's.
_READINGS = {
    "UNRESOLVED_COLUMN": "It reads a column `{objectName}` that is not there.{proposal}",
    "TABLE_OR_VIEW_NOT_FOUND": "It reads `{relationName}`, which does not exist.",
    "UNRESOLVED_ROUTINE": "It calls a function `{routineName}` that this engine lacks.",
    "PARSE_SYNTAX_ERROR": "Its SQL does not parse near {error}.",
    "DATATYPE_MISMATCH": "Types do not fit in `{sqlExpr}`.",
    "DIVIDE_BY_ZERO": "It divides by zero.",
    "CAST_INVALID_INPUT": "A value cannot be read as {targetType}.",
}


def reading(condition: str | None, parameters: dict | None) -> str:
    parameters = dict(parameters or {})
    parameters["proposal"] = f" Did you mean {parameters['proposal']}?" if parameters.get("proposal") else ""
    for k, text in _READINGS.items():
        if (condition or "").startswith(k):
            return re.sub(r"\{(\w+)\}", lambda m: str(parameters.get(m[1], "?")), text).replace("``", "`")
    return ""


def moved_metrics(r: Report) -> list[tuple[str, MetricDiff]]:
    out = [(m.name, x) for m in r.models if m.diff for x in m.diff.metrics if x.moved]
    return out + [("", x) for x in r.spanning if x.moved]


def top_mover(r: Report) -> tuple[str, MetricDiff] | None:
    def rel(x: MetricDiff) -> float:
        return math.inf if not x.base else abs((float(x.head or 0) - float(x.base)) / float(x.base))

    found = moved_metrics(r)
    return min(found, key=lambda p: (-rel(p[1]), p[1].label, p[0])) if found else None


def plural(n: int, word: str) -> str:
    return f"{n:,} {word}" + ("" if n == 1 else "s")


def headline(r: Report) -> str:
    """The most serious first: what failed, what broke, what moved, what is the same."""
    if r.fatal:
        return r.fatal.split("\n")[0]
    if not r.changed:
        return "no model changed"
    parts = []
    if n := sum(m.outcome == "failed" for m in r.models):
        parts.append(f"{plural(n, 'model')} failed to build")
    if n := sum(not t.preexisting for m in r.models for t in m.tests):
        parts.append(f"{plural(n, 'test')} failed")
    if n := sum(m.fails and m.outcome != "failed" for m in r.models):
        parts.append(f"{plural(n, 'model')} not checked")
    if n := sum(v["severity"] == "error" for v in r.violations):
        parts.append(f"{plural(n, 'convention')} broken")
    diffs = [m.diff for m in r.models if m.diff]
    if n := sum(d.breaking for d in diffs):
        parts.append(f"{plural(n, 'model')} with breaking column changes")
    if top := top_mover(r):
        parts.append(f"{top[1].label} {number(top[1].base)} → {number(top[1].head)} ({delta(top[1].base, top[1].head)})")
        if more := len(moved_metrics(r)) - 1:
            parts.append(f"{plural(more, 'more metric')} moved")
    elif n := sum(bool(d.rows_differing) or d.rows_base != d.rows_head for d in diffs if d.base_exists):
        parts.append(f"rows differ in {plural(n, 'model')}")
    elif diffs and all(d.identical for d in diffs):
        parts.append("outputs identical")
    if n := sum(m.outcome == "not_verified" for m in r.models):
        parts.append(f"{plural(n, 'model')} not verified")
    return ", ".join(parts) or f"{plural(len(r.models), 'model')} built"


#: The folder whose models the headline counts as marts.
MARTS = "marts"


def headline_data(r: Report) -> dict | None:
    """The headline as counts with its text; None if nothing can be said. Without a base nothing is compared, so what a
    comparison would tell is None."""
    if r.fatal or not r.changed:
        return None
    failing = sum(m.outcome == "failed" for m in r.models) + sum(not t.preexisting for m in r.models for t in m.tests)
    of = lambda *names: sum(m.outcome in names for m in r.models)
    top = top_mover(r)
    told = {
        "moved_metrics": sum(x.moved for m in r.models if m.diff for x in m.diff.metrics),
        "top_metric": {k: getattr(top[1], k) for k in ("name", "label", "base", "head")} if top else None,
        "value_changed_models": sum(bool(m.diff and m.diff.base_exists and (m.diff.rows_differing or m.diff.rows_base != m.diff.rows_head)) for m in r.models),
        "touched_models": len(r.models),
        "touched_marts": sum(m.layer == MARTS for m in r.models),
    }
    return {
        "text": headline(r),
        "new_failures": failing + sum(v["severity"] == "error" for v in r.violations),
        "metrics_defined": r.metrics_defined,
        "unverified": of("unverified_broken_on_base", "not_verified"),
        "broken_on_base": of("broken_on_base"),
        "fixture_limited": of("fixture_limited"),
        "not_built": 0 if failing else of("skipped", "skipped_unchecked"),
        **(told if r.compared else dict.fromkeys(told)),
    }


def _diff_lines(d: ModelDiff) -> list[str]:
    if not d.base_exists:
        return [f"- new model: {plural(d.rows_head or 0, 'row')}, {plural(len(d.columns.added), 'column')}"]
    if d.identical:
        return ["- identical"]
    out = [f"- rows {number(d.rows_base)} → {number(d.rows_head)} ({delta(d.rows_base, d.rows_head)})" if d.rows_base != d.rows_head else f"- rows {number(d.rows_head)}"]
    if d.rows_differing:
        out.append(f"- {plural(d.rows_differing, 'row')} differ ({share(d.rows_differing, d.rows_head)})" + (f", on {plural(d.compared_columns, 'common column')}" if d.compared_columns is not None else ""))
    c, profiles = d.columns, {p.name: p for p in d.profiles}
    out += [f"- column added: `{n}` {t}" + (f" ({profiles[n].text()})" if n in profiles else "") for n, t in c.added]
    for what, rows in (("removed", [(n, f"`{n}` {t}") for n, t in c.removed]), ("renamed", [(a, f"`{a}` → `{b}`") for a, b in c.renamed])):
        out += [f"- column {what}: {text}" + (f"; still named in {', '.join(d.references[n])}" if d.references.get(n) else "") for n, text in rows]
    out += [f"- column retyped: `{n}` {a} → {b}" for n, a, b in c.retyped]
    return out


def _metric_lines(ms: list[MetricDiff], budget: int) -> list[str]:
    out = []
    for i, m in enumerate(x for x in ms if x.moved):
        out.append(f"- {m.label}: {number(m.base)} → {number(m.head)} ({delta(m.base, m.head)})" + (f", over {', '.join(m.spans)}" if m.spans else ""))
        for dim, rows in m.breakdown.items() if i < budget else ():
            out.append(f"  - by {dim}: " + "; ".join(f"{v} {number(b)} → {number(h)}" for v, b, h in rows))
    steady = [m.label for m in ms if not m.moved and not m.unsupported]
    if steady:
        out.append(f"- unmoved: {', '.join(steady[:STEADY])}" + (f" and {len(steady) - STEADY} more" if len(steady) > STEADY else ""))
    out += [f"- {m.label}: not evaluated ({m.unsupported})" for m in ms if m.unsupported]
    return out


def markdown(r: Report) -> str:
    out = [f"## {TITLES[r.verdict]}", "", headline(r), ""]
    if r.fatal:
        return "\n".join([*out, "```", *r.fatal.split("\n")[:MESSAGE_LINES], "```"]) + "\n"
    shown = 0
    for m in r.models:
        lines = []
        if m.outcome != "success":
            lines += [f"- {m.outcome.replace('_', ' ')}" + (": " + m.message.split("\n")[0] if m.message else "")]
            if plain := reading(m.condition, m.parameters):
                lines.append(f"  {plain}")
        for t in m.tests:
            text = f"test `{t.name}`: " + (f"{plural(t.failures, 'failing row')}" if t.failures else t.status) + (f" ({t.base_failures} on base)" if t.base_failures else "") + (", as on base" if t.preexisting else "")
            shown += not t.preexisting
            lines.append(f"- {text}" if shown <= OPEN_TESTS else f"<details><summary>{text}</summary>{t.message}</details>")
        lines += [f"- warning `{t.name}`: {plural(t.failures or 0, 'row')}" for t in m.warnings]
        if m.diff:
            lines += _diff_lines(m.diff) + _metric_lines(m.diff.metrics, METRICS)
        if m.tests_passed:
            lines.append(f"- {plural(m.tests_passed, 'test')} passed")
        if m.name in r.changed or m.outcome != "success" or m.tests or (m.diff and not m.diff.identical):
            out += [f"### {m.name}", *(lines or ["- built"]), ""]
    rest = [m.name for m in r.models if m.name not in r.changed and m.outcome == "success" and not m.tests and not (m.diff and not m.diff.identical)]
    if rest:
        out += [f"Also built: {', '.join(rest[:NAMES])}" + (f" and {len(rest) - NAMES} more" if len(rest) > NAMES else ""), ""]
    if r.spanning:
        out += ["### Metrics over several models", *_metric_lines(r.spanning, 0), ""]
    if r.violations:
        out += ["### Conventions", *(f"- {v['severity']}: {v['model']}: {v['message']}" for v in r.violations), ""]
    if r.tables:
        out += ["### Data", f"- {plural(len(r.tables), 'source table')}, {plural(sum(r.tables.values()), 'row')}", *(f"- {w}" for w in r.warnings), ""]
    return "\n".join(out).rstrip() + "\n"


def counts(r: Report) -> dict[str, int]:
    bucket = {"success": "built", "failed": "failed", "not_verified": "not_verified", "broken_on_base": "broken_on_base", "fixture_limited": "fixture_limited"}
    out = dict.fromkeys(["in_scope", *bucket.values(), "skipped", "tests_passed", "tests_failed", "tests_preexisting", "tests_warned"], 0)
    for m in r.models:
        out["in_scope"] += 1
        out[bucket.get(m.outcome, "skipped")] += 1
        out["tests_passed"] += m.tests_passed
        out["tests_failed"] += sum(not t.preexisting for t in m.tests)
        out["tests_preexisting"] += sum(t.preexisting for t in m.tests)
        out["tests_warned"] += len(m.warnings)
    return out


def summary(r: Report) -> dict:
    def metric(x: MetricDiff) -> dict:
        return {"name": x.name, "label": x.label, "base": x.base, "head": x.head, "moved": x.moved, "unsupported": x.unsupported or None, "spans": x.spans, "breakdown": x.breakdown}

    def facets(d: ModelDiff) -> dict:
        return {
            "base_exists": d.base_exists, "identical": d.identical, "breaking": d.breaking, "schema_changed": d.columns.changed, "rows_base": d.rows_base, "rows_head": d.rows_head, "rows_differing": d.rows_differing, "rows_changed": d.rows_base != d.rows_head,
            "compared_columns": d.compared_columns, "added": d.columns.added, "removed": d.columns.removed, "retyped": d.columns.retyped, "renamed": d.columns.renamed, "references": d.references,
            "profiles": [vars(p) for p in d.profiles], "metrics": [metric(x) for x in d.metrics],
        }

    return {
        "schema_version": SCHEMA_VERSION, "verdict": r.verdict, "headline": headline_data(r), "passed": r.passed, "changed": r.changed, "counts": counts(r), "violations": r.violations, "fatal": r.fatal or None, "tables": r.tables, "warnings": r.warnings,
        "models": [{"name": m.name, "outcome": m.outcome, "fails": m.fails, "message": m.message, "tests_passed": m.tests_passed, "tests": [vars(t) for t in m.tests], "warnings": [vars(t) for t in m.warnings], "diff": facets(m.diff) if m.diff else None} for m in r.models],
        "spanning": [metric(x) for x in r.spanning],
    }


def rename_detected(data: dict) -> bool:
    """Whether a summary tells of a renamed column."""
    return any(m["diff"] and m["diff"]["renamed"] for m in data["models"])
