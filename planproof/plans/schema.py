"""Source schemas of a project: declared columns, tests, and what the readers' SQL says about the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from planproof.plans import infer, jsonshape
from planproof.plans.generate import Spec, TableSpec
from planproof.plans.lineage import Analysis, Reads, macro_columns, parse, pass_through, placeheld, typed_nulls
from planproof.plans.project import Project
from planproof.sources.dbml import ColumnDef, Schema, TableDef

_DECLARED = {
    "int": "int64 int integer bigint smallint tinyint number", "float": "float64 float double real", "decimal": "numeric bignumeric decimal", "boolean": "bool boolean",
    "timestamp": "datetime timestamp timestamp_ntz timestamp_tz timestamp_ltz timestamptz", "date": "date", "varchar": "string text char varchar", "json": "json jsonb variant super",
}
_BY_NAME = {n: t for t, names in _DECLARED.items() for n in names.split()}


def short_type(declared: str | None) -> str | None:
    """A declared type's short name, without precision; unknown ones are varchar."""
    return _BY_NAME.get(declared.split("(")[0].strip().lower(), "varchar") if declared else None


@dataclass
class Resolved:
    schema: Schema
    guessed: dict[str, set[str]] = field(default_factory=dict)
    unknown: dict[str, set[str]] = field(default_factory=dict)
    shapes: dict[tuple[str, str], jsonshape.Shape] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    without: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)


def table_names(p: Project) -> dict[str, str]:
    """Source uid -> table name: its identifier, with the source's name before it where two share one; wildcards and
    odd characters become `_`."""
    clean = lambda t: re.sub(r"\W+", "_", t).strip("_")
    plain = {s.uid: clean(s.identifier) for s in p.sources.values()}
    twice = {n for n in plain.values() if list(plain.values()).count(n) > 1}
    return {s.uid: f"{clean(s.source)}__{plain[s.uid]}" if plain[s.uid] in twice else plain[s.uid] for s in p.sources.values()}


def _readers(spark: SparkSession, p: Project, out: Resolved) -> dict[str, list[tuple[str, Reads]]]:
    """Source uid -> (model, what it reads). A model that reads another model's column reads the source column that this
    is, through renames, casts and stars, as far as models keep it."""
    found: dict[str, list[tuple[str, Reads]]] = {}
    outputs: dict[str, dict[str, tuple[str, str]]] = {}  # model -> its column -> (source uid, column)
    whole: dict[str, str] = {}  # model -> the source whose rows and columns it hands on
    order = [n.removeprefix("model.") for n in p.graph().ordered() if n.startswith("model.")]
    for name in order:
        m = p.models[name]
        try:
            text, names = placeheld(m.sql)
            plan = parse(spark, text)
            got = Analysis(plan).reads
        except PySparkException as e:
            out.skipped[name] = str(e).split("\n")[0][:160]
            continue
        to = lambda key, c: (p.uid_of(names[key]), c) if names[key][0] == "source" else outputs.get(names[key][1], {}).get(c) or ((whole[names[key][1]], c) if names[key][1] in whole else None)
        mine: dict[str, Reads] = {}
        for key in names:
            if names[key][0] == "source":
                mine.setdefault(p.uid_of(names[key]), Reads({"x": {}}))
                if key in got.stars:
                    mine[p.uid_of(names[key])].stars.add("x")
            for c, use in got.columns.get(key, {}).items():
                if base := to(key, c):
                    r = mine.setdefault(base[0], Reads({"x": {}}))
                    u = r.use("x", base[1])
                    u.casts |= use.casts
                    u.hints |= use.hints
                    u.json |= use.json
        outputs[name] = {}
        for o, (key, c) in got.outputs.items():
            if key in names and (base := to(key, c)):
                outputs[name][o] = base
        for key in got.stars & set(names):
            if names[key][0] == "ref":
                outputs[name] |= {c: b for c, b in outputs.get(names[key][1], {}).items() if c not in outputs[name]}
        handed = pass_through(plan)
        if handed in names:
            uid = p.uid_of(names[handed])
            if uid.startswith("source."):
                whole[name] = uid
            elif names[handed][1] in whole:
                whole[name] = whole[names[handed][1]]
        for uid, r in mine.items():
            r.grain_kept, r.ambiguous = got.grain_kept, got.ambiguous
            r.outputs = {o: b[1] for o, b in outputs[name].items() if b[0] == uid}
            found.setdefault(uid, []).append((name, r))
    return found


def resolve(spark: SparkSession, p: Project) -> Resolved:
    out = Resolved(Schema())
    out.names = table_names(p)
    readers = _readers(spark, p, out)
    columns: dict[str, dict[str, tuple[str | None, set[str], set[str]]]] = {}
    for s in p.sources.values():
        mine = {c: (short_type(t), set(), set()) for c, t in s.columns.items()}
        low = {c.lower(): c for c in mine}
        for model, got in readers.get(s.uid, []):
            for c, use in got.columns["x"].items():
                name = low.setdefault(c, c)
                t, casts, hints = mine.get(name, (None, set(), set()))
                mine[name] = (t, casts | {x for x in map(short_type, use.casts) if x}, hints | use.hints)
                shape = jsonshape.of_reads(use.json)
                if shape:
                    out.shapes[s.uid, name] = jsonshape.merged(out.shapes.get((s.uid, name), {}), shape)
            _, names = placeheld(p.models[model].sql)
            for c, t in typed_nulls(parse(spark, placeheld(p.models[model].sql)[0])).items():
                if not s.columns and len(names) == 1 and c.lower() not in low:
                    mine[c] = ("int" if infer.type_by_name(c) == "int" else short_type(t), set(), set())
            for c in macro_columns(p.models[model].sql):
                if c.lower() not in low and not s.columns and len(names) == 1:
                    mine[c] = (None, set(), set())
        for c, text in s.notes.items():
            shape = jsonshape.parse_note(text)
            if shape is None:
                out.shapes.pop((s.uid, c), None)
            elif shape:
                out.shapes[s.uid, c] = jsonshape.merged(out.shapes.get((s.uid, c), {}), shape)
        if mine:
            columns[s.uid] = mine
        else:
            out.without.append(s.uid)
    lists = {out.names[u]: list(cols) for u, cols in columns.items()}
    source_of = {out.names[s.uid]: s.source for s in p.sources.values()}
    for s in p.sources.values():
        if s.uid in columns:
            _table(out, p, s, columns[s.uid], lists, source_of, readers.get(s.uid, []))
    return out


def _table(out: Resolved, p: Project, s, cols, lists, source_of, readers) -> None:
    name = out.names[s.uid]
    t = TableDef(name)
    tests: dict[str, dict[str, dict]] = {}
    for x in s.tests:
        tests.setdefault(x.column, {})[x.kind] = x.args
    # A model that keeps the source's rows says with its tests what holds for the source's columns.
    for model, got in readers:
        if got.grain_kept:
            for x in p.tests:
                if x.node == f"model.{model}" and x.column.lower() in got.outputs:
                    tests.setdefault(got.outputs[x.column.lower()], {}).setdefault(x.kind, x.args)
    refs = {}
    for c in cols:
        to = tests.get(c, {}).get("relationships")
        if to and "source(" in str(to.get("to")):
            a, b = re.findall(r"['\"]([^'\"]+)['\"]", to["to"])[:2]
            refs[c] = (out.names.get(f"source.{a}.{b}", b), to.get("field", "id"))
        elif target := infer.foreign_key(name, c, lists, source_of):
            refs[c] = (target, "id")
    for c, (declared, casts, hints) in cols.items():
        if len(casts) > 1:
            out.conflicts.append(f"{name}.{c}: read as {', '.join(sorted(casts))}")
        usage = next((h for h in ("numeric", "varchar", "boolean") if h in hints), None)
        kind = declared or infer.resolve_type(c, sorted(casts)[0] if casts else None, usage, c in refs)
        if declared is None and not casts and usage is None:
            out.guessed.setdefault(s.uid, set()).add(c)
        d = ColumnDef(c, kind, unique="unique" in tests.get(c, {}), not_null="not_null" in tests.get(c, {}))
        if values := tests.get(c, {}).get("accepted_values", {}).get("values"):
            if all(isinstance(v, str) for v in values):
                d.type = f"{name}_{c}"
                out.schema.enums[d.type] = list(values)
        if (s.uid, c) in out.shapes:
            d.note = jsonshape.note(out.shapes[s.uid, c])
        t.columns.append(d)
    by = {c.name.lower(): c for c in t.columns}
    key = by.get("id") or next((c for c in t.columns if c.unique and c.not_null), None)
    if key:
        key.pk = True
    out.schema.tables[name] = t
    out.schema.refs += [(name, c, *target) for c, target in refs.items() if c in cols]


def generator(r: Schema, shapes: dict[tuple[str, str], jsonshape.Shape] | None = None, loaders: dict[str, str] | None = None) -> dict[str, TableSpec]:
    """How to fill the tables of a schema. shapes: (table, column) -> JSON shape."""
    out = {}
    refers = {(a, b): c for a, b, c, _ in r.refs if c in r.tables}
    for name, t in r.tables.items():
        cols = {}
        for c in t.columns:
            enum = r.enums.get(c.type)
            spec = Spec("varchar" if enum or c.type == "json" else c.type, unique=c.pk or c.unique, values=enum or [], refers=refers.get((name, c.name)))
            shape = (shapes or {}).get((name, c.name)) or (jsonshape.parse_note(c.note) if "JSON:" in c.note else None)
            if shape:
                spec.json = shape
            cols[c.name] = spec
        out[name] = TableSpec(cols, list(t.unique_together), (loaders or {}).get(name))
    return out


def reshaped(head: Schema, base: Schema) -> set[str]:
    """Tables that are not the same on both branches."""
    return {t for t in {*head.tables, *base.tables} if head.tables.get(t) != base.tables.get(t) or {r for r in head.refs if r[0] == t} != {r for r in base.refs if r[0] == t}}


def unmatched(made: dict[str, object], names: dict[str, str]) -> tuple[list[str], list[str]]:
    """Sources that no made table serves, and tables that no source declares."""
    return sorted(u for u, n in names.items() if n not in made), sorted(n for n in made if n not in names.values())


def annotated(r: Resolved) -> Schema:
    """The schema with a note on each column whose type only its name suggests."""
    for uid, names in r.guessed.items():
        for c in r.schema.tables[r.names[uid]].columns:
            if c.name in names and not c.note:
                c.note = "type guessed by name"
    return r.schema
