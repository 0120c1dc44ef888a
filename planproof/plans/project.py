"""A project of SQL models: reading its folder, building a branch of it on Spark, and what changed between two."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from planproof.operators import quality
from planproof.operators.judge import Result, not_verified
from planproof.operators.metrics import BiReader, Definition, Measure, Metric, SemanticModel, SemanticReader
from planproof.plans import template
from planproof.plans.dialect import fitted, without_layout
from planproof.plans.graph import Graph
from planproof.sources.files import seed as read_seed


@dataclass
class Source:
    source: str
    name: str
    identifier: str
    columns: dict[str, str | None] = field(default_factory=dict)
    tests: list[Test] = field(default_factory=list)
    notes: dict[str, str] = field(default_factory=dict)
    loader: str | None = None
    database: str | None = None

    @property
    def uid(self) -> str:
        return f"source.{self.source}.{self.name}"


@dataclass
class Test:
    kind: str  # not_null, unique, accepted_values, relationships, singular
    node: str
    column: str = ""
    args: dict = field(default_factory=dict)
    sql: str = ""
    severity: str = "error"
    name: str = ""

    @property
    def uid(self) -> str:
        return self.name or f"{self.kind}_{self.node.rpartition('.')[2]}_{self.column}"


@dataclass
class UnitTest:
    name: str
    model: str
    given: dict[str, list[dict]]
    expect: list[dict]


@dataclass
class Model:
    name: str
    sql: str
    path: str = ""
    layer: str = ""
    materialized: str = "view"
    description: str = ""
    columns: dict[str, dict] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)

    @property
    def uid(self) -> str:
        return f"model.{self.name}"


@dataclass
class Project:
    root: str
    models: dict[str, Model] = field(default_factory=dict)
    sources: dict[tuple[str, str], Source] = field(default_factory=dict)
    tests: list[Test] = field(default_factory=list)
    unit_tests: list[UnitTest] = field(default_factory=list)
    seeds: dict[str, str] = field(default_factory=dict)
    snapshots: dict[str, str] = field(default_factory=dict)
    macros: str = ""
    semantic_models: list[SemanticModel] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    vars: dict[str, object] = field(default_factory=dict)
    profile: str = ""
    edges: list[tuple[str, str]] = field(default_factory=list)
    test_reads: dict[str, set[str]] = field(default_factory=dict)

    # -------------------------------------------------------------- names

    def names(self, found: list[tuple[str, ...]], model: Model | None = None, relation=None) -> dict:
        """What templates can call. Each ref and source is noted in found."""

        def ref(*args):
            found.append(("ref", args[-1]))
            return relation("ref", args[-1]) if relation else f"`{args[-1]}`"

        def source(a, b):
            found.append(("source", a, b))
            return relation("source", a, b) if relation else f"`{a}__{b}`"

        def config(**kw):
            if model is not None:
                model.config |= without_layout(kw)
                model.materialized = kw.get("materialized", model.materialized)
            return ""

        def var(name, default=None):
            return self.vars.get(name, default)

        def env_var(name, default=None):
            value = os.environ.get(name, default)
            if value is None:
                raise template.TemplateError(f"environment variable `{name}` is not set")
            return value

        out = {"ref": ref, "source": source, "config": config, "var": var, "env_var": env_var, "is_incremental": lambda: False, "this": f"`{model.name}`" if model else "", "target": {"name": "local", "type": "spark"}}
        template.render(self.macros, out)
        return out

    def rendered(self, sql: str, model: Model | None = None, relation=None) -> tuple[str, list[tuple[str, ...]]]:
        found: list[tuple[str, ...]] = []
        return template.render(sql, self.names(found, model, relation)).strip().rstrip(";"), found

    def uid_of(self, call: tuple[str, ...]) -> str:
        if call[0] == "source":
            return f"source.{call[1]}.{call[2]}"
        kind = "seed" if call[1] in self.seeds else "snapshot" if call[1] in self.snapshots else "model"
        return f"{kind}.{call[1]}"

    def graph(self) -> Graph:
        g = Graph(self.edges)
        for m in self.models.values():
            g.children.setdefault(m.uid, [])
            g.parents.setdefault(m.uid, [])
        return g

    def compiled_metrics(self) -> list[Definition]:
        out = SemanticReader(self.semantic_models, self.metrics).all()
        for m in self.models.values():
            columns = {c: (d.get("meta") or {}).get("metrics") or {} for c, d in m.columns.items()}
            out += BiReader(m.name, columns, m.meta.get("metrics")).all()
        return out

    def digest(self, m: Model) -> str:
        """A model's text, settings and the macros it calls: what decides whether it is modified."""
        called = {n: b for n, b in re.findall(r"\{%-?\s*macro\s+(\w+)(.*?)\{%-?\s*endmacro", self.macros, re.S) if re.search(rf"\b{n}\s*\(", m.sql)}
        text = re.sub(r"\s+", " ", re.sub(r"--[^\n]*", "", m.sql)).strip()
        return hashlib.sha256(repr((text, m.materialized, sorted(m.config.items(), key=str), sorted(called.items()))).encode()).hexdigest()


def modified(head: Project, base: Project) -> set[str]:
    """Models and tests that are new or not as on base."""
    out = {m.uid for n, m in head.models.items() if n not in base.models or head.digest(m) != base.digest(base.models[n])}
    old = {t.uid: repr(t) for t in base.tests}
    return out | {f"test.{t.uid}" for t in head.tests if old.get(t.uid) != repr(t)}


# ------------------------------------------------------------------ reading


def load(root: str, variables: dict | None = None) -> Project:
    p = Project(root)
    top = Path(root)
    settings = yaml.safe_load((top / "dbt_project.yml").read_text()) if (top / "dbt_project.yml").exists() else {}
    p.vars = {**(settings.get("vars") or {}), **(variables or {})}
    p.profile = str(settings.get("profile") or settings.get("name") or "")
    p.macros = "\n".join(f.read_text() for f in sorted(top.glob("macros/**/*.sql")))
    for f in sorted(top.glob("seeds/**/*.csv")):
        p.seeds[f.stem] = str(f)
    for f in sorted(top.glob("snapshots/**/*.sql")):
        p.snapshots[f.stem] = f.read_text()
    for f in sorted(top.glob("models/**/*.sql")):
        parts = f.relative_to(top / "models").parts
        m = Model(f.stem, f.read_text(), str(f.relative_to(top)), parts[0] if len(parts) > 1 else "")
        for folder in parts[:-1]:
            m.materialized = ((settings.get("models") or {}).get(settings.get("name"), {}) or {}).get(folder, {}).get("+materialized", m.materialized)
        p.models[m.name] = m
    for f in sorted([*top.glob("models/**/*.yml"), *top.glob("models/**/*.yaml"), *top.glob("seeds/**/*.yml")]):
        _yaml(p, yaml.safe_load(f.read_text()) or {})
    for f in sorted(top.glob("tests/**/*.sql")):
        p.tests.append(Test("singular", "", sql=f.read_text(), name=f.stem))
    return linked(p)


def linked(p: Project) -> Project:
    """p with what reads what."""
    for m in p.models.values():
        try:
            _, found = p.rendered(m.sql, m)
        except template.TemplateError:
            found = [("source", *s) if k == "source" else ("ref", s[-1]) for k, s in ((k, re.findall(r"['\"]([^'\"]+)['\"]", a)) for k, a in re.findall(r"\b(ref|source)\(([^)]*)\)", m.sql))]
        p.edges += [(p.uid_of(c), m.uid) for c in dict.fromkeys(found)]
    for t in p.tests:
        reads = {t.node} - {""}
        if t.kind == "singular":
            reads |= {p.uid_of(c) for c in p.rendered(t.sql)[1]}
        if t.kind == "relationships":
            reads |= {p.uid_of(c) for c in p.rendered("{{ " + str(t.args.get("to")) + " }}")[1]}
        p.test_reads[t.uid] = reads
    return p


def _tests(node: str, column: str, raw) -> list[Test]:
    out = []
    for t in raw or []:
        kind, args = (t, {}) if isinstance(t, str) else next(iter(t.items()))
        args = {**(args or {})}
        args |= args.pop("arguments", {})
        severity = (args.pop("config", None) or {}).get("severity", args.pop("severity", "error"))
        out.append(Test(kind, node, column, args, severity=severity, name=args.pop("name", "")))
    return out


def _yaml(p: Project, raw: dict) -> None:
    for s in raw.get("sources") or []:
        for t in s.get("tables") or []:
            src = Source(s["name"], t["name"], t.get("identifier") or t["name"], loader=t.get("loader") or s.get("loader"), database=s.get("database"))
            for c in t.get("columns") or []:
                src.columns[c["name"]] = c.get("data_type")
                src.notes[c["name"]] = str((c.get("meta") or {}).get("note") or c.get("description") or "")
                src.tests += _tests(src.uid, c["name"], c.get("data_tests") or c.get("tests"))
            p.sources[src.source, src.name] = src
            p.tests += src.tests
    for kind in ("models", "seeds"):
        for d in raw.get(kind) or []:
            node = f"{kind[:-1]}.{d['name']}"
            m = p.models.get(d["name"])
            if m is not None:
                m.description = d.get("description") or ""
                m.meta = {**(d.get("meta") or {}), **((d.get("config") or {}).get("meta") or {})}
                m.columns = {c["name"]: {**c, "meta": {**(c.get("meta") or {}), **((c.get("config") or {}).get("meta") or {})}} for c in d.get("columns") or []}
                m.materialized = (d.get("config") or {}).get("materialized", m.materialized)
            for c in d.get("columns") or []:
                p.tests += _tests(node, c["name"], c.get("data_tests") or c.get("tests"))
            p.tests += _tests(node, "", d.get("data_tests") or d.get("tests"))
    for u in raw.get("unit_tests") or []:
        p.unit_tests.append(UnitTest(u["name"], u["model"], {g["input"]: g.get("rows") or [] for g in u.get("given") or []}, (u.get("expect") or {}).get("rows") or []))
    for s in raw.get("semantic_models") or []:
        named = re.findall(r"['\"]([^'\"]+)['\"]", str(s.get("model") or ""))
        measures = {m["name"]: Measure(m["name"], str(m.get("agg")), str(m.get("expr") or m["name"])) for m in s.get("measures") or []}
        dims = {d["name"]: str(d.get("expr") or d["name"]) for d in s.get("dimensions") or []}
        ents = {e["name"]: str(e.get("expr") or e["name"]) for e in s.get("entities") or []}
        p.semantic_models.append(SemanticModel(s["name"], named[-1] if named else None, measures, dims, [d["name"] for d in s.get("dimensions") or [] if d.get("type") == "categorical"], ents))
    for m in raw.get("metrics") or []:
        p.metrics.append(_metric(m))


def _metric(m: dict) -> Metric:
    t = m.get("type_params") or {}
    name = lambda v: v.get("name") if isinstance(v, dict) else v or ""
    texts = lambda v: [] if not v else [v] if isinstance(v, str) else list(v)
    measure = t.get("measure")
    window = t.get("window") or (t.get("cumulative_type_params") or {}).get("window") or ""
    grain = t.get("grain_to_date") or (t.get("cumulative_type_params") or {}).get("grain_to_date") or ""
    return Metric(
        m["name"], str(m.get("type") or "simple"), m.get("label") or "", name(measure), texts(m.get("filter")), texts(measure.get("filter")) if isinstance(measure, dict) else [],
        name(t.get("numerator")), name(t.get("denominator")), str(t.get("expr") or ""), [name(x) for x in t.get("metrics") or []], str(window), str(grain),
    )


# ------------------------------------------------------------------ building


def failed(name: str, e: Exception) -> Result:
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    if condition is None and (named := re.search(r"\[([A-Z][A-Z_.]{4,})\]", str(e))):
        condition = named[1]  # an error of a task comes as text
    said = (e.getMessageParameters() or {}) if isinstance(e, PySparkException) else {}
    return Result(name, "error", None, str(e).split("\n\nJVM")[0], condition, dict(said))


class Branch:
    """One version of a project on the given sources. Models are temporary views of the branch's own names over rows that
    are computed once and kept (in memory, then on disk) until the branch is closed, as tests, children and the
    comparison read them."""

    def __init__(self, spark: SparkSession, name: str, project: Project, sources: dict[str, DataFrame], dialect: str | None = None):
        self.spark, self.name, self.project, self.dialect = spark, name, project, dialect
        self.frames: dict[str, DataFrame] = dict(sources)
        self.results: dict[str, Result] = {}
        self.rows: dict[str, int] = {}
        for s, path in project.seeds.items():
            self.frames[f"seed.{s}"] = read_seed(spark, path)
        for uid, df in self.frames.items():
            df.createOrReplaceTempView(self.view(uid))

    def view(self, uid: str) -> str:
        return re.sub(r"\W", "_", f"{self.name}__{uid}")

    def relation(self, *call: str) -> str:
        return f"`{self.view(self.project.uid_of(call))}`"

    def build(self, selection: set[str] | None = None) -> dict[str, Result]:
        """Parents first; what stands behind a failure is skipped."""
        g = self.project.graph()
        for uid in g.ordered():
            if not uid.startswith("model.") or (selection is not None and uid not in selection):
                continue
            m = self.project.models[uid.removeprefix("model.")]
            if any(self.results[p].status != "success" for p in g.parents[uid] if p in self.results):
                self.results[uid] = Result(uid, "skipped")
                continue
            self.results[uid] = self._model(m)
        return self.results

    def _model(self, m: Model) -> Result:
        """Builds the model: its plan is analysed and its rows are computed, once, and kept for all that reads them; an error
        that shows only in the data is the model's result like any other."""
        df = None
        try:
            sql, _ = self.project.rendered(m.sql, m, self.relation)
            df = self.spark.sql(fitted(self.spark, sql, self.dialect)).persist()
            self.rows[m.uid] = df.count()
            self.frames[m.uid] = df
            df.createOrReplaceTempView(self.view(m.uid))
            return Result(m.uid, "success")
        except Exception as e:
            if df is not None:
                df.unpersist()
            return failed(m.uid, e)

    def test(self, t: Test) -> Result:
        try:
            if any(self.results.get(n, Result(n, "success")).status != "success" or (n not in self.frames and not n.startswith("test.")) for n in self.project.test_reads[t.uid]):
                return Result(t.uid, "skipped")
            if t.kind == "singular":
                rows = self.spark.sql(fitted(self.spark, self.project.rendered(t.sql, None, self.relation)[0], self.dialect))
            else:
                args = dict(t.args)
                if t.kind == "relationships":
                    call = self.project.rendered("{{ " + args["to"] + " }}")[1][0]
                    args["to"] = self.project.uid_of(call)
                rows = quality.run_test(t.kind, self.frames[t.node], t.column, self.frames, **args)
            n = rows.count()
            return Result(t.uid, ("warn" if t.severity == "warn" else "fail") if n else "pass", n)
        except Exception as e:
            return failed(t.uid, e)

    def unit(self, u: UnitTest) -> Result:
        """The model on the given rows; what a given row leaves out is NULL, typed as the input is."""
        m = self.project.models[u.model]
        try:
            inputs: dict[str, str] = {}
            for call, rows in u.given.items():
                uid = self.project.uid_of(self.project.rendered("{{ " + call + " }}")[1][0])
                kind = self.frames[uid].schema
                texts = ", ".join(f"`{f.name}` string" for f in kind.fields)
                raw = self.spark.createDataFrame([tuple(None if r.get(f.name) is None else str(r[f.name]) for f in kind.fields) for r in rows], texts)
                name = self.view(f"unit.{u.name}.{uid}")
                raw.select(*(raw[f.name].cast(f.dataType).alias(f.name) for f in kind.fields)).createOrReplaceTempView(name)
                inputs[uid] = name
            relation = lambda *c: f"`{inputs.get(self.project.uid_of(c), self.view(self.project.uid_of(c)))}`"
            sql, _ = self.project.rendered(m.sql, m, relation)
            cols = list(u.expect[0]) if u.expect else []
            expected = self.spark.createDataFrame([tuple(None if r[c] is None else str(r[c]) for c in cols) for r in u.expect], ", ".join(f"`{c}` string" for c in cols))
            r = quality.unit_test(lambda: self.spark.sql(fitted(self.spark, sql, self.dialect)), {}, expected)
            return Result(u.name, "pass" if r.passed else "fail", r.missing + r.unexpected, str(r.rows))
        except Exception as e:
            return failed(u.name, e)

    def unverified(self) -> set[str]:
        return {n for n, r in self.results.items() if not_verified(r)}

    def close(self) -> None:
        for uid, df in self.frames.items():
            self.spark.catalog.dropTempView(self.view(uid))
            if uid.startswith("model."):
                df.unpersist()
