"""Both branches on the same data: what the change broke, and what it changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planproof.operators import breakdown as bd
from planproof.operators import conventions as cv
from planproof.operators import diff, judge, metrics, profile
from planproof.operators.judge import Result
from planproof.plans.dialect import rewritten
from planproof.plans.lineage import mentions
from planproof.plans.project import Branch, Project, modified
from planproof.sources.files import Config


@dataclass
class MetricDiff:
    name: str
    label: str
    base: object = None
    head: object = None
    unsupported: str = ""
    breakdown: dict[str, list[tuple[object, object, object]]] = field(default_factory=dict)
    spans: list[str] = field(default_factory=list)

    @property
    def moved(self) -> bool:
        return not self.unsupported and metrics.values_moved(self.base, self.head)


@dataclass
class ModelDiff:
    name: str
    base_exists: bool = True
    columns: diff.SchemaDiff = field(default_factory=diff.SchemaDiff)
    profiles: list[profile.ColumnProfile] = field(default_factory=list)
    references: dict[str, list[str]] = field(default_factory=dict)
    rows_base: int | None = None
    rows_head: int | None = None
    rows_differing: int | None = None
    compared_columns: int | None = None  # None: all
    metrics: list[MetricDiff] = field(default_factory=list)

    @property
    def breaking(self) -> bool:
        return self.columns.breaking

    @property
    def identical(self) -> bool:
        return self.base_exists and not self.columns.changed and self.rows_base == self.rows_head and not self.rows_differing and not any(m.moved for m in self.metrics)


def compare_model(name: str, head: DataFrame, base: DataFrame | None, defs: list[metrics.Definition], dims: dict[str, str] | None = None, texts: dict[str, str] | None = None) -> ModelDiff:
    """Jobs: one per side for metrics and row counts together, one for the rows; profiles, renames and breakdowns only
    where there is something to tell. Sides with the same plan are not run twice."""
    d = ModelDiff(name)
    count = metrics.Definition("__rows", metrics.Leaf(name, "count", "*"))
    mine = [m for m in defs if m.relation == name and not m.spans]
    now, bad = metrics.evaluate(head, [count, *mine])
    d.rows_head = now.pop("__rows")
    if base is None:
        d.base_exists = False
        d.columns.added = list(diff.columns_of(head).items())
        return d
    if diff.identical_plan(head, base):
        d.rows_base, d.rows_differing, then, worse = d.rows_head, 0, dict(now), dict(bad)
    else:
        then, worse = metrics.evaluate(base, [count, *mine])
        d.rows_base = then.pop("__rows")
        d.columns = diff.with_renames(head, base)
        common = diff.common_columns(head, base)
        same = {c.lower(): t for c, t in diff.columns_of(head).items()} == {c.lower(): t for c, t in diff.columns_of(base).items()}
        d.compared_columns = None if same else len(common)
        d.rows_differing = diff.row_diff(head, base, common).first()["only_head"]
        d.profiles = profile.profile(head, [c for c, _ in d.columns.added])
        for c in [c for c, _ in d.columns.removed] + [a for a, _ in d.columns.renamed]:
            d.references[c] = mentions(c, texts or {})
    for m in mine:
        x = MetricDiff(m.name, m.label or m.name, then.get(m.name), now.get(m.name), bad.get(m.name, "") or (worse.get(m.name, "") if now.get(m.name) is None else ""))
        d.metrics.append(x)
    moved = [m for m in mine if any(x.name == m.name and x.moved for x in d.metrics)]
    if moved and dims:
        resolves = lambda df, e: not metrics.unresolved(df, metrics.config_metrics([{"name": "d", "model": name, "sql": f"max({e})"}])[0])
        usable = {n: e for n, e in dims.items() if resolves(head, e) and resolves(base, e)}
        kept = [r["dimension"] for r in bd.gate(head, usable).collect()] if usable else []
        if kept:
            # One pass a side for all metrics that moved; what comes back is ROWS values a dimension and metric.
            rows = bd.top_contributors(bd.breakdowns(head, base, {n: usable[n] for n in kept}, moved)).orderBy("metric", "dimension", "place").collect()
            for x in d.metrics:
                mine = [r for r in rows if r["metric"] == x.name]
                if mine:
                    x.breakdown = {n: [(r["value"], r["base"], r["head"]) for r in mine if r["dimension"] == n] for n in kept}
    return d


def spanning(defs: list[metrics.Definition], head: dict[str, DataFrame], base: dict[str, DataFrame], compared: set[str]) -> list[MetricDiff]:
    """Metrics over several relations of which one was compared. A relation that is not on base counts as no value."""
    out = []
    for m in defs:
        over = set(m.relations)
        if not m.spans or not over & compared:
            continue
        x = MetricDiff(m.name, m.label or m.name, spans=sorted(over))
        try:
            x.head = metrics.combine(m, head).first()[0]
        except (metrics.NotEvaluated, PySparkException) as e:
            x.unsupported = metrics.reason(e)
        try:
            x.base = metrics.combine(m, base).first()[0] if not x.unsupported else None
        except (metrics.NotEvaluated, PySparkException):
            x.base = None
        out.append(x)
    return out


@dataclass
class FailedTest:
    name: str
    status: str
    failures: int | None
    message: str
    preexisting: bool = False
    base_failures: int | None = None


@dataclass
class ModelReport:
    name: str
    outcome: str  # success, failed, skipped..., broken_on_base, fixture_limited, not_verified
    fails: bool
    message: str = ""
    tests_passed: int = 0
    tests: list[FailedTest] = field(default_factory=list)
    warnings: list[FailedTest] = field(default_factory=list)
    diff: ModelDiff | None = None
    layer: str = ""
    condition: str | None = None
    parameters: dict = field(default_factory=dict)


@dataclass
class Report:
    changed: list[str] = field(default_factory=list)
    models: list[ModelReport] = field(default_factory=list)
    violations: list[dict] = field(default_factory=list)
    spanning: list[MetricDiff] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    tables: dict[str, int] = field(default_factory=dict)
    fatal: str = ""
    dialect_errors: bool = False
    compared: bool = False
    metrics_defined: int = 0

    @property
    def failing(self) -> int:
        n = sum(m.fails for m in self.models) + sum(not t.preexisting for m in self.models for t in m.tests) + sum(v["severity"] == cv.ERROR for v in self.violations)
        return n + (sum(m.outcome == "not_verified" for m in self.models) if self.dialect_errors else 0)

    @property
    def warned(self) -> int:
        """A moved metric alone is no warning."""
        soft = sum(m.outcome in ("not_verified", "broken_on_base", "fixture_limited") or bool(m.warnings) or any(t.preexisting for t in m.tests) or bool(m.diff and m.diff.breaking) for m in self.models)
        return soft + sum(v["severity"] == cv.WARN for v in self.violations)

    @property
    def verdict(self) -> str:
        return judge.verdict(bool(self.fatal), len(self.changed), self.failing, self.warned)

    @property
    def passed(self) -> bool:
        return not self.fatal and not self.failing


def convention_rows(spark: SparkSession, p: Project, names: list[str], frames: dict[str, DataFrame], c: cv.Conventions) -> list[dict]:
    models = [p.models[n] for n in names]
    if not models:
        return []
    up = p.graph().parents
    kind = lambda m, k: sum(x.startswith(k) for x in up.get(m.uid, ()))
    nodes = spark.createDataFrame([(m.name, m.layer, kind(m, "source."), kind(m, "model."), bool(m.description)) for m in models], "model string, layer string, sources int, refs int, described boolean")
    tests = spark.createDataFrame([(t.node.removeprefix("model."), t.column, t.kind) for t in p.tests if t.node.startswith("model.")], "model string, column string, test string")
    cols = spark.createDataFrame([(m.name, m.layer, n, t) for m in models if m.uid in frames for n, t in diff.columns_of(frames[m.uid]).items()], "model string, layer string, column_name string, type string")
    on = lambda r: c.severity(r) != cv.OFF
    parts = []
    if on("naming"):
        parts.append(cv.naming(nodes, c.layers, c.severity("naming"), c.hints))
    if on("layering"):
        parts.append(cv.layering(nodes, c.source_layer, c.severity("layering")))
    if on("description"):
        parts.append(cv.description(nodes, c.severity("description")))
    if on("primary_key"):
        parts.append(cv.primary_key(nodes, tests, c.severity("primary_key")))
    if on("column_naming"):
        parts.append(cv.column_naming(cols, c.severity("column_naming"), c.layers).drop("column_name"))
    out = []
    for x in parts:
        out += [r.asDict() for r in x.orderBy("model", "message").collect()]
    return out


def run(spark: SparkSession, head: Project, base: Project | None, sources: dict[str, DataFrame], config: Config | None = None, guessed: dict[str, set[str]] | None = None, reshaped: set[str] = frozenset(), on_base: dict[str, DataFrame] | None = None) -> Report:
    """sources: by uid, the same for both branches but for those in on_base. Without a base everything is changed and nothing is compared."""
    config = config or Config()
    report = Report(dialect_errors=config.dialect_errors, compared=base is not None)
    report.metrics_defined = len(head.compiled_metrics()) + len(config.metrics)
    g = head.graph()
    changed = modified(head, base) if base else {m.uid for m in head.models.values()}
    edited = {c.removeprefix("test.") for c in changed if c.startswith("test.")}
    touched = {c for c in changed if c.startswith("model.")}
    for t in head.tests:
        if t.uid in edited:
            touched |= {n for n in head.test_reads[t.uid] if n.startswith("model.")} if base else set()
    touched |= {c for s in reshaped for c in g.descendants(s) if c.startswith("model.")}
    report.changed = sorted(c.removeprefix("model.") for c in touched)
    if not touched:
        return report
    models_of_test = {t: {n for n in r if n.startswith("model.")} for t, r in head.test_reads.items()}
    selection = g.affected(touched, models_of_test)
    reach = set(g.depths(touched))
    h = Branch(spark, "head", head, sources, config.dialect)
    b = Branch(spark, "base", base, {**sources, **(on_base or {})}, config.dialect) if base else None
    h.build(selection)
    base_results: dict[str, Result] = {}
    if b:
        base_results = dict(b.build({u for u in selection if u.removeprefix("model.") in base.models}))
        base_results |= {t.uid: b.test(t) for t in base.tests if base.test_reads[t.uid] & (set(b.results) | set(sources))}
    guessed_models = set(g.bound(guessed or {})) if guessed else set()
    reached_tests = {t for t, r in models_of_test.items() if r & reach}
    usable = judge.usable_base(base_results, edited, {t for t, r in models_of_test.items() if r & {d for s in reshaped for d in g.depths([s])}}, {t for t, r in head.test_reads.items() if r & guessed_models}, reached_tests)
    reports: dict[str, ModelReport] = {}
    for uid, r in h.results.items():
        name = uid.removeprefix("model.")
        old = base_results.get(uid)
        if r.status == "success":
            reports[uid] = ModelReport(name, "success", False)
        elif judge.not_verified(r):
            reports[uid] = ModelReport(name, "not_verified", False, r.message)
        elif r.status == "error":
            data = (judge.data_shaped(r) and g.reads_source(uid)) or uid in guessed_models
            outcome, fails = judge.model_outcome(r, old, data=data, reached=uid in reach, modified=uid in touched)
            reports[uid] = ModelReport(name, outcome, fails, r.message)
        else:
            behind = {reports[p].outcome for p in g.ancestors(uid) if p in reports and reports[p].outcome not in ("success",) and not reports[p].outcome.startswith("skipped")}
            if behind == {"not_verified"}:
                reports[uid] = ModelReport(name, "not_verified", False)
            else:
                outcome, fails = judge.skipped_outcome(behind, uid in reach, old is not None and old.status == "skipped")
                reports[uid] = ModelReport(name, outcome, fails)
    for t in head.tests:
        reads = head.test_reads[t.uid] & set(reports)
        if not reads:
            continue
        owner = reports[max(reads, key=lambda n: (n == t.node, n in touched, n))]
        r = h.test(t)
        if r.status in judge.FAILING:
            old = usable.get(t.uid)
            owner.tests.append(FailedTest(t.uid, r.status, r.failures, r.message, judge.preexisting(r, old), old.failures if old else None))
        elif r.status == "warn":
            owner.warnings.append(FailedTest(t.uid, r.status, r.failures, r.message))
        elif r.status == "pass":
            owner.tests_passed += 1
    for u in head.unit_tests:
        if f"model.{u.model}" in reports and reports[f"model.{u.model}"].outcome == "success":
            r = h.unit(u)
            if r.status == "pass":
                reports[f"model.{u.model}"].tests_passed += 1
            else:
                reports[f"model.{u.model}"].tests.append(FailedTest(u.name, r.status, r.failures, r.message))
    built = {u for u, x in reports.items() if x.outcome == "success"}
    if b:
        defs = metrics.first_of_each([m for m in head.compiled_metrics() if m.source == "semantic"], [m for m in head.compiled_metrics() if m.source == "bi"], metrics.config_metrics(config.metrics))
        if config.dialect:
            defs = [m.translated(lambda sql: rewritten(sql, config.dialect)) for m in defs]
        snapshots = {f"snapshot.{s}" for s in head.snapshots}
        for uid in g.comparable(touched, built, snapshots):
            name = uid.removeprefix("model.")
            texts = {f"model {n}": m.sql for n, m in head.models.items() if n != name} | {f"metadata of {n}": str((m.columns, m.meta)) for n, m in head.models.items()} | {f"semantic model {s.name}": str(s) for s in head.semantic_models} | {f"test {t.uid}": f"{t.column} {t.sql}" for t in head.tests}
            sm = next((s for s in head.semantic_models if s.relation == name), None)
            dims = {d: sm.dimensions[d] for d in sm.categorical} if sm else bi_dimensions(head, name)
            try:
                reports[uid].diff = compare_model(name, h.frames[uid], b.frames.get(uid), defs, dims, texts)
            except Exception as e:  # what can be computed on either side can still not be comparable
                reports[uid].message = f"not compared: {metrics.reason(e)}"
                report.warnings.append(f"{name}: {reports[uid].message}")
        short = lambda f: {u.removeprefix("model."): d for u, d in f.items() if u.startswith("model.")}
        report.spanning = spanning(defs, short(h.frames), short(b.frames), {x.name for x in reports.values() if x.diff})
    for uid, x in reports.items():
        x.layer = head.models[x.name].layer
        if x.message and uid in h.results:
            x.condition, x.parameters = h.results[uid].condition, h.results[uid].parameters
    report.models = sorted(reports.values(), key=lambda x: x.name)
    report.violations = convention_rows(spark, head, [n for n in report.changed if n in head.models], h.frames, config.conventions)
    h.close()
    if b:
        b.close()
    return report


def bi_dimensions(p: Project, model: str) -> dict[str, str]:
    """String dimensions of a BI tool's metadata that are not hidden and not the primary key."""
    m = p.models[model]
    key = m.meta.get("primary_key")
    out = {}
    for c, d in m.columns.items():
        spec = (d.get("meta") or {}).get("dimension") or {}
        if spec.get("type") == "string" and not spec.get("hidden") and c != key:
            out[c] = str(spec.get("sql") or c).replace("${TABLE}.", "")
    return out
