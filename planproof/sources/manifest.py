"""A compiled project as one JSON document: nodes, sources, tests, metrics and their edges, read into a Project."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from planproof.operators.metrics import Measure, SemanticModel
from planproof.plans.project import Model, Project, Source, Test, UnitTest, _metric


def load(path: str) -> Project:
    return read(json.loads(Path(path).read_text()))


def _short(uid: str) -> str:
    kind, _, rest = uid.partition(".")
    parts = rest.split(".")
    return f"source.{parts[-2]}.{parts[-1]}" if kind == "source" else f"{kind}.{parts[-1]}"


def read(raw: dict) -> Project:
    """Unique ids lose their package, as projects here have one name space."""
    p = Project(".")
    for s in (raw.get("sources") or {}).values():
        src = Source(s["source_name"], s["name"], s.get("identifier") or s["name"], {c["name"]: c.get("data_type") for c in (s.get("columns") or {}).values()}, loader=s.get("loader"), database=s.get("database"))
        p.sources[src.source, src.name] = src
    for uid, n in (raw.get("nodes") or {}).items():
        kind = n.get("resource_type")
        if kind == "model":
            folders = Path(n.get("path") or "").parts
            config = n.get("config") or {}
            columns = {c: {**d, "meta": {**(d.get("meta") or {}), **((d.get("config") or {}).get("meta") or {})}} for c, d in (n.get("columns") or {}).items()}
            p.models[n["name"]] = Model(n["name"], n.get("raw_code") or "", n.get("original_file_path") or "", folders[0] if len(folders) > 1 else "", config.get("materialized", "view"), n.get("description") or "", columns, {**(n.get("meta") or {}), **(config.get("meta") or {})})
        elif kind == "seed":
            p.seeds[n["name"]] = n.get("original_file_path") or ""
        elif kind == "snapshot":
            p.snapshots[n["name"]] = n.get("raw_code") or ""
        elif kind == "test":
            meta = n.get("test_metadata") or {}
            args = {k: v for k, v in (meta.get("kwargs") or {}).items() if k not in ("column_name", "model")}
            node = _short(n["attached_node"]) if n.get("attached_node") else ""
            t = Test(meta.get("name") or "singular", node, n.get("column_name") or "", args, "" if meta else n.get("raw_code") or "", str((n.get("config") or {}).get("severity") or "error").lower(), n["name"])
            p.tests.append(t)
            p.test_reads[t.uid] = {_short(d) for d in (n.get("depends_on") or {}).get("nodes") or []}
            for s in p.sources.values():
                if s.uid == node:
                    s.tests.append(t)
        if kind in ("model", "snapshot"):
            p.edges += [(_short(d), _short(uid)) for d in (n.get("depends_on") or {}).get("nodes") or []]
    for u in (raw.get("unit_tests") or {}).values():
        p.unit_tests.append(UnitTest(u["name"], u["model"], {g["input"]: g.get("rows") or [] for g in u.get("given") or []}, (u.get("expect") or {}).get("rows") or []))
    for s in (raw.get("semantic_models") or {}).values():
        model = next((_short(d).partition(".")[2] for d in (s.get("depends_on") or {}).get("nodes") or []), None)
        named = lambda k: {x["name"]: str(x.get("expr") or x["name"]) for x in s.get(k) or []}
        p.semantic_models.append(SemanticModel(s["name"], model, {m["name"]: Measure(m["name"], m["agg"], str(m.get("expr") or m["name"])) for m in s.get("measures") or []}, named("dimensions"), [d["name"] for d in s.get("dimensions") or [] if d.get("type") == "categorical"], named("entities")))
    for m in (raw.get("metrics") or {}).values():
        inputs = (m.get("type_params") or {}).get("input_metrics")
        if inputs is not None:
            m = {**m, "type_params": {**m["type_params"], "metrics": inputs}}
        if isinstance(m.get("filter"), dict):
            m = {**m, "filter": [f.get("where_sql_template") for f in m["filter"].get("where_filters") or []]}
        p.metrics.append(_metric(m))
    return p


def edges(spark: SparkSession, p: Project) -> DataFrame:
    """The graph as a table (parent, child)."""
    return spark.createDataFrame(p.edges or [], "parent string, child string")
