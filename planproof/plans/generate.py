"""Deterministic made-up source tables, as Columns over a row number: same seed, same data, at any number of partitions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planproof.functions.scalar import declared_type
from planproof.plans.jsonshape import nested

ROWS, SEED = 200, 42


@dataclass
class Spec:
    """How a column is filled. after: a timestamp column it follows; unique: values differ in all rows."""

    type: str = "varchar"
    unique: bool = False
    null_rate: float = 0.0
    values: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    true_rate: float = 0.5
    low: float = 0.0
    high: float = 1000.0
    shape: str = "uniform"  # uniform, lognormal, exponential
    refers: str | None = None
    skew: float = 0.0
    after: str | None = None
    json: dict | None = None
    absent: frozenset[str] = frozenset()  # paths of json that are JSON null


@dataclass
class TableSpec:
    columns: dict[str, Spec]
    unique_together: list[tuple[str, ...]] = field(default_factory=list)
    loader: str | None = None


#: Lineage columns that a loader adds.
LOADER_COLUMNS = {"dlt": {"_dlt_load_id": "load", "_dlt_id": "row"}, "fivetran": {"_fivetran_synced": "time"}, "airbyte": {"_airbyte_ab_id": "row", "_airbyte_emitted_at": "time"}}

EXAMPLE = {
    "customers": TableSpec({"id": Spec("int", unique=True), "email": Spec("varchar", unique=True), "segment": Spec(values=["consumer", "business"], weights=[8, 1]), "phone": Spec(null_rate=0.3), "is_opted_in": Spec("boolean", true_rate=0.45), "created_at": Spec("timestamp")}),
    "orders": TableSpec({"id": Spec("int", unique=True), "customer_id": Spec("int", refers="customers", skew=0.7), "status": Spec(values=["pending", "paid", "cancelled"], weights=[1, 8, 1]), "ordered_at": Spec("timestamp"), "shipped_at": Spec("timestamp", after="ordered_at", null_rate=0.2)}),
}


def _hash(seed: int, *parts) -> Column:
    return F.xxhash64(F.lit(seed), *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _uniform(seed: int, *parts) -> Column:
    """In (0, 1)."""
    return (F.pmod(_hash(seed, *parts), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def column(table: str, name: str, s: Spec, seed: int, sizes: dict[str, int]) -> Column:
    row = F.col("_row")
    u = _uniform(seed, table, name, row)
    kind = declared_type(s.type)
    if s.refers:
        n = sizes[s.refers]
        out = F.floor(F.pow(u, F.lit(1 + 3 * s.skew)) * n).cast("long") + 1
    elif s.json is not None:
        out = json_column(table, name, s.json, seed, s.absent)
    elif s.values:
        total, upto, out = float(sum(s.weights or [1] * len(s.values))), 0.0, F.lit(s.values[-1])
        marks = []
        for v, w in zip(s.values, s.weights or [1] * len(s.values)):
            upto += w / total
            marks.append((upto, v))
        for mark, v in reversed(marks[:-1]):
            out = F.when(u < mark, v).otherwise(out)
    elif isinstance(kind, T.BooleanType):
        out = u < s.true_rate
    elif isinstance(kind, (T.LongType, T.DoubleType)):
        if s.unique:
            out = row + 1
        else:
            # Inverse distribution functions; the tail is cut at the upper bound.
            v = {"exponential": -F.log(1 - u) / 4, "lognormal": F.exp((F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * _uniform(seed, table, name, "2", row))) * 0.5) / 5}.get(s.shape, u)
            v = F.least(v, F.lit(1.0)) * (s.high - s.low) + s.low
            out = F.round(v) if isinstance(kind, T.LongType) else F.round(v, 2)
        out = out.cast(kind)
    elif isinstance(kind, T.TimestampNTZType):
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") if not s.after else F.col(s.after)
        span = 730 * 86400 if not s.after else 10 * 86400
        out = start + F.make_dt_interval(secs=F.floor(u * span) + 1)
    elif isinstance(kind, T.DateType):
        out = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(u * 730).cast("int"))
    elif name == "email":
        out = F.concat(F.lit("user"), (row + 1).cast("string"), F.lit("@example.com"))
    elif s.unique:
        out = F.concat(F.lit(f"{name}_"), (row + 1).cast("string"))
    else:
        out = F.concat(F.lit(f"{name}_"), F.substring(F.hex(_hash(seed, table, name, row)), -4, 4))
    if s.null_rate:
        out = F.when(_uniform(seed, table, name, "null", row) >= s.null_rate, out)
    return out


def one_table(spark: SparkSession, name: str, spec: TableSpec, n: int, sizes: dict[str, int], seed: int) -> DataFrame:
    """n rows. Where keys must be unique together, more rows are tried for those that repeat one, twice as many each time, until
    there are n or the keys are used up."""
    tried, df = n, _rows(spark, name, spec, n, sizes, seed)
    if spec.unique_together:
        while tried < n << TRIES and df.count() < n:
            tried *= 2
            df = _rows(spark, name, spec, tried, sizes, seed)
        df = df.orderBy("_row").limit(n)
    return df.drop("_row")


#: Doublings of the rows that are tried for a table whose keys must be unique together.
TRIES = 5


def _rows(spark: SparkSession, name: str, spec: TableSpec, n: int, sizes: dict[str, int], seed: int) -> DataFrame:
    df = spark.range(n).withColumnRenamed("id", "_row")
    first = [c for c, s in spec.columns.items() if not s.after]
    df = df.select("_row", *(column(name, c, spec.columns[c], seed, sizes).alias(c) for c in first))
    later = [c for c in spec.columns if c not in first]
    while later:
        ready = [c for c in later if spec.columns[c].after in df.columns]
        if not ready:
            raise ValueError(f"columns of {name} follow each other in a circle: {', '.join(later)}")
        df = df.select("*", *(column(name, c, spec.columns[c], seed, sizes).alias(c) for c in ready))
        later = [c for c in later if c not in ready]
    for c, kind in LOADER_COLUMNS.get(spec.loader or "", {}).items():
        value = {"load": F.lit(f"load_{seed}"), "row": F.substring(F.sha2(F.concat_ws(":", F.lit(f"{seed}:{name}"), F.col("_row").cast("string")), 256), 1, 14), "time": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")}[kind]
        df = df.withColumn(c, value)
    for key in spec.unique_together:
        # of rows with the same key the first one stays, whatever the partitions
        first = df.groupBy(*key).agg(F.min("_row").alias("_first")).select("_first")
        df = df.join(first, df._row == first._first, "left_semi")
    return df.select("_row", *spec.columns, *LOADER_COLUMNS.get(spec.loader or "", {}))


def tables(spark: SparkSession, specs: dict[str, TableSpec], rows: dict[str, int] | None = None, seed: int = SEED, default: int = ROWS) -> dict[str, DataFrame]:
    sizes = {t: (rows or {}).get(t, default) for t in specs}
    return {t: one_table(spark, t, s, sizes[t], sizes, seed) for t, s in specs.items()}


def warnings(specs: dict[str, TableSpec]) -> list[str]:
    """What the generator cannot honour: references in a circle, unknown parents, keys larger than their values."""
    out, edges = [], {t: {s.refers for s in spec.columns.values() if s.refers} for t, spec in specs.items()}
    for t, parents in edges.items():
        out += [f"{t}: refers to unknown table {p}" for p in sorted(parents - set(specs))]
        seen, todo = set(), set(parents)
        while todo:
            p = todo.pop()
            if p == t:
                out.append(f"{t}: is part of a circle of references")
                break
            if p not in seen:
                seen.add(p)
                todo |= edges.get(p, set())
        for key in specs[t].unique_together:
            out += [f"{t}: unique key names unknown column {c}" for c in key if c not in specs[t].columns]
    return out


# ------------------------------------------------------------------ JSON values


def _leaf(kind: str, seed: int, table: str, col: str, path: str) -> Column:
    row = F.col("_row")
    h = F.pmod(_hash(seed, table, col, path, row), F.lit(1 << 40))
    if kind == "integer":
        return row * 1000 + h % 1000
    if kind == "number":
        return F.round(row * 1000 + (h % 100000) / 100, 2)
    if kind == "boolean":
        return h % 2 == 0
    if kind == "date":
        return F.date_add(F.lit("2024-01-01").cast("date"), (h % 730).cast("int")).cast("string")
    if kind == "timestamp":
        return F.date_format(F.timestamp_seconds(F.lit(1704067200) + h % (730 * 86400)), "yyyy-MM-dd'T'HH:mm:ss")
    name = path.rstrip("[]").rpartition(".")[2] or col
    return F.concat(F.lit(f"{name}_"), row.cast("string"), F.lit("_"), F.lpad(F.hex(h % 65536), 4, "0"))


def _json(tree, seed: int, table: str, col: str, path: str, absent: frozenset[str] = frozenset()) -> Column:
    if re.sub(r"\[\d+\]", "[]", path).lstrip(".") in absent:
        return F.lit(None).cast("string")
    if not isinstance(tree, dict):
        return _leaf(tree, seed, table, col, path)
    if set(tree) == {"[]"}:
        n = (F.pmod(_hash(seed, table, col, path, F.col("_row")), F.lit(3)) + 1).cast("int")
        return F.slice(F.array(*(_json(tree["[]"], seed, table, col, f"{path}[{i}]", absent) for i in range(3))), F.lit(1), n)
    return F.struct(*(_json(v, seed, table, col, f"{path}.{k}", absent).alias(k) for k, v in sorted(tree.items()) if k != "[]"))


def json_column(table: str, col: str, shape: dict, seed: int = SEED, absent: frozenset[str] = frozenset()) -> Column:
    """Compact JSON text with every path present, those in absent as JSON null; a path's value depends on itself alone, so
    new paths change no other. Only the whole value read: {"id": row}."""
    tree = nested(shape)
    value = _json(tree, seed, table, col, "", absent) if tree else F.struct(F.col("_row").alias("id"))
    return F.to_json(value, {"ignoreNullFields": "false"}) if absent else F.to_json(value)


def json_rows(spark: SparkSession, table: str, col: str, shape: dict, n: int, seed: int = SEED) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "_row").select("_row", json_column(table, col, shape, seed).alias(col))


def as_on_base(specs: dict[str, TableSpec], added: dict[tuple[str, str], set[str]]) -> dict[str, TableSpec]:
    """The tables whose JSON columns have paths that only head reads, with those as JSON null: base never wrote them."""
    out = {}
    for t in {t for (t, _), paths in added.items() if paths and t in specs}:
        columns = {c: replace(s, absent=frozenset(added.get((t, c), ()))) for c, s in specs[t].columns.items()}
        out[t] = replace(specs[t], columns=columns)
    return out


# ------------------------------------------------------------------ stand-ins and updates


def empty_stand_in(spark: SparkSession, columns: dict[str, str | None]) -> DataFrame:
    """No rows, the declared columns: what a source without data looks like to its readers."""
    return spark.createDataFrame([], T.StructType([T.StructField(n, declared_type(t)) for n, t in columns.items()]))


def update_column(df: DataFrame, values: DataFrame, key: str, column_name: str) -> DataFrame:
    """df with column_name set from values where their key is there: an update as a join."""
    new = values.select(F.col(key).alias("__key"), F.col(column_name).alias("__new"))
    out = df.join(new, df[key] == F.col("__key"), "left")
    return out.select(*(F.coalesce("__new", c).alias(c) if c == column_name else F.col(c) for c in df.columns))
