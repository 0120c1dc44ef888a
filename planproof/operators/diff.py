"""What changed between two versions of a relation: columns, rows, renames.

Row comparison is multiset comparison, NULL equal to NULL and NaN to NaN. Both directions come from one signed
aggregate: head rows count +1, base rows -1, grouped by the compared columns. That is one shuffle of either side
with map-side combine, against two or four for set operations, and no replication of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGN = "__sign"


def type_name(t: T.DataType) -> str:
    return t.simpleString().upper()


def columns_of(df: DataFrame) -> dict[str, str]:
    """Ordered {name: TYPE}."""
    return {f.name: type_name(f.dataType) for f in df.schema.fields}


@dataclass
class SchemaDiff:
    added: list[tuple[str, str]] = field(default_factory=list)
    removed: list[tuple[str, str]] = field(default_factory=list)
    retyped: list[tuple[str, str, str]] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)

    @property
    def changed(self) -> bool:
        return bool(self.added or self.removed or self.retyped or self.renamed)

    @property
    def breaking(self) -> bool:
        return bool(self.removed or self.retyped or self.renamed)


def schema_diff(head: DataFrame, base: DataFrame) -> SchemaDiff:
    """Names match without regard to case, as Spark resolves them; types are compared as text."""
    h, b = columns_of(head), columns_of(base)
    by = {n.lower(): n for n in b}
    low = {n.lower() for n in h}
    return SchemaDiff(
        [(n, t) for n, t in h.items() if n.lower() not in by],
        [(n, t) for n, t in b.items() if n.lower() not in low],
        [(n, b[by[n.lower()]], t) for n, t in h.items() if n.lower() in by and b[by[n.lower()]] != t],
    )


def schema_rows(head: DataFrame, base: DataFrame) -> DataFrame:
    """The schema join as rows: column, change, base_type, head_type; a full outer join of the column metadata."""
    spark = head.sparkSession
    frame = lambda d, c: spark.createDataFrame(list(columns_of(d).items()) or [], f"column string, {c} string")
    both = frame(base, "base_type").join(frame(head, "head_type"), "column", "full")
    change = F.when(F.col("base_type").isNull(), "added").when(F.col("head_type").isNull(), "removed").when(F.col("base_type") != F.col("head_type"), "retyped")
    return both.withColumn("change", change).where("change is not null").select("column", "change", "base_type", "head_type")


def common_columns(head: DataFrame, base: DataFrame) -> list[str]:
    """Columns with the same name and type on both sides, in head's order."""
    b = {n.lower(): t for n, t in columns_of(base).items()}
    return [n for n, t in columns_of(head).items() if b.get(n.lower()) == t]


def _key(name: str, t: T.DataType) -> Column:
    """A column as a grouping key: maps, which cannot be compared, become sorted entries."""
    c = F.col(f"`{name}`")
    return F.array_sort(F.map_entries(c)).alias(name) if isinstance(t, T.MapType) else c


def comparable(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    return df.select(*(_key(n, kinds[n.lower()]) for n in (names or df.columns)))


def signed(head: DataFrame, base: DataFrame, names: list[str]) -> DataFrame:
    """Each distinct row with how many more times head has it than base."""
    both = comparable(head, names).withColumn(_SIGN, F.lit(1)).unionByName(comparable(base, names).withColumn(_SIGN, F.lit(-1)))
    return both.groupBy(*(F.col(f"`{n}`") for n in names)).agg(F.sum(_SIGN).alias(_SIGN))


def row_diff(head: DataFrame, base: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row: only_head, only_base (multiset differences both ways). With no common column both are NULL."""
    names = common_columns(head, base) if names is None else names
    if not names:
        return head.sparkSession.range(1).select(F.lit(None).cast("long").alias("only_head"), F.lit(None).cast("long").alias("only_base"))
    s = F.col(_SIGN)
    total = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("long")
    return signed(head, base, names).agg(total(s).alias("only_head"), total(-s).alias("only_base"))


def differing_rows(head: DataFrame, base: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The rows themselves: side (head or base), copies, and the compared columns."""
    names = common_columns(head, base) if names is None else names
    return signed(head, base, names).where(F.col(_SIGN) != 0).select(F.when(F.col(_SIGN) > 0, "head").otherwise("base").alias("side"), F.abs(F.col(_SIGN)).cast("long").alias("copies"), *(F.col(f"`{n}`") for n in names))


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames of one column each hold the same multiset of values."""
    names = ["value"]
    x, y = a.toDF("value"), b.toDF("value")
    return signed(x, y, names).where(F.col(_SIGN) != 0).isEmpty()


def fingerprint(name: str, t: T.DataType) -> Column:
    """(rows, nulls, sum and xor of a 64-bit hash): equal for equal multisets."""
    h = F.xxhash64(_key(name, t))
    return F.struct(F.count(F.lit(1)).alias("n"), F.count(F.col(f"`{name}`")).alias("some"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))


def fingerprints(df: DataFrame, names: list[str]) -> dict[str, tuple]:
    """Fingerprints of several columns from one pass without a shuffle of rows."""
    if not names:
        return {}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(*(fingerprint(n, kinds[n]).alias(n) for n in names)).first()
    return {n: tuple(row[n]) for n in names}


def renames(head: DataFrame, base: DataFrame, diff: SchemaDiff) -> list[tuple[str, str]]:
    """(base name, head name) of columns that only changed their name: equal type and equal multiset of values.
    Removed columns in order take the first added one that fits, which is then used up. Fingerprints, one pass a
    side, leave few pairs; those are compared exactly."""
    pairs = [(r, a) for r, rt in diff.removed for a, at in diff.added if rt == at]
    old, new = fingerprints(base, list(dict.fromkeys(r for r, _ in pairs))), fingerprints(head, list(dict.fromkeys(a for _, a in pairs)))
    found: list[tuple[str, str]] = []
    for r, a in pairs:
        if all(r != x and a != y for x, y in found) and old[r] == new[a] and same_multiset(base.select(f"`{r}`"), head.select(f"`{a}`")):
            found.append((r, a))
    return found


def with_renames(head: DataFrame, base: DataFrame) -> SchemaDiff:
    """The schema difference with renamed columns taken out of added and removed."""
    d = schema_diff(head, base)
    d.renamed = renames(head, base, d) if d.added and d.removed else []
    gone, come = {x for x, _ in d.renamed}, {y for _, y in d.renamed}
    d.removed = [x for x in d.removed if x[0] not in gone]
    d.added = [x for x in d.added if x[0] not in come]
    return d


def identical_plan(head: DataFrame, base: DataFrame) -> bool:
    """Both sides are the same query on the same inputs, so nothing needs to run."""
    return columns_of(head) == columns_of(base) and head.sameSemantics(base)
