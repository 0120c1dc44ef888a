"""Data tests and unit tests. Each data test is a frame of failing rows; its failures are their count."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planproof.operators.diff import differing_rows, row_diff


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values (combinations) that stand more than once; rows with a NULL among them do not count."""
    known = df.dropna(how="any", subset=list(columns))
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: list, quote: bool = True) -> DataFrame:
    """Distinct values that are not accepted, with their rows; NULL does not fail."""
    c = F.col(column)
    ok = [str(v) for v in values] if quote else values
    return df.where(c.isNotNull() & ~(c.cast("string") if quote else c).isin(ok)).groupBy(c.alias("value_field")).agg(F.count(F.lit(1)).alias("n_records"))


def relationships(child: DataFrame, column: str, parent: DataFrame, field_name: str) -> DataFrame:
    """Child rows whose key is not NULL and has no parent."""
    keys = parent.select(F.col(field_name).alias("__to")).where("__to is not null").distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__to"), "left_anti")


def failures(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("test"), "failures")


def singular(spark, sql: str) -> DataFrame:
    return spark.sql(sql)


@dataclass
class UnitResult:
    missing: int
    unexpected: int
    rows: list = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not (self.missing or self.unexpected)


def unit_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """missing and unexpected rows, on the expected columns."""
    cols = expected.columns
    return row_diff(actual.select(*cols), expected, cols).select(F.col("only_base").alias("missing"), F.col("only_head").alias("unexpected"))


def unit_test(model, inputs: dict[str, DataFrame], expected: DataFrame, show: int = 20) -> UnitResult:
    """model: called with the inputs by name. The compared columns are cast to the model's types."""
    actual = model(**inputs)
    kinds = dict(zip((c.lower() for c in actual.columns), (f.dataType for f in actual.schema.fields)))
    expected = expected.select(*(F.col(c).cast(kinds[c.lower()]).alias(c) for c in expected.columns))
    r = unit_diff(actual, expected).first()
    rows = differing_rows(actual.select(*expected.columns), expected, expected.columns).limit(show).collect() if r["missing"] or r["unexpected"] else []
    return UnitResult(r["missing"], r["unexpected"], [x.asDict() for x in rows])


def run_test(kind: str, df: DataFrame, column: str, relations: dict[str, DataFrame], **kw) -> DataFrame:
    if kind == "not_null":
        return not_null(df, column)
    if kind == "unique":
        return unique(df, column)
    if kind == "accepted_values":
        return accepted_values(df, column, kw["values"], kw.get("quote", True))
    if kind == "relationships":
        return relationships(df, column, relations[kw["to"]], kw["field"])
    raise ValueError(f"no data test `{kind}`")
