"""Where a metric moved: per dimension value, the biggest contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planproof.operators.metrics import Definition, Program, config_metrics

LEAST, MOST, DIMENSIONS, ROWS = 2, 12, 3, 3


def distinct_counts(df: DataFrame, dims: dict[str, str]) -> DataFrame:
    """dimension, n_distinct: exact, all expressions in one aggregate."""
    names = list(dims)
    wide = df.agg(*(F.countDistinct(F.expr(dims[n])).alias(f"d{i}") for i, n in enumerate(names)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(f"d{i}").alias("n_distinct")) for i, n in enumerate(names)))).alias("p")).select("p.*")


def gate(df: DataFrame, dims: dict[str, str]) -> DataFrame:
    """Dimensions of LEAST to MOST values, the fewest first, then by name; DIMENSIONS of them at most."""
    return distinct_counts(df, dims).where(F.col("n_distinct").between(LEAST, MOST)).orderBy("n_distinct", "dimension").limit(DIMENSIONS)


def grouped(df: DataFrame, dims: dict[str, str], definitions: list[Definition]) -> DataFrame:
    """metric, dimension, value, amount: all metrics for all dimensions in one GROUPING SETS pass. NULL is a value of its own."""
    names = list(dims)
    keys = [f"k{i}" for i in range(len(names))]
    source = df.select("*", *(F.expr(dims[n]).cast("string").alias(k) for n, k in zip(names, keys)))
    program = Program(definitions)
    out = program.finished(source.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(*program.aggregates(), *(F.grouping(k).alias(f"g{i}") for i, k in enumerate(keys))))
    pick = lambda what: F.coalesce(*(F.when(F.col(f"g{i}") == 0, what(i)) for i in range(len(names))))
    amounts = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(s).cast("double").alias("amount")) for n, s in program.results.items()))
    return out.select(pick(lambda i: F.lit(names[i])).alias("dimension"), pick(lambda i: F.col(keys[i])).alias("value"), F.inline(amounts))


def breakdowns(head: DataFrame, base: DataFrame, dims: dict[str, str], definitions: list[Definition]) -> DataFrame:
    """metric, dimension, value, base, head, contribution. Values meet null-safely; a missing group counts as 0 in the
    contribution and stays NULL in its column."""
    h, b = grouped(head, dims, definitions), grouped(base, dims, definitions)
    on = (F.col("h.metric") == F.col("b.metric")) & (F.col("h.dimension") == F.col("b.dimension")) & F.col("h.value").eqNullSafe(F.col("b.value"))
    met = h.alias("h").join(b.alias("b"), on, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    either = lambda c: F.coalesce(f"h.{c}", f"b.{c}").alias(c)
    gap = F.abs(zero("h.amount") - zero("b.amount")).alias("contribution")
    return met.select(either("metric"), either("dimension"), either("value"), F.col("b.amount").alias("base"), F.col("h.amount").alias("head"), gap)


def breakdown(head: DataFrame, base: DataFrame, dims: dict[str, str], sql: str) -> DataFrame:
    """breakdowns() of one aggregate given as SQL."""
    return breakdowns(head, base, dims, config_metrics([{"name": "metric", "model": "", "sql": sql}])).drop("metric")


def top_contributors(parts: DataFrame, rows: int = ROWS) -> DataFrame:
    """The biggest contributions of each dimension (of each metric), then by value (NULL as 'None'); zero ones too."""
    w = W.partitionBy(*(c for c in ("metric", "dimension") if c in parts.columns)).orderBy(F.desc("contribution"), F.coalesce("value", F.lit("None")))
    return parts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= rows)


def biggest_mover(metrics: DataFrame, by: tuple[str, ...] = ("label", "metric")) -> DataFrame:
    """Of rows (metric, label, base, head, moved) the one with the greatest relative change; from NULL or 0 it is infinite."""
    rel = F.when(F.col("base").isNull() | (F.col("base") == 0), F.lit(float("inf"))).otherwise(F.abs((F.coalesce("head", F.lit(0.0)) - F.col("base")) / F.col("base")))
    return metrics.where("moved").withColumn("relative", rel).orderBy(F.desc("relative"), *by).limit(1)
