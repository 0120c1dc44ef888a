"""Registered queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planproof.functions import json as js
from planproof.functions import scalar
from planproof.operators import breakdown as bd
from planproof.operators import conventions, diff, judge, metrics, profile, quality
from planproof.plans import compare, generate, graph, infer, lineage, project
from planproof.plans.marts import Marts
from planproof.session import configured

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Marts(configured(spark), sf_dir))

        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


# ------------------------------------------------------------------ SQL of the example models

_CTES = """
stg_orders AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
  o_orderdate AS ordered_at, o_orderpriority AS channel FROM orders),
stg_items AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS gross_cents,
  CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS discount_cents, l_shipdate AS shipped_at, l_returnflag AS return_flag FROM lineitem),
items_aggregated AS (SELECT order_id, count(*) AS line_item_count, sum(quantity)::BIGINT AS units, sum(gross_cents)::BIGINT AS gross_amount_cents,
  sum(discount_cents)::BIGINT AS discount_amount_cents, sum(gross_cents - discount_cents)::BIGINT AS net_amount_cents FROM stg_items GROUP BY order_id),
fct_orders AS (SELECT o.order_id, customer_id, status, channel, CAST(ordered_at AS DATE) AS order_date, coalesce(line_item_count, 0) AS line_item_count,
  coalesce(units, 0) AS units, coalesce(net_amount_cents, 0) AS net_amount_cents, status = 'F' AS is_cancelled, status IN ('O', 'P') AS is_open,
  line_item_count IS NOT NULL AS has_items, CASE WHEN status = 'F' THEN 'closed' WHEN status = 'O' THEN 'open' ELSE 'other' END AS status_group
  FROM stg_orders o LEFT JOIN items_aggregated i ON o.order_id = i.order_id),
fct_order_items AS (SELECT i.order_id, product_id, customer_id, quantity, gross_cents, gross_cents - discount_cents AS net_cents,
  date_diff('day', CAST(ordered_at AS DATE), CAST(shipped_at AS DATE)) AS days_to_ship FROM stg_items i JOIN stg_orders o ON i.order_id = o.order_id),
dim_products AS (SELECT p_partkey AS product_id, upper(p_brand) AS brand,
  list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS type, p_size::BIGINT AS size,
  coalesce(units_sold, 0) AS units_sold, coalesce(orders, 0) AS orders
  FROM part LEFT JOIN (SELECT product_id, sum(quantity)::BIGINT AS units_sold, count(DISTINCT order_id) AS orders FROM stg_items GROUP BY 1) s ON p_partkey = product_id)"""


def _dim(where: str) -> str:
    return f"""(SELECT c_custkey AS customer_id, lower(c_name) AS name, c_mktsegment AS segment, c_nationkey::BIGINT AS nation_id,
  coalesce(lifetime_orders, 0) AS lifetime_orders, coalesce(lifetime_cents, 0) AS lifetime_cents, lifetime_orders IS NOT NULL AS has_ordered, first_order_date, last_order_date
  FROM customer LEFT JOIN (SELECT customer_id, count(*) AS lifetime_orders, sum(net_amount_cents)::BIGINT AS lifetime_cents, min(order_date) AS first_order_date,
  max(order_date) AS last_order_date FROM fct_orders {where} GROUP BY customer_id) l ON c_custkey = l.customer_id)"""


_WITH = f"WITH {_CTES}, dim_base AS {_dim('WHERE status <> ' + chr(39) + 'F' + chr(39))}, dim_head AS {_dim('')}"


def _model(name: str) -> str:
    return f"{_WITH} SELECT * FROM {name}"


@query(_model("dim_base"))
def build_dim_customers(m):
    return m.dim_customers()


@query(_model("fct_orders"))
def build_fct_orders(m):
    return m.fct_orders()


@query(_model("fct_order_items"))
def build_fct_order_items(m):
    return m.fct_order_items()


@query(_model("dim_products"))
def build_dim_products(m):
    return m.dim_products()


@query(_model("items_aggregated"))
def build_items_aggregated(m):
    return m.items_aggregated()


@query("SELECT CAST(d AS DATE) AS date_day FROM generate_series(DATE '2023-01-01', DATE '2026-12-31', INTERVAL 1 DAY) t(d)")
def build_time_spine(m):
    return scalar.time_spine(m.spark, "2023-01-01", "2026-12-31")


# ------------------------------------------------------------------ sources


@query("SELECT event_id, TRY_CAST(CAST(ts AS VARCHAR) AS TIMESTAMP)::DATE AS day, TRY_CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS user_id, TRY_CAST(event_type AS BIGINT) AS bad_long, TRY_CAST(CAST(event_id % 7 AS VARCHAR) || '.0' AS BIGINT) AS whole FROM events")
def stage_try_cast(m):
    e = m.table("events")
    text = e.select("event_id", F.col("ts").cast("string").alias("ts"), F.col("user_id").cast("string").alias("user_id"), "event_type", F.concat((F.col("event_id") % 7).cast("string"), F.lit(".0")).alias("whole"))
    long, ts = scalar.declared_type("int64"), scalar.declared_type("timestamp")
    return text.select("event_id", scalar.try_cast_text(F.col("ts"), ts).cast("date").alias("day"), scalar.try_cast_text(F.col("user_id"), long).alias("user_id"), scalar.try_cast_text(F.col("event_type"), long).alias("bad_long"), scalar.try_cast_text(F.col("whole"), long).alias("whole"))


@query("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS DOUBLE) AS total WHERE false")
def stage_typed_null(m):
    return generate.empty_stand_in(m.spark, {"id": "int64", "email": "text", "total": "numeric(28,6)"})


@query("SELECT event_id - 1 AS _row, props IS NOT NULL AS filled FROM events")
def stage_ordered_rows(m):
    return m.table("events").select((F.col("event_id") - 1).alias("_row"), F.col("props").isNotNull().alias("filled"))


@query("SELECT r_regionkey, coalesce(u.name, r_name) AS r_name FROM region LEFT JOIN (SELECT 1 AS k, 'ONE' AS name UNION ALL SELECT 3, 'THREE') u ON r_regionkey = u.k")
def sink_update_join(m):
    return generate.update_column(m.table("region"), m.spark.createDataFrame([(1, "ONE"), (3, "THREE")], "r_regionkey int, r_name string"), "r_regionkey", "r_name")


# ------------------------------------------------------------------ row differences


def _changed_orders(m):
    """A tenth of the orders cost more, every hundredth is gone, every 250th is doubled."""
    o = m.table("orders")
    k = F.col("o_orderkey")
    new = o.where(k % 100 != 7).withColumn("o_totalprice", F.when(k % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return new.unionAll(new.where(k % 250 == 0))


_HEAD_ORDERS = """base AS (SELECT * FROM orders), once AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
  FROM orders WHERE o_orderkey % 100 <> 7), head AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE o_orderkey % 250 = 0)"""
_BOTH = "(SELECT count(*) FROM (SELECT {c} FROM head EXCEPT ALL SELECT {c} FROM base)) AS only_head, (SELECT count(*) FROM (SELECT {c} FROM base EXCEPT ALL SELECT {c} FROM head)) AS only_base"


def _row_sql(ctes: str, cols: str = "*") -> str:
    return f"WITH {ctes} SELECT {_BOTH.format(c=cols)}"


@query(_row_sql("base AS (SELECT * FROM orders), head AS (SELECT * FROM orders)"))
def diff_rows_identical(m):
    return diff.row_diff(m.table("orders"), m.table("orders"))


@query(_row_sql(_HEAD_ORDERS))
def diff_rows_changed(m):
    return diff.row_diff(_changed_orders(m), m.table("orders"))


_DUP = "base AS (SELECT l_orderkey, l_linenumber FROM lineitem), head AS (SELECT l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 = 0)"


@query(_row_sql(_DUP))
def diff_rows_duplicates(m):
    b = m.table("lineitem").select("l_orderkey", "l_linenumber")
    return diff.row_diff(b.unionAll(b.where("l_orderkey % 5 = 0")), b)


_NULLS = "base AS (SELECT o_orderkey % 50 AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders), head AS (SELECT o_orderkey % 50 AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)"


@query(_row_sql(_NULLS))
def diff_rows_nulls(m):
    side = lambda n: m.table("orders").select((F.col("o_orderkey") % 50).alias("k"), F.when(F.col("o_orderkey") % n != 0, F.col("o_orderstatus")).alias("s"))
    return diff.row_diff(side(4), side(3))


def _reshaped_orders(m):
    return _changed_orders(m).drop("o_orderpriority").withColumn("o_orderdate", F.col("o_orderdate").cast("date")).withColumn("is_big", F.col("o_totalprice") > 100000)


@query(_row_sql(_HEAD_ORDERS, "o_orderkey, o_custkey, o_orderstatus, o_totalprice"))
def diff_common_columns(m):
    return diff.row_diff(_reshaped_orders(m), m.table("orders"))


@query(f"""WITH {_HEAD_ORDERS}, d AS (SELECT {_BOTH.format(c="o_orderkey, o_custkey, o_orderstatus, o_totalprice")}, (SELECT count(*) FROM base) AS rows_base, (SELECT count(*) FROM head) AS rows_head)
SELECT rows_base, rows_head, only_head AS rows_differing, true AS schema_changed, true AS breaking, rows_base <> rows_head AS rows_changed, false AS identical FROM d""")
def diff_summary(m):
    head, base = _reshaped_orders(m), m.table("orders")
    s = diff.with_renames(head, base)
    counts = head.agg(F.count("*").alias("rows_head")).crossJoin(base.agg(F.count("*").alias("rows_base")))
    d = diff.row_diff(head, base).crossJoin(counts)
    changed = F.col("rows_base") != F.col("rows_head")
    same = ~F.lit(s.changed) & ~changed & (F.coalesce("only_head", F.lit(0)) == 0)
    return d.select("rows_base", "rows_head", F.col("only_head").alias("rows_differing"), F.lit(s.changed).alias("schema_changed"), F.lit(s.breaking).alias("breaking"), changed.alias("rows_changed"), same.alias("identical"))


@query(f"""WITH {_HEAD_ORDERS}, h AS (SELECT 'head' AS side, count(*) AS copies, * FROM (SELECT * FROM head EXCEPT ALL SELECT * FROM base) GROUP BY ALL),
b AS (SELECT 'base' AS side, count(*) AS copies, * FROM (SELECT * FROM base EXCEPT ALL SELECT * FROM head) GROUP BY ALL)
SELECT side, copies, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM (SELECT * FROM h UNION ALL SELECT * FROM b)""")
def diff_row_samples(m):
    d = diff.differing_rows(_changed_orders(m), m.table("orders"))
    return d.select("side", "copies", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


@query("""SELECT * FROM (VALUES ('is_big', 'added', NULL, 'BOOLEAN'), ('o_orderdate', 'retyped', 'TIMESTAMP_NTZ', 'DATE'), ('o_orderpriority', 'removed', 'STRING', NULL)) t("column", change, base_type, head_type)""")
def diff_schema(m):
    return diff.schema_rows(_reshaped_orders(m), m.table("orders"))


@query("SELECT * FROM (VALUES ('o_orderstatus', 'status'), ('o_custkey', 'customer_id')) t(base_name, head_name)")
def diff_renames(m):
    base = m.table("orders")
    head = base.withColumnsRenamed({"o_orderstatus": "status", "o_custkey": "customer_id"}).withColumn("other_id", F.col("o_orderkey") + 1)
    return m.spark.createDataFrame(diff.with_renames(head, base).renamed, "base_name string, head_name string")


@query("SELECT count(*) = 0 AS same FROM ((SELECT o_orderstatus FROM orders EXCEPT ALL SELECT reverse(o_orderstatus) FROM orders) UNION ALL (SELECT reverse(o_orderstatus) FROM orders EXCEPT ALL SELECT o_orderstatus FROM orders))")
def diff_same_values(m):
    o = m.table("orders")
    d = diff.signed(o.select(F.reverse("o_orderstatus").alias("v")), o.select(F.col("o_orderstatus").alias("v")), ["v"])
    return d.agg((F.count_if(F.col("__sign") != 0) == 0).alias("same"))


# ------------------------------------------------------------------ profiles


@query("""SELECT 'p_brand' AS "column", count(*) AS "rows", count(p_brand) AS non_null, count(DISTINCT p_brand) AS n_distinct FROM part
UNION ALL SELECT 'p_size', count(*), count(p_size), count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_type', count(*), count(p_type), count(DISTINCT p_type) FROM part""")
def profile_added_columns(m):
    return profile.profile_columns(m.table("part"), ["p_brand", "p_size", "p_type"])


@query("SELECT l_returnflag AS value, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def profile_top_values(m):
    return profile.top_values(m.table("lineitem"), "l_returnflag")


# ------------------------------------------------------------------ metrics

_SEMANTIC = metrics.SemanticModel(
    "orders", "fct_orders",
    {x.name: x for x in (
        metrics.Measure("order_count", "count", "order_id"), metrics.Measure("net", "sum", "net_amount_cents"), metrics.Measure("buyers", "count_distinct", "customer_id"),
        metrics.Measure("avg_units", "average", "units"), metrics.Measure("first_key", "min", "order_id"), metrics.Measure("last_key", "max", "order_id"),
        metrics.Measure("mid_units", "median", "units"), metrics.Measure("cancelled", "sum_boolean", "is_cancelled"), metrics.Measure("p90", "percentile", "units"),
    )},
    {"status": "status", "channel": "channel", "is_open": "is_open"}, ["status", "channel"], {"order": "order_id"},
)
_CUSTOMERS = metrics.SemanticModel("customers", "dim_customers", {"customer_count": metrics.Measure("customer_count", "count", "customer_id")}, {"segment": "segment"}, ["segment"], {})
_METRICS = [metrics.Metric(n, measure=n) for n in _SEMANTIC.measures] + [
    metrics.Metric("customer_count", measure="customer_count"),
    metrics.Metric("open_net", measure="net", filters=["{{ Dimension('order__is_open') }} = true"], measure_filters=["{{ Dimension('order__status') }} <> 'P'"]),
    metrics.Metric("net_per_order", "ratio", numerator="net", denominator="order_count"),
    metrics.Metric("cancelled_share", "derived", expr="cancelled / order_count * 100", inputs=["cancelled", "order_count"]),
    metrics.Metric("all_time_net", "cumulative", measure="net"),
    metrics.Metric("weekly_net", "cumulative", measure="net", window="7 days"),
    metrics.Metric("daily_open", measure="order_count", filters=["{{ TimeDimension('order__status', 'day').grain('day') }} = 'O'"]),
    metrics.Metric("orders_per_customer", "ratio", numerator="order_count", denominator="customer_count"),
]
READER = metrics.SemanticReader([_SEMANTIC, _CUSTOMERS], _METRICS)
_BY_NAME = {c.name: c for c in READER.all()}


def _metric_query(key: str, metric: str, sql: str):
    @query(f"WITH {_CTES} SELECT {sql} AS {metric} FROM fct_orders", key)
    def run(m):
        return metrics.batch(m.fct_orders(), [_BY_NAME[metric]])[0]


_metric_query("metric_sum", "net", "sum(net_amount_cents)::BIGINT")
_metric_query("metric_count", "order_count", "count(order_id)")
_metric_query("metric_count_distinct", "buyers", "count(DISTINCT customer_id)")
_metric_query("metric_average", "avg_units", "avg(units)")
_metric_query("metric_min", "first_key", "min(order_id)")
_metric_query("metric_max", "last_key", "max(order_id)")
_metric_query("metric_median", "mid_units", "median(units)")
_metric_query("metric_sum_boolean", "cancelled", "sum(CASE WHEN is_cancelled THEN 1 ELSE 0 END)::BIGINT")
_metric_query("metric_filtered", "open_net", "(sum(net_amount_cents) FILTER (WHERE status <> 'P' AND is_open = true))::BIGINT")
_metric_query("metric_grain", "daily_open", "count(order_id) FILTER (WHERE status = 'O')")
_metric_query("metric_ratio", "net_per_order", "CAST(sum(net_amount_cents) AS DOUBLE) / nullif(count(order_id), 0)")
_metric_query("metric_derived", "cancelled_share", "CAST(sum(CASE WHEN is_cancelled THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(order_id) AS DOUBLE) * 100")
_metric_query("metric_cumulative_all_time", "all_time_net", "sum(net_amount_cents)::BIGINT")

_BI = metrics.BiReader("fct_orders", {
    "order_id": {"orders": {"type": "count"}, "big_orders": {"type": "COUNT", "filters": [{"units": ">= 100"}, {"status": "!F"}]}},
    "net_amount_cents": {"net": {"type": "sum"}},
    "channel": {"urgent": {"type": "count", "filters": [{"channel": "1-URGENT, 2-HIGH"}]}, "known": {"type": "count", "filters": [{"channel": "!null"}, {"is_open": True}]}},
}, {"net_per_order": {"type": "number", "sql": "${net} / nullif(${orders}, 0)"}, "net_per_unit": {"type": "NUMBER", "sql": "sum(${fct_orders.net_amount_cents}) / sum(${units})"}, "loop": {"type": "number", "sql": "${loop} + 1"}})


@query(f"""WITH {_CTES} SELECT count(order_id) AS orders, count(order_id) FILTER (WHERE units >= 100 AND status <> 'F') AS big_orders, sum(net_amount_cents)::BIGINT AS net,
count(channel) FILTER (WHERE channel IN ('1-URGENT', '2-HIGH')) AS urgent, count(channel) FILTER (WHERE channel IS NOT NULL AND is_open) AS known,
sum(net_amount_cents)::BIGINT / nullif(count(order_id), 0) AS net_per_order, sum(net_amount_cents)::BIGINT / sum(units)::BIGINT AS net_per_unit FROM fct_orders""")
def metric_bi_number(m):
    return metrics.batch(m.fct_orders(), _BI.all())[0]


@query(f"{_WITH} SELECT CAST((SELECT count(order_id) FROM fct_orders) AS DOUBLE) / nullif((SELECT count(customer_id) FROM dim_base), 0) AS orders_per_customer")
def metric_spanning(m):
    return metrics.combine(_BY_NAME["orders_per_customer"], {"fct_orders": m.fct_orders(), "dim_customers": m.dim_customers()})


@query(f"""WITH {_CTES} SELECT count(order_id) AS order_count, sum(net_amount_cents)::BIGINT AS net, count(DISTINCT customer_id) AS buyers, avg(units) AS avg_units, max(order_id) AS last_key,
sum(net_amount_cents)::BIGINT AS all_time_net FROM fct_orders""")
def metric_batch(m):
    names = ["order_count", "net", "buyers", "avg_units", "last_key", "all_time_net", "p90", "weekly_net"]
    return metrics.batch(m.fct_orders(), [_BY_NAME[n] for n in names])[0]


@query("""WITH declared(metric, kind, agg, span) AS (VALUES {rows})
SELECT metric, CASE WHEN span <> '' THEN 'running' ELSE 'aggregation' END AS why FROM declared
WHERE span <> '' OR (kind IN ('simple', 'cumulative') AND agg NOT IN ('sum', 'count', 'count_distinct', 'average', 'min', 'max', 'median', 'sum_boolean'))""".format(
    rows=", ".join(f"('{m.name}', '{m.type}', '{_SEMANTIC.measures[m.measure].agg if m.measure in _SEMANTIC.measures else 'count'}', '{m.window}')" for m in _METRICS)))
def metric_refused(m):
    rows = [(c.name, "running" if "running value" in c.unsupported else "aggregation") for c in READER.all() if c.unsupported]
    return m.spark.createDataFrame(rows, "metric string, why string")


_FLAGSHIP = metrics.config_metrics([
    {"name": "customers", "model": "dim_customers", "sql": "count(customer_id)"},
    {"name": "lifetime_orders", "model": "dim_customers", "sql": "sum(lifetime_orders)"},
    {"name": "lifetime_value", "model": "dim_customers", "sql": "sum(lifetime_cents)"},
    {"name": "average_orders", "model": "dim_customers", "sql": "avg(lifetime_orders)"},
    {"name": "buyers", "model": "dim_customers", "sql": "count(*) filter (where has_ordered)"},
])


def _moved_sql() -> str:
    exprs = {"customers": "count(customer_id)", "lifetime_orders": "sum(lifetime_orders)", "lifetime_value": "sum(lifetime_cents)", "average_orders": "avg(lifetime_orders)", "buyers": "count(*) FILTER (WHERE has_ordered)"}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST((SELECT {e} FROM dim_base) AS DOUBLE) AS base, CAST((SELECT {e} FROM dim_head) AS DOUBLE) AS head" for n, e in exprs.items())
    return f"{_WITH}, r AS ({rows}) SELECT *, abs(head - base) > 1e-9 AS moved FROM r"


@query(_moved_sql())
def metric_diff(m):
    return metrics.metric_diff(m.dim_customers(True), m.dim_customers(), _FLAGSHIP)


def _delta(base, head):
    pct = F.round((head - base) / F.abs(base) * 100, 1)
    return F.when(base.isNull() | head.isNull(), None).when(base == 0, head - base).otherwise(pct)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancelled orders counted in lifetime value: each metric before and after."""
    m = Marts(configured(spark), sf_dir)
    d = metrics.metric_diff(m.dim_customers(True), m.dim_customers(), _FLAGSHIP)
    return d.withColumn("delta_pct", _delta(F.col("base"), F.col("head"))).select("metric", "base", "head", "delta_pct", "moved").orderBy("metric")


@query(_moved_sql().replace("SELECT *, abs(head - base) > 1e-9 AS moved FROM r", "SELECT metric, round((head - base) / abs(base) * 100, 1) AS delta_pct FROM r WHERE base <> 0"))
def percent_delta(m):
    d = metrics.metric_diff(m.dim_customers(True), m.dim_customers(), _FLAGSHIP)
    return d.where("base <> 0").select("metric", _delta(F.col("base"), F.col("head")).alias("delta_pct"))


# ------------------------------------------------------------------ breakdowns


def _breakdown_sql(dims: dict[str, str], expr: str) -> str:
    side = lambda t: " UNION ALL ".join(f"SELECT '{n}' AS dimension, CAST({e} AS VARCHAR) AS value, CAST({expr} AS DOUBLE) AS metric FROM {t} GROUP BY 2" for n, e in dims.items())
    return f"""{_WITH}, h AS ({side('dim_head')}), b AS ({side('dim_base')}), met AS (SELECT coalesce(h.dimension, b.dimension) AS dimension, coalesce(h.value, b.value) AS value,
b.metric AS base, h.metric AS head, abs(coalesce(h.metric, 0) - coalesce(b.metric, 0)) AS contribution FROM h FULL JOIN b ON h.dimension = b.dimension AND h.value IS NOT DISTINCT FROM b.value)"""


_DIMS = {"segment": "segment", "bought": "has_ordered"}


@query(_breakdown_sql(_DIMS, "sum(lifetime_cents)") + " SELECT * FROM met")
def breakdown_segment(m):
    return bd.breakdown(m.dim_customers(True), m.dim_customers(), _DIMS, "sum(lifetime_cents)")


@query(_breakdown_sql(_DIMS, "sum(lifetime_orders)") + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY contribution DESC, coalesce(value, 'None'))::INT AS place FROM met) WHERE place <= 3")
def breakdown_top3(m):
    return bd.top_contributors(bd.breakdown(m.dim_customers(True), m.dim_customers(), _DIMS, "sum(lifetime_orders)"))


@query("""SELECT * FROM (SELECT 'event_type' AS dimension, count(DISTINCT event_type) AS n_distinct FROM events UNION ALL SELECT 'user', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'weekday', count(DISTINCT dayofweek(ts)) FROM events UNION ALL SELECT 'constant', 1 FROM events LIMIT 4) WHERE n_distinct BETWEEN 2 AND 12 ORDER BY n_distinct, dimension LIMIT 3""")
def dimension_gate(m):
    return bd.gate(m.table("events"), {"event_type": "event_type", "user": "user_id", "weekday": "dayofweek(ts)", "constant": "1"})


@query(_moved_sql().replace("SELECT *, abs(head - base) > 1e-9 AS moved FROM r", "SELECT metric, base, head FROM r WHERE abs(head - base) > 1e-9 ORDER BY CASE WHEN base = 0 THEN 1e308 ELSE abs((head - base) / base) END DESC, metric LIMIT 1"))
def top_mover(m):
    d = metrics.metric_diff(m.dim_customers(True), m.dim_customers(), _FLAGSHIP)
    return bd.biggest_mover(d, ("metric",)).select("metric", "base", "head")


# ------------------------------------------------------------------ data tests


@query("SELECT 'not_null_discount' AS test, count(*) AS failures FROM (SELECT nullif(l_discount, 0) AS d FROM lineitem) WHERE d IS NULL")
def test_not_null(m):
    return quality.failures(quality.not_null(m.table("lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("d")), "d"), "not_null_discount")


@query("SELECT 'unique_line' AS test, count(*) AS failures FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def test_unique(m):
    return quality.failures(quality.unique(m.table("lineitem"), "l_orderkey", "l_linenumber"), "unique_line")


@query("SELECT o_orderstatus AS value_field, count(*) AS n_records FROM orders WHERE o_orderstatus NOT IN ('O', 'P') GROUP BY 1")
def test_accepted_values(m):
    return quality.accepted_values(m.table("orders"), "o_orderstatus", ["O", "P"])


@query("SELECT 'order_customer' AS test, count(*) AS failures FROM (SELECT CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_custkey + 1 END AS k FROM orders) c LEFT JOIN customer p ON c.k = p.c_custkey WHERE k IS NOT NULL AND p.c_custkey IS NULL")
def test_relationships(m):
    child = m.table("orders").select(F.when(F.col("o_orderkey") % 20 != 0, F.col("o_custkey") + 1).alias("k"))
    return quality.failures(quality.relationships(child, "k", m.table("customer"), "c_custkey"), "order_customer")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def test_singular(m):
    m.table("orders").createOrReplaceTempView("singular_orders")
    return quality.singular(m.spark, "SELECT o_orderkey FROM singular_orders WHERE o_totalprice > 400000")


@query("""WITH actual AS (SELECT l_orderkey AS order_id, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS units FROM lineitem GROUP BY 1),
expected AS (SELECT order_id, n, CASE WHEN order_id % 50 = 0 THEN NULL ELSE units END AS units FROM actual WHERE order_id % 70 <> 3 UNION ALL SELECT * FROM actual WHERE order_id % 90 = 1)
SELECT (SELECT count(*) FROM (SELECT * FROM expected EXCEPT ALL SELECT * FROM actual)) AS missing, (SELECT count(*) FROM (SELECT * FROM actual EXCEPT ALL SELECT * FROM expected)) AS unexpected""")
def unit_test_diff(m):
    lines = m.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("bigint").alias("q"))
    actual = lines.groupBy("order_id").agg(F.count("*").alias("n"), F.sum("q").alias("units"))
    expected = actual.where("order_id % 70 <> 3").withColumn("units", F.when(F.col("order_id") % 50 != 0, F.col("units"))).unionAll(actual.where("order_id % 90 = 1"))
    return quality.unit_diff(actual, expected)


#: Results of tests made up from the orders, on head and on base: every pair of statuses, counts and errors; the same SQL on
#: both engines. The two errors name a column each, and differ else only in what two runs of one error differ in.
_STATUS = "CASE {} % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' WHEN 3 THEN 'error' ELSE 'skipped' END"
_RESULTS = {
    "test": "'t' || CAST(o_orderkey AS VARCHAR(20))",
    "status": _STATUS.format("o_orderkey"),
    "failures": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 4 END",
    "message": "CASE WHEN o_custkey % 2 = 0 THEN 'no column `a` in head.t (line 3, pos 4)' ELSE 'no column `b` in head.t (line 5, pos 1)' END",
    "base_status": _STATUS.format("CAST(floor(o_orderkey / 5) AS BIGINT)"),
    "base_failures": "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(floor(o_custkey / 4) AS BIGINT) % 4 END",
    "base_message": "CASE WHEN o_custkey % 3 = 0 THEN 'no column a in  base.t' ELSE 'no column `b` in base.t (line 9, pos 12)' END",
}


@query("""WITH r AS (SELECT {}, o_orderkey % 13 <> 0 AS on_base FROM orders), f AS (SELECT *, status IN ('fail', 'error') AS failing, regexp_extract(message, 'column `?(.)', 1) = regexp_extract(base_message, 'column `?(.)', 1) AS same_error FROM r),
p AS (SELECT test, failing, failing AND on_base AND status = base_status AND CASE status WHEN 'fail' THEN coalesce(failures <= base_failures, true) ELSE same_error END AS preexisting FROM f)
SELECT test, preexisting, failing AND NOT preexisting AS counts FROM p""".format(", ".join(f"{e} AS {n}" for n, e in _RESULTS.items())))
def judge_tests(m):
    o = m.table("orders")
    head = o.selectExpr(*(f"{_RESULTS[n]} AS {n}" for n in ("test", "status", "failures", "message")))
    base = o.where("o_orderkey % 13 <> 0").selectExpr(f"{_RESULTS['test']} AS test", *(f"{_RESULTS['base_' + n]} AS {n}" for n in ("status", "failures", "message")))
    return judge.judged(head, base)


@query("""WITH cases AS (SELECT * FROM (VALUES ('none'), ('passed'), ('same'), ('other')) a(base), (VALUES (true), (false)) d(data), (VALUES (true), (false)) r(reached), (VALUES (true), (false)) w(modified)),
o AS (SELECT *, CASE WHEN base <> 'same' THEN 'failed' WHEN data AND reached THEN 'unverified_broken_on_base' WHEN data THEN 'fixture_limited' WHEN NOT reached THEN 'broken_on_base' WHEN modified THEN 'failed' ELSE 'unverified_broken_on_base' END AS outcome FROM cases)
SELECT *, outcome NOT IN ('fixture_limited', 'broken_on_base') AS fails FROM o""")
def judge_outcomes(m):
    """What an error on head counts as, for every state of the base and of the change."""
    error = lambda c: judge.Result("m", "error", None, f"no column {c}", "UNRESOLVED_COLUMN")
    base = {"none": None, "passed": judge.Result("m", "success"), "same": error("a"), "other": error("b")}
    flags = (True, False)
    rows = [(k, d, r, w, *judge.model_outcome(error("a"), b, data=d, reached=r, modified=w)) for k, b in base.items() for d in flags for r in flags for w in flags]
    return m.spark.createDataFrame(rows, "base string, data boolean, reached boolean, modified boolean, outcome string, fails boolean")


_BEHIND = ("broken_on_base", "fixture_limited", "unverified_broken_on_base", "failed")


@query("""WITH b(behind) AS (VALUES {}), cases AS (SELECT x.behind AS one, y.behind AS other, reached, base_skipped FROM b x, b y, (VALUES (true), (false)) r(reached), (VALUES (true), (false)) s(base_skipped)),
o AS (SELECT *, CASE WHEN 'failed' IN (one, other) THEN 'skipped' WHEN 'unverified_broken_on_base' IN (one, other) OR NOT base_skipped THEN 'skipped_by_unverified' WHEN reached THEN 'skipped_unchecked' ELSE 'skipped_excused' END AS outcome FROM cases)
SELECT *, outcome <> 'skipped_excused' AS fails FROM o""".format(", ".join(f"('{x}')" for x in _BEHIND)))
def judge_skipped(m):
    """What a skipped model counts as, behind every pair of outcomes."""
    flags = (True, False)
    rows = [(a, b, r, s, *judge.skipped_outcome({a, b}, r, s)) for a in _BEHIND for b in _BEHIND for r in flags for s in flags]
    return m.spark.createDataFrame(rows, "one string, other string, reached boolean, base_skipped boolean, outcome string, fails boolean")


# ------------------------------------------------------------------ graph

_EDGES = [("src.customers", "stg_customers"), ("src.orders", "stg_orders"), ("src.items", "stg_items"), ("stg_items", "int_items"), ("stg_orders", "fct_orders"), ("int_items", "fct_orders"), ("stg_customers", "dim_customers"), ("fct_orders", "dim_customers"), ("src.products", "dim_products")]
_EDGE_SQL = "edges(parent, child) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + ")"


def _edges(m):
    return m.spark.createDataFrame(_EDGES, "parent string, child string")


@query(f"WITH RECURSIVE {_EDGE_SQL}, d(node) AS (SELECT 'stg_items' UNION SELECT child FROM edges JOIN d ON parent = node) SELECT node FROM d WHERE node <> 'stg_items'")
def dag_descendants(m):
    return graph.reachable(_edges(m), ["stg_items"]).where("depth > 0").select("node")


@query(f"WITH RECURSIVE {_EDGE_SQL}, d(node) AS (SELECT 'int_items' UNION SELECT child FROM edges JOIN d ON parent = node), u(node) AS (SELECT node FROM d UNION SELECT parent FROM edges JOIN u ON child = node) SELECT node FROM u")
def dag_affected(m):
    return graph.affected(_edges(m), ["int_items"])


@query(f"WITH RECURSIVE {_EDGE_SQL}, u(node, depth) AS (SELECT 'dim_customers', 0 UNION SELECT parent, depth + 1 FROM edges JOIN u ON child = node) SELECT node, min(depth) AS depth FROM u WHERE node IN ('stg_orders', 'fct_orders', 'stg_items', 'dim_products') GROUP BY node")
def dag_changed_ancestors(m):
    return graph.changed_ancestors(_edges(m), "dim_customers", ["stg_orders", "fct_orders", "stg_items", "dim_products"])


@query(f"""WITH RECURSIVE {_EDGE_SQL}, reads(test, model) AS (VALUES ('same_total', 'fct_orders'), ('same_total', 'dim_products'), ('sizes', 'dim_products'), ('sizes', 'stg_customers')),
d(node) AS (SELECT 'int_items' UNION SELECT child FROM edges JOIN d ON parent = node), t(node) AS (SELECT node FROM d UNION SELECT o.model FROM reads r JOIN d ON r.model = d.node JOIN reads o ON o.test = r.test),
u(node) AS (SELECT node FROM t UNION SELECT parent FROM edges JOIN u ON child = node) SELECT node FROM u""")
def dag_affected_by_tests(m):
    """Models that share a test with what is affected are built too, with all that they read."""
    found = graph.Graph(_EDGES).affected({"int_items"}, {"same_total": {"fct_orders", "dim_products"}})
    return m.spark.createDataFrame([(n,) for n in sorted(found)], "node string")


@query(f"""WITH RECURSIVE {_EDGE_SQL}, l(node, level) AS (SELECT DISTINCT parent, 0 FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION SELECT child, level + 1 FROM edges JOIN l ON parent = node)
SELECT node, count(DISTINCT e.parent) AS parents, true AS after_parents FROM (SELECT DISTINCT node FROM l) LEFT JOIN edges e ON e.child = node GROUP BY node""")
def dag_ordered(m):
    g = graph.Graph(_EDGES)
    at = {n: k for k, n in enumerate(g.ordered())}
    return m.spark.createDataFrame([(n, len(set(g.parents[n])), all(at[p] < k for p in g.parents[n])) for n, k in at.items()], "node string, parents long, after_parents boolean")


@query(f"""WITH RECURSIVE {_EDGE_SQL}, d(node) AS (SELECT 'stg_items' UNION SELECT child FROM edges JOIN d ON parent = node), s(node) AS (SELECT 'stg_customers' UNION SELECT child FROM edges JOIN s ON parent = node)
SELECT node FROM d WHERE node NOT IN (SELECT node FROM s) AND node <> 'stg_items'""")
def dag_comparable(m):
    """What is compared: reached by the change, built, and not behind a snapshot."""
    built = {n for e in _EDGES for n in e} - {"stg_items"}
    return m.spark.createDataFrame([(n,) for n in graph.Graph(_EDGES).comparable(["stg_items"], built, {"stg_customers"})], "node string")


@query(f"WITH RECURSIVE {_EDGE_SQL}, d(node) AS (SELECT 'src.items' UNION SELECT child FROM edges JOIN d ON parent = node) SELECT node FROM d WHERE node NOT LIKE 'src.%'")
def fixture_bound(m):
    return graph.reachable(_edges(m), ["src.items"]).where("depth > 0").select("node")


# ------------------------------------------------------------------ conventions

#: Models made up from the orders: every mix of name, layer, reads and description; the same SQL on both sides.
_NODES = {
    "model": "CASE o_orderkey % 11 WHEN 0 THEN 'stg_shop__orders' WHEN 1 THEN 'stg_shop' WHEN 2 THEN 'int_orders__sum' WHEN 3 THEN 'fct_sales' WHEN 4 THEN 'dim_x' WHEN 5 THEN 'Fct_Sales' WHEN 6 THEN 'my_stg_shop__orders' "
    "WHEN 7 THEN 'stg_Shop__orders' WHEN 8 THEN 'int__x' WHEN 9 THEN 'fct_' ELSE 'sales' END || CAST(o_orderkey AS VARCHAR(20))",
    "layer": "CASE o_orderkey % 5 WHEN 0 THEN 'staging' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'marts' WHEN 3 THEN 'utilities' ELSE '' END",
    "sources": "CAST(o_custkey % 3 AS INT)",
    "refs": "CAST(o_orderkey % 7 % 3 AS INT)",
    "described": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 6 <> 0 END",
}
_NODE_SQL = "nodes AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _NODES.items()) + " FROM orders)"
_NAMED = " OR ".join(f"(layer = '{layer}' AND NOT regexp_matches(model, '{pattern}'))" for layer, pattern in conventions.HOUSE["layers"].items())
_LAYERED = """SELECT model, 1 AS n FROM nodes WHERE layer = 'staging' AND sources <> 1 UNION ALL SELECT model, 2 FROM nodes WHERE layer = 'staging' AND refs > 0
UNION ALL SELECT model, 3 FROM nodes WHERE layer NOT IN ('staging', '') AND sources > 0"""


def _nodes(m):
    return m.table("orders").selectExpr(*(f"{e} AS {n}" for n, e in _NODES.items()))


@query(f"WITH {_NODE_SQL} SELECT 'naming' AS rule, model FROM nodes WHERE {_NAMED}")
def conv_naming(m):
    return conventions.naming(_nodes(m)).select("rule", "model")


#: Of a project's own patterns the first is not anchored, and still holds from the name's start on.
_OWN_RULES = {"preset": "team", "presets": {"team": {"layers": {"staging": "stg_shop", "marts": "fct_[a-z]+[0-9]*$"}, "hints": {"marts": "fct_<event>"}, "rules": {"naming": "warn"}}}}


@query(f"""WITH {_NODE_SQL} SELECT model, 'warn' AS severity, CASE layer WHEN 'staging' THEN 'a model in `staging/` is named to match stg_shop' ELSE 'a model in `marts/` is named fct_<event>' END AS message
FROM nodes WHERE (layer = 'staging' AND NOT starts_with(model, 'stg_shop')) OR (layer = 'marts' AND NOT regexp_full_match(model, 'fct_[a-z]+[0-9]*'))""")
def conv_own_rules(m):
    c = conventions.from_config(_OWN_RULES)
    return conventions.naming(_nodes(m), c.layers, c.severity("naming"), c.hints).select("model", "severity", "message")


@query(f"WITH {_NODE_SQL} SELECT 'layering' AS rule, model, count(*) AS n FROM ({_LAYERED}) GROUP BY model")
def conv_layering(m):
    return conventions.layering(_nodes(m)).groupBy("rule", "model").agg(F.count("*").alias("n"))


@query(f"WITH {_NODE_SQL} SELECT 'description' AS rule, model FROM nodes WHERE NOT coalesce(described, false)")
def conv_description(m):
    return conventions.description(_nodes(m)).select("rule", "model")


_TESTED = {"model": "'m' || CAST(o_custkey AS VARCHAR(20))", "column": "'c' || CAST(o_orderkey % 3 AS VARCHAR(20))", "test": "CASE WHEN o_orderkey % 5 < 2 THEN 'unique' WHEN o_orderkey % 5 = 2 THEN 'not_null' ELSE 'accepted_values' END"}


@query("""WITH tests AS (SELECT {} FROM orders WHERE o_orderkey % 4 = 0) SELECT 'primary_key' AS rule, 'm' || c_custkey AS model FROM customer WHERE 'm' || c_custkey NOT IN
(SELECT u.model FROM tests u JOIN tests n ON u.model = n.model AND u."column" = n."column" WHERE u.test = 'unique' AND n.test = 'not_null')""".format(", ".join(f'{e} AS "{n}"' for n, e in _TESTED.items())))
def conv_primary_key(m):
    tests = m.table("orders").where("o_orderkey % 4 = 0").selectExpr(*(f"{e} AS `{n}`" for n, e in _TESTED.items()))
    return conventions.primary_key(m.table("customer").selectExpr("'m' || c_custkey AS model"), tests).select("rule", "model")


_COLUMNS_OF = {
    "model": "'m' || CAST(o_orderkey AS VARCHAR(20))",
    "layer": "CASE o_orderkey % 4 WHEN 0 THEN 'utilities' ELSE 'marts' END",
    "column_name": "CASE o_orderkey % 9 WHEN 0 THEN 'created_at' WHEN 1 THEN 'created' WHEN 2 THEN 'order_date' WHEN 3 THEN 'is_open' WHEN 4 THEN 'has_items' WHEN 5 THEN 'open' WHEN 6 THEN 'BadName' WHEN 7 THEN 'island' ELSE '9lives' END",
    "type": "CASE o_orderkey % 5 WHEN 0 THEN 'TIMESTAMP_NTZ' WHEN 1 THEN 'date' WHEN 2 THEN 'BOOLEAN' WHEN 3 THEN 'timestamp' ELSE 'BIGINT' END",
}


@query("WITH c AS (SELECT {} FROM orders) SELECT 'column_naming' AS rule, model, column_name FROM c WHERE layer = 'marts' AND (NOT regexp_full_match(column_name, '[a-z][a-z0-9_]*') "
       "OR (upper(type) LIKE 'TIMESTAMP%' AND NOT ends_with(column_name, '_at')) OR (upper(type) = 'DATE' AND NOT ends_with(column_name, '_date')) "
       "OR (upper(type) = 'BOOLEAN' AND NOT (starts_with(column_name, 'is_') OR starts_with(column_name, 'has_'))))".format(", ".join(f"{e} AS {n}" for n, e in _COLUMNS_OF.items())))
def conv_column_naming(m):
    cols = m.table("orders").selectExpr(*(f"{e} AS {n}" for n, e in _COLUMNS_OF.items()))
    return conventions.column_naming(cols, layers=conventions.HOUSE["layers"]).select("rule", "model", "column_name")


@query(f"WITH {_NODE_SQL}, v AS (SELECT 'error' AS severity FROM nodes WHERE {_NAMED} UNION ALL SELECT 'error' FROM ({_LAYERED}) UNION ALL SELECT 'warn' FROM nodes WHERE NOT coalesce(described, false)) SELECT severity, count(*) AS violations FROM v GROUP BY severity")
def conv_severity_counts(m):
    n, c = _nodes(m), conventions.Conventions()
    every = conventions.naming(n).union(conventions.layering(n, severity=c.severity("layering"))).union(conventions.description(n, c.severity("description")))
    return every.groupBy("severity").agg(F.count("*").alias("violations"))


# ------------------------------------------------------------------ JSON


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def json_extract_paths(m):
    return m.table("events").select("event_id", js.extract(F.col("props"), "k").alias("k"), js.extract(F.col("props"), "a.b").alias("missing"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.k') AS DATE) AS d FROM events")
def json_typed_leaf(m):
    return m.table("events").select("event_id", js.leaf(F.col("props"), "k", "integer").alias("k"), js.leaf(F.col("props"), "k", "date").alias("d"))


@query("SELECT event_id, json_array_length(json_object('items', ([1, 2, 3])[1:(event_id % 4)::INT]), '$.items')::INT AS n FROM events")
def json_array_len(m):
    e = m.table("events").select("event_id", F.to_json(F.struct(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (F.col("event_id") % 4).cast("int")).alias("items"))).alias("j"))
    return e.select("event_id", js.array_length(F.col("j"), "items").alias("n"))


@query("SELECT 200::BIGINT AS n, 200::BIGINT AS distinct_totals, true AS arrays_fit, true AS whole")
def json_values(m):
    shape = {"id": "integer", "total": "number", "paid": "boolean", "items[].sku": "string", "at.day": "date"}
    rows = generate.json_rows(m.spark, "parcels", "payload", shape, 200)
    j = F.col("payload")
    size = js.array_length(j, "items")
    return rows.agg(F.count("*").alias("n"), F.countDistinct(js.leaf(j, "total", "number")).alias("distinct_totals"), F.every(size.between(1, 3)).alias("arrays_fit"), F.every(js.leaf(j, "id", "integer").isNotNull() & js.leaf(j, "at.day", "date").isNotNull() & js.leaf(j, "paid", "boolean").isNotNull()).alias("whole"))


# ------------------------------------------------------------------ inference

#: Column names made up from the orders: every mix of a start, a stem and an end.
_NAME = ("CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'is_' WHEN 2 THEN 'order_' ELSE 'Has_' END || CASE o_custkey % 10 WHEN 0 THEN 'email' WHEN 1 THEN 'status' WHEN 2 THEN 'subtotal' WHEN 3 THEN 'count' WHEN 4 THEN 'name' "
         "WHEN 5 THEN 'weight' WHEN 6 THEN 'enabled' WHEN 7 THEN 'date' WHEN 8 THEN 'counted' ELSE 'id' END || CASE CAST(floor(o_orderkey / 4) AS BIGINT) % 11 WHEN 0 THEN '' WHEN 1 THEN '_at' WHEN 2 THEN '_date' WHEN 3 THEN '_id' WHEN 4 THEN '_cents' "
         "WHEN 5 THEN '_flag' WHEN 6 THEN '_rate' WHEN 7 THEN '_on' WHEN 8 THEN '_QTY' WHEN 9 THEN 's' ELSE '_timestamp' END")
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_ENDS = lambda ends: "(" + " OR ".join(f"ends_with(n, '{e}')" for e in ends) + ")"


@query(f"""WITH x AS (SELECT DISTINCT {_NAME} AS name FROM orders), l AS (SELECT name, lower(name) AS n FROM x)
SELECT name, CASE WHEN list_contains({_LIST(infer.VARCHAR_NAMES)}, n) THEN 'varchar' WHEN list_contains({_LIST(infer.TIMESTAMP_NAMES)}, n) OR {_ENDS(infer.TIMESTAMP_ENDS)} THEN 'timestamp'
WHEN list_contains({_LIST(infer.DATE_NAMES)}, n) OR {_ENDS(infer.DATE_ENDS)} THEN 'date' WHEN n = 'id' OR ends_with(n, '_id') THEN 'int'
WHEN starts_with(n, 'is_') OR starts_with(n, 'has_') OR list_contains({_LIST(infer.BOOLEAN_NAMES)}, n) OR {_ENDS(infer.BOOLEAN_ENDS)} THEN 'boolean'
WHEN list_has_any(string_split(n, '_'), {_LIST(infer.INT_TOKENS)}) OR {_ENDS(infer.INT_ENDS)} THEN 'int' WHEN len(list_filter({_LIST(infer.DECIMAL_PARTS)}, lambda p: contains(n, p))) > 0 THEN 'decimal' ELSE 'varchar' END AS type FROM l""")
def infer_types_by_name(m):
    return m.table("orders").selectExpr(f"{_NAME} AS name").distinct().select("name", infer.type_by_name_column(F.col("name")).alias("type"))


@query("SELECT * FROM (VALUES ('amount', 'date'), ('day_count', 'int'), ('label', 'decimal'), ('code', 'varchar'), ('flagged', 'boolean'), ('parent_id', 'int'), ('total_amount', 'decimal')) t(name, type)")
def infer_type_precedence(m):
    cases = [("amount", "date", None), ("day_count", None, "numeric"), ("label", None, "numeric"), ("code", None, "varchar"), ("flagged", None, "boolean"), ("parent_id", None, None), ("total_amount", None, None)]
    return m.spark.createDataFrame([(n, infer.resolve_type(n, cast=c, usage=u)) for n, c, u in cases], "name string, type string")


@query("SELECT * FROM (VALUES ('orders', 'customer_id', 'customers'), ('orders', 'box', 'boxes'), ('items', 'order_id', 'orders'), ('items', 'category_id', 'raw_categories')) t(child, column_name, parent)")
def fk_candidates(m):
    tables = {"customers": ["id"], "orders": ["id", "customer_id", "box", "ordered_at"], "items": ["id", "order_id", "category_id"], "raw_categories": ["id"], "boxes": ["id"]}
    return m.spark.createDataFrame([(t, c, p) for t, cols in tables.items() for c in cols if (p := infer.foreign_key(t, c, tables))], "child string, column_name string, parent string")


# ------------------------------------------------------------------ lineage

#: Statements whose tables and columns either engine's parser tells.
_STATEMENTS = [
    "SELECT a, t.b AS c FROM t WHERE d > 1",
    "SELECT x.a, y.k FROM t x JOIN u y ON x.id = y.id WHERE y.e IS NOT NULL",
    "SELECT region, sum(amount) AS total FROM t GROUP BY region HAVING max(m) > 3",
    "WITH c AS (SELECT id, v FROM t) SELECT id FROM c WHERE v IN (SELECT w FROM u)",
    "WITH c AS (SELECT id FROM t) SELECT b FROM s WHERE k IN (SELECT id FROM c)",
    "WITH c AS (SELECT id FROM t), d AS (SELECT id FROM c) SELECT b, (SELECT max(id) FROM d) AS top FROM s",
    "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.k = t.id AND u.w > 2)",
    "SELECT CASE WHEN f THEN g ELSE h END AS z FROM t",
    "SELECT a FROM t UNION ALL SELECT b FROM u",
    "SELECT row_number() OVER (PARTITION BY p ORDER BY q) AS n FROM t",
    "SELECT z.a FROM (SELECT a, b FROM t WHERE r = 1) z WHERE z.b < 2",
    "SELECT CAST(a AS DATE) AS d, coalesce(b, c) AS e FROM t WHERE lower(f) LIKE 'x%'",
    "SELECT a FROM t WHERE b IN (SELECT DISTINCT c FROM u) AND d > (SELECT e FROM v ORDER BY g LIMIT 1)",
]


@query("""WITH s(k, ast) AS (SELECT k, json_serialize_sql(text) FROM (VALUES {}) x(k, text)), names AS (SELECT k, 'column' AS kind, unnest(regexp_extract_all(ast, '"column_names":\\[(?:"\\w+",)?"(\\w+)"\\]', 1)) AS name FROM s
UNION ALL SELECT k, 'table', unnest(regexp_extract_all(ast, '"table_name":"(\\w+)"', 1)) FROM s), ctes AS (SELECT k, unnest(regexp_extract_all(ast, '"key":"(\\w+)"', 1)) AS name FROM s)
SELECT DISTINCT k, kind, name FROM names WHERE kind = 'column' OR NOT EXISTS (SELECT 1 FROM ctes WHERE ctes.k = names.k AND ctes.name = names.name)""".format(", ".join("({}, '{}')".format(k, t.replace("'", "''")) for k, t in enumerate(_STATEMENTS))))
def lineage_reads(m):
    """Tables and columns that statements read, through aliases, subqueries and CTEs."""
    rows = set()
    for k, text in enumerate(_STATEMENTS):
        got = lineage.reads(m.spark, text)[0].columns
        rows |= {(k, "table", t) for t in got} | {(k, "column", c) for of in got.values() for c in of}
    return m.spark.createDataFrame(sorted(rows), "k int, kind string, name string")


# ------------------------------------------------------------------ verdicts


@query("""SELECT o_orderkey AS run, CASE WHEN o_orderkey % 17 = 0 THEN 'could_not_run' WHEN o_custkey % 3 > 0 THEN 'failed' WHEN o_orderkey % 4 = 0 THEN 'nothing_changed' WHEN o_custkey % 5 = 0 THEN 'passed' ELSE 'passed_with_warnings' END AS verdict FROM orders""")
def verdict(m):
    return judge.verdicts(m.table("orders").selectExpr("o_orderkey AS run", "o_orderkey % 17 = 0 AS fatal", "o_orderkey % 4 AS changed", "o_custkey % 3 AS failing", "o_custkey % 5 AS warnings"))


#: Records of runs of the suite made up from the orders: {} is 1 for the earlier record and 3 for the later.
_RECORD = {
    "verdict": "CASE CAST(floor(o_custkey / {}) AS BIGINT) % 5 WHEN 0 THEN 'nothing_changed' WHEN 1 THEN 'passed' WHEN 2 THEN 'passed_with_warnings' WHEN 3 THEN 'failed' ELSE 'could_not_run' END",
    "built": "CAST(floor(o_orderkey / {}) AS BIGINT) % 4",
    "failed": "CAST(floor(o_custkey / {}) AS BIGINT) % 3",
    "not_verified": "CAST(floor(o_orderkey / {}) AS BIGINT) % 2",
    "no_result": "CAST(floor(o_custkey / {}) AS BIGINT) % 2",
    "rename_detected": "CAST(floor(o_orderkey / {}) AS BIGINT) % 5 > 1",
}


def _record(step: int) -> list[str]:
    return ["o_orderkey AS run", *(f"{e.format(step)} AS {n}" for n, e in _RECORD.items())]


@query("""WITH b AS (SELECT {} FROM orders), n AS (SELECT {} FROM orders), j AS (SELECT n.run, list_position({ranks}, n.verdict) AS rank, list_position({ranks}, b.verdict) AS old_rank, n.built, b.built AS old_built, n.failed, b.failed AS old_failed,
n.not_verified, b.not_verified AS old_not_verified, n.no_result, b.no_result AS old_no_result, b.rename_detected AND NOT n.rename_detected AS lost FROM n JOIN b USING (run))
SELECT run, 'built fell' AS regression FROM j WHERE built < old_built UNION ALL SELECT run, 'failed rose' FROM j WHERE failed > old_failed UNION ALL SELECT run, 'not_verified rose' FROM j WHERE not_verified > old_not_verified
UNION ALL SELECT run, 'no_result rose' FROM j WHERE no_result > old_no_result UNION ALL SELECT run, 'rename no longer detected' FROM j WHERE lost UNION ALL SELECT run, 'verdict is worse' FROM j WHERE rank > old_rank""".format(", ".join(_record(1)), ", ".join(_record(3)), ranks=list(judge.RANK)))
def suite_regressions(m):
    o = m.table("orders")
    return judge.regressions(o.selectExpr(*_record(3)), o.selectExpr(*_record(1)))


@query("SELECT *, date_diff('hour', CAST(ts AS TIMESTAMP), CAST(ts AS TIMESTAMP) + INTERVAL 95 MINUTE) AS hours, date_diff('month', ts, ts + INTERVAL 40 DAY) AS months FROM (SELECT event_id, ts FROM events)")
def fn_date_diff(m):
    e = m.table("events").select("event_id", "ts")
    return e.select("event_id", "ts", scalar.date_diff("hour", F.col("ts"), F.expr("ts + interval 95 minutes")).alias("hours"), scalar.date_diff("month", F.col("ts"), F.expr("ts + interval 40 days")).alias("months"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey / (o_orderkey % 3) END AS ratio, initcap_ FROM (SELECT *, upper(o_orderstatus[1]) || lower(o_orderstatus[2:]) AS initcap_ FROM orders)")
def fn_safe_divide(m):
    return m.table("orders").select("o_orderkey", scalar.safe_divide(F.col("o_orderkey"), F.col("o_orderkey") % 3).alias("ratio"), F.initcap("o_orderstatus").alias("initcap_"))


@query("SELECT 'orders' AS table_name, 40::BIGINT AS n, 40::BIGINT AS keys, 0::BIGINT AS orphans, 0::BIGINT AS bad_status")
def generate_constraints(m):
    made = generate.tables(m.spark, generate.EXAMPLE, {"customers": 15, "orders": 40}, seed=42)
    o, c = made["orders"], made["customers"]
    orphans = quality.relationships(o, "customer_id", c, "id").agg(F.count("*").alias("orphans"))
    return o.agg(F.lit("orders").alias("table_name"), F.count("*").alias("n"), F.countDistinct("id").alias("keys"), F.count_if(~F.col("status").isin("pending", "paid", "cancelled")).alias("bad_status")).crossJoin(orphans).select("table_name", "n", "keys", "orphans", "bad_status")


# ------------------------------------------------------------------ joins, rollups and rules of their own


@query("SELECT a.o_orderkey, a.o_custkey, b.o_totalprice > 1000 AS is_big FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey")
def join_shared_key(m):
    o = m.table("orders")
    return o.select("o_orderkey", "o_custkey").join(o.select("o_orderkey", (F.col("o_totalprice") > 1000).alias("is_big")), "o_orderkey")


@query(f"WITH {_CTES} SELECT customer_id, count(*) AS n, sum(units)::BIGINT AS units FROM fct_orders GROUP BY customer_id")
def rollup_generated(m):
    return m.fct_orders().groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("units").alias("units"))


@query("SELECT l_suppkey FROM (SELECT l_suppkey + 1 AS l_suppkey FROM lineitem) l WHERE l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)")
def join_anti(m):
    return quality.relationships(m.table("lineitem").select((F.col("l_suppkey") + 1).alias("l_suppkey")), "l_suppkey", m.table("supplier"), "s_suppkey")


_DEFINED = [("semantic", 1, "orders", "revenue"), ("bi", 2, "orders", "revenue"), ("bi", 2, "orders", "count"), ("bi", 2, "items", "units"), ("config", 3, "orders", "count"), ("config", 3, "items", "revenue"), ("config", 3, "items", "units")]


@query("WITH d(source, place, relation, metric) AS (VALUES {}) SELECT relation, metric, arg_min(source, place) AS source FROM d GROUP BY relation, metric".format(", ".join(map(str, _DEFINED))))
def metric_first_definition(m):
    kinds = [[metrics.Definition(n, metrics.Leaf(r, "count", "*"), source=s) for s, _, r, n in _DEFINED if s == kind] for kind in ("semantic", "bi", "config")]
    return m.spark.createDataFrame([(x.relation, x.name, x.source) for x in metrics.first_of_each(*kinds)], "relation string, metric string, source string")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 2 THEN 'read ' || o_orderstatus || '.csv after' ELSE 'no column c' || CAST(o_custkey AS VARCHAR) || ' in run.t' END AS message FROM orders")
def judge_normalised(m):
    text = ("CASE o_orderkey % 3 WHEN 0 THEN 'no column `c' || o_custkey || '` in head.t (line ' || o_orderkey || ', pos 4)' WHEN 1 THEN 'no  column c' || o_custkey || ' in\\n base.t #' || o_orderkey || 'L' "
            "ELSE 'read /data/x' || o_custkey || '/' || o_orderstatus || '.csv after ' || o_orderkey || '.5 ms' END")
    return m.table("orders").selectExpr("o_orderkey AS k", f"{text} AS message").select("k", judge.normalised_column(F.col("message")).alias("message"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_valid(props)) AS valid, count(*) FILTER (WHERE json_exists(props, '$.k')) AS with_k FROM events GROUP BY 1")
def json_valid_exists(m):
    e = m.table("events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(js.valid(F.col("props"))).alias("valid"), F.count_if(js.exists(F.col("props"), "k")).alias("with_k"))


#: JSON texts of every kind, by the event; the same SQL on both sides.
_TEXTS = """CASE event_id % 9 WHEN 0 THEN '{"a": null}' WHEN 1 THEN '{"a": 1, "x-y": {"z": true}}' WHEN 2 THEN '{"x-y": {"z": null}, "b": 2}' WHEN 3 THEN '{bad' WHEN 4 THEN NULL WHEN 5 THEN '[1, 2]'
WHEN 6 THEN '12' WHEN 7 THEN '"text"' ELSE 'true' END"""


@query(f"""WITH x AS (SELECT event_id, {_TEXTS} AS t FROM events), v AS (SELECT event_id, t, CASE WHEN json_valid(t) THEN t END AS j FROM x)
SELECT event_id, coalesce(json_exists(j, '$.a'), false) AS has_a, coalesce(json_exists(j, '$."x-y".z'), false) AS has_z, t IS NOT NULL AND j IS NULL AS malformed, TRY_CAST(json_extract_string(j, '$.a') AS BIGINT) AS a,
CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(json_keys(j), ',') END AS keys, CASE json_type(j) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(j) END AS kind FROM v""")
def json_structure(m):
    t = F.col("t")
    kind = F.regexp_extract(js.type_of(t), "^[A-Z]+", 0)
    rows = m.table("events").selectExpr("event_id", f"{_TEXTS} AS t")
    return rows.select("event_id", js.exists(t, "a").alias("has_a"), js.exists(t, "x-y.z").alias("has_z"), F.coalesce(js.malformed(t), F.lit(False)).alias("malformed"), js.variant(t, "a", "integer").alias("a"), F.array_join(js.keys(t), ",").alias("keys"), kind.alias("kind"))


@query("""WITH x AS (SELECT o_orderkey, (o_custkey % 3 - 1)::DOUBLE AS a, nullif(o_orderkey % 4, 3)::DOUBLE AS b, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT o_orderkey, CASE WHEN b IS NULL THEN 'null' WHEN b <> 0 THEN 'number' WHEN a = 0 THEN 'nan' WHEN a > 0 THEN 'up' ELSE 'down' END AS quotient, CASE WHEN b <> 0 THEN a / b END AS value, round(cents / 100, 2) AS units FROM x""")
def fn_ieee_divide(m):
    a, b = F.col("o_custkey") % 3 - 1, F.nullif(F.col("o_orderkey") % 4, F.lit(3))
    rows = m.table("orders").select("o_orderkey", scalar.ieee_divide(a, b).alias("q"), scalar.cents_to_units(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("units"))
    q, top = F.col("q"), float("inf")
    kind = F.when(q.isNull(), "null").when(F.isnan(q), "nan").when(q == top, "up").when(q == -top, "down").otherwise("number")
    return rows.select("o_orderkey", kind.alias("quotient"), F.when(kind == "number", q).alias("value"), "units")


@query("SELECT 'l_shipdate' AS dimension, count(DISTINCT date_trunc('month', l_shipdate)) AS n_distinct FROM lineitem UNION ALL SELECT 'l_flags', count(DISTINCT l_returnflag || l_linestatus) FROM lineitem")
def distinct_expressions(m):
    return bd.distinct_counts(m.table("lineitem"), {"l_shipdate": "date_trunc('month', l_shipdate)", "l_flags": "l_returnflag || l_linestatus"})


# ------------------------------------------------------------------ whole runs


def _project(models: dict[str, str]) -> project.Project:
    p = project.Project("")
    for t in ("orders", "customer"):
        p.sources["shop", t] = project.Source("shop", t, t)
    for name, sql in models.items():
        p.models[name] = project.Model(name, sql)
    return project.linked(p)


def _sources(m):
    return {f"source.shop.{t}": m.table(t) for t in ("orders", "customer")}


_STAGED = "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total, o_orderstatus AS status FROM {{ source('shop', 'orders') }}"
_PAID = "SELECT order_id, customer_id, total FROM {{ ref('staged') }} WHERE status = 'F'"
_SPENT = "SELECT c_custkey AS customer_id, c_mktsegment AS segment, p.paid FROM {{ source('shop', 'customer') }} LEFT JOIN (SELECT customer_id, count(*) AS paid FROM {{ ref('paid') }} GROUP BY customer_id) p ON c_custkey = p.customer_id"
_RUN_BASE = {"staged": _STAGED, "paid": _PAID, "spent": _SPENT, "segments": "SELECT segment, sum(paid) AS paid FROM {{ ref('spent') }} GROUP BY segment"}
_RUN_HEAD = {**_RUN_BASE, "paid": _PAID.replace("= 'F'", "IN ('F', 'P')")}


_RUN_SQL = """staged AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total, o_orderstatus AS status FROM orders),
paid_base AS (SELECT order_id, customer_id, total FROM staged WHERE status = 'F'), paid_head AS (SELECT order_id, customer_id, total FROM staged WHERE status IN ('F', 'P')),
spent_base AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment, p.paid FROM customer LEFT JOIN (SELECT customer_id, count(*) AS paid FROM paid_base GROUP BY customer_id) p ON c_custkey = p.customer_id),
spent_head AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment, p.paid FROM customer LEFT JOIN (SELECT customer_id, count(*) AS paid FROM paid_head GROUP BY customer_id) p ON c_custkey = p.customer_id),
segments_base AS (SELECT segment, sum(paid)::BIGINT AS paid FROM spent_base GROUP BY segment), segments_head AS (SELECT segment, sum(paid)::BIGINT AS paid FROM spent_head GROUP BY segment)"""


def _compared(name: str) -> str:
    return f"""SELECT '{name}' AS model, 'success' AS outcome, (SELECT count(*) FROM {name}_base) AS rows_base, (SELECT count(*) FROM {name}_head) AS rows_head,
(SELECT count(*) FROM (SELECT * FROM {name}_head EXCEPT ALL SELECT * FROM {name}_base)) AS rows_differing"""


@query(f"WITH {_RUN_SQL} " + " UNION ALL ".join(_compared(n) for n in ("paid", "spent", "segments")))
def run_compared(m):
    """A whole run: what is affected is built on both sides, and the rows of each model are compared."""
    out = compare.run(m.spark, _project(_RUN_HEAD), _project(_RUN_BASE), _sources(m))
    rows = [(x.name, x.outcome, x.diff.rows_base, x.diff.rows_head, x.diff.rows_differing) for x in out.models if x.diff]
    return m.spark.createDataFrame(rows, "model string, outcome string, rows_base long, rows_head long, rows_differing long")


#: Models that fail only in the data: on head, on base, on both, on neither; each has a child.
_BROKEN = [(f"m{h}{b}{c}", h, b, c) for h in (0, 1) for b in (0, 1) for c in (0, 1)]


def _cast(fails: int, more: str = "") -> str:
    return f"SELECT o_orderkey, {'cast' if fails else 'try_cast'}(o_orderstatus AS INT) AS n{more} FROM {{{{ source('shop', 'orders') }}}}"


@query("""WITH cases(model, h, b, c) AS (VALUES {}), own AS (SELECT model, h, b, c, CASE WHEN h = 0 THEN 'success' WHEN b = 0 THEN 'failed' ELSE 'unverified_broken_on_base' END AS outcome FROM cases WHERE c = 1 OR h <> b),
reached AS (SELECT model, outcome FROM own UNION ALL SELECT model || '_child', CASE outcome WHEN 'failed' THEN 'skipped' WHEN 'unverified_broken_on_base' THEN 'skipped_by_unverified' ELSE outcome END FROM own)
SELECT * FROM reached WHERE (SELECT count(*) FROM orders WHERE try_cast(o_orderstatus AS INT) IS NULL) > 0""".format(", ".join(map(str, _BROKEN))))
def run_failures(m):
    """Errors that show in the data alone, as outcomes: a model is modified if its text differs (h <> b, or c)."""
    children = {f"{n}_child": f"SELECT o_orderkey FROM {{{{ ref('{n}') }}}}" for n, *_ in _BROKEN}
    head = {n: _cast(h, ", 1 AS c" if c else "") for n, h, _, c in _BROKEN} | children
    base = {n: _cast(b) for n, _, b, _ in _BROKEN} | children
    out = compare.run(m.spark, _project(head), _project(base), _sources(m))
    return m.spark.createDataFrame([(x.name, x.outcome) for x in out.models], "model string, outcome string")
