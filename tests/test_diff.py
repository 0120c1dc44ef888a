import collections
import random

from planproof.operators import breakdown as bd
from planproof.operators import diff, metrics, profile
from planproof.plans.compare import compare_model, spanning


def frame(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def test_signed_counts_match_multisets(spark):
    rnd = random.Random(3)
    for _ in range(4):
        make = lambda: [(rnd.choice([1, 2, None]), rnd.choice(["a", None, "b"]), rnd.choice([0.0, -0.0, float("nan"), None])) for _ in range(rnd.randrange(1, 40))]
        h, b = make(), make()
        key = lambda r: tuple("nan" if v != v else v for v in r)
        H, B = collections.Counter(map(key, h)), collections.Counter(map(key, b))
        got = diff.row_diff(frame(spark, h, "k int, s string, x double"), frame(spark, b, "k int, s string, x double")).first()
        assert (got["only_head"], got["only_base"]) == (sum((H - B).values()), sum((B - H).values()))


def test_schema_rows_and_metrics(spark):
    base = frame(spark, [(1, "a", 10.0, "2024-01-01"), (2, "b", 20.0, "2024-01-02"), (3, "c", 30.0, "2024-01-03")], "customer_id int, name string, revenue double, since_date string").selectExpr("customer_id", "name", "revenue", "cast(since_date as date) since_date")
    head = base.where("customer_id < 3").selectExpr("customer_id", "revenue", "cast(since_date as string) since_date", "true as is_active")
    defs = metrics.config_metrics([{"name": n, "model": "m", "sql": s} for n, s in (("revenue", "sum(revenue)"), ("customers", "count(*)"), ("max_id", "max(customer_id)"), ("broken", "sum(nope)"))])
    d = compare_model("m", head, base, defs)
    assert d.columns.added == [("is_active", "BOOLEAN")] and d.columns.removed == [("name", "STRING")] and d.columns.retyped == [("since_date", "DATE", "STRING")]
    assert (d.rows_base, d.rows_head, d.rows_differing, d.compared_columns) == (3, 2, 0, 2) and d.breaking and not d.identical
    by = {m.name: m for m in d.metrics}
    assert (by["revenue"].base, by["revenue"].head, by["max_id"].head) == (60.0, 30.0, 2) and by["broken"].unsupported and by["broken"].head is None


def test_identical_and_new(spark):
    a = frame(spark, [(1, 5.0)], "id int, v double")
    assert compare_model("m", a, a, []).identical
    d = compare_model("m", a, None, [])
    assert not d.base_exists and d.rows_head == 1 and len(d.columns.added) == 2


def test_rename_profile_references(spark):
    base = frame(spark, [(1, "consumer"), (2, "business"), (3, "consumer")], "customer_id int, customer_segment string")
    head = base.selectExpr("customer_id", "customer_segment as segment", "customer_segment = 'business' as is_business")
    d = compare_model("m", head, base, [], texts={"a": "select customer_segment from m", "b": "select customer_segments"})
    assert d.columns.renamed == [("customer_segment", "segment")] and d.columns.added == [("is_business", "BOOLEAN")] and not d.columns.removed
    assert d.profiles[0].text() == "1 true, 2 false" and d.references == {"customer_segment": ["a"]}


def test_no_common_column_is_null(spark):
    assert diff.row_diff(frame(spark, [(1,)], "a int"), frame(spark, [(1,)], "b int")).first()["only_head"] is None


def test_maps_compare(spark):
    a = spark.sql("select map('x', 1, 'y', 2) m union all select map('y', 2, 'x', 1)")
    assert tuple(diff.row_diff(a, spark.sql("select map('x', 1, 'y', 2) m")).first()) == (1, 0)


def test_breakdown_and_gate(spark):
    base = frame(spark, [(1, 10.0, "consumer"), (2, 20.0, "consumer"), (3, 30.0, "business")], "id int, revenue double, segment string")
    head = frame(spark, [(1, 15.0, "consumer"), (2, 20.0, "consumer"), (3, 50.0, "business")], "id int, revenue double, segment string")
    got = bd.top_contributors(bd.breakdown(head, base, {"segment": "segment"}, "sum(revenue)")).orderBy("place").collect()
    assert [(r["value"], r["base"], r["head"]) for r in got] == [("business", 30.0, 50.0), ("consumer", 30.0, 35.0)]
    city = spark.range(13).selectExpr("id", "concat('c', id) city", "if(id % 2 = 0, 'a', 'b') segment")
    assert [r[0] for r in bd.gate(city, {"city": "city", "segment": "segment"}).collect()] == ["segment"]


def test_null_dimension_is_a_group(spark):
    base, head = frame(spark, [(None, 1.0)], "d string, v double"), frame(spark, [(None, 3.0)], "d string, v double")
    r = bd.breakdown(head, base, {"d": "d"}, "sum(v)").collect()
    assert len(r) == 1 and (r[0]["value"], r[0]["contribution"]) == (None, 2.0)


def test_profile_top(spark):
    df = frame(spark, [("a",), ("b",), ("a",), (None,)], "v string")
    assert profile.profile(df, ["v"])[0].text() == "2 distinct: a 2, b 1; 1 null"


def test_spanning(spark):
    count = lambda r: metrics.Leaf(r, "count", "*")
    defs = [metrics.Definition("opc", metrics.Quotient(count("orders"), count("customers")))]
    o, c3, c2 = spark.range(1), spark.range(3), spark.range(2)
    x = spanning(defs, {"orders": o, "customers": c2}, {"orders": o, "customers": c3}, {"customers"})[0]
    assert (round(x.base, 4), x.head, x.moved) == (0.3333, 0.5, True)
    x = spanning(defs, {"orders": o, "customers": c2}, {"orders": o}, {"customers"})[0]
    assert x.base is None and x.moved
    x = spanning(defs, {"orders": o}, {}, {"orders"})[0]
    assert x.unsupported and not x.moved


def test_moved_rule():
    nan, inf = float("nan"), float("inf")
    assert not metrics.values_moved(1.0, 1.0 + 1e-12) and metrics.values_moved(None, 0) and not metrics.values_moved(None, None) and not metrics.values_moved(nan, 1) and not metrics.values_moved(inf, inf)
