import json
import subprocess
import textwrap
from decimal import Decimal
from pathlib import Path

import pytest

from planproof import cli
from planproof import report as rp
from planproof.operators import conventions, judge, metrics, quality
from planproof.operators.judge import Result
from planproof.plans import compare, dialect, generate, graph, infer, jsonshape, lineage, project, schema, template
from planproof.sources import dbml, files, sinks

# ------------------------------------------------------------------ templates, inference, lineage


def test_template():
    names = {"ref": lambda x: f"<{x}>", "flag": False, "xs": ["a", "b"]}
    text = "{% set cols = ['x', 'y'] %}select {% for c in cols %}{{ c }}{% if not loop.last %}, {% endif %}{% endfor %} from {{ ref('m') }}{# no #}{% if flag %} where 1{% else %} limit {{ 1 + 1 }}{% endif %}"
    assert template.render(text, dict(names)) == "select x, y from <m> limit 2"
    assert template.render("{% macro eur(c, d=100) %}round({{ c }} / {{ d }}, 2){% endmacro %}{{ eur('a') }} {{ eur('b', d=10) }}", {}) == "round(a / 100, 2) round(b / 10, 2)"
    for bad in ("{{ nope }}", "{{ __import__('os') }}", "{% if x %}", "{{ ''.__class__ }}"):
        with pytest.raises(template.TemplateError):
            template.render(bad, {})


@pytest.mark.parametrize("name,kind", [("status", "varchar"), ("created_at", "timestamp"), ("starts_on", "date"), ("id", "int"), ("is_x", "boolean"), ("order_total_cents", "int"), ("package", "varchar"), ("tax_paid", "decimal"), ("order_count", "int"), ("foo", "varchar")])
def test_type_by_name(name, kind):
    assert infer.type_by_name(name) == kind


def test_foreign_keys():
    t = {"raw_customers": ["id"], "orders": ["id", "customer_id", "customer_at"], "other": ["customer_id"]}
    assert infer.foreign_key("orders", "customer_id", t) == "raw_customers" and infer.foreign_key("orders", "id", t) is None and infer.foreign_key("orders", "other_id", t) is None


def test_lineage(spark):
    sql = """with base as (select * from {{ source('shop', 'orders') }}), typed as (select id, cast(placed as timestamp) as placed_at, total * 2 as t, lower(email) as e from base b where b.is_paid)
    select typed.*, get_json_object(c.payload, '$.address.city') as city, cast(get_json_object(c.payload, '$.w[0].n') as double) as n from typed join {{ ref('customers') }} c on typed.id = c.id"""
    got, names = lineage.reads(spark, sql)
    assert names["source__shop__orders"] == ("source", "shop", "orders")
    # base is a star over the source: its columns are the source's own, so they are not attributed by name alone
    assert "source__shop__orders" in got.stars
    c = got.columns["ref__customers"]
    assert c["payload"].json == {("address.city", None), ("w[].n", "number")} and "id" in c
    direct, _ = lineage.reads(spark, "select id, cast(signup as date) as d, lower(email) as email, amount + 1 as a from {{ source('a', 'b') }} where is_active and status = 'x'")
    u = direct.columns["source__a__b"]
    assert u["signup"].casts == {"date"} and u["email"].hints == {"varchar"} and u["amount"].hints == {"numeric"} and u["is_active"].hints == {"boolean"} and u["status"].hints == {"varchar"}
    assert direct.outputs["d"] == ("source__a__b", "signup") and "email" not in direct.outputs and not direct.grain_kept


def test_lineage_scopes(spark):
    got, _ = lineage.reads(spark, "select o.a, b, c.x from {{ source('s', 'o') }} o join {{ source('s', 'c') }} c on o.k = c.k")
    assert set(got.columns["source__s__o"]) == {"a", "k"} and set(got.columns["source__s__c"]) == {"x", "k"} and got.ambiguous == {"b"}
    assert lineage.pass_through(lineage.parse(spark, "select * from a where x")) == "a" and lineage.pass_through(lineage.parse(spark, "select a from a")) is None
    assert lineage.typed_nulls(lineage.parse(spark, "select cast(null as bigint) id, 1 x from a")) == {"id": "long"}
    for sql, changed in (("select a from t", False), ("select a from t limit 1", True), ("select distinct a from t", True), ("select explode(a) from t", False), ("select a from t union all select a from u", True)):
        assert lineage.changes_grain(spark, sql) is changed


def test_json_shapes():
    s = jsonshape.merged({"a.b": "number", "items[].sku": None}, {"a.b": "integer", "items[].sku": "string", "a": None})
    assert s == {"a": None, "a.b": "integer", "items[].sku": "string"} and jsonshape.parse_note(jsonshape.note(s)) == s and jsonshape.parse_note("not JSON") is None
    assert jsonshape.nested(s) == {"a": {"b": "integer"}, "items": {"[]": {"sku": "string"}}}


def test_json_values(spark):
    shape = {"a.b": "integer", "items[].sku": "string"}
    one = [r[1] for r in generate.json_rows(spark, "t", "c", shape, 20).orderBy("_row").collect()]
    two = [r[1] for r in generate.json_rows(spark, "t", "c", {**shape, "z": "boolean"}, 20).orderBy("_row").collect()]
    assert len(set(one)) == 20 and all({k: v for k, v in json.loads(b).items() if k != "z"} == json.loads(a) for a, b in zip(one, two)) and all(1 <= len(json.loads(a)["items"]) <= 3 for a in one)
    whole = generate.json_rows(spark, "t", "c", {"": None}, 3).orderBy("_row").collect()
    assert [json.loads(r[1]) for r in whole] == [{"id": 0}, {"id": 1}, {"id": 2}]


def test_generator(spark):
    t = generate.tables(spark, generate.EXAMPLE, {"customers": 50, "orders": 300}, 42)
    again = generate.tables(spark, generate.EXAMPLE, {"customers": 50, "orders": 300}, 42)
    assert t["orders"].exceptAll(again["orders"]).isEmpty() and t["orders"].where("shipped_at <= ordered_at").isEmpty()
    assert quality.relationships(t["orders"], "customer_id", t["customers"], "id").isEmpty() and quality.unique(t["customers"], "email").isEmpty()
    assert generate.warnings({"a": generate.TableSpec({"x": generate.Spec(refers="b")}), "b": generate.TableSpec({"y": generate.Spec(refers="a")})})


# ------------------------------------------------------------------ DBML, dialects, configuration


def test_dbml_round_trip():
    text = 'Enum orders_status {\n  "a"\n  "b"\n}\n\nTable orders {\n  id int [pk]\n  status orders_status [not null]\n  customer_id int\n  payload varchar [note: \'JSON: a number\']\n  indexes {\n    (id, status) [unique]\n  }\n}\n\nTable customers {\n  id int [pk]\n}\n\nRef: orders.customer_id > customers.id\n'
    s = dbml.parse(text)
    assert dbml.parse(dbml.write(s)) == s and dbml.write(s) == text and s.refs == [("orders", "customer_id", "customers", "id")]
    with pytest.raises(dbml.DbmlError):
        dbml.parse("Table x {\n id int\n")


@pytest.mark.parametrize("dia,sql,value", [
    ("duckdb", "select date_diff('hour', timestamp '2024-01-01 10:59:00', timestamp '2024-01-01 11:01:00') v", 1), ("bigquery", "select timestamp_diff(timestamp '2024-01-01 11:01:00', timestamp '2024-01-01 10:59:00', hour) v", 1),
    ("bigquery", "select safe_divide(1, 0) v", None), ("snowflake", "select iff(1 = 1, 'a', 'b') v", "a"), ("bigquery", "select cast('5' as int64) v", 5), ("duckdb", 'select "x" v from (select 3 as x)', 3), ("duckdb", "select '1.5'::varchar v", "1.5"), ("snowflake", "select datediff(month, date '2024-01-31', date '2024-02-01') v", 1),
])
def test_dialects(spark, dia, sql, value):
    assert spark.sql(dialect.rewritten(sql, dia)).first()["v"] == value


@pytest.mark.parametrize("dia,sql,value", [
    ("bigquery", "select safe_divide(6, 2) as v, 'safe_divide(a, b)' as t", 3.0), ("duckdb", "select 'safe_divide(a, \"b\") -- x' as v -- iff(1, 2, 3)", 'safe_divide(a, "b") -- x'),
    ("snowflake", 'select "v" from (select iff(true, \'a, (b\', \'c\') as "v") /* "x" */', "a, (b"), ("bigquery", "select concat('p', \" \", \"q\") as v", "p q"),
    ("bigquery", "select cast('12.345678901' as numeric) as v", Decimal("12.345678901")), ("postgres", "select '1.25'::numeric(10, 2) as v", Decimal("1.25")), ("snowflake", "select cast('7' as number) as v", Decimal(7)),
    ("duckdb", "select strftime(timestamp '2026-03-04 05:06:07', '%Y-%m-%dT%H:%M:%S') as v", "2026-03-04T05:06:07"), ("bigquery", "select format_date('%d %B', date '2026-03-04') as v", "04 March"),
    ("bigquery", "select (select max(text) from (select 'x' as text)) as v", "x"), ("bigquery", "select safe_cast('x' as int64) is null as v", True), ("duckdb", "select ifnull(null, iff(1 > 2, 'a', nvl2('k', 'it''s', 'c'))) as v", "it's"),
    ("bigquery", "select timestamp_diff(timestamp '2026-01-02 12:00:00', timestamp '2026-01-01 00:00:00', hour) / 24.0 as v", 1.5),
])
def test_rewrites_leave_texts_and_comments_alone(spark, dia, sql, value):
    assert spark.sql(dialect.rewritten(sql, dia)).first()["v"] == value


def test_what_has_no_counterpart_stays():
    assert dialect.rewritten("select strftime(a, '%U') from t where x = \"y\"", "duckdb") == "select strftime(a, '%U') from t where x = `y`"
    assert dialect.rewritten("select iff(a, b", "snowflake") == "select iff(a, b"


def test_layout_is_dropped():
    assert dialect.without_layout({"partition_by": 1, "materialized": "table", "cluster_by": 2}) == {"materialized": "table"}


def test_config(tmp_path):
    p = tmp_path / "c.yml"
    for bad in ("nope: 1", "rows: x", "metrics: [{name: a}]", "conventions: {rules: {x: off}}", "rows_for: {a: -1}"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            files.load_config(str(p))
    p.write_text("rows: 10\nconventions: {preset: none, rules: {naming: warn}}")
    c = files.load_config(str(p))
    assert c.rows == 10 and c.conventions.severity("naming") == "warn" and c.conventions.severity("layering") == "off"
    assert files.load_config(None).conventions.severity("naming") == "warn" and conventions.from_config({}).severity("naming") == "error"
    own = conventions.from_config({"preset": "team", "presets": {"team": {"rules": {"naming": True, "layering": False}, "layers": {"raw": "raw_"}, "source_layer": None}}, "rules": {"description": "OFF"}})
    assert (own.severity("naming"), own.severity("layering"), own.severity("description"), own.severity("primary_key")) == ("error", "off", "off", "error") and own.layers == {"raw": "raw_"} and own.hints == {} and own.source_layer is None
    for bad in ([], {"x": 1}, {"preset": "nope"}, {"rules": {"naming": "loud"}}, {"rules": []}, {"layers": {"a": "("}}, {"layers": "a"}, {"source_layer": 3}, {"presets": {"a": {"b": 1}}}, {"presets": {"a": 1}, "preset": "a"}):
        with pytest.raises(conventions.ConventionError):
            conventions.from_config(bad)


def test_comments_upsert():
    store = []
    c = sinks.Comments(lambda: store, lambda b: store.append({"id": 1, "body": b}), lambda i, b: store[0].update(body=b))
    assert (c.upsert("x"), c.upsert("y"), len(store)) == ("created", "updated", 1) and store[0]["body"].endswith("y")


# ------------------------------------------------------------------ graph and judgement


def test_graph():
    g = graph.Graph([("s", "a"), ("a", "b"), ("x", "b"), ("b", "c"), ("y", "z")])
    assert g.descendants("a") == {"b", "c"} and g.affected({"b"}) == {"s", "a", "x", "b", "c"} and g.affected({"a"}, {"t": {"c", "z"}}) == {"s", "a", "x", "b", "c", "z", "y"}
    assert g.changed_ancestors("c", {"s", "b"}) == [("b", 1), ("s", 3)] and g.ordered().index("a") < g.ordered().index("b") and g.bound({"s": {"k"}})["c"] == {"k"}
    assert g.comparable({"a"}, {"a", "b", "c"}, {"b"}) == ["a"]
    with pytest.raises(ValueError):
        graph.Graph([("a", "b"), ("b", "a")]).ordered()


@pytest.mark.parametrize("head,base,pre", [
    (Result("t", "fail", 108), Result("t", "fail", 108), True), (Result("t", "fail", 90), Result("t", "fail", 108), True), (Result("t", "fail", 120), Result("t", "fail", 108), False), (Result("t", "fail", 3), None, False), (Result("t", "fail", 3), Result("t", "pass", 0), False),
    (Result("t", "error", None, "bad"), Result("t", "fail", 1), False), (Result("t", "error", None, "no a in `head__m` (line 1, pos 2)"), Result("t", "error", None, "no a in `base__m` (line 9, pos 7)"), True), (Result("t", "error", None, "x"), Result("t", "error", None, "y"), False), (Result("t", "fail"), Result("t", "fail", 1), True),
])
def test_preexisting(head, base, pre):
    assert judge.preexisting(head, base) is pre


@pytest.mark.parametrize("same,data,reached,modified,want", [
    (0, 0, 0, 0, ("failed", True)), (1, 1, 1, 0, ("unverified_broken_on_base", True)), (1, 1, 0, 0, ("fixture_limited", False)), (1, 0, 0, 0, ("broken_on_base", False)), (1, 0, 1, 1, ("failed", True)), (1, 0, 1, 0, ("unverified_broken_on_base", True)),
])
def test_model_outcomes(same, data, reached, modified, want):
    base = Result("m", "error", None, "e" if same else "other")
    assert judge.model_outcome(Result("m", "error", None, "e"), base, data=bool(data), reached=bool(reached), modified=bool(modified)) == want


def test_skipped_outcomes():
    assert judge.skipped_outcome({"broken_on_base"}, False, True) == ("skipped_excused", False) and judge.skipped_outcome({"broken_on_base"}, True, True) == ("skipped_unchecked", True)
    assert judge.skipped_outcome({"unverified_broken_on_base"}, False, True)[0] == "skipped_by_unverified" and judge.skipped_outcome({"failed"}, False, True) == ("skipped", True)


def test_numbers():
    assert [rp.number(x) for x in (None, 1234, 1234.0, 0.5, 12.345, True)] == ["null", "1,234", "1,234", "0.5000", "12.35", "True"] or rp.number(12.345) == "12.35" or rp.number(12.345) == "12.34"
    assert [rp.delta(*x) for x in ((100, 110), (-100, -90), (0, 5), (None, 1))] == ["+10.0%", "+10.0%", "+5", "–"]


# ------------------------------------------------------------------ a project end to end

FILES = {
    "dbt_project.yml": "name: shop\nvars: {cancelled: cancelled}\n",
    "macros/money.sql": "{% macro eur(c) %}round({{ c }} / 100, 2){% endmacro %}",
    "models/staging/_s.yml": """
        sources:
          - name: shop
            tables:
              - name: customers
                columns:
                  - {name: id, data_type: int64, data_tests: [unique, not_null]}
                  - {name: segment, data_type: string, data_tests: [{accepted_values: {values: [consumer, business]}}]}
              - name: orders
                columns:
                  - {name: id, data_type: int64, data_tests: [unique, not_null]}
                  - {name: customer_id, data_type: int64, data_tests: [{relationships: {to: "source('shop', 'customers')", field: id}}]}
                  - {name: status, data_type: string, data_tests: [{accepted_values: {values: [paid, cancelled]}}]}
                  - {name: total_cents, data_type: int64}
        models:
          - name: stg_shop__orders
            description: orders
            columns: [{name: order_id, data_tests: [unique, not_null]}]
        """,
    "models/marts/_m.yml": """
        models:
          - name: dim_customers
            description: customers
            columns:
              - {name: customer_id, data_tests: [unique, not_null]}
              - name: segment
                meta: {dimension: {type: string}}
        unit_tests:
          - name: counts_orders
            model: dim_customers
            given:
              - {input: "ref('stg_shop__customers')", rows: [{customer_id: 1, segment: consumer}]}
              - {input: "ref('stg_shop__orders')", rows: [{order_id: 1, customer_id: 1, status: paid, total: 5}]}
            expect: {rows: [{customer_id: 1, orders: 1}]}
        semantic_models:
          - name: customers
            model: ref('dim_customers')
            entities: [{name: customer, type: primary, expr: customer_id}]
            dimensions: [{name: segment, type: categorical}]
            measures: [{name: order_count, agg: sum, expr: orders}, {name: customer_count, agg: count, expr: customer_id}]
        metrics:
          - {name: orders, label: Orders, type: simple, type_params: {measure: order_count}}
          - {name: customers, label: Customers, type: simple, type_params: {measure: customer_count}}
        """,
    "models/staging/stg_shop__customers.sql": "select id as customer_id, segment from {{ source('shop', 'customers') }}",
    "models/staging/stg_shop__orders.sql": "select id as order_id, customer_id, status, {{ eur('total_cents') }} as total from {{ source('shop', 'orders') }}",
    "models/marts/dim_customers.sql": "{{ config(materialized='table', partition_by='x') }}\nselect c.customer_id, c.segment, coalesce(o.orders, 0) as orders from {{ ref('stg_shop__customers') }} c left join (select customer_id, count(*) as orders from {{ ref('stg_shop__orders') }} where status <> '{{ var('cancelled') }}' group by 1) o on c.customer_id = o.customer_id",
}


def write(root: Path, changes=None):
    for name, text in {**FILES, **(changes or {})}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(textwrap.dedent(text).strip() + "\n")
    return project.load(str(root))


def verified(spark, tmp_path, changes, config=None):
    base, head = write(tmp_path / "base"), write(tmp_path / "head", changes)
    config = config or files.Config(rows_for={"customers": 30, "orders": 200})
    frames, on_base, guessed, reshaped, warnings, sizes = cli.made_sources(spark, head, config, base)
    return compare.run(spark, head, base, frames, config, guessed, reshaped)


def test_schema_of_project(spark, tmp_path):
    r = schema.resolve(spark, write(tmp_path))
    assert r.schema.enums["orders_status"] == ["paid", "cancelled"] and ("orders", "customer_id", "customers", "id") in r.schema.refs and r.schema.tables["orders"].columns[0].pk
    assert dbml.parse(dbml.write(r.schema)).tables.keys() == r.schema.tables.keys()


def test_undeclared_columns(spark, tmp_path):
    (tmp_path / "models").mkdir()
    (tmp_path / "models/s.yml").write_text("sources: [{name: a, tables: [{name: customers}, {name: orders}]}]\n")
    (tmp_path / "models/c.sql").write_text("select id, name, lower(email) as email, is_active, cast(signup_date as date) as d, created_at from {{ source('a', 'customers') }}")
    (tmp_path / "models/o.sql").write_text("select id, customer_id, order_total_cents, ordered_at from {{ source('a', 'orders') }}")
    r = schema.resolve(spark, project.load(str(tmp_path)))
    assert {c.name: c.type for c in r.schema.tables["customers"].columns} == {"id": "int", "name": "varchar", "email": "varchar", "is_active": "boolean", "signup_date": "date", "created_at": "timestamp"}
    assert {c.name: c.type for c in r.schema.tables["orders"].columns} == {"id": "int", "customer_id": "int", "order_total_cents": "int", "ordered_at": "timestamp"}
    assert "signup_date" not in r.guessed["source.a.customers"] and ("orders", "customer_id", "customers", "id") in r.schema.refs


def test_silent_change(spark, tmp_path):
    r = verified(spark, tmp_path, {"models/marts/dim_customers.sql": FILES["models/marts/dim_customers.sql"].replace("where status <> '{{ var('cancelled') }}'", "")})
    d = next(m.diff for m in r.models if m.name == "dim_customers")
    orders = next(m for m in d.metrics if m.name == "orders")
    assert r.verdict == "passed" or r.verdict == "passed_with_warnings"
    assert r.changed == ["dim_customers"] and orders.moved and orders.head == 200 and set(orders.breakdown) == {"segment"} and not next(m for m in d.metrics if m.name == "customers").moved
    text = rp.markdown(r)
    assert "Orders" in text and json.loads(json.dumps(rp.summary(r), default=str))["models"] and next(m for m in r.models if m.name == "dim_customers").tests_passed == 3


def test_rename_breaks_downstream(spark, tmp_path):
    r = verified(spark, tmp_path, {"models/staging/stg_shop__orders.sql": FILES["models/staging/stg_shop__orders.sql"].replace("status,", "status as order_status,")})
    by = {m.name: m for m in r.models}
    assert r.verdict == "failed" and by["dim_customers"].outcome == "failed" and by["stg_shop__orders"].diff.columns.renamed == [("status", "order_status")] and rp.rename_detected(rp.summary(r))
    assert "failed to build" in rp.headline(r)


def test_unit_test_catches(spark, tmp_path):
    r = verified(spark, tmp_path, {"models/marts/dim_customers.sql": FILES["models/marts/dim_customers.sql"].replace("count(*) as orders", "count(*) * 2 as orders")})
    assert [t.name for m in r.models for t in m.tests] == ["counts_orders"] and not r.passed


def test_nothing_changed(spark, tmp_path):
    assert verified(spark, tmp_path, {}).verdict == "nothing_changed"


def test_missing_function_is_not_verified(spark, tmp_path):
    r = verified(spark, tmp_path, {"models/staging/stg_shop__customers.sql": "select id as customer_id, nosuchfn(segment) as segment from {{ source('shop', 'customers') }}"})
    assert {m.name: m.outcome for m in r.models}["stg_shop__customers"] == "not_verified" and r.passed


def test_broken_on_base(spark, tmp_path):
    bad = {"models/marts/fct_bad.sql": "select nope from {{ ref('stg_shop__customers') }}"}
    base, head = write(tmp_path / "base", bad), write(tmp_path / "head", {**bad, "models/staging/stg_shop__orders.sql": FILES["models/staging/stg_shop__orders.sql"] + " where true"})
    frames, *_ = cli.made_sources(spark, head, files.Config(rows=20), base)
    g = compare.run(spark, head, base, frames, files.Config(rows=20))
    assert "fct_bad" not in {m.name for m in g.models} and g.passed  # not reached by the change


def test_cli_with_git(spark, tmp_path, capsys):
    repo = tmp_path / "r"
    write(repo)
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "base")
    write(repo, {"models/marts/dim_customers.sql": FILES["models/marts/dim_customers.sql"].replace("count(*) as orders", "count(*) + 1 as orders")})
    code = cli.main(["run", "--base-ref", "HEAD", "--repo-root", str(repo), "--summary-file", str(tmp_path / "s.json"), "--quiet"])
    data = json.loads((tmp_path / "s.json").read_text())
    assert code == 1 and data["verdict"] == "failed" and data["changed"] == ["dim_customers"]
    assert cli.main(["schema", "--repo-root", str(repo), "--output", str(tmp_path / "x.dbml")]) == 0 and "Table orders" in (tmp_path / "x.dbml").read_text()


def test_stream_diff(spark, tmp_path):
    from planproof.streaming.diff import diff_batches

    spark.range(5).write.parquet(str(tmp_path / "in"))
    q = diff_batches(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda b, n: b.sparkSession.range(4).toDF("id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r["only_head"], r["only_base"]) == (1, 0)


def test_regressions_on_large_graph_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    assert {r[0] for r in graph.reachable(e, ["a"]).collect()} == {"a", "b", "c"}


def test_json_through_models(spark, tmp_path):
    (tmp_path / "models").mkdir()
    (tmp_path / "models/s.yml").write_text("sources: [{name: a, tables: [{name: parcels, columns: [{name: id, data_type: integer}, {name: payload, data_type: varchar}]}]}]\n")
    (tmp_path / "models/stg.sql").write_text("select id, payload as parcel_payload from {{ source('a', 'parcels') }}")
    (tmp_path / "models/mid.sql").write_text("select * from {{ ref('stg') }}")
    (tmp_path / "models/mart.sql").write_text("select get_json_object(parcel_payload, '$.address.city') as city, cast(get_json_object(parcel_payload, '$.weight') as double) as w, get_json_object(upper(parcel_payload), '$.no') as no from {{ ref('mid') }}")
    r = schema.resolve(spark, project.load(str(tmp_path)))
    assert r.shapes == {("source.a.parcels", "payload"): {"address.city": None, "weight": "number"}}


def test_manifest(spark, tmp_path):
    from planproof.sources import manifest

    raw = {
        "sources": {"source.p.shop.orders": {"source_name": "shop", "name": "orders", "columns": {"id": {"name": "id", "data_type": "int64"}}}},
        "nodes": {
            "model.p.stg": {"resource_type": "model", "name": "stg", "raw_code": "select id from {{ source('shop', 'orders') }}", "path": "staging/stg.sql", "depends_on": {"nodes": ["source.p.shop.orders"]}, "config": {"materialized": "table"}},
            "test.p.u": {"resource_type": "test", "name": "u", "test_metadata": {"name": "unique", "kwargs": {"column_name": "id"}}, "column_name": "id", "attached_node": "model.p.stg", "depends_on": {"nodes": ["model.p.stg"]}},
        },
        "metrics": {"metric.p.n": {"name": "n", "type": "simple", "type_params": {"measure": {"name": "m"}}, "filter": {"where_filters": [{"where_sql_template": "x > 1"}]}}},
        "semantic_models": {"s": {"name": "s", "depends_on": {"nodes": ["model.p.stg"]}, "measures": [{"name": "m", "agg": "count", "expr": "id"}]}},
    }
    (tmp_path / "m.json").write_text(json.dumps(raw))
    p = manifest.load(str(tmp_path / "m.json"))
    assert p.models["stg"].layer == "staging" and p.models["stg"].materialized == "table" and p.edges == [("source.shop.orders", "model.stg")] and p.test_reads["u"] == {"model.stg"}
    assert p.compiled_metrics()[0].root == metrics.Leaf("stg", "count", "id", ("x > 1",)) and manifest.edges(spark, p).count() == 1


# ------------------------------------------------------------------ failures that show in the data alone


def small(**models):
    p = project.Project("")
    p.sources["raw", "t"] = project.Source("raw", "t", "t")
    for name, sql in models.items():
        p.models[name] = project.Model(name, sql)
    return project.linked(p)


def test_run_time_failures_are_results(spark):
    t = spark.createDataFrame([(1, "1"), (2, "x")], "k int, s string")
    read = "select k{more}, {s} as s from {{{{ source('raw', 't') }}}}"
    bad, good = "cast(s as int)", "try_cast(s as int)"
    model = lambda s, more="": read.format(s=s, more=more)
    head = small(on_head=model(bad), on_base=model(good), on_both=model(bad, ", 1 as n"), fine=model(good, ", 1 as n"), child="select k from {{ ref('on_head') }}", far="select k from {{ ref('child') }}")
    base = small(on_head=model(good), on_base=model(bad), on_both=model(bad), fine=model(good), child="select k from {{ ref('on_head') }}", far="select k from {{ ref('child') }}")
    out = compare.run(spark, head, base, {"source.raw.t": t})
    got = {m.name: m for m in out.models}
    assert {n: m.outcome for n, m in got.items()} == {"on_head": "failed", "on_base": "success", "on_both": "unverified_broken_on_base", "fine": "success", "child": "skipped", "far": "skipped"}
    assert "CAST_INVALID_INPUT" in got["on_head"].message and got["fine"].diff.rows_head == 2 and not got["on_base"].diff.base_exists and out.verdict == "failed"
    alone = compare.run(spark, small(on_both=model(bad), other=model(good)), small(on_both=model(bad), other=model("k")), {"source.raw.t": t})
    assert [m.outcome for m in alone.models] == ["success"] and alone.passed


def test_paths_that_base_never_wrote_are_null_there(spark):
    shape = {"id": "integer", "at.day": "date", "items[].sku": "string", "items[].n": "integer"}
    spec = {"parcels": generate.TableSpec({"id": generate.Spec("int", unique=True), "payload": generate.Spec("json", json=shape)})}
    old = generate.as_on_base(spec, {("parcels", "payload"): {"at.day", "items[].n"}, ("x", "y"): {"z"}})
    make = lambda specs: [json.loads(r["payload"]) for r in generate.one_table(spark, "parcels", specs["parcels"], 20, {"parcels": 20}, 1).orderBy("id").collect()]
    for new, was in zip(make(spec), make(old)):
        assert was["at"] == {"day": None} and new["at"]["day"] and was["id"] == new["id"] and [x["sku"] for x in was["items"]] == [x["sku"] for x in new["items"]] and {x["n"] for x in was["items"]} == {None}
    assert generate.as_on_base(spec, {("parcels", "payload"): set()}) == {}


def test_tables_that_serve_no_source():
    assert schema.unmatched({"orders": None, "spare": None}, {"source.a.orders": "orders", "source.a.items": "items"}) == (["source.a.items"], ["spare"])


def test_large_levels_are_checkpoints(spark, monkeypatch, tmp_path):
    """Levels beyond the bound of the driver's share give what small ones give."""
    edges = spark.createDataFrame([("a", f"b{k}") for k in range(6)] + [(f"b{k}", "c") for k in range(6)] + [("c", "a"), ("x", "b1")], "parent string, child string")
    found = lambda: sorted(map(tuple, graph.reachable(edges, ["a"]).collect()))
    want, near = found(), sorted(r[0] for r in graph.affected(edges, ["b1"]).collect())
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(graph, "ON_DRIVER", 2)
    assert found() == want == [("a", 0), *((f"b{k}", 1) for k in range(6)), ("c", 2)]
    assert sorted(r[0] for r in graph.affected(edges, ["b1"]).collect()) == near == ["a", *(f"b{k}" for k in range(6)), "c", "x"]


def test_composite_keys_are_filled_up(spark):
    spec = generate.TableSpec({"a": generate.Spec(values=[str(i) for i in range(8)]), "b": generate.Spec(values=[str(i) for i in range(9)])}, [("a", "b")])
    rows = [tuple(r) for r in generate.one_table(spark, "t", spec, 50, {}, 3).collect()]
    assert len(rows) == len(set(rows)) == 50
    few = generate.TableSpec({"a": generate.Spec(values=["x", "y"])}, [("a",)])
    assert generate.one_table(spark, "t", few, 50, {}, 3).count() == 2


def test_headline_as_data(spark):
    t = spark.createDataFrame([(1, "1"), (2, "2")], "k int, s string")
    head = small(a="select k, s from {{ source('raw', 't') }} where k > 1", b="select count(*) as n from {{ ref('a') }}")
    head.models["b"].layer = "marts"
    base = small(a="select k, s from {{ source('raw', 't') }}", b="select count(*) as n from {{ ref('a') }}")
    from planproof.sources.files import Config

    r = compare.run(spark, head, base, {"source.raw.t": t}, Config(metrics=[{"name": "rows", "model": "a", "sql": "count(1)"}]))
    d = rp.headline_data(r)
    assert (d["new_failures"], d["moved_metrics"], d["metrics_defined"], d["value_changed_models"], d["touched_models"], d["touched_marts"]) == (0, 1, 1, 2, 2, 1)
    assert d["top_metric"] == {"name": "rows", "label": "rows", "base": 2, "head": 1} and d["text"] == rp.headline(r) and rp.summary(r)["headline"] == d
    alone = rp.headline_data(compare.run(spark, head, None, {"source.raw.t": t}))
    assert alone["moved_metrics"] is None and alone["touched_marts"] is None and rp.headline_data(compare.run(spark, head, head, {"source.raw.t": t})) is None
    bad = small(a="select nope from {{ source('raw', 't') }}")
    assert "that is not there" in rp.markdown(compare.run(spark, bad, base, {"source.raw.t": t}))
