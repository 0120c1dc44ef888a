"""The example star schema over the star-schema tables, in a base and a changed version.

customers: customer; orders: orders; order items: lineitem; products: part. Money is whole cents, so sums are
exact in any order of rows. `F` orders stand for cancelled ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


class Marts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stg_orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"),
            cents("o_totalprice").alias("total_cents"), F.col("o_orderdate").alias("ordered_at"), F.col("o_orderpriority").alias("channel"),
        )

    def stg_items(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"),
            cents("l_extendedprice").alias("gross_cents"), F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("bigint").alias("discount_cents"),
            F.col("l_shipdate").alias("shipped_at"), F.col("l_returnflag").alias("return_flag"),
        )

    def items_aggregated(self) -> DataFrame:
        return self.stg_items().groupBy("order_id").agg(
            F.count("*").alias("line_item_count"), F.sum("quantity").alias("units"), F.sum("gross_cents").alias("gross_amount_cents"),
            F.sum("discount_cents").alias("discount_amount_cents"), F.sum(F.col("gross_cents") - F.col("discount_cents")).alias("net_amount_cents"),
        )

    def fct_orders(self) -> DataFrame:
        o, i = self.stg_orders(), self.items_aggregated()
        return o.join(i, "order_id", "left").select(
            "order_id", "customer_id", "status", "channel", F.to_date("ordered_at").alias("order_date"), F.coalesce("line_item_count", F.lit(0)).alias("line_item_count"),
            F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("net_amount_cents", F.lit(0)).alias("net_amount_cents"),
            (F.col("status") == "F").alias("is_cancelled"), F.col("status").isin("O", "P").alias("is_open"), F.col("line_item_count").isNotNull().alias("has_items"),
            F.when(F.col("status") == "F", "closed").when(F.col("status") == "O", "open").otherwise("other").alias("status_group"),
        )

    def fct_order_items(self) -> DataFrame:
        i, o = self.stg_items(), self.stg_orders().select("order_id", "customer_id", "ordered_at")
        net = F.col("gross_cents") - F.col("discount_cents")
        days = F.datediff(F.to_date("shipped_at"), F.to_date("ordered_at")).cast("bigint")
        return i.join(o, "order_id").select("order_id", "product_id", "customer_id", "quantity", "gross_cents", net.alias("net_cents"), days.alias("days_to_ship"))

    def dim_products(self) -> DataFrame:
        sold = self.stg_items().groupBy("product_id").agg(F.sum("quantity").alias("units_sold"), F.countDistinct("order_id").alias("orders"))
        p = self.table("part")
        return p.join(sold, p.p_partkey == sold.product_id, "left").select(
            F.col("p_partkey").alias("product_id"), F.upper("p_brand").alias("brand"), F.initcap(F.lower("p_type")).alias("type"), F.col("p_size").cast("bigint").alias("size"),
            F.coalesce("units_sold", F.lit(0)).alias("units_sold"), F.coalesce("orders", F.lit(0)).alias("orders"),
        )

    def dim_customers(self, count_cancelled: bool = False) -> DataFrame:
        """Lifetime figures of each customer; the changed version counts cancelled orders too."""
        o = self.fct_orders()
        if not count_cancelled:
            o = o.where(F.col("status") != "F")
        life = o.groupBy("customer_id").agg(
            F.count("*").alias("lifetime_orders"), F.sum("net_amount_cents").alias("lifetime_cents"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date")
        )
        c = self.table("customer")
        return c.join(life, c.c_custkey == life.customer_id, "left").select(
            F.col("c_custkey").alias("customer_id"), F.lower("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("bigint").alias("nation_id"),
            F.coalesce("lifetime_orders", F.lit(0)).alias("lifetime_orders"), F.coalesce("lifetime_cents", F.lit(0)).alias("lifetime_cents"),
            F.col("lifetime_orders").isNotNull().alias("has_ordered"), "first_order_date", "last_order_date",
        )
