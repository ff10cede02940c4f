"""The opportunity view over order tables: which column plays which role, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AMOUNTS = ["revenue", "revenue_updated", "budget", "cost"]
DATES = ["registered_at", "start_at", "real_end_at", "closing_at", "planned_end_at"]
LEVELS = ["entity", "opp_type", "category", "status"]
STATUSES = ["won", "lost", "in_progress"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the roles of a sales opportunity; null and negative values as in real exports.

    Line amounts count in whole millionths, so that an order's sum, and the fourth decimal it is rounded to (halves up), is the same in whatever order lines arrive.
    """
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.sum("l_quantity").alias("qty"),
        F.sum(F.rint(net * 1e6)).alias("net"), F.sum(F.rint(net * (1 + F.col("l_tax")) * 1e6)).alias("gross"),
    )
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("code"), F.col("c_name").alias("client"), F.col("n_name").alias("entity"), F.col("o_orderpriority").alias("opp_type"), F.col("c_mktsegment").alias("category"),
        F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "P", "lost").otherwise("in_progress").alias("status"),
        F.col("o_orderdate").alias("registered_at"), F.col("first_ship").alias("start_at"), F.when(F.col("o_orderstatus") == "F", F.col("last_ship")).alias("real_end_at"),
        F.when(key % 7 != 0, F.col("last_ship")).alias("closing_at"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("planned_end_at"),
        (F.round(F.coalesce("net", F.lit(0.0)) / 100) / 10_000).alias("revenue"), (F.round(F.coalesce("gross", F.lit(0.0)) / 100) / 10_000).alias("revenue_updated"),
        F.when(key % 11 != 0, F.col("o_totalprice")).alias("budget"), F.round(F.coalesce("qty", F.lit(0.0)) * 900 - 2000, 2).alias("cost"),
    )


OPP = """opp as (
  select o_orderkey as code, c_name as client, n_name as entity, o_orderpriority as opp_type, c_mktsegment as category,
    case o_orderstatus when 'F' then 'won' when 'P' then 'lost' else 'in_progress' end as status,
    o_orderdate as registered_at, first_ship as start_at, case when o_orderstatus = 'F' then last_ship end as real_end_at,
    case when o_orderkey % 7 <> 0 then last_ship end as closing_at, o_orderdate + interval 60 day as planned_end_at,
    round(coalesce(net, 0) / 100) / 10000 as revenue, round(coalesce(gross, 0) / 100) / 10000 as revenue_updated,
    case when o_orderkey % 11 <> 0 then o_totalprice end as budget, round(coalesce(qty, 0) * 900 - 2000, 2) as cost
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join (
    select l_orderkey, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship, sum(l_quantity) as qty,
      sum(round_even(l_extendedprice * (1 - l_discount) * 1e6, 0)) as net, sum(round_even(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 1e6, 0)) as gross
    from lineitem group by l_orderkey) on o_orderkey = l_orderkey)"""


class Book:
    """Queries and their SQL, collected by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def on_view(self, name: str, sql: str | None = None):
        """Register a function of the opportunity view; its SQL may use opp."""

        def add(f):
            self.queries[name] = lambda spark, sf_dir: f(opportunities(spark, sf_dir))
            if sql:
                body = sql.strip()
                rest = body.lower()
                recursive = rest.startswith("with recursive ")
                self.oracle[name] = f"with recursive {OPP}, {body[15:]}" if recursive else f"with {OPP}, {body[5:]}" if rest.startswith("with ") else f"with {OPP} {body}"
            return f

        return add

    def on_tables(self, name: str, sql: str | None = None):
        """Register a function of (spark, sf_dir)."""

        def add(f):
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql.strip()
            return f

        return add
