"""Sources and sinks (A): CSV with coerced dates, typed ingest, renaming, aligned versions, column families, outside series."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import interpolate
from ..plans.roles import AMOUNTS, DATES, Book, read

book = Book()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder (spark.checkpoint.dir; a temporary one only where none is set)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
    return f"{at}/files-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """A result table as CSV with a header, written by the executors."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def load_csv(spark: SparkSession, path: str, dates: list[str] | None = None, sep: str = ",", fmt: str | None = None) -> DataFrame:
    """All columns as text but ``dates``, where what does not parse is null; bytes that are not UTF-8 are read as Latin-1.

    A missing file raises Spark's own error, a missing date column ValueError.
    """
    take = lambda enc: spark.read.option("header", True).option("sep", sep).option("encoding", enc).csv(path)
    df = take("UTF-8")
    broken = F.concat_ws("", *(F.col(f"`{c}`") for c in df.columns)).contains("�")
    if not df.where(broken).isEmpty():
        df = take("ISO-8859-1")
    require(df, dates or [])
    return df.withColumns({c: F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c) for c in dates or []})


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def retype(df: DataFrame, dates: tuple[str, ...] = ("date", "_at"), amounts: tuple[str, ...] = ("revenue", "budget", "cost")) -> DataFrame:
    """Text columns typed by their names: dates to timestamps, amounts such as ``1 234,50 EUR`` to doubles; names are trimmed."""
    out = []
    for c, t in df.dtypes:
        x, name = F.col(f"`{c}`"), c.strip()
        if t == "string" and any(d in name.lower() for d in dates):
            x = F.try_to_timestamp(x)
        elif t == "string" and any(a in name.lower() for a in amounts):
            x = F.regexp_replace(F.regexp_replace(x, r"[^0-9,.\-]", ""), ",", ".").try_cast("double")
        out.append(x.alias(name))
    return df.select(*out)


def renamed(df: DataFrame, names: DataFrame, old: str = "original", new: str = "clean") -> DataFrame:
    """Renamed by a dictionary table; only its rows for columns of ``df`` reach the driver."""
    pairs = names.where(F.col(old).isin(df.columns)).select(old, new).collect()
    return df.withColumnsRenamed({r[0]: r[1] for r in pairs})


def aligned(versions: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """Versions under the columns of the first one, stacked; missing columns are null, or raise if ``strict``."""
    (_, first), *_ = versions.items()
    out = None
    for name, df in versions.items():
        if strict and set(df.columns) != set(first.columns):
            raise ValueError(f"{name}: columns differ: {sorted(set(df.columns) ^ set(first.columns))}")
        kinds = dict(first.dtypes)
        part = df.select(*(F.col(c).cast(kinds[c]) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in first.columns), F.lit(name).alias("version"))
        out = part if out is None else out.unionByName(part)
    return out


def external_series(spark: SparkSession, path: str, date: str, value: str) -> DataFrame:
    """(p, y): a CSV's values on a gapless grid of months, interpolated."""
    s = load_csv(spark, path, [date]).select(F.trunc(date, "month").alias("p"), F.col(value).try_cast("double").alias("y")).dropna()
    s = s.groupBy("p").agg(F.sum("y").alias("y"))
    grid = s.agg(F.explode(F.sequence(F.min("p"), F.max("p"), F.expr("interval 1 month"))).alias("p"))
    return interpolate(grid.join(s, "p", "left").withColumn("s", F.lit(0))).select("p", "y")


@book.on_tables("A1_csv", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority from orders")
def csv_round_trip(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    back = load_csv(spark, write_csv(o, scratch(spark), ";"), ["day"], ";")
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.date_format("day", "yyyy-MM-dd").alias("day"), "o_orderpriority")


def export(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", fmt: str = "csv", by: list[str] | None = None) -> str:
    """A result table to files: chosen columns, CSV with a separator or Parquet, in folders of the columns ``by``; nested columns become JSON in CSV. Missing columns raise."""
    out = require(df, [*(columns or []), *(by or [])]).select(*(columns or df.columns))
    if fmt == "csv":
        out = out.withColumns({c: F.to_json(c) for c, t in out.dtypes if t.startswith(("array", "map", "struct"))})
    writer = out.write.mode("overwrite").partitionBy(*(by or []))
    (writer.option("header", True).option("sep", sep).csv if fmt == "csv" else writer.parquet)(path)
    return path


@book.on_view("A6_table_sinks", "select code, status, round((revenue - cost) * 100 / nullif(revenue, 0), 4) as margin_pct, 'csv' as kind from opp union all select code, status, round((revenue - cost) * 100 / nullif(revenue, 0), 4), 'parquet' from opp")
def table_sinks(df: DataFrame) -> DataFrame:
    """A table of business variables written with another separator and as Parquet by status, and read back."""
    spark = df.sparkSession
    t = df.select("code", "status", F.round(F.try_divide((F.col("revenue") - F.col("cost")) * 100, F.expr("nullif(revenue, 0)")), 4).alias("margin_pct"), "client")
    columns = ["code", "status", "margin_pct"]
    text = load_csv(spark, export(t, scratch(spark), columns, "|"), sep="|").select(F.col("code").cast("long"), "status", F.col("margin_pct").cast("double"), F.lit("csv").alias("kind"))
    return text.union(spark.read.parquet(export(t, scratch(spark), columns, fmt="parquet", by=["status"])).select("code", "status", "margin_pct", F.lit("parquet")))


@book.on_view("A2_typed_ingest", "select code, strftime(planned_end_at, '%Y-%m-%d') as planned_end, budget, cost from opp")
def typed_ingest(df: DataFrame) -> DataFrame:
    text = lambda c: F.concat(F.translate(F.col(c).cast("decimal(18,2)").cast("string"), ".", ","), F.lit(" EUR"))
    raw = df.select("code", F.date_format("planned_end_at", "yyyy-MM-dd").alias(" planned_end_at "), text("budget").alias("budget"), text("cost").alias("cost"))
    return retype(raw).select("code", F.date_format("planned_end_at", "yyyy-MM-dd").alias("planned_end"), "budget", "cost")


@book.on_tables("A3_renamed", "select n_nationkey as id, n_name as entity, n_regionkey from nation")
def renamed_nations(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    names = n.sparkSession.createDataFrame([("n_nationkey", "id"), ("n_name", "entity"), ("absent", "x")], "original string, clean string")
    return renamed(n, names)


@book.on_view("A4_versions", "select version, count(*) as n, count(budget) as n_budget, round(sum(cost), 2) as cost from (select 'raw' as version, budget, cost from opp union all select 'won', null, cost from opp where status = 'won') group by 1")
def versions(df: DataFrame) -> DataFrame:
    a = df.select("code", "budget", "cost")
    both = aligned({"raw": a, "won": df.where("status = 'won'").select("code", "cost", "client")})
    return both.groupBy("version").agg(F.count("*").alias("n"), F.count("budget").alias("n_budget"), F.round(F.sum("cost"), 2).alias("cost"))


@book.on_view("A5_families", " union all ".join(f"select '{f}' as family, '{c}' as name, count({c}) as filled from opp" for f, cs in (("date", DATES), ("amount", AMOUNTS)) for c in cs))
def families(df: DataFrame) -> DataFrame:
    """Date and amount columns by type, and how many cells of each are filled: one scan."""
    require(df, ["code", "status"])
    kind = {"timestamp": "date", "timestamp_ntz": "date", "double": "amount"}
    cols = [(kind[t], c) for c, t in df.dtypes if t in kind]
    wide = df.agg(*(F.count(c).alias(c) for _, c in cols))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(c).alias("name"), F.col(c).alias("filled")) for f, c in cols))))


@book.on_tables("A7_external_series", """with m as (select date_trunc('month', o_orderdate)::date as p, case when month(o_orderdate) % 3 <> 0 then round(sum(o_totalprice), 2) end as y from orders group by 1, month(o_orderdate)),
  g as (select * from m where p between (select min(p) from m where y is not null) and (select max(p) from m where y is not null)), i as (select *, row_number() over (order by p) as i from g),
  n as (select *, last_value(case when y is not null then i end ignore nulls) over b as ia, last_value(y ignore nulls) over b as va, first_value(case when y is not null then i end ignore nulls) over a as ib, first_value(y ignore nulls) over a as vb
    from i window b as (order by p rows between unbounded preceding and current row), a as (order by p rows between current row and unbounded following))
  select strftime(p, '%Y-%m') as month, round(case when y is not null then y else va + (vb - va) * (i - ia) / (ib - ia) end, 1) as y from n""")
def external_orders(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").where(F.month("o_orderdate") % 3 != 0)
    m = o.groupBy(F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return external_series(spark, write_csv(m, scratch(spark)), "date", "value").select(F.date_format("p", "yyyy-MM").alias("month"), F.round("y", 1).alias("y"))
