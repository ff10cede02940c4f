"""Series (F): regular grids, interpolation, lags, exogenous alignment, sequences, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import period_end, quantile
from ..plans.roles import Book

book = Book()
#: monthly revenue per type, where every third value is taken as missing
_M = "m as (select opp_type as s, strftime(last_day(closing_at::date), '%Y-%m-%d') as p, case when month(last_day(closing_at::date)) % 3 <> 0 then round(sum(revenue), 4) end as y, month(last_day(closing_at::date)) as mon from opp where closing_at is not null group by 1, last_day(closing_at::date))"


def monthly(df: DataFrame) -> DataFrame:
    m = period_end("closing_at", "month")
    out = df.where("closing_at is not null").groupBy(F.col("opp_type").alias("s"), m.alias("d")).agg(F.round(F.sum("revenue"), 4).alias("y"))
    return out.select("s", F.date_format("d", "yyyy-MM-dd").alias("p"), F.when(F.month("d") % 3 != 0, F.col("y")).alias("y"), F.month("d").alias("mon"))


def interpolate(df: DataFrame, key: str = "s", order: str = "p", value: str = "y") -> DataFrame:
    """Linear by row position; leading gaps 0, trailing gaps keep the last value."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    r = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).alias("v")))
    r = r.withColumn("_a", F.last(at, True).over(back)).withColumn("_b", F.first(at, True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), 0.0).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)
    return r.withColumn(value, filled).drop("_i", "_a", "_b")


_I = f"""{_M}, i as (select *, row_number() over (partition by s order by p) as i from m),
  n as (select *, last_value(case when y is not null then i end ignore nulls) over b as ia, last_value(y ignore nulls) over b as va, first_value(case when y is not null then i end ignore nulls) over a as ib, first_value(y ignore nulls) over a as vb
    from i window b as (partition by s order by p rows between unbounded preceding and current row), a as (partition by s order by p rows between current row and unbounded following)),
  f as (select s, p, mon, case when y is not null then y when ia is null then 0 when ib is null then va else va + (vb - va) * (i - ia) / (ib - ia) end as y from n)"""


@book.on_view("F1_interpolated", f"with {_I} select s, p, round(y, 6) as y from f")
def interpolated(df: DataFrame) -> DataFrame:
    return interpolate(monthly(df)).select("s", "p", F.round("y", 6).alias("y"))


def cap(df: DataFrame, key: str = "s", value: str = "y", k: float = 1.5) -> DataFrame:
    q = df.groupBy(key).agg(quantile(value, 0.25).alias("_1"), quantile(value, 0.75).alias("_3"))
    lo, hi = F.col("_1") - k * (F.col("_3") - F.col("_1")), F.col("_3") + k * (F.col("_3") - F.col("_1"))
    return df.join(F.broadcast(q), key).withColumn(value, F.least(F.greatest(F.col(value), lo), hi)).drop("_1", "_3")


@book.on_view("F2_capped", f"with {_I}, q as (select s, quantile_cont(y, 0.25) as a, quantile_cont(y, 0.75) as b from f group by 1) select s, p, round(least(greatest(y, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 5) as y from f join q using (s)")
def capped(df: DataFrame) -> DataFrame:
    return cap(interpolate(monthly(df)), k=0.5).select("s", "p", F.round("y", 5).alias("y"))


@book.on_view("F3_summary", f"with {_I} select m.s, count(*) - count(m.y) as missing, round(avg(m.y), 3) as mean_before, round(stddev_samp(m.y), 3) as std_before, round(avg(f.y), 3) as mean_after, round(stddev_samp(f.y), 3) as std_after from m join f using (s, p) group by 1")
def summary(df: DataFrame) -> DataFrame:
    before = monthly(df)
    both = before.join(interpolate(before).select("s", "p", F.col("y").alias("z")), ["s", "p"])
    return both.groupBy("s").agg((F.count("*") - F.count("y")).alias("missing"), *(F.round(f(c), 3).alias(f"{n}_{t}") for c, t in (("y", "before"), ("z", "after")) for n, f in (("mean", F.avg), ("std", F.stddev))))


def lag_features(df: DataFrame, k: int, key: str = "s", order: str = "p", value: str = "y") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.select("*", *(F.lag(value, i).over(w).alias(f"lag{i}") for i in range(1, k + 1))).dropna(subset=[f"lag{k}"])


@book.on_view("F4_lags", f"with {_I}, l as (select s, p, mon, round(y, 6) as y, " + ", ".join(f"round(lag(y, {i}) over (partition by s order by p), 6) as lag{i}" for i in range(1, 5)) + " from f) select s, p, mon::int as month, y, lag1, lag2, lag3, lag4 from l where lag4 is not null")
def lags(df: DataFrame) -> DataFrame:
    out = lag_features(interpolate(monthly(df)), 4)
    return out.select("s", "p", F.col("mon").cast("int").alias("month"), *(F.round(c, 6).alias(c) for c in ("y", "lag1", "lag2", "lag3", "lag4")))


@book.on_view("F5_exogenous", f"with {_M}, x as (select s, p, first_value(y ignore nulls) over (partition by s order by p rows between current row and unbounded following) as b, last_value(y ignore nulls) over (partition by s order by p rows between unbounded preceding and current row) as a, mon from m) select s, p, mon::int as mon, round(coalesce(b, a), 4) as exog from x")
def exogenous(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("s").orderBy("p")
    b = F.first("y", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    a = F.last("y", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return monthly(df).select("s", "p", F.col("mon").cast("int").alias("mon"), F.round(F.coalesce(b, a), 4).alias("exog"))


@book.on_view("F6_sequences", f"with {_I}, w as (select s, p, y, list(y) over (partition by s order by p rows between 6 preceding and 1 preceding) as x from f) select s, p, round(y, 6) as y, round(list_sum(x), 6) as window_sum, round(x[1], 6) as oldest from w where len(x) = 6")
def sequences(df: DataFrame, width: int = 6) -> DataFrame:
    w = Window.partitionBy("s").orderBy("p").rowsBetween(-width, -1)
    out = interpolate(monthly(df)).withColumn("x", F.collect_list("y").over(w)).where(F.size("x") == width)
    return out.select("s", "p", F.round("y", 6).alias("y"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("window_sum"), F.round(F.col("x")[0], 6).alias("oldest"))


@book.on_view("F8_folds", f"with {_M}, r as (select s, p, row_number() over (partition by s order by p) as i, count(*) over (partition by s) as n from m), k as (select unnest(range(1, 6)) as fold) select s, fold::int as fold, min(p) as test_from, max(p) as test_to, count(*) as n_test from r, k where i > n - (6 - fold) * (n // 6) and i <= n - (5 - fold) * (n // 6) group by 1, 2")
def folds(df: DataFrame, splits: int = 5) -> DataFrame:
    w = Window.partitionBy("s")
    r = monthly(df).select("s", "p", F.row_number().over(w.orderBy("p")).alias("i"), F.count("*").over(w).alias("n")).select("*", F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("fold"))
    size = F.floor(F.col("n") / (splits + 1))
    inside = r.where((F.col("i") > F.col("n") - (splits + 1 - F.col("fold")) * size) & (F.col("i") <= F.col("n") - (splits - F.col("fold")) * size))
    return inside.groupBy("s", "fold").agg(F.min("p").alias("test_from"), F.max("p").alias("test_to"), F.count("*").alias("n_test"))


@book.on_view("F12_asof", f"with {_M} select s, p, round(last_value(y ignore nulls) over (partition by s order by p rows between unbounded preceding and current row), 4) as pred from m")
def asof(df: DataFrame) -> DataFrame:
    return monthly(df).select("s", "p", F.round(F.last("y", True).over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)), 4).alias("pred"))


_QUARTERS = """m as (select opp_type as s, last_day((date_trunc('quarter', closing_at) + interval 2 month)::date) as p, sum(revenue) as y from opp where closing_at is not null group by 1, 2)"""


@book.on_view("F4_lags_quarter", f"with {_QUARTERS}, l as (select s, p, y, " + ", ".join(f"lag(y, {i}) over (partition by s order by p) as lag{i}" for i in (1, 2)) + " from m) select s, strftime(p, '%Y-%m-%d') as p, quarter(p)::int as quarter, round(y, 4) as y, round(lag1, 4) as lag1, round(lag2, 4) as lag2 from l where lag2 is not null")
def lags_quarter(df: DataFrame) -> DataFrame:
    m = df.where("closing_at is not null").groupBy(F.col("opp_type").alias("s"), period_end("closing_at", "quarter").alias("p")).agg(F.sum("revenue").alias("y"))
    return lag_features(m, 2).select("s", F.date_format("p", "yyyy-MM-dd").alias("p"), F.quarter("p").alias("quarter"), *(F.round(c, 4).alias(c) for c in ("y", "lag1", "lag2")))


@book.on_view("F4_lags_year", "with m as (select opp_type as s, year(closing_at)::int as year, sum(revenue) as y from opp where closing_at is not null group by 1, 2), l as (select *, lag(y) over (partition by s order by year) as lag1 from m) select s, year, round(y, 4) as y, round(lag1, 4) as lag1 from l where lag1 is not null")
def lags_year(df: DataFrame) -> DataFrame:
    m = df.where("closing_at is not null").groupBy(F.col("opp_type").alias("s"), F.year("closing_at").alias("year")).agg(F.sum("revenue").alias("y"))
    return lag_features(m, 1, order="year").select("s", "year", *(F.round(c, 4).alias(c) for c in ("y", "lag1")))


@book.on_view("F5_with_target", f"with {_I}, t as (select s, p, count(*) as n from (select opp_type as s, strftime(last_day(closing_at::date), '%Y-%m-%d') as p from opp where closing_at is not null) group by 1, 2) select s, p, n as target, round(y, 5) as exog from t join f using (s, p)")
def with_target(df: DataFrame) -> DataFrame:
    """Monthly counts as the target, with the interpolated revenue of the same periods beside them."""
    target = df.where("closing_at is not null").groupBy(F.col("opp_type").alias("s"), F.date_format(period_end("closing_at", "month"), "yyyy-MM-dd").alias("p")).agg(F.count("*").alias("target"))
    return target.join(interpolate(monthly(df)).select("s", "p", F.round("y", 5).alias("exog")), ["s", "p"])


@book.on_view("F6_scaled_sequences", f"with {_I}, z as (select s, p, coalesce((y - min(y) over (partition by s)) / nullif(max(y) over (partition by s) - min(y) over (partition by s), 0), 0) as y from f), w as (select s, p, y, list(round(y, 4)) over (partition by s order by p rows between 6 preceding and 1 preceding) as x from z) select s, p, round(y, 4) as label, list_sum(list_transform(x, lambda v, i: round(v * i, 4))) as weighted, len(x) as width from w where len(x) = 6")
def scaled_sequences(df: DataFrame, width: int = 6) -> DataFrame:
    """Min-max scaled windows with the next value as label; the window is shown by its length and position-weighted sum."""
    out = windows(df, width)
    weighted = F.aggregate(F.transform("x", lambda v, i: F.round(v * (i + 1), 4)), F.lit(0.0), lambda a, v: a + v)
    return out.select("s", "p", F.round("label", 4).alias("label"), weighted.alias("weighted"), F.size("x").cast("long").alias("width"))


def windows(df: DataFrame, width: int = 6) -> DataFrame:
    """(s, p, x, label): arrays of the scaled values before each point."""
    own = Window.partitionBy("s")
    z = interpolate(monthly(df)).withColumn("y", F.coalesce(F.try_divide(F.col("y") - F.min("y").over(own), F.max("y").over(own) - F.min("y").over(own)), F.lit(0.0)))
    w = own.orderBy("p").rowsBetween(-width, -1)
    return z.select("s", "p", F.col("y").alias("label"), F.collect_list(F.round("y", 4)).over(w).alias("x")).where(F.size("x") == width)
