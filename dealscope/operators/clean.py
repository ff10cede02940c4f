"""Cleaning (B): range checks, rare levels, imputation, keys, splits, winsorising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import any_flag, days, flag, quantile_row
from ..plans.roles import AMOUNTS, DATES, LEVELS, Book, read

book = Book()
LO, HI = "1993-01-01", "1998-06-30"


def outside(c: str, lo: str = LO, hi: str = HI) -> Column:
    return flag((F.col(c) < F.lit(lo).cast("timestamp")) | (F.col(c) > F.lit(hi).cast("timestamp")))


_OUT = {c: f"coalesce({c} < timestamp '{LO}' or {c} > timestamp '{HI}', false)" for c in DATES}


@book.on_view("B1_date_flags", "select code, " + ", ".join(f"{s} as flag_{c}" for c, s in _OUT.items()) + " from opp where " + " or ".join(_OUT.values()))
def date_flags(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or DATES
    return df.select("code", *(outside(c).alias(f"flag_{c}") for c in cols)).where(any_flag(*(F.col(f"flag_{c}") for c in cols)))


@book.on_view("B2_date_nulling", "select " + ", ".join(f"count(*) filter ({s}) as n_{c}" for c, s in _OUT.items()) + " from opp")
def nulled_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count(F.when(outside(c), 1)).alias(f"n_{c}") for c in DATES))


def null_dates(df: DataFrame, cols: list[str], lo: str = LO, hi: str = HI) -> DataFrame:
    return df.withColumns({c: F.when(~outside(c, lo, hi), F.col(c)) for c in cols})


@book.on_view("B3_date_review", f"select code, strftime(closing_at, '%Y-%m-%d') as value from opp where {_OUT['closing_at']} order by closing_at, code limit 5")
def date_review(df: DataFrame, col: str = "closing_at", n: int = 5) -> DataFrame:
    return df.where(outside(col)).orderBy(col, "code").limit(n).select("code", F.date_format(col, "yyyy-MM-dd").alias("value"))


def bucket_rare(df: DataFrame, col: str, share: float | None = None, count: int | None = None, other: str = "Autres", fit: DataFrame | None = None) -> DataFrame:
    """Levels below a share of the non-null rows, or below a count, become one level; levels are counted on ``fit``."""
    n = (df if fit is None else fit).where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    if share is not None:
        kept = n.crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_t")))).where(F.col("_n") >= share * F.col("_t"))
    else:
        kept = n.where(F.col("_n") >= count)
    out = df.join(kept.select(F.col(col).alias("_level")), F.col(col) == F.col("_level"), "left")
    missing = F.lit(other) if fit is not None else F.when(F.col(col).isNotNull(), other)
    return out.withColumn(col, F.coalesce("_level", missing)).drop("_level")


@book.on_view("B4_rare_share", "select case when count(*) over (partition by entity) >= 0.039 * count(*) over () then entity else 'Autres' end as entity, code from opp")
def rare_share(df: DataFrame) -> DataFrame:
    return bucket_rare(df, "entity", share=0.039).select("entity", "code")


@book.on_view("B5_rare_count", "select client, count(*) as n from (select case when count(*) over (partition by client) >= 15 then client else 'Autre' end as client from opp) group by 1")
def rare_count(df: DataFrame) -> DataFrame:
    return bucket_rare(df, "client", count=15, other="Autre").groupBy("client").agg(F.count("*").alias("n"))


@book.on_view("B6_rare_fitted", "with k as (select client from opp where registered_at < timestamp '1996-01-01' group by 1 having count(*) >= 12) select case when client in (select client from k) then client else 'Autre' end as client, count(*) as n from opp where registered_at >= timestamp '1996-01-01' group by 1")
def rare_fitted(df: DataFrame) -> DataFrame:
    train, test = df.where("registered_at < timestamp '1996-01-01'"), df.where("registered_at >= timestamp '1996-01-01'")
    return bucket_rare(test, "client", count=12, other="Autre", fit=train).groupBy("client").agg(F.count("*").alias("n"))


@book.on_view("B7_missing_rows", "select code from opp where budget is null")
def missing_rows(df: DataFrame, col: str = "budget") -> DataFrame:
    return df.where(F.col(col).isNull()).select("code")


@book.on_view("B8_amounts", "select code, case when cost >= 0 then cost end as cost, case when budget >= 0 then budget end as budget from opp")
def sane_amounts(df: DataFrame, cols=("cost", "budget")) -> DataFrame:
    return df.select("code", *(F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in cols))


@book.on_view("B9_dedup_key", "select client, code from (select client, code, row_number() over (partition by client order by registered_at, code) as r from opp) where r = 1")
def dedup_key(df: DataFrame, key: str = "client", order=("registered_at", "code")) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").select(key, "code")


@book.on_view("B10_exclude_flagged", "select code from opp where code not in (select o_orderkey from orders where o_orderkey % 5 = 0)")
def exclude_flagged(df: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    flagged = df.where("code % 5 = 0").select("code") if flagged is None else flagged
    return df.join(flagged, "code", "left_anti").select("code")


@book.on_view("B11_indicators", "select code, floor((epoch_us(real_end_at) - epoch_us(start_at)) / 86400000000)::bigint as duration, round(revenue / nullif(budget, 0), 6) as realisation, round(revenue - cost, 4) as margin from opp")
def indicators(df: DataFrame) -> DataFrame:
    return df.select("code", days("real_end_at", "start_at").cast("long").alias("duration"), F.round(F.try_divide("revenue", F.expr("nullif(budget, 0)")), 6).alias("realisation"), F.round(F.col("revenue") - F.col("cost"), 4).alias("margin"))


def impute(df: DataFrame, amounts: list[str], levels: list[str], text: str = "Non renseigné", narrow: bool = False) -> DataFrame:
    """Medians for amounts, a literal for text."""
    if not amounts:
        return df.withColumns({c: F.coalesce(c, F.lit(text)) for c in levels})
    med = quantile_row(df, {f"_{c}": (c, 0.5) for c in amounts}, narrow)
    out = df.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(c, f"_{c}") for c in amounts} | {c: F.coalesce(c, F.lit(text)) for c in levels})
    return out.drop(*(f"_{c}" for c in amounts))


@book.on_view("B12_imputed", "select code, round(coalesce(budget, (select quantile_cont(budget, 0.5) from opp)), 4) as budget from opp")
def imputed(df: DataFrame) -> DataFrame:
    return impute(df, ["budget"], ["entity"]).select("code", F.round("budget", 4).alias("budget"))


@book.on_view("B13_complete_rows", "select count(*) as n from opp where start_at is not null and closing_at is not null")
def complete_rows(df: DataFrame) -> DataFrame:
    return impute(df, AMOUNTS, ["entity"]).dropna(subset=["start_at", "closing_at"]).agg(F.count("*").alias("n"))


@book.on_view("B14_exclude_lost", "select status, count(*) as n from opp where not regexp_matches(status, '(?i)perdu|annul|aband|lost') group by 1")
def exclude_lost(df: DataFrame, pattern: str = "(?i)perdu|annul|aband|lost") -> DataFrame:
    return df.where(~flag(F.col("status").rlike(pattern))).groupBy("status").agg(F.count("*").alias("n"))


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; constant columns become 0."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    stats = df.sparkSession.createDataFrame([tuple(stats.first())], stats.schema)  # sums of doubles differ by the order of the rows: one value for all later jobs
    z = lambda c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0))
    return df.crossJoin(F.broadcast(stats)).withColumns({c: z(c) for c in cols}).drop(*(f"_{n}_{c}" for c in cols for n in "ms"))


@book.on_view("B15_zscores", "select code, round((revenue - avg(revenue) over ()) / stddev_pop(revenue) over (), 6) as revenue, round((cost - avg(cost) over ()) / stddev_pop(cost) over (), 6) as cost from opp")
def zscores(df: DataFrame) -> DataFrame:
    return standardise(df, ["revenue", "cost"]).select("code", *(F.round(c, 6).alias(c) for c in ("revenue", "cost")))


@book.on_view("B17_active_variables", " union all ".join(f"select '{c}' as variable, 'quantitative' as kind from opp having count(distinct {c}) > 1" for c in AMOUNTS) + " union all " + " union all ".join(f"select '{c}', 'qualitative' from opp having count(distinct {c}) > 1 and count(distinct {c}) <= 0.8 * count(*)" for c in (*LEVELS, "client")))
def active_variables(df: DataFrame) -> DataFrame:
    """One profile aggregate decides which columns stay: no ids, dates, constants, or near-unique texts."""
    kinds = {c: t for c, t in df.dtypes if c != "code" and not t.startswith("timestamp")}
    p = df.agg(F.count("*").alias("_n"), *(F.count_distinct(c).alias(c) for c in kinds)).first()
    keep = [(c, "quantitative" if t == "double" else "qualitative") for c, t in kinds.items() if p[c] > 1 and (t == "double" or p[c] <= 0.8 * p["_n"])]
    return df.sparkSession.createDataFrame(keep, "variable string, kind string")


@book.on_view("B18_business", "select code, round((revenue - cost) * 100 / nullif(revenue, 0), 4) as margin_pct, coalesce((revenue - cost) / nullif(revenue, 0) < 0.1, false) as low_margin, floor((epoch_us(real_end_at) - epoch_us(planned_end_at)) / 86400000000)::bigint as delay, coalesce(real_end_at <= planned_end_at, false) as on_time from opp")
def business(df: DataFrame) -> DataFrame:
    m = F.try_divide(F.col("revenue") - F.col("cost"), F.expr("nullif(revenue, 0)"))
    return df.select("code", F.round(F.try_divide((F.col("revenue") - F.col("cost")) * 100, F.expr("nullif(revenue, 0)")), 4).alias("margin_pct"), flag(m < 0.1).alias("low_margin"), days("real_end_at", "planned_end_at").cast("long").alias("delay"), flag(F.col("real_end_at") <= F.col("planned_end_at")).alias("on_time"))


@book.on_view("B19_cycle", "select code, floor((epoch_us(real_end_at) - epoch_us(registered_at)) / 86400000000)::bigint as cycle from opp where real_end_at is not null")
def cycle(df: DataFrame) -> DataFrame:
    return df.where("real_end_at is not null").select("code", days("real_end_at", "registered_at").cast("long").alias("cycle"))


_MED = "med as (select quantile_cont(floor((epoch_us(real_end_at) - epoch_us(start_at)) / 86400000000), 0.5) as d from opp where real_end_at is not null and start_at is not null)"


@book.on_view("B21_median_duration", f"with {_MED} select round(d, 4) as median_days from med")
def median_duration(df: DataFrame) -> DataFrame:
    d = df.where("real_end_at is not null and start_at is not null").select(days("real_end_at", "start_at").alias("d"))
    return quantile_row(d, {"m": ("d", 0.5)}).select(F.round("m", 4).alias("median_days"))


def copy_real_ends(df: DataFrame) -> DataFrame:
    return df.withColumn("closing_at", F.when((F.col("status") == "won") & F.col("real_end_at").isNotNull(), F.col("real_end_at")).otherwise(F.col("closing_at")))


@book.on_view("B20_copied_ends", "select count(*) filter (status = 'won' and real_end_at is not null) as copied, count(*) filter (status = 'won' and real_end_at is not null and closing_at is null) as filled from opp")
def copied_ends(df: DataFrame) -> DataFrame:
    hit = (F.col("status") == "won") & F.col("real_end_at").isNotNull()
    return df.agg(F.count(F.when(hit, 1)).alias("copied"), F.count(F.when(hit & F.col("closing_at").isNull(), 1)).alias("filled"))


@book.on_view("B22_imputed_closing", f"with {_MED} select code, strftime(start_at + to_seconds(d * 86400), '%Y-%m-%d %H:%M:%S') as closing_at from opp, med where closing_at is null and start_at is not null")
def imputed_closing(df: DataFrame) -> DataFrame:
    at = F.timestamp_seconds(F.unix_micros(F.col("start_at").cast("timestamp")) / 1_000_000 + F.col("median_days") * 86400)
    return df.where("closing_at is null and start_at is not null").crossJoin(F.broadcast(median_duration(df))).select("code", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("closing_at"))


@book.on_view("B24_won", "select code, strftime(closing_at, '%Y-%m-%d') as closing_at, revenue from opp where status = 'won' and closing_at is not null")
def won(df: DataFrame) -> DataFrame:
    return df.where("status = 'won' and closing_at is not null").select("code", F.date_format("closing_at", "yyyy-MM-dd").alias("closing_at"), "revenue")


@book.on_view("B25_flag_drops", "select count(*) filter (cost < 0) as n_cost, count(*) filter (not coalesce(cost < 0, false) and budget is null) as n_budget, count(*) filter (not coalesce(cost < 0, false) and budget is not null) as n_left from opp")
def flag_drops(df: DataFrame) -> DataFrame:
    a, b = flag(F.col("cost") < 0), F.col("budget").isNull()
    return df.agg(F.count(F.when(a, 1)).alias("n_cost"), F.count(F.when(~a & b, 1)).alias("n_budget"), F.count(F.when(~a & ~b, 1)).alias("n_left"))


@book.on_view("B26_correction_summary", "select count(*) as rows, count(*) filter (closing_at is null and start_at is not null) as imputed, count(*) filter (status = 'won') as won from opp")
def correction_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count(F.when(F.col("closing_at").isNull() & F.col("start_at").isNotNull(), 1)).alias("imputed"), F.count(F.when(F.col("status") == "won", 1)).alias("won"))


@book.on_view("B28_labels", "select code, (status = 'won')::int as is_won from opp where status in ('won', 'lost') and closing_at is not null")
def labels(df: DataFrame) -> DataFrame:
    return df.where("status in ('won', 'lost') and closing_at is not null").select("code", (F.col("status") == "won").cast("int").alias("is_won"))


_SPLIT = "case when registered_at < timestamp '1996-01-01' then 'train' when registered_at <= timestamp '1997-01-01' then 'val' else 'test' end"


@book.on_view("B29_split", f"select {_SPLIT} as split, count(*) as n from opp group by 1")
def split_sizes(df: DataFrame) -> DataFrame:
    return chronological_split(df, "registered_at", "1996-01-01", "1997-01-01").groupBy("split").agg(F.count("*").alias("n"))


def chronological_split(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    d = F.col(date)
    return df.withColumn("split", F.when(d < F.lit(start).cast("timestamp"), "train").when(d <= F.lit(end).cast("timestamp"), "val").otherwise("test"))


@book.on_view("B30_winsorised", "with q as (select quantile_cont(revenue, 0.01) as lo, quantile_cont(revenue, 0.99) as hi from opp where registered_at < timestamp '1996-01-01') select code, round(least(greatest(revenue, lo), hi), 4) as revenue from opp, q")
def winsorised(df: DataFrame, col: str = "revenue") -> DataFrame:
    q = quantile_row(df.where("registered_at < timestamp '1996-01-01'"), {"lo": (col, 0.01), "hi": (col, 0.99)})
    return df.crossJoin(F.broadcast(q)).select("code", F.round(F.least(F.greatest(col, "lo"), "hi"), 4).alias(col))


@book.on_view("B32_binary_columns", "select 'status_flag' as variable, 2::bigint as n_distinct, round(avg((status = 'won')::int), 6) as positive_share from opp")
def binary_columns(df: DataFrame) -> DataFrame:
    x = (F.col("status") == "won").cast("int")
    return df.agg(F.count_distinct(x).alias("n_distinct"), F.round(F.avg(x), 6).alias("positive_share")).select(F.lit("status_flag").alias("variable"), "n_distinct", "positive_share")


@book.on_view("B34_ordinal_encoding", "with l as (select category, dense_rank() over (order by category) - 1 as i from (select distinct category from opp where registered_at < timestamp '1993-01-01')) select code, coalesce(i, -1)::bigint as category from opp left join l using (category)")
def ordinal(df: DataFrame, col: str = "category") -> DataFrame:
    """Positions of the train levels in sorted order; unknown levels are -1."""
    levels = df.where("registered_at < timestamp '1993-01-01'").select(col).distinct().withColumn("i", F.dense_rank().over(Window.orderBy(col)) - 1)
    return df.join(levels, col, "left").select("code", F.coalesce("i", F.lit(-1)).cast("long").alias(col))


@book.on_view("B33_onehot_long", "select code, 'category=' || category as feature, 1.0::double as value from opp union all select code, 'cost', round((cost - avg(cost) over ()) / stddev_pop(cost) over (), 6) from opp")
def onehot_long(df: DataFrame) -> DataFrame:
    z = standardise(df, ["cost"])
    cells = F.array(F.struct(F.concat(F.lit("category="), "category").alias("feature"), F.lit(1.0).alias("value")), F.struct(F.lit("cost").alias("feature"), F.round("cost", 6).alias("value")))
    return z.select("code", F.explode(cells).alias("c")).select("code", "c.*")


@book.on_view("B2_nulled_dates", "select code, " + ", ".join(f"strftime(case when not {_OUT[c]} then {c} end, '%Y-%m-%d') as {c}" for c in DATES) + " from opp")
def nulled_dates(df: DataFrame) -> DataFrame:
    out = null_dates(df, DATES)
    return out.select("code", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in DATES))


@book.on_view("B3_review_stats", " union all ".join(f"select '{c}' as variable, count(*) as n, strftime(min({c}), '%Y-%m-%d') as lo, strftime(max({c}), '%Y-%m-%d') as hi, round(quantile_cont(epoch_us({c}) / 86400000000.0, 0.5), 4) as median_day from opp where {_OUT[c]}" for c in DATES))
def review_stats(df: DataFrame) -> DataFrame:
    """Out-of-range dates per column: how many, first, last, and the median as days since 1970."""
    days_of = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000
    out = df.select(*(F.when(outside(c), F.col(c)).alias(c) for c in DATES))
    med = quantile_row(out.select(*(days_of(c).alias(c) for c in DATES)), {c: (c, 0.5) for c in DATES})
    wide = out.agg(*(F.struct(F.count(c).alias("n"), F.date_format(F.min(c), "yyyy-MM-dd").alias("lo"), F.date_format(F.max(c), "yyyy-MM-dd").alias("hi")).alias(f"s_{c}") for c in DATES)).crossJoin(med)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"s_{c}.n").alias("n"), F.col(f"s_{c}.lo").alias("lo"), F.col(f"s_{c}.hi").alias("hi"), F.round(c, 4).alias("median_day")) for c in DATES))).alias("r")).select("r.*")


@book.on_view("B5_rare_off", "select client, count(*) as n from (select case when (select count(*) from opp) < 1000000000 or count(*) over (partition by client) >= 1000000000 then client else 'Autre' end as client from opp) group by 1")
def rare_off(df: DataFrame, count: int = 1_000_000_000) -> DataFrame:
    """Rare levels by count, left alone when the table has fewer rows than the threshold."""
    out = df if df.count() < count else bucket_rare(df, "client", count=count, other="Autre")
    return out.groupBy("client").agg(F.count("*").alias("n"))


@book.on_view("B13_complete", "select code from opp where start_at is not null and closing_at is not null")
def complete(df: DataFrame) -> DataFrame:
    return impute(df, AMOUNTS, ["entity"]).dropna(subset=["start_at", "closing_at"]).select("code")


@book.on_view("B14_excluded", "select code, 'status: ' || status as reason from opp where regexp_matches(status, '(?i)perdu|annul|aband|lost')")
def excluded(df: DataFrame, pattern: str = "(?i)perdu|annul|aband|lost") -> DataFrame:
    """What is left out, and why."""
    return df.where(flag(F.col("status").rlike(pattern))).select("code", F.concat(F.lit("status: "), "status").alias("reason"))


@book.on_view("B18_margins", "select code, round(revenue - cost, 4) as margin, round(revenue / nullif(budget, 0), 6) as budget_ratio from opp")
def margins(df: DataFrame) -> DataFrame:
    return df.select("code", F.round(F.col("revenue") - F.col("cost"), 4).alias("margin"), F.round(F.try_divide("revenue", F.expr("nullif(budget, 0)")), 6).alias("budget_ratio"))


@book.on_view("B20_copied_rows", "select code, strftime(case when status = 'won' and real_end_at is not null then real_end_at else closing_at end, '%Y-%m-%d') as closing_at from opp")
def copied_rows(df: DataFrame) -> DataFrame:
    return copy_real_ends(df).select("code", F.date_format("closing_at", "yyyy-MM-dd").alias("closing_at"))


def few_valued(df: DataFrame, most: int = 2, key: str | None = None) -> DataFrame:
    """(variable, n_distinct, lo, hi) of all columns with at most ``most`` distinct values but the key: one row per value first, then counts."""
    cols = [c for c in df.columns if c != key]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("v")) for c in cols)))
    return df.select(cells.alias("c")).select("c.*").where("v is not null").distinct().groupBy("variable").agg(F.count("*").alias("n_distinct"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("n_distinct") <= most)


@book.on_tables("B32_discovered", " union all ".join(f"select '{c}' as variable, count(distinct {c}) as n_distinct, min({c}::varchar) as lo, max({c}::varchar) as hi from labels having count(distinct {c}) between 1 and 2" for c in ("quality", "toxic")))
def discovered(spark, sf_dir) -> DataFrame:
    """Binary targets of the label table, found by their values."""
    return few_valued(read(spark, sf_dir, "labels"), key="doc_id")


class Encoder:
    """Z-scores of numbers and one-hot levels, fitted on one table and applied to others: unseen levels are all 0, missing numbers 0."""

    def __init__(self, amounts: list[str], levels: list[str]) -> None:
        self.amounts, self.levels = amounts, levels

    def fit(self, df: DataFrame) -> "Encoder":
        s = df.agg(*(f(c).alias(f"{n}_{c}") for c in self.amounts for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        self.scale = {c: (s[f"m_{c}"] or 0.0, s[f"s_{c}"] or 0.0) for c in self.amounts}
        rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in self.levels))).alias("x")).select("x.*").where("v is not null").distinct().collect()  # one row per level
        self.known = sorted((r["c"], r["v"]) for r in rows)
        return self

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        z = [F.coalesce((F.col(c) - m) / s if s else F.lit(0.0), F.lit(0.0)).alias(c) for c, (m, s) in self.scale.items()]
        return df.select(*keep, *z, *(flag(F.col(c) == v).cast("double").alias(f"{c}={v}") for c, v in self.known))


_TRAIN = "registered_at < timestamp '1996-01-01'"


@book.on_view("B33_encoded", f"with t as (select * from opp where {_TRAIN}), r as (select * from opp where not {_TRAIN}) select code, " + ", ".join(f"round(coalesce(({c} - (select avg({c}) from t)) / (select stddev_pop({c}) from t), 0), 5) as {c}" for c in ("revenue", "budget")) + ", category || case when category in (select category from t) then '' else '?' end as category from r")
def encoded(df: DataFrame) -> DataFrame:
    """Fitted on the older rows, applied to the newer ones; the indicators read back as the level."""
    e = Encoder(["revenue", "budget"], ["category"]).fit(df.where(_TRAIN))
    out = e.transform(df.where(f"not {_TRAIN}"), "code")
    level = F.coalesce(*(F.when(F.col(f"`category={v}`") == 1, F.lit(v)) for _, v in e.known), F.lit("?"))
    return out.select("code", *(F.round(c, 5).alias(c) for c in ("revenue", "budget")), level.alias("category"))
