"""Whole preparation jobs (B16, B23, B27, B31, I4, I5): chains of the single operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import days, flag, quantile_row
from ..plans.roles import AMOUNTS, DATES, Book
from .clean import HI, LO, bucket_rare, chronological_split, copy_real_ends, impute, median_duration, null_dates, outside, standardise
from .kpi import _CAL, period_sums
from .vectors import cut

book = Book()
_OUTSQL = {c: f"case when {c} >= timestamp '{LO}' and {c} <= timestamp '{HI}' then {c} end as {c}" for c in DATES}
_LOST = "(?i)perdu|annul|aband|lost"


def prepare(df: DataFrame, flagged: DataFrame | None = None, exclude_lost: bool = True, key: str = "code") -> DataFrame:
    """Dates out of range to null, negative amounts to null, one row per key, flagged keys out, indicators, medians and a literal for what is missing, lost deals out, z-scores."""
    out = null_dates(df, DATES).withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in AMOUNTS})
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("registered_at"))).where("_r = 1").drop("_r")
    if flagged is not None:
        out = out.join(flagged.select(key), key, "left_anti")
    out = out.withColumns({"duration": days("real_end_at", "start_at").cast("double"), "realisation": F.try_divide("revenue", F.expr("nullif(budget, 0)"))})
    out = impute(out, [*AMOUNTS, "duration", "realisation"], ["entity", "opp_type", "category", "status"])
    if exclude_lost:
        out = out.where(~flag(F.col("status").rlike(_LOST)))
    return standardise(out, [*AMOUNTS, "duration", "realisation"])


_NUM = [*AMOUNTS, "duration", "realisation"]


@book.on_view("B16_prepared", f"""with a as (select code, entity, opp_type, category, status, {", ".join(_OUTSQL.values())}, {", ".join(f"case when {c} >= 0 then {c} end as {c}" for c in AMOUNTS)} from opp where code % 5 <> 0),
  b as (select *, floor((epoch_us(real_end_at) - epoch_us(start_at)) / 86400000000)::double as duration, revenue / nullif(budget, 0) as realisation from a),
  c as (select code, coalesce(entity, 'Non renseigné') as entity, status, {", ".join(f"coalesce({c}, (select quantile_cont({c}, 0.5) from b)) as {c}" for c in _NUM)} from b), d as (select * from c where not regexp_matches(status, '{_LOST}'))
  select code, entity, {", ".join(f"round(({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0), 4) as {c}" for c in _NUM)} from d""")
def prepared(df: DataFrame) -> DataFrame:
    return prepare(df, df.where("code % 5 = 0").select("code")).select("code", "entity", *(F.round(c, 4).alias(c) for c in _NUM))


def repaired(df: DataFrame, flags: dict) -> DataFrame:
    """Flagged rows out, the real end copied into the closing date of won deals, the rest imputed by the median duration, won deals with a date kept."""
    for cond in flags.values():
        df = df.where(~flag(F.expr(cond)))
    df = copy_real_ends(df)
    at = F.timestamp_seconds(F.unix_micros(F.col("start_at").cast("timestamp")) / 1_000_000 + F.col("median_days") * 86400)
    df = df.crossJoin(F.broadcast(median_duration(df))).withColumn("closing_at", F.coalesce("closing_at", F.when(F.col("start_at").isNotNull(), at).cast(dict(df.dtypes)["closing_at"])))
    return df.where("status = 'won' and closing_at is not null")


_BAD = {"negative cost": "cost < 0", "no budget": "budget is null"}
_REPAIR = """a as (select * from opp where not coalesce(cost < 0, false) and budget is not null), c as (select * replace (case when status = 'won' and real_end_at is not null then real_end_at else closing_at end as closing_at) from a),
  med as (select quantile_cont(floor((epoch_us(real_end_at) - epoch_us(start_at)) / 86400000000), 0.5) as d from c where real_end_at is not null and start_at is not null),
  w as (select * replace (coalesce(closing_at, start_at + to_seconds(d * 86400)) as closing_at) from c, med where status = 'won' and coalesce(closing_at, start_at) is not null)"""


@book.on_view("B27_repaired_revenue", f"with {_REPAIR}, {_CAL} select granularity, strftime(period_end, '%Y-%m-%d') as period_end, round(coalesce(sum(revenue), 0), 3) as revenue from cal left join e using (granularity, period_end) group by 1, 2")
def repaired_revenue(df: DataFrame) -> DataFrame:
    out = period_sums(repaired(df, _BAD), "closing_at", {"revenue": F.sum("revenue")})
    return out.select("granularity", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), F.round("revenue", 3).alias("revenue"))


@book.on_view("B27_corrections", f"with {_REPAIR} select (select count(*) from opp) as rows, (select count(*) from opp where coalesce(cost < 0, false)) as dropped_cost, (select count(*) from opp where not coalesce(cost < 0, false) and budget is null) as dropped_budget, (select count(*) from a where status = 'won' and real_end_at is not null) as copied, (select count(*) from c where closing_at is null and start_at is not null) as imputed, (select count(*) from w) as kept")
def corrections(df: DataFrame) -> DataFrame:
    """The counters of the repair in one pass over its flags."""
    bad, late = flag(F.col("cost") < 0), F.col("budget").isNull()
    left = ~bad & ~late
    done = left & (F.col("status") == "won") & F.col("real_end_at").isNotNull()
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    empty = left & F.col("closing_at").isNull() & ~done
    return df.agg(F.count("*").alias("rows"), n(bad, "dropped_cost"), n(~bad & late, "dropped_budget"), n(done, "copied"), n(empty & F.col("start_at").isNotNull(), "imputed"), n(left & (F.col("status") == "won") & F.coalesce(F.col("real_end_at"), F.col("closing_at"), F.col("start_at")).isNotNull(), "kept"))


def predicted_durations(df: DataFrame, features: list[str], trees: int = 30, seed: int = 7) -> DataFrame:
    """Rows without a closing date get the start date plus the duration that a random forest predicts; no feature column raises."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    features = [c for c in features if c in df.columns]
    if not features:
        raise ValueError("none of the feature columns is there")
    ready = VectorAssembler(inputCols=features, outputCol="_v").transform(impute(df, features, []))
    known = ready.where("real_end_at is not null and start_at is not null").withColumn("_d", days("real_end_at", "start_at").cast("double"))
    model = RandomForestRegressor(featuresCol="_v", labelCol="_d", predictionCol="_p", numTrees=trees, seed=seed).fit(known)
    at = F.timestamp_seconds(F.unix_micros(F.col("start_at").cast("timestamp")) / 1_000_000 + F.round("_p") * 86400)
    out = model.transform(ready.where("closing_at is null and start_at is not null"))
    return out.withColumns({"closing_at": at, "predicted_days": F.col("_p")}).drop("_v", "_p")


@book.on_view("B23_predicted_closing")
def predicted_closing(df: DataFrame) -> DataFrame:
    return predicted_durations(df, ["revenue", "budget", "cost"]).select("code", F.date_format("closing_at", "yyyy-MM-dd").alias("closing_at"), F.round("predicted_days", 4).alias("predicted_days"))


LEAKS = ["status", "real_end_at", "revenue_updated"]


def feature_list(df: DataFrame, wanted: list[str], leaks: list[str] = LEAKS) -> list[str]:
    """Blank names out, missing columns raise, leakage columns out, each name once."""
    names = list(dict.fromkeys(c.strip() for c in wanted if c and c.strip()))
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return [c for c in names if c not in leaks]


@book.on_view("B31_feature_list", "select variable, n from (select 'revenue' as variable, count(revenue) as n from opp union all select 'budget', count(budget) from opp union all select 'category', count(category) from opp)")
def feature_counts(df: DataFrame) -> DataFrame:
    """The features that are left, with their non-null counts."""
    keep = feature_list(df, ["revenue", " budget ", "", "status", "category", "revenue", "real_end_at"])
    wide = df.agg(*(F.count(c).alias(c) for c in keep))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in keep))).alias("r")).select("r.*")


TRAIN_END, VAL_END = "1996-01-01", "1997-01-01"
_LEAD = f"""l as (select *, (status = 'won')::int as is_won, case when registered_at < timestamp '{TRAIN_END}' then 'train' when registered_at <= timestamp '{VAL_END}' then 'val' else 'test' end as split from opp where status in ('won', 'lost') and closing_at is not null)"""


def labelled(df: DataFrame) -> DataFrame:
    """Won and lost deals with a date, is_won (an existing one is accepted) and their chronological split; an empty split raises nothing here, see ``checked``."""
    if "is_won" not in df.columns:
        df = df.where("status in ('won', 'lost')").withColumn("is_won", (F.col("status") == "won").cast("int"))
    return chronological_split(df.where("closing_at is not null and is_won is not null"), "registered_at", TRAIN_END, VAL_END)


def checked(splits: DataFrame) -> DataFrame:
    """Raises if one of the three splits is empty."""
    found = {r["split"] for r in splits.select("split").distinct().collect()}  # three values at most
    if gone := {"train", "val", "test"} - found:
        raise ValueError(f"empty splits: {sorted(gone)}")
    return splits


def lead_features(splits: DataFrame, amounts=("revenue", "budget", "cost"), levels=("entity", "category", "opp_type"), rare: int = 5) -> DataFrame:
    """Calendar features, rare levels bucketed, ordinal levels and z-scores, all fitted on the train split: medians for what is missing, -1 for levels that train lacks."""
    out = splits.withColumns({"month": F.coalesce(F.month("closing_at"), F.lit(0)), "year": F.coalesce(F.year("closing_at"), F.lit(0)), "duration": F.coalesce(days("planned_end_at", "start_at"), F.lit(0)).cast("double")})
    for c in levels:
        out = bucket_rare(out, c, count=rare, other="Autre", fit=out.where("split = 'train'"))
    train = out.where("split = 'train'")
    stats = quantile_row(train, {f"_q_{c}": (c, 0.5) for c in amounts})
    full = out.crossJoin(F.broadcast(stats)).withColumns({c: F.coalesce(c, f"_q_{c}") for c in amounts})
    spread = full.where("split = 'train'").agg(*(f(c).alias(f"_{n}_{c}") for c in amounts for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    full = full.crossJoin(F.broadcast(spread)).withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in amounts})
    for c in levels:
        places = full.where("split = 'train'").select(c).distinct().withColumn("_i", F.dense_rank().over(Window.orderBy(c)) - 1)  # one row per level
        full = full.join(places, c, "left").withColumn(c, F.coalesce("_i", F.lit(-1)).cast("long")).drop("_i")
    return full.select("code", "split", "is_won", "month", "year", "duration", *amounts, *levels)


def _lead_sql(amounts=("revenue", "budget", "cost"), levels=("entity", "category", "opp_type"), rare: int = 5) -> str:
    kept = ", ".join(f"k_{c} as (select {c} as v from l where split = 'train' and {c} is not null group by 1 having count(*) >= {rare})" for c in levels)
    named = ", ".join(f"case when {c} in (select v from k_{c}) then {c} else 'Autre' end as {c}" for c in levels)
    place = ", ".join(f"o_{c} as (select v, dense_rank() over (order by v) - 1 as i from (select distinct {c} as v from b where split = 'train'))" for c in levels)
    filled = ", ".join(f"coalesce({c}, (select quantile_cont({c}, 0.5) from b where split = 'train')) as {c}" for c in amounts)
    z = ", ".join(f"round(coalesce(({c} - (select avg({c}) from f where split = 'train')) / nullif((select stddev_pop({c}) from f where split = 'train'), 0), 0), 5) as {c}" for c in amounts)
    i = ", ".join(f"coalesce((select i from o_{c} where v = {c}), -1)::bigint as {c}" for c in levels)
    return f"""with {_LEAD}, {kept}, b as (select code, split, is_won, closing_at, start_at, planned_end_at, {", ".join(amounts)}, {named} from l), {place},
  f as (select * replace ({filled.replace(' as ', ' as ')}) from b)
  select code, split, is_won, coalesce(month(closing_at), 0)::int as month, coalesce(year(closing_at), 0)::int as year, coalesce(floor((epoch_us(planned_end_at) - epoch_us(start_at)) / 86400000000), 0)::double as duration, {z}, {i} from f"""


@book.on_view("I4_lead_features", _lead_sql())
def lead_table(df: DataFrame) -> DataFrame:
    out = lead_features(labelled(df))
    return out.select(*(F.round(c, 5).alias(c) if c in ("revenue", "budget", "cost") else F.col(c) for c in out.columns))


def winsorised_splits(splits: DataFrame, cols: list[str]) -> DataFrame:
    """Amounts cut at the 1 % and 99 % quantiles of the train split."""
    q = quantile_row(splits.where("split = 'train'"), {f"_{n}_{c}": (c, v) for c in cols for n, v in (("lo", 0.01), ("hi", 0.99))})
    return splits.crossJoin(F.broadcast(q)).withColumns({c: F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}")) for c in cols}).drop(*(f"_{n}_{c}" for c in cols for n in ("lo", "hi")))


def preprocess(df: DataFrame, out: str | None = None) -> dict[str, DataFrame]:
    """The lead-scoring job: dates nulled, labels, splits, winsorised amounts, features, conversion series; ``out`` persists the nine tables as parquet."""
    splits = checked(labelled(null_dates(df, ["start_at", "planned_end_at"])))
    full = cut(lead_features(winsorised_splits(splits, ["revenue", "budget", "cost"])))
    series = period_sums(df.where("status in ('won', 'lost')"), "closing_at", {"won": F.count(F.when(F.col("status") == "won", 1)), "closed": F.count("*")}).where("granularity = 'month'")
    series = cut(series.select("period_end", "won", "closed", F.coalesce(F.try_divide("won", "closed"), F.lit(0.0)).alias("conv_rate")))
    tables = {}
    for s in ("train", "val", "test"):
        part = full.where(F.col("split") == s)
        tables |= {f"x_{s}": part.drop("is_won", "split"), f"y_{s}": part.select("code", "is_won")}
    tables |= {"conv_train": series.where(F.col("period_end") < F.lit(TRAIN_END)), "conv_val": series.where((F.col("period_end") >= F.lit(TRAIN_END)) & (F.col("period_end") < F.lit(VAL_END))), "conv_test": series.where(F.col("period_end") >= F.lit(VAL_END))}
    if out:
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(f"{out}/{name}")
    return tables


@book.on_view("I5_preprocessed", f"""with {_LEAD} select 'x_' || split as name, count(*) as n, sum(is_won)::bigint as won from l group by 1, split union all
  select 'conv_' || case when d < date '{TRAIN_END}' then 'train' when d < date '{VAL_END}' then 'val' else 'test' end, count(*), sum(w)::bigint from (
    select last_day(p::date) as d, coalesce((select count(*) from opp where status = 'won' and closing_at is not null and last_day(closing_at::date) = last_day(p::date)), 0) as w
    from (select min(closing_at) as lo, max(closing_at) as hi from opp where status in ('won', 'lost')), unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month)) t(p)) group by 1""")
def preprocessed(df: DataFrame) -> DataFrame:
    """Rows and won deals of the feature and series tables."""
    t = preprocess(df)
    rows = [t[f"x_{s}"].join(t[f"y_{s}"], "code").agg(F.count("*").alias("n"), F.sum("is_won").alias("won")).select(F.lit(f"x_{s}").alias("name"), "n", F.col("won").cast("long").alias("won")) for s in ("train", "val", "test")]
    rows += [t[f"conv_{s}"].agg(F.count("*").alias("n"), F.sum("won").alias("won")).select(F.lit(f"conv_{s}").alias("name"), "n", F.col("won").cast("long").alias("won")) for s in ("train", "val", "test")]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@book.on_view("D27_before_repaired", f"with {_REPAIR}, x as (select last_day(closing_at::date) as m, sum(revenue) as before from opp where status = 'won' and closing_at is not null group by 1), y as (select last_day(closing_at::date) as m, sum(revenue) as after from w group by 1) select strftime(m, '%Y-%m-%d') as period_end, round(before, 2) as before, round(after, 2) as after from x full join y using (m)")
def before_repaired(df: DataFrame) -> DataFrame:
    """Monthly revenue by the dates as they are and by the repaired ones."""
    by = lambda d, name: d.groupBy(F.last_day(F.to_date("closing_at")).alias("m")).agg(F.sum("revenue").alias(name))
    both = by(df.where("status = 'won' and closing_at is not null"), "before").join(by(repaired(df, _BAD), "after"), "m", "full")
    return both.select(F.date_format("m", "yyyy-MM-dd").alias("period_end"), F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))
