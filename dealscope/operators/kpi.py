"""Business aggregations (D): KPIs, pivots, top lists, shares, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import any_flag, cut, days, flag, period_end, quantile_row, quarter, rounded
from ..plans.roles import STATUSES, Book

book = Book()
GRANULARITIES = ["month", "quarter", "year"]


def top(df: DataFrame, by: list[str], n: int, *ties: str) -> DataFrame:
    """First n rows, descending, ties broken by key."""
    return df.orderBy(*(F.desc(c) for c in by), *ties).limit(n)


def share(df: DataFrame, value: str, alias: str = "share") -> DataFrame:
    """Percent of the total of all rows (the total is one row, joined by broadcast)."""
    total = df.agg(F.sum(value).alias("_t"))
    return df.crossJoin(F.broadcast(total)).withColumn(alias, F.round(F.col(value) * 100 / F.expr("nullif(_t, 0)"), 4)).drop("_t")


@book.on_view("D1_global_kpis", """select count(*) as total, count(*) filter (status = 'won') as won, count(*) filter (status = 'lost') as lost, count(*) filter (status = 'in_progress') as in_progress,
  round(count(*) filter (status = 'won') * 100.0 / count(*), 4) as conversion_pct, round(sum(revenue), 2) as revenue, round(avg(revenue) filter (revenue > 0), 4) as mean_positive,
  round(avg(floor((epoch_us(real_end_at) - epoch_us(registered_at)) / 86400000000)), 4) as mean_days from opp""")
def global_kpis(df: DataFrame) -> DataFrame:
    n = {s: F.count(F.when(F.col("status") == s, 1)) for s in STATUSES}
    return df.agg(F.count("*").alias("total"), *(v.alias(k) for k, v in n.items()), F.round(n["won"] * 100.0 / F.count("*"), 4).alias("conversion_pct"), F.round(F.sum("revenue"), 2).alias("revenue"), F.round(F.avg(F.when(F.col("revenue") > 0, F.col("revenue"))), 4).alias("mean_positive"), F.round(F.avg(days("real_end_at", "registered_at")), 4).alias("mean_days"))


_Q = "coalesce(year({c}) || 'Q' || quarter({c}), 'NaT')"


@book.on_view("D2_quarterly", f"select {_Q.format(c='closing_at')} as quarter, count(*) as n, round(sum(revenue), 2) as revenue from opp group by 1")
def quarterly(df: DataFrame) -> DataFrame:
    return df.groupBy(quarter("closing_at").alias("quarter")).agg(F.count("*").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"))


@book.on_view("D2_reconciliation", f"with q as (select {_Q.format(c='closing_at')} as quarter, count(*) as n from opp group by 1) select (select count(*) from opp) as n, sum(n)::bigint as n_by_quarter, (select count(*) from opp) = sum(n) as reconciled from q")
def reconciliation(df: DataFrame) -> DataFrame:
    by = quarterly(df).agg(F.sum("n").alias("n_by_quarter"))
    return df.agg(F.count("*").alias("n")).crossJoin(by).withColumn("reconciled", F.col("n") == F.col("n_by_quarter"))


@book.on_view("D3_quarter_status", f"select {_Q.format(c='closing_at')} as quarter, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in STATUSES) + " from opp group by 1")
def quarter_status(df: DataFrame) -> DataFrame:
    return df.groupBy(quarter("closing_at").alias("quarter")).pivot("status", STATUSES).count().fillna(0)


def quarter_by_top(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """Quarter x level revenue of the n levels with most revenue, long form."""
    best = top(df.groupBy(by).agg(F.sum("revenue").alias("_r")), ["_r"], n, by).select(by)
    return df.join(F.broadcast(best), by, "left_semi").groupBy(quarter("closing_at").alias("quarter"), by).agg(F.round(F.sum("revenue"), 2).alias("revenue"))


for _c in ("entity", "opp_type"):
    book.on_view(f"D4_quarter_top_{_c}", f"select {_Q.format(c='closing_at')} as quarter, {_c}, round(sum(revenue), 2) as revenue from opp where {_c} in (select {_c} from opp group by 1 order by sum(revenue) desc, 1 limit 5) group by 1, 2")(lambda df, c=_c: quarter_by_top(df, c))


def revenue_by(df: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Count, revenue and share per level; the n largest if given, with shares of all."""
    out = share(df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue")), "revenue")
    return out if n is None else top(out, ["revenue"], n, by)


_SHARE = "select {by}, count(*) as n, round(sum(revenue), 2) as revenue, round(round(sum(revenue), 2) * 100 / nullif(sum(round(sum(revenue), 2)) over (), 0), 4) as share from opp group by 1"
for _name, _by, _n in (("D5_status_pipeline", "status", None), ("D9_revenue_entity", "entity", None), ("D9_revenue_type", "opp_type", None), ("D9_top20_sales", "client", 20)):
    book.on_view(_name, _SHARE.format(by=_by) + (f" order by revenue desc, 1 limit {_n}" if _n else ""))(lambda df, by=_by, n=_n: revenue_by(df, by, n))


@book.on_view("D6_quarter_status_revenue", f"select {_Q.format(c='closing_at')} as quarter, " + ", ".join(f"round(coalesce(sum(revenue) filter (status = '{s}'), 0), 2) as {s}" for s in STATUSES) + " from opp group by 1")
def quarter_status_revenue(df: DataFrame) -> DataFrame:
    out = df.groupBy(quarter("closing_at").alias("quarter")).pivot("status", STATUSES).agg(F.sum("revenue")).fillna(0)
    return out.select("quarter", *(F.round(s, 2).alias(s) for s in STATUSES))


@book.on_view("D7_top_clients_count", "select client, count(*) as n from opp group by 1 order by 2 desc, 1 limit 10")
def top_clients_count(df: DataFrame) -> DataFrame:
    return top(df.groupBy("client").agg(F.count("*").alias("n")), ["n"], 10, "client")


@book.on_view("D8_top_clients_revenue", "with t as (select client, round(sum(revenue), 2) as revenue from opp group by 1 order by 2 desc, 1 limit 10) select *, round(revenue * 100 / sum(revenue) over (), 4) as share_of_top10 from t")
def top_clients_revenue(df: DataFrame) -> DataFrame:
    return share(top(df.groupBy("client").agg(F.round(F.sum("revenue"), 2).alias("revenue")), ["revenue"], 10, "client"), "revenue", "share_of_top10")


@book.on_view("D10_conversion_type", "select opp_type, round(avg(case status when 'won' then 100.0 when 'lost' then 0 end), 4) as conversion_pct from opp group by 1")
def conversion_by_type(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isin("won", "lost")).groupBy("opp_type").agg(F.round(F.avg((F.col("status") == "won").cast("int")) * 100, 4).alias("conversion_pct"))


@book.on_view("D11_loglog_ols", "select round(regr_slope(log10(revenue), log10(budget)), 4) as slope, round(regr_intercept(log10(revenue), log10(budget)), 4) as intercept, count(*) as n from opp where revenue > 0 and budget > 0")
def loglog_ols(df: DataFrame) -> DataFrame:
    x, y = F.log10("budget"), F.log10("revenue")
    return df.where("revenue > 0 and budget > 0").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.count("*").alias("n"))


_R = "r as (select revenue / budget as r from opp where budget > 0), t as (select * from r where r <= (select quantile_cont(r, 0.99) from r))"


@book.on_view("D12_ratio_describe", f"with {_R} select count(*) as n, round(avg(r), 3) as mean, round(stddev_samp(r), 3) as std, " + ", ".join(f"round(quantile_cont(r, {q}), 3) as p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) + " from t")
def ratio_describe(df: DataFrame) -> DataFrame:
    r = cut(df.where("budget > 0").select((F.col("revenue") / F.col("budget")).alias("r")))
    r = r.crossJoin(F.broadcast(quantile_row(r, {"most": ("r", 0.99)}))).where("r <= most").select("r")
    q = quantile_row(r, {f"p{int(v * 100)}": ("r", v) for v in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)})
    return rounded(r.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev("r").alias("std")).crossJoin(F.broadcast(q)), 3)


@book.on_view("D13_ratio_histogram", "select floor((log10(revenue / budget) + 1) / 4 * 39)::bigint as bin, count(*) as n from opp where budget > 0 and revenue / budget between 0.1 and 1000 group by 1")
def ratio_histogram(df: DataFrame) -> DataFrame:
    r = F.col("revenue") / F.col("budget")
    return df.where((F.col("budget") > 0) & r.between(0.1, 1000)).groupBy(F.floor((F.log10(r) + 1) / 4 * 39).cast("long").alias("bin")).agg(F.count("*").alias("n"))


_D = "d as (select status, floor((epoch_us(closing_at) - epoch_us(registered_at)) / 86400000000) as d from opp where closing_at is not null)"


@book.on_view("D14_duration_box", f"with {_D}, q as (select status, quantile_cont(d, 0.25) as q1, quantile_cont(d, 0.5) as med, quantile_cont(d, 0.75) as q3 from d where d > 0 group by 1) select q.status, round(q1, 4) as q1, round(med, 4) as med, round(q3, 4) as q3, min(d)::bigint as low, max(d)::bigint as high from q join d using (status) where d > 0 and d between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all")
def duration_box(df: DataFrame) -> DataFrame:
    d = df.select("status", days("closing_at", "registered_at").alias("d")).where("d > 0")
    q = d.groupBy("status").agg(*(F.percentile("d", F.lit(v)).alias(c) for c, v in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))))
    inside = d.join(F.broadcast(q), "status").where("d between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)")
    return inside.groupBy("status", *(F.round(c, 4).alias(c) for c in ("q1", "med", "q3"))).agg(F.min("d").cast("long").alias("low"), F.max("d").cast("long").alias("high"))


@book.on_view("D15_duration_by_revenue_quartile", "with c as (select quantile_cont(revenue, 0.25) as a, quantile_cont(revenue, 0.5) as b, quantile_cont(revenue, 0.75) as c from opp where revenue > 0), d as (select case when revenue <= a then 1 when revenue <= b then 2 when revenue <= c.c then 3 else 4 end as quartile, floor((epoch_us(closing_at) - epoch_us(registered_at)) / 86400000000) as d from opp, c where revenue > 0) select quartile, count(*) as n, round(avg(d), 4) as mean_days, round(quantile_cont(d, 0.5), 4) as median_days from d group by 1")
def duration_by_quartile(df: DataFrame) -> DataFrame:
    """Quartiles of positive revenue, closed on the right; equal edges raise, since the buckets would not be four."""
    df = df.where("revenue > 0")
    edges = list(quantile_row(df, {f"q{i}": ("revenue", i / 4) for i in range(5)}).first())
    if edges[0] is not None and len(set(edges)) < 5:
        raise ValueError(f"quartile edges must be unique: {edges}")
    r = F.col("revenue")
    bucket = F.when(r <= edges[1], 1).when(r <= edges[2], 2).when(r <= edges[3], 3).otherwise(4)
    d = df.select(bucket.alias("quartile"), days("closing_at", "registered_at").alias("d"))
    return d.groupBy("quartile").agg(F.count("*").alias("n"), F.round(F.avg("d"), 4).alias("mean_days"), F.round(F.percentile("d", F.lit(0.5)), 4).alias("median_days"))


_flagged = lambda: flag((F.col("revenue") > 300000) | (F.col("cost") < 0))
_FSQL = "coalesce(revenue > 300000 or cost < 0, false)"


@book.on_view("D16_status_outlier", f"select status, count(*) filter (not {_FSQL}) as normal, count(*) filter ({_FSQL}) as outlier, round(count(*) filter ({_FSQL}) * 100.0 / nullif(sum(count(*) filter ({_FSQL})) over (), 0), 1) as share_of_outliers from opp group by 1")
def status_outlier(df: DataFrame) -> DataFrame:
    out = df.groupBy("status").agg(F.count(F.when(~_flagged(), 1)).alias("normal"), F.count(F.when(_flagged(), 1)).alias("outlier"))
    total = out.agg(F.sum("outlier").alias("t"))
    return out.crossJoin(F.broadcast(total)).select("status", "normal", "outlier", F.round(F.col("outlier") * 100.0 / F.expr("nullif(t, 0)"), 1).alias("share_of_outliers"))


for _c in ("client", "entity"):
    book.on_view(f"D17_top5_outliers_{_c}", f"select {_c}, count(*) as n from opp where {_FSQL} group by 1 order by 2 desc, 1 limit 5")(lambda df, c=_c: top(df.where(_flagged()).groupBy(c).agg(F.count("*").alias("n")), ["n"], 5, c))


@book.on_view("D18_normal_outlier_long", f"select entity, case when {_FSQL} then 'outlier' else 'normal' end as kind, count(*) as n from opp group by 1, 2")
def normal_outlier_long(df: DataFrame) -> DataFrame:
    wide = df.groupBy("entity").agg(F.count(F.when(~_flagged(), 1)).alias("normal"), F.count(F.when(_flagged(), 1)).alias("outlier"))
    return wide.unpivot("entity", ["normal", "outlier"], "kind", "n").where("n > 0")


@book.on_view("D19_segment_profile", "select category, round(avg(revenue), 4) as revenue, round(avg(budget), 4) as budget, round(avg(cost), 4) as cost from opp group by 1")
def segment_profile(df: DataFrame, by: str = "category", cols=("revenue", "budget", "cost")) -> DataFrame:
    return df.groupBy(by).agg(*(F.round(F.avg(c), 4).alias(c) for c in cols))


@book.on_view("D20_crosstab", "select entity, category, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share from opp group by 1, 2")
def crosstab(df: DataFrame, a: str = "entity", b: str = "category") -> DataFrame:
    out = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(out.agg(F.sum("n").alias("_t")))).select(a, b, "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def calendar(df: DataFrame, date: str, by: list[str] | None = None) -> DataFrame:
    """Every period end of every granularity between the first and last date (per key)."""
    span = df.where(F.col(date).isNotNull()).groupBy(*(by or [])).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    out = None
    for g, step in zip(GRANULARITIES, ("1 month", "3 months", "1 year")):
        part = span.select(*(by or []), F.lit(g).alias("granularity"), F.explode(F.expr(f"sequence(cast(trunc(lo, '{g}') as date), cast(trunc(hi, '{g}') as date), interval {step})")).alias("p"))
        part = part.select(*(by or []), "granularity", period_end("p", g).alias("period_end"))
        out = part if out is None else out.union(part)
    return out


def period_sums(df: DataFrame, date: str, measures: dict, by: list[str] | None = None) -> DataFrame:
    """Month, quarter and year totals in one pass, gaps filled with 0."""
    by = by or []
    each = df.where(F.col(date).isNotNull()).select("*", F.explode(F.array(*(F.struct(F.lit(g).alias("granularity"), period_end(date, g).alias("period_end")) for g in GRANULARITIES))).alias("_p")).select("*", "_p.*")
    sums = each.groupBy(*by, "granularity", "period_end").agg(*(v.alias(k) for k, v in measures.items()))
    return calendar(df, date, by).join(sums, [*by, "granularity", "period_end"], "left").fillna(0, list(measures))


_CAL = """b as (select min(closing_at) as lo, max(closing_at) as hi from w), cal as (
  select 'month' as granularity, last_day(p::date) as period_end from b, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month)) t(p)
  union all select 'quarter', last_day((p + interval 2 month)::date) from b, unnest(generate_series(date_trunc('quarter', lo), date_trunc('quarter', hi), interval 3 month)) t(p)
  union all select 'year', last_day((p + interval 11 month)::date) from b, unnest(generate_series(date_trunc('year', lo), date_trunc('year', hi), interval 1 year)) t(p)),
  e as (select *, 'month' as granularity, last_day(closing_at::date) as period_end from w union all select *, 'quarter', last_day((date_trunc('quarter', closing_at) + interval 2 month)::date) from w
  union all select *, 'year', last_day((date_trunc('year', closing_at) + interval 11 month)::date) from w)"""


@book.on_view("D21_period_revenue", f"with w as (select * from opp where status = 'won' and closing_at is not null), {_CAL} select granularity, strftime(period_end, '%Y-%m-%d') as period_end, round(coalesce(sum(revenue), 0), 4) as revenue from cal left join e using (granularity, period_end) group by 1, 2")
def period_revenue(df: DataFrame) -> DataFrame:
    out = period_sums(df.where("status = 'won'"), "closing_at", {"revenue": F.sum("revenue")})
    return out.select("granularity", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), F.round("revenue", 4).alias("revenue"))


@book.on_view("D22_conversion_monthly", f"with w as (select * from opp where status in ('won', 'lost') and closing_at is not null), {_CAL} select strftime(period_end, '%Y-%m-%d') as period_end, count(*) filter (status = 'won') as won, count(status) as closed, round(coalesce(count(*) filter (status = 'won') * 1.0 / nullif(count(status), 0), 0), 6) as conv_rate, case when period_end < date '1997-01-01' then 'train' else 'test' end as split from cal left join e using (granularity, period_end) where granularity = 'month' group by period_end")
def conversion_monthly(df: DataFrame, cut: str = "1997-01-01") -> DataFrame:
    out = period_sums(df.where("status in ('won', 'lost')"), "closing_at", {"won": F.count(F.when(F.col("status") == "won", 1)), "closed": F.count("*")}).where("granularity = 'month'")
    return out.select(F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "won", "closed", F.round(F.coalesce(F.try_divide("won", "closed"), F.lit(0.0)), 6).alias("conv_rate"), F.when(F.col("period_end") < F.lit(cut).cast("date"), "train").otherwise("test").alias("split"))


_FLAGS = {"high_revenue": "revenue > 300000", "negative_cost": "cost < 0", "late": "closing_at > planned_end_at"}
_FAMILIES = {"all_amounts": ("high_revenue", "negative_cost"), "any": tuple(_FLAGS)}


@book.on_view("D23_flag_effect", "with w as (select * from opp where status = 'won' and closing_at is not null), e as (select last_day(closing_at::date) as m, revenue, " + ", ".join(f"coalesce({s}, false) as {k}" for k, s in _FLAGS.items()) + " from w) select strftime(m, '%Y-%m-%d') as period_end, flag, round(sum(revenue), 2) as with_flagged, round(sum(case when hit then 0 else revenue end), 2) as without_flagged from (" + " union all ".join(f"select m, revenue, '{k}' as flag, {k} as hit from e" for k in _FLAGS) + "".join(f" union all select m, revenue, '{k}', {' or '.join(v)} from e" for k, v in _FAMILIES.items()) + ") group by 1, 2")
def flag_effect(df: DataFrame, flags: dict | None = None, families: dict | None = None) -> DataFrame:
    """Monthly revenue with and without the rows of each flag, and of each family of flags (any of its flags; a family without flags is left out)."""
    named = {k: flag(F.expr(v)) for k, v in (flags or _FLAGS).items()}
    groups = families if families is not None else _FAMILIES if flags is None else {"any": tuple(flags)}
    named |= {k: any_flag(*(named[f] for f in v)) for k, v in groups.items() if v}
    w = df.where("status = 'won' and closing_at is not null").select(period_end("closing_at", "month").alias("m"), "revenue", F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), v.alias("hit")) for k, v in named.items()))).alias("f"))
    return w.groupBy(F.date_format("m", "yyyy-MM-dd").alias("period_end"), F.col("f.flag").alias("flag")).agg(F.round(F.sum("revenue"), 2).alias("with_flagged"), F.round(F.sum(F.when(F.col("f.hit"), 0).otherwise(F.col("revenue"))), 2).alias("without_flagged"))


@book.on_view("D27_before_after", """with w0 as (select last_day(closing_at::date) as m, sum(revenue) as before from opp where status = 'won' and closing_at is not null group by 1),
  w1 as (select last_day(coalesce(real_end_at, closing_at)::date) as m, sum(revenue) as after from opp where status = 'won' and coalesce(real_end_at, closing_at) is not null group by 1)
  select strftime(m, '%Y-%m-%d') as period_end, round(before, 2) as before, round(after, 2) as after from w0 full join w1 using (m)""")
def before_after(df: DataFrame) -> DataFrame:
    won = df.where("status = 'won'")
    by = lambda c, name: won.where(c.isNotNull()).groupBy(period_end(c, "month").alias("m")).agg(F.sum("revenue").alias(name))
    return by(F.col("closing_at"), "before").join(by(F.coalesce("real_end_at", "closing_at"), "after"), "m", "full").select(F.date_format("m", "yyyy-MM-dd").alias("period_end"), F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))


# forecasts by simple rules, long metrics, and the tables built from them
_FC = """m as (select strftime(last_day(closing_at::date), '%Y-%m-%d') as p, opp_type, round(sum(revenue), 2) as y from opp where closing_at is not null group by 1, 2),
  f as (select *, lag(y, 1) over (partition by opp_type order by p) as naive, lag(y, 12) over (partition by opp_type order by p) as seasonal from m),
  l as (select opp_type, p, y, 'naive' as model, naive as pred from f where naive is not null union all select opp_type, p, y, 'seasonal', seasonal from f where seasonal is not null),
  g as (select model, opp_type as series, count(*) as n, avg(abs(pred - y)) as mae, sqrt(avg((pred - y) ** 2)) as rmse, avg(abs((pred - y) / nullif(y, 0))) * 100 as mape from l group by 1, 2)"""


def rule_forecasts(df: DataFrame) -> DataFrame:
    """Last-value and same-month-last-year forecasts of monthly revenue per type."""
    m = df.where("closing_at is not null").groupBy(F.date_format(period_end("closing_at", "month"), "yyyy-MM-dd").alias("p"), "opp_type").agg(F.round(F.sum("revenue"), 2).alias("y"))
    w = Window.partitionBy("opp_type").orderBy("p")
    f = m.select("*", F.lag("y", 1).over(w).alias("naive"), F.lag("y", 12).over(w).alias("seasonal"))
    return f.unpivot(["opp_type", "p", "y"], ["naive", "seasonal"], "model", "pred").where("pred is not null").withColumnRenamed("opp_type", "series")


def forecast_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE and the MAPE that ignores zero actuals."""
    e = F.col("pred") - F.col("y")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(F.try_divide(e, F.expr("nullif(y, 0)")))) * 100).alias("mape"))


@book.on_view("F7_forecast_metrics", f"with {_FC} select model, series, n, round(mae, 2) as mae, round(rmse, 2) as rmse, round(mape, 2) as mape from g")
def metrics_query(df: DataFrame) -> DataFrame:
    return forecast_metrics(rule_forecasts(df), ["model", "series"]).select("model", "series", "n", *(F.round(c, 2).alias(c) for c in ("mae", "rmse", "mape")))


@book.on_view("D24_performance_table", f"with {_FC} select model, " + ", ".join(f"round(max({m}) filter (series = '{s}'), 2) as {m}_{k}" for k, s in enumerate(("1-URGENT", "2-HIGH")) for m in ("mae", "rmse")) + " from g group by 1")
def performance_table(df: DataFrame) -> DataFrame:
    g = forecast_metrics(rule_forecasts(df), ["model", "series"])
    return g.groupBy("model").agg(*(F.round(F.max(F.when(F.col("series") == s, F.col(m))), 2).alias(f"{m}_{k}") for k, s in enumerate(("1-URGENT", "2-HIGH")) for m in ("mae", "rmse")))


@book.on_view("D25_best_model", f"with {_FC} select series, arg_min(model, rmse) as model, printf('%s: best model %s', series, arg_min(model, rmse)) as line from g group by 1")
def best_model(df: DataFrame) -> DataFrame:
    g = forecast_metrics(rule_forecasts(df), ["model", "series"]).groupBy("series").agg(F.min_by("model", "rmse").alias("model"))
    return g.select("series", "model", F.format_string("%s: best model %s", "series", "model").alias("line"))


@book.on_view("D26_minmax_metrics", f"with {_FC} select model, series, " + ", ".join(f"round(coalesce(({m} - min({m}) over ()) / nullif(max({m}) over () - min({m}) over (), 0), 0), 4) as {m}" for m in ("mae", "rmse")) + " from g")
def minmax_metrics(df: DataFrame, cols=("mae", "rmse")) -> DataFrame:
    g = forecast_metrics(rule_forecasts(df), ["model", "series"])
    ends = g.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    return g.crossJoin(F.broadcast(ends)).select("model", "series", *(F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)), 4).alias(c) for c in cols))


@book.on_view("D2_reconciled_revenue", f"with q as (select {_Q.format(c='closing_at')} as quarter, count(*) as n, sum(revenue) as r from opp group by 1) select (select count(*) from opp) as n, sum(n)::bigint as n_by_quarter, round((select sum(revenue) from opp), 2) as revenue, round(sum(r), 2) as revenue_by_quarter, (select count(*) from opp) = sum(n) and abs((select sum(revenue) from opp) - sum(r)) < 0.01 * count(*) as reconciled from q")
def reconciled_revenue(df: DataFrame) -> DataFrame:
    """Counts and revenue of the quarters against those of the table."""
    q = df.groupBy(quarter("closing_at").alias("quarter")).agg(F.count("*").alias("n"), F.sum("revenue").alias("r"))
    by = q.agg(F.sum("n").alias("n_by_quarter"), F.sum("r").alias("rq"), F.count("*").alias("k"))
    out = df.agg(F.count("*").alias("n"), F.sum("revenue").alias("rt")).crossJoin(by)
    ok = (F.col("n") == F.col("n_by_quarter")) & (F.abs(F.col("rt") - F.col("rq")) < 0.01 * F.col("k"))
    return out.select("n", "n_by_quarter", F.round("rt", 2).alias("revenue"), F.round("rq", 2).alias("revenue_by_quarter"), ok.alias("reconciled"))


@book.on_view("D11_line_points", "with p as (select ln(budget) as x, ln(revenue) as y from opp where budget > 0 and revenue > 0), l as (select regr_slope(y, x) as a, regr_intercept(y, x) as b, min(x) as lo, max(x) as hi from p) select i, round(exp(lo + (hi - lo) * i / 10.0), 3) as budget, round(exp(b + a * (lo + (hi - lo) * i / 10.0)), 3) as revenue from l, unnest(range(0, 11)) t(i)")
def line_points(df: DataFrame, n: int = 10) -> DataFrame:
    """Points of the fitted line from the least to the greatest budget."""
    p = df.where("budget > 0 and revenue > 0").select(F.ln("budget").alias("x"), F.ln("revenue").alias("y"))
    fit = p.agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / n
    return fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).select(F.col("i").cast("long").alias("i"), F.round(F.exp(at), 3).alias("budget"), F.round(F.exp(F.col("b") + F.col("a") * at), 3).alias("revenue"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@book.on_view("D24_performance_full", f"with {_FC} select model, " + ", ".join(f"round(max({m}) filter (series = '{s}'), 2) as \"{m}_{s[2:].lower()}\"" for s in _PRIORITIES for m in ("mae", "rmse", "mape")) + " from g group by 1")
def performance_full(df: DataFrame) -> DataFrame:
    """Every metric of every series, one row per model; the series are those that the data have."""
    g = forecast_metrics(rule_forecasts(df), ["model", "series"])
    names = [r["series"] for r in g.select("series").distinct().orderBy("series").collect()]
    return g.groupBy("model").agg(*(F.round(F.max(F.when(F.col("series") == s, F.col(m))), 2).alias(f"{m}_{s[2:].lower()}") for s in names for m in ("mae", "rmse", "mape")))


def _granular(g: str) -> str:
    end = {"month": "last_day(closing_at::date)", "quarter": "last_day((date_trunc('quarter', closing_at) + interval 2 month)::date)", "year": "last_day((date_trunc('year', closing_at) + interval 11 month)::date)"}[g]
    return f"select '{g}' as granularity, {end} as p, round(sum(revenue), 2) as y from opp where closing_at is not null group by 2"


@book.on_view("D25_best_per_granularity", "with s as (" + " union all ".join(map(_granular, GRANULARITIES)) + "), f as (select *, lag(y, 1) over w as naive, (lag(y, 1) over w + lag(y, 2) over w) / 2 as mean2 from s window w as (partition by granularity order by p)), l as (select granularity, 'naive' as model, y, naive as pred from f where naive is not null union all select granularity, 'mean2', y, mean2 from f where mean2 is not null), g as (select granularity, model, sqrt(avg((pred - y) ** 2)) as rmse from l group by 1, 2) select granularity, arg_min(model, rmse) as model, round(min(rmse), 2) as rmse from g group by 1")
def best_per_granularity(df: DataFrame) -> DataFrame:
    """The simple forecast with the lowest RMSE for each granularity."""
    out = None
    for g in GRANULARITIES:
        s = df.where("closing_at is not null").groupBy(period_end("closing_at", g).alias("p")).agg(F.round(F.sum("revenue"), 2).alias("y")).withColumn("granularity", F.lit(g))
        out = s if out is None else out.union(s)
    w = Window.partitionBy("granularity").orderBy("p")
    f = out.select("granularity", "y", F.lag("y", 1).over(w).alias("naive"), ((F.lag("y", 1).over(w) + F.lag("y", 2).over(w)) / 2).alias("mean2"))
    g = forecast_metrics(f.unpivot(["granularity", "y"], ["naive", "mean2"], "model", "pred").where("pred is not null"), ["granularity", "model"])
    return g.groupBy("granularity").agg(F.min_by("model", "rmse").alias("model"), F.round(F.min("rmse"), 2).alias("rmse"))
