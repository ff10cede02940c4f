"""Profiling (C) and univariate outliers (E1, E2, E8): one scan for all columns, then long tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cut, flag, kurtosis_corrected, level_rows, quantile, quantile_row, rounded, running_sums, skew_corrected, wide_to_long
from ..plans.roles import AMOUNTS, DATES, LEVELS, Book
from .kpi import top

book = Book()
_each = lambda cols, body: " union all ".join(body.format(c=c) for c in cols)

@book.on_view("C1_data_dictionary", _each(AMOUNTS + LEVELS, "select '{c}' as variable, count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as n_distinct, count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0 / count(*), 4) as missing_pct from opp"))
def data_dictionary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    stats = {
        "n_distinct": lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")),
        "missing": lambda c: F.count("*") - F.count(c),
        "missing_pct": lambda c: F.round((F.count("*") - F.count(c)) * 100.0 / F.count("*"), 4),
    }
    return wide_to_long(df, cols or AMOUNTS + LEVELS, stats)


@book.on_view("C1_samples", _each(LEVELS, "select '{c}' as variable, string_agg(v, ' | ' order by v) as samples from (select distinct {c} as v from opp where {c} is not null order by 1 limit 5)"))
def samples(df: DataFrame, cols: list[str] | None = None, n: int = 5) -> DataFrame:
    levels = level_rows(df, cols or LEVELS).where("level is not null").distinct()
    ranked = levels.withColumn("r", F.row_number().over(Window.partitionBy("variable").orderBy("level"))).where(F.col("r") <= n)
    return ranked.groupBy("variable").agg(F.array_join(F.array_sort(F.collect_list("level")), " | ").alias("samples"))


_STATS = {"mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max, "skew": skew_corrected, "kurtosis": kurtosis_corrected}
_SQL = {"mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "q1": "quantile_cont({c}, 0.25)", "median": "quantile_cont({c}, 0.5)", "q3": "quantile_cont({c}, 0.75)", "max": "max({c})", "skew": "skewness({c})", "kurtosis": "kurtosis({c})"}


def quantiles(df: DataFrame, cols: list[str], qs: dict[str, float], narrow: bool = False) -> DataFrame:
    """One row per column with its quantiles."""
    wide = quantile_row(df, {f"{c}__{n}": (c, q) for c in cols for n, q in qs.items()}, narrow)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), *(F.col(f"{c}__{n}").alias(n) for n in qs)) for c in cols))).alias("r")).select("r.*")


@book.on_view("C2_numeric_overview", _each(AMOUNTS, "select '{c}' as variable, count({c}) as n, count(*) - count({c}) as missing, " + ", ".join(f"round({v}, 4) as {k}" for k, v in _SQL.items()) + " from opp"))
def numeric_overview(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or AMOUNTS
    df = cut(df.select(*cols))
    stats = wide_to_long(df, cols, {"n": F.count, "missing": lambda c: F.count("*") - F.count(c), **_STATS})
    return rounded(stats.join(F.broadcast(quantiles(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, narrow=True)), "variable"))


@book.on_view("C3_categorical_overview", _each(LEVELS, "select '{c}' as variable, count(distinct {c}) as n_distinct, (select {c} from opp where {c} is not null group by 1 order by count(*) desc, 1 limit 1) as top_level, (select count(*) from opp where {c} is not null group by {c} order by 1 desc limit 1) as top_freq, count(*) - count({c}) as missing from opp"))
def categorical_overview(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    counts = level_rows(df, cols or LEVELS).groupBy("variable", "level").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("level").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("level").alias("v"))))
    out = counts.groupBy("variable").agg(F.count("level").alias("n_distinct"), best.alias("b"), F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    return out.select("variable", "n_distinct", F.col("b.v").alias("top_level"), (-F.col("b.k")).alias("top_freq"), "missing")


@book.on_view("C4_date_overview", _each(DATES, "select '{c}' as variable, strftime(min({c}), '%Y-%m-%d') as lo, strftime(max({c}), '%Y-%m-%d') as hi, count(*) - count({c}) as missing from opp"))
def date_overview(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    day = lambda f: lambda c: F.date_format(f(c), "yyyy-MM-dd")
    return wide_to_long(df, cols or DATES, {"lo": day(F.min), "hi": day(F.max), "missing": lambda c: F.count("*") - F.count(c)})


@book.on_view("C5_typology", _each(AMOUNTS, "select '{c}' as variable, count(distinct {c}) as n_distinct, round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 4) as skew, count(distinct {c}) <= 2 as low_variability, abs(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0))) > 1 as strongly_skewed from opp"))
def typology(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return rounded(wide_to_long(df, cols or AMOUNTS, {"n_distinct": F.count_distinct, "skew": F.skewness, "low_variability": lambda c: F.count_distinct(c) <= 2, "strongly_skewed": lambda c: F.abs(F.skewness(c)) > 1}))


@book.on_view("C6_level_counts", _each(LEVELS, "select '{c}' as variable, {c} as level, count(*) as n from opp group by 2"))
def level_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return level_rows(df, cols or LEVELS).groupBy("variable", "level").agg(F.count("*").alias("n"))


@book.on_view("C7_missing_pct", _each(DATES + AMOUNTS, "select '{c}' as variable, round(avg(case when {c} is null then 100.0 else 0 end), 4) as missing_pct from opp"))
def missing_pct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return wide_to_long(df, cols or DATES + AMOUNTS, {"missing_pct": lambda c: F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 4)})




def rare_levels(df: DataFrame, cols: list[str], threshold: int) -> DataFrame:
    """Levels with fewer rows than the threshold; null is a level."""
    return level_rows(df, cols).groupBy("variable", "level").agg(F.count("*").alias("n")).where(F.col("n") < threshold)


@book.on_view("C8_rare_levels", "select 'client' as variable, client as level, count(*) as n from opp group by 2 having count(*) < 5")
def rare_levels_query(df: DataFrame) -> DataFrame:
    return rare_levels(df, ["client"], 5)


@book.on_view("C8_rare_rows", "select code from opp where client in (select client from opp group by 1 having count(*) < 5)")
def rare_rows(df: DataFrame, col: str = "client", threshold: int = 5) -> DataFrame:
    rare = rare_levels(df, [col], threshold).select("level")
    return df.join(rare, F.col(col).eqNullSafe(F.col("level")), "left_semi").select("code")


@book.on_view("C9_rare_pairs", "select client, opp_type, count(*) as n from opp where client is not null and opp_type is not null group by 1, 2 having count(*) < 3")
def rare_pairs(df: DataFrame, a: str = "client", b: str = "opp_type", threshold: int = 3) -> DataFrame:
    return df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n")).where(F.col("n") < threshold)


@book.on_view("C10_rare_digest", "with r as (select 'client' as variable, client as level, count(*) as n from opp group by 2 having count(*) < 5 union all select 'entity', entity, count(*) from opp group by 2 having count(*) < 5), k as (select *, row_number() over (partition by variable order by n, level) as rk from r) select variable, level[1:40] as level, n from k where rk <= 5")
def rare_digest(df: DataFrame, cols=("client", "entity"), threshold: int = 5, n: int = 5) -> DataFrame:
    r = rare_levels(df, list(cols), threshold).withColumn("rk", F.row_number().over(Window.partitionBy("variable").orderBy("n", "level")))
    return r.where(F.col("rk") <= n).select("variable", F.substring("level", 1, 40).alias("level"), "n")


_PAIRS = [(a, b) for i, a in enumerate(AMOUNTS) for b in AMOUNTS[i + 1 :]]


@book.on_view("C11_correlation", "select * from (" + " union all ".join(f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as corr from opp" for a, b in _PAIRS) + ")")
def correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or AMOUNTS
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    wide = df.agg(*(both(a, b).alias(f"{a}__{b}") for a, b in pairs))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(f"{a}__{b}", 6).alias("corr")) for a, b in pairs))).alias("r")).select("r.*")


@book.on_view("C12_cleaning_impact", _each(AMOUNTS, "select '{c}' as variable, round(avg({c}), 4) as mean_before, round(avg({c}) filter (cost >= 0), 4) as mean_after, round(quantile_cont({c}, 0.5), 4) as median_before, round(quantile_cont({c}, 0.5) filter (cost >= 0), 4) as median_after, round(stddev_samp({c}), 4) as std_before, round(stddev_samp({c}) filter (cost >= 0), 4) as std_after from opp"))
def cleaning_impact(df: DataFrame, keep=None, cols: list[str] | None = None) -> DataFrame:
    keep = F.col("cost") >= 0 if keep is None else keep
    cols, stats = cols or AMOUNTS, {}
    for name, f in (("mean", F.avg), ("std", F.stddev)):
        stats[f"{name}_before"] = lambda c, f=f: f(F.col(c))
        stats[f"{name}_after"] = lambda c, f=f: f(F.when(keep, F.col(c)))
    both = df.select(*cols, *(F.when(keep, F.col(c)).alias(f"{c}__kept") for c in cols))
    med = quantile_row(both, {c: (c, 0.5) for c in both.columns})
    med = med.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("median_before"), F.col(f"{c}__kept").alias("median_after")) for c in cols))).alias("r")).select("r.*")
    return rounded(wide_to_long(df, cols, stats).join(F.broadcast(med), "variable"))


_REGION = "case when {a} = 0 and {b} = 0 then 'origin' when {b} = 0 then 'x-axis' when {a} = 0 then 'y-axis' when {a} = {b} then 'diagonal' else 'normal' end"


@book.on_view("C13_pair_regions", " union all ".join(f"select '{a}/{b}' as pair, {_REGION.format(a=a, b=b)} as region, count(*) as n from opp group by 2" for a, b in _PAIRS))
def pair_regions(df: DataFrame, pairs=None) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(f"{a}/{b}").alias("pair"), F.expr(_REGION.format(a=a, b=b)).alias("region")) for a, b in pairs or _PAIRS))
    return df.select(F.explode(rows).alias("r")).groupBy("r.pair", "r.region").agg(F.count("*").alias("n"))


_BOX = (0.05, 0.25, 0.5, 0.75, 0.95)


@book.on_view("C14_positive_box", _each(AMOUNTS, "select '{c}' as variable, " + ", ".join(f"round(quantile_cont({{c}}, {q}) filter ({{c}} > 0), 4) as p{int(q * 100)}" for q in _BOX) + " from opp"))
def positive_box(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or AMOUNTS
    return rounded(quantiles(df.select(*(F.when(F.col(c) > 0, F.col(c)).alias(c) for c in cols)), cols, {f"p{int(q * 100)}": q for q in _BOX}))


@book.on_view("C15_histogram", "with b as (select min(revenue) as lo, max(revenue) as hi from opp) select least(floor((revenue - lo) / (hi - lo) * 20), 19)::bigint as bin, count(*) as n from opp, b group by 1")
def histogram(df: DataFrame, col: str = "revenue", bins: int = 20) -> DataFrame:
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    at = F.least(F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("long")
    return df.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


@book.on_view("C16_ecdf", "select distinct cost, round(cume_dist() over (order by cost), 6) as ecdf from opp")
def ecdf(df: DataFrame, col: str = "cost") -> DataFrame:
    """Cumulative share per distinct value: counts first, then running sums by range."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    run = running_sums(counts, col, {"c": "n"})
    return run.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select(col, F.round(F.col("c") / F.col("t"), 6).alias("ecdf"))


def fences(df: DataFrame, cols: list[str], k: float = 1.5, narrow: bool = False) -> DataFrame:
    q = quantile_row(df, {f"{c}__{n}": (c, v) for c in cols for n, v in (("q1", 0.25), ("q3", 0.75))}, narrow)
    return q.select(*(x for c in cols for x in ((F.col(f"{c}__q1") - k * (F.col(f"{c}__q3") - F.col(f"{c}__q1"))).alias(f"{c}__lo"), (F.col(f"{c}__q3") + k * (F.col(f"{c}__q3") - F.col(f"{c}__q1"))).alias(f"{c}__hi"))))


_F = lambda c, k: f"f_{c} as (select quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from opp)"


@book.on_view("E1_iqr_outliers", "with " + ", ".join(_F(c, 1.5) for c in AMOUNTS) + " " + _each(AMOUNTS, "select code, '{c}' as variable, {c} as value, case when {c} < lo then 'low' else 'high' end as side from opp, f_{c} where {c} < lo or {c} > hi"))
def iqr_outliers(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, narrow: bool = False) -> DataFrame:
    """Long table of outlying cells with key and side; the columns are stored first, unless ``narrow`` says that they are."""
    cols = cols or AMOUNTS
    df = df if narrow else cut(df.select("code", *cols))
    cell = lambda c: F.struct(F.lit(c).alias("variable"), F.col(c).alias("value"), F.when(F.col(c) < F.col(f"{c}__lo"), "low").when(F.col(c) > F.col(f"{c}__hi"), "high").alias("side"))
    return df.crossJoin(F.broadcast(fences(df, cols, k, narrow=True))).select("code", F.explode(F.array(*map(cell, cols))).alias("r")).select("code", "r.*").where("side is not null")


@book.on_view("E2_iqr_sensitivity", "with " + ", ".join(_F(c, k).replace(f"f_{c}", f"f_{c}_{int(k * 10)}") for c in AMOUNTS for k in (1.5, 2.5, 3.0)) + " " + " union all ".join(f"select '{c}' as variable, {k} as k, count(*) filter ({c} < lo or {c} > hi) as n from opp, f_{c}_{int(k * 10)}" for c in AMOUNTS for k in (1.5, 2.5, 3.0)))
def iqr_sensitivity(df: DataFrame, cols: list[str] | None = None, ks=(1.5, 2.5, 3.0)) -> DataFrame:
    """Counts for several fences from one quartile table."""
    cols = cols or AMOUNTS
    q = quantile_row(df, {f"{c}__{n}": (c, v) for c in cols for n, v in (("q1", 0.25), ("q3", 0.75))})
    wide = df.crossJoin(F.broadcast(q))
    hit = lambda c, k: F.count(F.when((F.col(c) < F.col(f"{c}__q1") - k * (F.col(f"{c}__q3") - F.col(f"{c}__q1"))) | (F.col(c) > F.col(f"{c}__q3") + k * (F.col(f"{c}__q3") - F.col(f"{c}__q1"))), 1))
    wide = wide.agg(*(hit(c, k).alias(f"{c}__{i}") for c in cols for i, k in enumerate(ks)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.lit(k).alias("k"), F.col(f"{c}__{i}").alias("n")) for c in cols for i, k in enumerate(ks)))).alias("r")).select("r.*")


@book.on_view("E8_extreme_records", "with m as (select " + ", ".join(f"quantile_cont({c}, 0.5) as m_{c}" for c in AMOUNTS) + " from opp), d as (select code, round(greatest(" + ", ".join(f"coalesce(abs({c} - m_{c}), 0)" for c in AMOUNTS) + "), 2) as deviation from opp, m order by 2 desc, 1 limit 20) select code, deviation, 'Record ' || code || ' deviates most' as sentence from d")
def extreme_records(df: DataFrame, cols: list[str] | None = None, n: int = 20) -> DataFrame:
    cols = cols or AMOUNTS
    med = quantile_row(df, {f"m_{c}": (c, 0.5) for c in cols})
    dev = F.round(F.greatest(*(F.coalesce(F.abs(F.col(c) - F.col(f"m_{c}")), F.lit(0.0)) for c in cols)), 2)
    return top(df.crossJoin(F.broadcast(med)).select("code", dev.alias("deviation")), ["deviation"], n, "code").withColumn("sentence", F.format_string("Record %d deviates most", "code"))


_m1 = lambda: flag(F.col("revenue") > 250000)
_m2 = lambda: flag(F.col("budget") > 240000)
_m3 = lambda: flag(F.col("cost") < 0)
_MS = "coalesce(revenue > 250000, false) as a, coalesce(budget > 240000, false) as b, coalesce(cost < 0, false) as u"


def combine_flags(df: DataFrame, a="a", b="b", u="u") -> DataFrame:
    """Exclusive type, multivariate flag (a or b) and any flag, from two multivariate flags and a univariate one."""
    kind = F.when(F.col(a) & F.col(b), "both").when(F.col(a), "A only").when(F.col(b), "B only").otherwise("normal")
    return df.select("*", kind.alias("kind"), (F.col(a) | F.col(b)).alias("multi"), (F.col(a) | F.col(b) | F.col(u)).alias("any"))


@book.on_view("E5_combined_flags", f"with f as (select {_MS} from opp) select case when a and b then 'both' when a then 'A only' when b then 'B only' else 'normal' end as kind, count(*) as n, count(*) filter (a or b or u) as n_any from f group by 1")
def combined_flags(df: DataFrame) -> DataFrame:
    f = combine_flags(df.select(_m1().alias("a"), _m2().alias("b"), _m3().alias("u")))
    return f.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("any"), 1)).alias("n_any"))


@book.on_view("E6_outlier_summary", f"with f as (select {_MS} from opp) select count(*) as rows, count(*) filter (a) as n_a, count(*) filter (b) as n_b, count(*) filter (u) as n_u, count(*) filter (a and b) as n_both, count(*) filter (a or b) as n_multi, count(*) filter (a or b or u) as n_any from f")
def outlier_summary(df: DataFrame) -> DataFrame:
    f = combine_flags(df.select(_m1().alias("a"), _m2().alias("b"), _m3().alias("u")))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return f.agg(F.count("*").alias("rows"), n(F.col("a"), "n_a"), n(F.col("b"), "n_b"), n(F.col("u"), "n_u"), n(F.col("a") & F.col("b"), "n_both"), n(F.col("multi"), "n_multi"), n(F.col("any"), "n_any"))


@book.on_view("E7_outlier_families", f"with f as (select {_MS} from opp) select case when a and b then 'A and B' when a then 'A' when b then 'B' else 'univariate' end as family, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 2) as share from f where a or b or u group by 1")
def outlier_families(df: DataFrame) -> DataFrame:
    f = combine_flags(df.select(_m1().alias("a"), _m2().alias("b"), _m3().alias("u"))).where("any")
    fam = f.groupBy(F.when(F.col("a") & F.col("b"), "A and B").when(F.col("a"), "A").when(F.col("b"), "B").otherwise("univariate").alias("family")).agg(F.count("*").alias("n"))
    return fam.crossJoin(F.broadcast(fam.agg(F.sum("n").alias("t")))).select("family", "n", F.round(F.col("n") * 100.0 / F.col("t"), 2).alias("share"))


_TYPES = {"double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP", "bigint": "BIGINT"}


@book.on_view("C1_types", " union all ".join(f"select '{c}' as variable, case when typeof(max({c})) like 'TIMESTAMP%' then 'timestamp' when typeof(max({c})) = 'VARCHAR' then 'string' when typeof(max({c})) = 'BIGINT' then 'bigint' else 'double' end as dtype from opp" for c in ["code", *AMOUNTS, *LEVELS, *DATES]))
def types(df: DataFrame) -> DataFrame:
    kinds = {c: "timestamp" if t.startswith("timestamp") else t for c, t in df.dtypes}
    return df.limit(1).select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.lit(kinds[c]).alias("dtype")) for c in ["code", *AMOUNTS, *LEVELS, *DATES]))).alias("r")).select("r.*")


@book.on_view("C2_missing_and_distinct", _each(AMOUNTS, "select '{c}' as variable, round((count(*) - count({c})) * 100.0 / count(*), 4) as missing_pct, count(distinct {c}) as n_distinct from opp"))
def missing_and_distinct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Values counted first, so no column needs a distinct count of its own."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("v")) for c in cols or AMOUNTS)))
    n = df.select(cells.alias("c")).select("c.*").groupBy("variable", "v").agg(F.count("*").alias("n"))
    missing = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
    return n.groupBy("variable").agg(F.round(missing * 100.0 / F.sum("n"), 4).alias("missing_pct"), F.count("v").alias("n_distinct"))


@book.on_view("C3_missing_pct", _each(LEVELS, "select '{c}' as variable, round((count(*) - count({c})) * 100.0 / count(*), 4) as missing_pct from opp"))
def level_missing(df: DataFrame) -> DataFrame:
    return wide_to_long(df, LEVELS, {"missing_pct": lambda c: F.round((F.count("*") - F.count(c)) * 100.0 / F.count("*"), 4)})


@book.on_view("C9_rare_combo_rows", "select code, coalesce(count(*) over (partition by client, opp_type) < 3 and client is not null and opp_type is not null, false) as flag_combo_rare from opp")
def rare_combo_rows(df: DataFrame, a: str = "client", b: str = "opp_type", threshold: int = 3) -> DataFrame:
    rare = rare_pairs(df, a, b, threshold).select(a, b, F.lit(True).alias("flag_combo_rare"))
    return df.select("code", a, b).join(rare, [a, b], "left").select("code", F.coalesce("flag_combo_rare", F.lit(False)).alias("flag_combo_rare"))


@book.on_view("C10_rare_counts", "with r as (select 'client' as variable, client as level from opp group by 2 having count(*) < 12 union all select 'entity', entity from opp group by 2 having count(*) < 12) select variable, count(*) as n_rare from r group by 1 order by 2 desc, 1 limit 16")
def rare_counts(df: DataFrame, cols=("client", "entity", "status"), excluded=("status",), threshold: int = 12, n: int = 16) -> DataFrame:
    """Rare levels per variable, the 16 variables with most, some left out."""
    r = rare_levels(df, [c for c in cols if c not in excluded], threshold)
    return top(r.groupBy("variable").agg(F.count("*").alias("n_rare")), ["n_rare"], n, "variable")


@book.on_view("C11_raw_and_clean", "select * from (" + " union all ".join(f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as raw, round(corr({a}, {b}) filter (cost >= 0), 6) as clean from opp" for a, b in _PAIRS) + ")")
def raw_and_clean(df: DataFrame) -> DataFrame:
    """Correlations before and after cleaning, side by side, in one scan; constant columns have none and are left out."""
    both = lambda a, b, ok: F.corr(F.when(ok & F.col(b).isNotNull(), F.col(a)), F.when(ok & F.col(a).isNotNull(), F.col(b)))
    wide = df.agg(*(both(a, b, ok).alias(f"{n}_{i}") for i, (a, b) in enumerate(_PAIRS) for n, ok in (("raw", F.lit(True)), ("clean", F.col("cost") >= 0))))
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(f"raw_{i}", 6).alias("raw"), F.round(f"clean_{i}", 6).alias("clean")) for i, (a, b) in enumerate(_PAIRS)))).alias("r")).select("r.*")
    return rows.where("raw is not null")


@book.on_view("C13_positive_regions", " union all ".join(f"select '{a}/{b}' as pair, case when {a} = {b} then 'diagonal' when {a} > {b} then 'above' else 'below' end as region, count(*) as n from opp where {a} > 0 and {b} > 0 group by 2" for a, b in _PAIRS))
def positive_regions(df: DataFrame) -> DataFrame:
    """Regions of pairs of which both are positive."""
    rows = F.array(*(F.when((F.col(a) > 0) & (F.col(b) > 0), F.struct(F.lit(f"{a}/{b}").alias("pair"), F.when(F.col(a) == F.col(b), "diagonal").when(F.col(a) > F.col(b), "above").otherwise("below").alias("region"))) for a, b in _PAIRS))
    return df.select(F.explode(rows).alias("r")).where("r is not null").groupBy("r.pair", "r.region").agg(F.count("*").alias("n"))


@book.on_view("C14_positive_box_clean", _each(AMOUNTS, "select '{c}' as variable, " + ", ".join(f"round(quantile_cont({{c}}, {q}) filter ({{c}} > 0 and cost >= 0), 4) as p{int(q * 100)}" for q in _BOX) + " from opp"))
def positive_box_clean(df: DataFrame) -> DataFrame:
    return positive_box(df.where("cost >= 0"))


@book.on_view("C15_histograms", " union all ".join(f"select '{c}' as variable, version, least(floor(({c} - lo) / nullif(hi - lo, 0) * 20), 19)::bigint as bin, count(*) as n from (select {c}, cost, v as version from opp, unnest(['raw', 'clean']) t(v) where {c} is not null and (v = 'raw' or cost >= 0)), (select min({c}) as lo, max({c}) as hi from opp) group by 2, 3" for c in AMOUNTS))
def histograms(df: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins of every amount over its raw range, before and after cleaning."""
    ends = df.agg(*(f(c).alias(f"{n}_{c}") for c in AMOUNTS for n, f in (("lo", F.min), ("hi", F.max))))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.expr(f"nullif(hi_{c} - lo_{c}, 0)") * bins), F.lit(bins - 1)).cast("long")
    cells = F.array(*(F.struct(F.lit(c).alias("variable"), F.lit(v).alias("version"), F.when(F.col(c).isNotNull() & ok, F.lit(True)).alias("use"), at(c).alias("bin")) for c in AMOUNTS for v, ok in (("raw", F.lit(True)), ("clean", F.col("cost") >= 0))))
    return df.crossJoin(F.broadcast(ends)).select(F.explode(cells).alias("r")).where("r.use").groupBy("r.variable", "r.version", "r.bin").agg(F.count("*").alias("n"))


#: coefficients of a rational approximation of the normal quantile (central part, then tails)
_NORMAL = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572), (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416))


def normal_quantile(p):
    """The value below which a standard normal lies with probability p, as a column expression."""
    a, b, c, d = _NORMAL
    poly = lambda q, ks: sum((F.lit(k) * F.pow(q, F.lit(len(ks) - 1 - i)) for i, k in enumerate(ks)), F.lit(0.0))
    tail = lambda q: poly(q, c) / poly(q, (*d, 1.0))
    mid, low, high = p - 0.5, F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    r = mid * mid
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(mid * poly(r, a) / poly(r, (*b, 1.0)))


@book.on_view("C16_qq")
def qq(df: DataFrame, col: str = "revenue", points: int = 100) -> DataFrame:
    """Normal QQ points of the logarithm: as many quantiles as points, against the normal ones, from the range-partitioned counts."""
    logs = df.where(F.col(col) > 0).select(F.ln(col).alias("v"))
    wide = quantile_row(logs, {f"q{i}": ("v", (i + 0.5) / points) for i in range(points)})
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit((i + 0.5) / points).alias("p"), F.col(f"q{i}").alias("sample")) for i in range(points)))).alias("r")).select("r.*")
    return rows.select("p", F.round(normal_quantile(F.col("p")), 6).alias("normal"), F.round("sample", 6).alias("sample"))


@book.on_view("E1_side_counts", "with " + ", ".join(_F(c, 1.5) for c in AMOUNTS) + " " + _each(AMOUNTS, "select '{c}' as variable, count(*) filter ({c} < lo) as low, count(*) filter ({c} > hi) as high from opp, f_{c}"))
def side_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or AMOUNTS
    n = lambda cond: F.count(F.when(cond, 1))
    wide = df.crossJoin(F.broadcast(fences(df, cols))).agg(*(x for c in cols for x in (n(F.col(c) < F.col(f"{c}__lo")).alias(f"{c}__low"), n(F.col(c) > F.col(f"{c}__hi")).alias(f"{c}__high"))))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"{c}__low").alias("low"), F.col(f"{c}__high").alias("high")) for c in cols))).alias("r")).select("r.*")


@book.on_view("E1_cleaned", "with " + ", ".join(_F(c, 1.5) for c in AMOUNTS) + " select code, revenue from opp" + "".join(f", f_{c}" for c in AMOUNTS) + " where " + " and ".join(f"coalesce({c} between f_{c}.lo and f_{c}.hi, true)" for c in AMOUNTS))
def without_outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The table less the rows with an outlying amount."""
    cols = cols or AMOUNTS
    inside = [F.coalesce(F.col(c).between(F.col(f"{c}__lo"), F.col(f"{c}__hi")), F.lit(True)) for c in cols]
    out = df.crossJoin(F.broadcast(fences(df, cols)))
    for ok in inside:
        out = out.where(ok)
    return out.select("code", "revenue")
