"""Points and clusters (G, H): projections from small matrices, quality given labels, agreement, ellipses, grids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..plans.roles import AMOUNTS, Book, read
from .clean import standardise
from .pca_sql import scores_sql

book = Book()
_P = "p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


def points(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def pca(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (n / (n - 1) convention) and loadings of the correlation matrix, largest absolute loading positive."""
    df = df.dropna(subset=cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    r = df.agg(F.count("*").alias("n"), *(F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    m = np.eye(len(cols))
    for i, j in pairs:
        m[i, j] = m[j, i] = r[f"c{i}_{j}"] or 0.0
    vals, vecs = np.linalg.eigh(m)
    vals, vecs = vals[::-1], vecs[:, ::-1]
    vecs = vecs * np.sign(vecs[np.abs(vecs).argmax(axis=0), np.arange(len(cols))])
    return vals * r["n"] / max(r["n"] - 1, 1), vecs


_SCORES = "select code, round(list_dot_product(z.v, (select v from axis where a = 1)), 6) as F1, round(list_dot_product(z.v, (select v from axis where a = 2)), 6) as F2 from z"


@book.on_view("G1_pca_scores", scores_sql("opp", _SCORES))
def pca_scores(df: DataFrame, cols: list[str] | None = None, k: int = 2) -> DataFrame:
    """Scores as column expressions over z-scores; only the loadings come from the driver."""
    cols = cols or AMOUNTS
    _, v = pca(df, cols)
    z = standardise(df.dropna(subset=cols), cols)
    return z.select("code", *(F.round(sum((F.col(c) * float(v[i, a]) for i, c in enumerate(cols)), F.lit(0.0)), 6).alias(f"F{a + 1}") for a in range(k)))


@book.on_view("G3_inertia_two", "with c as (select corr(revenue, cost) as r, count(*) as n from opp), e as (select 1 as axis, (1 + abs(r)) * n / (n - 1) as ev from c union all select 2, (1 - abs(r)) * n / (n - 1) from c) select axis::bigint as axis, round(ev, 6) as eigenvalue, round(ev * 100 / sum(ev) over (), 4) as pct, round(sum(ev) over (order by axis) * 100 / sum(ev) over (), 4) as cumulative from e")
def inertia_two(df: DataFrame) -> DataFrame:
    return inertia(df, ["revenue", "cost"])


def inertia(df: DataFrame, cols: list[str]) -> DataFrame:
    """Axis, eigenvalue, percent and cumulative percent."""
    v, _ = pca(df, cols)
    p = v * 100 / v.sum()
    rows = [(i + 1, round(float(a), 6), round(float(b), 4), round(float(c), 4)) for i, (a, b, c) in enumerate(zip(v, p, p.cumsum()))]
    return df.sparkSession.createDataFrame(rows, "axis long, eigenvalue double, pct double, cumulative double")


@book.on_view("G3_inertia", scores_sql("opp", "select a::bigint as axis, round(ev, 6) as eigenvalue, round(ev * 100 / sum(ev) over (), 4) as pct, round(sum(ev) over (order by a) * 100 / sum(ev) over (), 4) as cumulative from axis"))
def inertia_all(df: DataFrame) -> DataFrame:
    return inertia(df, AMOUNTS)


@book.on_view("G2_component_count", scores_sql("opp", "select greatest((select count(*) from axis where ev >= 1), (select min(a) from (select a, sum(ev) over (order by a) / sum(ev) over () as c from axis) where c >= 0.8))::int as n_components"))
def component_count(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.8) -> DataFrame:
    v, _ = pca(df, cols or AMOUNTS)
    reach = int(np.searchsorted(v.cumsum() / v.sum(), threshold) + 1)
    return df.sparkSession.createDataFrame([(int(max((v >= 1).sum(), reach)),)], "n_components int")


@book.on_view("G4_contributions", scores_sql("opp", "select [" + ", ".join(f"'{c}'" for c in AMOUNTS) + "][i]::varchar as variable, a::int as axis, round(100 * v[i] ** 2, 6) as contribution, round(v[i] ** 2 * ev, 6) as cos2 from axis, range(1, 5) t(i)"))
def contributions(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Percent contribution of each variable to each axis, and its cos2."""
    cols = cols or AMOUNTS
    ev, v = pca(df, cols)
    rows = [(c, a + 1, round(float(100 * v[i, a] ** 2), 6), round(float(v[i, a] ** 2 * ev[a]), 6)) for i, c in enumerate(cols) for a in range(len(cols))]
    return df.sparkSession.createDataFrame(rows, "variable string, axis int, contribution double, cos2 double")


@book.on_view("G5_axis_correlation", scores_sql("opp", "select [" + ", ".join(f"'{c}'" for c in AMOUNTS) + "][i]::varchar as variable, " + ", ".join(f"round(corr(z.v[i], list_dot_product(z.v, (select v from axis where a = {a}))), 6) as F{a}" for a in (1, 2)) + " from z, range(1, 5) t(i) group by i"))
def axis_correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or AMOUNTS
    s = pca_scores(df, cols).join(df.select("code", *cols), "code")
    wide = s.agg(*(F.corr(c, f).alias(f"{c}__{f}") for c in cols for f in ("F1", "F2")))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.round(f"{c}__F1", 6).alias("F1"), F.round(f"{c}__F2", 6).alias("F2")) for c in cols))).alias("r")).select("r.*")


@book.on_view("G6_burt", "with l as (select code, 'category=' || category as v from opp union all select code, 'status=' || status from opp) select a.v as a, b.v as b, count(*) as n from l a join l b using (code) group by 1, 2")
def burt(df: DataFrame, cols=("category", "status")) -> DataFrame:
    """Counts over level pairs: a self-product of each row's few levels, no self-join."""
    levels = F.array(*(F.concat(F.lit(f"{c}="), F.col(c)) for c in cols))
    return df.select(F.explode(levels).alias("a"), levels.alias("l")).select("a", F.explode("l").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@book.on_tables("H10_cluster_stats", f"with {_P} select label, count(*) as n, round(avg(x), 6) as x_mean, round(stddev_samp(x), 6) as x_std, round(avg(y), 6) as y_mean, round(stddev_samp(y), 6) as y_std from p group by 1")
def cluster_stats(spark, sf_dir) -> DataFrame:
    return rounded(points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.stddev("x").alias("x_std"), F.avg("y").alias("y_mean"), F.stddev("y").alias("y_std")), 6)


@book.on_tables("H7_calinski_davies", f"""with {_P}, g as (select avg(x) as gx, avg(y) as gy, count(*) as n, count(distinct label) as k from p), c as (select label, avg(x) as cx, avg(y) as cy, count(*) as m from p group by 1),
  s as (select label, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) as d, sum((x - cx) ** 2 + (y - cy) ** 2) as w from p join c using (label) group by 1), b as (select sum(m * ((cx - gx) ** 2 + (cy - gy) ** 2)) as b from c, g),
  r as (select a.label, max((sa.d + sb.d) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) as r from c a join c b on a.label <> b.label join s sa on sa.label = a.label join s sb on sb.label = b.label group by 1)
  select round((select b from b) / ((select k from g) - 1) / ((select sum(w) from s) / ((select n from g) - (select k from g))), 4) as calinski_harabasz, round((select avg(r) from r), 4) as davies_bouldin""")
def calinski_davies(spark, sf_dir) -> DataFrame:
    """From centroids and group sums only; the pairs joined are those of centroids."""
    p = points(spark, sf_dir)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("m"))
    g = p.agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"), F.count("*").alias("n"), F.count_distinct("label").alias("k"))
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    s = p.join(F.broadcast(c), "label").groupBy("label", "cx", "cy", "m").agg(F.avg(F.sqrt(d2)).alias("d"), F.sum(d2).alias("w"))
    ch = s.crossJoin(F.broadcast(g)).groupBy("n", "k").agg(F.sum(F.col("m") * ((F.col("cx") - F.col("gx")) ** 2 + (F.col("cy") - F.col("gy")) ** 2)).alias("b"), F.sum("w").alias("w"))
    o = s.select(*(F.col(v).alias(f"o_{v}") for v in ("label", "cx", "cy", "d")))
    db = s.join(o, F.col("label") != F.col("o_label")).groupBy("label").agg(F.max((F.col("d") + F.col("o_d")) / F.sqrt((F.col("cx") - F.col("o_cx")) ** 2 + (F.col("cy") - F.col("o_cy")) ** 2)).alias("r")).agg(F.round(F.avg("r"), 4).alias("davies_bouldin"))
    return ch.select(F.round(F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k"))), 4).alias("calinski_harabasz")).crossJoin(db)


@book.on_tables("H13_ellipses", f"with {_P}, c as (select label, avg(x) as cx, avg(y) as cy, var_samp(x) as a, var_samp(y) as d, covar_samp(x, y) as b from p group by 1) select label, round(cx, 6) as cx, round(cy, 6) as cy, round(sqrt(((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b)) * -2 * ln(0.1)), 6) as major, round(sqrt(greatest((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b), 0) * -2 * ln(0.1)), 6) as minor from c")
def ellipses(spark, sf_dir, coverage: float = 0.9) -> DataFrame:
    c = points(spark, sf_dir).groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("a"), F.var_samp("y").alias("d"), F.covar_samp("x", "y").alias("b"))
    mid, gap, q = (F.col("a") + F.col("d")) / 2, F.sqrt(((F.col("a") - F.col("d")) / 2) ** 2 + F.col("b") * F.col("b")), -2 * math.log(1 - coverage)
    return c.select("label", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round(F.sqrt((mid + gap) * q), 6).alias("major"), F.round(F.sqrt(F.greatest(mid - gap, F.lit(0.0)) * q), 6).alias("minor"))


@book.on_tables("H14_density_grid", f"with {_P}, b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p) select least(floor((x - x0) / (x1 - x0) * 30), 29)::bigint as i, least(floor((y - y0) / (y1 - y0) * 30), 29)::bigint as j, count(*) as n from p, b group by 1, 2")
def density_grid(spark, sf_dir, bins: int = 30) -> DataFrame:
    p = points(spark, sf_dir)
    b = p.agg(*(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * bins), F.lit(bins - 1)).cast("long")
    return p.crossJoin(F.broadcast(b)).groupBy(at("x").alias("i"), at("y").alias("j")).agg(F.count("*").alias("n"))


_CH = lambda c: f"sum({c} * ({c} - 1) / 2.0)"


@book.on_tables("H15_adjusted_rand", f"with {_P}, t as (select label as a, (x > 0)::int as b, count(*) as n from p group by 1, 2), i as (select {_CH('n')} as v from t), a as (select {_CH('n')} as v from (select sum(n) as n from t group by a)), b as (select {_CH('n')} as v from (select sum(n) as n from t group by b)), n as (select sum(n) * (sum(n) - 1) / 2.0 as v from t) select round((i.v - a.v * b.v / n.v) / ((a.v + b.v) / 2 - a.v * b.v / n.v), 6) as ari from i, a, b, n")
def adjusted_rand(spark, sf_dir) -> DataFrame:
    t = points(spark, sf_dir).groupBy(F.col("label").alias("a"), (F.col("x") > 0).alias("b")).agg(F.count("*").alias("n"))
    pairs = lambda d, name: d.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))
    one = pairs(t, "i").crossJoin(pairs(t.groupBy("a").agg(F.sum("n").alias("n")), "ra")).crossJoin(pairs(t.groupBy("b").agg(F.sum("n").alias("n")), "rb")).crossJoin(t.agg((F.sum("n") * (F.sum("n") - 1) / 2).alias("all")))
    e = F.col("ra") * F.col("rb") / F.col("all")
    return one.select(F.round((F.col("i") - e) / ((F.col("ra") + F.col("rb")) / 2 - e), 6).alias("ari"))


@book.on_view("E9_projection", scores_sql("(select code, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in AMOUNTS) + " from opp)", _SCORES))
def projection(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Two components of the outlier columns, where a missing amount counts as 0."""
    return pca_scores(df.fillna(0.0, cols or AMOUNTS), cols)


def axis_similarity(a: np.ndarray, b: np.ndarray, k: int = 2) -> float:
    """Mean absolute cosine of the first k axes."""
    return float(np.abs((a[:, :k] * b[:, :k]).sum(axis=0)).mean())


@book.on_view("G14_fold_stability")
def fold_stability(df: DataFrame, cols: list[str] | None = None, splits: int = 5) -> DataFrame:
    """Axes of all rows against those without a fold (by key hash), and the first axis' share."""
    cols = cols or AMOUNTS
    _, whole = pca(df, cols)
    rows = []
    for fold in range(splits):
        ev, v = pca(df.where(F.pmod(F.xxhash64("code"), F.lit(splits)) != fold), cols)
        rows.append((fold, axis_similarity(whole, v), float(ev[0] / ev.sum())))
    return df.sparkSession.createDataFrame(rows, "fold int, axis_similarity double, first_share double")


@book.on_view("G15_drift")
def drift(df: DataFrame, cols: list[str] | None = None, date: str = "registered_at") -> DataFrame:
    """Older rows against newer ones, cut at the median date: axis similarity, how far the mean scores on the older axes move, and how much the newer rows' distances to the centre differ on the two pairs of axes."""
    cols = cols or AMOUNTS
    known = df.dropna(subset=[*cols, date])
    at = F.unix_micros(F.col(date).cast("timestamp"))
    cut = known.agg(F.percentile(at, 0.5).alias("c")).first()["c"]
    if cut is None:
        return df.sparkSession.createDataFrame([], "axis int, axis_similarity double, mean_shift double, distance_discrepancy double")
    (_, v), (_, w) = (pca(known.where(half), cols) for half in (at <= cut, at > cut))
    z = standardise(known, cols).withColumn("new", at > cut)
    means = z.agg(*(F.avg(F.when(F.col("new") == new, F.col(c))).alias(f"{c}_{int(new)}") for c in cols for new in (False, True))).first()
    gap = np.array([(means[f"{c}_1"] or 0.0) - (means[f"{c}_0"] or 0.0) for c in cols])
    moved = distance_discrepancy(known.where(at > cut), cols, v, w)
    rows = [(a + 1, axis_similarity(v, w), float(gap @ v[:, a]), float(moved)) for a in range(min(2, len(cols)))]
    return df.sparkSession.createDataFrame(rows, "axis int, axis_similarity double, mean_shift double, distance_discrepancy double")


@book.on_tables("H13_angles", f"with {_P}, c as (select label, var_samp(x) as a, var_samp(y) as d, covar_samp(x, y) as b from p group by 1) select label, round(degrees(0.5 * atan2(2 * b, a - d)), 4) as angle from c")
def angles(spark, sf_dir) -> DataFrame:
    """Direction of the major half-axis of every ellipse in degrees."""
    c = points(spark, sf_dir).groupBy("label").agg(F.var_samp("x").alias("a"), F.var_samp("y").alias("d"), F.covar_samp("x", "y").alias("b"))
    return c.select("label", F.round(F.degrees(0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("d"))), 4).alias("angle"))


@book.on_view("G4_individual_cos2", scores_sql("opp", "select code, " + ", ".join(f"round(coalesce(list_dot_product(v, (select v from axis where a = {a})) ** 2 / nullif(list_dot_product(v, v), 0), 0), 6) as cos2_F{a}" for a in (1, 2)) + " from z"))
def individual_cos2(df: DataFrame, cols: list[str] | None = None, k: int = 2) -> DataFrame:
    """Squared cosines of the rows on the first axes: squared scores over the squared length."""
    cols = cols or AMOUNTS
    _, v = pca(df, cols)
    z = standardise(df.dropna(subset=cols), cols)
    length = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    score = lambda a: sum((F.col(c) * float(v[i, a]) for i, c in enumerate(cols)), F.lit(0.0))
    return z.select("code", *(F.round(F.coalesce(F.try_divide(score(a) * score(a), length), F.lit(0.0)), 6).alias(f"cos2_F{a + 1}") for a in range(k)))


def distance_discrepancy(df: DataFrame, cols: list[str], v: np.ndarray, w: np.ndarray, k: int = 2) -> float:
    """Mean relative difference of the distances to the centre in two projections."""
    z = standardise(df.dropna(subset=cols), cols)
    away = lambda m: F.sqrt(sum((sum((F.col(c) * float(m[i, a]) for i, c in enumerate(cols)), F.lit(0.0)) ** 2 for a in range(k)), F.lit(0.0)))
    return z.agg(F.avg(F.try_divide(F.abs(away(v) - away(w)), away(v)))).first()[0] or 0.0


@book.on_view("G14_fold_summary")
def fold_summary(df: DataFrame, cols: list[str] | None = None, splits: int = 5) -> DataFrame:
    """Mean and deviation over the folds of axis similarity, first-axis share and distance discrepancy. All folds come from one pass of sums per fold, which are subtracted from the total."""
    cols = cols or AMOUNTS
    d = df.dropna(subset=cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = d.groupBy(F.pmod(F.xxhash64("code"), F.lit(splits)).alias("fold")).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)), *(F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"q{i}_{j}") for i, j in pairs)).collect()

    def axes_of(rows):
        n = sum(r["n"] for r in rows)
        s = np.array([sum(r[f"s{i}"] for r in rows) for i in range(len(cols))]) / n
        q = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            q[i, j] = q[j, i] = sum(r[f"q{i}_{j}"] for r in rows) / n - s[i] * s[j]
        scale = np.sqrt(np.maximum(np.diag(q), 1e-12))
        vals, vecs = np.linalg.eigh(q / np.outer(scale, scale))
        vals, vecs = vals[::-1], vecs[:, ::-1]
        return vals, vecs * np.sign(vecs[np.abs(vecs).argmax(axis=0), np.arange(len(cols))])

    _, whole = axes_of(sums)
    found = []
    for r in sums:
        ev, v = axes_of([x for x in sums if x["fold"] != r["fold"]])
        found.append((axis_similarity(whole, v), float(ev[0] / ev.sum()), distance_discrepancy(d, cols, whole, v)))
    a = np.array(found)
    spread = a.std(axis=0, ddof=1) if len(a) > 1 else np.zeros(3)
    rows = [(name, round(float(m), 6), round(float(s), 6)) for name, m, s in zip(("axis_similarity", "first_share", "distance_discrepancy"), a.mean(axis=0), spread)]
    return df.sparkSession.createDataFrame(rows, "measure string, mean double, std double")
