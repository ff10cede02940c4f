"""Clustering (H1-H9, H11, H12, H16, H17): sweeps, density and graph clusters, quality, tables of methods and versions."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.roles import AMOUNTS, LEVELS, Book, read
from .factor import GROUPS, _kept, _mixed, _whole, famd, mca, mfa, principal, trustworthiness, versions
from .density import dbscan
from .neighbour_join import neighbours
from .sparse import lanczos
from .vectors import axes, centroid_scores, cut, moments, overall_by, pair_stats, point_stats, projected, qualities, silhouettes, squared_silhouettes

book = Book()
KS = (2, 3, 4)


def embedded(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))


def reduced(df: DataFrame, k: int = 5) -> DataFrame:
    """The first principal coordinates, as the new ``x``."""
    _, mean, cov = moments(df)
    return projected(df, mean, axes(cov)[1][:, :k]).drop("x").withColumnRenamed("f", "x")


def spectral_coordinates(df: DataFrame, k: int, neighbour_count: int = 10) -> DataFrame:
    """(id, x, u): the ``k`` leading eigenvectors of the normalised graph of nearest neighbours, over the roots of the degrees.

    Edges weigh 1 if both points name each other (the point itself counts among its ``neighbour_count``), else 1/2; the graph is a table of edges at any size."""
    near = neighbours(df, neighbour_count - 1).select(F.col("id").alias("a"), F.col("other").alias("b"))
    graph = cut(near.union(near.select("b", "a")).groupBy("a", "b").agg((F.count("*") / 2).alias("w")))
    degree = cut(graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree")))
    root = lambda n: degree.select(F.col("node").alias(n), F.sqrt("degree").alias(f"r{n}"))
    entries = cut(graph.join(root("a"), "a").join(root("b"), "b").select("a", "b", (F.col("w") / (F.col("ra") * F.col("rb"))).alias("s")))
    _, u = lanczos(entries, degree.select("node", F.lit(0.0).alias("c")), k, tolerance=1e-7)
    scaled = u.join(root("node"), "node").select(F.col("node").alias("id"), F.transform("u", lambda v: v / F.col("rnode")).alias("u"))
    return df.select("id", "x").join(scaled, "id")


def labels(df: DataFrame, algorithm: str, k: int, seed: int = 7) -> DataFrame:
    """(id, x, label) by one algorithm; "graph" is k-means on spectral coordinates (``u``, made here if the rows have none)."""
    return labels_of(df, algorithm, (k,), seed).select("id", "x", F.col(f"k{k}").alias("label"))


def labels_of(df: DataFrame, algorithm: str, ks: tuple[int, ...], seed: int = 7) -> DataFrame:
    """(id, x) and a column ``k2`` .. of labels for each number of clusters."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.functions import array_to_vector

    if algorithm == "graph":
        base = df if "u" in df.columns else cut(spectral_coordinates(df, max(ks)))
        at = lambda k: F.slice("u", 1, k)
    else:  # the bisecting kind splits along the length of the centre, so centred points are moved away from the origin
        base, at = df.select("id", "x"), lambda k: F.transform("x", lambda c: c + 1)
    out = base
    for k in ks:
        make = {"gmm": GaussianMixture(featuresCol="v", k=k, seed=seed, maxIter=30), "bisecting": BisectingKMeans(featuresCol="v", k=k, seed=seed)}.get(algorithm, KMeans(featuresCol="v", k=k, seed=seed))
        model = make.fit(base.withColumn("v", array_to_vector(at(k))))
        placed = model.transform(out.withColumn("v", array_to_vector(at(k))))
        out = placed.select(*out.columns, F.col("prediction").cast("long").alias(f"k{k}"))
    return out.select("id", "x", *(f"k{k}" for k in ks))


ALGORITHMS = ("kmeans", "gmm", "bisecting", "graph")


def curve(df: DataFrame, algorithm: str, ks=KS) -> list[tuple]:
    """(algorithm, k, silhouette, low, high, dunn, calinski_harabasz, inverse Davies-Bouldin) of each k; the distances are worked out once for all of them."""
    out, got = [], cut(labels_of(df, algorithm, tuple(ks)))
    for k, s in zip(ks, qualities(got, *(f"k{k}" for k in ks))):
        ch, db = centroid_scores(got, label=f"k{k}")
        m, s_, n, dunn = (s["m"], s["s"], s["n"], s["dunn"]) if s else (None, 0.0, 0, None)
        half = 1.96 * s_ / max(n, 1) ** 0.5
        out.append((algorithm, k, m, *((m - half, m + half) if s else (None, None)), dunn, ch, 1 / db if db else None))
    return out


CURVE = "algorithm string, k int, silhouette double, low double, high double, dunn double, calinski_harabasz double, inverse_davies_bouldin double"


def best_k(table: DataFrame, metrics=("silhouette", "dunn", "calinski_harabasz", "inverse_davies_bouldin"), by: str = "algorithm") -> DataFrame:
    """The k with the greatest mean of the metrics, each scaled to 0..1 over the k of an algorithm (a constant metric counts 0)."""
    w = Window.partitionBy(by)
    scaled = [F.coalesce(F.try_divide(F.col(m) - F.min(m).over(w), F.max(m).over(w) - F.min(m).over(w)), F.lit(0.0)) for m in metrics]
    s = table.withColumn("score", sum(scaled) / len(metrics))
    return s.groupBy(by).agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"), F.max("score").alias("score"))


def _round(df: DataFrame, n: int = 5) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


for _key, _algorithm in (("H1_kmeans_sweep", "kmeans"), ("H2_gmm_sweep", "gmm"), ("H3_bisecting_sweep", "bisecting"), ("H4_graph_sweep", "graph")):

    @book.on_tables(_key)
    def sweep(spark, sf_dir, algorithm=_algorithm) -> DataFrame:
        """Silhouette of each k, and the best (2 if none has a value)."""
        rows = [r[:3] for r in curve(cut(reduced(embedded(spark, sf_dir))), algorithm)]
        known = [r for r in rows if r[2] is not None]
        best = max(known, key=lambda r: r[2])[1] if known else 2
        return _round(spark.createDataFrame([(*r, r[1] == best) for r in rows], "algorithm string, k int, silhouette double, best boolean"))


@book.on_tables("H6_curve")
def all_curves(spark, sf_dir) -> DataFrame:
    x = cut(reduced(embedded(spark, sf_dir)))
    return _round(spark.createDataFrame([r for a in ALGORITHMS for r in curve(x, a)], CURVE))


@book.on_tables("H8_best_k")
def best_by_curve(spark, sf_dir) -> DataFrame:
    x = cut(reduced(embedded(spark, sf_dir)))
    return _round(best_k(spark.createDataFrame(curve(x, "kmeans") + curve(x, "bisecting"), CURVE)))


@book.on_tables("H12_labels_by_k")
def labels_by_k(spark, sf_dir) -> DataFrame:
    """Long table of labels per algorithm and k."""
    x, out = cut(reduced(embedded(spark, sf_dir))), None
    for a in ("kmeans", "gmm", "bisecting"):
        for k in KS:
            part = labels(x, a, k).select("id", F.lit(a).alias("algorithm"), F.lit(k).alias("k"), "label")
            out = part if out is None else out.union(part)
    return out


_CORE = "near as (select a.id, b.id as other from p a join p b on list_distance(a.x, b.x) <= {eps}), core as (select id from near group by 1 having count(*) >= 5) select p.id, case when p.id in (select id from core) then 'core' when exists (select 1 from near join core on core.id = near.other where near.id = p.id) then 'border' else 'noise' end as kind from p"
_FLAT = "with p as (select vec_id as id, embedding[1:{d}]::double[] as x from embeddings), "
_CLUSTERS = _FLAT.replace("with p", "with recursive p") + """near as (select a.id, b.id as other from p a join p b on list_distance(a.x, b.x) <= {eps}), core as (select id from near group by 1 having count(*) >= 5),
  edge as (select n.id, n.other from near n join core a on a.id = n.id join core b on b.id = n.other), reach as (select id, id as r from core union select reach.id, edge.other from reach join edge on edge.id = reach.r),
  label as (select id, min(r) as label from reach group by 1), border as (select n.id, min(l.label) as label from near n join label l on l.id = n.other group by 1)
  select p.id, coalesce(l.label, b.label, -1)::bigint as label from p left join label l on l.id = p.id left join border b on b.id = p.id"""

for _name, _d, _eps in (("H5_dbscan_kinds", 2, 0.2), ("H5_dbscan_kinds_5d", 5, 0.45)):

    @book.on_tables(_name, _FLAT.format(d=_d) + _CORE.format(eps=_eps))
    def dbscan_kinds(spark, sf_dir, d: int = _d, eps: float = _eps) -> DataFrame:
        return dbscan(embedded(spark, sf_dir).withColumn("x", F.slice("x", 1, d)), eps).select("id", "kind")


@book.on_tables("H5_dbscan_labels", _CLUSTERS.format(d=5, eps=0.45))
def dbscan_labels(spark, sf_dir) -> DataFrame:
    return dbscan(embedded(spark, sf_dir).withColumn("x", F.slice("x", 1, 5)), 0.45).select("id", "label")


@book.on_tables("H5_dbscan_sweep")
def dbscan_sweep(spark, sf_dir, radii=(0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Clusters, noise and silhouette (without noise) of each radius over two standardised coordinates; best is the greatest silhouette of two clusters or more."""
    x = reduced(embedded(spark, sf_dir), 2)
    _, mean, cov = moments(x)
    x = cut(projected(x, mean, np.diag(1 / np.sqrt(np.maximum(np.diag(cov), 1e-12)))).drop("x").withColumnRenamed("f", "x"))
    rows = []
    for eps in radii:
        got = cut(dbscan(x, eps))
        n = got.agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k"), F.count(F.when(F.col("label") < 0, 1)).alias("noise")).first()
        s = qualities(got.where("label >= 0"), "label")[0]["m"] if n["k"] > 1 else None
        rows.append((eps, n["k"], n["noise"], s))
    known = [r for r in rows if r[3] is not None]
    best = max(known, key=lambda r: r[3])[0] if known else None
    return _round(spark.createDataFrame([(*r, r[0] == best) for r in rows], "eps double, clusters long, noise long, silhouette double, best boolean"))


_D = "s as (select vec_id as id, label::bigint as label, embedding::double[] as x from embeddings where label is not null), d as (select a.id, a.label, b.label as other, list_distance(a.x, b.x) as d from s a join s b on a.id <> b.id)"
_SIL = f"{_D}, m as (select id, label, other, avg(d) as m from d group by 1, 2, 3), ab as (select id, label, max(m) filter (other = label) as a, min(m) filter (other <> label) as b from m group by 1, 2), sil as (select id, label, coalesce((b - a) / greatest(a, b), 0) as silhouette from ab)"


@book.on_tables("H7_silhouette_points", f"with {_SIL} select id, label, round(silhouette, 4) as silhouette from sil")
def silhouette_points(spark, sf_dir) -> DataFrame:
    return _round(silhouettes(pair_stats(embedded(spark, sf_dir))), 4)


_SQUARED = """with e as (select vec_id as id, label::bigint as label, unnest(embedding::double[]) as v, unnest(range(len(embedding))) as j from embeddings where label is not null), p as (select id, label, sum(v * v) as q from e group by 1, 2),
  m as (select label as other, count(*) as n, sum(q) as q from p group by 1), c as (select label as other, j, sum(v) as s from e group by 1, 2), x as (select e.id, c.other, sum(e.v * c.s) as d from e join c using (j) group by 1, 2),
  t as (select p.id, p.label, m.other, m.n, greatest(m.n * p.q - 2 * x.d + m.q, 0) as t from p join x using (id) join m using (other)), ab as (select id, label, max(t / (n - 1)) filter (other = label and n > 1) as a, min(t / n) filter (other <> label) as b from t group by 1, 2)
  select id, label, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 4) as silhouette from ab"""


@book.on_tables("H7_silhouette_squared", _SQUARED)
def squared_points(spark, sf_dir) -> DataFrame:
    """Silhouettes with squared distances: exact for every row at any size."""
    return _round(squared_silhouettes(embedded(spark, sf_dir)), 4)


@book.on_tables("H7_quality", f"""with {_SIL}, e as (select vec_id as id, label, unnest(embedding::double[]) as v, unnest(range(len(embedding))) as j from embeddings), c as (select label, j, avg(v) as c from e group by 1, 2), g as (select j, avg(v) as g from e group by 1),
  n as (select label, count(*) as n from embeddings group by 1), p as (select e.id, e.label, sqrt(sum((v - c) ** 2)) as d, sum((v - c) ** 2) as w from e join c using (label, j) group by 1, 2), b as (select sum(n * (c - g) ** 2) as b from c join g using (j) join n using (label)),
  sp as (select label, avg(d) as s from p group by 1), r as (select x.label, max((x.s + y.s) / d) as r from sp x join sp y on x.label <> y.label join (select a.label as la, b.label as lb, sqrt(sum((a.c - b.c) ** 2)) as d from c a join c b using (j) group by 1, 2) q on q.la = x.label and q.lb = y.label group by 1)
  select round((select avg(silhouette) from sil), 4) as silhouette, round((select min(d) filter (other <> label) / max(d) filter (other = label) from d), 4) as dunn,
    round((select b from b) / ((select count(*) from n) - 1) / ((select sum(w) from p) / ((select sum(n) from n) - (select count(*) from n))), 3) as calinski_harabasz, round((select avg(r) from r), 4) as davies_bouldin""")
def quality(spark, sf_dir) -> DataFrame:
    """All indices of given labels on all dimensions."""
    e = embedded(spark, sf_dir)
    ch, db = centroid_scores(e)
    s = overall_by(point_stats(e)[0]).select(F.round("m", 4).alias("silhouette"), F.round("dunn", 4).alias("dunn"))
    return s.select("*", F.lit(round(ch, 3)).alias("calinski_harabasz"), F.lit(round(db, 4)).alias("davies_bouldin"))


@book.on_tables("H9_intra_inter", f"with {_D}, s2 as (select id, label, x[1:2] as x from s), d2 as (select a.id, a.label, b.label as other, list_distance(a.x, b.x) as d from s2 a join s2 b on a.id <> b.id) select space, round(avg(d) filter (label = other), 4) as intra, round(avg(d) filter (label <> other), 4) as inter from (select 'original' as space, label, other, d from d union all select 'reduced', label, other, d from d2) group by 1")
def intra_inter(spark, sf_dir) -> DataFrame:
    """Mean distances within and between clusters, in all dimensions and in two, over every row."""
    e, out = embedded(spark, sf_dir), None
    for name, d in (("original", e), ("reduced", e.withColumn("x", F.slice("x", 1, 2)))):
        mean = lambda total, n: F.round(F.sum(F.col("copies") * F.col(total)) / F.sum(F.col("copies") * F.col(n)), 4)
        part = point_stats(d)[0].agg(mean("within", "same").alias("intra"), mean("between", "others").alias("inter")).select(F.lit(name).alias("space"), "intra", "inter")
        out = part if out is None else out.union(part)
    return out


@book.on_tables("H10_all_dimensions", "with e as (select label, unnest(embedding::double[]) as v, unnest(range(len(embedding))) as dimension from embeddings) select label, dimension::bigint as dimension, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std from e group by 1, 2")
def all_dimensions(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dimension", "v"))
    return e.groupBy("label", F.col("dimension").cast("long").alias("dimension")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.stddev(F.col("v").cast("double")), 6).alias("std"))


@book.on_tables("H11_segmented")
def segmented(spark, sf_dir, k: int = 3) -> DataFrame:
    """Rows with their first coordinates and one cluster column per algorithm."""
    e = embedded(spark, sf_dir)
    x = cut(reduced(e))
    out = e.select("id", "label").join(x.select("id", F.round(F.col("x")[0], 5).alias("F1"), F.round(F.col("x")[1], 5).alias("F2")), "id")
    for a in ALGORITHMS:
        out = out.join(labels(x, a, k).select("id", F.col("label").alias(f"cluster_{a}")), "id", "left")
    return out


def _method_row(spark, name: str, points: DataFrame, full: DataFrame, inertia: list[float]) -> tuple:
    began = time.time()
    rows = curve(points, "kmeans", (2, 3))
    best = max(rows, key=lambda r: (r[2] if r[2] is not None else -1))
    t = trustworthiness(full.join(points.select("id", F.col("x").alias("f")), "id")).first()
    share = inertia[0] if inertia else 0.0
    return (name, sum(inertia[:2]), sum(v > 100 / max(len(inertia), 1) for v in inertia), best[2], best[5], best[6], best[7], t["trustworthiness"], t["continuity"], time.time() - began, best[1], "kmeans", share > 50)


_METHODS = "method string, cumulative double, kaiser int, silhouette double, dunn double, calinski_harabasz double, inverse_davies_bouldin double, trustworthiness double, continuity double, seconds double, k int, algorithm string, dominated boolean"


def method_table(df: DataFrame) -> DataFrame:
    """Methods side by side: variance of two axes, axes above the mean, cluster quality, neighbourhood quality, runtime, and whether the first axis dominates (over 50 %)."""
    d = _whole(df)
    full, _ = _mixed(d, AMOUNTS, LEVELS, "code")
    full = full.withColumnRenamed("code", "id")
    rows = []
    for name, made in (("famd", lambda: famd(d, AMOUNTS, LEVELS)), ("mca", lambda: mca(d, LEVELS)), ("mfa", lambda: mfa(d, GROUPS)[0])):
        f = made()
        points = cut(f.scores.select(F.col("code").alias("id"), F.array("F1", "F2").alias("x")))
        rows.append(_method_row(df.sparkSession, name, points, full, [r["pct"] for r in f.inertia.orderBy("axis").collect()]))
    return df.sparkSession.createDataFrame(rows, _METHODS)


@book.on_view("H16_method_table")
def methods(df: DataFrame) -> DataFrame:
    return _round(method_table(df).drop("seconds"), 4)


@book.on_view("H17_versions")
def version_table(df: DataFrame) -> DataFrame:
    """The principal projection and its clusters over every dataset version."""
    rows = []
    for name, d in versions(_kept(df, AMOUNTS)).items():
        scores, vals = principal(d.fillna(0.0, AMOUNTS), 2)
        points = cut(scores.select(F.col("code").alias("id"), F.array("F1", "F2").alias("x")))
        best = curve(points, "kmeans", (3,))[0]
        rows.append((name, points.count(), float(100 * vals[:2].sum() / max(vals.sum(), 1e-12)), best[2], best[6]))
    return _round(df.sparkSession.createDataFrame(rows, "dataset_version string, rows long, cumulative double, silhouette double, calinski_harabasz double"), 4)
