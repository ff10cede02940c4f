"""Kernels and models against direct computation and known properties."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealscope.functions.columns import quantile_row
from dealscope.operators import cluster, factor, forecast, leads, outliers, pipelines, scorers, vectors


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 4, 4))])
    rows = [(i, v.tolist(), i // 40) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, x array<double>, label long")


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 997).astype(float), rng.normal(size=997)
    df = spark.createDataFrame([(float(x), float(y) if i % 3 else None) for i, (x, y) in enumerate(zip(a, b))], "a double, b double").repartition(7)
    qs = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    row = quantile_row(df, {f"{c}{q}": (c, q) for c in "ab" for q in qs}).first()
    for q in qs:
        assert row[f"a{q}"] == pytest.approx(np.quantile(a, q)) and row[f"b{q}"] == pytest.approx(np.quantile(b[np.arange(997) % 3 > 0], q))
    assert quantile_row(df.limit(0), {"q": ("a", 0.5)}).first()["q"] is None
    # brackets of a sketch: many rows, a third of them equal
    big = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("v"))
    v = np.array([r["v"] for r in big.collect()])
    row = quantile_row(big, {f"q{q}": ("v", q) for q in qs}).first()
    assert [row[f"q{q}"] for q in qs] == pytest.approx([np.quantile(v, q) for q in qs], abs=1e-12)


def test_neighbours_and_density(blobs):
    x, df = blobs
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in vectors.neighbours(df, 5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert all([o for _, o in sorted(got[i])] == want[i].tolist() for i in range(120))
    kth = np.sort(d, axis=1)[:, 4]
    lrd = np.array([1 / (np.maximum(d[i, want[i]], kth[want[i]]).mean() + 1e-10) for i in range(120)])
    lof = {r["id"]: r["lof"] for r in vectors.local_outlier_factor(df, 5).collect()}
    assert all(lof[i] == pytest.approx((lrd[want[i]] / lrd[i]).mean(), rel=1e-5) for i in range(120))


def test_forest_finds_the_far_point(spark, blobs):
    _, df = blobs
    far = df.union(spark.createDataFrame([(999, [30.0, -30.0, 30.0], 0)], df.schema))
    scores = {r["id"]: r["score"] for r in vectors.isolation_forest(far).collect()}
    assert max(scores, key=scores.get) == 999 and scores[999] > 0.6 and len(scores) == 121


def test_outlier_flags_have_every_row(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i == 3 else float(i % 5)) for i in range(60)] + [(99, 1000.0, -1000.0)], "code long, revenue double, cost double")
    flags = {r["code"]: r for r in outliers.model_flags(df, ["revenue", "cost"]).collect()}
    assert len(flags) == 61 and flags[99]["multi"] and flags[99]["any"] and not flags[10]["u"]


def test_cluster_quality_and_sweep(blobs):
    _, df = blobs
    rows = {r[1]: r for r in cluster.curve(df, "kmeans", (2, 3, 4))}
    assert max(rows, key=lambda k: rows[k][2]) == 3 and rows[3][2] > 0.85 and rows[3][3] <= rows[3][2] <= rows[3][4]
    for a in ("gmm", "graph", "bisecting"):
        got = cluster.labels(df, a, 3).join(df.select("id", F.col("label").alias("true")), "id").groupBy("true").agg(F.count_distinct("label").alias("n")).collect()
        assert all(r["n"] == 1 for r in got), a
    best = cluster.best_k(df.sparkSession.createDataFrame(list(rows.values()), cluster.CURVE)).first()
    assert best["k"] == 3


def test_dbscan(spark, blobs):
    _, df = blobs
    far = df.select("id", "x").union(spark.createDataFrame([(999, [30.0, -30.0, 30.0])], "id long, x array<double>"))
    got = {r["id"]: r for r in cluster.dbscan(far, 0.8).collect()}
    assert got[999]["kind"] == "noise" and got[999]["label"] == -1
    assert {got[i]["label"] for i in range(120)} == {0, 40, 80}


def test_factor_methods(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), "xyz"[i % 3], "uv"[int(a > 0)]) for i, (a, b) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(rows, "code long, a double, b double, c string, d string")
    m = factor.mca(df, ["c", "d"])
    total = sum(r["eigenvalue"] for r in m.inertia.collect())
    assert total == pytest.approx(5 / 2 - 1)  # levels over variables, less one
    var = m.scores.agg(F.var_pop("F1").alias("v")).first()["v"]
    assert var == pytest.approx(m.inertia.orderBy("axis").first()["eigenvalue"], rel=1e-6)
    f = factor.famd(df, ["a", "b"], ["c", "d"])
    assert f.loadings.groupBy("axis").agg(F.sum("contribution").alias("s")).first()["s"] == pytest.approx(100)
    with pytest.raises(ValueError, match="missing"):
        factor.famd(df.withColumn("a", F.when(F.col("code") > 1, F.col("a"))), ["a"], ["c"])
    out, groups = factor.mfa(df, {"numbers": ["a", "b"], "levels": ["c", "d"]})
    assert groups.groupBy("axis").agg(F.sum("contribution").alias("s")).first()["s"] == pytest.approx(100)
    assert out.inertia.agg(F.sum("pct").alias("s")).first()["s"] == pytest.approx(100)
    assert {r["variable"] for r in factor.by_variable(f.loadings).collect()} == {"a", "b", "c", "d"}


def test_constant_series_repeats(spark):
    rows = [("flat", dt.date(2020 + i // 12, i % 12 + 1, 28), 5.0) for i in range(24)] + [("line", dt.date(2020 + i // 12, i % 12 + 1, 28), float(i)) for i in range(36)]
    df = spark.createDataFrame(rows, "s string, p date, y double")
    got = forecast.recursive(df, horizon=3).collect()
    assert len(got) == 18 and all(r["pred"] == r["lo"] == r["hi"] == 5.0 for r in got if r["series"] == "flat")
    assert sorted({str(r["p"]) for r in got if r["series"] == "line"}) == ["2023-01-31", "2023-02-28", "2023-03-31"]
    ahead = [r["pred"] for r in sorted((r for r in got if r["series"] == "line" and r["model"] == "trend"), key=lambda r: r["p"])]
    assert ahead == pytest.approx([36, 37, 38], abs=1.5)
    rolled = forecast.rolling_origin(df, ("ar",), test=4).collect()
    assert len(rolled) == 8 and all(r["y"] == r["pred"] for r in rolled if r["series"] == "flat")


def test_recursion_feeds_predictions():
    y = np.array([1.0, 2.0] * 12)
    pred, _ = forecast.autoregressive(y, 12, 4)
    assert pred == pytest.approx([1, 2, 1, 2], abs=1e-6)


def test_preparation_rules(spark):
    with pytest.raises(ValueError, match="missing"):
        pipelines.feature_list(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    assert pipelines.feature_list(spark.createDataFrame([(1, 2)], "a int, status int"), ["", " a", "a", "status"]) == ["a"]
    with pytest.raises(ValueError, match="feature"):
        pipelines.predicted_durations(spark.createDataFrame([(1,)], "a int"), ["x"])
    one = spark.createDataFrame([("train",)], "split string")
    with pytest.raises(ValueError, match="test"):
        pipelines.checked(one)


def test_balancing(spark):
    df = spark.createDataFrame([(i, int(i < 6), [float(i), 1.0]) for i in range(40)], "id long, y int, x array<double>")
    assert {r["y"]: r["count"] for r in scorers.undersample(df, "id", "y").groupBy("y").count().collect()} == {0: 6, 1: 6}
    out = scorers.oversample(df, "id", "y", "x")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 34, 1: 34}
    assert all(0 <= r["x"][0] <= 5 and r["x"][1] == 1.0 for r in out.where("synthetic").collect())


def test_missing_lookup_keys(spark):
    c = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "c_custkey long, c_nationkey int")
    n = spark.createDataFrame([(10, "N", 5)], "n_nationkey int, n_name string, n_regionkey int")
    r = spark.createDataFrame([(6, "R")], "r_regionkey int, r_name string")
    got = {x["c_custkey"]: (x["sector"], x["region"]) for x in leads.enriched(c, n, r).collect()}
    assert got == {1: ("N", "nc"), 2: ("inconnu", "nc"), 3: ("inconnu", "nc")}


@pytest.mark.parametrize("model", ("trend", "ar", "boosted"))
def test_rolling_origins_equal_refits(spark, model):
    """Every origin from running cross-products against a fit of its whole history."""
    rng = np.random.default_rng(6)
    made = {"noisy": 1e6 + 1e5 * rng.normal(size=60) + 2e5 * np.sin(np.arange(60) * np.pi / 6), "line": np.arange(40.0) * 3, "short": rng.normal(size=7), "flat": np.full(20, 4.0), "late": np.r_[np.zeros(25), rng.normal(size=5)], "two": np.array([1.0, 2.0])}
    rows = [(s, dt.date(2015 + i // 12, i % 12 + 1, 1), float(v)) for s, y in made.items() for i, v in enumerate(y)]
    got = {}
    for r in forecast.rolling_origin(spark.createDataFrame(rows, "s string, p date, y double"), (model,), test=12, season=12).orderBy("series", "p").collect():
        got.setdefault(r["series"], []).append((r["y"], r["pred"]))
    for s, y in made.items():
        origins = range(max(1, len(y) - 12), len(y))
        assert [v for v, _ in got[s]] == pytest.approx([y[at] for at in origins])
        assert [v for _, v in got[s]] == pytest.approx([forecast.predict(y[:at], model, 12, 1)[0][0] for at in origins], rel=1e-6, abs=1e-8 * np.abs(y).max())
