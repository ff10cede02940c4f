"""Local outlier factors where points have many rows and distances tie, and what they leave for the shuffles."""

from collections import Counter

import numpy as np
import pytest

from dealscope.operators import neighbour_join, outliers, vectors


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>")


def factors(ids, x, k):
    d = neighbour_join.exact_distances(x, x)
    order = [[j for j in np.lexsort((ids, d[i])) if j != i][:k] for i in range(len(x))]
    kth = np.array([d[i, o[-1]] for i, o in enumerate(order)])
    lrd = np.array([1 / (np.maximum(d[i, o], kth[o]).mean() + 1e-10) for i, o in enumerate(order)])
    return {int(ids[i]): (lrd[o] / lrd[i]).mean() for i, o in enumerate(order)}


def test_factors_of_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    base = np.concatenate([np.round(rng.normal(0, 1, (60, 2)), 1), rng.normal(4, 1, (40, 2)), np.array([[a, b] for a in range(6) for b in range(6)]) + 9.0])
    x = np.repeat(base, rng.integers(1, 9, len(base)), axis=0)
    ids = rng.permutation(len(x)) * 5
    got = {r["id"]: r["lof"] for r in vectors.local_outlier_factor(frame(spark, ids, x), 5).collect()}
    want = factors(ids, x, 5)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_copies_are_not_expanded(spark):
    base = np.random.default_rng(7).normal(size=(150, 3))
    for copies, most in ((30, 0), (6, 150 * 4)):  # k = 20: all neighbours at the point itself, or at three to four points
        x = np.repeat(base, copies, axis=0)
        classes = neighbour_join.grouped(frame(spark, np.arange(len(x)), x), 20)
        assert neighbour_join.nearest_nodes(classes, 20).count() <= most


def test_flags_score_prepared_points_only(spark, monkeypatch):
    seen = []
    whole = outliers.local_outlier_factor
    monkeypatch.setattr(outliers, "local_outlier_factor", lambda *a: seen.append(1) or whole(*a))
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(40)], "code long, revenue double, cost double")
    assert outliers.model_flags(df, ["revenue", "cost"]).count() == 40
    assert len(seen) == 1


def test_quality_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAIRS", 100_000)
    rng = np.random.default_rng(8)
    x, own = rng.normal(size=(1200, 2)), rng.integers(0, 3, 1200)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, own))], "id long, x array<double>, label long").coalesce(1)
    stats = vectors.pair_stats(df)
    got = {r["id"]: r["silhouette"] for r in vectors.silhouettes(stats).collect()}
    assert stats.rdd.getNumPartitions() == 15  # 1200 x 1200 pairs, 100,000 to a task
    d = neighbour_join.exact_distances(x, x)
    for i in range(0, 1200, 97):
        mean = [d[i, own == k].sum() / ((own == k).sum() - (own[i] == k)) for k in range(3)]
        a, b = mean[own[i]], min(m for k, m in enumerate(mean) if k != own[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_top_outliers_from_one_pass(spark, monkeypatch):
    rows = [(i, f"c{i % 7}", f"e{i % 3}", i % 7 < 3 or i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "code long, client string, entity string, multi boolean")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(outliers, "with_flags", lambda d: d.mapInArrow(counted, d.schema))
    got = [(r.level, r.name, r.n) for r in outliers.top_outliers(df).collect()]
    want = []
    for level, at in (("client", 1), ("entity", 2)):
        n = Counter(r[at] for r in rows if r[3])
        want += [(level, k, v) for k, v in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:5]]
    assert sorted(got) == sorted(want) and read.value == len(rows)


@pytest.mark.parametrize("few", [100_000, 0])
def test_flags_by_point_equal_factors_of_rows(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "FEW", few)
    rng = np.random.default_rng(9)
    base = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(0, 9, (25, 2))])
    x = np.repeat(base, rng.integers(1, 4, len(base)), axis=0)
    rows = [(int(i) * 3, float(a), None if i % 9 == 0 else float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "code long, revenue double, cost double")
    p = outliers.points(df, ["revenue", "cost"])
    want = {f: {r["id"]: r["lof"] > outliers.LOF_SCORE for r in vectors.local_outlier_factor(p.select("id", p[f].alias("x"))).collect()} for f in ("raw", "prepared")}
    got = outliers.density_flags(df, ["revenue", "cost"]).collect()
    assert len(got) == len(rows)
    for f in want:
        assert {r["id"]: r[f"lof_{f}"] for r in got} == want[f] and 0 < sum(want[f].values()) < len(rows)
    f = {r["code"]: r for r in outliers.model_flags(df, ["revenue", "cost"]).collect()}
    assert {k: r["b"] for k, r in f.items()} == want["prepared"]
    scores = {r["id"]: r["score"] for r in vectors.isolation_forest(p, "id", "prepared").collect()}
    assert {k: r["a"] for k, r in f.items()} == {k: v > outliers.FOREST_SCORE for k, v in scores.items()}
    side = {r["code"] for r in outliers_of(df)}
    assert {k for k, r in f.items() if r["u"]} == side


def outliers_of(df):
    from dealscope.operators.profile import iqr_outliers

    return iqr_outliers(df, ["revenue", "cost"]).collect()


def test_flags_do_not_shuffle_rows(spark):
    """Rows meet forests, fences and outlying points where they are."""
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(400)], "code long, revenue double, cost double")
    for flags in (outliers.forest_flags, outliers.density_flags, outliers.model_flags):
        plan = flags(df, ["revenue", "cost"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, flags


def test_quality_of_points_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    x, own = rng.normal(size=(90, 2)) + np.repeat([[0, 0], [6, 0], [0, 6]], 30, axis=0), np.repeat(range(3), 30)
    df = spark.createDataFrame([(i, (v + 1e7).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, own))], "id long, x array<double>, label long")
    got = vectors.overall(vectors.pair_stats(df))
    d, same = neighbour_join.exact_distances(x, x), own[:, None] == own
    a = np.where(same, d, 0).sum(axis=1) / 29
    b = np.min([np.where(own == k, np.inf, d[:, own == k].mean(axis=1)) for k in range(3)], axis=0)
    score = (b - a) / np.maximum(a, b)
    assert (got["m"], got["s"], got["n"]) == (pytest.approx(score.mean(), abs=1e-7), pytest.approx(score.std(ddof=1), abs=1e-7), 90)
    assert got["dunn"] == pytest.approx(d[~same].min() / d[same].max(), rel=1e-6)


def test_neighbour_search_is_dealt_by_work(spark):
    """Few bytes, much work: what adaptive execution would put into one task stays dealt out, and a node's neighbours are one row."""
    x = np.random.default_rng(5).normal(size=(3000, 2))
    classes = neighbour_join.grouped(frame(spark, np.arange(3000), x), 5)
    units, visitors, width = neighbour_join.visited(classes.select("node", "x"), 5, block=64)
    assert neighbour_join._met(units, visitors, width, 5).rdd.getNumPartitions() >= neighbour_join.tasks(classes)
    near = neighbour_join.nearest_counts(classes, 5, block=64)
    assert near.count() == 3000 and near.select("to").first()["to"] is not None
