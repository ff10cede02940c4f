"""Exact neighbour join, density clusters and cluster quality against all pairs in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealscope.operators import density, neighbour_join, vectors


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>")


def nearest(ids, x, k):
    d, out = neighbour_join.exact_distances(x, x), {}
    for i in range(len(x)):
        order = np.lexsort((ids, d[i]))
        out[int(ids[i])] = [(int(ids[j]), float(d[i, j])) for j in order[order != i][:k]]
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    # three densities, a third of all rows in one point, and a lattice full of ties
    return np.concatenate([rng.normal(c, s, (900, 3)) for c, s in ((0, 0.3), (5, 0.1), (-7, 1.0))] + [np.full((1700, 3), 2.0), np.round(rng.normal(0, 1, (600, 3)), 1)])


def test_neighbours_equal_all_pairs(spark, cloud):
    ids = np.random.default_rng(1).permutation(len(cloud))
    got = {}
    for r in neighbour_join.neighbours(frame(spark, ids, cloud), 10, block=64).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["distance"]))
    assert {i: [(o, d) for _, o, d in sorted(v)] for i, v in got.items()} == nearest(ids, cloud, 10)


def test_few_units_are_visited(spark):
    x = np.random.default_rng(2).normal(size=(5000, 2))
    nodes = frame(spark, np.arange(5000), x).withColumnRenamed("id", "node")
    units, visitors, _ = neighbour_join.visited(nodes, 5, block=64)
    assert units.count() >= 70
    per_node = visitors.agg(F.sum(F.size("nodes"))).first()[0] / 5000
    assert per_node < 12  # of 80 units and more: about 700 candidates of 5000


@pytest.mark.parametrize("n", (0, 1, 3))
def test_fewer_points_than_neighbours(spark, n):
    x = np.arange(n * 2.0).reshape(n, 2)
    df = frame(spark, np.arange(n), x).union(spark.createDataFrame([(99, None), (None, [0.0, 0.0])], "id long, x array<double>"))
    got = {(r["id"], r["other"]) for r in neighbour_join.neighbours(df, 5).collect()}
    assert got == {(i, j) for i in range(n) for j in range(n) if i != j}


def clusters(ids, x, eps, least):
    near = neighbour_join.exact_distances(x, x) <= eps
    core = near.sum(axis=1) >= least
    label = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], np.iinfo(np.int64).max).min(axis=1), label)
        if (new == label).all():
            break
        label = new
    reach = np.where(near & core[None, :], label[None, :], np.iinfo(np.int64).max).min(axis=1)
    kind = np.where(core, "core", np.where((near & core[None, :]).any(axis=1), "border", "noise"))
    return {int(i): (str(k), int(r) if k != "noise" else -1) for i, k, r in zip(ids, kind, reach)}


@pytest.mark.parametrize("eps", (0.05, 0.4))
def test_density_clusters_equal_all_pairs(spark, cloud, monkeypatch, eps):
    monkeypatch.setattr(density, "ROWS", 50)  # dense cells in many blocks
    ids = np.random.default_rng(3).permutation(len(cloud)) * 3
    got = {r["id"]: (r["kind"], r["label"]) for r in density.dbscan(frame(spark, ids, cloud), eps).collect()}
    assert got == clusters(ids, cloud, eps, 5)


def test_no_points_no_clusters(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0])], "id long, x array<double>")
    assert density.dbscan(df, 0.5).count() == 0


def quality(x, own):
    d = neighbour_join.exact_distances(x, x)
    out = []
    for i in range(len(x)):
        mean = {k: (d[i, own == k].sum() / ((own == k).sum() - (own[i] == k)) if (own == k).sum() > (own[i] == k) else None) for k in set(own.tolist())}
        a, b = mean[own[i]], min(v for k, v in mean.items() if k != own[i])
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return out


@pytest.mark.parametrize("anchors", (8192, 120))
def test_every_row_has_a_silhouette(spark, anchors):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.5, (n, 4)) for c, n in ((0, 300), (3, 150), (6, 1))])
    own = np.repeat([0, 1, 2], [300, 150, 1])
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, own))] + [(999, [0.0] * 4, None), (998, None, 1)], "id long, x array<double>, label long")
    got = {r["id"]: r["silhouette"] for r in vectors.silhouettes(vectors.pair_stats(df, anchors=anchors)).collect()}
    want = quality(x, own)
    assert sorted(got) == list(range(451))
    assert max(abs(got[i] - want[i]) for i in range(451)) < (1e-9 if anchors > 451 else 0.2)
    square = {r["id"]: r["silhouette"] for r in vectors.squared_silhouettes(df).collect()}
    d2 = neighbour_join.exact_distances(x, x) ** 2
    for i in (0, 299, 300, 449):
        a = d2[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d2[i, own == k].mean() for k in (0, 1, 2) if k != own[i])
        assert square[i] == pytest.approx((b - a) / max(a, b))
    assert square[450] == 0.0 and len(square) == 451
    assert vectors.pair_stats(df.limit(0)).count() == 0
