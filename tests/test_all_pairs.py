"""Cluster quality beyond one block of points: all pairs count, whatever the number of rows."""

import numpy as np
import pytest

from dealscope.operators import cluster, neighbour_join, vectors


def points(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 1.0, (n, 3)) for c in (0, 2, 5)])
    x[-n // 3 :] = x[-1]  # one point of many rows
    x[:2] = x[-1]  # which other clusters hold too
    return x, np.repeat([0, 1, 7], n)


def frame(spark, x, **labels):
    return spark.createDataFrame([(i, v.tolist(), *(int(o[i]) for o in labels.values())) for i, v in enumerate(x)], "id long, x array<double>, " + ", ".join(f"{c} long" for c in labels))


def want(x, own):
    d, same = neighbour_join.exact_distances(x, x), own[:, None] == own
    a = np.where(same, d, 0).sum(axis=1) / (same.sum(axis=1) - 1)
    b = np.min([np.where(own == k, np.inf, d[:, own == k].mean(axis=1)) for k in np.unique(own)], axis=0)
    return (b - a) / np.maximum(a, b), d[~same].min() / d[same].max()


def test_every_pair_counts_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PACK", 1 << 12)
    x, own = points(200)
    got = {r["id"]: r["silhouette"] for r in vectors.silhouettes(vectors.pair_stats(frame(spark, x, label=own), anchors=50)).collect()}
    assert sorted(got) == list(range(600))
    assert np.abs(np.array([got[i] for i in range(600)]) - want(x, own)[0]).max() < 1e-9


def test_labels_of_several_k_share_their_distances(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ANCHORS", 64)
    x, own = points(100)
    x[:2] += 0.5
    other = np.arange(300) % 2
    for q, labels in zip(vectors.qualities(frame(spark, x, a=own, b=other), "a", "b"), (own, other)):
        score, dunn = want(x, labels)
        assert (q["m"], q["s"], q["n"]) == (pytest.approx(score.mean()), pytest.approx(score.std(ddof=1)), 300)
        assert q["dunn"] == pytest.approx(dunn)


def test_equal_points_of_two_clusters_are_at_zero(spark):
    x = np.full((40, 2), 1e6 / 3)
    q = vectors.qualities(frame(spark, x, label=np.arange(40) % 2), "label")[0]
    assert (q["m"], q["n"], q["dunn"]) == (0.0, 40, None)


def test_curve_counts_all_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ANCHORS", 32)
    x, _ = points(60)
    df = frame(spark, x, label=np.zeros(180))
    for a in cluster.ALGORITHMS:
        rows = cluster.curve(df.select("id", "x"), a, (2, 3))
        for r in rows:
            own = {v["id"]: v["label"] for v in cluster.labels(df, a, r[1]).collect()}
            assert a == "graph" or r[2] == pytest.approx(want(x, np.array([own[i] for i in range(180)]))[0].mean())
        assert [r[1] for r in rows] == [2, 3]
