"""Shared Newton scans, AUC and successive halving against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealscope.operators import halving


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [1.5, -1.0, 0.0] + 0.3)))).astype(float)
    w = np.where(y == 1, 0.7, 1.4)
    df = spark.createDataFrame([(v.tolist(), float(a), float(b), i) for i, (v, a, b) in enumerate(zip(x, y, w))], "x array<double>, y double, weight double, day long")
    return x, y, w, halving.with_parts(df, F.floor(F.col("day") / 10)).cache()


def direct(x, y, w, penalty):
    z, beta = np.concatenate([np.ones((len(x), 1)), x], axis=1), np.zeros(x.shape[1] + 1)
    ridge = np.r_[0, np.full(x.shape[1], penalty)]
    for _ in range(60):
        s = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z.T * (w * s * (1 - s))) @ z / w.sum() + np.diag(ridge), z.T @ (w * (s - y)) / w.sum() + ridge * beta)
    return beta


def auc(score, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]])


def test_parts_are_equal_shares_in_time(rows):
    got = rows[3].groupBy("part").agg(F.count("*").alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi")).orderBy("part").collect()
    assert [r["n"] for r in got] == [100] * 6 and all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))


def test_linear_jobs_equal_their_own_fits(rows):
    x, y, w, df = rows
    jobs = [(0.01, 1), (1.0, 3), (0.1, 5)]
    beta = halving.newton(df, 3, jobs)
    for b, (penalty, fold) in zip(beta, jobs):
        assert b == pytest.approx(direct(x[: 100 * fold], y[: 100 * fold], w[: 100 * fold], penalty), abs=1e-6)
    areas = halving.areas(halving.linear_scores(df, beta, jobs))
    for i, (_, fold) in enumerate(jobs):
        at = slice(100 * fold, 100 * fold + 100)
        assert areas[i] == pytest.approx(auc(beta[i, 0] + x[at] @ beta[i, 1:], y[at]), abs=1e-4)


def test_a_fold_of_one_class_has_no_area(rows):
    df = rows[3].withColumn("y", F.when(F.col("part") == 2, 1.0).otherwise(F.col("y")))
    jobs = [(0.1, 2), (0.1, 3)]
    assert set(halving.areas(halving.linear_scores(df, halving.newton(df, 3, jobs), jobs))) == {1}


def test_worse_candidates_leave_early(rows):
    calls = []
    table = halving.halving(rows[3], [("logistic", {"penalty": p}) for p in (0.01, 0.1, 1000.0, 5000.0)], lambda *a: calls.append(a))
    assert not calls and [r[2:4] for r in table][2:] != [(2, 5)] * 2
    assert sum(r[2] == 2 for r in table) == 1 and all(0.5 < r[4] < 1 for r in table)
