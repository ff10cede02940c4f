"""Search over models and parameters (I10): successive halving over expanding folds by time, where candidates share scans.

The fold is a column: part 0 only trains, part j tests what the parts before it train. All linear candidates of a rung, in all their folds, take a Newton step
in the same scan, which adds up their gradients and curvatures inside the tasks; only matrices of the features' width meet on the driver. Tree candidates are fitted by
Spark, each fold once. After a rung, on more folds each, the worse half of the candidates goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLDS, STEPS, BINS = 5, 8, 1_000_000


def with_parts(v: DataFrame, at, folds: int = FOLDS) -> DataFrame:
    """``part`` 0..folds: equal shares of the rows in the order of ``at``, whose values (days, months) are few; rows of one value stay together."""
    counts = v.groupBy(at.alias("_at")).agg(F.count("*").alias("_n"))
    ran = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_at")))  # one row per day or month
    whole = counts.agg(F.sum("_n").alias("_all"))
    part = F.least(F.floor((F.col("_upto") - 1) * (folds + 1) / F.col("_all")), F.lit(folds)).cast("int")
    placed = ran.crossJoin(F.broadcast(whole)).select("_at", part.alias("part"))
    return v.withColumn("_at", at).join(F.broadcast(placed), "_at").drop("_at")


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return np.concatenate([np.ones((len(x), 1)), x], axis=1), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()


def newton(v: DataFrame, width: int, jobs: list[tuple[float, int]], steps: int = STEPS) -> np.ndarray:
    """Weights (intercept first) of the logistic models (L2 penalty, first part that is not trained on), from rows (x, y, weight, part); a scan per step for all of them.

    Minimises the weighted mean loss plus penalty / 2 times the squared weights without the intercept."""
    beta, p = np.zeros((len(jobs), width + 1)), width + 1
    for _ in range(steps):
        now = beta.copy()

        def work(batches, now=now):
            total = np.zeros((len(jobs), 1 + p + p * p))
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, w, part = _rows(b)
                for i, (_, fold) in enumerate(jobs):
                    own = part < fold
                    xi, wi = x[own], w[own]
                    s = 1 / (1 + np.exp(-np.clip(xi @ now[i], -500, 500)))
                    total[i, 0] += wi.sum()
                    total[i, 1 : 1 + p] += xi.T @ (wi * (s - y[own]))
                    total[i, 1 + p :] += (xi.T @ (xi * (wi * s * (1 - s))[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

        parts = v.select("x", "y", "weight", "part").mapInArrow(work, "v array<double>").select(F.posexplode("v").alias("i", "v"))
        flat = np.zeros(len(jobs) * (1 + p + p * p))
        for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r["i"]] = r["v"]
        for i, t in enumerate(flat.reshape(len(jobs), -1)):
            if t[0] <= 0:
                continue
            ridge = np.full(p, jobs[i][0])
            ridge[0] = 0.0
            gradient, curve = t[1 : 1 + p] / t[0] + ridge * beta[i], t[1 + p :].reshape(p, p) / t[0] + np.diag(ridge + 1e-9)
            move = np.linalg.solve(curve, gradient)
            beta[i] -= move * min(1.0, 10.0 / max(np.linalg.norm(move), 1e-12))  # separable folds have no end point
    return beta


def linear_scores(v: DataFrame, beta: np.ndarray, jobs: list[tuple[float, int]]) -> DataFrame:
    """(job, score, y, n): how many rows of its fold's test part have a score, to six digits, counted inside the tasks; one scan for all jobs."""

    def work(batches):
        for b in batches:
            out = []
            x, y, _, part = _rows(b) if b.num_rows else (np.zeros((0, 1)),) + (np.zeros(0),) * 3
            for i, (_, fold) in enumerate(jobs):
                own = part == fold
                s = np.round(BINS / (1 + np.exp(-np.clip(x[own] @ beta[i], -500, 500)))).astype(np.int64)
                cell, n = np.unique(2 * s + y[own].astype(np.int64), return_counts=True)
                out.append((np.full(len(cell), i), cell // 2, cell % 2, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["job", "score", "y", "n"])

    return v.select("x", "y", "weight", "part").mapInArrow(work, "job bigint, score bigint, y bigint, n bigint")


def areas(counts: DataFrame) -> dict[int, float]:
    """AUC by average ranks of (job, score, y, n); a job without both classes has none. A window sees at most BINS + 1 scores of a job."""
    by = counts.groupBy("job", "score").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"))
    w = Window.partitionBy("job").orderBy("score")
    ranked = by.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / 2)
    t = ranked.groupBy("job").agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    t = t.where("p > 0 and p < n").select("job", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))
    return {r["job"]: r["auc"] for r in t.collect()}


def halving(v: DataFrame, candidates: list[tuple[str, dict]], trees, folds: int = FOLDS) -> list[tuple[str, dict, int, int, float | None]]:
    """(model, parameters, rung, folds, mean AUC) of all candidates, from rows (v, x, y, weight, part): "logistic" with ``penalty`` here, others by ``trees(model, parameters)``.

    Rungs see 2, then 4, then all folds, the last ones being the largest; candidates that leave keep the mean of their last rung."""
    from pyspark.ml.functions import vector_to_array

    width = len(v.select("x").first()["x"])
    table, alive, seen = {}, list(range(len(candidates))), {}
    sizes = sorted({min(2, folds), min(4, folds), folds})
    for rung, size in enumerate(sizes):
        use = range(1, size + 1)
        linear = [(c, f) for c in alive for f in use if candidates[c][0] == "logistic" and (c, f) not in seen]
        if linear:
            jobs = [(float(candidates[c][1]["penalty"]), f) for c, f in linear]
            found = areas(linear_scores(v, newton(v, width, jobs), jobs))
            seen |= {key: found.get(i) for i, key in enumerate(linear)}
        for c in alive:
            for f in use:
                if (c, f) in seen:
                    continue
                train, test = v.where(F.col("part") < f), v.where(F.col("part") == f)
                if train.select("y").distinct().count() < 2:
                    seen[c, f] = None
                    continue
                score = F.round(vector_to_array("probability")[1] * BINS).cast("long").alias("score")
                told = trees(*candidates[c]).fit(train).transform(test).select(F.lit(0).cast("long").alias("job"), score, F.col("y").cast("long").alias("y"), F.lit(1).cast("long").alias("n"))
                seen[c, f] = areas(told).get(0)
        for c in alive:
            known = [seen[c, f] for f in use if seen[c, f] is not None]
            table[c] = (*candidates[c], rung, len(known), sum(known) / len(known) if known else None)
        if rung < len(sizes) - 1:
            alive = sorted(alive, key=lambda c: (-(table[c][4] if table[c][4] is not None else -1.0), c))[: max(1, -(-len(alive) // 2))]
    return [table[c] for c in range(len(candidates))]
