"""Density clusters (DBSCAN) without a table of point pairs, in any number of dimensions.

Space is a grid of side ``eps / sqrt(d)``: all points of a cell are within eps of each other, so a cell of ``min_samples``
points is core as a whole and only points of thinner cells are counted. Occupied cells near enough to matter come from
a range join of cell centres, so the empty neighbours of a cell cost nothing whatever the dimension. Points
travel as blocks of a cell (a dense cell is dealt over several), and two blocks meet in one task that returns counts, a yes, or the
least label, never pairs. Cells are merged by their first blocks; only pairs of cells still in different clusters compare all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut
from .neighbour_join import exact_distances, within

ROWS = 1024


def spanning_labels(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that edges (a, b) reach; labels fall to those of neighbours, then to the labels of labels, until none falls."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        step = label.join(near, "id").select("id", F.least("label", "l").alias("label"))
        new = cut(step.join(label.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label")))
        if not new.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count():
            return new
        label = new


def _blocks(points: DataFrame) -> DataFrame:
    """(cell, part, ids, xs) of rows (cell, part, id, x)."""
    return points.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "x")).alias("r")).select("cell", "part", F.col("r.id").alias("ids"), F.flatten("r.x").alias("xs"))


def _near(pairs: DataFrame, eps: float, width: int, answer: str) -> DataFrame:
    """From rows (key, ids, xs, ys): "count" (id, n) of points ys within eps of each id, "any" (key) where some are, "least" (id, label) with the key where some are."""

    def work(batches):
        for b in batches:
            ids, found = [], []
            for i in range(b.num_rows):
                x, y = (b.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(-1, width) for c in (2, 3))
                n = np.zeros(len(x), np.int64)
                for at in range(0, len(x), ROWS):
                    n[at : at + ROWS] = (exact_distances(x[at : at + ROWS], y) <= eps).sum(axis=1)
                if answer == "any":
                    if n.any():
                        ids.append(np.array([b.column(0)[i].as_py()])), found.append(np.ones(1, np.int64))
                    continue
                hit = n > 0
                ids.append(b.column(1)[i].values.to_numpy()[hit])
                found.append(n[hit] if answer == "count" else np.full(hit.sum(), b.column(0)[i].as_py()))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(found), pa.int64())], ["id", "v"])

    return pairs.mapInArrow(work, "id bigint, v bigint")


def dbscan(df: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """(id, x, kind, label) of points (id, x): core points by count of points within eps (themselves included), clusters of core points by their smallest id;
    border points take the least such cluster, noise is -1. Rows without a point are left out."""
    d = df.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x is not null and id is not null")
    first = d.select(F.size("x").alias("n")).first()
    schema = "id long, x array<double>, kind string, label long"
    if first is None:
        return df.sparkSession.createDataFrame([], schema)
    width = first["n"]
    side = eps / math.sqrt(width) * (1 - 1e-9)
    keyed = d.withColumn("key", F.transform("x", lambda v: F.floor(v / side).cast("long")))
    cells = cut(keyed.groupBy("key").agg(F.min("id").alias("cell"), F.count("*").alias("n")))
    points = cut(keyed.join(cells, "key").select("id", "x", "cell", "n", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ROWS)).alias("part")))
    # cells that can hold points within eps of each other: boxes no further apart than that, so centres within twice
    centres = cells.select(F.col("cell").alias("node"), F.transform("key", lambda c: (c + 0.5) * side).alias("x"))
    box = F.aggregate(F.zip_with("p", "q", lambda a, b: F.greatest(F.abs(a - b) - 1, F.lit(0)).cast("double") * side), F.lit(0.0), lambda s, v: s + v * v)
    close = within(centres, 2 * eps * (1 + 1e-9)).select(F.col("node").alias("a"), F.col("to").alias("b"))
    keys = cells.select("cell", "key", "n")
    close = close.join(keys.select(F.col("cell").alias("a"), F.col("key").alias("p"), F.col("n").alias("na")), "a").join(keys.select(F.col("cell").alias("b"), F.col("key").alias("q")), "b")
    close = cut(close.where(box <= eps * eps * (1 + 1e-9)).select("a", "b", "na"))
    blocks = cut(_blocks(points))
    left = lambda b, *keep: b.select(F.col("cell").alias("a"), *keep)
    right = lambda b: b.select(F.col("cell").alias("b"), F.col("xs").alias("ys"))
    # counts of the points of thin cells
    thin = close.where(F.col("na") < min_samples).select("a", "b")
    met = thin.join(left(blocks, "ids", "xs"), "a").join(right(blocks), "b").select(F.col("b").alias("key"), "ids", "xs", "ys")
    others = _near(met, eps, width, "count").groupBy("id").agg(F.sum("v").alias("v"))
    ready = cut(points.join(others, "id", "left").withColumn("core", F.col("n") + F.coalesce("v", F.lit(0)) >= min_samples).drop("v"))
    core = cut(_blocks(ready.where("core")))
    name = cut(ready.where("core").groupBy("cell").agg(F.min("id").alias("least")))
    # cells of one cluster: first blocks, then all blocks of what is still apart
    pairs = close.where("a < b").join(name.select(F.col("cell").alias("a"), F.col("least").alias("la")), "a").join(name.select(F.col("cell").alias("b"), F.col("least").alias("lb")), "b").select("a", "b", "la", "lb")
    pairs = cut(pairs.withColumn("key", F.monotonically_increasing_id()))

    def joined(some: DataFrame, b: DataFrame) -> DataFrame:
        rows = some.join(left(b, "ids", "xs"), "a").join(right(b), "b").select("key", "ids", "xs", "ys")
        return some.join(_near(rows, eps, width, "any").select(F.col("id").alias("key")).distinct(), "key", "left_semi").select(F.col("la").alias("a"), F.col("lb").alias("b"))

    edges = cut(joined(pairs, core.where("part = 0")))
    label = spanning_labels(edges)
    of = lambda n, c: label.select(F.col("id").alias(n), F.col("label").alias(c))
    apart = pairs.join(of("la", "ca"), "la", "left").join(of("lb", "cb"), "lb", "left").where(F.coalesce("ca", "la") != F.coalesce("cb", "lb")).select("a", "b", "la", "lb", "key")
    more = cut(joined(apart, core))
    label = spanning_labels(edges.union(more)) if more.limit(1).count() else label
    name = cut(name.join(label, name["least"] == label["id"], "left").select("cell", F.coalesce("label", "least").alias("label")))
    # what is not core and near a core point
    rest = _blocks(ready.where("not core"))
    around = close.select("a", "b").union(rest.select("cell", "cell").distinct())
    met = around.join(left(rest, "ids", "xs"), "a").join(right(core), "b").join(name.select(F.col("cell").alias("b"), F.col("label").alias("key")), "b").select("key", "ids", "xs", "ys")
    border = _near(met, eps, width, "least").groupBy("id").agg(F.min("v").alias("near"))
    out = ready.join(name, "cell", "left").join(border, "id", "left")
    kind = F.when(F.col("core"), "core").when(F.col("near").isNotNull(), "border").otherwise("noise")
    return out.select("id", "x", kind.alias("kind"), F.when(F.col("core"), F.col("label")).otherwise(F.coalesce("near", F.lit(-1))).cast("long").alias("label"))
