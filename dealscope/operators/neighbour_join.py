"""Exact nearest-neighbour join at any size: pivots cut space into cells, distances to the pivot cut cells into rings, and a point is compared only with rings that bounds leave open.

1. Equal points are one node that knows its ``k + 1`` smallest ids. A node that has all of them is near enough to itself: it seeks no others, but is found by them.
2. A hash sample gives pivots (at most PIVOTS, about the square root of the nodes). Nodes go to their nearest pivot's cell and are dealt by range of
   (cell, distance), so a unit is a run of about ``block`` nodes of one cell between two distances, however dense the cell. Units number at most
   UNITS: beyond, they grow. Their bounds are the only thing all tasks get.
3. Bound: a node's k-th neighbour is no further than its k-th within its own unit, or, in a unit of fewer nodes, than the k-th least way over a pivot to a cell's innermost nodes.
4. Visits: a unit is visited if the triangle inequality (distance to its pivot against its ring) and the plane between the two
   pivots leave room within that bound. Visitors are sent to the unit's owners (several by salt where many visit) and stream past the unit's nodes.

Distances are those of direct differences in double precision; equal ones rank by id. Bounds are widened by the rounding error of the products
they come from, so nothing is lost to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cut

PIVOTS, UNITS, BLOCK, NEAREST, VISITS = 2048, 1 << 18, 1024, 6, 1 << 15
_UNIT = "unit bigint, salt int, kind int, nodes array<bigint>, xs array<double>, bound array<double>, sizes array<int>, home bigint"


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances from direct differences."""
    out = np.empty((len(x), len(y)))
    if x.shape[1] <= 8:  # a dimension at a time, in blocks that stay in cache
        step = max(1, (1 << 16) // max(1, len(y)))
        x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
        room = np.empty((step, y.shape[1]))
        for at in range(0, len(out), step):
            total = out[at : at + step]
            gap = room[: len(total)]
            for i in range(len(x)):
                np.subtract(x[i, at : at + step, None], y[i, None, :], out=gap if i else total)
                if i:
                    total += np.multiply(gap, gap, out=gap)
                else:
                    np.multiply(total, total, out=total)
            np.sqrt(total, out=total)
        return out if len(x) else np.zeros_like(out)
    step = max(1, (1 << 20) // max(1, y.size))
    for at in range(0, len(x), step):
        d = x[at : at + step, None, :] - y[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _rough(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from products, and by how much each may be off."""
    nx, ny = (x**2).sum(axis=1)[:, None], (y**2).sum(axis=1)[None, :]
    error = 4e-16 * (x.shape[1] + 4) * (nx + ny)
    square = np.maximum(nx + ny - 2 * x @ y.T, 0)
    return np.sqrt(square), np.sqrt(square + error) - np.sqrt(np.maximum(square - error, 0))


def _flat(scalar, width: int) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _list(parts: list[np.ndarray], kind) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else [], kind))


class Cells:
    """Pivots, and ring bounds of all units: what every task knows."""

    def __init__(self, pivots: np.ndarray):
        self.centre = pivots.mean(axis=0)
        self.pivots = pivots
        self.between = exact_distances(pivots, pivots) if len(pivots) <= 512 else _rough(pivots - self.centre, pivots - self.centre)[0]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot, and the exact distance to it."""
        cell = _rough(x - self.centre, self.pivots - self.centre)[0].argmin(axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))

    def learn(self, units: list, inner: list) -> None:
        """Units (unit, cell, low, high) by cell; of each cell the distances of its innermost nodes."""
        units = sorted(units, key=lambda r: (r["cell"], r["low"]))
        self.unit, self.cell = np.array([r["unit"] for r in units], np.int64), np.array([r["cell"] for r in units], np.int64)
        self.low, self.high = np.array([r["low"] for r in units]), np.array([r["high"] for r in units])
        self.first = np.searchsorted(self.cell, np.arange(len(self.pivots) + 1))
        self.inner = {r["cell"]: np.array(r["inner"]) for r in inner}

    def bounds(self, x: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the distance to the k-th other node, by way of pivots."""
        out = np.full(len(x), np.inf)
        way, off = _rough(x - self.centre, self.pivots - self.centre)
        way += off
        known = np.array(sorted(self.inner))
        for i in range(len(x)):
            near = known[np.argsort(way[i, known])]
            held = np.cumsum([len(self.inner[c]) for c in near])
            take = near[: max(NEAREST, int(np.searchsorted(held, k + 1)) + 1)]
            ways = np.concatenate([way[i, c] + self.inner[c] for c in take])
            if len(ways) > k:  # one of them may be the node itself
                out[i] = np.partition(ways, k)[k]
        return out

    def visits(self, x: np.ndarray, cell: int, bound: np.ndarray):
        """(unit, which of the nodes visit it)."""
        way, off = _rough(x - self.centre, self.pivots - self.centre)
        own, slack = way[:, cell], off + 1e-12 * (1 + way)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (way**2 - own[:, None] ** 2) / (2 * self.between[cell][None, :]) - 2 * (slack + slack[:, [cell]]) * (1 + (way + own[:, None]) / self.between[cell][None, :])
        plane[:, self.between[cell] == 0] = 0
        for c in np.flatnonzero((plane <= bound[:, None]).any(axis=0)):
            open_ = np.flatnonzero(plane[:, c] <= bound)
            a, b = self.first[c], self.first[c + 1]
            d, e = way[open_, c][:, None], slack[open_, c][:, None] + bound[open_][:, None]
            room = (d - self.high[a:b] <= e) & (self.low[a:b] - d <= e)
            for u in np.flatnonzero(room.any(axis=0)):
                yield int(self.unit[a + u]), open_[room[:, u]]


def _units(known, width: int, block: int):
    """Runs of nodes of one cell, which come sorted by distance to its pivot."""

    def work(batches):
        unit = TaskContext.get().partitionId() << 32
        nodes, xs, cells, away, seek, sizes = [], [], [], [], [], []

        def made(rows):
            nonlocal unit
            n, x, c, d, w, z = rows
            for cell in np.unique(c):
                own = np.flatnonzero(c == cell)
                for part in np.array_split(own, -(-len(own) // block)):
                    yield unit, int(cell), float(d[part[0]]), float(d[part[-1]]), n[part], x[part].ravel(), d[part], w[part], z[part]
                    unit += 1

        def batch(rows):
            u, c, lo, hi, n, x, d, w, z = zip(*rows)
            lists = [_list(n, pa.int64()), _list(x, pa.float64()), _list(d, pa.float64()), _list(w, pa.bool_()), _list(z, pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(c, pa.int32()), pa.array(lo), pa.array(hi), *lists], ["unit", "cell", "low", "high", "nodes", "xs", "away", "seek", "sizes"])

        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            nodes.append(b.column(0).to_numpy()), xs.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            cells.append(b.column(2).to_numpy()), away.append(b.column(3).to_numpy())
            seek.append(b.column(4).to_numpy(zero_copy_only=False)), sizes.append(b.column(5).to_numpy())
            held += b.num_rows
            if held >= 4 * block:
                yield batch(made([np.concatenate(v) for v in (nodes, xs, cells, away, seek, sizes)]))
                nodes, xs, cells, away, seek, sizes, held = [], [], [], [], [], [], 0
        if held:
            yield batch(made([np.concatenate(v) for v in (nodes, xs, cells, away, seek, sizes)]))

    return work


def _sent(known, width: int, k: int, radius: float | None):
    """Each unit's nodes with their bounds (the radius, if there is one), addressed to the units they visit."""

    def work(batches):
        cells: Cells = known.value
        for b in batches:
            for i in range(b.num_rows):
                cell, nodes, there = b.column(0)[i].as_py(), b.column(1)[i].values.to_numpy(), _flat(b.column(2)[i], width)
                seek, home = b.column(3)[i].values.to_numpy(zero_copy_only=False), b.column(5)[i].as_py()
                nodes, x, sizes = nodes[seek], there[seek], b.column(4)[i].values.to_numpy()[seek]
                if not len(x):
                    continue
                if radius is not None:
                    bound = np.full(len(x), radius)
                elif len(there) > k:
                    bound = np.partition(exact_distances(x, there), k, axis=1)[:, k]  # the node itself is among these
                else:
                    bound = cells.bounds(x, k)
                got = list(cells.visits(x, cell, bound))
                for at in range(0, len(got), 256):
                    part = got[at : at + 256]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([u for u, _ in part], pa.int64()), pa.array(np.zeros(n), pa.int32()), pa.array(np.ones(n), pa.int32()), _list([nodes[v] for _, v in part], pa.int64()), _list([x[v].ravel() for _, v in part], pa.float64()), _list([bound[v] for _, v in part], pa.float64()), _list([sizes[v] for _, v in part], pa.int32()), pa.array(np.full(n, home), pa.int64())],
                        ["unit", "salt", "kind", "nodes", "xs", "bound", "sizes", "home"],
                    )

    return work


_PACKED = "home bigint, nodes array<bigint>, own array<int>, counts array<int>, to array<bigint>, distance array<double>, n array<int>"


def _compared(width: int, k: int | None):
    """Visitors, sorted behind the unit they visit, with all nodes within their bound; with ``k`` their nearest of these, packed for the unit they come from."""

    def work(batches):
        here = there = sizes = None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                nodes, x = b.column(1)[i].values.to_numpy(), _flat(b.column(2)[i], width)
                if b.column(0)[i].as_py() == 0:
                    here, there, sizes = nodes, x, b.column(4)[i].values.to_numpy()
                    continue
                bound, began = b.column(3)[i].values.to_numpy(), len(out)
                for at in range(0, len(x), 512):
                    d = exact_distances(x[at : at + 512], there)
                    d[nodes[at : at + 512, None] == here[None, :]] = np.inf
                    limit = bound[at : at + 512]
                    if k is not None and len(here) > k:  # ties with the k-th stay: they rank by id
                        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                    row, col = np.nonzero(d <= (limit * (1 + 1e-12))[:, None])
                    ok = np.isfinite(d[row, col])
                    out.append((nodes[at + row[ok]], here[col[ok]], d[row[ok], col[ok]], sizes[col[ok]]) if k is None else (np.bincount(row[ok], minlength=len(d)).astype(np.int32), here[col[ok]], d[row[ok], col[ok]], sizes[col[ok]]))
                if k is not None:
                    counts, *found = (np.concatenate(v) for v in zip(*out[began:]))
                    lists = zip((nodes, b.column(4)[i].values.to_numpy(), counts, *found), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(5)[i].as_py()], pa.int64()), *(_list([v], t) for v, t in lists)], ["home", "nodes", "own", "counts", "to", "distance", "n"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], ["node", "to", "distance", "n"])

    return work


def tasks(df: DataFrame) -> int:
    """Partitions for what is few bytes and much work, which Spark would put together by their bytes."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _classes(d: DataFrame, k: int) -> DataFrame:
    """(x, ids, size): the k + 1 smallest ids of each point, and how many rows share it."""
    near = d.repartition(tasks(d), "x").withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("_r") <= k + 1)
    return near.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def visited(classes: DataFrame, k: int, block: int = BLOCK, radius: float | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Units of the nodes (node, x; size and whether they seek, if they say so), the visitors of each unit, and the points' dimensions: for k neighbours, or for all within a radius."""
    spark = classes.sparkSession
    classes = classes.select("node", "x", *(F.col(c) if c in classes.columns else F.lit(v).alias(c) for c, v in (("seek", True), ("size", 1))))
    n = classes.count()
    many = max(1, min(PIVOTS, int(math.sqrt(n) / 2)))
    pivots = np.array([r["x"] for r in classes.orderBy(F.xxhash64("node"), "node").limit(many).collect()], np.float64)
    cells, width = Cells(pivots), pivots.shape[1]
    known = spark.sparkContext.broadcast(cells)

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                cell, away = known.value.place(x)
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(cell, pa.int32()), pa.array(away), *b.columns[2:]], ["node", "x", "cell", "away", "seek", "size"])

    block = max(block, -(-n // UNITS))
    placed = classes.mapInArrow(place, "node bigint, x array<double>, cell int, away double, seek boolean, size int")
    dealt = placed.repartitionByRange(max(1, -(-n // (4 * block))), "cell", "away", "node").sortWithinPartitions("cell", "away", "node")
    units = cut(dealt.mapInArrow(_units(known, width, block), "unit bigint, cell int, low double, high double, nodes array<bigint>, xs array<double>, away array<double>, seek array<boolean>, sizes array<int>"))
    inner = units.select("cell", F.explode(F.slice("away", 1, k + 1)).alias("d")).withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("r") <= k + 1)
    cells.learn(units.select("unit", "cell", "low", "high").collect(), inner.groupBy("cell").agg(F.sort_array(F.collect_list("d")).alias("inner")).collect())  # at most UNITS and PIVOTS x (k + 1)
    bounds = spark.sparkContext.broadcast(cells)
    return units, cut(units.select("cell", "nodes", "xs", "seek", "sizes", "unit").mapInArrow(_sent(bounds, width, k, radius), _UNIT)), width


def _met(units: DataFrame, visitors: DataFrame, width: int, k: int | None) -> DataFrame:
    """(node, to, distance, n), packed by the visitors' own unit if k is given: every visitor against the nodes of the units it visits, and their sizes. Owners of much visited units are several."""
    load = visitors.groupBy("unit").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("nodes")) / VISITS)).cast("int").alias("salts"))
    owners = units.join(load, "unit").select("unit", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "nodes", "xs", F.array().cast("array<double>").alias("bound"), "sizes", F.lit(0).cast("long").alias("home"))
    coming = visitors.join(load, "unit").select("unit", F.pmod(F.xxhash64(F.col("nodes")[0]), "salts").cast("int").alias("salt"), "kind", "nodes", "xs", "bound", "sizes", "home")
    many = max(tasks(units), -(-units.count() // 16))
    met = owners.union(coming).repartition(many, "unit", "salt").sortWithinPartitions("unit", "salt", "kind").select("kind", "nodes", "xs", "bound", "sizes", "home")
    return met.mapInArrow(_compared(width, k), "node bigint, to bigint, distance double, n int" if k is None else _PACKED)


def within(points: DataFrame, radius: float, block: int = BLOCK) -> DataFrame:
    """(node, to, distance): all pairs of different rows (node, x) within the radius, both ways."""
    if not points.limit(1).count():
        return points.sparkSession.createDataFrame([], "node bigint, to bigint, distance double")
    units, visitors, width = visited(points, 0, block, radius)
    return _met(units, visitors, width, None).select("node", "to", "distance")


def _points(df: DataFrame, key: str, features: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x")).where("x is not null and id is not null")


def grouped(d: DataFrame, k: int) -> DataFrame:
    """(node, x, ids) of rows (id, x), stored: equal points are one node, named by their smallest id."""
    return cut(_classes(d, k).select(F.col("ids")[0].alias("node"), "x", "ids"))


def _ranked(k: int, answer):
    """What ``answer`` makes of the visitors of a unit, which come together: node, to, distance, n, before, tied, alone, need, own, sorted by node and rank."""

    def rank(rows):
        node, own = (np.repeat(np.concatenate([r[c] for r in rows]), np.concatenate([r[2] for r in rows])) for c in (0, 1))
        to, distance, n = (np.concatenate([r[c] for r in rows]) for c in (3, 4, 5))
        order = np.lexsort((to, distance, node))
        node, own, to, distance, n = node[order], own[order], to[order], distance[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.diff(node, prepend=node[0] - 1) if len(node) else node)
        keep = np.arange(len(node)) - np.repeat(first, np.diff(first, append=len(node))) < k
        node, own, to, distance, n = node[keep], own[keep], to[keep], distance[keep], n[keep]
        if not len(node):
            return
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        tie = new.copy()
        tie[1:] |= distance[1:] != distance[:-1]
        total, first, at = np.cumsum(n) - n, np.flatnonzero(new), np.flatnonzero(tie)
        size = np.diff(at, append=len(node))
        before = np.repeat(total[at], size) - np.repeat(total[first], np.diff(first, append=len(node)))
        tied, alone, need = np.repeat(np.add.reduceat(n, at), size), np.repeat(size == 1, size), k + 1 - own.astype(np.int64)
        keep = before < need
        if keep.any():
            yield answer(*(v[keep] for v in (node, to, distance, n, before, tied, alone, need, own)))

    def work(batches):
        home, rows = None, []
        for b in batches:
            for i in range(b.num_rows):
                if (h := b.column(0)[i].as_py()) != home:
                    if rows:
                        yield from rank(rows)
                    home, rows = h, []
                rows.append([b.column(c)[i].values.to_numpy() for c in range(1, 7)])
        if rows:
            yield from rank(rows)

    return work


def _nearest(classes: DataFrame, k: int, block: int, answer, schema: str) -> DataFrame:
    own = F.size("ids")
    units, visitors, width = visited(classes.select("node", "x", (own <= k).alias("seek"), own.alias("size")), k, block)
    return _met(units, visitors, width, k).repartition(max(tasks(units), -(-units.count() // 16)), "home").sortWithinPartitions("home").mapInArrow(_ranked(k, answer), schema)


def nearest_nodes(classes: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(node, to, distance, n, before, tied, alone, need): the other nodes that hold the ``need`` ids which a row of ``node`` lacks beside its own point; ``n`` ids each,
    ``before`` of them strictly nearer, ``tied`` at this distance, where ``alone`` tells whether one node holds them.

    The nearest ids are among the nearest nodes, as every node has an id and is ranked by its smallest; so nothing is expanded into ids before this ranking."""
    names = ["node", "to", "distance", "n", "before", "tied", "alone", "need"]
    return _nearest(classes, k, block, lambda *v: pa.RecordBatch.from_arrays([pa.array(c) for c in v[:8]], names), "node bigint, to bigint, distance double, n bigint, before bigint, tied bigint, alone boolean, need bigint")


def nearest_counts(classes: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(node, s, to, distance, n), stored: for a row of each seeking node, how many of its ``k`` nearest others lie at which other node, and the ids (up to k + 1) of its own.

    Ids decide only where several nodes tie for the last places."""

    def lists(node, to, distance, n, before, tied, alone, need, own):
        torn = ~alone & (before + tied > need)
        first = np.flatnonzero(np.diff(node, prepend=node[0] - 1))
        cut_ = lambda v, some: [p[q] for p, q in zip(np.split(v, first[1:]), np.split(some, first[1:]))]
        n = np.minimum(n, need - before).astype(np.int32)
        parts = [_list(cut_(v, some), t) for v, some, t in ((to, ~torn, pa.int64()), (distance, ~torn, pa.float64()), (n, ~torn, pa.int32()), (to, torn, pa.int64()), (distance, torn, pa.float64()), ((need - before).astype(np.int32), torn, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(own[first], pa.int32()), *parts], ["node", "s", "to", "distance", "n", "torn", "at", "left"])

    kind = "node bigint, s int, to array<bigint>, distance array<double>, n array<int>, torn array<bigint>, at array<double>, left array<int>"
    found = cut(_nearest(classes, k, block, lists, kind))
    plain, open_ = found.drop("torn", "at", "left"), found.where("size(torn) > 0")
    if not open_.limit(1).count():
        return plain
    ids = open_.select("node", F.explode(F.arrays_zip("torn", "at", "left")).alias("o")).select("node", F.col("o.torn").alias("to"), F.col("o.at").alias("distance"), "o.left")
    ids = ids.join(classes.select(F.col("node").alias("to"), "ids"), "to").select("node", "distance", "to", "left", F.explode("ids").alias("id"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where("r <= left").groupBy("node", "distance", "to").agg(F.count("*").cast("int").alias("n"))
    last = ids.groupBy("node").agg(F.collect_list(F.struct("to", "distance", "n")).alias("last"))
    more = open_.select(*plain.columns).join(last, "node").select("node", "s", *(F.concat(c, F.col(f"last.{c}")).alias(c) for c in ("to", "distance", "n")))
    return found.where("size(torn) = 0").drop("torn", "at", "left").union(cut(more))


def to_rows(d: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """(id, columns) of every row (id, x) from those of its class (node, x, ids): rows that share a point take them by it, and a point of many rows is dealt over salts."""
    shared = classes.where("size(ids) > 1").select("x", *columns, F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    copies = d.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(shared, ["x", "salt"]).select("id", *columns)
    return classes.where("size(ids) = 1").select(F.col("node").alias("id"), *columns).union(copies)


def neighbours(df: DataFrame, k: int, key: str = "id", features: str = "x", block: int = BLOCK) -> DataFrame:
    """(id, other, distance, rank): the k nearest others of every row, by distance, then id. Rows without a point are left out; exact whatever the number of rows."""
    d = _points(df, key, features)
    classes = grouped(d, k)
    schema = "id bigint, other bigint, distance double, rank int"
    if not classes.limit(1).count():
        return df.sparkSession.createDataFrame([], schema)
    found = nearest_nodes(classes, k, block)
    # nodes stand for all their ids
    ids = found.join(classes.select(F.col("node").alias("to"), "ids"), "to").select("node", "distance", "need", F.explode("ids").alias("other"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("distance", "other"))
    others = ids.withColumn("r", rank).where("r <= need").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("others"))
    lists = classes.join(others, "node", "left").select("node", "x", "ids", F.coalesce("others", F.array().cast("array<struct<distance:double,other:bigint>>")).alias("others"))
    rows = to_rows(d, lists, "ids", "others")
    same = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(0.0).alias("distance"), i.alias("other")))
    return rows.select("id", F.posexplode(F.slice(F.concat(same, "others"), 1, k)).alias("rank", "n")).select("id", "n.other", "n.distance", (F.col("rank") + 1).alias("rank"))
