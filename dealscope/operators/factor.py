"""Factor analysis (G6-G13, G16, H18): correspondence, mixed and multiple analyses from small cross-products, distances, neighbourhood quality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.roles import AMOUNTS, LEVELS, Book, read
from .clean import standardise
from .neighbour_join import neighbours
from .sparse import lanczos
from .vectors import axes, cut, hash_sample, moments, projected

book = Book()
#: up to so many levels the cross-products are one small matrix on the driver; beyond, they stay a table of entries
DENSE = 512


@dataclass
class Factors:
    """Scores (id and F1..Fk), levels or variables (name, axis, coordinate, contribution in percent), inertia (axis, eigenvalue, pct, cumulative)."""

    scores: DataFrame
    loadings: DataFrame
    inertia: DataFrame


def _tables(df: DataFrame, scores: DataFrame, names: list[str], coordinates: np.ndarray, shares: np.ndarray, values: np.ndarray, total: float) -> Factors:
    spark, k = df.sparkSession, coordinates.shape[1]
    rows = [(n, a + 1, float(coordinates[i, a]), float(100 * shares[i, a])) for i, n in enumerate(names) for a in range(k)]
    pct = 100 * values / total if total else values
    table = [(a + 1, float(values[a]), float(pct[a]), float(pct[: a + 1].sum())) for a in range(len(values))]
    return Factors(scores, spark.createDataFrame(rows, "name string, axis int, coordinate double, contribution double"), spark.createDataFrame(table, "axis int, eigenvalue double, pct double, cumulative double"))


def _named(scores: DataFrame, key: str, k: int) -> DataFrame:
    return scores.select(key, *(F.col("f")[a].alias(f"F{a + 1}") for a in range(k)))


def levels_of(df: DataFrame, cols: list[str], unknown: str = "Inconnu") -> tuple[list[str], np.ndarray, int]:
    """Level names (variable__level), their counts, and the number of rows; a missing level is one of its own."""
    each = F.explode(F.array(*(F.concat(F.lit(f"{c}__"), F.coalesce(F.col(c), F.lit(unknown))) for c in cols)))
    rows = df.select(each.alias("v")).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()  # one row per level
    return [r["v"] for r in rows], np.array([r["n"] for r in rows], float), int(sum(r["n"] for r in rows) / max(len(cols), 1))


def indicator(cols: list[str], names: list[str], scale: np.ndarray, centre: np.ndarray | None = None, unknown: str = "Inconnu"):
    """Array column of scaled (and centred) indicators of the levels."""
    own = F.array(*(F.concat(F.lit(f"{c}__"), F.coalesce(F.col(c), F.lit(unknown))) for c in cols))
    return F.transform(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(float(s)).alias("s"), F.lit(float(0 if centre is None else centre[i])).alias("m")) for i, (n, s) in enumerate(zip(names, scale)))), lambda v: (F.array_contains(own, v["n"]).cast("double") - v["m"]) * v["s"])


@dataclass
class Survey:
    """One pass: rows, mean and deviation of each number, and about how many levels each variable has."""

    rows: int
    centre: dict[str, tuple[float, float]]
    levels: dict[str, int]

    def z(self, c: str, scale: float = 1.0):
        m, s = self.centre[c]
        return (F.col(c) - m) / s * scale if s > 0 else F.lit(0.0)


def survey(df: DataFrame, quant: list[str], qual: list[str]) -> Survey:
    """Missing numbers raise."""
    figures = [f(c).alias(f"{n}{i}") for i, c in enumerate(quant) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("k", F.count))]
    r = df.agg(F.count("*").alias("n"), *figures, *(F.approx_count_distinct(F.coalesce(F.col(c), F.lit("Inconnu"))).alias(f"l{j}") for j, c in enumerate(qual))).first()
    if any(r[f"k{i}"] < r["n"] for i in range(len(quant))):
        raise ValueError("missing numbers: impute them first")
    return Survey(r["n"], {c: (float(r[f"m{i}"] or 0.0), float(r[f"s{i}"] or 0.0)) for i, c in enumerate(quant)}, {c: r[f"l{j}"] for j, c in enumerate(qual)})


@dataclass
class Crossed:
    """Sums over the rows for numbers (z-scores) and levels: nodes, their means (shares, for levels) and products (shares of pairs), none of them centred."""

    seen: Survey
    quant: list[str]
    qual: list[str]
    names: list[str]  # numbers, then levels in order
    counts: np.ndarray  # rows of each level
    mean: np.ndarray
    products: np.ndarray

    def of(self, name: str) -> str:
        return name if name in self.quant else max((c for c in self.qual if name.startswith(f"{c}__")), key=len)

    def covariance(self) -> np.ndarray:
        """Of z-scores and of indicators over sqrt(share)."""
        return (self.products - np.outer(self.mean, self.mean)) / np.outer(self.root(), self.root())

    def root(self) -> np.ndarray:
        return np.concatenate([np.ones(len(self.quant)), np.sqrt(np.maximum(self.mean[len(self.quant) :], 1e-12))])

    def scores(self, df: DataFrame, key: str, weight: np.ndarray) -> DataFrame:
        """key, F1..Fk: the weighted z-scores and levels of every row; the few levels go to the rows."""
        m, k = len(self.quant), weight.shape[1]
        out = df.select(key, *(self.seen.z(c).alias(f"_z{i}") for i, c in enumerate(self.quant)), *(F.coalesce(F.col(c), F.lit("Inconnu")).alias(f"_l{j}") for j, c in enumerate(self.qual)))
        for j, c in enumerate(self.qual):
            rows = [(n[len(c) + 2 :], weight[i].tolist()) for i, n in enumerate(self.names) if i >= m and self.of(n) == c]
            out = out.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"_l{j} string, _f{j} array<double>")), f"_l{j}", "left")
        told = lambda a: sum((F.col(f"_z{i}") * float(weight[i, a]) for i in range(m)), F.lit(0.0)) + sum((F.col(f"_f{j}")[a] for j in range(len(self.qual))), F.lit(0.0))
        return out.select(key, *(told(a).alias(f"F{a + 1}") for a in range(k)))

    def centred_scores(self, df: DataFrame, key: str, vectors: np.ndarray) -> DataFrame:
        """The scores of centred z-scores and indicators over sqrt(share) on the vectors."""
        weight = vectors / self.root()[:, None]
        shift = self.mean @ weight
        out = self.scores(df, key, weight)
        return out.select(key, *((F.col(f"F{a + 1}") - float(shift[a])).alias(f"F{a + 1}") for a in range(len(shift))))


def crossed(df: DataFrame, quant: list[str], qual: list[str], seen: Survey) -> Crossed:
    """One pass adds rows up per combination of levels; all cross-products are sums over the combinations. Pairs of levels and numbers reach the driver."""
    m, n = len(quant), max(seen.rows, 1)
    z = df.select(*(seen.z(c).alias(f"z{i}") for i, c in enumerate(quant)), *(F.coalesce(F.col(c), F.lit("Inconnu")).alias(f"l{j}") for j, c in enumerate(qual)))
    both = [(i, j) for i in range(m) for j in range(i, m)]
    sums = [F.sum(f"z{i}").alias(f"s{i}") for i in range(m)] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}_{j}") for i, j in both]
    cells = cut(z.groupBy(*(f"l{j}" for j in range(len(qual)))).agg(F.count("*").alias("n"), *sums))
    own = F.array(*(F.concat(F.lit(f"{c}__"), F.col(f"l{j}")) for j, c in enumerate(qual)))
    rows = cells.select(F.explode(own).alias("v"), "n", *(f"s{i}" for i in range(m))).groupBy("v").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(m))).orderBy("v").collect() if qual else []  # one row per level
    names, at = [*quant, *(r["v"] for r in rows)], {r["v"]: m + i for i, r in enumerate(rows)}
    counts = np.array([r["n"] for r in rows], float)
    products = np.zeros((len(names), len(names)))
    whole = cells.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(m)), *(F.sum(f"q{i}_{j}").alias(f"q{i}_{j}") for i, j in both)).first() if m else {}
    for i, j in both:
        products[i, j] = products[j, i] = float(whole[f"q{i}_{j}"] or 0.0) / n
    for r in rows:
        for i in range(m):
            products[i, at[r["v"]]] = products[at[r["v"]], i] = r[f"s{i}"] / n
    if qual:
        for r in cells.select(F.explode(own).alias("a"), own.alias("l"), "n").select("a", F.explode("l").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # levels squared
            products[at[r["a"]], at[r["b"]]] = r["n"] / n
    mean = np.concatenate([[float(whole[f"s{i}"] or 0.0) / n for i in range(m)], counts / n])
    return Crossed(seen, quant, qual, names, counts, mean, products)


def _own(cols: list[str], unknown: str = "Inconnu"):
    return F.array(*(F.concat(F.lit(f"{c}__"), F.coalesce(F.col(c).cast("string"), F.lit(unknown))) for c in cols))


def many_levels(df: DataFrame, cols: list[str], dense: int, seen: Survey | None = None) -> bool:
    about = sum(seen.levels[c] for c in cols) if seen else dense
    if not dense / 2 <= about <= dense * 2:  # the estimate is good to a few percent
        return about > dense
    return df.select(F.explode(_own(cols)).alias("v")).distinct().limit(dense + 1).count() > dense if cols else False


@dataclass
class SparseAxes:
    values: np.ndarray
    total: float
    nodes: DataFrame  # node, p (share of a level, null for a number), u (one entry per axis)
    scores: DataFrame  # key, f


def _one_large(df: DataFrame, quant: list[str], qual: list[str], k: int, scale: dict[str, float], seen: Survey, small: int) -> tuple[np.ndarray, float, DataFrame] | None:
    """Values, total inertia and (node, u, p, w) if the numbers and the levels of all variables but the largest are at most ``small``; else None.

    The levels of one variable never meet, so their block is s I - c c', and with B, their products with everything else, the matrix maps the span of [B, c] and the small
    nodes into itself. A basis of that span follows from the Gram matrix of [B, c], a sum over the levels; what is left has the value s only."""
    if not qual:
        return None
    large = max(qual, key=lambda c: seen.levels[c])
    rest = [c for c in qual if c != large]
    if many_levels(df, rest, small - len(quant), seen):
        return None
    spark, n, cross = df.sparkSession, max(seen.rows, 1), crossed(df, quant, rest, seen)
    m, q, s = len(quant), len(cross.names), float(scale.get(large, 1.0))
    weight = np.array([float(scale.get(cross.of(c), 1.0)) for c in cross.names]) / cross.root()
    # per level of the large variable: sums of numbers, and counts of the combinations that it meets
    rows = df.select(F.concat(F.lit(f"{large}__"), F.coalesce(F.col(large).cast("string"), F.lit("Inconnu"))).alias("node"), *(seen.z(c).alias(f"z{i}") for i, c in enumerate(quant)), *(F.coalesce(F.col(c), F.lit("Inconnu")).alias(f"l{j}") for j, c in enumerate(rest)))
    for j, c in enumerate(rest):
        told = [(v[len(c) + 2 :], i) for i, v in enumerate(cross.names) if i >= m and cross.of(v) == c]
        rows = rows.join(F.broadcast(spark.createDataFrame(told, f"l{j} string, i{j} int")), f"l{j}").drop(f"l{j}")
    sums = [F.sum(f"z{i}").alias(f"z{i}") for i in range(m)]
    cells = rows.groupBy("node", *(f"i{j}" for j in range(len(rest)))).agg(F.count("*").alias("n"), *sums)
    met = F.collect_list(F.struct("n", *(f"i{j}" for j in range(len(rest)))))
    per = cut(cells.groupBy("node").agg(F.sum("n").alias("n"), F.array(*sums).cast("array<double>").alias("z"), met.alias("met")).select("node", "n", "z", F.col("met.n").alias("many"), *(F.col(f"met.i{j}").alias(f"i{j}") for j in range(len(rest)))))

    def wide(b) -> np.ndarray:
        """[B, c] of a batch of levels."""
        count = b.column(1).to_numpy().astype(float)
        out = np.zeros((b.num_rows, q + 1))
        if m:
            out[:, :m] = b.column(2).flatten().to_numpy().reshape(-1, m)
        many, at = b.column(3).flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy()))
        for j in range(len(rest)):
            np.add.at(out, (at, b.column(4 + j).flatten().to_numpy()), many)
        out[:, :q] *= weight
        out[:, q] = count
        return out / n * (s / np.sqrt(count / n))[:, None]

    def work(batches):
        total = np.zeros((q + 1, q + 1))
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                x = wide(pa.RecordBatch.from_arrays([c.slice(at, 2048) for c in b.columns], names=b.schema.names))
                total += x.T @ x
        yield pa.RecordBatch.from_pylist([{"v": total.ravel().tolist()}])

    gram = np.zeros((q + 1) * (q + 1))
    for r in per.mapInArrow(work, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        gram[r["i"]] = r["v"]
    gram = gram.reshape(q + 1, q + 1)
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
    keep = vals > 1e-10 * max(vals.max(), 1e-300)
    basis = vecs[:, keep] / np.sqrt(vals[keep])
    r = basis.T @ gram
    c = np.concatenate([r[:, q], cross.mean * weight * (np.arange(q) >= m)])
    t = np.block([[s * s * np.eye(r.shape[0]), r[:, :q]], [r[:, :q].T, cross.products * np.outer(weight, weight)]]) - np.outer(c, c)
    values, y = np.linalg.eigh((t + t.T) / 2)
    values, y = values[::-1][:k], y[:, ::-1][:, :k]
    levels = per.count()
    if levels > r.shape[0] and (len(values) < k or values[-1] <= s * s * (1 + 1e-9)):
        return None  # an axis that only the large variable's levels span
    along = basis @ y[: r.shape[0]]

    def place(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = pa.RecordBatch.from_arrays([c.slice(at, 2048) for c in b.columns], names=b.schema.names)
                u = wide(part) @ along
                p = part.column(1).to_numpy() / n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * u.shape[1]), pa.array(u.ravel())), pa.array(p), pa.array(s / np.sqrt(p))], ["node", "u", "p", "w"])

    kind = "node string, u array<double>, p double, w double"
    few = [(v, y[r.shape[0] + i].tolist(), float(cross.mean[i]) if i >= m else None, float(weight[i]) if i >= m else None) for i, v in enumerate(cross.names)]
    known = per.mapInArrow(place, kind)
    known = known.union(spark.createDataFrame(few, kind)) if few else known
    of = [cross.of(v) for v in cross.names[m:]]
    total = s * s * (levels - 1) + sum(float(scale.get(v, 1.0)) ** 2 * (of.count(v) - 1) for v in rest) + sum(float(scale.get(v, 1.0)) ** 2 for v in quant)
    return values, total, known


def _by_lanczos(z: DataFrame, quant: list[str], qual: list[str], k: int, scale: dict[str, float], n: int) -> tuple[np.ndarray, float, DataFrame]:
    """Values, total inertia and (node, u, p, w) from a table of entries."""
    spark, z = z.sparkSession, cut(z)
    factor = F.lit(1.0)
    for c in qual:
        factor = F.when(F.col("node").startswith(f"{c}__"), float(scale.get(c, 1.0))).otherwise(factor)
    each = z.select("z", F.explode("own").alias("node"))
    levels = cut(each.groupBy("node").agg(F.count("*").alias("n"), *(F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(len(quant)))).withColumn("p", F.col("n") / n).withColumn("w", factor / F.sqrt("p")))
    weight = levels.select("node", "w")
    pairs = z.select(F.explode("own").alias("a"), "own").select("a", F.explode("own").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    entries = pairs.join(weight.select(F.col("node").alias("a"), F.col("w").alias("wa")), "a").join(weight.select(F.col("node").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", (F.col("n") / n * F.col("wa") * F.col("wb")).alias("s"))
    nodes = levels.select("node", (F.col("p") * F.col("w")).alias("c"))
    if quant:
        mixed = levels.select("node", F.explode(F.array(*(F.struct(F.lit(c).alias("q"), (F.col(f"z{i}") / n * F.col("w")).alias("s")) for i, c in enumerate(quant)))).alias("m")).select("node", "m.q", "m.s")
        products = z.agg(*(F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"s{i}_{j}") for i in range(len(quant)) for j in range(len(quant)))).first()
        among = spark.createDataFrame([(a, b, float(products[f"s{i}_{j}"] or 0.0) / max(n, 1)) for i, a in enumerate(quant) for j, b in enumerate(quant)], "a string, b string, s double")
        entries = entries.union(mixed.select("node", "q", "s")).union(mixed.select("q", "node", "s")).union(among)
        nodes = nodes.union(spark.createDataFrame([(c, 0.0) for c in quant], "node string, c double"))
    total = (levels.agg(F.sum((1 - F.col("p")) * F.col("p") * F.col("w") ** 2)).first()[0] or 0.0) + sum(float(scale.get(c, 1.0)) ** 2 for c in quant)
    values, u = lanczos(cut(entries), nodes, k)
    return values, float(total), u.join(levels.select("node", "p", "w"), "node", "left")


def sparse_axes(df: DataFrame, quant: list[str], qual: list[str], k: int, key: str, scale: dict[str, float] | None = None, small: int = DENSE) -> SparseAxes:
    """Leading axes of z-scores and centred indicators over sqrt(p), each times the scale of its variable, for levels of any number.

    Where one variable alone has more than ``small`` levels with the numbers and the levels of all others, its levels are eliminated; else cross-products are a
    table of entries: numbers among themselves, sums of numbers per level, counts of level pairs. Scores come from the row's own levels by a join, so nothing is as wide as the levels."""
    scale, seen = scale or {}, survey(df, quant, qual)
    z = df.select(key, F.array(*(seen.z(c, float(scale.get(c, 1.0))) for c in quant)).cast("array<double>").alias("z"), _own(qual).alias("own"))
    values, total, known = _one_large(df, quant, qual, k, scale, seen, small) or _by_lanczos(z, quant, qual, k, scale, seen.rows)
    m = len(values)
    known = cut(known)
    own = known.where("p is not null")
    shift = own.agg(*(F.sum(F.col("p") * F.col("w") * F.col("u")[a]).alias(f"x{a}") for a in range(m))).first() if m else []
    numbers = {r["node"]: r["u"] for r in known.where("p is null").collect()}  # one row per number
    told = z.select(key, F.explode("own").alias("node")).join(own.select("node", "w", "u"), "node").groupBy(key).agg(*(F.sum(F.col("w") * F.col("u")[a]).alias(f"f{a}") for a in range(m)))
    score = lambda a: F.coalesce(f"f{a}", F.lit(0.0)) - float((shift[a] if qual else 0.0) or 0.0) + sum((F.col("z")[i] * float(numbers[c][a]) for i, c in enumerate(quant)), F.lit(0.0))
    scores = z.select(key, "z").join(told, key, "left").select(key, F.array(*(score(a) for a in range(m))).alias("f"))
    return SparseAxes(values, float(total), known, scores)


def _sparse_tables(df: DataFrame, made: SparseAxes, key: str, coordinate, values: np.ndarray, total: float, score: float = 1.0) -> Factors:
    m = len(made.values)
    rows = made.nodes.select(F.col("node").alias("name"), "p", F.posexplode("u").alias("a", "u"))
    root = F.element_at(F.array(*(F.lit(float(np.sqrt(max(v, 0.0)))) for v in made.values)), F.col("a") + 1)
    loadings = rows.select("name", (F.col("a") + 1).alias("axis"), coordinate(F.col("u"), root, F.col("p")).alias("coordinate"), (100 * F.col("u") ** 2).alias("contribution"))
    pct = 100 * values / total if total else values
    table = [(a + 1, float(values[a]), float(pct[a]), float(pct[: a + 1].sum())) for a in range(len(values))]
    scores = made.scores.select(key, *((F.col("f")[a] * float(score)).alias(f"F{a + 1}") for a in range(m)))
    return Factors(scores, loadings, df.sparkSession.createDataFrame(table, "axis int, eigenvalue double, pct double, cumulative double"))


def mca(df: DataFrame, cols: list[str], k: int = 2, benzecri: bool = False, key: str = "code", dense: int = DENSE) -> Factors:
    """Correspondence analysis of the indicator table: eigen-decomposition of the Burt matrix, small or as sparse entries, row scores from the level coordinates.

    With more levels than ``dense`` the inertia table has the first ``k`` axes only, in percent of the whole."""
    q = len(cols)
    seen = survey(df, [], cols)
    if many_levels(df, cols, dense, seen):
        made = sparse_axes(df, [], cols, k, key)
        values, total = made.values / q, made.total / q
        if benzecri:
            values = np.where(values > 1 / q, (q / (q - 1) * (values - 1 / q)) ** 2, 0)
            total = float(values.sum())
        return _sparse_tables(df, made, key, lambda u, root, p: u / F.sqrt(p) * root, values, total, 1 / np.sqrt(q))
    cross = crossed(df, [], cols, seen)
    names, n, rows, burt = cross.names, cross.counts, seen.rows, cross.products * seen.rows
    mass = n / n.sum()
    s = burt / (rows * q * q) / np.sqrt(np.outer(mass, mass)) - np.sqrt(np.outer(mass, mass))
    vals, vecs = axes(s)
    m = min(k, len(names) - q)
    vals, vecs = vals[: max(len(names) - q, 1)], vecs[:, :m]
    coordinates = vecs / np.sqrt(mass)[:, None] * np.sqrt(vals[:m])
    scale = vecs / np.sqrt(mass)[:, None] / q  # a row's score is the mean of its levels' standard coordinates
    scores = cross.scores(df, key, scale)
    inertia = vals
    if benzecri:
        inertia = np.where(vals > 1 / q, (q / (q - 1) * (vals - 1 / q)) ** 2, 0)
        inertia = inertia[inertia > 0] if (inertia > 0).any() else inertia[:1]
    return _tables(df, scores, names, coordinates, vecs**2, inertia, float(inertia.sum()))


def _mixed(df: DataFrame, quant: list[str], qual: list[str], key: str):
    """Rows of z-scores and of indicators scaled by 1 / sqrt(p), as one array column; missing numbers raise."""
    _complete(df, quant)
    names, n, rows = levels_of(df, qual) if qual else ([], np.zeros(0), 0)
    p = n / max(rows, 1)
    z = standardise(df, quant) if quant else df
    parts = ([F.array(*quant)] if quant else []) + ([indicator(qual, names, 1 / np.sqrt(np.maximum(p, 1e-12)), p)] if qual else [])
    return z.select(key, F.concat(*parts).alias("x")), [*quant, *names]


def _complete(df: DataFrame, quant: list[str]) -> None:
    if quant and df.where(F.greatest(*(F.col(c).isNull().cast("int") for c in [*quant, quant[0]])) > 0).limit(1).count():
        raise ValueError("missing numbers: impute them first")


def famd(df: DataFrame, quant: list[str], qual: list[str], k: int = 2, key: str = "code", dense: int = DENSE) -> Factors:
    """Principal components of z-scores and scaled indicators together; with more levels than ``dense`` from sparse entries, and the first ``k`` axes of the inertia."""
    seen = survey(df, quant, qual)
    if many_levels(df, qual, dense, seen):
        made = sparse_axes(df, quant, qual, k, key)
        return _sparse_tables(df, made, key, lambda u, root, p: u * root, made.values, made.total)
    cross = crossed(df, quant, qual, seen)
    vals, vecs = axes(cross.covariance())
    k = min(k, len(vals))
    return _tables(df, cross.centred_scores(df, key, vecs[:, :k]), cross.names, vecs[:, :k] * np.sqrt(vals[:k]), vecs[:, :k] ** 2, vals, float(vals.sum()))


def by_variable(loadings: DataFrame) -> DataFrame:
    """Contributions summed from level (``variable__level``) to variable."""
    return loadings.groupBy(F.split("name", "__")[0].alias("variable"), "axis").agg(F.sum("contribution").alias("contribution"))


def mfa(df: DataFrame, groups: dict[str, list[str]], k: int = 2, weights: dict[str, float] | None = None, key: str = "code", dense: int = DENSE) -> tuple[Factors, DataFrame]:
    """Groups of variables, each divided by its first singular value, then one analysis of all; also contributions of the groups per axis (percent).

    Numeric and level columns may mix; levels count as indicators. The inertia is renormalised to 100 percent.
    """
    kinds = dict(df.dtypes)
    split = {g: ([c for c in cols if kinds[c] != "string"], [c for c in cols if kinds[c] == "string"]) for g, cols in groups.items()}
    numbers, words = (list(dict.fromkeys(c for own in split.values() for c in own[i])) for i in (0, 1))
    seen = survey(df, numbers, words)
    if many_levels(df, words, dense, seen):
        return _sparse_mfa(df, split, k, weights or {}, key)
    cross = crossed(df, numbers, words, seen)
    cov, at, scale, of = cross.covariance(), [], [], []
    for g, (quant, qual) in split.items():
        own = [i for c in quant for i, n in enumerate(cross.names) if n == c] + [i for i, n in enumerate(cross.names) if i >= len(numbers) and cross.of(n) in qual]
        first = axes(cov[np.ix_(own, own)])[0][0] if own else 1.0
        at += own
        of += [g] * len(own)
        scale += [np.sqrt((weights or {}).get(g, 1.0) / max(first, 1e-12))] * len(own)
    names, scale = [cross.names[i] for i in at], np.array(scale)
    vals, vecs = axes(cov[np.ix_(at, at)] * np.outer(scale, scale))
    k = min(k, len(vals))
    along = np.zeros((len(cross.names), k))
    np.add.at(along, at, scale[:, None] * vecs[:, :k])
    out = _tables(df, cross.centred_scores(df, key, along), names, vecs[:, :k] * np.sqrt(vals[:k]), vecs[:, :k] ** 2, vals / vals.sum(), 1.0)
    group = {n: g for n, g in zip(names, of)}
    rows = [(g, a + 1, float(100 * sum(vecs[i, a] ** 2 for i, n in enumerate(names) if group[n] == g))) for g in groups for a in range(k)]
    return out, df.sparkSession.createDataFrame(rows, "grp string, axis int, contribution double")


def _sparse_mfa(df: DataFrame, split: dict, k: int, weights: dict[str, float], key: str) -> tuple[Factors, DataFrame]:
    scale: dict[str, float] = {}
    for g, (quant, qual) in split.items():
        first = sparse_axes(df, quant, qual, 1, key).values
        scale |= {c: float(np.sqrt(weights.get(g, 1.0) / max(first[0] if len(first) else 1.0, 1e-12))) for c in (*quant, *qual)}
    made = sparse_axes(df, [c for q, _ in split.values() for c in q], [c for _, q in split.values() for c in q], k, key, scale)
    out = _sparse_tables(df, made, key, lambda u, root, p: u * root, made.values / made.total, 1.0)
    named = df.sparkSession.createDataFrame([(c, g) for g, (a, b) in split.items() for c in (*a, *b)], "variable string, grp string")
    return out, by_variable(out.loadings).join(F.broadcast(named), "variable").groupBy("grp", F.col("axis").cast("int").alias("axis")).agg(F.sum("contribution").alias("contribution"))


def _kept(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns of an analysis, stored: it reads them several times."""
    return cut(df.select("code", *cols))


def _whole(df: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    return _kept(df.fillna(0.0, AMOUNTS), [*AMOUNTS, *levels])


_two = lambda t, *cols: t.select(*(F.round(c, 6).alias(c) if d == "double" else F.col(c) for c, d in t.dtypes if not cols or c in cols))


@book.on_view("G6_mca_scores")
def mca_scores(df: DataFrame) -> DataFrame:
    return _two(mca(_kept(df, LEVELS), LEVELS).scores)


@book.on_view("G6_mca_levels")
def mca_levels(df: DataFrame) -> DataFrame:
    return _two(mca(_kept(df, LEVELS), LEVELS).loadings)


@book.on_view("G6_mca_inertia")
def mca_inertia(df: DataFrame) -> DataFrame:
    """Eigenvalues as they are and with Benzecri's correction."""
    df = _kept(df, LEVELS)
    plain, corrected = (mca(df, LEVELS, benzecri=b).inertia.withColumn("benzecri", F.lit(b)) for b in (False, True))
    return _two(plain.union(corrected))


_CLIENTS = [*LEVELS, "client"]


@book.on_view("G6_mca_clients")
def mca_clients(df: DataFrame) -> DataFrame:
    """Coordinates of every level where the client is an active variable: as many levels as clients."""
    return mca(_kept(df, _CLIENTS), _CLIENTS).loadings.select("name", "axis", F.round(F.abs("coordinate"), 4).alias("coordinate"), F.round("contribution", 4).alias("contribution"))


@book.on_view("G8_famd_client_contributions")
def famd_client_contributions(df: DataFrame) -> DataFrame:
    return _two(by_variable(famd(_whole(df, _CLIENTS), AMOUNTS, _CLIENTS).loadings))


@book.on_view("G7_famd_scores")
def famd_scores(df: DataFrame) -> DataFrame:
    return _two(famd(_whole(df), AMOUNTS, LEVELS).scores)


@book.on_view("G7_famd_loadings")
def famd_loadings(df: DataFrame) -> DataFrame:
    return _two(famd(_whole(df), AMOUNTS, LEVELS).loadings)


@book.on_view("G8_famd_contributions")
def famd_contributions(df: DataFrame) -> DataFrame:
    return _two(by_variable(famd(_whole(df), AMOUNTS, LEVELS).loadings))


GROUPS = {"money": AMOUNTS, "deal": ["opp_type", "category"], "place": ["entity", "status"]}


@book.on_view("G9_mfa_scores")
def mfa_scores(df: DataFrame) -> DataFrame:
    return _two(mfa(_whole(df), GROUPS)[0].scores)


@book.on_view("G9_mfa_inertia")
def mfa_inertia(df: DataFrame) -> DataFrame:
    return _two(mfa(_whole(df), GROUPS)[0].inertia)


@book.on_view("G10_mfa_groups")
def mfa_groups(df: DataFrame) -> DataFrame:
    """Contributions of the groups per axis, with the axis' share of inertia."""
    out, groups = mfa(_whole(df), GROUPS)
    return _two(groups.join(out.inertia.select("axis", "pct"), "axis"))


def principal(df: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """code, F1..Fk of the complete amounts, and all eigenvalues."""
    cross = crossed(df, AMOUNTS, [], survey(df, AMOUNTS, []))
    vals, vecs = axes(cross.covariance())
    return cross.centred_scores(df, "code", vecs[:, :k]), vals


@book.on_view("G11_score_export")
def score_export(df: DataFrame, k: int = 4) -> DataFrame:
    """Record id and principal coordinates, ready for a sink."""
    return _two(principal(_whole(df, []), k)[0])


_PROFILE = "e as (select entity, avg(revenue) as a, avg(coalesce(budget, 0)) as b, avg(cost) as c, avg((status = 'won')::int) as d from opp group by 1), z as (select entity, " + ", ".join(f"({c} - avg({c}) over ()) / nullif(stddev_pop({c}) over (), 0) as {c}" for c in "abcd") + " from e)"


@book.on_view("G12_distances", f"with {_PROFILE} select x.entity as a, y.entity as b, round(sqrt(" + " + ".join(f"coalesce((x.{c} - y.{c}) ** 2, 0)" for c in "abcd") + "), 5) as distance from z x join z y on x.entity < y.entity")
def distances(df: DataFrame) -> DataFrame:
    """Euclidean distances between the standardised profiles of all entities (one row per entity, so the pairs stay few)."""
    e = df.groupBy("entity").agg(F.avg("revenue").alias("a"), F.avg(F.coalesce("budget", F.lit(0.0))).alias("b"), F.avg("cost").alias("c"), F.avg((F.col("status") == "won").cast("int")).alias("d"))
    z = standardise(e, list("abcd"))
    x, y = (z.select(F.col("entity").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in "abcd")) for n in "ab")
    gap = F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "abcd"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(gap, 5).alias("distance"))


def _ranks(df: DataFrame, features: str, n: int) -> DataFrame:
    return neighbours(df, n - 1, "id", features).select("id", "other", F.col("rank").alias(f"r_{features}"))


_RANKS = """s as (select vec_id as id, embedding::double[] as x, embedding[1:2]::double[] as f from embeddings order by md5(vec_id::varchar), vec_id limit 500), n as (select count(*) as n, least(10, count(*) // 2) as k from s),
  r as (select a.id, b.id as other, row_number() over (partition by a.id order by round(list_distance(a.x, b.x), 9), b.id) as rx, row_number() over (partition by a.id order by round(list_distance(a.f, b.f), 9), b.id) as rf from s a join s b on a.id <> b.id)"""


@book.on_tables("G13_trust_continuity", f"with {_RANKS} select round(1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * (select coalesce(sum(rx - k), 0) from r, n where rf <= k and rx > k), 4) as trustworthiness, round(1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * (select coalesce(sum(rf - k), 0) from r, n where rx <= k and rf > k), 4) as continuity from n")
def trust_continuity(spark, sf_dir, cap: int = 500) -> DataFrame:
    """Ranks of neighbours in all dimensions and in two, on a hash sample of bounded size."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return trustworthiness(e.withColumn("f", F.slice("x", 1, 2)), cap)


def trustworthiness(df: DataFrame, cap: int = 500) -> DataFrame:
    """From rows (id, x, f): trustworthiness and continuity of f as a projection of x."""
    s = cut(hash_sample(df, "id", cap).select("id", "x", "f"))
    n = s.count()
    k = min(10, n // 2)
    gap = lambda a, b: F.round(F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)), 9)
    w = Window.partitionBy("id")
    # at most cap x cap pairs, all of which are ranked
    pairs = s.crossJoin(F.broadcast(s.select(F.col("id").alias("other"), F.col("x").alias("y"), F.col("f").alias("g")))).where("id <> other").select("id", "other", gap("x", "y").alias("dx"), gap("f", "g").alias("df"))
    r = pairs.select("id", F.row_number().over(w.orderBy("dx", "other")).alias("rx"), F.row_number().over(w.orderBy("df", "other")).alias("rf"))
    unit = 2.0 / max(n * k * (2 * n - 3 * k - 1), 1)
    miss = lambda a, b: F.coalesce(F.sum(F.when((F.col(a) <= k) & (F.col(b) > k), F.col(b) - k)), F.lit(0))
    return r.agg(F.round(1 - unit * miss("rf", "rx"), 4).alias("trustworthiness"), F.round(1 - unit * miss("rx", "rf"), 4).alias("continuity"))


def versions(df: DataFrame) -> dict[str, DataFrame]:
    """The table as it is, without negative costs, and without missing budgets."""
    return {"raw": df, "no_negative_cost": df.where("cost >= 0"), "complete": df.where("budget is not null")}


@book.on_view("G16_version_scores")
def version_scores(df: DataFrame) -> DataFrame:
    """Axis limits per dataset version and over all of them: min and max of the scores of each version's own projection."""
    out = None
    for name, d in versions(_kept(df, AMOUNTS)).items():
        part = _two(principal(d.fillna(0.0, AMOUNTS), 2)[0]).agg(*(f(c).alias(f"{n}_{c}") for c in ("F1", "F2") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n")).withColumn("version", F.lit(name))
        out = part if out is None else out.union(part)
    shared = out.agg(*(f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("F1", "F2") for n, f in (("min", F.min), ("max", F.max))), F.sum("n").alias("n")).withColumn("version", F.lit("shared"))
    return out.union(shared)


@book.on_view("H18_factor_grid")
def factor_grid(df: DataFrame, components=(2, 3, 4), goal: float = 80.0) -> DataFrame:
    """Components and options of the analyses with the inertia they reach; the best needs ``goal`` percent with the fewest components, or else reaches most."""
    d = _whole(df)
    rows = []
    for method, made in (("famd", lambda k: famd(d, AMOUNTS, LEVELS, k)), ("mca", lambda k: mca(d, LEVELS, k)), ("mca benzecri", lambda k: mca(d, LEVELS, k, benzecri=True)), ("mfa", lambda k: mfa(d, GROUPS, k)[0])):
        reach = {r["axis"]: r["cumulative"] for r in made(max(components)).inertia.collect()}
        rows += [(method, k, float(reach.get(k, max(reach.values())))) for k in components]
    best = min(rows, key=lambda r: (r[2] < goal, r[1] if r[2] >= goal else -r[2], r[0]))
    return df.sparkSession.createDataFrame([(m, k, round(c, 6), (m, k, c) == best) for m, k, c in rows], "method string, components int, cumulative double, best boolean")
