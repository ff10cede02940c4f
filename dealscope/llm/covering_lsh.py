"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: bit b is 1 if it is set in over half of the XXH64 hashes of the k-word shingles, repeats included.

Search: every bit position gets a non-zero vector of RADIUS + 1 bits, and every non-zero vector v a table whose mask
holds the positions with odd inner product. The positions in which two fingerprints within the radius differ span a
space of at most RADIUS dimensions, so some v is orthogonal to all of them, and the pair agrees under its mask: every pair meets
in one of 2 ** (RADIUS + 1) - 1 tables, each keyed by about half the bits.

Equal fingerprints are one class first. A bucket of up to ``limit`` fingerprints is compared in its task; a fuller one is covered once
more by the same masks over the bits that its table leaves free, after which at most 2 ** 16 different fingerprints
can share a bucket, whatever the input. A bucket reports links of a spanning forest (member, smallest member reached), never all its pairs.

Defined results: null text and text without words have fingerprint zero and are linked like any other; fewer than k words are one
shingle; rows that repeat a doc_id count as one document with the union of their links; null doc_id keeps its fingerprint, is linked with
nothing and has a null component; very long texts are hashed whole, in pieces of ``PIECE`` shingles; an empty table gives no rows; ties
go to the smallest doc_id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import components, drop, stored, table

SHINGLE, RADIUS, SEED, LIMIT, PIECE = 4, 4, 42, 4096, 1 << 16


def _bit_counts(words: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in the hashes of the byte ranges, per run of ranges beginning at ``first``."""
    text, digest = words.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())), "<u8", len(start))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, first, axis=0, dtype=np.int64)


def fingerprints(column: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """One 64-bit fingerprint per text."""
    data, off = tk.raw(column)
    data = tk.LOWER[data]
    s, e, row = tk.words(data, off, tk.SPACES)
    # every word with one space behind it: a shingle is a byte range
    size = e - s
    b = np.cumsum(size + 1)
    a = b - size - 1
    spaced = np.full(b[-1] if len(b) else 0, 32, np.uint8)
    inside = np.ones(len(spaced), bool)
    inside[b - 1] = False
    spaced[inside] = data[tk.SPACES[data]]
    n = np.diff(tk.row_bounds(row, len(off) - 1))
    begin = np.cumsum(n) - n
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), shingles)
    word = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + begin[owner]
    last = np.minimum(word + k, begin[owner] + n[owner]) - 1
    counts = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(owner), PIECE):
        w, z, o = word[at : at + PIECE], last[at : at + PIECE], owner[at : at + PIECE]
        first = np.flatnonzero(tk.starts(o))
        base = a[w[0]]
        counts[o[first]] += _bit_counts(spaced[base : b[z[-1]]], a[w] - base, b[z] - 1 - base, first)
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over these bit positions: whichever ``radius`` of them are taken, one mask holds none of these."""
    n = 1 << (radius + 1)
    vector = {p: i % (n - 1) + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member that links reach) for all members but these smallest ones."""
    left = np.sort(values)
    member, root = [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = np.array([seed], values.dtype)
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for x in np.array_split(front, -(-len(front) * len(left) // (1 << 22))):
                near |= (np.bitwise_count(x[:, None] ^ left[None, :]) <= radius).any(axis=0)
            front, left = left[near], left[~near]
            member.append(front)
            root.append(np.full(len(front), seed))
    z = np.zeros(0, values.dtype)
    return np.concatenate([z, *member]), np.concatenate([z, *root])


def _linked(batches):
    """(a, b) from buckets; small ones of equal size are compared together."""
    for batch in batches:
        column = batch.column(0)
        flat = column.flatten().to_numpy().view(np.uint64)
        size = pc.list_value_length(column).to_numpy().astype(np.int64)
        at = np.cumsum(size) - size
        found = []
        for k in np.unique(size[size <= 16]):
            for rows in np.array_split(at[size == k], -(-int((size == k).sum()) * k * k // (1 << 22))):
                x = np.sort(flat[rows[:, None] + np.arange(k)], axis=1)
                near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= RADIUS
                label = np.tile(np.arange(k), (len(x), 1))
                for _ in range(k):
                    label = np.where(near, label[:, None, :], k).min(axis=2)
                moved = label != np.arange(k)
                found.append((x[moved], np.take_along_axis(x, label, 1)[moved]))
        found += [forest(flat[i : i + n]) for i, n in zip(at[size > 16], size[size > 16])]
        if found:
            a, b = (np.concatenate(c).view(np.int64) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _compared(keys: DataFrame, by: list[str]) -> DataFrame:
    buckets = keys.groupBy(*by).agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
    return buckets.mapInArrow(_linked, "a bigint, b bigint").distinct()


def link_fingerprints(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect all of the different fingerprints ``fp`` that lie within RADIUS of each other in steps."""
    masks = covering_masks(list(range(64)))
    cells = lambda m, free="fp": [F.struct(F.lit(i).alias("t"), F.col(free).bitwiseAND(F.lit(_signed(x))).alias("key")) for i, x in enumerate(m)]
    keys = classes.select("fp", F.explode(F.array(*cells(masks))).alias("c")).select("fp", "c.t", "c.key")
    over = stored(keys.groupBy("t", "key").agg(F.count("*").alias("size")).where(F.col("size") > limit).select("t", "key"))
    links = stored(_compared(keys.join(over, ["t", "key"], "left_anti"), ["t", "key"]))
    # the second covering: the same rule over the bits that table t leaves free
    again = F.array(*(F.array(*(F.lit(_signed(x)) for x in covering_masks([p for p in range(64) if not m >> p & 1]))) for m in masks))
    deep = keys.join(over, ["t", "key"]).select("fp", "t", "key", F.posexplode(again[F.col("t")]).alias("u", "mask")).select("fp", "t", "u", F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    out = stored(links.union(_compared(deep, ["t", "u", "key"])))
    drop(links, over)
    return out


def near_duplicates(documents: DataFrame, k: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``documents``."""

    def work(batches):
        for b in tk.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), k).view(np.int64))], ["doc_id", "fp"])

    rows = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, fp bigint"))
    known = rows.where("doc_id is not null")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # a doc_id with several texts links their fingerprints
    least = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id", "lo")
    tied = known.join(least, "doc_id").where("lo < fp").select(F.col("lo").alias("a"), F.col("fp").alias("b"))
    links = link_fingerprints(classes, limit)
    label = components(links.union(tied))
    named = stored(classes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    shown = named.join(smallest, "component").select("fp", "component_id")
    out = rows.join(shown, "fp", "left")
    drop(classes, links, label)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op13_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
