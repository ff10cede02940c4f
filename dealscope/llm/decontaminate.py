"""Benchmark decontamination with a distributed positional inverted index.

The index is cut into shards of about one slice of documents each. A shard maps each of its terms to its postings: the
documents of the shard and the positions of the term in them, in that order. Shards are rows of a stored table, so
neither posting lists nor hot terms are shuffled, and no list is longer than a shard. Terms that no benchmark text holds are left out by a bitmap of fixed size, at every
number of windows. Term frequencies over all documents order the terms of each benchmark window;
a window is looked up from its rarest term, and the offset-adjusted lists of
the next rarest terms are intersected until all terms agree (exact phrase).
The same postings give proximity matches: the rarest terms of a window within
``slop`` words of each other in any order.

Benchmark windows are the query set. They reach the tasks in blocks of at most
``BLOCK`` windows, so the broadcast is bounded and no window is left out; the items of the windows found are joined afterwards.

Defined results: null or empty texts have no words and are clean; items of
1 to ``size`` - 1 words are one window; an empty benchmark hits nothing, an empty table gives no rows; repeated
document rows are reported row by row; a null doc_id is kept; a very long text is a shard of its own; terms of equal frequency are taken
in the order of the window; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import bitmap, drop, in_bitmap, stored, table

SIZE, SLOP, NEAR_TERMS, BLOCK = 10, 20, 5, 200_000


def _terms(column):
    data, off = tk.raw(column)
    data = tk.LOWER[data]
    s, e, row = tk.words(data, off, tk.ALNUM)
    return tk.span_hash(data, s, e), row


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, terms): one row per distinct window of an item."""

    def work(batches):
        for b in tk.slices(batches):
            h, row = _terms(b.column(1))
            bounds = tk.row_bounds(row, b.num_rows)
            ids, out = [], []
            for r in range(b.num_rows):
                w = h[bounds[r] : bounds[r + 1]].view(np.int64)
                if len(w):
                    k = min(size, len(w))
                    out += [w[i : i + k].tolist() for i in range(len(w) - k + 1)]
                    ids += [b.column(0)[r].as_py()] * (len(w) - k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.int64()))], ["item_id", "terms"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(work, "item_id string, terms array<bigint>").distinct()


def posting_index(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One row per shard: docs, n_words (per document), terms (ascending), sizes (postings of each term), rows and positions (of the postings, in the order of terms)."""
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        for b in tk.slices(batches):
            h, row = _terms(b.column(1))
            bounds = tk.row_bounds(row, b.num_rows)
            at = np.flatnonzero(in_bitmap(known.value, h))
            order = at[np.argsort(h[at], kind="stable")]
            h, r, pos = h[order], row[order], (np.arange(len(row)) - bounds[row])[order]
            first = np.flatnonzero(tk.starts(h))
            one = lambda v, kind: pa.array([v], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0)), one(np.diff(bounds), pa.int64()), one(h[first].view(np.int64), pa.int64()), one(np.diff(np.append(first, len(h))), pa.int32()), one(r, pa.int32()), one(pos, pa.int32())],
                ["docs", "n_words", "terms", "sizes", "rows", "positions"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "docs array<bigint>, n_words array<bigint>, terms array<bigint>, sizes array<int>, rows array<int>, positions array<int>")


def _plan(windows: list, count: dict[int, int], size: int) -> dict:
    """A block of windows as arrays: their numbers and terms from the rarest on."""
    live = [(w, t) for w, t in windows if all(count.get(x) for x in t)]
    terms, offs = np.zeros((len(live), size), np.int64), np.full((len(live), size), -1, np.int64)
    for i, (_, t) in enumerate(live):
        order = sorted(range(len(t)), key=lambda j: (count[t[j]], j))
        terms[i, : len(t)], offs[i, : len(t)] = [t[j] for j in order], order
    lead = np.argsort(terms[:, 0].view(np.uint64), kind="stable")
    return {"terms": terms[lead].view(np.uint64), "offs": offs[lead], "windows": np.array([w for w, _ in live], np.int64)[lead], "size": size}


def _ranges(starts, counts):
    """Concatenated aranges."""
    total = int(counts.sum())
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(total)


def _lookup(shard: dict, plan: dict, slop: int):
    """Rows, first words and windows of exact matches; rows and windows of proximity matches."""
    z = np.zeros(0, np.int64)
    n = len(shard["docs"])
    term, run, posted, pos = shard["terms"].view(np.uint64), shard["sizes"].astype(np.int64), shard["rows"].astype(np.int64), shard["positions"].astype(np.int64)
    T = plan["terms"]
    if not len(T) or not len(term):
        return z, z, z, z, z
    voc = np.unique(T)
    t = np.searchsorted(voc, term)
    t = np.where(voc[np.minimum(t, len(voc) - 1)] == term, t, len(voc))
    start = np.cumsum(run) - run
    # a posting is a number: term, document, position; postings are in that order
    width = np.int64(pos.max() + 2) + 2 * np.int64(slop)
    key = (np.repeat(t, run) * n + posted) * width + pos + slop
    key = key[np.repeat(t < len(voc), run)]
    wt = np.searchsorted(voc, T)
    # every posting of a rarest term starts a candidate for each window that it leads
    lo, hi = np.searchsorted(wt[:, 0], t, "left"), np.searchsorted(wt[:, 0], t, "right")
    lead = np.flatnonzero((hi > lo) & (t < len(voc)))
    each = run[lead]
    at = _ranges(start[lead], each)
    src = np.repeat(lead, each)
    n_win = (hi - lo)[src]
    win, p = _ranges(lo[src], n_win), np.repeat(pos[at], n_win)
    row = posted[np.repeat(at, n_win)]
    first = p - plan["offs"][win, 0]
    alive = np.flatnonzero(first >= 0)
    for j in range(1, plan["size"]):
        w, off = win[alive], plan["offs"][win[alive], j]
        want = (wt[w, j] * n + row[alive]) * width + first[alive] + off + slop
        i = np.minimum(np.searchsorted(key, want), len(key) - 1)
        alive = alive[(off < 0) | (key[i] == want)]
    near = np.arange(len(win))
    for j in range(1, min(NEAR_TERMS, plan["size"])):
        w = win[near]
        want = (wt[w, j] * n + row[near]) * width + p[near]
        i = np.minimum(np.searchsorted(key, want), len(key) - 1)
        near = near[(plan["offs"][w, j] < 0) | ((key[i] >= want) & (key[i] <= want + 2 * slop))]
    return row[alive], first[alive], win[alive], row[near], win[near]


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, slop: int = SLOP) -> DataFrame:
    """Matches per document row: doc_id, n_words, n_hit, hit (word numbers), items (sorted strings), near_items (proximity)."""
    spark = documents.sparkSession
    windows = stored(benchmark_windows(benchmark, size).withColumn("window", F.xxhash64("terms")))
    wanted = stored(windows.groupBy("window").agg(F.first("terms").alias("terms")))
    blocks = max(1, -(-wanted.count() // BLOCK))
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    index = stored(posting_index(documents, bitmap(terms, "term")).withColumn("shard", F.monotonically_increasing_id()))
    seen = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("n"))
    seen = stored(terms.join(seen, "term"))
    found = None
    for k in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        counts = block.select(F.explode("terms").alias("term")).distinct().join(seen, "term").collect()
        plan = spark.sparkContext.broadcast(_plan([(r["window"], r["terms"]) for r in block.collect()], {r["term"]: r["n"] for r in counts}, size))

        def work(batches, plan=plan):
            for b in batches:
                for i in range(b.num_rows):
                    p = plan.value
                    shard = {c: b.column(j)[i].values.to_numpy(zero_copy_only=False) for j, c in enumerate(b.schema.names[:5])}
                    row, first, win, nrow, nwin = _lookup(shard, p, slop)
                    near = np.unique(np.stack([nrow, nwin], axis=1), axis=0) if len(nrow) else np.zeros((0, 2), np.int64)
                    length = (p["offs"][win] >= 0).sum(axis=1) if len(win) else win
                    rows = np.concatenate([row, near[:, 0]])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(5).slice(i, 1).take(pa.array(np.zeros(len(rows), np.int64))), pa.array(rows, pa.int32()), pa.array(p["windows"][np.concatenate([win, near[:, 1]])] if len(rows) else rows, pa.int64()), pa.array(np.concatenate([first, np.full(len(near), -1)]), pa.int32()), pa.array(np.concatenate([length, np.zeros(len(near), np.int64)]), pa.int32())],
                        ["shard", "row", "window", "first", "length"],
                    )

        part = index.select("docs", "terms", "sizes", "rows", "positions", "shard").mapInArrow(work, "shard bigint, row int, window bigint, first int, length int")
        found = part if found is None else found.union(part)
    found = stored(found)
    exact = F.col("first") >= 0
    words = found.where(exact).select("shard", "row", F.explode(F.sequence("first", F.col("first") + F.col("length") - 1)).alias("word")).groupBy("shard", "row").agg(F.sort_array(F.collect_set("word")).alias("hit"))
    named = found.select("shard", "row", "window", exact.alias("exact")).distinct().join(windows.select("window", "item_id"), "window")
    items = named.groupBy("shard", "row").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.sort_array(F.collect_set(F.when(~F.col("exact"), F.col("item_id")))).alias("near_items"))
    docs = index.select("shard", F.posexplode(F.arrays_zip("docs", "n_words")).alias("row", "d")).select("shard", "row", F.col("d.docs").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    out = docs.join(stored(items.join(words, ["shard", "row"], "left")), ["shard", "row"], "left")
    drop(wanted, seen, found)
    return out.select("doc_id", "n_words", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"), none("hit", "int"), none("items", "string"), none("near_items", "string"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
with w as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as l from benchmark),
wins as (select distinct item_id, k, array_to_string(l[i:i + k - 1], ' ') as g from (select item_id, l, least(len(l), 10) as k, unnest(range(1, len(l) - least(len(l), 10) + 2)) as i from w where len(l) > 0)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as l from documents),
grams as (select doc_id, k, i, array_to_string(l[i:i + k - 1], ' ') as g from (select doc_id, l, k, unnest(range(1, len(l) - k + 2)) as i from d, (select distinct k from wins) where len(l) >= k)),
hits as (select doc_id, grams.k, i, item_id from grams join wins on grams.k = wins.k and grams.g = wins.g),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(l)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join it using (doc_id)
"""
