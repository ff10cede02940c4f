"""Sequence packing as a cutting-stock problem solved by column generation.

Every document is its token ids and a closing id 0. Full stretches of ``LENGTH``
ids are sequences of their own; what remains (1 to LENGTH - 1 ids) is an item
whose length is all that matters. The histogram of item lengths (at most
LENGTH - 1 numbers, whatever the size of the corpus) goes to the driver, where
a linear program over patterns is solved by column generation: the restricted
master is a revised simplex with an explicit basis inverse, a knapsack dynamic
program prices new patterns until none improves or the bound of the prices shows the
program to be within ``GAP`` of its optimum. Patterns rounded from its solution are completed by
knapsack patterns over what is left. Patterns then become slots. Documents are
ranked within their length by the task that reads them, in buckets of ``BUCKET_ROWS`` rows, and prefix sums over the buckets (no window
over documents); rank and length give sequence and offset.

Words between single spaces are tokenized once per task while they stay in a cache of ``CACHE`` words, from which the
least recently used half goes when it is full.

Defined results: null text is empty (one id: the closing 0); an empty table gives
no rows; repeated rows are packed each; very long texts give a sequence for each full stretch and
one piece for the rest; ties between documents of a length are settled by their place in the table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import stored, table

LENGTH, CACHE, BUCKET_ROWS, SLICE, RUN, GAP = 1024, 600_000, 20_000, 1 << 22, 100, 2e-3
_BUCKETS = 1 << 20  # numbers that a task has for its buckets
_state: dict = {}
#: white space before which or after which a single space does not begin a new word of the tokenizer
_ODD = re.compile(r"\s (?:\s|$)")


class _Words:
    """Ids of words, end to end; words are found by a dictionary of their numbers."""

    def __init__(self, encode, cache: int = CACHE):
        self.encode, self.cache = encode, cache
        self.clear([], np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def clear(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.number = {w: i for i, w in enumerate(words)}
        self.size, self.ids = size, ids
        self.start = np.cumsum(size) - size
        self.used = np.zeros(len(size), np.int64)
        self.clock = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words that are all different."""
        self.clock += 1
        found = list(map(self.number.get, words))
        if found.count(None) + len(self.number) > self.cache and len(self.number) > self.cache // 2:
            self._forget()
            found = list(map(self.number.get, words))
        new = [i for i, n in enumerate(found) if n is None]
        if new:
            ids, size = self.encode([words[i] for i in new])
            n, at = len(self.number), len(self.ids)
            for k, i in enumerate(new):
                self.number[words[i]] = found[i] = n + k
            self.size = np.concatenate([self.size, size])
            self.start = np.concatenate([self.start, at + np.cumsum(size) - size])
            self.ids = np.concatenate([self.ids, ids])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        out = np.array(found, np.int64)
        self.used[out] = self.clock
        return out

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.cache // 2])
        words = list(self.number)
        size = self.size[keep]
        self.clear([words[i] for i in keep], size, self.ids[_ranges(self.start[keep], size)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges."""
    kind = np.int32 if len(start) and int((start + size).max()) < 2**31 else np.int64
    return np.repeat((start - np.cumsum(size) + size).astype(kind), size) + np.arange(int(size.sum()), dtype=kind)


def _encoder(path: str, cache: int = CACHE):
    """Texts to their ids, end to end, and n + 1 bounds: as the tokenizer gives for whole texts."""
    if (path, cache) not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        plain = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        added = re.compile("|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values()) or r"(?!)")
        begins = np.zeros(max(t.get_vocab().values()) + 1, bool)  # tokens that begin with a space
        begins[[i for w, i in t.get_vocab().items() if w.startswith("\u0120")]] = True

        def one_by_one(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            got = plain(words)
            return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

        def spaced(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Words after a single space: many in one text, whose ids are cut where a token begins with a space."""
            simple = [len(w.split()) == 1 and w.strip() == w for w in words]
            run = [w for w, ok in zip(words, simple) if ok]
            ids = np.array([i for x in plain([" " + " ".join(run[i : i + RUN]) for i in range(0, len(run), RUN)]) for i in x], np.uint32)
            first = np.flatnonzero(begins[ids])
            if len(first) != len(run):  # not a tokenizer that splits there
                return one_by_one([" " + w for w in words])
            rest_ids, rest_size = one_by_one([" " + w for w, ok in zip(words, simple) if not ok])
            size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            simple = np.array(simple, bool)
            size[simple], start[simple] = np.diff(np.append(first, len(ids))), first
            size[~simple], start[~simple] = rest_size, len(ids) + np.cumsum(rest_size) - rest_size
            return np.concatenate([ids, rest_ids])[_ranges(start, size)], size

        _state[path, cache] = plain, added, _Words(one_by_one, cache), _Words(spaced, cache)
    plain, added, first, rest = _state[path, cache]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        odd = np.array([bool(_ODD.search(t) or added.search(t)) for t in texts.to_pylist()], bool)
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        lead = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        words = pc.list_flatten(parts)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        number = rest.numbers(coded.dictionary.to_pylist())
        size, start = rest.size[number][code], rest.start[number][code]
        heads = words.take(pa.array(lead)).dictionary_encode()
        head = first.numbers(heads.dictionary.to_pylist())[heads.indices.to_numpy(zero_copy_only=False)]
        # ids of both stores, then of whole texts, in one array
        whole = [np.array(e, np.uint32) for e in plain(texts.filter(pa.array(odd)).to_pylist())]
        pool = np.concatenate([rest.ids, first.ids, *whole])
        size[lead], start[lead] = first.size[head], first.start[head] + len(rest.ids)
        of = np.zeros(n, np.int64)  # words of each text
        of[~odd], of[odd] = np.diff(np.append(lead, len(code))), 1
        at = np.cumsum(of) - of
        sizes, starts = np.zeros(int(of.sum()), np.int64), np.zeros(int(of.sum()), np.int64)
        fast = np.repeat(~odd, of)
        sizes[fast], starts[fast] = size, start
        own = np.array([len(w) for w in whole], np.int64)
        sizes[at[odd]], starts[at[odd]] = own, len(rest.ids) + len(first.ids) + np.cumsum(own) - own
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return pool[_ranges(starts, sizes)], bounds[np.append(at, len(sizes))]

    return encode


def token_lengths(documents: DataFrame, tokenizer: str, length: int = LENGTH, cache: int = CACHE, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, doc_tokens, the crc32 of the ids of each full stretch and of the rest, and the row's bucket with its rank among
    the rests of that length and the full stretches before it."""

    def work(batches):
        encode = _encoder(tokenizer, cache)
        bucket, seen, full, rows = TaskContext.get().partitionId() * _BUCKETS, np.zeros(length, np.int64), 0, 0
        for b in tk.slices(batches, limit=slice_bytes):
            ids, bounds = encode(pc.fill_null(b.column(1), "").cast(pa.string()))
            ids, bounds = np.insert(ids, bounds[1:], 0).astype("<u4"), bounds + np.arange(len(bounds))
            size = np.diff(bounds)
            data = memoryview(ids).cast("B")
            pieces = -(-size // length)
            cut = np.repeat(bounds[:-1] - length * (np.cumsum(pieces) - pieces), pieces) + length * np.arange(pieces.sum())
            end = np.minimum(cut + length, np.repeat(bounds[1:], pieces))
            crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(cut.tolist(), end.tolist())]
            where, rank, run = [], [], []
            for item, whole in zip((size % length).tolist(), (size // length).tolist()):
                if rows == BUCKET_ROWS:
                    bucket, full, rows = bucket + 1, 0, 0
                    seen[:] = 0
                where.append(bucket), rank.append(int(seen[item])), run.append(full)
                seen[item] += 1
                full += whole
                rows += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), tk.lists(crc, np.concatenate([[0], np.cumsum(pieces)]), pa.int64()), pa.array(where, pa.int64()), pa.array(rank, pa.int64()), pa.array(run, pa.int64())], ["doc_id", "doc_tokens", "crcs", "bucket", "rn", "run"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, doc_tokens bigint, crcs array<bigint>, bucket bigint, rn bigint, run bigint")


def _knapsack(size: np.ndarray, value: np.ndarray, limit: np.ndarray, cap: int) -> np.ndarray:
    """Copies of each item (at most ``limit``) of greatest total value within ``cap``: dynamic program over binary-split copies."""
    best = np.zeros(cap + 1)
    took = []
    for i in np.argsort(-value / size, kind="stable"):
        n, k = int(min(limit[i], cap // size[i])), 1
        while n > 0:
            c = min(k, n)
            n, k, w = n - c, 2 * k, c * int(size[i])
            if w > cap:
                break
            trial = best[: cap + 1 - w] + c * value[i]
            better = trial > best[w:] + 1e-12
            if better.any():
                took.append((i, c, w, better))
                best[w:] = np.where(better, trial, best[w:])
    out, at = np.zeros(len(size), np.int64), int(np.argmax(best))
    for i, c, w, better in reversed(took):
        if at >= w and better[at - w]:
            out[i] += c
            at -= w
    return out


def _greedy(sizes: np.ndarray, demand: np.ndarray, cap: int) -> list[np.ndarray]:
    """Starting columns: the longest item left, then ever the longest that still fits."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        col, space = np.zeros(len(sizes), np.int64), cap
        live = np.flatnonzero(left)
        while len(live := live[(sizes[live] <= space) & (left[live] > col[live])]):
            col[live[-1]] += 1
            space -= int(sizes[live[-1]])
        out.append(col)
        left -= col * int((left[col > 0] // col[col > 0]).min())
    return out


def _priced(sizes: np.ndarray, demand: np.ndarray, cap: int, gap: float) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractions of the linear program: min sum x, patterns x = demand, x >= 0."""
    n = len(sizes)
    a = np.diag(cap // sizes).astype(float)  # first basis: one size per pattern
    inv = np.diag(1 / np.diag(a))
    x = inv @ demand
    low = float((sizes * demand).sum()) / cap
    pool = np.stack(_greedy(sizes, demand, cap), axis=1).astype(float)
    while x.sum() > low * (1 + gap):
        dual = inv.sum(axis=0)
        gain = dual @ pool
        if gain.max() > 1 + 1e-6:
            col = pool[:, int(gain.argmax())]
        else:
            col = _knapsack(sizes, dual, np.full(n, cap), cap).astype(float)
            worth = dual @ col
            low = max(low, x.sum() / worth)  # no solution is below the value over the best price
            if worth <= 1 + 1e-6:
                break
            pool = np.concatenate([pool, col[:, None]], axis=1)
        d = inv @ col
        up = d > 1e-9
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        r = int(np.argmin(ratio))
        a[:, r] = col
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        row = inv[r] / d[r]
        inv -= np.outer(d, row)
        inv[r] = row
    return [(a[:, j].astype(np.int64), float(x[j])) for j in np.argsort(-x) if x[j] > 1e-9]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, cap: int = LENGTH, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies of each size) and how often each is used; every item is covered exactly."""
    n = len(sizes)
    if not n:
        return []
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    columns = _priced(sizes, demand, cap, gap) if n > 1 else []
    for whole in (True, False):  # rounded down, then the largest fractions that still fit
        for col, x in sorted(columns, key=lambda c: c[1] if whole else c[1] % 1, reverse=True):
            times = int(min(np.floor(x + 1e-9) if whole else x % 1 > 0.5, (left[col > 0] // col[col > 0]).min()))
            if times > 0:
                out.append((col, times))
                left -= col * times
    while left.any():  # what rounding left over: fullest pattern, as often as it fits
        live = np.flatnonzero(left)
        big = live[-1]  # the longest item is the hardest to place
        rest = _knapsack(sizes[live], sizes[live] * (1 + 1e-6 * np.arange(len(live))), left[live] - (live == big), cap - int(sizes[big]))
        col = np.zeros(n, np.int64)
        col[live] = rest
        col[big] += 1
        times = int((left[col > 0] // col[col > 0]).min())
        out.append((col, times))
        left -= col * times
    return out


def _slots(sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Per size: rows of (first rank, first sequence, offset); ranks run on through the rows."""
    rows: dict[int, list] = {int(s): [] for s in sizes}
    rank = dict.fromkeys(rows, 0)
    seq = 0
    for col, times in patterns:
        at = 0
        for i in np.flatnonzero(col)[::-1]:
            s = int(sizes[i])
            for _ in range(int(col[i])):
                rows[s].append((rank[s], seq, at))
                rank[s] += times
                at += s
        seq += times
    return {s: np.array(v, np.int64).reshape(-1, 3) for s, v in rows.items()} | {0: np.array([[0, seq, 0]])}


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, cache: int = CACHE, slice_bytes: int = SLICE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A task holds ``cache`` words and works on ``slice_bytes`` of text at a time: less memory for more time, the same result.
    """
    spark = documents.sparkSession
    docs = stored(token_lengths(documents, tokenizer, length, cache, slice_bytes)).withColumn("item", (F.col("doc_tokens") % length).cast("int")).withColumn("full", F.floor(F.col("doc_tokens") / length))
    by = stored(docs.groupBy("bucket", "item").agg(F.count("*").alias("n"), F.sum("full").alias("full")))
    hist = by.where("item > 0").groupBy("item").agg(F.sum("n").alias("n")).orderBy("item").collect()  # at most length - 1 rows
    sizes, demand = np.array([r["item"] for r in hist], np.int64), np.array([r["n"] for r in hist], np.int64)
    slots = _slots(sizes, cutting_stock(sizes, demand, length))
    packed = int(slots[0][0, 1])
    slots = spark.sparkContext.broadcast(slots)
    # where each bucket begins: in the ranks of a length, and among the full sequences
    first = by.withColumn("rank0", F.coalesce(F.sum("n").over(Window.partitionBy("item").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    block = by.groupBy("bucket").agg(F.sum("full").alias("full")).withColumn("group", F.floor(F.col("bucket") / (64 * _BUCKETS)))
    groups = block.groupBy("group").agg(F.sum("full").alias("g")).withColumn("g0", F.sum("g").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)))  # one row per 64 tasks
    seq0 = block.join(groups, "group").withColumn("seq0", F.coalesce("g0", F.lit(0)) + F.coalesce(F.sum("full").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = (
        docs.join(first.select("bucket", "item", "rank0"), ["bucket", "item"])
        .join(seq0.select("bucket", "seq0"), "bucket")
        .select("doc_id", "doc_tokens", "crcs", "item", (F.col("rn") + F.col("rank0")).cast("long").alias("rank"), (F.col("run") + F.col("seq0") + packed).cast("long").alias("seq"))
    )

    def work(batches):
        where = slots.value
        for b in batches:
            if not b.num_rows:
                continue
            item, rank, seq = (b.column(i).to_numpy() for i in (3, 4, 5))
            n_piece = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            last_seq, last_off = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
            for s in np.unique(item[item > 0]):
                at = np.flatnonzero(item == s)
                t = where[int(s)]
                k = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                last_seq[at], last_off[at] = t[k, 1] + rank[at] - t[k, 0], t[k, 2]
            src = np.repeat(np.arange(len(item)), n_piece)
            j = np.arange(len(src)) - np.repeat(np.cumsum(n_piece) - n_piece, n_piece)
            total = b.column(1).to_numpy()
            tail = (j == n_piece[src] - 1) & (item[src] > 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(src)), pa.array(j * length), pa.array(np.where(tail, item[src], length).astype(np.int64)), pc.list_flatten(b.column(2)), pa.array(total[src]), pa.array(np.where(tail, last_seq[src], seq[src] + j)), pa.array(np.where(tail, last_off[src], 0))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(work, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
