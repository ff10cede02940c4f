"""Exact substring dedup by threshold-bounded interval expansion over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id. Sorting every suffix of the corpus would shuffle
many times the input, so suffixes are sampled by content: each LENGTH-byte window
is filed under its minimizer, the least hash among its ``GRAM``-byte strings.
Equal windows have equal minimizers at the same place, so only suffixes that
start at minimizers are compared, with others of the same string, and no
equal pair is lost. Two thin passes find the suffixes that can matter: the minimizer must occur in another document, and
so must the minimizer with ``SIDE`` bytes more to the left or to the right, as a window has that many on one side.

Suffixes of a minimizer meet with the bytes around them. Those with equal surroundings need no comparison but for the one of the smallest doc_id.
The others are sorted; intervals of rows
with a common prefix are expanded breadth first: at step t the suffix start moves
back by one byte (the character of the Burrows-Wheeler column splits an
interval) while the prefix that must agree ahead shrinks to LENGTH - t (intervals
merge), so common strings of exactly LENGTH bytes come out for each t. Groups of more than ``HOT`` such rows go on as
single windows, which Spark counts without bringing a group together.

Copies of whole texts collapse to their smallest doc_id first. Bitmaps of bounded size tell the tasks what the thin passes
found; what they let through beyond that is compared and removes nothing.

Defined results: null text is empty, empty and short texts lose nothing;
rows with the same doc_id do not remove from each other; null doc_id loses and
removes nothing; an empty table gives no rows; texts of over ``CHUNK`` bytes are searched in overlapping pieces that hold every window; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import bitmap, drop, in_bitmap, stored, table

LENGTH, GRAM, CHUNK, UNIT, HOT, ROWS = 50, 24, 1 << 22, 1_000_000, 20_000, 20_000
_SPAN = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM + 1) // 2
_LOW = np.uint64((1 << 24) - 1)


def _runs(data: np.ndarray, off: np.ndarray):
    """Runs of windows with one minimizer: row, first window, windows, minimizer's place in the run, its hash."""
    n = len(data)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64)
    if n > CHUNK:  # a very long text: windows are independent, so any cut will do
        parts = []
        for at in range(0, n - LENGTH + 1, CHUNK - LENGTH + 1):
            end = min(n, at + CHUNK)
            r, j, w, a, h = _runs(data[at:end], np.clip(off, at, end) - at)
            parts.append((r, j + at, w, a, h))
        return tuple(np.concatenate(p) for p in zip(*parts))
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    g = tk.mix(x[:-16] * np.uint64(0x9E3779B97F4A7C15) + (x[8:-8] ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB) + (x[16:] ^ np.uint64(0x8EBC6AF09C88C6E3)) * np.uint64(0x589965CC75374CC3))
    m = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    k = 1
    while 2 * k <= _SPAN:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    m = np.minimum(m[: len(m) - (_SPAN - k)], m[_SPAN - k :])
    pos = (m & _LOW).astype(np.int64)
    size = np.diff(off)
    valid = np.zeros(len(pos), bool)
    for s, e in zip(off[:-1][size >= LENGTH].tolist(), off[1:][size >= LENGTH].tolist()):
        valid[s : e - LENGTH + 1] = True
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    breaks = np.flatnonzero(new | ~valid)
    last = np.append(breaks, len(pos))[np.searchsorted(breaks, first, side="right")]
    return np.searchsorted(off, first, side="right") - 1, first, last - first, pos[first] - first, g[pos[first]]


def _side_keys(data, off, row, at):
    """Hashes of the minimizers at ``at`` with SIDE bytes more to the left and to the right, and whether the text has these."""
    left, right = at - SIDE >= off[row], at + GRAM + SIDE <= off[row + 1]
    keys = np.zeros((2, len(at)), np.uint64)
    if len(at):
        keys[0, left] = tk.span_hash(data, at[left] - SIDE, at[left] + GRAM)
        keys[1, right] = tk.mix(tk.span_hash(data, at[right], at[right] + GRAM + SIDE) + np.uint64(1))
    return keys, np.stack([left, right])


def _shared_keys(docs: DataFrame, known=None, bits: int = 0) -> DataFrame:
    """(h): minimizers that several documents hold, or, of the minimizers that the bitmap lets through, such keys with one side."""
    near = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def combined(parts):
        h, d = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((d, h))
        hs, ds = h[order], d[order]
        first = np.flatnonzero(tk.starts(hs))
        last = np.append(first[1:], len(hs)) - 1
        several = ds[first] != ds[last]
        keep = np.sort(np.concatenate([order[first], order[last[several]]]))  # in the order of documents, which compresses well
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(d[keep])], ["h", "doc"])

    def keys(batches):
        parts, size = [], 0
        for b in tk.slices(batches):
            data, off = tk.raw(b.column(1))
            row, j, _, a, h = _runs(data, off)
            if near is not None:
                ok = in_bitmap(near.value, h, bits)
                row, at = row[ok], (j + a)[ok]
                k, there = _side_keys(data, off, row, at)
                h, row = np.concatenate([k[i][there[i]] for i in (0, 1)]), np.concatenate([row[there[i]] for i in (0, 1)])
            if len(h):
                parts.append((h, b.column(0).to_numpy()[row]))
                size += len(h)
            if size > UNIT:
                yield combined(parts)
                parts, size = [], 0
        if parts:
            yield combined(parts)

    def several(batches):
        """Of rows sorted by h: each h with more than one doc."""
        last_h, last_d, told = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            h, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            first = np.flatnonzero(tk.starts(h))
            lo, hi = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
            many = lo != hi
            if last_h is not None and h[0] == last_h:
                many[0] = not told and (many[0] or lo[0] != last_d)
                told = told or bool(many[0])
            else:
                told = False
            yield pa.RecordBatch.from_arrays([pa.array(h[first][many])], ["h"])
            if len(first) > 1 or h[-1] != last_h:
                told = bool(many[-1])
            last_h, last_d = h[-1], d[-1]

    rows = docs.select("doc_id", "text").mapInArrow(keys, "h bigint, doc bigint").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(several, "h bigint")


def _as_bitmap(found: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap with room for the hashes: of 8 to 128 MB, whatever their number."""
    found = stored(found)
    bits = min(30, max(26, math.ceil(math.log2(8 * max(found.count(), 1)))))
    out = bitmap(found, bits=bits), bits
    drop(found)
    return out


def _suffixes(docs: DataFrame, known: tuple[np.ndarray, int], sides: tuple[np.ndarray, int]) -> DataFrame:
    """(h, ctx, doc, tid, j, n, a, bytes): runs of windows whose minimizer and one side pass the bitmaps.

    Of runs with equal surroundings in a slice only those of its smallest doc go on; the others are settled here, and travel
    with a below 0, without bytes, under keys of their own, so that no common passage gathers its documents in one task.
    """
    near = docs.sparkSession.sparkContext.broadcast((known, sides))

    def work(batches):
        (bits1, n1), (bits2, n2) = near.value
        for b in tk.slices(batches):
            data, off = tk.raw(b.column(2))
            row, j, n, a, h = _runs(data, off)
            ok = np.flatnonzero(in_bitmap(bits1, h, n1))
            k, there = _side_keys(data, off, row[ok], (j + a)[ok])
            ok = ok[(there[0] & in_bitmap(bits2, k[0], n2)) | (there[1] & in_bitmap(bits2, k[1], n2))]
            row, j, n, a, h = row[ok], j[ok], n[ok], a[ok], h[ok]
            size, doc = n + LENGTH - 1, b.column(0).to_numpy()[row]
            ctx = tk.mix(tk.span_hash(data, j, j + size) + a.astype(np.uint64)) if len(j) else h
            order = np.lexsort((doc, ctx, h))
            first = tk.starts(h[order], ctx[order])
            least = doc[order][first][np.cumsum(first) - 1]
            done = np.zeros(len(j), bool)
            done[order] = doc[order] > least
            size, a = np.where(done, 0, size), np.where(done, -1, a)
            h = np.where(done, tk.mix(doc.view(np.uint64) + j.astype(np.uint64)), h)
            flat = data[np.repeat(j - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            blob = pa.Array.from_buffers(pa.binary(), len(j), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc), b.column(1).take(pa.array(row)), pa.array(j - off[row]), pa.array(n.astype(np.int32)), pa.array(a.astype(np.int32)), blob],
                ["h", "ctx", "doc", "tid", "j", "n", "a", "bytes"],
            )

    return docs.select("doc_id", "tid", "text").mapInArrow(work, "h bigint, ctx bigint, doc bigint, tid bigint, j bigint, n int, a int, bytes binary")


def expand_intervals(h, doc, left, right, n_left, n_right):
    """For each row and step t whether the window that starts t bytes before the suffix also occurs at a smaller doc.

    left: rows x (LENGTH - GRAM) bytes before the suffix, nearest first; right: rows x LENGTH bytes from its start.
    """
    rows = len(h)
    words = np.zeros((rows, 56), np.uint8)
    words[:, :LENGTH] = right
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], h))
    h, doc, left, right, n_left, n_right = (v[order] for v in (h, doc, left, right, n_left, n_right))
    lcp = np.full(rows, -1)
    if rows > 1:
        same = np.concatenate([right[1:] == right[:-1], np.zeros((rows - 1, 1), bool)], axis=1)
        lcp[1:] = np.where(h[1:] == h[:-1], same.argmin(axis=1), -1)
    out = np.zeros((rows, _SPAN), bool)
    code = np.zeros(rows, np.uint64)
    for t in range(_SPAN):
        if t:
            code = tk.mix(code * np.uint64(0xD6E8FEB86659FD93) + left[:, t - 1].astype(np.uint64) + np.uint64(1))
        live = np.flatnonzero((n_left >= t) & (n_right >= LENGTH - t))
        if len(live) < 2:
            continue
        interval = np.cumsum(lcp < LENGTH - t)[live]
        by = np.lexsort((doc[live], code[live], interval))
        live, interval = live[by], interval[by]
        start = np.ones(len(live), bool)
        start[1:] = (interval[1:] != interval[:-1]) | (code[live][1:] != code[live][:-1])
        least = doc[live][start][np.cumsum(start) - 1]
        out[live[least < doc[live]], t] = True
    back = np.empty(rows, np.int64)
    back[order] = np.arange(rows)
    return out[back]


_KINDS = "doc bigint, tid bigint, s bigint, e bigint, w binary"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def _rows_out(doc, tid, s, e, w=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tid), pa.array(s), pa.array(e), pa.nulls(len(doc), pa.binary()) if w is None else w], ["doc", "tid", "s", "e", "w"])


def _expanded(h, doc, tid, j, a, data, off) -> pa.RecordBatch:
    """Ranges of windows that a smaller doc of the group holds."""
    begin, size, a = off[:-1], np.diff(off), a.astype(np.int64)
    step, back = np.arange(LENGTH), np.arange(LENGTH - GRAM)
    n_right = np.minimum(size - a, LENGTH)
    right = np.where(step < n_right[:, None], data[np.minimum((begin + a)[:, None] + step, len(data) - 1)], 0).astype(np.uint8)
    left = np.where(back < a[:, None], data[np.maximum((begin + a)[:, None] - 1 - back, 0)], 0).astype(np.uint8)
    r, t = np.nonzero(expand_intervals(h, doc, left, right, a, n_right))
    at = j[r] + a[r] - t
    by = np.lexsort((at, r))
    r, at = r[by], at[by]
    s = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)])) if len(r) else r
    e = np.append(s[1:], len(r)) - 1 if len(r) else r
    return _rows_out(doc[r[s]], tid[r[s]], at[s], at[e])


def _windows_of(doc, tid, j, n, data, off) -> pa.RecordBatch:
    """Every window of the runs by itself."""
    n = n.astype(np.int64)
    run = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    flat = data[(off[:-1][run] + i)[:, None] + np.arange(LENGTH)]
    w = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(run), [None, pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
    at = j[run] + i
    return _rows_out(doc[run], tid[run], at, at, w)


def _settled(batches, most: int, at_once: int):
    """(doc, tid, s, e, w) from suffixes sorted by h, ctx and doc: repeated ranges of windows, or single windows (w) of groups of over ``most`` rows.

    Rows whose surroundings a smaller doc has are settled at once. The others wait, ``at_once`` at a time, until their group is whole.
    """
    wait, hot, key, least = [], None, None, 0  # waiting rows, the group that goes on as windows, the last h and ctx with their least doc

    def packed(rows):
        cols = [np.concatenate(c) for c in zip(*(r[:6] for r in rows))]
        data = np.concatenate([r[6] for r in rows])
        return (*cols, data, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(r[7]) for r in rows]))]))

    def some(rows, at):
        h, doc, tid, j, n, a, data, off = rows
        size = np.diff(off)[at]
        flat = data[np.repeat(off[:-1][at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        return h[at], doc[at], tid[at], j[at], n[at], a[at], flat, np.concatenate([[0], np.cumsum(size)])

    for b in batches:
        if not b.num_rows:
            continue
        h, ctx, doc, tid, j, n, a = (b.column(i).to_numpy() for i in range(7))
        data, off = _bytes_of(b.column(7))
        sure = a < 0
        if sure.any():
            yield _rows_out(doc[sure], tid[sure], j[sure], j[sure] + n[sure] - 1)
            ctx = ctx[~sure]
            h, doc, tid, j, n, a, data, off = some((h, doc, tid, j, n, a, data, off), np.flatnonzero(~sure))
            if not len(h):
                continue
        new = tk.starts(h, ctx)
        if key == (h[0], ctx[0]):
            new[0] = False
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        lo = np.where(run >= 0, doc[first[np.maximum(run, 0)]] if len(first) else 0, least)
        key, least = (h[-1], ctx[-1]), lo[-1]
        done = doc > lo
        if done.any():
            yield _rows_out(doc[done], tid[done], j[done], j[done] + n[done] - 1)
        rows = some((h, doc, tid, j, n, a, data, off), np.flatnonzero(~done))
        if hot is not None and len(rows[0]):
            own = rows[0] == hot
            if own.any():
                part = some(rows, np.flatnonzero(own))
                yield _windows_of(part[1], part[2], part[3], part[4], part[6], part[7])
                rows = some(rows, np.flatnonzero(~own))
            if h[-1] != hot:
                hot = None
        if len(rows[0]):
            wait.append(rows)
        if sum(len(r[0]) for r in wait) < at_once:
            continue
        rows = packed(wait)
        last = np.flatnonzero(rows[0] == rows[0][-1])  # sorted by h: the end, whose group may go on
        whole = np.arange(last[0])
        if len(whole):
            part = some(rows, whole)
            yield _expanded(part[0], part[1], part[2], part[3], part[5], part[6], part[7])
        wait = [some(rows, last)]
        if len(last) > most:
            part, wait, hot = wait[0], [], rows[0][-1]
            yield _windows_of(part[1], part[2], part[3], part[4], part[6], part[7])
    if wait:
        part = packed(wait)
        yield _expanded(part[0], part[1], part[2], part[3], part[5], part[6], part[7])


def repeated_spans(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tid, text), and (doc, tid, spans): per text the window ranges that start in a smaller doc; whole is set for copies of a whole text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")), F.length("text")).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    first = stored(named.select("doc_id", "tid", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("lo"), F.count("*").alias("size"), F.any_value("tid").alias("tid")).where("size > 1").select("tid", "lo"))
    copies = stored(named.select("doc_id", "tid").join(first, "tid").where("lo < doc_id").select("doc_id", "tid").distinct())
    reps = named.join(copies, ["doc_id", "tid"], "left_anti")
    known = _as_bitmap(_shared_keys(reps))
    sides = _as_bitmap(_shared_keys(reps, *known))
    most, at_once = HOT, ROWS
    found = stored(_suffixes(reps, known, sides).repartition("h").sortWithinPartitions("h", "ctx", "doc").mapInArrow(lambda batches: _settled(batches, most, at_once), _KINDS))
    single = found.where("w is not null")
    least = single.groupBy("w").agg(F.min("doc").alias("lo"))
    windows = single.join(least, "w").where("lo < doc").select("doc", "tid", "s", "e")
    spans = found.where("w is null").select("doc", "tid", "s", "e").union(windows).groupBy("doc", "tid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    full = copies.select(F.col("doc_id").alias("doc"), "tid", F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("e"))).alias("spans"))
    out = stored(spans.union(full))
    drop(first, found, copies)
    return rows, out


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (byte ranges) and kept_sha256 of every row."""
    rows, spans = repeated_spans(documents)

    def work(batches):
        for b in tk.slices(batches):
            out = []
            for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode()
                gone: list[list[int]] = []
                for m in sorted(marks or [], key=lambda m: m["s"]):
                    s, e = m["s"], (len(raw) if m["e"] < 0 else m["e"] + LENGTH)
                    if gone and s <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([s, e])
                kept, at = hashlib.sha256(), 0
                for s, e in gone:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((len(raw), sum(e - s for s, e in gone), len(gone), gone, kept.hexdigest()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.list_(pa.int64()))), pa.array(cols[4])], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"])

    joined = rows.join(spans.withColumnRenamed("doc", "doc_id"), ["doc_id", "tid"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<array<bigint>>, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("removed")


ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, x, unnest(range(0, length(x) // 2 - 49)) as j from d),
g as (select md5(substr(x, 2 * j + 1, 100)) as k, doc_id, j from w),
f as (select k, min(doc_id) as lo from g group by k having min(doc_id) < max(doc_id)),
hit as (select doc_id, j, j - row_number() over (partition by doc_id order by j) as island from g join f using (k) where lo < doc_id),
runs as (select doc_id, min(j) as s, max(j) + 50 as e from hit group by doc_id, island),
glued as (select *, sum(fresh) over (partition by doc_id order by s) as run from
  (select *, case when s > max(e) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from runs)),
gone as (select doc_id, run, min(s) as s, max(e) as e from glued group by doc_id, run),
cuts as (select doc_id, s, e, lag(e, 1, 0::bigint) over (partition by doc_id order by s) as since from gone),
kept as (select doc_id, string_agg(substr(x, 2 * since + 1, 2 * (s - since)), '' order by s) || substr(any_value(x), 2 * max(e) + 1) as y, sum(e - s) as n_removed, count(*) as n_spans
  from cuts join d using (doc_id) group by doc_id)
select d.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(from_hex(coalesce(y, x))) as kept_sha256
from d left join kept using (doc_id)
"""
