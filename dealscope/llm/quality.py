"""Quality rules: hashed word and character n-gram logistic regression.

A base of plain text statistics rejects texts outright; the verdict on the rest
comes from a logistic regression over hashed word 1- and 2-grams, hashed character (code point)
4-grams and a few dense statistics. It is fitted on a bounded sample of the
labelled rows (``MAX_LABELLED``, lowest hash of the id; a fifth of them is held
out for Platt calibration) and applied in Arrow batches to every text with the
fixed threshold ``THRESHOLD`` on the calibrated probability of good quality.

Defined results: null and empty texts have zero words, so base_failed; without
labels of both classes the model keeps everything; repeated label rows count
once with their lowest quality; null labels are ignored; repeated document rows
are scored row by row, and a labelled doc_id with several texts is learned from by the one that sorts first; a null doc_id is scored; an empty table gives no rows; very long texts
are scored whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table

MAX_LABELLED, THRESHOLD, BITS, EPOCHS = 2000, 0.5, 16, 150
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
N_DENSE = 5


def _count(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def text_statistics(column) -> dict[str, np.ndarray]:
    """Per row of a slice: the base counts, and the word hashes for the model."""
    data, off = tk.raw(column)
    n = len(off) - 1
    s, e, row = tk.words(data, off, tk.SPACES)
    h = tk.span_hash(data, s, e)
    bounds = tk.row_bounds(row, n)
    out = {"data": data, "off": off, "h": h, "row": row, "bounds": bounds, "n_words": np.diff(bounds)}
    out["word_chars"] = _count(tk.SPACES[data] & ((data & 0xC0) != 0x80), off)
    out["n_symbols"] = _count(_SYMBOLS[data], off)
    out["n_upper"] = _count(_UPPER[data], off)
    # lines with a word that equal an earlier line of the text
    at, line_end, line_row = tk.words(data, off, tk.word_table(b"\n"))
    has = np.concatenate([[0], np.cumsum(tk.SPACES[data], dtype=np.int64)])
    real = has[line_end] > has[at]
    at, line_end, line_row = at[real], line_end[real], line_row[real]
    lines = tk.mix(tk.span_hash(data, at, line_end) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(lines, return_index=True)
    again = np.ones(len(lines), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)
    # words inside 3-word windows that occur twice or more
    g = tk.ngram_hash(h, 3)
    same = np.flatnonzero(row[: len(g)] == row[2:]) if len(g) else np.zeros(0, np.int64)
    key = tk.mix(g[same] + row[same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    dup = np.zeros(len(k), bool)
    dup[1:] = k[1:] == k[:-1]
    dup[:-1] |= dup[1:]
    start = same[order[dup]]
    hit = np.zeros(len(h), bool)
    for j in range(3):
        hit[start + j] = True
    out["n_repeat_words"] = np.bincount(row[hit], minlength=n)
    return out


def _features(x: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the word n-grams and of the character n-grams."""
    m = np.uint64((1 << BITS) - 1)
    h, row, data, off = x["h"], x["row"], x["data"], x["off"]
    pair = tk.ngram_hash(h, 2)
    inside = np.flatnonzero(row[: len(pair)] == row[1:]) if len(pair) else np.zeros(0, np.int64)
    word = np.concatenate([h & m, pair[inside] & m]).astype(np.int64), np.concatenate([row, row[inside]])
    first = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    rows = np.searchsorted(off, first, side="right") - 1
    whole = np.flatnonzero(rows[: max(len(rows) - 3, 0)] == rows[3:])
    end = np.append(first, len(data))[whole + 4]
    char = (tk.span_hash(data, first[whole], end) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS), rows[whole]
    return [word, char]


def _dense(x: dict) -> np.ndarray:
    n, b = np.maximum(x["n_words"], 1), np.maximum(np.diff(x["off"]), 1)
    return np.stack([np.log1p(x["n_words"]) / 5, 5 * x["n_symbols"] / n, x["n_repeat_words"] / n, x["n_upper"] / b * 5, x["word_chars"] / n / 5], axis=1)


SCALE = 20.0


def _training_rows(labelled: DataFrame) -> list:
    def work(batches):
        for b in tk.slices(batches):
            x = text_statistics(b.column(1))
            n = b.num_rows
            cols, vals, rows = [], [], []
            for bucket, row in _features(x):
                size = np.maximum(np.bincount(row, minlength=n), 1)
                key, c = np.unique(row * np.int64(1 << (BITS + 1)) + bucket, return_counts=True)
                r = key >> (BITS + 1)
                rows.append(r)
                cols.append(key & ((1 << (BITS + 1)) - 1))
                vals.append(SCALE * c / size[r])
            r = np.concatenate(rows)
            order = np.argsort(r, kind="stable")
            bounds = tk.row_bounds(r[order], n)
            d = _dense(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), tk.lists(np.concatenate(cols)[order], bounds, pa.int32()), tk.lists(np.concatenate(vals)[order], bounds, pa.float32()), tk.lists(d.ravel(), np.arange(n + 1) * N_DENSE, pa.float32())],
                ["doc_id", "y", "at", "value", "dense"],
            )

    return labelled.mapInArrow(work, "doc_id bigint, y int, at array<int>, value array<float>, dense array<float>").toArrow()


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """Weights of the calibrated model; None weights where the labels have one class only."""
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("int").alias("y"))
    named = named.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = docs.join(F.broadcast(named), docs.doc_id == named.label_id)  # at most max_labelled ids
    t = _training_rows(own.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")))
    y = t["y"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return {"w": None}
    lens = pc.list_value_length(t["at"]).to_numpy()
    flat = t["at"].combine_chunks().flatten().to_numpy()
    val = t["value"].combine_chunks().flatten().to_numpy()
    dense = np.concatenate([t["dense"].combine_chunks().flatten().to_numpy().reshape(-1, N_DENSE), np.ones((len(y), 1))], axis=1).astype(np.float64)
    row = np.repeat(np.arange(len(y), dtype=np.int32), lens)
    order = np.argsort(t["doc_id"].to_numpy(), kind="stable")
    held = np.zeros(len(y), bool)
    held[order[::5]] = True
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    fit_rows = ~held[row]
    f_row, f_at, f_val = row[fit_rows], flat[fit_rows], val[fit_rows]
    weight = np.where(y > 0, 0.5 / max((y[~held] > 0).mean(), 1e-9), 0.5 / max((y[~held] <= 0).mean(), 1e-9)) * ~held
    weight /= weight.sum()
    w, v = np.zeros(2 << BITS), np.zeros(N_DENSE + 1)
    m1, m2, d1, d2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)
    for k in range(1, EPOCHS + 1):  # full-batch Adam on the bounded sample
        z = np.bincount(f_row, f_val * w[f_at], minlength=len(y)) + dense @ v
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gw, gv = np.bincount(f_at, f_val * g[f_row], minlength=len(w)) + 1e-6 * w, dense.T @ g + 1e-6 * v
        for p, q, s, grad in ((w, m1, m2, gw), (v, d1, d2, gv)):
            q += 0.1 * (grad - q)
            s += 0.01 * (grad * grad - s)
            p -= 0.05 * (q / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-9)
    z = np.bincount(row, val * w[flat], minlength=len(y)) + dense @ v
    a, c = 1.0, 0.0  # Platt scaling on the rows held out, with the class shares as they are
    zs, ys = (z[held], y[held]) if held.any() else (z, y)
    n1, n0 = ys.sum(), len(ys) - ys.sum()
    target = np.where(ys > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * zs + c, -30, 30)))
        r, s = target - p, p * (1 - p) + 1e-9
        hess = np.array([[(s * zs * zs).sum() + 1e-6, (s * zs).sum()], [(s * zs).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(r * zs).sum(), r.sum()]))
        a, c = a + np.clip(step[0], -1, 1), c + np.clip(step[1], -1, 1)
    return {"w": w, "v": v, "a": max(a, 1e-3), "c": c}


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score (probability of good quality) and kept, one row per document row."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def work(batches):
        m = model.value
        for b in tk.slices(batches):
            x = text_statistics(b.column(1))
            n = b.num_rows
            z = np.full(n, 30.0)
            if m["w"] is not None:
                z = np.concatenate([_dense(x), np.ones((n, 1))], axis=1) @ m["v"]
                for bucket, row in _features(x):
                    z += SCALE * np.bincount(row, m["w"][bucket], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
                z = m["a"] * z + m["c"]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
            cols = [pa.array(x[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The document rows that the rules keep, all columns as they are (row by row, without a join)."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    names = documents.columns

    def work(batches):
        m = model.value
        for b in tk.slices(batches):
            x = text_statistics(b.column(names.index("text")))
            n = b.num_rows
            ok = ~((x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"]))
            if m["w"] is not None:
                z = np.concatenate([_dense(x), np.ones((n, 1))], axis=1) @ m["v"]
                for bucket, row in _features(x):
                    z += SCALE * np.bincount(row, m["w"][bucket], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
                ok &= m["a"] * z + m["c"] >= np.log(threshold / (1 - threshold))
            yield b.filter(pa.array(ok))

    return documents.mapInArrow(work, documents.schema)
