"""Language identification with a string kernel.

Blended-spectrum presence kernel: a text is the set of its byte 1- to 4-grams
(lower case, hashed to ``BUCKETS``); k(x, y) = |x and y| / sqrt(|x| |y|).
A Nystroem map over landmark texts and a one-versus-rest kernel ridge
regression are fitted on a bounded sample (``PER_LANG`` texts of each language, fewer where that is over ``SAMPLE`` in
all, but at least ``FEW``, and ``LANDMARKS`` landmarks; drawn by a hash of id and text). Every language is learned, however many there are. Scoring is one matrix
product per block of texts: landmarks, Nystroem map and ridge weights are
folded into one weight per bucket and language, which is algebraically the
same as going through the landmarks.

Only rows whose crc32(doc_id as text) mod 4 is not 2 and whose lang is not null
are learned from; lang, source and doc_id are no inputs of a prediction.

Defined results: null text or text without a letter gives ``und`` and score 0;
with nothing to learn from every text is ``und``; null doc_id is not held out; repeated rows are one example and are predicted row by row; an empty table
gives no rows; very long texts are read whole; ties go to the language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import table

BUCKETS, PER_LANG, LANDMARKS, RIDGE, ROWS, SAMPLE, FEW = 1 << 14, 400, 256, 1e-3, 256, 12_000, 8


def presence(column) -> np.ndarray:
    """rows x BUCKETS flags: which hashed n-grams a text holds."""
    data, off = tk.raw(pc.utf8_lower(column))
    n = len(off) - 1
    out = np.zeros(n * BUCKETS, bool)
    base = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))
    g = np.zeros(len(data), np.uint32)
    for k in range(1, 5):
        m = len(data) - k + 1
        if m <= 0:
            break
        g = g[:m] | data[k - 1 :].astype(np.uint32) << np.uint32(8 * (k - 1))
        fits = left[:m] >= k
        bucket = ((g * np.uint32(2654435761) ^ np.uint32(0x5BD1E995 * k & 0xFFFFFFFF)) * np.uint32(2246822519)) >> np.uint32(32 - 14)
        out[base[:m][fits] + bucket[fits]] = True
    return out.reshape(n, BUCKETS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(documents: DataFrame) -> dict:
    """Languages and the folded weights, learned from a bounded sample of the rows that are not held out."""
    pool = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    slot = F.xxhash64("doc_id", "text")
    counts = pool.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return {"langs": []}
    per = max(FEW, min(PER_LANG, SAMPLE // len(counts)))
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * per / r["count"])))))
    drawn = pool.select("lang", "text", slot.alias("slot")).where(F.pmod("slot", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    drawn = drawn.groupBy("lang", "slot").agg(F.first("text").alias("text"))  # repeated rows once

    def work(batches):
        for b in tk.slices(batches):
            for i in range(0, b.num_rows, ROWS):
                c = b.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([np.packbits(r).tobytes() for r in presence(c.column(2))], pa.binary())], ["slot", "lang", "bits"])

    got = drawn.select("slot", "lang", "text").mapInArrow(work, "slot bigint, lang string, bits binary").toPandas()
    got = got.sort_values(["lang", "slot"]).groupby("lang").head(2 * per)
    langs = sorted(got["lang"].unique())
    bits = np.stack([np.frombuffer(b, np.uint8) for b in got["bits"]])
    rows = lambda at: _unit(np.unpackbits(bits[at], axis=1).astype(np.float32))
    y = (got["lang"].to_numpy()[:, None] == np.array(langs)[None, :]).astype(np.float32)
    pick = np.unique(np.linspace(0, len(bits) - 1, min(LANDMARKS, len(bits))).astype(int))
    land = rows(pick)
    vals, vecs = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = vals > vals.max() * 1e-6
    root = vecs[:, good] / np.sqrt(vals[good])  # K_mm ** -1/2
    z = np.concatenate([rows(slice(i, i + 512)) @ land.T for i in range(0, len(bits), 512)]).astype(np.float64) @ root  # a block of rows at a time
    balance = 1 / y.sum(axis=0)[y.argmax(axis=1)]
    zw = z * balance[:, None]
    w = np.linalg.solve(zw.T @ z + RIDGE * np.eye(z.shape[1]), zw.T @ y)
    return {"langs": langs, "V": (land.T @ (root @ w)).astype(np.float32)}


def predict(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per document row."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents))

    def work(batches):
        m = model.value
        for big in tk.slices(batches):
            for i in range(0, big.num_rows, ROWS):
                b = big.slice(i, ROWS)
                letters = pc.fill_null(pc.match_substring_regex(b.column(1), r"\pL"), False).to_numpy(zero_copy_only=False)
                names, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
                if m["langs"]:
                    s = _unit(presence(b.column(1)).astype(np.float32)) @ m["V"]
                    best = s.argmax(axis=1)
                    e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                    score = np.where(letters, 1 / e.sum(axis=1), 0.0)
                    names = np.where(letters, np.array(m["langs"], object)[best], "und")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(names), pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
