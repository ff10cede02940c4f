"""Line dedup with a log-template tree.

Lines are parsed by a tree of fixed depth: token count, then the ``DEPTH`` leading
tokens (a token with a digit is a wildcard from the start). A line that recurs by itself is a template. The other
lines of a leaf generalise: each proposes templates in which one field of up to ``FIELD`` tokens behind the leading ones, or one or two of
``PARTS`` equal parts of the rest (single tokens in short lines) are wildcards, as long as ``SIMILARITY`` of its tokens stay; so a leaf holds any number of
templates, and proposals grow with the length of the lines only.
A template that recurs in ``MIN_DOCS`` unrelated documents is dropped from all documents.

Documents are related if they are copies. The marks of a line in a document are the least hashes of the 5-word shingles of
the document's other lines (lines of other text) under ``len(_SEEDS)`` hash functions. Near copies share most marks, documents that share just
templates do not: the share of different marks among the different texts that hold a template is, on average over the functions, the share of
the shingles around it that are the documents' own, whatever the number of documents. It must be ``SPREAD`` (copies with a similarity of 0.8 have 0.11, and somewhat more in small groups). A line with
nothing around it has the same marks in every document, so documents that are a single line are never emptied.

Leaves reach the tasks as a bitmap of fixed size, which lets through more than these and loses none. Dropped lines
reach them as 64-bit hashes if they are at most ``BROADCAST``, and by a join beyond that.

Defined results: null text stays null and has no lines; blank lines and lines that are all wildcards always stay; an empty
table gives an empty one; repeated rows are cut alike and count as one text; lines of a very long text are treated like others; all other
columns are kept as they are, and the new column's name gets underscores until it clashes with none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import bitmap, drop, in_bitmap, stored, table

DEPTH, SIMILARITY, FIELD, MIN_DOCS, SPREAD, SHINGLE, PARTS, BROADCAST = 3, 0.7, 3, 10, 0.25, 5, 9, 4_000_000
_NEWLINE = tk.word_table(b"\n")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WILD = np.uint64(0x2A)
_SEEDS = tuple(np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1)) for k in range(1, 17))


def _lines(column, every: bool = False):
    """Word hashes, masked hashes, and per line with a token that is no wildcard (or ``every`` line with a token): byte range, row, first and last token, leaf and masked-line hash."""
    data, off = tk.raw(column)
    s, e, _ = tk.words(data, off, tk.SPACES)
    h = tk.span_hash(data, s, e)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    masked = np.where(digits[e] > digits[s], _WILD, h)
    ls, le, lrow = tk.words(data, off, _NEWLINE)
    t0, t1 = np.searchsorted(s, ls), np.searchsorted(s, le)
    wild = np.concatenate([[0], np.cumsum(masked == _WILD)])
    real = (t1 > t0) & (every | (wild[t1] - wild[t0] < t1 - t0))
    ls, le, lrow, t0, t1 = ls[real], le[real], lrow[real], t0[real], t1[real]
    whole = tk.mix(tk.sequence_hash(masked, t0, t1) + (t1 - t0).astype(np.uint64))
    leaf = tk.mix(tk.sequence_hash(masked, t0, np.minimum(t0 + DEPTH, t1)) + (t1 - t0).astype(np.uint64) * _SEEDS[0])
    return data, off, h, masked, ls, le, lrow, t0, t1, leaf, whole


def _around(own: np.ndarray, g: np.ndarray, lrow: np.ndarray, t0: np.ndarray, t1: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """Per line (own: hashes of the lines, g: of the shingles) the least shingle hash of the lines of its document that differ from it; 0 if there are none."""
    small = lambda v: (v * (seed | np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    least = small(own)  # a short line is one shingle
    long = np.flatnonzero(t1 - t0 >= SHINGLE)
    if len(long):
        ends = np.stack([t0[long], t1[long] - SHINGLE + 1], axis=1).ravel()
        least[long] = np.minimum.reduceat(np.append(small(g), np.uint32(2**32 - 1)), ends)[::2]
    order = np.lexsort((least, lrow))
    new = tk.starts(lrow[order], least[order])
    r, v = lrow[order][new], least[order][new]
    at = tk.row_bounds(r, n)
    v = np.append(v, np.zeros(2, np.uint32))
    first = v[at[:-1]]
    second = np.where(np.diff(at) > 1, v[at[:-1] + 1], np.uint32(0))
    return np.where(least == first[lrow], second[lrow], first[lrow])


def _marks(rows: np.ndarray) -> pa.Array:
    return tk.lists(rows.ravel().view(np.int32), len(_SEEDS) * np.arange(len(rows) + 1), pa.int32())


def _line_rows(documents: DataFrame) -> DataFrame:
    """(leaf, line, body, marks): the different lines of every text."""

    def work(batches):
        for b in tk.slices(batches):
            data, off, h, masked, _, _, lrow, t0, t1, leaf, whole = _lines(b.column(0), every=True)
            if not len(lrow):
                continue
            n = b.num_rows
            body = tk.span_hash(data, off[:-1].clip(0, len(data) - 1), off[1:])[lrow]
            g = tk.ngram_hash(h, SHINGLE)
            own = tk.sequence_hash(h, t0, t1)
            marks = np.stack([_around(own, g, lrow, t0, t1, n, s) for s in _SEEDS], axis=1)
            wild = np.concatenate([[0], np.cumsum(masked == _WILD)])
            order = np.lexsort((whole, body))
            at = order[tk.starts(body[order], whole[order]) & (wild[t1] - wild[t0] < t1 - t0)[order]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at].view(np.int64)) for c in (leaf, whole, body)), _marks(marks[at])], ["leaf", "line", "body", "marks"])

    return documents.select("text").mapInArrow(work, "leaf bigint, line bigint, body bigint, marks array<int>")


def _leaf_tokens(documents: DataFrame, leaves: np.ndarray) -> DataFrame:
    """(line, tokens): the different lines of the leaves that the bitmap lets through."""
    known = documents.sparkSession.sparkContext.broadcast(leaves)

    def work(batches):
        for b in tk.slices(batches):
            *_, masked, _, _, _, t0, t1, leaf, whole = _lines(b.column(0))
            at = np.flatnonzero(in_bitmap(known.value, leaf) & (t1 - t0 > DEPTH))
            _, first = np.unique(whole[at], return_index=True)
            at = at[first]
            n = t1[at] - t0[at]
            flat = np.repeat(t0[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(whole[at].view(np.int64)), tk.lists(masked[flat].view(np.int64), np.concatenate([[0], np.cumsum(n)]), pa.int64())], ["line", "tokens"])

    return documents.select("text").mapInArrow(work, "line bigint, tokens array<bigint>")


def generalised(tokens: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Hashes of the templates that a line proposes: a field of 1 to FIELD tokens, or one or two of PARTS parts, as wildcards."""
    n, most = len(tokens), int((1 - similarity) * len(tokens) + 1e-9)
    place = np.arange(n, dtype=np.uint64) * _SEEDS[0]
    own = tk.mix(tokens + place)
    total = own.sum() + np.uint64(n) * _SEEDS[1]
    gain = (tk.mix(_WILD + place) - own)[DEPTH:]
    up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gain)])
    sums = [up[w:] - up[:-w] for w in range(1, min(FIELD, most, len(gain)) + 1)]
    cuts = np.unique(np.linspace(0, len(gain), min(PARTS, len(gain)) + 1).astype(int))
    part, size = up[cuts[1:]] - up[cuts[:-1]], np.diff(cuts)
    i, j = np.triu_indices(len(part))  # a part with itself: that part alone
    fits = np.where(i == j, size[i], size[i] + size[j]) <= most
    sums.append(np.where(i == j, part[i], part[i] + part[j])[fits])
    return np.unique(tk.mix(total + np.concatenate(sums))) if sums else np.zeros(0, np.uint64)


def _proposals(lines: DataFrame, similarity: float, by_line: bool) -> DataFrame:
    """(line, template) of rows (line, tokens, uses), or (template, body, marks), once in each Arrow batch."""

    def work(batches):
        for b in (big.slice(i, 256) for big in batches for i in range(0, big.num_rows, 256)):
            tokens = b.column(1)
            off, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
            found = [generalised(flat[s:e], similarity) for s, e in zip(off, off[1:])]
            size = np.array([len(f) for f in found], np.int64)
            template = np.concatenate([*found, np.zeros(0, np.uint64)])
            line = np.repeat(np.arange(b.num_rows), size)
            if by_line:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(line)), pa.array(template.view(np.int64))], ["line", "template"])
                continue
            uses = b.column(2)
            held = np.diff(uses.offsets.to_numpy())
            body, marks = uses.values.field(0).to_numpy(), uses.values.field(1).values.to_numpy().reshape(-1, len(_SEEDS))
            use = np.repeat(uses.offsets.to_numpy()[:-1][line] - np.cumsum(held[line]) + held[line], held[line]) + np.arange(held[line].sum())
            template = np.repeat(template, held[line])
            order = np.lexsort((body[use], template))
            at = order[tk.starts(template[order], body[use][order])]
            yield pa.RecordBatch.from_arrays([pa.array(template[at].view(np.int64)), pa.array(body[use[at]]), _marks(marks[use[at]].view(np.uint32))], ["template", "body", "marks"])

    return lines.select("line", "tokens", "uses").mapInArrow(work, "line bigint, template bigint" if by_line else "template bigint, body bigint, marks array<int>")


def _recurring(uses: DataFrame, key: str, min_docs: int, spread: float) -> DataFrame:
    """The keys with enough unrelated documents, from rows (key, body, marks), one for each key and body."""
    often = uses.groupBy(key).agg(F.count("*").alias("bodies")).where(F.col("bodies") >= min_docs)
    kinds = range(len(_SEEDS))
    marks = uses.join(often.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("bodies"), *(F.count_distinct(F.col("marks")[i]).alias(f"d{i}") for i in kinds))
    return marks.where(sum(F.col(f"d{i}") - 1 for i in kinds) >= len(kinds) * spread * (F.col("bodies") - 1)).select(key)


def recurring_lines(documents: DataFrame, min_docs: int = MIN_DOCS, spread: float = SPREAD, similarity: float = SIMILARITY) -> DataFrame:
    """(line): masked-line hashes whose template recurs across unrelated documents."""
    rows = stored(_line_rows(documents).groupBy("leaf", "line", "body").agg(F.first("marks").alias("marks")))
    alone = _recurring(rows, "line", min_docs, spread)
    few = rows.groupBy("line").agg(F.count("*").alias("n"), F.min("leaf").alias("leaf")).where(F.col("n") < min_docs)
    # a leaf of fewer such lines cannot hold a template of them that recurs often enough
    leaves = few.groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    tokens = _leaf_tokens(documents, bitmap(leaves, "leaf")).groupBy("line").agg(F.first("tokens").alias("tokens"))
    rare = rows.join(few.select("line"), "line").groupBy("line").agg(F.collect_list(F.struct("body", "marks")).alias("uses"))  # fewer than min_docs each
    lines = stored(tokens.join(rare, "line").repartition(64, "line"))
    uses = stored(_proposals(lines, similarity, by_line=False).dropDuplicates(["template", "body"]))
    good = _recurring(uses, "template", min_docs, spread)
    found = _proposals(lines, similarity, by_line=True).join(good, "template").select("line")
    out = stored(alone.union(found).distinct())
    drop(rows, lines, uses)
    return out


def _without(text: str, gone: set[int]) -> tuple[str, list[int]]:
    """The text without the lines that start at the byte offsets, and their numbers."""
    kept, numbers, at = [], [], 0
    for i, line in enumerate(text.encode().split(b"\n")):
        if at in gone:
            numbers.append(i)
        else:
            kept.append(line)
        at += len(line) + 1
    return b"\n".join(kept).decode(), numbers


def _cut(documents: DataFrame, name: str, lost_of) -> DataFrame:
    """The documents less the lines that ``lost_of(batch, hashes, rows)`` marks, with their numbers in a last column."""
    names = documents.columns
    at_text = names.index("text")
    schema = documents.withColumn(name, F.array().cast("array<int>")).schema

    def work(batches):
        for b in tk.slices(batches):
            _, off, _, _, ls, _, lrow, _, _, _, whole = _lines(b.column(at_text))
            gone = np.flatnonzero(lost_of(b, whole, lrow))
            numbers = [[] for _ in range(b.num_rows)]
            text = b.column(at_text)
            if len(gone):
                text = text.to_pylist()
                by: dict[int, set] = {}
                for r, s in zip(lrow[gone].tolist(), (ls[gone] - off[lrow[gone]]).tolist()):
                    by.setdefault(r, set()).add(s)
                for r, starts in by.items():
                    text[r], numbers[r] = _without(text[r], starts)
                text = pa.array(text, b.schema.field(at_text).type)
            yield pa.RecordBatch.from_arrays([*(text if i == at_text else c for i, c in enumerate(b.columns)), pa.array(numbers, pa.list_(pa.int32()))], [*names, name])

    return documents.mapInArrow(work, schema)


def drop_recurring_lines(documents: DataFrame, min_docs: int = MIN_DOCS, broadcast: int = BROADCAST) -> DataFrame:
    """All columns of ``documents`` with the recurring lines cut out of text, and last dropped_lines (their numbers from 0, array)."""
    name = "dropped_lines"
    while name.lower() in {c.lower() for c in documents.columns}:
        name += "_"
    lost = recurring_lines(documents, min_docs)
    if lost.count() <= broadcast:
        known = documents.sparkSession.sparkContext.broadcast(np.sort(lost.toArrow()["line"].to_numpy().view(np.uint64)))
        return _cut(documents, name, lambda b, whole, lrow: tk.among(whole, known.value))
    # more than tasks should hold: the lost lines of each row are joined to it
    numbered = stored(documents.withColumn(name, F.monotonically_increasing_id()))

    def lines_of(batches):
        for b in tk.slices(batches):
            *_, lrow, _, _, _, whole = _lines(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lrow)), pa.array(whole.view(np.int64))], ["row", "line"])

    held = numbered.select(name, "text").mapInArrow(lines_of, "row bigint, line bigint").distinct().join(lost, "line")
    held = held.groupBy(F.col("row").alias(name)).agg(F.collect_list("line").alias("_lost"))
    both = numbered.join(held, name, "left").select(*documents.columns, F.coalesce("_lost", F.array().cast("array<bigint>")).alias(name))

    def lost_of(b, whole, lrow):
        own = b.column(b.num_columns - 1)
        row = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy())).astype(np.uint64)
        flat = own.flatten().to_numpy().view(np.uint64)
        return tk.among(tk.mix(whole + lrow.astype(np.uint64) * _SEEDS[0]), np.sort(tk.mix(flat + row * _SEEDS[0])))

    cut = _cut(both, f"{name}_", lost_of)
    return cut.select(*documents.columns, F.col(f"{name}_").alias(name))


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = drop_recurring_lines(docs)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped"), F.length(kept).cast("long").alias("n_chars_kept"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
