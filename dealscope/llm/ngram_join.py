"""N-gram Jaccard self-join with vertical partitioning.

A document is the set of its distinct k-word shingles. Equal sets collapse to
one class first, named by a 64-bit mark. A document can only link if at least the
threshold's share of its shingles occurs in other classes too, so the shingles are
cut into vertical fragments by hash and the first fragment (``SHARE`` of them) is counted alone:
shingles that a task meets in several documents are settled there, the others are
shuffled once, and documents with too many shingles of their own are done. Only the rest
(documents made of repeated text) go on with all their shingles: these are counted exactly, the
global order is by document frequency, then hash, and the first (1 - t) n + 1 of
each set form its prefix.

Candidate pairs: every member of a prefix group with three pivots of the
group, two of them those with the fewest shingles of their own; while these links leave many pairs open in different components, with one more
pivot at a time; then members of different components only, less those that sizes, positions in the order and the shingles each lacks
of the other (counted from below by a bit each) rule out. Pairs are verified exactly: the
overlap of a pair is counted in each of ``FRAGMENTS`` fragments apart and summed per pair.

Defined results: null text and text without words have an empty set, n_shingles
0, and are linked with nothing; fewer than k words are one shingle; rows that
repeat a doc_id count as one document with the union of their links; null
doc_id is kept, unlinked, with a null component; an empty table gives no rows; very long texts
are cut into sets like others (a text is never split); ties cannot change the result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import bitmap, components, drop, in_bitmap, stored, table

SHINGLE, THRESHOLD, UNIT, SHARE, FRAGMENTS = 4, 85, 500_000, 1 / 3, 4
#: 64-bit words of a set's bits; open pairs for each row of a prefix group, from which on another pivot comes before them
WORDS, AHEAD = 16, 4


def _sets(column, k: int):
    """Distinct shingles of a slice, sorted by row and hash: hash, row, and n + 1 bounds."""
    data, off = tk.raw(column)
    data = tk.LOWER[data]
    s, e, row = tk.words(data, off, tk.SPACES)
    g, r, _ = tk.shingles(tk.span_hash(data, s, e), row, len(off) - 1, k)
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = tk.starts(g, r)
    g, r = g[new], r[new]
    return g, r, tk.row_bounds(r, len(off) - 1)


def _marks(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set, 0 if empty."""
    if not len(g):
        z = np.zeros(len(bounds) - 1, np.uint64)
        return z, z
    first = np.add.reduceat(np.append(tk.mix(g.copy()), np.uint64(0)), bounds[:-1])
    second = np.bitwise_xor.reduceat(np.append(tk.mix(g * np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64(0)), bounds[:-1])
    empty = np.diff(bounds) == 0
    first[empty] = second[empty] = 0
    return first, second


def _in_first(g: np.ndarray) -> np.ndarray:
    return g < np.uint64(int(SHARE * 2**64))


def _classes(documents: DataFrame, k: int) -> DataFrame:
    """Per document row: its set's size, marks, and size within the first fragment."""

    def work(batches):
        for b in tk.slices(batches):
            g, r, bounds = _sets(b.column(1), k)
            m1, m2 = _marks(g, bounds)
            n1 = np.bincount(r[_in_first(g)], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(m1.view(np.int64)), pa.array(m2.view(np.int64)), pa.array(n1, pa.int64())], ["doc_id", "n", "m1", "m2", "n1"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n bigint, m1 bigint, m2 bigint, n1 bigint")


def _first_fragment(documents: DataFrame, k: int) -> DataFrame:
    """(h, id, hits) from units of about UNIT shingles: hits 0 for a shingle of one set in the unit, -1 once for a shingle
    of several, and, under the id's own hash, the number of these for each of the sets."""

    def combined(parts):
        h, owner = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = tk.starts(h, owner)  # copies inside the unit
        h, owner = h[new], owner[new]
        first = np.flatnonzero(tk.starts(h))
        size = np.diff(np.append(first, len(h)))
        many = np.repeat(size > 1, size)
        ids, count = np.unique(owner[many], return_counts=True)
        once = first[size > 1]
        cols = np.concatenate([h[~many], h[once], ids]), np.concatenate([owner[~many], owner[once], ids]), np.concatenate([np.zeros((~many).sum(), np.int32), np.full(len(once), -1, np.int32), count.astype(np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2])], ["h", "id", "hits"])

    def work(batches):
        parts, size = [], 0
        for b in tk.slices(batches):
            g, r, bounds = _sets(b.column(0), k)
            m1, _ = _marks(g, bounds)
            at = _in_first(g)
            parts.append((g[at], m1[r[at]]))
            size += len(parts[-1][0])
            if size > UNIT:
                yield combined(parts)
                parts, size = [], 0
        if size:
            yield combined(parts)

    return documents.where("doc_id is not null").select("text").mapInArrow(work, "h bigint, id bigint, hits int")


def _repeated(batches):
    """(id, hits): for each set, how many of its shingles other sets hold too; rows come sorted by h and id."""

    def counted(h, owner, hits):
        given = hits > 0
        sure_id, sure = owner[given], hits[given]
        h, owner, hits = h[~given], owner[~given], hits[~given]
        first = np.flatnonzero(tk.starts(h)) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(h)))
        several = np.zeros(len(first), bool)
        if len(h):
            several = (owner[first] != owner[np.append(first[1:], len(h)) - 1]) | (np.minimum.reduceat(hits, first) < 0)
        hit = np.repeat(several, size) & (hits == 0)
        ids, at = np.unique(np.concatenate([owner[hit], sure_id]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.ones(hit.sum()), sure]), len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "hits"])

    open_ = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)
    for b in batches:
        if not b.num_rows:
            continue
        rows = tuple(np.concatenate([o, b.column(i).to_numpy()]) for i, o in enumerate(open_))
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        tail = tuple(x[last:] for x in rows)
        if len(tail[0]) > 10_000 and (tail[1][0] != tail[1][-1] or tail[2].min() < 0):  # a hot shingle is known to be repeated: one row of it is enough
            sure = tail[2] > 0
            yield counted(*rows)
            keep = np.flatnonzero(~sure)[:1]
            open_ = tail[0][keep], tail[1][keep], np.full(len(keep), -1, np.int32)
            continue
        open_ = tail
        if last:
            yield counted(*(x[:last] for x in rows))
    if len(open_[0]):
        yield counted(*open_)


def _alive_sets(documents: DataFrame, alive: DataFrame, k: int) -> DataFrame:
    """(id, n, hashes) of the classes in ``alive``; a bitmap of fixed size spares other documents the work."""
    known = documents.sparkSession.sparkContext.broadcast(bitmap(alive.select(F.xxhash64("rep").alias("h"))))

    def work(batches):
        for big in batches:
            near = in_bitmap(known.value, big.column(2).to_numpy().view(np.uint64))
            for b in tk.slices([big.filter(pa.array(near))]):
                g, _, bounds = _sets(b.column(1), k)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_marks(g, bounds)[0].view(np.int64)), tk.lists(g.view(np.int64), bounds, pa.int64())], ["rep", "id", "hashes"])

    docs = documents.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("slot"))
    rows = docs.mapInArrow(work, "rep bigint, id bigint, hashes array<bigint>")
    return rows.join(alive.select("rep", "id", "n"), ["rep", "id"]).dropDuplicates(["id"]).select("id", "n", "hashes")


def _need(a, b, threshold: int):
    """Common shingles that sets of these sizes must have."""
    return F.ceil((a + b) * threshold / (100 + threshold))


def _may_link(x, y, threshold: int):
    """For a shingle that both prefixes hold: sizes fit, and what stands before and behind it leaves room for enough common ones."""
    room = F.least(x["pos"] - x["lone"], y["pos"] - y["lone"]) + F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return (100 * F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])) & (room >= _need(x["n"], y["n"], threshold))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int, fragments: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: overlaps counted per fragment, summed per pair."""
    each = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment"))
    left = each.join(sets.select(F.col("id").alias("a"), "fragment", F.col("n").alias("na"), F.col("hashes").alias("ha")), ["a", "fragment"])
    both = left.join(sets.select(F.col("id").alias("b"), "fragment", F.col("n").alias("nb"), F.col("hashes").alias("hb")), ["b", "fragment"])
    part = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("both"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return total.where(100 * F.col("both") >= threshold * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _bits(sets: DataFrame) -> DataFrame:
    """(id, bits: n, b): how many shingles of a set others of these sets hold too, and a bit for each by hash, in WORDS words."""
    each = sets.select("id", F.explode("hashes").alias("h"))
    shared = each.join(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h"), "h").select("id", F.xxhash64("h").alias("g"))
    word, bit = F.pmod(F.shiftright("g", 6), F.lit(WORDS)), F.expr("shiftleft(1L, cast(g & 63 as int))")
    return shared.groupBy("id").agg(F.struct(F.count("*").alias("n"), F.array(*(F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")) for i in range(WORDS))).alias("b")).alias("bits"))


def _common(x, y):
    """At most so many shingles are common to two sets: a bit that only one has is a shingle that the other lacks."""
    lacks = lambda p, q: F.aggregate(F.zip_with(p["b"], q["b"], lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda n, k: n + k)
    return F.least(x["n"] - lacks(x, y), y["n"] - lacks(y, x))


def _links(sets: DataFrame, threshold: int, fragments: int) -> DataFrame:
    """Linked pairs (a, b) of class ids: enough of them to connect every component."""
    each = sets.select("id", "n", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("id")
    ranked = each.join(often, "h").select("id", "n", "h", (F.col("n") - F.count("*").over(own)).alias("lone"), F.row_number().over(own.orderBy("df", "h")).alias("rank"))
    prefix = ranked.select("id", "n", "h", "lone", (F.col("lone") + F.col("rank")).alias("pos")).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1)
    prefix = stored(prefix)
    member = F.struct("id", "n", "lone", "pos")
    # near copies of a text have shingles of their own, the text itself has none: the members with the fewest are hubs
    order = [F.struct("lone", "id"), F.struct("lone", F.xxhash64("id")), F.struct(F.xxhash64("id", F.lit(1)), "id")]
    pivots = prefix.groupBy("h").agg(F.count("*").alias("size"), *(F.min(F.struct(o.alias("by"), member.alias("x")))["x"].alias(f"p{i}") for i, o in enumerate(order))).where("size > 1")
    star = prefix.join(pivots.select("h", F.array_distinct(F.array(*(f"p{i}" for i in range(len(order))))).alias("to")), "h").select(member.alias("x"), F.explode("to").alias("y"))
    ordered = lambda rows: rows.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    tried = stored(ordered(star.where((F.col("x.id") != F.col("y.id")) & _may_link(F.col("x"), F.col("y"), threshold))))
    cut = F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment")
    of = lambda h: F.pmod(F.shiftrightunsigned(h, 40), F.lit(fragments))
    cut_sets = stored(sets.join(prefix.select("id").distinct(), "id", "left_semi").select("id", "n", "hashes", cut).select("id", "n", "fragment", F.filter("hashes", lambda h: of(h) == F.col("fragment")).alias("hashes")))
    links = stored(_verified(tried, cut_sets, threshold, fragments))
    label = components(links)
    turn, spare = 0, []
    while True:
        # what the pivots left open: members of a group in different components
        named = prefix.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "h", member.alias("x"), F.coalesce("component", "id").alias("c"))
        each_c = named.groupBy("h", "c").agg(F.count("*").alias("m"))
        mixed = stored(each_c.groupBy("h").agg(F.count("*").alias("cs"), F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max_by("c", F.struct("m", "c")).alias("major")).where("cs > 1"))
        spare.append(mixed)
        load = mixed.agg(F.sum("size").alias("rows"), F.sum((F.col("size") * F.col("size") - F.col("same")) / 2).alias("pairs")).first()
        if not load["rows"] or load["pairs"] <= AHEAD * load["rows"]:
            break
        # too many pairs: one more member of each group, drawn by hash, meets those of other components
        turn += 1
        at = stored(named.join(mixed.select("h"), "h"))
        drawn = at.groupBy("h").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn + 1)).alias("by"), F.col("x").alias("y"), F.col("c").alias("cy"))).alias("p")).select("h", "p.y", "p.cy")
        met = at.join(drawn, "h").where((F.col("c") != F.col("cy")) & _may_link(F.col("x"), F.col("y"), threshold))
        fresh = stored(ordered(met).join(tried, ["a", "b"], "left_anti"))
        more = stored(_verified(fresh, cut_sets, threshold, fragments))
        found, seen = more.count(), stored(tried.union(fresh))
        drop(tried, at, fresh)
        tried = seen
        if not found:
            drop(more)
            break
        both = stored(links.union(more))
        drop(links, more, label)
        links, label = both, components(both)
    rest = named.join(mixed.select("h", "major"), "h")
    ids = stored(rest.select("id").distinct())
    first = prefix.join(ids, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "h")))["h"].alias("first"))
    open_ = stored(rest.join(first, "id").join(_bits(sets.join(ids, "id", "left_semi")), "id").select("h", "x", "c", "major", "first", "bits"))
    x, y = (open_.select("h", "major", F.col("x").alias(v), F.col("c").alias(f"c{v}"), F.col("first").alias(f"first_{v}"), F.col("bits").alias(f"bits_{v}")) for v in "xy")
    # a pair is emitted once, at its first common shingle, which must stand early in the smaller set; in a group's largest component nobody seeks
    early = lambda v: F.col(f"{v}.pos") <= F.col(f"{v}.n") - F.ceil(2 * F.col(f"{v}.n") * threshold / (100 + threshold)) + 1
    once = (F.array_intersect("first_x", "first_y")[0] == F.col("h")) & F.when(F.col("x.n") < F.col("y.n"), early("x")).otherwise(early("y"))
    sought = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("major")) | (F.col("x.id") < F.col("y.id")))
    close = _common(F.col("bits_x"), F.col("bits_y")) >= _need(F.col("x.n"), F.col("y.n"), threshold)
    cross = x.where("cx <> major").join(y.drop("major"), "h").where(sought & _may_link(F.col("x"), F.col("y"), threshold) & once & close)
    more = stored(_verified(ordered(cross).join(tried, ["a", "b"], "left_anti"), cut_sets, threshold, fragments))
    out = stored(links.union(more))
    drop(prefix, tried, cut_sets, links, label, ids, open_, more, *spare)
    return out


def link_documents(documents: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``documents``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(_classes(docs, k))
    full = rows.where("n > 0 and doc_id is not null")
    classes = stored(full.groupBy("n", "m1", "m2", "n1").agg(F.min("doc_id").alias("rep")))
    first = _first_fragment(docs, k).repartition("h").sortWithinPartitions("h", "id")
    hits = first.mapInArrow(_repeated, "id bigint, hits bigint").groupBy("id").agg(F.sum("hits").alias("hits"))
    spare = F.col("n") - F.ceil(F.col("n") * threshold / 100)
    alive = stored(classes.withColumnRenamed("m1", "id").join(hits, "id", "left").where(F.col("n1") - F.coalesce("hits", F.lit(0)) <= spare).select("id", "rep", "n"))
    sets = stored(_alive_sets(docs, alive, k))
    links = _links(sets, threshold, fragments)
    name = alive.select("id", "rep")
    edges = links.join(name.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a").join(name.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # a doc_id with several texts links their classes
    several = full.groupBy("doc_id").agg(F.min("m1").alias("lo"), F.max("m1").alias("hi")).where("lo < hi").select("doc_id")
    tied = full.join(several, "doc_id").join(classes.drop("n1"), ["n", "m1", "m2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    label = components(edges.union(tied))
    drop(alive, sets, links)
    shown = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("n", "m1", "m2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(shown, ["n", "m1", "m2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


ORACLE = """
with recursive w as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') as l from documents
), s as (
  select doc_id, case when len(l) = 0 then [] when len(l) < 4 then [array_to_string(l, ' ')]
    else list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) end as g from w
), e as (select doc_id, len(g) as n, unnest(g) as h from s),
classes as (select doc_id, n, sum(hash(h)::hugeint) as k1, bit_xor(hash(h || '#')) as k2 from e group by all),
reps as (select min(doc_id) as rep, n, k1, k2 from classes group by n, k1, k2),
member as (select doc_id, rep from classes join reps using (n, k1, k2)),
f as (select e.*, row_number() over (partition by e.doc_id order by df, e.h) as pos
      from e join (select rep as doc_id from reps) using (doc_id) join (select h, count(*) as df from e group by h) using (h)),
cand as (
  select distinct a.doc_id as a, b.doc_id as b from f a join f b on a.h = b.h and a.doc_id < b.doc_id
  where a.pos <= a.n - ceil(0.85 * a.n) + 1 and b.pos <= b.n - ceil(0.85 * b.n) + 1 and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), inter as (select a, b, count(*) as c from cand join e x on x.doc_id = a join e y on y.doc_id = b and y.h = x.h group by a, b),
links as (
  select a, b from inter join (select doc_id as a, n as na from classes) using (a) join (select doc_id as b, n as nb from classes) using (b) where 100 * c >= 85 * (na + nb - c)
  union select rep, doc_id from member where rep <> doc_id
), both_ways as (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, b from reach join both_ways on r = a)
select s.doc_id, len(g)::bigint as n_shingles, min(r)::bigint as component_id from s join reach using (doc_id) group by s.doc_id, g
"""
