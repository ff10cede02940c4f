"""Source divergence audit: how far the term rates of each source stand from those of the other sources and of its language.

First pass: exact document frequencies by (lang, term), counted per slice and summed in Spark; terms in at least LEAST documents
stay. They are dealt by hash into shards of about SHARD, and a task builds each shard's minimal perfect hash: levels of bit
arrays, where a key that has a position to itself takes the rank of that bit as its slot. The shards with their keys are
broadcast; in the second pass every distinct term of a slice is looked up, verified against the key stored at its slot, and
counted in dense slots of its (lang, source) group. What is broadcast is bounded: where keys exceed ``BOUND`` bytes, only the most frequent ones (by powers of two
of their document frequency) are broadcast, and the occurrences of the others are summed and joined with their keys in the same pass.

Counts are merged per (shard, source); a task per shard then makes all differences of its terms in exact integers, sums them for
every pair of sources and keeps its first ``TOP`` terms of every source, of which a window keeps the first ``TOP``.

Defined results: null text, lang and source are ''; empty texts have no terms but their group occurs; every row is a document, so rows that repeat a doc_id (or have none) count each;
very long texts are counted whole; ties rank by the bytes of the item; a language with one source has no pair, one without kept terms
has pairs of value 0; an empty table gives no rows; extra columns are ignored. Rows of a (lang, source) group may be any share of
all: its counts come from all tasks and are merged shard by shard. The result has a row for every two sources of a language.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import drop, stored, table

SHARD, LEAST, TOP, SCALE, BOUND = 4096, 3, 200, 10**9, 64 << 20
SLICE, SLOTS, LEVELS = 4 << 20, 1 << 23, 40
LETTERS = tk.word_table(bytes(b for b in range(128) if not chr(b).isalpha()))


def _terms(column) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a slice, their hashes, and code and row of every occurrence."""
    data, off = tk.raw(column)
    data = tk.LOWER[data]
    s, e, row = tk.words(data, off, LETTERS)
    ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(data[LETTERS[data]]))
    coded = every.dictionary_encode()
    terms = coded.dictionary
    letters, bounds = tk.raw(terms)
    return terms, tk.span_hash(letters, bounds[:-1], bounds[1:]), coded.indices.to_numpy(), row


def _codes(column) -> tuple[list[str], np.ndarray]:
    coded = pc.fill_null(column, "").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _frequencies(batches):
    """(lang, term, h, df) of every slice."""
    for b in tk.slices(batches, limit=SLICE):
        terms, h, code, row = _terms(b.column(0))
        if not len(terms):
            continue
        langs, of = _codes(b.column(1))
        once = np.unique(row * len(terms) + code)
        pair, df = np.unique(of[once // len(terms)].astype(np.int64) * len(terms) + once % len(terms), return_counts=True)
        at = pair % len(terms)
        yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(pair // len(terms))), terms.take(pa.array(at)).cast(pa.string()), pa.array(h[at].view(np.int64)), pa.array(df)], ["lang", "term", "h", "df"])


def build(h: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Minimal perfect hash of distinct 64-bit hashes: bit words, bits of each level, and the keys' places in slot order. Equal hashes are left out."""
    words, sizes, order = [], [], []
    left = np.arange(len(h))
    for level in range(LEVELS):
        if not len(left):
            break
        bits = -(-2 * len(left) // 64) * 64
        at = _position(h[left], level, bits)
        many = np.bincount(at, minlength=bits)
        alone = many[at] == 1
        words.append(np.packbits(many == 1, bitorder="little").view("<u8"))
        sizes.append(bits)
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    z = np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, "<u8"), *words]), sizes, np.concatenate([z, *order])


def _position(h: np.ndarray, level: int, bits) -> np.ndarray:
    return (tk.mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.asarray(bits, np.uint64)).astype(np.int64)


def _shards(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One perfect hash: its bits, and its keys in slot order; keys that share a 64-bit hash come behind them."""
    rows = rows.sort_values("term")
    h = rows["h"].to_numpy().view(np.uint64)
    words, sizes, order = build(h)
    rest = np.setdiff1d(np.arange(len(h)), order)
    terms = rows["term"].to_numpy()[np.concatenate([order, rest])]
    return pd.DataFrame({"lang": [key[0]], "shard": [key[1]], "words": [words.tobytes()], "sizes": [sizes], "terms": [terms.tolist()], "hashed": [len(order)]})


class Lexicon:
    """All broadcast shards as one table: global slots run through the shards of a language, and through the languages."""

    def __init__(self, shards: list):
        shards = sorted(shards, key=lambda r: (r["lang"], r["shard"]))
        self.langs: dict[str, tuple[int, int]] = {}
        for i, r in enumerate(shards):
            self.langs[r["lang"]] = self.langs.get(r["lang"], (i,))[0], i + 1
        self.shard = np.array([r["shard"] for r in shards], np.int64)
        self.sizes = np.zeros((len(shards), LEVELS), np.int64)
        for i, r in enumerate(shards):
            self.sizes[i, : len(r["sizes"])] = r["sizes"]
        before = np.cumsum(self.sizes.ravel()) - self.sizes.ravel()
        self.at = before.reshape(self.sizes.shape)
        self.words = np.frombuffer(b"".join(r["words"] for r in shards), np.uint64)
        self.base = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in shards])])
        hashed = np.array([r["hashed"] for r in shards], np.int64)
        # rank of a word's first bit; shards whose last keys have no bit shift those behind
        ones = np.cumsum(np.bitwise_count(self.words).astype(np.int64)) - np.bitwise_count(self.words)
        shift = np.repeat(self.base[:-1] - (np.cumsum(hashed) - hashed), [len(r["words"]) // 8 for r in shards])
        self.rank = ones + shift
        self.keys = pa.array([t for r in shards for t in r["terms"]], pa.large_string())
        self.odd = {(r["lang"], t): self.base[i] + r["hashed"] + j for i, r in enumerate(shards) for j, t in enumerate(r["terms"][r["hashed"] :])}

    def slots(self, lang: str, terms: pa.Array, h: np.ndarray) -> np.ndarray:
        """Global slot of every term of the language, -1 if it is not kept."""
        out = np.full(len(terms), -1, np.int64)
        if lang not in self.langs or not len(terms):
            return out
        first, end = self.langs[lang]
        shard = first + np.mod(h.view(np.int64), end - first)
        left = np.arange(len(terms))
        for level in range(LEVELS):
            left = left[self.sizes[shard[left], level] > 0]
            if not len(left):
                break
            s = shard[left]
            p = self.at[s, level] + _position(h[left], level, self.sizes[s, level])
            word, bit = self.words[p >> 6], (p & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.rank[p >> 6] + below)[hit]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), terms.take(pa.array(found))).to_numpy(zero_copy_only=False)
        out[found[~same]] = -1
        if self.odd:
            for i in np.flatnonzero(out < 0):
                out[i] = self.odd.get((lang, terms[i].as_py()), -1)
        return out

    def span(self, lang: str) -> tuple[int, int]:
        first, end = self.langs.get(lang, (0, 0))
        return int(self.base[first]), int(self.base[end])


CELLS = "lang string, source string, shard int, slots array<int>, counts array<bigint>, term string, n bigint"


def _recount(broadcast, tail: bool):
    """(lang, source, shard, slots, counts): dense slots of each group, handed on when they fill SLOTS; with a tail also (lang, source, term, n) of all else."""

    def work(batches):
        lexicon: Lexicon = broadcast.value
        dense: dict[tuple[str, str], np.ndarray] = {}
        used = 0

        def flushed():
            for (lang, source), counts in dense.items():
                at = np.flatnonzero(counts)
                if not len(at):
                    continue
                slot = at + lexicon.span(lang)[0]
                shard = np.searchsorted(lexicon.base, slot, "right") - 1
                new = np.flatnonzero(tk.starts(shard))
                bounds = np.append(new, len(at))
                n, own = len(new), shard[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n), pa.array([source] * n), pa.array(lexicon.shard[own], pa.int32()), tk.lists(slot - lexicon.base[shard], bounds, pa.int32()), tk.lists(counts[at], bounds, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())],
                    names,
                )
            dense.clear()

        names = [c.split()[0] for c in CELLS.split(", ")]
        for b in tk.slices(batches, limit=SLICE):
            terms, h, code, row = _terms(b.column(0))
            langs, lang_of = _codes(b.column(1))
            sources, source_of = _codes(b.column(2))
            group = lang_of.astype(np.int64) * len(sources) + source_of
            order = np.argsort(group[row], kind="stable")
            code, owner = code[order], group[row][order]
            new = np.flatnonzero(tk.starts(owner))
            slot = {i: lexicon.slots(langs[i], terms, h) for i in range(len(langs))}
            for g, start, end in zip(owner[new].tolist(), new, np.append(new[1:], len(owner))):
                lang, source = langs[g // len(sources)], sources[g % len(sources)]
                lo, hi = lexicon.span(lang)
                own = code[start:end]
                at = slot[g // len(sources)][own]
                known = at >= 0
                if known.any():
                    if (lang, source) not in dense:
                        if used + hi - lo > SLOTS:
                            yield from flushed()
                            used = 0
                        dense[lang, source] = np.zeros(hi - lo, np.int64)
                        used += hi - lo
                    np.add.at(dense[lang, source], at[known] - lo, 1)
                if tail and not known.all():
                    rare, n = np.unique(own[~known], return_counts=True)
                    k = len(rare)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * k), pa.array([source] * k), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int64())), terms.take(pa.array(rare)).cast(pa.string()), pa.array(n, pa.int64())],
                        names,
                    )
        yield from flushed()

    return work


def _merged(batches):
    """Rows sorted by (lang, shard, source) to one row each, with the total."""
    key, slots, counts = None, [], []

    def row():
        s, at = np.unique(np.concatenate(slots), return_inverse=True)
        n = np.zeros(len(s), np.int64)
        np.add.at(n, at, np.concatenate(counts))
        slots[:], counts[:] = [s], [n]
        return {"lang": key[0], "shard": key[1], "source": key[2], "slots": s.tolist(), "counts": n.tolist(), "total": int(n.sum())}

    for b in batches:
        ready = []
        for lang, shard, source, s, n in zip(*(b.column(i) for i in range(5))):
            own = lang.as_py(), shard.as_py(), source.as_py()
            if key is not None and own != key:
                ready.append(row())
                slots, counts = [], []
            key = own
            slots.append(s.values.to_numpy())
            counts.append(n.values.to_numpy())
            if sum(map(len, slots)) > 64 * SHARD:
                row()
        if ready:
            yield pa.RecordBatch.from_pylist(ready, MERGED)
    if key is not None:
        yield pa.RecordBatch.from_pylist([row()], MERGED)


MERGED = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("source", pa.string()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("total", pa.int64())])


def _rate(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for counts of any size."""
    if total < 2**63 // SCALE - 1:
        return 1 + SCALE * (count + 1) // (total + kept)
    return np.array([1 + SCALE * (int(c) + 1) // (total + kept) for c in count.ravel()], np.int64).reshape(count.shape)


def _differences(key: tuple, cells: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """All terms of one shard: sums per pair of sources, and the first terms of every source."""
    named = facts["source"].notna()
    terms = facts.loc[~named, "terms"].iloc[0]
    groups = facts[named].sort_values("source")
    sources, totals = groups["source"].to_numpy(), groups["total"].to_numpy()
    kept, everything = int(groups["kept"].iloc[0]), int(groups["lang_total"].iloc[0])
    utf8 = np.argsort(np.argsort(np.array([t.encode() for t in terms], object)))
    place = {s: i for i, s in enumerate(sources)}
    pairs = np.zeros((len(sources), len(sources)), np.int64)
    best: dict[int, list] = defaultdict(list)
    entries = [(place[s], np.asarray(at), np.asarray(n)) for s, at, n in zip(cells["source"], cells["slots"], cells["counts"])]
    step = max(1, (1 << 21) // len(sources))
    for lo in range(0, len(terms), step):
        width = min(step, len(terms) - lo)
        count = np.zeros((len(sources), width), np.int64)
        for i, at, n in entries:
            inside = (at >= lo) & (at < lo + width)
            count[i, at[inside] - lo] += n[inside]
        q = _rate(count.sum(axis=0), everything, kept)
        p = np.stack([_rate(c, int(t), kept) for c, t in zip(count, totals)])
        for i in range(len(sources)):
            pairs[i] += ((p[i] - p) ** 2 // p).sum(axis=1)
            over = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value = (p[i, over] - q[over]) ** 2 // q[over]
            first = np.lexsort((utf8[over + lo], -value))[:TOP]
            best[i] += zip((-value[first]).tolist(), utf8[over[first] + lo].tolist(), (over[first] + lo).tolist())
    rows = [(sources[i], "pair", sources[j], int(pairs[i, j])) for i in range(len(sources)) for j in range(len(sources)) if i != j]
    rows += [(sources[i], "term", terms[at], -value) for i, found in best.items() for value, _, at in sorted(found)[:TOP]]
    out = pd.DataFrame(rows, columns=["source", "part", "item", "value"])
    out.insert(0, "lang", key[0])
    return out


def _head(kept: DataFrame, bound: int) -> int:
    """The smallest power of two from which on keys of that document frequency fit the bound; 0 if all do."""
    power = F.floor(F.log2("df")).cast("int")
    sizes = {r["power"]: r["size"] for r in kept.groupBy(power.alias("power")).agg(F.sum(F.octet_length("term") + 16).alias("size")).collect()}  # one row per power of two
    total = 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > bound:
            return 1 << (p + 1)
    return 0


def audit(documents: DataFrame, bound: int = BOUND) -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark = documents.sparkSession
    docs = documents.select("text", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    found = docs.select("text", "lang").mapInArrow(_frequencies, "lang string, term string, h bigint, df bigint")
    kept = stored(found.groupBy("lang", "term", "h").agg(F.sum("df").alias("df")).where(F.col("df") >= LEAST))
    least = _head(kept, bound)
    head = (F.col("df") >= least).alias("head")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    parts = kept.groupBy("lang", head).agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    # shards of the tail are numbered downwards from -1
    dealt = kept.select("lang", "term", "h", head).join(parts, ["lang", "head"]).select("lang", "term", "h", F.when(F.col("head"), F.pmod("h", "shards")).otherwise(-1 - F.pmod("h", "shards")).cast("int").alias("shard"))
    shards = stored(dealt.groupBy("lang", "shard").applyInPandas(_shards, "lang string, shard int, words binary, sizes array<bigint>, terms array<string>, hashed int"))
    lexicon = spark.sparkContext.broadcast(Lexicon(shards.where("shard >= 0").collect()))  # at most ``bound`` bytes of keys
    cells = docs.select("text", "lang", "source").mapInArrow(_recount(lexicon, least > 0), CELLS)
    cells = stored(cells) if least else cells
    dense = cells.where("shard is not null").select("lang", "shard", "source", "slots", "counts").repartition("lang", "shard", "source").sortWithinPartitions("lang", "shard", "source")
    kind = ", ".join(f"{f.name} {'array<bigint>' if f.name == 'counts' else 'array<int>' if f.name == 'slots' else 'int' if f.name == 'shard' else 'bigint' if f.name == 'total' else 'string'}" for f in MERGED)
    counted = dense.mapInArrow(_merged, kind)
    if least:
        keys = shards.where("shard < 0").select("lang", "shard", F.posexplode("terms").alias("slot", "term"))
        rare = cells.where("term is not null").groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(keys, ["lang", "term"])
        rare = rare.groupBy("lang", "shard", "source").agg(F.collect_list(F.struct("slot", "n")).alias("x"), F.sum("n").alias("total"))
        counted = counted.union(rare.select("lang", "shard", "source", "x.slot", "x.n", "total"))
    counted = stored(counted)
    totals = counted.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    facts = shards.select("lang", "shard").join(groups.join(lang_totals, "lang"), "lang").select("lang", "shard", F.lit(None).cast("array<string>").alias("terms"), "source", "total", "kept", "lang_total")
    facts = facts.union(shards.select("lang", "shard", "terms", *(F.lit(None).cast(t) for t in ("string", "long", "long", "long"))))
    rows = counted.groupBy("lang", "shard").cogroup(facts.groupBy("lang", "shard")).applyInPandas(_differences, "lang string, source string, part string, item string, value bigint")
    rows = rows.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("kept = 0").select("lang", "source")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    rows = stored(rows.union(zero))
    drop(kept, shards, counted, groups, *([cells] if least else []))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part: rows.where(F.col("part") == part).withColumn("rank", F.row_number().over(by))
    return ranked("pair").union(ranked("term").where(F.col("rank") <= TOP))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = """
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as l from documents),
o as (select id, lang, source, unnest(l) as term from d),
kept as (select lang, term from o group by lang, term having count(distinct id) >= 3),
size as (select lang, count(*) as v from kept group by lang),
pairs as (select distinct lang, source from d),
got as (select lang, source, term, count(*) as c from o join kept using (lang, term) group by all),
total as (select p.lang, p.source, coalesce(sum(c), 0)::hugeint as n, coalesce(any_value(v), 0) as v from pairs p left join got g on g.lang = p.lang and g.source = p.source left join size s on s.lang = p.lang group by all),
rate as (select t.lang, t.source, k.term, coalesce(c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c, 0) + 1)) // (n + v) as p
  from total t join kept k on k.lang = t.lang left join got g on g.lang = t.lang and g.source = t.source and g.term = k.term),
whole as (select k.lang, k.term, 1 + (1000000000::hugeint * (sum(c) + 1)) // (any_value(n) + any_value(v)) as q
  from kept k join got using (lang, term) join (select lang, sum(n) as n, any_value(v) as v from total group by lang) t on t.lang = k.lang group by k.lang, k.term),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from rate a join rate b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all select a.lang, a.source, 'pair', b.source, 0 from total a join total b on a.lang = b.lang and a.source <> b.source where a.v = 0),
term as (select r.lang, r.source, 'term' as part, r.term as item, ((p - q) * (p - q)) // q as value from rate r join whole using (lang, term) where c > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
where part = 'pair' or rank <= 200
"""
