"""Vector codes, source divergence and covering SimHash against brute force in plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dealscope.llm import covering_lsh, source_audit, textkit, vector_codes

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> smallest doc_id reachable, from all pairs of rows."""
    root = {d: d for d, _ in prints if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(prints, 2):
        if a is not None and b is not None and (a == b or (x ^ y).bit_count() <= 4):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}


def test_every_small_set_of_positions_is_free_in_some_table():
    whole = covering_lsh.covering_masks(list(range(64)))
    for at in itertools.combinations(range(64), 3):
        assert any(not any(m >> p & 1 for p in at) for m in whole)
    rng = random.Random(5)
    for m in whole:
        free = [p for p in range(64) if not m >> p & 1]
        deeper = covering_lsh.covering_masks(free)
        assert all(len(free) - d.bit_count() <= 16 for d in deeper)  # the bound on a bucket's fingerprints
        for _ in range(200):
            at = rng.sample(free, 4)
            assert any(not any(d >> p & 1 for p in at) for d in deeper)


def test_forests_of_buckets():
    rng = random.Random(1)
    for n, bits in ((2, 5), (17, 10), (300, 13), (900, 24)):
        values = np.array(rng.sample(range(1 << bits), n), np.uint64)
        want = components([(int(v), int(v)) for v in values])
        member, root = covering_lsh.forest(values)
        got = {int(v): int(v) for v in values} | dict(zip(member.tolist(), root.tolist()))
        assert got == want


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(600)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "three words only"), (None, " ".join(base)), (7, "lone text"), (7, " ".join(base)), (None, None)]
    for d in range(20, 60):  # edited copies of one text
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(600)] = word()
        rows.append((d, " ".join(copy)))
    rows += [(d, " ".join(word() for _ in range(rng.randint(1, 60)))) for d in range(60, 90)]
    rows += [(90, " ".join(base) * 30), (91, " ".join(base)), (91, " ".join(base))]
    return rows


@pytest.mark.parametrize("limit", (4096, 2))
def test_simhash_components(spark, texts, limit):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("fp", "t", "key", "component")})
    got = covering_lsh.near_duplicates(docs, limit=limit).collect()
    want = components([(d, fingerprint(t)) for d, t in texts])
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(d), f"{fingerprint(t):016x}") for d, t in texts)
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items()) | {(None, None)}
    assert len({want[d] for d in range(20, 60)}) < 40 and covering_lsh.near_duplicates(docs.limit(0)).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch, texts):
    import pyarrow as pa

    monkeypatch.setattr(covering_lsh, "PIECE", 7)
    got = covering_lsh.fingerprints(pa.array([t for _, t in texts]))
    assert got.tolist() == [fingerprint(t) for _, t in texts]


def audit(rows):
    """The audit in plain Python: (lang, source, part, item, value, rank)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    df, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        rate = {}
        for source in [s for x, s in counts if x == lang]:
            n = sum(counts[lang, source][t] for t in kept)
            rate[source] = {t: 1 + 10**9 * (counts[lang, source][t] + 1) // (n + len(kept)) for t in kept}
        whole = {t: sum(counts[lang, s][t] for s in rate) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        for s, p in rate.items():
            pairs = [(o, sum((p[t] - r[t]) ** 2 // r[t] for t in kept)) for o, r in rate.items() if o != s]
            terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, 200)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(900)]
    rows = [(None, None, None), ("", "en", "empty"), ("12 34 !", "xx", "a"), ("only here", "xx", "b"), ("Word word WORD", "yy", "c"), ("word", "yy", "c"), ("word-word", "yy", "c")]
    for d in range(150):
        rows.append((" ".join(vocabulary[int(rng.paretovariate(0.7)) % 900].upper() if rng.random() < 0.1 else vocabulary[int(rng.paretovariate(0.7)) % 900] for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "S2", None])))
    return rows + [(" ".join(vocabulary) * 20, "en", "s1"), rows[-1], rows[-1]]


@pytest.mark.parametrize("bound, shard", ((source_audit.BOUND, 4096), (source_audit.BOUND, 16), (3000, 16), (0, 4096)))
def test_source_divergence(spark, monkeypatch, sources, bound, shard):
    """Whole, in many shards, with a tail that is joined, and all of it joined."""
    monkeypatch.setattr(source_audit, "SHARD", shard)
    docs = spark.createDataFrame(sources, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "shard", "n", "df", "total")})
    got = source_audit.audit(docs, bound).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == audit(sources)
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_perfect_hash_keeps_its_keys_apart():
    import pandas as pd
    import pyarrow as pa

    def lookup(h, keys, asked, of):
        shards = [source_audit._shards(("en", i), pd.DataFrame({"term": keys[i::3], "h": h[i::3].view(np.int64)})).iloc[0].to_dict() for i in range(3)]
        return source_audit.Lexicon(shards), source_audit.Lexicon(shards).slots("en", pa.array(asked, pa.large_string()), of)

    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**60, 3000, dtype=np.uint64) * np.uint64(3) + np.tile(np.arange(3, dtype=np.uint64), 1000)  # dealt to three shards
    keys = np.array([f"k{i}" for i in range(3000)], object)
    lexicon, slots = lookup(h, keys, list(keys) + ["other", "k0"], np.append(h, [h[5], h[7]]).astype(np.uint64))
    assert sorted(slots[:3000]) == list(range(3000)) and lexicon.keys.take(pa.array(slots[:3000])).to_pylist() == list(keys)
    assert slots[3000:].tolist() == [-1, -1]  # a slot is only believed with its stored key
    same = np.full(30, 9, np.uint64)  # equal hashes: told apart by the keys alone
    shard = source_audit._shards(("en", 0), pd.DataFrame({"term": keys[:30], "h": same.view(np.int64)})).iloc[0].to_dict()
    assert sorted(source_audit.Lexicon([shard]).slots("en", pa.array(list(keys[:30]), pa.large_string()), same)) == list(range(30))


def test_rates_beyond_long():
    assert source_audit._rate(np.array([5 * 10**15]), 10**16, 7).tolist() == [1 + 10**9 * (5 * 10**15 + 1) // (10**16 + 7)]


def codes(vectors, rounds=6):
    """Lloyd in Python integers over (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v], label) for i, v, label in vectors if v and None not in v and np.isfinite(v).all() and len(v) % 8 == 0]
    size = len(min((i, v) for i, v, _ in kept if i is not None)[1])
    kept = [r for r in kept if len(r[1]) == size]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    w = size // 8
    books = [[v[p * w : p * w + w] for _, v in sorted(first.items())[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(8):
                members[p, near(v[p * w : p * w + w], books[p])[1]].append(v[p * w : p * w + w])
        books = [[[sum(c) // len(c) for c in zip(*members[p, e])] if members[p, e] else old for e, old in enumerate(book)] for p, book in enumerate(books)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out, per_label = [], Counter()
    for i, v, label in kept:
        found = [near(v[p * w : p * w + w], books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        per_label[label] += out[-1][2]
    return sorted(((i, c, e, per_label[label], digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("owners", (1024, 8))
def test_vector_codes(spark, monkeypatch, owners):
    rng = np.random.default_rng(11)
    # values on a float32 grid, two hot spots, exact copies, ties
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0 if i % 3 else i % 7, 0.3, 16)], [0, 1, None][i % 3]) for i in range(160)]
    vectors += [(i, [0.5] * 16, 2) for i in range(200, 260)]
    vectors += [(None, [0.25] * 16, 1), (5, [0.125] * 16, None), (5, [0.125] * 16, None), (300, None, 1), (301, [], 1), (302, [1.0, None] * 8, 1), (303, [float("nan")] * 16, 1), (304, [float("-inf")] * 16, 1), (305, [1.0] * 24, 1), (306, [1.0] * 7, 0)]
    monkeypatch.setattr(vector_codes, "OWNERS", owners)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("id", "position", "entry", "new", "error", "of")})
    got = sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)
    assert got == codes(vectors)


def test_vector_codes_of_few_or_no_vectors(spark):
    few = [(i, [float(i)] * 8, 0) for i in range(3)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str) == codes(few)
    assert vector_codes.compress(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="exact range"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 0)], df.schema)).collect()
