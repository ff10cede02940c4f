"""Line templates, PII, substring, passage and n-gram dedup against brute force on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dealscope.llm import compact_windows, line_templates, ngram_join, pii, suffix_dedup

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta river stone cloud ember frost grain".split()


def prose(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % 16] + str(x // 16 % 97 % 7) + WORDS[x // 2048 % 16])
    return " ".join(out)


@pytest.fixture(scope="module")
def docs(spark):
    a, b, shared = prose(1, 120), prose(2, 90), prose(3, 70)
    rows = [(1, a), (2, b), (3, a), (4, a.replace(a.split()[60], "changed", 1)), (5, prose(4, 60) + " " + shared), (6, shared + " " + prose(5, 40)), (7, None), (8, ""), (9, "two words"), (10, "two words"), (None, a), (2, b), (11, prose(6, 30))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("hit", F.lit("extra")).withColumn("n", F.lit(1))


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_substrings(docs):
    rows = texts(docs)
    first = {}
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - 49):
            if d is not None:
                first[raw[i : i + 50]] = min(d, first.get(raw[i : i + 50], d))
    want = set()
    for d, t in rows:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        kept = bytes(c for i, c in enumerate(raw) if i not in gone)
        want.add((d, len(raw), len(gone), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.dedup_substrings(docs).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(r.n_removed for r in got) > 0
    assert suffix_dedup.dedup_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", (20_000, 1))
def test_substrings_of_families(spark, monkeypatch, hot):
    """Edited copies, shared passages at many places, repeats inside a text, and groups that go on as single windows."""
    import random

    rng = random.Random(hot)
    letters = lambda n: "".join(rng.choice("abcd \u00e9") for _ in range(n))
    base, rows = letters(900), []
    for d in range(30):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        at = rng.randrange(900)
        rows.append((d, letters(rng.randint(0, 90)) + "".join(t)[at:] + letters(40) + base[: rng.randint(40, 70)] + letters(60) + base[: rng.randint(40, 70)]))
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "ROWS", 200 if hot > 1 else 20)
    monkeypatch.setattr(suffix_dedup, "UNIT", 500)
    first, want = {}, {}
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], d)
    for d, t in rows:
        raw = t.encode()
        want[d] = len({p for i in range(len(raw) - 49) if first[raw[i : i + 50]] < d for p in range(i, i + 50)})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup_substrings(df).collect()} == want


def test_ngram_components(docs):
    rows = texts(docs)
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append((d, {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()}))
    comp = {d: d for d, _ in rows}
    for _ in range(5):
        for d, x in sets:
            for e, y in sets:
                if d is not None and e is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    comp[d] = comp[e] = min(comp[d], comp[e])
    got = ngram_join.link_documents(docs).collect()
    assert len(got) == len(rows) and all(r.component_id == comp[r.doc_id] for r in got)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id != 2}[9] == 1
    assert ngram_join.link_documents(docs.limit(0)).count() == 0


def test_copies_without_their_text(spark, monkeypatch):
    """Edited copies whose own text is not there, in four degrees: linked as by every pair, and few pairs are tried."""
    rng, rows = random.Random(3), []
    base = prose(11, 150).split()
    for i in range(240):
        own = list(base)
        for at in rng.sample(range(150), (1, 2, 3, 4)[i % 4]):
            own[at] = f"own{i}x{at}"
        rows.append((i, " ".join(own)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(147)} for _, t in rows]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    tried, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *more: verified((tried.append(pairs.count()), pairs)[1], *more))
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want and 1 < len(set(want)) < 200
    assert sum(tried) < 12 * len(rows)


def test_passages(docs):
    got = {r.doc_id: r for r in compact_windows.dedup_passages(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert got[1].class_id == got[3].class_id == got[4].class_id == 1
    assert got[5].class_id == got[6].class_id == 5 and got[5].passages == [[60, 130]] and got[6].passages == [[0, 70]]
    assert all(not got[d].passages for d in (2, 7, 8, 9, 10, 11))
    assert compact_windows.dedup_passages(docs.limit(0)).count() == 0


def test_line_templates(spark):
    rows = [(i, f"{prose(100 + i, 40)}\nContact agent{i} for more help now please\n\nLicensed under the same terms\n{prose(500 + i, 30)}") for i in range(14)]
    rows += [(100 + i, "\n".join((prose(7, 30), prose(8, 30)))) for i in range(14)] + [(200, None), (201, ""), (202, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dropped", F.lit(0))
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(df).collect()}
    for i in range(14):
        assert got[i].dropped_lines == [1, 3] and got[i].text == "\n".join(x for k, x in enumerate(rows[i][1].split("\n")) if k not in (1, 3))
        assert got[100 + i].dropped_lines == []  # copies of one text are no template
    assert got[200].text is None and got[201].text == "" and got[202].text == "\n \n"
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_pii(spark):
    rows = [(1, "mail a.b%c@x-y.co.uk, a@b.c%d@e.f. or x@y; \U0001f600 ip 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8"), (2, "card 4111 1111 1111 1111 and 4111-1111-1111-1112; +1 (489) 555-8583 +12 34"), (3, None), (4, ""), (5, "1" * 5000 + " @" * 300 + "." * 50)]
    rows += [(10 + i, f"my card no 4111 1111 1111 {1111 if i < 6 else 1112}\nreach me at user{i}@mail.example.org") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("email", F.lit("x"))
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for d, t in rows:
        want = [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert [(s.kind, s.start, s.end) for s in got[d].base] == want, d
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_discovers_by_context(spark):
    rows = [(i, f"report {i} client phone: +1 (489) 555-{1000 + i} end") for i in range(12)] + [(50, "client phone: (489) 555-7777 end"), (51, "batch 12345678 of today")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.hit) for s in got[50].found] == [("phone", "(489) 555-7777")] and not got[51].found


def test_long_identifiers_are_candidates(spark):
    """Runs of any length are found whole, and long runs of any characters are read in linear time."""
    import time

    account, mail = "GB12" + "A7" * 60, "x" * 300 + " at " + "y" * 200 + ".example"
    rows = [(1, f"account {account} end"), (2, f"write to {mail} now"), (3, "id 12 34 56 " + "78 90 " * 40 + "12"), (4, "_" * 200_000), (5, "1 " * 100_000 + "a"), (6, "A" * 200_000), (7, "9" * 100_000 + "x"), (8, ("a-" * 100_000))]
    began = time.time()
    hits = {r.doc_id: r.hit for r in pii.span_rows(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'other'").collect()}
    assert hits[1] == account and hits[2] == mail and hits[3] == rows[2][1][3:] and 4 not in hits and 6 not in hits and 8 not in hits
    assert time.time() - began < 60
