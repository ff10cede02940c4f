"""HTML extraction, quality rules, language ID, packing, decontamination against brute force."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealscope.llm import decontaminate, html_text, language, packing, quality

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hit string, items string"
ODD = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "s", 0, "x", "y"),
    (3, "one two three", "en", "s", 13, None, None),
    (3, "one two three", "en", "s", 13, None, None),
    (4, " \n\t ", None, None, 4, None, None),
    (5, "a b c d e f g h i j k l " * 3000, "en", "hot", 72000, None, None),
    (6, "Zwei \U0001f600 drei  vier\n\n fünf   sechs \n", "de", "s", None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy</div><article><h1>Title &amp; more</h1><p>First
    line<br>goes   on.<div class='cookie-notice'><p>accept</p></div><p><b>Second &#233;<!-- x --></b><p>Third</article>
    <section id="comments"><p>reader</p></section><aside>side</aside><form><p>mail</p></form><footer>foot</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst line goes on.\n\nSecond é\n\nThird"
    for empty in (None, "", "<p></p>", "<!-- only"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("<div><p>alone</p></div>") == "alone"


def test_html_on_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        import html

        want = "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in parts) if t)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 3000 else None
    if often is None:
        from collections import Counter

        often = {g for g, n in Counter(grams).items() if n > 1}
    hit = set()
    for i, g in enumerate(grams):
        if g in often:
            hit.update((i, i + 1, i + 2))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_base(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") + 10**6, "text"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id: base_counts(r.text) for r in docs.collect()}
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
    empty = labels.limit(0)
    assert quality.score_quality(docs.limit(5), empty).where("not base_failed and not kept").count() == 0
    assert quality.keep_good(docs, labels).count() == quality.score_quality(docs, labels).where("kept").count()
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97
    for i in (0, 5, 77):
        assert language.predict(docs.where(F.col("doc_id") == i)).first().held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    rows = {r.doc_id: r for r in language.predict(odd).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[4].lang_pred == "und" and rows[1].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language.predict(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return public_tokenizers.path("byte_bpe_50k.json"), lambda s: t.encode(s or "", add_special_tokens=False).ids + [0]


def check_packing(spark, docs, padding):
    path, ids = encoder()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, ids(r.text))
    rows = packing.pack(docs, path).toPandas()
    for doc, own in rows.groupby("doc_id"):
        for r in own.itertuples():
            part = texts[doc][r.start : r.start + r.length]
            assert len(part) == r.length and r.doc_tokens == len(texts[doc])
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert own.length.sum() % len(texts[doc]) == 0
    filled = 0
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024
        filled += 1024
    assert rows.length.sum() >= (1 - padding) * filled
    return rows


def test_packing(spark, odd):
    check_packing(spark, spark.read.parquet(f"{SF}/documents.parquet"), 0.02)
    rows = check_packing(spark, odd, 1)
    assert len(rows[rows.doc_id == 3]) == 2
    assert packing.pack(odd.limit(0), encoder()[0]).count() == 0


def test_encoder_equals_whole_texts():
    path, ids = encoder()
    odd = ["", " ", "  ", "a  b", "a   b", " a", "a ", "a\n b", "a\n\n b", "\n \nx", "x \n y", "x  y", "\t a\t b ", "it's  we'll 'd 12 345,6", "<|endoftext|> x", "é è\r\n ü 　 z"]
    odd += ["x <|endoftext|> y", "x<|endoftext|>y z"]
    for texts in (odd, odd[::-1], ["plain words"], [], ["x  ", " "]):
        got, bounds = packing._encoder(path)(pa.array(texts, pa.string()))
        assert [got[s:e].tolist() for s, e in zip(bounds, bounds[1:])] == [ids(t)[:-1] for t in texts]


def test_cache_forgets_the_least_used(monkeypatch):
    path, ids = encoder()
    monkeypatch.setattr(packing, "_state", {})
    encode = packing._encoder(path, 60)
    for i in range(12):
        text = " ".join(f"w{i}x{j} the" for j in range(25))
        got, _ = encode(pa.array([text, "the end"]))
        assert got.tolist() == ids(text)[:-1] + ids("the end")[:-1]
    held = packing._state[path, 60][3].number
    assert len(held) <= 90 and "the" in held


def test_columns_are_priced_at_every_size(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    priced = []
    real = packing._knapsack
    monkeypatch.setattr(packing, "_priced", lambda *a, f=packing._priced: priced.append(f(*a)) or priced[-1])
    monkeypatch.setattr(packing, "_knapsack", real)
    rows = packing.pack(docs, encoder()[0]).agg(F.max("sequence_id").alias("n"), F.sum("length").alias("ids")).first()
    assert priced and any((c > 0).sum() > 1 for c, _ in priced[0])
    assert rows.ids >= 0.985 * 1024 * (rows.n + 1)


def test_cutting_stock_covers_demand():
    rng = np.random.default_rng(1)
    for n, most in ((1, 3), (40, 2), (300, 60), (1000, 9)):
        sizes = np.sort(rng.choice(np.arange(1, 1024), n, replace=False))
        demand = rng.integers(1, most + 1, n)
        got = packing.cutting_stock(sizes, demand)
        assert (sum(c * t for c, t in got) == demand).all() and all(c @ sizes <= 1024 for c, _ in got)
        if n == 1000:
            assert sum(t for _, t in got) <= 1.02 * (sizes @ demand) / 1024 + 1


def brute_force(documents: list[tuple], benchmark: list[tuple], size: int = decontaminate.SIZE) -> dict:
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins: dict[tuple, set] = {}
    for item, text in benchmark:
        w = cut(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(x) for x in wins}
    out = {}
    for doc, text in documents:
        w, hit, items = cut(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := wins.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    items |= found
        out[doc] = (len(w), sorted(hit), sorted(items))
    return out


def test_decontamination(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").cast("string"), "text")
    bench = bench.union(spark.createDataFrame([("a", "Two three"), ("b", None), ("c", " .,"), ("d", "a b c d e f g h i j k l m"), ("d", "a b c d e f g h i j k l m"), ("e", "a b c d e f g h i j")], "item_id string, text string"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") + 10**6, "text"))
    docs = docs.union(spark.createDataFrame([(7_000_000, "x A B, c d e f g h i j! k a b c"), (7_000_001, "c b a e d f g h i j k l")], "doc_id long, text string")).withColumn("rows", F.lit("clash"))
    want = brute_force([tuple(r)[:2] for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert sum(bool(w[1]) for w in want.values()) > 5
    rows = decontaminate.decontaminate(docs, bench).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.hit, r["items"], r.n_hit) == (*want[r.doc_id], len(want[r.doc_id][1])), r.doc_id
    path = {r.doc_id: r for r in rows}
    assert set(path[7_000_001].near_items) == {"d", "e"}
    old, decontaminate.BLOCK = decontaminate.BLOCK, 50  # several blocks of windows give the same
    try:
        again = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    finally:
        decontaminate.BLOCK = old
    assert again == path
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
