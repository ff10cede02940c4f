"""Every registered query over tables with nulls, empty and long texts, ties, repeated rows and clashing columns, and over empty ones."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dealscope.llm import registry

from test_codes_audit_simhash import audit, codes, components, fingerprint
from test_join_operators import KINDS, valid
from test_map_operators import base_counts, brute_force

COLUMNS = {
    "op1_line_templates": "doc_id n_dropped dropped n_chars_kept kept_sha256",
    "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_html_text": "page_id url text n_chars",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_language": "doc_id held_out lang_pred score",
    "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_compact_windows": "doc_id n_words passages class_id",
    "op9_ngram_join": "doc_id n_shingles component_id",
    "op10_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_source_divergence": "lang source part item value rank",
    "op13_covering_simhash": "doc_id fingerprint component_id",
    "pipeline": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    own = docs.where("length(text) > 600").limit(3).select("text").collect()
    odd = [(None, None), (10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n "), (10**6 + 3, own[0].text), (10**6 + 3, own[0].text), (10**6 + 4, own[1].text + " end"), (10**6 + 5, "mail a@b.co " * 400 + "1" * 3000), (10**6 + 6, own[2].text * 10)]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(c) for c in ("tid", "h", "uid", "kind", "rank", "items", "dropped_lines", "bucket", "component", "shard", "_gone")}
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(more).withColumns(clash).write.parquet(f"{at}/documents.parquet")
    for t, n in (("labels", 200), ("benchmark", 20), ("pages", 20), ("embeddings", 60)):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(n).write.parquet(f"{at}/{t}.parquet")
    return at


def texts(spark, at):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def results():
    return {}


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - {"pipeline"}))  # whose stages are run below
def test_rows_and_columns(spark, tables, results, name):
    got = registry.QUERIES[name](spark, tables)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    rows = results[name] = got.collect()
    if name == "op3_html_text":
        assert len(rows) == spark.read.parquet(f"{tables}/pages.parquet").count()
    elif name == "op11_vector_codes":
        assert sorted((tuple(r[c] for c in COLUMNS[name].split()) for r in rows), key=str) == codes([(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()])
    elif name == "op12_source_divergence":
        assert sorted(tuple(r[c] for c in COLUMNS[name].split()) for r in rows) == audit([(r.text, r.lang, r.source) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()])
    elif name != "op7_packing":
        assert sorted((r.doc_id is not None, r.doc_id) for r in rows if r.doc_id is not None) == sorted((True, d) for d, _ in texts(spark, tables) if d is not None)


def test_links_of_fingerprints(spark, tables, results):
    prints = [(d, fingerprint(t)) for d, t in texts(spark, tables)]
    want = components(prints)
    assert sorted((str(r.doc_id), r.fingerprint) for r in results["op13_covering_simhash"]) == sorted((str(d), f"{f:016x}") for d, f in prints)
    assert all(r.component_id == want.get(r.doc_id) for r in results["op13_covering_simhash"])


def test_counts_of_quality(spark, tables, results):
    want = {}
    for d, t in texts(spark, tables):
        want.setdefault(d, set()).add(base_counts(t))
    for r in results["op5_quality"]:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert own in want[r.doc_id] and r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and not (r.base_failed and r.kept)


def test_pieces_hold_every_id_once(spark, tables, results):
    """Pieces of a document follow each other, and those of a sequence have no gap."""
    by_sequence, by_doc = {}, {}
    for r in results["op7_packing"]:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    rows = {}
    for d, _ in texts(spark, tables):
        rows[d] = rows.get(d, 0) + 1
    assert all(sum(x[1] for x in p) == sum(x[2] for x in p if x[0] == 0) and sum(x[0] == 0 for x in p) == rows[d] for d, p in by_doc.items()) and set(by_doc) == set(rows)


def test_spans_of_passages(spark, tables, results):
    own = {}
    for d, t in texts(spark, tables):
        own.setdefault(d, set()).add(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    for r in results["op8_compact_windows"]:
        spans = [tuple(map(int, p.split(":"))) for p in r.passages.split(",") if p]
        assert r.n_words in own[r.doc_id] and len(spans) == r.n_passages and sum(e - s for s, e in spans) == r.n_repeated_words
        assert all(0 <= s < e <= r.n_words and e - s >= 45 for s, e in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert r.class_id is None if r.doc_id is None else r.class_id <= r.doc_id


def test_digests_of_personal_data(spark, tables, results):
    want = {}
    for d, t in texts(spark, tables):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        want[d] = hashlib.sha256(",".join(spans).encode()).hexdigest(), set(spans)
    for r in results["op2_pii"]:
        assert r.base_sha256 == want[r.doc_id][0] and want[r.doc_id][1] <= set(r.spans.split(",")), r.doc_id


def test_digests_of_benchmark_items(spark, tables, results):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = brute_force(texts(spark, tables), bench)
    for r in results["op10_decontaminate"]:
        n, hit, items = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit))


def test_stages_one_by_one(spark, tables):
    """Each stage against what its operator says of the stage's own input; columns stay as they are."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = corpus_pipeline.stored(stage(spark, docs, tables))
        after = out.collect()
        if name == "packing":
            assert sum(r.length for r in after if r.start == 0) > 0 and len({(r.doc_id, r.start) for r in after}) <= len(after)
            break
        assert out.columns == docs.columns
        if name == "quality rules":
            for r in before:
                n, *_, repeat = base_counts(r.text)
                if n < 50 or 100 * repeat > 50 * n:
                    assert r.doc_id not in {x.doc_id for x in after}
        elif name == "line dedup":
            assert len(after) == len(before)
        elif name == "n-gram Jaccard join":
            kept = {}
            for r in after:
                kept.setdefault(r.text, set()).add(r.doc_id)
            assert all(len(ids) == 1 for t, ids in kept.items())  # copies leave one document
        else:
            hit = {d for d, w in brute_force([(r.doc_id, r.text) for r in before], bench).items() if w[1]}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - hit
        docs = out


def test_empty_tables(spark, tables, tmp_path_factory):
    """The pipeline, and so five operators; the others' tests have their own empty tables."""
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    assert registry.QUERIES["pipeline"](spark, at).collect() == []
