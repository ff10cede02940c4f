"""Stages of the pipeline on small tables."""

import corpus_pipeline


def test_near_duplicates_from_four_fifths(spark):
    words = [f"word{i}" for i in range(200)]
    other = lambda n: " ".join([f"other{i}" for i in range(n)] + words[n:])
    swapped = lambda n: " ".join(words[:80] + [f"new{i}" for i in range(n)] + words[80 + n :])
    # 196 shingles of five words, of which a block of n changed words takes n + 4: 177 / 215 = 0.82 and 172 / 220 = 0.78
    docs = spark.createDataFrame([(1, " ".join(words)), (2, swapped(15)), (3, None), (4, other(200))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, 4}
    docs = spark.createDataFrame([(1, " ".join(words)), (2, swapped(20))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 2}
