"""Training-corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Stages work on everything that their
predecessor kept, and read only tables of ``sf_dir`` beside it. A stage that is called has its predecessor's result
written, so it first deletes the scratch tables that earlier stages left for their lazy results.

Defined results, for every stage: an empty table gives an empty one; null and empty texts have no words, so quality rules
drop them, and the other stages keep them (packing as the closing id alone); a null doc_id is kept like any other row, never a near
duplicate; repeated rows of a doc_id stay or go together in all stages but line dedup, which cuts them alike, and packing, which packs each;
extra columns pass through, whatever their names; very long texts are treated whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.llm import decontaminate, line_templates, ngram_join, packing, quality
from dealscope.llm.shared import drop, owned, release, stored, table

OWNER, BATCH, BATCHES = "pipeline stages", 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: packing runs last, on executors whose heaps are full: words that a task keeps, and bytes of text it works on at a time
WORDS, SLICE = 250_000, 1 << 20


def _stage(f):
    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER)
        # whole texts travel in these batches while the stage works, and the stages share their executors with all that went before
        before = spark.conf.get(BATCHES)
        spark.conf.set(BATCHES, str(BATCH))
        try:
            with owned(OWNER):
                return f(spark, docs, sf_dir)
        finally:
            spark.conf.set(BATCHES, before)

    return call


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines are cut out of the texts; n_chars follows where a text changed."""
    out = line_templates.drop_recurring_lines(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size(out.columns[-1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every component of documents linked by 5-word shingles at 0.8 or more stays."""
    linked = ngram_join.link_documents(docs, k=5, threshold=80)
    gone = stored(linked.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = stored(found.where("n_hit > 0").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


@_stage
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=WORDS, slice_bytes=SLICE)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: a trained classifier and the tokenizer are beyond SQL; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
