"""Queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import functools
from pathlib import Path

from . import compact_windows, covering_lsh, decontaminate, html_text, language, line_templates, ngram_join, packing, pii, quality, source_audit, suffix_dedup, vector_codes


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _importable(query):
    """Python workers find this package wherever the driver was started from."""

    @functools.wraps(query)
    def call(spark, sf_dir):
        env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
        if root not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
        return query(spark, sf_dir)

    return call


QUERIES = {
    f.__name__: _importable(f)
    for f in (
        line_templates.op1_line_templates,
        pii.op2_pii,
        html_text.op3_html_text,
        suffix_dedup.op4_suffix_dedup,
        quality.op5_quality,
        language.op6_language,
        packing.op7_packing,
        compact_windows.op8_compact_windows,
        ngram_join.op9_ngram_join,
        decontaminate.op10_decontaminate,
        vector_codes.op11_vector_codes,
        source_audit.op12_source_divergence,
        covering_lsh.op13_covering_simhash,
        pipeline,
    )
}

ORACLE = {
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_source_divergence": source_audit.ORACLE,
}
