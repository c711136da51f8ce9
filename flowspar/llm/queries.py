"""Queries of the llm operators over the whole tables, and their SQL where it can be given."""

from __future__ import annotations

import corpus_pipeline
from flowspar.llm import capture, chat, decontaminate, lattice, mixing, near, ogg, quality, suffix, toxicity


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark, sf_dir):
    return quality.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_suffix_array_repeats(spark, sf_dir):
    return suffix.repeated_spans(_table(spark, sf_dir, "documents"))


def op3_capture_index(spark, sf_dir):
    return capture.capture_index(_table(spark, sf_dir, "pages"))


def op4_reply_trees(spark, sf_dir):
    return chat.reply_paths(chat.threaded(chat.reply_parents(_table(spark, sf_dir, "conversations"))))


def op5_lattice_likelihood(spark, sf_dir):
    return lattice.lattice_ranks(_table(spark, sf_dir, "documents"))


def op6_poisson_source_mix(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return mixing.poisson_mix(docs, mixing.quality_weights(docs, _table(spark, sf_dir, "labels")))


def op7_ogg_packets(spark, sf_dir):
    return ogg.ogg_packets(ogg.documents_as_ogg(_table(spark, sf_dir, "documents")))


def op8_wu_manber_leaks(spark, sf_dir):
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_string_kernel_toxicity(spark, sf_dir):
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_lsh_forest_near_duplicates(spark, sf_dir):
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_importance_resampling,
    op2_suffix_array_repeats,
    op3_capture_index,
    op4_reply_trees,
    op5_lattice_likelihood,
    op6_poisson_source_mix,
    op7_ogg_packets,
    op8_wu_manber_leaks,
    op9_string_kernel_toxicity,
    op10_lsh_forest_near_duplicates,
)


def queries() -> dict:
    return {**{f.__name__: f for f in QUERIES}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {
        "op2_suffix_array_repeats": suffix.sql(),
        "op3_capture_index": capture.sql(),
        "op4_reply_trees": chat.sql(),
        "op6_poisson_source_mix": mixing.sql(),
        "op7_ogg_packets": ogg.sql(),
        "op8_wu_manber_leaks": decontaminate.sql(),
    }
    return {**sql, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
