"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import blocks, edit_embedding, graph, minhash, mixing, quality, runs, sentencepiece_scan, token_counts, toxicity
from .common import REPEATS_SQL


def _table(name):
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


_docs, _labels = _table("documents"), _table("labels")


def queries() -> dict:
    return {
        "op1_toxicity": lambda spark, sf: toxicity.toxicity(_docs(spark, sf), _labels(spark, sf)),
        "op2_suffix_array_dedup": lambda spark, sf: runs.run_repeats(_docs(spark, sf)),
        "op3_minhash_near_dedup": lambda spark, sf: minhash.near_duplicates(_docs(spark, sf)),
        "op4_document_fingerprints": lambda spark, sf: edit_embedding.edit_groups(_docs(spark, sf)),
        "op5_quality": lambda spark, sf: quality.quality(_docs(spark, sf), _labels(spark, sf)),
        "op6_embedding_near_dedup": lambda spark, sf: graph.near_vectors(_table("embeddings")(spark, sf)),
        "op7_substring_dedup": lambda spark, sf: blocks.block_repeats(_docs(spark, sf)),
        "op8_sentencepiece": lambda spark, sf: sentencepiece_scan.encode(_docs(spark, sf)),
        "op9_mixing": lambda spark, sf: mixing.mix_sources(_docs(spark, sf)),
        "op10_token_counts": lambda spark, sf: token_counts.token_counts(_docs(spark, sf)),
    }


def oracle_sql() -> dict:
    repeats = REPEATS_SQL.format(least=50)
    return {"op2_suffix_array_dedup": repeats, "op6_embedding_near_dedup": graph.PAIRS_SQL, "op7_substring_dedup": repeats}
