"""Token counts by count-only Viterbi over Aho-Corasick matches of a unigram vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, ready, trim
from .unigram import MODEL, SPACE, Counts, Unigram, loaded, vocabulary


def count_tokens(texts: pa.Array, unigram: Unigram, counts: Counts, size: int = 16_000_000) -> np.ndarray:
    """Number of tokens of each text; its units are ``Unigram.units``, each different one of about ``size`` bytes of text is looked up once."""
    if len(texts) > 1 and texts.nbytes > size:
        half = len(texts) // 2
        return np.concatenate([count_tokens(x, unigram, counts, size) for x in (texts[:half], texts[half:])])
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
    out = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(odd).tolist():
        out[i] = sum(map(counts.__getitem__, unigram.units(texts[i].as_py())))
    if len(plain):
        marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), " ", f" {SPACE}"), "\n", " \n ")
        units = pc.split_pattern(pc.binary_join_element_wise(SPACE, marked, ""), " ")
        coded = pc.dictionary_encode(units.flatten())
        at = coded.indices.to_numpy()
        many = counts.of(coded.dictionary.to_pylist(), np.bincount(at))
        out[plain] = np.add.reduceat(many[at], units.offsets.to_numpy()[:-1])
    return out


def count_column(spark, text: Column, model: str = MODEL) -> Column:
    """Number of tokens of ``text``; 0 for a null or empty one."""
    shared = ready(spark).sparkContext.broadcast(vocabulary(model))

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        unigram, counts, _ = loaded(shared)
        made = pa.array(count_tokens(text, unigram, alone(counts)))
        trim()
        return made

    return count(text.cast("string"))


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``.

    Tie rules and byte fallback are those in ``unigram``. Null and empty texts
    have 0 tokens; null ids stay; repeated rows are counted each; other
    columns are not read; an empty table gives an empty one. The vocabulary is
    broadcast: its size is the tokenizer's, not the corpus's.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), count_column(docs.sparkSession, F.col("text"), model).alias("n_tokens"))
