"""Scores of documents against word inventories by embeddings.

A document and a category are each the mean of the unit vectors of their words, not brought
to unit length again; the score is the dot product, so the mean cosine of all word pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions.vectors import doubles, unit, zeros
from stanzaflow.operators.corpus import small, term_counts
from stanzaflow.shared import stage

#: Word vectors up to this many numbers are sent to every executor, more are joined by shuffle.
BROADCAST_NUMBERS = 8_000_000


def unit_words(embeddings: DataFrame, word: str = "word", vec: str = "v") -> DataFrame:
    """``word, u``: unit vectors; null vectors are left out."""
    v = embeddings.select(F.col(word).alias("word"), doubles(F.col(vec)).alias("v")).where("word is not null and v is not null")
    return v.select("word", unit(F.col("v")).alias("u"))


def _mean(rows: DataFrame, key: str, weight: str, dim: int) -> DataFrame:
    """Weighted mean of ``u`` per key: one sum per dimension, so it combines before the shuffle."""
    sums = [F.sum(F.col(weight) * F.element_at("u", i + 1)).alias(f"s{i}") for i in range(dim)]
    agg = rows.groupBy(key).agg(F.sum(weight).alias("n"), *sums)
    return agg.select(key, F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dim)]).alias("m"))


def category_vectors(inventory: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """``category, m``: mean unit vector of the category's known words, repeats counted; zero without any."""
    hits = inventory.select("category", "word").join(words, "word").withColumn("one", F.lit(1.0))
    means = _mean(hits, "category", "one", dim)
    return inventory.select("category").distinct().join(means, "category", "left").select("category", F.coalesce("m", zeros(dim)).alias("m"))


def document_vectors(toks: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """``doc_id, m``: mean unit vector of the document's known words, repeats counted; zero without any."""
    w = small(words, max(1, BROADCAST_NUMBERS // max(1, dim))).withColumnRenamed("word", "term")
    means = _mean(term_counts(toks).join(w, "term"), "doc_id", "cnt", dim)
    return toks.select("doc_id").join(means, "doc_id", "left").select("doc_id", F.coalesce("m", zeros(dim)).alias("m"))


def inventory_scores(toks: DataFrame, inventory: DataFrame, words: DataFrame, dim: int, similarity: bool = False) -> DataFrame:
    """``doc_id`` and one column per category: distance 1 - score, or the score itself.

    The score is linear in the words of the document: every word is multiplied with every category
    once, in the word table, and a document adds up one number per category, not one per dimension.
    Inventories are word lists: their category vectors are few (``BROADCAST_NUMBERS`` at most).
    """
    cats = category_vectors(inventory, words, dim).orderBy("category").limit(BROADCAST_NUMBERS // max(1, dim) + 1).collect()
    if len(cats) * dim > BROADCAST_NUMBERS:
        raise ValueError("too many categories")
    g = np.array([r["m"] for r in cats], dtype=float).reshape(len(cats), dim)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            s = u @ g.T
            off = np.arange(0, s.size + 1, max(1, len(g)), dtype=np.int32) if len(g) else np.zeros(len(u) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(s.ravel()))], names=["term", "s"])

    hits = small(stage(words.select("word", "u").mapInArrow(each, "term string, s array<double>"), "scores"), max(1, BROADCAST_NUMBERS // max(1, len(cats))))
    one = [F.element_at("s", i + 1) for i in range(len(cats))]
    per = toks.select("doc_id", F.explode("tokens").alias("term")).join(hits, "term").groupBy("doc_id").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(one)])
    out = toks.select("doc_id").join(per, "doc_id", "left")

    def score(i: int) -> Column:
        x = F.coalesce(F.col(f"s{i}") / F.col("n"), F.lit(0.0))
        return x if similarity else F.lit(1.0) - x

    return out.select("doc_id", *[score(i).alias(r["category"]) for i, r in enumerate(cats)])
