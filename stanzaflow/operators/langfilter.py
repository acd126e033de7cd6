"""Keeping English documents: words outside a vocabulary, and topics of foreign words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzaflow.config import CorpusConfig
from stanzaflow.functions.text import split_tokens
from stanzaflow.operators import topics
from stanzaflow.operators.corpus import preprocess, small
from stanzaflow.shared import stage


def non_englishness(docs: DataFrame, english: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n``: distinct alphabetic tokens outside the vocabulary; its size for an empty text."""
    vocab = english.select(F.lower("term").alias("term")).distinct()
    size = vocab.count()
    words = F.array_distinct(F.filter(split_tokens(F.col(text)), lambda t: t.rlike(r"^\p{L}+$")))
    d = docs.select(F.col(doc).alias("doc_id"), (F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty"), words.alias("w"))
    out = d.select("doc_id", F.explode("w").alias("term")).join(small(vocab), "term", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))
    return d.join(out, "doc_id", "left").select("doc_id", F.when(F.col("empty"), F.lit(size)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("n"))


def total_non_englishness(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"))


def foreign_topics(beta: DataFrame, english: DataFrame, top_k_words: int = 50, thresh: int = 15) -> DataFrame:
    """``topic`` of topics with ``thresh`` or more of their top terms outside the vocabulary."""
    top = topics.top_terms(beta, top_k_words)
    out = top.join(english.select(F.lower("term").alias("term")).distinct(), "term", "left_anti")
    return out.groupBy("topic").count().where(F.col("count") >= thresh).select("topic")


def drop_foreign(docs: DataFrame, theta: DataFrame, foreign: DataFrame) -> DataFrame:
    """``docs`` without those whose likeliest topic is a foreign one."""
    drop = topics.dominant_topic(theta).join(F.broadcast(foreign), "topic").select("doc_id")  # at most k topics
    return docs.join(drop, "doc_id", "left_anti")


def filter_english(docs: DataFrame, english: DataFrame, stopwords: DataFrame | None = None, k: int = 20, thresh: int = 15, top_k_words: int = 50, n_iter: int = 1, em_iters: int = 30, preproc: bool = True, seed: int = 0) -> DataFrame:
    """Documents without those whose likeliest topic is foreign; fitted anew in each of ``n_iter`` rounds.

    Ends early when no topic is foreign. ``docs`` has ``doc_id`` and ``text``.
    """
    config = CorpusConfig(no_below=5, no_above=0.8) if preproc else CorpusConfig(no_below=0, no_above=1.0)
    for _ in range(n_iter):
        corpus = preprocess(docs, config, stopwords)
        model = topics.fit(corpus.bow, docs.select("doc_id"), stage(corpus.vocab, "vocab"), k, em_iters, seed)
        bad = stage(foreign_topics(model.beta, english, top_k_words, thresh), "bad")
        if bad.isEmpty():
            break
        docs = drop_foreign(docs, model.theta, bad)
    return docs
