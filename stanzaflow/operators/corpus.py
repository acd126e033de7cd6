"""Tokens, vocabulary and bag of words of a corpus.

Everything is a function of (documents, settings); nothing is changed in place. Steps that
need the whole corpus give a small table of terms, steps on single documents use it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.config import CorpusConfig
from stanzaflow.functions.text import padded_ngrams, tokenize
from stanzaflow.shared import stage

#: A word list up to this many rows is sent to every executor, a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (default: ``BROADCAST_ROWS``); the count stops there."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tokens``: default tokens in order; an empty array for null or empty texts."""
    return docs.select(F.col(doc).alias("doc_id"), tokenize(F.col(text)).alias("tokens"))


def token_rows(toks: DataFrame) -> DataFrame:
    """``doc_id, pos, term``: one row per token, positions from 0; documents without tokens have none."""
    return toks.select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def _back(rows: DataFrame, toks: DataFrame) -> DataFrame:
    """Token rows back to arrays in order; documents that lost all tokens get an empty array."""
    arrays = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("s")).select("doc_id", F.col("s.term").alias("tokens"))
    return toks.select("doc_id").join(arrays, "doc_id", "left").select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def lemmatize(toks: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Tokens with each term replaced by its lemma; terms that the table lacks stay as they are."""
    table = small(lemmas.groupBy("term").agg(F.min("lemma").alias("lemma")))
    rows = token_rows(toks).join(table, "term", "left").select("doc_id", "pos", F.coalesce("lemma", "term").alias("term"))
    return _back(rows, toks)


def drop_stopwords(toks: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Tokens that are no stopwords, in order."""
    rows = token_rows(toks).join(small(stopwords.select("term").distinct()), "term", "left_anti")
    return _back(rows, toks)


def ngrams(toks: DataFrame, unit: str = "unigram") -> DataFrame:
    """Padded n-grams; anything but ``unigram`` and ``bigram`` means trigrams."""
    n = {"unigram": 1, "bigram": 2}.get(unit, 3)
    return toks.select("doc_id", padded_ngrams(F.col("tokens"), n).alias("tokens"))


def collection_frequency(toks: DataFrame) -> DataFrame:
    """``term, cf``: occurrences in the collection."""
    return toks.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("cf"))


def term_counts(toks: DataFrame) -> DataFrame:
    """``doc_id, term, cnt``."""
    return toks.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("cnt"))


def document_frequency(toks: DataFrame) -> DataFrame:
    """``term, df, cf`` in one pass: every token adds to ``cf``, every distinct one of a document to ``df``."""
    each = lambda arr, df, cf: F.transform(arr, lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(cf).alias("cf")))
    both = F.concat(each(F.col("tokens"), 0, 1), each(F.array_distinct("tokens"), 1, 0))
    return toks.select(F.explode(both).alias("s")).groupBy("s.term").agg(F.sum("s.df").cast("bigint").alias("df"), F.sum("s.cf").cast("bigint").alias("cf"))


def prune_vocab(freq: DataFrame, n_docs: int, no_below: int = 5, no_above: float = 0.3, keep_n: int = 100_000) -> DataFrame:
    """``term, term_id, df, cf`` of terms in ``no_below`` documents or more and in at most int(no_above x n_docs).

    The ``keep_n`` most frequent by documents stay (ties by term); ids count from 0 by term.
    """
    kept = freq.where((F.col("df") >= no_below) & (F.col("df") <= int(no_above * n_docs))).orderBy(F.desc("df"), "term").limit(keep_n)
    return kept.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint").alias("term_id"), "df", "cf")  # at most keep_n rows


def bag_of_words(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_id, term, cnt`` over the vocabulary; other terms are left out before counting."""
    rows = toks.select("doc_id", F.explode("tokens").alias("term")).join(small(vocab.select("term")), "term", "left_semi")
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"))


@dataclass(frozen=True)
class Corpus:
    """The tables of a corpus: documents, tokens, vocabulary and bag of words."""

    docs: DataFrame
    tokens: DataFrame
    vocab: DataFrame
    bow: DataFrame


def preprocess(docs: DataFrame, config: CorpusConfig = CorpusConfig(), stopwords: DataFrame | None = None, lemmas: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> Corpus:
    """Tokens, lemmas, stopwords (after lemmas, unigrams only), n-grams, pruning and counts."""
    toks = tokens(docs, doc, text)
    if lemmas is not None:
        toks = lemmatize(toks, lemmas)
    if config.unit == "unigram":
        if config.filter_stopwords and stopwords is not None:
            toks = drop_stopwords(toks, stopwords)
    else:
        toks = ngrams(toks, config.unit)
    vocab = stage(prune_vocab(document_frequency(toks), docs.count(), config.no_below, config.no_above, config.keep_n), "vocab")
    return Corpus(docs, toks, vocab, bag_of_words(toks, vocab))
