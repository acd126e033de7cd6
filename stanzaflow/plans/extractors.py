"""Extractors: the plug-in protocol and the four that come with the engine."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from stanzaflow.config import TopicConfig
from stanzaflow.operators import inventory as inv
from stanzaflow.operators import lexical, lexicon, topics
from stanzaflow.operators.corpus import Corpus
from stanzaflow.shared import stage


class FeatureSet:
    """A named table of features, ``doc_id`` and columns; topics bring their terms along."""

    def __init__(self, name: str, table: DataFrame, topic_terms: DataFrame | None = None, vocab: DataFrame | None = None):
        self.name, self.table, self.topic_terms, self.vocab = name, table, topic_terms, vocab

    @property
    def columns(self) -> list[str]:
        return [c for c in self.table.columns if c != "doc_id"]

    def __str__(self) -> str:
        return self.name


class Extractor(Protocol):
    """Anything that turns a corpus into a feature set."""

    def extract(self, corpus: Corpus) -> FeatureSet: ...


class LinguisticFeature:
    """Nine lexical statistics; ``drop_nulls`` leaves out columns that hold a null."""

    def __init__(self, stopwords: DataFrame, rare_below: int = 2, quantile: float = 0.75, drop_nulls: bool = False):
        self.stopwords, self.rare_below, self.quantile, self.drop_nulls = stopwords, rare_below, quantile, drop_nulls

    def extract(self, corpus: Corpus) -> FeatureSet:
        t = lexical.linguistic_features(corpus.tokens, self.stopwords, self.rare_below, self.quantile)
        return FeatureSet("linguistic", lexical.drop_null_columns(t) if self.drop_nulls else t)


class Lexicon:
    """Category counts of a wildcard lexicon (``category, pattern, ord``); without one, ``extract`` raises ``ValueError``."""

    def __init__(self, table: DataFrame | None):
        self.table = table

    @property
    def is_loaded(self) -> bool:
        return self.table is not None

    def extract(self, corpus: Corpus) -> FeatureSet:
        if self.table is None:
            raise ValueError("no lexicon is set")
        cats = [r[0] for r in self.table.groupBy("category").agg({"ord": "min"}).orderBy("min(ord)").select("category").collect()]
        return FeatureSet("liwc", lexicon.lexicon_counts(corpus.tokens, lexicon.compile_lexicon(self.table), cats))


class InventoryScore:
    """Distance (or similarity) of documents to word inventories."""

    def __init__(self, name: str, inventory: DataFrame, words: DataFrame, dim: int, similarity: bool = False):
        self.name, self.inventory, self.words, self.dim, self.similarity = name, inventory, words, dim, similarity

    def extract(self, corpus: Corpus) -> FeatureSet:
        return FeatureSet(self.name, inv.inventory_scores(corpus.tokens, self.inventory, self.words, self.dim, self.similarity))


class TopicFeature:
    """Topic shares of a fitted model."""

    def __init__(self, config: TopicConfig = TopicConfig()):
        self.config = config

    def extract(self, corpus: Corpus) -> FeatureSet:
        vocab = stage(corpus.vocab, "vocab")
        m = topics.fit(stage(corpus.bow, "bow"), corpus.tokens.select("doc_id"), vocab, self.config.k, self.config.n_iters, self.config.seed)
        return FeatureSet(f"TopicFeature@{m.k}", topics.topic_columns(m.theta, m.k), m.beta, vocab)
