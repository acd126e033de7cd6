"""From a corpus to its feature sets, as the command line runs it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.config import DEFAULT_FEATURES, CorpusConfig, ResourcePaths, TopicConfig
from stanzaflow.operators.corpus import Corpus, bag_of_words, document_frequency, drop_stopwords, lemmatize, prune_vocab, tokens
from stanzaflow.operators.inventory import unit_words
from stanzaflow.operators.langfilter import filter_english
from stanzaflow.plans.extractors import FeatureSet, InventoryScore, Lexicon, LinguisticFeature, TopicFeature
from stanzaflow.shared import stage
from stanzaflow.sources import readers


def default_stopwords(spark: SparkSession) -> DataFrame:
    """Spark's English list."""
    from pyspark.ml.feature import StopWordsRemover

    return spark.createDataFrame([(w,) for w in StopWordsRemover.loadDefaultStopWords("english")], "term string")


def extract(docs: DataFrame, resources: ResourcePaths = ResourcePaths(), features: tuple[str, ...] = DEFAULT_FEATURES, corpus: CorpusConfig = CorpusConfig(), topic: TopicConfig = TopicConfig(), english_only: bool = False) -> dict[str, FeatureSet]:
    """Feature sets of ``doc_id, text``. Texts are tokenised once; lexical sets keep stopwords, the others don't.

    Inventory sets need embeddings; a set whose resource is missing raises ``ValueError``.
    """
    spark = docs.sparkSession
    stop = readers.word_list(spark, resources.stopwords) if resources.stopwords else default_stopwords(spark)
    if english_only:
        if not resources.english_vocab:
            raise ValueError("english_only needs an English vocabulary")
        docs = filter_english(docs, readers.word_list(spark, resources.english_vocab), stop)
    raw = tokens(docs)
    if resources.lemmas:
        raw = lemmatize(raw, readers.lemma_table(spark, resources.lemmas))
    raw = stage(raw, "tokens")
    full = Corpus(docs, raw, None, None)
    out: dict[str, FeatureSet] = {}
    if "linguistic" in features:
        out["linguistic"] = LinguisticFeature(stop).extract(full)
    if "liwc" in features:
        out["liwc"] = Lexicon(readers.lexicon_json(spark, resources.lexicon)).extract(full)
    rest = [f for f in features if f not in ("linguistic", "liwc")]
    if not rest:
        return out
    kept = stage(drop_stopwords(raw, stop), "kept") if corpus.filter_stopwords else raw
    words, dim = None, 0
    if any(f != "topic" for f in rest):
        if not resources.embeddings:
            raise ValueError("inventory scores need embeddings")
        words = stage(unit_words(readers.embeddings(spark, resources.embeddings)), "words")
        dim = words.select(F.size("u")).first()[0]
    for f in rest:
        if f == "topic":
            vocab = stage(prune_vocab(document_frequency(kept), docs.count(), corpus.no_below, corpus.no_above, corpus.keep_n), "vocab")
            out[f] = TopicFeature(replace(topic)).extract(Corpus(docs, kept, vocab, bag_of_words(kept, vocab)))
        else:
            if f not in resources.inventories:
                raise ValueError(f"no inventory is set for {f}")
            out[f] = InventoryScore(f, readers.inventory_json(spark, resources.inventories[f]), words, dim).extract(Corpus(docs, kept, None, None))
    return out
