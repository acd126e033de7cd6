"""Settings of the extraction pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CorpusConfig:
    """How texts become tokens and a bag of words."""

    unit: str = "unigram"
    filter_stopwords: bool = True
    no_below: int = 5
    no_above: float = 0.3
    keep_n: int = 100_000


@dataclass(frozen=True)
class TopicConfig:
    """Size and length of a topic fit; equal seeds give equal models."""

    k: int = 25
    n_iters: int = 30
    seed: int = 0


@dataclass(frozen=True)
class ResourcePaths:
    """Where word lists and models lie; any may be missing."""

    stopwords: str | None = None
    lemmas: str | None = None
    english_vocab: str | None = None
    lexicon: str | None = None
    inventories: dict[str, str] = field(default_factory=dict)
    embeddings: str | None = None
    id_map: str | None = None


#: Feature sets that the command line knows.
FEATURE_SETS = ("linguistic", "liwc", "value", "personality", "topic")
DEFAULT_FEATURES = ("linguistic", "value", "personality", "topic")
