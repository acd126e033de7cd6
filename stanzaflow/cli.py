"""``python -m stanzaflow.cli text out_path``: features of a file of one document per line."""

from __future__ import annotations

import argparse
import os

from stanzaflow.config import DEFAULT_FEATURES, FEATURE_SETS, CorpusConfig, ResourcePaths, TopicConfig
from stanzaflow.plans.pipeline import extract
from stanzaflow.session import local_session
from stanzaflow.shared import discard_all
from stanzaflow.sources.readers import line_text
from stanzaflow.sources.writers import output_path, write_csv, write_parquet


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stanzaflow")
    p.add_argument("text", help="file or folder with one document per line")
    p.add_argument("out_path")
    p.add_argument("--w2v", help="embeddings: text file or Parquet with word and v")
    p.add_argument("--format", choices=["csv", "hdf5", "parquet"], default="csv", help="hdf5 writes a Parquet folder of the same layout")
    p.add_argument("--inventory", help="custom inventory: JSON object of word lists")
    p.add_argument("--value-inventory")
    p.add_argument("--personality-inventory")
    p.add_argument("--lexicon", default=os.environ.get("LIWC_PATH"))
    p.add_argument("--stopwords")
    p.add_argument("--lemmas")
    p.add_argument("--english-vocab")
    p.add_argument("--features", nargs="*", choices=FEATURE_SETS, default=None)
    p.add_argument("--filt-non-eng", action="store_true")
    p.add_argument("--k", type=int, default=25)
    p.add_argument("--n-iters", type=int, default=30)
    p.add_argument("--min-doc-freq", type=int, default=5)
    p.add_argument("--max-doc-freq", type=float, default=0.3)
    return p


def main(argv: list[str] | None = None) -> str:
    a = parser().parse_args(argv)
    features = tuple(a.features or DEFAULT_FEATURES)
    inventories = {k: v for k, v in (("value", a.value_inventory), ("personality", a.personality_inventory)) if v}
    if a.inventory:
        if not os.path.exists(a.inventory):
            raise ValueError(f"no inventory at {a.inventory}")
        name = os.path.splitext(os.path.basename(a.inventory))[0] or "custom_inventory"
        inventories[name] = a.inventory
        features += (name,)
    spark = local_session()
    paths = ResourcePaths(stopwords=a.stopwords, lemmas=a.lemmas, english_vocab=a.english_vocab, lexicon=a.lexicon, inventories=inventories, embeddings=a.w2v)
    sets = extract(line_text(spark, a.text), paths, features, CorpusConfig(no_below=a.min_doc_freq, no_above=a.max_doc_freq), TopicConfig(k=a.k, n_iters=a.n_iters), a.filt_non_eng)
    out = output_path(a.text, a.out_path, "csv" if a.format == "csv" else "parquet")
    tables = {n: s.table for n, s in sets.items()}
    if a.format == "csv":
        write_csv(tables, out)
    else:
        t = sets.get("topic")
        write_parquet(tables, out, t and t.topic_terms, t and t.vocab)
    discard_all(spark)
    return out


if __name__ == "__main__":
    print(main())
