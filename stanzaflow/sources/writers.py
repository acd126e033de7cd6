"""Writers of feature sets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzaflow.operators.assemble import align


def output_path(source: str, out_path: str, fmt: str = "csv") -> str:
    """``<stem of source>_feat.<csv|parquet>`` in ``out_path``."""
    stem = os.path.splitext(os.path.basename(source.rstrip("/")))[0]
    return os.path.join(out_path, f"{stem}_feat.{'csv' if fmt == 'csv' else 'parquet'}")


def formatted(df: DataFrame, include_id: bool = True) -> DataFrame:
    """All values as text with eight decimals; nulls stay null."""
    cols = [F.format_string("%.8f", F.col(c).cast("double")).alias(c) for c in df.columns if c != "doc_id"]
    cols = [F.when(F.col(n).isNotNull(), c).alias(n) for n, c in zip([c for c in df.columns if c != "doc_id"], cols)]
    return df.select(*(["doc_id"] if include_id else []), *cols)


def write_csv(sets: dict[str, DataFrame], path: str, include_id: bool = True, single_file: bool = False) -> None:
    """Aligned sets as CSV with a header ``<set>_<column>``; sorted by id within files."""
    out = align(sets)
    out = (out.coalesce(1) if single_file else out).sortWithinPartitions("doc_id")
    formatted(out, include_id).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(sets: dict[str, DataFrame], path: str, topic_terms: DataFrame | None = None, vocab: DataFrame | None = None) -> None:
    """One table per set under ``features/``, in the rows of the first; ``topic_terms`` and ``vocab`` beside them."""
    if not sets:
        raise ValueError("no feature sets")
    ids = next(iter(sets.values())).select("doc_id")
    for name, df in sets.items():
        ids.join(df, "doc_id", "left").write.mode("overwrite").parquet(f"{path}/features/{name}")
    if topic_terms is not None:
        topic_terms.write.mode("overwrite").parquet(f"{path}/features/topic_terms")
    if vocab is not None:
        vocab.write.mode("overwrite").parquet(f"{path}/features/vocab")
