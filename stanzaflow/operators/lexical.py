"""Lexical statistics of documents: nine features, fitted on the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzaflow.operators.corpus import BROADCAST_ROWS, collection_frequency, small
from stanzaflow.shared import stage

#: Stopwords up to this many become part of the expression; more are joined.
LITERAL_WORDS = 10_000
COLUMNS = ("num_words", "num_unique_words", "num_stop_words", "num_rare_words", "num_common_words", "ratio_unique_words", "ratio_stop_words", "ratio_rare_words", "ratio_common_words")


def extreme_threshold(cf: DataFrame, quantile: float = 0.75) -> DataFrame:
    """``p``: the exact percentile of collection frequencies, interpolated."""
    return cf.agg(F.percentile("cf", F.lit(quantile)).alias("p"))


def extreme_words(cf: DataFrame, rare_below: int = 2, quantile: float = 0.75) -> DataFrame:
    """``term, kind`` of terms that occur less than ``rare_below`` times (rare) or more than the percentile (common)."""
    p = extreme_threshold(cf, quantile).first()["p"]
    rare, common = F.col("cf") < rare_below, F.col("cf") > F.lit(p)
    return cf.where(rare | common).select("term", rare.alias("rare"), common.alias("common"))


def linguistic_features(toks: DataFrame, stopwords: DataFrame, rare_below: int = 2, quantile: float = 0.75, sent: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id`` and the nine features, nulls where a document has no tokens.

    Words are counted with repetition; unique words and stopwords are distinct ones. Rare and
    common counts are occurrences over the size of the rare or common set (0 for an empty set);
    ratios divide once more by the number of words. Every row of ``toks`` comes out once. Rare and
    common words are sent to every executor if they are ``sent`` at most; else the ``sent`` most
    frequent ones are, which hold nearly all occurrences, and only other tokens move to their words.
    """
    # term tables are written once: the percentile, the sizes and the join all read them
    cf = stage(collection_frequency(toks), "cf")
    extreme = stage(extreme_words(cf, rare_below, quantile), "extreme")
    sizes = extreme.agg(F.sum(F.col("rare").cast("long")).alias("r"), F.sum(F.col("common").cast("long")).alias("c"), F.count("*").alias("n")).first()
    n_rare, n_common = sizes["r"] or 0, sizes["c"] or 0
    stop = stopwords.select("term").where("term is not null").distinct()
    t = toks.select("doc_id", F.monotonically_increasing_id().alias("_row"), "tokens", F.array_distinct("tokens").alias("_d"))
    few = [r[0] for r in stop.limit(LITERAL_WORDS + 1).collect()]
    if len(few) <= LITERAL_WORDS:
        stops = F.size(F.filter("_d", lambda x: x.isin(*few))) if few else F.lit(0)
        t = t.select("doc_id", "_row", "tokens", F.size("_d").alias("_u"), stops.alias("_s"))
        keys = ["doc_id", "_row", "_u", "_s"]
        rows = t.select(*keys, F.explode_outer("tokens").alias("term"))
    else:
        # a token of many stopwords is looked up where it stands first in its document
        t = t.select("doc_id", "_row", "tokens", F.size("_d").alias("_u"))
        keys = ["doc_id", "_row", "_u"]
        rows = t.select(*keys, F.posexplode_outer("tokens").alias("pos", "term"), "tokens")
        rows = rows.select(*keys, "term", (F.array_position("tokens", F.col("term")) == F.col("pos") + 1).alias("_first"))
        rows = rows.join(small(stop.withColumn("_stop", F.lit(1))), "term", "left").withColumn("_s1", F.when(F.col("_first"), F.col("_stop")))
    if sizes["n"] <= sent:
        flagged = rows.join(F.broadcast(extreme), "term", "left")
    else:
        hot = cf.join(extreme, "term").orderBy(F.desc("cf"), "term").limit(sent).select("term", "rare", "common")
        hot = F.broadcast(stage(hot, "hot"))  # ``sent`` rows
        tail = rows.join(hot.select("term"), "term", "left_anti").join(extreme, "term", "left")
        flagged = rows.join(hot, "term").unionByName(tail)
    held = [F.sum(F.when(F.col(k), 1).otherwise(0)).alias(f"{k}_n") for k in ("rare", "common")]
    per = flagged.groupBy(*keys).agg(F.count("term").alias("_n"), *held, *([] if "_s" in keys else [F.count("_s1").alias("_s")]))
    out = per.select(
        "doc_id", F.when(F.col("_n") > 0, F.col("_n")).cast("bigint").alias("num_words"), F.greatest("_u", F.lit(0)).cast("bigint").alias("num_unique_words"), F.greatest("_s", F.lit(0)).cast("bigint").alias("num_stop_words"),
        (F.col("rare_n") / F.lit(float(max(1, n_rare)))).alias("num_rare_words"), (F.col("common_n") / F.lit(float(max(1, n_common)))).alias("num_common_words"),
    )
    ratios = [(F.col(f"num_{k}_words") / F.col("num_words")).alias(f"ratio_{k}_words") for k in ("unique", "stop", "rare", "common")]
    return out.select("*", *ratios)


def drop_null_columns(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` without the columns that hold a null anywhere (the schema depends on the data)."""
    cols = [c for c in df.columns if c != key]
    has = df.agg(*[F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0)).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if has[c]])
