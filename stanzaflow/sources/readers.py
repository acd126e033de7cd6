"""Readers of corpora, word lists, maps, embeddings and sparse matrices."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LYRICS_SCHEMA = "message struct<header: struct<status_code: int>, body: struct<lyrics: struct<lyrics_body: string>>>"
FOOTER_LINES = 3


#: On-disk size from which a table is worth dealing out to all cores, and up to which that costs next to nothing.
DEAL_LEAST, DEAL_MOST = 256 * 1024, 32 * 1024 * 1024


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, read as it lies.

    Only a small table (``DEAL_MOST`` bytes at most) of fewer files than there are cores is dealt out
    to all of them: it may be one row group, which no split setting can part.
    """
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not DEAL_LEAST <= size <= DEAL_MOST:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def line_text(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text``: one document per line, stripped; blank lines stay as empty documents.

    Ids count from 0 in the order of files and of their lines; lines are counted per file split,
    so no row moves.
    """
    rows = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    part, inner = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    splits = rows.groupBy(part.alias("p"), "f", "b").agg(F.count("*").alias("n"), F.min(inner).alias("lo")).orderBy("f", "b").collect()
    at, offsets = 0, []
    for s in splits:
        offsets.append((s["p"], s["f"], s["b"], at - s["lo"]))
        at += s["n"]
    off = spark.createDataFrame(offsets, "p bigint, f string, b bigint, shift bigint")
    text = F.regexp_replace("value", r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")
    out = rows.withColumn("p", part).join(F.broadcast(off), ["p", "f", "b"])  # one row per file split
    return out.select((inner + F.col("shift")).alias("doc_id"), text.alias("text"))


def lyrics_body(body: Column) -> Column:
    """Lower-cased lines without empty ones and without the last three (the provider's footer), joined by blanks."""
    lines = F.filter(F.split(F.lower(body), "\n"), lambda x: x != "")
    return F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - FOOTER_LINES, F.lit(0))), " ")


def lyrics_json(spark: SparkSession, path: str, suffix: str = "json", keep_empty: bool = False) -> DataFrame:
    """``tid, text`` of API responses, one file each; the id is the file name up to the suffix.

    Other statuses and missing bodies give an empty text; empty texts are dropped unless asked for.
    """
    df = spark.read.schema(LYRICS_SCHEMA).option("multiLine", True).option("pathGlobFilter", f"*.{suffix}").json(path)
    ok = F.col("message.header.status_code") == 200
    text = F.when(ok, F.coalesce(lyrics_body(F.col("message.body.lyrics.lyrics_body")), F.lit(""))).otherwise("")
    out = df.select(F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*?)\.{suffix}", 1).alias("tid"), text.alias("text"))
    return out if keep_empty else out.where("text <> ''")


def id_map_csv(spark: SparkSession, path: str) -> DataFrame:
    """``mxm, msd, line_no`` of a two-column file without header; ``operators.assemble.id_map`` picks the last of repeats.

    Lines are numbered in the order of files and of lines within them, however the files are split.
    """
    rows = line_text(spark, path).where("text <> ''")
    return rows.select(F.from_csv("text", "mxm string, msd string").alias("r"), F.col("doc_id").alias("line_no")).select("r.*", "line_no")


def lemma_table(spark: SparkSession, path: str) -> DataFrame:
    """``term, lemma`` from a Parquet table, or from lines of the two words parted by a comma or tab (no header); lower-cased."""
    if path.rstrip("/").endswith("parquet"):
        rows = spark.read.parquet(path).select("term", "lemma")
    else:
        parts = F.split("value", "[,\t]")
        rows = spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("term"), parts[1].alias("lemma"))
    low = lambda c: F.lower(F.trim(c)).alias(c)
    return rows.select(low("term"), low("lemma")).where("term <> '' and lemma <> ''")


def inventory_json(spark: SparkSession, path: str) -> DataFrame:
    """``category, word, pos, ord`` of a JSON object of word lists; repeats stay. Raises ``ValueError`` on a missing file or another shape."""
    import json

    if "://" not in path and not os.path.exists(path):
        raise ValueError(f"no inventory at {path}")
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a word list made by hand
    data = json.loads(text)
    return inventory(spark, data)


def inventory(spark: SparkSession, data: dict[str, list[str]]) -> DataFrame:
    """The same from a dictionary."""
    if not isinstance(data, dict) or not all(isinstance(k, str) and isinstance(v, list) and all(isinstance(w, str) for w in v) for k, v in data.items()):
        raise ValueError("an inventory is an object of lists of words")
    rows = [(c, w, i, k) for k, (c, ws) in enumerate(data.items()) for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "category string, word string, pos int, ord int")


def lexicon_json(spark: SparkSession, path: str | None) -> DataFrame | None:
    """``category, pattern, ord`` in dictionary order; None where no lexicon is set."""
    if not path:
        return None
    inv = inventory_json(spark, path)
    return inv.select("category", F.col("word").alias("pattern"), (F.col("ord") * 1_000_000 + F.col("pos")).alias("ord"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """``term``: one word per line, or a table with such a column."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else spark.read.text(path).select(F.trim("value").alias("term"))
    return df.select("term").where("term <> ''")


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``word, v`` from a table, or from text lines of a word and numbers (a header of two numbers is passed over)."""
    if path.rstrip("/").endswith("parquet"):
        return spark.read.parquet(path).select("word", F.col("v").cast("array<double>").alias("v"))
    parts = F.split(F.trim("value"), " ")
    return spark.read.text(path).where(F.size(parts) > 2).select(parts[0].alias("word"), F.slice(parts, 2, F.size(parts) - 1).cast("array<double>").alias("v"))


def csr_parquet(spark: SparkSession, path: str, row: str = "users", col: str = "items") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(data, rows, cols) for ``operators.assemble.csr_to_long`` from tables ``data``, ``users`` and ``items`` under ``path``."""
    return spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/{row}"), spark.read.parquet(f"{path}/{col}")
