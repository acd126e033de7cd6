"""Document-local features on streams: fitted tables are static, documents flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stanzaflow.functions.text import tokenize
from stanzaflow.operators.corpus import collection_frequency
from stanzaflow.operators.lexical import extreme_words


def fit_words(toks: DataFrame, stopwords: DataFrame, most: int = 1_000_000) -> dict[str, list[str]]:
    """Rare, common and stop words of a fitted corpus; refused above ``most`` words."""
    ext = extreme_words(collection_frequency(toks), 2, 0.75)
    rows = ext.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rare and common words")
    stop = [r["term"] for r in stopwords.select("term").distinct().limit(most).collect()]
    return {"rare": [r["term"] for r in rows if r["rare"]], "common": [r["term"] for r in rows if r["common"]], "stop": stop}


def document_counts(docs: DataFrame, stopwords: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, num_words, num_unique_words, num_stop_words``: the same for a table and a stream."""
    t = docs.select(F.col(doc).alias("doc_id"), tokenize(F.col(text)).alias("t"))
    n = F.size("t")
    stop = F.size(F.filter(F.array_distinct("t"), lambda x: x.isin(*stopwords))) if stopwords else F.lit(0)
    return t.select("doc_id", F.when(n > 0, n).cast("bigint").alias("num_words"), F.size(F.array_distinct("t")).cast("bigint").alias("num_unique_words"), stop.cast("bigint").alias("num_stop_words"))


def stream_documents(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """New Parquet files under ``path`` as a stream of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes all that has come so far to ``out``, each document once, and stops."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
