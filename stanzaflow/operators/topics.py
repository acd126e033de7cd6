"""Probabilistic topics by expectation-maximisation (pLSA).

``theta`` has one row per document, ``beta`` one per term, each with an array of K numbers.
Two forms of a step agree: one of joins and aggregates, for any vocabulary, and one that
keeps a document in a row and runs in Arrow batches with the terms' table at hand, for
vocabularies of bounded size. Initial values are hashes, so equal seeds give equal models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.functions.vectors import dot, zeros
from stanzaflow.operators.corpus import small
from stanzaflow.shared import discard, stage

EPS = 1e-10
FLOOR = 1e-14
#: Terms times topics that are sent to every executor at most; beyond, steps run as joins.
MOST_CELLS = 10_000_000
#: Terms whose names and numbers are held on the driver at most; beyond, as well.
MOST_TERMS = 1_000_000


def hashed_unit(key: Column, z: Column | int, seed: int) -> Column:
    """A number in [0, 1) from the md5 of key, topic and seed; the same in any SQL engine."""
    z = F.lit(z) if isinstance(z, int) else z
    h = F.md5(F.concat_ws("|", key.cast("string"), z.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _init(key: str, k: int, seed: int) -> Column:
    raw = F.array(*[hashed_unit(F.col(key), z, seed) for z in range(k)])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def init_theta(docs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``doc_id, th``: hashed numbers that add up to 1 per document."""
    return docs.select("doc_id", _init("doc_id", k, seed).alias("th"))


def init_beta(vocab: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``term, be``: hashed numbers that add up to 1 per term (not per topic; the first step mends that)."""
    return vocab.select("term", _init("term", k, seed).alias("be"))


def em_step(bow: DataFrame, theta: DataFrame, beta: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """One step as joins and aggregates; both updates use the old values. Gives (theta, beta).

    Documents without counted terms get zeros.
    """
    cells = bow.join(theta, "doc_id").join(small(beta, MOST_CELLS // k), "term")
    cells = cells.withColumn("p", F.zip_with("th", "be", lambda a, b: a * b)).withColumn("s", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    scale = F.col("cnt") / F.when(F.col("s") == 0, F.lit(EPS)).otherwise(F.col("s"))
    q = cells.select("doc_id", "term", *[(F.element_at("p", z + 1) * scale).alias(f"q{z}") for z in range(k)])
    sums = [F.sum(f"q{z}").alias(f"q{z}") for z in range(k)]
    by_doc, by_term = q.groupBy("doc_id").agg(*sums), q.groupBy("term").agg(*sums)
    total = F.lit(EPS)
    for z in range(k):
        total = total + F.col(f"q{z}")
    th = by_doc.select("doc_id", F.array(*[F.col(f"q{z}") / total for z in range(k)]).alias("new"))
    th = theta.select("doc_id").join(th, "doc_id", "left").select("doc_id", F.coalesce("new", zeros(k)).alias("th"))
    tops = by_term.agg(*[(F.sum(f"q{z}") + F.lit(EPS)).alias(f"t{z}") for z in range(k)])
    be = by_term.crossJoin(F.broadcast(tops))  # one row
    be = be.select("term", F.array(*[F.col(f"q{z}") / F.col(f"t{z}") for z in range(k)]).alias("be"))
    return th, be


def document_rows(bow: DataFrame, vocab: DataFrame, theta: DataFrame) -> DataFrame:
    """``doc_id, terms, cnts, th``: a document with its term numbers and counts in one row."""
    ids = bow.join(small(vocab.select("term", "term_id")), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "cnt"))).alias("c"))
    none = F.array().cast("array<bigint>")
    return theta.join(ids, "doc_id", "left").select("doc_id", F.coalesce("c.term_id", none).alias("terms"), F.coalesce("c.cnt", none).alias("cnts"), "th")


def _batch(b: pa.RecordBatch, k: int):
    terms = b.column("terms").flatten().to_numpy(zero_copy_only=False)
    cnts = b.column("cnts").flatten().to_numpy(zero_copy_only=False).astype(float)
    off = b.column("terms").offsets.to_numpy()
    size = np.diff(off)
    th = b.column("th").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return terms, cnts, size, np.repeat(np.arange(len(size)), size), th


def _posterior(th: np.ndarray, be: np.ndarray, cnts: np.ndarray) -> np.ndarray:
    p = th * be
    s = p.sum(axis=1)
    s[s == 0] = EPS
    return p * (cnts / s)[:, None]


def _per_doc(q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows of each document, normalised; zeros for documents without terms."""
    k = q.shape[1]
    out = np.zeros((len(size), k))
    has = size > 0
    if has.any():
        starts = np.append(0, np.cumsum(size[has])[:-1])
        sums = np.add.reduceat(q, starts, axis=0)
        out[has] = sums / (EPS + sums.sum(axis=1, keepdims=True))
    return out


def _list(a: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    n, k = a.shape
    return pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), pa.array(a.ravel(), kind))


def _stepper(beta: np.ndarray, k: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros_like(beta)
        kind, doc_type = ["doc_id", "terms", "cnts", "th", "term_id", "q"], None
        for b in batches:
            doc_type = b.column(0).type
            terms, cnts, size, row, th = _batch(b, k)
            q = _posterior(th[row], beta[terms], cnts)
            for z in range(k):
                part[:, z] += np.bincount(terms, q[:, z], len(beta))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _list(_per_doc(q, size)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.float64()))], names=kind)
        used = np.flatnonzero(part.any(axis=1))
        if len(used) and doc_type is not None:
            n, ints = len(used), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, doc_type), pa.nulls(n, ints), pa.nulls(n, ints), pa.nulls(n, pa.list_(pa.float64())), pa.array(used.astype(np.int64)), _list(part[used])], names=kind)

    return step


@dataclass(frozen=True)
class TopicModel:
    """A fitted model: ``theta`` by document and ``beta`` by term, of ``k`` topics."""

    k: int
    theta: DataFrame
    beta: DataFrame


def fit(bow: DataFrame, docs: DataFrame, vocab: DataFrame, k: int = 25, n_iters: int = 30, seed: int = 0) -> TopicModel:
    """Exactly ``n_iters`` steps from the hashed start. ``docs`` has ``doc_id``, ``vocab`` ``term`` and ``term_id`` from 0."""
    spark = bow.sparkSession
    theta, beta = init_theta(docs, k, seed), init_beta(vocab, k, seed)
    n_terms = vocab.count()
    if n_terms * k > MOST_CELLS or n_terms > MOST_TERMS:
        bow = stage(bow, "bow")
        for _ in range(n_iters):
            t, b = em_step(bow, theta, beta, k)
            theta, beta = stage(t, "theta"), stage(b, "beta")
        return TopicModel(k, theta, beta)
    table = np.zeros((n_terms, k))
    got = beta.join(vocab.select("term", "term_id"), "term").select("term_id", "be").toArrow()
    if len(got):
        table[got.column(0).to_numpy()] = got.column(1).combine_chunks().flatten().to_numpy().reshape(-1, k)
    state = stage(document_rows(bow, vocab, theta), "docs")
    kinds = f"doc_id {dict(state.dtypes)['doc_id']}, terms array<bigint>, cnts array<bigint>, th array<double>, term_id bigint, q array<double>"
    for _ in range(n_iters):
        new = stage(state.select("doc_id", "terms", "cnts", "th").mapInArrow(_stepper(table, k), kinds), "step")
        sums = new.where("term_id is not null").groupBy("term_id").agg(*[F.sum(F.element_at("q", z + 1)).alias(f"q{z}") for z in range(k)])
        table = np.zeros_like(table)
        got = sums.toArrow()  # at most MOST_CELLS numbers
        if len(got):
            table[got.column(0).to_numpy()] = np.stack([c.to_numpy() for c in got.columns[1:]], axis=1)
        table /= EPS + table.sum(axis=0)
        discard(state)
        state = new.where("term_id is null")
        state._stanzaflow_stage = new._stanzaflow_stage
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(table)], "term_id bigint, be array<double>")
    return TopicModel(k, state.select("doc_id", "th"), vocab.join(rows, "term_id").select("term", "be"))


def fold_in(bow: DataFrame, docs: DataFrame, beta: DataFrame, k: int, n_iters: int = 30, seed: int = 0) -> DataFrame:
    """``doc_id, th`` of new documents with ``beta`` held: documents don't meet, so all steps run in one pass."""
    most = min(MOST_CELLS // k, MOST_TERMS)
    got = beta.select("term", "be").orderBy("term").limit(most + 1).toArrow()
    if len(got) > most:
        bow, theta = stage(bow, "bow"), init_theta(docs, k, seed)
        for _ in range(n_iters):
            theta = stage(em_step(bow, theta, beta, k)[0], "theta")
        return theta
    table = got.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if len(got) else np.zeros((0, k))
    names = pd.DataFrame({"term": got.column(0).to_pylist(), "term_id": np.arange(len(got))})
    vocab = bow.sparkSession.createDataFrame(names, "term string, term_id bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts, cnts, size, row, th = _batch(b, k)
            be = table[ts]
            for _ in range(n_iters):
                th = _per_doc(_posterior(th[row], be, cnts), size)
            yield pa.RecordBatch.from_arrays([b.column(0), _list(th)], names=["doc_id", "th"])

    rows = document_rows(bow, vocab, init_theta(docs, k, seed))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, th array<double>")


def perplexity(bow: DataFrame, theta: DataFrame, beta: DataFrame) -> DataFrame:
    """``perplexity`` of counts: exp of minus the mean log-probability, each floored."""
    p = bow.join(theta, "doc_id").join(beta, "term").select("cnt", F.log(F.greatest(dot(F.col("th"), F.col("be")), F.lit(FLOOR))).alias("lp"))
    return p.agg(F.exp(-F.sum(F.col("cnt") * F.col("lp")) / F.sum("cnt")).alias("perplexity"))


def top_terms(beta: DataFrame, topk: int = 20) -> DataFrame:
    """``topic, rank, term, p``: the most likely terms of each topic, ties by term."""
    rows = beta.select("term", F.posexplode("be").alias("topic", "p"))
    w = Window.partitionBy("topic").orderBy(F.desc("p"), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk).select("topic", "rank", "term", "p")


def dominant_topic(theta: DataFrame) -> DataFrame:
    """``doc_id, topic``: the likeliest topic, the lowest of equals."""
    return theta.select("doc_id", (F.array_position("th", F.array_max("th")) - 1).cast("int").alias("topic"))


def topic_columns(theta: DataFrame, k: int) -> DataFrame:
    """``doc_id, topic1 .. topicK``."""
    return theta.select("doc_id", *[F.element_at("th", z + 1).alias(f"topic{z + 1}") for z in range(k)])
