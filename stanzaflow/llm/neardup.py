"""Groups of near-duplicate records: MinHash with banding, verification, components.

Word shingles are hashed and many universal hash minima (multiply-add) per set are taken in
Arrow batches, in one pass over the texts, and cut into bands; records that agree in a band
become candidates. Copies (equal shingle sets) are one node from the start. Within a bucket
every member is first compared with the bucket's least member only, so the work stays linear
where a bucket is one real group, however large; then members of different components that
share a bucket are compared, in blocks of bounded size. Both steps verify by the signatures,
then by the exact similarity of the sets, worked out anew from the texts of candidates only.
Components come from alternating large-star and small-star.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stanzaflow.shared import discard, stage

MOST_HASHES = 320
MISS = 0.006
BLOCK = 64
#: Texts that a task works on at a time.
TEXTS = 500
#: So many large buckets (24 bytes each) are sent to every executor at most; more are joined by shuffle.
BROADCAST_BUCKETS = 1_000_000


def banding(threshold: float, most: int = MOST_HASHES, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the most selective banding that misses a pair at the threshold with probability ``miss`` at most."""
    best = (1, math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999999))))
    for r in range(2, 33):
        b = math.ceil(math.log(miss) / math.log1p(-(min(threshold, 0.999999) ** r)))
        if r * b <= most:
            best = (r, b)
    return best


_WORD = re.compile(r"[^\W_]+")


class _WordHashes(dict):
    """64-bit hash of a word, kept once worked out."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], n: int, known: _WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of the sequences of ``n`` words of every text; none for texts of fewer words."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    size = [len(w) for w in words]
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(size))
    s = h[: max(0, len(h) - n + 1)]
    for j in range(1, n):
        s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    out, at = [], 0
    for k in size:
        out.append(np.unique(s[at : at + max(0, k - n + 1)]))
        at += k
    return out


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each set, whatever the order; empty sets have 0."""
    out = np.zeros(len(sets), np.int64)
    size = np.array([len(x) for x in sets], np.uint64)
    has = np.flatnonzero(size)
    if len(has):
        at = np.append(0, np.cumsum(size[has])[:-1]).astype(np.int64)
        out[has] = _mixed(np.add.reduceat(_mixed(np.concatenate([sets[i] for i in has])), at) + size[has]).view(np.int64)
    return out


def _signer(n: int, least: int, rows: int, bands: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    c = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint32)
    mix = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def minima(x: np.ndarray) -> np.ndarray:
        x, low = (x >> np.uint64(32)).astype(np.uint32), None
        for k in range(0, len(x), 1024):
            m = (x[k : k + 1024, None] * a + c).min(axis=0)
            low = m if low is None else np.minimum(low, m)
        return low

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _WordHashes(), set()
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                sets = shingle_sets(batch.column(1).to_pylist(), n, known)
                prints = [p if len(x) >= least else None for p, x in zip(_prints(sets).tolist(), sets)]
                low, fresh = [], []
                for i, p in enumerate(prints):
                    # of the copies that a task sees only the first is signed
                    if p is not None and p not in seen:
                        seen.add(p)
                        low.append(minima(sets[i])), fresh.append(i)
                if len(seen) > 1_000_000:
                    seen.clear()
                low = np.array(low, np.uint32).reshape(-1, rows * bands)
                keys = _mixed((low.astype(np.uint64).reshape(-1, bands, rows) * mix).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
                lanes = (low >> np.uint32(8)).astype(np.uint8)
                sig, size = [None] * len(sets), np.zeros(len(sets), np.int32)
                for r, i in enumerate(fresh):
                    sig[i], size[i] = lanes[r].tobytes(), bands
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(sig, pa.binary()), lists], names=["d", "fp", "k", "sig", "bands"])

    return sign


def _setter(n: int):
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the texts that have the print they are asked for, each once per task."""
        known, seen = _WordHashes(), set()
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch, fps, out = whole.slice(lo, TEXTS), [], []
                sets = shingle_sets(batch.column(1).to_pylist(), n, known)
                for p, x, own in zip(batch.column(0).to_pylist(), sets, _prints(sets).tolist()):
                    if p not in seen and len(x) and own == p:
                        seen.add(p), fps.append(p), out.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(out, pa.binary())], names=["fp", "sh"])

    return give


def _exact(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                c = int((both[1:] == both[:-1]).sum())
                sim[i] = c / (len(both) - c) if c >= threshold * (len(both) - c) else -1
            keep = pa.array(sim >= 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(sim[sim >= 0])], names=["a", "b", "sim"])

    return check


@F.pandas_udf(DoubleType())
def _agreement(a, b):
    """Similarity that two signatures of 8-bit lanes let expect."""
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256))


def block_pairs(members: DataFrame, key: str, item: str, n: str, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of items of equal ``key`` as ``a < b`` (and the carried columns as ``x_a, x_b``).

    ``n`` is the key's count. A key is cut into blocks by hash and joined block by block, so no
    task holds more than about ``block`` squared pairs of one key.
    """
    m = members.select(F.col(key).alias("k"), F.col(item).alias("i"), F.ceil(F.col(n) / block).cast("int").alias("nb"), *carry)
    m = m.withColumn("blk", F.pmod(F.xxhash64("i"), "nb").cast("int"))
    left = m.select("k", F.col("blk").alias("p"), F.explode(F.expr("sequence(blk, nb - 1)")).alias("q"), F.col("i").alias("ia"), *[F.col(x).alias(f"{x}_a") for x in carry])
    right = m.select("k", F.explode(F.expr("sequence(0, blk)")).alias("p"), F.col("blk").alias("q"), F.col("i").alias("ib"), *[F.col(x).alias(f"{x}_b") for x in carry])
    both = left.join(right, ["k", "p", "q"]).where("ia <> ib and (p <> q or ia < ib)")
    flip = F.col("ia") > F.col("ib")
    cols = [F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")]
    for x in carry:
        cols += [F.when(flip, F.col(f"{x}_b")).otherwise(F.col(f"{x}_a")).alias(f"{x}_a"), F.when(flip, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")).alias(f"{x}_b")]
    return both.select(*cols)


def block_pairs_across(members: DataFrame, key: str, item: str, part: str, block: int = BLOCK) -> DataFrame:
    """All pairs ``a < b`` of items of equal ``key`` but different ``part``; pairs within a part are never formed.

    A part of ``block`` items or more has blocks of its own, smaller ones share blocks by hash. Blocks
    are numbered, shared ones first, and each meets only those that hold another part.
    """
    m = members.select(F.col(key).alias("k"), F.col(item).alias("i"), F.col(part).alias("r"))
    size = m.groupBy("k", "r").agg(F.count("*").alias("n")).withColumn("own", F.when(F.col("n") >= block, F.ceil(F.col("n") / block)).otherwise(0).cast("int"))
    size = stage(size, "sizes")
    total = size.groupBy("k").agg(F.ceil(F.sum(F.when(F.col("own") == 0, F.col("n")).otherwise(0)) / block).cast("int").alias("shared"), F.sum("own").cast("int").alias("pure"))
    before = F.sum("own").over(Window.partitionBy("k").orderBy("r")) - F.col("own")  # a row per part, not per item
    base = size.join(total, "k").select("k", "r", "own", (F.col("shared") + before).cast("int").alias("base"), "shared", (F.col("shared") + F.col("pure")).alias("nb"))
    h = F.xxhash64("i")
    m = m.join(base, ["k", "r"]).withColumn("blk", F.when(F.col("own") > 0, F.col("base") + F.pmod(h, "own")).otherwise(F.pmod(h, "shared")).cast("int"))
    first = F.expr("if(own > 0, base + own, blk)")
    last = F.expr("if(own > 0, base - 1, blk)")
    left = m.where(first < F.col("nb")).select("k", F.col("r").alias("ra"), F.col("i").alias("ia"), F.col("blk").alias("p"), F.explode(F.sequence(first, F.col("nb") - 1)).alias("q"))
    right = m.where(last >= 0).select("k", F.col("r").alias("rb"), F.col("i").alias("ib"), F.explode(F.sequence(F.lit(0), last)).alias("p"), F.col("blk").alias("q"))
    both = left.join(right, ["k", "p", "q"]).where("ra <> rb and (p <> q or ia < ib)")
    return both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of the undirected edges ``a, b``; the root is the least node.

    Alternates large-star (hand every larger neighbour to the least of the neighbourhood) and
    small-star (hand every smaller neighbour to the least) until the edges are stars.
    Each round is a pre-aggregated minimum and a join, never a gathered neighbourhood, and is
    written to the shared folder.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def settled(x: DataFrame) -> bool:
        """Whether every node either hangs on one node, or is one on which others hang."""
        ends = x.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("s"))
        return ends.groupBy("s.n").agg(F.sum("s.up").alias("ups"), F.min("s.up").alias("low")).where("ups > 1 or (ups = 1 and low = 0)").isEmpty()

    for _ in range(most_rounds):
        if settled(e):
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        small = j.select(F.col("u"), F.col("m").alias("v")).union(j.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        was, e = e, stage(small, "small")
        discard(was)
    else:
        if not settled(e):
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def groups(df: DataFrame, doc: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, min_shingles: int = 1, seed: int = 11, links: bool = False) -> DataFrame:
    """``doc_id, group_id, n_shingles``: the group of every record; its id is the least record id in it.

    Two records are linked if their distinct word ``n``-grams in common are at least
    ``threshold`` of all theirs together; a group is what links join, directly or over others.
    Records with fewer than ``min_shingles`` distinct n-grams (empty and null texts among them)
    form groups of their own. Null ids are left out. A record id that comes with several texts
    gets a row for each. Records are copies if the 64-bit hashes of their sets are equal. Extra
    columns aren't read. With ``links`` each record also has its most similar partner among the
    verified links (of a copy: its representative) and their exact similarity, as
    ``linked_to, similarity``; null where it stands alone.
    """
    rows, bands = banding(threshold)
    src = df.select(F.col(doc).cast("bigint").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null")
    docs = stage(src.mapInArrow(_signer(n, max(1, min_shingles), rows, bands, seed), "d bigint, fp bigint, k int, sig binary, bands array<bigint>"), "docs")
    # one record stands for all copies; those that several tasks have signed are told apart here
    signed = docs.where("sig is not null")
    twice = stage(signed.groupBy("fp").agg(F.count("*").alias("c"), F.min("d").alias("one")).where("c > 1"), "twice")
    many = twice.limit(BROADCAST_BUCKETS + 1).count()
    sigs = signed.join(F.broadcast(twice) if many <= BROADCAST_BUCKETS else twice, "fp", "left").where("one is null or d = one").select("fp", "d", "sig", "bands") if many else signed
    reps = sigs.select("fp", "d")

    slack = 4 * math.sqrt(threshold * (1 - threshold) / (rows * bands)) + 0.01

    def verified(cand: DataFrame) -> DataFrame:
        s = sigs.select("fp", "sig")
        near = cand.join(s.select(F.col("fp").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("fp").alias("b"), F.col("sig").alias("sb")), "b")
        near = stage(near.where(_agreement("sa", "sb") >= threshold - slack).select("a", "b").where("a <> b"), "near")
        if near.isEmpty():
            return near.withColumn("sim", F.lit(0.0))
        nodes = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(reps, "fp")
        again = src.join(nodes, "d").select("fp", "t").mapInArrow(_setter(n), "fp bigint, sh binary")
        again = stage(again.dropDuplicates(["fp"]), "sets")
        full = near.join(again.select(F.col("fp").alias("a"), F.col("sh").alias("x")), "a").join(again.select(F.col("fp").alias("b"), F.col("sh").alias("y")), "b")
        out = stage(full.select("a", "b", "x", "y").mapInArrow(_exact(threshold), "a bigint, b bigint, sim double"), "links")
        discard(near), discard(again)
        return out

    spread = sigs.select("fp", F.explode("bands").alias("bk"))
    buckets = stage(spread.groupBy("bk").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("cn")).where("a <> b"), "buckets")
    # buckets of two are a pair already; only the members of larger ones are looked up again
    large = buckets.where("cn > 2").select("bk", "a")
    larger = large.count()
    large = F.broadcast(large) if larger <= BROADCAST_BUCKETS else large
    members = stage(spread.join(large, "bk").select("bk", "a", F.col("fp").alias("b")), "members")
    first = verified(buckets.where("cn = 2").select("a", "b").union(members.where("a <> b").select("a", "b")).distinct())
    comp = stage(components(first), "comp")

    # of large buckets only those whose members are in different components go on
    known = stage(members.select("bk", F.col("b").alias("fp")).join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left").select("bk", "fp", F.coalesce("root", "fp").alias("root")), "known")
    split = known.groupBy("bk").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bk")
    rest = block_pairs_across(known.join(split, "bk"), "bk", "fp", "root").distinct()
    second = verified(rest.join(first, ["a", "b"], "left_anti"))
    found = comp
    if not second.isEmpty():
        c = comp.select("node", "root")
        over = second.join(c.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(c.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        over = over.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        top = components(over).select(F.col("node").alias("root"), F.col("root").alias("top"))
        lone = top.join(comp.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), "top")
        found = stage(comp.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(lone.select("node", F.col("top").alias("root"))), "found")

    placed = docs.select("d", "fp", "k").join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("d", "fp", "k", F.coalesce("root", "fp").alias("root"))
    least = placed.where("root is not null").groupBy("root").agg(F.min("d").alias("g"))
    out = placed.join(least, "root", "left").select(F.col("d").alias("doc_id"), F.coalesce("g", "d").alias("group_id"), F.col("k").alias("n_shingles"), "fp")
    if not links:
        return out.drop("fp")
    both = first.union(second)
    both = both.union(both.select("b", "a", "sim")).groupBy(F.col("a").alias("fp")).agg(F.max(F.struct("sim", F.negate("b").alias("b"))).alias("s")).select("fp", "s.sim", (-F.col("s.b")).alias("other"))
    both = both.join(reps.select(F.col("fp").alias("other"), F.col("d").alias("partner")), "other").select("fp", "sim", "partner")
    out = out.join(both, "fp", "left").join(reps.select("fp", F.col("d").alias("rep")), "fp", "left")
    copy = F.col("rep") != F.col("doc_id")
    return out.select("doc_id", "group_id", "n_shingles", F.when(copy, F.col("rep")).otherwise(F.col("partner")).alias("linked_to"), F.when(copy, F.lit(1.0)).otherwise(F.col("sim")).alias("similarity"))


def group_pairs(grouped: DataFrame) -> DataFrame:
    """``doc_id_a < doc_id_b``: all pairs of different records in one group."""
    g = stage(grouped.select("doc_id", "group_id").distinct(), "grouped")
    many = g.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    pairs = block_pairs(g.join(many, "group_id"), "group_id", "doc_id", "n")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")).distinct()
