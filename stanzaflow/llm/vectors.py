"""The k most similar vectors of every vector, by vantage-point trees per shard.

A vantage-point tree fitted on a bounded sample routes every vector to a shard; a shard of
more than a block is routed further by a tree fitted on a sample of its own, level by level,
so shards stay of block size however many vectors there are. Each block gets a vantage-point
tree of all its vectors. Vectors first ask their own block; then, with the radius found there,
they go down the routers to the blocks that the triangle inequality cannot rule out, where
queries and block meet in one group, so a block travels once per pack of queries. A branch is
left out if its gap exceeds ``relax`` times the radius; at 1 the search is exact, below it is
faster. Cosine order equals Euclidean order on unit vectors, so distances are taken there.
Between tasks vectors are bytes of doubles: cheap to move and to read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.shared import discard, stage

SAMPLE = 4096
SHARD_ROWS = 4096
#: Queries of one pack, and copies of one vector, that a task holds at most (about).
PACK_ROWS = 16_384
#: A router has at most so many shards; the number of a shard's child is ``FAN`` times its own plus 1 and more.
FAN = 128
#: Routers below one another at most: 128 to the power of 6 shards. Shards that still exceed a block (equal distances) are cut by hash.
LEVELS = 6
LEAF = 64
EPS = 1e-7
#: So many copied vectors (40 bytes each) are sent to every executor at most; more are joined by shuffle.
BROADCAST_COPIES = 500_000


def build_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple]]:
    """(order, nodes) of a vantage-point tree over unit vectors.

    A node covers a range of ``order``: (lo, hi, inner, outer, d_max, d_min); its vantage point is
    at ``lo``; children are node numbers, -1 for none. Leaves have no children.
    """
    order, nodes = np.arange(len(points)), []

    def grow(lo: int, hi: int) -> int:
        me = len(nodes)
        nodes.append((lo, hi, -1, -1, 0.0, 0.0))
        if hi - lo <= leaf:
            return me
        p = points[order[lo:hi]]
        tries = p[np.linspace(0, len(p) - 1, 5).astype(int)]
        spread = (tries @ p.T).std(axis=1)
        v = int(np.linspace(0, len(p) - 1, 5).astype(int)[spread.argmax()])
        order[lo], order[lo + v] = order[lo + v], order[lo]
        rest = order[lo + 1 : hi]
        d = np.sqrt(np.maximum(0, 2 - 2 * (points[rest] @ points[order[lo]])))
        by = np.argsort(d, kind="stable")
        order[lo + 1 : hi], d = rest[by], d[by]
        mid = len(d) // 2
        inner, outer = grow(lo + 1, lo + 1 + mid), grow(lo + 1 + mid, hi)
        nodes[me] = (lo, hi, inner, outer, float(d[mid - 1]), float(d[mid]))
        return me

    if len(points):
        grow(0, len(points))
    return order, nodes


def search_tree(points: np.ndarray, ids: np.ndarray, nodes: list[tuple], q: np.ndarray, qid: np.ndarray, radius: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, ids) of the k best of every query, -inf where there are fewer; ties go to the smaller id."""
    n = len(q)
    best, who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    tau = radius.astype(float).copy()

    def offer(act: np.ndarray, sims: np.ndarray, cand: np.ndarray) -> None:
        sims = np.where(cand[None, :] == qid[act][:, None], -np.inf, sims)
        floor = np.maximum(best[act, -1], 1 - tau[act] ** 2 / 2 - EPS)
        hit = sims.max(axis=1) >= floor
        if not hit.any():
            return
        act, sims = act[hit], sims[hit]
        s = np.concatenate([best[act], sims], axis=1)
        w = np.concatenate([who[act], np.broadcast_to(cand, sims.shape)], axis=1)
        o = np.lexsort((w, -s), axis=1)[:, :k]
        best[act], who[act] = np.take_along_axis(s, o, 1), np.take_along_axis(w, o, 1)
        with np.errstate(invalid="ignore"):
            kth = np.sqrt(np.maximum(0, 2 - 2 * best[act, -1]))
        tau[act] = np.minimum(tau[act], kth)

    stack = [(0, np.arange(n), np.zeros(n))] if nodes else []
    while stack:
        at, act, gap = stack.pop()
        keep = gap <= relax * tau[act] + EPS
        act = act[keep]
        if not len(act):
            continue
        lo, hi, inner, outer, d_max, d_min = nodes[at]
        if inner < 0:
            offer(act, q[act] @ points[lo:hi].T, ids[lo:hi])
            continue
        sims = q[act] @ points[lo]
        offer(act, sims[:, None], ids[lo : lo + 1])
        d = np.sqrt(np.maximum(0, 2 - 2 * sims))
        ways = [(outer, np.maximum(0, d_min - d)), (inner, np.maximum(0, d - d_max))]
        ways.sort(key=lambda x: -x[1].sum())
        stack += [(w, act, g) for w, g in ways]
    return best, who


class Router:
    """Assigns vectors to shards and names the shards a query ball may reach."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.shards, self.split = 1, []
        if shards > 1 and len(sample) >= 4 * shards:
            order, nodes = build_tree(sample, max(2, math.ceil(len(sample) / shards)))
            leaf_no: dict[int, int] = {}
            for i, x in enumerate(nodes):
                if x[2] < 0:
                    leaf_no[i] = len(leaf_no)
            self.shards = len(leaf_no)
            # (vantage vector, cut, inner, outer); a child below 0 is shard -child-1
            kid = lambda i: -leaf_no[i] - 1 if i in leaf_no else i
            self.split = {i: (sample[order[x[0]]], (x[4] + x[5]) / 2, kid(x[2]), kid(x[3])) for i, x in enumerate(nodes) if x[2] >= 0}

    def dump(self) -> bytes:
        return pickle.dumps((self.shards, self.split))

    @classmethod
    def load(cls, raw: bytes) -> Router:
        out = cls(np.empty((0, 1)), 1)
        out.shards, out.split = pickle.loads(raw)
        return out

    def home(self, u: np.ndarray) -> np.ndarray:
        out = np.zeros(len(u), np.int32)
        stack = [(0, np.arange(len(u)))] if self.split else []
        while stack:
            at, act = stack.pop()
            if at < 0:
                out[act] = -at - 1
            elif len(act):
                v, cut, inner, outer = self.split[at]
                near = np.sqrt(np.maximum(0, 2 - 2 * (u[act] @ v))) <= cut
                stack += [(inner, act[near]), (outer, act[~near])]
        return out

    def reach(self, u: np.ndarray, radius: np.ndarray, relax: float) -> list[tuple[int, np.ndarray]]:
        """(shard, query positions) for all shards within reach."""
        if not self.split:
            return [(0, np.arange(len(u)))]
        out, stack = [], [(0, np.arange(len(u)))]
        while stack:
            at, act = stack.pop()
            if at < 0:
                out.append((-at - 1, act))
            elif len(act):
                v, cut, inner, outer = self.split[at]
                d = np.sqrt(np.maximum(0, 2 - 2 * (u[act] @ v)))
                r = relax * radius[act] + EPS
                stack += [(inner, act[d - cut <= r]), (outer, act[cut - d <= r])]
        return out


def _column(t: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = t.column(name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
        if isinstance(c, pa.ChunkedArray):
            c = c.chunk(0)
    return c


def _numbers(t: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return _column(t, name).to_numpy(zero_copy_only=False)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors of ``dim`` doubles from their bytes."""
    if not len(col):
        return np.empty((0, dim))
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.array(np.frombuffer(data, np.uint8)[off[0] : off[-1]]).view(np.float64).reshape(-1, dim)


def _bytes(u: np.ndarray) -> pa.Array:
    n, dim = u.shape
    off = np.arange(0, n * dim * 8 + 1, dim * 8, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(u, np.float64))])


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.diff(b.column(1).offsets.to_numpy())
        flat, start = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float), np.append(0, np.cumsum(sizes)[:-1])
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == dim)
            x = flat[start[rows][:, None] + np.arange(dim)]
            with np.errstate(invalid="ignore", over="ignore"):
                x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
                norm = np.sqrt((x * x).sum(axis=1))
                ok = np.isfinite(norm) & (norm > 0)
            # adding 0 turns -0 into 0, so equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[ok]], pa.int64()), _bytes(x[ok] / norm[ok, None] + 0.0), pa.array(np.full(ok.sum(), dim, np.int32)), b.column(2).take(pa.array(rows[ok]))], names=["id", "u", "n", "more"])


def unit_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``id, u, n``: one unit vector (bytes) per id and its length, invalid ones left out (null, empty, with null, NaN or infinity, all zero)."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null and v is not null")
    # only ids that come again are gathered; vectors of the others don't move
    again = stage(rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "again")
    units = rows.join(_sent(again, again.limit(BROADCAST_COPIES + 1).count()).withColumn("more", F.lit(True)), "id", "left").select("id", "v", F.col("more").isNotNull().alias("more"))
    units = units.mapInArrow(_normalise, "id bigint, u binary, n int, more boolean")
    some = units.where("more").groupBy("id").agg(F.min(F.struct("u", "n")).alias("s")).select("id", "s.*")
    return units.where("not more").drop("more").union(some)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most ``BROADCAST_COPIES`` rows."""
    return F.broadcast(df) if rows <= BROADCAST_COPIES else df


def _cogrouped(rows: DataFrame, side: DataFrame, run, schema: str) -> DataFrame:
    """``run(packs of rows, side)`` per node and sub; a node of many rows is cut into packs that all meet its side."""
    per = rows.groupBy("node", "sub").agg(F.ceil(F.count("*") / PACK_ROWS).cast("int").alias("packs"))
    q = rows.join(per, ["node", "sub"]).withColumn("p", F.pmod(F.xxhash64("id"), "packs").cast("int")).drop("packs")
    s = side.join(per, ["node", "sub"]).withColumn("p", F.explode(F.expr("sequence(0, packs - 1)"))).drop("packs")
    return q.groupBy("node", "sub", "p").cogroup(s.groupBy("node", "sub", "p")).applyInArrow(run, schema)


def nearest(df: DataFrame, key: str = "doc_id", vec: str = "features", k: int = 5, min_similarity: float | None = None, relax: float = 1.0, queries: str | None = None, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``id, neighbour, similarity, rank``: the k most similar other records by cosine.

    Each id counts once; of rows that differ the vector of the least bytes stays. Vectors that are
    null, empty, all zero or hold a null, NaN or infinity are left out. Vectors of different lengths
    aren't compared: each length is searched for itself. Only neighbours of ``min_similarity`` or more
    come out where it is set. ``relax`` scales the pruning radius (1: exact). ``queries`` is an SQL
    condition on ``id``; without it every record asks. Ties go to the smaller id. Records with an
    equal vector are one point of the trees and come back with their k + 1 least ids. Routers are
    fitted on at most ``sample`` vectors each; every vector is indexed. Extra columns aren't read.
    """
    pts = unit_vectors(df, key, vec).withColumn("asks", F.expr(queries) if queries else F.lit(True))
    pts = stage(pts.select("*", F.xxhash64("u").alias("vh"), F.xxhash64(F.lit(1), "u").alias("vg")), "pts")
    lengths = sorted((r["n"], r["count"]) for r in pts.groupBy("n").count().collect())
    parts = [_nearest(pts.where(F.col("n") == n), c, n, k, min_similarity, relax, sample, shard_rows) for n, c in lengths if c > 1]
    if not parts:
        return df.sparkSession.createDataFrame([], "id bigint, neighbour bigint, similarity double, rank int")
    return reduce(DataFrame.union, parts)


def _nearest(pts: DataFrame, rows: int, dim: int, k: int, min_similarity: float | None, relax: float, sample: int, shard_rows: int) -> DataFrame:
    """The search among ``rows`` vectors of one length: ``id, u, asks, vh, vg``."""
    copied = stage(pts.groupBy("vh", "vg").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("asks").alias("any")).where("copies > 1"), "copied")
    copies, members = copied.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    total = rows - members + copies
    reps = pts.select("id", "u", "asks")
    if copies:
        reps = pts.join(_sent(copied, copies), ["vh", "vg"], "left").where("rep is null or id = rep").select("id", "u", F.coalesce("any", "asks").alias("asks"))
    reach0 = math.sqrt(max(0.0, 2 - 2 * min_similarity)) if min_similarity is not None else 2.0

    shards = min(total // shard_rows, FAN, sample // 32)
    seen = reps.select("u", F.xxhash64("id", F.lit(3)).alias("h")).orderBy("h").limit(sample).collect() if shards > 1 else []
    router = Router(np.frombuffer(b"".join(r["u"] for r in seen)).reshape(-1, dim), shards)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(router.home(_matrix(b.column(1), dim)) + np.int64(1))], names=["id", "u", "asks", "node"])

    def fit(t: pa.Table) -> pa.Table:
        x, node = _matrix(_column(t, "u"), dim), t.column("node")[0].as_py()
        shards = max(2, min(FAN, t.column("c")[0].as_py() // shard_rows, len(x) // 32))
        return pa.table({"node": [node], "sub": pa.array([0], pa.int32()), "router": [Router(x[np.argsort(_numbers(t, "h"))][:sample], shards).dump()]})

    def home_below(left: pa.Table, right: pa.Table) -> pa.Table:
        below = Router.load(right.column("router")[0].as_py())
        node = left.column("node")[0].as_py() * FAN + 1 + below.home(_matrix(_column(left, "u"), dim)).astype(np.int64)
        return pa.table({"id": left.column("id"), "u": left.column("u"), "asks": left.column("asks"), "node": node})

    kinds = "id bigint, u binary, asks boolean, node bigint"
    levels: list[DataFrame] = []  # routers of the shards that exceed a block, level by level
    subs = None
    if router.shards == 1 and total <= 2 * shard_rows:
        homes = reps.withColumn("node", F.lit(1).cast("bigint"))
    else:
        homes = stage(reps.mapInArrow(home, kinds), "homes")
        while True:
            counts = stage(homes.groupBy("node").agg(F.count("*").alias("c")), "counts")
            large = counts.where(F.col("c") > 2 * shard_rows)
            if large.isEmpty() or len(levels) >= LEVELS:
                break
            some = homes.join(large, "node").withColumn("h", F.xxhash64("id", F.lit(len(levels)))).where(F.pmod("h", F.lit(1 << 20)) < (0.75 * sample * (1 << 20)) / F.col("c"))
            below = stage(some.select("node", "u", "c", "h").groupBy("node").applyInArrow(fit, "node bigint, sub int, router binary"), "routers")
            levels.append(below)
            known = below.select("node")
            deeper = _cogrouped(homes.join(known, "node", "left_semi").withColumn("sub", F.lit(0)), below, home_below, kinds)
            was, homes = homes, stage(homes.join(known, "node", "left_anti").select("id", "u", "asks", "node").union(deeper), "homes")
            discard(was), discard(counts)
        if not large.isEmpty():
            # shards that could not be cut by distance are cut by hash; nearly always there are none
            subs = counts.select("node", F.ceil(F.col("c") / (2 * shard_rows)).cast("int").alias("subs"))
            homes = homes.join(subs, "node").withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int"))
    homes = homes.select("id", "u", "asks", "node", F.lit(0).alias("sub") if subs is None else "sub")

    def found(qid: np.ndarray, best: np.ndarray, who: np.ndarray) -> dict:
        r, c = np.nonzero(np.isfinite(best))
        return {"id": pa.array(qid[r], pa.int64()), "nb": pa.array(who[r, c], pa.int64()), "sim": pa.array(best[r, c], pa.float64())}

    def own(t: pa.Table) -> pa.Table:
        """Neighbours within the block, and for every query its vector and the radius so far."""
        x, ids = _matrix(_column(t, "u"), dim), _numbers(t, "id").astype(np.int64)
        order, nodes = build_tree(x, LEAF)
        ask = np.flatnonzero(_numbers(t, "asks"))
        best, who = search_tree(x[order], ids[order], nodes, x[ask], ids[ask], np.full(len(ask), reach0), k, relax)
        hits = pa.table(found(ids[ask], best, who))
        n, m = len(hits), len(ask)
        hits = hits.append_column("u", pa.nulls(n, pa.binary())).append_column("radius", pa.nulls(n, pa.float64())).append_column("node", pa.nulls(n, pa.int64())).append_column("sub", pa.nulls(n, pa.int32()))
        with np.errstate(invalid="ignore"):
            radius = np.minimum(reach0, np.where(np.isfinite(best[:, -1]), np.sqrt(np.maximum(0, 2 - 2 * best[:, -1])), reach0))
        asked = t.take(pa.array(ask))
        rest = {"id": asked.column("id"), "nb": pa.nulls(m, pa.int64()), "sim": pa.nulls(m, pa.float64()), "u": asked.column("u"), "radius": pa.array(radius, pa.float64()), "node": asked.column("node"), "sub": asked.column("sub")}
        return pa.concat_tables([hits, pa.table(rest)])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, r = _matrix(b.column(1), dim), b.column(2).to_numpy(zero_copy_only=False)
            for s, act in router.reach(u, r, relax):
                if len(act):
                    x = b.take(pa.array(act))
                    yield pa.RecordBatch.from_arrays([*x.columns[:5], pa.array(np.full(len(act), s + 1, np.int64))], names=["id", "u", "radius", "home", "home_sub", "node"])

    def reach_below(left: pa.Table, right: pa.Table) -> pa.Table:
        below, node = Router.load(right.column("router")[0].as_py()), left.column("node")[0].as_py()
        left = left.select(["id", "u", "radius", "home", "home_sub"])
        parts = below.reach(_matrix(_column(left, "u"), dim), _numbers(left, "radius"), relax)
        return pa.concat_tables([left.take(pa.array(act)).append_column("node", pa.array(np.full(len(act), node * FAN + 1 + s, np.int64))) for s, act in parts])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ids, qid = _matrix(_column(right, "u"), dim), _numbers(right, "id").astype(np.int64), _numbers(left, "id").astype(np.int64)
        order, nodes = build_tree(x, LEAF)
        best, who = search_tree(x[order], ids[order], nodes, _matrix(_column(left, "u"), dim), qid, _numbers(left, "radius"), k, relax)
        return pa.table(found(qid, best, who))

    def top(x: DataFrame, n: int = k) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.desc("sim"), "nb")
        return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    first = stage(homes.groupBy("node", "sub").applyInArrow(own, "id bigint, nb bigint, sim double, u binary, radius double, node bigint, sub int"), "first")
    out = first.where("nb is not null").select("id", "nb", "sim")
    if router.shards > 1 or subs is not None:
        kinds = "id bigint, u binary, radius double, home bigint, home_sub int, node bigint"
        far = first.where("nb is null").select("id", "u", "radius", F.col("node").alias("home"), F.col("sub").alias("home_sub")).mapInArrow(reach, kinds)
        for below in levels:
            was = stage(far, "far")
            known = below.select("node")
            deeper = _cogrouped(was.join(known, "node", "left_semi").withColumn("sub", F.lit(0)), below, reach_below, kinds)
            far = was.join(known, "node", "left_anti").select("id", "u", "radius", "home", "home_sub", "node").union(deeper)
        far = far.withColumn("sub", F.lit(0)) if subs is None else far.join(subs, "node").withColumn("sub", F.explode(F.expr("sequence(0, subs - 1)")))
        far = stage(far.where("node <> home or sub <> home_sub").select("id", "u", "radius", "node", "sub"), "far")
        out = out.union(_cogrouped(far, homes.select("node", "sub", "id", "u"), search, "id bigint, nb bigint, sim double"))
    out = top(out).select("id", "nb", "sim")
    if copies:
        w = Window.partitionBy("vh", "vg").orderBy("id")
        members = pts.select("vh", "vg", "id", "asks").join(_sent(copied.select("vh", "vg", "rep", "copies"), copies), ["vh", "vg"])
        some = members.withColumn("no", F.row_number().over(w)).where(F.col("no") <= k + 1)
        some = stage(some.select("rep", F.col("id").alias("member")), "some")
        mates = copied.where("any").select(F.col("rep").alias("id"), "rep").join(some, "rep").select("id", F.col("member").alias("nb"), F.lit(1.0).alias("sim"))
        wide = out.withColumnRenamed("nb", "rep").join(some, "rep", "left").select("id", F.coalesce("member", "rep").alias("nb"), "sim").union(mates)
        wide = stage(top(wide, k + 1).select("id", "nb", "sim"), "wide")
        # copies of one vector are spread over several groups, each with the neighbours of their representative
        groups = copied.select("rep", F.ceil(F.col("copies") / PACK_ROWS).cast("int").alias("packs"))
        theirs = groups.join(wide.withColumnRenamed("id", "rep"), "rep").withColumn("p", F.explode(F.expr("sequence(0, packs - 1)"))).drop("packs")
        each = members.where("asks").select("id", "rep", F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / PACK_ROWS).cast("int")).cast("int").alias("p"))
        theirs = each.join(theirs, ["rep", "p"]).where("id <> nb").select("id", "nb", "sim")
        out = wide.join(groups.select(F.col("rep").alias("id")), "id", "left_anti").select("id", "nb", "sim").union(theirs)
    res = top(out)
    if min_similarity is not None:
        res = res.where(F.col("sim") >= min_similarity)
    return res.select("id", F.col("nb").alias("neighbour"), F.col("sim").alias("similarity"), F.col("rank").cast("int").alias("rank"))
