"""Mixing sources to target weights with Pfair scheduling.

Time is counted in slots, each filled with one block of ``block_tokens`` tokens of one
source. Block j of a source of weight w is released at slot floor(j/w) and due before slot
ceil((j+1)/w); among released blocks the earliest deadline goes first. Weights are exact
fractions, so every positive share has blocks, however small it is. Documents are laid into
their source's blocks by distributed running sums; a document may take several blocks, or
end in the middle of one, and the stream then goes on with it where its source's next
block is due. At every slot up to the demand a source that isn't short deviates by less
than one block from its line, whatever the lengths of the documents.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.functions.text import count_tokens, norm_source
from stanzaflow.shared import discard, stage

BLOCK_TOKENS = 4096
BUCKET_ROWS = 20_000
#: Slots that are scheduled one by one on the driver; a longer stream repeats a frame of so many.
MOST_SLOTS = 400_000
#: Sources are a configuration, not data: more than this many are refused.
MOST_SOURCES = 10_000


def quotas(weights: dict[str, Fraction], frame: int) -> dict[str, int]:
    """Blocks of each source in a frame: largest remainders, ties by name; sums to ``frame``, at least 1 for a positive weight."""
    exact = {s: w * frame for s, w in weights.items()}
    out = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: frame - sum(out.values())]:
        out[s] += 1
    for s in sorted(exact):
        if exact[s] > 0 and not out[s]:
            out[s] = 1
            out[max(sorted(out), key=out.get)] -= 1
    return out


def pfair(weights: dict[str, Fraction], blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of all ``blocks``: earliest deadline first among released blocks.

    Deadline ties go to the block whose window overlaps its successor's, then by name. Slots for
    which nothing is released, as a source has run out of blocks, stay empty.
    """
    waiting: list[tuple] = [(0, s, 0) for s in sorted(blocks) if blocks[s] and weights[s]]
    ready: list[tuple] = []
    out, t = [], 0
    while waiting or ready:
        if not ready and waiting[0][0] > t:
            t = waiting[0][0]
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            n, d = weights[s].numerator, weights[s].denominator
            heapq.heappush(ready, (-(-(j + 1) * d // n), (j + 1) * d % n == 0, s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append((s, j, t))
        t += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * weights[s].denominator // weights[s].numerator, s, j + 1))
    return out


def _schedule(weights: dict[str, Fraction], blocks: dict[str, int], most: int) -> tuple[list[tuple[str, int, int]], dict[str, int], int]:
    """(pattern, blocks of each source in it, slots it takes): the whole stream, or a frame that repeats."""
    if sum(blocks.values()) <= most:
        return pfair(weights, blocks), blocks, 0
    quota = quotas(weights, most)
    return pfair({s: Fraction(q, most) for s, q in quota.items()}, quota), quota, most


def mix(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = BLOCK_TOKENS, size=None, seed: int = 7, most_slots: int = MOST_SLOTS) -> tuple[DataFrame, DataFrame]:
    """Schedule documents; gives (uses, report).

    ``uses``: ``source, doc_id, pass, slot, offset, doc_offset, n_tokens``, one row per use of a
    document and slot that holds a part of it: ``n_tokens`` tokens of the document from
    ``doc_offset`` on stand in the slot from ``offset`` on. Reading by (slot, offset) gives the
    mixed stream. ``report``: per target source its tokens, demand, what was placed and the share
    reached.

    The total is the tokens of all documents whose source is a target, a source's demand its share
    of it (shares that don't add up to 1 are scaled). Its documents are placed until the demand is
    met, the last one wholly, so it is exceeded by less than a document; that excess follows behind
    the stream. A source with too few tokens is gone through at most ``max_repeats`` times; then
    its slots stay empty and it is reported as short. A stream of more than ``most_slots`` blocks
    repeats a frame of that length, whose weights are multiples of one slot (one at least); the
    amounts placed stay exact. Null or negative shares count as 0, null repeats as 1; targets that
    are named alike after normalising are summed. Documents without text, with an unknown or null
    source or a null id take no part. Documents are ordered by a seeded hash of id and pass, so ties
    and repeated rows come in a fixed order. ``size`` is the token count of the text (default: runs
    of word characters and of other signs). Extra columns aren't read.
    """
    spark = docs.sparkSession
    t = targets.select(F.col("source").alias("name"), norm_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).cast("bigint").alias("max_repeats"))
    t = t.where("source is not null")
    rows = t.groupBy("source").agg(F.min("name").alias("name"), F.sum("share").alias("share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    wanted = [r["source"] for r in rows]
    tokens = size(F.col(text)) if size else count_tokens(F.col(text))
    sized = docs.select(F.col(doc).cast("bigint").alias("doc_id"), norm_source(F.col(source)).alias("source"), tokens.cast("bigint").alias("n_tokens"))
    sized = stage(sized.where(F.col("source").isin(wanted) & F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0)), "sized")

    have = {r["source"]: (r["n"], r["tokens"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    total = sum(x for _, x in have.values())
    shares = math.fsum(r["share"] for r in rows)
    scale = 1.0 if abs(shares - 1) < 1e-6 or not shares else 1 / shares
    conf = []
    for r in rows:
        n, own = have.get(r["source"], (0, 0))
        due = float(r["share"]) * scale * total
        # passes over the source that meet its demand, at most max_repeats
        conf.append((r["source"], r["name"], float(r["share"]), r["max_repeats"], n, own, due, max(0, min(r["max_repeats"], math.ceil(due / own))) if own else 0))
    config = spark.createDataFrame(conf, "source string, name string, share double, max_repeats bigint, n_docs bigint, tokens bigint, due_tokens double, need bigint")

    use = sized.join(F.broadcast(config.select("source", "due_tokens", "need")), "source").where("need > 0")
    buckets = max(16, -(-max([n for n, _ in have.values()], default=0) // BUCKET_ROWS))
    use = use.withColumn("pass", F.explode(F.expr("sequence(0L, need - 1)"))).drop("need")
    use = use.withColumn("h", F.md5(F.concat_ws("|", "doc_id", "pass", F.lit(str(seed)))))
    use = use.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 7), 16, 10).cast("bigint") * buckets, 28))
    # running sum in two steps: over the few buckets of a pass, then within each bucket
    sums = use.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = sums.select("source", "pass", "bucket", (F.sum("bucket_tokens").over(Window.partitionBy("source").orderBy("pass", "bucket")) - F.col("bucket_tokens")).alias("before"))
    inner = Window.partitionBy("source", "pass", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    use = use.join(before, ["source", "pass", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    laid = stage(use.where("start < due_tokens").select("source", "doc_id", "pass", "start", "n_tokens"), "laid")
    discard(sized)

    placed = laid.groupBy("source").agg(F.sum("n_tokens").alias("placed_tokens"), F.max("pass").alias("last_pass")).collect()
    placed = {r["source"]: (r["placed_tokens"], r["last_pass"] + 1) for r in placed}
    blocks = {s: -(-n // block_tokens) for s, (n, _) in placed.items()}
    # a weight is a share of all targets, so slots of sources that are short stay empty
    exact = {r["source"]: Fraction(float(r["share"])) for r in rows}
    whole = sum(exact.values())
    weights = {s: x / whole for s, x in exact.items() if x}
    pattern, quota, frame = _schedule(weights, {s: blocks.get(s, 0) for s in weights}, most_slots)
    pattern = spark.createDataFrame(pd.DataFrame(pattern or [("", 0, 0)], columns=["source", "in_frame", "at"]), "source string, in_frame bigint, at bigint")
    quota = spark.createDataFrame([(s, max(1, q)) for s, q in quota.items()] or [("", 1)], "source string, quota bigint")

    part = laid.withColumn("block", F.explode(F.expr(f"sequence(start div {block_tokens}, (start + n_tokens - 1) div {block_tokens})")))
    begin = F.greatest(F.col("start"), F.col("block") * block_tokens)
    part = part.withColumn("from", begin).withColumn("until", F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block_tokens))
    part = part.join(F.broadcast(quota), "source").withColumn("in_frame", F.col("block") % F.col("quota")).join(F.broadcast(pattern), ["source", "in_frame"])  # at most most_slots rows
    uses = part.select(
        "source", "doc_id", "pass", (F.floor(F.col("block") / F.col("quota")) * frame + F.col("at")).alias("slot"), (F.col("from") % block_tokens).alias("offset"),
        (F.col("from") - F.col("start")).alias("doc_offset"), (F.col("until") - F.col("from")).alias("n_tokens"),
    )

    used = sum(n for n, _ in placed.values())
    out = []
    for s, name, share, most, n, own, due, _ in conf:
        got, passes = placed.get(s, (0, 0))
        out.append((s, name, share, most, n, own, total, due, blocks.get(s, 0), got, passes, got / used if used else 0.0))
    report = spark.createDataFrame(out, "source string, name string, target_share double, max_repeats bigint, n_docs bigint, tokens bigint, total_tokens bigint, due_tokens double, filled_blocks bigint, placed_tokens bigint, passes bigint, actual_share double")
    return uses, report


def short_sources(report: DataFrame) -> DataFrame:
    """Sources that the schedule could not fill: all their repeats are placed and the demand isn't met."""
    return report.where("placed_tokens < due_tokens").select(F.col("name").alias("source"))
