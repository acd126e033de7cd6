"""Joining feature sets, audio blocks and exact splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.functions.vectors import EPS, column_norm, zeros

AUDIO_STATS = ("mean", "std")


def align(sets: dict[str, DataFrame], check: bool = True, order: str | None = None) -> DataFrame:
    """``doc_id`` and ``<set>_<column>`` of all sets, in the rows of the first set.

    Of an id that comes again in another set the last row stays: by the column ``order`` where the set
    has it, else in reading order. Further ids of other sets are dropped; an id they lack raises
    ``KeyError`` if ``check`` is on. Repeated ids of the first set keep their rows.
    """
    if not sets:
        raise ValueError("no feature sets")
    named = []
    for k, (n, df) in enumerate(sets.items()):
        cols = [F.col(c).alias(f"{n}_{c}") for c in df.columns if c not in ("doc_id", order)]
        by = F.col(order) if order in df.columns else F.monotonically_increasing_id()
        named.append((n, df.select("doc_id", *cols) if k == 0 else last_rows(df.select("doc_id", *cols, by.alias("_order")), "doc_id", "_order")))
    if check:
        anchor = named[0][1].select("doc_id")
        for n, df in named[1:]:
            if not anchor.join(df.select("doc_id"), "doc_id", "left_anti").isEmpty():
                raise KeyError(f"feature set {n} lacks documents of {named[0][0]}")
    return reduce(lambda a, b: a.join(b, "doc_id", "left"), [df for _, df in named])


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``: a pre-aggregated maximum."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("s")).select(key, "s.*")


def id_map(df: DataFrame, key: str = "mxm", value: str = "msd", order: str = "line_no") -> DataFrame:
    """Two-column map; of repeated keys the last in file order wins, also if its value is null."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(value), F.col(order)).alias("s")).select(key, f"s.{value}")


def add_audio(docs: DataFrame, mapping: DataFrame, audio: DataFrame, n: int, key: str = "mxm", value: str = "msd", track: str = "tid", feature: str = "feature") -> DataFrame:
    """``doc_id`` and audio columns: mapped ids only, zeros where the track has no audio."""
    block = audio.select(F.col(track).alias("_t"), F.col(feature).cast("array<double>").alias("_f"))
    out = docs.join(mapping.select(F.col(key).alias("_k"), F.col(value).alias("_t")), docs[track] == F.col("_k")).join(block, "_t", "left")
    return out.select("doc_id", F.coalesce("_f", zeros(n)).alias("feature"))


def audio_columns(n_coef: int = 40, names: tuple[str, ...] = ("mfcc", "dmfcc", "ddmfcc"), stats: tuple[str, ...] = AUDIO_STATS) -> list[str]:
    """``mean_mfcc0 ..``: one column per statistic, kind and coefficient."""
    return [f"{s}_{k}{i}" for s in stats for k in names for i in range(n_coef)]


def spread(df: DataFrame, array: str, columns: list[str]) -> DataFrame:
    """An array column as named columns."""
    return df.select(*[c for c in df.columns if c != array], *[F.element_at(array, i + 1).alias(c) for i, c in enumerate(columns)])


def normalize_columns(df: DataFrame, key: str, vec: str, dim: int, order: float = 2, eps: float = EPS) -> DataFrame:
    """Vectors with every component over the norm of its column (order 0, any positive one, inf or -inf); one aggregate row and no long form."""
    x = lambda i: F.element_at(F.col(vec), i + 1).cast("double")
    whole = lambda c: column_norm(c, order)
    norms = df.agg(*[whole(x(i)).alias(f"n{i}") for i in range(dim)])
    norm = lambda i: F.greatest(F.col(f"n{i}"), F.lit(eps))
    return df.crossJoin(F.broadcast(norms)).select(key, F.array(*[x(i) / norm(i) for i in range(dim)]).alias("u"))  # one row


def order_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def exact_split(df: DataFrame, key: str = "doc_id", train_ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """``df`` with ``is_train``: exactly int(ratio x N) rows, by the order of a seeded hash of the id.

    Rows are counted in 65,536 hash ranges; only the range that holds the cut is ranked.
    """
    h = df.withColumn("_h", order_hash(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 4))
    counts = sorted((r["_b"], r["count"]) for r in h.groupBy("_b").count().collect())
    want, cut, left = int(train_ratio * sum(n for _, n in counts)), "", 0
    for b, n in counts:
        if want < n:
            cut, left = b, want
            break
        want -= n
        cut, left = b + "~", 0
    w = Window.partitionBy("_b").orderBy("_h", key)
    edge = h.where(F.col("_b") == cut).withColumn("is_train", F.row_number().over(w) <= left)
    rest = h.where(F.col("_b") != cut).withColumn("is_train", F.col("_b") < cut)
    return rest.unionByName(edge).drop("_h", "_b")


def row_ranges(counts: DataFrame, key: str, n: str, per_block: int = 65_536) -> DataFrame:
    """``key, start, end``: ranges of ``n`` positions each, in the order of the integer ``key``.

    A running sum in two steps: over blocks of keys, then within each block.
    """
    c = counts.select(F.col(key), F.col(n).alias("_n"), F.floor(F.col(key) / per_block).alias("_b"))
    sums = c.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))  # a row per block
    inner = F.sum("_n").over(Window.partitionBy("_b").orderBy(key))
    out = c.join(before, "_b").withColumn("end", F.col("_before") + inner)
    return out.select(key, (F.col("end") - F.col("_n")).alias("start"), "end")


def csr_to_long(data: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """``row_id, col_id, value`` from a sparse matrix in row form.

    ``data``: ``pos, index, value`` of the stored entries; ``rows``: ``row_no, row_id, start, end``;
    ``cols``: ``col_no, col_id``. Entries are numbered, so rows take theirs by a join on fixed blocks of positions.
    """
    size = 1024
    d = data.withColumn("blk", F.floor(F.col("pos") / size))
    r = rows.where("end > start").withColumn("blk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    got = d.join(r, "blk").where("pos >= start and pos < end")
    return got.join(cols, got["index"] == cols["col_no"]).select("row_id", "col_id", "value")


def long_to_csr(cells: DataFrame) -> DataFrame:
    """``row_id, cols, vals``: a row of the matrix per line, columns in order; a hot row is as long as its distinct columns."""
    s = F.sort_array(F.collect_list(F.struct("col_id", "value")))
    return cells.groupBy("row_id").agg(s.alias("s")).select("row_id", F.col("s.col_id").alias("cols"), F.col("s.value").alias("vals"))


def matrix_cells(events: DataFrame, row: str = "row_id", col: str = "col_id", value: str = "value") -> DataFrame:
    """``row_id, col_id, value`` summed from events; null values and ids don't count, repeated rows count once."""
    e = events.where(F.col(value).isNotNull() & F.col(row).isNotNull() & F.col(col).isNotNull()).distinct()
    return e.groupBy(F.col(row).alias("row_id"), F.col(col).alias("col_id")).agg(F.sum(F.col(value).cast("bigint")).alias("value"))
