"""Frequency of every distinct term, from compressed bitmaps of record identifiers.

Vertical layout: per term and block of 65,536 record ids there is one container, a
sorted list of the low 16 bits (a plain bitmap above 4,096 entries), with occurrence
counters lying parallel to its set bits. Containers are built per input partition,
merged by union, and document frequency is the cardinality of the union; a record that
is seen twice sets the same bit twice and so counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzaflow.shared import stage

BLOCK_BITS = 16
ARRAY_MOST = 4096
FLUSH_TOKENS = 1_000_000
CONTAINER = "term string, block bigint, n int, occ bigint, ids binary, cnts binary"
_SCHEMA = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("occ", pa.int64()), ("ids", pa.binary()), ("cnts", pa.binary())])


def _pack_ids(low: np.ndarray) -> bytes:
    if len(low) <= ARRAY_MOST:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, dtype=bool)
    bits[low] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _unpack_ids(raw: bytes, n: int) -> np.ndarray:
    if n <= ARRAY_MOST:
        return np.frombuffer(raw, dtype="<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little"))


def _pack_counts(c: np.ndarray) -> bytes:
    top = int(c.max(initial=0))
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    return c.astype(kind).tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    change = np.zeros(len(keys[0]), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _encode(names: list, codes: np.ndarray, docs: np.ndarray, cnts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Containers of unique (code, doc) cells, sorted by both."""
    block, low = docs >> BLOCK_BITS, docs & ((1 << BLOCK_BITS) - 1)
    at = _runs(codes, block)
    ends = np.append(at[1:], len(codes))
    occ = np.add.reduceat(cnts, at) if len(at) else cnts
    for i in range(0, len(at), 20_000):
        s, e = at[i : i + 20_000], ends[i : i + 20_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[c] for c in codes[s]], pa.string()), pa.array(block[s]), pa.array((e - s).astype(np.int32)), pa.array(occ[i : i + 20_000].astype(np.int64)),
                pa.array([_pack_ids(low[a:b]) for a, b in zip(s, e)], pa.binary()), pa.array([_pack_counts(cnts[a:b]) for a, b in zip(s, e)], pa.binary()),
            ],
            schema=_SCHEMA,
        )


def _flush(terms: list[pa.Array], docs: list[np.ndarray], rows: list[np.ndarray], cnts: list[np.ndarray], universe: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    enc = pa.chunked_array(terms, pa.string()).combine_chunks().dictionary_encode() if terms else None
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    names = (enc.dictionary.to_pylist() if enc is not None else []) + [None]
    u = np.unique(np.concatenate(universe)) if universe else np.empty(0, np.int64)
    if enc is not None and len(enc):
        c, d, r, k = enc.indices.to_numpy(), np.concatenate(docs), np.concatenate(rows), np.concatenate(cnts)
        o = np.lexsort((r, d, c))
        c, d, r, k = c[o].astype(np.int64), d[o], r[o], k[o]
        at = _runs(c, d, r)  # counts within one record
        c, d, k = c[at], d[at], np.add.reduceat(k, at)
        at = _runs(c, d)  # the same record again: no further count
        c, d, k = c[at], d[at], np.maximum.reduceat(k, at)
    else:
        c = d = k = np.empty(0, np.int64)
    yield from _encode(names, np.append(c, np.full(len(u), len(names) - 1)), np.append(d, u), np.append(k, np.ones(len(u), np.int64)))


def _from_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, docs, rows, cnts, universe, held, base = [], [], [], [], [], 0, 0
    for b in batches:
        doc, toks = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        parent = toks.value_parent_indices() if hasattr(toks, "value_parent_indices") else pa.compute.list_parent_indices(toks)
        flat, parent = toks.flatten(), parent.to_numpy(zero_copy_only=False)
        if flat.null_count:
            keep = flat.is_valid()
            flat, parent = flat.filter(keep), parent[keep.to_numpy(zero_copy_only=False)]
        universe.append(doc.astype(np.int64))
        if len(flat):
            terms.append(flat.cast(pa.string()))
            docs.append(doc[parent].astype(np.int64))
            rows.append(parent.astype(np.int64) + base)
            cnts.append(np.ones(len(flat), np.int64))
        base += len(doc)
        held += len(flat)
        if held >= FLUSH_TOKENS:
            yield from _flush(terms, docs, rows, cnts, universe)
            terms, docs, rows, cnts, universe, held = [], [], [], [], [], 0
    if universe:
        yield from _flush(terms, docs, rows, cnts, universe)


def _from_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, docs, rows, cnts, universe, held, base = [], [], [], [], [], 0, 0
    for b in batches:
        doc, term, k = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        universe.append(np.unique(doc))
        keep = k > 0
        terms.append(term.filter(pa.array(keep)).cast(pa.string()))
        docs.append(doc[keep])
        rows.append(np.flatnonzero(keep) + base)
        cnts.append(k[keep].astype(np.int64))
        base += len(doc)
        held += len(doc)
        if held >= FLUSH_TOKENS:
            yield from _flush(terms, docs, rows, cnts, universe)
            terms, docs, rows, cnts, universe, held = [], [], [], [], [], 0
    if universe:
        yield from _flush(terms, docs, rows, cnts, universe)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite containers of equal (term, block); input sorted by both. The last key of a batch is carried on."""
    carry: tuple | None = None  # (term, block, low, cnt)

    def emit(names, key, low, cnt, blocks):
        o = np.lexsort((low, key))
        key, low, cnt = key[o], low[o], cnt[o]
        at = _runs(key, low)
        key, low, cnt = key[at], low[at], np.maximum.reduceat(cnt, at)
        return key, low, cnt

    for b in batches:
        if not b.num_rows:
            continue
        term, block = b.column(0).to_pylist(), b.column(1).to_pylist()
        n, ids, cnts = b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()
        low = [_unpack_ids(x, k) for x, k in zip(ids, n)]
        cnt = [_unpack_counts(x, k) for x, k in zip(cnts, n)]
        if carry:
            term.insert(0, carry[0]), block.insert(0, carry[1]), low.insert(0, carry[2]), cnt.insert(0, carry[3])
        key, keys = np.empty(len(term), np.int64), []
        for i, k in enumerate(zip(term, block)):
            if not keys or keys[-1] != k:
                keys.append(k)
            key[i] = len(keys) - 1
        k, lo, c = emit(None, np.repeat(key, [len(x) for x in low]), np.concatenate(low), np.concatenate(cnt), None)
        cut = int(np.searchsorted(k, len(keys) - 1))
        carry = (*keys[-1], lo[cut:], c[cut:])
        if cut:
            blocks = np.array([x[1] for x in keys], np.int64)
            yield from _encode([x[0] for x in keys], k[:cut], (blocks[k[:cut]] << BLOCK_BITS) | lo[:cut], c[:cut])
    if carry:
        yield from _encode([carry[0]], np.zeros(len(carry[2]), np.int64), (np.int64(carry[1]) << BLOCK_BITS) | carry[2], carry[3])


def term_bitmaps(df: DataFrame, doc: str = "doc_id", tokens: str | None = "tokens", term: str | None = None, cnt: str | None = None) -> DataFrame:
    """One container per term and id block: ``term, block, n, occ, ids, cnts``.

    Input is either token arrays (``tokens``) or cells (``term``, ``cnt``). The row with a
    null term is the bitmap of all records, those without terms included. Null records are
    left out; null terms, null arrays and cells whose count is null or below 1 add no
    occurrence. Repeated rows of a record don't add up: the larger counter stays. Extra
    columns aren't read. Each container holds at most 65,536 records, however hot its term.
    """
    if term:
        slim = df.select(F.col(doc).cast("bigint").alias("d"), F.col(term).alias("t"), F.when(F.col(term).isNull(), 0).otherwise(F.coalesce(F.col(cnt).cast("bigint"), F.lit(0))).alias("c"))
        build = _from_cells
    else:
        slim = df.select(F.col(doc).cast("bigint").alias("d"), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("t"))
        build = _from_tokens
    parts = slim.where("d is not null").mapInArrow(build, CONTAINER)
    return parts.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_union, CONTAINER)


def term_frequencies(bitmaps: DataFrame, no_below: int = 5, no_above: float = 0.3) -> DataFrame:
    """``term, df, cf, mark``: documents and occurrences of every term.

    ``mark`` is ``rare`` below ``no_below`` documents, else ``common`` above the share
    ``no_above`` of all records, else null. An empty input gives no rows.
    """
    sums = stage(bitmaps.groupBy("term").agg(F.sum("n").cast("bigint").alias("df"), F.sum("occ").cast("bigint").alias("cf")), "terms")
    everything = sums.where("term is null").first()
    total = everything["df"] if everything else 0
    mark = F.when(F.col("df") < no_below, "rare").when(F.col("df") > F.lit(no_above) * F.lit(total), "common")
    return sums.where("term is not null").select("term", "df", "cf", mark.alias("mark"))
