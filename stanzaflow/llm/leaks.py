"""Passages of evaluation items inside a corpus, by the q-gram lemma and banded alignment.

Texts are compared as their words (lower-cased, accents removed, split at all that is no
letter or digit) joined by single spaces. A passage of w characters with at most e edits
shares w + 1 - q(e + 1) q-grams with its source, on diagonals that differ by at most e; q is
chosen per item so that this is 1 at least for its shortest passage. Shared q-grams are
counted in overlapping diagonal bands; bands that reach the bound are kept, cut into regions
where q-grams are far apart, counted per passage, and verified by banded alignment. The corpus is read once, whatever the
number of items: items go in blocks of bounded size, whose indexes are broadcast and loaded
one after the other for each batch of texts.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM_CHARS = 1_000_000
SLICE_CHARS = 1_000_000
#: Shared q-grams that a task holds at a time (about).
MOST_HITS = 4_000_000
#: Blocks of items up to this many stay loaded; of more, one at a time.
KEPT_BLOCKS = 4
Q, LEAST_Q = 9, 4
BIN = 4
EDIT_COST = 4
OUT = "doc_id bigint, item_id bigint, score int, doc_start bigint, doc_end bigint, item_start int, item_end int, whole_run boolean"
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_FURTHER = re.compile("[֐-᪯]")


def plain_words(text: str | None) -> list[str]:
    """Lower-cased words without accents."""
    t = (text or "").lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
        if _FURTHER.search(t):  # scripts with marks of their own
            t = "".join(c for c in t if not unicodedata.combining(c))
    return _WORD.findall(t)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(x: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q-gram."""
    n = len(x) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n]
    return h ^ (h >> np.uint64(31))


class ItemIndex:
    """Positions of the q-grams of a block of items, in a table per q."""

    def __init__(self, items: list[tuple[int, str]], q: int, words: int, edits: int):
        self.words, self.edits = words, edits
        self.ids, self.texts, self.bound, self.q, self.e, self.windows = [], [], [], [], [], []
        parts: dict[int, list[tuple]] = {}
        for i, text in items:
            w = plain_words(text)
            k = min(words, len(w))
            s = " ".join(w)
            if k == 0 or len(s) < LEAST_Q:
                continue
            at = np.cumsum([0] + [len(x) + 1 for x in w])
            windows = np.stack([at[: len(w) - k + 1], at[k:] - 1], axis=1)
            least = int((windows[:, 1] - windows[:, 0]).min())
            e = max(0, min(edits, least // LEAST_Q - 1))
            qi = max(1, min(q, least // (e + 1)))
            h = _grams(_codes(s), qi)
            parts.setdefault(qi, []).append((h, np.full(len(h), len(self.ids), np.int32), np.arange(len(h), dtype=np.int32)))
            self.ids.append(i), self.texts.append(_codes(s)), self.windows.append(windows), self.q.append(qi), self.e.append(e)
            self.bound.append(least + 1 - qi * (e + 1))
        self.tables = {}
        for qi, rows in parts.items():
            h, owner, pos = (np.concatenate(c) for c in zip(*rows))
            o = np.argsort(h, kind="stable")
            keys, start = np.unique(h[o], return_index=True)
            sieve = np.zeros(1 << 20, bool)
            sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables[qi] = (keys, np.append(start, len(h)), owner[o], pos[o], sieve)

    def runs(self, k: int) -> set[bytes]:
        """Passages of ``words`` words of item k; none if it has fewer."""
        t, w = self.texts[k], self.windows[k]
        if len(w) == 1 and int((t == 32).sum()) + 1 < self.words:
            return set()
        return {t[a:z].tobytes() for a, z in w}

    def matches(self, x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(q, positions, key numbers) of the q-grams of a text that items have."""
        out = []
        for qi, (keys, _, _, _, sieve) in self.tables.items():
            ps, ks = [], []
            for a in range(0, len(x), SLICE_CHARS):
                h = _grams(x[a : a + SLICE_CHARS + qi - 1], qi)
                p = np.flatnonzero(sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                k = np.searchsorted(keys, h[p])
                ok = k < len(keys)
                p, k = p[ok], k[ok]
                ok = keys[k] == h[p]
                ps.append(p[ok] + a), ks.append(k[ok])
            if ps:
                out.append((qi, np.concatenate(ps), np.concatenate(ks)))
        return out

    def expand(self, got: list[tuple[int, np.ndarray, np.ndarray]], parts: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, item position) of the matches, of every ``parts``-th item only; few at a time are held beside those kept."""
        out = [(np.empty(0, np.int64),) * 3]
        for qi, p, k in got:
            _, start, owner, pos, _ = self.tables[qi]
            n = start[k + 1] - start[k]
            cut = np.flatnonzero(np.diff(np.append(-1, np.cumsum(n) // MOST_HITS)))
            for a, z in zip(cut, np.append(cut[1:], len(n))):
                m, first = n[a:z], start[k[a:z]]
                at = np.repeat(first - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())
                o = owner[at]
                keep = o % parts == part if parts > 1 else slice(None)
                out.append((np.repeat(p[a:z], m)[keep].astype(np.int64), o[keep].astype(np.int64), pos[at[keep]].astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out))


def band_distance(pairs: list[tuple[np.ndarray, np.ndarray, int]], width: int) -> np.ndarray:
    """Fewest edits that turn each item part into a piece of the text that starts within the ``width`` diagonals."""
    item, text = _stacked(pairs, width)
    longest, n = item.shape
    size = np.array([len(a) for a, _, _ in pairs])
    dist, best = np.zeros((width, n), np.int32), np.full(n, 1 << 20, np.int32)
    for i in range(longest):
        prev = dist
        dist = prev + (item[i] != text[i : i + width])
        np.minimum(dist[:-1], prev[1:] + 1, out=dist[:-1])
        for d in range(1, width):
            np.minimum(dist[d], dist[d - 1] + 1, out=dist[d])
        done = size == i + 1
        best[done] = dist[:, done].min(axis=0)
    return best


def _stacked(pairs, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Item parts and texts as columns, the text from the first diagonal on."""
    n = len(pairs)
    longest = max((len(a) for a, _, _ in pairs), default=0)
    item = np.full((longest, n), 0xFFFFFFFE, np.uint32)
    text = np.full((longest + width, n), 0xFFFFFFFF, np.uint32)
    for r, (a, t, first) in enumerate(pairs):
        item[: len(a), r] = a
        lo, hi = max(0, first), min(len(t), first + longest + width)
        if hi > lo:
            text[lo - first : hi - first, r] = t[lo:hi]
    return item, text


def band_align(pairs: list[tuple[np.ndarray, np.ndarray, int]], width: int) -> np.ndarray:
    """Best local alignment of each (item part, text, first diagonal) over ``width`` diagonals.

    Rows: score, item start, item end, text start, text end. A match counts 1, an edit ``-EDIT_COST``.
    """
    # on row i, diagonal d: text position first + i + d
    item, text = (x.T for x in _stacked(pairs, width))
    n, longest = item.shape
    score = np.zeros((n, width), np.int32)
    start = np.zeros((n, width, 2), np.int32)
    best = np.zeros((n, 5), np.int64)
    rows = np.arange(n)
    for i in range(longest):
        prev, before = score, start
        score, start = np.zeros_like(prev), np.zeros_like(before)
        for d in range(width):
            same = item[:, i] == text[:, i + d]
            s = np.where(same, prev[:, d] + 1, prev[:, d] - EDIT_COST)
            fresh = (prev[:, d] <= 0)[:, None]
            st = np.where(fresh, np.array([i, i + d], np.int32), before[:, d])
            if d + 1 < width:
                up = prev[:, d + 1] - EDIT_COST
                take = up > s
                s, st = np.where(take, up, s), np.where(take[:, None], before[:, d + 1], st)
            if d:
                left = score[:, d - 1] - EDIT_COST
                take = left > s
                s, st = np.where(take, left, s), np.where(take[:, None], start[:, d - 1], st)
            score[:, d], start[:, d] = np.maximum(s, 0), st
        d = score.argmax(axis=1)
        s = score[rows, d]
        more = s > best[:, 0]
        best[more] = np.stack([s, start[rows, d, 0], np.full(n, i + 1), start[rows, d, 1], i + d + 1], axis=1)[more]
    return best


class _Search:
    """Searches a block of items in texts given as words and codes."""

    def __init__(self, index: ItemIndex):
        self.index, self.e = index, index.edits
        self.bin = max(BIN, self.e)
        self.width = self.bin + 2 * self.e + 1
        self.runs: dict[int, set[bytes]] = {}

    def texts(self, ids: list, joined: list[np.ndarray]) -> list[tuple]:
        """Rows of some texts; they are cut further where they share very many q-grams with items."""
        x = np.concatenate([c for j in joined for c in (j, np.zeros(1, np.uint32))]) if joined else np.empty(0, np.uint32)
        got = self.index.matches(x)
        total = sum(int((self.index.tables[q][1][k + 1] - self.index.tables[q][1][k]).sum()) for q, _, k in got)
        if total > MOST_HITS and len(ids) > 1:
            half = len(ids) // 2
            return self.texts(ids[:half], joined[:half]) + self.texts(ids[half:], joined[half:])
        parts = max(1, min(len(self.index.ids), -(-total // MOST_HITS)))
        return [r for p in range(parts) for r in self._part(ids, joined, *self.index.expand(got, parts, p))]

    def _part(self, ids, joined, p, item, ip) -> list[tuple]:
        index, e = self.index, self.e
        if not len(p):
            return []
        begin = np.cumsum([0] + [len(j) + 1 for j in joined])
        doc = np.searchsorted(begin, p, side="right") - 1
        diag = p - begin[doc] - ip
        low = diag // self.bin
        # overlapping bands: a diagonal within e of the lower edge counts below as well
        again = diag - low * self.bin < e
        doc, item, ip, low = (np.concatenate([v, v[again]]) for v in (doc, item, ip, low))
        low[len(diag) :] -= 1
        o = np.lexsort((ip, low, item, doc))
        doc, item, ip, low = doc[o], item[o], ip[o], low[o]
        q, bound = np.asarray(index.q)[item], np.asarray(index.bound)[item]
        cut = np.ones(len(o), bool)
        cut[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] != low[:-1]) | (ip[1:] - ip[:-1] > ((e + 1) * q)[1:])
        at = np.flatnonzero(cut)
        n = np.diff(np.append(at, len(o)))
        keep = n >= bound[at]
        at, n = at[keep], n[keep]
        if not len(at):
            return []
        regions = []
        for a, m in zip(at, n):
            k = int(item[a])
            # the lemma for every passage by itself
            w, here = index.windows[k], ip[a : a + m]
            over = np.searchsorted(here, w[:, 1] - index.q[k], "right") - np.searchsorted(here, w[:, 0]) - (w[:, 1] - w[:, 0] + 1 - index.q[k] * (index.e[k] + 1))
            ok = np.flatnonzero(over >= 0)
            if len(ok):
                regions.append((int(doc[a]), k, int(low[a]) * self.bin - e, w[ok[np.argsort(-over[ok], kind="stable")]]))
        near = self._near(regions, joined)
        hits = [r for r, ok in zip(regions, near) if ok]
        hits.sort(key=lambda r: r[3].max() - r[3].min())  # alike long regions together
        found: dict[tuple[int, int], tuple] = {}
        for b in range(0, len(hits), 1024):
            part = hits[b : b + 1024]
            pairs = [(index.texts[k][w.min() : w.max()], joined[d], int(w.min()) + g) for d, k, g, w in part]
            for (d, k, _, w), (_, _, first), (s, a, z, ta, tz) in zip(part, pairs, band_align(pairs, self.width).tolist()):
                if s > found.get((d, k), (-1,))[0]:
                    i0 = int(w.min())
                    found[d, k] = (s, first + ta, first + tz, i0 + a, i0 + z)
        return [(ids[d], index.ids[k], *v, self._whole(joined[d], k)) for (d, k), v in found.items()]

    def _whole(self, text: np.ndarray, k: int) -> bool:
        """Whether a passage of item k stands in the text unchanged."""
        runs = self.runs.get(k)
        if runs is None:
            if len(self.runs) > 1000:
                self.runs.clear()
            runs = self.runs[k] = self.index.runs(k)
        at = np.concatenate([[0], np.flatnonzero(text == 32) + 1, [len(text) + 1]])
        m = self.index.words
        return any(text[a : z - 1].tobytes() in runs for a, z in zip(at[:-m], at[m:])) if len(at) > m else False

    def _near(self, regions: list[tuple], joined: list[np.ndarray]) -> np.ndarray:
        """Whether a passage of each region is within its edits of the text: the likeliest first, then the others."""
        index, ok = self.index, np.zeros(len(regions), bool)
        for rest in (False, True):
            ask = [(index.texts[k][a:z], joined[d], a + g, r, index.e[k]) for r, (d, k, g, w) in enumerate(regions) if not ok[r] for a, z in (w[1:] if rest else w[:1]).tolist()]
            ask.sort(key=lambda x: len(x[0]))
            for b in range(0, len(ask), 4096):
                part = ask[b : b + 4096]
                for (_, _, _, r, e), v in zip(part, band_distance([x[:3] for x in part], self.width)):
                    ok[r] |= v <= e
        return ok


def _searcher(blocks: list):
    """Runs all blocks of items over each batch; a block is unloaded again if there are many."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Search] = {}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            joined = [_codes(" ".join(plain_words(t))) for t in texts]
            sizes, rows = np.cumsum([len(j) for j in joined]), []
            for no, block in enumerate(blocks):
                run = kept.get(no) or _Search(pickle.loads(block.value))
                if len(blocks) <= KEPT_BLOCKS:
                    kept[no] = run
                lo = 0
                while lo < len(ids):
                    done = sizes[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(sizes, done + SLICE_CHARS, side="right")))
                    rows += run.texts(ids[lo:hi], joined[lo:hi])
                    lo = hi
            cols = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in OUT.split(", ")])

    return search


def passages(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = 8, edits: int = 2, q: int = Q, item_chars: int = ITEM_CHARS) -> DataFrame:
    """One row per document and item of which a passage of ``words`` words stands in it with at most ``edits`` edits.

    An edit inserts, drops or changes one character of the word-joined text. ``score`` is the local
    alignment's (matches less ``EDIT_COST`` per edit); offsets count characters of the word-joined
    texts; ``whole_run`` says whether ``words`` consecutive words stand there unchanged. An item of
    fewer words is searched as a whole. Every such pair comes out: ``q`` is lowered for items with
    short passages until the lemma's bound is 1 at least, and passages of fewer than
    ``LEAST_Q`` (edits + 1) = 12 characters, which only items of fewer words have, are searched with
    as many edits as leave ``LEAST_Q`` characters each. Items shorter than ``LEAST_Q`` characters and
    null texts and ids aren't searched. Repeated rows give their rows once. Extra columns aren't read.
    """
    it = items.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    total = it.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-total // item_chars))
    src = docs.select(F.col(doc).cast("bigint").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null and t <> ''")
    blocks = []
    for p in range(parts):
        rows = it.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).distinct().collect()  # about ``item_chars`` characters
        blocks.append(docs.sparkSession.sparkContext.broadcast(pickle.dumps(ItemIndex([(r["i"], r["t"]) for r in rows], q, words, edits))))
    both = src.mapInArrow(_searcher(blocks), OUT)
    w = F.struct("score", "doc_start", "doc_end", "item_start", "item_end")
    best = both.groupBy("doc_id", "item_id").agg(F.max(w).alias("b"), F.max("whole_run").alias("whole_run"))
    return best.select("doc_id", "item_id", "b.*", "whole_run")
