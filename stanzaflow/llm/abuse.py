"""Severity of abusive, hateful or sexual content by ordinal regression.

Every text is cut into sentences and lines; disguised spellings are undone; words, word
pairs and triples and consonant skeletons are hashed into a fixed number of weights. A
cumulative-link model (shared weights, ordered thresholds) grades each piece, a document is
as severe as its worst piece, and the output is the expected grade. Training only knows
grades of whole documents, so the piece that stands for a graded document is chosen anew in
each round; documents whose grade the model finds unlikely, as raters err, weigh less.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions.text import norm_source
from stanzaflow.shared import stage

#: At most so many rated documents with an objection, and as many without, are used for fitting.
RATED_DOCS = 4000
#: Features of fewer rated documents carry no weight.
LEAST_DOCS = 3
#: A feature may raise a grade if this share of its rated documents is of high grade.
LEAST_SHARE = 0.5
BITS = 18
GRADES = 3
ROUNDS = 6
STEPS = 150
RIDGE = 2e-4
WINDOW, STRIDE = 24, 12
CUT = 1.0

# Letters of other scripts and signs that stand in for Latin letters.
_LOOKALIKE = str.maketrans("авеёкмнорстухіјѕԁɡοαεικνρτυχω", "abeekmhopctyxijsdgoaeiknptuxw")
_STAND_IN = str.maketrans("0134578@$€", "oieastbase")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:([ .\-_*·])[^\W_])(?:\1[^\W_]){1,}(?![^\W_])")
#: What any such word holds, found faster.
_SPACED_SIGN = re.compile(r"([ .\-_*·])[^\W_]\1[^\W_](?![^\W_])")
_INNER = re.compile(r"[._\-*·~](?<=[^\W\d_][._\-*·~])(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[@$€!*](?=[^\W_]))*")
_SENTENCE = re.compile(r"(?<=[.!?;…])[\"'»”)]*\s+")
_END = re.compile("[.!?;…]")
_OTHER_SCRIPT = re.compile("[Ͱ-ԯɡ]")
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$€])")


_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_RUN = re.compile(r"(.)\1+")


def plain(text: str) -> str:
    """Lower-cased text without accents, hidden signs, look-alike letters and split-up words."""
    t = text.lower()
    if not t.isascii():
        t = _HIDDEN.sub("", t)
        if _OTHER_SCRIPT.search(t):
            t = t.translate(_LOOKALIKE)
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
        if _OTHER_SCRIPT.search(t):
            t = t.translate(_LOOKALIKE)
    if _SPACED_SIGN.search(t):
        t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), t)
    return _INNER.sub("", t)


def _squeeze(w: str) -> str:
    if _MIXED.match(w):
        w = w.translate(_STAND_IN)
    return _RUN.sub(r"\1", w.replace("!", "i").replace("*", ""))


def raw_pieces(text: str | None) -> list[list[str]]:
    """Words of every sentence or line; pieces of more than ``WINDOW`` words as overlapping windows."""
    out = []
    for line in plain(text or "").split("\n"):
        for p in _SENTENCE.split(line) if _END.search(line) else (line,):
            w = _WORD.findall(p)
            if len(w) <= WINDOW:
                if w:
                    out.append(w)
            else:
                out += [w[a : a + WINDOW] for a in range(0, len(w) - STRIDE, STRIDE)]
    return out


def pieces(text: str | None) -> list[list[str]]:
    """The same with words squeezed, as they count."""
    return [[_squeeze(w) for w in p] for p in raw_pieces(text)]


def _hash(s: str, h: int) -> int:
    for c in s.encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


class _Words(dict):
    """A number for every word; its hashes (of the squeezed word, of its consonants) stand at that place."""

    def __init__(self):
        self.pairs: list[tuple[int, int]] = []

    def __missing__(self, w: str) -> int:
        q = _squeeze(w)
        s = re.sub("[aeiouy]", "", q)
        self.pairs.append((_hash(q, 1469598103934665603), _hash(s, 7809847782465536322) if len(s) >= 3 else 0))
        k = self[w] = len(self)
        return k


class Hasher:
    """Feature numbers of pieces; words and their hashes are kept, up to a bound."""

    def __init__(self, bits: int = BITS):
        self.bits, self.known, self.table = bits, _Words(), np.empty((0, 2), np.uint64)

    def features(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, piece) pairs, each once per piece, sorted by piece."""
        if len(self.known) > 300_000:
            self.known, self.table = _Words(), np.empty((0, 2), np.uint64)
        size = [len(p) for p in parts]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sum(size))
        if len(self.table) < len(self.known.pairs):
            self.table = np.concatenate([self.table, np.array(self.known.pairs[len(self.table) :], np.uint64)])
        h, sk = self.table[at, 0], self.table[at, 1]
        seg = np.repeat(np.arange(len(parts)), size)
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        feats, segs = [h], [seg]
        two = seg[1:] == seg[:-1]
        h2 = (h[:-1] * a + h[1:]) * b
        feats.append(h2[two]), segs.append(seg[1:][two])
        three = seg[2:] == seg[:-2]
        h3 = (h2[:-1] * a + h[2:]) * b
        feats.append(h3[three]), segs.append(seg[2:][three])
        gap = (h[:-2] * b + h[2:]) * a + np.uint64(1)
        feats.append(gap[three]), segs.append(seg[2:][three])
        has = sk > 0
        feats.append(sk[has]), segs.append(seg[has])
        f, s = np.concatenate(feats), np.concatenate(segs)
        f = ((f ^ (f >> np.uint64(29))) * b) >> np.uint64(64 - self.bits)
        key = np.sort(s.astype(np.uint64) << np.uint64(self.bits) | f)
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        return (key & np.uint64((1 << self.bits) - 1)).astype(np.int64), (key >> np.uint64(self.bits)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Ordinal:
    """Cumulative-link model: P(grade > k) = sigmoid(w x - theta_k), theta ascending."""

    def __init__(self, bits: int = BITS):
        self.w, self.theta = np.zeros(1 << bits), np.array([1.0, 2.0, 3.0])
        self.common = self.raising = np.ones(1 << bits, bool)

    def expected(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(np.asarray(score)[:, None] - self.theta).sum(axis=1)

    def likelihood(self, score: np.ndarray, y: np.ndarray) -> np.ndarray:
        up = np.concatenate([np.ones((len(score), 1)), _sigmoid(score[:, None] - self.theta), np.zeros((len(score), 1))], axis=1)
        r = np.arange(len(score))
        return up[r, y] - up[r, y + 1]

    def scores(self, feats: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.w[feats], at) / np.sqrt(size) if len(at) else np.empty(0)

    def fit(self, feats: np.ndarray, at: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, rate: float = 0.1) -> None:
        """Full-batch Adam on the penalised likelihood; thresholds by their gaps, so they stay in order."""
        rows, scale = np.repeat(np.arange(len(at)), size), 1 / np.sqrt(size)
        used, place = np.unique(feats, return_inverse=True)
        free, most = self.common[used], np.where(self.raising[used], np.inf, 0)
        w = self.w[used].copy()
        t = np.array([self.theta[0], *np.log(np.diff(self.theta))])
        m = [np.zeros_like(w), np.zeros_like(t)]
        v = [np.zeros_like(w), np.zeros_like(t)]
        total = weight.sum()
        for i in range(1, steps + 1):
            theta = np.cumsum([t[0], *np.exp(t[1:])])
            f = np.add.reduceat(w[place], at) * scale
            s = _sigmoid(f[:, None] - theta)  # P(y > k)
            up = np.concatenate([np.ones((len(f), 1)), s, np.zeros((len(f), 1))], axis=1)
            d = np.concatenate([np.zeros((len(f), 1)), s * (1 - s), np.zeros((len(f), 1))], axis=1)
            r = np.arange(len(f))
            p = np.maximum(up[r, y] - up[r, y + 1], 1e-9)
            gf = -weight * (d[r, y] - d[r, y + 1]) / p / total
            gth = np.array([(weight * (np.where(y == k + 1, 1, 0) - np.where(y == k, 1, 0)) * d[:, k + 1] / p).sum() for k in range(GRADES)]) / total
            gt = np.array([gth.sum(), *[gth[k:].sum() * np.exp(t[k]) for k in range(1, GRADES)]])
            gw = np.bincount(place, (gf * scale)[rows], len(used)) * free + RIDGE * w / max(1.0, len(at) / 1000)
            for x, g, k in ((w, gw, 0), (t, gt, 1)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                x -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
            np.minimum(w, most, out=w)
        self.w[:] = 0
        self.w[used] = w
        self.theta = np.cumsum([t[0], *np.exp(t[1:])])


def _subset(pick: np.ndarray, feats: np.ndarray, at: np.ndarray, size: np.ndarray):
    idx = np.concatenate([np.arange(at[p], at[p] + size[p]) for p in pick]) if len(pick) else np.empty(0, np.int64)
    n = size[pick]
    return feats[idx], np.append(0, np.cumsum(n)[:-1]).astype(np.int64), n


def train(texts: list[str], grades: np.ndarray, share: float = 1.0, share_bad: float = 1.0) -> Ordinal:
    """Fits the model to graded documents (grades 0 to 3); ``share`` is the kept part of those of grade 0, ``share_bad`` of the others.

    Both parts count as often as they are in the whole, so the model doesn't depend on how many of each are kept.
    """
    model, hasher = Ordinal(), Hasher()
    if not len(grades) or not grades.any() or grades.all():
        model.theta = np.array([9.0, 10.0, 11.0])
        return model
    owners, fs, sizes = [], [], []
    for lo in range(0, len(texts), 500):
        parts = []
        for d in range(lo, min(lo + 500, len(texts))):
            mine = raw_pieces(texts[d])
            parts += mine
            owners += [d] * len(mine)
        if parts:
            f, seg = hasher.features(parts)
            fs.append(f.astype(np.int32)), sizes.append(np.bincount(seg, minlength=len(parts)))
    feats, size, owner = np.concatenate(fs), np.concatenate(sizes), np.array(owners)
    at = np.append(0, np.cumsum(size)[:-1])
    del fs, sizes, owners
    bad = grades >= 2
    # start: log-odds of a feature among documents of high and of low grade
    pair = np.unique(np.repeat(owner, size).astype(np.int64) << BITS | feats)
    doc, f = pair >> BITS, pair & ((1 << BITS) - 1)
    up, down = np.bincount(f[bad[doc]], minlength=1 << BITS), np.bincount(f[~bad[doc]], minlength=1 << BITS)
    p, n = max(1, bad.sum()), max(1, (~bad).sum())
    model.w = np.log((up + 0.5) / (p + 1)) - np.log((down + 0.5) / (n + 1))
    model.common = up + down >= LEAST_DOCS
    # only what stands mostly in documents of high grade may raise a grade
    mild = np.bincount(f[(grades == 1)[doc]], minlength=1 << BITS)
    most, least = (up + mild) / share_bad, (down - mild) / share
    model.raising = (up >= 2) & (up / share_bad >= LEAST_SHARE * (most + least))
    model.w = np.where(model.common, np.where(model.raising, model.w, np.minimum(model.w, 0)), 0)
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    docs, weight = owner[start], np.ones(len(grades))
    for r in range(ROUNDS):
        s = model.scores(feats, at, size)
        order = np.lexsort((-s, owner))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        # graded documents stand with their worst piece, harmless ones with their worst few and some others
        pick = order[(rank == 0) | ((grades[owner[order]] == 0) & ((rank < 4) | (rank % 4 == r % 4)))]
        y = grades[owner[pick]].astype(int)
        wt = weight[owner[pick]].copy()
        wt[y == 0] *= share_bad / (3 * share)
        model.fit(*_subset(pick, feats, at, size), y, wt)
        worst = np.maximum.reduceat(model.scores(feats, at, size), start)
        if r >= 1:
            weight[docs] = np.clip(model.likelihood(worst, grades[docs].astype(int)) * 4, 0.02, 1)
    return model


def graded(docs: DataFrame, ratings: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, grade`` of rated documents.

    Grade 0: nobody objects; 1: up to half of the raters; 2: more, or a single rater; 3: all of several.
    A rater's repeated rows count once (the latest stays, a higher rating at equal times); null ratings don't count.
    """
    r = ratings.where("toxic is not null and doc_id is not null").groupBy("doc_id", "rater_id").agg(F.max(F.struct("rated_at", "toxic"))["toxic"].cast("double").alias("t"))
    r = r.groupBy("doc_id").agg(F.avg("t").alias("share"), F.count("*").alias("n"))
    grade = F.when(F.col("share") == 0, 0).when(F.col("share") <= 0.5, 1).when((F.col("share") < 1) | (F.col("n") == 1), 2).otherwise(3)
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.join(r.select("doc_id", grade.alias("grade")), "doc_id").where("text <> ''")


def fit(docs: DataFrame, ratings: DataFrame, most: int = RATED_DOCS, seed: int = 5) -> Ordinal:
    """Fits on at most ``most`` rated documents with and ``most`` without an objection, by a seeded hash of their id."""
    every = stage(graded(docs, ratings), "graded")
    bad, harmless = every.agg(F.count_if(F.col("grade") > 0), F.count_if(F.col("grade") == 0)).first()
    texts, grades = [], []
    for part in ("grade > 0", "grade = 0"):
        for r in every.where(part).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "text").limit(most).toLocalIterator():
            texts.append(r["text"]), grades.append(r["grade"])
    g = np.array(grades, dtype=np.int64)
    return train(texts, g, (g == 0).sum() / max(1, harmless), (g > 0).sum() / max(1, bad))


def severities(docs: DataFrame, model: Ordinal, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, severity``: expected grade from 0 to 3 of every document's worst piece.

    ``source`` is trimmed, lower-cased and written with underscores. Null and empty texts have
    severity 0; null ids are left out; repeated rows give theirs again. Extra columns aren't read.
    """
    w, theta = model.w.astype(np.float32), model.theta
    kept = np.flatnonzero(w)
    values = w[kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = Ordinal(), Hasher()
        m.w[kept], m.theta = values, theta
        for b in batches:
            texts = b.column(2)
            out = np.zeros(b.num_rows)
            for lo in range(0, b.num_rows, 500):
                parts, owner = [], []
                for i, t in enumerate(texts.slice(lo, 500).to_pylist()):
                    mine = raw_pieces(t)
                    parts += mine
                    owner += [lo + i] * len(mine)
                if parts:
                    feats, seg = hasher.features(parts)
                    at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
                    e = m.expected(m.scores(feats, at, np.diff(np.append(at, len(seg)))))
                    np.maximum.at(out, np.array(owner), e)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["doc_id", "source", "severity"])

    src = docs.select(F.col(doc).cast("bigint").alias("doc_id"), norm_source(F.col(source)).alias("source"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    return src.mapInArrow(score, "doc_id bigint, source string, severity double")


def source_rates(scored: DataFrame, cut: float = CUT) -> DataFrame:
    """``source, n_docs, n_flagged, rate, mean_severity`` per source (null sources together)."""
    hit = (F.col("severity") >= cut).cast("bigint")
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(hit).alias("n_flagged"), F.avg(hit.cast("double")).alias("rate"), F.avg("severity").alias("mean_severity"))
