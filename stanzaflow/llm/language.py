"""Language of every record and of every stretch of a mixed one.

Scripts and their letters narrow the candidates of a word; within a script words are scored
by their frequencies per language, unseen ones by their letter trigrams, and one state stands
for languages that the model doesn't know. Viterbi with a switching penalty, lower at line
ends, labels the words; lines take the language of their words, and runs of lines become
segments. The word scores are fitted on at most ``SAMPLE_DOCS`` labelled records, whose lines
are relabelled a few times since labels may be wrong. Every record comes out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.llm.quality import CHORD, FUNCTION_WORDS, HEADER, SYLLABLE

#: Labelled records that the word scores are fitted on at most.
SAMPLE_DOCS = 8000
#: A language is fitted if so many sampled records are labelled with it, and kept if this share of its lines still speaks it in the end.
LEAST_RECORDS = 5
LEAST_KEPT = 0.5
ROUNDS = 4
SWITCH_WORD, SWITCH_LINE = 7.0, 2.0
CLIP, CLIP_UNKNOWN = 6.0, 2.0
#: Cost of a word no language knows, and of a known word, or one of a known script, where the text is in none of the languages.
STRANGE, FAMILIAR, SAME_SCRIPT = 1.0, 1.5, 0.4
SEGMENT_LINES = 3
UNKNOWN = "und"
OUT = "doc_id bigint, segment int, first_line bigint, n_lines int, lang string, confidence double, n_segments int"

#: Scripts and the letters among them that the named language uses; a word of the script with other letters is in none of the languages.
SCRIPTS = {"el": ("Ͱ-Ͽ", ""), "ru": ("Ѐ-ӿ", "Ѐ-Џѐ-ҁҊ-ӿ"), "he": ("֐-׿", ""), "ar": ("؀-ۿ", "ٮ-ۓەۮۯۺ-ۿ"), "hi": ("ऀ-ॿ", ""), "th": ("฀-๿", ""), "ja": ("぀-ヿ", ""), "ko": ("가-힯", ""), "zh": ("一-鿿", "")}
#: Other spellings of the labels.
LABELS = {"eng": "en", "english": "en", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr", "french": "fr", "deu": "de", "ger": "de", "german": "de", "por": "pt", "portuguese": "pt", "ita": "it", "italian": "it"}
_WORD = re.compile(r"(?<!\w)[^\W\d_]++(?:['’](?=[^\W\d_]))?(?![\d_])")
#: The same where no digit or underscore stands, found faster.
_PLAIN_WORD, _DIGIT = re.compile(r"[^\W\d_]+(?:'(?=[^\W\d_]))?"), re.compile(r"[\d_]")
#: Addresses, markup and damaged encoding inside a line.
_REMAINS = re.compile(r"\b\w{1,20}://\S+|</?\w[^<>]*>|&#?\w+;|\{[^{}]*\}|Ã.|â€.?|ï¿½|Â(?=\s|$)|\ufffd")
#: What any of them holds, found faster.
_REMAINS_SIGN = re.compile("[:<&{Ãâï\ufffdÂ]")
#: A line is in a language if known words make up this share of its visible characters.
KNOWN_SHARE = 0.2
_NO_LANGUAGE = re.compile(rf"^(?:{SYLLABLE}|{CHORD}|x)$", re.I)
_HEADER, _CHORD = re.compile(HEADER), re.compile(CHORD)
_SCRIPT = [(k, re.compile(f"[{v}]"), re.compile(f"[{x}]") if x else None) for k, (v, x) in SCRIPTS.items()]


def label_language(label: Column) -> Column:
    """Two-letter language a label names, in whatever spelling; null for empty and placeholder labels."""
    x = F.lower(F.trim(label))
    two = F.regexp_extract(x, r"^([a-z]{2})(?:[-_].*)?$", 1)
    three = F.element_at(F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv]), F.regexp_extract(x, r"^([a-z]+)", 1))
    return F.coalesce(three, F.nullif(two, F.lit("")))


def line_words(line: str) -> list[str]:
    """Words of a line that speak for a language; none for headers, chords, syllables and signs."""
    words = _words(line)
    return words if any(map(_speaks, words)) else []


def _words(line: str) -> list[str]:
    parts = line.split()
    if not parts or _HEADER.match(line) or (len(parts) > 1 and parts[0][0] in "ABCDEFGH" and all(map(_CHORD.fullmatch, parts))):
        return []
    t = (_REMAINS.sub(" ", line) if _REMAINS_SIGN.search(line) else line).lower().replace("’", "'")
    return (_WORD if _DIGIT.search(t) else _PLAIN_WORD).findall(t)


def _speaks(w: str) -> bool:
    """Whether the word is neither a sung syllable nor a chord."""
    return not _NO_LANGUAGE.match(w.rstrip("'"))


def _grams(w: str) -> list[str]:
    p = f"^{w}$"
    return [p[i : i + 3] for i in range(len(p) - 2)]


class WordScores:
    """Log-probabilities per language, relative to the best one, of words and letter trigrams.

    The languages are those of ``FUNCTION_WORDS`` and of the labels; one whose lines turn out to
    speak another language, as its label was only ever wrong, is given up. ``states`` adds the scripts
    that stand for a language and, last, the unknown language.
    """

    def __init__(self, texts: list[tuple[str, str | None]]):
        seen = Counter(lang for _, lang in texts if lang)
        self.langs = tuple(FUNCTION_WORDS) + tuple(sorted(k for k, n in seen.items() if n >= LEAST_RECORDS and k not in FUNCTION_WORDS and k not in SCRIPTS))
        lines, labels, words = [], [], {}
        for text, lang in texts:
            for line in (text or "").split("\n"):
                w = words.get(line)
                if w is None:
                    w = words[line] = line_words(line)
                if w:
                    lines.append(w), labels.append(lang)
        vocab: dict[str, int] = {}
        for ws in [*lines, *FUNCTION_WORDS.values()]:
            for w in ws:
                vocab.setdefault(w, len(vocab))
        flat = np.array([vocab[w] for ws in lines for w in ws], dtype=np.int64)
        owner = np.repeat(np.arange(len(lines)), [len(w) for w in lines]) if lines else np.empty(0, np.int64)
        while True:
            place = {k: i for i, k in enumerate(self.langs)}
            given = np.array([place.get(k, -1) for k in labels], dtype=np.int64)
            table, score = self._fit(vocab, flat, owner, given)
            # a language fails if most lines that bear its label speak other ones
            kept = tuple(k for i, k in enumerate(self.langs) if k in FUNCTION_WORDS or self._own(given == i, owner, flat, table, i) >= LEAST_KEPT)
            if kept == self.langs:
                break
            self.langs = kept
        self.words = {w: score[i].astype(np.float32) for w, i in vocab.items() if table[i].sum() >= 2}
        grams: dict[str, np.ndarray] = {}
        for w, i in vocab.items():
            few = np.minimum(table[i], 5)
            for g in _grams(w):
                if g in grams:
                    grams[g] += few
                else:
                    grams[g] = few.copy()
        g = self._relative(np.array(list(grams.values())).reshape(-1, len(self.langs)), 1.0, 3.0) if grams else np.zeros((0, len(self.langs)))
        self.grams = {k: v.astype(np.float32) for k, v in zip(grams, g)}
        self.states = (*self.langs, *SCRIPTS, UNKNOWN)
        self.scripts = [(self.states.index(k), p, other) for k, p, other in _SCRIPT]

    def _fit(self, vocab: dict[str, int], flat: np.ndarray, owner: np.ndarray, lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, scores) of the words per language, the lines relabelled a few times."""
        n = len(self.langs)
        seed = np.zeros((len(vocab), n))
        for i, lang in enumerate(self.langs):
            for w in FUNCTION_WORDS.get(lang, ()):
                seed[vocab[w], i] += 3
        table, score = seed, self._relative(seed, 0.3, CLIP)
        for _ in range(ROUNDS):
            k = lab[owner] if len(owner) else owner
            table = seed + np.bincount(flat[k >= 0] * n + k[k >= 0], minlength=seed.size).reshape(seed.shape)
            score = self._relative(table, 0.3, CLIP)
            if len(lab):
                by_line = np.stack([np.bincount(owner, score[flat, i], len(lab)) for i in range(n)], axis=1)
                best = by_line.max(axis=1)
                sure = best - np.sort(by_line, axis=1)[:, -2] > 2
                lab = np.where(sure, by_line.argmax(axis=1), lab)
        return table, score

    def _own(self, mine: np.ndarray, owner: np.ndarray, flat: np.ndarray, table: np.ndarray, k: int) -> float:
        """Share of the language's lines whose words mostly are words of its own, judged without its label's own counts."""
        at = mine[owner]
        rest = np.delete(table, k, axis=1).sum(axis=1)[flat[at]]
        # a word that other languages use about as often as this one speaks for them
        own = table[flat[at], k] > rest
        lines = np.unique(owner[at], return_inverse=True)[1]
        if not len(lines):
            return 0.0
        return float((np.bincount(lines, own) > 0.5 * np.bincount(lines)).mean())

    @staticmethod
    def _relative(table: np.ndarray, alpha: float, clip: float) -> np.ndarray:
        p = np.log((table + alpha) / (table.sum(axis=0, keepdims=True) + alpha * max(1, len(table))))
        # a language that was hardly seen must not look likely for rare words
        return np.maximum(p - p.max(axis=1, keepdims=True), -clip)

    def familiar(self, word: str) -> bool:
        """Whether the word is known (a script of its own counts as known)."""
        return word in self.words or not word.isascii() and any(p.search(word) for _, p, _ in self.scripts)

    def score(self, word: str) -> np.ndarray:
        """A score per state: 0 for the likeliest language; a word that none knows costs all of them ``STRANGE``."""
        out = np.full(len(self.states), -CLIP, np.float32)
        if not word.isascii():
            for k, pattern, other in self.scripts:
                if pattern.search(word):
                    if other and other.search(word):
                        out[-1] = 0
                    else:
                        out[k], out[-1] = 0, -SAME_SCRIPT
                    return out
        known = self.words.get(word)
        n = len(self.langs)
        if known is None:
            g = [self.grams[x] for x in _grams(word) if x in self.grams]
            guess = np.clip(np.sum(g, axis=0) * 0.5, None, 0) if g else np.zeros(n)
            out[:n], out[-1] = np.maximum(guess - guess.max(), -CLIP_UNKNOWN) - STRANGE, 0
        else:
            out[:n], out[-1] = known, -FAMILIAR
        return out


def viterbi(scores: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Best state paths of (texts, words, states); ``penalty`` is the cost of switching before each word."""
    n, t, s = scores.shape
    if not t:
        return np.zeros((n, 0), np.int64)
    v, back = scores[:, 0].copy(), np.zeros((n, t, s), np.int16)
    own = np.arange(s, dtype=np.int16)
    for i in range(1, t):
        top = v.argmax(axis=1)
        jump = np.take_along_axis(v, top[:, None], 1) - penalty[:, i, None]
        stay = v >= jump
        back[:, i] = np.where(stay, own, top[:, None])
        v = np.where(stay, v, jump) + scores[:, i]
    path = np.empty((n, t), np.int64)
    path[:, -1] = v.argmax(axis=1)
    rows = np.arange(n)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = back[rows, i, path[:, i]]
    return path


def segments_of(lines: list[tuple[int, int]], least: int = SEGMENT_LINES) -> list[tuple[int, int, int]]:
    """(first line, lines, language) of the segments of (line number, language) in order."""
    runs: list[list[int]] = []
    for no, lang in lines:
        if runs and runs[-1][2] == lang:
            runs[-1][1] += 1
        else:
            runs.append([no, 1, lang])
    if not runs:
        return []
    kept = [r for r in runs if r[1] >= least] or [max(runs, key=lambda r: r[1])]
    joined: list[list[int]] = []
    for r in kept:
        if joined and joined[-1][2] == r[2]:
            joined[-1][1] += r[1]
        else:
            joined.append(list(r))
    joined[0][0] = lines[0][0]
    return [tuple(r) for r in joined]


class _Numbers(dict):
    """A number for every word; its scores, and its length if it is known, stand at that place."""

    def __init__(self, model: WordScores):
        self.model, self.known, self.speaks, self.scores = model, [], [], np.zeros((1024, len(model.states)), np.float32)

    def __missing__(self, w: str) -> int:
        k = self[w] = len(self)
        if k == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[k] = self.model.score(w)
        self.known.append(len(w) if self.model.familiar(w) else 0)
        self.speaks.append(_speaks(w))
        return k


class _Lines:
    """Word numbers of lines, and scores of word numbers; both kept up to a bound, as lines and words come again."""

    def __init__(self, model: WordScores):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.lines: dict[str, tuple[list[int], bool]] = {}
        self.numbers = _Numbers(self.model)

    def trim(self) -> None:
        if len(self.lines) > 200_000 or len(self.numbers) > 200_000:
            self._reset()

    def words(self, line: str) -> tuple[list[int], bool]:
        """The numbers of the words that speak for a language, and whether enough of the line is known."""
        got = self.lines.get(line)
        if got is None:
            ws = _words(line)
            nos = list(map(self.numbers.__getitem__, ws))
            if not any(map(self.numbers.speaks.__getitem__, nos)):
                ws, nos = [], []
            seen, visible = sum(map(self.numbers.known.__getitem__, nos)), len(line) - line.count(" ")
            speaks = seen >= KNOWN_SHARE * visible
            # too few known words: a line of an unknown language if it is of words at all
            if not speaks and 2 * sum(map(len, ws)) < visible:
                nos = []
            got = self.lines[line] = nos, speaks
        return got


def _labeller(model: WordScores):
    names, und = model.states, len(model.states) - 1

    def rows_of(d: int, nos: list[int], lang: list[int], p: np.ndarray) -> list[tuple]:
        """Segments of known languages, and runs of lines in an unknown one beside them."""
        if lang and lang[0] != und and lang.count(lang[0]) == len(lang):
            return [(d, 1, nos[0], len(nos), names[lang[0]], float(p[:, lang[0]].mean()), 1)]
        known = [i for i, k in enumerate(lang) if k != und]
        segs = segments_of([(nos[i], lang[i]) for i in known])
        rows = []
        for k, (first, n, m) in enumerate(segs):
            until = segs[k + 1][0] if k + 1 < len(segs) else float("inf")
            sure = [p[i, m] for i in known if first <= nos[i] < until and lang[i] == m]
            rows.append((first, n, names[m], float(np.mean(sure)) if sure else 0.0))
        run: list[int] = []
        for i, k in [*enumerate(lang), (len(lang), -1)]:
            if k == und:
                run.append(i)
            elif run:
                if len(run) >= SEGMENT_LINES or not segs:
                    rows.append((nos[run[0]], len(run), UNKNOWN, float(np.mean(p[run, und]))))
                run = []
        if not segs:  # the longest, the first of equals
            rows = sorted(rows, key=lambda r: -r[1])[:1] or [(1, 0, UNKNOWN, 0.0)]
        return [(d, k + 1, *r, len(segs)) for k, r in enumerate(sorted(rows))]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Lines(model)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            docs, rows = [], []
            seen.trim()
            for d, text in zip(ids, texts):
                nos, parts, sure = [], [], []
                for no, line in enumerate((text or "").split("\n"), 1):
                    w, speaks = seen.words(line)
                    if w:
                        nos.append(no), parts.append(w), sure.append(speaks)
                if parts:
                    docs.append((d, nos, parts, sum(map(len, parts)), sure))
                else:
                    rows += rows_of(d, [], [], np.zeros((0, und + 1)))
            docs.sort(key=lambda x: x[3])
            lo = 0
            while lo < len(docs):
                hi = lo + 1
                while hi < len(docs) and (hi - lo) < 512 and docs[hi][3] * (hi - lo + 1) < 200_000:
                    hi += 1
                part = docs[lo:hi]
                lo = hi
                t = part[-1][3]
                # all lines of all texts in a row
                words = seen.numbers.scores[[k for x in part for w in x[2] for k in w]]
                # states that no word of these texts speaks for, mostly scripts, can't be on a best path
                act = np.flatnonzero((words > -CLIP).any(axis=0))
                words = words[:, act]
                length = np.array([len(w) for x in part for w in x[2]])
                size, lines = np.array([x[3] for x in part]), np.array([len(x[2]) for x in part])
                starts, begin = np.append(0, np.cumsum(length)[:-1]), np.append(0, np.cumsum(size)[:-1])
                text = np.repeat(np.arange(len(part)), size)
                place = np.arange(len(words)) - begin[text]
                x, pen = np.zeros((len(part), t, len(act)), np.float32), np.full((len(part), t), SWITCH_WORD, np.float32)
                x[text, place] = words
                pen[text[starts], place[starts]] = SWITCH_LINE
                path = act[viterbi(x, pen)[text, place]]
                line = np.repeat(np.arange(len(length)), length)
                votes = np.bincount(line * len(names) + path, minlength=len(length) * len(names)).reshape(-1, len(names))
                lang = np.where(np.array([y for x in part for y in x[4]]), votes.argmax(axis=1), und).tolist()
                sums = np.add.reduceat(words, starts, axis=0)
                sums = np.exp(sums - sums.max(axis=1, keepdims=True))
                p = np.zeros((len(length), len(names)), np.float32)
                p[:, act] = sums / sums.sum(axis=1, keepdims=True)
                first = 0
                for (d, nos, _, _, _), n in zip(part, lines.tolist()):
                    rows += rows_of(d, nos, lang[first : first + n], p[first : first + n])
                    first += n
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in OUT.split(", ")])

    return label


def fit(df: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE_DOCS, seed: int = 3) -> WordScores:
    """Word scores from at most ``sample`` labelled records, chosen by a seeded hash of the text."""
    some = df.select(F.col(text).cast("string").alias("t"), label_language(F.col(label)).alias("l")).where(F.col("l").isNotNull() & (F.length("t") > 0))
    some = some.orderBy(F.xxhash64("t", F.lit(seed)), "t", "l").limit(sample)
    return WordScores([(r["t"], r["l"]) for r in some.toLocalIterator()])


def segments(df: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "lang", model: WordScores | None = None) -> DataFrame:
    """``doc_id, segment, first_line, n_lines, lang, confidence, n_segments, label_lang``; one row or more for every record.

    Lines are what a newline separates, counted from 1. A segment is a run of at least three lines
    in one language (blank lines, headers in square brackets, chords, sung syllables and signs are
    passed over); shorter runs are dropped and equal neighbours joined; if no run is that long, the
    longest, the first of equals, is the segment. ``confidence`` is the mean probability of the
    language over the segment's lines. Runs of three lines or more in a language that the model
    doesn't know come out as ``und`` beside them and don't cut the others; a record of such lines
    only has its longest run, and one without any line in a language (null and empty texts among
    them) a row ``und`` of 0 lines with confidence 0. ``n_segments`` counts segments of known
    languages. Null ids give no row; repeated rows give theirs again. Extra columns aren't read.
    """
    model = model or fit(df, text, label)
    src = df.select(F.col(doc).cast("bigint").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null")
    names = df.select(F.col(doc).cast("bigint").alias("doc_id"), label_language(F.col(label)).alias("label_lang")).where("doc_id is not null").groupBy("doc_id").agg(F.max("label_lang").alias("label_lang"))
    return src.mapInArrow(_labeller(model), OUT).join(names, "doc_id", "left")


def mislabelled(segs: DataFrame) -> DataFrame:
    """Segments in known languages of records whose label is missing or names another language, or that have several."""
    return segs.where(F.col("lang") != UNKNOWN).where((F.col("n_segments") > 1) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")))
