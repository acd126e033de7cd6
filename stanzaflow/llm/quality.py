"""Text statistics per record, and natural text told from lists, tables and junk.

Statistics are taken per line with built-in functions. An ordered rule list over them is
induced by incremental reduced-error pruning (IREP) on labelled documents and exported as
one SQL CASE expression, so applying it needs no Python. A record is not natural text if
more than half of its non-blank lines are list entries, table rows or junk.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Frequent function words of six languages.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for with from is are was were i you he she it we they my your not that this".split(),
    "es": "el la los las un una de que y en por con sin no se me te mi tu es como si lo al del para donde nada".split(),
    "fr": "le la les une du et je tu il elle nous que qui ne pas est dans sur avec sans pour mon ma où comme tout rien moi".split(),
    "de": "der die das den ein eine und ich du er sie wir ist nicht mit ohne für auf im zu wenn wie wo mir mich mein nur nie".split(),
    "pt": "o os as um uma do da em eu não com sem para meu minha seu mais quem quando já nunca também nada há você ao se".split(),
    "it": "il lo gli uno di che e io non senza per mio mia ti più chi quando già mai adesso anche niente della tutto dove c".split(),
}
#: A sung syllable, and a chord name. Patterns are matched against single words: a repeated group over a whole line could take time out of all proportion.
SYLLABLE = r"(?:[snt]?h?r?[aou]+h*|l[aiou]+|n[aou]+|d[aeiou]+|b[aou]+p?|y[ae]+h?|yeah|h[ea]+y+|[ow]+h+[oa]*h*|w[oa]+p*h*|mm+|hm+|sh[aou]+p?|tra|dum|oh+|ey+|ay+|e?h+a+)"
CHORD = r"(?:[A-H][#b]?(?:m|maj|min|dim|aug|sus|add)?[0-9]{0,2}(?:/[A-G][#b]?)?)"
HEADER = r"^\s*\[[^\[\]]*\]\s*$"

#: Name and meaning of the statistics of a line that rules may test.
LINE_STATS = {
    "words": "runs of letters", "common": "share of function words", "letters": "share of letters among visible signs", "digits": "share of digits among visible signs",
    "marks": "bars, tabs and inner semicolons per word", "gaps": "runs of two or more blanks inside the line", "lead": "starts like a list entry", "title": "share of capitalised words",
    "varied": "distinct words per word, of ten words at most", "signs": "distinct letters, of four at most", "longest": "longest run of visible signs, 18 at least", "broken": "markup or damaged encoding", "keyed": "a key, then a colon, dash, arrow or equals sign",
    "commas": "commas per word", "clock": "a time of day or a duration", "links": "a web address", "sung": "a section header, chords or sung syllables", "doc_varied": "distinct lines per line of the record, a half at most",
}
#: Statistics that most rules test and that cost little: worked out for every line. Others are only where a rule gets to them.
EAGER = ("words", "common", "letters", "digits", "varied", "commas")
#: What rules are induced over; ``sung`` stands in an exception ahead of them.
RULE_NAMES = tuple(k for k in LINE_STATS if k != "sung")
#: Lines that no rule may take: the first conditions of the CASE.
EXCEPTIONS = ("`sung` > 0.5D",)
#: Four different letters, wherever they stand; nothing is tried twice.
FOUR_LETTERS = r"^(.)\1*+(.)(?:\1|\2)*+(.)(?:\1|\2|\3)*+."
#: Labelled documents that rules are induced on at most.
MOST_LABELLED = 20_000
TRAINING_DOCS = 3000
#: Induction ends after so many rules in a row that were not worth keeping.
MOST_MISSES = 25


def _drop(x: Column, *parts: str) -> Column:
    """The text without these parts, byte by byte: much cheaper than a pattern."""
    for p in parts:
        x = F.replace(x, F.lit(p), F.lit(""))
    return x


def _number(x: Column, *parts: str) -> Column:
    """How often the signs occur."""
    return (F.length(x) - F.length(_drop(x, *parts))).cast("double")


def line_stats(line: str = "line") -> list[Column]:
    """The statistics of a line column, without ``doc_varied``. Expects ``w``, its lower-cased runs of letters, and ``letters_n``, their length.

    Only those that a rule tests are worked out. Patterns run only on lines with a sign they need.
    """
    x, w = F.col(line), F.col("w")
    t = F.trim(x)
    visible = F.greatest(F.length(_drop(x, " ", "\t", "\u00a0")), F.lit(1))
    n = F.size(w)
    some = F.greatest(n, F.lit(1))
    frequent = sorted({v for ws in FUNCTION_WORDS.values() for v in ws})
    flag = lambda p: t.rlike(p).cast("double")
    where = lambda need, value, other=0.0: F.when(need, value).otherwise(F.lit(other))
    holds = lambda *parts: F.greatest(*[x.contains(p) for p in parts]) if len(parts) > 1 else x.contains(parts[0])
    parts = F.split(t, r"\s+")
    chords = t.rlike(rf"^{CHORD}\s") & F.forall(parts, lambda v: v.rlike(f"^{CHORD}$"))
    # a held vowel is sung, a row of one letter is not
    syllables = (n > 0) & F.forall(w, lambda v: v.rlike(f"^{SYLLABLE}$") & ~v.rlike(r"(\p{L})\1{4}"))
    inner = _number(x, ";") - (F.length(x) - F.length(_drop(x, "; "))) / 2 - x.endswith(";").cast("double")
    return [
        n.cast("double").alias("words"),
        (F.size(F.filter(w, lambda v: v.isin(*frequent))) / some).alias("common"),
        (F.col("letters_n") / visible).alias("letters"),
        (F.regexp_count(x, F.lit(r"\p{N}")).cast("double") / visible).alias("digits"),
        ((_number(x, "|", "\t") + where(holds(";"), inner)) / some).alias("marks"),
        where(holds("  ", "\t"), F.regexp_count(t, F.lit(r"\S(?:\s{2,}|\t)(?=\S)")).cast("double")).alias("gaps"),
        flag(r"^(?:[-*+•·–>#~]\s|\(?\d{1,3}[.):]\s|\(?\p{L}[.)]\s|\d{1,2}[./]\d{1,2}[./]?|[-*•·])").alias("lead"),
        where(x != F.lower(x), F.regexp_count(x, F.lit(r"(?:^|[^\p{L}'’])\p{Lu}[\p{Ll}'’]+")).cast("double") / some).alias("title"),
        F.least(F.lit(1.0), F.size(F.array_distinct(w)) / F.least(some, F.lit(10))).alias("varied"),
        # four different letters are found near the start of nearly every line
        where(~F.array_join(w, "").rlike(FOUR_LETTERS), F.size(F.array_distinct(F.split(F.array_join(w, ""), ""))).cast("double"), 4.0).alias("signs"),
        where(t.rlike(r"\S{19}"), F.array_max(F.transform(F.split(t, r"\s+"), lambda v: F.length(v))).cast("double"), 18.0).alias("longest"),
        where(x.rlike("[<&{Ãâï\ufffdÂ]"), flag(r"</?\p{L}+[^<>]*>|&#?\w+;|\{\S{1,40}:\S{1,60}[;}]|Ã.|â€|ï¿½|\x{FFFD}|Â ")).alias("broken"),
        flag(r"^[\p{L}\p{N}.'’]++(?: [\p{L}\p{N}.'’]++){0,2} ?(?::|->|=>|=|–|—|→| - )\s").alias("keyed"),
        (_number(x, ",") / some).alias("commas"),
        where(holds(":"), flag(r"\b\d{1,2}:\d{2}\b")).alias("clock"),
        where(holds("://", "www."), flag(r"\b\w{1,20}://|www\.")).alias("links"),
        ((x.contains("[") & x.rlike(HEADER)) | chords | syllables).cast("double").alias("sung"),
    ]


# ---------------------------------------------------------------- labelled documents


class _Maker:
    """Labelled documents of invented words: (line, 1 for list, table or junk)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syl = [c + v for c in ("b", "br", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "z") for v in ("a", "e", "i", "o", "u", "ei", "ou")]
        self.nouns = ["".join(self.r.choice(syl) for _ in range(self.r.choice((1, 2, 2, 3)))) + self.r.choice(("", "n", "r", "s", "t", "l")) for _ in range(1500)]

    def noun(self) -> str:
        return self.r.choice(self.nouns)

    def sentence(self, lang: str, lo: int, hi: int) -> str:
        r, f = self.r, FUNCTION_WORDS[lang]
        noun = (lambda: self.noun().capitalize() if r.random() < 0.7 else self.noun()) if lang == "de" else self.noun
        w = [r.choice(f) if r.random() < 0.42 else noun() for _ in range(r.randint(lo, hi))]
        if not any(v in f for v in w) or r.random() < 0.5:
            w[r.randrange(len(w))] = r.choice(f)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            k = r.randrange(len(w))
            w[k] += "," if not w[k].endswith(",") else ""
        s = " ".join(w).rstrip(",")
        if r.random() < 0.25:
            k = r.randrange(len(s))
            s = s[:k] + r.choice("aeiou'") + s[k:]
        return s

    def verse(self) -> list[tuple[str, int]]:
        r, lang = self.r, self.r.choice(list(FUNCTION_WORDS))
        style = r.choice(("low", "low", "cap", "up"))
        end, mark = r.choice(("", "", ",", ".", "...", ";", "!")), r.choice(("", "", "", "", "> ", "- ", "• ", "1", "2"))
        if r.random() < 0.12:
            s = r.choice((" ", ". ", ", ")).join(self.sentence(lang, 4, 9) for _ in range(r.randint(8, 30)))
            return [(s.upper() if style == "up" else s, 0)]
        out = []
        for k in range(r.randint(6, 36)):
            s = self.sentence(lang, 4, 10)
            s = s.upper() if style == "up" else s[:1].upper() + s[1:] if style == "cap" else s
            out.append(((f"{k + 1}. " if mark == "1" else f"{k + 1}  " if mark == "2" else mark) + s + end + (r.choice((" (oh yeah)", " (hey!)")) if r.random() < 0.05 else ""), 0))
        return out

    def prose(self) -> list[tuple[str, int]]:
        r, lang = self.r, self.r.choice(list(FUNCTION_WORDS))
        line = lambda: " ".join(s[:1].upper() + s[1:] + "." for s in (self.sentence(lang, 6, 15) for _ in range(r.randint(1, 6))))
        return [(line(), 0) for _ in range(r.randint(1, 8))]

    def name(self, n: int = 2, art: str = "") -> str:
        w = [self.noun() for _ in range(n)]
        if art and n > 1:
            w[-1:] = [art.strip(), w[-1]]
        return " ".join(v.capitalize() for v in w)

    def odd(self) -> list[tuple[str, int]]:
        r = self.r
        art = r.choice(("", "", "", *(f"{a} " for a in ("la", "le", "der", "die", "il", "o", "el", "un"))))
        item = lambda: r.choice((art + self.noun(), self.name(r.choice((1, 2, 2, 3)), art), f"{r.randint(1, 9)} x {art}{self.noun()}"))
        time = lambda: f"{r.randint(0, 9)}:{r.randint(0, 59):02d}"
        sep, mark = r.choice(("\t", ";", " | ", "|", "   ", " || ", ",")), r.choice(("- ", "* ", "• ", "+ ", "· ", "-> ", "# "))
        hexes = lambda: " ".join(f"{r.getrandbits(32):08x}" for _ in range(r.randint(2, 8)))
        chars = lambda a, lo, hi: "".join(r.choice(a) for _ in range(r.randint(lo, hi)))
        phrase = " ".join(self.noun() for _ in range(r.choice((1, 1, 2, 3, 4))))
        letter, role = r.choice("abcdefghijklmnopqrstuvwxyz"), [self.noun() for _ in range(6)]
        b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        chord = lambda: r.choice("CDEFGAB") + r.choice(("", "", "m", "7"))
        junk = [
            hexes, lambda: chars(b64, 40, 70), lambda: chars("0123456789,./: ", 12, 60), lambda: chars("abcdefghijklmnopqrstuvwxyz,;", 15, 60), lambda: r.choice("-=~#*._") * r.randint(8, 60),
            lambda: " ".join(r.choice(("Ã©Â", "ï¿½", "â€™", "Ã¼", "��", "Ã±Ã³")) for _ in range(r.randint(3, 15))), lambda: " ".join(r.choice(("!!!", "???", "%%", "@@", "^^", "♪♪", "<3", "☆")) for _ in range(r.randint(4, 15))),
            lambda: f'<{r.choice(("td", "div", "li"))} class="{self.noun()}">&nbsp;&#{r.randint(100, 9999)};</{r.choice(("td", "div", "li"))}>', lambda: f'{{{self.noun()}:{r.randint(1, 999)};{self.noun()}:"{r.getrandbits(40):x}"}}', lambda: " ".join(f"http://{self.noun()}.invalid/{self.noun()}" for _ in range(r.randint(1, 3))),
        ]
        kinds = [
            *([lambda k: mark + item()] * 4), lambda k: f"{k + 1}. {item()}", lambda k: f"{k + 1}) {self.name(2, art)}", lambda k: f"{chr(97 + k % 26)}) {self.name(2, art)}", lambda k: item(), lambda k: self.name(2, art) + f" ({time()})",
            lambda k: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}. {self.name(1)}, {self.name(2, art)}", lambda k: f"{r.choice(role)}: {self.name(2, art)}", lambda k: f"{self.noun()} {r.choice(('->', '=', '–'))} {art}{self.noun()}",
            lambda k: sep.join((str(k + 1), self.name(r.choice((2, 3)), art), time(), str(r.randint(60, 190)), chord())), lambda k: f"| {k + 1} | {self.name(2, art)} | {time()} | {r.randint(60, 190)} |", lambda k: f"{self.name(2, art)}{sep if sep != ',' else ' || '}{time()}{sep}{self.name(2, art)}",
            lambda k: " ".join(f"{r.randint(1, 99999):7d}" for _ in range(6)), lambda k: f"{k + 1:<4}{self.name():<28}{time()}{r.randint(50, 190):6d}", lambda k: "  ".join(r.choice((chord(), chord(), "%", "x")) for _ in range(4)) + f"  | {art}{self.noun()}",
            lambda k: r.choice("eBGDAE") + "|" + chars("-----0123457h", 25, 45) + "|", *([lambda k: ", ".join(art + self.noun() for _ in range(r.randint(4, 12)))] * 4), lambda k: " ".join([phrase] * max(3, r.randint(5, 14) // len(phrase.split()))),
            lambda k: " ".join([letter * r.randint(3, 12)] * r.randint(2, 6)), *([lambda k: r.choice(junk)()] * 5),
        ]
        make = r.choice(kinds)
        if r.random() < 0.05:
            return [(phrase, 1)] * r.randint(12, 30)
        return [(make(k), 1) for k in range(r.randint(8, 34))]

    def document(self) -> list[tuple[str, int]]:
        r = self.r
        kind = r.random()
        if kind < 0.45:
            return self.verse()
        if kind < 0.55:
            return self.prose()
        odd = self.odd()
        if kind < 0.7:
            some = self.verse()[: r.randint(2, 6)]
            return some + odd if r.random() < 0.5 else odd + some
        return odd


def labelled_lines(seed: int = 5, docs: int = TRAINING_DOCS) -> list[tuple[int, str, int]]:
    """(document, line, label) of ``docs`` invented documents."""
    m = _Maker(seed)
    return [(d, line, y) for d in range(docs) for line, y in m.document()]


# ---------------------------------------------------------------- rule induction

Rule = list[tuple[int, str, float]]  # (statistic, "<=" or ">", threshold), all of which must hold


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, op, t in rule:
        ok &= x[:, f] <= t if op == "<=" else x[:, f] > t
    return ok


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], orders: list[np.ndarray], ok: np.ndarray) -> Rule:
    """Add the condition of the most FOIL gain until no negative is covered, among the rows marked ``ok``; ``orders`` sorts each statistic."""
    rule: Rule = []
    while len(rule) < 10:
        p, n = y[ok].sum(), (1 - y[ok]).sum()
        if n == 0 or p == 0:
            break
        base, best = np.log2(p / (p + n)), (0.0, None)
        for f, cs in enumerate(cuts):
            if not len(cs):
                continue
            o = orders[f][ok[orders[f]]]
            vs, pos = x[o, f], np.cumsum(np.append(0, y[o]))
            at = np.searchsorted(vs, cs, side="right")
            for op, pc, all_ in (("<=", pos[at], at), (">", p - pos[at], len(vs) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pc > 0, pc * (np.log2(pc / np.maximum(all_, 1)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], (f, op, float(cs[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        ok = ok & _covers([best[1]], x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, slack: float = 0.02) -> tuple[Rule, float]:
    """Cut final conditions: the shortest rule whose (p - n) / (p + n) on the pruning set is within ``slack`` of the best."""
    worths = []
    for k in range(1, len(rule) + 1):
        c = _covers(rule[:k], x)
        p, n = y[c].sum(), (1 - y[c]).sum()
        worths.append((p - n) / (p + n) if p + n else -1.0)
    k = next(i for i, v in enumerate(worths) if v >= max(worths) - slack)
    return rule[: k + 1], worths[k]


def irep(x: np.ndarray, y: np.ndarray, group: np.ndarray, seed: int = 1, most: int = 80, worth: float = 0.95) -> list[Rule]:
    """Rules for label 1, in order. ``group`` (the document) is never split between growing and pruning.

    Ends when a pruned rule's worth on the pruning set is below ``worth`` or it covers under 5 lines there.
    """
    rng, left, rules, misses = np.random.default_rng(seed), np.ones(len(x), bool), [], 0
    cuts, orders = [], [np.argsort(x[:, f], kind="stable") for f in range(x.shape[1])]
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mids = (v[1:] + v[:-1]) / 2
        cuts.append(mids if len(mids) <= 40 else np.unique(np.quantile(mids, np.linspace(0, 1, 40))))
    while y[left].sum() and len(rules) < most and misses < MOST_MISSES:
        docs = np.unique(group[left])
        growing = np.isin(group, rng.permutation(docs)[: len(docs) * 2 // 3])
        g, p = left & growing, left & ~growing
        # after a miss another half of the statistics is tried, or greed would end in the same rule
        some = set(rng.permutation(len(cuts))[: len(cuts) // 2 + 1]) if misses else set(range(len(cuts)))
        rule = _grow(x, y, [c if f in some else c[:0] for f, c in enumerate(cuts)], orders, g)
        rule, value = _prune(rule, x[p], y[p]) if rule else (rule, -1)
        covered = _covers(rule, x) if rule else np.zeros(len(x), bool)
        if value < worth or (covered & p & (y == 1)).sum() < 5:
            misses += 1
            continue
        misses = 0
        rules.append(rule)
        left &= ~covered
    return rules


def case_expression(rules: list[Rule], names: tuple[str, ...] = RULE_NAMES, exceptions: tuple[str, ...] = EXCEPTIONS) -> str:
    """The ordered rules as one SQL CASE: 0 where an exception holds, 1 where a rule holds, else 0."""
    whens = [f"WHEN {e} THEN 0" for e in exceptions]
    whens += ["WHEN " + " AND ".join(f"`{names[f]}` {op} {t!r}D" for f, op, t in rule) + " THEN 1" for rule in rules]
    return "CASE " + " ".join(whens) + " ELSE 0 END" if whens else "0"


_WHEN = re.compile(r"WHEN (.*?) THEN ([01])(?= WHEN | ELSE )")
_TEST = re.compile(r"`(\w+)` (<=|>) (\S+)D")


def case_column(rule: str, stats: dict[str, Column]) -> Column:
    """A CASE as ``case_expression`` writes it, over given columns.

    Exceptions that stand first are tested last, on lines that a rule has taken: the result is the
    same, and few lines get there. Raises ``ValueError`` for SQL of another form.
    """
    whens = [(w, int(v)) for w, v in _WHEN.findall(rule)]
    tests = [[_TEST.fullmatch(c) for c in w.split(" AND ")] for w, _ in whens]
    if case_expression([], exceptions=()) != rule and ("CASE " + " ".join(f"WHEN {w} THEN {v}" for w, v in whens) + " ELSE 0 END" != rule or not all(all(t) for t in tests)):
        raise ValueError("not a list of rules")
    holds = [reduce(lambda a, b: a & b, [stats[t[1]] <= float(t[3]) if t[2] == "<=" else stats[t[1]] > float(t[3]) for t in ts]) for ts in tests]
    first = next((i for i, (_, v) in enumerate(whens) if v), len(whens))
    if any(not v for _, v in whens[first:]):
        raise ValueError("not a list of rules")
    if first == len(whens):
        return F.lit(0)
    taken = F.when(holds[first], True)
    for h in holds[first + 1 :]:
        taken = taken.when(h, True)
    out = taken.otherwise(False)
    for h in holds[:first]:
        out = out & ~h
    return out.cast("int")


def _with_words(df: DataFrame) -> DataFrame:
    """Adds ``w`` and ``letters_n`` of ``line``."""
    return df.withColumn("w", F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}+"), F.lit(0))).withColumn("letters_n", F.length(F.array_join("w", "")))


def exploded_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``d, line, w, letters_n, distinct_lines, doc_varied``: the non-blank lines of every record."""
    t = df.select(F.col(doc).cast("bigint").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null")
    lines = F.filter(F.split(_drop(F.col("t"), "\r"), "\n"), lambda x: x.rlike(r"[^\s\p{Z}]"))
    t = t.select("d", lines.alias("lines")).where("size(lines) > 0")
    t = t.select("d", (F.size(F.array_distinct("lines")) / F.size("lines")).alias("distinct_lines"), F.explode("lines").alias("line"))
    return _with_words(t.withColumn("doc_varied", F.least(F.lit(0.5), "distinct_lines")))


def _induced(lines: DataFrame, seed: int) -> str:
    """The CASE induced on ``i, d, line, y, doc_varied``."""
    got = _with_words(lines).select("i", "d", "y", *line_stats(), "doc_varied").toPandas().sort_values("i")
    return case_expression(irep(got[list(RULE_NAMES)].to_numpy(float), got["y"].to_numpy(int), got["d"].to_numpy(), seed))


def learned_case(labelled: DataFrame, text: str = "text", label: str = "label", most: int = MOST_LABELLED, seed: int = 5) -> str:
    """The CASE expression induced on labelled documents.

    ``label`` is 1 (or true) for documents that are not natural text; their lines take it over, so
    documents of one kind teach best (a line may stand as a document of its own). At most ``most``
    documents are used, by a seeded hash of their text. Null labels and texts don't count; without
    both labels no rule comes out. Extra columns aren't read.
    """
    some = labelled.select(F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y")).where("t is not null and y is not null").orderBy(F.xxhash64("t", F.lit(seed)), "t", "y").limit(most).toPandas()
    spark = labelled.sparkSession
    docs = spark.createDataFrame(some.assign(d=np.arange(len(some))), "t string, y int, d bigint")
    lines = exploded_lines(docs, "d", "t").join(docs.select("d", "y"), "d").select("d", "line", "y", "doc_varied")
    return _induced(lines.withColumn("i", F.row_number().over(Window.orderBy("d", "line"))), seed)  # at most ``most`` documents


@lru_cache(maxsize=4)
def _default_case(session: str, seed: int) -> str:
    rows = labelled_lines(seed)
    texts: dict[int, list[str]] = {}
    for d, line, _ in rows:
        texts.setdefault(d, []).append(line)
    varied = {d: min(0.5, len(set(v)) / len(v)) for d, v in texts.items()}
    pdf = pd.DataFrame([(i, d, line, y, varied[d]) for i, (d, line, y) in enumerate(rows)], columns=["i", "d", "line", "y", "doc_varied"])
    return _induced(SparkSession.getActiveSession().createDataFrame(pdf, "i bigint, d bigint, line string, y int, doc_varied double"), seed)


def default_case(spark: SparkSession, seed: int = 5) -> str:
    """The CASE expression induced on ``TRAINING_DOCS`` documents that this module invents, where no labels are at hand."""
    return _default_case(spark.sparkContext.applicationId, seed)


def record_statistics(df: DataFrame, doc: str = "doc_id", text: str = "text", rule: str | None = None) -> DataFrame:
    """Statistics of every record, and ``odd_share``, the share of lines that are list, table or junk.

    Section headers, chord lines and sung syllables count as lines of verse. Records without a
    visible line get zeros and ``odd_share`` 0. Null ids are left out; a repeated id adds up its
    rows. Extra columns aren't read. ``rule``: the CASE expression (``learned_case`` of labelled
    documents; default: ``default_case``).
    """
    rule = rule or default_case(df.sparkSession)
    stats = dict(zip(LINE_STATS, line_stats()))
    try:
        later = {k: v for k, v in stats.items() if k not in EAGER}
        odd = case_column(rule, {**{k: F.col(k) for k in (*EAGER, "doc_varied")}, **later})
        now = [stats[k] for k in EAGER]
    except ValueError:  # a rule in other SQL
        odd, now = F.expr(rule), list(stats.values())
    lines = exploded_lines(df, doc, text).select("d", "line", "w", "letters_n", *now, "distinct_lines", "doc_varied")
    n = F.col("words")
    per = lines.groupBy("d").agg(
        F.count("*").alias("n_lines"), F.sum(n).cast("bigint").alias("n_words"), F.sum("letters_n").alias("_letters"), F.sum(F.regexp_count("line", F.lit(r"[^\p{L}\p{N}\s\p{Z}]"))).alias("_symbols"),
        F.sum(F.length(_drop(F.col("line"), " ", "\t", "\u00a0"))).alias("_visible"), F.avg(F.col("line").rlike(r"[.,;:!?…]['\"»)]*\s*$").cast("double")).alias("ended_share"), F.sum(F.col("common") * n).alias("_common"),
        F.max("distinct_lines").alias("distinct_lines"), F.avg(odd.cast("double")).alias("odd_share"),
    )
    every = df.select(F.col(doc).cast("bigint").alias("d")).where("d is not null").distinct()
    zero = lambda c, a: F.coalesce(c, F.lit(0)).cast(a)
    return every.join(per, "d", "left").select(
        F.col("d").alias("doc_id"), zero(F.col("n_lines"), "bigint").alias("n_lines"), zero(F.col("n_words"), "bigint").alias("n_words"), zero(F.try_divide("_letters", "n_words"), "double").alias("mean_word_length"),
        zero(F.try_divide("_symbols", "_visible"), "double").alias("symbol_ratio"), zero(F.col("ended_share"), "double").alias("ended_share"), zero(F.try_divide("_common", "n_words"), "double").alias("common_share"),
        zero(F.col("distinct_lines"), "double").alias("distinct_lines"), zero(F.col("odd_share"), "double").alias("odd_share"),
    )


def unnatural(stats: DataFrame) -> DataFrame:
    """Records that are not natural text."""
    return stats.where("odd_share > 0.5")


def token_statistics(tokens: DataFrame, stopwords: DataFrame, doc: str = "doc_id", col: str = "tokens", most_stopwords: int = 10_000) -> DataFrame:
    """``doc_id, n_tokens, mean_length, distinct_share, stop_share`` of token lists.

    A record's rows count once (the least list stays); null lists count as empty, empty lists give
    zeros, null ids are left out. The stopword list is read whole and refused above ``most_stopwords``.
    """
    stop = [r[0] for r in stopwords.select("term").where("term is not null").distinct().limit(most_stopwords + 1).collect()]
    if len(stop) > most_stopwords:
        raise ValueError(f"more than {most_stopwords} stopwords")
    t = F.col("t")
    rows = tokens.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.col(col), F.array().cast("array<string>")).alias("t")).where("doc_id is not null").groupBy("doc_id").agg(F.min("t").alias("t"))
    n = F.size(t)
    share = lambda x: F.round(F.coalesce(F.try_divide(x.cast("double"), n.cast("double")), F.lit(0.0)), 6)
    return rows.select(
        "doc_id", n.cast("bigint").alias("n_tokens"), share(F.length(F.array_join(t, ""))).alias("mean_length"), share(F.size(F.array_distinct(t))).alias("distinct_share"),
        share(F.size(F.filter(t, lambda x: x.isin(*stop)))).alias("stop_share"),
    )
