import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzaflow.llm import quality as Q

SCHEMA = "doc_id bigint, text string"
VERSE = "I know that you follow the golden road\nand the night is calling for me again\nso take my hand before the morning comes\nwe were dancing in the rain for a while"


@pytest.fixture(scope="module")
def rule(spark):
    return Q.default_case(spark)


def shares(spark, rule, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA + ", words int, line string")
    return {r["doc_id"]: r for r in Q.record_statistics(df, rule=rule).collect()}


def test_verse_stays(spark, rule):
    texts = [VERSE, VERSE.upper(), "\n".join("> " + x for x in VERSE.splitlines()), "\n".join(f"{i}. {x}" for i, x in enumerate(VERSE.splitlines())), VERSE.replace("\n", " "), "\n".join(f"{x}\nAm   G   C   F" for x in VERSE.splitlines()), "[Chorus]\nla la la\nna na na, hey hey\n" + VERSE, (VERSE + "\n\n") * 4]
    assert [i for i, r in shares(spark, rule, texts).items() if r["odd_share"] > 0.5] == []


def test_lists_tables_and_junk_go(spark, rule):
    texts = [
        "\n".join(f"- {w}" for w in "river station candle mirror harbor".split()), "\n".join(f"| {i} | Golden Road | 3:4{i} |" for i in range(6)), "\n".join("4f3a9b21 77c0d1e2 90ab12cd" for _ in range(5)), "\n".join(["free free free free free free free free"] * 6),
        "\n".join(f"{i}\tLonely Street\t2:1{i}\t120" for i in range(8)), '<td class="a">&nbsp;&#1234;</td>\n' * 5, "ssss ssss ssss\nsssss sssss\nsss sss sss", "drums: Mira Kolen\nbass: Tove Lund\nmix: Ola Brand", VERSE.splitlines()[0] + "\n" + "\n".join(f"{k}) Silent Window" for k in "abcdef"),
    ]
    assert [i for i, r in shares(spark, rule, texts).items() if r["odd_share"] <= 0.5] == []


def test_statistics_and_dirt(spark, rule):
    got = shares(spark, rule, ["Ab cd.\nThe x!", "", None, " \n\t", "a" * 200_000])
    r = got[0]
    assert (r["n_lines"], r["n_words"], r["mean_word_length"], r["ended_share"], r["common_share"]) == (2, 4, 2.0, 1.0, 0.25)
    assert abs(r["symbol_ratio"] - 2 / 10) < 1e-9 and r["distinct_lines"] == 1.0
    assert all(got[i]["n_lines"] == 0 and got[i]["odd_share"] == 0 for i in (1, 2, 3)) and got[4]["n_words"] == 1
    assert Q.record_statistics(spark.createDataFrame([], SCHEMA), rule=rule).count() == 0
    assert Q.record_statistics(spark.createDataFrame([(None, "x")], SCHEMA), rule=rule).count() == 0


def test_held_out_accuracy(spark, rule):
    rows = Q.labelled_lines(seed=99, docs=200)
    texts, truth = {}, {}
    for d, line, y in rows:
        texts.setdefault(d, []).append(line), truth.setdefault(d, []).append(y)
    got = shares(spark, rule, ["\n".join(texts[d]) for d in sorted(texts)])
    right = sum((got[i]["odd_share"] > 0.5) == (np.mean(truth[d]) > 0.5) for i, d in enumerate(sorted(texts)))
    assert right >= 0.97 * len(texts)


def test_rules_in_plain_python():
    r = np.random.default_rng(0)
    x = r.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.7) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))).astype(int)
    rules = Q.irep(x, y, np.arange(4000) // 10, worth=0.9)
    hit = np.any([Q._covers(k, x) for k in rules], axis=0)
    assert (hit == y).mean() > 0.95
    assert Q.case_expression([[(0, "<=", 1.5), (1, ">", 2.0)]], ("a", "b"), ("`c` > 0",)) == "CASE WHEN `c` > 0 THEN 0 WHEN `a` <= 1.5D AND `b` > 2.0D THEN 1 ELSE 0 END"
    assert Q.case_expression([], exceptions=()) == "0" and Q.irep(x[:0], y[:0], y[:0]) == []


def test_case_column_equals_its_sql(spark, rule):
    rows = Q.labelled_lines(seed=77, docs=60)
    df = spark.createDataFrame([(d, "\n".join(t for e, t, _ in rows if e == d)) for d in range(60)] + [(99, VERSE + "\nAm  G C\nla la la\n[Chorus]\nA x")], SCHEMA)
    lines = Q.exploded_lines(df, "doc_id", "text").select("*", *Q.line_stats())
    got = lines.select(F.expr(rule).alias("sql"), Q.case_column(rule, {k: F.col(k) for k in Q.LINE_STATS}).alias("mine")).groupBy("sql", "mine").count().collect()
    assert {(r["sql"], r["mine"]) for r in got} == {(0, 0), (1, 1)}
    for other in ("CASE WHEN words > 3 THEN 1 ELSE 0 END", "1", "CASE WHEN `words` > 3.0D THEN 1 WHEN `words` > 1.0D THEN 0 ELSE 0 END"):
        with pytest.raises(ValueError):
            Q.case_column(other, {k: F.col(k) for k in Q.LINE_STATS})
        assert Q.record_statistics(df, rule=other).where("odd_share > 0").count() > 0


def test_rules_follow_the_given_labels(spark):
    """Texts that no generator made: once shouting is unnatural, once questions are."""
    r = np.random.default_rng(4)
    base = [w for t in VERSE.splitlines() for w in t.split()]
    line = lambda: " ".join(r.choice(base, 7))
    rows = [("\n".join(line().upper().title() if k == 0 else line().replace(" ", ", ") if k == 1 else line() for _ in range(6)), k) for k in (0, 1, 2) * 150]
    cases = []
    for odd in (0, 1):
        train = spark.createDataFrame([(t, k == odd, 0.0) for t, k in rows[:300]] + [(None, True, 0.0), ("x y", None, 0.0)], "text string, label boolean, words double")
        case = Q.learned_case(train)
        got = shares(spark, case, [t for t, _ in rows[300:]])
        right = sum((got[i]["odd_share"] > 0.5) == (k == odd) for i, (_, k) in enumerate(rows[300:]))
        assert right >= 0.98 * len(got)
        cases.append(case)
    assert cases[0] != cases[1] and "title" in cases[0] and "title" not in cases[1]
    assert "THEN 1" not in Q.learned_case(spark.createDataFrame([], "text string, label int"))


def test_signs_and_cheap_counts_agree_with_patterns(spark):
    lines = ["aaa bbb", "abab cd", "abc abc", "zzzz", "a", "", "a;b; c;", "x|y\tz", "ab ba bac d", "ééé ñ ü o"]
    df = Q._with_words(spark.createDataFrame([(t,) for t in lines], "line string"))
    got = {r["line"]: r for r in df.select("line", "w", *Q.line_stats()).collect()}
    for t in lines:
        letters = {c for c in t.lower() if c.isalpha()}
        assert got[t]["signs"] == min(4, max(len(letters), got[t]["signs"] if not letters else 0)), t
        some = max(1, got[t]["words"])
        assert got[t]["marks"] == sum(c in "|\t" or (c == ";" and i + 1 < len(t) and t[i + 1] != " ") for i, c in enumerate(t)) / some, t


def test_token_statistics(spark):
    t = spark.createDataFrame([(1, ["a", "bb", "a"]), (1, ["a", "bb", "a"]), (2, []), (3, None), (None, ["a"])], "doc_id bigint, tokens array<string>")
    s = spark.createDataFrame([("a",), (None,)], "term string")
    got = {r[0]: tuple(r)[1:] for r in Q.token_statistics(t, s).collect()}
    assert got == {1: (3, 1.333333, 0.666667, 0.666667), 2: (0, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0)}
