import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stanzaflow.operators import assemble, inventory, langfilter, lexical, lexicon, topics
from stanzaflow.operators import corpus as C
from stanzaflow.plans.extractors import Lexicon, LinguisticFeature
from stanzaflow.sources import readers


def toks(spark, *docs):
    return spark.createDataFrame([(i + 1, list(d)) for i, d in enumerate(docs)], "doc_id bigint, tokens array<string>")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def close(a, b):
    return a == b if a is None or b is None else abs(a - b) < 1e-9


LING = {1: (4, 3, 1, 0.5, 2.0, 0.75, 0.25, 0.125, 0.5), 2: (3, 3, 1, 0.5, 1.0, 1.0, 1 / 3, 1 / 6, 1 / 3), 3: (None, 0, 0, 0, 0, None, None, None, None)}


def test_linguistic_golden(spark):
    t = toks(spark, ["the", "cat", "the", "dog"], ["the", "cat", "-"], [])
    stop = spark.createDataFrame([("the",)], "term string")
    out = lexical.linguistic_features(t, stop)
    assert tuple(out.columns[1:]) == lexical.COLUMNS
    for i, r in by_id(out).items():
        assert all(close(r[c], w) for c, w in zip(lexical.COLUMNS, LING[i])), r
    assert lexical.drop_null_columns(out).columns == ["doc_id", "num_unique_words", "num_stop_words", "num_rare_words", "num_common_words"]
    assert LinguisticFeature(stop, drop_nulls=True).extract(C.Corpus(t, t, None, None)).columns[0] == "num_unique_words"


def test_linguistic_forms_agree(spark, monkeypatch):
    """Words sent to all, only the most frequent ones sent, stopwords joined: the same rows; repeated ids keep theirs."""
    rng = np.random.default_rng(2)
    docs = [[f"w{min(rng.integers(0, 40), rng.integers(0, 40))}" for _ in range(rng.integers(0, 30))] for _ in range(40)]
    t = toks(spark, *docs)
    t = t.union(t.where("doc_id <= 2"))
    stop = spark.createDataFrame([("w0",), ("w3",), ("w9",), (None,)], "term string")
    rows = lambda **kw: sorted(map(tuple, lexical.linguistic_features(t, stop, **kw).collect()), key=repr)
    want = rows()
    assert len(want) == 42 and rows(sent=3) == want
    monkeypatch.setattr(lexical, "LITERAL_WORDS", 1)
    assert rows() == want and rows(sent=3) == want


def test_linguistic_of_nothing(spark):
    stop = spark.createDataFrame([], "term string")
    assert lexical.linguistic_features(toks(spark).limit(0), stop).count() == 0
    assert lexical.linguistic_features(toks(spark, [], []), stop).first()["num_words"] is None


LEX = [("A", "love*", 0), ("A", "the", 1), ("A", "an", 2), ("A", "an", 3), ("B", "lov*", 4), ("B", "the", 5), ("C", "lovely", 6)]


def test_lexicon_golden(spark):
    c = lexicon.compile_lexicon(spark.createDataFrame(LEX, "category string, pattern string, ord int"))
    terms = spark.createDataFrame([(w,) for w in ("lovely", "lo", "lov", "the", "an")], "term string")
    assert {r[0]: r[1] for r in lexicon.match_terms(terms, c).collect()} == {"lovely": ["B"], "lov": ["B"], "the": ["A", "B"], "an": ["A", "A"]}
    t = toks(spark, ["lovely", "an", "an", "x"], [])
    got = by_id(lexicon.lexicon_counts(t, c, ["A", "B", "C"]))
    assert [tuple(got[i])[1:] for i in (1, 2)] == [(4, 1, 0), (0, 0, 0)]


def slow_match(word, entries):
    best = None
    for stem, wild, cats in entries:
        if wild and word.startswith(stem) and (best is None or len(stem) < len(best[0])):
            best = (stem, cats)
    if best:
        return best[1]
    return next((c for s, w, c in entries if not w and s == word), None)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab", max_size=3), st.booleans()), min_size=1, max_size=8, unique=True), st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12, unique=True))
def test_lexicon_equals_slow_matcher(spark, stems, words):
    entries = [(s, w, [f"c{i}"]) for i, (s, w) in enumerate(stems)]
    c = lexicon.compile_lexicon(spark.createDataFrame([(cats[0], s + ("*" if w else ""), i) for i, (s, w, cats) in enumerate(entries)], "category string, pattern string, ord int"))
    got = {r[0]: r[1] for r in lexicon.match_terms(spark.createDataFrame([(w,) for w in words], "term string"), c).collect()}
    assert got == {w: m for w in words if (m := slow_match(w, entries))}


def test_missing_lexicon(spark):
    assert not Lexicon(None).is_loaded
    with pytest.raises(ValueError):
        Lexicon(None).extract(None)


def test_inventory_golden(spark):
    words = inventory.unit_words(spark.createDataFrame([("x", [3.0, 0.0]), ("y", [0.0, 2.0]), ("z", [1.0, 1.0]), ("n", None)], "word string, v array<double>"))
    inv = readers.inventory(spark, {"P": ["x", "y"], "Q": ["z", "missing"], "R": ["missing"]})
    t = toks(spark, ["x", "x", "y", "oov"], [])
    got = by_id(inventory.inventory_scores(t, inv, words, 2))
    assert np.allclose(tuple(got[1])[1:], (0.5, 1 - math.sqrt(0.5), 1)) and tuple(got[2])[1:] == (1, 1, 1)
    assert np.allclose(tuple(by_id(inventory.inventory_scores(t, inv, words, 2, True))[1])[1:], (0.5, math.sqrt(0.5), 0))
    with pytest.raises(ValueError):
        readers.inventory(spark, {"a": "b"})


def corpus_of(spark, *docs):
    t = toks(spark, *docs)
    vocab = C.prune_vocab(C.document_frequency(t), len(docs), 1, 1.0)
    return t, vocab, C.bag_of_words(t, vocab)


DOCS = (["a", "a", "b"], ["a"], ["c", "d", "c"], ["d", "b", "e"], [])


def test_one_topic_is_the_unigram_model(spark):
    t, vocab, bow = corpus_of(spark, ["a", "a", "b"], ["a"])
    m = topics.fit(bow, t.select("doc_id"), vocab, 1, 2)
    assert np.allclose([r["be"][0] for r in m.beta.orderBy("term").collect()], [0.75, 0.25])
    assert abs(topics.perplexity(bow, m.theta, m.beta).first()[0] - math.exp(-(3 * math.log(0.75) + math.log(0.25)) / 4)) < 1e-6


def test_both_step_forms_agree(spark, monkeypatch):
    t, vocab, bow = corpus_of(spark, *DOCS)
    fast = topics.fit(bow, t.select("doc_id"), vocab, 3, 4, seed=2)
    monkeypatch.setattr(topics, "MOST_CELLS", 3)
    slow = topics.fit(bow, t.select("doc_id"), vocab, 3, 4, seed=2)
    fold_slow = topics.fold_in(bow, t.select("doc_id"), slow.beta, 3, 3, 1).orderBy("doc_id").collect()
    monkeypatch.undo()
    for a, b, key in ((fast.theta, slow.theta, "doc_id"), (fast.beta, slow.beta, "term")):
        x, y = (np.array([r[1] for r in d.orderBy(key).collect()]) for d in (a, b))
        assert np.allclose(x, y, atol=1e-9)
    fold = topics.fold_in(bow, t.select("doc_id"), fast.beta, 3, 3, 1).orderBy("doc_id").collect()
    assert np.allclose([r["th"] for r in fold], [r["th"] for r in fold_slow], atol=1e-9)
    th = np.array([r["th"] for r in fast.theta.orderBy("doc_id").collect()])
    assert np.allclose(th.sum(axis=1), [1, 1, 1, 1, 0]) and np.allclose(np.sum([r["be"] for r in fast.beta.collect()], axis=0), 1)


def test_likelihood_never_falls_after_the_first_step(spark):
    t, vocab, bow = corpus_of(spark, *DOCS)
    p = []
    for n in (1, 2, 4, 8):
        m = topics.fit(bow, t.select("doc_id"), vocab, 2, n)
        p.append(topics.perplexity(bow, m.theta, m.beta).first()[0])
    assert all(a >= b - 1e-9 for a, b in zip(p, p[1:]))


def test_top_terms_and_ties(spark):
    beta = spark.createDataFrame([("b", [0.5, 0.1]), ("a", [0.5, 0.9])], "term string, be array<double>")
    assert [(r["topic"], r["term"]) for r in topics.top_terms(beta, 1).orderBy("topic").collect()] == [(0, "a"), (1, "a")]
    th = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9])], "doc_id bigint, th array<double>")
    assert {r[0]: r[1] for r in topics.dominant_topic(th).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize(("n", "want"), [(10, 8), (7, 5), (1, 0), (0, 0)])
def test_exact_split(spark, n, want):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    out = assemble.exact_split(df)
    assert out.count() == n and out.where("is_train").count() == want


def test_non_englishness(spark):
    docs = spark.createDataFrame([(1, "The the cat dog 1 x2"), (2, ""), (3, None)], "doc_id bigint, text string")
    eng = spark.createDataFrame([("The",), ("cat",)], "term string")
    got = {r[0]: r[1] for r in langfilter.non_englishness(docs, eng).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    assert langfilter.total_non_englishness(langfilter.non_englishness(docs, eng)).first()[0] == 5


def test_english_filter(spark):
    en, xx = ["sun", "moon", "star", "sky"], ["zug", "mond", "stern", "nacht"]
    docs = spark.createDataFrame([(i, " ".join((en if i < 12 else xx)[(i + k) % 4] for k in range(3))) for i in range(18)], "doc_id bigint, text string")
    kept = langfilter.filter_english(docs, spark.createDataFrame([(w,) for w in en], "term string"), None, k=2, thresh=3, top_k_words=4, em_iters=15, preproc=False, seed=1)
    assert {r["doc_id"] for r in kept.collect()} == set(range(12))


def test_english_filter_by_its_defaults(spark):
    """20 topics, 30 steps, 15 of the 50 likeliest terms."""
    rng = np.random.default_rng(1)
    en, xx = [[f"{c}{a}{b}" for a in "bdfglmprst" for b in "aeiouyvz"] for c in ("en", "xx")]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(en if i < 80 else xx, 40))) for i in range(160)], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in langfilter.filter_english(docs, spark.createDataFrame([(w,) for w in en], "term string")).collect()}
    assert kept == set(range(80))


def test_last_row_of_a_repeated_id_stays(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "doc_id bigint, x double")
    b = spark.createDataFrame([(1, 4.0, 9), (2, 5.0, 1), (1, 6.0, 3), (2, None, 2)], "doc_id bigint, x double, at int").coalesce(1)
    last = lambda **kw: [tuple(r) for r in assemble.align({"a": a, "b": b}, **kw).select("doc_id", "b_x").orderBy("doc_id").collect()]
    assert last() == [(1, 6.0), (2, None)] and last(order="at") == [(1, 4.0), (2, None)]


def test_row_ranges(spark):
    c = spark.createDataFrame([(k, k % 3) for k in range(0, 500, 7)], "k bigint, n bigint")
    got = [tuple(r) for r in assemble.row_ranges(c, "k", "n", per_block=16).orderBy("k").collect()]
    at, want = 0, []
    for k in range(0, 500, 7):
        want.append((k, at, at + k % 3))
        at += k % 3
    assert got == want


def test_joins_without_broadcast_agree(spark, monkeypatch):
    t = toks(spark, ["the", "cats", "run"], ["cats"], [])
    lem, stop = spark.createDataFrame([("cats", "cat")], "term string, lemma string"), spark.createDataFrame([("the",)], "term string")
    rows = lambda: (sorted(map(str, C.lemmatize(t, lem).collect())), sorted(map(str, C.drop_stopwords(t, stop).collect())))
    want = rows()
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_align(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "doc_id bigint, x double")
    b = spark.createDataFrame([(2, 5.0), (1, 4.0), (3, 9.0)], "doc_id bigint, x double")
    assert [tuple(r) for r in assemble.align({"a": a, "b": b}).orderBy("doc_id").collect()] == [(1, 1.0, 4.0), (2, 2.0, 5.0)]
    with pytest.raises(KeyError):
        assemble.align({"b": b, "a": a})
    with pytest.raises(ValueError):
        assemble.align({})


def test_audio_zero_fill_and_map(spark):
    rows = spark.createDataFrame([("t1", "s1", 0), ("t2", "s0", 1), ("t2", "s2", 2), (None, "s3", 3)], "mxm string, msd string, line_no bigint")
    m = assemble.id_map(rows)
    assert {r[0]: r[1] for r in m.collect()} == {"t1": "s1", "t2": "s2"}
    docs = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "doc_id bigint, tid string")
    au = spark.createDataFrame([("s1", [1.0, 2.0])], "tid string, feature array<double>")
    out = {r["doc_id"]: r["feature"] for r in assemble.add_audio(docs, m, au, 2).collect()}
    assert out == {1: [1.0, 2.0], 2: [0.0, 0.0]}
    assert len(assemble.audio_columns()) == 240 and assemble.audio_columns()[0] == "mean_mfcc0"


def test_csr_both_ways(spark):
    data = spark.createDataFrame([(i, i % 3, i * 10) for i in range(5)], "pos bigint, index bigint, value bigint")
    rows = spark.createDataFrame([(0, "u0", 0, 2), (1, "u1", 2, 2), (2, "u2", 2, 5)], "row_no bigint, row_id string, start bigint, end bigint")
    cols = spark.createDataFrame([(k, f"i{k}") for k in range(3)], "col_no bigint, col_id string")
    long = assemble.csr_to_long(data, rows, cols)
    assert {tuple(r) for r in long.collect()} == {("u0", "i0", 0), ("u0", "i1", 10), ("u2", "i2", 20), ("u2", "i0", 30), ("u2", "i1", 40)}
    back = {r["row_id"]: list(zip(r["cols"], r["vals"])) for r in assemble.long_to_csr(long).collect()}
    assert back["u2"] == [("i0", 30), ("i1", 40), ("i2", 20)]


def test_matrix_cells_repeats_and_nulls(spark):
    e = spark.createDataFrame([("u", "t", 2, 1), ("u", "t", 2, 1), ("u", "t", 3, 2), ("u", "t", None, 3), (None, "t", 1, 1)], "row_id string, col_id string, value int, at int")
    assert [tuple(r) for r in assemble.matrix_cells(e).collect()] == [("u", "t", 5)]


def test_column_norms(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (2, [4.0, 0.0])], "id bigint, v array<double>")
    assert {r["id"]: r["u"] for r in assemble.normalize_columns(df, "id", "v", 2).collect()} == {1: [0.6, 0.0], 2: [0.8, 0.0]}
    assert assemble.normalize_columns(df, "id", "v", 2, order=1).where("id = 1").first()["u"] == [3 / 7, 0.0]
    for order, n in ((0, 2.0), (3, 91 ** (1 / 3)), (float("inf"), 4.0), (float("-inf"), 3.0)):
        assert abs(assemble.normalize_columns(df, "id", "v", 2, order=order).where("id = 1").first()["u"][0] - 3 / n) < 1e-12
    with pytest.raises(ValueError):
        assemble.normalize_columns(df, "id", "v", 2, order=-1)
    assert assemble.spread(df, "v", ["a", "b"]).columns == ["id", "a", "b"]
    assert F.lit(1) is not None
