import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.functions.vectors import norm, unit
from stanzaflow.operators import corpus as C

TOKENS = {
    "Don't stop-it!? --": ["don", "t", "stop", "-", "it", "--"],
    "café x": ["x"],
    "café x": ["cafe", "x"],
    "a_b c1 D": ["d"],
    "": [],
}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_golden_tokens(spark):
    got = {r["doc_id"]: r["tokens"] for r in C.tokens(frame(spark, list(TOKENS))).collect()}
    assert got == dict(enumerate(TOKENS.values()))


def test_null_text_has_no_tokens(spark):
    assert C.tokens(frame(spark, [None])).first()["tokens"] == []


def test_ngrams(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "doc_id bigint, tokens array<string>")
    two = {r[0]: r[1] for r in C.ngrams(df, "bigram").collect()}
    assert two == {1: ["<s>_a", "a_b", "b_c", "c_</s>"], 2: ["<s>_</s>"]}
    three = {r[0]: r[1] for r in C.ngrams(df, "other").collect()}
    assert three == {1: ["<s>_<s>_a", "<s>_a_b", "a_b_c", "b_c_</s>", "c_</s>_</s>"], 2: ["<s>_<s>_</s>", "<s>_</s>_</s>"]}
    assert {r[0]: r[1] for r in C.ngrams(df).collect()} == {1: ["a", "b", "c"], 2: []}


def python_tokens(t):
    return [w for w in re.findall(r"\w+|[^\w\s]+", t.lower()) if set(w) <= set("abcdefghijklmnopqrstuvwxyz -")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="İ\x00", exclude_categories=["Cs", "Cn"]), max_size=60), min_size=1, max_size=30))
def test_tokens_equal_python(spark, texts):
    texts = [t for t in texts if t.lower() == unicodedata.normalize("NFC", t).lower()] or ["x"]
    got = [r["tokens"] for r in C.tokens(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [python_tokens(t) for t in texts]


def test_lemmas_then_stopwords(spark):
    toks = C.tokens(frame(spark, ["was the nights", "the", None]))
    lem = spark.createDataFrame([("was", "wa"), ("nights", "night")], "term string, lemma string")
    stop = spark.createDataFrame([("the",), ("was",)], "term string")
    out = C.drop_stopwords(C.lemmatize(toks, lem), stop)
    assert {r[0]: r[1] for r in out.collect()} == {0: ["wa", "night"], 1: [], 2: []}


def test_prune_and_bow(spark):
    toks = spark.createDataFrame([(i, ["all", f"t{i % 2}"] + (["once"] if i == 0 else [])) for i in range(6)], "doc_id bigint, tokens array<string>")
    vocab = C.prune_vocab(C.document_frequency(toks), 6, 2, 0.5)
    assert [(r["term"], r["term_id"]) for r in vocab.orderBy("term").collect()] == [("t0", 0), ("t1", 1)]
    assert C.bag_of_words(toks, vocab).count() == 6
    assert [r["term"] for r in C.prune_vocab(C.document_frequency(toks), 6, 1, 1.0, keep_n=1).collect()] == ["all"]


def test_preprocess_units(spark):
    docs = frame(spark, ["a b", "a c", "a b"])
    c = C.preprocess(docs, C.CorpusConfig(unit="bigram", no_below=2, no_above=0.7))
    assert {r["term"] for r in c.vocab.collect()} == {"a_b", "b_</s>"}


def test_norms(spark):
    v = F.array(F.lit(3.0), F.lit(-4.0), F.lit(0.0))
    row = spark.range(1).select(norm(v).alias("two"), norm(v, 1).alias("one"), norm(v, 0).alias("zero"), norm(v, float("inf")).alias("inf"), norm(v, float("-inf")).alias("low"), norm(v, 3).alias("three"), unit(v).alias("u"), unit(F.array(F.lit(0.0))).alias("z")).first()
    assert (row["two"], row["one"], row["zero"], row["inf"], row["low"]) == (5.0, 7.0, 2.0, 4.0, 0.0)
    assert abs(row["three"] - 91 ** (1 / 3)) < 1e-9
    assert row["u"] == [0.6, -0.8, 0.0] and row["z"] == [0.0]


def test_count_tokens_knows_unicode_space(spark):
    row = frame(spark, ["a b, c"]).select(T.count_tokens(F.col("text")).alias("n")).first()
    assert row["n"] == len(re.findall(r"\w+|[^\w\s]+", "a b, c"))
