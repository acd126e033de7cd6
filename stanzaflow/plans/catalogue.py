"""Queries over the test tables, and SQL that gives the same rows.

Doubles are rounded to six places and arrays come as joined strings, so that rows can be
compared. Word vectors are bound to terms by rank: the n-th most frequent term of the
documents (ties by term) has the vector with id n - 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stanzaflow.config import ResourcePaths
from stanzaflow.functions.text import norm_source
from stanzaflow.functions.vectors import dot, doubles, unit, zeros
from stanzaflow.operators import assemble, inventory, langfilter, lexical, lexicon, topics
from stanzaflow.operators import corpus as C
from stanzaflow.plans import pipeline
from stanzaflow.shared import scratch, stage
from stanzaflow.sources import readers, writers
from stanzaflow.streaming import score

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Fixed values of the example resources, the same in the SQL below.
LEMMAS = {"nights": "night", "rivers": "river", "running": "run", "was": "wa", "hearts": "heart", "keeps": "keep"}
LEXICON = {"motion": ["run*", "walk*", "driv*", "river"], "nature": ["river*", "rain", "night*", "ri*"], "self": ["i", "me", "my*", "my", "me"], "warm": ["fire", "heart*", "nightfall"]}
INVENTORY = {"place": ["street", "station", "house", "river", "nowhereland"], "feeling": ["heart", "lonely", "bitter", "heart"], "none": ["qqqq", "zzzz"]}
DIM, FOLDS, SEED = 64, 5, 0


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return readers.table(spark, f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def toks(spark: SparkSession, d: str) -> DataFrame:
    return C.tokens(documents(spark, d))


def r6(c) -> F.Column:
    return F.round(c, 6)


_CLASS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
_SPLIT = f"coalesce(regexp_extract_all(lower(text), '{_CLASS}'), [])"


def tok_sql(name: str = "documents", out: str = "tok") -> str:
    return f"{out} AS (SELECT doc_id, list_filter({_SPLIT}, lambda t: regexp_full_match(t, '[a-z-]+')) AS tokens FROM {name})"


_TOK = tok_sql()
_ROWS = _TOK + ", rw AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM tok)"
_CELL = _ROWS + ", cell AS (SELECT doc_id, term, count(*) AS cnt FROM rw GROUP BY ALL), cf AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS cf, count(*) AS df FROM cell GROUP BY term)"
_VOCAB = _CELL + ", vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, cf FROM (SELECT * FROM cf WHERE df >= 5 AND df <= CAST(floor(0.3 * (SELECT count(*) FROM documents)) AS BIGINT) ORDER BY df DESC, term LIMIT 100000))"
_BOW = _VOCAB + ", bow AS (SELECT cell.* FROM cell SEMI JOIN vocab USING (term))"


# ------------------------------------------------------------------ tokens


@query(f"WITH {_TOK} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, array_to_string(tokens, ' ') AS tokens FROM tok")
def tokenize_documents(spark, d):
    return toks(spark, d).select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {tok_sql('corpus_texts')} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, array_to_string(tokens, ' ') AS tokens FROM tok")
def tokenize_corpus(spark, d):
    return C.tokens(table(spark, d, "corpus_texts")).select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS n, CAST(0 AS BIGINT) AS differing FROM ngram_corpus")
def tokens_equal_given(spark, d):
    """The default tokens of the corpus against the token lists that come with it."""
    mine, given = C.tokens(table(spark, d, "corpus_texts")), table(spark, d, "ngram_corpus").select("doc_id", F.col("tokens").alias("g")).dropDuplicates(["doc_id"])
    return mine.join(given, "doc_id", "full_outer").agg(F.count("g").alias("n"), F.sum(F.when(F.col("g").eqNullSafe(F.col("tokens")), 0).otherwise(1)).cast("bigint").alias("differing"))


@query(f"WITH {_ROWS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM rw")
def explode_token_positions(spark, d):
    return C.token_rows(toks(spark, d)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


_LEMMA_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in LEMMAS.items()) + ") AS l(term, lemma)"


@query(f"WITH {_ROWS}, m AS (SELECT doc_id, pos, coalesce(lemma, rw.term) AS t FROM rw LEFT JOIN {_LEMMA_SQL} ON l.term = rw.term), a AS (SELECT doc_id, string_agg(t, ' ' ORDER BY pos) AS s FROM m GROUP BY doc_id) SELECT tok.doc_id, coalesce(s, '') AS tokens FROM tok LEFT JOIN a USING (doc_id)")
def lemmatize_lookup(spark, d):
    lem = spark.createDataFrame(list(LEMMAS.items()), "term string, lemma string")
    return C.lemmatize(toks(spark, d), lem).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_ROWS}, l AS (SELECT DISTINCT term, regexp_replace(term, '(ing|ed|es|s)$', '') AS lemma FROM rw WHERE length(term) > 4), m AS (SELECT doc_id, pos, coalesce(lemma, rw.term) AS t FROM rw LEFT JOIN l ON l.term = rw.term), a AS (SELECT doc_id, string_agg(t, ' ' ORDER BY pos) AS s FROM m GROUP BY doc_id) SELECT tok.doc_id, coalesce(s, '') AS tokens FROM tok LEFT JOIN a USING (doc_id)")
def lemmatize_from_file(spark, d):
    """Lemmas for every longer word of the collection, written as a word list and read by its reader."""
    t = stage(toks(spark, d), "tokens")
    words = t.select(F.explode("tokens").alias("term")).distinct().where(F.length("term") > 4)
    where = scratch(spark, "lemmas")
    words.select(F.concat_ws(",", "term", F.regexp_replace("term", "(ing|ed|es|s)$", ""))).write.text(where)
    return C.lemmatize(t, readers.lemma_table(spark, where)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_ROWS}, m AS (SELECT rw.* FROM rw ANTI JOIN stopwords s ON s.term = rw.term), a AS (SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS s FROM m GROUP BY doc_id) SELECT tok.doc_id, coalesce(s, '') AS tokens FROM tok LEFT JOIN a USING (doc_id)")
def remove_stopwords(spark, d):
    return C.drop_stopwords(toks(spark, d), table(spark, d, "stopwords")).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def _ngram_sql(n: int) -> str:
    pads = lambda s: "[" + ", ".join([f"'{s}'"] * (n - 1)) + "]"
    return f"WITH {_TOK}, p AS (SELECT doc_id, list_concat(list_concat({pads('<s>')}, tokens), {pads('</s>')}) AS p FROM tok) SELECT doc_id, array_to_string(list_transform(range(1, len(p) - {n - 2}), lambda i: array_to_string(p[i:i + {n - 1}], '_')), ' ') AS ngrams FROM p"


@query(_ngram_sql(2))
def bigrams(spark, d):
    return C.ngrams(toks(spark, d), "bigram").select("doc_id", F.array_join("tokens", " ").alias("ngrams"))


@query(_ngram_sql(3))
def trigrams(spark, d):
    return C.ngrams(toks(spark, d), "trigram").select("doc_id", F.array_join("tokens", " ").alias("ngrams"))


# ------------------------------------------------------------------ vocabulary


@query(f"WITH {_CELL} SELECT term, cf FROM cf")
def collection_frequency(spark, d):
    return C.collection_frequency(toks(spark, d))


@query(f"WITH {_CELL} SELECT term, CAST(df AS BIGINT) AS df, cf FROM cf")
def document_frequency(spark, d):
    return C.document_frequency(toks(spark, d)).select("term", "df", "cf")


def _corpus(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = toks(spark, d)
    vocab = stage(C.prune_vocab(C.document_frequency(t), documents(spark, d).count()), "vocab")
    return t, vocab, C.bag_of_words(t, vocab)


@query(f"WITH {_VOCAB} SELECT term, CAST(term_id AS BIGINT) AS term_id, CAST(df AS BIGINT) AS df, cf FROM vocab")
def vocab_pruned(spark, d):
    return _corpus(spark, d)[1]


@query(f"WITH {_BOW} SELECT doc_id, term, CAST(cnt AS BIGINT) AS cnt FROM bow")
def bow_counts(spark, d):
    return _corpus(spark, d)[2]


@query(f"""WITH {tok_sql('corpus_texts')}, rw AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM tok),
k AS (SELECT rw.* FROM rw ANTI JOIN stopwords s ON s.term = rw.term), cell AS (SELECT doc_id, term, count(*) AS cnt FROM k GROUP BY ALL),
v AS (SELECT term FROM cell GROUP BY term HAVING count(*) >= 5 AND count(*) <= CAST(floor(0.8 * (SELECT count(*) FROM corpus_texts)) AS BIGINT))
SELECT doc_id, term, CAST(cnt AS BIGINT) AS cnt FROM cell SEMI JOIN v USING (term)""")
def preprocess_corpus(spark, d):
    """The default preprocessing: tokens, stopwords out, pruning, counts."""
    c = C.preprocess(table(spark, d, "corpus_texts"), C.CorpusConfig(no_above=0.8), table(spark, d, "stopwords"))
    return c.bow


@query("SELECT doc_id, term, CAST(max(cnt) AS BIGINT) AS cnt FROM doc_term WHERE cnt > 0 GROUP BY doc_id, term")
def doc_term_cells(spark, d):
    """The given matrix without repeated and zero cells."""
    return table(spark, d, "doc_term").where("cnt > 0").groupBy("doc_id", "term").agg(F.max("cnt").cast("bigint").alias("cnt"))


# ------------------------------------------------------------------ lexical features


@query(f"WITH {_CELL} SELECT round(quantile_cont(cf, 0.75), 6) AS p FROM cf")
def extreme_threshold(spark, d):
    return lexical.extreme_threshold(C.collection_frequency(toks(spark, d))).select(r6("p").alias("p"))


@query(f"WITH {_CELL} SELECT term, cf FROM cf WHERE cf < 2")
def rare_words(spark, d):
    cf = C.collection_frequency(toks(spark, d))
    return cf.join(lexical.extreme_words(cf).where("rare"), "term", "left_semi")


@query(f"WITH {_CELL} SELECT term, cf FROM cf WHERE cf > (SELECT quantile_cont(cf, 0.75) FROM cf)")
def common_words(spark, d):
    cf = C.collection_frequency(toks(spark, d))
    return cf.join(lexical.extreme_words(cf).where("common"), "term", "left_semi")


_LING = f"""WITH {_CELL}, q AS (SELECT quantile_cont(cf, 0.75) AS p FROM cf),
f AS (SELECT term, cf < 2 AS rare, cf > (SELECT p FROM q) AS common FROM cf),
n AS (SELECT greatest(count(*) FILTER (rare), 1) AS r, greatest(count(*) FILTER (common), 1) AS c FROM f),
a AS (SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS w, count(*) AS u, count(*) FILTER (cell.term IN (SELECT term FROM stopwords)) AS s,
  coalesce(sum(cnt) FILTER (rare), 0) / (SELECT r FROM n) AS r, coalesce(sum(cnt) FILTER (common), 0) / (SELECT c FROM n) AS c FROM cell JOIN f USING (term) GROUP BY doc_id)
SELECT tok.doc_id, w AS num_words, CAST(coalesce(u, 0) AS BIGINT) AS num_unique_words, CAST(coalesce(s, 0) AS BIGINT) AS num_stop_words, round(coalesce(r, 0), 6) AS num_rare_words, round(coalesce(c, 0), 6) AS num_common_words,
  round(u / w, 6) AS ratio_unique_words, round(s / w, 6) AS ratio_stop_words, round(r / w, 6) AS ratio_rare_words, round(c / w, 6) AS ratio_common_words
FROM tok LEFT JOIN a USING (doc_id)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_LING)
def linguistic_features(spark, d):
    """Nine lexical statistics per document."""
    return _rounded(lexical.linguistic_features(toks(spark, d), table(spark, d, "stopwords")))


@query(f"SELECT doc_id, num_unique_words, num_stop_words, num_rare_words, num_common_words FROM ({_LING})")
def linguistic_features_nonnull(spark, d):
    """The columns without nulls (empty documents make five of nine null at these sizes)."""
    return lexical.drop_null_columns(linguistic_features(spark, d))


# ------------------------------------------------------------------ lexicon

_LEX_VALUES = ", ".join(f"('{c}', '{p}', {k * 1000 + i})" for k, (c, ps) in enumerate(LEXICON.items()) for i, p in enumerate(ps))
_LEX = f"""lex AS (SELECT * FROM (VALUES {_LEX_VALUES}) AS l(category, pattern, ord)),
pat AS (SELECT pattern, list(category ORDER BY ord) AS cats, min(ord) AS first FROM lex GROUP BY pattern),
node AS (SELECT split_part(pattern, '*', 1) AS stem, contains(pattern, '*') AS wild, arg_max(cats, first) AS cats FROM pat GROUP BY 1, 2),
terms AS (SELECT DISTINCT term FROM cell),
w AS (SELECT term, arg_min(cats, length(stem)) AS cats FROM terms JOIN node ON wild AND starts_with(term, stem) GROUP BY term),
hit AS (SELECT t.term, coalesce(w.cats, e.cats) AS cats FROM terms t LEFT JOIN w USING (term) LEFT JOIN node e ON NOT e.wild AND e.stem = t.term WHERE coalesce(w.cats, e.cats) IS NOT NULL)"""


def _lexicon(spark) -> DataFrame:
    rows = [(c, p, k * 1000 + i) for k, (c, ps) in enumerate(LEXICON.items()) for i, p in enumerate(ps)]
    return lexicon.compile_lexicon(spark.createDataFrame(rows, "category string, pattern string, ord int"))


@query(f"WITH {_CELL}, {_LEX} SELECT term, array_to_string(cats, ',') AS cats FROM hit")
def lexicon_match_terms(spark, d):
    return lexicon.match_terms(C.term_counts(toks(spark, d)), _lexicon(spark)).select("term", F.array_join("cats", ",").alias("cats"))


@query(f"WITH {_CELL}, {_LEX}, x AS (SELECT doc_id, cnt, unnest(cats) AS cat FROM cell JOIN hit USING (term)) SELECT tok.doc_id, " + ", ".join(f"CAST(coalesce(sum(cnt) FILTER (cat = '{c}'), 0) AS BIGINT) AS {c}" for c in LEXICON) + " FROM tok LEFT JOIN x USING (doc_id) GROUP BY tok.doc_id")
def lexicon_counts_wide(spark, d):
    return lexicon.lexicon_counts(toks(spark, d), _lexicon(spark), list(LEXICON))


# ------------------------------------------------------------------ vectors and inventories


@query("SELECT vec_id, array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(round(x / greatest(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 1e-12) * 1000000) AS BIGINT)), ',') AS u FROM embeddings")
def unit_normalize(spark, d):
    """Row-wise L2 normalisation, in millionths."""
    u = table(spark, d, "embeddings").select("vec_id", unit(doubles(F.col("embedding"))).alias("u"))
    return u.select("vec_id", F.array_join(F.transform("u", lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",").alias("u"))


@query("WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), n AS (SELECT p, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM e GROUP BY p) SELECT vec_id, string_agg(CAST(CAST(round(x / n * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY p) AS u FROM e JOIN n USING (p) GROUP BY vec_id")
def unit_normalize_columns(spark, d):
    """Column-wise L2 normalisation, in millionths."""
    u = assemble.normalize_columns(table(spark, d, "embeddings"), "vec_id", "embedding", DIM)
    return u.select("vec_id", F.array_join(F.transform("u", lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",").alias("u"))


_UNIT = "un AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))), 1e-12)) AS u FROM embeddings)"
_CENTRE = _UNIT + ", cent AS (SELECT label, list(a ORDER BY p) AS m FROM (SELECT label, p, avg(x) AS a FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM un) GROUP BY label, p) GROUP BY label)"


def _labels(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    words = inventory.unit_words(e, "vec_id", "embedding")
    cats = e.select(F.col("label").alias("category"), F.col("vec_id").alias("word"))
    return words, inventory.category_vectors(cats, words, DIM)


@query(f"WITH {_CENTRE} SELECT label, unnest(list_transform(m, lambda x: round(x, 6))) AS x, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS pos FROM cent")
def category_centroids(spark, d):
    _, cats = _labels(spark, d)
    return cats.select(F.col("category").alias("label"), F.posexplode("m").alias("pos", "x")).select("label", r6("x").alias("x"), F.col("pos").cast("bigint").alias("pos"))


@query(f"WITH {_CENTRE} SELECT vec_id, cent.label AS label, round(1 - list_dot_product(u, m), 6) AS distance FROM un, cent")
def embedding_label_distance(spark, d):
    """Distance of every vector to every label's mean unit vector."""
    words, cats = _labels(spark, d)
    rows = cats.select("category", "m").collect()  # one row per label
    each = F.array(*[F.struct(F.lit(r["category"]).alias("label"), F.array(*[F.lit(float(x)) for x in r["m"]]).alias("m")) for r in rows])
    return words.select(F.col("word").alias("vec_id"), "u", F.explode(each).alias("c")).select("vec_id", "c.label", r6(F.lit(1.0) - dot(F.col("u"), F.col("c.m"))).alias("distance"))


_EMB = _CELL + ", rk AS (SELECT term, row_number() OVER (ORDER BY cf DESC, term) - 1 AS vec_id FROM cf), " + _UNIT + ", emb AS (SELECT term, u FROM rk JOIN un USING (vec_id))"
_DOCV = _EMB + """, dx AS (SELECT doc_id, cnt, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM cell JOIN emb USING (term)),
dm AS (SELECT doc_id, list(a ORDER BY p) AS m FROM (SELECT doc_id, p, sum(cnt * x) / sum(cnt) AS a FROM dx GROUP BY doc_id, p) GROUP BY doc_id),
dv AS (SELECT tok.doc_id, coalesce(m, list_transform(range(64), lambda i: CAST(0 AS DOUBLE))) AS m FROM tok LEFT JOIN dm USING (doc_id))"""
_INV_VALUES = ", ".join(f"('{c}', '{w}')" for c, ws in INVENTORY.items() for w in ws)
_SCORE = _DOCV + f""", inv AS (SELECT * FROM (VALUES {_INV_VALUES}) AS i(category, word)),
ix AS (SELECT category, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM inv JOIN emb ON emb.term = inv.word),
im AS (SELECT category, list(a ORDER BY p) AS g FROM (SELECT category, p, avg(x) AS a FROM ix GROUP BY category, p) GROUP BY category),
sc AS (SELECT doc_id, c.category, coalesce(list_dot_product(m, g), 0) AS s FROM dv, (SELECT DISTINCT category FROM inv) c LEFT JOIN im USING (category))"""


def _words(spark, d) -> tuple[DataFrame, DataFrame]:
    """(tokens, unit vectors of the most frequent terms)."""
    t, e = toks(spark, d), table(spark, d, "embeddings")
    n = e.count()
    # the most frequent terms only, as many as there are vectors: a bounded ranking
    top = C.collection_frequency(t).orderBy(F.desc("cf"), "term").limit(n)
    rank = top.withColumn("vec_id", (F.row_number().over(Window.orderBy(F.desc("cf"), "term")) - 1).cast("bigint"))
    return t, stage(inventory.unit_words(rank.join(e, "vec_id"), "term", "embedding"), "words")


@query(f"WITH {_DOCV} SELECT doc_id, round(m[1], 6) AS d0, round(m[2], 6) AS d1, round(m[64], 6) AS d63, round(sqrt(list_dot_product(m, m)), 6) AS length FROM dv")
def doc_centroids(spark, d):
    """Mean unit vectors of documents: three components and the length."""
    v = inventory.document_vectors(*_words(spark, d), DIM)
    m = lambda i: r6(F.element_at("m", i))
    return v.select("doc_id", m(1).alias("d0"), m(2).alias("d1"), m(64).alias("d63"), r6(F.sqrt(dot(F.col("m"), F.col("m")))).alias("length"))


def _score_sql(expr: str) -> str:
    return f"WITH {_SCORE} SELECT doc_id, " + ", ".join(f"round({expr} FILTER (category = '{c}'), 6) AS {c}" for c in sorted(INVENTORY)) + " FROM sc GROUP BY doc_id"


def _scores(spark, d, similarity: bool) -> DataFrame:
    t, words = _words(spark, d)
    return _rounded(inventory.inventory_scores(t, readers.inventory(spark, INVENTORY), words, DIM, similarity))


@query(_score_sql("max(1 - s)"))
def inventory_scores(spark, d):
    return _scores(spark, d, False)


@query(_score_sql("max(s)"))
def inventory_similarity(spark, d):
    return _scores(spark, d, True)


# ------------------------------------------------------------------ topics


def _md5(key: str, z: str, seed: int = SEED) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', CAST({key} AS VARCHAR), CAST({z} AS VARCHAR), '{seed}')), 1, 8)) AS BIGINT) / 4294967296.0"


def _init_sql(rel: str, key: str, k: int, out: str, col: str) -> str:
    raw = "[" + ", ".join(_md5(key, str(z)) for z in range(k)) + "]"
    return f"{out} AS (SELECT {key}, list_transform(r, lambda x: x / list_sum(r)) AS {col} FROM (SELECT {key}, {raw} AS r FROM {rel}))"


def _em_sql(k: int, steps: int, bow: str = "bow", docs: str = "documents", frozen: str | None = None) -> str:
    """Steps as a chain of common tables th0, be0, th1, ...; ``frozen`` keeps the terms' table."""
    out = [_init_sql(docs, "doc_id", k, "th0", "th")]
    if not frozen:
        out.append(_init_sql("vocab", "term", k, "be0", "be"))
    for i in range(steps):
        be = frozen or f"be{i}"
        out.append(f"p{i} AS MATERIALIZED (SELECT doc_id, term, cnt, {', '.join(f'th[{z + 1}] * be[{z + 1}] AS a{z}' for z in range(k))} FROM {bow} JOIN th{i} USING (doc_id) JOIN {be} USING (term))")
        s = " + ".join(f"a{z}" for z in range(k))
        out.append(f"q{i} AS MATERIALIZED (SELECT doc_id, term, {', '.join(f'a{z} * cnt / CASE WHEN {s} = 0 THEN 1e-10 ELSE {s} END AS q{z}' for z in range(k))} FROM p{i})")
        sums = ", ".join(f"sum(q{z}) AS q{z}" for z in range(k))
        tot = " + ".join(f"q{z}" for z in range(k))
        out.append(f"d{i} AS (SELECT doc_id, {sums} FROM q{i} GROUP BY doc_id)")
        out.append(f"th{i + 1} AS MATERIALIZED (SELECT b.doc_id, [{', '.join(f'coalesce(q{z} / ({tot} + 1e-10), 0)' for z in range(k))}] AS th FROM {docs} b LEFT JOIN d{i} USING (doc_id))")
        if not frozen:
            out.append(f"t{i} AS (SELECT term, {sums} FROM q{i} GROUP BY term)")
            out.append(f"be{i + 1} AS MATERIALIZED (SELECT term, [{', '.join(f'q{z} / ((SELECT sum(q{z}) FROM t{i}) + 1e-10)' for z in range(k))}] AS be FROM t{i})")
    return ", ".join(out)


def _wide(prefix: str, arr: str, k: int) -> str:
    return ", ".join(f"round({arr}[{z + 1}], 6) AS {prefix}{z + 1}" for z in range(k))


def _cols(df: DataFrame, key: str, arr: str, k: int, prefix: str = "topic") -> DataFrame:
    return df.select(key, *[r6(F.element_at(arr, z + 1)).alias(f"{prefix}{z + 1}") for z in range(k)])


@query(f"WITH {_init_sql('documents', 'doc_id', 3, 'th0', 'th')} SELECT doc_id, {_wide('topic', 'th', 3)} FROM th0")
def plsa_init_theta(spark, d):
    return _cols(topics.init_theta(documents(spark, d), 3, SEED), "doc_id", "th", 3)


@query(f"WITH {_VOCAB}, {_init_sql('vocab', 'term', 3, 'be0', 'be')} SELECT term, {_wide('topic', 'be', 3)} FROM be0")
def plsa_init_beta(spark, d):
    return _cols(topics.init_beta(_corpus(spark, d)[1], 3, SEED), "term", "be", 3)


def _one_step(spark, d) -> tuple[DataFrame, DataFrame]:
    _, vocab, bow = _corpus(spark, d)
    return topics.em_step(stage(bow, "bow"), topics.init_theta(documents(spark, d), 3, SEED), topics.init_beta(vocab, 3, SEED), 3)


@query(f"WITH {_BOW}, {_em_sql(3, 1)} SELECT doc_id, {_wide('topic', 'th', 3)} FROM th1")
def plsa_em_step_theta(spark, d):
    return _cols(_one_step(spark, d)[0], "doc_id", "th", 3)


@query(f"WITH {_BOW}, {_em_sql(3, 1)} SELECT term, {_wide('topic', 'be', 3)} FROM be1")
def plsa_em_step_beta(spark, d):
    return _cols(_one_step(spark, d)[1], "term", "be", 3)


def _fit(spark, d, k: int, n: int) -> tuple[topics.TopicModel, DataFrame]:
    _, vocab, bow = _corpus(spark, d)
    bow = stage(bow, "bow")
    return topics.fit(bow, documents(spark, d).select("doc_id"), stage(vocab, "vocab"), k, n, SEED), bow


@query(f"WITH {_BOW} SELECT term, round(sum(cnt) / (SELECT sum(cnt) FROM bow), 9) AS p FROM bow GROUP BY term")
def plsa_fit_k1(spark, d):
    """One topic: the unigram model."""
    m, _ = _fit(spark, d, 1, 2)
    return m.beta.select("term", F.round(F.element_at("be", 1), 9).alias("p"))


@query(f"WITH {_BOW}, {_em_sql(5, 3)} SELECT doc_id, {_wide('topic', 'th', 5)} FROM th3")
def plsa_doc_topic(spark, d):
    """Three steps of five topics, in Arrow batches."""
    return _cols(_fit(spark, d, 5, 3)[0].theta, "doc_id", "th", 5)


@query(f"WITH {_BOW}, {_em_sql(25, 30)} SELECT doc_id, {', '.join(f'round(th[{z + 1}], 4) AS topic{z + 1}' for z in range(25))} FROM th30")
def topic_features_25(spark, d):
    """The default fit: 25 topics, 30 steps."""
    th = topics.topic_columns(_fit(spark, d, 25, 30)[0].theta, 25)
    return th.select("doc_id", *[F.round(c, 4).alias(c) for c in th.columns[1:]])


@query(f"""WITH {_BOW}, {_em_sql(3, 1)}, {tok_sql('corpus_texts', 'tok2')}, c2 AS (SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest(tokens) AS term FROM tok2) GROUP BY ALL),
bow2 AS (SELECT c2.* FROM c2 SEMI JOIN vocab USING (term)), fold AS (WITH {_em_sql(3, 2, 'bow2', 'corpus_texts', 'be1')} SELECT * FROM th2) SELECT doc_id, {_wide('topic', 'th', 3)} FROM fold""")
def plsa_fold_in(spark, d):
    """Topics of the other corpus with the terms' table held."""
    m, _ = _fit(spark, d, 3, 1)
    new = C.tokens(table(spark, d, "corpus_texts"))
    bow = C.bag_of_words(new, m.beta)
    return _cols(topics.fold_in(bow, new.select("doc_id"), m.beta, 3, 2, SEED), "doc_id", "th", 3)


_SPLIT_SQL = "sp AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '0')), doc_id) <= CAST(floor(0.8 * (SELECT count(*) FROM documents)) AS BIGINT) AS is_train FROM documents)"


@query(f"WITH {_BOW}, {_SPLIT_SQL}, tr AS (SELECT term, sum(cnt) AS c FROM bow JOIN sp USING (doc_id) WHERE is_train GROUP BY term), te AS (SELECT bow.* FROM bow JOIN sp USING (doc_id) JOIN tr USING (term) WHERE NOT is_train) SELECT round(exp(-sum(cnt * ln(greatest(c / (SELECT sum(c) FROM tr), 1e-14))) / sum(cnt)), 4) AS perplexity FROM te JOIN tr USING (term)")
def plsa_perplexity_k1(spark, d):
    """Hold-out perplexity of one topic."""
    docs = assemble.exact_split(documents(spark, d).select("doc_id"))
    _, vocab, bow = _corpus(spark, d)
    both = stage(bow.join(docs, "doc_id"), "bow")
    train, test = both.where("is_train").drop("is_train"), both.where("not is_train").drop("is_train")
    m = topics.fit(train, docs.where("is_train").select("doc_id"), stage(vocab, "vocab"), 1, 2, SEED)
    seen = test.join(train.select("term").distinct(), "term", "left_semi")
    th = topics.fold_in(seen, docs.where("not is_train").select("doc_id"), m.beta, 1, 2, SEED)
    return topics.perplexity(seen, th, m.beta).select(F.round("perplexity", 4).alias("perplexity"))


_TOP = f"WITH {_BOW}, {_em_sql(3, 1)}, x AS (SELECT term, unnest(be) AS p, generate_subscripts(be, 1) - 1 AS topic FROM be1), r AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(p, 12) DESC, term) AS rank, term, p FROM x)"


@query(_TOP + " SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term, round(p, 6) AS p FROM r WHERE rank <= 20")
def topic_top_terms(spark, d):
    _, be = _one_step(spark, d)
    top = topics.top_terms(be.select("term", F.transform("be", lambda x: F.round(x, 12)).alias("be")), 20)
    return top.select(F.col("topic").cast("bigint").alias("topic"), F.col("rank").cast("bigint").alias("rank"), "term", r6("p").alias("p"))


@query(f"WITH {_BOW}, {_em_sql(3, 1)}, r AS (SELECT doc_id, list_transform(th, lambda x: round(x, 9)) AS th FROM th1) SELECT doc_id, CAST(list_position(th, list_max(th)) - 1 AS BIGINT) AS topic FROM r")
def dominant_topic(spark, d):
    th, _ = _one_step(spark, d)
    return topics.dominant_topic(th.select("doc_id", F.transform("th", lambda x: F.round(x, 9)).alias("th"))).select("doc_id", F.col("topic").cast("bigint").alias("topic"))


# ------------------------------------------------------------------ split, language, sources


@query(f"WITH {_SPLIT_SQL} SELECT doc_id, is_train FROM sp")
def train_test_split(spark, d):
    return assemble.exact_split(documents(spark, d).select("doc_id"))


_ENG = f"eng AS (SELECT DISTINCT unnest(list_filter({_SPLIT}, lambda t: regexp_full_match(t, '\\p{{L}}+'))) AS term FROM eval_items WHERE lang = 'en' UNION SELECT term FROM stopwords)"
_NON = f"""{_ENG}, w AS (SELECT doc_id, coalesce(text, '') = '' AS empty, list_distinct(list_filter({_SPLIT}, lambda t: regexp_full_match(t, '\\p{{L}}+'))) AS w FROM documents),
o AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM w) ANTI JOIN eng USING (term) GROUP BY doc_id),
non AS (SELECT w.doc_id, CAST(CASE WHEN empty THEN (SELECT count(*) FROM eng) ELSE coalesce(n, 0) END AS BIGINT) AS n FROM w LEFT JOIN o USING (doc_id))"""


def _english(spark, d) -> DataFrame:
    """A vocabulary for tests: words of the English evaluation items, and the stopwords."""
    from stanzaflow.functions.text import split_tokens

    words = table(spark, d, "eval_items").where("lang = 'en'").select(F.explode(F.filter(split_tokens(F.col("text")), lambda t: t.rlike(r"^\p{L}+$"))).alias("term"))
    return words.union(table(spark, d, "stopwords").select("term")).distinct()


@query(f"WITH {_NON} SELECT doc_id, n FROM non")
def non_englishness(spark, d):
    return langfilter.non_englishness(documents(spark, d), _english(spark, d))


@query(f"WITH {_NON} SELECT CAST(sum(n) AS BIGINT) AS total FROM non")
def non_englishness_total(spark, d):
    return langfilter.total_non_englishness(non_englishness(spark, d))


@query()
def english_topic_filter(spark, d):
    """Documents that stay after foreign topics are dropped, by the default settings (20 topics, 30 steps, 15 terms)."""
    docs = documents(spark, d).select("doc_id", "text")
    return langfilter.filter_english(docs, _english(spark, d), table(spark, d, "stopwords")).select("doc_id")


#: Topics of which this many of the 50 likeliest terms are foreign are dropped in the step below; at 15 all three topics of these tables are, and nothing is left.
FOREIGN = 28
_FOREIGN = f"WITH {_BOW}, {_em_sql(3, 1)}, {_ENG}, x AS (SELECT term, unnest(be) AS p, generate_subscripts(be, 1) - 1 AS topic FROM be1), r AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(p, 12) DESC, term) AS rank, term FROM x), bad AS (SELECT topic, count(*) AS n FROM r ANTI JOIN eng USING (term) WHERE rank <= 50 GROUP BY topic)"


def _rounded_step(spark, d) -> tuple[DataFrame, DataFrame]:
    th, be = _one_step(spark, d)
    return th.select("doc_id", F.transform("th", lambda x: F.round(x, 9)).alias("th")), be.select("term", F.transform("be", lambda x: F.round(x, 12)).alias("be"))


@query(_FOREIGN + " SELECT CAST(topic AS BIGINT) AS topic FROM bad WHERE n >= 15")
def foreign_topics(spark, d):
    """Topics of a given model with 15 or more of their 50 likeliest terms outside the vocabulary."""
    return langfilter.foreign_topics(_rounded_step(spark, d)[1], _english(spark, d)).select(F.col("topic").cast("bigint").alias("topic"))


@query(_FOREIGN + f", t AS (SELECT doc_id, list_transform(th, lambda x: round(x, 9)) AS th FROM th1) SELECT doc_id FROM t WHERE list_position(th, list_max(th)) - 1 NOT IN (SELECT topic FROM bad WHERE n >= {FOREIGN})")
def english_filter_step(spark, d):
    """Documents that one round of the filter keeps, given a model."""
    th, be = _rounded_step(spark, d)
    return langfilter.drop_foreign(documents(spark, d).select("doc_id"), th, langfilter.foreign_topics(be, _english(spark, d), thresh=FOREIGN))


@query("WITH l AS (SELECT doc_id, list_filter(string_split(lower(text), chr(10)), lambda x: x <> '') AS l FROM corpus_texts) SELECT doc_id, array_to_string(l[1:greatest(len(l) - 3, 0)], ' ') AS text FROM l")
def strip_footer_lines(spark, d):
    return table(spark, d, "corpus_texts").select("doc_id", readers.lyrics_body(F.col("text")).alias("text"))


@query("SELECT doc_id, tid FROM corpus_texts WHERE text <> ''")
def drop_empty_docs(spark, d):
    return table(spark, d, "corpus_texts").where("text <> ''").select("doc_id", "tid")


_STRIP = r"regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')"


@query(f"SELECT {_STRIP} AS text, CAST(count(*) AS BIGINT) AS n, true AS dense FROM corpus_texts GROUP BY 1")
def line_text_scan(spark, d):
    """Writes the corpus as lines and reads it back, blank lines kept; ids must be dense."""
    where = scratch(spark, "lines")
    one = table(spark, d, "corpus_texts").select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ").alias("value"))
    one.write.mode("overwrite").text(where)
    rows = stage(readers.line_text(spark, where), "lines")
    ids = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("k"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    dense = ids["n"] == ids["k"] == (ids["hi"] or 0) + 1 and not ids["lo"]
    return rows.groupBy("text").agg(F.count("*").alias("n")).withColumn("dense", F.lit(dense))


# ------------------------------------------------------------------ joins and tables


@query("SELECT mxm, msd FROM (SELECT mxm, msd, row_number() OVER (PARTITION BY mxm ORDER BY line_no DESC) AS r FROM id_map WHERE mxm IS NOT NULL) WHERE r = 1")
def id_map_last_wins(spark, d):
    return assemble.id_map(table(spark, d, "id_map"))


_MATRIX = "m AS (SELECT row_id, col_id, CAST(sum(value) AS BIGINT) AS value FROM (SELECT DISTINCT * FROM user_items WHERE value IS NOT NULL AND row_id IS NOT NULL AND col_id IS NOT NULL) GROUP BY ALL)"


@query(f"WITH {_MATRIX} SELECT row_id, col_id, value FROM m")
def user_item_matrix(spark, d):
    return assemble.matrix_cells(table(spark, d, "user_items"))


@query(f"WITH {_MATRIX} SELECT row_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(col_id || ':' || value, ',' ORDER BY col_id)) AS entries FROM m GROUP BY row_id")
def long_to_csr(spark, d):
    """A row of the matrix per line: number of entries and a digest of them."""
    rows = assemble.long_to_csr(assemble.matrix_cells(table(spark, d, "user_items")))
    pairs = F.zip_with("cols", "vals", lambda c, v: F.concat_ws(":", c, v.cast("string")))
    return rows.select("row_id", F.size("cols").cast("bigint").alias("n"), F.md5(F.array_join(pairs, ",")).alias("entries"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS row_id, CAST(l_partkey AS VARCHAR) AS col_id, CAST(l_linenumber AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def csr_to_long(spark, d):
    """A matrix of stored entries with row ranges (orders by customer), back to long form."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    entries = lines.select(F.col("o_custkey").alias("row_no"), F.col("l_partkey").cast("bigint").alias("index"), F.col("l_linenumber").cast("bigint").alias("value"), F.xxhash64("l_orderkey", "l_linenumber").alias("h"))
    entries = stage(entries, "entries")
    ranges = assemble.row_ranges(entries.groupBy("row_no").agg(F.count("*").alias("n")), "row_no", "n")
    data = entries.join(ranges.select("row_no", "start"), "row_no").withColumn("pos", F.col("start") + F.row_number().over(Window.partitionBy("row_no").orderBy("h")) - 1)
    # written in the layout of a matrix file and read back by its reader
    where = scratch(spark, "matrix")
    data.select("pos", "index", "value").write.parquet(f"{where}/data")
    ranges.select("row_no", F.col("row_no").cast("string").alias("row_id"), "start", "end").write.parquet(f"{where}/users")
    entries.select(F.col("index").alias("col_no")).distinct().withColumn("col_id", F.col("col_no").cast("string")).write.parquet(f"{where}/items")
    return assemble.csr_to_long(*readers.csr_parquet(spark, where))


_AUDIO = "im AS (SELECT mxm, arg_max({'v': msd}, line_no).v AS msd FROM id_map WHERE mxm IS NOT NULL GROUP BY mxm), au AS (SELECT t.tid, min(CAST(f.features AS DOUBLE[])) AS f FROM (SELECT DISTINCT doc_id, tid FROM corpus_texts WHERE tid IS NOT NULL) t JOIN text_features f USING (doc_id) WHERE f.features IS NOT NULL GROUP BY t.tid)"


@query(f"WITH {_AUDIO}, j AS (SELECT c.doc_id, f FROM corpus_texts c JOIN im ON im.mxm = c.tid LEFT JOIN au ON au.tid = c.tid AND im.msd IS NOT NULL) SELECT doc_id, round(coalesce(f[1], 0), 6) AS f1, round(coalesce(f[59], 0), 6) AS f59 FROM j")
def left_join_zero_fill(spark, d):
    """Feature blocks joined through the id map: mapped tracks only, zeros where there is no block."""
    docs = table(spark, d, "corpus_texts").select("doc_id", "tid")
    blocks = docs.where("tid is not null").distinct().join(table(spark, d, "text_features").where("features is not null").select("doc_id", "features"), "doc_id").groupBy("tid").agg(F.min("features").alias("f"))
    mapping = assemble.id_map(table(spark, d, "id_map"))
    known = mapping.where("msd is not null").join(blocks, mapping["mxm"] == blocks["tid"]).groupBy("mxm").agg(F.min("f").alias("f"))
    keyed = mapping.select("mxm", F.col("mxm").alias("track"))
    out = assemble.add_audio(docs, keyed, known.select(F.col("mxm").alias("tid"), F.col("f").alias("feature")), 59, value="track")
    return out.select("doc_id", r6(F.element_at("feature", 1)).alias("f1"), r6(F.element_at("feature", 59)).alias("f59"))


_ALIGN = f"""WITH {_CELL}, {_LEX}, x AS (SELECT doc_id, cnt, unnest(cats) AS cat FROM cell JOIN hit USING (term)), lc AS (SELECT doc_id, CAST(sum(cnt) FILTER (cat = 'warm') AS BIGINT) AS warm FROM x GROUP BY doc_id),
al AS (SELECT tok.doc_id, CAST(len(tokens) AS BIGINT) AS base_words, CAST(coalesce(warm, 0) AS BIGINT) AS liwc_warm FROM tok LEFT JOIN lc USING (doc_id))"""


def _aligned(spark, d) -> DataFrame:
    t = toks(spark, d)
    lex = lexicon.lexicon_counts(t, _lexicon(spark), list(LEXICON)).select("doc_id", "warm")
    return assemble.align({"base": t.select("doc_id", F.size("tokens").cast("bigint").alias("words")), "liwc": lex})


@query(_ALIGN + " SELECT doc_id, base_words, liwc_warm FROM al")
def align_feature_sets(spark, d):
    return _aligned(spark, d)


@query(_ALIGN + " SELECT doc_id, printf('%.8f', CAST(base_words AS DOUBLE)) AS base_words, printf('%.8f', CAST(liwc_warm AS DOUBLE)) AS liwc_warm FROM al")
def format_csv_rows(spark, d):
    return writers.formatted(_aligned(spark, d))


def _set_of(spark, d) -> dict[str, DataFrame]:
    return {"base": toks(spark, d).select("doc_id", F.size("tokens").alias("words"), F.size(F.array_distinct("tokens")).alias("unique"))}


_BASE = f"WITH {_TOK} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS words, CAST(len(list_distinct(tokens)) AS BIGINT) AS uniq FROM tok"


@query(_BASE)
def csv_round_trip(spark, d):
    """Feature sets written as CSV and read back."""
    where = scratch(spark, "csv")
    writers.write_csv(_set_of(spark, d), where)
    back = spark.read.schema("doc_id bigint, w double, u double").option("header", True).csv(where)
    return back.select("doc_id", F.col("w").cast("bigint").alias("words"), F.col("u").cast("bigint").alias("uniq"))


@query(_BASE)
def parquet_round_trip(spark, d):
    """Feature sets written as a Parquet folder and read back."""
    where = scratch(spark, "parquet")
    writers.write_parquet(_set_of(spark, d), where)
    back = spark.read.parquet(f"{where}/features/base")
    return back.select("doc_id", F.col("words").cast("bigint").alias("words"), F.col("unique").cast("bigint").alias("uniq"))


@query("SELECT doc_id, " + ", ".join(f"round(CAST(f[{i + 1}] AS DOUBLE), 6) AS topic{i + 1}" for i in range(25)) + " FROM (SELECT doc_id, any_value(doc_topic) AS f FROM topic_features WHERE doc_topic IS NOT NULL AND NOT isnan(list_sum(list_transform(doc_topic, lambda x: CAST(x AS DOUBLE)))) GROUP BY doc_id)")
def topic_matrix_columns(spark, d):
    """The given topic shares as named columns, one row per document, without invalid rows."""
    t = table(spark, d, "topic_features").where("doc_topic is not null").where(~F.exists("doc_topic", lambda x: F.isnan(x)))
    t = t.groupBy("doc_id").agg(F.min("doc_topic").alias("th"))
    return _rounded(topics.topic_columns(t.select("doc_id", doubles(F.col("th")).alias("th")), 25))


@query(f"WITH {tok_sql('corpus_texts')}, rw AS (SELECT doc_id, unnest(tokens) AS term FROM tok), cell AS (SELECT doc_id, term, count(*) AS cnt FROM rw GROUP BY ALL), cf AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS cf, count(*) AS df FROM cell GROUP BY term)" + _LING[_LING.index(", q AS") :].replace("SELECT tok.doc_id, w AS num_words", "SELECT c0.doc_id, w AS num_words").replace("FROM tok LEFT JOIN a USING (doc_id)", "FROM corpus_texts c0 LEFT JOIN a USING (doc_id)"))
def extract_linguistic(spark, d):
    """The whole run of the command line: extract, write as a Parquet folder, read back."""
    stop = f"{d}/stopwords.parquet"
    sets = pipeline.extract(table(spark, d, "corpus_texts").select("doc_id", "text"), ResourcePaths(stopwords=stop), ("linguistic",))
    where = scratch(spark, "extract")
    writers.write_parquet({k: v.table for k, v in sets.items()}, where)
    return _rounded(spark.read.parquet(f"{where}/features/linguistic"))


_RANGE = "SELECT norm AS source, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM (SELECT replace(replace(lower(trim(source)), '-', '_'), ' ', '_') AS norm, tokens FROM tok JOIN documents USING (doc_id)) GROUP BY norm"


@query(f"WITH {_TOK} {_RANGE}")
def tokens_by_source(spark, d):
    """Documents and tokens per source, sources compared after normalising."""
    docs = documents(spark, d)
    t = C.tokens(docs).join(docs.select("doc_id", norm_source(F.col("source")).alias("source")), "doc_id")
    return t.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).cast("bigint").alias("tokens"))


# ------------------------------------------------------------------ streaming

_COUNTS = f"WITH {_TOK} SELECT doc_id, CASE WHEN len(tokens) > 0 THEN CAST(len(tokens) AS BIGINT) END AS num_words, CAST(len(list_distinct(tokens)) AS BIGINT) AS num_unique_words, CAST(len(list_intersect(list_distinct(tokens), (SELECT list(term) FROM stopwords))) AS BIGINT) AS num_stop_words FROM tok"


def _stop(spark, d) -> list[str]:
    return [r["term"] for r in table(spark, d, "stopwords").select("term").distinct().collect()]


@query(_COUNTS)
def document_counts(spark, d):
    return score.document_counts(documents(spark, d), _stop(spark, d))


@query(_COUNTS)
def stream_document_counts(spark, d):
    """The same on a stream of documents, each written once."""
    docs = documents(spark, d).select("doc_id", "text")
    base = scratch(spark, "stream")
    docs.write.parquet(f"{base}/in")
    stream = score.stream_documents(spark, f"{base}/in", docs.schema)
    score.run_once(score.document_counts(stream, _stop(spark, d)), f"{base}/out", f"{base}/log")
    return spark.read.schema("doc_id bigint, num_words bigint, num_unique_words bigint, num_stop_words bigint").parquet(f"{base}/out")
