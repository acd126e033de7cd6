"""The pN_ queries over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.llm import abuse, language, leaks, mixing, neardup, quality, terms, vectors
from stanzaflow.operators.corpus import small
from stanzaflow.shared import stage
from stanzaflow.sources import readers


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return readers.table(spark, f"{d}/{name}.parquet")


def _versions(spark: SparkSession, d: str, links: bool = False) -> DataFrame:
    return neardup.groups(table(spark, d, "corpus_texts"), n=3, threshold=0.5, min_shingles=30, links=links)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records in one group of versions."""
    return neardup.group_pairs(_versions(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of versions of every record."""
    return _versions(spark, d)


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The group of versions of every record, and the closest verified link that puts it there."""
    return _versions(spark, d, links=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Segments of records that are mixed or whose label is missing or wrong."""
    corpus = table(spark, d, "corpus_texts")
    segs = stage(language.mislabelled(language.segments(corpus)).select("doc_id", "first_line", "lang"), "segments")
    # only records with such segments can matter
    asked = corpus.join(small(segs.select("doc_id").distinct()), "doc_id", "left_semi")
    odd = quality.unnatural(quality.record_statistics(asked)).select("doc_id")
    return segs.join(odd, "doc_id", "left_anti").distinct()


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every record with its language and confidence."""
    return language.segments(table(spark, d, "corpus_texts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that are too rare or too common."""
    freq = terms.term_frequencies(terms.term_bitmaps(table(spark, d, "ngram_corpus")))
    return freq.where("mark is not null").select("term", "mark")


def p3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and occurrences of every term of the token lists."""
    return terms.term_frequencies(terms.term_bitmaps(table(spark, d, "ngram_corpus")))


def p3_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same from document x term cells."""
    return terms.term_frequencies(terms.term_bitmaps(table(spark, d, "doc_term"), term="term", cnt="cnt"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that are mostly list entries, table rows or junk."""
    return quality.unnatural(quality.record_statistics(table(spark, d, "corpus_texts"))).select("doc_id")


def p4_stats(spark: SparkSession, d: str) -> DataFrame:
    """Text statistics of every record, and whether it is natural text."""
    stats = quality.record_statistics(table(spark, d, "corpus_texts"))
    return stats.withColumn("natural", F.col("odd_share") <= 0.5)


def p4_text_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every record that need no rules, rounded."""
    stats = quality.record_statistics(table(spark, d, "corpus_texts"), rule="0")
    return stats.select("doc_id", "n_lines", "n_words", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "ended_share", "common_share", "distinct_lines")])


def p4_token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the token lists: count, mean length, distinct share, share of stopwords."""
    return quality.token_statistics(table(spark, d, "ngram_corpus"), table(spark, d, "stopwords"))


#: Pruning radius of p5_found: recall against brute force stays at 1.000 on 49,167 vectors of each table.
RELAX = 0.3
#: Table, vector column and least cosine of the two vector collections.
VECTORS = (("text_features", "features", 0.95), ("topic_features", "doc_topic", 0.995))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which one is among the other's 5 most similar, above the table's cosine."""
    parts = []
    for name, vec, least in VECTORS:
        near = vectors.nearest(table(spark, d, name), vec=vec, k=5, min_similarity=least, relax=RELAX)
        pair = near.select(F.lit(name).alias("feature_set"), F.least("id", "neighbour").alias("doc_id_a"), F.greatest("id", "neighbour").alias("doc_id_b"))
        parts.append(pair.distinct())
    return parts[0].union(parts[1])


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar of every query (ids divisible by 100), against all vectors; exact pruning."""
    near = vectors.nearest(table(spark, d, "text_features"), k=10, queries="id % 100 = 0")
    return near.select(F.col("id").alias("doc_id"), "neighbour", F.round("similarity", 9).alias("similarity"), "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with eight consecutive words of an evaluation item."""
    return leaks.passages(table(spark, d, "documents"), table(spark, d, "eval_items")).where("whole_run").select("doc_id", "item_id")


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage of an evaluation item, small edits allowed, and where it stands."""
    return leaks.passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose capped repeats can't reach their target share."""
    _, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.short_sources(report)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    _, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.withColumn("actual_share", F.round("actual_share", 9))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document with its place in the mixed stream."""
    uses, _ = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return uses


def _severities(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.severities(docs, abuse.fit(docs, table(spark, d, "doc_ratings")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose expected severity reaches the cut."""
    return _severities(spark, d).where(F.col("severity") >= abuse.CUT).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The severity of every document."""
    return _severities(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of abusive documents per source."""
    return abuse.source_rates(_severities(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_groups, p1_links, p2_found, p2_segments, p3_found, p3_term_counts, p3_cell_counts, p4_found, p4_stats, p4_text_stats, p4_token_stats, p5_found, p5_neighbours, p6_found, p6_passages, p7_found, p7_shares, p7_mix, p8_found, p8_scores, p8_rates)}

_P3 = """
WITH docs AS (SELECT doc_id, any_value(tokens) AS tokens FROM ngram_corpus GROUP BY doc_id),
n AS (SELECT count(*) AS n FROM docs),
t AS (SELECT doc_id, unnest(tokens) AS term FROM docs),
f AS (SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM t GROUP BY term),
m AS (SELECT term, df, cf, CASE WHEN df < 5 THEN 'rare' WHEN df > CAST(0.3 AS DOUBLE) * (SELECT n FROM n) THEN 'common' END AS mark FROM f)
"""
_P1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM corpus_texts WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w),
k AS (SELECT doc_id, len(s) AS k, s FROM s WHERE len(s) >= 30),
u AS (SELECT doc_id, k, unnest(s) AS g FROM k),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.k) AS ka, any_value(b.k) AS kb, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c WHERE 2 * n >= ka + kb - n),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
"""
_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for ws in quality.FUNCTION_WORDS.values() for w in ws}))


def _neighbours_sql(table: str, vec: str, k: int, asking: str = "true") -> str:
    return f"""
        v AS (SELECT doc_id, min(list_transform({vec}, lambda x: CAST(x AS DOUBLE))) AS v FROM {table} WHERE doc_id IS NOT NULL AND {vec} IS NOT NULL GROUP BY doc_id),
        g AS (SELECT doc_id, v FROM v WHERE list_sum(list_transform(v, lambda x: x * x)) > 0 AND isfinite(list_sum(list_transform(v, lambda x: x * x)))),
        u AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM g),
        p AS (SELECT a.doc_id AS id, b.doc_id AS nb, list_dot_product(a.u, b.u) AS sim FROM u a, u b WHERE a.doc_id <> b.doc_id AND {asking}),
        top AS (SELECT id, nb, sim, row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, nb) AS rank FROM p QUALIFY rank <= {k})"""


def _pairs_sql(name: str, vec: str, least: float) -> str:
    return f"(WITH {_neighbours_sql(name, vec, 5)} SELECT DISTINCT '{name}' AS feature_set, least(id, nb) AS doc_id_a, greatest(id, nb) AS doc_id_b FROM top WHERE sim >= {least})"


_P7_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]+'))"

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM r WHERE a < b",
    "p1_groups": _P1 + """SELECT d.doc_id, least(d.doc_id, coalesce(m.m, d.doc_id)) AS group_id, CAST(len(d.s) AS INT) AS n_shingles
        FROM s d LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "p4_text_stats": rf"""
        WITH l AS (SELECT doc_id, list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: regexp_matches(x, '[^\s\p{{Z}}]')) AS l FROM corpus_texts WHERE doc_id IS NOT NULL),
        u AS (SELECT doc_id, unnest(l) AS x FROM l),
        w AS (SELECT doc_id, x, regexp_extract_all(lower(x), '\p{{L}}+') AS w FROM u),
        a AS (SELECT doc_id, count(*) AS n_lines, sum(len(w)) AS n_words, sum(length(array_to_string(w, ''))) AS letters, sum(len(regexp_extract_all(x, '[^\p{{L}}\p{{N}}\s\p{{Z}}]'))) AS symbols,
          sum(length(replace(replace(replace(x, ' ', ''), chr(9), ''), chr(160), ''))) AS visible, avg(CAST(regexp_matches(x, '[.,;:!?…][''"»)]*\s*$') AS INT)) AS ended, sum(len(list_filter(w, lambda v: v IN ({_COMMON})))) AS common FROM w GROUP BY doc_id)
        SELECT l.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, coalesce(CASE WHEN n_words > 0 THEN round(letters / n_words, 6) END, 0) AS mean_word_length,
          coalesce(CASE WHEN visible > 0 THEN round(symbols / visible, 6) END, 0) AS symbol_ratio, coalesce(round(ended, 6), 0) AS ended_share, coalesce(CASE WHEN n_words > 0 THEN round(common / n_words, 6) END, 0) AS common_share,
          coalesce(CASE WHEN len(l.l) > 0 THEN round(len(list_distinct(l.l)) / len(l.l), 6) END, 0) AS distinct_lines
        FROM l LEFT JOIN a USING (doc_id)""",
    "p5_found": " UNION ALL ".join(_pairs_sql(*x) for x in VECTORS),
    "p5_neighbours": f"WITH {_neighbours_sql('text_features', 'features', 10, 'a.doc_id % 100 = 0')} SELECT id AS doc_id, nb AS neighbour, round(sim, 9) AS similarity, CAST(rank AS INT) AS rank FROM top",
    "p6_found": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
        g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM i),
        h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' '))) AS g FROM w)
        SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
    "p3_found": _P3 + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p3_term_counts": _P3 + "SELECT term, df, cf, mark FROM m",
    "p3_cell_counts": """
        WITH c AS (SELECT doc_id, term, max(cnt) AS cnt FROM doc_term WHERE cnt > 0 GROUP BY doc_id, term),
        n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_term)
        SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(cnt) AS BIGINT) AS cf,
          CASE WHEN count(*) < 5 THEN 'rare' WHEN count(*) > CAST(0.3 AS DOUBLE) * (SELECT n FROM n) THEN 'common' END AS mark
        FROM c GROUP BY term""",
    "p4_token_stats": """
        WITH d AS (SELECT doc_id, any_value(tokens) AS t FROM ngram_corpus WHERE doc_id IS NOT NULL GROUP BY doc_id),
        u AS (SELECT doc_id, unnest(t) AS w FROM d),
        a AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS l, count(DISTINCT w) AS k, count(*) FILTER (w IN (SELECT term FROM stopwords)) AS s FROM u GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, coalesce(round(l / n, 6), 0) AS mean_length, coalesce(round(k / n, 6), 0) AS distinct_share, coalesce(round(s / n, 6), 0) AS stop_share
        FROM d LEFT JOIN a USING (doc_id)""",
    "p7_found": rf"""
        WITH d AS (SELECT replace(replace(lower(trim(source)), '-', '_'), ' ', '_') AS source, {_P7_TOKENS} AS n FROM documents),
        s AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(d.n), 0) AS n FROM mix_targets t LEFT JOIN d ON d.source = t.source GROUP BY ALL)
        SELECT source FROM s WHERE max_repeats * n < target_share * (SELECT sum(n) FROM s)""",
    "p7_shares": rf"""
        WITH d AS (SELECT doc_id, replace(replace(lower(trim(source)), '-', '_'), ' ', '_') AS source, CAST({_P7_TOKENS} AS BIGINT) AS n FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT t.source, t.target_share, CAST(t.max_repeats AS BIGINT) AS max_repeats, count(d.n) AS n_docs, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS tokens FROM mix_targets t LEFT JOIN d ON d.source = t.source AND d.n > 0 GROUP BY ALL),
        g AS (SELECT *, CAST((SELECT sum(tokens) FROM s) AS BIGINT) AS total_tokens FROM s),
        k AS (SELECT *, target_share * total_tokens AS due_tokens, CASE WHEN tokens = 0 THEN 0 ELSE least(max_repeats, CAST(ceil(target_share * total_tokens / tokens) AS BIGINT)) END AS need FROM g),
        u AS (SELECT k.source, k.due_tokens, d.doc_id, d.n, unnest(range(k.need)) AS pass FROM k JOIN d ON d.source = k.source AND d.n > 0),
        o AS (SELECT source, due_tokens, n, pass, sum(n) OVER (PARTITION BY source ORDER BY pass, md5(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(pass AS VARCHAR), '7')), doc_id, n) - n AS start FROM u),
        p AS (SELECT source, CAST(sum(n) AS BIGINT) AS placed, max(pass) + 1 AS passes FROM o WHERE start < due_tokens GROUP BY source)
        SELECT k.source, k.source AS name, target_share, max_repeats, CAST(n_docs AS BIGINT) AS n_docs, tokens, total_tokens, due_tokens, CAST(ceil(coalesce(placed, 0) / 4096) AS BIGINT) AS filled_blocks,
          coalesce(placed, 0) AS placed_tokens, CAST(coalesce(passes, 0) AS BIGINT) AS passes, round(coalesce(placed, 0) / (SELECT sum(placed) FROM p), 9) AS actual_share
        FROM k LEFT JOIN p USING (source)""",
}
