"""Category counts of a lexicon whose patterns may end in a wildcard.

Matching is an equality join: every prefix of a distinct term meets the wildcard stems, and
the term itself the exact entries. The shortest matching wildcard wins alone, over longer
wildcards and over an exact entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.operators.corpus import small, term_counts
from stanzaflow.shared import stage


def compile_lexicon(lexicon: DataFrame) -> DataFrame:
    """``stem, wildcard, cats`` from ``category, pattern`` (and, for the order of categories, ``ord``).

    What follows the first ``*`` of a pattern is ignored. Equal patterns join their categories in
    dictionary order with repeats; different patterns of one stem and kind: the last one stays.
    """
    lex = lexicon if "ord" in lexicon.columns else lexicon.withColumn("ord", F.row_number().over(Window.orderBy("category", "pattern")))  # lexicons are word lists
    per = lex.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("ord", "category"))).alias("s"), F.min("ord").alias("first"))
    per = per.select(F.substring_index("pattern", "*", 1).alias("stem"), F.col("pattern").contains("*").alias("wildcard"), F.col("s.category").alias("cats"), "first")
    return per.groupBy("stem", "wildcard").agg(F.max_by("cats", "first").alias("cats"))


def match_terms(terms: DataFrame, compiled: DataFrame) -> DataFrame:
    """``term, cats`` of the terms that match."""
    lex = small(compiled)
    t = terms.select("term").distinct()
    pre = t.select("term", F.explode(F.transform(F.sequence(F.lit(0), F.length("term")), lambda i: F.struct(i.alias("n"), F.substring("term", 1, i).alias("stem")))).alias("p"))
    wild = pre.select("term", "p.n", "p.stem").join(lex.where("wildcard").select("stem", "cats"), "stem").groupBy("term").agg(F.min_by("cats", "n").alias("wild"))
    exact = t.join(lex.where("not wildcard").select(F.col("stem").alias("term"), F.col("cats").alias("exact")), "term")
    both = wild.join(exact, "term", "full_outer")
    return both.select("term", F.coalesce("wild", "exact").alias("cats"))


def lexicon_counts(toks: DataFrame, compiled: DataFrame, categories: list[str]) -> DataFrame:
    """``doc_id`` and one count per category, 0 where nothing matches; every document has a row."""
    terms = toks.select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    hits = term_counts(toks).join(small(stage(match_terms(terms, compiled), "matches")), "term").select("doc_id", "cnt", F.explode("cats").alias("cat"))
    per = hits.groupBy("doc_id").agg(*[F.sum(F.when(F.col("cat") == c, F.col("cnt")).otherwise(0)).cast("bigint").alias(c) for c in categories])
    return toks.select("doc_id").join(per, "doc_id", "left").fillna(0, categories)
