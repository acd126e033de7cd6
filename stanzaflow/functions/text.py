"""Column functions on texts and token arrays; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word runs, and runs of other visible signs. Java's own \w and \s are ASCII only, so the classes are spelled out.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD_OR_SIGNS = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"
LETTERS_DIGITS = r"[\p{L}\p{N}]+"


def split_tokens(text: Column) -> Column:
    """Lower-cased runs of word characters and of other signs, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OR_SIGNS), F.lit(0))


def count_tokens(text: Column) -> Column:
    """How many tokens ``split_tokens`` gives, without building the array; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_OR_SIGNS)).cast("bigint"), F.lit(0).cast("bigint"))


def ascii_words(tokens: Column) -> Column:
    """Only tokens wholly of ASCII lower-case letters and hyphens (a lone hyphen stays)."""
    return F.filter(tokens, lambda t: t.rlike("^[a-z-]+$"))


def tokenize(text: Column) -> Column:
    """Default tokens: split, then the ASCII filter; an empty array for null or empty text."""
    return F.coalesce(ascii_words(split_tokens(text)), F.array().cast("array<string>"))


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(LETTERS_DIGITS), F.lit(0)), F.array().cast("array<string>"))


def padded_ngrams(tokens: Column, n: int) -> Column:
    """n-grams joined by '_' over n-1 start and end pads; the tokens themselves for n = 1.

    Unlike ``pyspark.ml`` NGram an empty document still yields its all-pad n-grams.
    """
    if n <= 1:
        return tokens
    padded = F.concat(F.array_repeat(F.lit("<s>"), n - 1), tokens, F.array_repeat(F.lit("</s>"), n - 1))
    return F.transform(F.sequence(F.lit(1), F.size(padded) - (n - 1)), lambda i: F.concat_ws("_", F.slice(padded, i, n)))


def norm_source(source: Column) -> Column:
    """Source names compared after trimming, lower-casing and writing '-' and space as '_'."""
    return F.regexp_replace(F.lower(F.trim(source)), "[- ]", "_")
