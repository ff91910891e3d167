"""Column expressions over text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_text(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed, JVM-side; equals exact_normalized_text() on text that NFKC leaves alone."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def exact_normalized_text(c: Column) -> Column:
    """NFKC, case folding, white space collapsed and trimmed. The JVM has neither of the first two as a built-in function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))

    return run(c)


def input_key(fields: dict[str, Column]) -> Column:
    """Canonical JSON of the normalised input, its keys sorted."""
    return F.to_json(F.struct(*(normalized_text(fields[k]).alias(k) for k in sorted(fields))))


def tokens(c: Column) -> Column:
    """Distinct tokens: single CJK characters, or runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9]+"), F.lit(0)))


def char_ngrams(c: Column, n: int) -> Column:
    """All runs of n code points, in order, with repeats."""
    return F.when(F.char_length(c) >= n, F.transform(F.sequence(F.lit(1), F.char_length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def coverage(query: Column, passage: Column) -> Column:
    return F.size(F.array_intersect(query, passage)) / F.greatest(F.lit(1), F.size(query))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def html_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def keyword_scores(text: Column, rules: dict[str, list[str]], high: float, low: float) -> dict[str, Column]:
    """Each label's score: high if any of its words is in the lower-cased text."""
    t = F.lower(text)
    return {label: F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)), high).otherwise(low) for label, words in rules.items()}


def argmax(scores: dict[str, Column]) -> Column:
    """The label of the largest score; of equal ones the first listed."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.coalesce(*(F.when(s == best, F.lit(label)) for label, s in scores.items()))
