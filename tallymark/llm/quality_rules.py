"""Op 9 [native]: a table of thresholds compiled into one Spark projection.

RULES lists what a document is measured by and within which bounds; compile_rules() turns the table into one column each and
one verdict. All measures are built-in expressions over the row, so no row ever moves.

Edge cases: a null or empty text has no words, lines or symbols and fails the base rule; ratios over 0 words are 0; repeated
rows are judged alike; an empty table gives no rows; a text of any length is read whole (its three-word windows are sorted
once, in memory that grows with that text); other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Common short words of the four languages of the corpus.
STOP_WORDS = ("the of and to in a is that for on with as be by it at this are or an der die das und zu den von mit ein ist im auf nicht le la les des et un une du est que dans pour en el los las de y se por con una al lo su").split()

#: name, measure (SQL over the base columns), least, most: a document is kept if every measure lies within its bounds.
RULES = [
    ("length", "n_words", 50, 10_000_000),
    ("mean_word_length", "word_chars / greatest(n_words, 1)", 1.5, 25),
    ("symbol_ratio", "n_symbols / greatest(n_words, 1)", 0, 0.25),
    ("stop_word_ratio", "n_stop_words / greatest(n_words, 1)", 0.002, 1),
    ("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)", 0, 0.5),
    ("repeat_word_ratio", "n_repeat_words / greatest(n_words, 1)", 0, 0.5),
]


def compile_rules(rules=RULES) -> Column:
    """The conjunction of all rules of the table."""
    kept = F.lit(True)
    for _, measure, least, most in rules:
        kept = kept & F.expr(measure).between(least, most)
    return kept


def repeat_words(windows: Column, n_words: Column) -> Column:
    """Words in three-word windows that are found twice or more. windows: array of structs (h, i), sorted."""
    h, i = windows["h"], windows["i"]
    n = F.size(windows)
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(h, F.lit(1), n - 1))
    after = F.concat(F.slice(h, F.lit(2), n - 1), F.array(F.lit(None).cast("long")))
    twice = F.filter(F.arrays_zip(h.alias("h"), i.alias("i"), before.alias("b"), after.alias("a")), lambda x: (x["h"] == x["b"]) | (x["h"] == x["a"]))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    # Each window's own words reach up to the next window's start, three at most; positions are folded in order.
    covered = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    return F.when(n_words < 4, F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the base columns."""
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    base = base.select("doc_id", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("t", "\n", -1), lambda x: F.rtrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "").alias("lines"))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    n = F.size("words")
    grams = F.transform(F.arrays_zip(F.col("words").alias("p"), F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("q"), F.slice("words", F.lit(3), F.greatest(n - 2, F.lit(0))).alias("r")), lambda x, i: F.struct(F.xxhash64(x["p"], x["q"], x["r"]).alias("h"), i.alias("i")))
    windows = F.array_sort(F.slice(grams, F.lit(1), F.greatest(n - 2, F.lit(0))))
    return base.select(
        "doc_id",
        "n_words",
        (F.char_length("t") - F.char_length(F.regexp_replace("t", WORD, ""))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        windows.alias("windows"),
    )


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Every document's measures and verdict."""
    m = measure(docs)
    m = m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat_words(F.col("windows"), F.col("n_words")).alias("n_repeat_words"), "n_lines", "n_stop_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every whole text of the table."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_STOP = "|".join(STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) v(k) WHERE n >= 2 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: regexp_full_match(x, '(?i)(?:{_STOP})')))::BIGINT AS n_stop_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed {"".join(f" AND {sql} BETWEEN {a} AND {b}" for _, sql, a, b in RULES)} AS kept FROM f
"""
