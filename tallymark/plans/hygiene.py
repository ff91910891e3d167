"""Queries over dataset hygiene and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import rounded
from ..operators import hygiene as H
from .base import LABELS, paired, query, records, table

#: The normalisation of SQL engines, and records under the operators' column names.
N = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_R = "r AS (SELECT item_id AS id, group_id, gold_label AS label, split, text, lang FROM records)"
_P = "CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"
_H8 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def base(spark, d):
    return records(spark, d).select(F.col("item_id").alias("id"), "group_id", F.col("gold_label").alias("label"), "split", "text", "lang")


_FAMILY = f"WITH {_R}, f AS (SELECT *, first_value(id) OVER (PARTITION BY {N.format('text')} ORDER BY {_P}, id) AS winner, min(label) OVER (PARTITION BY {N.format('text')}) <> max(label) OVER (PARTITION BY {N.format('text')}) AS conflict FROM r)"


@query(_FAMILY + " SELECT id, group_id, label, split FROM f WHERE NOT conflict AND id = winner")
def exact_dedup(spark, d):
    return H.exact_dedup(base(spark, d)).select("id", "group_id", "label", "split")


@query(_FAMILY + " SELECT id, split, CASE WHEN conflict THEN 'conflicting_official_labels' ELSE 'exact_input_duplicate' END AS reason, CASE WHEN NOT conflict THEN winner END AS kept_id FROM f WHERE conflict OR id <> winner")
def exact_dedup_removed(spark, d):
    return H.exact_removed(base(spark, d))


@query(f"WITH {_R}, f AS (SELECT id, split, first_value(id) OVER (PARTITION BY {N.format('text')} ORDER BY {_P}, id) AS kept_id FROM r) SELECT * FROM f WHERE id <> kept_id")
def text_repeat(spark, d):
    return H.text_repeats(base(spark, d))


@query(f"WITH {_R} SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_H8.format("'7:' || id")}, id) AS place FROM r QUALIFY place <= 10")
def capped_stratified(spark, d):
    return H.capped_stratified(base(spark, d), 10, "7").select("id", "label", "place")


@query(f"WITH {_R} SELECT split, lang, label, arg_min(id, ({_H8.format("'7:' || id")}, id)) AS id FROM r GROUP BY ALL")
def one_per_stratum(spark, d):
    return H.one_per_stratum(base(spark, d), ["split", "lang", "label"], "7")


_SPLIT = """, m AS (SELECT group_id, min(label) AS label, min(label) <> max(label) AS mixed FROM {src} GROUP BY ALL),
s AS (SELECT group_id, CASE WHEN (SELECT bool_or(mixed) FROM m) THEN '*' ELSE label END AS stratum FROM m),
k AS (SELECT group_id, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY group_id) AS k FROM s),
a AS (SELECT *, greatest(1, floor(n * 0.6)) AS a, greatest(1, floor(n * 0.2)) AS b0 FROM k),
p AS (SELECT group_id, CASE WHEN k <= a THEN 'train' WHEN k <= a + CASE WHEN a + b0 >= n THEN greatest(1, n - a - 1) ELSE b0 END THEN 'validation' ELSE 'test' END AS split FROM a)
SELECT id, {src}.group_id, label, p.split FROM {src} JOIN p USING (group_id)"""


@query(f"WITH {_R}, q AS (SELECT id, substr(md5(text), 1, 3) || label AS group_id, label FROM r)" + _SPLIT.format(src="q"))
def group_split(spark, d):
    b = base(spark, d).withColumn("group_id", F.concat(F.substring(F.md5("text"), 1, 3), "label"))
    return H.group_split(b).select("id", "group_id", "label", "split")


@query(f"WITH {_R}" + _SPLIT.format(src="r").replace("id, r.group_id", "r.id, r.group_id"))
def group_split_mixed(spark, d):
    return H.group_split(base(spark, d)).select("id", "group_id", "label", "split")


@query(f"""WITH {_R}
SELECT 'duplicate_id' AS code, id::VARCHAR AS detail FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing_group', id::VARCHAR FROM r WHERE coalesce(group_id, '') = ''
UNION ALL SELECT 'invalid_label', id::VARCHAR FROM r WHERE label NOT IN ('good', 'poor') UNION ALL SELECT 'invalid_or_empty_input', id::VARCHAR FROM r WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT 'group_overlap', group_id || ':' || string_agg(DISTINCT split, ',' ORDER BY split) FROM r GROUP BY group_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'exact_input_overlap', min(id)::VARCHAR FROM r GROUP BY {N.format('text')} HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'too_few_independent_test_units', count(DISTINCT group_id)::VARCHAR FROM r WHERE split = 'test' HAVING count(DISTINCT group_id) < 200""")
def audit_errors(spark, d):
    return H.audit_errors(base(spark, d), ["good", "poor"], 200)


@query(f"WITH {_R} SELECT split, count(*) AS records, count(DISTINCT group_id) AS groups, count(DISTINCT label) AS labels FROM r GROUP BY ALL")
def audit_counts(spark, d):
    return H.audit_counts(base(spark, d))


@query(f"WITH {_R}, h AS (SELECT split, sha256('{{\"group_id\":\"' || group_id || '\",\"id\":' || id || ',\"label\":\"' || label || '\"}}') AS h FROM r) , l AS (SELECT split, substr(h, 1, 6) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT split, substr(k, 1, 3) AS p, sha256(string_agg(h, chr(10) ORDER BY k)) AS h, sum(n) AS n FROM l GROUP BY ALL) SELECT split, sum(n)::BIGINT AS rows, sha256(string_agg(h, chr(10) ORDER BY p)) AS manifest_sha256 FROM m GROUP BY ALL")
def manifest_hash(spark, d):
    return H.manifest_hash(base(spark, d), ["id", "group_id", "label"], ["split"])


@query("WITH s AS (SELECT split, group_id, count(*) AS n FROM records GROUP BY ALL) SELECT split, count(*) AS groups, min(n) AS least, max(n) AS most, round(sum(n) ** 2 / sum(n * n), 6) AS kish_n, max(n) = 1 AS one_per_group FROM s GROUP BY ALL")
def kish_n(spark, d):
    k = H.kish(base(spark, d), ["split"])
    return k.withColumn("kish_n", rounded("kish_n", 6))


@query("SELECT gold_label AS label, count(*) AS n FROM records WHERE split = 'train' GROUP BY gold_label ORDER BY n DESC, list_position(['good', 'poor', 'toxic', 'rare'], gold_label) LIMIT 1")
def majority_class(spark, d):
    counts = base(spark, d).filter("split = 'train'").groupBy("label").agg(F.count("*").alias("n"))
    position = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    return counts.agg(F.max(F.struct("n", -position, "label")).alias("best")).select("best.label", "best.n")


@query("SELECT s.split, l.label, count(r.item_id) AS support FROM (VALUES ('train'), ('validation'), ('test')) s(split) CROSS JOIN (VALUES ('good'), ('poor'), ('toxic'), ('rare')) l(label) LEFT JOIN records r ON r.split = s.split AND r.gold_label = l.label GROUP BY ALL")
def label_support(spark, d):
    frame = spark.createDataFrame([(s, x) for s in H.SPLITS for x in LABELS], "split string, label string")
    counts = base(spark, d).groupBy("split", "label").agg(F.count("*").alias("support"))
    return F.broadcast(frame).join(counts, ["split", "label"], "left").na.fill(0, ["support"])


@query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY ALL")
def label_universe(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT a.split AS a, b.split AS b, count(DISTINCT a.group_id) AS shared_groups FROM records a JOIN records b ON a.group_id = b.group_id AND a.split < b.split GROUP BY ALL")
def partition_overlap(spark, d):
    g = base(spark, d).select("split", "group_id").distinct()
    a, b = g.select(F.col("split").alias("a"), "group_id"), g.select(F.col("split").alias("b"), "group_id")
    return a.join(b, "group_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared_groups"))


@query("SELECT group_id, count(DISTINCT split) AS splits, count(DISTINCT gold_label) AS labels FROM records GROUP BY ALL HAVING count(DISTINCT split) > 1 OR count(DISTINCT gold_label) > 1")
def group_integrity(spark, d):
    return base(spark, d).groupBy("group_id").agg(F.count_distinct("split").alias("splits"), F.count_distinct("label").alias("labels")).filter("splits > 1 or labels > 1")


@query(f"SELECT md5({N.format('text')}) AS unit, count(DISTINCT split) AS splits, count(DISTINCT gold_label) AS labels, min(item_id) AS first_id FROM records GROUP BY {N.format('text')} HAVING count(*) > 1")
def unit_consistency(spark, d):
    k = base(spark, d).groupBy(F.md5(T.normalized_text(F.col("text"))).alias("unit"))
    return k.agg(F.count_distinct("split").alias("splits"), F.count_distinct("label").alias("labels"), F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")


@query("SELECT n_nationkey % 5 AS id, count(*) AS n FROM nation GROUP BY ALL HAVING count(*) > 1")
def dup_ids(spark, d):
    return table(spark, d, "nation").groupBy((F.col("n_nationkey") % 5).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


@query(f"SELECT doc_id, md5({N.format('text')}) AS normalized_md5, length({N.format('text')}) AS n FROM documents")
def normalized_text(spark, d):
    n = T.normalized_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(n).alias("normalized_md5"), F.char_length(n).cast("long").alias("n"))


@query(None)
def normalized_text_exact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.exact_normalized_text(F.col("text"))).alias("normalized_md5"))


@query(f"SELECT item_id, '{{\"query\":' || to_json({N.format('text')}) || ',\"text\":' || to_json({N.format('text')}) || '}}' AS input_key FROM benchmark")
def input_key(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", T.input_key({"text": F.col("text"), "query": F.col("text")}).alias("input_key"))


@query("SELECT doc_id, len(t) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9]+')) AS t FROM documents)")
def tokens(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@query("SELECT item_id, len(g) AS n, len(list_distinct(g)) AS distinct_n FROM (SELECT item_id, [substr(text, i, 3) for i in range(1, length(text) - 1)] AS g FROM benchmark)")
def char_ngrams(spark, d):
    g = T.char_ngrams(F.col("text"), 3)
    return table(spark, d, "benchmark").select("item_id", F.size(g).cast("long").alias("n"), F.size(F.array_distinct(g)).cast("long").alias("distinct_n"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slug(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped_md5"))


RULES = {"english": ["the ", " and "], "german": [" der ", " und "], "french": [" le ", " et "]}


@query("SELECT doc_id, CASE WHEN contains(t, 'the ') OR contains(t, ' and ') THEN 'english' WHEN contains(t, ' der ') OR contains(t, ' und ') THEN 'german' WHEN contains(t, ' le ') OR contains(t, ' et ') THEN 'french' ELSE 'english' END AS prediction, CASE WHEN contains(t, 'the ') OR contains(t, ' and ') OR contains(t, ' der ') OR contains(t, ' und ') OR contains(t, ' le ') OR contains(t, ' et ') THEN 0.85::DOUBLE ELSE 0.08::DOUBLE END AS confidence FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def rule_predict(spark, d):
    s = T.keyword_scores(F.col("text"), RULES, 0.85, 0.08)
    return table(spark, d, "documents").select("doc_id", T.argmax(s).alias("prediction"), F.greatest(*s.values()).alias("confidence"))


@query("SELECT d.doc_id, coalesce(list_any_value([x for x in ['the', 'onst', 'eaux', 'ción', 'schung'] if contains(lower(d.text), x) AND contains(lower(b.text), x)]) IS NOT NULL, false) AS relevant FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)")
def rule_relevance(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("q"))
    p = paired(spark, d).select("doc_id", F.lower("text").alias("p"), "item_id")
    terms = F.array(*map(F.lit, ["the", "onst", "eaux", "ción", "schung"]))
    return p.join(b, "item_id").select("doc_id", F.exists(terms, lambda t: F.contains(F.col("q"), t) & F.contains(F.col("p"), t)).alias("relevant"))


@query("""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark), p AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT doc_id, item_id, len(list_intersect(q, w)) AS shared, round(len(list_intersect(q, w)) / greatest(1, len(list_distinct(list_concat(q, w)))), 6) AS jaccard, round(len(list_intersect(q, w)) / greatest(1, len(q)), 6) AS coverage FROM p JOIN t ON item_id = doc_id % (SELECT count(*) FROM benchmark)""")
def token_jaccard(spark, d):
    tok = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    t = table(spark, d, "benchmark").select("item_id", tok(F.col("text")).alias("q"))
    p = paired(spark, d).select("doc_id", "item_id", tok(F.col("text")).alias("w"))
    j = p.join(t, "item_id")
    return j.select("doc_id", "item_id", F.size(F.array_intersect("q", "w")).cast("long").alias("shared"), rounded(T.jaccard(F.col("q"), F.col("w")), 6).alias("jaccard"), rounded(T.coverage(F.col("q"), F.col("w")), 6).alias("coverage"))


@query(_FAMILY + f", s AS (SELECT id, split, 'lexical_text_repeat' AS reason, kept_id FROM (SELECT id, split, first_value(id) OVER (PARTITION BY {N.format('text')} ORDER BY {_P}, id) AS kept_id FROM r) WHERE id <> kept_id) SELECT id, split, CASE WHEN conflict THEN 'conflicting_official_labels' ELSE 'exact_input_duplicate' END AS reason, CASE WHEN NOT conflict THEN winner END AS kept_id FROM f WHERE conflict OR id <> winner UNION ALL SELECT * FROM s")
def removal_log(spark, d):
    b = base(spark, d)
    return H.exact_removed(b).unionByName(H.text_repeats(b).withColumn("reason", F.lit("lexical_text_repeat")), allowMissingColumns=True)


@query(_FAMILY + ", x AS (SELECT group_id FROM f WHERE conflict) SELECT id FROM f WHERE group_id NOT IN (SELECT group_id FROM x WHERE group_id IS NOT NULL)")
def anti_removed(spark, d):
    f = H.exact_families(base(spark, d))
    return f.select("id", "group_id").join(f.filter("conflict").select("group_id"), "group_id", "left_anti").select("id")


@query(f"WITH {_R}, s AS (SELECT id FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_H8.format("'7:' || id")}, id) <= 10) SELECT id, label, split FROM r WHERE id IN (SELECT id FROM s)")
def semi_selected(spark, d):
    b = base(spark, d)
    return b.join(H.capped_stratified(b, 10, "7").select("id"), "id", "left_semi").select("id", "label", "split")
