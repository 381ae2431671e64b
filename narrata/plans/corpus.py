"""Corpus statistics over ``documents``, which stand for the novels; rare words stand for unknown ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from . import load, query

#: Words of at least so many documents count as known to the dictionary.
KNOWN_DOCS = 5

TOK = """tok AS (SELECT doc_id, unnest(generate_series(0, len(a) - 1)) AS pos, unnest(a) AS w FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}'']+') AS a FROM documents)),
t AS (SELECT *, lower(w) AS word FROM tok WHERE length(w) <= 32),
known AS (SELECT word FROM t GROUP BY word HAVING count(DISTINCT doc_id) >= 5)"""
PER_DOC = f"""{TOK}, f AS (SELECT doc_id, t.word, count(*) AS total, sum(CASE WHEN known.word IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown,
 sum(CASE WHEN known.word IS NULL AND regexp_full_match(w, '\\p{{Lu}}[\\p{{Ll}}'']*') THEN 1 ELSE 0 END)::BIGINT AS capitalized,
 sum(CASE WHEN known.word IS NULL AND regexp_full_match(w, '\\p{{Lu}}[\\p{{Lu}}'']+') THEN 1 ELSE 0 END)::BIGINT AS all_caps,
 arg_min(contains(w, ''''), pos) AS first_apostrophe FROM t LEFT JOIN known ON t.word = known.word GROUP BY 1, 2)"""
MERGED = f"""{PER_DOC}, m AS (SELECT word, sum(total)::BIGINT AS total, sum(unknown)::BIGINT AS unknown, sum(capitalized)::BIGINT AS capitalized, sum(all_caps)::BIGINT AS all_caps, max(doc_id) AS last_source FROM f GROUP BY word)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    return C.tokens(load(spark, sf, "documents"))


def known_words(toks: DataFrame) -> DataFrame:
    per = toks.filter(F.length("w") <= C.LONGEST).select("doc_id", F.lower("w").alias("word")).distinct()
    return per.groupBy("word").count().filter(F.col("count") >= KNOWN_DOCS).select("word")


def per_document(spark: SparkSession, sf: str) -> DataFrame:
    toks = words(spark, sf)
    return C.word_frequency(toks, known_words(toks))


@query(f"WITH {PER_DOC} SELECT * FROM f")
def wordfreq_doc(spark: SparkSession, sf: str) -> DataFrame:
    return per_document(spark, sf)


@query(f"WITH {MERGED} SELECT * FROM m")
def wordfreq_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return C.merge_frequency(per_document(spark, sf))


@query(f"WITH {MERGED} SELECT word, total, unknown FROM m WHERE unknown * 100 / total > 95")
def unknown_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return C.unknown_ratio(C.merge_frequency(per_document(spark, sf))).select("word", "total", "unknown")


@query(f"WITH {MERGED} SELECT word, total, capitalized FROM m WHERE total > 4 AND (capitalized + all_caps) / total * 100 > 95")
def proper_noun_pick(spark: SparkSession, sf: str) -> DataFrame:
    return C.proper_nouns(C.merge_frequency(per_document(spark, sf))).select("word", "total", "capitalized")


@query(f"""WITH {MERGED} SELECT word FROM m WHERE regexp_matches(word, '[À-ÖØ-öø-ÿ'']') AND NOT (total >= 25 AND floor(capitalized * 100 / total) >= 99)""")
def accent_skip(spark: SparkSession, sf: str) -> DataFrame:
    m = C.merge_frequency(per_document(spark, sf))
    return m.filter(C.accent_skip(F.col("word"), F.col("total"), F.col("capitalized"))).select("word")


BRAND = "b AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)"


def brands(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query(f"WITH {BRAND} SELECT p_brand, p_type, n, (CASE WHEN top >= 8 THEN n * 8 // top ELSE n END)::BIGINT AS scaled FROM (SELECT *, max(n) OVER (PARTITION BY p_brand) AS top FROM b)")
def usage_scale(spark: SparkSession, sf: str) -> DataFrame:
    return C.scale(brands(spark, sf), ["p_brand"], "n", 8).select("p_brand", "p_type", "n", F.col("scaled").cast("long").alias("scaled"))


@query(f"""WITH {BRAND}, s AS (SELECT *, max(n) OVER (PARTITION BY p_brand) AS hi, min(n) OVER (PARTITION BY p_brand) AS lo FROM b)
SELECT p_brand, p_type, (CASE WHEN hi < 5 OR (lo > 0 AND hi // lo < 2) THEN 0 WHEN lo = 0 OR hi // lo > 4 THEN 4 * (hi - n) // hi ELSE hi // lo - n // lo END)::BIGINT AS cost FROM s""")
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    return C.usage_cost(brands(spark, sf), ["p_brand"], "n").select("p_brand", "p_type", "cost")


@query(f"""WITH {BRAND}, s AS (SELECT *, max(n) OVER (PARTITION BY p_brand) AS hi, min(n) OVER (PARTITION BY p_brand) AS lo FROM b), x AS (SELECT *, hi / lo AS k, n / lo AS q, 4 * (hi - n) / hi AS r FROM s)
SELECT p_brand, p_type, (CASE WHEN hi < 5 OR (lo > 0 AND k < 2) THEN 0 WHEN lo = 0 OR k > 4 THEN floor(r) + (CASE WHEN r - floor(r) > 0.5 THEN 1 ELSE 0 END)
ELSE floor(k) + (CASE WHEN k - floor(k) > 0.5 THEN 1 ELSE 0 END) - floor(q) - (CASE WHEN q - floor(q) > 0.5 THEN 1 ELSE 0 END) END)::BIGINT AS cost FROM x""")
def form_cost(spark: SparkSession, sf: str) -> DataFrame:
    return C.form_cost(brands(spark, sf), ["p_brand"], "n").select("p_brand", "p_type", "cost")


@query("""WITH w AS (SELECT p_type, count(DISTINCT p_brand) AS k FROM part GROUP BY 1), j AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT p_brand AS form, count(*) AS n_words, bool_and(k = 1) AS always_alone FROM j JOIN w USING (p_type) GROUP BY p_brand""")
def form_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_brand", "p_type").distinct()
    k = p.groupBy("p_type").agg(F.count("*").alias("k"))
    return p.join(k, "p_type").groupBy(F.col("p_brand").alias("form")).agg(F.count("*").alias("n_words"), F.bool_and(F.col("k") == 1).alias("always_alone"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_discount > 0.09)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, CASE WHEN a.l_suppkey IS NULL THEN 'add' WHEN b.l_suppkey IS NULL THEN 'remove' ELSE 'keep' END AS action
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag""")
def form_diff(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return C.form_diff(li.filter("l_quantity > 48"), li.filter("l_discount > 0.09"), ["l_suppkey", "l_returnflag"])


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN quality = toxic THEN 'agree' WHEN quality = 1 AND toxic = 0 THEN 'equivalent' ELSE 'differ' END AS verdict FROM labels) GROUP BY verdict""")
def tag_compare(spark: SparkSession, sf: str) -> DataFrame:
    lab = load(spark, sf, "labels")
    same = spark.createDataFrame([(1, 0)], "tag int, other int")
    return C.compare_tags(lab.select("doc_id", F.col("quality").alias("tag")), lab.select("doc_id", F.col("toxic").alias("other")), ["doc_id"], same).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_type, count(*) AS errors FROM events GROUP BY 1), r(event_type, class, part, whole) AS (VALUES ('error', 'tagger', 3, 10), ('error', 'ours', 7, 10), ('view', 'tagger', 1, 3))
SELECT event_type, class, (errors * part // whole)::BIGINT AS n FROM e JOIN r USING (event_type)""")
def error_distribution(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("errors"))
    r = spark.createDataFrame([("error", "tagger", 3, 10), ("error", "ours", 7, 10), ("view", "tagger", 1, 3)], "event_type string, class string, part int, whole int")
    return C.spread_errors(e, r, "event_type").select("event_type", "class", "n")


@query("""SELECT word, lang, n FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS s FROM (SELECT source AS word, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE s >= 2""")
def tag_distribution(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "documents").groupBy(F.col("source").alias("word"), "lang").agg(F.count("*").alias("n"))
    return g.withColumn("s", F.sum("n").over(Window.partitionBy("word"))).filter("s >= 2").drop("s")


@query(f"""WITH {TOK}, u AS (SELECT doc_id, pos, t.word FROM t LEFT JOIN known ON t.word = known.word WHERE known.word IS NULL)
SELECT doc_id, pos::INTEGER AS pos, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM u) WHERE r = 1""")
def syntax_check(spark: SparkSession, sf: str) -> DataFrame:
    """First unknown token of each document."""
    toks = words(spark, sf)
    t = toks.filter(F.length("w") <= C.LONGEST).withColumn("word", F.lower("w")).join(known_words(toks), "word", "left_anti")
    return t.groupBy("doc_id").agg(F.min_by("word", "pos").alias("word"), F.min("pos").alias("pos"))


@query("""WITH s AS (SELECT doc_id, trim(unnest(string_split_regex(text, '[.!?]'))) AS s FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(s, '[\\p{L}'']+')) AS n FROM s)
SELECT doc_id, count(*) AS n_sentences, sum(n)::BIGINT AS n_words, max(n)::INTEGER AS longest, (sum(n) // count(*))::BIGINT AS average FROM n WHERE n > 0 GROUP BY doc_id""")
def sentence_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    n = d.select("doc_id", F.explode(F.split("text", "[.!?]")).alias("s")).withColumn("n", F.size(F.regexp_extract_all("s", F.lit(C.TOKEN), 0))).filter("n > 0")
    return n.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_words"), F.max("n").alias("longest"), F.expr("sum(n) div count(*)").alias("average"))
