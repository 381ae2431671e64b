"""Queries of readers, writers, parses, names and answers that other modules don't cover."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lm as L
from ..operators import names as N
from ..operators import patterns as P
from ..operators import qa as Q
from ..operators import relational as R
from ..operators.markup import marked_tables
from ..sources import sinks as K
from ..sources import triples as T
from ..sources import xml as X
from . import load, query
from .language import COUNTS, ORDER, sentences

# -- writers, each read back --------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{K.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, n_chars FROM documents")
def scan_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """A table in folders by bucket, from which readers of one document open one folder."""
    where = _folder(spark, "bucketed")
    K.write_bucketed(load(spark, sf, "documents").select("doc_id", "lang", "n_chars"), where, "doc_id")
    return spark.read.parquet(where).select("doc_id", "lang", "n_chars")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_outfile(spark: SparkSession, sf: str) -> DataFrame:
    where = _folder(spark, "outfile")
    K.write_csv(load(spark, sf, "nation"), where)
    return spark.read.option("header", "true").schema("n_nationkey int, n_name string, n_regionkey int").csv(where)


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1")
def sink_batch_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Batches appended one after the other make one table."""
    where, e = _folder(spark, "inserted"), load(spark, sf, "events").select("event_id", "event_type")
    for kind in ("signup", "purchase"):
        K.insert_batch(e.filter(F.col("event_type") == kind), where)
    K.insert_batch(e.filter(~F.col("event_type").isin("signup", "purchase")), where)
    return spark.read.parquet(where).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def sink_table_as_select(spark: SparkSession, sf: str) -> DataFrame:
    return K.table_as_select(spark, load(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), _folder(spark, "ctas"))


@query("SELECT a.n_name AS name, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1")
def sink_memory_copy(spark: SparkSession, sf: str) -> DataFrame:
    """A small table kept in memory and read twice."""
    n = K.in_memory(load(spark, sf, "nation"))
    return n.join(n.select("n_regionkey", F.col("n_name").alias("other")), "n_regionkey").groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT 'n_regionkey=' || n_regionkey AS folder, 1::BIGINT AS files FROM nation GROUP BY n_regionkey")
def scan_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Files by folder of a partitioned table."""
    where = _folder(spark, "folders")
    load(spark, sf, "nation").repartition(1).write.partitionBy("n_regionkey").parquet(where)
    return T.count_files(spark, where).filter("folder like '%n_regionkey=%'").select(F.regexp_extract("folder", "([^/]+)$", 1).alias("folder"), "files")


@query("SELECT n_nationkey, n_name || ' Zoé £5' AS text, CASE n_nationkey % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'windows-1252' ELSE 'UTF-16' END AS charset FROM nation")
def scan_charset(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes in three encodings, told apart by byte order marks and validity."""
    n = load(spark, sf, "nation").withColumn("t", F.concat("n_name", F.lit(" Zoé £5")))
    k = F.col("n_nationkey") % 3
    raw = F.when(k == 0, F.encode("t", "UTF-8")).when(k == 1, F.encode("t", "ISO-8859-1")).otherwise(F.encode("t", "UTF-16"))
    return n.select("n_nationkey", raw.alias("content")).select("n_nationkey", T.decoded(F.col("content")).alias("text"), T.charset(F.col("content")).alias("charset"))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title FROM part WHERE p_size % 2 = 0 AND p_brand <> 'Brand#11'")
def scan_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue written as XML and read by row tag; books of an accepted class that aren't known yet."""
    p, where = load(spark, sf, "part"), _folder(spark, "catalogue")
    book = p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("someone").alias("creator"), F.lit("en").alias("language"),
        F.array(F.when(F.col("p_size") % 2 == 0, "PS").otherwise("QA"), F.lit("x")).alias("subject"),
    )
    book.write.format("xml").option("rootTag", "books").option("rowTag", "book").save(where)
    known = p.filter("p_brand = 'Brand#11'").select(F.col("p_partkey").cast("string").alias("id"))
    return X.accepted_books(X.catalogue(spark, where), known).select("id", "title")


@query("""SELECT lower(n_name) AS verb, 'class-' || n_regionkey AS class FROM nation UNION ALL SELECT lower(n_name) || '_sub', 'class-' || n_regionkey || '-1' FROM nation
UNION ALL SELECT 'deep' || r_regionkey, 'class-' || r_regionkey || '-1-1' FROM region""")
def scan_verb_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Verb classes as XML with two levels of subclasses."""
    n = load(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.lower("n_name"))).alias("names"))
    r = F.col("n_regionkey").cast("string")
    members = lambda end: F.concat(F.lit("<MEMBERS>"), F.array_join(F.transform("names", lambda x: F.concat(F.lit('<MEMBER name="'), x, F.lit(f'{end}"/>'))), ""), F.lit("</MEMBERS>"))
    deep = F.concat(F.lit('<SUBCLASSES><VNSUBCLASS ID="class-'), r, F.lit('-1-1"><MEMBERS><MEMBER name="deep'), r, F.lit('"/></MEMBERS><SUBCLASSES/></VNSUBCLASS></SUBCLASSES>'))
    xml = F.concat(F.lit('<VNCLASS ID="class-'), r, F.lit('">'), members(""), F.lit('<SUBCLASSES><VNSUBCLASS ID="class-'), r, F.lit('-1">'), members("_sub"), deep, F.lit("</VNSUBCLASS></SUBCLASSES></VNCLASS>"))
    return X.verb_members(n.select(F.from_xml(xml, X.verb_schema()).alias("c")))


@query("""SELECT 1 AS n, n_name AS gram, -((n_nationkey + 1) / 10.0)::DOUBLE AS log10_prob, 0.0::DOUBLE AS log10_backoff FROM nation
UNION ALL SELECT 2, n_name || ' ' || r_name, -((n_nationkey + 1) / 20.0)::DOUBLE, -0.5::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey""")
def scan_arpa(spark: SparkSession, sf: str) -> DataFrame:
    """A model of two orders in the text form that language model tools exchange."""
    p, k = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_nationkey")
    one = p.select((1001 + k).alias("k"), F.concat_ws("\t", (-(k + 1) / 10.0).cast("string"), "n_name").alias("value"))
    two = p.select((3001 + k).alias("k"), F.concat_ws("\t", (-(k + 1) / 20.0).cast("string"), F.concat_ws(" ", "n_name", "r_name"), F.lit("-0.5")).alias("value"))
    marks = spark.createDataFrame([(0, "\\data\\"), (1, "ngram 1=25"), (1000, "\\1-grams:"), (3000, "\\2-grams:"), (9000, "\\end\\")], "k long, value string")
    return T.arpa(one.unionByName(two).unionByName(marks), "k")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::INTEGER AS worker FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 8")
def work_claim(spark: SparkSession, sf: str) -> DataFrame:
    """The next open rows, one for each of eight workers."""
    return R.claimed(load(spark, sf, "orders").filter("o_orderstatus = 'O'"), ["o_orderdate", "o_orderkey"], 8).select("o_orderkey", "worker")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that lose their parent go from every table; here what is left of the first."""
    gone = load(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return R.delete_cascade({"documents": load(spark, sf, "documents"), "labels": load(spark, sf, "labels")}, gone, "doc_id")["documents"].select("doc_id")


# -- parses -------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS doc_id, string_agg(DISTINCT l_returnflag || '@' || l_linenumber, ',' ORDER BY l_returnflag || '@' || l_linenumber) AS tags FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN 2 AND 4 GROUP BY 1""")
def pattern_tag_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Tags under a match: the flags of lines 2 to 4 of each order."""
    m = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(2).alias("pos"), F.lit(5).alias("end"), F.lit("_X").alias("form"))
    n = F.col("l_linenumber")
    return P.tag_sets(m, load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("pos"), (n + 1).alias("end"), F.col("l_returnflag").alias("tag"))).select("doc_id", "tags")


@query("SELECT c_custkey AS parent, (100 - coalesce(sum(o_orderkey % 7), 0))::BIGINT AS cost FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def pattern_reduced_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Matches take over what the matches under them have saved; here customers and their orders."""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), (F.col("o_orderkey") % 7).alias("saved"))
    parents = load(spark, sf, "customer").select(F.col("c_custkey").alias("parent"), F.lit(100).cast("long").alias("cost"))
    return P.reduced_parents(parents, o.select("parent", "child"), o.select("child", "saved")).select("parent", "cost")


@query("""WITH t AS (SELECT user_id AS doc_id, event_id AS pos, event_type AS form, lag(event_type) OVER d AS b, lead(event_type) OVER d AS a FROM events WINDOW d AS (PARTITION BY user_id ORDER BY event_id))
SELECT doc_id, pos, CASE WHEN form = 'click' AND b = 'view' THEN 'verb' WHEN form = 'view' AND b = 'view' AND a = 'click' THEN 'noun' WHEN form = 'error' AND b = 'signup' THEN 'adverb' ELSE form END AS form FROM t""")
def pattern_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """Class corrections by what stands beside; a user's events are a sequence of classes."""
    t = load(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("form"))
    return P.corrected(t, [("click", "view", "", "verb"), ("view", "view", "click", "noun"), ("error", "signup", "", "adverb")])


_RULES = P.export_text(P.GRAMMAR)


@query("SELECT * FROM (VALUES {}) AS t(k, rule)".format(", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(_RULES))))
def pattern_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules written as text, read, and written again."""
    return spark.createDataFrame(list(enumerate(P.export_text(P.import_text(_RULES)))), "k int, rule string")


# -- names --------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS name_id, CASE WHEN c_custkey % 2 = 0 THEN 'Mr.' ELSE 'Mrs' END AS hon, n_name AS first, c_mktsegment AS last, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def name_parsed(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    word = lambda pos, w, tag: F.struct(F.lit(pos).alias("pos"), w.alias("w"), F.lit(tag).alias("tag"))
    hon = F.when(F.col("c_custkey") % 2 == 0, "Mr.").otherwise("Mrs")
    t = c.select(F.col("c_custkey").alias("name_id"), F.explode(F.array(word(0, hon, "hon"), word(1, F.col("n_name"), "first"), word(2, F.col("c_mktsegment"), "last"), word(3, F.col("c_mktsegment"), "other"))).alias("x"))
    return N.parsed(t.select("name_id", "x.*")).select("name_id", "n.hon", "n.first", "n.last", "gender")


@query("SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS neuter FROM supplier")
def name_neuter(spark: SparkSession, sf: str) -> DataFrame:
    k, null = F.col("s_suppkey"), F.lit(None).cast("string")
    parts = F.struct(null.alias("hon"), F.when(k % 3 == 1, "Ann").alias("first"), null.alias("middle"), F.when(k % 3 == 2, "Lee").alias("last"), null.alias("suffix"), F.col("s_name").alias("any"), F.lit(0).alias("nick"))
    return load(spark, sf, "supplier").select(k.alias("id"), parts.alias("n")).select("id", N.neuter("n").alias("neuter"))


@query("SELECT 'N' || n_nationkey AS name, 'R' || n_regionkey || 'x' AS other FROM nation WHERE n_nationkey % 2 = 0")
def name_equivalences(spark: SparkSession, sf: str) -> DataFrame:
    n, r = F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("x"))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(n, F.lit(", also known as "), r, F.lit("."))).otherwise(F.concat(n, F.lit(" met "), r))
    return N.equivalences(load(spark, sf, "nation").select(text.alias("text")))


@query("SELECT 'Nation ' || n_nationkey AS entity, CASE WHEN n_regionkey = 0 THEN 'state' ELSE 'country' END AS class FROM nation")
def onto_isa(spark: SparkSession, sf: str) -> DataFrame:
    what = F.when(F.col("n_regionkey") == 0, "a free state in").otherwise("a large country of")
    return G.isa_from_text(load(spark, sf, "nation").select(F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string"), F.lit(" is "), what, F.lit(" the world.")).alias("text")))


# -- models and answers -------------------------------------------------------------------------------------------


@query(f"""WITH {COUNTS}, m AS (SELECT n, gram, context, raw / sum(raw) OVER (PARTITION BY n, context) AS p, raw * raw / sum(raw * raw) OVER (PARTITION BY n, context) AS q FROM r),
l AS (SELECT *, 0.7 * log10(p) + 0.3 * log10(q) AS s FROM m) SELECT n::INTEGER AS n, gram, round(s - log10(sum(pow(10, s)) OVER (PARTITION BY n, context)), 6) AS log10 FROM l""")
def lm_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Two models of the same n-grams, by counts and by squared counts, mixed log-linearly."""
    c = G.cut(L.counts(sentences(spark, sf), ORDER))
    model = lambda x: c.join(c.groupBy("n", "context").agg(F.sum(x).alias("z")), ["n", "context"]).select("n", "gram", (x / F.col("z")).alias("prob"))
    return L.mix([(model(F.col("raw")), 0.7), (model(F.col("raw") * F.col("raw")), 0.3)]).withColumn("log10", F.round("log10", 6))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each nation: where it lies, or who leads it."""
    n = F.col("n_nationkey")
    verb = F.when(n % 3 == 0, "lie").when(n % 3 == 1, "lead").otherwise("own")
    null = F.lit(None).cast("string")
    return load(spark, sf, "nation").select(n.alias("q_id"), F.col("n_name").alias("subject"), verb.alias("verb"), F.lit("?").alias("object"), F.lit("in").alias("prep"), null.alias("prep_object"), F.lit(False).alias("negation"))


@query("SELECT n_nationkey AS q_id, r_name AS answer, 1000 AS total FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0")
def answer_infobox(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.lit("region").alias("property"), F.col("r_name").alias("value"))
    return Q.infobox(_questions(spark, sf), f, {"lie": "region", "lead": "leader"}).select("q_id", "answer", "total")


@query("""WITH q AS (SELECT n_nationkey AS q_id, n_name AS subject, CASE n_nationkey % 3 WHEN 0 THEN 'lie' WHEN 1 THEN 'lead' ELSE 'own' END AS verb, '?' AS object, 'in' AS prep FROM nation)
SELECT * FROM q UNION ALL SELECT q_id, object, 'contain', subject, prep FROM q WHERE verb = 'lie' UNION ALL SELECT q_id, subject, 'have', object, 'by' FROM q WHERE verb = 'own'""")
def question_transform(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("lie", "contain", None, True), ("own", "have", "by", False)], "verb string, new_verb string, new_prep string, swap boolean")
    return Q.transformed(_questions(spark, sf), rules).select("q_id", "subject", "verb", "object", "prep")


@query("""WITH a AS (SELECT n_nationkey AS q_id, n_name AS answer, CASE n_nationkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' END AS wanted FROM nation)
SELECT q_id, answer FROM a WHERE wanted IS NULL OR EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = answer AND r_name = wanted)""")
def answer_parent_group(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    wanted = F.when(F.col("n_nationkey") % 3 == 0, "asia").when(F.col("n_nationkey") % 3 == 1, "Europe")
    classes = n.join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("super"))
    return Q.parent_group(n.select(F.col("n_nationkey").alias("q_id"), F.col("n_name").alias("answer"), wanted.alias("wanted")), classes).select("q_id", "answer")


@query("SELECT user_id AS rel_id, 'user' || user_id AS subject, 'view' AS verb FROM events WHERE event_type = 'view'")
def relation_noun_verbs(spark: SparkSession, sf: str) -> DataFrame:
    """"X is a viewer" also says that X views."""
    rel = load(spark, sf, "events").select(F.col("user_id").alias("rel_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("subject"), F.lit("is").alias("verb"), F.concat("event_type", F.lit("er")).alias("object"))
    return Q.nouns_as_verbs(rel, spark.createDataFrame([("viewer", "view")], "noun string, noun_verb string")).select("rel_id", "subject", "verb")


@query("""SELECT n_nationkey AS q_id, CASE WHEN n_nationkey % 2 = 0 THEN 'fact' || n_nationkey WHEN n_nationkey % 3 = 0 THEN 'match' || n_nationkey ELSE 'near' || n_nationkey END AS answer FROM nation""")
def answer_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Facts before matches before what stands near."""
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("q_id"))
    stage = lambda name, total: n.select("q_id", F.concat(F.lit(name), F.col("q_id").cast("string")).alias("answer"), F.lit(total).alias("total"))
    return Q.staged_answers(stage("fact", 1000).filter("q_id % 2 = 0"), stage("match", 20).filter("q_id % 3 = 0"), stage("near", 1)).select("q_id", "answer")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders)
SELECT o_custkey AS doc_id, 1 AS tbl, 0 AS col, r::INTEGER AS row, 'orders of ' || o_custkey AS title, 'key' AS header, 'o' || o_orderkey AS entry FROM o""")
def table_build(spark: SparkSession, sf: str) -> DataFrame:
    """Marked text of a table for each customer, and one without a wanted title."""
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey")
    c, key = o.select("o_custkey").distinct(), F.col("o_custkey").cast("string")
    line = lambda df, k, s: df.select(F.col("o_custkey").alias("doc_id"), k.cast("long").alias("line"), s.alias("s"))
    rows = line(c, F.lit(0), F.concat(F.lit("table: orders of "), key)).unionByName(line(c, F.lit(1), F.lit("column: key"))).unionByName(line(o, 10 + F.col("o_orderkey"), F.concat(F.lit("entry: o"), F.col("o_orderkey").cast("string"))))
    far = 1_000_000_000
    rows = rows.unionByName(line(c, F.lit(far), F.lit("table: others"))).unionByName(line(c, F.lit(far + 1), F.lit("column: x"))).unionByName(line(c, F.lit(far + 2), F.lit("entry: y")))
    return marked_tables(rows, ["orders"])


# -- lexical relations and properties -------------------------------------------------------------------------------


@query("SELECT r_name AS node, n_name AS below FROM nation JOIN region ON n_regionkey = r_regionkey")
def wn_hyponyms(spark: SparkSession, sf: str) -> DataFrame:
    j = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return G.hyponyms(j.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")))


@query("""WITH p AS (SELECT DISTINCT lang || ' ' || source AS word, source AS antonym FROM documents), b AS (SELECT word, antonym FROM p UNION SELECT antonym, word FROM p), s AS (SELECT DISTINCT lang AS word, source AS synonym FROM documents)
SELECT * FROM b UNION SELECT s.word, b.antonym FROM s JOIN b ON b.word = s.synonym""")
def wn_antonyms(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    pairs = d.select(F.concat_ws(" ", "lang", "source").alias("word"), F.col("source").alias("antonym")).distinct()
    return G.antonyms(pairs, d.select(F.col("lang").alias("word"), F.col("source").alias("synonym")).distinct())


@query("""SELECT p_brand AS word, count(DISTINCT p_type) AS senses, (CASE WHEN count(DISTINCT p_type) <= 1 THEN 1 WHEN count(DISTINCT p_type) = 2 THEN 2 WHEN count(DISTINCT p_type) <= 4 THEN 3
WHEN count(DISTINCT p_type) <= 8 THEN 4 WHEN count(DISTINCT p_type) <= 16 THEN 5 ELSE 6 END) AS familiar FROM part GROUP BY 1""")
def wn_familiarity(spark: SparkSession, sf: str) -> DataFrame:
    return G.familiarity(load(spark, sf, "part").select(F.col("p_brand").alias("word"), F.col("p_type").alias("sense")))


@query("SELECT 'c' || c_custkey AS s, c_mktsegment AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(n_name) = lower('NATION_3') OR lower(r_name) = lower('NATION_3')")
def onto_properties(spark: SparkSession, sf: str) -> DataFrame:
    """A property of all subjects that a name stands for: a customer's nation is its name and the region an alias."""
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fact = lambda p, o: F.struct(F.lit(p).alias("p"), F.col(o).alias("o"))
    t = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), F.explode(F.array(fact("name", "n_name"), fact("alias", "r_name"), fact("segment", "c_mktsegment"))).alias("x")).select("s", "x.*")
    return G.properties(t, "NATION_3", "segment")
