"""Dictionary dimensions, the reading interface, table scoring and the later stages of question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import graph as G
from ..operators import markup as M
from ..operators import qa as Q
from ..operators import relations as L
from ..operators import text as T
from ..operators import views as V
from . import load, query
from .corpus import words
from .markup import TYPED, typed
from .questions import BEST, answers
from .text import FLAGS, TOKENS


@query("""WITH l AS (SELECT p_brand AS verb, arg_max((p_size % 9) || '.' || (p_partkey % 5) || '.' || p_size, p_partkey) AS class FROM part GROUP BY 1)
SELECT verb, class, ((split_part(class, '.', 1)::BIGINT << 16) | (split_part(class, '.', 2)::BIGINT << 8) | split_part(class, '.', 3)::BIGINT)::BIGINT AS number FROM l""")
def dict_verb_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    c = F.concat_ws(".", (F.col("p_size") % 9).cast("string"), (F.col("p_partkey") % 5).cast("string"), F.col("p_size").cast("string"))
    return D.verb_classes(p.select(F.col("p_brand").alias("verb"), c.alias("class"), F.col("p_partkey").alias("seq")))


@query("""SELECT kind, count(*) AS n, sum(k)::BIGINT AS words FROM (SELECT CASE WHEN regexp_matches(p_name, '^[''"]|[''"]$') THEN 'quoted' WHEN p_name LIKE '%.' THEN 'abbreviation' WHEN p_name LIKE '% %' THEN 'multi' ELSE 'single' END AS kind, len(string_split(p_name, ' ')) AS k FROM part) GROUP BY kind""")
def dict_register(spark: SparkSession, sf: str) -> DataFrame:
    r = D.register(load(spark, sf, "part").select(F.col("p_name").alias("entry")))
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))


@query("""WITH w AS (SELECT DISTINCT p_type AS word FROM part), f AS (SELECT p_type AS word, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS forms FROM part WHERE p_size < 10 GROUP BY 1), d AS (SELECT DISTINCT p_type AS word, lower(p_type) AS main_entry FROM part WHERE p_size > 45)
SELECT word, main_entry, forms FROM w LEFT JOIN d USING (word) LEFT JOIN f USING (word)""")
def dict_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").withColumnRenamed("p_type", "word")
    return D.lookup(p.select("word").distinct(), p.filter("p_size > 45").select("word", F.lower("word").alias("main_entry")).distinct(), p.filter("p_size < 10").select("word", F.col("p_brand").alias("form")))


@query("""WITH o(form, cost, preferred) AS (VALUES ('view', 1, false), ('click', 9, true)) SELECT event_id, CASE WHEN preferred THEN 0 ELSE coalesce(o.cost, 3) END AS cost FROM events LEFT JOIN o ON event_type = form""")
def dict_override_costs(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("event_id", F.lit("w").alias("word"), F.col("event_type").alias("form"), F.lit(3).alias("cost"))
    o = spark.createDataFrame([("w", "view", 1, False), ("w", "click", 9, True)], "word string, form string, cost int, preferred boolean")
    return D.override_costs(e, o).select("event_id", "cost")


@query("SELECT n_name AS word, n_regionkey = 1 AS moves FROM nation")
def dict_flagged(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").select(F.col("n_name").alias("word"), "n_regionkey")
    return D.flagged(n.select("word"), n.filter("n_regionkey = 1"), "moves")


@query("SELECT n_name AS noun, 'sail' || n_nationkey AS noun_verb FROM nation WHERE n_nationkey < 10 AND false UNION ALL SELECT n_name, 'sail' FROM nation WHERE n_nationkey < 10")
def wn_noun_verbs(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    d = F.when(F.col("n_nationkey") < 10, "One who sails the sea").otherwise("a place")
    return D.noun_verbs(n.select(F.col("n_name").alias("noun"), d.alias("definition")))


@query(f"""WITH {FLAGS}, p AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM f) SELECT doc_id, min(line)::INTEGER AS end_line FROM p WHERE (regexp_matches(upper(trim(s)), '^(THE )?END[.]?$|^FINIS[.]?$') AND trim(coalesce(b, '')) = '') OR regexp_matches(upper(s), '^[*]{{3}} ?END OF') GROUP BY doc_id""")
def text_end(spark: SparkSession, sf: str) -> DataFrame:
    return D.end_of_book(T.lines(load(spark, sf, "documents")))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'idiot') ORDER BY doc_id LIMIT 50")
def view_search(spark: SparkSession, sf: str) -> DataFrame:
    return V.search_sources(load(spark, sf, "documents"), "IDIOT").select("doc_id", "source")


@query(f"WITH {TOKENS} SELECT doc_id, pos::INTEGER AS pos, w FROM tok WHERE pos >= 20 AND pos < 30")
def view_elements(spark: SparkSession, sf: str) -> DataFrame:
    return V.elements(words(spark, sf), 20, 10)


@query(f"WITH {FLAGS} SELECT doc_id, line::INTEGER AS line, trim(s) AS title FROM f WHERE is_header AND NOT is_blank")
def view_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return V.chapters(T.lines(load(spark, sf, "documents")))


@query("SELECT conv_id AS source, role AS speaker, count(*) AS quotes, count(DISTINCT turn % 3) AS audiences FROM conversations GROUP BY 1, 2")
def view_agents(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    return V.agents(c.select(F.col("conv_id").alias("source"), F.col("role").alias("speaker"), (F.col("turn") % 3).alias("audience")))


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS uses, min(pos)::INTEGER AS first_pos, max(pos)::INTEGER AS last_pos FROM tok WHERE lower(w) = 'there' OR lower(w) = 'ther' GROUP BY doc_id HAVING count(*) FILTER (lower(w) = 'ther') = count(*)")
def view_word_info(spark: SparkSession, sf: str) -> DataFrame:
    t = words(spark, sf)
    other = t.filter(F.lower("w") == "there").select("doc_id").distinct()
    return V.word_info(t, "ther").join(other, "doc_id", "left_anti")


@query(f"WITH {TOKENS} SELECT doc_id, pos::INTEGER AS pos, (max(CASE WHEN w = 'The' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::INTEGER AS paragraph FROM tok")
def view_paragraph_start(spark: SparkSession, sf: str) -> DataFrame:
    return V.paragraph_start(words(spark, sf), "The").select("doc_id", "pos", "paragraph")


@query("""SELECT a.user_id AS doc_id, a.event_id AS pos, (SELECT string_agg(b.event_type, ',' ORDER BY b.event_id DESC) FROM (SELECT * FROM events b WHERE b.user_id = a.user_id AND b.event_id >= a.event_id - 500 AND b.event_id < a.event_id ORDER BY b.event_id DESC LIMIT 3) b) AS near FROM events a""")
def view_surrounding(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("object_id"))
    near = V.surrounding(e, 500, 3)
    return near.select("doc_id", "pos", F.when(F.size("near") > 0, F.array_join("near", ",")).alias("near"))


@query("""WITH s AS (SELECT user_id, event_id AS b, event_id + 300 AS e FROM events WHERE event_type = 'signup') SELECT s.user_id AS doc_id, s.b AS segment, string_agg(DISTINCT p.event_type, ',' ORDER BY p.event_type) AS speakers FROM s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_id >= b AND p.event_id < e GROUP BY 1, 2""")
def view_timeline(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    s = e.filter("event_type = 'signup'").select(F.col("user_id").alias("doc_id"), F.lit(None).cast("long").alias("parent"), F.col("event_id").alias("segment"), F.col("event_id").alias("begin"), (F.col("event_id") + 300).alias("end"))
    m = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("speaker"))
    return V.timeline(s, m).select("doc_id", "segment", "speakers")


@query(f"WITH {TYPED} SELECT tbl, type, CASE WHEN type = 'ANY' THEN 0 ELSE count(*) END AS n FROM t WHERE row % 2 = 1 GROUP BY tbl, type")
def table_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    return M.accumulated_types(typed(spark, sf).withColumn("confidence", F.col("row") % 2), ["ANY"]).select("tbl", "type", "n")


@query(f"WITH {TYPED}, r AS (SELECT tbl, row, bool_or(matches_title) AS m FROM t WHERE type <> 'ANY' GROUP BY 1, 2) SELECT tbl, sum(m::INT) * 4 > count(*) * 3 AS preferred FROM r GROUP BY tbl")
def table_title_preference(spark: SparkSession, sf: str) -> DataFrame:
    return M.title_preferred(typed(spark, sf).filter("type <> 'ANY'")).select("tbl", "preferred")


@query("""SELECT user_id AS doc_id, event_id // 20 AS place, 'u' AS subject, event_type AS verb, 'o' AS object, max(CASE WHEN event_id % 3 = 0 THEN 'in' END) AS prep, max(CASE WHEN event_id % 5 = 0 THEN 'p' || event_id END) AS prep_object, min(event_id) AS rel_id FROM events GROUP BY ALL""")
def relation_merge(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    g = load(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.expr("event_id div 20").alias("place"), F.lit("u").alias("subject"), F.col("event_type").alias("verb"), F.lit("o").alias("object"), F.when(i % 3 == 0, "in").alias("prep"), F.when(i % 5 == 0, F.concat(F.lit("p"), i.cast("string"))).alias("prep_object"), i.alias("rel_id"))
    return L.merged_groups(g)


@query("""WITH RECURSIVE c AS (SELECT event_id AS root, 0 AS step, event_id AS phrase FROM events WHERE event_id % 4 = 0 UNION ALL SELECT root, step + 1, phrase + 1 FROM c WHERE (phrase + 1) % 4 <> 0 AND phrase + 1 < (SELECT count(*) FROM events) AND step < 5) SELECT * FROM c""")
def relation_prep_chain(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return L.prep_chain(load(spark, sf, "events").select(i.alias("phrase"), F.when(i % 4 != 0, i - 1).alias("upon")))


@query(f"WITH {BEST} SELECT q_id, lower(answer) AS answer, max(final)::INTEGER AS final FROM h GROUP BY 1, 2")
def answer_constrained(spark: SparkSession, sf: str) -> DataFrame:
    return Q.constrained(Q.best(answers(spark, sf), "rel_id"))


@query("""WITH k AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' of x' ELSE n_name || ' of x of y' END AS full_name FROM nation) SELECT full_name AS name, 'land' AS class, name AS matched FROM k""")
def onto_extended(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    names = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" of x"))).otherwise(F.concat("n_name", F.lit(" of x of y"))).alias("name"))
    return G.extended(names, n.select(F.col("n_name").alias("name"), F.lit("land").alias("class")))


@query("SELECT c_name AS name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def onto_negative_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Names that were looked up in vain: a third is known, a fifth was looked up before."""
    c = load(spark, sf, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    none = spark.createDataFrame([], "acronym string, meaning string")
    return G.identified(c.select("name"), c.filter("c_custkey % 3 = 0").select("name", F.lit("person").alias("class")), none, c.filter("c_custkey % 5 = 0").select("name"))[1]


@query("""WITH r AS (SELECT o_orderkey AS release_id, c_mktsegment AS artist, o_orderpriority AS label FROM orders JOIN customer ON o_custkey = c_custkey), q(q_id, value) AS (VALUES (1, 'building'), (2, 'MACHINERY')),
n AS (SELECT q_id, label AS answer, count(*) AS n FROM q JOIN r ON lower(value) = lower(artist) GROUP BY 1, 2) SELECT q_id, answer, n FROM (SELECT *, rank() OVER (PARTITION BY q_id ORDER BY n DESC) AS k FROM n) WHERE k = 1""")
def answer_music(spark: SparkSession, sf: str) -> DataFrame:
    r = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = r.select(F.col("o_orderkey").alias("release_id"), F.col("c_mktsegment").alias("artist"), F.col("o_orderpriority").alias("label"), F.lit(None).cast("string").alias("title"))
    q = spark.createDataFrame([(1, "label", "artist", "building"), (2, "label", "artist", "MACHINERY")], "q_id int, wanted string, given string, value string")
    return Q.music_answers(q, r)


@query("""WITH t AS (SELECT DISTINCT user_id || ' ' || strftime(ts, '%Y-%m-%d') AS answer, event_type AS word FROM events), a AS (SELECT DISTINCT answer, 'click' AS wanted FROM t)
SELECT a.answer, min(CASE WHEN word = 'click' THEN 25000 WHEN word = 'view' THEN 50000 ELSE 100000 END) AS confidence FROM a LEFT JOIN t ON a.answer = t.answer GROUP BY 1""")
def answer_semantic(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("event_id", F.concat_ws(" ", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("answer"), F.col("event_type").alias("word"))
    syn = spark.createDataFrame([("click", "view"), ("error", "view")], "word string, synonym string")
    return Q.semantic_check(e.select("answer", F.lit("click").alias("wanted")).distinct(), e.select("answer", "word").distinct(), syn).select("answer", "confidence")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND value > 20 THEN 1 WHEN event_id % 2 = 1 AND event_type = 'view' THEN 2 WHEN event_id % 2 = 1 AND value > 20 THEN 4 WHEN event_id % 2 = 0 AND event_type = 'click' THEN 5 WHEN event_type = 'click' THEN 6 END AS reason FROM events""")
def tense_match(spark: SparkSession, sf: str) -> DataFrame:
    no, i = F.lit(False), F.col("event_id")
    q = F.struct((i % 2 == 0).alias("past"), (i % 2 == 1).alias("present"), no.alias("future"))
    a = F.struct((F.col("value") > 20).alias("past"), (F.col("event_type") == "view").alias("present"), no.alias("future"), (F.col("event_type") == "click").alias("story"), no.alias("negation"))
    e = load(spark, sf, "events").select("event_id", q.alias("q"), a.alias("a"))
    return e.select("event_id", L.tense_match(F.col("q"), F.col("a")).alias("reason"))


@query("SELECT c_custkey AS a, s_suppkey AS b FROM customer JOIN supplier ON regexp_replace(lower(c_name), '[^0-9]+', '', 'g') = regexp_replace(lower(s_name), '[^0-9]+', '', 'g')")
def identical_objects(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda c: F.regexp_replace(c, "[^0-9]+", "")
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), number("c_name").alias("name"))
    b = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), number("s_name").alias("name"))
    return Q.identical_particulars(a, b, ["name"])
