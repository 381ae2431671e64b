"""Ontology queries: regions, nations and customers are the class tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from . import load, query

EDGES = "e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT r_name, 'THING' FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'CYC1', 'CYC2' UNION ALL SELECT 'CYC2', 'CYC1')"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    r, n, c = load(spark, sf, "region"), load(spark, sf, "nation"), load(spark, sf, "customer")
    e = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    e = e.unionByName(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("child"), F.col("n_name").alias("parent")))
    e = e.unionByName(r.filter("r_regionkey < 3").select(F.col("r_name").alias("child"), F.lit("THING").alias("parent")))
    return e.unionByName(spark.createDataFrame([("CYC1", "CYC2"), ("CYC2", "CYC1")], "child string, parent string"))


@query(f"""WITH RECURSIVE {EDGES}, nodes AS (SELECT DISTINCT child AS node FROM e), p AS (SELECT child, min(parent) AS parent FROM e WHERE parent IN (SELECT node FROM nodes) GROUP BY 1),
r AS (SELECT node, 0 AS rank FROM nodes LEFT JOIN p ON node = child WHERE parent IS NULL UNION ALL SELECT p.child, r.rank + 1 FROM r JOIN p ON p.parent = r.node)
SELECT nodes.node, coalesce(r.rank, 100)::INTEGER AS rank FROM nodes LEFT JOIN r ON nodes.node = r.node""")
def onto_rank(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return G.ranks(e.select(F.col("child").alias("node")).distinct(), e)


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT child AS node, parent AS super FROM e WHERE parent <> 'THING' UNION SELECT c.node, e.parent FROM c JOIN e ON c.super = e.child WHERE e.parent <> 'THING') SELECT node, super FROM c""")
def onto_closure(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return G.closure(e.select(F.col("child").alias("node")).distinct(), e, ["THING"]).select("node", "super")


@query(f"""WITH RECURSIVE {EDGES}, f AS (SELECT child, min(parent) AS up FROM e GROUP BY 1), p AS (SELECT child AS node, child AS at, child AS path FROM e UNION ALL SELECT p.node, f.up, p.path || '>' || f.up FROM p JOIN f ON p.at = f.child WHERE NOT list_contains(string_split(p.path, '>'), f.up))
SELECT DISTINCT node, arg_max(path, length(path)) AS path FROM p GROUP BY node""")
def hypernym_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return G.hypernym_path(e.select(F.col("child").alias("node")).distinct(), e)


@query("""WITH t AS (SELECT c_custkey AS entity, o_orderpriority AS type, min(o_orderkey % 5) AS confidence, count(*) AS rank FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT *, rank() OVER (PARTITION BY entity ORDER BY confidence, rank) = 1 AS preferred FROM t""")
def onto_prefer(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("type")).agg(F.min(F.col("o_orderkey") % 5).alias("confidence"), F.count("*").alias("rank"))
    t = t.join(load(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), "entity", "left_semi")
    return G.prefer(t, ["entity"], "confidence", "rank")


@query("""SELECT key, string_agg(super, '|' ORDER BY super) AS super_classes FROM (SELECT DISTINCT n_name AS key, r_name AS super FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT p_type, p_brand FROM part) GROUP BY key""")
def onto_merge(spark: SparkSession, sf: str) -> DataFrame:
    n, r, p = load(spark, sf, "nation"), load(spark, sf, "region"), load(spark, sf, "part")
    a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.lit("subClassOf").alias("p"), F.col("r_name").alias("o"))
    b = p.select(F.col("p_brand").alias("s"), F.lit("superClassOf").alias("p"), F.col("p_type").alias("o"))
    return G.merge_sources(a, b).withColumn("super_classes", F.array_join("super_classes", "|"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://m.') THEN 1 WHEN starts_with(url, 'https://') THEN 2 WHEN starts_with(url, 'http://') THEN 3 ELSE 100 END AS rank FROM pages")
def onto_category_rank(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", G.category_rank(F.col("url"), [("http://m.", 1), ("https://", 2), ("http://", 3)]).alias("rank"))


@query("""WITH k(type, canonical) AS (VALUES ('signup', 'person'), ('purchase', 'business'), ('error', 'business')) SELECT user_id AS entity, canonical, min(value) AS confidence FROM events JOIN k ON event_type = type GROUP BY 1, 2""")
def onto_known(spark: SparkSession, sf: str) -> DataFrame:
    k = spark.createDataFrame([("signup", "person"), ("purchase", "business"), ("error", "business")], "type string, canonical string")
    return G.known_types(load(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("type"), F.col("value").alias("confidence")), k)


@query("""WITH x AS (SELECT p_brand AS type, p_partkey AS seq, p_size AS confidence, string_split_regex(lower(p_name), '[ _]+') AS w FROM part),
y AS (SELECT type, seq, w[-1] AS word, CASE WHEN len(w) > 1 THEN confidence * 2 ELSE confidence END AS confidence FROM x) SELECT type, word, arg_max(confidence, seq) AS confidence FROM y GROUP BY 1, 2""")
def type_word_assoc(spark: SparkSession, sf: str) -> DataFrame:
    return G.word_associations(load(spark, sf, "part").select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("confidence"), F.col("p_name").alias("label")))


@query("""SELECT word, synonym FROM (SELECT p_brand AS word, p_type AS synonym FROM part WHERE p_size < 20 UNION SELECT p_brand, p_type FROM part WHERE p_size > 40 UNION SELECT n_name, 'land' FROM nation) EXCEPT SELECT p_brand, p_type FROM part WHERE p_size = 5""")
def wn_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select(F.col("p_brand").alias("word"), F.col("p_type").alias("synonym"), "p_size")
    n = load(spark, sf, "nation").select(F.col("n_name").alias("word"), F.lit("land").alias("synonym"))
    return G.synonyms(p.filter("p_size < 20").drop("p_size"), p.filter("p_size > 40").drop("p_size"), n, p.filter("p_size = 5").drop("p_size"))


@query("SELECT a.n_name AS node, b.n_name AS sister FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def wn_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").select(F.col("n_name").alias("child"), F.col("n_regionkey").alias("parent"))
    return G.coordinates(n)
