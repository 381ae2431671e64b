"""Readers and writers: lines are made of the driver's tables and parsed by the readers' own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..sources import sinks as K
from ..sources import triples as T
from ..sources import xml as X
from ..streaming.counters import windowed
from . import load, query


def ontology_lines(spark: SparkSession, sf: str) -> DataFrame:
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    sub = j.select(F.concat(F.lit("<n/"), F.col("n_nationkey").cast("string"), F.lit(">\t<subClassOf> <r/"), F.col("r_regionkey").cast("string"), F.lit("> .")).alias("value"))
    label = n.select(F.concat(F.lit("<n/"), F.col("n_nationkey").cast("string"), F.lit('> <label> "'), F.col("n_name"), F.lit('"@en .')).alias("value"))
    rlabel = r.select(F.concat(F.lit("<r/"), F.col("r_regionkey").cast("string"), F.lit('> <label> "'), F.col("r_name"), F.lit('"@en .')).alias("value"))
    noise = spark.createDataFrame([("@prefix x: <y> .",), ("# note",), ("two fields",), ("",)], "value string")
    return sub.unionByName(label).unionByName(rlabel).unionByName(noise)


@query("""SELECT 'n/' || n_nationkey AS s, 'subClassOf' AS p, 'r/' || n_regionkey AS o FROM nation UNION ALL SELECT 'n/' || n_nationkey, 'label', n_name FROM nation UNION ALL SELECT 'r/' || r_regionkey, 'label', r_name FROM region""")
def scan_triples(spark: SparkSession, sf: str) -> DataFrame:
    return T.triples(ontology_lines(spark, sf))


@query("SELECT 'n/' || n_nationkey AS s, 'r/' || n_regionkey AS super, n_name AS label FROM nation UNION ALL SELECT 'r/' || r_regionkey, NULL, r_name FROM region")
def scan_ontology(spark: SparkSession, sf: str) -> DataFrame:
    return T.entries(T.triples(ontology_lines(spark, sf)), {"subClassOf": "super", "label": "label"})


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_graph_pattern(spark: SparkSession, sf: str) -> DataFrame:
    t = T.triples(ontology_lines(spark, sf))
    return T.select_pattern(t, ("?x", "subClassOf", "?y"), ("?x", "label", "?name"), ("?y", "label", "?region")).select("name", "region")


@query("""SELECT o_custkey AS release_id, 'order ' || o_orderkey AS title, n AS label FROM (SELECT *, unnest([o_orderpriority, o_orderstatus]) AS n FROM orders)""")
def scan_xml_releases(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    xml = F.concat(F.lit('<release id="'), F.col("o_custkey").cast("string"), F.lit('"><title>order '), F.col("o_orderkey").cast("string"), F.lit("</title><label>"), "o_orderpriority", F.lit("</label><label>"), "o_orderstatus", F.lit("</label></release>"))
    return X.releases(o.select(xml.alias("xml"))).select(F.col("release_id").cast("long").alias("release_id"), "title", "label")


@query("SELECT event_id, (props->>'k')::INTEGER AS k FROM events")
def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT conv_id AS sent, i::INTEGER AS pos, role AS word, 't' || turn AS tag FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)")
def scan_tagged(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    x = F.struct("turn", F.concat("role", F.lit("/t"), F.col("turn").cast("string")).alias("x"))
    lines = c.groupBy(F.col("conv_id").alias("sent")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda v: v["x"]), " ").alias("value"))
    return T.slash_tagged(lines)


@query("SELECT doc_id % 32 AS bucket, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def scan_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").groupBy((F.col("doc_id") % 32).alias("bucket")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS event_type_view, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS event_type_error FROM events GROUP BY user_id")
def sink_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return K.crosstab(load(spark, sf, "events"), "user_id", "event_type", ["view", "error"])


@query("""SELECT item_id AS doc_id, string_agg('<span id="' || p || '">' || w || '</span>', ' ' ORDER BY p) AS html FROM (SELECT item_id, unnest(range(len(a))) AS p, unnest(a) AS w FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}'']+') AS a FROM benchmark)) GROUP BY item_id""")
def sink_html(spark: SparkSession, sf: str) -> DataFrame:
    return K.html_page(C.tokens(load(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")))


@query("""WITH RECURSIVE t AS MATERIALIZED (SELECT item_id AS doc_id, unnest(range(len(a))) AS pos, unnest(a) AS w FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}'']+') AS a FROM benchmark)),
f AS (SELECT doc_id, pos, length(w) AS used, 0 AS row FROM t WHERE pos = 0 UNION ALL SELECT t.doc_id, t.pos, CASE WHEN used + 1 + length(w) > 60 THEN length(w) ELSE used + 1 + length(w) END, CASE WHEN used + 1 + length(w) > 60 THEN row + 1 ELSE row END
FROM f JOIN t ON t.doc_id = f.doc_id AND t.pos = f.pos + 1) SELECT doc_id, pos::INTEGER AS pos, (row // 40)::INTEGER AS page, (row % 40)::INTEGER AS line FROM f""")
def sink_layout(spark: SparkSession, sf: str) -> DataFrame:
    return K.pages_by_width(C.tokens(load(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = windowed(load(spark, sf, "events"))
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))
