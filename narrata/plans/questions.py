"""Question answering over events read as relations: user (subject), event type (verb), value class (object)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qa as Q
from . import load, query

REL = """rel AS (SELECT event_id AS rel_id, user_id AS source, CASE WHEN event_id % 13 = 0 THEN 'he' ELSE 'user' || (user_id % 40) END AS subject, event_type AS verb, 'v' || (event_id % 6) AS object,
CASE WHEN event_id % 3 = 0 THEN 'in' END AS prep, CASE WHEN event_id % 3 = 0 THEN 'p' || (event_id % 4) END AS prep_object, event_id % 10 = 0 AS negation, event_id % 17 = 0 AS in_question FROM events)"""
QS = "q(q_id, subject, verb, object, prep, prep_object, negation) AS (VALUES (1, 'user7', 'purchase', 'v1', 'in', 'p3', false), (2, '?', 'click', 'v2', NULL, NULL, false), (3, 'user9', 'error', 'v3', NULL, NULL, true))"
SYN = "syn(word, synonym) AS (VALUES ('purchase', 'signup'), ('click', 'view'), ('v1', 'v3'), ('v2', 'v4'), ('p3', 'p1'))"


def relations(spark: SparkSession, sf: str) -> DataFrame:
    e, i, u = load(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("rel_id"), u.alias("source"), F.when(i % 13 == 0, "he").otherwise(F.concat(F.lit("user"), (u % 40).cast("string"))).alias("subject"), F.col("event_type").alias("verb"),
        F.concat(F.lit("v"), (i % 6).cast("string")).alias("object"), F.when(i % 3 == 0, "in").alias("prep"), F.when(i % 3 == 0, F.concat(F.lit("p"), (i % 4).cast("string"))).alias("prep_object"),
        (i % 10 == 0).alias("negation"), (i % 17 == 0).alias("in_question"),
    )


def questions(spark: SparkSession) -> DataFrame:
    rows = [(1, "user7", "purchase", "v1", "in", "p3", False), (2, "?", "click", "v2", None, None, False), (3, "user9", "error", "v3", None, None, True)]
    return spark.createDataFrame(rows, "q_id int, subject string, verb string, object string, prep string, prep_object string, negation boolean")


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("purchase", "signup"), ("click", "view"), ("v1", "v3"), ("v2", "v4"), ("p3", "p1")], "word string, synonym string")


def _part(p: str, worth: int) -> str:
    return f"CASE WHEN q.{p} IS NULL OR q.{p} = '?' THEN 0 WHEN c.{p} IS NULL OR c.{p} = 'he' THEN 0 WHEN q.{p} = c.{p} THEN {worth} WHEN EXISTS (SELECT 1 FROM syn WHERE word = q.{p} AND synonym = c.{p}) THEN {worth * 3 // 4} ELSE -{worth} END AS s_{p}"


SCORED = f"""{REL}, {QS}, {SYN}, k AS (SELECT q_id, verb AS v, 'exact' AS how FROM q UNION ALL SELECT q_id, synonym, 'synonym' FROM q JOIN syn ON verb = word),
s AS (SELECT k.q_id, c.rel_id, c.source, c.subject, q.subject AS qs, {_part('subject', 8)}, {_part('object', 8)}, {_part('prep_object', 4)}, CASE WHEN how = 'exact' THEN 8 ELSE 6 END AS s_verb, CASE WHEN q.prep = c.prep THEN 2 ELSE 0 END AS s_prep
 FROM k JOIN rel c ON c.verb = k.v AND NOT c.in_question JOIN q ON q.q_id = k.q_id AND q.negation = c.negation),
t AS (SELECT *, s_subject + s_verb + s_object + s_prep + s_prep_object AS total FROM s)"""


def totals(spark: SparkSession, sf: str) -> DataFrame:
    syn = synonyms(spark)
    return Q.scored(Q.candidates(questions(spark), relations(spark, sf), syn), syn)


@query(f"WITH {SCORED} SELECT q_id, rel_id, s_subject, s_verb, s_object, s_prep, s_prep_object, total FROM t")
def srg_score(spark: SparkSession, sf: str) -> DataFrame:
    return totals(spark, sf).select("q_id", "rel_id", "s_subject", "s_verb", "s_object", "s_prep", "s_prep_object", "total")


@query(f"WITH {SCORED} SELECT q_id, rel_id, total FROM t WHERE total > 14 AND (s_subject > 0 OR qs = '?')")
def srg_matched(spark: SparkSession, sf: str) -> DataFrame:
    return Q.matched(totals(spark, sf)).select("q_id", "rel_id", "total")


BEST = f"""{SCORED}, a AS (SELECT q_id, rel_id, subject AS answer, total, (1 + source % 5)::INTEGER AS confidence FROM t WHERE total >= 14),
i AS (SELECT *, count(*) OVER (PARTITION BY q_id, lower(answer)) AS identical, row_number() OVER (PARTITION BY q_id, lower(answer) ORDER BY rel_id) - 1 AS earlier FROM a),
f AS (SELECT *, total + CASE WHEN identical = max(identical) OVER (PARTITION BY q_id) AND max(identical) OVER (PARTITION BY q_id) > 1 THEN 4 ELSE 0 END + CASE WHEN confidence = min(confidence) OVER (PARTITION BY q_id) THEN 6 ELSE 0 END AS final FROM i),
g AS (SELECT *, max(final) OVER (PARTITION BY q_id) AS top FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY q_id, lower(answer) ORDER BY rel_id) AS r FROM g WHERE final = top)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return totals(spark, sf).withColumn("answer", F.col("subject")).withColumn("confidence", (1 + F.col("source") % 5).cast("int"))


@query(f"WITH {BEST} SELECT q_id, rel_id, answer, final FROM h WHERE r = 1")
def answer_best(spark: SparkSession, sf: str) -> DataFrame:
    return Q.best(answers(spark, sf), "rel_id").select("q_id", "rel_id", "answer", "final")


@query(f"WITH {BEST} SELECT q_id, rel_id, identical, earlier FROM i")
def answer_identical(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_identical(answers(spark, sf).filter("total >= 14"), "rel_id").select("q_id", "rel_id", "identical", F.col("earlier").cast("long").alias("earlier"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN (CASE c WHEN 'person' THEN 1 WHEN 'other' THEN 50000 ELSE 100000 END) WHEN 'O' THEN (CASE c WHEN 'place' THEN 1 WHEN 'other' THEN 50000 ELSE 100000 END) ELSE (CASE c WHEN 'time' THEN 1 WHEN 'other' THEN 50000 ELSE 100000 END) END AS confidence
FROM (SELECT *, ['person', 'place', 'time', 'other'][o_orderkey % 4 + 1] AS c FROM orders)""")
def answer_type_check(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    wants = F.when(F.col("o_orderstatus") == "F", "who").when(F.col("o_orderstatus") == "O", "where").otherwise("when")
    c = F.get(F.array(*map(F.lit, ("person", "place", "time", "other"))), (F.col("o_orderkey") % 4).cast("int"))
    return o.select("o_orderkey", Q.type_check(wants, c).alias("confidence"))


@query(f"WITH {REL} SELECT rel_id, subject, object, false AS swapped FROM (SELECT * FROM rel) UNION ALL SELECT rel_id, object, subject, true FROM rel WHERE verb = 'view'")
def relation_switch(spark: SparkSession, sf: str) -> DataFrame:
    """Views stand for forms of to be."""
    r = relations(spark, sf).withColumn("verb", F.when(F.col("verb") == "view", "is").otherwise(F.col("verb")))
    return Q.switched(r).select("rel_id", "subject", "object", "swapped")


@query(f"WITH {SCORED}, m AS (SELECT * FROM t WHERE s_subject > 0), n AS (SELECT *, count(*) OVER (PARTITION BY q_id, source) AS k FROM m) SELECT q_id, rel_id, (s_subject // k)::INTEGER AS s_subject FROM n")
def subject_divide(spark: SparkSession, sf: str) -> DataFrame:
    d = Q.divided(totals(spark, sf).filter("s_subject > 0").select("q_id", "source", "rel_id", "s_subject"), ["q_id", "source"], "s_subject")
    return d.select("q_id", "rel_id", F.col("s_subject").cast("int").alias("s_subject"))


@query(f"""WITH {SCORED}, a AS (SELECT DISTINCT q_id, lower(subject) AS via FROM t WHERE total > 14 AND (s_subject > 0 OR qs = '?')) SELECT t.q_id, t.rel_id FROM t JOIN a ON t.q_id = a.q_id AND lower(t.subject) = a.via WHERE s_object > 0""")
def subquery_answers(spark: SparkSession, sf: str) -> DataFrame:
    first = Q.matched(totals(spark, sf)).select("q_id", F.col("subject").alias("answer")).distinct()
    return Q.two_step(first, totals(spark, sf).filter("s_object > 0")).select("q_id", "rel_id")
