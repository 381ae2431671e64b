"""Span patterns over ``benchmark`` and ``conversations`` texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns as P
from ..operators.corpus import tokens
from . import load, query
from .text import COVER

TOKP = "tok AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS w FROM (SELECT item_id AS doc_id, regexp_extract_all(text, '[A-Za-z]+') AS a FROM benchmark))"


def classes() -> dict:
    w = F.col("w")
    return {
        "capital": w.rlike("^[A-Z][a-z]*$"), "short": w.rlike("^[a-z]{1,3}$"), "adj": w.rlike("^[a-z]+(ly|ed|er)$"), "noun": w.rlike("^[a-z]{4,}$"), "number": w.rlike("^[0-9]+$"),
    }


def toks(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(load(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"), "[A-Za-z]+")


@query(f"""WITH {TOKP}, c AS (SELECT doc_id, pos, regexp_full_match(w, '[A-Z][a-z]*') AS ok FROM tok), j AS (SELECT doc_id, pos, ok AS a, lead(ok) OVER d AS b, lead(ok, 2) OVER d AS c FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos::INTEGER AS pos, (pos + 1)::INTEGER AS "end" FROM j WHERE a UNION ALL SELECT doc_id, pos::INTEGER, (pos + 2)::INTEGER FROM j WHERE a AND b UNION ALL SELECT doc_id, pos::INTEGER, (pos + 3)::INTEGER FROM j WHERE a AND b AND c""")
def pattern_name(spark: SparkSession, sf: str) -> DataFrame:
    t = toks(spark, sf)
    return P.match(t, P.forms(t, classes()), P.GRAMMAR[1]).select("doc_id", "pos", "end")


@query(f"""WITH {TOKP}, c AS (SELECT doc_id, pos, lower(w) IN ('of', 'in', 'with') AS p, regexp_full_match(w, '[a-z]{{4,}}') AS n FROM tok)
SELECT a.doc_id, a.pos::INTEGER AS pos, (a.pos + 2)::INTEGER AS "end", 0 AS cost FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.p AND b.n""")
def pattern_prep_noun(spark: SparkSession, sf: str) -> DataFrame:
    t = toks(spark, sf)
    p = P.Pattern("_PN", (P.Element(words={"of": 0, "in": 0, "with": 0}), P.Element({"noun": 0})))
    return P.match(t, P.forms(t, classes()), p).select("doc_id", "pos", "end", "cost")


#: The five rules over spans: single words, names, a noun phrase's beginning and head, and what is built of them.
SPANS = f"""{TOKP}, k AS MATERIALIZED (SELECT doc_id, pos, w, regexp_full_match(w, '[A-Z][a-z]*') AS cap, regexp_full_match(w, '[a-z]{{1,3}}') AS sh, regexp_full_match(w, '[a-z]+(ly|ed|er)') AS ad, regexp_full_match(w, '[a-z]{{4,}}') AS nn FROM tok),
kk AS MATERIALIZED (SELECT *, lead(cap) OVER d AS cap1, lead(cap, 2) OVER d AS cap2, lead(ad) OVER d AS ad1, lead(ad, 2) OVER d AS ad2 FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
nm AS MATERIALIZED (SELECT doc_id, pos, pos + 1 AS e FROM kk WHERE cap UNION ALL SELECT doc_id, pos, pos + 2 FROM kk WHERE cap AND cap1 UNION ALL SELECT doc_id, pos, pos + 3 FROM kk WHERE cap AND cap1 AND cap2),
pre AS MATERIALIZED (SELECT doc_id, pos, pos AS e, 0 AS cost FROM kk UNION ALL SELECT doc_id, pos, pos + 1, 1 FROM kk WHERE ad UNION ALL SELECT doc_id, pos, pos + 2, 2 FROM kk WHERE ad AND ad1
UNION ALL SELECT doc_id, pos, pos + 1, 0 FROM kk WHERE sh UNION ALL SELECT doc_id, pos, pos + 2, 1 FROM kk WHERE sh AND ad1 UNION ALL SELECT doc_id, pos, pos + 3, 2 FROM kk WHERE sh AND ad1 AND ad2),
hd AS MATERIALIZED (SELECT doc_id, pos, pos + 1 AS e, 0 AS cost FROM kk WHERE nn UNION ALL SELECT doc_id, pos, e, 1 FROM nm),
np AS MATERIALIZED (SELECT pre.doc_id, pre.pos, hd.e, min(pre.cost + hd.cost) AS cost FROM pre JOIN hd ON hd.doc_id = pre.doc_id AND hd.pos = pre.e GROUP BY 1, 2, 3),
pp AS MATERIALIZED (SELECT k.doc_id, k.pos, np.e, min(np.cost + (CASE WHEN lower(w) = 'to' THEN 1 ELSE 0 END)) AS cost FROM k JOIN np ON np.doc_id = k.doc_id AND np.pos = k.pos + 1 WHERE lower(w) IN ('of', 'in', 'with', 'to') GROUP BY 1, 2, 3),
n1 AS MATERIALIZED (SELECT np.doc_id, np.pos, pp.e, np.cost + pp.cost AS cost FROM np JOIN pp ON pp.doc_id = np.doc_id AND pp.pos = np.e),
npp AS (SELECT doc_id, pos, e, min(cost) AS cost FROM (SELECT * FROM n1 UNION ALL SELECT n1.doc_id, n1.pos, pp.e, n1.cost + pp.cost FROM n1 JOIN pp ON pp.doc_id = n1.doc_id AND pp.pos = n1.e) GROUP BY 1, 2, 3),
sp AS MATERIALIZED (SELECT doc_id, pos::INTEGER AS pos, e::INTEGER AS "end", form, cost::INTEGER AS cost, (1000 * cost // (e - pos))::BIGINT AS average FROM
(SELECT doc_id, pos, e, '_NAME' AS form, 0 AS cost FROM nm UNION ALL SELECT doc_id, pos, e, '_NP', cost FROM np UNION ALL SELECT doc_id, pos, e, '_PP', cost FROM pp UNION ALL SELECT doc_id, pos, e, '_NPP', cost FROM npp))"""


@query(f"WITH {SPANS} SELECT * FROM sp")
def pattern_np(spark: SparkSession, sf: str) -> DataFrame:
    """Bottom-up matching of the whole grammar."""
    t = toks(spark, sf)
    return P.average_cost(P.bottom_up(t, P.forms(t, classes()), P.GRAMMAR))


@query(f"""WITH RECURSIVE {SPANS}, fr AS (SELECT sp.* FROM sp LEFT JOIN tok b ON b.doc_id = sp.doc_id AND b.pos = sp.pos - 1 AND lower(b.w) = 'the' WHERE b.w IS NULL),
m AS MATERIALIZED (SELECT *, "end" - pos AS n FROM fr QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY average, "end" DESC, form) = 1), {COVER} SELECT m.* EXCLUDE (n) FROM m JOIN cv USING (doc_id, pos)""")
def pattern_winners(spark: SparkSession, sf: str) -> DataFrame:
    t = toks(spark, sf)
    return P.cover(P.winners(P.guarded(P.bottom_up(t, P.forms(t, classes()), P.GRAMMAR), t, ["the"])))


_DATE = "[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}"


@query(f"SELECT o_orderkey, regexp_extract(strftime(o_orderdate, '%Y-%m-%d'), '{_DATE}') AS d, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4)::INTEGER AS y FROM orders")
def pattern_date(spark: SparkSession, sf: str) -> DataFrame:
    s = F.date_format("o_orderdate", "yyyy-MM-dd")
    return load(spark, sf, "orders").select("o_orderkey", F.regexp_extract(s, _DATE, 0).alias("d"), F.substring(s, 1, 4).cast("int").alias("y"))
