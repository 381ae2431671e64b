"""Markup queries over ``pages``; tables, which the pages lack, are made of ``part`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import stripped
from ..operators import markup as M
from . import load, query


def _strip_sql(c: str) -> str:
    t = f"regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '\\[[0-9]+\\]', '', 'g')"
    for e, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{e}', '{ch}')"
    return f"trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"SELECT page_id, {_strip_sql('html')} AS text FROM pages")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", stripped(F.col("html")).alias("text"))


_RED = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in ("script", "style", "nav", "sup", "footer"):
    _RED = f"regexp_replace({_RED}, '(?s)<{_t}[^>]*>.*?</{_t}>', '', 'g')"
_RED = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_RED}, '<p[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '[ ]*\\n[ \\n]*', chr(10), 'g'))"


@query(f"SELECT page_id, {_RED} AS text FROM pages")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", M.reduced(F.col("html")).alias("text"))


@query(f"""WITH l AS (SELECT page_id, unnest(range(len(a))) AS tbl, unnest(a) AS body FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:ul|ol)[^>]*>(.*?)</(?:ul|ol)>', 1) AS a FROM pages)),
i AS (SELECT page_id, tbl, unnest(range(len(a))) AS r, unnest(a) AS item FROM (SELECT page_id, tbl, regexp_extract_all(body, '(?s)<li[^>]*>(.*?)</li>', 1) AS a FROM l))
SELECT page_id, tbl::INTEGER AS tbl, r::INTEGER AS row, {_strip_sql('item')} AS entry FROM i""")
def html_lists(spark: SparkSession, sf: str) -> DataFrame:
    return M.list_rows(load(spark, sf, "pages")).select("page_id", "tbl", "row", "entry")


@query(f"""SELECT page_id, CASE WHEN len(h) > 0 THEN {_strip_sql('h[-1]')} END AS heading FROM (SELECT page_id, regexp_extract_all(split_part(html, '<footer', 1), '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS h FROM pages)""")
def html_heading(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", M.heading_before(F.col("html"), "footer").alias("heading"))


def part_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each brand with a table of its parts; the type's cell is missing where the size is even."""
    cell = F.concat(F.lit("<tr><td>"), F.col("p_name"), F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td>"), F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("<td><b>"), F.col("p_type"), F.lit("</b></td>"))).otherwise(""), F.lit("</tr>"))
    rows = load(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", cell.alias("c")))), lambda x: x["c"]), "").alias("b"))
    return rows.select(F.col("p_brand").alias("page_id"), F.concat(F.lit("<h2>x</h2><table><tr><th>Name</th><th>Size</th><th>Type</th></tr>"), "b", F.lit("</table>")).alias("html"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part)
SELECT p_brand AS page_id, r::INTEGER AS row, 0 AS col, 'Name' AS header, trim(regexp_replace(p_name, '[ ]+', ' ', 'g')) AS entry FROM p UNION ALL SELECT p_brand, r::INTEGER, 1, 'Size', p_size::VARCHAR FROM p
UNION ALL SELECT p_brand, r::INTEGER, 2, 'Type', CASE WHEN p_size % 2 = 1 THEN p_type ELSE '-' END FROM p""")
def html_table(spark: SparkSession, sf: str) -> DataFrame:
    return M.table_rows(part_tables(spark, sf)).select("page_id", "row", "col", "header", "entry")


TYPED = "t AS (SELECT n_regionkey AS tbl, 0 AS col, c_custkey AS row, c_name AS entry, c_mktsegment AS type, c_acctbal > 0 AS matches_title FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 0, c_custkey, c_name || '*', 'ANY', true FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def typed(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = c.select(F.col("n_regionkey").alias("tbl"), F.lit(0).alias("col"), F.col("c_custkey").alias("row"), F.col("c_name").alias("entry"), F.col("c_mktsegment").alias("type"), (F.col("c_acctbal") > 0).alias("matches_title"))
    return a.unionByName(a.withColumns({"entry": F.concat("entry", F.lit("*")), "type": F.lit("ANY"), "matches_title": F.lit(True)}))


@query(f"""WITH {TYPED}, n AS (SELECT tbl, col, count(DISTINCT row) AS n_rows FROM t GROUP BY 1, 2), f AS (SELECT tbl, col, type, count(DISTINCT row) AS freq, bool_or(matches_title) AS m FROM t GROUP BY 1, 2, 3)
SELECT tbl, type, freq, row_number() OVER (PARTITION BY tbl, col ORDER BY freq DESC, type DESC)::INTEGER AS rank FROM f JOIN n USING (tbl, col) WHERE freq > n_rows - 1 OR (m AND freq > n_rows / 2)""")
def table_common_types(spark: SparkSession, sf: str) -> DataFrame:
    return M.common_types(typed(spark, sf)).select("tbl", "type", "freq", "rank")


@query(f"""WITH {TYPED}, f AS (SELECT tbl, col, type, count(DISTINCT row) AS freq FROM t GROUP BY 1, 2, 3), b AS (SELECT tbl, col, row, max(freq) AS best FROM t JOIN f USING (tbl, col, type) GROUP BY 1, 2, 3)
SELECT tbl, col, count(*) AS typed_rows, (100 * sum(best) // (count(*) * count(*)))::BIGINT AS coherence FROM b GROUP BY 1, 2""")
def table_coherence(spark: SparkSession, sf: str) -> DataFrame:
    return M.coherence(typed(spark, sf))


@query(f"""WITH {TYPED}, f AS (SELECT tbl, col, type, count(*) AS freq FROM t GROUP BY 1, 2, 3), e AS (SELECT tbl, row, entry, max(freq) AS m, sum(freq) AS s FROM t JOIN f USING (tbl, col, type) GROUP BY 1, 2, 3)
SELECT tbl, row, entry FROM (SELECT *, row_number() OVER (PARTITION BY tbl, row ORDER BY m DESC, s DESC, entry) AS r FROM e) WHERE r = 1""")
def table_row_preference(spark: SparkSession, sf: str) -> DataFrame:
    return M.preferred_entries(typed(spark, sf)).select("tbl", "row", "entry")


@query("""WITH h AS (SELECT user_id AS query, event_id AS rank, value AS relevance FROM events), x AS (SELECT *, sum(CASE WHEN relevance < 20 THEN 1 ELSE 0 END) OVER w AS low, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY query ORDER BY rank)) SELECT query, rank FROM x WHERE low = 0 AND n <= 10""")
def html_rank_follow(spark: SparkSession, sf: str) -> DataFrame:
    h = load(spark, sf, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("rank"), F.col("value").alias("relevance"))
    return M.followed(h, least=20).select("query", "rank")
