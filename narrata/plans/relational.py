"""The relational surface: filters, joins, aggregates, windows, set operations and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from . import load, query


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 AND source <> 'src0'")
def src_unprocessed_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.filter((F.col("lang") == "en") & (F.col("n_chars") > 500) & (F.col("source") != "src0")).select("doc_id", "source", "n_chars")


@query("SELECT count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, sum(CASE WHEN lang='en' THEN 1 ELSE 0 END)::BIGINT AS n_en FROM documents")
def src_progress_agg(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("n_en"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '1') ORDER BY p_partkey LIMIT 50")
def src_title_search(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").filter(F.lower("p_name").contains("1")).select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query("SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def word_form_join(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = load(spark, sf, "orders"), load(spark, sf, "customer"), load(spark, sf, "nation")
    return o.filter("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0 AND l_returnflag IN ('R','A') AND l_quantity >= 30")
def filter_parity_in(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.filter((F.col("l_linenumber") % 2 == 0) & F.col("l_returnflag").isin("R", "A") & (F.col("l_quantity") >= 30)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE (p_size & 9) = 9")
def filter_bitmask(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").filter(R.has_flags(F.col("p_size"), 9)).select("p_partkey")


@query("SELECT r_name, n_name FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 = 0) ON r_regionkey = n_regionkey")
def case_counts_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").filter("n_nationkey % 3 = 0")
    return load(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def relation_in_lookup(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").filter("o_totalprice > 300000")
    return load(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_new_sources(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").join(load(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT item_id FROM benchmark WHERE EXISTS (SELECT 1 FROM documents d WHERE d.text = benchmark.text)")
def semi_known_titles(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").join(load(spark, sf, "documents").select("text"), "text", "left_semi").select("item_id")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = load(spark, sf, "nation").alias("a"), load(spark, sf, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""WITH p AS (SELECT l_suppkey, l_returnflag, count(*) AS n_pair FROM lineitem GROUP BY 1, 2), v AS (SELECT l_returnflag, sum(n_pair)::BIGINT AS n_verb FROM p GROUP BY 1)
SELECT l_suppkey, l_returnflag, n_pair, n_verb, n_pair / n_verb AS ratio FROM p JOIN v USING (l_returnflag) WHERE n_pair >= 10 AND n_verb >= 100""")
def lift_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return R.lift(load(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", 10, 100).select("l_suppkey", "l_returnflag", "n_pair", "n_verb", "ratio")


@query("""SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q, max(l_quantity) AS top FROM lineitem GROUP BY l_partkey HAVING count(*) > 25 AND sum(l_quantity) > 700""")
def combined_lift_having(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.max("l_quantity").alias("top"))
    return g.filter("n > 25 AND q > 700")


@query("""SELECT word, count(*) AS n FROM (SELECT c_name AS word FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT p_brand FROM part) GROUP BY word""")
def union_all_nouns(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"), ("region", "r_name"), ("part", "p_brand")):
        x = load(spark, sf, t).select(F.col(c).alias("word"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) % 7 + 101)::BIGINT AS partition FROM customer")
def partition_assign(spark: SparkSession, sf: str) -> DataFrame:
    return R.round_robin(load(spark, sf, "customer").select("c_custkey"), "c_custkey", 7)


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, n FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS r FROM c) WHERE r = 1""")
def mode_winners(spark: SparkSession, sf: str) -> DataFrame:
    return R.modes(load(spark, sf, "part"), ["p_brand"], "p_type").select("p_brand", "p_type", "n")


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT n, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS members, count(*) AS n_keys FROM c GROUP BY n""")
def count_reverse_map(spark: SparkSession, sf: str) -> DataFrame:
    return R.by_count(load(spark, sf, "lineitem"), "l_suppkey")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def delete_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    gone = load(spark, sf, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return R.delete_in(load(spark, sf, "customer"), gone, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("""SELECT user_id, count(*) AS n, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""")
def upsert_add(spark: SparkSession, sf: str) -> DataFrame:
    """A table of counters built from the first half of the events and an additive upsert of the second."""
    e = load(spark, sf, "events").select("user_id", F.lit(1).cast("long").alias("n"), "event_type", "event_id")
    half = lambda c: e.filter(c).groupBy("user_id").agg(F.sum("n").alias("n"), F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
    out = R.upsert_add(half("event_id % 2 = 0"), half("event_id % 2 = 1"), ["user_id"], ["n"], ["event_type"], "event_id")
    return out.select("user_id", "n", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big ' || p_name ELSE p_name END AS p_name, p_size FROM part""")
def replace_into(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return R.replace_rows(p, p.filter("p_size > 25").withColumn("p_name", F.concat(F.lit("big "), F.col("p_name"))), ["p_partkey"])


@query("SELECT s_suppkey, s_name FROM supplier UNION SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    new = load(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return R.insert_ignore(load(spark, sf, "supplier").select("s_suppkey", "s_name"), new, ["s_suppkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_shippriority FROM (SELECT *, (o_orderkey % 16 | 4) AS o_shippriority FROM orders)")
def update_where_flags(spark: SparkSession, sf: str) -> DataFrame:
    o = R.update_where(load(spark, sf, "orders"), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000), o_orderstatus=F.lit("X"))
    return o.select("o_orderkey", "o_orderstatus", R.set_flags(F.col("o_orderkey") % 16, 4).alias("o_shippriority"))


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("source", "lang").distinct()


@query("""SELECT user_id, event_type, n, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS a, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS b
FROM (SELECT user_id, event_type, count(*) AS n, max(value) AS v FROM events GROUP BY 1, 2)) WHERE a <= 2 OR b <= 2""")
def topk_union(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    return R.top_union(g, ["user_id"], "event_type", ["n", "v"], 2)


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'purchase' THEN event_id END AS t FROM events),
d AS (SELECT user_id, event_id, max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b, min(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT user_id, event_id, least(event_id - b, a - event_id) AS distance FROM d""")
def nearest_distance(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_id", "event_type")
    return R.nearest(e, "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "distance")


@query("""WITH s AS (SELECT user_id, event_id AS b, event_id + 40 AS e FROM events WHERE event_type = 'signup')
SELECT p.user_id, p.event_id, s.b FROM events p JOIN s ON p.user_id = s.user_id AND p.event_id >= s.b AND p.event_id < s.e""")
def interval_containment(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("b"), (F.col("event_id") + 40).alias("e"))
    return R.within(e.select("user_id", "event_id"), spans, "user_id", "event_id", "b", "e").select("user_id", "event_id", "b")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY sum_qty DESC, l_returnflag, l_linestatus LIMIT 3""")
def relation_exclusion_topn(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"))
    return g.orderBy(F.desc("sum_qty"), "l_returnflag", "l_linestatus").limit(3)


@query("""SELECT conv_id, turn, lag(role) OVER w AS before, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS n_user FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def running_pointers(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    run = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, sf, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), run.alias("n_user"))


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events)
SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 1 PRECEDING) AS n_before, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_mark FROM e""")
def window_frames(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    mark = F.last(F.when(F.col("event_type") == "error", F.col("event_id")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, sf, "events").select("user_id", "event_id", F.count("*").over(w.rangeBetween(-500, -1)).alias("n_before"), mark.alias("last_mark"))


@query("""SELECT quality, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS toxic_0, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS toxic_1 FROM labels GROUP BY quality""")
def tag_confusion(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "labels").groupBy("quality").pivot("toxic", [0, 1]).count()
    return p.select("quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


@query("""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_has_any(list(l_returnflag), ['R']) AND NOT list_has_any(list(l_returnflag), ['N'])""")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return g.filter(F.arrays_overlap("f", F.array(F.lit("R"))) & (F.size(F.array_intersect("f", F.array(F.lit("N")))) == 0)).select("l_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 300 ORDER BY o_orderkey LIMIT 100")
def page_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").filter("o_orderkey > 300").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")
