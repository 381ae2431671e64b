"""Queries on small tables that showed differences or cost: each against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from narrata import plans
from narrata.operators import lm as L
from narrata.operators import names as N
from narrata.operators import text as T
from narrata.plans.entities import people
from narrata.plans.language import _asked, sentences
from tests.oracle import assert_same, connect

plans.load_all()


def same(spark, folder, name: str) -> duckdb.DuckDBPyConnection:
    con = connect(str(folder))
    assert_same(plans.QUERIES[name](spark, str(folder)), con, plans.ORACLE[name])
    return con


def test_timeline_rounds_seconds(spark, tmp_path):
    """Pauses of 36,000 seconds and a part: seconds are rounded, halves to even; odd rows without a time or type."""
    hours, half = 36_000_000_000, 500_000
    times = {1: [0, hours + half], 2: [half, 2 * half + hours], 3: [3 * half, hours + 5 * half], 4: [700_000, hours + 800_000], 5: [400_000, hours + 600_000], 6: [None, 0, None], 7: [0, 1, hours * 2]}
    rows = [(i, u, t) for i, (u, t) in enumerate((u, t) for u, ts in times.items() for t in ts)]
    kinds = [None if u == 7 else ("view", "error", None)[i % 3] for i, u, _ in rows]
    t = pa.table({"event_id": [i for i, _, _ in rows], "user_id": [u for _, u, _ in rows], "ts": pa.array([t for _, _, t in rows], pa.timestamp("us")), "event_type": pa.array(kinds, pa.string())})
    pq.write_table(t, tmp_path / "events.parquet")
    same(spark, tmp_path, "timeline_speakers")


def test_language_models_for_many_sentences(spark, tmp_path):
    """More sentences than a mask has bits, in several passes, also repeated words, empty and null texts."""
    letters = "abcdefghijkl"
    asked = [" ".join(letters[(i * k + k) % 12] for k in range(i % 5)) for i in range(130)] + [None]
    pq.write_table(pa.table({"item_id": list(range(131)), "text": asked}), tmp_path / "benchmark.parquet")
    said = [" ".join(letters[(i * i + j * (i % 3 + 1)) % 12] for j in range(i % 9)) for i in range(80)] + [None, "", "a a a", "zz a zz"]
    pq.write_table(pa.table({"conv_id": list(range(84)), "turn": [0] * 84, "role": ["user"] * 84, "text": said}), tmp_path / "conversations.parquet")
    same(spark, tmp_path, "lm_filter_union")
    con = same(spark, tmp_path, "lm_filter_multiple")
    s, v = sentences(spark, str(tmp_path)), _asked(spark, str(tmp_path)).select("sent", F.explode("words").alias("word"))
    assert_same(L.sentences_to_any(s, 3, v, 100).groupBy("sent", "n").agg(F.count("*").alias("kept")), con, plans.ORACLE["lm_filter_multiple"])
    assert_same(L.restrict_to_any(L.counts(s, 3), v).groupBy("sent", "n").agg(F.count("*").alias("kept")), con, plans.ORACLE["lm_filter_multiple"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # n-grams meet the sentences' words before they are moved
        for name in ("lm_filter_multiple", "lm_filter_union"):
            plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            moved = plan.split("SortMergeJoin")[1:]
            assert all("w1" not in part.splitlines()[0] and "gram" not in part.splitlines()[0] for part in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_names_are_compared_once_by_kind(spark, tmp_path):
    """Many copies of few names: whole results, and the comparison of names comes behind the distinct kinds."""
    keys = [k for k in range(330) if k % 7 != 3]
    pq.write_table(pa.table({"n_nationkey": [0, 1, 2], "n_name": ["PERU", "CHINA", "KENYA"]}), tmp_path / "nation.parquet")
    pq.write_table(pa.table({"c_custkey": keys, "c_nationkey": [(k // 5) % 3 for k in keys], "c_mktsegment": [("BUILDING", "MACHINERY", "AUTOMOBILE")[k // 4 % 3] for k in keys]}), tmp_path / "customer.parquet")
    pq.write_table(pa.table({"s_suppkey": keys[:90], "s_nationkey": [k % 3 for k in keys[:90]]}), tmp_path / "supplier.parquet")
    for name in ("name_like", "name_confident", "name_merge", "name_components"):
        same(spark, tmp_path, name)
    left, right = people(spark, str(tmp_path))
    kinds = N.kinds_paired(left, right, ["block"], N.like("x", "y"))
    assert kinds.count() == kinds.distinct().count() < N.link(left, right, ["block"]).count()
    for name in ("name_like", "name_confident", "name_merge"):  # names become distinct on both sides before they are compared
        assert plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_components_of_an_id_with_two_names(spark):
    """An id that comes with two names connects them; names without a link are no nodes."""
    kind = "id string, n struct<hon:string,first:string,middle:string,last:string,suffix:string,any:string,nick:int>, block int"
    n = lambda first, last: (None, first, None, last, None, None, 0)
    left = spark.createDataFrame([("c3", n("Ann", "Roe"), 1), ("c3", n("Bob", "Poe"), 1), ("c1", n("Bob", "Poe"), 1), ("c9", n("Eve", "Low"), 1), ("c0", n("Ann", "Roe"), 2)], kind)
    right = spark.createDataFrame([("s1", n("Ann", "Roe"), 1), ("s2", n("Bob", "Poe"), 1), ("s3", n(None, "Low"), 1), ("s4", n("A", "Roe"), 2)], kind)
    got = sorted(map(tuple, N.components(left, right, ["block"]).select("node", "root").collect()))
    assert got == [("c0", "c0"), ("c1", "c1"), ("c3", "c1"), ("s1", "c1"), ("s2", "c1"), ("s4", "c0")]


def test_multiword_positions_are_not_moved(spark, tmp_path, monkeypatch):
    """Phrases of just 40 documents and of 39, repeated within a document, other scripts, no words; also by a shuffle."""
    text = ["The old Man saw the old man and the old house; it's là" if i < 40 else "old house saw old house saw old house. Ça va bien, the old" if i < 79 else "it's là va" for i in range(85)] + [None, "", "one", "...", "the old"]
    pq.write_table(pa.table({"doc_id": list(range(len(text))), "text": text}), tmp_path / "documents.parquet")
    longest = plans.QUERIES["multiword_longest"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in longest and "Aggregate" not in longest
    for near in (T.NEAR, 0):
        monkeypatch.setattr(T, "NEAR", near)
        for name in ("multiword_longest", "multiword_cover"):
            assert same(spark, tmp_path, name).execute(plans.ORACLE[name]).fetchall()
