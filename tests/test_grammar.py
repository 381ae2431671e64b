"""Class strings and rules, readers of bytes, buckets, filters of models and errors of fixpoints."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from narrata.operators import grammar as G
from narrata.operators import graph
from narrata.operators import lm as L
from narrata.operators import relational as R
from narrata.sources import sinks, triples


def test_classes_and_rules(spark):
    docs = spark.createDataFrame([(1, "The old man, quickly running, has seen 12 dogs. Mr Smith is called Zoé!\nWho knows?"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["sentence"]: r["classes"] for r in G.class_strings(docs).collect()}
    assert got == {0: "dNN,ai,hvZN", 1: "uPbCP", 2: "qk"}
    rows = {(r["rule"], r["n"], r["words"]) for r in G.matched(G.class_strings(docs), "names").collect()}
    assert ("titled", 1, 2) in rows


def test_rules_are_valid_and_name_no_unknown_rule():
    for _, _, rule in G.RULES:
        re.compile(G.expanded(rule))
    assert len(G.FAMILIES) == 25
    words = [w for ws in G.CLOSED.values() for w in ws.split()]
    assert len(words) == len(set(words)) and all(len(k) == 1 for k in G.CLOSED)


def test_long_runs_without_stops(spark):
    texts = ["house, " * 20_000, "the " * 20_000, "Anna and " * 20_000, "of the old house that he " * 4_000, "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = G.class_strings(docs).cache()
    assert s.agg(F.max(F.length("classes"))).first()[0] == 200
    for family in G.FAMILIES:
        assert G.matched(s, family).count() >= 0


def test_buckets_claims_and_cascades(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("v"))
    sinks.write_bucketed(df, str(tmp_path / "b"), "doc_id")
    got = sinks.read_bucket(spark, str(tmp_path / "b"), "doc_id", 77)
    assert [(r["doc_id"], r["v"]) for r in got.collect()] == [(77, 2)] and "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().toString()
    assert [r["worker"] for r in R.claimed(df, ["doc_id"], 3).orderBy("doc_id").collect()] == [0, 1, 2]
    left = R.delete_cascade({"a": df, "b": df.filter("v = 0")}, df.filter("v = 0"), "doc_id")
    assert left["b"].count() == 0 and left["a"].count() == 133


def test_charsets(spark):
    rows = [(b"caf\xc3\xa9", "UTF-8", "café"), (b"caf\xe9 \x80", "windows-1252", "café €"), (b"\xfe\xff\x00c\x00\xe9", "UTF-16", "cé"), (b"", "UTF-8", ""), (b"\xef\xbb\xbfx", "UTF-8", "x")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, content binary")
    got = [(r["c"], r["t"]) for r in df.select("i", triples.charset(F.col("content")).alias("c"), triples.decoded(F.col("content")).alias("t")).orderBy("i").collect()]
    assert got == [r[1:] for r in rows]


def test_filters_of_models(spark):
    grams = spark.createDataFrame([(1, "a"), (2, "a b"), (2, "b a"), (2, "a c"), (2, "a a")], "n int, gram string")
    vocab = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "a")], "sent long, word string")
    assert sorted(map(tuple, L.restrict_to_any(grams, vocab).select("sent", "gram").collect())) == [(1, "a"), (1, "a a"), (1, "a b"), (1, "b a"), (2, "a"), (2, "a a"), (2, "a c")]
    phrases = spark.createDataFrame([(["x", "a", "b"],)], "words array<string>")
    assert sorted(r["gram"] for r in L.restrict_to_phrases(grams, phrases).collect()) == ["a", "a b"]


def test_fixpoints_end_with_an_error_not_silently(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(8)], "child string, parent string")
    start = spark.createDataFrame([("0",)], "node string")
    assert graph.closure(start, edges, []).count() == 8
    with pytest.raises(RuntimeError):
        graph.closure(start, edges, [], most=5)
    with pytest.raises(RuntimeError):
        graph.hypernym_path(start, edges, most=5)
