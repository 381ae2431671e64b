"""Operators on small inputs with results worked out by hand or by brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from narrata.functions import strings as S
from narrata.operators import corpus as C
from narrata.operators import graph as G
from narrata.operators import hmm as H
from narrata.operators import lm as L
from narrata.operators import markup as M
from narrata.operators import names as N
from narrata.operators import patterns as P
from narrata.operators import qa as Q
from narrata.operators import relational as R
from narrata.operators import relations as Rel
from narrata.operators import text as T
from narrata.sources import sinks, triples, xml


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_split_and_merge_equals_one_pass(spark):
    docs = spark.createDataFrame([(i, "Anna and Anna met BOB. And so on") for i in range(6)], "doc_id long, text string")
    toks, known = C.tokens(docs), spark.createDataFrame([("and",), ("so",), ("on",), ("met",)], "word string")
    whole = C.merge_frequency(C.word_frequency(toks, known))
    parts = C.merge_frequency(C.word_frequency(toks.filter("doc_id < 3"), known).unionByName(C.word_frequency(toks.filter("doc_id >= 3"), known)))
    assert rows(whole, *whole.columns) == rows(parts, *whole.columns)
    got = {r["word"]: r for r in whole.collect()}
    assert (got["anna"]["unknown"], got["anna"]["capitalized"], got["bob"]["all_caps"], got["and"]["unknown"]) == (12, 12, 6, 0)


def test_ratio_edges(spark):
    df = spark.createDataFrame([("a", 100, 95), ("b", 100, 96), ("c", 4, 4)], "word string, total long, unknown long")
    assert rows(C.unknown_ratio(df), "word") == [("b",), ("c",)]
    p = spark.createDataFrame([("x", 4, 4, 0), ("y", 5, 5, 0), ("z", 100, 95, 0)], "word string, total long, capitalized long, all_caps long")
    assert rows(C.proper_nouns(p), "word") == [("y",)]
    a = spark.createDataFrame([("né", 24, 24), ("né", 25, 25), ("ne", 1, 0)], "w string, t long, c long")
    assert [r[0] for r in a.select(C.accent_skip(F.col("w"), F.col("t"), F.col("c"))).collect()] == [True, False, False]


def test_costs(spark):
    df = spark.createDataFrame([("w", "a", 12), ("w", "b", 0), ("w", "c", 6), ("v", "a", 4), ("v", "b", 1), ("u", "a", 9), ("u", "b", 3)], "word string, form string, n long")
    assert rows(C.usage_cost(df, ["word"], "n"), "word", "form", "cost") == [("u", "a", 0), ("u", "b", 2), ("v", "a", 0), ("v", "b", 0), ("w", "a", 0), ("w", "b", 4), ("w", "c", 2)]
    half = spark.createDataFrame([("w", "a", 8), ("w", "b", 0), ("w", "c", 5)], "word string, form string, n long")
    assert rows(C.form_cost(half, ["word"], "n"), "form", "cost") == [("a", 0), ("b", 4), ("c", 1)]  # 1.5 goes down


def test_updates_keep_null_logic(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, s string")
    assert rows(R.update_where(df, F.col("s") != "x", s=F.lit("z")).fillna("-"), "id", "s") == [(1, "-"), (2, "x"), (3, "z")]
    assert rows(R.insert_ignore(df.filter("id = 2"), df.unionByName(df), ["id"]).select("id"), "id") == [(1,), (2,), (3,)]


def test_round_robin_numbers_all_rows(spark):
    got = rows(R.round_robin(spark.range(100).repartition(7), "id", 7), "id", "partition")
    assert got == [(i, (i + 1) % 7 + 101) for i in range(100)]


def test_nearest_and_within(spark):
    df = spark.createDataFrame([(1, p, p in (3, 9)) for p in range(12)], "doc int, pos int, t boolean")
    got = dict(rows(R.nearest(df, "doc", "pos", F.col("t")), "pos", "distance"))
    assert got == {p: min(abs(p - 3), abs(p - 9)) for p in range(12)}
    spans = spark.createDataFrame([(1, 2, 200), (1, 5, 6), (1, 7, 7)], "doc int, b int, e int")
    points = spark.createDataFrame([(1, p) for p in range(0, 300, 5)], "doc int, pos int")
    assert rows(R.within(points, spans, "doc", "pos", "b", "e"), "pos", "b") == sorted([(p, 2) for p in range(5, 200, 5)] + [(5, 5)])


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    states = ["a", "b", "c"]
    for _ in range(20):
        first, trans = np.log(rng.dirichlet(np.ones(3))), np.log(rng.dirichlet(np.ones(3), 3))
        emit = {w: np.log(rng.random(3)) for w in "xyz"}
        words = [str(w) for w in rng.choice(list("xyz"), 5)]

        def score(path):
            s = first[path[0]] + emit[words[0]][path[0]]
            return s + sum(trans[i, j] + emit[w][j] for i, j, w in zip(path, path[1:], words[1:], strict=False))

        best = max(itertools.product(range(3), repeat=5), key=score)
        assert H.viterbi(words, states, first, trans, emit, np.zeros(3)) == [states[i] for i in best]
    assert H.viterbi([], states, np.zeros(3), np.zeros((3, 3)), {}, np.zeros(3)) == []


def test_language_model_probabilities_sum_to_one(spark):
    s = spark.createDataFrame([(i, t.split()) for i, t in enumerate(["a b c", "a b", "b c a", "c", "a a b", "b b c"])], "sent long, words array<string>")
    adj = L.adjusted(L.counts(s, 2), 2)
    d = L.discounts(adj)
    p = {r["gram"]: r["prob"] for r in L.probabilities(adj, d, 2).collect()}
    uni = sum(v for k, v in p.items() if " " not in k)
    v = sum(1 for k in p if " " not in k) + 1
    gamma = {r["context"]: r["gamma"] for r in L.discounted(adj, d).select("context", "gamma").distinct().collect()}
    assert math.isclose(uni + gamma[""] / v, 1, rel_tol=1e-9)
    for context in ("a", "b", "c", "<s>"):  # words not seen after the context get gamma times their unigram
        seen = {k.split()[1]: x for k, x in p.items() if k.startswith(context + " ")}
        rest = sum(x for k, x in p.items() if " " not in k and k not in seen) + gamma[""] / v
        assert math.isclose(sum(seen.values()) + gamma[context] * rest, 1, rel_tol=1e-9)


def test_folds(spark):
    got = rows(H.folds(spark.range(23).withColumnRenamed("id", "i"), "i", 5), "i", "fold")
    assert [f for _, f in got] == [i // 4 for i in range(23)]


def test_patterns_round_trip_and_match(spark):
    assert P.import_text(P.export_text(P.GRAMMAR)) == P.GRAMMAR
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate("the old house of Anna Smith".split())], "doc_id int, pos int, w string")
    w = F.col("w")
    singles = P.forms(toks, {"short": w.rlike("^[a-z]{1,3}$"), "noun": w.rlike("^[a-z]{4,}$"), "capital": w.rlike("^[A-Z]"), "adj": w == "old"})
    found = {(r["form"], r["pos"], r["end"]): r["cost"] for r in P.bottom_up(toks, singles, P.GRAMMAR).collect()}
    assert found[("_NAME", 4, 6)] == 0 and found[("_NP", 0, 3)] == 1 and found[("_PP", 3, 6)] == 1 and found[("_NPP", 0, 6)] == 2
    cover = rows(P.cover(P.winners(P.bottom_up(toks, singles, P.GRAMMAR))), "pos", "end")
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(cover))


def test_ontology_with_cycle_and_missing_parent(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "zz"), ("d", "gone"), ("x", "y"), ("y", "x"), ("e", "c"), ("e", "b")], "child string, parent string")
    nodes = spark.createDataFrame([(n,) for n in "abcdexy"], "node string")
    assert dict(rows(G.ranks(nodes, e), "node", "rank")) == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 2, "x": 100, "y": 100}
    once = G.closure(nodes, e, ["a"])
    assert rows(once.filter("node = 'e'"), "super") == [("b",), ("c",), ("zz",)]
    assert dict(rows(G.hypernym_path(nodes, e), "node", "path"))["e"] == "e>b>a"


def test_names(spark):
    def n(hon=None, first=None, middle=None, last=None, suffix=None, any_=None, nick=0):
        return (hon, first, middle, last, suffix, any_, nick)

    t = "hon string, first string, middle string, last string, suffix string, any string, nick int"
    cases = [
        (n(first="Anna", last="Lee"), n(first="A", last="Lee"), True, True), (n("mrs", last="Lee"), n("miss", last="Lee"), False, False),
        (n("mr", last="Lee"), n("mrs", last="Lee"), False, False), (n(any_="Lee"), n(first="Anna", last="Lee"), True, False),
        (n(first="Bob", last="Lee", nick=3), n(first="Robert", last="Lee", nick=3), True, False), (n(first="Anna", last="Lee"), n(first="Anna", last="Poe"), False, False),
        (n(first="two", last="x"), n(first="2", last="x"), True, True),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], f"i int, a struct<{t.replace(' ', ':').replace(',:', ',')}>, b struct<{t.replace(' ', ':').replace(',:', ',')}>")
    got = df.select("i", N.like("a", "b"), N.confident("a", "b"), N.merged("a", "b").alias("m")).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [(x, y) for _, _, x, y in cases]
    assert got[0]["m"]["first"] == "Anna"


def test_conversations(spark):
    q = spark.createDataFrame([(1, 1, "a", "b", 0), (1, 2, "b", "a", 0), (1, 3, "c", "c", 0), (1, 4, "d", "e", 0), (1, 5, "e", "d", 1)], "doc int, pos int, speaker string, audience string, group int")
    assert rows(Rel.conversations(q, "doc", "pos"), "pos", "conversation") == [(1, 1), (2, 1), (4, 2), (5, 3)]


def test_inverse_twice_is_identity(spark):
    rel = spark.createDataFrame([("a", "b", 0, 2), ("c", "a", 4, 1)], "src string, dst string, type int, n long")
    once = Rel.with_inverse(rel)
    assert set(rows(Rel.with_inverse(once).distinct(), "src", "dst", "type", "n")) == set(rows(once, "src", "dst", "type", "n"))


def test_answers(spark):
    syn = spark.createDataFrame([("run", "jog"), ("dog", "hound")], "word string, synonym string")
    q = spark.createDataFrame([(1, "dog", "run", "park", None, None, False)], "q_id int, subject string, verb string, object string, prep string, prep_object string, negation boolean")
    r = spark.createDataFrame(
        [(1, 1, "dog", "run", "park", None, None, False, False), (2, 1, "hound", "jog", "park", None, None, False, False), (3, 1, "dog", "run", "park", None, None, True, False), (4, 1, "it", "run", "park", None, None, False, False), (5, 1, "cat", "run", "park", None, None, False, False), (6, 1, "dog", "run", "park", None, None, False, True)],
        "rel_id int, source int, subject string, verb string, object string, prep string, prep_object string, negation boolean, in_question boolean",
    )
    s = Q.scored(Q.candidates(q, r, syn), syn)
    assert dict(rows(s, "rel_id", "total")) == {1: 24, 2: 20, 4: 16, 5: 8}
    assert rows(Q.matched(s), "rel_id") == [(1,), (2,)]


def test_tables(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr><tr><td>2[3]</td><td><i>x</i> &amp; y</td></tr></table><table><tr><td>no header</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert rows(M.table_rows(df), "row", "col", "header", "entry") == [(0, 0, "A", "1"), (0, 1, "B", "-"), (1, 0, "A", "2"), (1, 1, "B", "x & y")]


def test_text(spark):
    assert [T.stem(w) for w in ("running", "happiness", "this", "cats", "ness", "relational")] == ["runn", "happi", "this", "cat", "ness", "relate"]
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate("in new york city new york".split())], "doc_id int, pos int, w string")
    d = spark.createDataFrame([("new york",), ("new york city",), ("york city",)], "entry string")
    assert rows(T.greedy(T.longest_entries(toks, d)), "pos", "entry") == [(1, "new york city"), (4, "new york")]
    w = spark.createDataFrame([("a1",), ("don't",), ("Abc",), ("nation",), ("simplify",), ("helpful",), ("onward",), ("zzz",)], "w string")
    assert [r[0][6:-2] for r in w.select(S.unknown_class(F.col("w"))).collect()] == ["digit", "punct", "upper", "noun", "verb", "adj", "adv", ""]


def test_sources(spark, tmp_path):
    lines = ["\\data\\", "ngram 1=2", "\\1-grams:", "-1.5\ta\t-0.2", "-2\tb", "\\2-grams:", "-0.5\ta b", "\\end\\"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    assert rows(triples.arpa(df, "i"), "n", "gram", "log10_prob", "log10_backoff") == [(1, "a", -1.5, -0.2), (1, "b", -2.0, 0.0), (2, "a b", -0.5, 0.0)]
    tagged = spark.createDataFrame(list(enumerate(["the\tDT", "cat\tNN", "", "it\tPRP"])), "i int, value string")
    assert rows(triples.tagged_lines(tagged, "i"), "sent", "pos", "word", "tag") == [(0, 0, "the", "DT"), (0, 1, "cat", "NN"), (1, 0, "it", "PRP")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes("né".encode("latin-1"))
    assert triples.whole_texts(spark, str(tmp_path / "d"), "ISO-8859-1").first()["text"] == "né"
    assert triples.count_files(spark, str(tmp_path)).first()["files"] == 1
    (tmp_path / "c.xml").write_text("<c><book><id>1</id><title>T</title><language>en</language><subject>PR</subject><subject>X</subject></book><book><id>2</id><language>fr</language><subject>PR</subject></book><book><id>3</id><subject>PS</subject></book></c>")
    books = xml.catalogue(spark, str(tmp_path / "c.xml"))
    assert rows(xml.accepted_books(books, spark.createDataFrame([("3",)], "id string")), "id") == [("1",)]
    (tmp_path / "v.xml").write_text('<V ID="run-1"><MEMBERS><MEMBER name="run"/><MEMBER name="jog"/></MEMBERS><SUBCLASSES><VNSUBCLASS ID="run-1-1"><MEMBERS><MEMBER name="dash"/><MEMBER name="hop"/></MEMBERS></VNSUBCLASS></SUBCLASSES></V>')
    v = spark.read.format("binaryFile").load(str(tmp_path / "v.xml")).select(F.from_xml(F.decode("content", "UTF-8"), xml.VERB_SCHEMA).alias("c"))
    assert rows(xml.verb_members(v), "verb", "class") == [("dash", "run-1-1"), ("hop", "run-1-1"), ("jog", "run-1"), ("run", "run-1")]
    out = str(tmp_path / "out")
    sinks.write_bucketed(spark.range(50).withColumnRenamed("id", "doc_id"), out, "doc_id", 4)
    assert spark.read.parquet(out).count() == 50


def test_stream_counts_once(spark, tmp_path):
    from narrata.streaming.counters import merge_stream

    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k, "a b a")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    docs = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(src)
    merge_stream(docs, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "t" / "v2")), "word", "total") == [("a", 6), ("b", 3)]
