"""Dictionary, views, table scoring and later answering stages on small inputs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from narrata.operators import dictionary as D
from narrata.operators import graph as G
from narrata.operators import lm as L
from narrata.operators import markup as M
from narrata.operators import patterns as P
from narrata.operators import qa as Q
from tests.test_operators import rows


def test_dictionary(spark):
    lists = spark.createDataFrame([("noun", "run", None), ("verb", "run", None), ("verb", "ran", "run")], "form string, word string, main string")
    words, forms = D.closed_class(lists)
    assert rows(words, "word", "main_entry") == [("ran", "run"), ("run", "run")] and forms.count() == 3
    got = D.lookup(spark.createDataFrame([("run",), ("zzz",)], "word string"), words, forms)
    assert rows(got.fillna("-"), "word", "forms") == [("run", "noun,verb"), ("zzz", "-")]
    assert spark.range(1).select(D.class_number(F.lit("13.4.2"))).first()[0] == (13 << 16) + (4 << 8) + 2
    d = spark.createDataFrame([("runner", "One who runs fast"), ("tree", "A plant"), ("bus", "something that carries")], "noun string, definition string")
    assert rows(D.noun_verbs(d), "noun", "noun_verb") == [("bus", "carrie"), ("runner", "run")]
    lines = spark.createDataFrame([(1, 0, "text"), (1, 1, ""), (1, 2, "THE END"), (1, 3, "more"), (2, 0, "x"), (2, 1, "the end"), (3, 0, "*** END OF THIS BOOK")], "doc_id int, line int, s string")
    assert rows(D.end_of_book(lines), "doc_id", "end_line") == [(1, 2), (3, 0)]


def test_marked_tables(spark):
    lines = "table: Rivers\ncolumn: name\nentry: Rhine\nentry: Elbe\ncolumn: length\nentry: 1\ntable: Other\ncolumn: x\nentry: y".split("\n")
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "doc_id int, line int, s string")
    t = M.marked_tables(df, ["rivers"])
    assert rows(t, "col", "row", "header", "entry") == [(0, 0, "name", "Rhine"), (0, 1, "name", "Elbe"), (1, 0, "length", "1")]
    a = M.table_answers(t, spark.createDataFrame([(1, 0, 80), (1, 1, 20)], "tbl int, col int, coherence int"))
    assert rows(a, "entry", "score") == [("Elbe", 80)]


def test_pattern_costs_and_corrections(spark):
    parents = spark.createDataFrame([("p", 10), ("q", 5)], "parent string, cost int")
    links = spark.createDataFrame([("p", "c"), ("p", "d"), ("q", "e")], "parent string, child string")
    assert rows(P.reduced_parents(parents, links, spark.createDataFrame([("c", 2), ("d", 1)], "child string, saved int")), "parent", "cost") == [("p", 7), ("q", 5)]
    m = spark.createDataFrame([(1, 0, 4, "_NP")], "doc_id int, pos int, end int, form string")
    tags = spark.createDataFrame([(1, 1, 2, "N"), (1, 3, 5, "V"), (1, 0, 1, "D")], "doc_id int, pos int, end int, tag string")
    assert rows(P.tag_sets(m, tags), "tags") == [("D@0,N@1",)]
    toks = spark.createDataFrame([(1, 0, "DET"), (1, 1, "VERB"), (1, 2, "VERB"), (1, 3, "X")], "doc_id int, pos int, form string")
    fixed = P.corrected(toks, [("VERB", "DET", "VERB", "NOUN"), ("VERB", "DET", "", "ADJ")])
    assert [f for _, f in rows(fixed, "pos", "form")] == ["DET", "NOUN", "VERB", "X"]


def test_mixed_models_are_normalised(spark):
    a = spark.createDataFrame([(1, "x", 0.7), (1, "y", 0.3)], "n int, gram string, prob double")
    b = spark.createDataFrame([(1, "x", 0.2), (1, "y", 0.8)], "n int, gram string, prob double")
    p = {r["gram"]: 10 ** r["log10"] for r in L.mix([(a, 0.5), (b, 0.5)]).collect()}
    x, y = math.sqrt(0.14), math.sqrt(0.24)
    assert math.isclose(p["x"], x / (x + y)) and math.isclose(p["y"], y / (x + y))


def test_question_stages(spark):
    q = spark.createDataFrame([(1, "Anna", "born", None, None, None, False), (2, "Bob", "wrote", "book", None, None, False)], "q_id int, subject string, verb string, object string, prep string, prep_object string, negation boolean")
    rules = spark.createDataFrame([("wrote", "written", "by", True)], "verb string, new_verb string, new_prep string, swap boolean")
    assert rows(Q.transformed(q, rules).filter("verb = 'written'"), "subject", "object", "prep") == [("book", "Bob", "by")]
    facts = spark.createDataFrame([("anna", "birth", "1900"), ("bob", "birth", "1901")], "entity string, property string, value string")
    first = Q.infobox(q, facts, {"born": "birth"})
    assert rows(first, "q_id", "answer", "total") == [(1, "1900", 1000)]
    second = spark.createDataFrame([(1, "x", 20), (2, "y", 20)], "q_id int, answer string, total int")
    assert rows(Q.staged_answers(first, second), "q_id", "answer") == [(1, "1900"), (2, "y")]
    a = spark.createDataFrame([(1, "Rhine", "river"), (2, "Anna", "river"), (3, "z", None)], "q_id int, answer string, wanted string")
    assert rows(Q.parent_group(a, spark.createDataFrame([("rhine", "River")], "node string, super string")), "q_id") == [(1,), (3,)]
    rel = spark.createDataFrame([(1, "anna", "is", "runner")], "rel_id int, subject string, verb string, object string")
    assert rows(Q.nouns_as_verbs(rel, spark.createDataFrame([("runner", "run")], "noun string, noun_verb string")), "subject", "verb") == [("anna", "run")]


def test_ontology_lookups(spark):
    o = spark.createDataFrame([("United Nations", "org"), ("Bank", "firm"), ("Bank of England", "central bank")], "name string, class string")
    e = spark.createDataFrame([("UN",), ("Bank",), ("nobody",), ("seen",)], "name string")
    found, absent = G.identified(e, o, spark.createDataFrame([("UN", "United Nations")], "acronym string, meaning string"), spark.createDataFrame([("seen",)], "name string"))
    assert rows(found, "name", "by") == [("Bank", "name"), ("UN", "acronym")] and rows(absent, "name") == [("nobody",)]
    n = spark.createDataFrame([("Bank of England of old",), ("Bank of Spain",)], "name string")
    assert rows(G.extended(n, o), "name", "class") == [("Bank of England of old", "central bank"), ("Bank of Spain", "firm")]
    s = spark.createDataFrame([("Anna Lee is a Swiss painter.",), ("Anna Lee was an old famous painter who lived.",), ("no match",)], "text string")
    assert rows(G.isa_from_text(s.filter("text not like '%Swiss%'")), "entity", "class") == [("Anna Lee", "painter")]


def test_names_from_text(spark):
    from narrata.operators import names as N

    t = [(1, 0, "Mrs.", "hon"), (1, 1, "Anna", "first"), (1, 2, "B.", "middle"), (1, 3, "C.", "middle"), (1, 4, "Lee", "last"), (2, 0, "Bob", "any")]
    got = {r["name_id"]: r for r in N.parsed(spark.createDataFrame(t, "name_id int, pos int, w string, tag string")).collect()}
    assert (got[1]["n"]["first"], got[1]["n"]["middle"], got[1]["n"]["last"], got[1]["gender"]) == ("Anna", "B. C.", "Lee", "female")
    assert got[2]["n"]["any"] == "Bob" and got[2]["n"]["middle"] is None
    s = spark.createDataFrame([("Samuel Clemens, better known as Mark Twain, wrote.",), ("He is known as a friend.",), ("The Big River is also called Old Man.",)], "text string")
    assert rows(N.equivalences(s), "name", "other") == [("Samuel Clemens", "Mark Twain"), ("The Big River", "Old Man")]
