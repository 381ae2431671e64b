"""Span patterns over tagged tokens: elements with alternatives, costs and repetition, matched by joins.

A pattern is a list of elements; an element allows word classes or sub-patterns, each with a cost, from ``least`` to
``most`` times. Matching keeps every alternative end, as rows (doc_id, pos, end, cost).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut



@dataclass(frozen=True)
class Element:
    """``forms``: class or '_pattern' name and its cost; ``words``: literal words and their cost."""

    forms: dict[str, int] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    least: int = 1
    most: int = 1


@dataclass(frozen=True)
class Pattern:
    name: str
    elements: tuple[Element, ...]
    only_begin: bool = False

    def children(self) -> set[str]:
        return {f for e in self.elements for f in e.forms if f.startswith("_")}

    def mandatory(self) -> list[set[str]]:
        return [set(e.forms) | set(e.words) for e in self.elements if e.least > 0]


#: A small grammar: dates, numbers, names, noun phrases and what is built of them.
GRAMMAR = (
    Pattern("_NUMBER", (Element({"number": 0}, most=2),)),
    Pattern("_NAME", (Element({"capital": 0}, least=1, most=3),)),
    Pattern("_NP", (Element({"short": 0}, least=0), Element({"adj": 1}, least=0, most=2), Element({"noun": 0, "_NAME": 1}))),
    Pattern("_PP", (Element(words={"of": 0, "in": 0, "with": 0, "to": 1}), Element({"_NP": 0}))),
    Pattern("_NPP", (Element({"_NP": 0}), Element({"_PP": 0}, least=1, most=2))),
)


def forms(toks: DataFrame, classes: dict[str, object]) -> DataFrame:
    """(doc_id, pos, end, form, cost) of single tokens: one row for each class that a token may be."""
    made = [F.when(c, F.lit(name)) for name, c in classes.items()]
    return toks.select("doc_id", "pos", (F.col("pos") + 1).alias("end"), F.explode(F.array_compact(F.array(*made))).alias("form"), F.lit(0).alias("cost"))


def match_element(frontier: DataFrame, parts: DataFrame, toks: DataFrame, e: Element) -> DataFrame:
    """Extend matches (doc_id, pos, end, cost) by one element."""
    steps = None
    if e.forms:
        price = F.create_map(*[x for k, v in e.forms.items() for x in (F.lit(k), F.lit(v))])
        steps = parts.filter(F.col("form").isin(*e.forms)).select("doc_id", F.col("pos").alias("at"), F.col("end").alias("to"), (F.col("cost") + price[F.col("form")]).alias("more"))
    if e.words:
        price = F.create_map(*[x for k, v in e.words.items() for x in (F.lit(k), F.lit(v))])
        w = toks.filter(F.lower("w").isin(*e.words)).select("doc_id", F.col("pos").alias("at"), (F.col("pos") + 1).alias("to"), price[F.lower("w")].alias("more"))
        steps = w if steps is None else steps.unionByName(w)
    steps = steps.groupBy("doc_id", "at", "to").agg(F.min("more").alias("more"))  # the cheapest way over a span
    out = frontier if e.least == 0 else None
    now = frontier
    for k in range(1, e.most + 1):
        now = now.join(steps, (now["doc_id"] == steps["doc_id"]) & (now["end"] == steps["at"])).select(now["doc_id"], "pos", F.col("to").alias("end"), (F.col("cost") + F.col("more")).alias("cost"))
        if k >= e.least:
            out = now if out is None else out.unionByName(now)
    return out.groupBy("doc_id", "pos", "end").agg(F.min("cost").alias("cost"))


def match(toks: DataFrame, parts: DataFrame, p: Pattern) -> DataFrame:
    """All matches of a pattern, each span with its least cost."""
    starts = toks.select("doc_id", "pos")
    if p.only_begin:
        starts = starts.filter("pos = 0")
    frontier = starts.withColumn("end", F.col("pos")).withColumn("cost", F.lit(0))
    for e in p.elements:
        frontier = match_element(frontier, parts, toks, e)
    return frontier.filter("end > pos").withColumn("form", F.lit(p.name))


def levels(grammar: tuple[Pattern, ...]) -> list[list[Pattern]]:
    """Leaf patterns first; a pattern comes after all its children."""
    done, out, rest = set(), [], list(grammar)
    while rest:
        ready = [p for p in rest if p.children() <= done]
        if not ready:
            raise ValueError("patterns that contain one another")
        out.append(ready)
        done |= {p.name for p in ready}
        rest = [p for p in rest if p.name not in done]
    return out


def bottom_up(toks: DataFrame, singles: DataFrame, grammar: tuple[Pattern, ...]) -> DataFrame:
    """(doc_id, pos, end, form, cost) of every pattern, level by level."""
    cols = ["doc_id", "pos", "end", "form", "cost"]
    parts, found = singles.select(*cols), None
    for level in levels(grammar):
        for p in level:
            m = cut(match(toks, parts, p).select(*cols))  # higher levels read it again and again
            found = m if found is None else found.unionByName(m)
        parts = singles.select(*cols).unionByName(found)
    return found


def average_cost(m: DataFrame) -> DataFrame:
    return m.withColumn("average", F.expr("1000 * cost div (end - pos)").cast("long"))


def winners(m: DataFrame) -> DataFrame:
    """At each position the match of the lowest average cost; longer first, then by name."""
    w = Window.partitionBy("doc_id", "pos").orderBy("average", F.desc("end"), "form")
    return average_cost(m).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def cover(m: DataFrame) -> DataFrame:
    """Left-to-right cover of a document by winners without overlaps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, end = [], -1
        pdf = pdf.sort_values("pos")
        for i, (a, b) in enumerate(zip(pdf["pos"], pdf["end"], strict=True)):
            if a >= end:
                keep.append(i)
                end = b
        return pdf.iloc[keep]

    return m.groupBy("doc_id").applyInPandas(run, m.schema)


def guarded(m: DataFrame, toks: DataFrame, after: list[str]) -> DataFrame:
    """Matches that don't follow one of the given words."""
    before = toks.filter(F.lower("w").isin(*after)).select("doc_id", (F.col("pos") + 1).alias("pos"))
    return m.join(before, ["doc_id", "pos"], "left_anti")


def export_text(grammar: tuple[Pattern, ...]) -> list[str]:
    """Patterns as lines of text, which ``import_text`` reads."""
    out = []
    for p in grammar:
        cells = []
        for e in p.elements:
            alternatives = [f"{k}*{v}" for k, v in e.forms.items()] + [f'"{k}"*{v}' for k, v in e.words.items()]
            cells.append(f"{e.least}*{e.most}( {' / '.join(alternatives)} )")
        out.append(f"{p.name}{'^' if p.only_begin else ''} = {' '.join(cells)}")
    return out


def import_text(lines: list[str]) -> tuple[Pattern, ...]:
    import re

    out = []
    for line in lines:
        name, _, body = line.partition(" = ")
        elements = []
        for least, most, inside in re.findall(r"(\d+)\*(\d+)\( (.*?) \)", body):
            forms_, words_ = {}, {}
            for a in inside.split(" / "):
                k, _, v = a.rpartition("*")
                (words_ if k.startswith('"') else forms_)[k.strip('"')] = int(v)
            elements.append(Element(forms_, words_, int(least), int(most)))
        out.append(Pattern(name.rstrip("^"), tuple(elements), name.endswith("^")))
    return tuple(out)




def reduced_parents(parents: DataFrame, links: DataFrame, children: DataFrame) -> DataFrame:
    """Parents take over what their children's costs fell by: links (parent, child), children (child, saved)."""
    saved = links.join(children, "child").groupBy("parent").agg(F.sum("saved").alias("_s"))
    return parents.join(saved, "parent", "left").withColumn("cost", F.col("cost") - F.coalesce("_s", F.lit(0))).drop("_s")


def tag_sets(match_: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags (tag, pos, end) under each match of the same document, as sorted 'tag@pos' lists."""
    t = tags.select("doc_id", F.col("pos").alias("tpos"), F.col("end").alias("tend"), "tag")
    j = match_.join(t, (match_["doc_id"] == t["doc_id"]) & (F.col("tpos") >= F.col("pos")) & (F.col("tend") <= F.col("end"))).drop(t["doc_id"])
    return j.groupBy("doc_id", "pos", "end", "form").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("@", "tag", F.col("tpos").cast("string")))), ",").alias("tags"))


def corrected(toks: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Class corrections after parsing: (class, class before, class after or '', new class); the first rule that fits."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = toks.withColumns({"_b": F.lag("form").over(w), "_a": F.lead("form").over(w)})
    new = F.col("form")
    for form, before, after, other in reversed(rules):
        fits = (F.col("form") == form) & (F.col("_b") == before)
        if after:
            fits = fits & (F.col("_a") == after)
        new = F.when(fits, other).otherwise(new)
    return t.withColumn("form", new).drop("_b", "_a")
