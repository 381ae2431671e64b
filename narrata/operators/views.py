"""The reading interface as functions that return DataFrames: sources, elements, agents, words, chapters, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search_sources(docs: DataFrame, text: str, column: str = "text", most: int = 50) -> DataFrame:
    """Documents whose column holds the text in any case; a literal, never part of a statement."""
    return docs.filter(F.lower(column).contains(text.lower())).orderBy("doc_id").limit(most)


def elements(toks: DataFrame, after: int, width: int = 1000) -> DataFrame:
    """A page of a document's words by position."""
    return toks.filter((F.col("pos") >= after) & (F.col("pos") < after + width)).orderBy("doc_id", "pos")


def chapters(lines: DataFrame) -> DataFrame:
    from .text import line_flags

    return line_flags(lines).filter("is_header and not is_blank").select("doc_id", "line", F.trim("s").alias("title"))


def agents(quotes: DataFrame) -> DataFrame:
    """Speakers by how much they say and to how many others."""
    return quotes.groupBy("source", "speaker").agg(F.count("*").alias("quotes"), F.count_distinct("audience").alias("audiences"))


def word_info(toks: DataFrame, word: str) -> DataFrame:
    t = toks.filter(F.lower("w") == word.lower())
    return t.groupBy("doc_id").agg(F.count("*").alias("uses"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def paragraph_start(toks: DataFrame, mark: str = "|||") -> DataFrame:
    """Position of the last paragraph mark at or before each word."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return toks.withColumn("paragraph", F.last(F.when(F.col("w") == mark, F.col("pos")), True).over(w))


def surrounding(mentions: DataFrame, before: int = 500, most: int = 10) -> DataFrame:
    """For each mention the ids of the objects mentioned in the positions before it, the latest first."""
    w = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-before, -1)
    return mentions.withColumn("near", F.slice(F.reverse(F.collect_list("object_id").over(w)), 1, most))


def matching(mentions: DataFrame, objects: DataFrame) -> DataFrame:
    """Mentions with their objects' names, in order of position."""
    return mentions.join(objects, "object_id").select("doc_id", "pos", "object_id", "name")


def timeline(segments: DataFrame, mentions: DataFrame) -> DataFrame:
    """Segments (doc_id, parent, segment, begin, end) with the distinct speakers inside, parents before children."""
    from .relational import within

    inside = within(mentions.select("doc_id", "pos", "speaker"), segments, "doc_id", "pos", "begin", "end")
    who = inside.groupBy("doc_id", "segment").agg(F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speakers"))
    return segments.join(who, ["doc_id", "segment"], "left").select("doc_id", "parent", "segment", "begin", "end", "speakers")
