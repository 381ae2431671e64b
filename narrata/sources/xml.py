"""XML sources: catalogues of books, verb classes, music releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK = "id string, title string, creator string, language string, subject array<string>"


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "book").schema(BOOK).load(path)


def accepted_books(books: DataFrame, existing: DataFrame, classes: str = "^P[A-Z]") -> DataFrame:
    """English or unmarked books of an accepted class that aren't known yet."""
    ok = (F.col("language").isNull() | (F.col("language") == "en")) & F.exists("subject", lambda s: s.rlike(classes))
    return books.filter(ok).join(existing.select("id"), "id", "left_anti")


LEVELS = 4  # schema depth of nested subclasses; Spark's XML schemas can't be recursive


def verb_schema(levels: int = LEVELS) -> str:
    members = "MEMBERS struct<MEMBER:array<struct<_name:string>>>"
    inner = f"_ID string, {members}"
    for _ in range(levels):
        inside = inner.replace("_ID string", "_ID:string").replace("MEMBERS struct", "MEMBERS:struct").replace("SUBCLASSES struct", "SUBCLASSES:struct")
        inner = f"_ID string, {members}, SUBCLASSES struct<VNSUBCLASS:array<struct<{inside}>>>"
    return inner


VERB_SCHEMA = verb_schema()


def verb_members(classes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(verb, class) of a class column ``c`` and its subclasses, level by level."""
    now, out = classes.select("c"), None
    for k in range(levels + 1):
        rows = now.select(F.col("c._ID").alias("class"), F.explode("c.MEMBERS.MEMBER").alias("m")).select(F.col("m._name").alias("verb"), "class").filter("verb is not null")
        out = rows if out is None else out.unionByName(rows)
        if k < levels:
            now = now.select(F.explode("c.SUBCLASSES.VNSUBCLASS").alias("c"))
    return out


RELEASE = "_id string, title string, artist string, country string, date string, label array<string>"


def releases(rows: DataFrame, column: str = "xml") -> DataFrame:
    """One row a release and label."""
    r = rows.select(F.from_xml(column, RELEASE).alias("r"))
    return r.select(F.col("r._id").alias("release_id"), "r.title", "r.artist", "r.country", "r.date", F.explode_outer("r.label").alias("label"))
