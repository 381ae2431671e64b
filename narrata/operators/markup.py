"""Web markup to tables: content reduction, list and table rows, headings, and what makes a table column coherent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import stripped

PAD = "-"


def reduced(html: Column) -> Column:
    """The content block without scripts, styles, comments, navigation and superscripts; text of paragraphs only."""
    t = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "sup", "footer"):
        t = F.regexp_replace(t, f"(?s)<{tag}[^>]*>.*?</{tag}>", "")
    t = F.regexp_replace(t, "<p[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "[ \\t]+", " "), "[ ]*\\n[ \\n]*", "\n"))


def heading_before(html: Column, tag: str) -> Column:
    """Text of the last heading before the first ``tag``."""
    before = F.substring_index(html, f"<{tag}", 1)
    heads = F.regexp_extract_all(before, F.lit("(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)
    return F.when(F.size(heads) > 0, stripped(F.element_at(heads, -1)))


def list_rows(pages: DataFrame) -> DataFrame:
    """Lists as one-column tables: (page_id, tbl, heading, row, col, entry). Nested lists go before their text is taken."""
    lists = F.regexp_extract_all("html", F.lit("(?s)<(?:ul|ol)[^>]*>(.*?)</(?:ul|ol)>"), 1)
    t = pages.select("page_id", heading_before(F.col("html"), "ul").alias("heading"), F.posexplode(lists).alias("tbl", "body"))
    items = F.regexp_extract_all("body", F.lit("(?s)<li[^>]*>(.*?)</li>"), 1)
    return t.select("page_id", "tbl", "heading", F.posexplode(items).alias("row", "item")).select("page_id", "tbl", "heading", "row", F.lit(0).alias("col"), stripped(F.col("item")).alias("entry"))


def table_rows(pages: DataFrame) -> DataFrame:
    """Tables with at least one header cell: (page_id, tbl, row, col, header, entry); missing cells are padded."""
    tables = F.regexp_extract_all("html", F.lit("(?s)<table[^>]*>(.*?)</table>"), 1)
    t = pages.select("page_id", F.posexplode(tables).alias("tbl", "body"))
    t = t.withColumn("headers", F.transform(F.regexp_extract_all("body", F.lit("(?s)<th[^>]*>(.*?)</th>"), 1), lambda h: stripped(h))).filter(F.size("headers") > 0)
    rows = F.filter(F.regexp_extract_all("body", F.lit("(?s)<tr[^>]*>(.*?)</tr>"), 1), lambda r: r.contains("<td"))
    r = t.select("page_id", "tbl", "headers", F.posexplode(rows).alias("row", "cells"))
    cells = F.transform(F.regexp_extract_all("cells", F.lit("(?s)<td[^>]*>(.*?)</td>"), 1), lambda c: stripped(c))
    width = F.size("headers")
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(PAD), F.greatest(width - F.size(cells), F.lit(0)))), F.lit(1), width)
    return r.select("page_id", "tbl", "row", "headers", F.posexplode(padded).alias("col", "entry")).select("page_id", "tbl", "row", "col", F.get("headers", F.col("col")).alias("header"), "entry")


def common_types(typed: DataFrame) -> DataFrame:
    """Types of a column that occur in more than all rows but one, or match the title and occur in more than half.

    ``typed``: (tbl, col, row, type, matches_title); most frequent first, then by name downwards.
    """
    rows = typed.groupBy("tbl", "col").agg(F.count_distinct("row").alias("n_rows"))
    freq = typed.groupBy("tbl", "col", "type").agg(F.count_distinct("row").alias("freq"), F.bool_or("matches_title").alias("matches_title"))
    j = freq.join(rows, ["tbl", "col"]).filter((F.col("freq") > F.col("n_rows") - 1) | (F.col("matches_title") & (F.col("freq") > F.col("n_rows") / 2)))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("tbl", "col").orderBy(F.desc("freq"), F.desc("type"))))


def coherence(typed: DataFrame) -> DataFrame:
    """100 * sum over typed rows of the greatest frequency of a row's types / (typed rows squared), whole number."""
    freq = typed.groupBy("tbl", "col", "type").agg(F.count_distinct("row").alias("freq"))
    best = typed.join(freq, ["tbl", "col", "type"]).groupBy("tbl", "col", "row").agg(F.max("freq").alias("best"))
    return best.groupBy("tbl", "col").agg(F.count("*").alias("typed_rows"), F.expr("100 * sum(best) div (count(*) * count(*))").alias("coherence"))


def preferred_entries(typed: DataFrame) -> DataFrame:
    """In each row the entry whose types are most frequent in the column; ties by the sum, then the first entry."""
    freq = typed.groupBy("tbl", "col", "type").agg(F.count("*").alias("freq"))
    e = typed.join(freq, ["tbl", "col", "type"]).groupBy("tbl", "col", "row", "entry").agg(F.max("freq").alias("m"), F.sum("freq").alias("s"))
    w = Window.partitionBy("tbl", "col", "row").orderBy(F.desc("m"), F.desc("s"), "entry")
    return e.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def followed(hits: DataFrame, least: int = 70, most: int = 10) -> DataFrame:
    """Search hits in order of rank, up to the first whose relevance is under ``least`` and at most ``most``."""
    w = Window.partitionBy("query").orderBy("rank")
    low = F.sum((F.col("relevance") < least).cast("int")).over(w)
    return hits.withColumns({"_low": low, "_n": F.row_number().over(w)}).filter((F.col("_low") == 0) & (F.col("_n") <= most)).drop("_low", "_n")


def accumulated_types(typed: DataFrame, unwanted: list[str]) -> DataFrame:
    """Confident types (confidence 1) counted for each column; types of unwanted kinds count as zero."""
    n = typed.filter("confidence = 1").groupBy("tbl", "col", "type").agg(F.count("*").alias("n"))
    return n.withColumn("n", F.when(F.col("type").isin(*unwanted), 0).otherwise(F.col("n")) if unwanted else F.col("n"))


def title_preferred(typed: DataFrame) -> DataFrame:
    """(tbl, col, preferred): the title's type is preferred where over three quarters of the typed rows match it."""
    rows = typed.groupBy("tbl", "col", "row").agg(F.bool_or("matches_title").alias("m"))
    return rows.groupBy("tbl", "col").agg((F.sum(F.col("m").cast("long")) * 4 > F.count("*") * 3).alias("preferred"))


def marked_tables(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """Tables from marked text: 'table: title', 'column: header' and 'entry: text' lines. Tables whose title or header
    has none of the wanted words are left out. (doc_id, tbl, col, row, title, header, entry)."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    kind, value = F.regexp_extract("s", "^(table|column|entry): ?(.*)$", 1), F.regexp_extract("s", "^(table|column|entry): ?(.*)$", 2)
    t = lines.withColumns({"k": kind, "v": value}).filter("k <> ''")
    t = t.withColumns({"tbl": F.sum((F.col("k") == "table").cast("int")).over(w), "c": F.sum((F.col("k") == "column").cast("int")).over(w), "title": F.last(F.when(F.col("k") == "table", F.col("v")), True).over(w), "header": F.last(F.when(F.col("k") == "column", F.col("v")), True).over(w)})
    per = Window.partitionBy("doc_id", "tbl")
    t = t.filter("k = 'entry'").withColumn("col", F.dense_rank().over(per.orderBy("c")) - 1)
    t = t.withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "tbl", "c").orderBy("line")) - 1)
    named = F.lower(F.concat_ws(" ", "title", "header"))
    ok = F.exists(F.split(named, "[^a-z]+"), lambda x: x.isin(*wanted))
    return t.filter(ok).select("doc_id", "tbl", "col", "row", "title", "header", F.col("v").alias("entry"))


def table_answers(entries: DataFrame, columns: DataFrame, least: int = 50) -> DataFrame:
    """Entries of coherent columns below the header row; the coherence is their score."""
    return entries.filter("row > 0").join(columns.filter(F.col("coherence") >= least), ["tbl", "col"]).withColumn("score", F.col("coherence"))
