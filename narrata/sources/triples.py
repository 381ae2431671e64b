"""Readers of line formats. Each takes a DataFrame with a ``value`` column, as ``spark.read.text`` gives it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def whole_texts(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(path, text): one row a file, decoded by the encoding given or found."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", (F.decode("content", encoding) if encoding else decoded(F.col("content"))).alias("text"))


def charset(content: Column) -> Column:
    """UTF-16 by its byte order mark, UTF-8 where the bytes are valid, else the Western code page."""
    mark = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    return F.when(mark, "UTF-16").when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("windows-1252")


#: The code page's letters for the bytes 80 to 9F.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded(content: Column) -> Column:
    """Text of bytes in the charset that ``charset`` finds, without a byte order mark."""
    which = charset(content)
    western = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)
    text = F.when(which == "UTF-16", F.decode(content, "UTF-16")).when(which == "UTF-8", content.cast("string")).otherwise(western)
    return F.regexp_replace(text, "^\\ufeff", "")


def count_files(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by folder, recursively; contents aren't read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return b.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def triples(lines: DataFrame) -> DataFrame:
    """N-Triples and simple Turtle lines: (s, p, o). Lines of @ and # go, tabs are blanks, three fields are needed."""
    t = lines.select(F.trim(F.regexp_replace("value", "\t", " ")).alias("v")).filter(~F.col("v").rlike("^[@#]") & (F.col("v") != ""))
    m = "^(\\S+) +(\\S+) +(.+?) *[.;]?$"
    t = t.filter(F.col("v").rlike(m))
    return t.select(*[_term(F.regexp_extract("v", m, i)).alias(c) for i, c in ((1, "s"), (2, "p"), (3, "o"))])


def _term(c: Column) -> Column:
    """Without angle brackets, quotes and language tags."""
    return F.regexp_replace(F.regexp_replace(c, "^<(.*)>$", "$1"), '^"(.*)"(?:@[a-zA-Z-]+|\\^\\^.*)?$', "$1")


def entries(t: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Triples as rows: a column for each predicate, the least object where there are several."""
    return t.filter(F.col("p").isin(*predicates)).groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for p, c in predicates.items()])


def select_pattern(t: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """A basic graph pattern over triples: terms that begin with ? are variables; patterns are joined on shared ones."""
    out = None
    for s, p, o in patterns:
        x = t
        names = {}
        for column, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                names[column] = term[1:]
            else:
                x = x.filter(F.col(column) == term)
        x = x.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
        out = x if out is None else out.join(x, [c for c in out.columns if c in x.columns])
    return out


def tagged_lines(lines: DataFrame, order: str) -> DataFrame:
    """token<TAB>tag lines; an empty line ends a sentence. (sent, pos, word, tag)."""
    w = Window.orderBy(order)  # a corpus file is one sequence; split files keep their own numbering
    t = lines.withColumn("_end", (F.trim("value") == "").cast("int"))
    t = t.withColumn("sent", F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_end = 0")
    parts = F.split("value", "\t")
    pos = F.row_number().over(Window.partitionBy("sent").orderBy(order)) - 1
    return t.select("sent", pos.alias("pos"), F.get(parts, 0).alias("word"), F.get(parts, 1).alias("tag"))


def slash_tagged(lines: DataFrame) -> DataFrame:
    """word/TAG sentences, one a line; the last slash divides."""
    t = lines.select("sent", F.posexplode(F.split(F.trim("value"), " +")).alias("pos", "x"))
    return t.select("sent", "pos", F.regexp_extract("x", "^(.*)/([^/]*)$", 1).alias("word"), F.regexp_extract("x", "^(.*)/([^/]*)$", 2).alias("tag"))


def arpa(lines: DataFrame, order: str) -> DataFrame:
    """ARPA models: (n, gram, log10_prob, log10_backoff). The section of a line is the last header before it."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.last(F.when(F.col("value").rlike("^\\\\[0-9]+-grams:"), F.regexp_extract("value", "([0-9]+)", 1).cast("int")).when(F.col("value").rlike("^\\\\end"), 0), True).over(w)
    t = lines.withColumn("n", n).filter((F.col("n") > 0) & F.col("value").contains("\t"))
    parts = F.split("value", "\t")
    return t.select("n", F.get(parts, 1).alias("gram"), F.get(parts, 0).cast("double").alias("log10_prob"), F.coalesce(F.get(parts, 2).cast("double"), F.lit(0.0)).alias("log10_backoff"))


def titles(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated dump of titles, each once."""
    return spark.read.option("sep", "\t").schema("title string").csv(path).dropDuplicates()
