"""Dictionary dimensions: word lists with forms, verb classes, multi-word registers, overrides, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_class(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, word_forms) from rows (form, word, main): a word may have several forms; main defaults to itself."""
    words = lists.groupBy("word").agg(F.min(F.coalesce("main", "word")).alias("main_entry"))
    return words, lists.select("word", "form").distinct()


def class_number(dotted: Column) -> Column:
    """13.4.2 packed with eight bits for each level."""
    return F.aggregate(F.transform(F.split(dotted, "[.-]"), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(x))


def verb_classes(rows: DataFrame) -> DataFrame:
    """(verb, class, number): of several classes of a verb the later row counts."""
    last = rows.groupBy("verb").agg(F.max_by("class", "seq").alias("class"))
    return last.withColumn("number", class_number(F.col("class")))


def register(entries: DataFrame) -> DataFrame:
    """Multi-word, quoted and abbreviated entries in one table with a kind column."""
    e = F.col("entry")
    kind = F.when(e.rlike("^['\"]|['\"]$"), "quoted").when(e.endswith("."), "abbreviation").when(e.contains(" "), "multi").otherwise("single")
    return entries.withColumn("kind", kind).withColumn("n_words", F.size(F.split("entry", " ")))


def lookup(words: DataFrame, dictionary: DataFrame, forms: DataFrame) -> DataFrame:
    """Words with their main entries and sorted forms; unknown ones keep nulls."""
    f = forms.groupBy("word").agg(F.array_join(F.sort_array(F.collect_set("form")), ",").alias("forms"))
    return words.join(dictionary, "word", "left").join(f, "word", "left")


def override_costs(costs: DataFrame, override: DataFrame) -> DataFrame:
    """Costs set by hand take the place of computed ones; a preferred form costs nothing."""
    o = override.select("word", "form", F.col("cost").alias("_cost"), "preferred")
    j = costs.join(o, ["word", "form"], "left")
    return j.withColumn("cost", F.when(F.col("preferred"), 0).otherwise(F.coalesce("_cost", "cost"))).drop("_cost", "preferred")


def flagged(words: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """A boolean column that marks the words of a list (change-of-state verbs and the like)."""
    return words.join(members.select("word").distinct().withColumn(name, F.lit(True)), "word", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def noun_verbs(definitions: DataFrame) -> DataFrame:
    """(noun, noun_verb): nouns defined as one who, or something that, does something."""
    m = "^(?:one who|someone who|a person who|something that|that which) ([a-z]+)"
    verb = F.regexp_extract(F.lower("definition"), m, 1)
    return definitions.select("noun", F.regexp_replace(verb, "(?<=[a-z]{3})s$", "").alias("noun_verb")).filter("noun_verb <> ''")


def end_of_book(lines: DataFrame) -> DataFrame:
    """First line of a document that announces its end with a blank line before it, or an end mark of a text archive."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line")
    alone = F.upper(F.trim("s")).rlike("^(THE )?END[.]?$|^FINIS[.]?$") & (F.coalesce(F.trim(F.lag("s").over(w)), F.lit("")) == "")
    mark = F.upper("s").rlike("^[*]{3} ?END OF")
    return lines.withColumn("_e", alone | mark).filter("_e").groupBy("doc_id").agg(F.min("line").alias("end_line"))
