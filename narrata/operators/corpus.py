"""Corpus statistics: tokens, word frequencies and their merge, usage and form costs, comparisons of taggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[\\p{L}']+"  # letters of any script
LONGEST = 32  # fixed value: the width of the dictionary's word column


def tokens(docs: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(doc_id, pos, w): words in their original case, positions from 0."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("pos", "w"))


def word_frequency(toks: DataFrame, known: DataFrame) -> DataFrame:
    """Per document and word: total, unknown, unknown in capitals, and the class of the first occurrence.

    ``known``: words (lower case) of the dictionary. Words longer than the dictionary's column are skipped.
    """
    cap = F.col("w").rlike("^\\p{Lu}[\\p{Ll}']*$")
    caps = F.col("w").rlike("^\\p{Lu}[\\p{Lu}']+$")
    t = toks.withColumn("word", F.lower("w")).filter((F.length("word") <= LONGEST) & (F.col("word") != ""))
    t = t.join(known.select("word").distinct().withColumn("known", F.lit(True)), "word", "left").withColumn("new", F.col("known").isNull())
    n = lambda c: F.sum(c.cast("long"))
    return t.groupBy("doc_id", "word").agg(
        F.count("*").alias("total"), n(F.col("new")).alias("unknown"), n(F.col("new") & cap).alias("capitalized"), n(F.col("new") & caps).alias("all_caps"),
        F.min_by(F.col("w").contains("'"), "pos").alias("first_apostrophe"),
    )


def merge_frequency(per_doc: DataFrame) -> DataFrame:
    """Additive merge over documents; the last document to write a word is the one with the greatest id."""
    return per_doc.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("total", "unknown", "capitalized", "all_caps")], F.max("doc_id").alias("last_source"))


def unknown_ratio(freq: DataFrame, percent: int = 95) -> DataFrame:
    """Words that are unknown in more than ``percent`` of their uses."""
    return freq.filter(F.col("unknown") * 100 / F.col("total") > percent)


def proper_nouns(freq: DataFrame) -> DataFrame:
    return freq.filter((F.col("total") > 4) & ((F.col("capitalized") + F.col("all_caps")) / F.col("total") * 100 > 95))


def accent_skip(word: Column, total: Column, cap: Column) -> Column:
    """True where a word with an accent or apostrophe is skipped: too rare, or not capitalised throughout."""
    odd = word.rlike("[À-ÖØ-öø-ÿ']")
    return odd & ~((total >= 25) & (F.floor(cap * 100 / total) >= 99))


def scale(df: DataFrame, group: list[str], count: str, cap: int) -> DataFrame:
    """Scale the counts of a group so that the greatest is ``cap``, only where it reaches the cap."""
    top = df.groupBy(*group).agg(F.max(count).alias("_top"))
    return df.join(top, group).withColumn("scaled", F.when(F.col("_top") >= cap, F.expr(f"{count} * {cap} div _top")).otherwise(F.col(count))).drop("_top")


def usage_cost(df: DataFrame, group: list[str], count: str, cap: int = 4) -> DataFrame:
    """Cost of each form of a word from its use counts: none (0) where the greatest count is under 5 or the counts are
    within a factor of two; where the least is 0 or the factor is above the cap, cap * (hi - c) / hi; else factor - c / lo."""
    stats = df.groupBy(*group).agg(F.max(count).alias("_hi"), F.min(count).alias("_lo"))
    j = df.join(stats, group)
    factor = F.expr("_hi div nullif(_lo, 0)")
    skip = (F.col("_hi") < 5) | F.coalesce((F.col("_lo") > 0) & (factor < 2), F.lit(False))
    far = F.coalesce((F.col("_lo") == 0) | (factor > cap), F.lit(True))
    cost = F.when(skip, F.lit(0)).when(far, F.expr(f"{cap} * (_hi - {count}) div _hi")).otherwise(factor - F.expr(f"{count} div nullif(_lo, 0)"))
    return j.withColumn("cost", cost.cast("long")).drop("_hi", "_lo")


def form_cost(df: DataFrame, group: list[str], count: str, cap: int = 4) -> DataFrame:
    """The same with exact quotients, rounded to nearest with halves down."""
    stats = df.groupBy(*group).agg(F.max(count).alias("_hi"), F.min(count).alias("_lo"))
    j = df.join(stats, group)
    down = lambda x: (F.floor(x) + F.when(x - F.floor(x) > 0.5, 1).otherwise(0)).cast("long")
    factor = F.col("_hi") / F.nullif(F.col("_lo"), F.lit(0))
    skip = (F.col("_hi") < 5) | F.coalesce((F.col("_lo") > 0) & (factor < 2), F.lit(False))
    far = F.coalesce((F.col("_lo") == 0) | (factor > cap), F.lit(True))
    cost = F.when(skip, F.lit(0)).when(far, down(F.lit(cap) * (F.col("_hi") - F.col(count)) / F.col("_hi"))).otherwise(down(factor) - down(F.col(count) / F.nullif(F.col("_lo"), F.lit(0))))
    return j.withColumn("cost", cost.cast("long")).drop("_hi", "_lo")


def form_diff(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keep, remove or add for each key of the stored and the wanted forms."""
    a = stored.select(*keys).distinct().withColumn("_s", F.lit(1))
    b = wanted.select(*keys).distinct().withColumn("_w", F.lit(1))
    action = F.when(F.col("_s").isNull(), "add").when(F.col("_w").isNull(), "remove").otherwise("keep")
    return a.join(b, keys, "full").select(*keys, action.alias("action"))


def compare_tags(ours: DataFrame, theirs: DataFrame, on: list[str], same: DataFrame) -> DataFrame:
    """agree, equivalent or differ for each token; ``same``: pairs (tag, other) that count as equal (a map of tags)."""
    j = ours.join(theirs, on).join(same.withColumn("_eq", F.lit(1)), ["tag", "other"], "left")
    return j.withColumn("verdict", F.when(F.col("tag") == F.col("other"), "agree").when(F.col("_eq") == 1, "equivalent").otherwise("differ")).drop("_eq")


def spread_errors(counts: DataFrame, ratios: DataFrame, key: str) -> DataFrame:
    """Split error counts by measured integer ratios: n * part div whole."""
    return counts.join(ratios, key).withColumn("n", F.expr("errors * part div whole"))
