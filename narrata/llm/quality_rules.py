"""Quality rules as one Spark projection.

A table of thresholds (length, symbol, stop-word, line and repetition ratios) is compiled into boolean columns of
a single ``select``: no user functions, no shuffle, one pass over the documents.

Defined results: a null text counts as the empty text (no words, base_failed true); lines without a word never count
as duplicates; rows are independent, so ties, repeated rows, null ids and extra columns change nothing; a text of any
length is judged by the same rules, as one row. Repeated windows of words are told apart by 64-bit hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most frequent function words of the languages in scope.
STOP_WORDS = (
    "the of and to in is that it for was with as on are be this by at or from "  # English
    "le la les de des du et en un une que qui dans pour sur est pas par au avec "  # French
    "der die das und ist von zu mit den dem ein eine nicht im für auf als auch des sich "  # German
    "el los las y del al una con por para se su lo como no más es"  # Spanish
).split()

#: Space and the control characters from tab to carriage return separate words.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes where ``low <= measure <= high``, where it has under ``least_words`` words, or where the measure is null."""

    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0

    def column(self) -> Column:
        m, ok = F.col(self.measure), F.lit(True)
        if self.low is not None:
            ok = ok & (m >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (m <= F.lit(self.high))
        if self.least_words:
            ok = ok | (F.col("n_words") < self.least_words)
        return F.coalesce(ok, F.lit(True))


#: The threshold table.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_word_ratio", high=0.25),
    Rule("stop_word_ratio", low=0.02, least_words=20),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.2),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts behind the rules to ``df``; the temporary columns are prefixed with ``_q_``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("_q_t", t)
    df = df.withColumns({
        "_q_w": words_of(F.col("_q_t")),
        "_q_lines": F.filter(F.split("_q_t", "\n"), lambda x: F.length(F.translate(x, SEPARATOR_CHARS, "")) > 0),
        "word_chars": F.length(F.translate("_q_t", SEPARATOR_CHARS, "")).cast("long"),
        "n_symbols": (F.length("_q_t") - F.length(F.translate("_q_t", SYMBOLS, ""))).cast("long"),
    })
    w = F.col("_q_w")
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long"),
        "_q_h": F.when(
            F.size(w) >= 5,
            F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])),
        ).otherwise(F.array().cast("array<long>")),
    })
    # windows are sorted only where one of them occurs twice
    df = df.withColumn(
        "_q_s",
        F.when(
            F.size(F.array_distinct("_q_h")) < F.size("_q_h"),
            F.sort_array(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("_q_s")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    df = df.withColumn(
        "_q_d", F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    )
    covered = F.aggregate(
        "_q_d",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n")),
    )["n"]
    n = F.nullif(F.col("n_words"), F.lit(0).cast("long")).cast("double")
    lines = F.nullif(F.col("n_lines"), F.lit(0).cast("long")).cast("double")
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumns({
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_word_ratio": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "repeat_word_ratio": F.col("n_repeat_words") / n,
        "base_failed": (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
    })
    return df.drop("_q_t", "_q_w", "_q_lines", "_q_h", "_q_s", "_q_d")


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measures, one ``ok_<measure>`` column a rule, and ``kept``: every rule holds and the base test is passed."""
    df = measured(df, text)
    df = df.withColumns({f"ok_{r.measure}": r.column() for r in rules})
    kept = ~F.col("base_failed")
    for r in rules:
        kept = kept & F.col(f"ok_{r.measure}")
    return df.withColumn("kept", kept)
