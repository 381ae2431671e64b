"""Mixing sources to target weights, with soft domain membership. DataFrame operations only.

1. A discretised naive Bayes classifier is trained on the labelled documents: its classes are the observed pairs of
   (quality, toxic), its features are binned text ratios and binned counts of learned indicator words. It gives every
   document a posterior over the domains; nothing is assigned outright.
2. Rates r >= 0, the expected copies of each document, minimise |W^(1/2) (A r - T)|^2 by projected gradient. A r are
   the expected tokens of each domain (sum of rate, tokens and posterior), T the targets, and W the inverse of the
   domains' Gram matrix, which makes one step length right for all. The update of a rate is
   max(0, r - step . p): it depends on the document's posterior only, so a rate is a function of p and the list of
   steps taken, and no rates are stored between iterations. Documents of equal bins have equal posteriors, and an
   iteration sums over the table of bins (as many rows as there are combinations, however many documents).
3. A document's copies are the whole part of its rate, and one more with the fraction's probability, drawn from a hash.

Fitting reads at most ``labelled`` labelled rows (by hash); everything else covers all rows and whole texts.

Defined results: null and empty texts have no tokens and get the rate of their posterior; repeated rows get equal
rates; rows of equal doc_id draw equal fractions; without labels all documents belong to one domain; targets of domains
that don't occur count as zero, and targets that can't be met leave a residual, which is returned and, over 0.01, warned
of; extra columns of any name are carried by ``mix`` and not read; empty tables give empty results. A text of any length
is one row: memory grows with the longest.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, staged, unstage, whole_rows
from .quality_rules import STOP_WORDS

#: Expected share of tokens of each domain, (quality, toxic).
TARGETS = {(1, 0): 0.95, (1, 1): 0.05, (0, 0): 0.0, (0, 1): 0.0}
WORDS = "[\\x20\\x09-\\x0D]+"
N_INDICATORS = 48

#: Upper bin edges of each ratio.
EDGES = {
    "symbols": (0.001, 0.02, 0.2),
    "upper": (0.05, 0.2, 0.5),
    "bars": (0.001, 0.05),
    "distinct": (0.1, 0.2, 0.4),
    "stops": (0.001, 0.03, 0.1),
    "quality_words": (0.5, 1.5, 3.5),
    "toxic_words": (0.5, 1.5, 3.5),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


@dataclass
class Bayes:
    """Log priors by class, log likelihoods by feature, bin and class, and the indicator words of both labels."""

    classes: list[tuple[int, int]]
    prior: list[float]
    table: dict[str, list[list[float]]]
    lexicon: dict[str, list[str]]


def features(docs: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """``docs`` (text and columns of this module) with n_tokens and a bin number for each feature."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_m_t", t).withColumn("_m_w", _words(F.col("_m_t")))
    n, chars = F.greatest(F.size("_m_w"), F.lit(1)), F.greatest(F.length("_m_t"), F.lit(1))
    found = lambda pattern: F.regexp_count("_m_t", F.lit(pattern))
    hits = lambda words: F.size(F.filter("_m_w", lambda w: w.isin(*words))) if words else F.lit(0)
    distinct = F.array_distinct("_m_w")
    values = {
        "symbols": found("[#*$%&<>@^~]") / n,
        "upper": found("\\p{Lu}") / chars,
        "bars": found("[|]") / n,
        "distinct": F.when(F.size("_m_w") < 15, 1.0).otherwise(F.size(distinct) / F.pow(n, F.lit(0.8))),
        "stops": F.when(F.size("_m_w") < 15, 1.0).otherwise(hits(STOP_WORDS) / n),
        "quality_words": hits(lexicon.get("quality", [])),
        "toxic_words": hits(lexicon.get("toxic", [])),
    }
    bins = {f"b_{k}": sum(((v > F.lit(float(e))).cast("int") for e in EDGES[k]), F.lit(0)) for k, v in values.items()}
    return df.withColumns({"n_tokens": F.size("_m_w").cast("long")} | bins).drop("_m_t", "_m_w")


BINS = [f"b_{k}" for k in EDGES]


def train(docs: DataFrame, labels: DataFrame, labelled: int = 12_000) -> Bayes:
    """Fit on at most ``labelled`` labelled documents."""
    known = (
        pick(labels, doc_id="long", quality="int", toxic="int").filter("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    )
    rows = staged(pick(docs, doc_id="long", text="string").join(F.broadcast(known), "doc_id"), "mixing-sample")  # bounded by ``labelled``
    # words that mark a label: high log odds of the documents that hold them
    totals = rows.agg(F.count("*").alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("t")).first()
    n, q, tox = totals["n"], totals["q"] or 0, totals["t"] or 0
    if not n:
        return Bayes([(1, 0)], [0.0], {b: [[0.0]] * (len(EDGES[b[2:]]) + 1) for b in BINS}, {})
    word = F.explode(F.array_distinct(F.transform(_words(F.coalesce("text", F.lit(""))), lambda w: F.regexp_replace(w, "[.,;:!?]+$", ""))))
    counts = rows.select("quality", "toxic", word.alias("word")).filter("length(word) > 0").groupBy("word").agg(F.count("*").alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("t"))
    least = max(3, n // 300)
    counts = staged(counts.filter(F.col("n") >= least), "mixing-words")
    lexicon = {}
    for name, having, total in (("quality", F.col("n") - F.col("q"), n - q), ("toxic", F.col("t"), tox)):
        odds = F.log((having + 0.5) / (F.lit(total + 1.0))) - F.log((F.col("n") - having + 0.5) / F.lit(n - total + 1.0))
        got = counts.select("word", odds.alias("odds")).filter("odds > 2").orderBy(F.desc("odds"), "word").limit(N_INDICATORS).collect()
        lexicon[name] = sorted({w for r in got for w in (r["word"], f"{r['word']}.", f"{r['word']},")})
    f = features(rows, lexicon)
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("f"), F.col(b).alias("bin")) for b in BINS]))
    got = f.select("quality", "toxic", pairs.alias("x")).groupBy("quality", "toxic", "x.f", "x.bin").count().collect()  # bins times classes
    unstage(rows)
    unstage(counts)
    classes = sorted({(r["quality"], r["toxic"]) for r in got})
    size = {c: sum(r["count"] for r in got if (r["quality"], r["toxic"]) == c and r["f"] == BINS[0]) for c in classes}
    table = {}
    for b in BINS:
        width = len(EDGES[b[2:]]) + 1
        have = {((r["quality"], r["toxic"]), r["bin"]): r["count"] for r in got if r["f"] == b}
        table[b] = [[math.log((have.get((c, i), 0) + 0.5) / (size[c] + 0.5 * width)) for c in classes] for i in range(width)]
    return Bayes(classes, [math.log(size[c] / n) for c in classes], table, lexicon)


def with_posterior(df: DataFrame, model: Bayes) -> DataFrame:
    """Add ``p``, the array of class probabilities, from the bins."""
    logs = [
        sum((F.get(F.array(*[F.lit(row[c]) for row in model.table[b]]), F.col(b)) for b in BINS), F.lit(model.prior[c]))
        for c in range(len(model.classes))
    ]
    df = df.withColumn("_m_logs", F.array(*logs))
    share = lambda x: F.lit(1.0) / F.aggregate("_m_logs", F.lit(0.0), lambda a, y: a + F.exp(y - x))
    return df.withColumn("p", F.transform("_m_logs", share)).drop("_m_logs")


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate of a document with posterior ``p`` after the given steps, starting from one."""
    if not steps:
        return F.lit(1.0)
    dot = lambda s: sum((F.get(p, k) * F.get(s, k) for k in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(F.array(*[F.array(*map(F.lit, s)) for s in steps]), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def solve(cells: DataFrame, weights: list[float], rounds: int = 40, tolerance: float = 1e-5) -> tuple[list[list[float]], float]:
    """Projected gradient over ``cells`` (p, n): the steps and the last relative residual."""
    k = len(weights)
    gram = cells.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.get("p", i) * F.get("p", j)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    total = float(gram["n"] or 0)
    if not total:
        return [], 0.0
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
    inverse = np.linalg.inv(g + 1e-4 * np.eye(k) * max(1e-9, np.trace(g) / k))
    target, steps, residual = np.array(weights), [], 1.0
    for _ in range(rounds):
        r = rate(F.col("p"), steps)
        got = cells.agg(*[F.sum(F.col("n") * F.get("p", i) * r).alias(f"s{i}") for i in range(k)]).first()
        rho = np.array([got[f"s{i}"] for i in range(k)]) / total - target
        residual, last = float(np.abs(rho).max()), residual
        if residual < tolerance or abs(last - residual) < tolerance:  # met, or as near as nonnegative rates come
            break
        steps.append([float(x) for x in inverse @ rho])
    return steps, residual


def rates(
    docs: DataFrame, labels: DataFrame, targets: dict[tuple[int, int], float] | None = None, labelled: int = 12_000, whole: bool = False
) -> tuple[DataFrame, Bayes, float]:
    """(doc_id, n_tokens, p (posteriors), rate, copies) for each row of ``docs``, the model, and the relative residual.

    The targets are shares of the present token total. The residual is what nonnegative rates of these posteriors can't
    reach, or what ``solve`` left. ``whole``: the rows themselves come along as the column ``row``; their bins are then
    computed in both passes, which costs less than shuffling or writing texts.
    """
    targets = TARGETS if targets is None else targets
    model = train(docs, labels, labelled)
    narrow = pick(docs, doc_id="long", text="string")
    if whole:
        rows = whole_rows(docs)
        narrow = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    binned = features(narrow, model.lexicon).drop("text")
    if not whole:
        binned = staged(binned, "mixing-bins")
    counted = staged(binned.groupBy(*BINS).agg(F.sum("n_tokens").alias("n")), "mixing-cells")
    cells = staged(with_posterior(counted, model).select("n", "p"), "mixing-cells")
    weights = [targets.get(c, 0.0) for c in model.classes]
    if len(model.classes) == 1:
        weights = [1.0]
    steps, residual = solve(cells, [w / (sum(weights) or 1.0) for w in weights])
    unstage(counted)
    unstage(cells)
    if residual > 0.01:
        warnings.warn(f"the targets can't be met: a domain's share is off by {residual:.4f}", stacklevel=2)
    out = with_posterior(binned, model).drop(*BINS).withColumn("rate", rate(F.col("p"), steps))
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    # zero, but not deterministic to the optimizer: else it would copy all expressions into a filter on ``copies``
    u = u + F.least(F.spark_partition_id(), F.lit(0))
    return out.withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("long")), model, residual


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[tuple[int, int], float] | None = None, labelled: int = 12_000) -> DataFrame:
    """(doc_id, n_tokens, p_q<quality>t<toxic> ..., rate, copies, residual) of every row."""
    out, model, residual = rates(docs, labels, targets, labelled)
    named = [(F.get("p", model.classes.index((q, t))) if (q, t) in model.classes else F.lit(0.0)).alias(f"p_q{q}t{t}") for q in (0, 1) for t in (0, 1)]
    return out.select("doc_id", "n_tokens", *named, "rate", "copies", F.lit(residual).alias("residual"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[tuple[int, int], float] | None = None, labelled: int = 12_000) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its copies say."""
    out, _, _ = rates(docs, labels, targets, labelled, whole=True)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
