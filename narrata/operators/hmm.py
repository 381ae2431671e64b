"""Hidden Markov tagging: vocabulary, counts and probabilities as aggregates; decoding per sentence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

START = "--s--"
BREAK = "--n--"


def vocabulary(tagged: DataFrame, least: int = 2) -> DataFrame:
    return tagged.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("word")


def with_unknown(tagged: DataFrame, vocab: DataFrame, unknown) -> DataFrame:
    """Words outside the vocabulary become their class."""
    return tagged.join(vocab.withColumn("_k", F.lit(1)), "word", "left").withColumn("word", F.when(F.col("_k").isNull(), unknown(F.col("word"))).otherwise(F.col("word"))).drop("_k")


def transitions(tagged: DataFrame) -> DataFrame:
    """(prev, tag, n): a sentence begins and ends in the start state."""
    w = Window.partitionBy("sent").orderBy("pos")
    steps = tagged.select("sent", F.coalesce(F.lag("tag").over(w), F.lit(START)).alias("prev"), "tag")
    ends = tagged.groupBy("sent").agg(F.max_by("tag", "pos").alias("prev")).select("sent", "prev", F.lit(START).alias("tag"))
    return steps.unionByName(ends).groupBy("prev", "tag").agg(F.count("*").alias("n"))


def emissions(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("tag", "word").agg(F.count("*").alias("n"))


def transition_probabilities(counts: DataFrame, alpha: float = 0.001) -> DataFrame:
    """(c + alpha) / (context + alpha K) of all pairs of the K states."""
    states = counts.select("tag").union(counts.select(F.col("prev").alias("tag"))).distinct()
    k = states.agg(F.count("*").alias("k"))
    context = counts.groupBy("prev").agg(F.sum("n").alias("ctx"))
    pairs = context.join(F.broadcast(states.crossJoin(k)))  # K by K states: the tag set, which doesn't grow with the corpus
    return pairs.join(counts, ["prev", "tag"], "left").select("prev", "tag", ((F.coalesce("n", F.lit(0)) + alpha) / (F.col("ctx") + alpha * F.col("k"))).alias("p"))


def emission_probabilities(counts: DataFrame, alpha: float = 0.001) -> DataFrame:
    """(c + alpha) / (context + alpha N) of the pairs seen; N: words of the vocabulary."""
    n = counts.agg(F.count_distinct("word").alias("words"))
    context = counts.groupBy("tag").agg(F.sum("n").alias("ctx"))
    return counts.join(F.broadcast(context), "tag").join(F.broadcast(n)).select("tag", "word", ((F.col("n") + alpha) / (F.col("ctx") + alpha * F.col("words"))).alias("p"))


def trigram_transitions(tagged: DataFrame) -> DataFrame:
    """(t2, t1, tag, n) with two start states, and the number of contexts seen once (for one-count smoothing)."""
    w = Window.partitionBy("sent").orderBy("pos")
    s = lambda k: F.coalesce(F.lag("tag", k).over(w), F.lit(START))
    tri = tagged.select(s(2).alias("t2"), s(1).alias("t1"), "tag").groupBy("t2", "t1", "tag").agg(F.count("*").alias("n"))
    single = tri.groupBy("t2", "t1").agg((1 + F.sum((F.col("n") == 1).cast("long"))).alias("lambda"))
    return tri.join(single, ["t2", "t1"])


def viterbi(words: list[str], states: list[str], first: np.ndarray, trans: np.ndarray, emit: dict[str, np.ndarray], unseen: np.ndarray, last: np.ndarray | None = None) -> list[str]:
    """Best path in log space; the first state in order wins ties."""
    if not words:
        return []
    score, back = first + emit.get(words[0], unseen), []
    for w in words[1:]:
        step = score[:, None] + trans
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + emit.get(w, unseen)
    if last is not None:
        score = score + last
    at = int(score.argmax())
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return [states[i] for i in reversed(path)]


def decode(sentences: DataFrame, transition: DataFrame, emission: DataFrame, alpha: float = 0.001, most: int = 5_000_000) -> DataFrame:
    """(sent, tags): sentences (sent, words array) tagged in Arrow batches.

    ``emission``: counts (tag, word, n) over a vocabulary in which rare words are classes; ``sentences`` name the same
    classes. A word that a tag wasn't seen with has alpha / (context + alpha N). The model (tag set by vocabulary) is
    collected: it is bounded by the vocabulary, and an error beyond ``most`` entries.
    """
    t, e = transition.toPandas(), emission.limit(most + 1).toPandas()
    if len(e) > most:
        raise ValueError("the emission table is too large to send to every task")
    states = sorted(set(e["tag"]))
    at = {s: i for i, s in enumerate(states)}
    k, n_words = len(states), e["word"].nunique()
    tiny = np.log(1e-12)
    trans, first, last = np.full((k, k), tiny), np.full(k, tiny), np.full(k, tiny)
    for prev, tag, p in zip(t["prev"], t["tag"], t["p"], strict=True):
        if prev == START and tag in at:
            first[at[tag]] = np.log(p)
        elif tag == START and prev in at:
            last[at[prev]] = np.log(p)
        elif prev in at and tag in at:
            trans[at[prev], at[tag]] = np.log(p)
    context = e.groupby("tag")["n"].sum().reindex(states).to_numpy(dtype=float)
    unseen = np.log(alpha / (context + alpha * n_words))
    emit: dict[str, np.ndarray] = {}
    for tag, word, n in zip(e["tag"], e["word"], e["n"], strict=True):
        i = at[tag]
        emit.setdefault(word, unseen.copy())[i] = np.log((n + alpha) / (context[i] + alpha * n_words))
    model = sentences.sparkSession.sparkContext.broadcast((states, first, trans, emit, unseen, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, first, trans, emit, unseen, last = model.value
        for b in batches:
            tags = [viterbi(w or [], states, first, trans, emit, unseen, last) for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sent"), pa.array(tags, pa.list_(pa.string()))], names=["sent", "tags"])

    return sentences.select("sent", "words").mapInArrow(run, "sent long, tags array<string>")


def folds(df: DataFrame, order: str, k: int) -> DataFrame:
    """Contiguous portions of floor(n / k) rows; a remainder becomes an extra portion."""
    n = df.agg(F.expr(f"greatest(count(*) div {k}, 1)").alias("_size"))
    size = n.first()["_size"]
    # rows are numbered by range: each range by itself, then the ranges' sizes before it are added
    ranged = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    before, offsets = 0, []
    for p, rows in sorted(map(tuple, ranged.groupBy("_p").count().collect())):  # a row for each partition
        offsets.append((p, before))
        before += rows
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _o long"))  # as many rows as partitions
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_o")
    return ranged.join(offset, "_p").withColumn("_i", place).withColumn("fold", F.floor(F.col("_i") / size).cast("long")).drop("_i", "_p", "_o")


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, tag, n): how often each tag was given for each."""
    return pairs.groupBy("gold", "tag").agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    """Per gold tag: tokens, right ones, precision, recall."""
    gold = pairs.groupBy(F.col("gold").alias("tag")).agg(F.count("*").alias("n_gold"), F.sum((F.col("gold") == F.col("tag")).cast("long")).alias("n_right"))
    said = pairs.groupBy("tag").agg(F.count("*").alias("n_said"))
    return gold.join(said, "tag", "left").select("tag", "n_gold", F.coalesce("n_said", F.lit(0)).alias("n_said"), "n_right", (F.col("n_right") / F.col("n_gold")).alias("recall"))


