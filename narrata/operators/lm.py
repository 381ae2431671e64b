"""N-gram language models with interpolated modified Kneser-Ney smoothing, as aggregates and joins.

Sentences are arrays of words; each is read as <s> words </s>. An n-gram is its words joined by blanks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def _slice(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def counts(sentences: DataFrame, order: int) -> DataFrame:
    """(n, gram, context, word, raw): counts of all n-grams up to ``order``; one pass, partial sums before the shuffle."""
    s = sentences.select(F.concat(F.array(F.lit(BOS)), F.col("words"), F.array(F.lit(EOS))).alias("w"))
    out = None
    for n in range(1, order + 1):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        g = s.select(F.explode(F.transform(starts, _slice(n))).alias("gram")).select(F.lit(n).alias("n"), "gram")
        out = g if out is None else out.unionByName(g)
    return _parts(out.groupBy("n", "gram").agg(F.count("*").alias("raw")))


def _parts(df: DataFrame) -> DataFrame:
    return df.withColumn("word", F.substring_index("gram", " ", -1)).withColumn("context", F.expr("CASE WHEN n = 1 THEN '' ELSE substring(gram, 1, length(gram) - length(word) - 1) END"))


def adjusted(raw: DataFrame, order: int) -> DataFrame:
    """Lower orders count distinct words to the left; the highest order and n-grams that begin a sentence keep raw
    counts; <s> itself counts nothing."""
    left = raw.filter("n > 1").select((F.col("n") - 1).alias("n"), F.expr("substring(gram, instr(gram, ' ') + 1)").alias("gram"), F.substring_index("gram", " ", 1).alias("l"))
    left = left.groupBy("n", "gram").agg(F.count_distinct("l").alias("lefts"))
    j = raw.join(left, ["n", "gram"], "left")
    begins = F.substring_index("gram", " ", 1) == BOS
    c = F.when((F.col("n") == 1) & begins, 0).when((F.col("n") == order) | begins, F.col("raw")).otherwise(F.coalesce("lefts", F.lit(0)))
    return j.select("n", "gram", "context", "word", "raw", c.cast("long").alias("adj"))


def discounts(adj: DataFrame) -> DataFrame:
    """(n, d1, d2, d3); 0.5, 1, 1.5 where one of the count-of-counts is missing or a discount isn't within 0 and its count."""
    t = adj.groupBy("n").agg(*[F.sum((F.col("adj") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    ok = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = lambda j: F.lit(float(j)) - F.lit(float(j + 1)) * y * F.col(f"n{j + 1}") / F.nullif(F.col(f"n{j}"), F.lit(0))
    for j in (1, 2, 3):
        ok = ok & F.coalesce((d(j) >= 0) & (d(j) <= j), F.lit(False))
    return t.select("n", *[F.when(ok, d(j)).otherwise(F.lit(0.5 * j)).alias(f"d{j}") for j in (1, 2, 3)])


def discounted(adj: DataFrame, disc: DataFrame) -> DataFrame:
    """(n, gram, context, word, p, gamma): discounted probabilities and the weight of the lower order in the context."""
    a = adj.filter("adj > 0").join(F.broadcast(disc), "n")  # a row for each order
    d = F.when(F.col("adj") == 1, F.col("d1")).when(F.col("adj") == 2, F.col("d2")).otherwise(F.col("d3"))
    ctx = a.groupBy("n", "context").agg(F.sum("adj").alias("total"), F.sum(d).alias("taken"))
    return a.join(ctx, ["n", "context"]).select("n", "gram", "context", "word", ((F.col("adj") - d) / F.col("total")).alias("p"), (F.col("taken") / F.col("total")).alias("gamma"))


def probabilities(adj: DataFrame, disc: DataFrame, order: int) -> DataFrame:
    """(n, gram, prob): interpolated with all lower orders, down to the uniform over the vocabulary (<unk> included, <s> not)."""
    u = cut(discounted(adj, disc))  # every order reads it
    size = adj.filter((F.col("n") == 1) & (F.col("word") != BOS)).agg((F.count("*") + 1).alias("v"))
    low = u.filter("n = 1").join(F.broadcast(size)).select("n", "gram", (F.col("p") + F.col("gamma") / F.col("v")).alias("prob"))
    out = low
    for n in range(2, order + 1):
        now = u.filter(F.col("n") == n).withColumn("low_gram", F.expr("substring(gram, instr(gram, ' ') + 1)"))
        low = now.join(low.select(F.col("gram").alias("low_gram"), F.col("prob").alias("low")), "low_gram").select("n", "gram", (F.col("p") + F.col("gamma") * F.col("low")).alias("prob"))
        out = out.unionByName(low)
    return out


def backoffs(adj: DataFrame, disc: DataFrame) -> DataFrame:
    """(context, gamma) of every context of any length."""
    return discounted(adj, disc).filter("n > 1").select("context", "gamma").distinct()


def score(sentences: DataFrame, probs: DataFrame, gammas: DataFrame, order: int) -> DataFrame:
    """(sent, log10, oov, n): longest match of each word with backoff weights of the unused contexts.

    Words outside the vocabulary count as out-of-vocabulary and add nothing.
    """
    s = sentences.select("sent", F.concat(F.array(F.lit(BOS)), F.col("words"), F.array(F.lit(EOS))).alias("w"))
    t = s.select("sent", "w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("i"))
    for n in range(1, order + 1):
        t = t.withColumn(f"g{n}", F.when(F.col("i") >= n, F.array_join(F.slice("w", F.col("i") - (n - 1), n), " ")))
        t = t.withColumn(f"c{n}", F.when((F.col("i") > n - 1) & F.lit(n > 1), F.array_join(F.slice("w", F.greatest(F.col("i") - (n - 1), F.lit(1)), n - 1), " ")) if n > 1 else F.lit(None).cast("string"))
    t = t.drop("w")
    for n in range(1, order + 1):
        t = t.join(probs.filter(F.col("n") == n).select(F.col("gram").alias(f"g{n}"), F.col("prob").alias(f"p{n}")), f"g{n}", "left")
        if n > 1:
            t = t.join(gammas.select(F.col("context").alias(f"c{n}"), F.col("gamma").alias(f"b{n}")), f"c{n}", "left")
    best = F.lit(None).cast("double")
    for n in range(1, order + 1):  # a longer match wins; else its context's weight times the shorter one's value
        best = F.coalesce(F.col(f"p{n}"), best * F.coalesce(F.col(f"b{n}"), F.lit(1.0)) if n > 1 else F.lit(None).cast("double"))
    return t.withColumn("p", best).groupBy("sent").agg(F.sum(F.log10("p")).alias("log10"), F.sum(F.col("p").isNull().cast("long")).alias("oov"), F.count("*").alias("n"))


def prune(adj: DataFrame, thresholds: list[int]) -> DataFrame:
    """Drop n-grams whose raw count is at most their order's threshold (never of order 1); the last threshold is padded."""
    limit = F.lit(0)
    for n in range(2, 10):
        limit = F.when(F.col("n") == n, thresholds[min(n - 1, len(thresholds) - 1)]).otherwise(limit)
    return adj.filter((F.col("n") == 1) | (F.col("raw") > limit))


def restrict(grams: DataFrame, vocab: DataFrame) -> DataFrame:
    """N-grams of which every word is in the vocabulary."""
    words = grams.select("n", "gram", F.explode(F.split("gram", " ")).alias("word")).join(vocab.withColumn("_in", F.lit(1)), "word", "left")
    good = words.groupBy("n", "gram").agg(F.count("_in").alias("k")).filter(F.col("k") == F.col("n"))
    return grams.join(good.select("n", "gram"), ["n", "gram"], "left_semi")


def mix(models: list[tuple[DataFrame, float]]) -> DataFrame:
    """Log-linear interpolation: (n, gram, log10) proportional to the product of the models' probabilities, each to the
    power of its weight, normalised within the context. Models are (n, gram, prob); n-grams missing in one are left out."""
    out = None
    for i, (m, w) in enumerate(models):
        x = m.select("n", "gram", (F.log10("prob") * w).alias(f"_l{i}"))
        out = x if out is None else out.join(x, ["n", "gram"])
    out = _parts(out.withColumn("log10", sum((F.col(f"_l{i}") for i in range(len(models))), F.lit(0.0))))
    z = out.groupBy("n", "context").agg(F.log10(F.sum(F.pow(F.lit(10.0), F.col("log10")))).alias("_z"))
    return out.join(z, ["n", "context"]).select("n", "gram", (F.col("log10") - F.col("_z")).alias("log10"))


#: Sentences that go into one pass: a bit for each in the masks of their words, which are broadcast.
AT_ONCE = 1024


def _words_in_common(rows: DataFrame, longest: int, vocabularies: DataFrame, found, at_once: int) -> DataFrame:
    """(sent, n, gram) of rows with the words w1, w2 and so on up to ``longest``, null behind the last. ``found`` says which
    of a row's beginnings are n-grams, by an array of (n, whether). A word has a bit for each sentence that holds it, so
    the bits in common are the sentences that hold all words; they are known before any row is shuffled."""
    v = vocabularies.select("sent", "word").filter("sent is not null and word is not null").distinct()
    ranks = cut(v.select("sent").distinct().withColumn("rank", F.row_number().over(Window.orderBy("sent")) - 1))
    out, total = None, max(ranks.count(), 1)
    for start in range(0, total, at_once):
        part = ranks.filter((F.col("rank") >= start) & (F.col("rank") < start + at_once)).withColumn("rank", F.col("rank") - start)
        slots = range(-(-min(at_once, total - start) // 64))
        bit = F.expr("shiftleft(1L, rank % 64)")
        masks = v.join(F.broadcast(part), "sent").groupBy("word").agg(*[F.bit_or(F.when(F.expr("rank div 64") == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{j}") for j in slots])
        t = rows
        for i in range(1, longest + 1):
            m = masks.select(F.col("word").alias(f"w{i}"), *[F.col(f"m{j}").alias(f"b{i}_{j}") for j in slots])
            t = t.join(F.broadcast(m), f"w{i}", "left" if i > 1 else "inner")
            if i > 1:
                t = t.withColumns({f"b{i}_{j}": F.coalesce(F.col(f"b{i}_{j}").bitwiseAND(F.col(f"b{i - 1}_{j}")), F.lit(0).cast("long")) for j in slots})
        some = lambda n: reduce(lambda x, y: x | y, [F.col(f"b{n}_{j}") != 0 for j in slots])
        gram = lambda n: F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[f"w{i}" for i in range(1, n + 1)]).alias("gram"), *[F.col(f"b{n}_{j}").alias(f"m{j}") for j in slots])
        g = t.select(F.explode(F.array(*[F.when(here & some(n), gram(n)) for n, here in found])).alias("g")).filter("g is not null").select("g.*").distinct()
        g = g.select("n", "gram", F.explode(F.array(*[F.struct(F.lit(j).alias("slot"), F.col(f"m{j}").alias("bits")) for j in slots])).alias("s")).filter("s.bits <> 0")
        g = g.select("n", "gram", "s.slot", F.explode(F.expr("filter(sequence(0, 63), b -> bit_get(s.bits, b) = 1)")).alias("b"))
        g = g.select("n", "gram", (F.col("slot") * 64 + F.col("b")).alias("rank"))
        g = g.join(F.broadcast(part), "rank").select("sent", "n", "gram")
        out = g if out is None else out.unionByName(g)
    return out


def restrict_to_any(grams: DataFrame, vocabularies: DataFrame, longest: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(sent, n, gram): the n-grams whose words all lie in a sentence's vocabulary (sent, word), for each sentence; over all
    sentences (``distinct``) this is the union of the single filters."""
    longest = longest or grams.agg(F.max("n")).first()[0] or 1
    words = F.split("gram", " ")
    rows = grams.select("n", *[F.get(words, F.lit(i - 1)).alias(f"w{i}") for i in range(1, longest + 1)])
    return _words_in_common(rows, longest, vocabularies, [(n, F.col("n") == n) for n in range(1, longest + 1)], at_once)


def sentences_to_any(sentences: DataFrame, order: int, vocabularies: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """The same for all n-grams of sentences up to ``order``, without counting them first."""
    w = F.concat(F.array(F.lit(BOS)), F.col("words"), F.array(F.lit(EOS)))
    s = sentences.select(w.alias("w"))
    ahead = s.select(F.inline(F.arrays_zip(*[F.slice("w", i, F.size("w")).alias(f"w{i}") for i in range(1, order + 1)])))
    return _words_in_common(ahead.toDF(*[f"w{i}" for i in range(1, order + 1)]), order, vocabularies, [(n, F.col(f"w{n}").isNotNull()) for n in range(1, order + 1)], at_once)


def restrict_to_phrases(grams: DataFrame, phrases: DataFrame) -> DataFrame:
    """The n-grams that are parts of a phrase (words array) as they stand, in order and side by side."""
    part = F.explode(F.sequence(F.lit(1), F.size("words")))
    parts = phrases.filter("size(words) > 0").select("words", part.alias("i"))
    width = F.explode(F.sequence(F.lit(1), F.least(F.size("words") - F.col("i") + 1, F.lit(9))))
    spans = parts.select("words", "i", width.alias("n")).select(F.array_join(F.slice("words", F.col("i"), F.col("n")), " ").alias("gram")).distinct()
    return grams.join(spans, "gram", "left_semi")
