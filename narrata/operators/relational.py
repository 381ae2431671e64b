"""Relational building blocks: keyed updates, set-like maintenance of tables, ties, nearest positions, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_add(old: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], last: list[str], seq: str) -> DataFrame:
    """Add the counters of ``delta`` to those of ``old``; columns in ``last`` take the value of the greatest ``seq``.

    One aggregation over the union: partial sums are formed before the shuffle.
    """
    both = old.select(*keys, *sums, *last, seq).unionByName(delta.select(*keys, *sums, *last, seq))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, seq).alias(c) for c in last], F.max(seq).alias(seq))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed replacement: rows of ``new`` take the place of rows of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows of ``new`` whose key ``old`` lacks; of equal new keys one."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE; rows for which the condition is null stay."""
    return df.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def delete_in(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def set_flags(flags: Column, mask: int) -> Column:
    return flags.bitwiseOR(F.lit(mask))


def has_flags(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def round_robin(df: DataFrame, order: str, parts: int, first: int = 101) -> DataFrame:
    """Number rows in order and deal them to ``parts`` work partitions from ``first`` on.

    A global numbering in one task would not scale: rows are numbered within ranges of the order, and the ranges'
    offsets (a row each) are added.
    """
    ranged = df.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    numbered = ranged.withColumn("_n", within)
    sizes = ranged.groupBy("_range").count()
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = numbered.join(F.broadcast(offsets.select("_range", "_before")), "_range")  # a row for each partition
    return numbered.withColumn("partition", ((F.col("_n") + F.col("_before")) % parts + first).cast("long")).drop("_n", "_before", "_range")


def modes(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """All values at the greatest count of their group, ties included."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    most = counts.groupBy(*group).agg(F.max("n").alias("n"))
    return counts.join(most, [*group, "n"])


def by_count(df: DataFrame, key: str) -> DataFrame:
    """Reverse map: for each count the keys that have it, sorted and joined by commas."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.groupBy("n").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.col(key).cast("string")))).alias("members"), F.count("*").alias("n_keys"))


def lift(df: DataFrame, subject: str, verb: str, least_pair: int, least_verb: int) -> DataFrame:
    """count(subject, verb) / count(verb), in one pass over pairs."""
    pairs = df.groupBy(subject, verb).agg(F.count("*").alias("n_pair"))
    verbs = pairs.groupBy(verb).agg(F.sum("n_pair").alias("n_verb"))
    return pairs.join(verbs, verb).filter((F.col("n_pair") >= least_pair) & (F.col("n_verb") >= least_verb)).withColumn("ratio", F.col("n_pair") / F.col("n_verb"))


def top_union(df: DataFrame, group: list[str], key: str, measures: list[str], k: int) -> DataFrame:
    """Union of the top k by each measure (ties by key)."""
    ranked = df.withColumns({f"_r{i}": F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(m), key)) for i, m in enumerate(measures)})
    wanted = F.lit(False)
    for i in range(len(measures)):
        wanted = wanted | (F.col(f"_r{i}") <= k)
    return ranked.filter(wanted).drop(*[f"_r{i}" for i in range(len(measures))])


def nearest(df: DataFrame, doc: str, pos: str, is_target: Column) -> DataFrame:
    """Distance from each row to the nearest target row of its document, on either side."""
    back = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(doc).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(is_target, F.col(pos))
    before, after = F.last(at, True).over(back), F.first(at, True).over(on)
    return df.withColumn("distance", F.least(F.col(pos) - before, after - F.col(pos)))


def within(points: DataFrame, spans: DataFrame, doc: str, pos: str, begin: str, end: str, width: int = 64) -> DataFrame:
    """Points inside half-open spans of their document. Both sides are cut into cells of ``width`` positions, so that
    the join is an equi-join even where one document holds most rows."""
    p = points.withColumn("_cell", F.floor(F.col(pos) / width))
    s = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.greatest(F.col(end), F.col(begin) + 1) - 1) / width))))
    return p.join(s, [doc, "_cell"]).filter((F.col(pos) >= F.col(begin)) & (F.col(pos) < F.col(end))).drop("_cell")


def claimed(rows: DataFrame, order: list[str], workers: int) -> DataFrame:
    """The first ``workers`` rows in order, each with the number of the worker that takes it. A worker that comes later
    finds them gone, as rows that are taken are skipped, not waited for."""
    first = rows.orderBy(*order).limit(workers)  # as many rows as there are workers
    return first.withColumn("worker", F.row_number().over(Window.orderBy(*order)) - 1)


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the keys that go."""
    keys = gone.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}
