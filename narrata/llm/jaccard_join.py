"""Similarity join on word n-gram sets: MinHash banding finds candidates, full sets decide.

1. One Python pass computes each document's set of five-word shingles (64-bit hashes of lower-case words between white
   space; a text of one to four words is one shingle), its MinHash bands and a 128-bit digest of the set. Documents
   of equal sets form a class, and only classes go on.
2. Only band hashes are shuffled. Classes that meet in a bucket are linked to the bucket's least member, and the
   components of these links are blocks of candidates: every colliding pair lies in one block, once. A block too heavy
   for a few tasks (chains of chance collisions) is compared bucket by bucket instead, where a pair counts in the first
   band that it shares.
3. The members' texts are read again and their full sets are compared within blocks or buckets. One above a fixed
   weight is cut into parts by hash and every pair of parts is a task of its own, so that no group, however large,
   meets in one task and no pair is skipped. A task returns a count for each class and a spanning forest of its links,
   never pairs.

Rows and bands follow from the threshold and the recall wanted at it: with J = 0.8, five rows and the fewest bands
that find a pair with probability ``recall`` (0.9999 needs 24).

Defined results: null and empty texts have no shingles, are in classes of their own and have no links; repeated rows
count as copies; a row without doc_id takes part like any other, and a class or group of such rows only has a null name;
where rows share a doc_id each is judged by its text; texts of any length are read whole; a tie for the row that stays
goes to the least doc_id, nulls last, then to the text's hash; extra columns of any name are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FIVE, Memo, apart, parallelism, pick, short_batches, slices, staged, unstage, whole_rows
from .components import components

SET_SCHEMA = "doc_id long, tag long, set_id binary, n_shingles int, bands array<long>"
PART_WEIGHT = 1_000_000  # shingles that one side of a comparing task may hold, about
PART_MEMBERS = 512
BLOCK_PARTS = 16  # a block of more parts is compared by buckets


def bands_for(threshold: float, recall: float, rows: int = 5) -> int:
    """The fewest bands that a pair at the threshold misses with a probability of at most ``1 - recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


_WORD = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int = FIVE) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORD.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(h))
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = out * _M + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(out))


def _signer(bands: int, rows: int):
    k = bands * rows
    rng = np.random.default_rng(20_240_117)
    a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, k, dtype=np.uint64)

    def signature(s: np.ndarray) -> np.ndarray:
        least = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(s), 2048):
            np.minimum(least, (s[at : at + 2048, None] * a + b).min(axis=0), out=least)
        h = np.zeros(bands, dtype=np.uint64)
        for r in range(rows):
            h = mixed(h * _M + least.reshape(bands, rows)[:, r])
        return h.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _WORD.claim()
        for batch in batches:
            for part in slices(batch, 1000):
                ids, counts, signs = [], [], []
                for t in part.column("text").to_pylist():
                    s = shingles(t)
                    counts.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signs.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tag"), pa.array(ids, pa.binary()), pa.array(counts, pa.int32()), pa.array(signs, pa.list_(pa.int64()))],
                    names=["doc_id", "tag", "set_id", "n_shingles", "bands"],
                )

    return run


_CARRIED = ("node", "size", "block", "band", "parts", "part", "bands")
SETS = "node binary, size long, block binary, band int, parts int, part int, bands array<long>, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the texts that stand for a class."""
    _WORD.claim()
    for batch in batches:
        for part in slices(batch, 500):
            sets, keep = [], []
            for i, (t, node) in enumerate(zip(part.column("text").to_pylist(), part.column("node").to_pylist(), strict=True)):
                s = shingles(t).tobytes()
                if hashlib.blake2b(s, digest_size=16).digest() == node:
                    keep.append(i)
                    sets.append(s)
            part = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in _CARRIED] + [pa.array(sets, pa.binary())], names=[*_CARRIED, "shingles"])


def _comparer(threshold: float):
    def compare(key, table):
        table = table.sort_by("node")
        nodes, size, part = table.column("node").to_pylist(), table.column("size").to_numpy(), table.column("part").to_numpy()
        once = [i for i in range(len(nodes)) if not i or nodes[i] != nodes[i - 1]]  # a repeated row stands for the same class
        nodes, size, part = [nodes[i] for i in once], size[once], part[once]
        raw = table.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in once]
        n, band = len(nodes), key[1].as_py()
        counts = np.array([len(s) for s in sets], dtype=np.int64)
        inter = shared_counts(sets)
        union = counts[:, None] + counts[None, :] - inter
        near = inter >= threshold * union - 1e-9
        np.fill_diagonal(near, False)
        if key[2].as_py() != key[3].as_py():  # two parts: pairs within each part have a task of their own
            near &= part[:, None] != part[None, :]
        if band > 0:  # pairs that share an earlier band are met there
            all_bands = table.column("bands").to_pylist()
            for earlier in np.array([all_bands[i][:band] for i in once], dtype=np.int64).T:
                near &= earlier[:, None] != earlier[None, :]
        links = near @ size
        root = list(range(n))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(n):
            for j in np.flatnonzero(near[i, :i]).tolist():
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
        keep = [i for i in range(n) if links[i]]
        return pa.table({"node": pa.array([nodes[i] for i in keep], pa.binary()), "links": pa.array([int(links[i]) for i in keep], pa.int64()), "other": pa.array([nodes[find(i)] for i in keep], pa.binary())})

    return compare


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the shingles that occur twice or more."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.int64)
    if n < 2:
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    often = np.diff(np.append(new, len(values))) > 1
    column = np.repeat(np.cumsum(often) - 1, np.diff(np.append(new, len(values))))
    twice = np.repeat(often, np.diff(np.append(new, len(values))))
    column, owner = column[twice], owner[twice]
    total = int(often.sum())
    for at in range(0, total, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        m = np.zeros((n, min(4096, total - at)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _parts(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` (block, band, node) with the number of parts that each block is cut into; ``sets``: node, n."""
    sizes = members.join(sets, "node").groupBy("block", "band").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    parts = F.greatest(F.ceil(F.col("m") / PART_MEMBERS), F.ceil(F.col("w") / PART_WEIGHT)).cast("int").alias("parts")
    return members.join(sizes.select(apart("block"), "band", parts), ["block", "band"])


def _grouped(rows: DataFrame, threshold: float, recall: float, n_rows: int, block_parts: int) -> tuple[DataFrame, DataFrame]:
    """(signed, named) for ``rows`` (doc_id, text, tag): each row's set_id, and each set's class, root, group and links."""
    spark = rows.sparkSession
    signed = staged(rows.mapInArrow(_signer(bands_for(threshold, recall, n_rows), n_rows), SET_SCHEMA), "shingle-sets", compression="zstd")
    classes = staged(
        signed.filter("n_shingles > 0").groupBy(F.col("set_id").alias("node"))
        .agg(F.min(F.struct("doc_id", "tag")).alias("rep"), F.min("doc_id").alias("class_id"), F.count("*").alias("size"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    bucket = classes.select("node", F.posexplode("bands").alias("band", "h"))
    heads = bucket.groupBy("band", "h").agg(F.min("node").alias("head"), F.count("*").alias("m")).filter("m > 1").drop("m")
    meet = staged(bucket.join(heads.select("band", apart("h"), "head"), ["band", "h"]).select("node", "head", "band"), "buckets")
    blocks = components(meet.select(F.col("node").alias("a"), F.col("head").alias("b")))
    blocks = staged(_parts(blocks.select("node", F.col("root").alias("block"), F.lit(-1).alias("band")), classes.select("node", "n")), "blocks")
    heavy = blocks.filter(F.col("parts") > block_parts).select("node")
    if heavy.limit(1).count():
        split = _parts(meet.join(heavy, "node", "left_semi").select("node", F.col("head").alias("block"), "band"), classes.select("node", "n"))
        blocks = blocks.filter(F.col("parts") <= block_parts).unionByName(split)
    bands = F.when(F.col("band") > 0, F.col("bands"))
    members = blocks.join(classes.select("node", "rep", "size", "bands"), "node").select(
        "node", "rep", "size", "block", "band", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), bands.alias("bands")
    )
    texts = rows.select("text", "doc_id", "tag").join(members, F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.tag") == F.col("tag")))
    sets = texts.select(*_CARRIED, "text").mapInArrow(_sets, SETS)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tasks = sets.withColumn("other", other).select("node", "size", "part", "bands", "shingles", "block", "band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    # parts meet as (p, q): part p's rows come with every q; a part meets itself once
    keys = ("block", "band", "p", "q")
    found = staged(tasks.repartition(parallelism(spark), *keys).groupBy(*keys).applyInArrow(_comparer(threshold), "node binary, links long, other binary"), "links")
    unstage(meet)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.select("node", "class_id", "size").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a component's name is its least doc_id, not its least digest
    least = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = named.join(least.select(apart("root"), "group_id"), "root").select(
        F.col("node").alias("set_id"), "root", "class_id", "group_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return signed, named


def _tagged(docs: DataFrame) -> DataFrame:
    """With the hash of the text, by which rows are told apart that share a doc_id or have none."""
    return docs.withColumn("tag", F.xxhash64("text", F.col("doc_id").isNull()))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, rows: int = 5, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """(doc_id, class_id, group_id, n_links, n_shingles) for every row of ``docs`` (doc_id, text).

    class_id: the least doc_id with the same n-gram set; group_id: the least doc_id that chains of links reach;
    n_links: how many other documents have a similarity of at least ``threshold`` to this one, copies included.
    """
    signed, named = _grouped(_tagged(pick(docs, doc_id="long", text="string")), threshold, recall, rows, block_parts)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return (
        signed.select("doc_id", "set_id", "n_shingles")
        .join(named, "set_id", "left")
        .select("doc_id", F.coalesce("class_id", own).alias("class_id"), F.coalesce("group_id", own).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles")
    )


def one_of_each_group(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """Of each group one row of ``docs``, all columns: that of the least doc_id; and every row without words.

    Of rows with the same doc_id and text, which have no order, any one stays.
    """
    short_batches(docs)
    rows = whole_rows(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    signed, named = _grouped(_tagged(rows.select("doc_id", "text")), threshold, recall, 5, block_parts)
    last = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    heads = signed.filter("n_shingles > 0").join(named.select("set_id", "root"), "set_id").groupBy("root").agg(F.min(last).alias("head"))
    none = signed.filter("n_shingles = 0").select("doc_id", "tag", F.lit(False).alias("single")).distinct()
    kept = heads.select("head.doc_id", "head.tag", F.lit(True).alias("single")).union(none).select(F.coalesce("doc_id", F.lit(0)).alias("id"), "tag", "single")
    found = _tagged(rows).drop("text").withColumn("id", F.coalesce("doc_id", F.lit(0))).drop("doc_id").join(kept, ["id", "tag"])
    # the join has brought equal rows together; of those with words the first stays
    w = Window.partitionBy("id", "tag").orderBy("id")
    return found.withColumn("k", F.row_number().over(w)).filter("not single or k = 1").select("row.*")
