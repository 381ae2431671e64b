"""Content-addressed store of token ids.

Every document's id stream is cut into chunks where a rolling hash of its last 16 ids has a fixed bit pattern, so an
edit changes only the chunks around it. A chunk's address is the SHA-256 of its bytes; each distinct chunk is stored
once. A recipe lists a document's chunks in order, and its Merkle root; recipes lie in ascending doc_id order, and a
manifest holds the Merkle tree over the recipes, about 1024 children a node. Reading computes the tree again.

Files under the store's path (Parquet containers, binary payloads):

* ``objects/kind=chunk``: chunk_id binary(32), n_ids int, payload binary (little-endian unsigned 16-bit ids where the
  vocabulary has at most 65,536 entries, else 32-bit);
* ``recipes``: pid int, doc_id long, start long, n_tokens long, chunk_ids array<binary>, root binary(32);
* ``manifest``: level int, span long, node long, digest string; the highest level has one node.

Defined results: a null text is the empty text (one end id, one chunk); repeated rows are documents of their own;
rows of equal or null doc_id are ordered by their roots, nulls first; extra columns are not read; texts are encoded
whole, in slices of about 1.5 MB, a longer one by itself. An empty table gives a store without chunks and recipes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, drop_folder, forget, new_folder, partitions_for, pick, slices

ROLL = 16
FANOUT = 1024

# -- chunking ---------------------------------------------------------------------------------------------------


@lru_cache(2)
def gear(size: int) -> np.ndarray:
    """A pseudo-random 64-bit word for each id (splitmix64)."""
    z = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def rolling(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """At each place the hash of the last 16 ids: the sum of their gear words, shifted by their age."""
    h = gear(vocabulary)[ids]
    for width in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint64(width))
    return h


MEAN, LEAST, MOST = 512, 128, 4096


def marks(ids: np.ndarray, vocabulary: int, mean: int = MEAN) -> np.ndarray:
    """Places after ids whose rolling hash has zeros in its top bits.

    Several documents can be marked at once: chunks have more ids than the hash sees, so no place that counts depends
    on the document before.
    """
    return np.flatnonzero(rolling(ids, vocabulary) >> np.uint64(64 - (mean.bit_length() - 1)) == 0) + 1


def cuts(n: int, wanted: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of a stream's chunks: marks, with ``least`` to ``most`` ids a chunk (the last may be shorter)."""
    if n <= least:
        return [n]
    ends, at = [], 0
    for c in wanted:
        if c - at < least:
            continue
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least or c == n:
            ends.append(c)
            at = c
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd last node moves up."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# -- crc32 of a concatenation -----------------------------------------------------------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    p = 0
    while a:
        if a & 0x80000000:
            p ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
    return p


@lru_cache(20_000)
def _shift(n_bytes: int) -> int:
    """x to the power 8 n_bytes."""
    out, base, n = 0x80000000, 0x00800000, n_bytes
    while n:
        if n & 1:
            out = _times(base, out)
        base = _times(base, base)
        n >>= 1
    return out


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """crc32(a + b) from crc32(a), crc32(b) and the length of b."""
    return _times(_shift(second_bytes), first) ^ second


# -- encoding ---------------------------------------------------------------------------------------------------

_STATE: dict = {}


#: How byte-level tokenizers write bytes: printable Latin-1 as it is, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


MARKS = ".,;:!?#*$%&"


class Known(Memo):
    """Ids of words; a new word stands for itself."""

    def __missing__(self, word: str) -> str:
        return word


class Encoder:
    """Ids of texts. Pieces between blanks and line ends are encoded once and remembered.

    That is exact for byte-level BPE tokenizers that lower-case, drop white space and keep letters apart from
    marks (``by_word``), as word_bpe_49k does; others get whole texts. A new word of Latin letters is one piece to the
    tokenizer whatever surrounds it, so it goes to the BPE model directly; other pieces take the tokenizer's whole way.
    """

    LIMIT = 600_000

    def __init__(self, path: str, by_word: bool, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word, self.dtype = Tokenizer.from_file(path), by_word, np.dtype(dtype)
        self.memo: dict[str, bytes] = Known()
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1 if by_word else 0
        self.of_id = [np.array([i], dtype=self.dtype).tobytes() for i in range(size)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        memo, plain, ended, other = self.memo, [], [], []
        for p in pieces:
            if p.isalpha():
                plain.append(p)
            elif (base := p.rstrip(MARKS)) != p and base.isalpha() and max(base) <= "\xff":
                ended.append((p, base, p[len(base) :]))
            else:
                other.append(p)
        if ended:  # marks behind Latin letters, which no lower-casing turns into marks, are a piece of their own to the tokenizer
            plain += {b for _, b, _ in ended if b not in memo}.difference(plain)
            marks_ = [m for m in {m for _, _, m in ended} if m not in memo]
            if marks_:
                memo.update(zip(marks_, self.whole(marks_), strict=True))
        of, tokenize = self.of_id, self.tokenizer.model.tokenize
        for w in plain:
            if w.isascii():
                memo[w] = b"".join([of[x.id] for x in tokenize(w.lower())])
            elif max(w) <= "\xff":
                memo[w] = b"".join([of[x.id] for x in tokenize(w.lower().encode().decode("latin-1").translate(BYTE_LETTERS))])
            else:
                other.append(w)
        if other:
            memo.update(zip(other, self.whole(other), strict=True))
        for p, base, m in ended:
            memo[p] = memo[base] + memo[m]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        if len(self.memo) > self.LIMIT:
            self.memo.clear()
        pieces: list[list[str]] = []
        for t in texts:
            if "<|" in t:  # may spell a special token
                pieces.append([])
                continue
            try:  # for Latin letters the order of lower-casing and splitting is of no account
                t.encode("latin-1")
                t = t.lower()
            except UnicodeEncodeError:
                pass
            pieces.append(t.replace("\n", " ").split(" "))
        get = self.memo.__getitem__
        found = [list(map(get, p)) for p in pieces]  # ids, or the word itself where it is new
        places = [[i for i, x in enumerate(f) if x.__class__ is str] for f in found]
        if new := {f[i] for f, at in zip(found, places, strict=True) for i in at}:
            self.learn(list(new))
        out = []
        for f, at, t in zip(found, places, texts, strict=True):
            for i in at:
                f[i] = get(f[i])
            out.append(b"".join(f) if f else self.whole([t])[0])
        return out


def encoder(path: str, by_word: bool, dtype: str) -> Encoder:
    key = (path, by_word, dtype)
    if key not in _STATE:
        _STATE[key] = Encoder(path, by_word, dtype)
    return _STATE[key]


STAGE_SCHEMA = "kind string, key long, doc_id long, n_tokens long, chunk_ids array<binary>, root binary, chunk_id binary, n_ids int, payload binary"
_ARROW = pa.schema([
    ("kind", pa.string()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunk_ids", pa.list_(pa.binary())),
    ("root", pa.binary()), ("chunk_id", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary()),
])


def _cutter(path: str, end_id: int, vocabulary: int, by_word: bool):
    dtype = "<u2" if vocabulary <= 65_536 else "<u4"
    width = int(dtype[2])
    end = np.array([end_id], dtype=dtype).tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path, by_word, dtype), set()
        enc.memo.claim()
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                streams = enc.ids([t or "" for t in part.column("text").to_pylist()])
                streams = [raw + end for raw in streams]
                sizes = [len(raw) // width for raw in streams]
                stops = np.cumsum(sizes)
                wanted = marks(np.frombuffer(b"".join(streams), dtype=dtype), vocabulary)
                split = np.searchsorted(wanted, stops, side="right").tolist()
                starts = (stops - sizes).tolist()
                for k, (doc_id, raw) in enumerate(zip(part.column("doc_id").to_pylist(), streams, strict=True)):
                    own = (wanted[split[k - 1] if k else 0 : split[k]] - starts[k]).tolist()
                    last, addresses = 0, []
                    for c in cuts(sizes[k], own):
                        payload = raw[last * width : c * width]
                        address = hashlib.sha256(payload).digest()
                        addresses.append(address)
                        if address not in seen:  # saves shuffling; the exact test follows the shuffle
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(address)
                            out.append(("chunk", int.from_bytes(address[:8], "little", signed=True), None, None, None, None, address, c - last, payload))
                        last = c
                    root = merkle(addresses)
                    out.append(("doc", (int.from_bytes(root[:7], "little") + (doc_id or 0)) & 0x7FFFFFFFFFFFFFFF, doc_id, sizes[k], addresses, root, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return rows


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal chunks, which the shuffle brought to one partition, the first."""
    forget()
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, a in enumerate(batch.column("chunk_id").to_pylist()):
            if a is None or a not in seen:
                keep.append(i)
                if a is not None:
                    seen.add(a)
        yield batch.take(pa.array(keep, type=pa.int64())) if len(keep) < batch.num_rows else batch


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, by_word: bool = False) -> None:
    """Encode, cut and store ``docs`` (doc_id, text); see the module's text for the files."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id="long", text="string")
    n = partitions_for(rows)  # what a task remembers of a partition is bounded by its size
    rows = rows.mapInArrow(_cutter(tokenizer, end_id, vocabulary, by_word), STAGE_SCHEMA)
    rows.repartition(n, "key").mapInArrow(_once, STAGE_SCHEMA).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    made = spark.read.schema(STAGE_SCHEMA).parquet(f"{path}/objects").filter("kind = 'doc'")
    ordered = (
        made.select("doc_id", "n_tokens", "chunk_ids", "root")
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "root")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
        .withColumn("pid", F.spark_partition_id())
    )
    ordered.write.parquet(f"{path}/_ordered")
    ordered = spark.read.schema(ordered.schema).parquet(f"{path}/_ordered")
    before, count, offsets = 0, 0, []
    for pid, tokens, n_docs in ordered.groupBy("pid").agg(F.sum("n_tokens"), F.count("*")).orderBy("pid").collect():  # a row for each partition
        offsets.append((pid, before))
        before, count = before + tokens, count + n_docs
    first = spark.createDataFrame(offsets or [(0, 0)], "pid int, first long")
    w = Window.partitionBy("pid").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    (
        ordered.join(F.broadcast(first), "pid")
        .withColumn("start", F.col("first") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
        .select("pid", "doc_id", "start", "n_tokens", "chunk_ids", "root")
        .write.option("compression", "zstd").parquet(f"{path}/recipes")
    )
    _manifest(spark, path, max(1, before * FANOUT // max(1, count)))
    drop_folder(spark, f"{path}/_ordered")
    drop_folder(spark, f"{path}/objects/kind=doc")


def _nodes(children: DataFrame, span: int) -> DataFrame:
    """(node, digest) over ``children`` (at, digest): a node for each span of ``at``, in the order of ``at``."""
    joined = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]))
    return children.groupBy(F.floor(F.col("at") / span).cast("long").alias("node")).agg(F.sha2(joined, 256).alias("digest"))


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    """What a recipe's leaf says: its document, place, length and root."""
    recipes = spark.read.schema("doc_id long, start long, n_tokens long, root binary").parquet(f"{path}/recipes")
    said = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "start", "n_tokens", F.hex("root"))
    return recipes.select(F.col("start").alias("at"), F.sha2(said, 256).alias("digest"))


MANIFEST = "level int, span long, node long, digest string"


def _manifest(spark: SparkSession, path: str, span: int) -> None:
    """Merkle tree over the recipes in their order, level by level up to one root.

    The children of a lowest node are the recipes that start within the same ``span`` of ids (about 1024 documents);
    above, a node has 1024 children.
    """
    level, rows, n = 0, _leaves(spark, path), 2
    while n > 1:
        _nodes(rows, span).select(F.lit(level).alias("level"), F.lit(span).cast("long").alias("span"), "node", "digest").write.mode("append").parquet(f"{path}/manifest")
        done = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").filter(F.col("level") == level)
        rows, span, level, n = done.select(F.col("node").alias("at"), "digest"), FANOUT, level + 1, done.count()


def verify_manifest(spark: SparkSession, path: str) -> str:
    """Compute the tree again from the recipes and hold it against the manifest; its root, or an error."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    levels = manifest.groupBy("level").agg(F.min("span").alias("span"), F.count("*").alias("n"), F.max("digest").alias("digest")).orderBy("level").collect()  # a few levels
    rows, root = _leaves(spark, path), ""
    for level, span, _, root in levels:
        stored = manifest.filter(F.col("level") == level).select("node", F.col("digest").alias("stored"))
        made = _nodes(rows, span)
        if (bad := made.join(stored, "node", "full").filter("not (digest <=> stored)").limit(1).collect()):
            raise ValueError(f"the recipes under node {bad[0]['node']} of level {level} don't match the manifest")
        rows = stored.select(F.col("node").alias("at"), F.col("stored").alias("digest"))
    if levels and levels[-1]["n"] != 1 or not levels and _leaves(spark, path).limit(1).count():
        raise ValueError("the manifest has no single root")
    return root


CHECKED = "chunk_id binary, n_ids int, crc long"


def _verify(wide: bool):
    dtype = "<u4" if wide else "<u2"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, n, crc = [], [], []
            for a, payload in zip(batch.column("chunk_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if hashlib.sha256(payload).digest() != a:
                    raise ValueError(f"chunk {a.hex()} doesn't match its address")
                x = np.frombuffer(payload, dtype=dtype)
                ids.append(a)
                n.append(len(x))
                crc.append(zlib.crc32(x.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], names=["chunk_id", "n_ids", "crc"])

    return rows


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("parts")
        flat, stops = lists.flatten(), lists.offsets.to_pylist()
        seq, ids, n_ids, crc = (flat.field(i).to_pylist() for i in range(4))
        roots, crcs, counts = batch.column("root").to_pylist(), [], []
        for root, lo, hi in zip(roots, stops, stops[1:], strict=False):
            order = range(lo, hi) if hi - lo == 1 else sorted(range(lo, hi), key=seq.__getitem__)
            if merkle([ids[k] for k in order]) != root or any(crc[k] is None for k in order):
                raise ValueError(f"document {root.hex()} can't be put together from its chunks")
            c, n = crc[order[0]], n_ids[order[0]]
            for k in order[1:]:
                c = crc32_joined(c, crc[k], 4 * n_ids[k])
                n += n_ids[k]
            crcs.append(c)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())], names=["root", "ids_crc32", "n_read"])


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id binary, payload binary, kind string").parquet(f"{path}/objects").filter("kind = 'chunk'").drop("kind")


def read_digests(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """One row a document from the store's files: recipes are held against the manifest, every chunk against its
    address, every document against its root and length, and the checksum of a document's ids is put together from
    those of its chunks."""
    verify_manifest(spark, path)
    chunks = stored_chunks(spark, path)
    checked = chunks.mapInArrow(_verify(vocabulary > 65_536), CHECKED)
    recipes = spark.read.schema("doc_id long, start long, n_tokens long, chunk_ids array<binary>, root binary").parquet(f"{path}/recipes")
    distinct = recipes.select("root", "chunk_ids").dropDuplicates(["root"])  # copies share their recipe
    parts = (
        distinct.select("root", F.posexplode("chunk_ids").alias("seq", "chunk_id"))
        .join(checked, "chunk_id", "left")
        .groupBy("root")
        .agg(F.collect_list(F.struct("seq", "chunk_id", "n_ids", "crc")).alias("parts"))
        .mapInArrow(_joined, "root binary, ids_crc32 long, n_read long")
    )
    whole = F.when(F.col("n_read") == F.col("n_tokens"), F.col("n_read")).otherwise(F.raise_error(F.lit("a document's length isn't its recipe's")).cast("long"))
    return recipes.join(parts, "root").select(
        "doc_id", "start", "n_tokens", "ids_crc32", whole.alias("n_read"), F.size("chunk_ids").alias("n_chunks"), F.lower(F.hex("root")).alias("root")
    )


def read_ids(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, ids): the documents themselves, put together from their chunks."""
    dtype = "<u4" if vocabulary > 65_536 else "<u2"
    chunks = stored_chunks(spark, path)
    recipes = spark.read.schema("doc_id long, start long, chunk_ids array<binary>, root binary").parquet(f"{path}/recipes")
    parts = (
        recipes.select("root", "chunk_ids").dropDuplicates(["root"])
        .select("root", F.posexplode("chunk_ids").alias("seq", "chunk_id"))
        .join(chunks, "chunk_id")
        .groupBy("root").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("parts"))
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in parts), dtype=dtype).astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(ids, pa.list_(pa.int32()))], names=["root", "ids"])

    return recipes.join(parts.mapInArrow(join, "root binary, ids array<int>"), "root").select("doc_id", "start", "ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def store_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, vocabulary: int = 49_408, by_word: bool = True, path: str | None = None) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and return what its files say about each document."""
    path = path or new_folder(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer or default_tokenizer(), end_id, vocabulary, by_word)
    return read_digests(docs.sparkSession, path, vocabulary)
