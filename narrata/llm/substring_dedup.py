"""Removal of repeated 50-byte strings, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes where a 50-byte string that covers it also starts in a document of a smaller doc_id.

1. A task cuts its texts into segments: maximal runs of 50-byte windows with the same minimizer (of the 8-byte strings in
   a window the first in a fixed order: by hash, but common ones last). Equal windows have equal minimizers, so with
   segments dealt to buckets by minimizer every repeat lies within one bucket. A segment that the task has met in a document of a smaller id is settled at
   once; of what is left each segment goes to its bucket, packed and compressed with the others of its slice.
2. A bucket collapses equal segments to the least doc_id, keeps the runs of windows whose hash occurs in two or more
   distinct segments of different documents, and builds the Burrows-Wheeler transform of these runs. From the empty
   string's interval, breadth-first backward extension (each interval by every preceding byte at once) sets the
   longest-common-prefix values in ascending order and stops at 50: entries still unset have common prefixes of 50 or
   more. Each run of unset entries is a repeated string; its least doc_id decides which of its starts go.
3. Starts are merged to spans for each document, and the texts are cut.

Buckets hold a fixed number of windows on average, so their number grows with the input. By hash alone a common 8-byte
string with a small hash would be the minimizer of a fixed share of all windows, and its bucket would grow with the input.
So strings that a hash sample of the documents shows to be common come last: the sample (a thousandth and 8 MB of text)
and the list (``COMMON`` strings, 8 bytes each) only shape the buckets, the result doesn't depend on them. Repeated
passages reach their bucket about once from each task, as pre-aggregation keeps what a task has found to repeat.

Defined results: a null text is the empty text; rows of equal doc_id don't affect one another; a null doc_id counts as
greater than all others; texts under 50 bytes stay whole; a text of any length is cut in one piece, with memory of some
tens of bytes for each of its bytes; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pick, slices

LENGTH = 50
GRAM = 8
SLICE = 4 << 20  # bytes of text that a task cuts at a time
BUCKET = 2_000_000  # windows in a bucket, on average
COMMON = 1_000_000  # 8-byte strings that can be put last
LAST = (1 << 63) - 1
_M = np.uint64(0x9E3779B97F4A7C15)
_X = np.uint64(0xD6E8FEB86659FD93)


def words8(b: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number; ``b`` ends with 8 bytes to spare."""
    a = b.astype(np.uint64)
    a = a[:-1] | (a[1:] << np.uint64(8))
    a = a[:-2] | (a[2:] << np.uint64(16))
    return a[:-4] | (a[4:] << np.uint64(32))


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on, by doubling."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def hashes8(buffer: np.ndarray) -> np.ndarray:
    """A hash of the 8 bytes at each place, without its top bit."""
    v = words8(buffer)
    h = (v ^ (v >> np.uint64(31))) * _X
    h ^= h >> np.uint64(33)
    return h >> np.uint64(1)


class Common:
    """Hashes of common 8-byte strings; a table of a bit for each 20-bit ending keeps most lookups short."""

    def __init__(self, hashes: list[int]):
        self.hashes = np.sort(np.array(hashes, dtype=np.uint64))
        self.screen = np.zeros(1 << 20, dtype=bool)
        self.screen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def last(self, h: np.ndarray) -> np.ndarray:
        """The hashes with their top bit set where they are common."""
        if not len(self.hashes):
            return h
        some = np.flatnonzero(self.screen[(h & np.uint64((1 << 20) - 1)).view(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        h[some[self.hashes[k] == h[some]]] |= np.uint64(1 << 63)
        return h


def segments(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, common: Common | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the buffer, windows, minimizer) of each segment; ``buffer`` ends with 64 bytes to spare."""
    h = hashes8(buffer)
    m = least_in_window(common.last(h) if common else h, LENGTH - GRAM + 1)
    long = np.flatnonzero(lengths >= LENGTH)
    n_windows = lengths[long] - LENGTH + 1
    first = np.cumsum(n_windows) - n_windows
    place = np.arange(n_windows.sum(), dtype=np.int64) + np.repeat(starts[long] - first, n_windows)
    values = m[place]
    new = np.empty(len(values), dtype=bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    return np.repeat(long, n_windows)[at], place[at], np.diff(np.append(at, len(values))), values[at]


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a.tobytes()) for a in arrays], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(types), []
    for size, t in zip(np.frombuffer(raw, dtype="<i8", count=len(types)).tolist(), types, strict=True):
        out.append(np.frombuffer(raw, dtype=t, count=size // np.dtype(t).itemsize, offset=at))
        at += size
    return out


# doc_ids (as steps) and tags of the documents; of segments: document (as steps), start, windows; their bytes; settled
# runs: document, start, windows. A tag is 32 bits of the text's hash and tells rows of one doc_id apart.
_BLOB = ("<i8", "<u4", "<u4", "<i4", "<i4", "u1", "<i4", "<i4", "<i4")


def _cutter(buckets: int, common: Common):
    def cut(rows: list[tuple], hot: dict[bytes, int]) -> Iterator[tuple[int, bytes]]:
        rows.sort(key=lambda r: r[1])
        data = [r[2] for r in rows]
        lengths = np.array([len(d) for d in data], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        joined = b"".join(data)
        doc, place, windows, m = segments(np.frombuffer(joined + bytes(64), dtype=np.uint8), starts, lengths, common)
        if not len(doc):
            return
        ids = [r[1] for r in rows]
        seen: dict[bytes, int] = {}
        settled, keep = [], []
        for i, (d, p, n) in enumerate(zip(doc.tolist(), place.tolist(), (windows + LENGTH - 1).tolist(), strict=True)):
            s, me = joined[p : p + n], ids[d]
            other = seen.get(s)
            if other is None:
                seen[s] = me
                if (other := hot.get(s)) is None or other >= me:
                    keep.append(i)
                    continue
            elif other == me:
                keep.append(i)
                continue
            if len(hot) > 100_000:
                hot.clear()
            hot[s] = min(other, me)
            settled.append(i)
        keep_, settled_ = np.array(keep, dtype=np.int64), np.array(settled, dtype=np.int64)
        bucket = (mix(m[keep_]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        groups = np.split(keep_[order], cuts) if len(keep_) else []
        names = bucket[order[np.append(0, cuts)]].tolist() if len(keep_) else []
        tags, doc_ids = np.array([r[0] for r in rows], dtype="<u4"), np.array(ids, dtype="<i8")
        none = np.empty(0, dtype="<i4")
        run = runs(doc[settled_], place[settled_] - starts[doc[settled_]], windows[settled_]) if settled else (none,) * 3
        if settled and not groups:
            groups, names = [np.empty(0, dtype=np.int64)], [0]
        for b, g in zip(names, groups, strict=True):
            used, local = np.unique(np.concatenate([doc[g], run[0]]), return_inverse=True)
            local = local.astype("<i4")
            body = np.frombuffer(b"".join(joined[p : p + n] for p, n in zip(place[g].tolist(), (windows[g] + LENGTH - 1).tolist(), strict=True)), dtype=np.uint8)
            yield b, pack(np.diff(doc_ids[used], prepend=0), tags[used], np.diff(local[: len(g)], prepend=0).astype("<u4"), (place[g] - starts[doc[g]]).astype("<i4"), windows[g].astype("<i4"), body, local[len(g) :], run[1].astype("<i4"), run[2].astype("<i4"))
            run = (none,) * 3  # settled runs go along once

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows, size, hot = [], 0, {}
        names = ["bucket", "blob"]
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tag", "doc_id", "text")), strict=True):
                raw = (row[2] or "").encode("utf-8", "surrogatepass")
                if len(raw) < LENGTH:
                    continue
                rows.append((row[0], LAST if row[1] is None else row[1], raw))
                size += len(raw)
                if size >= SLICE:
                    if out := list(cut(rows, hot)):
                        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=names)
                    rows, size = [], 0
        if rows and (out := list(cut(rows, hot))):
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=names)

    return run_all


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge runs of windows that touch, for (doc, start) in any order."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(start + n, at) if len(at) else start[:0]
    return doc[at], start[at], end - start[at]


# -- the transform ----------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; ``text`` holds bytes + 1, and below them a number of its own for each end of a string."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


def long_prefixes(text: np.ndarray, ends: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, unset): where ``unset``, a suffix has at least ``least`` symbols in common with the one before.

    ``text``: strings one after the other, each followed by an end symbol; ends are 0 .. ends - 1 and bytes come above.
    """
    n = len(text)
    sa = suffix_array(text)
    last = text[sa - 1]  # the transform; the first place is preceded by the last end
    order = np.argsort(last, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[order] = np.arange(n)  # of each place: where the suffix that starts one symbol earlier lies
    unset = np.ones(n, dtype=bool)
    unset[0] = False
    unset[: ends + 1] = False  # ends differ from one another and from all bytes
    is_byte = last >= ends
    lo, hi = np.array([0]), np.array([n])
    for length in range(least):  # intervals of the strings w of this length; they give those of cw
        size = hi - lo
        inside = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(lo)), size)
        good = is_byte[inside]
        inside, owner = inside[good], owner[good]
        key = owner * 65536 + (last[inside] - ends)
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
        new_lo = step[inside[by[first]]]
        new_hi = new_lo + np.diff(np.append(first, len(key)))
        new = (new_hi < n) & unset[np.minimum(new_hi, n - 1)]
        unset[new_hi[new]] = False
        # intervals that end at the last suffix have no boundary to set but can still give some
        new |= new_hi == n
        lo, hi = new_lo[new], new_hi[new]
        if not length:  # the end symbols are strings of length one as well
            lo, hi = np.concatenate([np.arange(ends), lo]), np.concatenate([np.arange(1, ends + 1), hi])
        if not len(lo):
            break
    return sa, unset


def repeated_starts(data: list[bytes], docs: list[int], least: int = LENGTH) -> list[np.ndarray]:
    """For each string the places of which the next ``least`` bytes also occur in a string of a smaller document."""
    ends = len(data)
    lengths = np.array([len(d) for d in data], dtype=np.int64)
    text = np.frombuffer(b"\0".join(data) + b"\0", dtype=np.uint8).astype(np.int64) + ends
    stops = np.cumsum(lengths + 1) - 1
    text[stops] = np.arange(ends)
    sa, unset = long_prefixes(text, ends, least)
    group = np.cumsum(~unset) - 1
    sizes = np.bincount(group)
    which = np.searchsorted(stops, sa)
    doc = np.array(docs, dtype=np.int64)[which]
    firsts = np.flatnonzero(~unset)
    lowest = np.minimum.reduceat(doc, firsts)
    bad = (sizes[group] > 1) & (doc > lowest[group])
    starts = stops - lengths
    where = np.sort(sa[bad])
    owner = np.searchsorted(stops, where)
    return np.split(where - starts[owner], np.searchsorted(owner, np.arange(1, ends)))


FOUND = "id long, tag long, start int, n int"


def _bucket(table):
    tags, ids, doc, start, windows, data, settled = [], [], [], [], [], [], []
    base = 0
    for blob in table.column("blob").to_pylist():
        i, k, d, s, w, b, sd, ss, sn = unpack(blob, *_BLOB)
        tags.append(k)
        ids.append(np.cumsum(i))
        doc.append(np.cumsum(d.view("<i4")) + base)
        start.append(s)
        windows.append(w)
        data.append(b)
        settled.append((sd + base, ss, sn))
        base += len(k)
    tag, doc_id = np.concatenate(tags).astype(np.int64), np.concatenate(ids)
    doc, start, windows = (np.concatenate(x).astype(np.int64) for x in (doc, start, windows))
    out = [tuple(np.concatenate(x).astype(np.int64) for x in zip(*settled, strict=True))]
    if len(doc):
        raw = np.concatenate(data).tobytes()
        size = windows + LENGTH - 1
        place = np.cumsum(size) - size
        # equal segments collapse to the least doc_id
        me = doc_id[doc]
        least: dict[bytes, int] = {}
        number = np.empty(len(doc), dtype=np.int64)
        texts: list[bytes] = []
        for i, (p, n) in enumerate(zip(place.tolist(), size.tolist(), strict=True)):
            s = raw[p : p + n]
            j = least.get(s)
            if j is None:
                j = least[s] = len(texts)
                texts.append(s)
            number[i] = j
        lowest = np.full(len(texts), LAST, dtype=np.int64)
        np.minimum.at(lowest, number, me)
        whole = me > lowest[number]
        out.append((doc[whole], start[whole], windows[whole]))
        rest = np.flatnonzero(~whole)
        marks = partial(texts, lowest)
        if marks:
            r = rest[np.isin(number[rest], np.fromiter(marks, dtype=np.int64, count=len(marks)))]
            for i in r.tolist():
                at = marks[int(number[i])]
                out.append((np.full(len(at), doc[i]), start[i] + at, np.ones(len(at), dtype=np.int64)))
    d, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
    d, s, n = runs(d, s, n)
    return pa.table({"id": pa.array(doc_id[d], pa.int64()), "tag": pa.array(tag[d], pa.int64()), "start": pa.array(s, pa.int32()), "n": pa.array(n, pa.int32())})


def partial(texts: list[bytes], docs: np.ndarray) -> dict[int, np.ndarray]:
    """Of distinct segments: the places whose windows also occur in a segment of a smaller document."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    joined = b"".join(texts)
    v = words8(np.frombuffer(joined + bytes(64), dtype=np.uint8))
    stop = len(joined) - LENGTH + 1
    h = v[:stop].copy()
    for o in (8, 16, 24, 32, 40, 42):
        h *= _M
        h ^= h >> np.uint64(32)
        h ^= v[o : o + stop]
    h *= _X
    windows = size - LENGTH + 1
    first = np.cumsum(windows) - windows
    place = np.arange(windows.sum(), dtype=np.int64) + np.repeat(np.cumsum(size) - size - first, windows)
    h = h[place]
    # values that occur twice or more
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return {}
    screen = np.zeros(1 << 20, dtype=bool)
    screen[(twice >> np.uint64(44)).astype(np.int64)] = True
    some = np.flatnonzero(screen[(h >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(twice, h[some]), len(twice) - 1)
    good = twice[k] == h[some]
    some, k = some[good], k[good]
    owner = np.searchsorted(first, some, side="right") - 1
    low, high = np.full(len(twice), LAST, dtype=np.int64), np.full(len(twice), -LAST, dtype=np.int64)
    np.minimum.at(low, k, docs[owner])
    np.maximum.at(high, k, docs[owner])
    shared = (low < high)[k]
    some, owner = some[shared], owner[shared]
    if not len(some):
        return {}
    # runs of such windows make the text of the transform
    seg, at, n = runs(owner, some - first[owner], np.ones(len(some), dtype=np.int64))
    pieces = [texts[i][a : a + c + LENGTH - 1] for i, a, c in zip(seg.tolist(), at.tolist(), n.tolist(), strict=True)]
    found = repeated_starts(pieces, docs[seg].tolist())
    out: dict[int, list] = {}
    for i, a, f in zip(seg.tolist(), at.tolist(), found, strict=True):
        if len(f):
            out.setdefault(i, []).append(a + f)
    return {i: np.concatenate(f) for i, f in out.items()}


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            packed = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), part.column("tag"), pa.array(packed, pa.binary())], names=["doc_id", "id", "tag", "packed"])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out = []
            for doc_id, packed, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "packed", "found")), strict=True):
                raw = z.decompress(packed)
                spans: list[list[int]] = []
                for x in sorted((f["start"], f["n"]) for f in found or []):
                    a, b = x[0], x[0] + x[1] + LENGTH - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                kept, last = [], 0
                for a, b in spans:
                    kept.append(raw[last:a])
                    last = b
                left = b"".join([*kept, raw[last:]])
                out.append((doc_id, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of the 8-byte strings that a slice of texts holds twice or more."""
    forget()
    for batch in batches:
        for part in slices(batch, 4000, SLICE):
            joined = b"\0".join((t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist())
            h, n = np.unique(hashes8(np.frombuffer(joined + bytes(8), dtype=np.uint8)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["hash", "n"])


def common_strings(docs: DataFrame, total: int, bucket_windows: int, sample: int | None = None) -> Common:
    """Of a sample the 8-byte strings that may be the minimizer of more windows than half a bucket holds; ``COMMON`` at most."""
    if total <= bucket_windows:
        return Common([])
    sample = sample or (8 << 20) + total // 1000
    share = min(1.0, sample / total)
    least = max(4, int(min(sample, total) * bucket_windows / total / (2 * (LENGTH - GRAM + 1))))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("text")
    counts = some.mapInArrow(_counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    got = counts.orderBy(F.desc("n"), "hash").limit(COMMON).select("hash").toArrow()  # 8 MB at most
    return Common(got.column("hash").to_pylist())


def removed_spans(docs: DataFrame, bucket_windows: int = BUCKET) -> DataFrame:
    """(id, tag, start, n): runs of window starts that go; ``docs`` has doc_id, tag and text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_windows))
    packed = docs.mapInArrow(_cutter(buckets, common_strings(docs, total, bucket_windows)), "bucket int, blob binary")
    return packed.groupBy("bucket").applyInArrow(_bucket, FOUND)


def dedup(docs: DataFrame, bucket_windows: int = BUCKET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs`` (doc_id, text)."""
    rows = pick(docs, doc_id="long", text="string").withColumn("id", F.coalesce("doc_id", F.lit(LAST).cast("long")))
    # tags take a tenth of what is shuffled, so they are given only where a doc_id occurs twice
    twice = rows.groupBy("id").count().filter("count > 1").limit(1).count()
    rows = rows.withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)) if twice else F.lit(0).cast("long"))
    found = removed_spans(rows, bucket_windows).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    packed = rows.mapInArrow(_squeezed, "doc_id long, id long, tag long, packed binary")  # texts are shuffled in compressed form
    return packed.join(found, ["id", "tag"], "left").select("doc_id", "packed", "found").mapInArrow(
        _cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
