"""Benchmark decontamination: n-gram seeds find candidates, Smith-Waterman alignment scores them.

1. Every n-gram of a test item is a seed, however often the corpus repeats it and however few of them an edited copy
   keeps: one hit makes a document and an item a candidate.
2. An alignment of M matches in r unbroken runs scores at most 2M - (r - 1), which is M + B + 1 for its B = M - r
   adjacent pairs of matches. Candidates go where the item's words and word pairs that occur in the document, then in
   the passage around the hits, are too few for the threshold, so hits of frequent n-grams cost little.
3. The others are aligned with the passage. The score is the local alignment's (match 2, mismatch -1, gap -1) over that
   of a perfect copy, so edits lower it gradually. The passage is as wide as an alignment over the threshold can be.

What is found are the alignments over the threshold that hold n matching words in a row; a copy edited so densely that
no n words in a row are left has no seed and is not found.

The test set is the query set: it is dealt into blocks of a bounded number of words and each block meets all
documents, so what tasks hold doesn't grow with either table. Documents are never shuffled.

Words are lower-case with everything but letters and digits removed. Defined results: null or empty documents and
items match nothing; items under ``n`` words are one n-gram; repeated rows give repeated results; equal items are
reported each under its own item_id; rows are judged one by one, so null or shared doc_ids change nothing; a text of any
length is read whole, with memory in proportion to the longest; of equal scores in a document the first passage counts;
extra columns are carried by ``clean_documents`` and not read; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, pick, short_batches, slices

_PUNCTUATION = re.compile(r"[\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def _word(w: str) -> int:
    w = _PUNCTUATION.sub("", w)
    return xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 if w else 0


_WORDS = Memo(_word)


def words(text: str | None) -> np.ndarray:
    w = (text or "").lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, w), dtype=np.uint64, count=len(w))
    return h[h != 0]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _M + h[k : len(h) - n + 1 + k]
    return out ^ (out >> np.uint64(29))


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of many ranges, one range after another."""
    n = last - first
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def present(known: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which of the sorted values are among ``seen``; one more, for no value, is false."""
    out = np.zeros(len(known) + 1, dtype=bool)
    if len(known) and len(seen):
        k = np.minimum(np.searchsorted(known, seen), len(known) - 1)
        out[k[known[k] == seen]] = True
    return out


class Items:
    """A block of test items and where their n-grams lie."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids = [i for i, _ in rows]
        self.words = [words(t) for _, t in rows]
        self.widths = sorted({min(n, len(w)) for w in self.words if len(w)})
        gram, item, offset = [], [], []
        for k, w in enumerate(self.words):
            if len(w):
                g = grams(w, min(n, len(w)))
                gram.append(g)
                item.append(np.full(len(g), k))
                offset.append(np.arange(len(g)))
        g = np.concatenate(gram) if gram else np.empty(0, dtype=np.uint64)
        order = np.argsort(g, kind="stable")
        self.item = np.concatenate(item)[order] if gram else np.empty(0, dtype=np.int64)
        self.offset = np.concatenate(offset)[order] if gram else np.empty(0, dtype=np.int64)
        self.gram, self.first = np.unique(g[order], return_index=True)
        self.last = np.append(self.first, len(g))[1:]
        self.screen = np.zeros(1 << 18, dtype=bool)
        self.screen[(self.gram & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        # all items' words in a row, as numbers of distinct words and pairs; an item's last word begins no pair
        flat = np.concatenate([*self.words, np.empty(0, dtype=np.uint64)])
        self.end = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        self.begin = self.end - [len(w) for w in self.words]
        self.word, self.word_at = np.unique(flat, return_inverse=True)
        self.pair, self.pair_at = np.unique(grams(flat, 2), return_inverse=True)
        self.pair_at = np.append(self.pair_at, 0)
        self.pair_at[self.end[self.end > 0] - 1] = len(self.pair)

    def most(self, h: np.ndarray, items: np.ndarray) -> np.ndarray:
        """What an alignment of each of these items (none empty) with the words ``h`` can score at most."""
        n = self.end[items] - self.begin[items]
        at = spans(self.begin[items], self.end[items])
        matches = present(self.word, h)[self.word_at[at]].astype(np.int64) + present(self.pair, grams(h, 2))[self.pair_at[at]]
        return np.add.reduceat(matches, np.cumsum(n) - n) + 1

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document and the numbers of the n-grams that lie there."""
        at, which = [], []
        for n in self.widths:
            g = grams(h, n)
            places = np.flatnonzero(self.screen[(g & np.uint64((1 << 18) - 1)).astype(np.int64)])
            if len(places):
                k = np.minimum(np.searchsorted(self.gram, g[places]), len(self.gram) - 1)
                good = self.gram[k] == g[places]
                at.append(places[good])
                which.append(k[good])
        if not at:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(at), np.concatenate(which)


def align(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Smith-Waterman: the best local score, and the end of the alignment in the passage (exclusive)."""
    j = np.arange(len(passage) + 1) * -gap
    row, best, end = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == w, match, mismatch), row[1:] + gap)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + j) - j, 0)
        if (top := int(new.max())) > best:
            best, end = top, int(new.argmax())
        row = new
    return best, end


class Aligner:
    """Scores of a block's items against documents; the alignments of the last passages are kept."""

    def __init__(self, items: Items, threshold: float):
        self.items, self.threshold, self.memo = items, threshold, {}

    def best_passage(self, k: int, h: np.ndarray, places: np.ndarray) -> tuple[float, int, int]:
        """Best normalised score of item ``k`` in the document, and its place."""
        w, found, threshold = self.items.words[k], (0.0, 0, 0), self.threshold
        m = len(w)
        gaps = int(2 * m * (1 - threshold)) + 1  # more gaps than these leave less than the threshold
        starts = np.sort(places)
        groups = np.split(starts, np.flatnonzero(np.diff(starts) > gaps) + 1)
        for g in groups:
            lo, hi = max(0, int(g[0]) - gaps), min(len(h), int(g[-1]) + m + gaps)
            passage = h[lo:hi]
            if self.items.most(passage, np.array([k]))[0] < 2 * threshold * m:
                continue
            key = (k, passage.tobytes())
            if key not in self.memo:
                if len(self.memo) > 2000:
                    self.memo.clear()
                score, end = align(w, passage)
                # the same from behind gives the start
                start = end - align(w[::-1], passage[:end][::-1])[1] if score >= 2 * threshold * m else end
                self.memo[key] = (score / (2 * m), start, end)
            score, start, end = self.memo[key]
            if score > found[0]:
                found = (score, lo + start, lo + end)
        return found

    def found(self, text: str | None) -> Iterator[tuple[int, float, int, int]]:
        """(item, score, start, end) of the items that a document holds."""
        items, h = self.items, words(text)
        at, which = items.hits(h)
        if not len(at):
            return
        rows = spans(items.first[which], items.last[which])
        item, start = items.item[rows], np.repeat(at, items.last[which] - items.first[which]) - items.offset[rows]
        order = np.argsort(item, kind="stable")
        item, start = item[order], start[order]
        cut = np.flatnonzero(np.diff(item)) + 1
        candidates = item[np.append(0, cut)]
        enough = items.most(h, candidates) >= 2 * self.threshold * (items.end - items.begin)[candidates]
        for k, s, good in zip(candidates.tolist(), np.split(start, cut), enough.tolist(), strict=True):
            if good:
                score, a, b = self.best_passage(k, h, s)
                if score >= self.threshold:
                    yield k, float(score), a, b


def _reporter(items: Items, threshold: float):
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _WORDS.claim()
        aligner = Aligner(items, threshold)
        for batch in batches:
            for part in slices(batch):
                out = [
                    (doc_id, items.ids[k], *rest)
                    for doc_id, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                    for k, *rest in aligner.found(t)
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return run


def _cleaner(items: Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _WORDS.claim()
        aligner = Aligner(items, threshold)
        for batch in batches:
            for part in slices(batch):
                clean = [next(aligner.found(t), None) is None for t in part.column("text").to_pylist()]
                yield part if all(clean) else part.filter(pa.array(clean, pa.bool_()))

    return run


FOUND = "doc_id long, item_id long, score double, start_word int, end_word int"


def blocks_of(benchmark: DataFrame, n: int, block_words: int) -> Iterator[Items]:
    """The test set in blocks of about ``block_words`` words, one after the other."""
    items = pick(benchmark, item_id="long", text="string").filter("text is not null")
    size = items.agg(F.sum(F.size(F.split("text", "\\s+"))).alias("w")).first()["w"] or 0
    blocks = max(1, math.ceil(size / block_words))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # bounded by block_words
        block = Items([tuple(r) for r in rows], n)
        if len(block.gram):
            yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, block_words: int = 500_000) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) for documents that hold an item or an edited copy of it."""
    rows = pick(docs, doc_id="long", text="string")
    found = [rows.mapInArrow(_reporter(block, threshold), FOUND) for block in blocks_of(benchmark, n, block_words)]
    return functools.reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], FOUND)


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, block_words: int = 500_000) -> DataFrame:
    """The rows of ``docs``, all columns, without benchmark items in them.

    Each row is judged by its own text, whatever its doc_id, in the pass that reads it; nothing is shuffled.
    """
    short_batches(docs)
    for block in blocks_of(benchmark, n, block_words):
        docs = docs.mapInArrow(_cleaner(block, threshold), docs.schema)
    return docs
