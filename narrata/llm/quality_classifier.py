"""Quality classifier by co-training.

Two logistic regressions see different views of a document: its text (character and word statistics, hashed words)
and its page metadata (language, source, length). Both start from labelled documents. In each round, each view labels the unlabelled documents of which it
is most confident, in the classes' proportion, for the *other* view's training set. At the end each view is calibrated on held-out labelled documents, their log-odds are combined by a small
logistic regression on the same documents, and the combination scores every document in one pass.

Labelled documents for fitting are a sample of at most ``labelled`` rows, chosen by a hash of doc_id. All unlabelled
documents take part in the exchange: their features are computed once and staged, each round counts their confident
scores by level over the whole table, and those above the level that gives ``each`` labels go over, on the level itself
by a hash. A round's labels are bounded as the method has it; what is sent to tasks is the fitted model.

Defined results: null and empty texts have zero counts and are scored like any other; null languages, sources and
lengths are values of their own; a doc_id labelled more than once counts once, with its least label; labels that are
null or have no document are left out; documents of equal features count once in the exchange, whatever their ids; ties
go by hash; a text of any length is one row of fixed features; without labels of both classes every document gets score 1 and is kept; repeated rows get equal
scores; extra columns pass through untouched; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, pick, release, short_batches, slices, staged, unstage

HASHED = 192
_BUCKET = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % HASHED)
_CLASSES = np.zeros(256, dtype=np.int64)  # of a UTF-8 byte: other, lower, upper, digit, space, line end, comma or stop, symbol
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i] = 0 if _i > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".,;:'\"-?" else 7
N_STATS = 18
_VOWELS = re.compile(r"[^\W\d_]")


def text_view(text: str | None) -> np.ndarray:
    out = np.zeros(N_STATS + HASHED, dtype=np.float32)
    t = text or ""
    raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    share = np.bincount(_CLASSES[raw], minlength=8) / max(1, len(raw))
    words = t.split()
    n = len(words)
    counts = Counter(words)
    lines = t.split("\n")
    out[:8] = share
    out[8] = np.log1p(n)
    out[9] = len(t) / max(1, n) / 10
    out[10] = len(counts) / max(1, n)
    out[11] = max(counts.values(), default=0) / max(1, n)
    out[12] = len(set(lines)) / len(lines)
    out[13] = np.log1p(len(lines)) / 5
    out[14] = sum(map(str.isupper, words)) / max(1, n)
    out[15] = sum(c for w, c in counts.items() if not _VOWELS.search(w)) / max(1, n)
    out[16] = n < 20
    out[17] = np.log1p(share[7] * len(raw)) / 5
    if n:
        h = np.fromiter(map(_BUCKET.__getitem__, counts), dtype=np.int64, count=len(counts))
        out[N_STATS:] = np.bincount(h, weights=np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), minlength=HASHED) / np.sqrt(n * max(n, 30))
    return out


META = 80


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META, dtype=np.float32)
    out[xxhash.xxh3_64_intdigest(repr(lang)) % 16] = 1
    out[16 + xxhash.xxh3_64_intdigest(repr(source)) % 40] = 1
    length = np.log1p(max(0, n_chars or 0))
    out[56 + min(15, int(length * 1.4))] = 1
    out[72] = length / 10
    out[73] = n_chars is None
    return out


def views(rows: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """rows: text, lang, source, n_chars."""
    _BUCKET.claim()
    pairs = [(text_view(t), meta_view(a, s, n)) for t, a, s, n in rows]
    return np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs])


class Logistic:
    """L2-regularised logistic regression, by full-batch Adam on standardised features; calibrated by Platt's method."""

    def __init__(self, l2: float = 1e-3, steps: int = 250):
        self.l2, self.steps, self.a, self.c = l2, steps, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean = x.mean(axis=0)
        self.scale = 1 / np.maximum(x.std(axis=0), 1e-2)
        z = (x - self.mean) * self.scale
        np.clip(z, -8, 8, out=z)
        y = y.astype(np.float32)
        w, b = np.zeros(z.shape[1], dtype=np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        g = np.zeros(z.shape[1] + 1, dtype=np.float32)
        m, v = np.zeros_like(g), np.zeros_like(g)
        for t in range(1, self.steps + 1):
            r = 1 / (1 + np.exp(-np.clip(z @ w + np.float32(b), -30, 30))) - y
            g[:-1], g[-1] = z.T @ r / len(y) + self.l2 * w, r.mean()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w, b
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8) @ self.w + self.b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        (self.a,), self.c = newton(self.raw(x)[:, None], y)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.c, -30, 30)


def newton(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 40) -> tuple[np.ndarray, float]:
    """A logistic regression on few features; targets are smoothed as Platt proposed."""
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - t) + l2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w = w - d * min(1.0, 4 / max(1e-9, np.abs(d).max()))
        if np.abs(d).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


LEVELS = 8  # levels of confidence to a unit of log-odds


def bins(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.abs(logits) * LEVELS).astype(np.int64)


def counted(logits: np.ndarray, least: float) -> Counter:
    """How many log-odds lie on each level of at least ``least``."""
    level = bins(logits)
    return Counter(level[level >= least * LEVELS].tolist())


def level_for(counts: Counter, wanted: int) -> int:
    """The highest level at or above which ``wanted`` lie, or the lowest there is."""
    total = 0
    for level in sorted(counts, reverse=True):
        total += counts[level]
        if total >= wanted:
            return level
    return min(counts, default=0)


class CoTrained:
    """The two calibrated views and their combination."""

    def __init__(self, rounds: int = 4, each: int = 400, sure: float = 0.97):
        self.rounds, self.each, self.sure = rounds, each, sure

    def fit(self, views_: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, exchange) -> CoTrained:
        """``held`` marks labelled rows for calibration; y is 0 or 1.

        ``exchange(models, wanted, taken)`` gives for each view and label (view, label, key, text, meta) of about
        ``wanted`` unlabelled documents, without those whose (view, key) is taken.
        """
        data, hold = [v[~held] for v in views_], [v[held] for v in views_]
        known, held_y = y[~held], y[held]
        extra: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # what the other view has labelled
        share = known.mean()
        self.exchanged = []
        for r in range(self.rounds + 1):
            self.models = []
            for v in (0, 1):
                rows = [extra[v][k] for k in sorted(extra[v])]
                x = np.concatenate([data[v], np.stack([f for _, f in rows])]) if rows else data[v]
                t = np.concatenate([known, [label for label, _ in rows]]) if rows else known
                self.models.append(Logistic().fit(x, t).calibrate(hold[v], held_y))
            if r == self.rounds:
                break
            wanted = {1.0: int(np.ceil(self.each * share)), 0.0: int(np.ceil(self.each * (1 - share)))}
            given = exchange(self.models, wanted, [frozenset(extra[1]), frozenset(extra[0])])
            for v, label, key, *features in given:
                extra[1 - v][key] = (label, features[1 - v])
            self.exchanged.append(len(given))
            if not given:
                break
        self.weights, self.bias = newton(np.column_stack([m.logit(h) for m, h in zip(self.models, hold, strict=True)]), held_y)
        return self

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.models[0].logit(text), self.models[1].logit(meta)
        both = self.weights[0] * a + self.weights[1] * b + self.bias
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, both))


def _columns(part: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")), strict=True)


FEATURES = "doc_id long, quality int, key long, text binary, meta binary"


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 500):
            texts, metas = ([r.tobytes() for r in v] for v in views(_columns(part)))
            keys = [xxhash.xxh3_64_intdigest(t + m) >> 1 for t, m in zip(texts, metas, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("quality"), pa.array(keys, pa.int64()), pa.array(texts, pa.binary()), pa.array(metas, pa.binary())],
                names=["doc_id", "quality", "key", "text", "meta"],
            )


def _arrays(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.float32).reshape(part.num_rows, -1) for c in ("text", "meta")]


_TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def featurized(docs: DataFrame, labels: DataFrame, labelled: int = 12_000) -> DataFrame:
    """Features of all documents, staged; quality is set for a sample of at most ``labelled`` labelled ones."""
    known = pick(labels, doc_id="long", quality="int").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # at most that many rows
    rows = pick(docs, **_TYPES).join(F.broadcast(sample), "doc_id", "left").select(*_TYPES, "quality")
    return staged(rows.mapInArrow(_featurize, FEATURES), "quality-features", compression="zstd")


def _exchange(features: DataFrame, sure: float):
    """Looks for confident documents among all unlabelled rows of ``features``."""
    rows = features.filter("quality is null").select("key", "text", "meta")
    least = float(np.log(sure / (1 - sure)))

    def exchange(models: list[Logistic], wanted: dict[float, int], taken: list[frozenset]) -> list[tuple]:
        def confident(part: pa.RecordBatch) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
            """(view, label, rows, log-odds) of the rows of which a view is sure."""
            for v, x in enumerate(_arrays(part)):
                z = models[v].logit(x)
                free = np.array([k not in taken[v] for k in part.column("key").to_pylist()], dtype=bool)
                for label, sign in ((1.0, z > 0), (0.0, z < 0)):
                    at = np.flatnonzero(sign & free & (np.abs(z) >= least))
                    yield v, label, at, z[at]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, float], Counter] = {}
            for batch in batches:
                for v, label, _, z in confident(batch) if batch.num_rows else ():
                    total.setdefault((v, label), Counter()).update(counted(z, least))
            out = [(v, label, level, n) for (v, label), c in total.items() for level, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int64()))], names=["v", "label", "level", "n"])

        got = rows.mapInArrow(count, "v int, label double, level long, n long").groupBy("v", "label", "level").agg(F.sum("n").alias("n")).collect()  # some hundred levels
        levels, part_of = {}, {}
        for v in (0, 1):
            for label, n in wanted.items():
                counts = Counter({r["level"]: r["n"] for r in got if (r["v"], r["label"]) == (v, label)})
                if n and counts:
                    levels[v, label] = level_for(counts, n)
                    above = sum(c for k, c in counts.items() if k > levels[v, label])
                    part_of[v, label] = min(1.0, 2 * (n - above + 8) / counts[levels[v, label]])  # of the level itself, by hash

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("key").to_pylist()
                for v, label, at, z in confident(batch) if batch.num_rows else ():
                    if (v, label) not in levels:
                        continue
                    level = bins(z)
                    u = np.array([xxhash.xxh3_64_intdigest(str(keys[i])) / 2**64 for i in at.tolist()])
                    keep = at[(level > levels[v, label]) | (level == levels[v, label]) & (u < part_of[v, label])] if len(at) else at
                    if len(keep):
                        some = batch.take(pa.array(keep))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v] * len(keep), pa.int32()), pa.array([label] * len(keep)), pa.array(level[np.isin(at, keep)]), some.column("key"), some.column("text"), some.column("meta")],
                            names=["v", "label", "level", "key", "text", "meta"],
                        )

        # about twice what is wanted at most; documents of equal features are one
        found = rows.mapInArrow(take, "v int, label double, level long, key long, text binary, meta binary").dropDuplicates(["v", "label", "key"]).collect()
        out = []
        for v in (0, 1):
            for label, n in wanted.items():
                own = sorted((r for r in found if (r["v"], r["label"]) == (v, label)), key=lambda r: (-r["level"], xxhash.xxh3_64_intdigest(str(r["key"]))))
                out += [(v, label, r["key"], *(np.frombuffer(r[c], dtype=np.float32) for c in ("text", "meta"))) for r in own[:n]]
        return out

    return exchange


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 12_000, held: float = 0.3, each: int = 400, features: DataFrame | None = None) -> CoTrained | None:
    """The co-trained model; None where the labels don't hold both classes. ``features``: those of ``featurized``."""
    own = featurized(docs, labels, labelled) if features is None else features
    got = own.filter("quality is not null").toArrow()  # at most ``labelled`` documents, but for rows that share an id
    got = got.take(pa.array(np.lexsort((got.column("key").to_numpy(), got.column("doc_id").to_numpy())))).combine_chunks()
    y = got.column("quality").to_numpy().astype(np.float64)
    model = None
    if len(y) and min((y == 0).sum(), (y == 1).sum()) >= 5:
        x = [np.frombuffer(b"".join(got.column(c).to_pylist()), dtype=np.float32).reshape(len(y), -1) for c in ("text", "meta")]
        hold = np.array([(i * 2_654_435_761 + 12_345) % 4_294_967_296 / 4_294_967_296 for i in got.column("doc_id").to_pylist()]) < held
        if min(np.bincount(y[hold].astype(int), minlength=2)) < 2 or min(np.bincount(y[~hold].astype(int), minlength=2)) < 2:
            hold = np.arange(len(y)) % 2 == 0
        model = CoTrained(each=each)
        model.fit((x[0], x[1]), y, hold, _exchange(own, model.sure))
    if features is None:
        unstage(own)
    release()
    return model


def _scorer(model: CoTrained | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.scores(*_arrays(batch)) if model else [np.ones(batch.num_rows)] * 3
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c.astype(np.float64)) for c in p), pa.array(p[2] >= threshold)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return run


SCORES = "doc_id long, p_text double, p_meta double, score double, kept boolean"


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = 12_000) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) of every row, by a model that is fitted on the same features."""
    features = featurized(docs, labels, labelled)
    model = fit(docs, labels, labelled, features=features)
    return features.select("doc_id", "text", "meta").mapInArrow(_scorer(model, threshold), SCORES)


def score(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) of every row."""
    rows = pick(docs, **_TYPES).withColumn("quality", F.lit(None).cast("int"))
    return rows.mapInArrow(_featurize, FEATURES).select("doc_id", "text", "meta").mapInArrow(_scorer(model, threshold), SCORES)


def keep_good(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                good = model.scores(*views(_columns(part)))[2] >= threshold
                yield part.filter(pa.array(good))

    short_batches(docs)
    return docs.mapInArrow(run, docs.schema) if model else docs
