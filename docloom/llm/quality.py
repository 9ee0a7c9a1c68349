"""A quality classifier: random Fourier features over document statistics.

Statistics of the whole text (characters, words, lines; no label, language,
source or id) are standardised; cosines of random projections approximate a
Gaussian kernel over them; ridge weights follow from normal equations that each
partition sums up on its own. Isotonic regression on out-of-fold scores, in a
fixed number of bins, makes them probabilities. What reaches the driver has a
fixed size at any scale.

Learned from: labelled rows whose crc32(doc_id) mod 5 isn't 0, of at most about
``TRAIN_ROWS`` ids, chosen by a seeded hash; every document is scored. Defined
results: a null text counts as empty and gets a score as any other; a very long
one is described as a whole; of several labels of one id the largest counts;
null labels and labels of unknown ids are ignored; without labels of both kinds
every score is their mean, or 0.5; repeated rows are scored alike; a null
``doc_id`` is scored and not held out; extra columns are ignored, and kept by
:func:`accepted`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, text_bytes, written
from .repeats import byte_symbols, gram_hashes, range_hashes, words_of

FEATURES = 256
BINS = 1024
FOLDS = 4
RIDGE = 1e-3
WIDTH = 0.12
THRESHOLD = 0.3
SEED = 2
#: Labelled documents that are learned from, about; all, if there are fewer.
TRAIN_ROWS = 1 << 15
#: Partitions of them, and so partial sums that are added up.
PARTS = 16

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\f", "\n", ".,;:", "!?", "#*$%&|<>", "()[]{}\"'`-_/\\=+~^@"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)  # other control characters
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(_c) for _c in _chars]] = _k
_CLASS[0x80:0xC0] = len(_CLASSES) + 1  # continuation bytes
_CLASS[0xC0:] = len(_CLASSES) + 2
_N = len(_CLASSES) + 3
_UPPER, _SPACE, _LINE, _MARK, _LOUD, _SYMBOL = 0, 3, 4, 5, 6, 7
DIM = _N + 19


def per_doc_counts(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: different hashes, hashes that occur more than once (all
    occurrences), occurrences of the most frequent."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1]))) if len(d) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(d)))
    of = d[first]
    most = np.zeros(n)
    np.maximum.at(most, of, size)
    return np.bincount(of, minlength=n), np.bincount(of, np.where(size > 1, size, 0), minlength=n), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, DIM) of a chunk of texts."""
    n = len(off) - 1
    length = np.diff(off)
    doc = np.repeat(np.arange(n), length)
    cls = _CLASS[data]
    share = np.bincount(doc * _N + cls, minlength=n * _N).reshape(n, _N).astype(np.float64)
    chars = np.maximum(length - share[:, -2], 1)
    entropy = np.zeros(n)
    freq = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(length, 1)[:, None]
    entropy = -(freq * np.log2(np.maximum(freq, 1e-12))).sum(1)
    starts, ends, bounds = words_of(data, off)
    words = np.diff(bounds)
    per = np.maximum(words, 1)
    wdoc = np.repeat(np.arange(n), words)
    size = ends - starts
    mean = np.bincount(wdoc, size, minlength=n) / per
    spread = np.sqrt(np.maximum(np.bincount(wdoc, size.astype(float) ** 2, minlength=n) / per - mean**2, 0))

    def of_words(mask):
        return np.bincount(wdoc, mask, minlength=n) / per

    symbols = byte_symbols(data)
    if len(starts):
        h = range_hashes(symbols, starts, ends)
        upper = np.append(0, np.cumsum(cls == _UPPER))
        lower = np.append(0, np.cumsum(cls == 1))
        ups, lows = upper[ends] - upper[starts], lower[ends] - lower[starts]
        last, first = cls[ends - 1], cls[starts]
        caps, shout = first == _UPPER, (ups > 1) & (lows == 0)
        stop, loud, odd = last == _MARK, last == _LOUD, last == _SYMBOL
        bare = (ups == 0) & (lows == 0)
    else:
        h = np.zeros(0, np.uint64)
        caps = shout = stop = loud = odd = bare = np.zeros(0, bool)
    kinds, repeated, most = per_doc_counts(wdoc, h, n)
    if len(h) >= 3:
        g = gram_hashes(h, 3)
        inside = wdoc[2:] == wdoc[:-2]
        gdoc, g = wdoc[:-2][inside], g[inside]
    else:
        gdoc, g = np.zeros(0, np.int64), h[:0]
    _, again, _ = per_doc_counts(gdoc, g, n)
    lines = share[:, _LINE] + 1
    begins = np.unique(np.concatenate((off[:-1][length > 0], np.flatnonzero(data == 10) + 1)))
    begins = begins[begins < len(data)]
    ldoc = np.searchsorted(off, begins, "right") - 1
    stop_at = np.append(begins[1:], len(data))
    lh = range_hashes(symbols, begins, stop_at) if len(begins) else h[:0]
    lkinds, _, _ = per_doc_counts(ldoc, lh, n)
    return np.column_stack(
        [
            share / chars[:, None],
            np.log1p(length),
            np.log1p(words),
            entropy,
            mean,
            spread,
            of_words(size <= 2),
            of_words(size >= 12),
            of_words(caps),
            of_words(shout),
            of_words(stop),
            of_words(loud),
            of_words(odd),
            of_words(bare),
            kinds / per,
            repeated / per,
            most / per,
            again / per,
            np.log1p(words / lines),
            1 - lkinds / lines,
        ]
    ).astype(np.float32)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled_labels(labels: DataFrame, most: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, y, fold) of about ``most`` labelled ids that aren't held out,
    chosen by a seeded hash; all if there are fewer."""
    y = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    y = written(y.filter(~held_out()), "labels")
    n = y.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 32)) < F.lit(int((1 << 32) * min(1.0, most / max(n, 1))))
    return y.filter(part).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))


def training_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """f, y, fold: the statistics of the sampled labels' documents. The sample
    has a bounded size, so no text is shuffled."""

    def run(batches):
        for part, data, off in chunks(batches, "text"):
            f = pa.FixedSizeListArray.from_arrays(pa.array(statistics(data, off).ravel()), DIM).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([f, part.column(1), part.column(2)], names=["f", "y", "fold"])

    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = written(mine.select("text", "y", "fold").mapInArrow(run, "f array<float>, y int, fold int"), "train")
    # a fixed number of partial sums, however many files there are
    return written(rows.repartition(PARTS), "train")


@dataclass
class Model:
    """Everything a score needs; its size is fixed."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(DIM))
    scale: np.ndarray = field(default_factory=lambda: np.ones(DIM))
    features: int = FEATURES
    width: float = WIDTH
    seed: int = SEED
    weights: np.ndarray | None = None
    low: float = 0.0
    high: float = 1.0
    knots: np.ndarray | None = None
    constant: float = 0.5

    def lift(self, f: np.ndarray) -> np.ndarray:
        """Random Fourier features, with a constant and the statistics."""
        x = np.clip((f - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(self.seed)
        w = rng.standard_normal((f.shape[1], self.features)) * self.width
        b = rng.uniform(0, 2 * np.pi, self.features)
        return np.column_stack((np.sqrt(2 / self.features) * np.cos(x @ w + b), np.ones(len(x)), x / 10))

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.lift(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of it keeps the order within a step."""
        if self.weights is None:
            return np.full(len(f), self.constant)
        r = np.clip((self.raw(f) - self.low) / (self.high - self.low), 0, 1)
        p = np.interp(r * (len(self.knots) - 1), np.arange(len(self.knots)), self.knots)
        return np.clip(0.999 * p + 0.001 * r, 0, 1)


def isotonic(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """The monotone fit of the bins' shares, weighted by their counts, by pooling
    adjacent violators; empty bins take what lies between."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(all_).tolist():
        blocks.append([float(good[i]), float(all_[i]), i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    at, v = [], []
    for g, n, a, b in blocks:
        at += [a, b]
        v += [g / n] * 2
    return np.interp(np.arange(len(all_)), at, v)


def summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """Adds what ``part`` makes of each of the PARTS partitions: (fold, vector)
    rows."""

    def vectors(batches):
        for fold, v in part(batches):
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([np.asarray(v, "<f8").tobytes()], pa.binary())], names=["fold", "v"])

    out = np.zeros((FOLDS, width))
    for r in rows.mapInArrow(vectors, "fold int, v binary").toLocalIterator():
        out[r[0]] += np.frombuffer(r[1], "<f8")
    return out


def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f, y, fold = (batch.column(batch.schema.get_field_index(c)) for c in ("f", "y", "fold"))
    return f.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM).astype(np.float64), y.to_numpy().astype(np.float64), fold.to_numpy()


def fit(train: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, bins: int = BINS, seed: int = SEED) -> Model:
    """``train``: written rows f, y (0/1), fold."""
    model = Model(features=features, width=width, seed=seed)

    def moments(batches):
        total = np.zeros(2 * DIM + 2)
        for b in batches:
            f, y, _ = columns(b)
            total += np.concatenate((f.sum(0), (f**2).sum(0), [len(y), y.sum()]))
        yield 0, total

    s = summed(train, moments, 2 * DIM + 2)[0]
    n, good = s[-2:]
    if not n:
        return model
    model.constant = float(good / n)
    if good in (0, n):
        return model
    model.mean = s[:DIM] / n
    model.scale = np.sqrt(np.maximum(s[DIM : 2 * DIM] / n - model.mean**2, 0)) + 1e-6
    size = features + 1 + DIM

    def equations(batches):
        total = {}
        for b in batches:
            f, y, fold = columns(b)
            z = model.lift(f)
            for k in np.unique(fold).tolist():
                m = fold == k
                v = np.concatenate(((z[m].T @ z[m]).ravel(), z[m].T @ y[m]))
                total[k] = total[k] + v if k in total else v
        yield from total.items()

    parts = summed(train, equations, size * size + size)

    def solve(v, rows):
        a, b = v[: size * size].reshape(size, size), v[size * size :]
        return np.linalg.solve(a + ridge * max(rows, 1) * np.eye(size) / size, b)

    whole = parts.sum(0)
    held = [solve(whole - p, n) for p in parts]
    model.weights = solve(whole, n)
    model.low, model.high = -0.5, 1.5

    def histogram(batches):
        total = np.zeros(2 * bins)
        for b in batches:
            f, y, fold = columns(b)
            raw = np.einsum("ij,ij->i", model.lift(f), np.array(held)[fold])
            at = np.clip(np.rint((raw - model.low) / (model.high - model.low) * (bins - 1)), 0, bins - 1).astype(int)
            total += np.concatenate((np.bincount(at, y, bins), np.bincount(at, minlength=bins)))
        yield 0, total

    h = summed(train, histogram, 2 * bins)[0]
    model.knots = isotonic(h[:bins], h[bins:])
    return model


def train_on(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, **how) -> Model:
    """Fits on a bounded sample of the labelled rows that aren't held out."""
    return fit(training_rows(docs, sampled_labels(labels, most)), **how)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document: a map, as the
    model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(train_on(docs, labels, **how))

    def run(batches):
        for part, data, off in chunks(batches):
            s = shared.value.score(statistics(data, off).astype(np.float64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    scores = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, score double")
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(train_on(docs, labels, **how))

    def run(batches):
        for part, data, off in chunks(batches):
            ok = shared.value.score(statistics(data, off).astype(np.float64)) >= threshold
            yield part.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def op2_fourier_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
