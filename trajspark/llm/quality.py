"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader (FTRL-proximal).

Words are white-space separated. An n-gram is over the words as they stand (1 and 2 words) or over their shapes (1, 2
and 3 words): a shape keeps one letter for each run of lower case, upper case or digits and the other bytes of a run
once, and a word equal to the one before it has the shape "=". N-grams are hashed to 2^18 places; a text is the vector
of its n-gram shares, so long and short texts weigh alike. Training reads a bounded sample: at most `per_class` labelled
rows of either class, the smallest by hash of doc_id; scoring is a sparse dot product in numpy over whole texts.

Cases: null and empty texts score the intercept alone; a doc_id labelled several times counts once, with its lowest
quality; without labelled rows of both classes every score is 0.5; repeated rows give one result each; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, table, words_of

BITS = 18
_U = np.uint64
_KIND = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, _U))


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ _U(seed)) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(32))


def _hash_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit polynomial hash for each run data[start:start+length]; runs follow one another without gaps."""
    within = np.arange(len(data)) - np.repeat(starts, lengths)
    return np.add.reduceat((data.astype(_U) + _U(1)) * _POWERS[within & 4095], starts)


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all n-grams of the texts, and the text that each belongs to."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
    begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts])[:-1]
    starts, ends = words_of(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(begins, starts, side="right") - 1
    lengths = ends - starts
    chars = data[np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    word = _hash_runs(chars, first, lengths)
    kind = _KIND[chars]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[first] = True
    kept = np.add.reduceat(new.astype(np.int64), first)
    shape = _hash_runs(kind[new], np.concatenate(([0], np.cumsum(kept)[:-1])), kept)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape[same] = _U(61)
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pair = lambda h: _mix(h[:-1], 7) * _U(3) + h[1:]
    grams = [
        (_mix(word, 1), doc),
        (_mix(pair(word), 2)[two], doc[1:][two]),
        (_mix(shape, 3), doc),
        (_mix(pair(shape), 4)[two], doc[1:][two]),
        (_mix(_mix(pair(shape)[:-1], 9) * _U(5) + shape[2:], 5)[three], doc[2:][three]),
    ]
    return np.concatenate([g for g, _ in grams]).astype(_U) >> _U(64 - BITS), np.concatenate([d for _, d in grams])


def margins(texts: list[bytes | None], weights: np.ndarray) -> np.ndarray:
    """Intercept (last weight) plus the sparse dot product of each text's n-gram shares."""
    places, doc = ngrams(texts)
    total = np.bincount(doc, weights[places.astype(np.int64)], len(texts))
    return weights[-1] + SCALE * total / np.maximum(np.bincount(doc, minlength=len(texts)), 1)


#: Shares are small; the scale brings them to the order of the intercept's 1.
SCALE = 50.0


def train(rows: list[tuple[list[int], list[float], int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 4) -> np.ndarray:
    """FTRL-proximal over (places, values, label) rows; the last weight is the intercept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    data = [(np.append(np.asarray(p, np.int64), 1 << BITS), np.append(np.asarray(v, float), 1.0), y) for p, v, y in rows]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(data)):
            i, x, y = data[k]
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weight(np.arange(len(z)))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500, label: str = "quality") -> DataFrame:
    """doc_id, y, text of at most per_class rows of either class, the smallest by hash of doc_id."""
    one = labels.where(f"doc_id is not null and {label} in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    pick = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = {r["doc_id"]: r["y"] for p in pick for r in p.collect()}  # at most 2 * per_class ids
    known = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, label: str = "quality") -> np.ndarray:
    """Weights learned from the bounded sample; the n-grams are hashed on the executors."""

    def hashed(cols):
        out = [[], [], [], []]
        for doc, y, text in zip(*cols):
            places, count = np.unique(ngrams([text])[0].astype(np.int64), return_counts=True)
            for c, v in zip(out, (doc, y, places.astype(np.int32), (SCALE * count / max(1, count.sum())).astype(np.float32))):
                c.append(v)
        return out

    sample = labelled_sample(docs, labels, per_class, label).select("doc_id", "y", "text")
    rows = map_batches(sample, hashed, "doc_id long, y int, places array<int>, shares array<float>").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    if len({r["y"] for r in rows}) < 2:
        return np.zeros((1 << BITS) + 1)
    return train([(r["places"], r["shares"], r["y"]) for r in rows])


def score_column(spark: SparkSession, weights: np.ndarray, text: Column) -> Column:
    """Probability of label 1, as a column over the whole text; the weights (2 MB) are broadcast."""
    shared = spark.sparkContext.broadcast(weights.astype(np.float64))

    def scores(texts):
        rows, out = texts.to_pylist(), []
        for part in _parts(rows):
            out.append(1 / (1 + np.exp(-np.clip(margins(part, shared.value), -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(scores, "double").asNondeterministic()(text.cast("binary"))


def _parts(rows: list, max_rows: int = 256, max_bytes: int = 1 << 20):
    part, size = [], 0
    for t in rows:
        part.append(t)
        size += len(t or b"")
        if size >= max_bytes or len(part) >= max_rows:
            yield part
            part, size = [], 0
    if part:
        yield part


def op7_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Quality score of every document, learned from labels of the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 5) == 0).alias("held_out"), score_column(spark, weights, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of at least threshold; all columns stay."""
    weights = fit(training, labels)
    return docs.where(score_column(docs.sparkSession, weights, F.col("text")) >= threshold)
