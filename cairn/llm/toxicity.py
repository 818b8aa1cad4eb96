"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its lower-cased words (A-Z), the first four and five bytes of each word (so
that inflected forms share evidence), pairs of neighbouring words, and pairs with one word between. They are hashed to
2^20 places. Each place has its own learning rate, and the L1 term leaves most weights exactly zero, so the model that
is broadcast is the few places that are not: at most 2^20, in practice some thousands.

Training reads at most TRAIN_ROWS labelled rows, chosen by a hash of their ids (a classifier may be fitted on a bounded
sample), in one task; scoring is one pass over whole texts.

Defined results: a null text counts as empty and gets the score of the bias alone; without labelled rows every score
is 0; labels that are null are ignored, of repeated labels of an id the largest counts; of
repeated ids the smallest text is learned from; repeated rows each get a row;
columns other than the id and the text are never read for a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, fold, slices

BITS = 20
TRAIN_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1


def features(data: bytes, bits: int = BITS, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """Places of the text's features, block by block, with repeats."""
    words, shift = data.lower().split(), np.uint64(64 - bits)
    for at in range(0, len(words), block):
        part = words[at : at + block + 2]
        h = np.fromiter(map(crc32, part), np.uint64, len(part))
        own = h[:block]
        four = np.fromiter((crc32(w[:4]) for w in part[:block]), np.uint64)
        five = np.fromiter((crc32(w[:5]) for w in part[:block]), np.uint64)
        mixed = [
            own * np.uint64(0x9E3779B97F4A7C15),
            (four + np.uint64(1 << 40)) * np.uint64(0xC2B2AE3D27D4EB4F),
            (five + np.uint64(1 << 41)) * np.uint64(0x165667B19E3779F9),
            (own[: len(h) - 1] * np.uint64(0x85EBCA77C2B2AE63) + h[1 : block + 1]) * np.uint64(0x9E3779B97F4A7C15),
            (own[: max(0, len(h) - 2)] * np.uint64(0x27D4EB2F165667C5) + h[2 : block + 2] + np.uint64(1 << 42)) * np.uint64(0xC2B2AE3D27D4EB4F),
        ]
        yield (np.concatenate(mixed) >> shift).astype(np.int64)


def trained(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> dict[int, float]:
    """Weights that aren't zero, by place; -1 is the bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    positive = sum(y for _, y in rows)
    bias = math.log((positive + 0.5) / (len(rows) - positive + 0.5))
    bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in rows:
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_n += g * g
            bias -= 0.05 * g / (1 + math.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > L1)
    return dict(zip(at.tolist(), weights(at).tolist())) | {-1: bias}


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> dict[int, float]:
    """Weights from labelled documents outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    chosen = known.groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(train_rows)
    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    # at most train_rows rows of an id and a bit: a bound that no table exceeds
    # of a repeated id the smallest text counts, so that the learning task reads at most train_rows rows too
    rows = own.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("k", "text", "y")

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = []
        for b in slices(batches):
            keys, ys = b.column(0).to_pylist(), b.column(2).to_pylist()
            for k, text, y in zip(keys, bytes_of(b, 1), ys):
                found = [np.unique(f) for f in features(text)]
                at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                read.append((crc32(str(k).encode()), k, at.astype(np.int32), y))
        read.sort(key=lambda r: (r[0], str(r[1])))
        if read:
            model = trained([(at, y) for _, _, at, y in read])
            yield pa.record_batch([pa.array(list(model), pa.int64()), pa.array(list(model.values()), pa.float64())], names=["place", "weight"])

    return {r.place: r.weight for r in rows.repartition(1).mapInArrow(learn, "place long, weight double").collect()}


class Scorer:
    def __init__(self, model: dict[int, float], bits: int = BITS):
        self.bias = model.get(-1)
        self.weights = np.zeros(1 << bits)
        for k, w in model.items():
            if k >= 0:
                self.weights[k] = w

    def score(self, data: bytes) -> float:
        if self.bias is None:
            return 0.0
        places = [f[self.weights[f] != 0] for f in features(data)]
        total = self.bias + (self.weights[np.unique(np.concatenate(places))].sum() if places else 0.0)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))


def scored(docs: DataFrame, model: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for b in slices(batches):
            s = np.array([own.score(x) for x in bytes_of(b, 1)], np.float64)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, model: dict[int, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.schema.names
    where = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(shared.value)
        for b in slices(batches):
            yield b.filter(pa.array([own.score(x) < threshold for x in bytes_of(b, where)], pa.bool_()))

    held = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return held.mapInArrow(run, held.schema).toDF(*names)
