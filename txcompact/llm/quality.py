"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, and every other visible character by itself, so that junk made of
signs has n-grams of its own; a word that repeats the last or last but one is replaced by one common sign.
Unigrams and bigrams are hashed to ``DIM`` weights; a text's features are
log(1 + count), scaled to length one. Training is the per-coordinate FTRL-proximal update over a
bounded sample; scoring is a sparse dot product for each text, followed by Platt's sigmoid, which is
fitted on rows kept from training and weighted to the classes' shares.

Defined results: null and empty texts have no features and get the calibrated bias; with no labelled rows,
or only one class, every score is that class's share (0 without any). Repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm.common import in_bucket, table
from txcompact.llm.labelled import FIT_ROWS, class_weights, fit_sample, platt

DIM = 1 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]")
#: Stands for a word that was there one or two words before, so that repetition is an n-gram of its own.
AGAIN = np.uint64(1 << 33)
MIX = np.uint64(0x9E3779B97F4A7C15)


def features(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text's word hashes and their values."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0)
    h = hashes.astype(np.uint64)
    again = np.zeros(len(h), bool)
    again[1:] |= h[1:] == h[:-1]
    again[2:] |= h[2:] == h[:-2]
    h = np.where(again, AGAIN, h)
    grams = np.concatenate([h * MIX, (h[:-1] * MIX + h[1:] + np.uint64(1)) * MIX]) >> np.uint64(44)
    at, n = np.unique(grams, return_counts=True)
    x = np.log1p(n)
    return at.astype(np.int64), x / np.sqrt((x * x).sum())


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(self.weights[at] @ x) + self.bias

    def score(self, raw: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(raw), self.constant)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))


def word_hashes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    words = WORD.findall(text)
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = zlib.crc32(w)
        out.append(h)
    return np.array(out, np.uint64)


def train(texts: list[str], y: np.ndarray, sizes: dict[int, int], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, seed: int = 1) -> LinearModel:
    """FTRL-proximal over the texts in random order; every fifth text only calibrates."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    if not len(texts) or y.min() == y.max():
        return LinearModel(z[:0], 0.0, constant=float(y[0]) if len(texts) else 0.0)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    known: dict[bytes, int] = {}
    rows = [features(word_hashes(t.encode("utf-8", "replace"), known)) for t in texts]
    rows = [(np.r_[at, DIM], np.r_[x, 1.0]) for at, x in rows]  # the last coordinate is the bias
    held = np.arange(len(texts)) % 5 == 4
    if not held.any() or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            at, x = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIM + 1))
    model = LinearModel(w[:DIM].astype(np.float32), float(w[DIM]))
    check = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    raw = np.array([model.raw(rows[i][0][:-1], rows[i][1][:-1]) for i in check])
    model.scale = platt(raw, y[check], class_weights(y, sizes)[check])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> LinearModel:
    """Train on at most ``rows`` labelled texts (half of each class)."""
    sample, sizes = fit_sample(docs, labels, label, rows)
    return train([r[0] for r in sample], np.array([r[1] for r in sample], np.int64), sizes)


def scored(docs: DataFrame, model: LinearModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for b in batches:
            if len(known) > 1_000_000:
                known = {}
            raw = np.zeros(b.num_rows)
            if model.constant is None:
                for i, t in enumerate(b.column(1).to_pylist()):
                    raw[i] = model.raw(*features(word_hashes(t or b"", known)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(raw))], names=[id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (in_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
