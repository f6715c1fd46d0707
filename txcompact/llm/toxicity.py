"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are hashed to buckets; each bucket that is seen in enough fitting texts has an embedding, all others
share one. Filters of several widths run over the whole text, the greatest value of each filter is
kept, and a logistic layer gives the raw score. The first component of an embedding starts at the bucket's
smoothed class log-odds, so that max pooling finds the telling words from the start; all is then trained by
mini-batches (Adagrad). Copies and near copies (texts of one class with the same eight least buckets) count
once, else the words of one much copied text pass for telling ones. A fifth of the sample is kept from training to calibrate: Platt's sigmoid gives
the score, and for every language the threshold with the best F1 on the calibration rows (0.5 where a
language has too few rows of a class). The language picks a threshold only; no score sees it.

Scoring is a sum of table rows: the products of embeddings and filters are worked out once.

Defined results: null and empty texts are one text without words and get its score; with no labelled rows,
or only one class, every score is that class's share (0 without any). Repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm.common import in_bucket, table
from txcompact.llm.labelled import FIT_ROWS, class_weights, fit_sample, platt

WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 8, 8, 1 << 26
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def buckets_of(text: str | bytes | None) -> list[int]:
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    return [zlib.crc32(w) % BUCKETS for w in WORD.findall(raw.lower())]


@dataclass
class ConvModel:
    buckets: np.ndarray  #: sorted buckets with an embedding of their own; row i + 2 is theirs (0: padding, 1: all others)
    tables: list[np.ndarray]  #: for each width and offset, embeddings times filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def raw(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Raw scores of texts laid end to end, each followed by padding of the greatest width."""
        pooled, k, n = [], 0, len(rows)
        for i, w in enumerate(WIDTHS):
            value = self.tables[k][rows].copy()
            for j in range(1, w):
                value[: n - j] += self.tables[k + j][rows[j:]]
            k += w
            value[across(starts, n)] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(value, starts, axis=0) + self.bias[i], 0))
        return np.concatenate(pooled, axis=1) @ self.out + self.out_bias

    def score(self, texts: list[list[int]]) -> np.ndarray:
        """``texts``: rows of the embedding table for each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.scale
        out = np.zeros(len(texts))
        begin = 0
        while begin < len(texts):  # some 200,000 words at a time
            end, words = begin, 0
            while end < len(texts) and (end == begin or words + len(texts[end]) < 200_000):
                words += len(texts[end])
                end += 1
            rows, starts = laid_out(texts[begin:end])
            out[begin:end] = 1 / (1 + np.exp(-np.clip(a * self.raw(rows, starts) + b, -30, 30)))
            begin = end
        return out


def laid_out(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    pad = max(WIDTHS)
    sizes = np.array([len(t) + pad for t in texts])
    starts = np.cumsum(sizes) - sizes
    rows = np.zeros(int(sizes.sum()), np.int64)
    for t, s in zip(texts, starts):
        rows[s : s + len(t)] = t
    return rows, starts


def across(starts: np.ndarray, n: int) -> np.ndarray:
    """Places from which a window could reach into the next text."""
    ends = np.r_[starts[1:], n]
    return (ends[:, None] - np.arange(1, max(WIDTHS))).ravel()


def rows_of(buckets: np.ndarray, texts: list[list[int]]) -> list[np.ndarray]:
    out = []
    for t in texts:
        b = np.array(t, np.int64)
        at = np.searchsorted(buckets, b)
        at[at == len(buckets)] = 0
        out.append(np.where(buckets[at] == b, at + 2, 1) if len(buckets) else np.ones(len(b), np.int64))
    return out


def train(texts: list[str], y: np.ndarray, langs: list, sizes: dict[int, int], epochs: int = 10, batch: int = 64, min_docs: int = 4, rate: float = 0.1, seed: int = 1) -> ConvModel:
    """Fit on texts with labels 0 and 1; every fifth text only calibrates."""
    empty = ConvModel(np.zeros(0, np.int64), [], np.zeros(0), np.zeros(0), 0.0)
    if not len(texts) or y.min() == y.max():
        empty.constant = float(y[0]) if len(texts) else 0.0
        return empty
    rng = np.random.default_rng(seed)
    hashed = [np.array(buckets_of(t), np.int64) for t in texts]
    once = list({(c, *sorted(set(h))[:8]): i for i, (h, c) in reversed(list(enumerate(zip(hashed, y))))}.values())[::-1]
    hashed, y, langs = [hashed[i] for i in once], y[once], [langs[i] for i in once]
    held = np.arange(len(hashed)) % 5 == 4
    if not held.any() or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    fit = np.flatnonzero(~held)
    seen = {c: np.unique(np.concatenate([np.zeros(0, np.int64), *[np.unique(hashed[i]) for i in fit if y[i] == c]]), return_counts=True) for c in (0, 1)}
    buckets = np.union1d(seen[0][0], seen[1][0])
    df = np.zeros((2, len(buckets)))
    for c in (0, 1):
        df[c, np.searchsorted(buckets, seen[c][0])] = seen[c][1]
    often = df.sum(axis=0) >= min_docs
    buckets, df = buckets[often], df[:, often]
    n = np.array([(y[fit] == 0).sum(), (y[fit] == 1).sum()])
    odds = np.log((df[1] + 5) / (n[1] + 10)) - np.log((df[0] + 5) / (n[0] + 10))
    emb = rng.normal(0, 0.05, (len(buckets) + 2, DIM))
    emb[0] = 0
    emb[1, 0] = 0
    emb[2:, 0] = np.clip(odds, -4, 4) / 2
    kernels = [rng.normal(0, 0.15, (w, DIM, FILTERS)) for w in WIDTHS]
    for w in kernels:  # half of the filters look for words of label 1 to start with
        w[0, 0, : FILTERS // 2] += 1.0
    bias = np.zeros((len(WIDTHS), FILTERS))
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS)
    for i in range(len(WIDTHS)):
        out[i * FILTERS : i * FILTERS + FILTERS // 2] += 0.2
    c = -1.0
    params = [emb, *kernels, bias, out]
    past = [np.full_like(p, 1e-2) for p in params]
    past_c = 1e-2
    rows = rows_of(buckets, hashed)
    for _ in range(epochs):
        order = rng.permutation(fit)
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            tokens, starts = laid_out([rows[i] for i in part])
            m, size = len(tokens), np.diff(np.r_[starts, len(tokens)])
            e = emb[tokens]
            doc = np.repeat(np.arange(len(part)), size)
            pooled, where = [], []
            for i, w in enumerate(WIDTHS):
                v = e @ kernels[i][0]
                for j in range(1, w):
                    v[: m - j] += e[j:] @ kernels[i][j]
                v[across(starts, m)] = -np.inf
                top = np.maximum.reduceat(v, starts, axis=0)
                first = np.where(v == top[doc], np.arange(m)[:, None], m)
                where.append(np.minimum.reduceat(first, starts, axis=0))
                pooled.append(np.maximum(top + bias[i], 0))
            h = np.concatenate(pooled, axis=1)
            p = 1 / (1 + np.exp(-np.clip(h @ out + c, -30, 30)))
            err = (p - y[part]) / len(part)
            grads = [np.zeros_like(emb), *[np.zeros_like(w) for w in kernels], np.zeros_like(bias), h.T @ err + 1e-4 * out]
            back = np.outer(err, out) * (h > 0)
            for i, w in enumerate(WIDTHS):
                g, at = back[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                grads[-2][i] = g.sum(axis=0)
                for j in range(w):
                    place = np.minimum(at + j, m - 1)
                    ok = (at + j < m) * g
                    x = e[place]  # text, filter, dimension
                    grads[1 + i][j] = np.einsum("bfd,bf->df", x, ok)
                    np.add.at(grads[0], tokens[place], ok[:, :, None] * kernels[i][j].T[None])
            grads[0][0] = 0
            for q, g, s in zip(params, grads, past):
                s += g * g
                q -= rate * g / np.sqrt(s)
            past_c += err.sum() ** 2
            c -= rate * err.sum() / np.sqrt(past_c)
    model = ConvModel(buckets, [(emb @ kernels[i][j]).astype(np.float32) for i, w in enumerate(WIDTHS) for j in range(w)], bias, out, float(c))
    check = np.flatnonzero(held) if held.any() else fit
    laid = [rows[i] for i in check]
    raw = np.concatenate([model.raw(*laid_out(laid[k : k + 100])) for k in range(0, len(laid), 100)])
    weight = class_weights(y, sizes)[check]
    model.scale = platt(raw, y[check], weight)
    scores, lang = model.score(laid), np.array([str(langs[i]) for i in check])
    for name in sorted(set(lang)):
        s, t, w = scores[lang == name], y[check][lang == name], weight[lang == name]
        if min((t == 0).sum(), (t == 1).sum()) >= 20:
            cuts = np.unique(np.r_[s, 0.5])
            f1 = [2 * (w * t * (s >= x)).sum() / max(1e-9, (w * t).sum() + (w * (s >= x)).sum()) for x in cuts]
            best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
            model.thresholds[name] = float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> ConvModel:
    """Train on at most ``rows`` labelled texts (half of each class)."""
    sample, sizes = fit_sample(docs, labels, label, rows, extra=("lang",))
    return train([r[0] for r in sample], np.array([r[1] for r in sample], np.int64), [r[2] for r in sample], sizes)


def scored(docs: DataFrame, model: ConvModel, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        own = {int(b): i + 2 for i, b in enumerate(model.buckets)}
        row: dict[bytes, int] = {}

        def look_up(w: bytes) -> int:
            r = row[w] = own.get(zlib.crc32(w) % BUCKETS, 1)
            return r

        for b in batches:
            if len(row) > 1_000_000:
                row.clear()
            get, score = row.get, []
            texts = b.column(b.num_columns - 1).to_pylist()
            for k in range(0, len(texts), 500):
                part = []
                for t in texts[k : k + 500]:
                    words = WORD.findall((t or b"").lower())
                    part.append([get(w) or look_up(w) for w in words])
                score.append(model.score(part))
            cols = [b.column(i) for i in range(len(id_cols))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([np.zeros(0), *score]))], names=[*id_cols, "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in id_cols), "score double"])
    return docs.select(*id_cols, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def toxic_rows(docs: DataFrame, model: ConvModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``score`` and ``rejected`` (in place of columns of these names): the score reaches its language's calibrated threshold."""
    docs = docs.drop("score", "rejected")
    both = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", text_col)
    found = scored(both, model, ("_row",), text_col)
    cut = F.create_map(*[x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(v))]) if model.thresholds else None
    at = F.coalesce(cut[F.col(f"_row.{lang_col}").cast("string")], F.lit(0.5)) if cut is not None else F.lit(0.5)
    return found.select("_row.*", "score", (F.col("score") >= at).alias("rejected"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (in_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
