"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation with full reorthogonalisation.

Vectors become integers, ``floor(scale * c) + shift``, and are stored in blocks of rows, a matrix each. Sums over the columns are
exact, so a row is centred without loss: whole and fractional part of the mean are taken off apart.

The bidiagonalisation alternates products with the centred rows X: ``Xv`` and ``X'u``, each the sum of what the tasks make of
their blocks. The long vectors u, an entry for each row, are never stored nor sent: each is a combination of columns of X that the driver
knows (``u = Xc``, c as long as a vector), so a task works out its own part of all earlier ones when it needs them. Each step takes
two passes: the first measures ``Xv`` against all earlier u, the second takes that off, measures what is left once more, and
forms ``X'u``. The short vectors v are made orthogonal in the driver, twice. Where the space found so far is closed, a new v orthogonal to
it is taken, so equal deviations are found as often as they occur. As many steps are made as there are dimensions, as the spectrum may
be flat; then the singular values of the small bidiagonal matrix give all deviations, and the components are ``V`` times its right vectors.

The driver holds some square matrices of the vectors' length and a vector from each task; beyond ``FEW`` tasks those are first
added up by their square root of tasks. Nothing else grows with the rows.

Defined results: rows whose vector is null, holds null or non-finite entries, or has another length than most (of equally many, the
longest) are left out; rows with null or repeated ids take part like any other; entries beyond 2**52 after scaling count as
2**52; components without deviation are not given, so equal vectors, a single one, or an empty table give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm.common import stored, table

#: Rows to a block, and tasks whose sums go straight to the driver.
ROWS, FEW = 4096, 64
#: What counts as zero beside the largest singular value.
TINY = 1e-13


@dataclass(frozen=True)
class Centre:
    """Mean of the integer vectors: ``whole + rest / n`` in each dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    components: np.ndarray  #: a column each
    variances: np.ndarray
    trace: float

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.of(x) @ (self.components / np.sqrt(self.variances))


def to_blocks(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Stored blocks: ``ids`` and ``x``, the integers of ``d`` columns as bytes."""
    sized = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("size(v) > 0")
    most = sized.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.equal(pc.list_value_length(b.column(1)), d))
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            fits = np.isfinite(values).all(1)
            x = np.clip(np.floor(values[fits] * scale), -(2.0**52), 2.0**52).astype(np.int64) + shift
            ids = b.column(0).filter(pa.array(fits))
            for i in range(0, len(x), ROWS):
                some = ids.slice(i, ROWS)
                held = pa.ListArray.from_arrays([0, len(some)], some)
                yield pa.RecordBatch.from_arrays([held, pa.array([d], pa.int32()), pa.array([x[i : i + ROWS].tobytes()])], names=["ids", "d", "x"])

    kind = dict(vectors.dtypes)[id_col]
    return stored(sized.mapInArrow(run, f"ids array<{kind}>, d int, x binary"), "vector-blocks")


def matrices(batches: Iterator[pa.RecordBatch], place: int, d: int) -> Iterator[np.ndarray]:
    for b in batches:
        for x in b.column(place):
            yield np.frombuffer(x.as_buffer(), np.int64).reshape(-1, d)


class Passes:
    """Sums over all blocks of what a function makes of each (vectors of one length)."""

    def __init__(self, blocks: DataFrame, d: int):
        self.x, self.d = blocks.select("x"), d
        self.tasks = self.x.select(F.spark_partition_id().alias("p")).distinct().count()

    def sum(self, make: Callable[[np.ndarray], np.ndarray], kind=np.float64) -> np.ndarray:
        d = self.d

        def add(vectors: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            total = None
            for v in vectors:
                total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return add(np.frombuffer(v.as_buffer(), kind) for b in batches for v in b.column(0))

        sums = self.x.mapInArrow(lambda batches: add(map(make, matrices(batches, 0, d))), "v binary")
        if self.tasks > FEW:
            sums = sums.repartition(int(self.tasks**0.5)).mapInArrow(again, "v binary")
        return np.sum([np.frombuffer(r.v, kind) for r in sums.collect()], 0)


def centre_of(passes: Passes) -> Centre:
    """Exact sums: the upper and lower bits are added apart."""

    def parts(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 20).sum(0), (x & ((1 << 20) - 1)).sum(0)])

    found = passes.sum(parts, np.int64).tolist()
    n, d = found[0], passes.d
    sums = [(hi << 20) + lo for hi, lo in zip(found[1 : d + 1], found[d + 1 :])]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(passes: Passes, centre: Centre, steps: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``V`` and the upper bidiagonal ``B`` with ``XV = UB``, after ``steps`` steps."""
    d, random = passes.d, np.random.default_rng(seed)
    v_all, b, c_all, y_all = np.zeros((d, 0)), np.zeros((steps, steps)), np.zeros((d, 0)), np.zeros((d, 0))
    v, largest = random.standard_normal(d), 0.0
    v /= np.linalg.norm(v)
    for k in range(steps):

        def first(x: np.ndarray, v=v, c=c_all) -> np.ndarray:
            x = centre.of(x)
            w = x @ v
            return np.append((x @ c).T @ w, w @ w)

        found = passes.sum(first)
        h = found[:-1]

        def second(x: np.ndarray, v=v, c=c_all, h=h) -> np.ndarray:
            x = centre.of(x)
            u = x @ c
            w = x @ v - u @ h
            return np.concatenate([u.T @ w, x.T @ w, [w @ w]])

        found = passes.sum(second)
        again, product, left = found[:k], found[k : k + d], found[-1]
        alpha = float(np.sqrt(max(0.0, left - again @ again)))
        largest = max(largest, alpha)
        v_all = np.column_stack([v_all, v])
        closed = alpha <= TINY * largest or not alpha
        b[k, k] = 0 if closed else alpha
        c_all = np.column_stack([c_all, np.zeros(d) if closed else (v - c_all @ (h + again)) / alpha])
        y_all = np.column_stack([y_all, np.zeros(d) if closed else (product - y_all @ again) / alpha])
        if k + 1 == steps:
            break
        p = _orthogonal(y_all[:, k] - b[k, k] * v, v_all)
        beta = float(np.linalg.norm(p))
        if beta <= TINY * max(largest, beta) or not beta:
            p, beta = _orthogonal(random.standard_normal(d), v_all), 0.0
        b[k, k + 1] = beta
        largest = max(largest, beta)
        v = _orthogonal(p / np.linalg.norm(p), v_all)
        v /= np.linalg.norm(v)
    return v_all, b


def fit(blocks: DataFrame, components: int = 8, steps: int | None = None) -> Whitening | None:
    """``steps``: None for as many as there are dimensions; fewer find the leading components of a steep spectrum only."""
    head = blocks.select("d").first()
    if head is None:
        return None
    passes = Passes(blocks, head.d)
    centre = centre_of(passes)
    trace = float(passes.sum(lambda x: np.array([(centre.of(x) ** 2).sum()]))[0]) / centre.n
    v, b = bidiagonalise(passes, centre, min(steps or head.d, head.d))
    _, sigma, right = np.linalg.svd(b)
    keep = min(components, int((sigma > max(head.d, 10) * TINY * sigma[0]).sum())) if sigma[0] > 0 else 0
    return Whitening(centre, (v @ right.T)[:, :keep], sigma[:keep] ** 2 / centre.n, trace)


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    passes, n, k = Passes(blocks, len(model.components)), model.centre.n, len(model.variances)
    mean = passes.sum(lambda x: model.of(x).sum(0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = model.of(x) - mean
        return (w.T @ w).ravel()

    return float(np.abs(passes.sum(products).reshape(k, k) / n - np.eye(k)).max())


def squares(x: np.ndarray, centre: Centre) -> list[int]:
    """For each row the exact sum over dimensions of ``(n * x - sum) ** 2``."""
    moved, n = x - centre.whole, centre.n
    if len(x) and (int(np.abs(moved).max()) + 1) ** 2 * n * n * x.shape[1] < 1 << 63:
        return ((moved * n - centre.rest) ** 2).sum(1).tolist()
    return ((moved.astype(object) * n - centre.rest.astype(object)) ** 2).sum(1).tolist()


def whiten(blocks: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """``id_col``, ``deviation`` (decimal, exact) and ``whitened``, a number for each component, of every row of the blocks."""
    d = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(matrices([b], 1, d)):
                w = model.of(x)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(squares(x, model.centre), pa.decimal128(38, 0)), held], names=[id_col, "deviation", "whitened"])

    kind = dict(blocks.dtypes)["ids"][6:-1]
    return blocks.select("ids", "x").mapInArrow(run, f"{id_col} {kind}, deviation decimal(38,0), whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = to_blocks(table(spark, sf_dir, "embeddings"))
    model = fit(blocks)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    rows = whiten(blocks, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(identity_error(blocks, model)).alias("identity_error"),
    )
