"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txcompact.llm import queries, whitening


def plain(rows, components=8):
    """rows: (id, list) -> n, deviations by row, variances, components, explained."""
    x = np.array([[math.floor(1024 * float(np.float64(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    centred = np.array([[float(c * n - s) / n for c, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, deviation, values[:components], centred @ vectors[:, :components] / np.sqrt(np.maximum(values[:components], 1e-300)), values[:components] / values.sum()


def test_query_matches_plain(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n, deviation, values, white, explained = plain(rows)
    got = queries.QUERIES["op11_whitening"](spark, sf_dir).collect()
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    for j in range(8):
        mine = np.array([by[i, j + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, j])
        assert np.abs(mine * sign - white[:, j]).max() < 1e-8
        assert by[rows[0][0], j + 1].explained == pytest.approx(explained[j], rel=1e-10)
    assert all(by[i, 1].deviation == d for (i, _), d in zip(rows, deviation))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).withColumn("x", F.lit(2)).withColumn("d", F.lit(3))


def test_odd_rows_are_left_out_and_ties_found(spark, monkeypatch):
    rng = np.random.default_rng(2)
    good = [(i, v.tolist()) for i, v in enumerate(np.concatenate([np.eye(6) * 3, -np.eye(6) * 3, np.eye(6) * 3]))]  # five equal variances
    good += [(None, [1.0] * 6), (3, [0.5] * 6), (3, [0.5] * 6)]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (53, [float("nan")] * 6), (54, [float("inf"), *[0.0] * 5]), (55, [1.0, 2.0])]
    for few in (whitening.FEW, 1):
        monkeypatch.setattr(whitening, "FEW", few)
        blocks = whitening.to_blocks(frame(spark, good + bad).repartition(5))
        model = whitening.fit(blocks)
        n, deviation, values, _, explained = plain(good, 6)
        assert model.centre.n == n and np.allclose(model.variances, values, rtol=1e-10)
        assert np.allclose(model.components.T @ model.components, np.eye(6), atol=1e-12)
        assert whitening.identity_error(blocks, model) < 1e-10
        got = whitening.whiten(blocks, model).collect()
        assert sorted(int(r.deviation) for r in got) == sorted(deviation) and len(got) == len(good)
    big = [(i, (rng.standard_normal(3) * 1e9).tolist()) for i in range(40)]
    blocks = whitening.to_blocks(frame(spark, big))
    got = whitening.whiten(blocks, whitening.fit(blocks)).collect()
    assert sorted(int(r.deviation) for r in got) == sorted(plain(big, 3)[1])


def test_flat_tables_have_no_components(spark):
    for rows in ([(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], []):
        blocks = whitening.to_blocks(frame(spark, rows))
        model = whitening.fit(blocks)
        assert model is None or not len(model.variances)
    line = whitening.fit(whitening.to_blocks(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(50)])))
    assert line.components.shape == (3, 1) and np.allclose(np.abs(line.components[:, 0]), np.array([1, 2, 0]) / 5**0.5)
