"""What the two classifiers share: the bounded sample they are fitted on, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txcompact.llm.common import in_bucket, stored

#: Most labelled rows that a classifier is fitted on (half of each class, where there are as many), and most
#: characters in all of them. Texts are never cut. Scoring knows no such bounds.
FIT_ROWS = 8000
FIT_CHARS = 32_000_000


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, chars: int = FIT_CHARS, extra: tuple[str, ...] = ()) -> tuple[list, dict[int, int]]:
    """Rows ``text, label, *extra`` to fit on, in a fixed order, and the rows of each class that there are to learn from.

    Learns only from ids whose crc32 modulo 5 is not 0. Ids are drawn by a hash; only the drawn ids, at most
    ``rows`` of them, are broadcast to find their texts. Null labels are left out; of several labels of an id the greatest counts,
    and of several rows of an id the one with the greatest text (null: empty), so that no more rows than ids reach the driver. Of these
    rows, in a fixed order that knows no lengths, those are taken before the first that does not fit in ``chars`` characters together; of
    each class the shortest always is."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (in_bucket("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(label).alias("_label"))
    sizes = {int(r[0]): r[1] for r in known.groupBy("_label").count().collect()}
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("_label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        drawn = part if drawn is None else drawn.union(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).join(F.broadcast(drawn), "doc_id")
    each = found.groupBy("doc_id").agg(F.max(F.struct("text", "_label", *extra)).alias("_row"))
    each = stored(each.select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("_o"), "_row.*"), "fit-sample")
    taken = within(each.select("doc_id", "_o", "_label", F.length("text").alias("n")).collect(), chars)
    got = each.join(F.broadcast(each.sparkSession.createDataFrame([(i,) for i in taken], "doc_id long")), "doc_id").select("_o", "text", "_label", *extra).collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return [(r[1], int(r[2]), *r[3:]) for r in got], sizes


def within(rows: list, chars: int) -> list[int]:
    """Ids of ``rows`` (id, place in the order, label, length) before the first that goes beyond ``chars`` characters together, and each
    class's shortest. Shorter ones behind it are not taken, as a sample that prefers them would be one of short texts."""
    shortest = {r[2]: r for r in sorted(rows, key=lambda r: (-r[3], r[0]))}
    taken, total = {r[0] for r in shortest.values()}, sum(r[3] for r in shortest.values())
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[0] in taken:
            continue
        if total + r[3] > chars:
            break
        taken.add(r[0])
        total += r[3]
    return sorted(taken)


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """``a, b`` such that sigmoid(a * raw + b) is the probability of label 1, by Newton's method with a little shrinkage."""
    a, b = 1.0, 0.0
    if not len(raw):
        return a, b
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        e, v = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(e * raw).sum() + 1e-3 * (a - 1), e.sum()])
        h = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-7:
            break
    return float(a), float(b)


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights that give the sample's classes their shares of all labelled rows."""
    total = max(1, sum(sizes.values()))
    share = np.array([sizes.get(0, 0) / total, sizes.get(1, 0) / total])
    have = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    return (share / have * len(y))[y]
