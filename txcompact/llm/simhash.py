"""SimHash near-dedup: 64-bit fingerprints linked by a Gray-order hierarchical index.

Fingerprints: bit majority over the XXH64 values of a text's word shingles. Distinct fingerprints are
joined for Hamming distance ``d`` as follows. Cut into ``b`` blocks (``d + 1``, and more the more rows there
are), two near fingerprints agree on at least ``b - d`` of them, so each fingerprint is dealt once for every
choice of so many blocks to the group with the same bits there. In a group rows stand in Gray-code order, where
neighbours share long patterns. Over runs of rows, leaves and upper nodes hold the bits that all rows
below share; a node keeps only the bits that its parent does not hold yet. A search adds up differing
bits from the top on and drops a whole node as soon as they exceed ``d``. Groups above ``group_limit``
rows are dealt in square cells, so that any two of their rows meet in some cell and no task holds a
group whole. Each cell returns the links of a spanning forest (a link for a row at most), not all pairs.
Components come from rounds of contraction, each written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; ties
of a bit (exactly half) give 0; repeated rows share fingerprint and component; rows with a null id take
part, but a component's id is the least non-null id in it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm.common import stored, table

FANOUT = 16


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of a UTF-8 text."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or b"").lower().split()
    n = len(words)
    if n <= width:
        return xxh(b" ".join(words), seed) if n else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = [0, *(ends[: n - width] + 1).tolist()]
    ends = ends[width - 1 :].tolist()
    counts, total = np.zeros(64, np.int64), n - width + 1
    for k in range(0, total, 65536):
        h = np.array([xxh(joined[a:b], seed) for a, b in zip(begins[k : k + 65536], ends[k : k + 65536])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id_col, fp`` (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"{id_col} {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _joined(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the rows a[i] and b[i]; ``lab`` holds the least row of each component."""
    while True:
        x, y = lab[a], lab[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while (up := lab[lab]).tobytes() != lab.tobytes():
            lab[:] = up


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, last): the range's number and each member."""
    n = last - first
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]


def linked_in_groups(group: np.ndarray, fp: np.ndarray, distance: int, block_pairs: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of each group's rows within ``distance``. Rows come with equal groups together."""
    order = np.lexsort((gray_rank(fp), group))
    group, fp = group[order], fp[order]
    n = len(fp)
    # Levels from the rows up: starts of the runs below each node, their shared bits, and the group's own node on top.
    starts, ands, ors, groups, levels = np.arange(n), fp, fp, group, []
    while True:
        new = np.r_[True, groups[1:] != groups[:-1]]
        inside = np.arange(len(groups)) - np.maximum.accumulate(np.where(new, np.arange(len(groups)), 0))
        at = np.flatnonzero(inside % FANOUT == 0)
        done = len(at) == int(new.sum())
        ands, ors = np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at)
        levels.append((at, np.r_[at[1:], len(groups)], ands, ~(ands ^ ors)))
        groups = groups[at]
        if done:
            break
    top = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    size = np.bincount(top)
    lab = np.arange(n)
    cost = np.cumsum(size[top])
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + block_pairs, "right")))
        q, node = np.arange(begin, min(end, n)), top[begin:end]
        above = levels[-1][3][node]
        sofar = np.bitwise_count((fp[q] ^ levels[-1][2][node]) & above).astype(np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            first, last, _, _ = levels[depth]
            own, child = _spread(first[node], last[node])
            q, sofar, above = q[own], sofar[own], above[own]
            pattern, mask = (fp[child], ~np.uint64(0)) if depth == 0 else (levels[depth - 1][2][child], levels[depth - 1][3][child])
            sofar = sofar + np.bitwise_count((fp[q] ^ pattern) & mask & ~above)
            ok = sofar <= distance
            if depth == 0:
                ok &= q < child
            q, sofar, node = q[ok], sofar[ok], child[ok]
            above = (above | mask)[ok] if depth else above[ok]
        _joined(lab, q, node)
        begin = end
    rest = np.flatnonzero(lab != np.arange(n))
    return fp[rest], fp[lab[rest]]


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks such that two codes within ``distance`` agree on all bits of at least one."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def blocks_for(n: int, distance: int, group: int = 512) -> int:
    """The least number of blocks whose groups would hold ``group`` of ``n`` evenly spread fingerprints or fewer."""
    blocks = distance + 1
    while n / 2 ** (64 * (blocks - distance) / blocks) > group and blocks < 2 * distance + 2:
        blocks += 1
    return blocks


def near_links(fps: DataFrame, distance: int = 4, group_limit: int = 4096, blocks: int | None = None) -> DataFrame:
    """``a, b``: links within ``distance`` between the distinct longs of ``fps.fp`` that connect all that can be connected."""
    masks = block_masks(distance, blocks or blocks_for(fps.count(), distance))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    hot = stored(dealt.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit), "hot-groups")
    cells = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) * 2 / group_limit)).cast("int")
    placed = (
        dealt.join(hot, ["choice", "key"], "left")
        .withColumn("m", cells)
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("choice", "key", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            change = np.r_[False, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]
            a, b = linked_in_groups(np.cumsum(change), rows[:, 4].view(np.uint64).copy(), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(map(len, held)) >= 200_000:  # all but the last group, which may go on
                rows = np.concatenate(held)
                cut = int(np.flatnonzero((rows[:, :4] == rows[-1, :4]).all(axis=1))[0])
                held = [rows[cut:]]
                if cut:
                    yield links(rows[:cut])
        if held:
            yield links(np.concatenate(held))

    return placed.repartition("choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``.

    In each round a node points to that one of its neighbours and itself which stands first in an order drawn anew, pointers are
    followed once more, and the graph is contracted to what they lead to. As the order is a new one each time, chains of any
    order shrink by a constant factor a round, so the rounds grow with the logarithm of the nodes."""
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mapping, turn = None, 0
    while edges.take(1):
        turn += 1
        draw = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(draw("b")).alias("m")).select("node", F.least(draw("node"), F.col("m"))["to"].alias("root")), "step")
        step = stored(step.join(step.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root")), "step")
        one = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(edges.join(one, "a").join(two, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if mapping is None:
            mapping = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            mapping = stored(mapping.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "mapping")
    return mapping if mapping is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``id_col, fp, component_id``: the least id reachable over links of at most ``distance`` differing bits."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "prints")
    least = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-prints")
    roots = components(near_links(least.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = stored(least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
