"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams.

Valid vectors are dealt by a hash of their id to shards of about ``shard_rows`` rows; of exactly equal
vectors of a shard only the ``k + 1`` least ids are needed and kept. In a shard, points join the graph in
random order in batches that double: a greedy beam search over the graph so far proposes neighbours, and
relaxed distance pruning keeps a neighbour only if no kept one is closer to it by the factor ``alpha``, so
that edges stay diverse. Kept edges also go back, and full nodes are pruned again. Every query searches each
shard by a beam from several entry points; cosines of what it finds are worked out on the original vectors
in double precision, and the best of all shards stay.

The graphs are stored, a row for each shard; queries meet them in blocks, each block once for each shard, joined and
dealt by shard and block, so that no key and no task holds the index. Every shard is searched for every query: on vectors
without clusters, near ones lie in all parts of space, and asking few parts only would miss them.

Defined results: null, zero and non-finite vectors, vectors with null components, and rows without an id take
no part; vectors of different lengths are never neighbours; of repeated ids each row is a candidate, an id appears once with
its best score, and the answer to a repeated query id is for all its vectors together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txcompact.llm.common import stored, table


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest points found (-1: none) and their squared distances, nearest first. All unit vectors."""
    m = len(queries)
    ids = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf)
    seen = np.zeros((m, beam), bool)
    start = entries[:beam]
    ids[:, : len(start)] = start
    dist[:, : len(start)] = 2 - 2 * queries @ x[start].T
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    active = np.arange(m)
    while len(active):
        open_ = ~seen[active] & (ids[active] >= 0)
        has = open_.any(axis=1)
        active, at = active[has], open_[has].argmax(axis=1)
        if not len(active):
            break
        seen[active, at] = True
        near = graph[ids[active, at]]
        known = (near[:, :, None] == ids[active][:, None, :]).any(axis=2) | (near < 0)
        d = 2 - 2 * np.einsum("mrd,md->mr", x[near], queries[active])
        d[known] = np.inf
        better = (d < dist[active, -1][:, None]).any(axis=1)
        if not better.any():
            continue
        rows, near, d = active[better], near[better], d[better]
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], np.where(np.isfinite(d), near, -1)], axis=1)
        all_s = np.concatenate([seen[rows], np.zeros(d.shape, bool)], axis=1)
        top = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[rows], dist[rows], seen[rows] = (np.take_along_axis(a, top, 1) for a in (all_i, all_d, all_s))
    return ids, dist


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each of ``own`` from its row of ``cand`` (-1: none, no repeats but -1)."""
    m, c = cand.shape
    vec = x[cand]
    d = 2 - 2 * np.einsum("mcd,md->mc", vec, x[own])
    d[(cand < 0) | (cand == own[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    vec = np.take_along_axis(vec, order[:, :, None], 1)
    between = 2 - 2 * vec @ vec.transpose(0, 2, 1)
    alive = np.isfinite(d)
    out = np.full((m, degree), -1)
    rows = np.arange(m)
    for k in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        first = alive.argmax(axis=1)
        out[has, k] = cand[rows, first][has]
        alive[rows, first] = False
        alive &= ~((alpha * alpha * np.maximum(between[rows, first], 0) <= d) & has[:, None])
    return out


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 48, alpha: float = 1.2, batch: int = 256, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists (-1: none) and entry points for unit vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    graph = np.full((n, degree), -1)
    count = np.zeros(n, np.int64)
    entries = order[: min(n, 8)]
    done = len(entries)
    for p in entries:
        others = entries[entries != p][:degree]
        graph[p, : len(others)] = others
        count[p] = len(others)
    while done < n:
        part = order[done : done + min(batch, max(1, done))]
        done += len(part)
        found, _ = beam_search(x, graph, entries, x[part], beam)
        graph[part] = robust_prune(x, part, found, degree, alpha)
        count[part] = (graph[part] >= 0).sum(axis=1)
        src = np.repeat(part, degree)
        dst = graph[part].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        while len(dst):  # at most ``degree`` new edges for each node at a time
            first = np.r_[True, dst[1:] != dst[:-1]]
            nth = np.arange(len(dst)) - np.maximum.accumulate(np.where(first, np.arange(len(dst)), 0))
            now = nth < degree
            nodes, where = np.unique(dst[now], return_inverse=True)
            more = np.full((len(nodes), degree), -1)
            more[where, nth[now]] = src[now]
            fits = count[nodes] + (more >= 0).sum(axis=1) <= degree
            for v, extra in zip(nodes[fits], more[fits]):
                extra = extra[extra >= 0]
                graph[v, count[v] : count[v] + len(extra)] = extra
                count[v] += len(extra)
            full = nodes[~fits]
            for k in range(0, len(full), batch):
                some = full[k : k + batch]
                cand = np.concatenate([graph[some], more[~fits][k : k + batch]], axis=1)
                graph[some] = robust_prune(x, some, cand, degree, alpha)
                count[some] = (graph[some] >= 0).sum(axis=1)
            src, dst = src[~now], dst[~now]
    return graph, entries


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def tasks_for(spark: SparkSession, groups: int) -> int:
    """Partitions for work on so many groups, each of which takes long: one for each, within a few waves of the session's partitions."""
    return max(1, min(groups, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def build_index(valid: DataFrame, k: int, shard_rows: int, degree: int, beam: int, alpha: float) -> DataFrame:
    """Stored: a row for each shard and vector length with packed ids, vectors, neighbours and entries."""
    shards = max(1, -(-valid.count() // shard_rows))
    placed = valid.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("width", F.size("v"))
    nth = F.row_number().over(Window.partitionBy("shard", "v").orderBy("vec_id"))
    few = placed.withColumn("_n", nth).where(F.col("_n") <= k + 1)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        v = np.stack(rows["v"].to_list())
        same: dict[bytes, list[int]] = {}
        for i, key in enumerate(v.view(np.uint8).reshape(len(v), -1)):
            same.setdefault(key.tobytes(), []).append(i)
        point = np.zeros(len(v), np.int64)
        for p, members in enumerate(same.values()):
            point[members] = p
        x = unit(v[[m[0] for m in same.values()]])
        graph, entries = build_graph(x, degree, beam, alpha)
        return pd.DataFrame(
            {"shard": [rows["shard"].iloc[0]], "width": [rows["width"].iloc[0]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "point": [point.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entries": [entries.astype(np.int64).tobytes()]}
        )

    dealt = few.drop("_n").repartition(tasks_for(valid.sparkSession, shards), "shard", "width")
    return stored(dealt.groupBy("shard", "width").applyInPandas(run, "shard int, width int, ids binary, vectors binary, point binary, graph binary, entries binary"), "ann-index")


def nearest(vectors: DataFrame, query_filter: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, degree: int = 40, build_beam: int = 64, beam: int = 192, alpha: float = 1.2, block_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each valid row that ``query_filter`` (SQL over ``vec_id``) picks, its ``k`` nearest others."""
    spark = vectors.sparkSession
    valid = valid_vectors(vectors, id_col, vector_col)
    index = build_index(valid, k, shard_rows, degree, build_beam, alpha)
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    queries = valid.where(query_filter).distinct()
    blocks = max(1, -(-queries.count() // block_rows))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, part in rows.groupby(rows["v"].map(len)):
            out.append({"block": int(part["block"].iloc[0]), "width": int(width), "q_ids": part["vec_id"].to_numpy(np.int64).tobytes(), "q_vectors": np.stack(part["v"].to_list()).tobytes()})
        return pd.DataFrame(out)

    asked = stored(asked.groupBy("block").applyInPandas(packed, "block int, width int, q_ids binary, q_vectors binary"), "ann-queries")

    def search(graphs: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for r in graphs.itertuples(index=False):
            for asks in questions.itertuples(index=False):
                ids, point = np.frombuffer(r.ids, np.int64), np.frombuffer(r.point, np.int64)
                v = np.frombuffer(r.vectors, np.float64).reshape(len(ids), r.width)
                q_ids = np.frombuffer(asks.q_ids, np.int64)
                q = np.frombuffer(asks.q_vectors, np.float64).reshape(len(q_ids), r.width)
                members = np.argsort(point, kind="stable")
                first = np.searchsorted(point[members], np.arange(point.max() + 2))
                x = unit(v[members[first[:-1]]])
                graph = np.frombuffer(r.graph, np.int32).reshape(len(x), -1).astype(np.int64)
                entries = np.frombuffer(r.entries, np.int64)
                norms = np.linalg.norm(v, axis=1)
                for a in range(0, len(q), 256):
                    near, _ = beam_search(x, graph, entries, unit(q[a : a + 256]), beam)
                    for qi, row in zip(range(a, a + len(near)), near):
                        row = row[row >= 0][: 4 * (k + 1)]
                        rows_of = np.concatenate([members[first[p] : first[p + 1]] for p in row])
                        rows_of = rows_of[ids[rows_of] != q_ids[qi]]
                        cos = (v[rows_of] @ q[qi]) / (norms[rows_of] * np.linalg.norm(q[qi]))
                        best = np.lexsort((ids[rows_of], -cos))[:k]
                        out.append(pd.DataFrame({"query_id": q_ids[qi], "vec_id": ids[rows_of[best]], "score": cos[best]}))
        return pd.concat(out)

    key = ["shard", "width", "block"]
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    sides = index.select("*", each("block", blocks)), asked.select("*", each("shard", shards))
    one, two = (df.repartition(tasks_for(spark, shards * blocks), *key).groupBy(*key) for df in sides)
    found = one.cogroup(two).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 50 = 0")
