"""Best-fit packing of texts into sequences of a fixed capacity, under conflicts.

Texts are cut into pieces of at most ``capacity`` units; pieces are dealt by a hash to shards of about
``shard_rows`` pieces, and each shard packs its own, longest first (ties by id, then piece). Bins are kept
ordered by residual. A bin carries bitmaps: one of the duplicate clusters in it, and for sources one for
each occurrence up to ``per_source``, so that a bin takes a cluster once and a source ``per_source`` times at
most. The search takes the successor of the piece's length among the residuals and goes on to the next
larger one until a compatible bin is found; without one it opens a bin.

Only id, length, source and cluster are shuffled, by hash: a source or a cluster that holds a third of all
rows is spread over all shards, and every piece is packed. Repeated rows are counted first and dealt one by one,
so that rows which share one id, or have none, are spread too.

Clusters are equal texts here (``packable``); any other duplicate clusters may be given to ``pack``.

Defined results: ids are kept as they are, null ids too; an empty or null text is one piece of length 0 (it fits any compatible bin); null sources are
one source; the pieces of a text share its cluster, so they lie in different bins; repeated rows are copies of
one cluster and each is packed; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm.common import ascii_lower, stored, table


class Bins:
    """Open bins by residual, each with its conflict bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.fill: list[tuple[int, int]] = []  # used units and pieces

    def put(self, length: int, cluster: int, source: int) -> tuple[int, int, int]:
        """Bin, place and offset of a piece. ``cluster`` and ``source`` are single bits; cluster 0 has no conflict."""
        i = bisect_left(self.order, (length, -1))
        while i < len(self.order):
            residual, b = self.order[i]
            if not self.clusters[b] & cluster and not self.sources[b][-1] & source:
                del self.order[i]
                break
            i += 1
        else:
            b, residual = len(self.fill), self.capacity
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
            self.fill.append((0, 0))
        self.clusters[b] |= cluster
        planes = self.sources[b]
        for k in range(self.per_source):
            if not planes[k] & source:
                planes[k] |= source
                break
        offset, place = self.fill[b]
        self.fill[b] = (offset + length, place + 1)
        insort(self.order, (residual - length, b))
        return b, place, offset


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """``rows`` (id, piece, length, source, cluster) with ``bin, place, offset``."""
    rows = rows.sort_values(["length", "id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    source, _ = pd.factorize(rows["source"], use_na_sentinel=False)
    cluster, names = pd.factorize(rows["cluster"], use_na_sentinel=False)
    twice = np.bincount(cluster, minlength=len(names)) > 1
    bit = np.cumsum(twice) - 1
    bins = Bins(capacity, per_source)
    put = [bins.put(n, 1 << int(bit[c]) if twice[c] else 0, 1 << int(s)) for n, c, s in zip(rows["length"].tolist(), cluster, source)]
    return rows.assign(bin=[p[0] for p in put], place=[p[1] for p in put], offset=[p[2] for p in put])


def pack(items: DataFrame, capacity: int, per_source: int = 4, shard_rows: int = 4096) -> DataFrame:
    """``items``: ``id long, length long, source string, cluster long``. Returns a row for each piece: ``id, piece, start,
    length, bin_id, place, offset``; ``bin_id`` is the shard times 2^32 plus the shard's bin."""
    counted = items.groupBy("id", "source", "cluster", "length").agg(F.count(F.lit(1)).alias("rows"))
    counted = stored(counted.withColumn("length", F.coalesce("length", F.lit(0)).cast("long")), "packable")
    piece_count = F.greatest(F.lit(1), F.ceil(F.col("length") / capacity))
    total = counted.agg(F.coalesce(F.sum(piece_count * F.col("rows")), F.lit(0))).first()[0]
    each = counted.select("id", "source", "cluster", "length", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"))
    pieces = each.select(
        "id",
        "source",
        "cluster",
        "copy",
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("length") / capacity) - 1))).alias("piece"),
    ).withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("piece") * capacity))
    shards = max(1, -(-int(total) // shard_rows))
    # pandas has no null in a column of longs: null ids are named by a column of their own.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "cluster", "copy"), F.lit(shards))).withColumn("no_id", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0).cast("long"))).withColumn("cluster", F.coalesce("cluster", F.lit(0).cast("long")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(rows, capacity, per_source)
        return pd.DataFrame(
            {"id": out["id"], "no_id": out["no_id"], "piece": out["piece"], "start": out["piece"] * capacity, "length": out["length"], "bin_id": out["shard"] * (1 << 32) + out["bin"], "place": out["place"], "offset": out["offset"]}
        )

    packed = dealt.groupBy("shard").applyInPandas(run, "id long, no_id boolean, piece long, start long, length long, bin_id long, place long, offset long")
    return packed.withColumn("id", F.when(~F.col("no_id"), F.col("id"))).drop("no_id")


def packable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Length in words, source, and the cluster of equal texts (A-Z lower-cased, runs of blanks as one)."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text_col, F.lit(""))), r"[ \t-\r]+"), "")
    return docs.select(F.col(id_col).alias("id"), F.size(words).cast("long").alias("length"), F.col(source_col).cast("string").alias("source"), F.xxhash64(words).alias("cluster"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pack(packable(docs), 4096).withColumnRenamed("id", "doc_id")
