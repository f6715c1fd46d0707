"""Near copies by exact Jaccard similarity of word shingles, together with the SimHash links.

Two texts are linked if their sets of five-word shingles (lower-cased words, 64-bit hashes) have a Jaccard similarity of 0.8 or
more, or if their fingerprints differ in four bits or fewer. Candidates come by prefix filtering: with all shingles in
one order, two sets that similar share one of their first ``n - ceil(0.8 n) + 1``, so no pair is missed whatever
the order is. Shingles that many prefixes hold come last in it. Candidates are looked for on the hashes' upper 32 bits; the
prefix's length goes by the number of whole hashes, which makes up for shingles that share a half. Of a pair in the same posting list an upper bound of the overlap
(least counts in 128 buckets) must reach what 0.8 needs, then the same bound over buckets as many as half of the longer set; what
is left is intersected exactly, on sets that are made anew from the texts in question. A first round links each list's members
with that one whose lists hold most sets (of a group of copies the one they come from, which has all they share), a second compares only members that are in different components by then, in lists that hold several. Each set
carries the least hashes of its lists there: two sets are compared in the first list that they share as far as these tell, and not
again in others. Lists above ``LIST_LIMIT`` sets are dealt in square cells, so that any two of their sets meet in some cell.

Defined results: null, empty and blank texts have no shingles and are equal; a text of fewer than five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txcompact.llm.common import stored
from txcompact.llm.simhash import components, fingerprint, near_links

WIDTH = 5
BUCKETS = 128
#: A shingle in more prefixes than this goes last in the order; the order holds so many of them at most. Neither changes results.
FREQUENT, MOST_FREQUENT = 64, 100_000
LIST_LIMIT = 1024
#: So many least hashes of its lists a set carries; fewer make more repeated pairs, not other results.
CARRIED, NO_HASH = 16, 2**31 - 1
#: Up to so many ids of sets to be intersected are broadcast, which saves a shuffle of all sets.
MOST_ASKED = 500_000


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a UTF-8 text's shingles, ascending as signed longs."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or b"").lower().split()
    n = len(words)
    if n <= width:
        return np.array([xxh(b" ".join(words), 42)] if n else [], np.uint64).view(np.int64)
    w = np.fromiter((xxh(x, 42) for x in words), np.uint64, n)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ w[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def upper(h: np.ndarray) -> np.ndarray:
    """Distinct upper halves of hashes, ascending."""
    return np.unique((h >> 32).astype(np.int32))


def prefix_length(n):
    """So many first half hashes of a set of ``n`` shingles meet those of any set with similarity 0.8, however many of its
    shingles share a half hash: if c do, the set has n - c halves, and at least ceil(0.8 n) - c of them stand for what the sets share; the first
    of these in the order has no more than n - ceil(0.8 n) before it."""
    return n - (4 * n + 4) // 5 + 1


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, th, fp, sid, n, shingles, counts``: for each row the text's hash, its fingerprint, and its set (upper halves,
    its size, counts by bucket); equal sets have one ``sid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                texts = b.column(2).to_pylist()
                sets = [shingles(x) for x in texts]
                sizes = [len(x) for x in sets]
                fps = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
                sids = np.array([xxh(x.tobytes(), 42) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                counts = [np.bincount(x & (BUCKETS - 1), minlength=BUCKETS).clip(0, 255).astype(np.uint8).tobytes() for x in sets]
                lists = listed([upper(x) for x in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps), pa.array(sids), pa.array(sizes, pa.int32()), lists, pa.array(counts, pa.binary())], names=[id_col, "th", "fp", "sid", "n", "shingles", "counts"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(id_col, F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"{id_col} {kind}, th long, fp long, sid long, n int, shingles array<int>, counts binary")


def listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays), kind))


def postings(sets: DataFrame, last: np.ndarray) -> DataFrame:
    """``h, sid``: the prefix of each set, where the hashes of ``last`` (ascending) come after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                got = []
                for h, n in zip(b.column(1), b.column(2).to_pylist()):
                    h = h.values.to_numpy(zero_copy_only=False)
                    if len(last) and len(h):
                        late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                        h = np.r_[h[~late], h[late]] if late.any() else h
                    got.append(h[: prefix_length(n)] if len(h) else h)
                sids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in got])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got), pa.int32()), pa.array(sids, pa.int64())], names=["h", "sid"])

    return sets.where("n > 0").select("sid", "shingles", "n").mapInArrow(run, "h int, sid long")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 100_000) -> Iterator[pa.Table]:
    """Tables of sorted rows in which no group of equal first ``keys`` columns is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            rows = pa.Table.from_batches(held)
            new = _starts(rows, keys)
            cut = int(new[-1])
            held = rows.slice(cut).combine_chunks().to_batches()
            if cut:
                yield rows.slice(0, cut)
    if held:
        yield pa.Table.from_batches(held)


def _starts(rows: pa.Table, keys: int) -> np.ndarray:
    at = np.column_stack([rows.column(k).to_numpy() for k in range(keys)])
    return np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])


def shared_lists(found: DataFrame) -> DataFrame:
    """``h, sid, size, at``: posting lists of two or more sets, each set once, with the list's size and the set's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, 1):
            rows = rows.take(pa.array(_starts(rows, 2)))
            starts = _starts(rows, 1)
            sizes = np.diff(np.r_[starts, rows.num_rows])
            size, at = np.repeat(sizes, sizes), np.arange(rows.num_rows) - np.repeat(starts, sizes)
            ok = np.flatnonzero(size > 1)
            yield pa.RecordBatch.from_arrays([pa.array(rows.column(c).to_numpy()[ok]) for c in (0, 1)] + [pa.array(size[ok], pa.int32()), pa.array(at[ok], pa.int32())], names=["h", "sid", "size", "at"])

    return found.repartition("h").sortWithinPartitions("h", "sid").mapInArrow(run, "h int, sid long, size int, at int")


def _may_be_near(n: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False only where the sets of rows x and y cannot have similarity 0.8."""
    ok = 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])
    at = np.flatnonzero(ok)
    bound = np.minimum(counts[x[at]], counts[y[at]]).sum(axis=1, dtype=np.int64)
    full = counts.max(axis=1, initial=0) == 255
    ok[at] = (9 * bound >= 4 * (n[x[at]] + n[y[at]])) | full[x[at]] | full[y[at]]
    return ok


def _met_before(h: np.ndarray, least: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """True where the sets of rows x and y carry a common hash below that of the list they are in."""
    own, other = least[x], least[y]
    below = np.where(own < h[x][:, None], own, NO_HASH)
    return ((below[:, :, None] == other[:, None, :]) & (below != NO_HASH)[:, :, None]).any(axis=(1, 2))


def _stars(h: np.ndarray, sid: np.ndarray, n: np.ndarray, counts: np.ndarray, starts: np.ndarray, weight: np.ndarray, *_) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The heaviest set of each list (the least of several) with all others of it."""
    sizes = np.diff(np.r_[starts, len(h)])
    own = np.repeat(np.arange(len(starts)), sizes)
    hub = np.lexsort((sid, -weight, own))[starts]
    x, y = np.repeat(hub, sizes), np.arange(len(h))
    yield x[x != y], y[x != y]


def _across(h: np.ndarray, sid: np.ndarray, n: np.ndarray, counts: np.ndarray, starts: np.ndarray, root: np.ndarray, c: np.ndarray, mixed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each cell that are in different components."""
    held, many = [], 0
    for a, b in zip(starts, np.r_[starts[1:], len(h)]):
        if b - a > 1 and (root[a:b] != root[a]).any():
            x, y = np.triu_indices(b - a, 1)
            x, y = x + a, y + a
            ok = (root[x] != root[y]) & (~mixed[a] | (c[x] != c[y]))
            held.append((x[ok], y[ok]))
            many += int(ok.sum())
            if many > 100_000:
                yield tuple(map(np.concatenate, zip(*held)))
                held, many = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def candidates(lists: DataFrame, pick: Callable, keys: list[str], rest: list[str]) -> DataFrame:
    """``a, b``: distinct pairs that ``pick`` gives and that may be near. With a column ``least`` a pair is given by the first of its lists."""
    carried = ["least"] if "least" in lists.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, len(keys), 20_000):
            of = {name: rows.column(name).to_numpy() for name in rows.column_names if name not in ("counts", "least")}
            counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS)
            n, sid = of["n"].astype(np.int64), of["sid"]
            mixed = [of["i"] != of["j"]] if "i" in of else []
            least = rows.column("least").combine_chunks().flatten().to_numpy().reshape(-1, CARRIED) if carried else None
            found = [np.empty((0, 2), np.int64)]
            for x, y in pick(of["h"], sid, n, counts, _starts(rows, len(keys)), *[of[c] for c in rest], *mixed):
                for k in range(0, len(x), 100_000):
                    p, q = x[k : k + 100_000], y[k : k + 100_000]
                    ok = _may_be_near(n, counts, p, q)
                    p, q = p[ok], q[ok]
                    if carried:
                        parts = [slice(i, i + 10_000) for i in range(0, len(p), 10_000)]
                        again = np.concatenate([np.empty(0, bool), *[_met_before(of["h"], least, p[i], q[i]) for i in parts]])
                        p, q = p[~again], q[~again]
                    p, q = sid[p], sid[q]
                    found.append(np.column_stack([np.minimum(p, q), np.maximum(p, q)]))
                if sum(map(len, found)) > 1_000_000:
                    found = [np.unique(np.concatenate(found), axis=0)]
            ab = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])

    dealt = lists.select(*keys, "sid", "n", "counts", *rest, *carried).repartition(*keys).sortWithinPartitions(*keys, "sid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def folded(h: np.ndarray) -> np.ndarray:
    """Counts of a set by bucket, up to 255, with a power of two of buckets, about half as many as the set has members."""
    size = 1 << max(6, int(len(h) // 2).bit_length())
    return np.bincount((h >> 7) & (size - 1), minlength=size).clip(0, 255).astype(np.uint8)


def overlap_bound(x: np.ndarray, y: np.ndarray) -> float:
    """At most so many members do the sets of two ``folded`` counts share."""
    if max(x.max(), y.max()) == 255:
        return np.inf
    x, y = (a.astype(np.int64) for a in ((x, y) if len(x) <= len(y) else (y, x)))
    return float(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())


def _asked(pairs: DataFrame, docs: DataFrame, texts: DataFrame, make: Callable, kind: str, arrow: pa.DataType) -> DataFrame:
    """``sid, n, s`` for the sets of ``pairs``: what ``make`` gives of each, made once for a text and task."""
    asked = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    asked = stored(asked.join(texts, "sid"), "asked")
    asked = F.broadcast(asked) if asked.count() <= MOST_ASKED else asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                if len(seen) > 1_000_000:
                    seen.clear()
                sids = b.column(0).to_pylist()
                new = [i for i, x in enumerate(sids) if x not in seen and not seen.add(x)]
                if new:
                    sets = [shingles(t) for t in b.column(1).take(pa.array(new)).to_pylist()]
                    made = listed([make(x) for x in sets], arrow) if arrow is not None else pa.array([make(x).tobytes() for x in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in new], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), made], names=["sid", "n", "s"])

    met = docs.select(F.xxhash64("t").alias("th"), F.col("t").cast("binary").alias("t")).join(asked, "th").select("sid", "t")
    return stored(met.mapInArrow(run, f"sid long, n int, s {kind}").dropDuplicates(["sid"]), "asked-sets")


def _both(pairs: DataFrame, own: DataFrame) -> DataFrame:
    one, two = (own.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b")


def confirmed(pairs: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs whose sets have similarity 0.8 or more. ``docs.t`` are the texts, ``texts`` names the hash of one for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint8) for v in b.column(c).to_pylist()] for c in (4, 5))
            total = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            ok = np.array([9 * overlap_bound(p, q) >= 4 * n for p, q, n in zip(x, y, total)], bool)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in (0, 1)], names=["a", "b"])

    rough = _both(pairs, _asked(pairs, docs, texts, folded, "binary", None)).select("a", "b", "na", "nb", "sa", "sb")
    left = stored(rough.mapInArrow(run, "a long, b long"), "bound-pairs")
    both = _both(left, _asked(left, docs, texts, lambda x: x, "array<long>", pa.int64()))
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def jaccard_links(sets: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: links between sids with similarity 0.8 or more that connect all that can be connected."""
    often = postings(sets, np.empty(0, np.int32)).groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > FREQUENT).orderBy(F.desc("k"), "h").limit(MOST_FREQUENT)
    last = np.sort(np.array([r.h for r in often.collect()], np.int32))
    lists = stored(shared_lists(postings(sets, last)), "shared-lists")
    facts = stored(sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("counts").alias("counts")), "set-facts")
    least = F.slice(F.array_sort(F.concat(F.collect_list("h"), F.array_repeat(F.lit(NO_HASH), CARRIED))), 1, CARRIED)
    weights = stored(lists.groupBy("sid").agg(F.sum("size").alias("weight"), least.alias("least")).join(facts, "sid"), "weights")
    lists = stored(lists.join(weights.drop("least"), "sid"), "posting-lists")
    first = stored(confirmed(stored(candidates(lists, _stars, ["h"], ["weight"]), "star-pairs"), docs, texts), "star-links")
    roots = components(first).select(F.col("node").alias("sid"), "root")
    cells = F.when(F.col("size") > LIST_LIMIT, F.ceil(F.col("size") * 2 / LIST_LIMIT)).otherwise(F.lit(1)).cast("int")
    rooted = stored(lists.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted-lists")
    several = rooted.groupBy("h").agg(F.min("root").alias("one"), F.max("root").alias("two")).where("one <> two").select("h")
    placed = (
        rooted.join(several, "h", "left_semi")
        .join(weights.select("sid", "least"), "sid")
        .withColumn("m", cells)
        .withColumn("c", F.col("at") % F.col("m"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .withColumn("i", F.least("c", "x"))
        .withColumn("j", F.greatest("c", "x"))
    )
    second = confirmed(stored(candidates(placed, _across, ["h", "i", "j"], ["root", "c"]), "cross-pairs"), docs, texts)
    return first.unionByName(stored(second, "cross-links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of near copies one row: that with the least id, nulls last. Of rows equal in id and text one stays, the first
    by its other columns written as JSON; these may have any names and types. An empty table gives no rows."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    docs, columns = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.struct(*rest).alias("_rest") if rest else F.struct(F.lit(0).alias("none")).alias("_rest")), docs.columns
    sets = stored(prints(docs, "_i", "_t"), "near-prints")
    by_print = stored(sets.groupBy("fp").agg(F.min("sid").alias("rep")), "distinct-prints")
    ends = [by_print.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}")) for x in "ab"]
    by_bits = near_links(by_print.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    same_print = sets.select("fp", "sid").distinct().join(by_print, "fp").select(F.col("sid").alias("a"), F.col("rep").alias("b"))
    texts = stored(sets.groupBy("sid").agg(F.min("th").alias("th")), "set-texts")
    links = jaccard_links(sets, docs.select(F.col("_t").alias("t")), texts)
    roots = components(links.unionByName(by_bits).unionByName(same_print)).select(F.col("node").alias("sid"), "root")
    rows = sets.groupBy("sid", F.col("_i").alias("_id"), F.col("th").alias("_th")).agg(F.count(F.lit(1)).alias("_rows"))
    least = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_th", "_rows")).alias("x")
    stay = stored(rows.join(roots, "sid", "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(least).select("x._id", "x._th", "x._rows"), "kept-rows")
    met = docs.join(stay, F.col("_i").eqNullSafe(F.col("_id")) & (F.xxhash64("_t") == F.col("_th")))
    again = met.where("_rows > 1").groupBy("_id", "_th").agg(F.min_by(F.struct("_i", "_t", "_rest"), F.to_json("_rest")).alias("x")).select("x.*")
    kept = met.where("_rows = 1").select("_i", "_t", "_rest").unionByName(again)
    return kept.select(*[F.col("_i").alias(c) if c == id_col else F.col("_t").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in columns])
