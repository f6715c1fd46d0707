"""LM scoring by prediction by partial matching over bytes.

A text is its lower-cased words, each followed by a space, the last by a newline, which ends the text.
The pretrained model is a trie of byte contexts of up to ``order`` bytes with counts over all training
texts, counted by Spark as (context, byte) grams. The probability of a byte is looked for in the longest
known context; a byte new there costs an escape (method C: as likely as the number of different bytes
seen), and the next shorter context leaves out the bytes already excluded. As all bytes of a longer
context are also seen in the shorter one, what an exclusion leaves is a fixed number for each trie node,
so a gram's code length is worked out once and looked up in a hash table by every position that needs it.

The trie is broadcast while it has at most ``node_limit`` grams. Beyond, the last two bytes of the context are
dealt, by their measured numbers of grams, to shards of at most that limit; one pair of bytes may exceed it alone, by what
``order - 2`` bytes and the next one can spell, whatever the corpus' size. Tasks then build the shards' tries and answer what they are
asked: texts go in chunks of some megabytes, each asks every shard once for its different grams, and the answers
meet the chunk again. So all shards take one pass, and what is shuffled grows with the texts alone. Both
ways are exact. ``adaptive_log10`` instead starts from nothing and learns along each text.

The unigram base score needs the corpus count of every token: counts of the frequent tokens (a bounded
number) are broadcast, all others are joined by a shuffle.

Defined results: null and empty texts are the end alone; with no training texts all bytes are equally
likely; repeated rows score alike and all count in training; a null id counts as the empty text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from txcompact.llm.common import in_bucket, stored, table

END = b"\n"
MULT = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def codes_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of ``order`` context bytes and the byte itself (lowest) at all places of normalised texts, with
    each text's first and last place. A text's first contexts are filled with ends."""
    pad = END * order
    buf = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts]) + order
    last = np.cumsum(sizes)
    code = buf.copy()
    for j in range(1, order + 1):
        code[j:] |= buf[:-j] << np.uint64(8 * j)
    return code, last - sizes + order, last


def below(k: int) -> np.uint64:
    """Mask of the grams of order ``k``."""
    return np.uint64((1 << (8 * (k + 1))) - 1)


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in sorted ``keys``; -1: not there."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


@dataclass
class Trie:
    """Static PPM trie. Lists by order: sorted grams, their counts, sorted contexts, their totals and numbers of
    different bytes, and what is left of the next shorter context without this one's bytes."""

    order: int
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    left: list[np.ndarray]
    slots: np.ndarray
    values: np.ndarray
    dealt: np.ndarray | None = None  #: the shard of each pair of bytes; None: one shard holds all
    shard: int = 0

    @staticmethod
    def build(top: np.ndarray, n: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None, dealt: np.ndarray | None = None, shard: int = 0) -> Trie:
        """``top``: sorted grams of the highest order with counts; ``low``: grams of order 1 over all shards."""
        grams, counts = [], []
        for k in range(order + 1):
            g, c = low if low is not None and k <= 1 else (top, n)
            u, inv = np.unique(g & below(k), return_inverse=True)
            grams.append(u)
            counts.append(np.bincount(inv, c, len(u)))
        contexts, totals, kinds, left = [], [], [], []
        for k in range(order + 1):
            c = grams[k] >> np.uint64(8)
            at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
            contexts.append(c[at])
            totals.append(np.add.reduceat(counts[k], at) if len(at) else np.zeros(0))
            kinds.append(np.diff(np.r_[at, len(c)]).astype(float))
            if k and len(at):
                parents = counts[k - 1][find(grams[k - 1], grams[k] & below(k - 1))]
                up = find(contexts[k - 1], c[at] & (below(k - 2) if k > 1 else np.uint64(0)))
                rest = totals[k - 1][up] - np.add.reduceat(parents, at)
                fresh = kinds[k - 1][up] - kinds[k]
                left.append(np.stack([rest + fresh, fresh]))
            else:
                left.append(np.zeros((2, len(at))))
        bits = max(4, int(2 * len(top)).bit_length())
        trie = Trie(order, grams, counts, contexts, totals, kinds, left, np.full(1 << bits, EMPTY), np.zeros(1 << bits), dealt, shard)
        values = trie.walk(top)
        slot, todo = trie._slot(top), np.arange(len(top))
        while len(todo):
            free = trie.slots[slot[todo]] == EMPTY
            take = todo[free]
            _, first = np.unique(slot[take], return_index=True)
            take = take[first]
            trie.slots[slot[take]], trie.values[slot[take]] = top[take], values[take]
            todo = todo[trie.slots[slot[todo]] != top[todo]]
            slot[todo] = (slot[todo] + 1) & (len(trie.slots) - 1)
        return trie

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code * MULT) >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def walk(self, code: np.ndarray) -> np.ndarray:
        """log10 probabilities of grams, by going down from the longest known context."""
        out, open_, came = np.zeros(len(code)), np.ones(len(code), bool), np.full(len(code), -1)
        for k in range(self.order, -1, -1):
            idx = np.flatnonzero(open_)
            if not len(idx):
                break
            g = code[idx] & below(k)
            node, gram = find(self.contexts[k], g >> np.uint64(8)), find(self.grams[k], g)
            entered = came[idx] >= 0
            if k < self.order and len(self.contexts[k + 1]):
                den = np.where(entered, self.left[k + 1][0][came[idx]], 0)
                fresh = np.where(entered, self.left[k + 1][1][came[idx]], 0)
            else:
                den = fresh = np.zeros(len(idx))
            if len(self.contexts[k]):
                den = np.where(entered, den, np.where(node >= 0, self.totals[k][node] + self.kinds[k][node], 0))
                fresh = np.where(entered, fresh, np.where(node >= 0, self.kinds[k][node], 0))
            hit = gram >= 0
            if hit.any():
                out[idx[hit]] += np.log10(self.counts[k][gram[hit]] / den[hit])
            escape = ~hit & (den > 0)
            out[idx[escape]] += np.log10(fresh[escape] / den[escape])
            came[idx] = node
            open_[idx[hit]] = False
        seen = self.kinds[0][0] if len(self.kinds[0]) else 0
        out[open_] -= math.log10(max(1.0, 256 - seen))
        return out

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probabilities; 0 where another shard has the position."""
        slot = self._slot(code)
        out = self.values[slot]
        key = self.slots[slot]
        miss = np.flatnonzero(key != code)
        lost = []
        while len(miss):
            gone = key[miss] == EMPTY
            lost.append(miss[gone])
            miss = miss[~gone]
            slot[miss] = (slot[miss] + 1) & (len(self.slots) - 1)
            key[miss] = self.slots[slot[miss]]
            found = key[miss] == code[miss]
            out[miss[found]] = self.values[slot[miss[found]]]
            miss = miss[~found]
        if lost and len(lost := np.concatenate(lost)):
            if self.dealt is not None:
                out[lost] = 0
                lost = lost[self.dealt[pair_of(code[lost])] == self.shard]
            u, inv = np.unique(code[lost], return_inverse=True)
            out[lost] = self.walk(u)[inv]
        return out


def pair_of(code: np.ndarray) -> np.ndarray:
    """The last two bytes of the context."""
    return ((code >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)


def deal_pairs(sizes: dict[int, int], limit: int) -> np.ndarray:
    """A shard for each pair of bytes, such that none but a single pair's exceeds ``limit`` grams: largest first, into the emptiest that has room."""
    dealt, loads = np.zeros(1 << 16, np.int32), []
    for pair, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if loads and loads[0][0] + n <= limit:
            load, shard = heappop(loads)
        else:
            load, shard = 0, len(loads)
        dealt[pair] = shard
        heappush(loads, (load + n, shard))
    return dealt


def adaptive_log10(text: bytes, order: int = 4) -> float:
    """log10 probability of a normalised text by a trie that starts empty and counts each byte after coding it."""
    trie: dict[bytes, Counter] = {}
    total, history = 0.0, END * order
    for byte in text:
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            seen = {b: c for b, c in trie.get(history[len(history) - k :], Counter()).items() if b not in excluded}
            if not seen:
                continue
            den = sum(seen.values()) + len(seen)
            if byte in seen:
                total += math.log10(seen[byte] / den)
                break
            total += math.log10(len(seen) / den)
            excluded |= seen.keys()
        else:
            total -= math.log10(256 - len(excluded))
        for k in range(order + 1):
            trie.setdefault(history[len(history) - k :], Counter())[byte] += 1
        history = (history + bytes([byte]))[-order:] if order else b""
    return total


def normalised(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def corpus_counts(texts: DataFrame, order: int, text_col: str = "text", flush: int = 300_000) -> DataFrame:
    """``kind, key, n``: counts over all texts of tokens (kind 0, the end is the key ``END``) and of grams (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, c = (np.concatenate(x) for x in zip(*held))
            u, inv = np.unique(g, return_inverse=True)
            return u, np.bincount(inv, c, len(u)).astype(np.int64)

        def rows(kind: int, keys: list | np.ndarray, n) -> pa.RecordBatch:
            data = pa.array(keys, pa.binary()) if kind == 0 else pa.Array.from_buffers(pa.binary(8), len(keys), [None, pa.py_buffer(keys.astype(">u8").tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), data, pa.array(n, pa.int64())], names=["kind", "key", "n"])

        def grams_out() -> pa.RecordBatch:
            u, c = merged()
            return rows(1, u, c)

        for b in batches:
            texts = b.column(0).to_pylist()
            begin = 0
            while begin < len(texts):
                part, size = [], 0
                while begin < len(texts) and size < 1_500_000:
                    w = words_of(texts[begin])
                    tokens.update(w)
                    part.append(normalised(w))
                    size += len(part[-1])
                    begin += 1
                tokens[END] += len(part)
                code, first, last = codes_of(part, order)
                own = np.ones(len(code), bool)
                for j in range(1, order + 1):
                    own[first - j] = False
                code = np.sort(code[own])
                at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                held.append((code[at], np.diff(np.r_[at, len(code)])))
                if sum(len(g) for g, _ in held) > 6 * flush:
                    held = [merged()]
                    if len(held[0][0]) > 3 * flush:
                        yield rows(1, *held[0])
                        held = []
                if len(tokens) > flush:
                    yield rows(0, list(tokens.keys()), list(tokens.values()))
                    tokens = Counter()
        if tokens:
            yield rows(0, list(tokens.keys()), list(tokens.values()))
        if held:
            yield grams_out()

    return texts.select(F.col(text_col).cast("binary")).mapInArrow(run, "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _frequent(tokens: DataFrame, limit: int, den: int) -> dict[bytes, float]:
    """Base scores of the most frequent tokens: all from some count on, at most ``limit`` of them."""
    level = F.floor(4 * F.log2("n"))
    sizes = sorted(((int(r[0]), r[1]) for r in tokens.groupBy(level).count().collect()), reverse=True)
    cut, total = None, 0
    for at, n in sizes:
        if total + n > limit:
            break
        cut, total = at, total + n
    if cut is None:
        return {}
    got = tokens.where(level >= cut).select("key", "n").toArrow()
    return dict(zip(got["key"].to_pylist(), np.log10((got["n"].to_numpy() + 1) / den).tolist()))


def _grams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select(F.conv(F.hex("key"), 16, -10).cast("long").alias("g"), "n").toArrow()
    g = got["g"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(g)
    return g[order], got["n"].to_numpy()[order]


def _chunked(rows: DataFrame, text_col: str, limit: int) -> DataFrame:
    """``rows`` with ``chunk``: the ``_row`` that begins its run of rows of a task, of about ``limit`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = None, 0
        for b in batches:
            at = []
            for row, n in zip(b.column("_row").to_pylist(), pc.binary_length(b.column(text_col)).to_pylist()):
                if chunk is None or size + (n or 0) > limit:
                    chunk, size = row, 0
                size += n or 0
                at.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "chunk"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("chunk", LongType())]))


def _sums(texts: list[bytes], order: int, log10, limit: int = 1_000_000) -> np.ndarray:
    """Sums of ``log10`` over each normalised text's grams, for about ``limit`` bytes at a time."""
    out, part, size = [np.zeros(0)], [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= limit or i == len(texts) - 1:
            code, first, last = codes_of(part, order)
            out.append(np.add.reduceat(np.r_[log10(code), 0], np.column_stack([first, last]).ravel())[::2])
            part, size = [], 0
    return np.concatenate(out)


def _asked(rows: DataFrame, order: int, dealt: np.ndarray) -> DataFrame:
    """``chunk, shard, codes``: the different grams of each chunk's texts that a shard has to answer for."""

    def ask(chunk: int, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        seen = []
        _sums([normalised(words_of(t)) for t in texts], order, lambda code: seen.append(np.unique(code)) or np.zeros(len(code)))
        code = np.unique(np.concatenate(seen))
        shard = dealt[pair_of(code)]
        by = np.argsort(shard, kind="stable")
        found, begin = np.unique(shard[by], return_index=True)
        packed = [x.astype("<u8").tobytes() for x in np.split(code[by], begin[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), pa.array(found, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "shard", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and chunk != at:
                    yield from ask(at, held)
                    held = []
                at = chunk
                held.append(text)
        if held:
            yield from ask(at, held)

    return rows.select("chunk", "_text").mapInArrow(run, "chunk long, shard int, codes binary")


def _sharded_scores(rows: DataFrame, grams: DataFrame, low: tuple[np.ndarray, np.ndarray], dealt: np.ndarray, order: int, at_a_time: int) -> DataFrame:
    """``_row, score`` by tries that tasks build, one for each shard and for about ``at_a_time`` grams that it is asked for."""
    asked = stored(_asked(rows, order, dealt), "lm-asked")
    most = asked.groupBy("shard").agg(F.sum(F.octet_length("codes")).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // (8 * at_a_time)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        g = part["g"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(g)
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "top": [g[by].tobytes()], "n": [part["n"].to_numpy(np.int64)[by].tobytes()]})

    known = grams.select("shard", F.conv(F.hex("key"), 16, -10).cast("long").alias("g"), "n").groupBy("shard").applyInPandas(pack, "shard int, top binary, n binary")
    known = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = asked.withColumn("block", F.pmod(F.xxhash64("chunk"), F.lit(blocks)).cast("int"))

    def answer(key: tuple, tries: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return pd.DataFrame({"chunk": [], "codes": [], "values": []})
        top, n = (np.frombuffer(tries[c].iloc[0], t) for c, t in (("top", np.uint64), ("n", np.int64)))
        trie = Trie.build(top, n, order, low, dealt, key[0])
        values = [trie.log10(np.frombuffer(c, "<u8")).tobytes() for c in asks["codes"]]
        return pd.DataFrame({"chunk": asks["chunk"], "codes": asks["codes"], "values": values})

    key = ["shard", "block"]
    answers = known.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(answer, "chunk long, codes binary, values binary")

    def score(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        code, first = np.unique(np.concatenate([np.frombuffer(c, "<u8") for c in found["codes"]]), return_index=True)
        value = np.concatenate([np.frombuffer(v, "<f8") for v in found["values"]])[first]
        sums = _sums([normalised(words_of(t)) for t in texts["_text"]], order, lambda c: value[np.minimum(np.searchsorted(code, c), len(code) - 1)])
        return pd.DataFrame({"_row": texts["_row"], "score": sums})

    return rows.select("chunk", "_row", "_text").groupBy("chunk").cogroup(stored(answers, "lm-answers").groupBy("chunk")).applyInPandas(score, "_row long, score double")


def score_corpus(
    docs: DataFrame, is_training: str, id_col: str = "doc_id", text_col: str = "text", order: int = 4, node_limit: int = 4_000_000, frequent_limit: int = 200_000, chunk_bytes: int = 4_000_000, at_a_time: int = 8_000_000
) -> DataFrame:
    """``id_col, is_training, n_tokens, n_known, train_tokens, base_score, score`` of every row, from a trie and
    token counts over the rows whose boolean column ``is_training`` is true."""
    spark = docs.sparkSession
    counts = stored(corpus_counts(docs.where(is_training), order, text_col), "lm-counts")
    tokens, grams = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    all_tokens, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    den = all_tokens + 1 * (kinds + 1)
    rows = docs.select(id_col, is_training, F.col(text_col).cast("binary").alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    sharded = grams.count() > node_limit
    if sharded:
        byte = lambda i: F.conv(F.hex(F.substring("key", i, 1)), 16, 10).cast("int")
        pair = byte(6) * 256 + byte(7)
        dealt = deal_pairs({r[0]: r[1] for r in grams.groupBy(pair.alias("pair")).count().collect()}, node_limit)
        named = spark.createDataFrame([(i, int(s)) for i, s in enumerate(dealt)], "pair int, shard int")
        got = grams.groupBy((byte(7) * 256 + byte(8)).alias("g")).agg(F.sum("n").alias("n")).orderBy("g").toArrow()
        low = got["g"].to_numpy().astype(np.uint64), got["n"].to_numpy()
        rows = stored(_chunked(rows, "_text", chunk_bytes), "lm-texts")
        others = _sharded_scores(rows, grams.withColumn("pair", pair).join(F.broadcast(named), "pair"), low, dealt, order, at_a_time)
        rows = rows.drop("chunk")
    trie = None if sharded else spark.sparkContext.broadcast(Trie.build(*_grams(grams), order))
    known = spark.sparkContext.broadcast(_frequent(tokens, frequent_limit, den))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = known.value
        for b in batches:
            texts, begin, out = b.column(2).to_pylist(), 0, []
            scores: list[np.ndarray] = []
            while begin < len(texts):
                part, size = [], 0
                while begin < len(texts) and size < 1_000_000:
                    w = words_of(texts[begin])
                    part.append(normalised(w))
                    size += len(part[-1])
                    begin += 1
                    w.append(END)
                    hits = [x for x in map(have.get, w) if x is not None]
                    rest = Counter(x for x in w if x not in have) if len(hits) < len(w) else {}
                    out.append((len(w), len(hits), sum(hits), list(rest.keys()), list(rest.values())))
                scores.append(np.zeros(len(part)) if trie is None else _sums(part, order, trie.value.log10))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(3), b.column(0), b.column(1), pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.binary())), pa.array(cols[4], pa.list_(pa.int64())),
                ],
                names=["_row", id_col, is_training, "score", "n_tokens", "known", "base", "rest", "times"],
            )

    schema = f"_row long, `{id_col}` {kind}, `{is_training}` boolean, score double, n_tokens long, known long, base double, rest array<binary>, times array<long>"
    found = stored(rows.mapInArrow(run, schema), "lm-scores")
    tail = (
        found.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("r"))
        .select("_row", F.col("r.rest").alias("key"), F.col("r.times").alias("times"))
        .join(tokens, "key", "left")
        .groupBy("_row")
        .agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(den)))).alias("more_base"))
    )
    whole = found.drop("rest", "times").join(tail, "_row", "left")
    if sharded:
        whole = whole.drop("score").join(others, "_row")
    return whole.select(
        id_col,
        is_training,
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(all_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def score_adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 4) -> DataFrame:
    """``id_col, score``: code length of every text by a trie of its own. Much slower than the pretrained form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([adaptive_log10(normalised(words_of(t)), order) for t in b.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("is_training", in_bucket("doc_id", 7) != 2)
    return score_corpus(docs, "is_training").select("doc_id", (~F.col("is_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
