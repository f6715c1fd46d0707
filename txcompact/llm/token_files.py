"""Token ids as binary files: Simple-8b words with offsets of blocks, in ascending order of the documents.

A word of 64 bits is a selector of 4 bits and 60 bits of ids: as many of the next ids as fit, all in one width (``COUNTS``:
60 ids of one bit to one id of 60 bits). Selector 0 is an escape for an id of more than 60 bits: the word holds its place among the
file's escapes, where it stands whole. Blocks of ``BLOCK`` ids begin at a word of their own, and the file keeps where, so a
reader fetches and decodes only the blocks that a document lies in. Packing walks all blocks of a file abreast, and packs and unpacks all
words of a selector at once.

A file, little-endian: ``MAGIC``; 64-bit numbers of documents, ids, ids to a block, words and escapes; then, as 64-bit numbers,
the documents' ids, 1 for those whose id is null, ids of each document, the first word of each block and the end, escapes, words.

Documents are dealt by ranges of ``(id, hash of the text, place in the input)``, so that a third of all rows under one id still meets
in no single task; each task sorts its range and writes files of about ``file_ids`` ids, of which it returns a row each. A file's
name is new in each attempt and only rows of the attempt that counts are kept, so a task may be run again. What stands before a
file is the sum over the parts before it (one number a part) and over the files before it in its part.

The files go to a folder that driver and executors share, through ``pyarrow.fs`` (local or mounted folders, and the stores it knows).

Defined results: a null text counts as empty, so it has the end id alone; documents with a null id come first; rows of one id
stand in the order of their texts' hashes, equal rows next to each other; an empty table makes no file; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txcompact.llm.common import shared_dir, stored, table
from txcompact.llm.pieces import ByteEncoder, Memo, gather, slices, split_pieces, totals

MAGIC = b"TXIDS8B1"
BLOCK = 4096
#: How many ids a word of selector ``i + 1`` holds; each has ``60 // count`` bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 64-bit number, 0 for 0."""
    short = lambda x: np.frexp(x.astype(np.float64))[1]  # noqa: E731  exact below 2**53
    if ids.size == 0 or ids.max() < 1 << 53:
        return short(ids).astype(np.uint8)
    high = ids >> np.uint64(32)
    return np.where(high > 0, 32 + short(high), short(ids & np.uint64(0xFFFFFFFF))).astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block and the end, and escapes."""
    n, most = -(-len(ids) // block), int(COUNTS[0])
    wide = np.zeros((n, block + most), np.uint64)
    padded = np.zeros(n * block, np.uint64)
    padded[: len(ids)] = ids
    wide[:, :block] = padded.reshape(n, block)
    bits = bit_lengths(wide)
    # Widest of the next 1, 2, 4, ... ids; two such runs that overlap make a run of any length.
    runs = {1: bits}
    while 2 * max(runs) <= most:
        size, last = max(runs), runs[max(runs)]
        runs[2 * size] = np.maximum(last[:, : last.shape[1] - size], last[:, size:])
    fits = np.zeros((n, block), np.uint8)
    for count in COUNTS:
        size = max(s for s in runs if s <= count)
        fits += np.maximum(runs[size][:, :block], runs[size][:, count - size : count - size + block]) <= 60 // count
    takes = np.array([0, *COUNTS[::-1]])[fits.ravel()]  # what fits in a width fits in all wider ones
    size = np.minimum(block, len(ids) - block * np.arange(n))
    at, base, steps = np.zeros(n, np.int64), block * np.arange(n), []
    while (left := at < size).any():
        steps.append(np.where(left, base + at, -1))
        at = np.where(left, at + np.maximum(takes[np.minimum(base + at, len(takes) - 1)], 1), at)
    begins = np.array(steps, np.int64).reshape(len(steps), n).T
    per_block = (begins >= 0).sum(1)
    begins = begins[begins >= 0]
    counts = takes[begins]
    places = begins + most * (begins // block)
    flat, words = wide.ravel(), np.zeros(len(begins), np.uint64)
    for selector, count in enumerate(COUNTS, 1):
        mine = np.flatnonzero(counts == count)
        word = np.full(len(mine), selector << 60, np.uint64)
        for j in range(count):
            word |= flat[places[mine] + j] << np.uint64(j * (60 // count))
        words[mine] = word
    escaped = np.flatnonzero(counts == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, np.concatenate([[0], np.cumsum(per_block)]).astype(np.int64), flat[places[escaped]]


def unpack(words: np.ndarray, per_block: np.ndarray, sizes: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks of ``per_block`` words and ``sizes`` ids each."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.concatenate([[1], COUNTS])[selectors]
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector, count in enumerate(COUNTS, 1):
        mine = np.flatnonzero(selectors == selector)
        width = 60 // count
        for j in range(count):
            out[begins[mine] + j] = (words[mine] >> np.uint64(j * width)) & np.uint64((1 << width) - 1)
    escaped = np.flatnonzero(selectors == 0)
    out[begins[escaped]] = escapes[words[escaped].astype(np.int64)]
    held = totals(counts, per_block)  # the last word of a block may hold zeros beyond its ids
    return gather(np.cumsum(held) - held, sizes, out)


def file_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, firsts, escapes = pack(ids.astype(np.uint64), block)
    head = np.array([len(doc_ids), len(ids), block, len(words), len(escapes)])
    names = np.array([0 if d is None else d for d in doc_ids], np.int64)
    missing = np.array([d is None for d in doc_ids], np.int64)
    parts = (head, names, missing, sizes, firsts)
    return MAGIC + b"".join(x.astype("<i8").tobytes() for x in parts) + escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes()


class TokenFile:
    """Reads a file's index, and then only the blocks that are asked for. ``source``: an open random-access file of pyarrow."""

    def __init__(self, source):
        self.source = source
        if source.read(8) != MAGIC:
            raise ValueError("not a file of token ids")
        docs, self.size, self.block, words, escapes = self._numbers(5)
        self.doc_ids, self.missing, self.sizes = self._numbers(docs), self._numbers(docs).astype(bool), self._numbers(docs)
        self.firsts = self._numbers(-(-self.size // self.block) + 1)
        self.escapes = self._numbers(escapes).view(np.uint64)
        self.begin = source.tell()
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _numbers(self, count: int) -> np.ndarray:
        return np.frombuffer(self.source.read(8 * int(count)), "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        a, b = start // self.block, (stop - 1) // self.block + 1
        self.source.seek(self.begin + 8 * int(self.firsts[a]))
        words = np.frombuffer(self.source.read(8 * int(self.firsts[b] - self.firsts[a])), "<u8")
        sizes = np.minimum(self.block, self.size - self.block * np.arange(a, b))
        found = unpack(words, np.diff(self.firsts[a : b + 1]), sizes, self.escapes)
        return found[start - a * self.block : stop - a * self.block]

    def documents(self, at_once: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of documents of about ``at_once`` ids: the first, the one after the last, and their ids."""
        ends = self.starts + self.sizes
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, self.starts[first] + at_once, "right")))
            yield first, last, self.ids(int(self.starts[first]), int(ends[last - 1]))
            first = last


def _folder(path: str):
    """A file system of pyarrow and the path in it; Spark writes local paths with one slash."""
    from pyarrow import fs

    local = path.startswith("file:/") and not path.startswith("file://")
    return fs.FileSystem.from_uri("file://" + path[5:] if local else path)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 2_000_000
) -> DataFrame:
    """Writes all texts' ids, each followed by ``end_id``, under ``folder``, and returns the stored list of files: ``part, seq, path,
    n_docs, n_ids, before`` (ids of the part's files before it). ``id_col`` must be of an integer type; ``tokenizer``: as for token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = ByteEncoder(Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)))
        memo = Memo(lambda keys: (encoder(keys), None))
        part, (to, root) = TaskContext.get().partitionId(), _folder(folder)
        to.create_dir(root, recursive=True)
        names, sizes, ids = [], [], []
        written = {"seq": 0, "before": 0}

        def file() -> pa.RecordBatch:
            path, every = f"{folder}/{part:06d}-{written['seq']:06d}-{uuid.uuid4().hex}.ids", np.concatenate(ids)
            with to.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}") as out:
                out.write(file_bytes(names, np.concatenate(sizes), every))
            row = {"part": part, "seq": written["seq"], "path": path, "n_docs": len(names), "n_ids": len(every), "before": written["before"]}
            written.update(seq=row["seq"] + 1, before=row["before"] + len(every))
            for held in (names, sizes, ids):
                held.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.string() if k == "path" else pa.int64()) for k in row]))

        for b in batches:
            texts, done = pc.fill_null(b.column(1), ""), 0
            for some in slices(texts):
                keys, places, per_text = split_pieces(some, encoder.how, encoder.kept)
                found, per_piece = memo.take(0, memo.codes(keys)[places])
                memo.forget()
                own = totals(per_piece, per_text)
                whole = np.full(len(found) + len(own), end_id, np.int64)
                held = np.ones(len(whole), bool)
                held[np.cumsum(own + 1) - 1] = False
                whole[held] = found
                names += b.column(0).slice(done, len(some)).to_pylist()
                sizes.append(own + 1)
                ids.append(whole)
                done += len(some)
                if sum(map(len, ids)) >= file_ids:
                    yield file()
        if names:
            yield file()

    # Only ids and hashes are sampled for the ranges and sorted with the texts; the tokens are made behind the exchange.
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("id", "h", "at").sortWithinPartitions("id", "h", "at")
    schema = "part long, seq long, path string, n_docs long, n_ids long, before long"
    return stored(dealt.select("id", "text").mapInArrow(run, schema), "token-files")


def read_token_files(files: DataFrame, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """``id_col, start, n_tokens`` and ``ids`` of every document of the listed files; with ``digest``, in place of ``ids``, the
    ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = files.join(parts, "part").select("path", (F.col("base") + F.col("before")).alias("base"))
    last = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.list_(pa.int64()))
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns)):
                source, at = _folder(path)
                with source.open_input_file(at) as opened:
                    held = TokenFile(opened)
                    for first, stop, ids in held.documents():
                        sizes = held.sizes[first:stop]
                        names = pa.array(held.doc_ids[first:stop], mask=held.missing[first:stop])
                        bounds = np.concatenate([[0], np.cumsum(sizes)])
                        if digest:
                            raw = memoryview(ids.astype("<u4").tobytes())
                            own = pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(bounds.tolist(), bounds[1:].tolist())], pa.int64())
                        else:
                            own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([names, pa.array(base + held.starts[first:stop]), pa.array(sizes), own], schema=schema)

    kind = "ids_crc32 long" if digest else "ids array<long>"
    # A task for each file (a row here) rather than one for many rows of so few bytes.
    return placed.repartition(max(1, files.count())).mapInArrow(run, f"{id_col} long, start long, n_tokens long, {kind}")


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), digest=True)
