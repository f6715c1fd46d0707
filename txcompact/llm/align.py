"""Alignment of two tokenizers over a corpus: which ids stand for the same bytes.

1. A text with a space in front is encoded by the byte-level tokenizer A, the text by the piece tokenizer B, which puts that space itself.
   Where the joined bytes of either differ from the space and the text, the text counts as having no tokens.
2. Byte offsets at which a token of A and one of B both end are shared ends: they cut the tokens into groups. Those
   before a token of A and one of B that both begin with a space, and a text's end, are the anchors: they cut a document into windows of ids.
3. A window's alignment depends on its ids alone, so it is remembered under the tuple of its ids (as bytes). The windows of
   a batch are made distinct first, and the fresh ones aligned together: each stretch between neighbouring ends, of
   either kind, links the token of A with the token of B that it lies in.
4. Each document's distinct linked pairs of ids, with how often it links them, are stored. Counts of pairs over documents come from
   them by partial aggregation, and the best count of each id of A.
5. The counts meet the stored pairs again. Those found in more than one of ``HEAVY`` stored rows, at most ``HEAVY`` pairs, are broadcast,
   so a pair that every document links is never shuffled; the others, where there are any, are joined by a shuffle. Sums by document
   are partial within the task that holds its row.

Memory of a task is bounded: batches of some megabytes of text; remembered pieces and windows are limited and long ones forgotten.

Defined results: null and empty texts have no tokens; each row counts as a document of its own, also where ids repeat or are null; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm.common import stored, table
from txcompact.llm.pieces import SPACES, WHOLE, ByteEncoder, Memo, give_back, piece_level, rows_of, slices, split_pieces, token_bytes, totals

#: Pairs that are broadcast at most: 20 bytes each.
HEAVY = 1_000_000
#: Pieces of each tokenizer and windows that a task remembers, the longest window kept, and bytes of text at a time.
PIECES, WINDOWS, WINDOW_BYTES, TEXT_BYTES = 300_000, 300_000, 512, 1_500_000


class Tokens:
    """What the alignment needs of one tokenizer: bytes, lengths and leading spaces of its ids, and ids of pieces with a check of their bytes."""

    def __init__(self, entries: list[bytes], how: str, encode):
        self.bytes, self.how, self.encode = entries, how, encode
        self.sizes = np.array([len(b) for b in entries], np.int64)
        self.spaced = np.array([b[:1] == b" " for b in entries])
        self.names = [str(i) for i in range(len(entries))]
        self.memo = Memo(self.rows, (np.int32, np.int8), most=PIECES)

    def rows(self, keys: list[str]) -> tuple:
        ids, sizes = self.encode(keys)
        joined = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        raw = [k.encode() for k in keys]
        if joined == b"".join(raw):  # all of them, if each ends where it should
            want = np.cumsum([len(r) for r in raw])
            same = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.cumsum(sizes)] == want
        else:
            bounds = np.cumsum(sizes)
            same = [b"".join(map(self.bytes.__getitem__, x.tolist())) == r for x, r in zip(np.split(ids, bounds[:-1]), raw)]
        return (ids, sizes), (np.array(same, np.int8), np.ones(len(keys), np.int64)), None

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, how many each has, and whether its bytes are right."""
        self.memo.forget()
        keys, places, per_text = split_pieces(texts, self.how)
        codes = self.memo.codes(keys)[places]
        ids, sizes = self.memo.take(0, codes)
        right = totals(self.memo.take(1, codes)[0].astype(np.int64), per_text) == per_text
        return ids, totals(sizes, per_text), right


def byte_tokens(path: str) -> Tokens:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    encoder = ByteEncoder(tok)
    return Tokens(token_bytes(tok), encoder.how, encoder)


def piece_tokens(path: str) -> Tokens:
    """Pieces begin with the space that the library adds, so it gets them without."""
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    entries = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Tokens(entries, SPACES if piece_level(model) else WHOLE, lambda keys: rows_of(sp.encode([k[1:] for k in keys], num_threads=1)))


def _marks(ends: np.ndarray, size: int) -> np.ndarray:
    found = np.zeros(size + 1, bool)
    found[ends] = True
    return found


class Aligner:
    """Aligns batches of texts; remembers windows by their ids."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.memo = Memo(self._align, (np.int64, np.int32), longest=WINDOW_BYTES, most=WINDOWS)

    def _align(self, windows: list[bytes]) -> tuple:
        """Links (pairs of ids) and number of groups of each window, and its groups as text. A window: ids of A, -1, ids of B."""
        every = np.frombuffer(b"".join(windows), np.int32)
        window = np.repeat(np.arange(len(windows)), [len(w) // 4 for w in windows])
        middle = np.flatnonzero(every < 0)
        is_b = np.arange(len(every)) > middle[window]
        is_a = ~is_b
        is_a[middle] = False
        a, b = every[is_a], every[is_b]
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        size = int(ends_a[-1])
        in_a, in_b = _marks(ends_a, size), _marks(ends_b, size)
        stretch = np.flatnonzero(in_a | in_b)
        link_a = np.searchsorted(ends_a, stretch)
        link_b = np.searchsorted(ends_b, stretch)
        pairs = a[link_a].astype(np.int64) * len(self.b.bytes) + b[link_b]
        per_window = np.bincount(window[is_a][link_a], minlength=len(windows))
        last_a, last_b = np.flatnonzero(in_b[ends_a]), np.flatnonzero(in_a[ends_b])
        groups = np.bincount(window[is_a][last_a], minlength=len(windows))
        name_a, name_b = [self.a.names[i] for i in a.tolist()], [self.b.names[i] for i in b.tolist()]
        said, i, j = [], 0, 0
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            said.append(f"{name_a[i] if x == i + 1 else ','.join(name_a[i:x])}|{name_b[j] if y == j + 1 else ','.join(name_b[j:y])}")
            i, j = x, y
        texts, at = [], 0
        for n in groups.tolist():
            texts.append(said[at] if n == 1 else ";".join(said[at : at + n]))
            at += n
        return (pairs, per_window), (groups, np.ones(len(windows), np.int64)), texts

    def rows(self, texts: pa.Array) -> tuple:
        """For each text (none null): counts of A, B, groups and links, the groups' text, and all links."""
        large = pa.large_string()
        with_space = pc.binary_join_element_wise(pa.scalar("", large), texts.cast(large), pa.scalar(" ", large))
        (ids_a, n_a, right_a), (ids_b, n_b, right_b) = self.a.of(with_space), self.b.of(with_space)
        right = right_a & right_b & (np.asarray(pc.binary_length(texts)) > 0)
        ids_a, ids_b = ids_a[np.repeat(right, n_a)], ids_b[np.repeat(right, n_b)]
        n_a, n_b = n_a * right, n_b * right
        none = np.zeros(len(texts), np.int64)
        if not len(ids_a):
            return none, none, none, none, [""] * len(texts), np.zeros(0, np.int64)
        ends_a, ends_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        size = int(ends_a[-1])
        last_a, last_b = np.flatnonzero(_marks(ends_b, size)[ends_a]), np.flatnonzero(_marks(ends_a, size)[ends_b])
        anchor = np.ones(len(last_a), bool)
        anchor[:-1] = self.a.spaced[ids_a[last_a[:-1] + 1]] & self.b.spaced[ids_b[last_b[:-1] + 1]]
        text_ends = np.cumsum(n_a)[right] - 1
        anchor[np.searchsorted(last_a, text_ends)] = True
        stop_a, stop_b = last_a[anchor] + 1, last_b[anchor] + 1
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        number = np.arange(len(stop_a))
        coded = np.full(len(ids_a) + len(ids_b) + len(number), -1, np.int32)
        coded[np.arange(len(ids_a)) + np.repeat(stop_b - size_b + number, size_a)] = ids_a
        coded[np.arange(len(ids_b)) + np.repeat(stop_a + number + 1, size_b)] = ids_b
        bounds = np.concatenate([[0], 4 * (stop_a + stop_b + number + 1)])
        windows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(number), [None, pa.py_buffer(bounds), pa.py_buffer(coded)]).dictionary_encode()
        self.memo.forget()
        codes = self.memo.codes(windows.dictionary.to_pylist())[np.asarray(windows.indices)]
        per_text = none.copy()
        per_text[right] = np.diff(np.searchsorted(stop_a, np.cumsum(n_a)[right], "right"), prepend=0)
        links, per_window = self.memo.take(0, codes)
        groups, _ = self.memo.take(1, codes)
        said, at, listed = self.memo.objects, 0, codes.tolist()
        shown = []
        for n in per_text.tolist():
            shown.append(";".join([said[c] for c in listed[at : at + n]]))
            at += n
        return n_a, n_b, totals(groups.astype(np.int64), per_text), totals(per_window, per_text), shown, links


def aligned_rows(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``row`` (a number of its own), ``id``, the counts, ``groups_sha256``, and its distinct linked ``pairs`` with ``times``."""
    schema = pa.schema(
        [("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        place = lambda x: x if os.path.isabs(x) else public_tokenizers.path(x)
        aligner = Aligner(byte_tokens(place(a)), piece_tokens(place(b)))
        first, entries = TaskContext.get().partitionId() << 40, len(aligner.a.bytes) * len(aligner.b.bytes)
        for batch in batches:
            texts, done = pc.fill_null(batch.column(1), ""), 0
            for some in slices(texts, TEXT_BYTES):
                n_a, n_b, groups, links, shown, pairs = aligner.rows(some)
                digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]
                # Links of a text next to each other, by pair; their first ones start runs.
                held = np.sort(np.repeat(np.arange(len(some)), links) * entries + pairs)
                start = np.flatnonzero(np.diff(held, prepend=-1))
                times = np.diff(start, append=len(held)).astype(np.int32)
                bounds = pa.array(np.searchsorted(held[start] // entries, np.arange(len(some) + 1)), pa.int32())
                own = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (held[start] % entries, times)]
                row = pa.array(first + done + np.arange(len(some)))
                ids = batch.column(0).slice(done, len(some))
                done += len(some)
                give_back()
                yield pa.RecordBatch.from_arrays([ids, row, *map(pa.array, (n_a, n_b, groups, links, digest)), *own], schema=schema.insert(0, pa.field("id", ids.type)))
            first += len(texts)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    )


def pair_counts(rows: DataFrame, entries: int) -> DataFrame:
    """``pair, a, b, n`` (documents that link it) and ``best``: whether no pair of the same id of A has more."""
    counted = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    split = counted.select("pair", F.expr(f"pair div {entries}").alias("a"), (F.col("pair") % entries).alias("b"), "n")
    most = split.groupBy("a").agg(F.max("n").alias("most"))
    return split.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Documents (``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``) and the table of pairs
    (``pair, a, b, n, best``). ``a``: a file of the tokenizers library, ``b``: one of sentencepiece, as a name or a path on every executor."""
    import os

    import public_tokenizers
    import sentencepiece

    entries = sentencepiece.SentencePieceProcessor(model_file=b if os.path.isabs(b) else public_tokenizers.path(b)).get_piece_size()
    made = aligned_rows(docs, a, b, id_col, text_col)
    rows = stored(made, "aligned", compression="zstd")
    pairs = stored(pair_counts(rows, entries), "pairs")
    size, total = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    marked = pairs.select("pair", "n", "best")
    # At most `heavy` pairs can each be in more than one of `heavy` of all rows.
    often = F.broadcast(marked if size <= heavy else marked.where(F.col("n") > total // heavy))
    found = each.join(often, "pair")
    if size > heavy:
        found = found.unionByName(each.join(often.select("pair"), "pair", "left_anti").join(marked.where(F.col("n") <= total // heavy), "pair").select(*found.columns))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).cast("long").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"), pairs


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
