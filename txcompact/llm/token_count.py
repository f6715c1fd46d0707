"""Token counts of a public tokenizer over whole texts, with overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in chunks that overlap. Two neighbours are spliced at a place where both
start the same word piece of the tokenizer's own splitting with the same token: what the tokenizer does after such a
place depends on nothing before it, so from there on the right chunk's tokens are those of the whole text. Places closer than
``margin`` to a chunk's cut ends are not trusted: near its right end, words and special strings may be cut; near its left end,
the right chunk still has to fall in step, which a common place proves. Where an overlap has no common place it
is doubled until it has, up to the last proven place; then the chunk itself grows.

Only tokenizers whose splitting looks at what follows a piece and not at what stands before it can be spliced so: those with a
byte-level, whitespace or punctuation splitter. ``splices`` reads that from the tokenizer's own description; with any
other every text is encoded whole.

Shorter texts are encoded whole too, unless ``cuts_at_spaces`` finds that a single space between two non-blank characters
always starts a word piece, as with the byte-level splitter: then each distinct piece between such spaces is encoded once in a
task. Pieces of more than ``LONGEST`` characters, as in scripts without spaces, are not remembered, so memory stays bounded.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; repeated rows each keep their row; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txcompact.llm.common import table

#: A single space with a non-blank character on each side.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pieces that a task remembers, and their most characters; when full it starts anew.
REMEMBERED, LONGEST = 1_000_000, 64
#: Splitters after whose cuts nothing depends on what stands before.
FORWARD = {"ByteLevel", "Whitespace", "WhitespaceSplit", "Punctuation", "Digits", "BertPreTokenizer", "Split", "Sequence"}


def splices(description: str) -> bool:
    """Whether texts may be encoded in chunks: by the description (JSON) of a tokenizer."""
    found = json.loads(description)
    splitter = found.get("pre_tokenizer")
    parts = [] if splitter is None else splitter.get("pretokenizers", [splitter])
    looks_back = any("(?<" in json.dumps(p.get("pattern", "")) for p in parts)
    prefixed = any(p.get("add_prefix_space") for p in parts)
    return bool(parts) and all(p["type"] in FORWARD for p in parts) and not looks_back and not prefixed and found.get("normalizer") is None


def cuts_at_spaces(description: str) -> bool:
    """Whether a single space between non-blank characters always starts a word piece: by the description of a tokenizer."""
    found = json.loads(description)
    splitter = found.get("pre_tokenizer") or {}
    plain = not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in found.get("added_tokens", []))
    return splices(description) and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and plain


class Pieces:
    """Starts of word pieces of an encoding of ``text[begin:]``: places in the text, tokens before them, and first tokens."""

    def __init__(self, encoding, begin: int):
        ids, words = encoding.ids, encoding.word_ids
        self.size = len(ids)
        self.at = np.array([i for i in range(self.size) if i == 0 or words[i] is None or words[i] != words[i - 1]], np.int64)
        offsets = encoding.offsets
        self.place = np.array([begin + offsets[i][0] for i in self.at], np.int64)
        self.first = np.array([ids[i] for i in self.at], np.int64)

    def common(self, right: Pieces, low: int, high: int) -> tuple[int, int] | None:
        """Tokens before the last common start between the places ``low`` and ``high`` (neither included), here and in ``right``."""
        mine = np.flatnonzero((self.place > low) & (self.place < high))
        theirs = np.flatnonzero((right.place > low) & (right.place < high))
        _, x, y = np.intersect1d(self.place[mine] * (1 << 20) + self.first[mine], right.place[theirs] * (1 << 20) + right.first[theirs], return_indices=True)
        if not len(x):
            return None
        return int(self.at[mine[x[-1]]]), int(right.at[theirs[y[-1]]])


def chunk_bounds(size: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of a text of ``size`` characters."""
    if size <= chunk:
        return [(0, size)]
    begins = range(0, size - overlap, chunk - overlap)
    return [(b, min(size, b + chunk)) for b in begins]


def spliced_count(encode: Callable, text: str, bounds: list[tuple[int, int]], encodings: list, margin: int = 64) -> int:
    """Tokens of ``text`` from its chunks' encodings; ``encode`` is asked for wider ones where neighbours have no common start."""
    (begin, end), left = bounds[0], Pieces(encodings[0], 0)
    done = start = 0  # tokens before the proven place, and the left chunk's tokens before it
    place = begin
    for (b, e), encoding in zip(bounds[1:], encodings[1:]):
        right, wide = Pieces(encoding, b), end - b
        while True:
            low = b + margin if b > place else place
            met = left.common(right, max(place, low), end - margin)
            if met:
                done, start = done + met[0] - start, met[1]
                place = int(right.place[np.searchsorted(right.at, met[1])])
                left, end = right, e
                break
            if b <= place:  # all that follows the proven place is in the right chunk: go on from there
                whole = Pieces(encode(text[place:e]), place)
                left, start, end = whole, 0, e
                break
            wide *= 2
            b = max(place, end - wide)
            right = Pieces(encode(text[b:e]), b)
    return done + left.size - start


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", chunk: int = 8192, overlap: int = 256, margin: int = 64) -> DataFrame:
    """``id_col, n_bytes, n_tokens`` for every row. ``tokenizer``: a file for the tokenizers library, as its
    name among the public tokenizers or its path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        tok.no_truncation()
        tok.no_padding()
        cut, spaces = splices(tok.to_str()), cuts_at_spaces(tok.to_str())
        known: dict[str, int] = {}

        def short(texts: list[str]) -> list[int]:
            nonlocal known
            if not spaces:
                return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            pieces = [CUT.split(t) for t in texts]
            for p in pieces:  # a piece after a cut carries its space
                p[1:] = [" " + x for x in p[1:]]
            if len(known) > REMEMBERED:
                known = {}
            fresh = list(dict.fromkeys(x for p in pieces for x in p if x not in known))
            known.update(zip(fresh, (len(e) for e in tok.encode_batch_fast(fresh, add_special_tokens=False))))
            found = [sum(map(known.__getitem__, p)) for p in pieces]
            for x in fresh:
                if len(x) > LONGEST:
                    del known[x]
            return found

        def encode(s: str):
            return tok.encode(s, add_special_tokens=False)

        def counts(texts: list[str]) -> Iterator[int]:
            begin = 0
            while begin < len(texts):  # chunks of about a million characters at a time
                bounds, size, end = [], 0, begin
                while end < len(texts) and size < 1_000_000:
                    bounds.append(chunk_bounds(len(texts[end]), chunk if cut else len(texts[end]), overlap))
                    size += len(texts[end])
                    end += 1
                single = [i for i, b in enumerate(bounds) if len(b) == 1]
                found = dict(zip(single, short([texts[begin + i] for i in single])))
                for i, own in enumerate(bounds):
                    text = texts[begin + i]
                    if i in found:
                        yield found[i]
                    else:
                        yield long_count(text, own)
                begin = end

        def long_count(text: str, own: list[tuple[int, int]]) -> int:
            return spliced_count(encode, text, own, tok.encode_batch([text[b:e] for b, e in own], add_special_tokens=False), margin)

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(list(counts(texts)), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
