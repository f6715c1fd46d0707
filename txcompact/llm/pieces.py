"""Exact encoding of texts by their distinct pieces, with vectorised splitting and assembling.

Texts are cut where a tokenizer starts a new word whatever stands on either side, so that the ids of a text are those of its
pieces in order; each distinct piece is encoded once while it is remembered. ``byte_level`` and ``piece_level`` read from a
tokenizer's own description whether this holds; with any other tokenizer every text is one piece.

- ``WORDS``, for byte-level splitters: before a run of blanks, between letters, digits and other signs (but not after an
  apostrophe, which may start an ending), and after a single line end between two other characters.
- ``SPACES``, for vocabularies of pieces: before a single space between two characters that are neither white space nor
  U+2581, which stands for a space in them.

Cuts are found over the bytes of a whole batch. What a byte alone cannot tell (most characters beyond U+00FF) gets no cut: a piece
may always be longer, never shorter. Special strings that the tokenizer takes whole are never cut.

Memory is bounded: pieces of more than ``LONGEST`` bytes are forgotten after their batch, and all when there are more than ``REMEMBERED``.
"""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED, LONGEST = 800_000, 64
#: Bytes of text that are encoded at a time.
AT_ONCE = 8_000_000
WHOLE, SPACES, WORDS = "whole", "spaces", "words"

_LETTER, _DIGIT, _OTHER, _APOSTROPHE = 1, 2, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
#: Lead bytes of U+0085 and U+00A0, U+1680, U+2000 to U+206F and U+2581, U+3000.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_level(description: str) -> bool:
    """Whether a tokenizer (its JSON) may be asked for pieces apart: it starts a word at every such space."""
    found = json.loads(description)
    splitter = found.get("pre_tokenizer") or {}
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in found.get("added_tokens", []))
    return found.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and plain


def piece_level(model: bytes) -> bool:
    """Whether a sentencepiece model may be asked for pieces apart: no entry continues over a space, and texts stay as they are."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    found = pb.ModelProto()
    found.ParseFromString(model)
    spec, kinds = found.normalizer_spec, pb.ModelProto.SentencePiece
    same = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    own = all("▁" not in p.piece.lstrip("▁") and p.type != kinds.USER_DEFINED for p in found.pieces)
    return same and own and found.trainer_spec.model_type == pb.TrainerSpec.BPE and not found.trainer_spec.treat_whitespace_as_suffix


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is surely no blank; ``at`` is at least 1."""
    before = data[at - 1]
    wide = (before >= 0x80) & (_LEADS[data[np.maximum(at, 2) - 2]] | _LEADS[data[np.maximum(at, 3) - 3]])
    return ~(_BLANK[before] | wide)


def _kinds(data: np.ndarray) -> np.ndarray:
    """Letter, digit or other sign of each ASCII byte and of both bytes of letters from U+00C0 to U+00FF; 0: not known."""
    kinds = _KIND[data]
    kinds[data == 39] = _APOSTROPHE
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kinds[lead] = _LETTER
    kinds[lead + 1] = _LETTER
    return kinds


def cut_places(data: np.ndarray, offsets: np.ndarray, how: str, kept: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where pieces begin in the bytes of texts that stand one after another from ``offsets[i]`` to ``offsets[i + 1]``. Empty
    texts have no piece. No cut falls inside an occurrence of one of ``kept``."""
    begins = np.zeros(len(data) + 1, bool)
    texts = offsets[:-1]
    if how != WHOLE and len(data) > 3:
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        if how == SPACES:
            at = np.flatnonzero(data[1:-1] == 32) + 1
            at = at[~first[at + 1] & _solid_before(data, at)]
            after = data[at + 1]
            begins[at[~(_BLANK[after] | _LEADS[after])]] = True
        else:
            kinds = _kinds(data)
            left, right = kinds[:-1], kinds[1:]
            # Of a letter's two bytes the second never differs from the first, so no cut falls inside it.
            differ = (left != right) & (left > 0) & (right > 0) & ~((left == _APOSTROPHE) & (right == _LETTER)) & ~((left >= _OTHER) & (right >= _OTHER))
            begins[1:-1] = differ
            blank = (data == 32) | ((data >= 9) & (data <= 13))
            at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
            begins[at[_solid_before(data, at)]] = True
            line = np.flatnonzero((data[1:-1] == 10) & (right[1:] > 0)) + 1
            line = line[~first[line] & _solid_before(data, line)]
            begins[line + 1] = True
        for word in kept:
            held, at = data.tobytes(), -1
            while (at := held.find(word, at + 1)) >= 0:
                begins[at + 1 : at + len(word)] = False
    begins[texts] = True
    begins[len(data)] = False
    return np.flatnonzero(begins)


def gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The stretches ``values[start : start + size]`` one after another."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


class Memo:
    """Keys with rows of integers, in long arrays, and perhaps an object. ``make`` gets the keys that are missing and returns
    the rows of each of ``kinds`` as their values one after another and their sizes, and last a list of objects or None."""

    def __init__(self, make: Callable[[list], tuple], kinds: tuple = (np.int32,), longest: int = LONGEST, most: int = REMEMBERED):
        self.make, self.kinds, self.longest, self.most = make, kinds, longest, most
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}
        self.long: list = []
        self.objects: list = []
        self.starts, self.sizes = ([np.zeros(0, np.int64) for _ in self.kinds] for _ in range(2))
        self.values = [np.zeros(0, k) for k in self.kinds]

    def codes(self, keys: list) -> np.ndarray:
        """A place in the table for each key (all distinct)."""
        known, base = self.known, len(self.starts[0])
        fresh = [k for k in keys if k not in known]
        if fresh:
            known.update(zip(fresh, range(base, base + len(fresh))))
            self.long += [k for k in fresh if len(k) > self.longest]
            *made, objects = self.make(fresh)
            for i, (values, sizes) in enumerate(made):
                self.starts[i] = np.concatenate([self.starts[i], len(self.values[i]) + np.cumsum(sizes) - sizes])
                self.sizes[i] = np.concatenate([self.sizes[i], sizes])
                self.values[i] = np.concatenate([self.values[i], values.astype(self.kinds[i], copy=False)])
            if objects is not None:
                self.objects += objects
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def forget(self) -> None:
        """Between batches: drop all when there is much; else the long ones are no longer found, and fall with the rest."""
        if len(self.starts[0]) > self.most or sum(map(len, self.values)) > 8 * self.most:
            self.clear()
        else:
            for k in self.long:
                del self.known[k]
            self.long = []

    def take(self, i: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``i``-th kind for ``codes``: all values, and how many each has."""
        sizes = self.sizes[i][codes]
        return gather(self.starts[i][codes], sizes, self.values[i]), sizes


def rows_of(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.array(list(chain.from_iterable(lists)), np.int64), sizes


def byte_table() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies write their entries: printable bytes stand for themselves, the
    others, in order, for the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(tok) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer; added strings as they are."""
    table, added = byte_table(), {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    size = max([*added, *tok.get_vocab().values()], default=-1) + 1
    found = [b""] * size
    for entry, i in tok.get_vocab().items():
        found[i] = added[i].encode() if i in added else bytes(table[c] for c in entry)
    return found


class ByteEncoder:
    """Ids of pieces by a tokenizer of the tokenizers library. Pieces that begin with a single space are joined, fifty
    at a time, which spares the library's cost for each call; the ends of their tokens must then agree with the pieces' ends, else they are encoded alone."""

    def __init__(self, tok):
        tok.no_truncation()
        tok.no_padding()
        self.tok = tok
        self.how = WORDS if byte_level(tok.to_str()) else WHOLE
        special = [] if tok.encode_special_tokens else [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        self.kept = tuple(special)
        self.sizes = np.array([len(b) for b in token_bytes(tok)], np.int64) if self.how == WORDS else None

    def alone(self, keys: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(keys, add_special_tokens=False)]

    def __call__(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys one after another, and how many each has."""
        if self.how == WHOLE:
            return rows_of(self.alone(keys))
        joined = np.array([k[0] == " " and k.strip() == k[1:] and k != " " for k in keys], bool)
        some, rest = [keys[i] for i in np.flatnonzero(joined)], [keys[i] for i in np.flatnonzero(~joined)]
        groups = ["".join(some[i : i + 50]) for i in range(0, len(some), 50)]
        values, per_group = rows_of(self.alone(groups))
        ends = np.cumsum(self.sizes[values])
        bounds = np.cumsum(np.asarray(pc.binary_length(pa.array(some, pa.large_string()))))
        last = np.searchsorted(ends, bounds)
        if len(some) and (last[-1] != len(ends) - 1 or (ends[np.minimum(last, len(ends) - 1)] != bounds).any()):
            values, sizes = rows_of(self.alone(some))
        else:
            sizes = np.diff(last, prepend=-1)
        other, other_sizes = rows_of(self.alone(rest))
        order = np.argsort(np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)]))
        every, every_sizes = np.concatenate([values, other]), np.concatenate([sizes, other_sizes])
        starts = np.cumsum(every_sizes) - every_sizes
        return gather(starts[order], every_sizes[order], every), every_sizes[order]


def slices(texts: pa.Array, at_once: int = AT_ONCE) -> Iterable[pa.Array]:
    """Runs of texts of about ``at_once`` bytes; a longer text is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    part = np.cumsum(sizes) // at_once
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def split_pieces(texts: pa.Array, how: str, kept: tuple[bytes, ...] = ()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of ``texts`` (none null), the place of every piece among them, and how many pieces each text has."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    buffer = texts.buffers()[2] if texts.buffers()[2] is not None else pa.py_buffer(b"")
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begins = cut_places(data, offsets, how, kept)
    begins = begins[begins < len(data)]
    bounds = np.append(begins, len(data)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64), np.diff(np.searchsorted(begins, offsets))


def give_back() -> None:
    """Hands freed memory back to the system, as an executor's workers share its limit; only glibc needs and has the call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts[i]`` values."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return ends[at[1:]] - ends[at[:-1]]
