"""Pieces, token files and the alignment of two tokenizers, against the libraries and plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txcompact.llm import align, pieces, token_files
from txcompact.llm.common import shared_dir

SIGNS = [*"abZz09 '.,\n\t\r \x1c\x1f", "é", "×", "÷", "ß", "\xa0", "\x85", " ", "▁", "日本", "́", "¹", "'s", "'ll", "<|endoftext|>", "<|", "|>", "  ", "\n\n", "😀", "　", "\x00", "’"]


def strange_texts(n: int) -> list[str]:
    rng = random.Random(5)
    return ["", " ", "  ", "a ", "\n", *("".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 24))) for _ in range(n))]


def byte_tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("special", [False, True])
def test_pieces_give_the_ids_of_whole_texts(special):
    tok = byte_tokenizer()
    tok.encode_special_tokens = special
    encoder, texts = pieces.ByteEncoder(tok), strange_texts(5000)
    memo = pieces.Memo(lambda keys: (encoder(keys), None), longest=6, most=3000)
    got = []
    for some in pieces.slices(pa.array(texts), 20_000):
        keys, places, per_text = pieces.split_pieces(some, encoder.how, encoder.kept)
        ids, sizes = memo.take(0, memo.codes(keys)[places])
        memo.forget()
        got += [x.tolist() for x in np.split(ids, np.cumsum(pieces.totals(sizes, per_text))[:-1])]
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts():
    assert not pieces.byte_level(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        assert pieces.piece_level(f.read())


def test_packing_round_trips_and_reads_ranges():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4096, 4097, 20_000):
        for bits in (1, 2, 16, 60, 61, 64):
            ids = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1) >> np.uint64(64 - bits)
            ids[rng.random(n) < 0.5] >>= np.uint64(min(bits - 1, 20))
            source = pa.BufferReader(token_files.file_bytes([7, None, 9], np.array([n // 2, 0, n - n // 2]), ids))
            held = token_files.TokenFile(source)
            assert held.missing.tolist() == [False, True, False] and held.sizes.sum() == n
            for a, b in ((0, n), (n // 3, n // 2), (n, n), (max(0, n - 1), n)):
                assert (held.ids(a, b) == ids[a:b]).all()


def plain_ids(rows, end=2):
    """rows: (id, text) -> (id, start, n, ids), nulls first."""
    tok, at, out = byte_tokenizer(), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), ids))
        at += len(ids)
    return out


def test_token_files_hold_every_document(spark):
    texts = strange_texts(60)
    rows = [*((i * 7 % 61, t) for i, t in enumerate(texts)), (1000, "word " * 30_000), (1001, None), (None, "no id"), (-5, "x" * 50_000)]
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("at", F.lit(2)).repartition(5)
    for file_ids in (500, 2_000_000):
        files = token_files.write_token_files(docs, f"{shared_dir(spark)}/ids-{file_ids}", file_ids=file_ids)
        got = [(r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in token_files.read_token_files(files).collect()]
        assert sorted(got, key=lambda r: r[1]) == plain_ids(rows)
        digests = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.read_token_files(files, digest=True).collect()}
        assert digests == {(i, s): zlib.crc32(np.array(x, "<u4").tobytes()) for i, s, _, x in plain_ids(rows)}
    empty = token_files.write_token_files(docs.limit(0), f"{shared_dir(spark)}/ids-none")
    assert token_files.read_token_files(empty).count() == 0


def test_repeated_ids_stand_together(spark):
    rows = [(5, "same text")] * 40 + [(5, f"text {i}") for i in range(20)] + [(4, "before"), (6, "after")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = token_files.read_token_files(token_files.write_token_files(docs, f"{shared_dir(spark)}/ids-again")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [4, *[5] * 60, 6]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    tok = byte_tokenizer()
    assert sorted(list(r.ids) for r in got) == sorted([*tok.encode(t, add_special_tokens=False).ids, 2] for _, t in rows)


def plain_alignment(rows):
    """rows: (id, text) -> results as the operator's, by sets of byte offsets."""
    tok = byte_tokenizer()
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    entries = pieces.token_bytes(tok)
    docs = []
    for i, t in rows:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        own_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(entries[x] for x in a) != whole or b"".join(own_b) != whole:
            docs.append((i, [], [], [], []))
            continue
        spans_a, spans_b = [], []
        for spans, ids, sizes in ((spans_a, a, [len(entries[x]) for x in a]), (spans_b, b, [len(x) for x in own_b])):
            at = 0
            for x, n in zip(ids, sizes):
                spans.append((at, at + n, x))
                at += n
        shared = sorted({e for _, e, _ in spans_a} & {e for _, e, _ in spans_b})
        groups, low = [], 0
        for e in shared:
            inside = lambda spans: ",".join(str(x) for s, f, x in spans if s >= low and f <= e)  # noqa: B023, E731
            groups.append(f"{inside(spans_a)}|{inside(spans_b)}")
            low = e
        docs.append((i, a, b, groups, [(x, y) for s, e, x in spans_a for u, v, y in spans_b if s < v and u < e]))
    counts = Counter(p for d in docs for p in set(d[4]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, a, b, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out, counts


@pytest.mark.parametrize("heavy", [align.HEAVY, 40])
def test_alignment_matches_plain(spark, sf_dir, heavy):
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(25).collect()]
    rows = [*enumerate(strange_texts(120)), *own, (3, "again and again"), (3, "again and again"), (None, "no id"), (900, None), (901, "▁"), (902, "x" * 3000), (903, "日本 語 " * 50), (904, "a\x00b <|endoftext|> c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("id", F.lit(2)).repartition(4)
    got, pairs = align.align(docs, heavy=heavy)
    want, counts = plain_alignment(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts
    assert align.align(docs.limit(0))[0].count() == 0
