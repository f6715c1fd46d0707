import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import CLASH, DOCS, plain_components, plain_fingerprint, plain_hits, plain_line_dedup
from txcompact.llm import ann, decontam, line_dedup, packing, ppm, quality, queries, simhash, token_count, toxicity, url_filter
from txcompact.llm.labelled import fit_sample

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and clashing further columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again today\nshared line", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog again and again today\nshared line", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\n ", "de", "b", 4),
        (None, "no id here at all\nShared Line ", "fr", "b", 3),
        (5, "the quick brown fox jumps over the lazy dog again and again today\nSHARED LINE", "en", "a", 10),
        (6, LONG, "es", "c", len(LONG)),
        (7, "É shared\x85line\x1c tail", "fr", None, 1),
        *((i, f"text number {i}\n shared line\t", "en", "a", 1) for i in range(20, 32)),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def pairs(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]


def test_line_dedup_matches_plain(odd_docs):
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(odd_docs).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain_line_dedup(pairs(odd_docs)), key=key)


def test_line_dedup_of_blank_runs_and_empty_tables(spark):
    blanks = "x" + " " * 1_000_000 + "y"
    rows = [(i, f"{blanks}\n\t{' ' * 1_000_000}\n{i}") for i in range(10)] + [(None, blanks), (None, None), (3, "3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("n_dropped", F.lit(7))
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()]
    assert sorted(got, key=str) == sorted(plain_line_dedup(rows), key=str)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_line_dedup_is_linear_in_dropped_lines(spark):
    long = "\n".join(f"drop {i % 997}" if i % 2 else f"keep {i}" for i in range(200_000))
    rows = [(0, long), *((i, "\n".join(f"drop {j}" for j in range(997))) for i in range(1, 11))]
    began = time.time()
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first()
    assert got.n_dropped == 100_000 and got.text == "\n".join(f"keep {i}" for i in range(0, 200_000, 2))
    assert time.time() - began < 60  # minutes when it grows with the square


def test_decontamination_is_linear_in_hits(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(0, " ".join([passage] * 10_000)), (1, "clean")], "doc_id long, text string")
    began = time.time()
    got = decontam.phrase_hits(docs, spark.createDataFrame([(1, passage), (2, passage)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.hit_items) for r in got] == [(200_000, 200_000, [1, 2]), (1, 0, [])]
    assert time.time() - began < 60


def test_decontamination_matches_plain(spark, odd_docs):
    items = [(1, "quick brown fox jumps over the lazy dog again and again today shared line"), (2, "lazy DOG"), (2, "again"), (3, None), (4, "..."), (None, "the"), (5, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11 word12 word13 word14")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    got = decontam.phrase_hits(odd_docs, bench).select("doc_id", "text", "n_words", "n_hit", "hit_items").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id != 6:
            assert (r.n_words, r.n_hit, list(r.hit_items)) == plain_hits(r.text, items), r.doc_id
        else:
            assert r.n_words == 30_000 and r.hit_items == [5] and r.n_hit == 14 * 31
    assert decontam.phrase_hits(odd_docs.limit(0), bench).count() == 0
    assert decontam.phrase_hits(odd_docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_proximity_finds_what_phrases_miss(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, "delta x x x x x x alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    near = lambda slop: {r.doc for r in decontam.proximity_matches(docs, items, slop).collect()}
    assert near(0) == {2} and near(1) == {1, 2}


def test_url_filter_nested_rules_and_odd_urls(spark):
    rules = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow"), ("example.net/en/bad", "block"), ("Example.net/en/bad", "allow"), (None, "block"), ("", "block"), ("bare", "block"), ("x.bare", "allow")], "rule string, action string")
    urls = ["http://EXAMPLE.net/en/x?y", "http://a.b.example.net/en/bad/1", "http://net/", "http://net", "http://notnet.com/", "nourl", None, "", "https://x.bare", "https://y.bare?q", "http://barefoot/", "a://b://c", "http://example.net/en/b\u00e9#z", "http://.net/a", "http://example.net/en"]
    df = spark.createDataFrame([(i % 5, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, key string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules, buckets=3).collect()}
    assert url_filter.judge_urls(df, rules).count() == 2 * len(urls)
    valid = [("net", "/", "net/", "block"), ("example.net", "/en/", "example.net/en/", "allow"), ("example.net", "/en/bad", "example.net/en/bad", "block"), ("bare", "", "bare", "block"), ("x.bare", "", "x.bare", "allow")]
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in valid if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[2]), default=(None, None, None, "allow"))
        assert got[u] == (host, path, best[2], best[3]), u
    assert url_filter.judge_urls(df, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_url_filter_ties_and_clashing_columns(spark):
    rules = spark.createDataFrame([("b.c/xy", "block"), ("a.b.c/x", "allow"), ("d.e/", "allow"), ("D.e/", "block")], "rule string, action string")
    urls = [(1, "http://a.b.c/xy", "p", "q", "r", "s"), (2, "http://d.e/", "p", "q", "r", "s"), (3, None, "p", "q", "r", "s")]
    df = spark.createDataFrame(urls, "page_id long, url string, host string, path string, rule string, verdict string")
    got = url_filter.judge_urls(df, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.host, r.rule, r.verdict) for r in got.collect()} == {1: ("a.b.c", "a.b.c/x", "allow"), 2: ("d.e", "D.e/", "block"), 3: ("", None, "allow")}


def test_simhash_matches_plain(spark, odd_docs, sf_dir):
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")):
        want = plain_components([(i, plain_fingerprint(t)) for i, t in ((r.doc_id, r.text) for r in docs.collect())])
        got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_simhash_hot_groups_are_cut_into_cells(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(0, 1 << 13, 12):
        for _ in range(40):
            x = int(base) << 40
            for b in rng.integers(0, 50, 3):
                x ^= 1 << int(b)
            fps.add(x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {(f, c) for f, _, c in plain_components([(f, f) for f in fps])}
    for limit in (4096, 16):
        roots = simhash.components(simhash.near_links(df, 4, group_limit=limit))
        found = dict((r.node, r.root) for r in roots.collect())
        groups = defaultdict(list)
        for f in fps:
            groups[found.get(f, f)].append(f)
        assert {(f, min(g)) for g in groups.values() for f in g} == want


def test_components_of_chains(spark):
    order = np.random.default_rng(0).permutation(200).tolist()
    for chain in (order, list(range(5000))):
        edges = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")
        rows = simhash.components(edges).collect()
        assert len(rows) == len(chain) and len({r.root for r in rows}) == 1
    assert simhash.components(edges.limit(0)).count() == 0


def test_more_fingerprints_are_cut_into_more_blocks(spark):
    assert [simhash.blocks_for(n, 4) for n in (1, 1 << 20, 1 << 26, 1 << 34, 1 << 40)] == [5, 5, 6, 7, 8]
    rng = np.random.default_rng(8)
    fps = {int(x) ^ sum(1 << int(b) for b in set(rng.integers(0, 63, k))) for x in rng.integers(0, 1 << 62, 60) for k in (0, 3, 4, 6)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for blocks in (5, 6, 7):
        links = simhash.components(simhash.near_links(df, 4, blocks=blocks)).collect()
        found, groups = {r.node: r.root for r in links}, defaultdict(list)
        for f in fps:
            groups[found.get(f, f)].append(f)
        assert {(f, min(g)) for g in groups.values() for f in g} == {(f, c) for f, _, c in plain_components([(f, f) for f in fps])}


def test_token_counts_match_the_library(odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = lambda t: len(tok.encode(t or "", add_special_tokens=False))
    want = sorted(((i, len((t or "").encode()), whole(t)) for i, t in pairs(odd_docs)), key=str)
    for chunk in (65536, 8192, 700):
        got = [tuple(r) for r in token_count.count_tokens(odd_docs, chunk=chunk).collect()]
        assert sorted(got, key=str) == want
    assert token_count.count_tokens(odd_docs.limit(0)).count() == 0
    encode = lambda s: tok.encode(s, add_special_tokens=False)

    def spliced(t, chunk, overlap, margin):
        bounds = token_count.chunk_bounds(len(t), chunk, overlap)
        return token_count.spliced_count(encode, t, bounds, [encode(t[a:b]) for a, b in bounds], margin)

    assert token_count.cuts_at_spaces(tok.to_str())
    for t in ("a" * 9000, "x y " * 3000, " \n\n  " * 2000, "foo<|endoftext|>bar  <|endoftext|> " * 500, "日本語 " * 2000, LONG[:50_000]):
        assert spliced(t, 300, 40, 16) == whole(t) == spliced(t, 2000, 128, 64) == spliced(t, 8192, 256, 64)


def test_tokens_of_pieces_too_long_to_remember(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "東京" * 500 + " end"), (2, "東京" * 500 + " end"), (3, "a" * 65 + " " + "b" * 64), (4, "a" * 65 + " " + "a" * 65), (5, "short")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_tokenizers_that_cannot_be_cut_are_given_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert not token_count.splices(tok.to_str()) and not token_count.cuts_at_spaces(tok.to_str())
    docs = spark.createDataFrame([(1, "Hello  wide\nworld " * 900)], "doc_id long, text string")
    want = len(tok.encode(docs.first().text, add_special_tokens=False))
    assert token_count.count_tokens(docs, "word_bpe_49k.json", chunk=500).first().n_tokens == want


def test_pairs_are_dealt_below_the_limit():
    sizes = {i: 1 + (i * 7919) % 97 for i in range(500)} | {501: 1000}
    dealt = ppm.deal_pairs(sizes, 300)
    loads = Counter()
    for pair, n in sizes.items():
        loads[dealt[pair]] += n
    assert sorted(loads.values())[-1] == 1000 and sorted(loads.values())[-2] <= 300 and len(loads) < 2 * sum(sizes.values()) / 300


def plain_ppm(train, text, order):
    """The definition, with dictionaries: method C escapes, exclusion, static counts."""
    trie = defaultdict(Counter)
    for t in train:
        h = b"\n" * order + t
        for i in range(order, len(h)):
            for k in range(order + 1):
                trie[h[i - k : i]][h[i]] += 1
    total, h = 0.0, b"\n" * order + text
    for i in range(order, len(h)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = {b: c for b, c in trie[h[i - k : i]].items() if b not in excluded}
            if not seen:
                continue
            den = sum(seen.values()) + len(seen)
            if h[i] in seen:
                total += math.log10(seen[h[i]] / den)
                break
            total += math.log10(len(seen) / den)
            excluded |= set(seen)
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize("node_limit, chunk_bytes, at_a_time", [(4_000_000, 4_000_000, 8_000_000), (60, 4_000_000, 8_000_000), (60, 50, 40)])
def test_lm_scores_match_plain(odd_docs, node_limit, chunk_bytes, at_a_time):
    docs = odd_docs.where("doc_id is null or doc_id <> 6").withColumn("is_training", F.expr("coalesce(doc_id, 0) % 3 <> 1"))
    rows = [(r.doc_id, r.text, r.is_training) for r in docs.select("doc_id", "text", "is_training").collect()]
    norm = [(i, (t or "").encode().lower().split(), f) for i, t, f in rows]
    train = [b" ".join(w) + b"\n" for _, w, f in norm if f]
    count = Counter(x for _, w, f in norm if f for x in [*w, b"\n"])
    n, v = sum(count.values()), len(count)
    want = []
    for i, w, f in norm:
        tokens = [*w, b"\n"]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens)
        want.append((str(i), f, len(tokens), sum(count[x] > 0 for x in tokens), n, round(base, 6), round(plain_ppm(train, b" ".join(w) + b"\n", 3), 6)))
    got = ppm.score_corpus(docs, "is_training", order=3, node_limit=node_limit, frequent_limit=5, chunk_bytes=chunk_bytes, at_a_time=at_a_time).collect()
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in got) == sorted(want)


def test_lm_without_training(odd_docs):
    few = odd_docs.where("doc_id = 1 or doc_id = 2").withColumn("t", F.lit(False))
    for r in ppm.score_corpus(few, "t").collect():
        n = 1 if r.doc_id == 2 else 78
        assert r.score == pytest.approx(-n * math.log10(256)) and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0
    assert ppm.score_corpus(few.limit(0), "t").count() == 0


def test_lm_shards_equal_one_trie(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", F.expr("doc_id % 3 = 0"))
    scores = lambda **k: {r.doc_id: round(r.score, 6) for r in ppm.score_corpus(docs, "t", **k).collect()}
    assert scores() == scores(node_limit=3000, chunk_bytes=20_000, at_a_time=5000)


def test_lm_adaptive(odd_docs):
    few = odd_docs.where("doc_id = 1 or doc_id = 2")
    once, twice = (ppm.adaptive_log10(b"the cat sat on the mat " * k) for k in (1, 2))
    assert once < twice - once < 0
    assert ppm.score_adaptive(few).count() == 3


def test_trie_probabilities_sum_to_one():
    text = b"abracadabra abracadabra\n"
    code, first, last = ppm.codes_of([text], 2)
    u, n = np.unique(code[first[0] : last[0]], return_counts=True)
    trie = ppm.Trie.build(u, n, 2)
    for context in (b"ab", b"\n\n", b"zz", b"za", b"a "):
        codes = np.array([context[0] << 16 | context[1] << 8 | s for s in range(256)], np.uint64)
        p = trie.log10(codes)
        assert (10.0**p).sum() == pytest.approx(1)
        assert p == pytest.approx(trie.walk(codes))


def test_packing_is_whole_and_keeps_conflicts_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 130)), None if i % 9 == 0 else f"s{i % 7 if i % 3 else 0}", int(i % 50 if i % 4 else 1)) for i in range(3000)]
    items = spark.createDataFrame([*rows, rows[5]], "id long, length long, source string, cluster long")
    got = packing.pack(items, 100, per_source=3, shard_rows=700).collect()
    by_id = {r[0]: r for r in rows}
    pieces = Counter((r.id, r.piece) for r in got)
    assert pieces == Counter((i, p) for i, n, *_ in [*rows, rows[5]] for p in range(max(1, -(-n // 100))))
    total = Counter()
    bins = defaultdict(list)
    for r in got:
        total[r.id] += r.length
        assert r.start == 100 * r.piece
        bins[r.bin_id].append(r)
    assert all(total[i] == by_id[i][1] * (2 if i == rows[5][0] else 1) for i in by_id)
    for members in bins.values():
        members.sort(key=lambda r: r.place)
        assert sum(r.length for r in members) <= 100
        assert [r.offset for r in members] == np.cumsum([0, *(r.length for r in members)])[:-1].tolist()
        assert max(Counter(by_id[r.id][3] for r in members).values()) == 1
        assert max(Counter(by_id[r.id][2] for r in members).values()) <= 3
    assert packing.pack(items.limit(0), 100).count() == 0


def test_packing_keeps_ids_as_they_are(spark):
    big = (1 << 60) + 1
    rows = [(big, 3, "a", 1), (None, 4, None, 2), (None, 4, None, 2), (None, 250, "b", None), (7, None, "b", 4)]
    got = packing.pack(spark.createDataFrame(rows, "id long, length long, source string, cluster long"), 100).collect()
    assert Counter((r.id, r.length) for r in got) == Counter([(big, 3), (None, 4), (None, 4), (None, 100), (None, 100), (None, 50), (7, 0)])
    same = spark.range(1).select(F.lit(None).cast("long").alias("id"), F.explode(F.array_repeat(F.lit(1).cast("long"), 5000)).alias("length"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("cluster"))
    shards = Counter(r.bin_id >> 32 for r in packing.pack(same, 10, shard_rows=500).collect())
    assert sum(shards.values()) == 5000 and len(shards) == 10


def test_packing_shard_is_best_fit():
    import pandas as pd

    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"id": range(400), "piece": 0, "length": rng.integers(1, 60, 400), "source": rng.choice(list("abcd"), 400), "cluster": rng.integers(0, 150, 400)})
    got = packing.pack_shard(rows, 100, 2)
    bins = []
    for r in got.itertuples():
        ok = [(100 - sum(x.length for x in b), k) for k, b in enumerate(bins) if sum(x.length for x in b) + r.length <= 100 and all(x.cluster != r.cluster for x in b) and sum(x.source == r.source for x in b) < 2]
        if ok:
            k = min(ok)[1]
        else:
            k = len(bins)
            bins.append([])
        bins[k].append(r)
        assert r.bin == k


def test_packable_handles_odd_rows(odd_docs):
    got = {(r.id, r.length) for r in packing.packable(odd_docs).collect()}
    assert {(2, 0), (3, 0), (4, 0), (6, 30_000), (None, 7)} <= got


def test_neighbours_recall_and_order(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in vectors.collect()}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    found = defaultdict(list)
    for r in ann.nearest(vectors, "vec_id % 20 = 0", shard_rows=200, beam=48, block_rows=10).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 20 == 0]:
        cos = x @ v[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(v[q]))
        want = [int(ids[i]) for i in np.lexsort((ids, -cos)) if ids[i] != q][:5]
        hits += len(set(want) & {i for i, _ in found[q]})
        assert len(found[q]) == 5 and [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True)
        for i, s in found[q]:
            assert s == pytest.approx(cos[np.searchsorted(ids, i)], abs=1e-12)
    assert hits >= 0.9 * 5 * len(found)


def test_recall_of_the_registered_search(spark):
    at = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in queries.QUERIES["op10_nearest"](spark, at).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cos = x @ x[q]
        cos[q] = -9
        hits += len(found[ids[q]] & set(ids[np.argsort(-cos)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(found)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(1, 40)] + [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]), (None, [1.0, 1.0]), (350, [1.0, 2.0, 3.0]), (400, [1e-30, 1e-30]), (450, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(0)).withColumn("shard", F.lit(0))
    got = defaultdict(list)
    for r in ann.nearest(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and set(got) == {0, 50, 400}
    assert got[50][0] == 400 and got[50][1:] == [0, 1, 2, 3]
    assert ann.nearest(df.limit(0), "vec_id % 50 = 0").count() == 0


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / max(1, y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name, label, cut, least", [("op2_toxicity", "toxic", 0.5, 0.95), ("op6_quality", "quality", 0.3, 0.97)])
def test_classifiers_on_held_out_rows(spark, name, label, cut, least):
    at = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[1] for r in spark.read.parquet(f"{at}/labels.parquet").select("doc_id", label).collect()}
    rows = queries.QUERIES[name](spark, at).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    score, predicted, y = map(np.array, zip(*held))
    assert auc(score, y) > least and (predicted == y).mean() > 0.95


def test_classifiers_on_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (20, None, None), (21, 0, 1), (22, 1, 0)], "doc_id long, quality int, toxic int")
    n = odd_docs.count()
    for some in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.fit(odd_docs, some)
        assert toxicity.scored(odd_docs, model).where("score between 0 and 1").count() == n
        assert toxicity.toxic_rows(odd_docs, model).where("rejected is not null").count() == n
        assert toxicity.scored(odd_docs.limit(0), model).count() == 0 == toxicity.toxic_rows(odd_docs.limit(0), model).count()
        assert quality.scored(odd_docs.limit(0), quality.fit(odd_docs, some)).count() == 0
        assert quality.scored(odd_docs, quality.fit(odd_docs, some)).where("score between 0 and 1").count() == n


def test_fit_sample_takes_an_id_once(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i % 3}", "en", i) for i in range(500)], "doc_id long, text string, lang string, _label int")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(7)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    sample, sizes = fit_sample(docs, labels, "toxic", extra=("lang",))
    learnt = [i for i in range(7) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(sample) == sorted(("text 2", i % 2, "en") for i in learnt)
    assert sizes == {y: n for y in (0, 1) if (n := sum(i % 2 == y for i in learnt))}
    assert len(fit_sample(docs, labels, "toxic", rows=2)[0]) == 2
    nulls = docs.withColumn("text", F.when(F.col("doc_id") != 1, F.col("text")))
    assert "" in [r[0] for r in fit_sample(nulls, labels, "toxic")[0]]
    long = docs.withColumn("text", F.expr("repeat('x', int(10 + doc_id))"))
    few = fit_sample(long, labels, "toxic", chars=30)[0]
    assert sum(len(r[0]) for r in few) <= 30 and {r[1] for r in few} == {0, 1}
    assert fit_sample(docs.limit(0), labels, "toxic")[0] == []


def test_toxicity_scores_match_a_direct_convolution():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"v{w}" for w in rng.integers(0, 30, rng.integers(1, 25))) + (" bad idiot" if i % 3 == 0 else "") for i in range(90)]
    model = toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(90)]), ["en"] * 90, {0: 60, 1: 30}, epochs=2)
    pad = max(toxicity.WIDTHS)
    for t in [*texts[:20], "", "unseen words only"]:
        rows = toxicity.rows_of(model.buckets, [toxicity.buckets_of(t)])[0].tolist()
        padded, pooled, k = rows + [0] * pad, [], 0
        for i, w in enumerate(toxicity.WIDTHS):
            # A window may reach into the padding but not beyond it.
            starts = range(len(rows) + pad - max(toxicity.WIDTHS) + 1)
            values = [sum(model.tables[k + j][padded[s + j]] for j in range(w)) for s in starts]
            pooled.append(np.maximum(np.max(values, axis=0) + model.bias[i], 0))
            k += w
        raw = float(np.concatenate(pooled) @ model.out + model.out_bias)
        a, b = model.scale
        assert model.score([rows])[0] == pytest.approx(1 / (1 + math.exp(-(a * raw + b))), abs=1e-5)


def test_quality_matches_a_plain_ftrl():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"v{w}" for w in rng.integers(0, 40, 12)) + (" junk !! junk" if i % 3 == 0 else " fine text") for i in range(60)]
    y = np.array([int(i % 3 != 0) for i in range(60)])
    model = quality.train(texts, y, {0: 20, 1: 40}, epochs=2)
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-4, 1e-4
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    def vector(t):
        at, x = quality.features(quality.word_hashes(t.encode(), {}))
        return {**dict(zip(at.tolist(), x.tolist())), "bias": 1.0}

    order = np.random.default_rng(1)
    for _ in range(2):
        for k in order.permutation([i for i in range(60) if i % 5 != 4]):
            x = vector(texts[k])
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y[k]) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    for t in [*texts[:15], "v1 v2 never seen"]:
        raw = sum(weight(i) * v for i, v in vector(t).items())
        at, x = quality.features(quality.word_hashes(t.encode(), {}))
        assert model.raw(at, x) == pytest.approx(raw, abs=1e-5)


def test_repeated_texts_score_alike(odd_docs):
    docs = odd_docs.where("doc_id in (1, 5)")
    model = toxicity.train([f"{x} {i} u{i} v{i}" for i in range(40) for x in ("nice day", "bad idiot")], np.array([0, 1] * 40), ["en"] * 80, {0: 40, 1: 40})
    scores = {r.score for r in toxicity.scored(docs, model).collect()}
    assert max(scores) - min(scores) < 1e-9
    a, b = toxicity.rows_of(model.buckets, [toxicity.buckets_of("a nice day"), toxicity.buckets_of("a bad idiot")])
    assert model.score([a, b])[0] < 0.5 < model.score([a, b])[1]


def test_item_digest(spark, sf_dir):
    rows = queries.QUERIES["op3_decontaminate"](spark, sf_dir).collect()
    assert {r.items_sha256 for r in rows if not r.n_items} == {hashlib.sha256(b"").hexdigest()}
