import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import plain_components, plain_fingerprint, plain_hits, plain_line_dedup
from txcompact.llm import near_copies
from txcompact.llm.labelled import within

TOXIC = ["idiot", "moron"]


def corpus():
    """Documents with toxic words, a boilerplate line, near copies and benchmark passages, by id."""
    docs, labels = [], []
    passage = " ".join(f"bench{i}" for i in range(40))
    for i in range(240):
        words = [f"w{zlib.crc32(f'{i}-{k}'.encode()) % 5000}" for k in range(60)]
        if i % 6 == 0:
            words[10] = TOXIC[i // 6 % 2]
            words[30] = TOXIC[(i // 6 + 1) % 2]
        text = " ".join(words)
        if i % 7 == 0:
            text += "\nAll rights  reserved"
        if i % 11 == 0:
            text += "\n" + passage[:150]
        docs.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, 1, int(i % 6 == 0)))
    for i in range(240, 250):
        docs.append([i, docs[i - 239][1].upper() if i % 2 else docs[i - 239][1], "en", "s0", 1])
    docs.append([250, None, None, None, None])
    docs.append([251, "", "en", "s1", 0])
    return docs, labels, [(1, passage), (2, None)]


def test_pipeline_matches_plain_stages(spark, tmp_path):
    docs, labels, bench = corpus()
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    pq.write_table(pa.table({k: pa.array([d[j] for d in docs], t) for j, (k, t) in enumerate(kinds.items())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels]), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in bench]), "text": pa.array([b[1] for b in bench], pa.string())}), tmp_path / "benchmark.parquet")
    kept = [(d[0], d[1]) for d in docs if not re.search("|".join(TOXIC), (d[1] or "").lower())]
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = stage.columns
    want = None
    for name, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, str(tmp_path))
        if name == "line_dedup":
            kept = [(i, t) for i, _, _, t in plain_line_dedup(kept)]
        elif name == "simhash_near_dedup":
            kept = [(i, t) for (i, t), (_, _, c) in zip(kept, plain_components([(i, plain_fingerprint(t)) for i, t in kept])) if i == c]
        elif name == "decontamination":
            kept = [(i, t) for i, t in kept for n, h, _ in [plain_hits(t, bench)] if not (h and 20 * h >= n)]
        if name == "best_fit_packing":
            want = sorted((i, len(t.split())) for i, t in kept)
            assert sorted((r.doc_id, r.length) for r in stage.collect()) == want
        else:
            assert stage.columns == columns
            assert sorted((r.doc_id, r.text or "") for r in stage.collect()) == sorted((i, t or "") for i, t in kept), name
    assert sorted((r.doc_id, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    assert 100 < len(want) < 240


def test_near_copies_are_told_apart_by_row_not_by_id(spark):
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(2, other, "a"), (5, text, "a"), (5, other + " more", "b"), (None, text, "c"), (None, "unlike all the others here", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(2, other), (5, text), (None, "unlike all the others here")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_of_similarity_four_fifths_go_and_one_row_stays(spark, monkeypatch):
    from txcompact.llm import near_copies

    rows = []
    for i in range(12):
        words = [f"v{zlib.crc32(f'{i}-{k}'.encode()) % 9000}" for k in range(220)]
        for copy in range(3):
            own = list(words)
            for at in range(copy):  # each changed word is in five shingles
                for k in range(4):
                    own[20 + 25 * k + 100 * at] = f"new{copy}-{at}-{k}"
            rows.append((100 * i + copy, " ".join(own), "a"))
    common = " ".join(f"passage{k}" for k in range(30))
    rows += [(5000 + i, f"{common} {' '.join(f'own{i}-{k}' for k in range(30))}", "a") for i in range(20)]
    rows += [(7, "one row of two", "a"), (7, "one row of two", "b"), (None, "no id", "a"), (None, "no id", "a"), (None, "One row of two", "a"), (8, None, "a"), (9, " ", "a")]
    sets = [plain_shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for x in range(len(rows)):
        for y in range(x):
            both, either = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            if 5 * both >= 4 * either:
                linked += 1
                parent[top(x)] = top(y)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(top(x), []).append(rows[x][0])
    want = sorted((min((i for i in g if i is not None), default=-1) for g in groups.values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for frequent, limit in ((64, 1024), (3, 4)):
        monkeypatch.setattr(near_copies, "FREQUENT", frequent)
        monkeypatch.setattr(near_copies, "LIST_LIMIT", limit)
        got = corpus_pipeline.drop_near_copies(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == want
    assert linked > 12


def test_each_pair_of_the_second_round_is_given_once_and_none_is_lost(spark):
    import random
    import itertools

    from pyspark.sql import functions as F

    from txcompact.llm import near_copies as nc

    rng = random.Random(3)
    of = {sid: sorted(rng.sample(range(60), 30)) for sid in range(40)}
    counts = bytes([1] * nc.BUCKETS)
    rows = [(h, sid, 0, 0, 0, 128, counts, sid % 7, (hs + [nc.NO_HASH] * nc.CARRIED)[: nc.CARRIED]) for sid, hs in of.items() for h in hs]
    kinds = "h int, sid long, i int, j int, c int, n int, counts binary, root long, least array<int>"
    lists = spark.createDataFrame(rows, kinds).repartition(5)
    want = sorted((a, b) for a, b in itertools.combinations(of, 2) if a % 7 != b % 7 and set(of[a]) & set(of[b]))
    for given in (lists, lists.drop("least"), lists.withColumn("least", F.array_repeat(F.lit(nc.NO_HASH), nc.CARRIED))):
        got = nc.candidates(given, nc._across, ["h", "i", "j"], ["root", "c"])
        assert sorted(map(tuple, got.collect())) == want
    # Without the final distinct the pairs that carry a common hash come once.
    h = nc.np.array([5, 9, 9], nc.np.int32)
    least = nc.np.array([[5, 9], [5, 9], [9, nc.NO_HASH]], nc.np.int32)
    at = lambda *x: nc.np.array(x)
    assert nc._met_before(h, least, at(1, 1, 0), at(0, 2, 2)).tolist() == [True, False, False]


def test_a_chain_of_drifting_texts_is_one_group(spark):
    words = [f"d{zlib.crc32(str(k).encode()) % 100000}" for k in range(700)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(60)] + [(100 + i, " ".join(words[400 + 60 * i : 500 + 60 * i])) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 100, 101, 102, 103]


def test_prefixes_meet_however_many_halves_are_shared():
    rng = np.random.default_rng(7)
    for bits in (4, 7, 10, 40):
        for _ in range(300):
            n = int(rng.integers(1, 120))
            pool = np.unique(rng.integers(0, 1 << bits, 3 * n) << 32 | rng.integers(0, 1 << 20, 3 * n))
            a = rng.choice(pool, min(n, len(pool)), replace=False)
            b = np.unique(np.r_[a[: max(1, int(len(a) * rng.uniform(0.75, 1)))], rng.choice(pool, 3)])
            if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
                continue
            first = [near_copies.upper(x)[: near_copies.prefix_length(len(x))] for x in (np.unique(a), b)]
            assert len(np.intersect1d(*first))


def test_one_of_a_group_stays_beside_any_columns(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text if i < 4 else f"{text} more{i}" if i < 6 else f"another text number {i} with words of its own", {"k": i}, i, "x", None) for i in (3, 2, 2, 2, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, _id int, _th string, _rows string").withColumn("x", F.lit(1))
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r._id, r.m["k"]) for r in got.collect()) == [(2, 2, 2), (6, 6, 6), (7, 7, 7)]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_a_bounded_sample_stops_at_the_first_that_does_not_fit():
    rows = [(1, 5, 0, 10), (2, 1, 1, 90), (3, 2, 0, 50), (4, 3, 1, 10), (5, 4, 0, 5)]
    assert within(rows, 100) == [4, 5] and within(rows, 1000) == [1, 2, 3, 4, 5] and within(rows, 160) == [2, 3, 4, 5]
