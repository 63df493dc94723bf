"""Nulls, repeats, chains, small tables and SQL, beside test_brute and test_edges."""

import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute import classes, removed

import corpus_pipeline
from busframe.llm import ann, jaccard, lines, media, mixing, packing, queries, sharding, substrings

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"


def words(tag, n=60):
    return [f"{tag}{i}" for i in range(n)]


def test_near_copies_with_null_and_repeated_ids(spark):
    a, b = words("a"), words("b")
    close = [*a[:59], "z"]
    rows = [(None, " ".join(a)), (None, " ".join(a)), (None, " ".join(close)), (5, " ".join(b)), (5, " ".join(words("c"))), (9, " ".join(b)), (None, None), (None, "")]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in out) == sorted([(0, 0, 2)] * 3 + [(5, 5, 1), (5, 5, 0), (9, 5, 1), (0, 0, 0), (0, 0, 0)])
    first = jaccard.representatives(spark.createDataFrame(rows, TEXTS)).collect()
    assert len(first) == 5  # a and close, b, c, null, empty


def test_a_chain_of_near_copies(spark):
    stream = words("s", 400)
    texts = {i: " ".join(stream[4 * i : 4 * i + 60]) for i in range(80)}  # neighbours share 52 of 60 grams, so the chain holds; the ends share none
    texts |= {1000 + i: " ".join(words(f"t{i}x", 40) + stream[:12]) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), TEXTS)
    want = classes(texts)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(df).collect()} == want
    assert len({c for d, (c, _) in want.items() if d < 80}) == 1


def test_a_large_group_of_near_copies(spark, monkeypatch):
    base, rng = words("w", 200), np.random.default_rng(8)
    texts = {}
    for i in range(1200):
        w = list(base)
        w[rng.integers(200)] = f"x{i}"
        texts[i] = " ".join(w)
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 100)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 400)
    out = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), TEXTS)).collect()
    assert {r.class_id for r in out} == {0} and {r.n_links for r in out} == {1199}  # two changed words leave 186 of 206 grams at least


def test_recall_of_the_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = classes(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs).collect()}
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values())
    assert all(got[d][1] <= want[d][1] for d in want)


def test_trie_links():
    rng = np.random.default_rng(1)
    signs = rng.integers(0, 1 << 16, (6, 24)).astype(np.uint16)
    signs[1] = signs[0]
    signs[3, :14] = signs[2, :14]  # 14 of 24 alike
    links = jaccard.trie_links(np.arange(6), signs, signs[:, :12], 5, 0.55, 0.85)
    assert {tuple(sorted(x)) for x in links} == {(0, 1), (2, 3)}


def test_substrings_with_nulls_and_repeats(spark):
    shared = words("p", 40)
    rows = [(None, " ".join(words("a", 50) + shared)), (None, " ".join(shared + words("b", 50))), (3, " ".join(shared)), (3, " ".join(shared)), (4, " ".join(words("c", 90))), (None, None)]
    df = spark.createDataFrame(rows, TEXTS)
    want = removed(dict(enumerate(t for _, t in rows)), 35)
    for hot in (2000, 1):
        got = substrings.dedup_substrings(df, hot=hot).collect()
        assert Counter(tuple(r)[1:] for r in got) == Counter(want.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_prefixes(spark, seed):
    """Passages of many copies in other surroundings, some cut short, some at the ends of texts."""
    rng = np.random.default_rng(seed)
    passage, texts = words("p", 70), {}
    for i in range(40):
        a, b = sorted(rng.integers(0, 71, 2))
        cut = passage[a:b] if i % 3 else passage
        texts[i] = " ".join(list(rng.choice(words("q", 30), rng.integers(0, 40))) + cut + list(rng.choice(words("r", 30), rng.integers(0, 40))))
    out = substrings.dedup_substrings(spark.createDataFrame(list(texts.items()), TEXTS), hot=2).collect()
    assert {r.doc_id: tuple(r)[1:] for r in out} == removed(texts, 35)


def test_lcp():
    rows = np.array([[3, 1, 2, 9], [3, 1, 2, 8], [1, 1, 1, 1], [3, 1, 5, 5]], np.uint64)
    order, shared = substrings.common_prefixes(rows, np.array([4, 4, 4, 4]))
    assert order.tolist() == [2, 1, 0, 3] and shared.tolist() == [0, 0, 3, 2]


def test_small_tables_of_vectors(spark):
    for n in (2, 12, 16, 21):
        x = np.random.default_rng(n).normal(size=(n, 8))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        out = ann.search(df, F.col("vec_id") == 0, k=20).collect()
        want = sorted((-float(x[0] @ x[i]), i) for i in range(1, n))[:20]
        assert [r.vec_id for r in sorted(out, key=lambda r: r.rank)] == [i for _, i in want]


def test_many_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    began = time.time()
    out = sharding.shard_documents(docs, shards=64).collect()
    assert time.time() - began < 60
    size, groups = Counter(), defaultdict(set)
    for r in out:
        size[r.shard] += r.size
        groups[r.text_crc32].add(r.shard)
    assert set(size) <= set(range(64)) and all(len(g) == 1 for g in groups.values())
    assert max(size.values()) <= sum(size.values()) / 64 + 2 * max(r.size for r in out)


def test_shards_split_the_widest_dimension(spark):
    """Two far groups along one dimension part there, whatever the others say."""
    rows = [(f"k{i}", 10, float(i % 2 * 100), float(i % 7)) for i in range(64)]
    groups = spark.createDataFrame(rows, "key string, weight long, x double, y double")
    out = {r.key: r.shard for r in sharding.kd_shards(groups, ["x", "y"], 2).collect()}
    assert {out[k] for k, _, x, _ in rows if x == 0} == {0} and {out[k] for k, _, x, _ in rows if x == 100} == {1}
    same = spark.createDataFrame([(f"k{i}", 1, None, 1.0) for i in range(40)], "key string, weight long, x double, y double")
    assert set(Counter(r.shard for r in sharding.kd_shards(same, ["x", "y"], 4).collect()).values()) == {10}


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    assert sorted(map(tuple, queries.op4_mixing(spark, "/root/testdata/sf0.01").collect())) == sorted(con.execute(queries.op4_sql()).fetchall())


def test_words_and_topics(spark):
    rows = ["", " \t\n", "one", " one  two\n", None, "mail me: a.b@c-d.org", "the Licence text", "see http://x", "room 1234", "12 34"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    out = df.select(mixing.n_tokens(F.col("t")), mixing.topic_of(F.col("t"))).collect()
    assert [r[0] for r in out] == [len((t or "").split()) for t in rows]
    assert [r[1] for r in out] == ["prose"] * 5 + ["contact", "licence", "links", "numbers", "prose"]


def test_packing_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "same text")] * 300 + [(None, None)] * 300, TEXTS)
    out = packing.pack_documents(df, length=16, group_items=50).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(out) == 600 and all(sum(n for _, n in b) <= 16 for b in bins.values())
    assert len(bins) <= sum(r.length for r in out) / 16 * 1.2 + 12


def test_equal_texts_have_equal_media(spark):
    df = spark.createDataFrame([(1, "text"), (2, "text"), (3, ""), (4, None), (5, "é" * 500)], TEXTS)
    out = {r.doc_id: r for r in media.media_features(df).collect()}
    same = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert [out[1][c] for c in same] == [out[2][c] for c in same] and [out[3][c] for c in same] == [out[4][c] for c in same]
    assert out[5].n_bytes == 1000 and out[5].tail_crc32 == zlib.crc32(("é" * 500).encode().ljust(1024, b"\0")[-64:])
    assert all(r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature for r in out.values())


def test_odd_lines(spark):
    """Tabs, runs of blanks, short and odd lengths against words compared one by one."""
    rng = np.random.default_rng(12)
    texts = {}
    for i in range(40):
        out = []
        for _ in range(3):
            w = list(rng.choice(list("abcdefg"), rng.integers(3, 9)))
            out.append(rng.choice([" ", "\t", "  "]).join(w) + rng.choice(["", " ", "\t"]))
        texts[i] = "\n".join(out)
    from test_brute import WORD, distance

    seen, want = [], {}
    for d, t in texts.items():
        keep = []
        for line in t.split("\n"):
            w = WORD.findall(line)
            if not any(line == x or (len(w) >= 5 and len(v) >= 5 and distance(w, v) <= 1) for x, v in seen):
                keep.append(line)
            seen.append((line, w))
        want[d] = "\n".join(keep)
    assert {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(list(texts.items()), TEXTS)).collect()} == want


def test_near_duplicate_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()}
    want = classes({r.doc_id: r.text for r in docs.collect()})
    assert kept == {c for c, _ in want.values()}
