"""Nulls, empty and long texts, ties and repeated rows, empty tables, and columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from busframe.llm import ann, jaccard, lines, media, mixing, packing, quality, sharding, substrings, urls

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "the same text here again and again"), (1, "the same text here again and again"), (2, "the same text here again and again"), (3, None), (4, ""), (5, " \t\n "), (None, "no number"), (6, LONG),
    (7, "é ü 漢字 \u2028 mixed\nlines\n\nhere"), (8, "x" * 50_000), (9, "\n".join(["a line of five words", "a line of five words", "a line of six words more"])),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, v int, dk long, group string, one long, h1 int, shard int, first string, block int, place int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None if (d or 0) % 3 else "en", None if (d or 0) % 4 else "s", None if t is None else len(t), "k", 1, 2, 3, "g", 4, 5, 6, "f", 7, 8) for d, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def classified(docs):
    return quality.classify(docs, quality.fit(docs, docs.sparkSession.createDataFrame([(1, 1, None), (1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")))


OPERATORS = {
    "substrings": substrings.dedup_substrings, "mixing": mixing.mix, "lines": lines.dedup_lines, "jaccard": jaccard.near_duplicates, "sharding": sharding.shard_documents, "quality": classified,
    "media": media.media_features,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_per_row(docs, empty, name):
    out = OPERATORS[name](docs).collect()
    ids = lambda rows: sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    assert ids(out) == ids(docs.collect())
    assert OPERATORS[name](empty).count() == 0
    same = [r for r in out if r.doc_id == 1]
    skip = {"slot"}
    strip = lambda r: {k: v for k, v in r.asDict().items() if k not in skip}
    assert strip(same[0]) == strip(same[1])


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_defined_results(docs):
    s = by_id(substrings.dedup_substrings(docs))
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((s[i].n_words, s[i].n_removed, s[i].kept_sha256) == (0, 0, nothing) for i in (3, 4, 5))
    assert s[6].n_words == 30_000 and s[6].n_removed == 30_000  # its own windows repeat
    n = by_id(lines.dedup_lines(docs))
    assert n[3].text is None and n[3].n_lines == 0 and n[4].text == "" and n[5].n_removed == 0
    assert (n[9].n_lines, n[9].n_removed, n[9].text) == (3, 1, "a line of five words\na line of six words more")
    assert n[1].n_removed == 0 and n[2].n_removed == 1 and n[2].text == ""
    j = by_id(jaccard.near_duplicates(docs))
    assert (j[2].class_id, j[2].n_links) == (1, 2) and (j[3].class_id, j[3].n_links) == (3, 0) and j[None].class_id is None
    m = by_id(mixing.mix(docs))
    assert not m[3].kept and m[3].tokens == 0 and m[6].tokens == 30_000
    assert by_id(classified(docs))[4].verdict == "reject"
    p = by_id(media.media_features(docs))
    assert p[3].n_bytes == 0 and p[3].payload_bytes == 64
    h = sharding.shard_documents(docs, shards=3)
    assert h.filter("doc_id in (1, 2)").select("shard").distinct().count() == 1
    assert sharding.shard_documents(docs, shards=None, target_bytes=40_000).select("shard").distinct().count() >= 3


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    assert sum(1 for r in rows if r.doc_id == 1) == 2
    assert [r.length for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert packing.pack_documents(empty).count() == 0


def test_urls(spark):
    labelled = spark.createDataFrame([("http://a.b/c", 1), (None, 0), ("http://x.y/z", None)], "url string, label int")
    model = urls.train_urls(labelled)
    pages = spark.createDataFrame([(1, None, "h"), (None, "http://" + "a" * 5000, None), (2, "", "x"), (2, "", "x")], "page_id long, url string, host string")
    assert urls.filter_urls(pages, model).count() == 4
    assert urls.filter_urls(pages.limit(0), model).count() == 0
    assert urls.filter_urls(pages, model, rules=[]).filter("rule is not null").count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(30)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, nan, 1.0]), (103, [inf, 1.0, 1.0]), (104, [1.0, None, 1.0]), (105, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (0, [1.0, 0.0, 0.5])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<float>, ids int, file int")
    out = ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    x = {i: v for i, v in rows}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for q in (0, 20):
        want = sorted((-dot(x[q], x[i]), i) for i in x if i != q)[:5]
        assert [(r.vec_id, r.rank) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == [(i, k + 1) for k, (_, i) in enumerate(want)]
    assert {r.query_id for r in out} == {0, 20}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(one, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 2.0)]
    long = spark.createDataFrame([(i, [float(1 + i), float(50 - i)]) for i in range(50)], "vec_id long, embedding array<float>")  # lengths differ
    got = {r.vec_id for r in ann.search(long, F.col("vec_id") == 0, k=3, prefix=16).collect()}
    assert got == {v for _, v in sorted((-(1 * (1 + i) + 50 * (50 - i)), i) for i in range(1, 50))[:3]}


def test_members_are_retried(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    archives = media.write_archives(df, str(tmp_path)).collect()
    read = lambda **o: media.read_archives(spark, str(tmp_path), archives, **o)
    assert read(range_bytes="700").count() == 40 and read(range_bytes="700").rdd.getNumPartitions() > 5
    file = tmp_path / archives[0].archive
    data = bytearray(file.read_bytes())
    data[data.index(b"IDAT") + 9] ^= 255
    file.write_bytes(data)
    rows = read(on_error="null").collect()
    assert len(rows) == 40 and sum(r.media is None for r in rows) == 1
    with pytest.raises(Exception, match="checksum"):
        read().collect()
    assert media.features(read(on_error="null")).filter("feature is null").count() == 1
    with pytest.raises(ValueError):
        media.decode_png(b"rubbish")


def test_stages(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        sf = "/root/testdata/sf0.001"
        out = stage(spark, docs, sf)
        out.collect()
        if name != "packing":
            assert out.columns[:5] == docs.columns[:5]
        assert stage(spark, empty, sf).count() == 0


def test_pipeline(spark):
    from collections import Counter

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= n
        n = docs.count()
        if name == "lines":
            seen = Counter(x for r in docs.collect() for x in r.text.split("\n") if x.strip())
            assert max(seen.values()) == 1
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept


def test_stages_with_null_ids(spark):
    stages, sf = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"
    shared = "one more line that both texts have"
    rows = [(None, f"first {i} " + f"word{i} " * 4 + f"\n{shared}", f"l{i}", f"s{i}") for i in range(3)] + [(1, "a text with an id of its own", "l", "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = stages["lines"](spark, docs, sf).collect()
    assert sum(r.text.count(shared) for r in out) == 1 and len(out) == 5
    assert sorted((r.text[6], r.lang, r.source) for r in out if r.doc_id is None) == [(str(i), f"l{i}", f"s{i}") for i in range(3)]
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abc"]
    rows = [(None, texts[0], "l", "s"), (None, texts[0], "l", "s"), (None, texts[1], "l", "s"), (7, texts[1], "l", "s"), (8, texts[2], "l", "s"), (8, texts[2], "l", "s"), (None, texts[2] + " end", "l", "s")]
    docs = spark.createDataFrame(rows, docs.schema)
    one = stages["near_duplicates"](spark, docs, sf)
    assert sorted(((r.doc_id or 0), r.text) for r in one.collect()) == [(0, texts[0]), (7, texts[1]), (8, texts[2])]
    assert stages["mixing"](spark, one, sf).count() == 3


def test_different_texts_under_one_id(spark):
    first, near = "one two three four five six", "one two three four five seven"
    rows = [(1, first, "a"), (7, "nothing of the kind\nhere", "b"), (7, f"a line alone\n{near}", "c"), (7, f"a line alone\n{near}", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [(r.doc_id, r.n_removed, r.text, r.carried.source) for r in lines.dedup_lines(docs, carry=["source"]).collect()]
    assert sorted(out) == [(1, 0, first, "a"), (7, 0, rows[1][1], "b"), (7, 1, "a line alone", "c"), (7, 1, "a line alone", "c")]


def test_stages_keep_columns_of_their_own_names(spark):
    """Extra columns come out as they went in, whatever they are called."""
    sf = "/root/testdata/sf0.001"
    names = {"score": 0.5, "_key": "k", "_hash": "h", "key": "x", "hash": 1, "_score": "s", "carried": "c", "dk": 3, "front": 4, "line_no": 5, "a.b": 6, "Text2": "t"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for c, v in names.items():
        docs = docs.withColumn(c, F.lit(v))
    docs = docs.withColumn("own", F.concat(F.lit("own"), "doc_id"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r["own"] == f"own{r.doc_id}" and all(r[c] == v for c, v in names.items()) for r in rows), name
    assert corpus_pipeline.packing_stage(spark, docs, sf).count() > 0
