"""The registered queries of the thirteen operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clustering, jaccard, lines, media, mixing, negatives, packing, quality, sharding, substrings, superminhash, urls
from .common import table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), window=35)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), length=1024)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 7).alias("weight"), F.round("keep_probability", 6).alias("keep_probability"), "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(urls.labelled_urls(), "url string, label int")
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.train_urls(labelled))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_permutation_index, op2_substring_dedup, op3_best_fit_packing, op4_mixing, op5_line_dedup,
            op6_jaccard_join, op7_url_filter, op8_kd_sharding, op9_quality_classifier, op10_media_columns,
            op11_centroid_clustering, op12_superminhash, op13_hard_negatives,
        )
    }


#: Lines by plain SQL: a line's words are compared after each deletion, as text.
OP5_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM docs WHERE text IS NOT NULL),
solid AS (SELECT *, list_filter(string_split_regex(line, '[\x20\x09\x0b-\x0d]+'), lambda x: x <> '') AS w FROM lines),
firsts AS (
  SELECT line, any_value(w) AS w, min({'d': doc_id, 'l': line_no}) AS first FROM solid WHERE len(w) > 0 GROUP BY line),
long AS (SELECT line, first, w, len(w) AS n FROM firsts WHERE len(w) >= 5),
cut AS (
  SELECT line, first, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM long)),
replaced AS (SELECT i, n, v, min(first) AS first FROM cut GROUP BY i, n, v),
longer AS (SELECT v, n, min(first) AS first FROM cut GROUP BY v, n),
whole AS (SELECT line, first, n, array_to_string(w, ' ') AS v FROM long),
shorter AS (SELECT v, n, min(first) AS first FROM whole GROUP BY v, n),
near AS (
  SELECT c.line FROM cut c JOIN replaced r ON c.i = r.i AND c.n = r.n AND c.v = r.v WHERE r.first < c.first
  UNION SELECT w.line FROM whole w JOIN longer l ON w.v = l.v AND l.n = w.n + 1 WHERE l.first < w.first
  UNION SELECT c.line FROM cut c JOIN shorter s ON c.v = s.v AND s.n = c.n - 1 WHERE s.first < c.first),
kept AS (SELECT first.d AS doc_id, first.l AS line_no FROM firsts WHERE line NOT IN (SELECT line FROM near)),
marked AS (
  SELECT s.doc_id, s.line_no, s.line, (len(s.w) = 0 OR k.line_no IS NOT NULL) AS stays
  FROM solid s LEFT JOIN kept k ON s.doc_id = k.doc_id AND s.line_no = k.line_no)
SELECT d.doc_id, coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(m.kept, '')) END AS kept_md5
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed,
         string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE stays) AS kept
  FROM marked GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""


def op4_sql(rounds: int = 40) -> str:
    """Raking by plain SQL: so many rounds over three dimensions, one after the other."""
    has = lambda *words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
    steps, last = [], "c0"
    for i, d in enumerate(("source", "lang", "topic") * rounds, 1):
        steps.append(f"c{i} AS (SELECT source, lang, topic, tokens, g_source, g_lang, g_topic, w * g_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM {last})")
        last = f"c{i}"
    goals = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}), 0.7) AS p_{d}" for d in ("source", "lang", "topic"))
    shares = ", ".join(f"p_{d} / (SELECT sum(p) FROM (SELECT DISTINCT {d}, p_{d} AS p FROM lifted)) AS g_{d}" for d in ("source", "lang", "topic"))
    return f"""
WITH base AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, concat_ws('|', '17', doc_id::VARCHAR, text) AS key FROM documents),
docs AS (
  SELECT doc_id, source, lang, key,
    CASE WHEN regexp_matches(t, '[A-Za-z0-9._-]@[A-Za-z0-9-]+\\.[a-z]') THEN 'contact'
         WHEN {has("icense", "icence", "ICENSE", "ICENCE", "opyright", "OPYRIGHT")} THEN 'licence'
         WHEN {has("http://", "https://")} THEN 'links' WHEN regexp_matches(t, '[0-9]{{3}}') THEN 'numbers' ELSE 'prose' END AS topic,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0d]+')) AS tokens
  FROM base),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0),
lifted AS (SELECT *, {goals} FROM cells),
c0 AS (SELECT source, lang, topic, tokens, {shares}, tokens / sum(tokens) OVER () AS w FROM lifted),
{", ".join(steps)},
fitted AS (SELECT source, lang, topic, w, (w / tokens) / max(w / tokens) OVER () AS p FROM {last})
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens::BIGINT AS tokens,
  CASE WHEN d.tokens > 0 THEN round(f.w, 7) ELSE 0 END AS weight, CASE WHEN d.tokens > 0 THEN round(f.p, 6) ELSE 0 END AS keep_probability,
  d.tokens > 0 AND ('0x' || md5(d.key)[1:10])::BIGINT / 1099511627776.0 < f.p AS kept
FROM docs d LEFT JOIN fitted f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic
"""


def op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Clustering by plain SQL: all distances of a round by pairs of lists, then sums of each component."""
    steps, last = [], "c0"
    near = """SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.vec_id, v.q, c.c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)])::BIGINT AS d FROM kept v, {0} c) GROUP BY vec_id, q"""
    for i in range(1, rounds + 1):
        steps.append(f"""a{i} AS ({near.format(last)}),
s{i} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i),
c{i} AS (SELECT o.c, coalesce(n.q, o.q) AS q FROM {last} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{i} GROUP BY c) n ON o.c = n.c)""")
        last = f"c{i}"
    return f"""
WITH kept AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM kept ORDER BY h LIMIT {k})),
{", ".join(steps)},
last AS ({near.format(last)})
SELECT l.vec_id, l.c::INT AS cluster, l.d AS distance, (sum(l.d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia, (sum(l.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM last l JOIN {last} c ON l.c = c.c
"""


#: Near duplicates by plain SQL: shared shingles are counted for every pair that has one, links are followed to their ends.
OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
pairs AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN lowest l ON d.doc_id = l.a
"""

#: Hard negatives by plain SQL: all scores of the anchors, ranked.
OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_sum([z[1] * z[2] for z in list_zip(a.q, r.q)])::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    """These have exact SQL that is quick enough; the others are held against brute force in tests/llm."""
    return {
        "op4_mixing": op4_sql(), "op5_line_dedup": OP5_SQL, "op11_centroid_clustering": op11_sql(), "op12_superminhash": OP12_SQL, "op13_hard_negatives": OP13_SQL,
    }
