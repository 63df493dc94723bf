"""A training corpus from documents: quality, line dedup, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) with the columns of documents and works on all that the stage before kept. Rows
with a null doc_id are documents of their own, told apart by their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busframe.llm import jaccard, lines, mixing, packing, quality
from busframe.llm.common import document_key, shared_path, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    scored = docs.withColumn(score, model.column(F.col("text")))
    return scored.filter((F.col(score).quality >= 0.5) & (F.col(score).clean >= 0.5)).drop(score)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go; documents of which nothing is left go with them."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = lines.dedup_lines(docs, carry=others).filter(F.trim(F.col("text")) != "")
    return left.select(*[F.col(f"carried.`{c}`").alias(c) if c in others else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, in one row: the one with the smallest doc_id; null ids come last."""
    key, text = unused(docs, "key"), unused(docs, "hash")
    one = jaccard.representatives(docs).toDF(key, text)
    keys = {key: document_key(F.col("doc_id"), F.col("text"), last=True), text: F.xxhash64("text")}
    return docs.withColumns(keys).join(one, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their cell's calibrated probability, towards shares of sources, languages and topics of the
    power 0.9 of the present ones, which lifts small ones. A document is known by its id and text together."""
    own = F.xxhash64("doc_id", "text")
    key = unused(docs, "key")
    kept = mixing.mix(docs.withColumn("doc_id", own), power=0.9).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, own).join(kept, key, "left_semi").drop(key)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, length=1024)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The quality scorer, the forest and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
