"""Shards by a k-d tree over metadata, in DataFrame functions only.

Equal texts are one group and stay together. A group has coordinates in several metadata dimensions (size, share of
bytes beyond ASCII, language, source) and a weight, its bytes. Starting from one node, every node is split at the
weighted median of its widest dimension until there are as many leaves as shards, or until leaves reach a target of
bytes. Where a node's groups agree in every dimension, a hash of the text parts them.

Scale: a level of the tree is one job that reads the groups of the level before and writes them with their new nodes.
Medians are found by histograms of 2**13 bins, then of the bin that holds the median, four rounds for 52 bits; counts
are combined before they are shuffled. What a level knows of its nodes (extents, cuts) is a small table that is joined
to the groups, never literals in the plan, so the plan is as long for 100,000 shards as for two, and the driver gets no
rows.

Groups heavier than a hundredth of a shard come first in every order, so that they are never next to a median while a
node has weight besides them, and shards stay equal up to one such group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

BITS, ROUNDS = 13, 4
#: Up to so many shards, and so rows of about 50 bytes, what is known of a level's nodes is broadcast.
BROADCAST_NODES = 1 << 16
TOP = 1 << (BITS * ROUNDS)


def text_size(text: Column) -> Column:
    """Bytes of UTF-8 (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def name_place(name: Column) -> Column:
    """A number that orders names by their first six bytes (null: 0)."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double") + 1, F.lit(0.0))


def document_dimensions(columns: list[str]) -> dict[str, Column]:
    """Metadata of a row: size, share of bytes beyond ASCII, and language and source where the table has them."""
    text = F.coalesce("text", F.lit(""))
    size = F.greatest(F.octet_length(text), F.lit(1))
    names = {c: name_place(F.col(c).cast("string")) for c in ("lang", "source") if c in columns}
    return {"log_size": F.log1p(F.octet_length(text).cast("double")), "beyond_ascii": (F.octet_length(text) - F.char_length(text)) / size, **names}


def kd_shards(groups: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """Rows (key, shard), one per row (key, weight, dimensions...) of groups. Null or equal coordinates are fine: the
    key's hash breaks ties. Where `shards` isn't a power of 2, nodes are split in proportion to the leaves on either
    side."""
    rows = groups.select("key", "weight", *dimensions)
    bounds = rows.agg(F.sum("weight").alias("all"), *[F.min(d).alias(f"a_{d}") for d in dimensions], *[F.max(d).alias(f"b_{d}") for d in dimensions])
    scaled = lambda d: F.coalesce(F.try_divide(F.col(d) - F.col(f"a_{d}"), F.col(f"b_{d}") - F.col(f"a_{d}")), F.lit(0.0))
    at = F.array(*[scaled(d) for d in dimensions])
    later = F.when(F.col("weight") >= F.col("all") / shards / 100, 0).otherwise(1)
    # bounds is one row
    rows = rows.crossJoin(F.broadcast(bounds)).select("key", "weight", at.alias("at"), later.alias("later"))
    rows = written(rows.select("*", F.lit(0).alias("first"), F.lit(shards).alias("leaves")), "groups")
    tie = F.pmod(F.xxhash64("key"), F.lit(1 << 28))
    small = F.broadcast if shards <= BROADCAST_NODES else lambda df: df  # there are at most as many nodes as shards
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        open_rows = rows.filter("leaves > 1")
        ends = [F.max(F.col("at")[i]) - F.min(F.col("at")[i]) for i in range(len(dimensions))]
        # of equal extents the first dimension's wins; "first" names a node: its first leaf
        nodes = open_rows.groupBy("first").agg(F.sum("weight").alias("w"), F.max("leaves").alias("n"), F.array(*ends).alias("extents"))
        nodes = nodes.select("first", (F.array_position("extents", F.array_max("extents")) - 1).cast("int").alias("dim"), (F.col("w") * F.floor(F.col("n") / 2) / F.col("n")).alias("wanted"), F.lit(0).cast("long").alias("begin"))
        # 24 bits of the coordinate, then 28 of the key; heavy groups first
        place = F.shiftleft((F.get(F.col("at"), F.col("dim")) * ((1 << 23) - 1)).cast("long") + F.col("later") * (1 << 23), 28) + tie
        for i in range(ROUNDS):
            step = TOP >> (BITS * (i + 1))
            bins = open_rows.join(small(nodes), "first").withColumn("bin", F.floor((place - F.col("begin")) / step)).filter(F.col("bin").between(0, (1 << BITS) - 1))
            bins = bins.groupBy("first", "bin", "dim", "begin", "wanted").agg(F.sum("weight").alias("w"))
            below = F.sum("w").over(Window.partitionBy("first").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            cut = bins.withColumn("below", below).filter(F.col("below") >= F.col("wanted")).groupBy("first").agg(F.min_by(F.struct("bin", "w", "below", "dim", "begin", "wanted"), "bin").alias("x")).select("first", "x.*")
            rest = F.col("wanted") - (F.col("below") - F.col("w"))
            # in the last round the group at the median goes to the nearer side
            beyond = F.when(rest * 2 >= F.col("w"), step).otherwise(0) if i == ROUNDS - 1 else F.lit(0)
            nodes = cut.select("first", "dim", rest.alias("wanted"), (F.col("begin") + F.col("bin") * step + beyond).alias("begin"))
        half = F.floor(F.col("leaves") / 2).cast("int")
        left = place < F.col("begin")
        split = rows.join(small(nodes.select("first", "dim", "begin")), "first", "left").select(
            "key", "weight", "at", "later", F.when((F.col("leaves") == 1) | left, F.col("first")).otherwise(F.col("first") + half).alias("first"),
            F.when(F.col("leaves") == 1, 1).when(left, half).otherwise(F.col("leaves") - half).alias("leaves"),
        )
        rows = written(split, "groups")
    return rows.select("key", F.col("first").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, *, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: law `bytes`, whole groups of equal texts per shard. A
    null text is a text of no bytes. A group's language and source are the smallest of its rows. With target_bytes the
    number of shards follows from the total. Rows may repeat; each has its own slot. An empty table gives no rows. A
    group heavier than a shard makes that shard heavier."""
    spark = docs.sparkSession
    dims = document_dimensions(docs.columns)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"), *[c.alias(f"_{d}") for d, c in dims.items()],
    )
    rows = written(rows, "sizes")
    dims = [f"_{d}" for d in dims]
    # texts that share a 64-bit hash stay together, too
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"), *[F.min(d).alias(d) for d in dims])
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    placed = rows.select("doc_id", "size", "text_crc32", "key", "row").join(kd_shards(groups, dims, shards), "key")
    # slots: rows are numbered in parts of a shard that a hash deals out, after the counts of the parts before
    parts = max(1, shuffle_partitions(spark))
    placed = written(placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "placed")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    out = placed.withColumn("own", own).join(starts, ["shard", "part"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
