"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed over the cells (source, language, topic), and the cells' weights are raked: scaled so that the sums of
one dimension meet its targets, then the next, over and over, until every sum is within a tolerance of its target. The
result fits every set of targets that the cells can meet together, and stays closest to the present mix. A document is
kept with its cell's ratio of fitted to present weight, scaled so that the largest is 1; a hash of the document decides,
so a rerun keeps the same ones.

Scale: texts are read once and never shuffled; raking works on a row per cell, written after every few rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = ("source", "lang", "topic")
BLANKS = " \t\n\x0b\x0c\r"


def n_tokens(text: Column) -> Column:
    """Words: runs of anything but space and \\x09-\\x0d."""
    clean = F.btrim(text, F.lit(BLANKS))
    return F.when(text.isNull() | (clean == ""), 0).otherwise(F.size(F.split(clean, "[\\x09-\\x0d\\x20]+"))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by what the text holds: contact data, licence terms, links, digits, or none of them. Texts are
    searched for plain strings first, as patterns are slow."""
    has = lambda *words: F.greatest(F.lit(False), *[F.coalesce(F.contains(text, F.lit(w)), F.lit(False)) for w in words])
    match = lambda pattern: F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False))
    return (
        F.when(has("@") & match(r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[a-z]"), "contact")
        .when(has("icense", "icence", "ICENSE", "ICENCE", "opyright", "OPYRIGHT"), "licence")
        .when(has("http://", "https://"), "links")
        .when(match("[0-9]{3}"), "numbers")
        .otherwise("prose")
    )


def tempered_targets(cells: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, power: float = 0.7) -> DataFrame:
    """(dimension, value, share): the present share of each value raised to a power below 1, which lifts small ones."""
    parts = [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("tokens").alias("t")) for d in dimensions]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    lifted = rows.filter("t > 0").select("dimension", "value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("t"))
    return lifted.withColumn("share", F.col("t") / F.sum("t").over(Window.partitionBy("dimension"))).drop("t")


def rake(
    cells: DataFrame, targets: DataFrame, *, dimensions: tuple[str, ...] = DIMENSIONS, tolerance: float = 1e-10, rounds: int = 64,
) -> DataFrame:
    """Adds `weight` (summing to 1) to cells (dimensions..., tokens). A value without a target keeps its share of what
    the targets of its dimension leave over. Cells without tokens get no row. Ends when each sum is within the tolerance
    of its target, or after so many rounds where the cells can't meet all targets."""
    rows = cells.filter("tokens > 0")
    # a table of one row is broadcast
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("tokens").alias("_all")))).withColumn("weight", F.col("tokens") / F.col("_all")).drop("_all")
    for d in dimensions:
        goal = targets.filter(F.col("dimension") == d).select(F.col("value").alias(f"v_{d}"), F.col("share").alias(f"goal_{d}"))
        rows = rows.join(goal, F.col(d).eqNullSafe(F.col(f"v_{d}")), "left").drop(f"v_{d}")
    rows = written(rows, "cells")
    block = 4
    for _ in range(0, rounds, block):
        for d in dimensions * block:
            scaled = F.col("weight") * F.col(f"goal_{d}") / F.sum("weight").over(Window.partitionBy(d))
            rows = rows.withColumn("weight", F.when(F.col(f"goal_{d}").isNull(), F.col("weight")).otherwise(scaled))
        rows = written(rows, "cells")  # a short plan
        gaps = [rows.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"goal_{d}")).alias("gap")).agg(F.max("gap").alias("gap")) for d in dimensions]
        gap = reduce(DataFrame.union, gaps).agg(F.max("gap")).first()[0]
        if gap is None or gap <= tolerance:
            break
    return rows.select(*dimensions, "tokens", "weight")


def mix(
    docs: DataFrame, *, targets: DataFrame | None = None, power: float = 0.7, tolerance: float = 1e-10, seed: int = 17, floor: float = 0.0,
    topic: Column | None = None,
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (of the cell), keep_probability, kept, one row per row.

    targets: (dimension, value, share); None stands for tempered_targets. floor raises small probabilities, at the price
    of the exact mix. topic: an expression; None stands for topic_of. Null sources and languages are values of their own.
    Texts without words have no weight and are not kept. Equal rows have equal outcomes."""
    number = F.col("doc_id").cast("long")
    dice = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), number.cast("string"), "text").cast("binary")), 1, 10), 16, 10).cast("long")
    rows = docs.select(
        number.alias("doc_id"), "source", "lang", (topic_of(F.col("text")) if topic is None else topic).alias("topic"), n_tokens(F.col("text")).alias("tokens"),
        (dice / float(1 << 40)).alias("dice"),
    )
    rows = written(rows, "tokens")
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, tempered_targets(cells, power=power) if targets is None else targets, tolerance=tolerance)
    raked = raked.withColumn("ratio", F.col("weight") / F.col("tokens"))
    raked = raked.crossJoin(F.broadcast(raked.agg(F.max("ratio").alias("most"))))  # of one row
    raked = raked.withColumn("keep_probability", F.greatest(F.col("ratio") / F.col("most"), F.lit(floor)))
    raked = raked.select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], "weight", "keep_probability")
    same = [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in DIMENSIONS]
    out = rows.join(raked, same[0] & same[1] & same[2], "left")
    kept = F.coalesce((F.col("tokens") > 0) & (F.col("dice") < F.col("keep_probability")), F.lit(False))
    zero = lambda c: F.coalesce(F.when(F.col("tokens") > 0, F.col(c)), F.lit(0.0)).alias(c)
    return out.select("doc_id", *DIMENSIONS, "tokens", zero("weight"), zero("keep_probability"), kept.alias("kept"))
