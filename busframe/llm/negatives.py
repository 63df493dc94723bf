"""Hard negatives by exact integer scores: matrix products in a residue number system.

The scores of a block of anchors against a slice of rows are wanted exactly, and integer matrix products are slow. So the
integer components are reduced modulo a few small primes, to residues of at most 125 either way; their products are
taken in float32, where sums of up to 1024 of them are exact; and Chinese remaindering puts the signed score together
from its residues. A block takes as many primes as its own largest components need, so every score is exact.

1. In a first pass each block gives the best same-label rows of each anchor; a window over the blocks picks the
   positives.
2. In a second pass each block gives, for each anchor and positive, the best different-label rows whose score lies in
   the positive's window; a window over the blocks picks the negatives.

Scale: anchors are a stated query set against all rows, in blocks; every pair is scored, twice. Slices hold at most
SLICE_ROWS rows and blocks BLOCK_ANCHORS anchors, dealt out by row number, so a hot label, id or vector fills none of
them; scores never leave a task, only a few rows for each anchor do. Nothing reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .clustering import LIMIT
from .common import shuffle_partitions, written

#: Small primes, largest first; a residue is at most 125 either way.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)
SLICE_ROWS, LEAST_ROWS, BLOCK_ANCHORS, CHUNK = 65536, 4096, 4096, 64
EXACT_TERMS = 1024  # 1024 * 125 ** 2 < 2 ** 24


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, between -(p - 1) / 2 and (p - 1) / 2, for float32 integers below 2 ** 24 (beyond about 2 ** 22 the result
    may be a neighbour by p, still of the same residue)."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product tells apart all numbers from -bound to bound."""
    product = 1
    for i, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound:
            return PRIMES[: i + 1]
    raise OverflowError("scores beyond the range of the primes")


class Residues:
    """An integer matrix by its balanced residues, ready to be multiplied."""

    def __init__(self, x: np.ndarray, primes: tuple[int, ...]):
        half = lambda r, p: np.where(r > p // 2, r - p, r).astype(np.float32)
        self.parts = [np.ascontiguousarray(half(np.mod(x, p), p)) for p in primes]


def product_residues(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, from float32 products of at most EXACT_TERMS terms."""
    if a.shape[1] <= EXACT_TERMS:
        return balanced(a @ b.T, p)
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, a.shape[1], EXACT_TERMS):
        out = balanced(out + balanced(a[:, at : at + EXACT_TERMS] @ b[:, at : at + EXACT_TERMS].T, p), p)
    return out


def exact_scores(a: Residues, b: Residues, primes: tuple[int, ...], at: slice = slice(None)) -> np.ndarray:
    """Signed integer products of the rows `at` of a with the rows of b. Chinese remaindering in a balanced mixed radix:
    each prime adds one digit between -(p - 1) / 2 and (p - 1) / 2, found modulo that prime from the digits before it, so
    all but the last sum stays in float32, and the sign comes by itself."""
    digits, weights, product = [], [], 1
    for x, y, p in zip(a.parts, b.parts, primes, strict=True):
        rest = product_residues(x[at], y, p)
        for d, w in zip(digits, weights, strict=True):
            small = (w + p // 2) % p - p // 2
            rest = balanced(rest - d * np.float32(small), p)
        inverse = (pow(product, -1, p) + p // 2) % p - p // 2
        digits.append(balanced(balanced(rest, p) * np.float32(inverse), p))
        weights.append(product)
        product *= p
    total = digits[0].astype(np.int64)
    for d, w in zip(digits[1:], weights[1:], strict=True):
        total += d.astype(np.int64) * w
    return total


def usable_rows(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    x = F.col(vector_column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < LIMIT))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), x.cast("array<double>").alias("x"), fine.alias("fine"))
    return rows.filter("vec_id is not null and label is not null and x is not null and fine").drop("fine")


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, q: the integer components, as little-endian int32 in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            q = np.floor(np.asarray(x.flatten(), float) * scale).astype("<i4")
            n = len(q) // max(1, len(b))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([q[i * n : (i + 1) * n].tobytes() for i in range(len(b))], pa.binary())], names=["vec_id", "label", "q"])

    return rows.mapInArrow(run, "vec_id long, label long, q binary")


def matrix(q: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(q), "<i4").reshape(len(q), -1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores that fit, ties by smaller id."""
    at = np.flatnonzero(fits)
    if len(at) > n:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - n)[len(s) - n]]
    return at[np.lexsort((ids[at], -score[at]))[:n]]


def scored(rows: pd.DataFrame, anchors: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """The place of each anchor and its scores with all rows."""
    x, a = matrix(rows.q), matrix(anchors.q)
    high = lambda m: int(np.abs(m).max(initial=0))
    primes = primes_for(max(1, high(x) * high(a) * x.shape[1]))
    x, a = Residues(x, primes), Residues(a, primes)
    for at in range(0, len(anchors), CHUNK):
        yield from enumerate(exact_scores(a, x, primes, slice(at, at + CHUNK)), at)


def hard_negatives(
    vectors: DataFrame, *, anchor_every: int = 50, flip_every: int | None = 7, labels: int = 10, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    `positives` rows of the same label, the first `negatives` rows of other labels whose score is between low and high
    hundredths of the positive's.

    Anchors are the rows whose id is divisible by anchor_every; where it is divisible by flip_every, the label first goes
    up by one, modulo labels. Components are scaled and floored; higher scores come first, ties by smaller id. No part
    take rows with a null id, label, vector or component, with a NaN, an infinite one or one beyond LIMIT / scale, and rows
    whose vector hasn't the commonest number of components (the smaller one at a tie). Repeated rows each count, but an
    anchor once; a row with the anchor's own id is never its positive or negative. No rows: none."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = usable_rows(vectors, id_column, vector_column, label_column, scale)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("x") == (sizes.d if sizes else 0))
    if flip_every:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % flip_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    base = written(scaled(rows, scale), "scaled-vectors")
    anchors = base.filter(F.col("vec_id") % anchor_every == 0).distinct()
    anchors = written(anchors.withColumn("akey", F.monotonically_increasing_id()), "anchors")
    n, n_anchors = base.count(), anchors.count()
    # small tables are still dealt out to all tasks
    slices = max(-(-n // SLICE_ROWS), min(-(-n // LEAST_ROWS), shuffle_partitions(spark)), 1)
    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    each = lambda name, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    dealt = base.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int")).select("*", each("block", blocks))
    block = F.pmod("akey", F.lit(blocks)).cast("int")
    asking = anchors.withColumn("block", block).select("*", each("slice", slices))
    key = ["slice", "block"]

    def table(parts: list[tuple], names: list[str]) -> pd.DataFrame:
        columns = [np.concatenate([np.broadcast_to(p[i], len(p[-1])) for p in parts]) for i in range(len(names))] if parts else [np.zeros(0, np.int64)] * len(names)
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    def near(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asked):
            ids, label = found.vec_id.to_numpy(), found.label.to_numpy()
            for (i, s), akey, own, own_label in zip(scored(found, asked), asked.akey, asked.vec_id, asked.label, strict=True):
                top = best(s, ids, (label == own_label) & (ids != own), positives)
                out.append((akey, ids[top], s[top]))
        return table(out, ["akey", "positive_id", "positive_score"])

    schema = "akey long, positive_id long, positive_score long"
    first = dealt.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(near, schema)
    order = Window.partitionBy("akey").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    told = first.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    told = written(told.select("akey", F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score")), "positives")
    asking = anchors.join(told, "akey").withColumn("block", block).select("*", each("slice", slices))

    def apart(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asked):
            ids, label = found.vec_id.to_numpy(), found.label.to_numpy()
            for (i, s), akey, own, own_label in zip(scored(found, asked), asked.akey, asked.vec_id, asked.label, strict=True):
                s = np.where((label != own_label) & (ids != own), s, np.iinfo(np.int64).min)
                for place, (name, p) in enumerate(zip(asked.positive_id.iat[i], asked.positive_score.iat[i], strict=True), 1):
                    # low * p <= 100 * s <= high * p, in integers
                    top = best(s, ids, (s >= -(-low * int(p) // 100)) & (s <= high * int(p) // 100), negatives)
                    out.append((akey, own, place, name, p, ids[top], s[top]))
        return table(out, ["akey", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    schema = "akey long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = dealt.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(apart, schema)
    order = Window.partitionBy("akey", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
