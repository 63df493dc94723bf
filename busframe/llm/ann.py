"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order (a prefix of the permutation of all pivots). It is posted in the
inverted files of its first `post` pivots; a query reads the files of its first `probe` pivots, ranks what it finds by
the footrule distance of the prefixes (a pivot that is missing in one counts as just behind the prefix), and the best
share is reranked by the exact inner product. Vectors get one more component, sqrt(longest^2 - length^2), so that the
order of angles is the order of inner products.

Scale: pivots are a sample of at most `max_pivots` vectors, the only thing that is broadcast; their number grows as the
square root of the rows, and so do the files. A file is dealt out in slices of vectors and blocks of queries of bounded
size, so that no group grows with the input. Equal vectors are indexed once, with their smallest ids: more than k + 1
of a set of copies are never in a query's first k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

SLICE_ROWS, BLOCK_QUERIES = 8192, 2048


def usable(vector: Column) -> Column:
    """Not null, of finite components, not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """vkey (smallest id), vector and the `keep` smallest ids of each distinct vector. Copies are cut in two steps, by a
    salt of the id first, so that no task holds a large set of them."""
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    rows = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(61))).dropDuplicates(["vec_id", "vector"])
    rows = rows.withColumn("n", first("vector", "salt")).filter(F.col("n") <= keep)
    rows = rows.withColumn("n", first("vector")).filter(F.col("n") <= keep)
    return rows.groupBy("vector").agg(F.min("vec_id").alias("vkey"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(
    vectors: DataFrame, is_query: Column, *, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    prefix: int = 32, post: int = 4, probe_share: float = 0.4, keep_share: float = 0.5, min_pivots: int = 16, max_pivots: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, its own row left out.

    Null, zero or non-finite vectors, null ids, and vectors whose number of components isn't the commonest one take no
    part. Repeated rows (same id and vector) count once. Fewer than k others: all of them. No usable row: no rows."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes.d if sizes else 1
    rows = rows.filter(F.size("vector") == dim)
    asking = rows.filter(is_query).distinct()
    base = written(distinct_vectors(rows, k + 1), "vectors")
    length2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = base.agg(F.count("*"), F.max(length2)).first()
    longest = longest or 1.0
    n_pivots = min(max(min_pivots, math.isqrt(n or 1)), max_pivots)
    sample = [r.vector for r in base.orderBy(F.xxhash64("vkey"), "vkey").limit(n_pivots).select("vector").collect()]
    if not sample:
        sample = [[1.0] * dim]
    n_pivots = len(sample)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))]

    pivots = lifted(np.array(sample, float))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    prefix = min(prefix, n_pivots, 181)  # its square fits 16 bits
    # files with room for three times the answer at least, so that small tables give full lists
    share = max(probe_share, min(1.0, 3 * (k + 1) / max(1, n or 0)))
    post, probe = min(post, prefix), max(1, math.ceil(share * n_pivots))

    def represent(files: int, ask: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.array(b.vector.tolist(), float).reshape(len(b), dim)
                wide = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))] if ask else lifted(x)
                order = np.argsort(-(wide @ pivots.T), axis=1, kind="stable")[:, : max(files, prefix)].astype(np.int32)
                yield b.assign(prefix=list(order[:, :prefix]), files=list(order[:, :files]))

        return run

    asked = written(asking.groupBy("vector").agg(F.min("vec_id").alias("qkey")), "asked")
    schema = "vector array<double>, prefix array<int>, files array<int>"
    posts = base.select("vkey", "ids", "vector").mapInPandas(represent(post, False), f"vkey long, ids array<long>, {schema}")
    posts = written(posts, "postings").withColumn("file", F.explode("files")).drop("files")
    asks = asked.select("qkey", "vector").mapInPandas(represent(probe, True), f"qkey long, {schema}")
    asks = written(asks, "queries").withColumn("file", F.explode("files")).drop("files")
    parts = lambda df, size: {r.file: -(-r["count"] // size) for r in df.groupBy("file").count().collect()}  # noqa: E731  (a row per pivot)
    slices, blocks = parts(posts, SLICE_ROWS), parts(asks, BLOCK_QUERIES)
    number = lambda of: F.element_at(F.array(*[F.lit(of.get(i, 1)) for i in range(n_pivots)]), F.col("file") + 1)
    one = lambda of, key: F.pmod(F.xxhash64(key), number(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), number(of) - 1))
    posts = posts.withColumn("slice", one(slices, "vkey")).withColumn("block", each(blocks))
    asks = asks.withColumn("block", one(blocks, "qkey")).withColumn("slice", each(slices))

    def rank(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asked):
            return pd.DataFrame({"qkey": [], "vkey": [], "score": [], "ids": []}, dtype=object)
        x = np.array(found.vector.tolist(), float)
        place = np.full((len(found), n_pivots), prefix, np.int16)
        np.put_along_axis(place, np.array(found.prefix.tolist(), np.int64), np.arange(prefix, dtype=np.int16)[None], 1)
        place = np.ascontiguousarray(place.T)
        vkey, ids = found.vkey.to_numpy(), found.ids.to_numpy()
        n_keep = max(4 * (k + 1), math.ceil(keep_share * len(found)))
        out, apart = [], np.empty(len(found), np.int16)
        for qkey, vector, own in zip(asked.qkey, asked.vector, asked.prefix, strict=True):
            near = np.arange(len(found))
            if n_keep < len(found):
                footrule = np.zeros(len(found), np.int16)  # at most prefix squared
                for i, pivot in enumerate(own):
                    np.subtract(place[pivot], np.int16(i), out=apart)
                    np.abs(apart, out=apart)
                    footrule += apart
                near = np.argpartition(footrule, n_keep)[:n_keep]
            score = x[near] @ np.asarray(vector, float)
            best = np.lexsort((vkey[near], -score))[: k + 1]
            out.append(pd.DataFrame({"qkey": qkey, "vkey": vkey[near[best]], "score": score[best], "ids": ids[near[best]]}))
        return pd.concat(out)

    key = ["file", "slice", "block"]
    found = posts.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(rank, "qkey long, vkey long, score double, ids array<long>")
    found = found.groupBy("qkey", "vkey").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    nearest = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    found = found.select("qkey", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1)
    lists = found.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))).alias("near"))
    # every query row takes the list of its vector and leaves itself out; written, so that the rows of one vector can be
    # split between tasks in both joins
    lists = written(lists, "lists")
    member = asking.join(asked.withColumnRenamed("vector", "v"), F.col("vector") == F.col("v")).select(F.col("vec_id").alias("query_id"), "qkey")
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = member.join(lists, "qkey").select("query_id", F.posexplode(mine).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
