"""Centroid clustering (k-means) in exact integers, by expressions of the JVM alone.

Vectors are scaled to integers once and written. In a round the centroids are literals of the plan: for each of them
`zip_with` multiplies and `aggregate` adds up the squared distance, and `array_min` over structs of (distance, number)
picks the nearest, ties going to the smaller number. Sums of each component, a column each, are taken by a hash aggregate
that is combined before its shuffle; a round moves k rows of sums for each task, never a vector. New centroids are exact
floors of sum / count.

Scale: what reaches the driver and goes out in the plan are k centroids, bounded by the parameters k and dim, whatever
the number of rows. Each round is one scan of the written vectors; equal vectors and a cluster that holds most rows need
no care, as nothing is dealt out by vector or by cluster.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Scaled components lie within this, so that 64 squares and their sum fit BIGINT.
LIMIT = 1 << 27


def integer_vectors(vectors: DataFrame, *, dim: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, q (floor of scale times each component), norm (sum of q squared) of the vectors that take part."""
    x = F.col(vector_column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < LIMIT))
    rows = vectors.filter(F.coalesce((F.size(x) == dim) & fine, F.lit(False)))
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))
    return rows.withColumn("norm", F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v * v))


def nearest(centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid to q: |q|^2 + |c|^2 plus the products of q and -2 c."""
    numbers = lambda c: ", ".join(f"{-2 * x}L" for x in c)
    table = F.expr("array(" + ", ".join(f"named_struct('norm', {sum(x * x for x in c)}L, 'twice', array({numbers(c)}))" for c in centroids) + ")")

    def to(c: Column, i: Column) -> Column:
        products = F.zip_with(F.col("q"), c["twice"], lambda a, b: a * b)
        return F.struct(F.aggregate(products, F.col("norm") + c["norm"], lambda s, p: s + p).alias("distance"), i.alias("cluster"))

    return F.array_min(F.transform(table, to))


def cluster(
    vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2:", id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector that takes part.

    Those are the rows whose vector has exactly dim components, none null, NaN, infinite or beyond LIMIT / scale. The first
    centroids are the k vectors (all, if fewer) with the smallest SHA-256 of seed and id; rows without an id are clustered
    but start none, unless there are fewer than k others; repeated rows each count. A cluster that loses all its vectors
    keeps its centroid. No vectors: no rows. Inertia beyond BIGINT is null. Other columns aren't looked at."""
    base = written(integer_vectors(vectors, dim=dim, scale=scale, id_column=id_column, vector_column=vector_column), "integer-vectors")
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    centroids = [list(r.q) for r in base.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()]  # k rows
    if not centroids:
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return base.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).limit(0)
    for _ in range(rounds):
        sums = [F.sum(F.get("q", F.lit(i))).alias(f"s{i}") for i in range(dim)]
        for r in base.select("q", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows at most
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    near = base.select("vec_id", nearest(centroids).alias("x")).select("vec_id", "x.cluster", "x.distance")
    near = written(near, "clusters")
    inertia = {r.cluster: int(r.s) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    digest = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    return near.select(
        "vec_id", "cluster", "distance", of([long(inertia.get(i, 0)) for i in range(len(centroids))]).alias("cluster_inertia"), long(sum(inertia.values())).alias("inertia"),
        of(digest).alias("centroid_sha256"),
    )
