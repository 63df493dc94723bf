"""Sample series: statistics, search, decimation, pairing. A series is keyed by `keys` (by default the signal); a series
may be longer than what one task can hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from . import scan
from .decode import Signal, decode_wide

KEYS = ("network", "message", "signal")


def value_samples(frames: DataFrame, signals: Sequence[Signal], networks: dict[int, str] | None = None) -> DataFrame:
    """frame_no, ts_ns, iface, can_id, value of one signal."""
    return decode_wide(frames, {"value": signals}, networks).filter(F.col("value").isNotNull())


def value_search(frames: DataFrame, signals: Sequence[Signal], low: float | None, high: float | None, networks: dict[int, str] | None = None, max_hits: int | None = None) -> DataFrame:
    """Samples within [low, high], in time order; an open bound is None. max_hits limits the answer."""
    s = value_samples(frames, signals, networks)
    s = s if low is None else s.filter(F.col("value") >= low)
    s = s if high is None else s.filter(F.col("value") <= high)
    return s if max_hits is None else s.orderBy("ts_ns", "frame_no").limit(max_hits)


def value_search_summary(frames: DataFrame, signals: Sequence[Signal], low: float | None, high: float | None, networks: dict[int, str] | None = None, max_hits: int = 100_000) -> DataFrame:
    """samples, seen_min, seen_max (over all samples), hits (at most max_hits), truncated."""
    v = F.col("value")
    hit = (v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True))
    n = F.coalesce(F.sum(hit.cast("long")), F.lit(0))
    return value_samples(frames, signals, networks).agg(
        F.count("*").alias("samples"), F.min(v).alias("seen_min"), F.max(v).alias("seen_max"), F.least(n, F.lit(max_hits)).alias("hits"), (n > max_hits).alias("truncated")
    )


def signal_stats(samples: DataFrame, begin_ns: int | None = None, end_ns: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    s = samples if begin_ns is None else samples.filter(F.col("ts_ns") >= begin_ns)
    s = s if end_ns is None else s.filter(F.col("ts_ns") <= end_ns)
    v = F.col("value")
    out = s.groupBy(*keys).agg(F.count("*").alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev")).alias("s")
    middle = scan.exact_median(s, keys, "value").alias("m")
    return out.join(middle, scan.same_keys("s", "m", keys), "left").select(*[f"s.{k}" for k in keys], "s.count", "s.min", "s.max", "s.mean", "m.median", "s.stddev")


def watch(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last raw and value, min, max, count, changed: whether the last raw differs from the one before. Of each series only
    the two newest samples of a task are sorted together with those of others."""
    along = Window.partitionBy(*keys).orderBy(F.desc("ts_ns"), F.desc("frame_no"))
    two = samples.select(*keys, "ts_ns", "frame_no", "raw", "value").withColumn("_n", F.row_number().over(along)).filter("_n <= 2")
    one = lambda n, c: F.max(F.when(F.col("_n") == n, F.struct(c))).getField(c)
    last = two.groupBy(*keys).agg(one(1, "raw").alias("raw"), one(1, "value").alias("value"), one(2, "raw").alias("before")).alias("l")
    out = samples.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count")).alias("s")
    changed = F.coalesce(F.col("l.raw") != F.col("l.before"), F.lit(False))
    return out.join(last, scan.same_keys("s", "l", keys)).select(*[f"s.{k}" for k in keys], "l.raw", "l.value", "s.min", "s.max", "s.count", changed.alias("changed"))


def decimate(samples: DataFrame, begin_ns: int, end_ns: int, buckets: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """First minimum and first maximum of each of `buckets` equal parts of [begin, end], and one neighbour on each side;
    all points of a series with at most 2 * buckets in that range."""
    width = max(1, end_ns - begin_ns) / buckets
    inside = samples.filter(F.col("ts_ns").between(begin_ns, end_ns))
    point = F.struct("ts_ns", "frame_no", "value")
    bucket = F.least(F.greatest(F.floor((F.col("ts_ns") - begin_ns) / width), F.lit(0)), F.lit(buckets - 1))
    first = lambda by: F.min_by(point, F.struct(by, "ts_ns", "frame_no"))
    ends = inside.groupBy(*keys, bucket.alias("bucket")).agg(first(F.col("value")).alias("a"), first(-F.col("value")).alias("b"))
    thin = ends.select(*keys, F.explode(F.array_distinct(F.array("a", "b"))).alias("p"))
    few = inside.groupBy(*keys).count().filter(F.col("count") <= 2 * buckets).select(*keys)
    thin = thin.join(few, list(keys), "left_anti").unionByName(inside.join(few, list(keys), "left_semi").select(*keys, point.alias("p")))
    order = F.struct("ts_ns", "frame_no")
    left = samples.filter(F.col("ts_ns") < begin_ns).groupBy(*keys).agg(F.max_by(point, order).alias("p"))
    right = samples.filter(F.col("ts_ns") > end_ns).groupBy(*keys).agg(F.min_by(point, order).alias("p"))
    return thin.unionByName(left).unionByName(right).select(*keys, "p.*")


def _placed(samples: DataFrame, keys: Sequence[str], span_ns: int = scan.RANGE_NS) -> DataFrame:
    """Adds _i, the place of each sample in its series from 0: counted in each range, with the counts of those before."""
    rows, key = scan.cut(samples, [], keys, "ts_ns", span_ns)
    return scan.running(rows, key, ["ts_ns", "frame_no"], {"_i": F.lit(1)}).withColumn("_i", F.col("_i") - 1).drop(scan.SEG, *key)


def samples_lod(samples: DataFrame, fan: int = 64, top: int = 4096, keys: Sequence[str] = KEYS) -> DataFrame:
    """Levels of a min/max pyramid: keys, level, bucket, ts_ns (first), min, max, points. Level 0 are `fan` points each; a
    level is made while the one below has at least `top` buckets in some series. Level 0 is written, and the others are
    made of it."""
    path, spark = shared_path(samples.sparkSession, "levels"), samples.sparkSession
    level = _placed(samples, keys).withColumn("bucket", F.floor(F.col("_i") / fan)).groupBy(*keys, "bucket").agg(
        F.min("ts_ns").alias("ts_ns"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("points")
    )
    level.write.parquet(path)
    level = spark.read.schema(level.schema).parquet(path)
    buckets = level.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    out, i = level.withColumn("level", F.lit(0)), 0
    while buckets >= max(top, 2):
        i, buckets = i + 1, -(-buckets // fan)
        level = level.withColumn("bucket", F.floor(F.col("bucket") / fan)).groupBy(*keys, "bucket").agg(
            F.min("ts_ns").alias("ts_ns"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("points").alias("points")
        )
        out = out.unionByName(level.withColumn("level", F.lit(i)))
    return out


def stride(samples: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return _placed(samples, keys).filter(F.col("_i") % n == 0).select(*[F.col(f"`{c}`") for c in samples.columns])


def trend(samples: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last n samples of each series."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts_ns"), F.desc("frame_no")))
    return samples.withColumn("_i", place).filter(F.col("_i") <= n).drop("_i")


def xy_pair(x: DataFrame, y: DataFrame, keys: Sequence[str], begin_ns: int | None = None, end_ns: int | None = None, span_ns: int = scan.RANGE_NS) -> DataFrame:
    """Each y (keys..., ts_ns, frame_no, value) with the newest x at or before it: keys..., ts_ns, x, y. A y before the
    first x is dropped; the range is of y, both ends inclusive. keys tell series (vehicles, logs) apart; [] is one."""
    tag = lambda df, n, a, b: df.select(*keys, "ts_ns", F.lit(n).alias("side"), "frame_no", a.alias("x"), b.alias("y"))
    none = F.lit(None).cast("double")
    both = tag(x, 0, F.col("value"), none).unionByName(tag(y, 1, none, F.col("value")))
    rows, key = scan.cut(both, [], keys or [F.lit(0)], "ts_ns", span_ns)
    out = scan.newest(rows, key, ["ts_ns", "side", "frame_no"], {"_x": F.col("x")}).filter((F.col("side") == 1) & F.col("_x").isNotNull())
    out = out if begin_ns is None else out.filter(F.col("ts_ns") >= begin_ns)
    out = out if end_ns is None else out.filter(F.col("ts_ns") <= end_ns)
    return out.select(*keys, "ts_ns", F.col("_x").alias("x"), "y")


def values_at(samples: DataFrame, a_ns: int, b_ns: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Value held at two cursors, their difference, and the distance of the cursors in ms and Hz."""
    order = F.struct("ts_ns", "frame_no")
    at = lambda t: F.max_by(F.when(F.col("ts_ns") <= t, F.col("value")), F.when(F.col("ts_ns") <= t, order))
    dt = b_ns - a_ns
    out = samples.groupBy(*keys).agg(at(a_ns).alias("a"), at(b_ns).alias("b"))
    return out.select(*keys, "a", "b", (F.col("b") - F.col("a")).alias("diff"), F.lit(dt / 1e6).alias("dt_ms"), F.lit(1e9 / dt if dt else None).cast("double").alias("hz"))
