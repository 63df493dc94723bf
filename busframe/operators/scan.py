"""Windows along time that one hot id can't stop: segmented scans with carry-over, halos, and exact medians.

A plain window puts all rows of a key, such as one id of a long log, into one task. Here every key is cut into ranges of
its order, and the work takes two passes: each range is scanned alone, and a small table with a row for each key and
range (its newest values, its counts) is scanned along the ranges; what comes out of it is joined back to the rows. The
rows are shuffled once, by key and range, so a log of one id spreads over as many tasks as it has ranges.

The rows of a range must be bounded for that. Ranges of time are, by what a bus can carry (a CAN interface at 1 Mbit/s has
at most some 20,000 frames a second); ranges of frame numbers are by their length.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path

RANGE_NS = 600 * 10**9
RANGE_FRAMES = 250_000

SEG, BY = "_seg", "_by"


def cut(rows: DataFrame, keys: Sequence[str], by: Sequence[str], order: str, span: int) -> tuple[DataFrame, list[str]]:
    """Adds the number of a row's range, and returns the columns of its key with it. keys: columns without nulls; those of
    `by` may hold nulls and go into one struct, which is equal to itself even so."""
    columns = {BY: F.struct(*[F.col(b) if isinstance(b, str) else b for b in by])} if by else {}
    return rows.withColumns(columns | {SEG: F.floor(F.col(order) / span)}), [*columns, *keys]


def _joined(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of their range; both sides are dealt out by key and range."""
    return rows.join(carried, [*keys, SEG], "left")


def newest(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], *, inclusive: bool = False, backwards: bool = False,
) -> DataFrame:
    """Adds, for each name, the newest value before a row (inclusive: or at it) that isn't null; backwards: the next one
    after it. A struct is never null, so a struct is what the row before has. rows come from `cut`."""
    names = list(values)
    rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    turned = (lambda c: F.desc(c)) if backwards else F.col
    own = Window.partitionBy(*keys, SEG).orderBy(*[turned(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inside = rows.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(own) for n in names})
    place = F.struct(*order)
    pick = F.min_by if backwards else F.max_by
    ends = rows.groupBy(*keys, SEG).agg(*[pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in names])
    along = Window.partitionBy(*keys).orderBy(turned(SEG)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, SEG, *[F.last(f"_e_{n}", ignorenulls=True).over(along).alias(f"_c_{n}") for n in names])
    out = _joined(inside, carried, keys)
    return out.withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in names}).drop(*[f"_{x}_{n}" for n in names for x in "vic"])


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum over the rows of the key up to and with this one. rows come from `cut`."""
    names = list(sums)
    rows = rows.withColumns({f"_v_{n}": c for n, c in sums.items()})
    own = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(own) for n in names})
    ends = rows.groupBy(*keys, SEG).agg(*[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in names])
    along = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, SEG, *[F.sum(f"_e_{n}").over(along).alias(f"_c_{n}") for n in names])
    out = _joined(inside, carried, keys)
    return out.withColumns({n: F.col(f"_i_{n}") + F.coalesce(f"_c_{n}", F.lit(0)) for n in names}).drop(*[f"_{x}_{n}" for n in names for x in "vic"])


def with_halo(rows: DataFrame, order: str, span: int, halo: int) -> DataFrame:
    """Rows by range, with a copy of those of the range before that lie within `halo` of the range: adds the range and
    `_halo`, true for copies. A window that reaches back no further than the halo can be taken in each range alone."""
    span = max(span, halo)
    own, reach = F.floor(F.col(order) / span), F.floor((F.col(order) + halo) / span)
    return rows.withColumn(SEG, F.explode(F.sequence(own, reach))).withColumn("_halo", F.col(SEG) > own)


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """The keys and the exact median of the values that aren't null, as `percentile(value, 0.5)` gives it, without a group
    that one task must hold: equal values are counted, the distinct ones sorted over ranges of (key, value), and the two
    middle ranks found from running counts."""
    rows = rows.filter(F.col(value).isNotNull())
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    counts = rows.groupBy(key.alias("_key"), F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    # ranges by Spark's own sampling; their numbers go up along (key, value), and are written, as they are read twice
    path = shared_path(rows.sparkSession, "ranges")
    counts.repartitionByRange("_key", "_x").withColumn(SEG, F.spark_partition_id().cast("long")).write.parquet(path)
    dealt = rows.sparkSession.read.schema("_key " + counts.schema["_key"].dataType.simpleString() + ", _x double, _n long, _seg long").parquet(path)
    upto = running(dealt, ["_key"], ["_x"], {"_upto": F.col("_n")})
    total = dealt.groupBy("_key").agg(F.sum("_n").alias("_total"))
    ranked = upto.join(total, "_key")
    holds = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    middle = ranked.filter(holds(low) | holds(high)).groupBy("_key").agg((F.lit(0.5) * F.min("_x") + F.lit(0.5) * F.max("_x")).alias(name))
    return middle.select(*[F.col("_key")[k].alias(k) for k in keys], name)


def same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    """Keys of two aliased tables, equal or both null."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys], F.lit(True))
