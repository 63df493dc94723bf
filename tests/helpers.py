"""Frames by hand, and rows in an order."""

from pyspark.sql import functions as F

from busframe.plans.fixtures import with_meta


def frames(spark, rows):
    """rows: (ts_ns, can_id, flags, bytes[, iface[, bus[, errors]]])"""
    full = []
    for i, r in enumerate(rows):
        iface, bus, errors = (*r[4:], *(0, "CAN", 0)[len(r) - 4 :])
        full.append((i, r[0], iface, f"can{iface}", bus, r[1], r[2], errors, list(r[3])))
    schema = "frame_no long, ts_ns long, iface int, channel string, bus string, can_id long, flags int, errors int, bytes array<int>"
    return with_meta(spark.createDataFrame(full, schema))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def norm(rows):
    import math

    cell = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
    return sorted(repr(tuple(cell(c) for c in r)) for r in rows)


def array(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")
