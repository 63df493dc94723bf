"""Segmented scans against plain windows, over ranges of every size, and halos and medians against Spark's own."""

import random

import pytest
from helpers import frames, norm
from pyspark.sql import Window
from pyspark.sql import functions as F

from busframe.operators import load, samples, scan, trace, transport, trigger
from busframe.schema import EXTENDED, TX

SPANS = [7, 1000, 10**12]


@pytest.fixture(scope="module")
def busy(spark):
    """Mostly one id, times that tie and a null log."""
    rng = random.Random(1)
    rows, t = [], 0
    for _ in range(600):
        t += rng.choice([0, 1, 2, 30, 900])
        rows.append((t, 0x100 if rng.random() < 0.8 else 0x101, rng.choice([0, TX]), [rng.randrange(3) for _ in range(3)], rng.randrange(2), "CAN", rng.choice([0, 0, 0, 8])))
    f = frames(spark, rows)
    return f.withColumn("log", F.when(F.col("frame_no") % 3 > 0, F.concat(F.lit("l"), F.col("frame_no") % 3))).cache()


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("by", [[], ["log"]])
def test_newest_and_running(busy, span, by):
    rows, key = scan.cut(busy, ["can_id"], by, "ts_ns", span)
    order = ["ts_ns", "frame_no"]
    value = F.when(F.col("errors") == 0, F.col("bytes")[0])
    out = scan.newest(rows, key, order, {"a": value, "b": F.struct("ts_ns")})
    out = scan.newest(out, key, order, {"c": value}, inclusive=True)
    out = scan.newest(out, key, order, {"d": value}, backwards=True)
    out = scan.running(out, key, order, {"e": F.col("bytes")[1]})
    w = Window.partitionBy(*by, "can_id").orderBy(*order)
    back = Window.partitionBy(*by, "can_id").orderBy(F.desc("ts_ns"), F.desc("frame_no")).rowsBetween(Window.unboundedPreceding, -1)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    plain = busy.select(
        "frame_no", F.last(value, True).over(before).alias("a"), F.lag("ts_ns").over(w).alias("b"), F.last(value, True).over(upto).alias("c"), F.last(value, True).over(back).alias("d"),
        F.sum(F.col("bytes")[1]).over(upto).alias("e"),
    )
    assert norm(out.select("frame_no", "a", "b.ts_ns", "c", "d", "e").collect()) == norm(plain.collect())


def test_ranges_are_dealt_out(spark):
    """A log of one id: every range is a group of its own in the one shuffle of the rows."""
    f = frames(spark, [(i * 10**9, 0x100, 0, [i % 256]) for i in range(4000)])
    plan = trace.with_delta(f)._jdf.queryExecution().optimizedPlan().toString()
    assert "_seg" in plan
    rows, key = scan.cut(f, ["can_id"], [], "ts_ns", scan.RANGE_NS)
    assert rows.groupBy(*key, scan.SEG).count().agg(F.max("count")).first()[0] == 600
    assert trace.with_delta(f).filter("delta_ns <> 1000000000").count() == 1  # the first


@pytest.mark.parametrize("span", SPANS)
def test_operators_by_ranges(busy, span, monkeypatch):
    monkeypatch.setattr(scan, "RANGE_NS", span)
    tx, ext = F.col("flags").bitwiseAND(TX), F.col("flags").bitwiseAND(EXTENDED)
    w = Window.partitionBy("log", "iface", tx, ext, "bus", "can_id").orderBy("ts_ns", "frame_no")
    plain = busy.select("frame_no", F.coalesce(F.col("ts_ns") - F.lag("ts_ns").over(w), F.lit(0)))
    assert norm(trace.with_delta(busy, ["log"], span).select("frame_no", "delta_ns").collect()) == norm(plain.collect())
    assert norm(trace.with_changed(busy, [], span).select("frame_no", "changed").collect()) == norm(trace.with_changed(busy, [], 10**15).select("frame_no", "changed").collect())
    s = busy.select("log", "frame_no", "ts_ns", F.col("bytes")[0].cast("double").alias("value"))
    n = F.row_number().over(Window.partitionBy("log").orderBy("ts_ns", "frame_no"))
    assert norm(samples._placed(s, ["log"], span).select("frame_no", "_i").collect()) == norm(s.select("frame_no", n - 1).collect())
    x, y = s.filter("frame_no % 5 = 0"), s.filter("frame_no % 5 = 1")
    assert norm(samples.xy_pair(x, y, ["log"], span_ns=span).collect()) == norm(samples.xy_pair(x, y, ["log"], span_ns=10**15).collect())
    assert samples.xy_pair(x, y, [], span_ns=span).count() == samples.xy_pair(x, y, []).count() > 0
    wide = busy.select("log", "frame_no", "ts_ns", "iface", F.when(F.col("errors") == 0, F.col("bytes")[0].cast("double")).alias("a"), F.when(F.col("tx" if False else "flags") == 0, F.col("bytes")[1].cast("double")).alias("b"))
    for stale in (None, 40):
        of = lambda r: trigger.conditional_log(wide, [trigger.Condition("a", ">", 0.5, 1), trigger.Condition("b", "<", 2.0)], ["a", "b"], by=["log"], pre_ns=50, stale_ns=stale, span_ns=r)  # noqa: B023, E731
        assert norm(of(span).collect()) == norm(of(10**15).collect())
        assert of(span).count() > 10
    loads = lambda r: load.rolling_load(busy, {}, span_ns=40, step_ns=5, range_ns=r)
    assert norm(loads(span).collect()) == norm(loads(10**15).collect())


@pytest.mark.parametrize("span", [3, 50])
def test_messages_that_span_ranges(spark, monkeypatch, span):
    from busframe.plans import fixtures as fx

    pdus = spark.createDataFrame([(i, bytearray([0x22, *range(i % 40)])) for i in range(60)], "pdu long, payload binary")
    rows = transport.isotp_segment(pdus).select((F.col("pdu") * 16 + F.col("chunk")).alias("frame_no"), "bytes")
    made = rows.withColumns({"ts_ns": F.col("frame_no") * 2, "iface": F.lit(0), "channel": F.lit("c"), "bus": F.lit("CAN"), "can_id": F.lit(0x700).cast("long"), "flags": F.lit(0), "errors": F.lit(0)})
    made = fx.with_meta(made).cache()
    plain = norm(transport.uds_pdus(made).select("ts_ns", "bytes", "frame_nos").collect())
    monkeypatch.setattr(scan, "RANGE_NS", span)
    assert norm(transport.uds_pdus(made).select("ts_ns", "bytes", "frame_nos").collect()) == plain and len(plain) == 60


def test_cycles_of_a_hot_id(busy):
    keys = [*trace.MONITOR]
    m = trace._monitored(busy)
    out = trace.with_cycle(m, trace.MONITOR, span=10)
    before = F.lag("ts_ns").over(Window.partitionBy(*keys).orderBy("frame_no"))
    plain = m.select("frame_no", F.when(F.col("ts_ns") >= before, F.col("ts_ns") - before))
    assert norm(out.select("frame_no", "cycle").collect()) == norm(plain.collect())


def test_exact_median(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, float("nan"), -0.5, *[rng.random() for _ in range(3)]])) for _ in range(500)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    rows += [("hot", 3.25)] * 1000
    df = spark.createDataFrame(rows, "k string, x double")
    want = df.filter("x is not null").groupBy("k").agg(F.percentile("x", 0.5).alias("median"))
    assert norm(scan.exact_median(df, ["k"], "x").collect()) == norm(want.collect())
    assert scan.exact_median(df, [], "x").collect()[0].median == df.agg(F.percentile("x", 0.5)).first()[0]
    assert scan.exact_median(df.limit(0), ["k"], "x").collect() == []
