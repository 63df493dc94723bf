"""What the projections of round 3 were about: steps that cost more than their input."""

import pandas as pd
from helpers import norm
from pyspark.sql import functions as F

from busframe.functions import n2k
from busframe.operators import transport
from busframe.streaming import ops, timed


def largest_method(df):
    """Bytes of the largest generated method of a plan; the JVM compiles none beyond 8000."""
    steps = df._jdf.queryExecution().debug().codegenToSeq()
    return max(steps.apply(i)._3().maxMethodCodeSize() for i in range(steps.size()))


def test_number_groups_are_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        f = n2k.with_n2k_fields(spark.range(9).select(F.array_repeat(F.lit(1), 43).alias("data")), 129029, "data").agg(*[F.sum(f"f.{c}") for c in ("lat", "lon", "alt", "hdop")])
        assert largest_method(f) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fields_in_steps(spark):
    """The fields of a group by steps are those of the struct; too short a payload has none."""
    for pgn, (least, layout) in n2k.LAYOUTS.items():
        rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.when(F.col("id") == 0, least - 1).otherwise(least)), lambda i: F.when(F.col("id") == 1, 255).otherwise((i * F.col("id") * 37 % 256).cast("int"))).alias("data"))
        out = n2k.with_n2k_fields(rows, pgn, "data")
        assert out.filter("f is null").count() == 1
        assert norm(out.select("id", "f.*").collect()) == norm(rows.select("id", n2k.n2k_fields(pgn, F.col("data")).alias("f")).select("id", "f.*").collect())
        assert out.select("f.*").columns == [f[0] for f in layout]


class Kept:
    """A state of one key in memory."""

    def __init__(self):
        self.x = None

    def exists(self):
        return bool(self.x)

    def get(self):
        return self.x

    def put(self, x):
        self.x = x

    update = put

    def clear(self):
        self.x = None

    def iterator(self):
        return iter((self.x or {}).items())

    def updateValue(self, k, v):
        self.x = (self.x or {}) | {k: v}


class Handle:
    getListState = getValueState = getMapState = lambda self, *_, **__: Kept()
    registerTimer = deleteTimer = lambda self, _: None


def test_a_long_log_leaves_in_chunks():
    """What a task holds of a log is Arrow columns, and never all of it as rows of Python."""
    n = 120_000
    log = pd.DataFrame({"frame_no": range(n), "ts_ns": [(i * 7919) % n for i in range(n)], "iface": 0, "channel": ["b" if i % 2 else None for i in range(n)], "bus": "CAN", "can_id": 1, "flags": 0, "errors": 0, "dlc": 8, "len": 8, "data": b"12345678"})
    hold = timed.HoldBack(10)
    hold.init(Handle())
    out = list(hold.handleInputRows(("a",), iter([log[:70_000], log[70_000:]]), None))
    assert max(map(len, out)) <= timed.CHUNK and sum(map(len, out)) == n - 10
    rows = pd.concat(out)
    assert rows.ts_ns.tolist() == list(range(n - 10)) and not rows.late.any() and set(rows.channel_no) == {1, 2}
    assert [r[1] for r in hold.held.get()] == list(range(n - 10, n))
    again = list(hold.handleInputRows(("a",), iter([log[log.ts_ns == 5]]), None))
    assert again[0].late.tolist() == [True] and again[0]["log"].tolist() == ["a"]


def test_messages_are_held_as_bytes():
    """A frame costs a stream a slice of bytes; the state's columns are as they were."""
    p = ops.IsoTp(None)
    p.init(Handle())
    rows = [b"\x10\x0a\x22\xf1\x90ABC", b"\x21DEFG\xcc\xcc"]
    table = lambda at, no: pd.DataFrame({"ts_ns": [no], "frame_no": [no], "payload": [rows[at]]})
    assert list(p.handleInputRows(tuple("abcdef"), iter([table(0, 1)]), None)) == []
    assert p.open.get() == (1, 10, 6, 1, [0x22, 0xF1, 0x90, 65, 66, 67], [1])
    out = list(p.handleInputRows(tuple("abcdef"), iter([table(1, 2)]), None))
    assert list(out[0].bytes[0]) == [0x22, 0xF1, 0x90, *b"ABCDEFG"] and out[0].frame_nos[0] == [1, 2] and not p.open.exists()


def test_chunks_are_cut_from_binary(spark):
    """A chunk costs the same wherever it lies in its payload, also beyond 4095 bytes."""
    pdus = spark.range(1, 4).select("id", F.unhex(F.repeat(F.lit("36C3A9"), (F.col("id") * F.col("id") * 700).cast("int"))).alias("payload"))
    out = transport.isotp_segment(pdus)
    assert "substring(payload" in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", "bytes"))).alias("c")).collect():
        n = r.id * r.id * 2100
        first = r.c[0].bytes[6:] if n > 4095 else r.c[0].bytes[2:]
        whole = [*first, *[b for c in r.c[1:] for b in c.bytes[1:]]]
        assert whole[:n] == [0x36, 0xC3, 0xA9] * (n // 3) and set(whole[n:]) <= {0xCC} and len(whole) - n < 7
