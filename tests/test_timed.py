"""Event-time streams: held-back order over batches and restarts, stale values, quiet buses."""

import random

import pytest
from helpers import frames, norm
from pyspark.sql import functions as F

from busframe.operators import trigger
from busframe.streaming import ops, timed

MS = 1_000_000


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def grow(df, path, parts):
    """Files of rows, in the order given: lists of numbers of frames."""
    rows = {r.frame_no: r for r in df.collect()}
    for part in parts:
        df.sparkSession.createDataFrame([rows[i] for i in part], df.schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, checkpoint):
    """Rows in the order in which batches give them."""
    out = []
    query = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_held_back_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(1)
    # two interfaces, of which the second arrives up to 40 ms behind
    times = [(t * MS, i % 2) for i, t in enumerate(range(1000, 4000, 7))]
    f = frames(spark, [(t, 0x100, 0, [i % 256], 3 - iface) for i, (t, iface) in enumerate(times)]).withColumn("log", F.lit("a"))
    arrival = sorted(range(len(times)), key=lambda i: times[i][0] + (rng.random() * 40 * MS if times[i][1] else 0))
    thirds = [arrival[i * len(times) // 6 : (i + 1) * len(times) // 6] for i in range(6)]
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    grow(f, path, thirds[:3])
    out = run(timed.reorder_stream(source(spark, f, path)), state)
    newest = max(times[i][0] for i in sum(thirds[:3], []))
    assert all(newest - times[i][0] < 50 * MS for i in set(sum(thirds[:3], [])) - {r.frame_no for r in out})
    grow(f, path, thirds[3:])
    out += run(timed.reorder_stream(source(spark, f, path)), state)
    assert [r.ts_ns for r in out] == sorted(r.ts_ns for r in out) and not any(r.late for r in out)
    # the end of the log releases the rest; a straggler is passed on and marked
    last = frames(spark, [(times[5][0], 0x100, 0, [1], 9), (10**10, 0, 0, [], 0, "END")]).withColumn("log", F.lit("a")).withColumn("frame_no", F.col("frame_no") + 10_000)
    last.coalesce(1).write.mode("append").parquet(path)
    end = run(timed.reorder_stream(source(spark, f, path)), state)
    assert [r.frame_no for r in end if r.late] == [10_000]
    assert sorted(r.frame_no for r in out + end if not r.late) == list(range(len(times)))
    # channels are numbered by their first frame, and a late one gets the next number
    assert {(r.channel, r.channel_no) for r in out + end} == {("can3", 1), ("can2", 2), ("can9", 3)}


def test_what_a_silent_log_holds_is_released(spark, tmp_path):
    f = frames(spark, [(50 * MS, 1, 0, [1]), (100 * MS, 2, 0, [1]), (90_000 * MS, 3, 0, [1]), (200_000 * MS, 4, 0, [1]), (200_001 * MS, 5, 0, [1])])
    f = f.withColumn("log", F.when(F.col("frame_no") < 2, "quiet").otherwise("busy"))
    path = str(tmp_path / "in")
    grow(f, path, [[0, 1], [2], [3], [4]])
    out = run(timed.reorder_stream(source(spark, f, path)), str(tmp_path / "state"))
    assert [r.frame_no for r in out if r.log == "quiet"] == [0, 1]


def test_stale_values_without_a_next_row(spark, tmp_path):
    rows = [("a", 0, 1.0, 20.0), ("a", 1, 2.0, 30.0), ("b", 2, 3.0, 1.0), ("b", 3, 9.0, 1.0), ("b", 4, 12.0, 50.0), ("b", 5, 13.0, 5.0), ("b", 6, 20.0, 5.0)]
    df = spark.createDataFrame([(log, i, int(t * 1e9), v) for log, i, t, v in rows], "log string, frame_no long, ts_ns long, speed double")
    path = str(tmp_path / "in")
    grow(df, path, [[0, 1], [2], [3], [4, 5], [6]])
    conditions = [trigger.Condition("speed", ">", 10.0)]
    out = run(timed.conditional_log_events(source(spark, df, path), ["speed"], conditions), str(tmp_path / "state"))
    events = sorted((r.log, r.ts_ns, r.event, r.met) for r in out)
    assert events == [
        ("a", 10**9, "row", True), ("a", 2 * 10**9, "row", True), ("a", 3_500_000_001, "stale", False), ("b", 9 * 10**9, "before", False), ("b", 12 * 10**9, "row", True), ("b", 13 * 10**9, "falling", False),
    ]


@pytest.mark.parametrize("all_of", [True, False])
def test_bound_conditions_as_in_batch(spark, tmp_path, all_of):
    rng = random.Random(3)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([50, 200, 900, 2500]) * MS
        rows.append((f"l{i % 2}", i, t, rng.choice([1, 2]), rng.choice([None, 5.0, 15.0]), rng.choice([None, 1.0, 2.0])))
    df = spark.createDataFrame(rows, "log string, frame_no long, ts_ns long, iface int, speed double, temp double")
    path = str(tmp_path / "in")
    grow(df, path, [range(i, i + 60) for i in range(0, 300, 60)])
    conditions = [trigger.Condition("speed", ">", 10.0, 1), trigger.Condition("temp", "<", 1.5)]
    stream = timed.conditional_log_events(source(spark, df, path), ["speed"], conditions, all_of=all_of)
    out = [r for r in run(stream, str(tmp_path / "state")) if r.event in ("row", "before")]
    batch = trigger.conditional_log(df, conditions, ["speed"], by=["log"], all_of=all_of).select("log", "frame_no", "speed", "met").collect()
    assert norm([(r.log, r.frame_no, r.speed, r.met) for r in out]) == norm(batch) and len(batch) > 30
    # a condition bound to an interface that never carries the value
    never = [trigger.Condition("speed", ">", 10.0, 7)]
    assert run(ops.conditional_log_stream(source(spark, df, path), ["speed"], never), str(tmp_path / "other")) == []
    old = run(ops.conditional_log_stream(source(spark, df, path), ["speed"], conditions, all_of=all_of), str(tmp_path / "old"))
    assert norm([(r.log, r.frame_no, r.speed, r.met) for r in old]) == norm(batch)


def test_a_quiet_bus_has_load_zero(spark, tmp_path):
    base = 1_790_000_000 * 1000
    at = [(0, 0), (10, 0), (120, 1), (480, 0), (5000, 1), (5030, 0), (5031, 1), (9000, 0), (12_000, 1)]
    f = frames(spark, [((base + ms) * MS, 0x100, 0, [1, 2], iface) for ms, iface in at])
    path = str(tmp_path / "in")
    grow(f, path, [[0, 1, 2], [3, 4], [5, 6], [7], [8]])
    out = run(timed.quiet_load_stream(source(spark, f, path), {1: 250_000}, late="1 second"), str(tmp_path / "state"))
    got = {(r.iface, r.end.timestamp()): (r.bits, round(r.load, 9)) for r in out}
    assert len(got) == len(out)
    mark = base + 11_000
    want = {}
    for iface, rate in ((0, 500_000), (1, 250_000)):
        mine = [ms for ms, i in at if i == iface]
        for end in range(base + mine[0] // 50 * 50 + 50, mark + 1, 50):
            bits = 75 * sum(end - 1000 <= base + ms < end for ms in mine)
            want[iface, end / 1000] = (bits, round(bits * 100 / rate, 9))
    assert got == want and (0, 0.0) in got.values()


def test_recorded_files(spark, tmp_path):
    """Text files of every batch, with the same channel numbers over a restart."""
    from busframe.sources import logs

    f = frames(spark, [((10 + i) * 100 * MS, 0x100 + i, 0, [i], [5, 4, 5, 9, 4, 5][i]) for i in range(6)]).withColumn("log", F.lit("a"))
    end = frames(spark, [(10**10, 0, 0, [], 0, "END")]).withColumn("log", F.lit("a"))
    for kind in ("parquet", "candump", "asc"):
        path, out, state = (str(tmp_path / kind / x) for x in ("in", "out", "state"))
        grow(f, path, [[1, 0], [2]])
        ops.record_log(source(spark, f, path), out, state, format=kind).trigger(availableNow=True).start().awaitTermination()
        grow(f, path, [[4, 3], [5]])
        end.coalesce(1).write.mode("append").parquet(path)
        ops.record_log(source(spark, f, path), out, state, format=kind).trigger(availableNow=True).start().awaitTermination()
        folders = sorted((tmp_path / kind / "out").glob("batch=*"), key=lambda p: int(p.name[6:]))
        back = [spark.read.parquet(str(p)) if kind == "parquet" else logs.read_log(spark, str(p), kind) for p in folders]
        rows = [r for b in back for r in b.orderBy("ts_ns").collect()]
        assert [r.can_id for r in rows] == [0x100 + i for i in range(6)]
        if kind == "asc":
            assert [r.channel for r in rows] == ["CH 1", "CH 2", "CH 1", "CH 3", "CH 2", "CH 1"]
