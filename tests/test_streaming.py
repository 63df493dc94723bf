import pytest
from helpers import frames, norm
from pyspark.sql import functions as F

from busframe.operators import transport, trigger
from busframe.plans import fixtures as fx
from busframe.streaming import ops

pytestmark = pytest.mark.filterwarnings("ignore")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def folder(df, path, parts=3):
    """df as a growing folder: files in time order."""
    n = df.count()
    rows = df.orderBy("ts_ns", "frame_no").collect()
    for i in range(parts):
        df.sparkSession.createDataFrame(rows[i * n // parts : (i + 1) * n // parts], df.schema).coalesce(1).write.mode("append").parquet(path)


COLUMNS = ["frame_no", "ts_ns", "ts", "iface", "channel", "bus", "can_id", "flags", "errors", "dlc", "len", "data", "bytes"]


def test_monitor_and_load(spark, tmp_path):
    df = fx.frames_from_events(spark, SF).select(*COLUMNS)
    folder(df, str(tmp_path / "in"))
    s = ops.stream_frames(spark, str(tmp_path / "in"), max_files=1)
    ops.run_once(ops.monitor_stream(s), "mon", str(tmp_path / "c1"), "complete")
    from busframe.operators.trace import monitor

    batch = monitor(df).select("tx", "error", "iface", "bus", "id", "count", "frame_no")
    assert norm(spark.table("mon").select("tx", "error", "iface", "bus", "id", "count", "last.frame_no").collect()) == norm(batch.collect())
    ops.run_once(ops.bus_load_stream(s, {}), "load", str(tmp_path / "c2"), "complete")
    total = df.filter("errors = 0").count() * 133
    assert spark.table("load").agg(F.sum("bits")).first()[0] == total
    ops.record(s, str(tmp_path / "out"), str(tmp_path / "c3"), str(tmp_path / "late")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
    # a batch that runs again takes the place of itself, and later ones know what came before
    writer = ops.record(s, str(tmp_path / "out"), str(tmp_path / "c4"), str(tmp_path / "late"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
    assert ops.stream_counts(query) == {"read": df.count(), "dropped": 0}
    newest = spark.read.parquet(str(tmp_path / "c4" / "recorded" / "2")).first().newest
    assert newest == df.agg(F.max("ts_ns")).first()[0]
    grid = ops.load_grid(spark, [0, 1], "2026-01-01 00:00:00", "2026-01-01 00:00:01")
    assert grid.count() == 42


def test_uds_over_batches(spark, tmp_path):
    df = fx.isotp_from_conversations(spark, SF).select(*COLUMNS)
    folder(df, str(tmp_path / "in"), 4)
    s = ops.stream_frames(spark, str(tmp_path / "in"), max_files=1)
    ops.run_once(ops.uds_stream(s), "uds", str(tmp_path / "c"))
    batch = transport.uds_pdus(df).select("iface", "can_id", "ts_ns", "bytes", "frame_nos")
    assert norm(spark.table("uds").select(*batch.columns).collect()) == norm(batch.collect())


def test_uds_with_addresses_and_lin(spark, tmp_path):
    rows, t = [], 0
    for i in range(12):
        for part in ([0x10, 10, 0x62, i, 1, 2, 3], [0x21, 4, 5, 6, 7, 8, 9]):
            for address in (0xF1, 0x10 + i):
                t += 1000
                rows.append((t, 0x7E8, 0, [address, *part[:7]]))
        for part in ([0x10, 8, 0x22, i, 1, 2, 3], [0x21, 4, 5, 6, 7, 8]):
            t += 1000
            rows.append((t, 0x3C if i % 2 else 0x7D, 0, [7, *part], 3, "LIN"))
    f = frames(spark, rows)
    folder(f.select(*COLUMNS), str(tmp_path / "in"), 5)
    s = ops.stream_frames(spark, str(tmp_path / "in"), max_files=1)
    for addr_ext in (True, False):
        ops.run_once(ops.uds_stream(s, addr_ext=addr_ext), f"uds{addr_ext}", str(tmp_path / f"c{addr_ext}"))
        batch = transport.uds_pdus(f, addr_ext).select(*ops.SESSION, "ts_ns", "bytes", "frame_nos")
        assert norm(spark.table(f"uds{addr_ext}").select(*batch.columns).collect()) == norm(batch.collect())
        assert batch.filter("bus = 'LIN'").count() == 12 and batch.filter("bus = 'CAN'").count() == (24 if addr_ext else 0)


def test_conditional_log(spark, tmp_path):
    rows = [("a", i, int(t * 1e9), None if v is None else float(v)) for i, (t, v) in enumerate([(1, 5), (2, 20), (2.5, 30), (3, 5), (9, 40), (10, 1), (11, None), (17, 50)])]
    df = spark.createDataFrame(rows, "log string, frame_no long, ts_ns long, speed double")
    folder(df, str(tmp_path / "in"), 4)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    conditions = [trigger.Condition("speed", ">", 10.0)]
    ops.run_once(ops.conditional_log_stream(s, ["speed"], conditions), "cond", str(tmp_path / "c"))
    batch = trigger.conditional_log(df, conditions, ["speed"], by=["log"])
    assert norm(spark.table("cond").select("frame_no", "met").collect()) == norm(batch.select("frame_no", "met").collect())
    ops.run_once(ops.conditional_log_stream(s, ["speed"], conditions, armed=True), "armed", str(tmp_path / "d"))
    assert spark.table("armed").filter("not met").count() == 0


def test_units(spark, tmp_path):
    ms = 1_000_000
    f = frames(spark, [
        (1 * ms, 0x7E0, 0, [2, 0x10, 1]), (2 * ms, 0x7E8, 0, [2, 0x50, 1]), (3 * ms, 0x7DF, 0, [2, 0x3E, 0]), (4 * ms, 0x7E9, 0, [2, 0x7E, 0]), (5 * ms, 0x7EA, 0, [2, 0x7E, 0]),
        (6 * ms, 0x700, 0, [2, 0x22, 1]), (3000 * ms, 0x708, 0, [2, 0x62, 1]),
    ])
    p = transport.uds_pdus(f)
    folder(p.withColumn("frame_no", F.lit(0)), str(tmp_path / "in"), 2)
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ops.run_once(ops.ecus_stream(s), "ecus", str(tmp_path / "c"))
    out = {tuple(r) for r in spark.table("ecus").select("rx_id", "tx_id", "guessed").collect()}
    assert out == {(0x7E8, 0x7E0, False), (0x7E9, 0x7E1, True), (0x7EA, 0x7E2, True)}
