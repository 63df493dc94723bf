"""What the findings of round 3 were about: work that grew faster than its input, and cuts."""


import duckdb
import pytest
from helpers import array, norm, value
from pyspark.sql import functions as F

from busframe.functions import text
from busframe.operators import load, trace, transport
from busframe.plans import fixtures as fx
from busframe.plans import log_queries  # noqa: F401
from busframe.plans.queries import QUERIES, SQL
from busframe.sources import binary_logs, dbc


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def busy(spark):
    f = spark.range(300).select(F.col("id").alias("frame_no"), (F.col("id") / 3).cast("long").alias("ts_ns"), (F.col("id") % 2).cast("int").alias("iface"))
    return f.withColumns({"bus": F.lit("CAN"), "flags": F.lit(0), "errors": F.when(F.col("frame_no") % 7 == 0, 1).otherwise(0), "len": F.lit(8)})


def test_rolling_load_does_not_look_at_its_span_again(spark):
    """Twice as many frames in a span aren't twice the work for each of them."""
    out = load.rolling_load(busy(spark), {}, span_ns=20, step_ns=5)
    assert "RangeFrame" not in plan(out)
    rows = [(r.frame_no, r.ts_ns, r.iface, 0 if r.errors else 133) for r in busy(spark).collect()]
    want = set()
    for step in range(20):
        for i in (0, 1):
            t = max(ts for _, ts, face, _ in rows if face == i and ts // 5 == step)
            bits = sum(b for _, ts, face, b in rows if face == i and t - 20 <= ts <= t)
            want.add((i, t, min(100.0, bits * 100.0 / 500_000 / (20 / 1e9))))
    assert {tuple(r) for r in out.collect()} == want


def test_dbc_in_ranges_of_lines(spark, tmp_path, monkeypatch):
    """A file of any length: what a line belongs to is carried over ranges."""
    text = "\n".join(f'BO_ {i + 5} M{i}: 8 X\n SG_ A : 0|8@1+ (1,0) [0|0] "" X\n SG_ B : 8|8@1+ (2,1) [0|0] "" X' for i in range(9))
    text += '\nCM_ BO_ 6 "one\ntwo\nthree";\nCM_ SG_ 7 A "of A";\nSIG_VALTYPE_ 8 A : 1;\nVAL_ 9 B 1 "on" 0 "off";\n'
    path = str(tmp_path / "a.dbc")
    (tmp_path / "a.dbc").write_text(text)
    whole = [norm(x.drop("log").collect()) for x in dbc.read_dbc(spark, path)]
    monkeypatch.setattr(dbc, "LINES", 4)
    parts = [norm(x.drop("log").collect()) for x in dbc.read_dbc(spark, path)]
    assert parts == whole and len(whole[0]) == 18
    notes = {(r.message, r.signal): (r.message_comment, r.signal_comment, r.value_type) for r in dbc.read_dbc(spark, path)[0].collect()}
    assert notes["M1", "A"][0] == "one\ntwo\nthree" and notes["M2", "A"][1] == "of A" and notes["M3", "A"][2] == "float32"


def test_levels_asked_for(spark, tmp_path):
    """A log long enough for a fifth level: the query asks for four."""
    duck = duckdb.connect()
    duck.execute(f"""copy (select i as event_id, timestamp '2024-01-01' + to_microseconds(i * 1000) as ts, i % 3 as user_id, 'click' as event_type, (i % 997)::double / 10 as value, '{{"k": 3}}' as props
      from range(200000) r(i)) to '{tmp_path}/events.parquet'""")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    out = QUERIES["samples_lod"](spark, str(tmp_path))
    want = duck.execute(SQL["samples_lod"])
    names = [d[0] for d in want.description]
    assert norm(out.select(*names).collect()) == norm(want.fetchall())


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges of 64 bytes of one capture: many ranges, few tasks."""
    import struct

    packet = struct.pack(">IBBBB", 0x123, 8, 0, 0, 0) + bytes(8)
    body = b"".join(struct.pack("<IIII", 10, i, 16, 16) + packet for i in range(200))
    (tmp_path / "a.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 227) + body)
    ranges = binary_logs.capture_ranges(spark, str(tmp_path / "a.pcap"), "pcap", 64)
    assert ranges.count() > 50 and ranges.rdd.getNumPartitions() == 1
    out = binary_logs.read_pcap(spark, str(tmp_path / "a.pcap"), 64)
    assert out.count() == 200 and out.select("iface").distinct().collect()[0][0] == 0


def test_protocol_filter_joins_once(spark):
    """Whether a first frame holds the text is told where it is read, not by a join of the frames with themselves."""
    f = busy(spark).withColumns({"can_id": F.col("frame_no"), "channel": F.lit("can0")})
    m = spark.range(20).select(F.array("id").alias("frame_nos"), F.concat(F.lit("m"), "id").alias("name"))
    out = trace.protocol_filter(m, f, "0x00a", hidden_interfaces=[1])
    assert plan(out).count("Join ") == 1
    assert sorted(r.name for r in out.collect()) == ["m10"]


LARGE = [655.35, 655.36, 655.37, 690.5, 775.36, 983.03, 983.04, 1200.5, 20000.0, 42949672.96, 0.0, 327.67, 327.68]
WHOLE = [
    "conditional_log_bound_stream", "conditional_log_stream", "conditional_events_stream", "conditional_log", "conditional_log_stale",
    "decimate", "samples_lod", "stride", "trend", "xy_pair",
    "values_at", "value_search", "value_search_summary", "decode_long", "sql_decode",
    "decoded_page", "decode_wide", "frame_table", "signal_stats",
]


@pytest.mark.parametrize("name", WHOLE)
def test_values_beyond_16_bits(spark, tmp_path, name):
    """A field holds a value whole, and not its lowest 16 bits."""
    duck = duckdb.connect()
    duck.execute(f"""copy (select i as event_id, timestamp '2024-01-01' + to_microseconds(i * 5000000000) as ts, i // 5 as user_id,
      ['click', 'view', 'purchase', 'error', 'signup'][i % 5 + 1] as event_type, CASE WHEN i % 31 < 13 THEN ({LARGE}::double[])[(i % 31) + 1] ELSE (i * 37 % 300)::double END as value, '{{"k": ' || (i % 100) || '}}' as props
      from range(465) r(i)) to '{tmp_path}/events.parquet'""")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert norm(QUERIES[name](spark, str(tmp_path)).select(*names).collect()) == norm(want.fetchall())


def test_single_frames_are_not_sorted_with_their_payloads(spark):
    """Messages of one frame are counted, not carried through the windows; repeated orders are dropped before they are frames."""
    f = fx.uds_from_orders(spark, "/root/testdata/sf0.001")
    assert "Deduplicate" not in f._jdf.queryExecution().analyzed().toString() and "first(bytes" not in plan(f)
    lines = plan(transport.uds_pdus(f)).splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line]
    inner = lines[windows[0] : windows[-1]]
    assert any("Filter" in line and "NOT (role" in line for line in inner)


def test_groups_of_bits(spark):
    """A payload shown by groups of bits, none of them cut to two digits."""
    data = array(0x34, 0x12, 0x00, 0x05, 0xF0)
    assert value(spark, text.group_text(data, [(0, 8), (8, 16), (0, 16), (24, 3), (36, 4)])) == "34 12 1234 05 0F"
    assert value(spark, text.group_text(data, [(4, 12), (16, 24)], "")) == "123F00500"
    shown = text.data_text(data, F.lit(0), F.lit(0), groups=[(0, 4), (4, 36)])
    assert value(spark, shown) == "04 F00500123" and value(spark, text.data_text(data, F.lit(0), F.lit(0))) == "34 12 00 05 F0"


PRINTED = ["frame_texts", "decoded_trace", "candump_roundtrip", "asc_roundtrip", "trc_roundtrip", "pcap_roundtrip"]


@pytest.mark.parametrize("name", PRINTED)
def test_texts_beyond_16_bits(spark, tmp_path, name):
    """Texts show a value whole."""
    test_values_beyond_16_bits(spark, tmp_path, name)


@pytest.mark.parametrize("x", [-0.01, 10995116277.76])
def test_packed_frames_cut_nothing(spark, tmp_path, x):
    """What 40 bits don't hold is an error."""
    rows = f"select 1L as event_id, timestamp_ntz'2024-01-01 00:00:00' as ts, 1L as user_id, 'click' as event_type, {x}D as value, '{{\"k\": 3}}' as props"
    spark.sql(rows).write.parquet(str(tmp_path / "events.parquet"))
    with pytest.raises(Exception, match="beyond 40 bits"):
        fx.packed_frames_from_events(spark, str(tmp_path)).collect()
