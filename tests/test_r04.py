"""What the findings of round 4 were about."""

import random

import duckdb
import pytest
from helpers import frames, norm

from busframe.functions.bits import motorola_start
from busframe.operators import decode
from busframe.plans import fixtures as fx
from busframe.plans import log_queries  # noqa: F401
from busframe.plans.queries import QUERIES, SQL

LARGE = [655.35, 655.36, 655.37, 690.5, 983.04, 20000.0, 42949672.96, 0.0, 327.68]


def events(path, n=465, value=f"CASE WHEN i % 31 < 9 THEN ({LARGE}::double[])[(i % 31) + 1] ELSE (i * 37 % 300)::double END"):
    duck = duckdb.connect()
    duck.execute(f"""copy (select i as event_id, timestamp '2024-01-01' + to_microseconds(i * 5000000000) as ts, i // 5 as user_id,
      ['click', 'view', 'purchase', 'error', 'signup'][i % 5 + 1] as event_type, {value} as value, '{{"k": ' || (i % 100) || '}}' as props
      from range({n}) r(i)) to '{path}/events.parquet'""")
    duck.execute(f"create view events as select * from '{path}/events.parquet'")
    return duck


def same_as_sql(spark, duck, path, name):
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(path))
    assert sorted(got.columns) == sorted(names)
    assert norm(got.select(*names).collect()) == norm(want.fetchall())


@pytest.mark.parametrize("name", ["encode_frames", "encode_frames_all"])
def test_encoded_values_beyond_16_bits(spark, tmp_path, name):
    """bytes of frames that hold the value whole."""
    same_as_sql(spark, events(tmp_path), tmp_path, name)


def one(signal, start, length, un, be, factor=1.0, seq=0):
    return ("A", 1, "M", "n", 20, signal, start, length, un, be, "integer", factor, 0.0, 0.0, 0.0, "", False, False, None, None, 0, seq, None, None)


def test_signals_over_words(spark):
    """Signals of both orders that lie across the eighth and sixteenth byte are read and written as they were."""
    places = [("a", 0, 5, True, False), ("b", 60, 9, False, False), ("c", 5, 52, True, False), ("d", motorola_start(77), 1, True, True), ("e", 75, 52, True, True), ("f", 127, 33, False, True)]
    d = spark.createDataFrame([one(*p, seq=i) for i, p in enumerate(places)], fx.SIGNALS)
    rng = random.Random(4)
    rows = []
    for i in range(40):
        bits = [rng.randrange(2) for _ in range(160)]
        payload = [0] * 20
        for _, start, length, _, be in places:
            for b in range(start, start + length):
                payload[b // 8] |= bits[b] << (7 - b % 8 if be else b % 8)
        rows.append((i, 1, 4, payload))
    f = frames(spark, rows)
    s = decode.decode(f, d, spark.createDataFrame([("A", 0, 0)], "network string, net_seq int, iface int"))
    whole = {(r.frame_no, r.signal): r.raw for r in s.collect()}
    for i, (_, _, _, payload) in enumerate(rows):
        for name, start, length, un, be in places:
            number = [payload[b // 8] >> (7 - b % 8 if be else b % 8) & 1 for b in range(start, start + length)]
            number = int("".join(map(str, number if be else number[::-1])), 2)
            assert whole[i, name] == (number if un or number < 1 << (length - 1) else number - (1 << length))
    got = {r.frame_no: r for r in decode.encode_frames(s.select("frame_no", "network", "raw_id", "signal", "value"), d).collect()}
    assert all(got[i].bytes == rows[i][3] and got[i].error is None for i in range(40))


def test_what_cannot_be_encoded(spark):
    d = spark.createDataFrame([one("a", 0, 8, True, False), one("z", 8, 8, True, False, factor=0.0)], fx.SIGNALS)
    v = spark.createDataFrame([(1, "a", 7.0), (2, "a", 7.0), (2, "z", 1.0), (3, "x", 1.0), (4, "a", None)], "frame_no int, signal string, value double")
    out = {r.frame_no: (r.bytes, r.error) for r in decode.encode_frames(v.selectExpr("frame_no", "'A' as network", "1L as raw_id", "signal", "value"), d).collect()}
    zero = [0] * 19
    assert out == {1: ([7, *zero], None), 2: ([7, *zero], "cannot encode z"), 3: ([], "cannot encode x"), 4: ([0, *zero], None)}


def test_every_level(spark, tmp_path):
    """a log long enough for a fifth level, which the query gives as well."""
    duck = events(tmp_path, 200_000, "(i % 997)::double / 10")
    same_as_sql(spark, duck, tmp_path, "samples_lod")
    assert duck.execute(f"select max(level) from ({SQL['samples_lod']})").fetchone() == (4,)


def test_services_of_each_unit(spark, tmp_path):
    """units are told apart, one may refuse what another supports."""
    duck = duckdb.connect()
    duck.execute(f"copy (select i as o_orderkey, (i // 3 % 2)::bigint as o_custkey, 1.0::double as o_totalprice from range(60) r(i)) to '{tmp_path}/orders.parquet'")
    duck.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    same_as_sql(spark, duck, tmp_path, "service_support")
    rows = {(r.can_id, r.sid): (r.supported, r.answers) for r in QUERIES["service_support"](spark, str(tmp_path)).collect()}
    assert rows == {(unit, sid): (sid != 49 or unit == 2025, 10) for unit in (2024, 2025) for sid in (25, 34, 49)}


def test_sql_decode_joins_by_key(spark, tmp_path):
    """frames meet the signals of their messages, not payloads the whole dictionary."""
    duck = events(tmp_path)
    same_as_sql(spark, duck, tmp_path, "sql_decode")
    out = QUERIES["sql_decode"](spark, str(tmp_path))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_table_functions_agree(spark):
    from busframe import sql

    sql.register(spark, fx.wide_dictionary(spark))
    fx.wide_frames_from_events(spark, "/root/testdata/sf0.001").createOrReplaceTempView("wide_frames")
    out = spark.sql("SELECT f.frame_no, d.* FROM (SELECT *, can_id AS key FROM wide_frames WHERE errors = 0 AND frame_no < 200) f, LATERAL decode_frame('A', f.key, f.bytes) d")
    first = spark.sql("""SELECT f.frame_no, d.message, d.signal, frame_raw(f.bytes, d.start_bit, d.length, d.big_endian, d.is_unsigned) AS raw FROM wide_frames f, LATERAL message_signals('A', f.can_id) d
      WHERE f.errors = 0 AND f.frame_no < 200 AND frame_holds(f.bytes, d.start_bit, d.length, d.is_muxed, d.mux_value, d.muxer)""")
    assert norm(out.select("frame_no", "message", "signal", "raw").collect()) == norm(first.collect()) and first.count() > 1000


def test_messages_without_descriptions(spark):
    """the same messages from a plan without the descriptions."""
    from busframe.operators import transport

    f = fx.bam_from_events(spark, "/root/testdata/sf0.001").filter("frame_no < 800").unionByName(fx.n2k_from_events(spark, "/root/testdata/sf0.001").filter("frame_no < 800"))
    plain, whole = transport.protocol_messages(f, described=False), transport.protocol_messages(f)
    assert norm(plain.collect()) == norm(whole.select(plain.columns).collect()) and plain.count() > 200
    tree = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert tree(plain) < tree(whole) * 0.75


def test_trc_bytes_in_other_forms(spark, tmp_path):
    """bytes of one digit, too few bytes and what isn't hex are told as before by the reader that takes a line's bytes as one number."""
    from busframe.sources.text_logs import read_trc

    head = ";$FILEVERSION=2.1\n;$STARTTIME=45292.0\n;$COLUMNS=N,O,T,B,I,d,R,L,D\n;\n"
    loads = ["01 02 0A", "1 2 A", "01 02", "01 02 ZZ", "012 1 02", "01 02 0A FF", "1 02 0a"]
    lines = [f"{i + 1:7d} {i:9d}.250 DT  1     0123 Rx -  3    {load}" for i, load in enumerate(loads)]
    (tmp_path / "a.trc").write_text(head + "\n".join(lines) + "\n")
    rows = sorted(((r.ts_ns - 1704067200 * 10**9) // 1000, r.bytes, bytes(r.data)) for r in read_trc(spark, str(tmp_path / "a.trc")).collect())
    assert rows == [(i * 1000 + 250, [1, 2, 10], b"\x01\x02\n") for i in (0, 1, 5, 6)]
