"""Bits, texts, protocols and checks against independent code and known vectors."""

import math
import struct

import pytest
from helpers import array, frames, norm, value
from pyspark.sql import functions as F

from busframe.functions import bits, text, uds
from busframe.functions.n2k import n2k_description, n2k_fields
from busframe.operators import decode, diagnostics, samples, trace, transport, trigger
from busframe.sources.text_logs import read_dtc_fields

DATA = [0x12, 0x9A, 0xF3, 0x45, 0x00, 0xFF, 0x81, 0x7E, 0xC3]


def bit_le(data, start, length):
    return sum(((data[(start + i) // 8] >> (start + i) % 8) & 1) << i for i in range(length) if (start + i) // 8 < len(data))


def bit_be(data, start, length):
    out = 0
    for i in range(start, start + length):
        out = out << 1 | ((data[i // 8] >> (7 - i % 8)) & 1 if i // 8 < len(data) else 0)
    return out


def signed64(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_every_bit_range(spark):
    """Every start and many lengths, both byte orders, against a bit-by-bit reading; geometry as columns."""
    cases = [(s, n) for s in range(72) for n in (1, 2, 7, 8, 9, 12, 16, 31, 33, 57, 63, 64) if s + n <= 72]
    df = spark.createDataFrame(cases, "s int, n int")
    out = df.select("s", "n", bits.extract_raw_le(array(*DATA), F.col("s"), F.col("n")).alias("le"), bits.extract_raw_be(array(*DATA), F.col("s"), F.col("n")).alias("be")).collect()
    assert len(out) == len(cases)
    for r in out:
        assert (r.le, r.be) == (signed64(bit_le(DATA, r.s, r.n)), signed64(bit_be(DATA, r.s, r.n))), (r.s, r.n)


def test_literal_bit_ranges(spark):
    cases = [(s, n) for s in (0, 1, 5, 7, 8, 13) for n in (1, 8, 11, 16, 33, 58, 64) if s + n <= 72]
    cols = [c for i, (s, n) in enumerate(cases) for c in (bits.extract_raw_le(F.col("d"), s, n).alias(f"l{i}"), bits.extract_raw_be(F.col("d"), s, n).alias(f"b{i}"))]
    r = spark.range(1).select(array(*DATA).alias("d")).select(*cols).first()
    for i, (s, n) in enumerate(cases):
        assert (r[f"l{i}"], r[f"b{i}"]) == (signed64(bit_le(DATA, s, n)), signed64(bit_be(DATA, s, n)))
    assert value(spark, bits.extract_raw_le(array(*DATA), 0, 65)) == 0 and value(spark, bits.extract_raw_le(array(*DATA), 512, 8)) == 0


def test_physical(spark):
    assert value(spark, bits.signed(F.lit(0x8000).cast("long"), 16)) == -32768
    assert value(spark, bits.unsigned_double(F.lit(-1).cast("long"))) == 2.0**64
    for x in (3.14159, -273.15, 0.0, 1e-40, float("inf"), 1e10):
        raw = struct.unpack("<i", struct.pack("<f", x))[0] & 0xFFFFFFFF
        assert value(spark, bits.bits_to_double(F.lit(raw).cast("long"), 32)) == struct.unpack("<f", struct.pack("<f", x))[0]
        raw = struct.unpack("<q", struct.pack("<d", x))[0]
        assert value(spark, bits.bits_to_double(F.lit(raw).cast("long"), 64)) == x
    assert math.isnan(value(spark, bits.bits_to_double(F.lit(0x7FC00000).cast("long"), 32)))
    be = bits.extract_raw_be(array(0xC4, 0x0D, 0x93, 0x33), 0, 32)
    raw = struct.unpack(">f", bytes([0xC4, 0x0D, 0x93, 0x33]))[0]
    assert value(spark, bits.to_physical(be, 32, False, "float32", 0.5, 10.0)) == raw * 0.5 + 10.0 == pytest.approx(-273.15, abs=1e-4)
    assert value(spark, bits.to_raw(F.lit(-2.5), 8, False, 1.0, 0.0)) == 253
    assert value(spark, bits.to_raw(F.lit(-2.5), 8, True, 1.0, 0.0)) == 0
    assert value(spark, bits.to_raw(F.lit(300.0), 16, True, 0.5, 0.0, 0, 100)) == 200


@pytest.mark.parametrize("big", [False, True])
def test_injection(spark, big):
    cases = [(0, 8), (3, 9), (12, 16), (5, 33)]
    read = bit_be if big else bit_le
    for s, n in cases:
        raw = 0x1A5A5A5A5 & ((1 << n) - 1)
        out = value(spark, bits.inject_raw(array(*DATA), s, n, big, F.lit(raw).cast("long")))
        assert read(out, s, n) == raw
        touched = {i for i in range(72) if (s <= i < s + n)}
        other = [i for i in range(72) if i not in touched]
        assert all(read(out, i, 1) == read(DATA, i, 1) for i in other)


def test_lengths_and_loads(spark):
    df = spark.range(66).select(F.col("id").cast("int").alias("n"))
    out = {r.n: (r.d, r.l) for r in df.select("n", bits.dlc_of_len(F.col("n")).alias("d"), bits.len_of_dlc(bits.dlc_of_len(F.col("n"))).alias("l")).collect()}
    assert out[0] == (0, 0) and out[8] == (8, 8) and out[9] == (9, 12) and out[13] == (10, 16) and out[64] == (15, 64) and out[65] == (8, 8)
    b = lambda bus, n, flags: value(spark, bits.frame_bits(F.lit(bus), F.lit(n), F.lit(flags)))
    assert (b("CAN", 8, 0), b("CAN", 8, 1), b("CAN", 8, 5), b("LIN", 8, 0)) == (133, 157, 181, 124)


def crc(data):
    c = 0xFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = ((c << 1) ^ 0x2F if c & 0x80 else c << 1) & 0xFF
    return c ^ 0xFF


def test_end_to_end_protection(spark):
    assert value(spark, bits.crc8_h2f(array(*b"123456789"))) == 0xDF
    assert value(spark, bits.e2e_p2_crc(array(*range(8)), 0x0234)) == 0xB8 == crc([0x34, 0x02, 0, *range(1, 8)])
    safe = bits.e2e_p2_protect(array(*range(8)), 0x0234, F.lit(21))
    assert value(spark, safe)[1] == 5 and value(spark, bits.e2e_p2_check(safe, 0x0234))
    assert not value(spark, bits.e2e_p2_check(array(1, 2, 3), 0x0234))
    f = frames(spark, [(i, 1, 0, [crc([0x34, 2, 0, c]) + (i == 2), c]) for i, c in enumerate([0, 1, 2, 3, 5])])
    assert [tuple(r) for r in trigger.e2e_audit(f, 0x234).select("frames", "bad_crc", "jumps").collect()] == [(5, 1, 2)]


def test_lin(spark):
    assert value(spark, bits.lin_protected_id(F.lit(0x3C))) == 0x3C and value(spark, bits.lin_protected_id(F.lit(0x10))) == 0x50
    assert value(spark, bits.lin_checksum(F.lit(0x10), array(1, 0xFF))) == 0xFF ^ ((0x50 + 1 + 0xFF) % 255)
    d = spark.createDataFrame([("N", 5, "F", "P", "s", 4, 6, 2.0, 1.0, "u")], "network string, frame_id int, frame string, publisher string, signal string, bit_offset int, bit_length int, factor double, offset double, unit string")
    f = frames(spark, [(0, 0x45, 0, [0x50, 0x02], 0, "LIN"), (1, 5, 0, [0], 0, "CAN")])
    assert [(r.raw, r.value) for r in decode.decode_lin(f, d).collect()] == [(0x25, 75.0)]


def test_texts(spark):
    v = lambda c: value(spark, c)
    for s, want in ((12.345, "12.345"), (59.9996, "1:00.000"), (245.25, "4:05.250"), (11045.25, "3:04:05.250"), (183845.25, "2d 03:04:05.250"), (-1.5, "-1.500"), (0.0, "0.000")):
        assert v(text.format_duration(F.lit(s))) == want
    for s, want in (("90", 90), ("1:30", 90), ("1:02:03.5", 3723.5), ("2d 1:02:03", 176523), ("2d", 172800), ("1d 0:10", 87000), ("", None), ("a", None), ("1:2:3:4", None), ("-1", None), ("inf", None)):
        assert v(text.parse_duration(F.lit(s))) == want, s
    assert v(text.parse_seconds_ns(F.lit("1700000000.123456789"))) == 1700000000123456789
    assert v(text.parse_seconds_ns(F.lit("5"))) == 5 * 10**9 and v(text.parse_seconds_ns(F.lit("5.x"))) is None
    i = lambda *a: v(text.id_text(*[F.lit(x) for x in a]))
    assert (i("CAN", 0x123, 0, 0), i("CAN", 0x1ABCDEF0, 1, 0), i("LIN", 0x7C, 0, 0), i("CAN", 1, 0, 1)) == ("0x123", "0x1ABCDEF0", "0x3C", "-")
    assert v(text.type_text(F.lit("CAN"), F.lit(1 | 4 | 8), F.lit(0))) == "FD.EXT.BRS" and v(text.type_text(F.lit("LIN"), F.lit(32), F.lit(0))) == "LIN.SLP"
    assert v(text.error_text(F.lit(0x9))) == "ERROR: ACK+CRC"
    assert v(text.format_value(F.lit(-0.001), "integer", 0.01, 0.0)) == "0.00" and v(text.format_value(F.lit(12.5), "integer", 0.0057, 0.0)) == "12.5000"
    assert v(text.format_value(F.lit(3.14159265), "float32", 1.0, 0.0)) == "3.141593"
    assert v(text.time_text(F.lit(1700000000123000000), "absolute_utc")) == "22:13:20.123"
    assert v(text.time_text(F.lit(1700000000123000000), "absolute", "Europe/Berlin")) == "23:13:20.123"


def test_raw_patterns(spark):
    f = frames(spark, [(0, 1, 0, [1, 0xFF, 0xFF, 0])])
    assert trace.raw_search(f, None, "01 ?? FF 00 05")[0].count() == 0 and trace.raw_search(f, None, "01 ?? FF 00 ??")[0].count() == 1
    log = frames(spark, [(i * 10**7, 0x222 if i % 2 else 0x111, 0, [(i // 2) & 1] if i % 2 else list(struct.pack("<h", i // 2 if i // 2 < 500 else 1000 - i // 2))) for i in range(2000)])
    counts = [trace.raw_search(log, i, p)[0].count() for i, p in ((0x222, ""), (0x222, "01"), (None, "01"), (0x111, "?? 01"), (0x333, ""))]
    assert counts == [1000, 500, 504, 489, 0]
    s = [decode.Signal(0x111, 0, 16, False, False, "integer", 0.01, 0.0)]
    r = samples.value_search_summary(log, s, 2.0, 3.0).first()
    assert (r.samples, r.hits, r.truncated) == (1000, 202, False) and (r.seen_min, r.seen_max) == (0.0, 5.0)
    hits = [x.frame_no for x in samples.value_search(log, s, 2.0, 3.0).orderBy("frame_no").collect()]
    assert hits == [*range(400, 601, 2), *range(1400, 1601, 2)]
    assert trace.raw_search(log, None, "", 5)[1] and trace.raw_search(log, None, "", 5)[0].count() == 5


def test_cycles(spark):
    ms = 10**6
    f = frames(spark, [(t * ms, 1, 0, []) for t in (1000, 1010, 1030, 1060, 1100)])
    c = trace.cycle_stats(f).first()
    assert (c.cycles, c.min_ns, c.max_ns, c.mean_ns, c.median_ns) == (4, 10 * ms, 40 * ms, 25 * ms, 25 * ms)
    f = frames(spark, [(t * ms, 1, 0, []) for t in (1000, 1010, 1030, 1060, 1100, *range(1105, 1105 + 5 * 256, 5))])
    c = trace.cycle_stats(f).first()
    assert c.median_ns == 5 * ms and c.max_ns == 40 * ms


def test_samples(spark):
    x = spark.createDataFrame([(i, i * 10, float(i)) for i in range(4)], "frame_no long, ts_ns long, value double")
    y = spark.createDataFrame([(i, 5 + i * 10, 10.0 + i) for i in range(3)], "frame_no long, ts_ns long, value double")
    assert [(r.x, r.y) for r in samples.xy_pair(x, y, keys=[]).orderBy("ts_ns").collect()] == [(0, 10), (1, 11), (2, 12)]
    s = spark.createDataFrame([("s", i, i * 10**9, v) for i, v in ((1, 10.0), (2, 20.0), (3, 35.0))], "signal string, frame_no long, ts_ns long, value double")
    at = lambda t: samples.values_at(s, int(t * 1e9), int(99e9), ["signal"]).first()
    assert (at(0.5).a, at(1.0).a, at(2.9).a, at(0.5).b) == (None, 10.0, 20.0, 35.0)
    p = spark.createDataFrame([("s", i, i, 99.0 if i == 333 else -99.0 if i == 777 else math.sin(i)) for i in range(1000)], "signal string, frame_no long, ts_ns long, value double")
    thin = samples.decimate(p, 0, 999, 10, ["signal"])
    assert thin.count() <= 24 and thin.filter("abs(value) = 99").count() == 2
    n = 64 * 64 * 8
    lod = samples.samples_lod(p.limit(0).unionByName(spark.range(n).selectExpr("'s' as signal", "id as frame_no", "id as ts_ns", "double(id) as value")), 64, 4, ["signal"])
    assert {r.level: r["count"] for r in lod.groupBy("level").count().collect()} == {0: n // 64, 1: n // 64 // 64, 2: 1}


def test_conditional_log(spark):
    rows = [("a", i, int(t * 1e9), float(v)) for i, (t, v) in enumerate([(1, 5), (2, 20), (2.5, 30), (3, 5), (9, 40)])]
    out = trigger.conditional_log(spark.createDataFrame(rows, "log string, frame_no long, ts_ns long, speed double"), [trigger.Condition("speed", ">", 10.0)], ["speed"], by=["log"])
    assert [r.frame_no for r in out.orderBy("ts_ns").collect()] == [0, 1, 2, 4]
    rows.append(("a", 5, int(12e9), 50.0))
    wide = spark.createDataFrame(rows, "log string, frame_no long, ts_ns long, speed double")
    assert trigger.conditional_log(wide, [], ["speed"], by=["log"]).count() == 0


def pdus(spark, rows):
    return [bytes(r.bytes) for r in transport.uds_pdus(frames(spark, rows)).orderBy("ts_ns").collect()]


def test_uds(spark):
    assert pdus(spark, [(0, 0x7E0, 0, [2, 0x10, 1])]) == [b"\x10\x01"]
    first = [0x10, 10, 0x22, 1, 2, 3, 4, 5]
    follow = [0x21, 6, 7, 8, 9, 0, 0, 0]
    assert pdus(spark, [(0, 0x7E0, 0, first), (1, 0x7E0, 0, follow)]) == [bytes([0x22, *range(1, 10)])]
    assert pdus(spark, [(0, 0x7E0, 0, first), (1, 0x7E0, 0, [0x30, 0, 0]), (2, 0x7E0, 0, follow), (3, 0x7E0, 0, [0x22, 1])]) == [bytes([0x22, *range(1, 10)])]
    assert pdus(spark, [(0, 0x7E0, 0, first), (1, 0x7E0, 0, [0x22, 6, 7]), (2, 0x7E0, 0, follow)]) == []
    assert pdus(spark, [(0, 0x7E0, 0, first), (1, 0x7E0, 0, [2, 0x3E, 0]), (2, 0x7E0, 0, follow)]) == [b"\x3e\x00"]
    assert pdus(spark, [(0, 0x7E0, 0, first), (1, 0x7E0, 0, [2, 0x05, 0]), (2, 0x7E0, 0, follow)]) == [bytes([0x22, *range(1, 10)])]
    assert pdus(spark, [(0, 0x7E0, 0, first), (0, 0x7E0, 16, first), (1, 0x7E0, 0, follow)]) == [bytes([0x22, *range(1, 10)])]
    assert pdus(spark, [(0, 0x18EBF110, 1, [2, 0x10, 1]), (1, 0x18DAF110, 1, [2, 0x10, 1]), (2, 0x3C, 0, [1, 2, 0x3E, 0], 0, "LIN")]) == [b"\x10\x01", b"\x3e\x00"]
    m = transport.uds_messages(frames(spark, [(0, 0x7E8, 0, [3, 0x7F, 0x22, 0x33]), (1, 0x18DAF1FE, 1, [4, 0x62, 0xF1, 0x90, 0x41])])).orderBy("ts_ns").collect()
    assert (m[0].type, m[0].description) == ("negative", "negative response: Security Access Denied")
    assert m[1].description == 'DID F190 VIN = 41  "A"' and m[1].metadata == {"Source Address": 0xFE, "Target Address": 0xF1}


def machine(rows):
    """Frame by frame: the session state machine of one id."""
    out, open_ = [], None
    for no, b in rows:
        kind, low = b[0] >> 4, b[0] & 15
        if kind == 0:
            size, at = (b[1], 2) if low == 0 and len(b) > 1 else (low, 1)
            if size and at + size <= len(b) and b[at] >= 0x10:
                out.append((no, bytes(b[at : at + size])))
                open_ = None
        elif kind == 1 and len(b) > 2 and b[2] >= 0x10 and (low << 8 | b[1]):
            open_ = [no, low << 8 | b[1], 1, list(b[2:])]
        elif kind == 2 and open_:
            if low != open_[2]:
                open_ = None
                continue
            open_[3] += b[1:][: max(0, open_[1] - len(open_[3]))]
            open_[2] = (low + 1) % 16
            if len(open_[3]) >= open_[1]:
                out.append((open_[0], bytes(open_[3])))
                open_ = None
    return out


def test_reassembly_equals_a_state_machine(spark):
    import random

    rng = random.Random(6)
    rows, by_id, sn = [], {}, {}
    for i in range(4000):
        can_id = 0x700 + rng.randrange(5)
        kind = rng.choices("fcsnx", [12, 60, 6, 4, 4])[0]
        if kind == "f":
            b, sn[can_id] = [0x10, rng.randrange(1, 40), *[rng.randrange(256) for _ in range(rng.choice([2, 6, 6, 6]))]], 1
        elif kind == "c":
            n = sn.get(can_id, 0)
            b, sn[can_id] = [0x20 | (n if rng.random() < 0.97 else n ^ 1), *[rng.randrange(256) for _ in range(rng.choice([7, 7, 7, 3]))]], (n + 1) % 16
        elif kind == "s":
            b = [rng.randrange(0, 9), *[rng.randrange(256) for _ in range(7)]]
        else:
            b = [0x30, 0, 0] if kind == "n" else [rng.randrange(0x40, 256), 1]
        by_id.setdefault(can_id, []).append((i, b))
        rows.append((i, can_id, 0, b))
    want = sorted(x for v in by_id.values() for x in machine(v))
    got = sorted((r.frame_nos[0], bytes(r.bytes)) for r in transport.uds_pdus(frames(spark, rows)).collect())
    assert got == want and len(want) > 300


def test_j1939_and_n2k(spark):
    cm, dt = 0x18ECFF05, 0x18EBFF05
    bam = [0x20, 9, 0, 2, 0xFF, 0xEC, 0xFE, 0]
    p = lambda rows: [(r.pgn, bytes(r.bytes)) for r in transport.j1939_pdus(frames(spark, rows)).orderBy("ts_ns").collect()]
    assert p([(0, cm, 1, bam), (1, dt, 1, [1, *b"ABCDEFG"]), (2, dt, 1, [2, *b"HI"])]) == [(0xFEEC, b"ABCDEFGHI")]
    assert p([(0, cm, 1, bam), (1, dt, 1, [2, *b"ABCDEFG"]), (2, dt, 1, [1, *b"HI"])]) == []
    assert p([(0, cm, 1, bam), (1, cm, 1, [255, *[0] * 7]), (2, dt, 1, [1, *b"ABCDEFG"]), (3, dt, 1, [2, *b"HI"])]) == []
    assert p([(0, 0x18FEF105, 1, [1, 2]), (1, 0x18DAF110, 1, [2, 0x10, 1])]) == [(0xFEF1, b"\1\2")]
    m = transport.j1939_messages(frames(spark, [(0, 0x18EAFF05, 1, [1]), (1, 0x0CF00405, 1, [1])])).orderBy("ts_ns").collect()
    assert m[0].description == "PDU1 (Peer-to-Peer) from SA [0x05] to DA [0xff]" and m[1].name == "Electronic Engine Controller 1 (EEC1)" and m[0].name == "PGN: 0xea00"
    n = transport.n2k_messages(frames(spark, [(0, 0x09F11280, 1, [1, 0x5C, 0x3D, 0xFF, 0x7F, 0xFF, 0x7F, 0xFD])])).first()
    assert n.name == "Vessel Heading" and n.description == "SID 1  heading 90.00°  deviation n/a  variation n/a  ref Magnetic"
    fast = (6 << 26) | (129542 << 8) | 3
    parts = [[0x40, 15, *range(6)], [0x41, *range(6, 13)], [0x42, 13, 14, 255, 255]]
    assert [bytes(r.bytes) for r in transport.n2k_pdus(frames(spark, [(i, fast, 1, b) for i, b in enumerate(parts)])).collect()] == [bytes(range(15))]
    assert transport.n2k_pdus(frames(spark, [(0, fast, 1, parts[0]), (1, fast, 1, parts[2])])).count() == 0
    assert transport.protocol_messages(frames(spark, [(0, 0x09F11280, 1, [1] * 8), (1, 0x7E0, 0, [2, 0x10, 1])])).count() == 3
    assert value(spark, n2k_fields(129025, array(*[0xFF, 0xFF, 0xFF, 0x7F, 0, 0, 0, 0]))["lat"]) is None
    assert value(spark, n2k_description(F.lit(129025), array(1))) == ""


def test_diagnostics(spark, tmp_path):
    f = frames(spark, [(0, 0x7E8, 4, [0, 11, 0x59, 2, 0xFF, 1, 0x23, 0, 0x2F, 0xC1, 0x55, 0x10, 9])])
    p = transport.uds_pdus(f)
    d = diagnostics.dtcs(p, spark.createDataFrame([("P0123-00", "throttle")], "code string, text string"))
    assert {(r.code, r.status, r.text) for r in d.collect()} == {("P0123-00", 0x2F, "throttle"), ("U0155-10", 9, None)}
    assert value(spark, uds.dtc_status(F.lit(9))) == "testFailed|confirmed"
    assert transport.uds_messages(f).first().description.startswith("2 DTCs\n  P0123-00  status 0x2F testFailed|")
    (tmp_path / "l.txt").write_text("ext 01 occurrences:u8 aging:u8\next 03 km:u24 volt:u8*0.1\nsnap F40C rpm:u16*0.25\nsnap F405 c:u8-40\n")
    layouts = read_dtc_fields(spark, str(tmp_path / "l.txt"))
    ext = [0x59, 6, 1, 0x23, 0, 0x2F, 1, 7, 9, 3, 0, 1, 2, 125, 0x77, 1]
    snap = [0x59, 4, 1, 0x23, 0, 0x2F, 1, 2, 0xF4, 0x0C, 0x10, 0, 0xF4, 5, 90]
    f = frames(spark, [(i, 0x7E8, 4, [0, len(b), *b]) for i, b in enumerate((ext, snap))])
    out = {(r.record, r.field): r.value for r in diagnostics.dtc_records(transport.uds_pdus(f), layouts).collect()}
    assert out == {(1, "occurrences"): 7, (1, "aging"): 9, (3, "km"): 258, (3, "volt"): 12.5, (0xF40C, "rpm"): 1024, (0xF405, "c"): 50}
    for request, want in (
        ([0x11, 0x81], "EcuReset 0x01 hardReset (suppress positive response)"), ([0x22, 0xF1, 0x90], "ReadDataByIdentifier F190 VIN"), ([0x14, 255, 255, 255], "ClearDiagnosticInformation group FFFFFF (all DTCs)"),
        ([0x19, 2, 0xFF], "ReadDTCInformation 0x02 reportDTCByStatusMask, status mask 0xFF"), ([0x31, 1, 2, 3, 9], "RoutineControl 0x01 startRoutine, routine 0203, options 09"),
        ([0x23, 0x24, 0, 0, 0x10, 0, 0, 0x20], "ReadMemoryByAddress address 0x1000 size 0x20"), ([0x27, 1], "SecurityAccess 0x01 requestSeed level 1"), ([0x36, 5, 1], "TransferData block 0x05, data 01"),
    ):
        assert value(spark, uds.uds_describe_request(array(*request))) == want


def test_dictionary(spark):
    from busframe.plans.fixtures import SIGNALS

    row = lambda name, start, n, be=False, factor=1.0, mux=None, muxer=False, lo=0.0, hi=0.0, kind="integer", i=1, msg="M": ("A", i, msg, "", 8, name, start, n, True, be, kind, factor, 0.0, lo, hi, "", muxer, mux is not None, mux, None, 0, ord(name[0]), None, None)
    d = spark.createDataFrame([
        row("a", 0, 8), row("b", 4, 8), row("c", 60, 8), row("d", 16, 8, factor=0.0), row("e", 24, 8, mux=1), row("f", 24, 8, mux=2), row("g", 32, 8, lo=2.0, hi=1.0), row("h", 40, 8, kind="float32"),
        row("x", 0, 8, i=2, msg="N"), row("x", 8, 8, i=2, msg="N"), row("y", 0, 8, i=3, msg="N"), row("z", 0, 0, i=4, msg="O"),
    ], SIGNALS)
    got = {(r.raw_id, r.signal, r.problem, r.other) for r in decode.dictionary_check(d).collect()}
    assert got == {
        (1, "a", "overlap", "b"), (1, "c", "outside the message", None), (1, "d", "factor 0", None), (1, "e", "no multiplexer", None), (1, "f", "no multiplexer", None), (1, "g", "min above max", None),
        (1, "h", "length of a float", None), (2, "x", "duplicate signal", None), (2, None, "duplicate message", None), (4, "z", "length 0", None),
    }
    names = lambda *rows: spark.createDataFrame([("A", *r) for r in rows], "network string, raw_id long, signal string, raw long, name string")
    _, kept = decode.merge_dictionary(d.filter("signal = 'a'"), d, names((1, "a", 0, "old")), names((1, "a", 0, "new"), (1, "b", 0, "fresh")))
    assert norm(kept.select("signal", "name").collect()) == norm([("a", "old"), ("b", "fresh")])


def test_seen_messages(spark):
    from busframe.plans import fixtures as fx

    body = [0] * 8
    rows = [(1, 256, 0, body, 0), (2, 257, 0, body, 1), (3, 258, 0, body, 2), (4, 258, 0, body, 2), (5, 259, 0, body, 1, "CAN", 1), (6, 260, 0, body, 0, "LIN"), (7, 9, 0, body, 0)]
    d, networks = fx.event_dictionary(spark), fx.event_networks(spark)
    f = frames(spark, rows)
    got = decode.seen_messages(f, d, networks)
    assert sorted(tuple(r) for r in got.collect()) == [(0, "A", 256, "Ev256", 1), (1, "B", 257, "Ev257", 1), (2, "A", 258, "Ev258", 2)]
    by_network = decode.seen_signals(d, f, networks).select("network", "raw_id").distinct().collect()
    assert sorted(map(tuple, by_network)) == [("A", 256), ("A", 258), ("B", 257)]
    assert decode.seen_signals(d, f).select("network", "raw_id").distinct().count() == 6
    assert decode.seen_messages(f.limit(0), d, networks).count() == 0
