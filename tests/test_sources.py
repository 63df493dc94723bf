import struct
from datetime import UTC, datetime

import pytest
from helpers import frames
from pyspark.sql import functions as F

from busframe.sources import binary_logs, dbc, logs, text_logs


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("frame_no").select(*cols).collect()]


def test_candump(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "(1700000000.123456789) can0 123#112233\n(1700000000.2) can1 1ABCDEF0#FF\n(1700000000.3) can1 123##1AABB\n(1700000000.4) can0 123#R4\n"
        "(1700000000.5) can0 20000080#0000000000000000\nrubbish\n(x) can0 123#00\n(1.0) can0 123#001122334455667788\n(2.0) can0 7ZZ#00\n"
    )
    out = rows(text_logs.read_candump(spark, str(tmp_path / "a.log")), "ts_ns", "iface", "channel", "can_id", "flags", "errors", "len", F.hex("data"))
    assert out == [
        (1700000000123456789, 0, "can0", 0x123, 0, 0, 3, "112233"), (1700000000200000000, 1, "can1", 0x1ABCDEF0, 1, 0, 1, "FF"),
        (1700000000300000000, 1, "can1", 0x123, 12, 0, 2, "AABB"), (1700000000400000000, 0, "can0", 0x123, 2, 0, 4, ""),
        (1700000000500000000, 0, "can0", 0x80, 0, 0x8000, 0, ""),
    ]


EVENTS = [  # ms, channel, kind, id, extended, sent, payload; kinds: data, fd, brs, remote (payload is its length), error, lin
    (3, 4, "brs", 0x0C5, False, True, bytes(range(90, 106))), (8, 2, "data", 0x0007, False, False, b""), (8, 4, "remote", 0x15555555, True, False, 3), (21, 2, "lin", 0x21, False, True, b"\x80\x01\xfe"),
    (40, 7, "fd", 0x7FF, False, False, bytes([255] * 20)), (41, 4, "error", 0, False, False, b""), (977, 7, "data", 0x00000F1, True, True, bytes.fromhex("de ad be ef 00 11 22 33")), (1500, 2, "fd", 0x12345, True, True, b"\x05"),
]


def codes(n):
    """The DLC of a length."""
    return next(c for c, size in enumerate([*range(9), 12, 16, 20, 24, 32, 48, 64]) if size >= n)


def expected(t0, kinds):
    """Of the events of these kinds: ts_ns, channel, bus, id, flags, error or not, length, payload."""
    out = []
    for ms, ch, kind, ident, ext, sent, load in EVENTS:
        if kind in kinds:
            flags = ext | (kind == "remote") << 1 | (kind in ("fd", "brs")) << 2 | (kind == "brs") << 3 | sent << 4
            size, data = (load, "") if kind == "remote" else (len(load), load.hex().upper())
            out.append((t0 + ms * 1_000_000, f"CH {ch}", "LIN" if kind == "lin" else "CAN", ident, 0 if kind == "error" else flags, kind == "error", size, data))
    return out


def read_back(df):
    return [tuple(r) for r in df.orderBy("frame_no").select("ts_ns", "channel", "bus", "can_id", "flags", F.col("errors") != 0, "len", F.hex("data")).collect()]


def asc_event(ms, ch, kind, ident, ext, sent, load):
    time, name, way = f"{ms / 1000:.6f}", f"{ident:x}{'x' * ext}", "Tx" if sent else "Rx"
    if kind == "error":
        return f" {time} {ch}  ErrorFrame"
    if kind == "remote":
        return f" {time} {ch}  {name} {way} r {load}"
    spaced = " ".join(f"{b:02x}" for b in load)
    if kind == "lin":
        return f" {time} {ch} LIN {name} {way} d {len(load)} {spaced} checksum = 00"
    if kind == "data":
        return f" {time} {ch}  {name} {way} d {len(load)} {spaced}"
    return f" {time} CANFD {ch} {way} {name} {int(kind == 'brs')} 0 {codes(len(load)):x} {len(load)} {spaced} 0 0 0"


def test_asc(spark, tmp_path):
    zones = {"UTC": 0, "America/New_York": 5 * 3600, "Asia/Kolkata": -5.5 * 3600}
    start = datetime(2031, 2, 4, 17, 8, 9, 500_000, UTC)
    for name, stamp in {"h24": start.strftime("%a %b %d %H:%M:%S.500 %Y"), "h12": start.strftime("%a %b %d %I:%M:%S.500 pm %Y")}.items():
        (tmp_path / name).write_text("\n".join([f"date {stamp}", "base hex timestamps absolute", "no event here", *[asc_event(*e) for e in EVENTS], " 9.0 1 zz Rx d 1 00", " 9.0 1 10 Rx d 2 00", ""]))
        for zone, behind in zones.items():
            t0 = int(start.timestamp() * 10**9 + behind * 10**9)
            assert read_back(text_logs.read_asc(spark, str(tmp_path / name), zone)) == expected(t0, {e[2] for e in EVENTS})


def trc_event(version, i, ms, ch, kind, ident, ext, sent, load):
    way, code = "Tx" if sent else "Rx", codes(len(load)) if isinstance(load, bytes) else load
    name, spaced = f"{ident:0{8 if ext else 4}X}", "RTR" if kind == "remote" and version == "1.1" else "" if kind == "remote" else " ".join(f"{b:02X}" for b in load)
    if version == "1.1":
        return f"{i:6d}) {ms:12.1f} {way} {name} {code} {spaced}"
    mark = {"data": "DT", "fd": "FD", "brs": "FB", "remote": "RR", "error": "ER"}[kind]
    name, code, spaced = ("-", 5, "00 00 00 00 00") if kind == "error" else (name, code, spaced)
    if version == "2.0":
        return f"{i:6d} {ms:12.3f} {mark} {name} {way} {len(load) if kind != 'error' and isinstance(load, bytes) else code} {spaced}"
    return f"{i:6d} {ms:12.3f} {mark} {ch} {name} {way} - {code} {spaced}"


@pytest.mark.parametrize(("version", "kinds"), [("1.1", {"data", "remote"}), ("2.0", {"data", "fd", "brs", "remote"}), ("2.1", {"data", "fd", "brs", "remote", "error"})])
def test_trc(spark, tmp_path, version, kinds):
    start = datetime(2031, 2, 4, 18, tzinfo=UTC)
    days = (start - datetime(1899, 12, 30, tzinfo=UTC)).total_seconds() / 86400
    columns = {"1.1": [], "2.0": [], "2.1": [";$COLUMNS=N,O,T,B,I,d,R,L,D"]}[version]
    lines = [f";$FILEVERSION={version}", f";$STARTTIME={days}", *columns, ";", *[trc_event(version, i, *e) for i, e in enumerate(EVENTS, 1) if e[2] in kinds]]
    (tmp_path / "log").write_bytes("\r\n".join([*lines, ""]).encode())
    want = expected(int(start.timestamp()) * 10**9, kinds)
    if version != "2.1":  # no channels
        want = [(t, "CH 1", *rest) for t, _, *rest in want]
    assert read_back(text_logs.read_trc(spark, str(tmp_path / "log"))) == want


def packet(word, data, fd=0):
    return struct.pack(">IBBBB", word, len(data), fd, 0, 0) + data


def test_captures(spark, tmp_path):
    packets = [packet(0x123, b"\x01\x02"), packet(0x80000000 | 0x18DAF110, b"\x03"), packet(0x20000080, bytes(8)), packet(0x456, bytes(range(12)).ljust(12), 5)]
    for order in "<>":
        head = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 227)
        body = b"".join(struct.pack(order + "IIII", 10, 5 + i, len(p), len(p)) + p for i, p in enumerate(packets))
        (tmp_path / f"{ord(order)}.pcap").write_bytes(head + body + b"\0\0")
        out = rows(binary_logs.read_pcap(spark, str(tmp_path / f"{ord(order)}.pcap")), "ts_ns", "can_id", "flags", "errors", "len")
        assert out == [(10000005000, 0x123, 0, 0, 2), (10000006000, 0x18DAF110, 1, 0, 1), (10000007000, 0x80, 0, 0x8000, 0), (10000008000, 0x456, 12, 0, 12)]
        pad = lambda b: b.ljust(-(-len(b) // 4) * 4, b"\0")
        block = lambda kind, b, o=order: struct.pack(o + "II", kind, len(b) + 12) + b + struct.pack(o + "I", len(b) + 12)
        options = struct.pack(order + "HH", 2, 4) + b"vcan" + struct.pack(order + "HH", 9, 1) + b"\x09\0\0\0" + struct.pack(order + "HH", 0, 0)
        ng = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", 227, 0, 0) + options)
        for i, p in enumerate(packets):
            ts = 10 * 10**9 + i
            ng += block(6, struct.pack(order + "IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(p), len(p)) + pad(p))
        (tmp_path / f"{ord(order)}.pcapng").write_bytes(ng)
        out = rows(binary_logs.read_pcapng(spark, str(tmp_path / f"{ord(order)}.pcapng")), "ts_ns", "channel", "can_id", "len")
        assert out == [(10**10, "vcan", 0x123, 2), (10**10 + 1, "vcan", 0x18DAF110, 1), (10**10 + 2, "vcan", 0x80, 0), (10**10 + 3, "vcan", 0x456, 12)]


SAMPLE = [
    (10**18 + 1_000_000, 0x123, 0, [1, 2, 3]), (10**18 + 2_000_000, 0x1ABCDEF0, 0x11, [0xFF]), (10**18 + 3_000_000, 0x123, 2, []), (10**18 + 4_000_000, 0x124, 0x0C, list(range(12))),
    (10**18 + 5_000_000, 0x125, 4, list(range(64)), 1), (10**18 + 6_000_000, 0x126, 0, []), (10**18 + 7_000_000, 0, 0, [], 0, "CAN", 0x8000),
]


@pytest.mark.parametrize("kind", ["candump", "asc", "trc"])
def test_round_trip(spark, tmp_path, kind):
    df = frames(spark, SAMPLE)
    logs.WRITERS[kind](df, str(tmp_path / "out"))
    back = logs.read_log(spark, str(tmp_path / "out"), kind)
    flags = F.col("flags").bitwiseAND(0xFF if kind != "candump" else 0xEF)
    cols = [F.when(F.col("errors") == 0, F.col("can_id")).otherwise(0).alias("id"), flags.alias("flags"), (F.col("errors") != 0).alias("e"), F.hex("data").alias("d")]
    t = lambda d: [tuple(r) for r in d.orderBy("ts_ns").select(F.col("ts_ns") - 10**18, *cols).collect()]
    assert t(back) == t(df)


def test_convert_and_table(spark, tmp_path):
    logs.write_candump(frames(spark, SAMPLE), str(tmp_path / "a"))
    logs.convert_log(spark, str(tmp_path / "a"), str(tmp_path / "b"), "parquet", "log")
    assert spark.read.parquet(str(tmp_path / "b")).count() == len(SAMPLE)
    table = logs.build_frame_table(spark.read.parquet(str(tmp_path / "b")), str(tmp_path / "c"), partitions=2)
    assert table.count() == len(SAMPLE)
    part = lambda d: d._jdf.inputFiles()
    made = set(part(table))
    again = logs.build_frame_table(spark.read.parquet(str(tmp_path / "b")), str(tmp_path / "c"), partitions=2)
    assert set(part(again)) == made  # the source is as it was
    logs.write_candump(frames(spark, SAMPLE[:3]), str(tmp_path / "a2"))
    logs.convert_log(spark, str(tmp_path / "a2"), str(tmp_path / "b2"), "parquet", "log")
    other = logs.build_frame_table(spark.read.parquet(str(tmp_path / "b2")), str(tmp_path / "c"), partitions=2)
    assert other.count() == 3  # another source: built anew
    assert logs.build_frame_table(frames(spark, SAMPLE[:2]), str(tmp_path / "c")).count() == 2  # no files
    table = logs.build_frame_table(spark.read.parquet(str(tmp_path / "b")), str(tmp_path / "c"), partitions=2)
    assert table.count() == len(SAMPLE) and "head" in table.columns
    plan = table.filter("can_id = 291")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(can_id), EqualTo(can_id,291)]" in plan
    with pytest.raises(ValueError):
        logs.read_log(spark, "x.mf4")


def test_a_table_knows_its_plan(spark, tmp_path):
    """Another filter, option or session of the same files is another table; a build that stopped is none."""
    from concurrent.futures import ThreadPoolExecutor

    f = frames(spark, [(i, 0x100 + i % 7, 0, [i % 256], i % 3) for i in range(300)])
    f.write.parquet(str(tmp_path / "src"))
    path = str(tmp_path / "table")
    src = lambda **o: spark.read.options(**o).parquet(str(tmp_path / "src"))
    built = lambda df: (logs.build_frame_table(df, path).count(), len(logs.Versions(spark, path).names()))
    assert built(src()) == (300, 1)
    assert built(src()) == (300, 1)
    assert built(src().filter("iface = 1")) == (100, 2)
    assert built(src().filter("iface = 1 and can_id = 256")) == (14, 2)
    assert built(src()) == (300, 2)
    newest = logs.Versions(spark, path).names()[-1]
    assert built(src(mergeSchema="true"))[0] == 300 and logs.Versions(spark, path).names()[-1] != newest
    # what a writer left that stopped before its mark isn't seen
    src().filter("iface = 2").write.parquet(logs.Versions(spark, path).data("9999999999-half"))
    assert logs.frame_table(spark, path).count() == 300
    with pytest.raises(Exception, match="(?i)unable to infer schema|does not exist"):
        spark.read.parquet(path).count()
    with pytest.raises(FileNotFoundError):
        logs.frame_table(spark, str(tmp_path / "none"))
    # readers during rebuilds see whole tables
    with ThreadPoolExecutor(2) as pool:
        builds = pool.submit(lambda: [built(src().filter(f"iface <> {i % 2}")) for i in range(3)])
        seen = []
        while not builds.done():
            seen.append(logs.frame_table(spark, path).count())
        builds.result()
    assert set(seen) <= {300, 200}


def test_tailed_files(spark, tmp_path):
    """Lines appended in pieces, over restarts and ranges of few bytes: each comes once, when it is whole."""
    from busframe.sources import tail

    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"(17000000{i:02d}.{i:06d}) can{i % 3} {0x100 + i:X}#{'AB' * (i % 9)}" for i in range(40)]
    text = "\n".join(lines) + "\n"
    out = []

    def run(size):
        stream = tail.tail_candump(spark, str(folder), ["can2", "can0"], suffix=".log", range_bytes=size)
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    def append(name, part):
        with (folder / name).open("a") as f:
            f.write(part)

    append("a.log", text[:333])
    append("skip.txt", text)
    run(1 << 20)
    assert len(out) == text[:333].count("\n")
    append("a.log", text[333:700])
    append("b.log", lines[39] + "\r\nrubbish\n(1.0) can0 1")
    run(17)
    append("a.log", text[700:])
    append("b.log", "#00\n")
    run(50)
    run(50)
    assert sorted(r.can_id for r in out if r.log.endswith("a.log")) == [0x100 + i for i in range(40)]
    assert sorted((r.ts_ns, r.can_id, r.iface) for r in out if r.log.endswith("b.log")) == [(10**9, 1, 1), (1700000039000039000, 0x127, 1)]
    assert {(r.channel, r.iface) for r in out} == {("can0", 1), ("can1", None), ("can2", 0)}


def test_candump_errors(spark):
    from busframe.schema import ERROR_BITS

    df = spark.createDataFrame([(b,) for b in [*ERROR_BITS.values(), 0x0003]], "e int")
    out = {r.e: (r.x.id, r.x.data) for r in df.select("e", logs.socketcan_error(F.col("e")).alias("x")).collect()}
    assert out[ERROR_BITS["ACK"]] == (0x200000A0, [0] * 8)
    assert out[ERROR_BITS["CRC"]] == (0x20000088, [0, 0, 0, 8, 0, 0, 0, 0])
    assert out[ERROR_BITS["PASSIVE"]] == (0x20000004, [0, 0x30, 0, 0, 0, 0, 0, 0])
    assert out[0x8000] == (0x20000080, [0] * 8)
    assert out[3] == (0x200000A8, [0, 0, 1, 0, 0, 0, 0, 0])


DBC = '''VERSION ""
BO_ 256 Engine: 8 ECU
 SG_ Speed : 0|16@1+ (0.1,0) [0|6000] "rpm" X
 SG_ Temp : 23|8@0- (1,-40) [0|0] "C" X
 SG_ Mode M : 24|4@1+ (1,0) [0|15] "" X
 SG_ A m0 : 32|8@1+ (1,0) [0|255] "" X
 SG_ Bad m0M : 32|8@1+ (1,0) [0|255] "" X
BO_ 2364540158 Wide: 8 Vector__XXX
 SG_ F : 0|32@1- (1,0) [0|0] "" X
BA_ "skip" 1;
CM_ BO_ 256 "first line
second";
CM_ SG_ 256 Speed "how fast";
VAL_ 256 Mode 0 "off" 1 "on" ;
VAL_ 217056510 F 1 "one" ;
SIG_VALTYPE_ 2364540158 F : 1;
BO_ broken
'''


def test_dbc(spark, tmp_path):
    (tmp_path / "a.dbc").write_text(DBC)
    signals, names, errors = dbc.read_dbc(spark, str(tmp_path / "a.dbc"), "N")
    s = {r.signal: r for r in signals.collect()}
    assert set(s) == {"Speed", "Temp", "Mode", "A", "F"}
    assert (s["Temp"].start_bit, s["Temp"].big_endian, s["Temp"].is_unsigned, s["Temp"].offset) == (16, True, False, -40.0)
    assert s["A"].mux_value == 0 and s["A"].muxer.start_bit == 24 and s["Mode"].is_muxer
    assert s["F"].value_type == "float32" and s["F"].sender == "" and s["F"].raw_id == 2364540158
    assert s["Speed"].message_comment == "first line\nsecond" and s["Speed"].signal_comment == "how fast" and s["Speed"].unit == "rpm"
    assert sorted((r.signal, r.raw, r.name) for r in names.collect()) == [("F", 1, "one"), ("Mode", 0, "off"), ("Mode", 1, "on")]
    assert sorted(r.line.strip()[:8] for r in errors.collect()) == ["BO_ brok", "SG_ Bad "]


def test_codes_and_layouts(spark, tmp_path):
    texts = [(0x4A21, "pump, low flow"), (0xB0, "door open"), (0xB0, "door ajar"), (0x77, "")]
    (tmp_path / "c.txt").write_text("# pumps and doors\n" + "".join(f"{'0x' * (i % 2)}{code:X}{' ' if i else ', '}{text}\n" for i, (code, text) in enumerate(texts)) + "not-a-code x\n")
    assert {(r.code, r.text) for r in text_logs.read_code_texts(spark, str(tmp_path / "c.txt")).collect()} == set(dict(texts).items())
    layouts = {("ext", 0x11): [("wear", "u24", "", ""), ("cell", "u8", "*0.02", "")], ("ext", 0x12): [("began", "time", "", "")], ("snap", 0x2F0): [("level", "u16", "*0.5", ""), ("rest", "u8", "", "")], ("snap", 0x2F1): [("heat", "u8", "", "-55")]}
    (tmp_path / "d.txt").write_text("".join(f"{k} {r:02X} " + " ".join(f"{n}:{t}{s}{o}" for n, t, s, o in fields) + "\n" for (k, r), fields in layouts.items()) + "other 01 x:u8\next 1FF far:u8\next 13 odd:u9\n")
    size = {"u8": 1, "u16": 2, "u24": 3, "time": 4}
    want = {(k, r, n): (size[t], float(s[1:] or 1), float(o or 0)) for (k, r), fields in layouts.items() for n, t, s, o in fields[: 1 if k == "snap" else None]}
    assert {(r.kind, r.record, r.name): (r.size, r.scale, r.offset) for r in text_logs.read_dtc_fields(spark, str(tmp_path / "d.txt")).collect()} == want
