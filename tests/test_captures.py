"""Captures in ranges of every size against a reader of whole files."""

import random
import struct

import pytest
from helpers import frames
from pyspark.sql import functions as F

from busframe.sources import binary_logs, logs

COLUMNS = ["log", "frame_no", "ts_ns", "channel", "can_id", "flags", "errors", "len"]


def can(rng, trap=b""):
    load = (trap or rng.randbytes(8))[:8]
    return struct.pack(">IBBBB", rng.choice([0x123, 0x80000000 | 0x18DAF110, 0x20000080]), len(load), 0, 0, 0) + load.ljust(8, b"\0")


def pcap(rng, order, n):
    """Payloads often look like headers of records."""
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 227)
    for i in range(n):
        p = can(rng, struct.pack(order + "II", 16, 16) if rng.random() < 0.5 else b"")
        if rng.random() < 0.05:
            p += rng.randbytes(rng.randrange(300))
        out += struct.pack(order + "IIII", 10, i, len(p), len(p)) + p
    return out


def block(order, kind, body):
    body = body.ljust(-(-len(body) // 4) * 4, b"\0")
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def pcapng(rng, n):
    """Sections in both orders, interfaces of other links and other resolutions in between, blocks of other kinds."""
    out, order, faces = b"", "<", 0
    for i in range(n):
        if i % 40 == 0:
            order, faces = rng.choice("<>"), 0
            out += block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
        if i % 20 == 0:
            name = f"bus{i}".encode()
            out += block(order, 1, struct.pack(order + "HHI", 227 if i % 3 else 1, 0, 0) + struct.pack(order + "HH", 2, len(name)) + name.ljust(-(-len(name) // 4) * 4, b"\0") + struct.pack(order + "HHI", 9, 1, 9) + struct.pack(order + "I", 0))
            faces += 1
        if rng.random() < 0.1:
            out += block(order, 5, rng.randbytes(20))
        p = can(rng)
        out += block(order, 6, struct.pack(order + "IIIII", rng.randrange(faces + 1), 0, 1000 + i, len(p), len(p)) + p)
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS, F.hex("data")).collect())


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_ranges(spark, tmp_path, kind):
    rng = random.Random(7)
    data = [pcap(rng, "<", 200), pcap(rng, ">", 60)[:-7], b"no capture at all" * 9, b""] if kind == "pcap" else [pcapng(rng, 200), pcapng(rng, 50)[:-30], b"nothing of the kind" * 9, b""]
    for i, d in enumerate(data):
        (tmp_path / f"{i}.{kind}").write_bytes(d)
    read = getattr(binary_logs, f"read_{kind}")
    whole = rows(read(spark, str(tmp_path)))
    assert len(whole) > 50
    for size in (150, 2000):
        part = read(spark, str(tmp_path), range_bytes=size)
        assert rows(part) == whole


def test_a_payload_of_headers(spark, tmp_path):
    """A packet whose payload is a chain of packets: ranges that begin in it are walked again."""
    rng = random.Random(1)
    inner = pcap(rng, "<", 60)[24:]
    outer = struct.pack("<IIII", 10, 5, len(inner), len(inner)) + inner
    (tmp_path / "a.pcap").write_bytes(pcap(rng, "<", 5) + outer + pcap(rng, "<", 5)[24:])
    whole = rows(binary_logs.read_pcap(spark, str(tmp_path / "a.pcap")))
    assert len(whole) == 11 and rows(binary_logs.read_pcap(spark, str(tmp_path / "a.pcap"), range_bytes=64)) == whole


def test_written_captures(spark, tmp_path):
    f = frames(spark, [(10**18 + i, 0x100 + i, flags, data) for i, (flags, data) in enumerate([(0, [1, 2]), (1, []), (12, list(range(48))), (2, []), (4, [7] * 12)])])
    logs.write_pcap(f, str(tmp_path / "out"))
    back = logs.read_log(spark, str(tmp_path / "out"), "pcap")
    cols = ["ts_ns", "can_id", "flags", "len", F.hex("data")]
    want = [tuple(r) for r in f.orderBy("ts_ns").select(*cols).collect()]
    assert [tuple(r) for r in back.orderBy("ts_ns").select(*cols).collect()] == want
