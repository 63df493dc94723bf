"""Packet captures (pcap, pcapng) of SocketCAN, read in byte ranges by many tasks.

Captures have no marks between packets. So a range looks for a place from which a chain of plausible headers follows,
walks on from there to the first packet at or behind its end, and tells both places; the interfaces and sections that it
meets (pcapng) come with them. Ranges that don't begin where the one before them ended are walked again from there,
until all fit: what a payload may look like can cost a walk, but never a packet. Then each range parses its packets. A
file of one range is parsed at once. A cut file ends at its last whole packet.

Files are read by pyarrow's file systems, from the storage that Spark names them in; only the walk's table, with a row for
each range, is shuffled.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BRS, EXTENDED, FD, GENERIC_ERROR, RTR
from ..session import shared_path, ship_package
from .text_logs import finish

RAW = "log string, frame_no long, ts_ns long, channel string, bus string, can_id long, flags int, errors int, bytes array<int>, remote_len long"
LINKTYPE, BATCH = 227, 20_000
RANGE_BYTES, BLOCK, TASK_BYTES = 64 << 20, 1 << 20, 8 << 20
CHAIN, LONGEST = 24, 1 << 18


def opened(uri: str):
    """File system and path of a name that Spark gave."""
    local = re.match(r"^file:/+", uri)
    if local or "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), "/" + uri[local.end() :] if local else uri
    return pyarrow.fs.FileSystem.from_uri(uri)


class File:
    """Bytes of a file by place; a block is kept."""

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        self.size, self.start, self.block = self.file.size(), 0, b""

    def at(self, start: int, n: int) -> bytes:
        off = start - self.start
        if off < 0 or off + n > len(self.block):
            self.start, off = start, 0
            self.block = self.file.read_at(max(0, min(max(n, BLOCK), self.size - start)), start) if start < self.size else b""
        return self.block[off : off + n]


def socketcan(packet: bytes) -> tuple | None:
    """can_id, flags, errors, bytes, remote_len of a SocketCAN packet (id in network order)."""
    if len(packet) < 8:
        return None
    word, n, fd_flags = struct.unpack(">IBB", packet[:6])
    is_fd = len(packet) > 16 or fd_flags & 0x04
    n = min(n, 64 if is_fd else 8, len(packet) - 8)
    if word & 0x20000000:
        return word & 0x1FFFFFFF, 0, GENERIC_ERROR, [], None
    flags = (EXTENDED if word & 0x80000000 else 0) | (RTR if word & 0x40000000 else 0) | ((FD | (BRS if fd_flags & 1 else 0)) if is_fd else 0)
    return word & (0x1FFFFFFF if word & 0x80000000 else 0x7FF), flags, 0, [] if flags & RTR else list(packet[8 : 8 + n]), n if flags & RTR else None


class Pcap:
    """Records behind a header of 24 bytes; the order of bytes is that of the whole file."""

    def __init__(self, file: File):
        self.file, head = file, file.at(0, 24)
        # The marks of both orders, in microseconds and in nanoseconds.
        marks = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
        self.order, self.unit = marks.get(head[:4], ("", 0))
        self.known = bool(self.order) and len(head) == 24 and struct.unpack(self.order + "I", head[20:24])[0] & 0xFFFF == LINKTYPE
        self.first = 24

    def next(self, at: int, order: str, strict: bool = False) -> tuple[int, str] | None:
        """Where the record at a place ends, and the order of bytes behind it; None if it doesn't fit the file."""
        head = self.file.at(at, 16)
        if len(head) < 16:
            return None
        _, fraction, size, whole = struct.unpack(self.order + "IIII", head)
        if at + 16 + size > self.file.size or (strict and (fraction * self.unit >= 10**9 or not 8 <= size <= min(whole, LONGEST))):
            return None
        return at + 16 + size, order

    def orders(self) -> str:
        return self.order

    def meta(self, at: int, order: str) -> bytes | None:
        return None

    def packet(self, at: int, end: int, order: str, faces: list) -> tuple[str, int, bytes]:
        sec, fraction = struct.unpack(self.order + "II", self.file.at(at, 8))
        return "pcap0", sec * 10**9 + fraction * self.unit, self.file.at(at + 16, end - at - 16)


class PcapNg:
    """Blocks with their lengths at both ends; a section sets the order of bytes and forgets the interfaces."""

    SECTION = b"\x0a\x0d\x0d\x0a"

    def __init__(self, file: File):
        self.file, self.known, self.first = file, True, 0

    def next(self, at: int, order: str, strict: bool = False) -> tuple[int, str] | None:
        head = self.file.at(at, 12)
        if len(head) < 12:
            return None
        if head[:4] == self.SECTION:
            order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">" if head[8:12] == b"\x1a\x2b\x3c\x4d" else ""
        if not order:
            return None
        kind, size = struct.unpack(order + "II", head[:8])
        if size < 12 or size % 4 or at + size > self.file.size:
            return None
        if strict and (at % 4 or size > LONGEST or (kind > 0xFF and head[:4] != self.SECTION and kind < 0x80000000) or self.file.at(at + size - 4, 4) != head[4:8]):
            return None
        return at + size, order

    def orders(self) -> str:
        return "<>"

    def meta(self, at: int, order: str) -> bytes | None:
        """The block, if it is a section or an interface."""
        kind, size = struct.unpack(order + "II", self.file.at(at, 8))
        return self.file.at(at, size) if kind in (0x0A0D0D0A, 1) else None

    @staticmethod
    def face(block: bytes, order: str, number: int) -> tuple[int, str, int]:
        """Link type, name and ticks a second of an interface block."""
        link, name, ticks, at = struct.unpack_from(order + "H", block, 8)[0], f"if{number}", 10**6, 16
        while at + 4 <= len(block) - 4:
            code, n = struct.unpack_from(order + "HH", block, at)
            value = block[at + 4 : at + 4 + n]
            if code == 0 or len(value) < n:
                break
            if code == 2 and n:
                name = value.split(b"\0")[0].decode(errors="replace")
            elif code == 9 and n:
                ticks = 1 << (value[0] & 127) if value[0] & 128 else 10 ** value[0]
            at += 4 + -(-n // 4) * 4
        return link, name, ticks

    def packet(self, at: int, end: int, order: str, faces: list) -> tuple[str, int, bytes] | None:
        kind, = struct.unpack(order + "I", self.file.at(at, 4))
        if kind != 6 or end - at < 32:
            return None
        face, high, low, n = struct.unpack(order + "IIII", self.file.at(at + 8, 16))
        if face >= len(faces) or faces[face][0] != LINKTYPE or 28 + n > end - at - 4:
            return None
        return faces[face][1], (high << 32 | low) * 10**9 // faces[face][2], self.file.at(at + 28, n)


def found(capture, begin: int, end: int) -> tuple[int, str] | None:
    """The first place of a range from which a chain of headers follows, or which leads to the end of the file."""
    for start in range(begin, min(end, begin + LONGEST, capture.file.size)):
        for order in capture.orders():
            at, seen, n = start, order, 0
            while n < CHAIN and at < capture.file.size and (step := capture.next(at, seen, True)):
                (at, seen), n = step, n + 1
            if n == CHAIN or (n and at == capture.file.size):
                return start, order
    return None


def walked(capture, at: int, order: str, end: int) -> tuple[int, str, list[tuple[int, str, bytes]]]:
    """From a packet's place: the first place at or behind the end (the file's end, if a packet doesn't fit), the order of
    bytes there, and the sections and interfaces between."""
    metas = []
    while at < end:
        step = capture.next(at, order)
        if step is None:
            return capture.file.size, order, metas
        if (block := capture.meta(at, step[1])) is not None:
            metas.append((at, step[1], block))
        at, order = step
    return at, order, metas


KINDS = {"pcap": Pcap, "pcapng": PcapNg}
WALK = "path string, length long, i int, begin long, end long, sync long, sync_order string, stop long, stop_order string, metas array<struct<at:long,order:string,block:binary>>"


def _walks(kind: str):
    """Rows of WALK of ranges (path, length, i, begin, end, start, start_order); start is where a range is told to begin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, capture = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.path != path:  # ranges of a file follow each other
                    path, capture = r.path, KINDS[kind](File(r.path))
                begin, end = int(r.begin), int(r.end)
                place = None
                if capture.known:
                    first = (capture.first, capture.orders()[0]) if r.i == 0 else None
                    place = first or ((int(r.start), r.start_order) if r.start == r.start and r.start is not None else found(capture, begin, end))
                if place is None or place[0] >= end:
                    out.append((r.path, r.length, r.i, begin, end, None, None, None, None, []))
                else:
                    stop, order, metas = walked(capture, *place, end)
                    out.append((r.path, r.length, r.i, begin, end, *place, stop, order, metas))
            names = [c.split()[0] for c in WALK.split(", ")]
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"sync": "Int64", "stop": "Int64"})

    return run


def _frames(kind: str):
    """Frames of ranges (path, end, sync, sync_order, metas); a frame's number is its packet's place in the file."""
    names = [c.split()[0] for c in RAW.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, capture = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.path != path:
                    path, capture = r.path, KINDS[kind](File(r.path))
                if not capture.known:
                    continue
                at, order, faces, rows = int(r.sync), r.sync_order, [], []

                def met(order: str, block: bytes, faces: list = faces) -> None:
                    if block[:4] == PcapNg.SECTION:
                        faces.clear()
                    else:
                        faces.append(PcapNg.face(block, order, len(faces)))

                for m in sorted((m["at"], m["order"], bytes(m["block"])) for m in r.metas):
                    if m[0] < at:
                        met(m[1], m[2])
                while at < r.end and (step := capture.next(at, order)):
                    end, order = step
                    block = capture.meta(at, order)
                    if block is not None:
                        met(order, block)
                    elif (p := capture.packet(at, end, order, faces)) and (f := socketcan(p[2])):
                        rows.append((r.path, at, p[1], p[0], "CAN", *f))
                    at = end
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"frame_no": "int64", "ts_ns": "int64", "can_id": "int64"})

    return run


def capture_ranges(spark: SparkSession, path: str | list[str], kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, end, sync, sync_order, metas of the ranges of all files that hold the beginning of a packet."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.greatest(F.ceil(F.col("length") / range_bytes) - 1, F.lit(0)).cast("int")
    ranges = files.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    begin = F.col("i").cast("long") * range_bytes
    none = F.lit(None)
    ranges = ranges.select("path", "length", "i", begin.alias("begin"), F.least(begin + range_bytes, F.col("length")).alias("end"), none.cast("long").alias("start"), none.cast("string").alias("start_order"))
    n = ranges.count()
    if n == files.count():  # every file is one range
        first, order = (24, "<") if kind == "pcap" else (0, "<")
        empty = F.array().cast("array<struct<at:long,order:string,block:binary>>")
        return ranges.repartitionByRange(max(n, 1), "path", "i").select("path", "end", F.lit(first).cast("long").alias("sync"), F.lit(order).alias("sync_order"), empty.alias("metas"))

    # a task takes neighbouring ranges, TASK_BYTES of them, so that small ranges and files don't cost a task each
    tasks = lambda n: max(1, min(n, -(-n * range_bytes // TASK_BYTES)))

    def done(todo: DataFrame, n: int) -> DataFrame:
        return todo.repartitionByRange(tasks(n), "path", "i").mapInPandas(_walks(kind), WALK)

    def stored(rows: DataFrame) -> DataFrame:
        target = shared_path(spark, "ranges")
        rows.write.parquet(target)
        return spark.read.schema(WALK).parquet(target)

    walks = stored(done(ranges, n))
    along = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        before = F.last(F.when(F.col("stop").isNotNull(), F.struct("stop", "stop_order")), ignorenulls=True).over(along)
        judged = walks.withColumn("before", before)
        right = F.when(F.col("sync").isNull(), F.col("before.stop") >= F.col("end")).otherwise((F.col("sync") == F.col("before.stop")) & (F.col("sync_order") == F.col("before.stop_order")))
        judged = judged.withColumn("right", (F.col("i") == 0) | F.coalesce(right, F.col("before").isNull() & F.col("sync").isNull()))
        wrong = judged.filter(~F.col("right"))
        m = wrong.count()
        if not m:
            break
        again = wrong.select("path", "length", "i", "begin", "end", F.coalesce("before.stop", "length").alias("start"), F.coalesce("before.stop_order", F.lit("<")).alias("start_order"))
        walks = stored(judged.filter("right").select(*walks.columns).unionByName(done(again, m)))
    metas = walks.groupBy("path").agg(F.flatten(F.collect_list("metas")).alias("metas"))  # sections and interfaces of a file
    return walks.filter("sync is not null").drop("metas").join(metas, "path").select("path", "i", "end", "sync", "sync_order", "metas").repartitionByRange(tasks(n), "path", "i").drop("i")


def _read(spark: SparkSession, path: str | list[str], kind: str, range_bytes: int) -> DataFrame:
    # a pcap has one channel, so no pass numbers them
    return finish(capture_ranges(spark, path, kind, range_bytes).mapInPandas(_frames(kind), RAW), ["pcap0"] if kind == "pcap" else None)


def read_pcap(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of SocketCAN captures; frame_no is a packet's place in its file."""
    return _read(spark, path, "pcap", range_bytes)


def read_pcapng(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of SocketCAN packets of all sections and interfaces; frame_no is a packet's place in its file."""
    return _read(spark, path, "pcapng", range_bytes)


def write_pcap(frames: DataFrame, path: str) -> None:
    """CAN frames in the order of time, as a folder of captures with nanoseconds: a file for each range of time, named by
    its number, so a task that runs again replaces its own. Spark's writer makes the folder and its mark of success."""
    ship_package(frames.sparkSession)
    out = frames.filter("bus = 'CAN'").select("ts_ns", "frame_no", "can_id", "flags", (F.col("errors") != 0).alias("error"), "len", "data")
    out = out.repartitionByRange("ts_ns", "frame_no").sortWithinPartitions("ts_ns", "frame_no").withColumn("part", F.spark_partition_id())
    frames.sparkSession.createDataFrame([], "none string").write.mode("errorifexists").text(path)
    fs = frames.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target = fs.getFileSystem(frames.sparkSession.sparkContext._jsc.hadoopConfiguration()).makeQualified(fs).toString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sink, n = None, 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if sink is None:
                    where, name = opened(f"{target}/part-{r.part:05d}.pcap")
                    sink = where.open_output_stream(name)
                    sink.write(struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, LONGEST, LINKTYPE))
                fd, remote = r.flags & FD, r.flags & RTR
                word = 0x20000080 if r.error else r.can_id | (0x80000000 if r.flags & EXTENDED else 0) | (0x40000000 if remote else 0)
                load = bytes(8) if r.error else bytes(r.data).ljust(64 if fd else 8, b"\0")
                size = 8 if r.error else int(r.len)
                packet = struct.pack(">IBBBB", word, size, (4 | (1 if r.flags & BRS else 0)) if fd else 0, 0, 0) + load
                sec, fraction = divmod(int(r.ts_ns), 10**9)
                sink.write(struct.pack("<IIII", sec, fraction, len(packet), len(packet)) + packet)
                n += 1
        if sink is not None:
            sink.close()
        yield pd.DataFrame({"n": [n]})

    out.mapInPandas(run, "n long").agg(F.sum("n")).collect()
