"""Logs by format, the frame table, and writers."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import has_flag, lin_checksum
from ..functions.text import fixed_point, hex_text, spaced_hex
from ..schema import BRS, ERROR_BITS, EXTENDED, FD, RTR, TX, head_of, hex_bytes, settled
from ..session import shared_path
from .binary_logs import read_pcap, read_pcapng, write_pcap
from .text_logs import read_asc, read_candump, read_trc

# Names of formats.
FORMATS = {"candump": "candump", "log": "candump", "asc": "asc", "vector_asc": "asc", "trc": "trc", "pcap": "pcap", "pcapng": "pcapng"}
READERS = {"candump": read_candump, "asc": read_asc, "trc": read_trc, "pcap": read_pcap, "pcapng": read_pcapng}


def format_of(name: str) -> str:
    """Format of a name or extension; unknown ones are an error."""
    key = name.strip().lower()
    if key not in FORMATS:
        raise ValueError(f"unknown log format {name!r}")
    return FORMATS[key]


def read_log(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    return READERS[format_of(format or (path.rpartition(".")[2] if "." in path else path))](spark, path, **options)


def fingerprint(frames: DataFrame) -> str | None:
    """What frames are made of and how: path, size and time of change of every file that they come from, the plan, and the
    options with which the files are read. None where they don't come from files. Python functions in the plan are known
    by their names alone."""
    sc = frames.sparkSession.sparkContext
    conf, found = sc._jsc.hadoopConfiguration(), []
    for name in sorted(frames.inputFiles()):
        p = sc._jvm.org.apache.hadoop.fs.Path(name)
        status = p.getFileSystem(conf).getFileStatus(p)
        found.append([name, status.getLen(), status.getModificationTime()])
    if not found:
        return None
    plan = frames._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            relation = leaf.relation()
            found.append([relation.getClass().getName(), relation.schema().json(), relation.options().toString() if hasattr(relation, "options") else ""])
    # numbers of expressions and of the virtual machine differ from run to run
    found.append(re.sub(r'"jvmId":"[^"]*"', "", frames._jdf.queryExecution().optimizedPlan().canonicalized().toJSON()))
    found.append(re.sub(r"#[0-9]+L?", "", plan.toString()))
    return hashlib.sha256(json.dumps(found).encode()).hexdigest()[:32]


class Versions:
    """Versions of a table in a folder. Data lie in folders of their own, and an empty file named after one, with a number
    in front and made last, says that it is whole: the highest number counts. So a reader never sees half a table, nor a
    writer that stopped midway."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        folder = self.to(f"{self.path}/_versions")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def data(self, name: str) -> str:
        return f"{self.path}/_table/data-{name}"

    def add(self, mark: str, write: Callable[[str], None], keep: int) -> str:
        names = self.names()
        name = f"{int(names[-1].split('-')[0]) + 1 if names else 0:010d}-{mark}-{uuid.uuid4().hex[:12]}"
        write(self.data(name))
        self.fs.create(self.to(f"{self.path}/_versions/{name}"), False).close()
        for old in self.names()[:-keep]:
            self.fs.delete(self.to(f"{self.path}/_versions/{old}"), False)
            self.fs.delete(self.to(self.data(old)), True)
        return name


def build_frame_table(frames: DataFrame, path: str, *, partitions: int | None = None, keep: int = 2) -> DataFrame:
    """Frames as Parquet, clustered by interface and id and sorted by time, so that a filter on ids skips row groups.
    `head` holds the first eight bytes as a number, from which `decode_wide` reads signals.

    The newest version of the table is used again if it was made by the same plan, with the same options, from files of
    the same names, sizes and times (`fingerprint`); otherwise, and where the frames don't come from files, a new version
    is built beside it. The newest `keep` versions stay, for those who still read an older one. Open a table without
    building it by `frame_table`; its folder can't be read as Parquet as it is."""
    versions = Versions(frames.sparkSession, path)
    mark = fingerprint(frames)
    names = versions.names()
    if mark is None or not names or names[-1].split("-")[1] != mark:

        def write(target: str) -> None:
            keys = [F.col("iface"), F.col("can_id"), F.col("ts_ns")]
            rows = frames.withColumn("head", head_of(F.col("bytes")))
            dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
            dealt.sortWithinPartitions("iface", "can_id", "ts_ns", "frame_no").write.parquet(target)

        versions.add(mark or "none", write, keep)
    return frame_table(frames.sparkSession, path)


def frame_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a frame table."""
    versions = Versions(spark, path)
    names = versions.names()
    if not names:
        raise FileNotFoundError(f"no frame table in {path}")
    return spark.read.parquet(versions.data(names[-1]))


# SocketCAN error classes and payload bits of the error bits: (bit, classes, payload byte, payload bits).
SOCKETCAN_ERRORS = [
    ("BIT", 0x88, 2, 0x01), ("FORM", 0x88, 2, 0x02), ("STUFF", 0x88, 2, 0x04), ("CRC", 0x88, 3, 0x08), ("ACK", 0xA0, 0, 0), ("BUSOFF", 0x40, 0, 0),
    ("OVERRUN", 0x04, 1, 0x01), ("TIMEOUT", 0x01, 0, 0), ("RESTARTED", 0x100, 0, 0), ("WARNING", 0x04, 1, 0x0C), ("PASSIVE", 0x04, 1, 0x30), ("ACTIVE", 0x04, 1, 0x40),
]


def socketcan_error(errors: Column) -> Column:
    """struct(id, data array<int>): the id with the error flag and classes, and the eight payload bytes."""
    classes, data = F.lit(0), [F.lit(0)] * 8
    for name, bits, byte, value in SOCKETCAN_ERRORS:
        on = errors.bitwiseAND(ERROR_BITS[name]) != 0
        classes = classes.bitwiseOR(F.when(on, bits).otherwise(0))
        if value:
            data[byte] = data[byte].bitwiseOR(F.when(on, value).otherwise(0))
    classes = F.when(classes == 0, 0x80).otherwise(classes)
    return F.struct(classes.bitwiseOR(0x20000000).alias("id"), F.array(*data).alias("data"))


def candump_line() -> Column:
    c = F.col
    error = socketcan_error(c("errors"))
    ident = F.when(has_flag(c("flags"), EXTENDED), F.lpad(F.hex("can_id"), 8, "0")).otherwise(F.lpad(F.hex("can_id"), 3, "0"))
    load = F.hex("data")
    body = (
        F.when(c("errors") != 0, F.concat(F.lpad(F.hex(error["id"]), 8, "0"), F.lit("#"), hex_text(error["data"], "")))
        .when(has_flag(c("flags"), FD), F.concat(ident, F.lit("##"), F.when(has_flag(c("flags"), BRS), "1").otherwise("0"), load))
        .when(has_flag(c("flags"), RTR), F.concat(ident, F.lit("#R"), c("len")))
        .otherwise(F.concat(ident, F.lit("#"), load))
    )
    micros = F.lpad(F.expr("ts_ns % 1000000000 div 1000").cast("string"), 6, "0")
    time = F.concat(F.lit("("), F.expr("ts_ns div 1000000000").cast("string"), F.lit("."), micros, F.lit(")"))
    return F.concat_ws(" ", time, F.translate("channel", " \t", "__"), body)


def write_candump(frames: DataFrame, path: str) -> None:
    """candump -L lines in time order, as part files; LIN frames, which the format hasn't, are left out."""
    frames.filter("bus = 'CAN'").orderBy("ts_ns", "frame_no").select(candump_line().alias("value")).write.text(path)


def _channel_numbers(frames: DataFrame) -> DataFrame:
    """Numbers from 1 by first appearance, or those of the column channel_no where a recording has given them."""
    from pyspark.sql import Window

    if "channel_no" in frames.columns:
        return frames.groupBy("channel").agg(F.min("channel_no").alias("ch"))
    first = frames.groupBy("channel").agg(F.min(F.struct("ts_ns", "frame_no")).alias("o"))
    return first.select("channel", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("o")).alias("ch"))  # a row per channel


def asc_lines(frames: DataFrame, zone: str = "UTC") -> DataFrame:
    """The lines of an ASC file in their order, as `value`: header, events from the earliest frame, footer. Frames are put
    in order as they are, and the lines made afterwards."""
    first = frames.agg(F.min("ts_ns").alias("t0"))
    c = F.col
    f = frames.join(_channel_numbers(frames), "channel").crossJoin(F.broadcast(first))
    f = f.select(F.lit(1).alias("part"), "ts_ns", "frame_no", (c("ts_ns") - c("t0")).alias("at"), "ch", "bus", "can_id", "flags", "errors", "dlc", "len", "data")
    stamp = F.timestamp_micros(F.expr("t0 div 1000"))
    date = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(stamp, F.current_timezone()), zone), "EEE MMM dd hh:mm:ss.SSS a yyyy")
    date = F.regexp_replace(F.regexp_replace(date, " AM ", " am "), " PM ", " pm ")
    head = F.array(
        F.concat(F.lit("date "), date), F.lit("base hex  timestamps absolute"), F.lit("internal events logged"), F.lit("// version 8.5.0"), F.concat(F.lit("Begin Triggerblock "), date),
        F.lit("   0.000000 Start of measurement"),
    )
    zero = F.lit(0).cast("long").alias("ts_ns")
    header = first.filter("t0 is not null").select(F.posexplode(head).alias("i", "told")).select(F.lit(0).alias("part"), zero, c("i").cast("long").alias("frame_no"), "told")
    footer = first.select(F.lit(2).alias("part"), zero, F.lit(0).cast("long").alias("frame_no"), F.lit("End TriggerBlock").alias("told"))
    rows = f.unionByName(header.unionByName(footer), allowMissingColumns=True).orderBy("part", "ts_ns", "frame_no")
    # what several forms of a line have in common is made once
    way, x = F.when(has_flag(c("flags"), TX), "Tx").otherwise("Rx"), F.when(has_flag(c("flags"), EXTENDED), "x").otherwise("")
    rows = settled(
        rows, "told", "bus", "can_id", "flags", "errors", "dlc", "len", "data", t=fixed_point(c("at"), 6, 11), ch=c("ch").cast("string"), way=way, x=x, ident=F.concat(F.lower(F.hex("can_id")), x),
        load=F.lower(spaced_hex(c("data"))),
    )
    t, ch, way, x, ident, load, size = (c(n) for n in ("t", "ch", "way", "x", "ident", "load", "len"))
    lin_id = F.lower(F.lpad(F.hex(c("can_id").bitwiseAND(63)), 2, "0"))
    lin = F.concat(t, F.lit(" "), ch, F.lit("  LIN "), lin_id, F.lit(" "), way)
    total = F.lower(F.lpad(F.hex(lin_checksum(c("can_id").bitwiseAND(63), hex_bytes(F.hex("data")))), 2, "0"))
    lin = F.when(c("errors") != 0, F.concat(lin, F.lit("   LIN_ChecksumError"))).otherwise(
        F.concat(lin, F.lit("  d "), size, F.lit(" "), load, F.lit(" checksum = "), total, F.lit(" header_time = 0 full_time = 0"))
    )
    fd = F.concat(
        t, F.lit(" CANFD "), F.lpad(ch, 3, " "), F.lit(" "), way, F.lit(" "), F.lpad(ident, 15, " "), F.when(has_flag(c("flags"), BRS), " 1 0 ").otherwise(" 0 0 "), F.lower(F.hex("dlc")), F.lit(" "),
        size, F.lit(" "), load,
    )
    remote = has_flag(c("flags"), RTR)
    can = F.concat(
        t, F.lit(" "), ch, F.lit("  "), F.rpad(ident, 15, " "), F.lit(" "), way, F.when(remote, "   r ").otherwise("   d "), size, F.lit(" "), F.when(remote, "").otherwise(load),
        F.lit("  Length = 0 BitCount = 0 ID = "), c("can_id").cast("string"), x,
    )
    line = F.when(c("bus") == "LIN", lin).when(c("errors") != 0, F.concat(t, F.lit(" "), ch, F.lit("  ErrorFrame"))).when(has_flag(c("flags"), FD), fd).otherwise(can)
    return rows.select(F.coalesce("told", line).alias("value"))


def write_asc(frames: DataFrame, path: str, zone: str = "UTC") -> None:
    asc_lines(frames, zone).write.text(path)


def trc_lines(frames: DataFrame) -> DataFrame:
    """The lines of a TRC 2.1 file in their order, as `value`; CAN frames only, numbered in time order. Numbers come from
    the counts of time ranges and a place in each, so that no task numbers the whole log; lines are made after the sort."""
    from pyspark.sql import Window

    c = F.col
    f = frames.filter("bus = 'CAN'")
    first = f.agg(F.min("ts_ns").alias("t0"))
    f = f.join(_channel_numbers(f), "channel").crossJoin(F.broadcast(first)).withColumn("range", F.floor((c("ts_ns") - c("t0")) / 1_000_000_000))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = f.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))  # a row per second
    own = F.row_number().over(Window.partitionBy("range").orderBy("ts_ns", "frame_no"))
    f = f.select("range", "ts_ns", "frame_no", "t0", "ch", "can_id", "flags", "errors", "dlc", "len", "data").withColumn("own", own).join(starts, "range")
    f = f.select(F.lit(1).alias("part"), (c("before") + c("own")).alias("number"), F.expr("(ts_ns - t0) div 1000").alias("us"), "ch", "can_id", "flags", "errors", "dlc", "len", "data")
    head = F.array(F.lit(";$FILEVERSION=2.1"), F.concat(F.lit(";$STARTTIME="), F.format_string("%.14f", F.lit(25569.0) + c("t0") / 86400e9)), F.lit(";$COLUMNS=N,O,T,B,I,d,R,L,D"), F.lit(";"))
    header = first.filter("t0 is not null").select(F.posexplode(head).alias("i", "told")).select(F.lit(0).alias("part"), c("i").cast("long").alias("number"), "told")
    rows = f.unionByName(header, allowMissingColumns=True).orderBy("part", "number")
    right = lambda x, n: F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, " "))
    ms = right(F.expr("us div 1000").cast("string"), 9)
    lead = F.concat(right(c("number").cast("string"), 7), F.lit(" "), ms, F.lit("."), F.lpad((c("us") % 1000).cast("string"), 3, "0"), F.lit(" "))
    way = F.when(has_flag(c("flags"), TX), "Tx").otherwise("Rx")
    rows = settled(rows, "told", "can_id", "flags", "errors", "dlc", "len", lead=lead, way=way, bus=right(c("ch").cast("string"), 2), hexed=spaced_hex(c("data")))
    lead, way, bus = c("lead"), c("way"), c("bus")
    kind = F.when(has_flag(c("flags"), FD), F.when(has_flag(c("flags"), BRS), "FB").otherwise("FD")).when(has_flag(c("flags"), RTR), "RR").otherwise("DT")
    ident = F.when(has_flag(c("flags"), EXTENDED), F.lpad(F.hex("can_id"), 8, "0")).otherwise(F.concat(F.lit("    "), F.lpad(F.hex("can_id"), 4, "0")))
    load = F.when(~has_flag(c("flags"), RTR) & (c("len") > 0), F.concat(F.when(c("dlc") < 10, "    ").otherwise("   "), c("hexed"))).otherwise("")
    frame = F.concat(lead, kind, F.lit(" "), bus, F.lit(" "), ident, F.lit(" "), way, F.lit(" -  "), c("dlc"), load)
    sent = F.when(has_flag(c("flags"), TX), "00").otherwise("01")
    error = F.concat(lead, F.lit("ER "), bus, F.lit("        - "), way, F.lit(" -  5    08 "), sent, F.lit(" 00 00 00"))
    return rows.select(F.coalesce("told", F.when(c("errors") != 0, error).otherwise(frame)).alias("value"))


def write_trc(frames: DataFrame, path: str) -> None:
    trc_lines(frames).write.option("lineSep", "\r\n").text(path)


WRITERS = {"candump": write_candump, "asc": write_asc, "trc": write_trc, "pcap": write_pcap, "parquet": lambda frames, path: frames.write.parquet(path)}


def convert_log(spark: SparkSession, source: str, target: str, target_format: str, source_format: str | None = None) -> None:
    """Any readable format to candump, ASC, TRC, pcap or Parquet. The log is parsed once: writers that go over the frames several
    times (order, channel numbers, first time) read them from a table in the shared folder."""
    if target_format != "parquet" and format_of(target_format) not in WRITERS:
        raise ValueError(f"{target_format!r} can't be written")
    frames = read_log(spark, source, source_format)
    if target_format == "parquet":
        frames.write.parquet(target)
        return
    path = shared_path(spark, "frames")
    frames.write.parquet(path)
    WRITERS[format_of(target_format)](spark.read.parquet(path), target)
