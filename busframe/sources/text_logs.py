"""Text logs (candump, ASC, TRC), code texts and record layouts, read in splits.

Lines get a frame number that grows along their file: the byte where their split begins plus the row's place in its
task. A split that another one of its file follows fills its task alone and has fewer lines than bytes, so numbers
neither repeat nor go back. The part files of a folder that Spark wrote are one log, in the order of their numbers. What a header says of a whole file (date, columns) is a separate small aggregate per file,
joined back; so are the numbers of channels, unless they are given (`channels`), and then a log is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import len_of_dlc
from ..functions.text import parse_seconds_ns
from ..schema import BRS, EXTENDED, FD, GENERIC_ERROR, RTR, TX, hex_bytes, settled, to_binary


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """log (file, or the folder of Spark's part files), frame_no, value of every line."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of the row in its task
    file = F.col("_metadata.file_path")
    name = F.call_function("locate", F.lit("/part-"), file)
    # a part's number stands behind its name; paths with a folder of such a name are looked at by their last part
    deep = F.call_function("locate", F.lit("/"), file, name + 1) > 0
    at = F.when((name > 0) & deep, F.length(file) - F.length(F.substring_index(file, "/", -1))).otherwise(name)
    is_part = (name > 0) & (~deep | F.startswith(F.substring_index(file, "/", -1), F.lit("part-")))
    log = F.when(is_part, F.call_function("substring", file, F.lit(1), at - 1)).otherwise(file)
    part = F.when(is_part, F.substring_index(F.call_function("substring", file, at + 6, F.lit(12)), "-", 1).try_cast("long"))
    begin = F.shiftleft(F.coalesce(part, F.lit(0).cast("long")), 42) + F.col("_metadata.file_block_start")
    value = F.when(F.endswith("value", F.lit("\r")), F.rtrim(F.col("value"), F.lit("\r"))).otherwise(F.col("value"))
    return spark.read.text(path).select(log.alias("log"), (begin + place).alias("frame_no"), value.alias("value"))


def with_iface(frames: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """iface: the channel's place in `channels` (null for others), or by first appearance over the whole input."""
    if channels is not None:
        place = F.array_position(F.array(*[F.lit(c) for c in channels]).cast("array<string>"), F.col("channel"))
        return frames.withColumn("iface", (F.nullif(place, F.lit(0).cast("long")) - 1).cast("int"))
    first = frames.groupBy("channel").agg(F.min(F.struct("log", "frame_no")).alias("o"))
    from pyspark.sql import Window

    numbers = first.select("channel", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("o")) - 1).cast("int").alias("iface"))  # a row per channel
    return frames.drop("iface").join(F.broadcast(numbers), "channel")


def finish(rows: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """The columns of frames, from rows with log, frame_no, ts_ns, channel, bus, can_id, flags, errors, bytes, for remote
    frames their length and, where they are known before, the data."""
    from ..functions.bits import dlc_of_len

    out = with_iface(settled(rows, *[c for c in rows.columns if c != "bytes"], bytes=F.col("bytes").cast("array<int>")), channels)
    remote = F.col("flags").bitwiseAND(RTR) != 0
    out = out.withColumn("len", F.when(remote, F.least(F.greatest(F.col("remote_len"), F.lit(0)), F.lit(8))).otherwise(F.size("bytes")).cast("int"))
    return out.select(
        "log", "frame_no", "ts_ns", F.timestamp_micros(F.expr("ts_ns div 1000")).alias("ts"), "iface", "channel", "bus", "can_id", F.col("flags").cast("int").alias("flags"),
        F.col("errors").cast("int").alias("errors"), dlc_of_len(F.col("len")).alias("dlc"), "len", (F.col("data") if "data" in rows.columns else to_binary(F.col("bytes"))).alias("data"), "bytes",
    )


def _number(text: Column, base: int = 10) -> Column:
    """Long of digits, else null."""
    if base == 10:
        return F.when(F.rlike(text, F.lit("^[0-9]{1,9}$")), text.try_cast("long"))
    return F.when(F.rlike(text, F.lit("^[0-9A-Fa-f]{1,8}$")), F.conv(text, 16, 10).cast("long"))


def _hex_list(parts: Column) -> Column:
    """array<int> of hex texts; null if one isn't a byte."""
    ok = F.forall(parts, lambda p: F.rlike(p, F.lit("^[0-9A-Fa-f]{1,2}$")))
    return F.when(ok, F.transform(parts, lambda p: F.conv(p, 16, 10).cast("int")))


def read_candump(spark: SparkSession, path: str | list[str], channels: Sequence[str] | None = None) -> DataFrame:
    """(sec.frac) iface ID#DATA, ID##fDATA, ID#R[len]; lines of another form are skipped."""
    return parse_candump(read_lines(spark, path), channels)


def parse_candump(lines: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Frames of lines (log, frame_no, value). Fields are cut at blanks by plain string functions; patterns run only on
    lines with other blanks than single spaces."""
    v = F.col("value")
    odd = F.contains(v, F.lit("\t")) | F.contains(v, F.lit("  ")) | ~F.contains(v, F.lit(") "))
    even = F.regexp_replace(F.regexp_replace(v, r"^(\([^)]*\))", "$1 "), r"[ \t]+", " ")
    p = settled(lines.filter(F.startswith(v, F.lit("("))), "log", "frame_no", w=F.split(F.when(odd, even).otherwise(v), " "))
    time, frame = F.get("w", F.lit(0)), F.get("w", F.lit(2))
    ident = F.substring_index(frame, "#", 1)
    p = settled(
        p.filter((F.size("w") >= 3) & F.endswith(time, F.lit(")")) & F.contains(frame, F.lit("#"))), "log", "frame_no",
        time=F.call_function("substring", time, F.lit(2), F.length(time) - 2), channel=F.get("w", F.lit(1)), id=ident, load=F.call_function("substring", frame, F.length(ident) + 2),
    )
    # unhex gives null for what isn't hex
    p = p.filter(F.length("id").between(1, 8) & F.unhex("id").isNotNull())
    raw, lead = F.conv("id", 16, 10).cast("long"), F.substring("load", 1, 1)
    p = settled(p, "log", "frame_no", "channel", "id", "load", ts_ns=parse_seconds_ns(F.col("time")), raw=raw, fd=lead == "#", remote=lead.isin("R", "r"))
    error, can_id, load = F.col("raw").bitwiseAND(0x20000000) != 0, F.col("raw").bitwiseAND(0x1FFFFFFF), F.col("load")
    fd, remote = ~error & F.col("fd"), ~error & F.col("remote")
    flags = F.when((F.length("id") == 8) | (can_id > 0x7FF), EXTENDED).otherwise(0)
    brs = F.conv(F.substring(load, 2, 1), 16, 10).cast("int").bitwiseAND(1) != 0
    flags = flags + F.when(fd, FD + F.when(brs, BRS).otherwise(0)).when(remote, RTR).otherwise(0)
    body = F.when(fd, F.substring(load, 3, 128)).when(error | remote, "").otherwise(load)
    room = F.when(fd, 128).otherwise(16)
    p = settled(
        p, "log", "frame_no", "ts_ns", "channel", "load", can_id=can_id, flags=F.when(error, 0).otherwise(flags), errors=F.when(error, GENERIC_ERROR).otherwise(0), fd=fd, remote=remote,
        error=error, body=body, room=room,
    )
    error, fd, remote, body = (F.col(c) for c in ("error", "fd", "remote", "body"))
    body_ok = F.unhex(body).isNotNull() & (F.length(body) % 2 == 0) & (F.length(body) <= F.col("room")) & (~fd | F.unhex(F.substring(load, 2, 1)).isNotNull() & (F.length(load) > 1))
    ok = F.col("ts_ns").isNotNull() & (error | F.when(remote, F.rlike(load, F.lit("^[Rr][0-9]*$"))).otherwise(body_ok))
    return finish(p.filter(ok).select(
        "log", "frame_no", "ts_ns", "channel", F.lit("CAN").alias("bus"), "can_id", "flags", "errors", hex_bytes(body).alias("bytes"), F.unhex(body).alias("data"),
        F.when(remote, F.coalesce(F.regexp_extract(load, "([0-9]+)", 1).try_cast("long"), F.lit(0))).alias("remote_len"),
    ), channels)


#: Names of months.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def asc_date_ns(line: Column, tz: str) -> Column:
    """ns of `date Mon Sep 25 10:00:00.000 am 2026` or of its 24 h form, in a time zone."""
    pattern = r"(?i)^date +\S+ +(\S{3})\S* +([0-9]+) +([0-9]+):([0-9]+):([0-9.]+)(?: +(am|pm))?.* ([0-9]{4})\s*$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(part(1))).cast("int")
    hour = part(3).try_cast("int")
    hour = F.when(part(6) == "", hour).otherwise(hour % 12 + F.when(F.lower(part(6)) == "pm", 12).otherwise(0))
    text = F.format_string("%s-%02d-%02d %02d:%02d:00", part(7), month, part(2).try_cast("int"), hour, part(4).try_cast("int"))
    local = F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), local)
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), utc)
    return F.when(F.rlike(line, F.lit(pattern)), micros * 1000 + parse_seconds_ns(part(5)))


def read_asc(spark: SparkSession, path: str | list[str], tz: str = "UTC", channels: Sequence[str] | None = None) -> DataFrame:
    """Classic, CANFD (two layouts), LIN and ErrorFrame events; times count from the header's date in tz."""
    lines = read_lines(spark, path)
    date = lines.filter(F.rlike("value", F.lit("(?i)^date "))).groupBy("log").agg(F.min_by(asc_date_ns(F.col("value"), tz), "frame_no").alias("base"))
    p = lines.withColumn("p", F.split(F.trim(F.col("value")), r"\s+")).filter(F.rlike("value", F.lit(r"^\s*[0-9]+(\.[0-9]*)?\s")) & (F.size("p") >= 3))
    at = lambda i: F.get("p", F.lit(i) if isinstance(i, int) else i)
    low = lambda i: F.lower(at(i))
    none = F.array().cast("array<int>")
    error, fd, lin = low(2) == "errorframe", low(1) == "canfd", (low(2) == "lin") & (F.size("p") >= 6)
    kind = F.when(error, "error").when(fd, "fd").when(lin, "lin").otherwise("can")
    p = p.withColumn("kind", kind)

    def hex_from(start: Column, n: Column) -> Column:
        part = F.slice("p", start + 1, F.greatest(n, F.lit(0)))
        return F.when(F.size(part) == n, _hex_list(part))

    ext = lambda i: F.rlike(at(i), F.lit("[xX]$"))
    ident = lambda i: _number(F.regexp_replace(at(i), "[xX]$", ""), 16)
    # classic
    n = _number(at(5))
    remote = low(4) == "r"
    can = F.struct(
        at(1).alias("ch"), ident(2).alias("id"), (F.when(ext(2), EXTENDED).otherwise(0) + F.when(low(3) == "tx", TX).otherwise(0) + F.when(remote, RTR).otherwise(0)).alias("fl"),
        F.when(remote, none).otherwise(hex_from(F.lit(6), n.cast("int"))).alias("by"), n.alias("n"), F.lit(0).alias("er"),
    )
    can = F.when((n <= 8) & (F.size("p") >= 6), can)
    # CAN FD: a frame name may stand before the flags
    i = F.when(_number(at(5)).isNull(), 6).otherwise(5)
    code, n1, n2 = _number(at(i + 2), 16), _number(at(i + 3)), _number(at(i + 4))
    vector = (code <= 15) & (len_of_dlc(code.cast("int")) == n1)
    legacy = (at(i + 1) == "0") & (at(i + 2) == "0") & (n1 == n2)
    data_at = F.when(vector, i + 4).when(legacy, i + 5)
    fl = F.when(ext(4), EXTENDED).otherwise(0) + FD + F.when(_number(at(i)).bitwiseAND(1) != 0, BRS).otherwise(0) + F.when(low(3) == "rx", 0).otherwise(TX)
    flex = F.when(data_at.isNotNull() & (n1 <= 64), F.struct(at(2).alias("ch"), ident(4).alias("id"), fl.alias("fl"), hex_from(data_at, n1.cast("int")).alias("by"), n1.alias("n"), F.lit(0).alias("er")))
    # LIN: bytes up to the length, as far as they are numbers
    bad = F.startswith(at(5), F.lit("LIN_"))
    m = _number(at(6))
    some = F.slice("p", 8, F.coalesce(m.cast("int"), F.lit(0)))
    numbers = F.transform(some, lambda x: F.coalesce(F.when(F.rlike(x, F.lit("^[0-9A-Fa-f]{1,2}$")), F.conv(x, 16, 10).cast("int")), F.lit(0)))
    numbers = F.concat(numbers, F.array_repeat(F.lit(0), (F.coalesce(m.cast("int"), F.lit(0)) - F.size(numbers))))
    slave = F.struct(
        at(1).alias("ch"), _number(at(3), 16).bitwiseAND(63).alias("id"), F.when(low(4) == "tx", TX).otherwise(0).alias("fl"), F.when(bad, none).otherwise(numbers).alias("by"),
        m.alias("n"), F.when(bad, 0x0200).otherwise(0).alias("er"),
    )
    slave = F.when(bad | ((low(5) == "d") & (m <= 8)), slave)
    broken = F.struct(at(1).alias("ch"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("fl"), none.alias("by"), F.lit(0).cast("long").alias("n"), F.lit(GENERIC_ERROR).alias("er"))
    p = p.withColumn("f", F.when(kind == "error", broken).when(kind == "fd", flex).when(kind == "lin", slave).otherwise(can))
    p = p.filter("f.id is not null and f.by is not null").join(date, "log", "left")
    ts = parse_seconds_ns(at(0)) + F.coalesce("base", F.lit(0))
    return finish(p.select(
        "log", "frame_no", ts.alias("ts_ns"), F.concat(F.lit("CH "), F.col("f.ch")).alias("channel"), F.when(F.col("kind") == "lin", "LIN").otherwise("CAN").alias("bus"),
        F.col("f.id").alias("can_id"), F.col("f.fl").alias("flags"), F.col("f.er").alias("errors"), F.col("f.by").alias("bytes"), F.col("f.n").alias("remote_len"),
    ), channels)


#: Columns of the file versions.
TRC_COLUMNS = {"1.1": "NOdILD", "1.3": "NOBdIRLD", "2.0": "NOTIdlD", "2.1": "NOTBIdRLD"}


def read_trc(spark: SparkSession, path: str | list[str], channels: Sequence[str] | None = None) -> DataFrame:
    """PEAK trace files of versions 1.1 to 2.1; ;$COLUMNS replaces a version's columns."""
    lines = read_lines(spark, path)
    head = lambda key: F.trim(F.regexp_extract("value", rf"^;\${key}=(.*)$", 1))
    is_head = lambda key: F.startswith(F.col("value"), F.lit(f";${key}="))
    latest = lambda key, c: F.max_by(F.when(is_head(key), c), F.when(is_head(key), F.col("frame_no")))
    versions = F.create_map(*[F.lit(x) for pair in TRC_COLUMNS.items() for x in pair])
    days = head("STARTTIME").try_cast("double")
    layout = lines.filter(F.startswith("value", F.lit(";$"))).groupBy("log").agg(
        F.coalesce(latest("COLUMNS", F.regexp_replace(head("COLUMNS"), r"([A-Za-z])[^,]*,?", "$1")), latest("FILEVERSION", F.try_element_at(versions, head("FILEVERSION")))).alias("columns"),
        latest("STARTTIME", F.round((days - 25569.0) * 86400e6).cast("long") * 1000).alias("start"),
    )
    # a row for each file; each step is computed once, and not in every place that uses it
    p = lines.filter(~F.startswith("value", F.lit(";")) & (F.trim("value") != "")).join(F.broadcast(layout), "log")
    parts = F.split(F.regexp_replace(F.trim(F.col("value")), r"^([0-9]+)\)", "$1"), r"\s+")
    p = settled(p, "log", "frame_no", "columns", "start", p=parts, d=F.instr("columns", "D") - 1)
    col = lambda c: F.get("p", F.when(F.instr("columns", c) > 0, F.instr("columns", c) - 1))
    p = settled(
        p, "log", "frame_no", "start", "p", "d", at=col("O"), kind=F.coalesce(col("T"), F.lit("")), way=F.coalesce(col("d"), F.lit("Rx")), ident=col("I"), b=F.coalesce(col("B"), F.lit("1")),
        code=_number(col("L")), size=_number(col("l")), number=_number(col("I"), 16), rtr=F.get("p", F.col("d")) == "RTR",
    )
    kind, way, number, code = (F.col(c) for c in ("kind", "way", "number", "code"))
    error, fd, remote = (way == "Error") | (kind == "ER"), kind.isin("FD", "FB", "FE", "BI"), (kind == "RR") | F.coalesce("rtr", F.lit(False))
    length = F.coalesce("size", F.when(code <= 15, F.when(fd, len_of_dlc(code.cast("int"))).otherwise(F.least(code, F.lit(8))))).cast("int")
    whole = F.substring_index("at", ".", 1)
    frac = F.rpad(F.substring(F.call_function("substring", F.col("at"), F.length(whole) + 2), 1, 6), 6, "0")
    time = F.when(F.rlike("at", F.lit(r"^[0-9]+(?:\.[0-9]*)?$")), whole.try_cast("long") * 1_000_000 + frac.try_cast("long"))
    p = settled(p, "log", "frame_no", "start", "p", "d", "kind", "way", "ident", "b", "number", error=error, fd=fd, remote=remote, length=length, time=time)
    error, fd, remote, length = (F.col(c) for c in ("error", "fd", "remote", "length"))
    ok = way.isin("Rx", "Tx", "Error") & (error | (kind.isin("", "DT", "RR") | fd) & number.isNotNull() & (number <= 0x1FFFFFFF) & length.isNotNull() & (length <= F.when(fd, 64).otherwise(8)))
    flags = F.when(way == "Rx", 0).otherwise(TX) + F.when(fd, FD).otherwise(0) + F.when(kind.isin("FB", "FE"), BRS).otherwise(0) + F.when(remote, RTR).otherwise(0)
    flags = flags + F.when((F.length("ident") > 4) | (number > 0x7FF), EXTENDED).otherwise(0)
    words = F.slice("p", F.col("d") + 1, F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)))
    none = F.array().cast("array<string>")
    p = settled(
        p.filter(ok & F.col("time").isNotNull()), "log", "frame_no", "length", ts_ns=F.coalesce("start", F.lit(0)) + F.col("time"), channel=F.concat(F.lit("CH "), F.col("b")),
        can_id=F.when(error, 0).otherwise(number).cast("long"), flags=F.when(error, 0).otherwise(flags), errors=F.when(error, GENERIC_ERROR).otherwise(0),
        n=F.when(remote | error, 0).otherwise(length), words=F.when(remote | error, none).otherwise(words),
    )
    # bytes of two digits each, as they mostly are, are read as one number; others one by one
    p = settled(p.filter(F.size("words") == F.col("n")), *[c for c in p.columns if c != "words"], "words", text=F.array_join("words", " "))
    plain = F.rlike("text", F.lit("^(?:[0-9A-Fa-f]{2}(?: (?!$)|$))*$"))
    p = settled(p, *[c for c in p.columns if c not in ("n", "text")], hexed=F.when(plain, F.translate("text", " ", "")))
    data = F.when(F.col("hexed").isNotNull(), hex_bytes(F.col("hexed"))).otherwise(_hex_list(F.col("words")))
    p = settled(p, *[c for c in p.columns if c not in ("words", "hexed", "length")], bytes=data, remote_len=F.col("length")).filter("bytes is not null")
    return finish(p.withColumn("bus", F.lit("CAN")), channels)


def read_code_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """code (number), text of `<hex> <text>` lines; # begins a comment; of a repeated code the last counts."""
    pattern = r"^\s*(?:0[xX])?([0-9A-Fa-f]{1,8})(?:[ \t,;]+(.*?))?\s*$"
    lines = read_lines(spark, path).filter(~F.rlike("value", F.lit(r"^\s*#")) & F.rlike("value", F.lit(pattern)))
    code = F.conv(F.regexp_extract("value", pattern, 1), 16, 10).cast("long")
    return lines.groupBy(code.alias("code")).agg(F.max_by(F.regexp_extract("value", pattern, 2), F.struct("log", "frame_no")).alias("text"))


def read_dtc_fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """kind (ext, snap), record, seq, name, size, is_time, scale, offset of record layouts; of a repeated record the last
    counts; a snapshot identifier has one field."""
    line = r"^\s*(ext|snap)\s+([0-9A-Fa-f]{1,4})\s+(.*)$"
    part = lambda i: F.regexp_extract("value", line, i)
    p = read_lines(spark, path).filter(F.rlike("value", F.lit(line))).select(
        part(1).alias("kind"), F.conv(part(2), 16, 10).cast("int").alias("record"), F.struct("log", "frame_no").alias("o"),
        F.filter(F.split(F.trim(part(3)), r"\s+"), lambda w: F.rlike(w, F.lit(r"^[^:]*:(u8|u16|u24|u32|time)([*+-].*)?$"))).alias("w"),
    )
    p = p.filter((F.size("w") > 0) & ((F.col("kind") == "snap") | (F.col("record") <= 255)))
    p = p.groupBy("kind", "record").agg(F.max_by("w", "o").alias("w")).withColumn("w", F.when(F.col("kind") == "snap", F.slice("w", 1, 1)).otherwise(F.col("w")))
    w = p.select("kind", "record", F.posexplode("w").alias("seq", "w"))
    kind = F.regexp_extract("w", r":(u8|u16|u24|u32|time)", 1)
    size = F.when(kind == "u8", 1).when(kind == "u16", 2).when(kind == "u24", 3).otherwise(4)
    scale = F.coalesce(F.regexp_extract("w", r":[^*]*\*([0-9.]+)", 1).try_cast("double"), F.lit(1.0))
    offset = F.coalesce(F.regexp_extract("w", r":.*?([+-][0-9.]+)", 1).try_cast("double"), F.lit(0.0))
    return w.select("kind", "record", "seq", F.regexp_extract("w", "^([^:]*):", 1).alias("name"), size.alias("size"), (kind == "time").alias("is_time"), scale.alias("scale"), offset.alias("offset"))
