"""Signal dictionaries from DBC text, many files as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import motorola_start
from ..operators import scan
from .text_logs import read_lines

BO = r"^\s*BO_\s+([0-9]+)\s+(\w+)\s*:\s*([0-9]+)\s+(\S+)"
NUM = r"[-+0-9.eE]+"
SG = rf"^\s*SG_\s+(\w+)\s*(M|m[0-9]+)?\s*:\s*([0-9]+)\|([0-9]+)@([01])([+-])\s*\(\s*({NUM})\s*,\s*({NUM})\s*\)\s*\[\s*({NUM})\s*\|\s*({NUM})\s*\]\s*\"([^\"]*)\"\s*(.*)$"
LINES = 100_000
KINDS = ("BO_ ", "SG_ ", "VAL_ ", "CM_ BO_", "CM_ SG_", "SIG_VALTYPE_ ")


def read_dbc(spark: SparkSession, path: str | list[str], network: str = "A") -> tuple[DataFrame, DataFrame, DataFrame]:
    """signals, value_names, errors (log, line_no, line). Lines of the known kinds that can't be read are errors, other
    sections are skipped. A later file (by name) has the higher db_seq. VAL_, CM_ and SIG_VALTYPE_ may name a bare 29-bit
    id. A comment spans lines up to its closing quote."""
    lines = read_lines(spark, path).withColumnRenamed("frame_no", "line_no")
    part = lambda pattern, i, c="value": F.regexp_extract(c, pattern, i)
    value = F.col("value")
    lines = lines.withColumn("bo", F.when(F.rlike(value, F.lit(BO)), F.struct(part(BO, 1).cast("long").alias("raw_id"), part(BO, 2).alias("message"), part(BO, 3).cast("int").alias("dlc"), part(BO, 4).alias("sender"))))
    # a file may be longer than what a task can hold, so lines are scanned in ranges
    lines, key = scan.cut(lines.withColumnRenamed("bo", "_bo"), ["log"], [], "line_no", LINES)
    lines = scan.newest(lines, key, ["line_no"], {"bo": F.col("_bo")}, inclusive=True)
    lines = scan.running(lines, key, ["line_no"], {"open": F.rlike(value, F.lit(r"^\s*CM_\s")).cast("int")}).drop("_bo", scan.SEG)
    sg = lines.filter(F.rlike(value, F.lit(SG)) & F.col("bo").isNotNull())
    big, mux = part(SG, 5) == "0", part(SG, 2)
    start = part(SG, 3).cast("int")
    files = read_lines(spark, path).select("log").distinct().select("log", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("log")) - 1).cast("int").alias("db_seq"))  # a row per file
    s = sg.select(
        "log", "line_no", "bo.*", part(SG, 1).alias("signal"), F.when(big, motorola_start(start)).otherwise(start).alias("start_bit"), part(SG, 4).cast("int").alias("length"),
        (part(SG, 6) == "+").alias("is_unsigned"), big.alias("big_endian"), part(SG, 7).try_cast("double").alias("factor"), part(SG, 8).try_cast("double").alias("offset"),
        part(SG, 9).try_cast("double").alias("min"), part(SG, 10).try_cast("double").alias("max"), part(SG, 11).alias("unit"), (mux == "M").alias("is_muxer"),
        F.startswith(mux, F.lit("m")).alias("is_muxed"), F.substring(mux, 2, 20).try_cast("long").alias("mux_value"),
    )
    muxers = s.filter("is_muxer").groupBy("log", "raw_id").agg(F.first(F.struct("start_bit", "length", "big_endian")).alias("muxer"))
    # an id may be given bare, so each stands for two
    both_ids = lambda c: F.explode(F.array(c, c + 0x80000000))

    vt = r"^\s*SIG_VALTYPE_\s+([0-9]+)\s+(\w+)\s*:?\s*([0-3])"
    types = lines.filter(F.rlike(value, F.lit(vt))).select(F.col("log").alias("tl"), both_ids(part(vt, 1).cast("long")).alias("ti"), part(vt, 2).alias("tn"), F.when(part(vt, 3) == "1", "float32").when(part(vt, 3) == "2", "float64").otherwise("integer").alias("value_type"))
    # comments: the lines from CM_ to the closing quote, joined
    notes = lines.filter("open > 0").groupBy("log", "open").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("value"))
    cb, cs = r'(?s)^\s*CM_\s+BO_\s+([0-9]+)\s+"(.*?)"\s*;', r'(?s)^\s*CM_\s+SG_\s+([0-9]+)\s+(\w+)\s+"(.*?)"\s*;'
    mc = notes.filter(F.rlike("value", F.lit(cb))).select(F.col("log").alias("ml"), both_ids(part(cb, 1).cast("long")).alias("mi"), part(cb, 2).alias("message_comment"))
    sc = notes.filter(F.rlike("value", F.lit(cs))).select(F.col("log").alias("sl"), both_ids(part(cs, 1).cast("long")).alias("si"), part(cs, 2).alias("sn"), part(cs, 3).alias("signal_comment"))
    raw = F.col("raw_id")
    s = s.join(muxers, ["log", "raw_id"], "left").join(F.broadcast(files), "log")
    s = s.join(types, (F.col("log") == F.col("tl")) & (F.col("signal") == F.col("tn")) & (F.col("ti") == raw), "left")
    s = s.join(mc, (F.col("log") == F.col("ml")) & (F.col("mi") == raw), "left").join(sc, (F.col("log") == F.col("sl")) & (F.col("signal") == F.col("sn")) & (F.col("si") == raw), "left")
    order = F.row_number().over(Window.partitionBy("log", "raw_id").orderBy("line_no")) - 1
    signals = s.select(
        F.lit(network).alias("network"), "raw_id", "message", F.when(F.col("sender") == "Vector__XXX", "").otherwise(F.col("sender")).alias("sender"), "dlc", "signal", "start_bit", "length",
        "is_unsigned", "big_endian", F.coalesce("value_type", F.lit("integer")).alias("value_type"), "factor", "offset", "min", "max", "unit", "is_muxer", "is_muxed", "mux_value",
        F.when(F.col("is_muxed"), F.col("muxer")).alias("muxer"), "db_seq", order.cast("int").alias("signal_seq"), "message_comment", "signal_comment",
    )
    vl = r"^\s*VAL_\s+([0-9]+)\s+(\w+)\s+(.*);"
    v = lines.filter(F.rlike(value, F.lit(vl))).select(F.col("log").alias("vlog"), both_ids(part(vl, 1).cast("long")).alias("vid"), part(vl, 2).alias("vsig"), part(vl, 3).alias("list"))
    pair = F.explode(F.arrays_zip(F.regexp_extract_all("list", F.lit(r'(-?[0-9]+)\s+"([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all("list", F.lit(r'(-?[0-9]+)\s+"([^"]*)"'), F.lit(2)).alias("n")))
    v = v.join(s.select("log", "raw_id", "signal").distinct(), (F.col("log") == F.col("vlog")) & (F.col("signal") == F.col("vsig")) & (F.col("vid") == raw))
    names = v.select("raw_id", "signal", pair.alias("x")).select(F.lit(network).alias("network"), "raw_id", "signal", F.col("x.k").cast("long").alias("raw"), F.col("x.n").alias("name"))
    read = F.rlike(value, F.lit(BO)) | F.rlike(value, F.lit(SG)) | F.rlike(value, F.lit(vl)) | F.rlike(value, F.lit(vt)) | F.rlike(value, F.lit(r"^\s*VAL_\s+[A-Za-z_]"))
    known = F.rlike(value, F.lit(r"^\s*(BO_|SG_|VAL_|SIG_VALTYPE_)\s"))
    errors = lines.filter(known & (~read | (F.rlike(value, F.lit(r"^\s*SG_\s")) & F.col("bo").isNull()))).select("log", "line_no", F.col("value").alias("line"))
    return signals, names, errors
