"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The names that end in _stored run on a table of at least 10 million stored frames (copies of the lineitem log, moved in
time), which is written first; load and convert run on text logs of part of it. Rates of these are in "million_per_sec"; that of
decode_one_id_stored counts the frames of that one id.
One untimed query comes first, so that no figure holds the session's start."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from busframe.operators import decode, trace  # noqa: E402
from busframe.plans import fixtures as fx  # noqa: E402
from busframe.plans.queries import QUERIES  # noqa: E402
from busframe.sources import logs  # noqa: E402

NAMES = [
    "value_search", "decode_wide", "decode_long", "lineitem_decode", "monitor", "cycle_stats", "frame_index", "delta_time", "bus_load", "signal_stats", "watch", "xy_pair", "raw_search",
    "conditional_log", "uds_reassembly", "j1939_transport", "n2k_track", "e2e_check",
]
STORED = int(os.environ.get("BENCH_FRAMES", 10_000_000))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stored(spark: SparkSession, sf: str, work: str) -> tuple[dict, dict]:
    frames = fx.frames_from_lineitem(spark, sf)
    n = frames.count()
    copies = -(-STORED // n)
    year = 366 * 86400 * 10**9
    many = frames.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("ts_ns", F.col("ts_ns") + F.col("_c") * (7 * year)).withColumn("frame_no", F.expr("ts_ns div 1000")).drop("_c")
    seconds, rates = {}, {}

    def timed(name: str, rows: int, f) -> None:
        began = time.time()
        f()
        seconds[name] = round(time.time() - began, 3)
        rates[name] = round(rows / 1e6 / seconds[name], 3)

    many.write.parquet(f"{work}/raw")
    timed("build_table_stored", n * copies, lambda: logs.build_frame_table(spark.read.parquet(f"{work}/raw"), f"{work}/frames"))
    table, total = logs.frame_table(spark, f"{work}/frames"), n * copies
    signal = lambda i, start, length: decode.Signal(i | 0x80000000, start, length, True, False, "integer", 1.0, 0.0)
    ids = [r.can_id for r in table.select("can_id").distinct().collect()]
    every = {"quantity": [signal(i, 0, 16) for i in ids], "cents": [signal(i, 32, 32) for i in ids]}
    one = {"quantity": [signal(ids[0], 0, 16)]}
    add = lambda wide, *names: wide.agg(*[F.sum(c) for c in names]).collect()
    add(decode.decode_wide(table, one), "quantity")
    timed("decode_all_ids_stored", total, lambda: add(decode.decode_wide(table, every), "quantity", "cents"))
    timed("decode_one_id_stored", table.filter(F.col("can_id") == ids[0]).count(), lambda: add(decode.decode_wide(table, one), "quantity"))
    timed("frame_index_stored", total, lambda: run(trace.frame_index(table)))
    timed("monitor_stored", total, lambda: run(trace.monitor(table)))
    part = spark.read.parquet(f"{work}/raw").limit(total // 5)
    part.write.parquet(f"{work}/part")
    part, rows = spark.read.parquet(f"{work}/part"), total // 5
    timed("write_candump_fifth", rows, lambda: logs.write_candump(part, f"{work}/candump"))
    timed("load_candump_fifth", rows, lambda: run(logs.read_log(spark, f"{work}/candump", "candump", channels=["can0"])))
    timed("convert_to_asc_fifth", rows, lambda: logs.convert_log(spark, f"{work}/candump", f"{work}/asc", "asc", "candump"))
    return seconds, rates


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["frame_texts"](spark, sf))
    seconds = {}
    for name in NAMES:
        began = time.time()
        run(QUERIES[name](spark, sf))
        seconds[name] = round(time.time() - began, 3)
    with tempfile.TemporaryDirectory(prefix="bench-") as work:
        more, rates = stored(spark, sf, work)
    seconds |= more
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "million_per_sec": rates, "frames": STORED, "sf": sf.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
