"""Filters, searches, statistics and order of frames.

What looks along a log (time since the frame before, cycles, changed bytes) is scanned in ranges of each key, with what a
range needs from those before it carried over (`scan`), so that a hot id spreads over many tasks. `by` (a log or vehicle
column) goes in front of the key where several logs are read at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import changed_mask, has_flag, is_error, masked_id
from ..functions.text import id_text, type_text
from ..schema import EXTENDED, TX
from . import scan

ORDER = ["ts_ns", "frame_no"]


# Filters.


def trace_filter(
    frames: DataFrame, *, show_tx: bool = True, show_rx: bool = True, hidden_can: Sequence[int] = (), hidden_lin: Sequence[int] = (),
    hidden_interfaces: Sequence[int] = (), hidden_nodes: Sequence[str] = (),
) -> DataFrame:
    """hidden_nodes needs a `sender` column (with_message)."""
    tx = has_flag(F.col("flags"), TX)
    can, lin = F.col("bus") == "CAN", F.col("bus") == "LIN"
    keep = F.lit(True)
    keep = keep if show_tx else keep & ~tx
    keep = keep if show_rx else keep & tx
    if hidden_can:
        keep &= ~(can & ~is_error(F.col("errors")) & F.col("can_id").isin(list(hidden_can)))
    if hidden_lin:
        keep &= ~(lin & F.col("can_id").bitwiseAND(63).isin(list(hidden_lin)))
    if hidden_interfaces:
        keep &= ~F.col("iface").isin(list(hidden_interfaces))
    if hidden_nodes:
        keep &= ~F.coalesce(F.col("sender").isin(list(hidden_nodes)), F.lit(False))
    return frames.filter(keep)


def smart_contains(column: Column, text: str) -> Column:
    """Substring; the case counts if the text has an upper-case letter."""
    found = F.contains(column, F.lit(text)) if text != text.lower() else F.contains(F.lower(column), F.lit(text))
    return F.coalesce(found, F.lit(False))


def text_found(df: DataFrame, text: str) -> Column:
    any_case = [id_text(*[F.col(c) for c in ("bus", "can_id", "flags", "errors")]), type_text(*[F.col(c) for c in ("bus", "flags", "errors")])]
    tests = [F.contains(F.lower(c), F.lit(text.lower())) for c in any_case]
    tests += [smart_contains(F.col(c), text) for c in ("message", "sender", "channel") if c in df.columns]
    return reduce(lambda a, b: a | b, tests)


def text_filter(df: DataFrame, text: str) -> DataFrame:
    """Rows whose id as shown or type contains the text (any case), or whose message, sender or channel does."""
    return df.filter(text_found(df, text))


def protocol_filter(messages: DataFrame, frames: DataFrame, text: str = "", **hidden) -> DataFrame:
    """Protocol messages (with frame_nos and name) whose first frame passes `trace_filter` with the options given, and
    whose name contains the text or whose first frame passes `text_filter`."""
    first = trace_filter(frames, **hidden)
    named = first.select(F.col("frame_no").alias("_first"), *([F.coalesce(text_found(first, text), F.lit(False)).alias("_found")] if text else []))
    out = messages.withColumn("_no", F.get("frame_nos", F.lit(0))).join(named, F.col("_no") == F.col("_first"))
    out = out.filter(F.col("_found") | smart_contains(F.col("name"), text)) if text else out
    return out.select(messages.columns)


def mask_filter(frames: DataFrame, can_id: int, mask: int, *, extended: bool | None = None, iface: int | None = None, tx: bool = False) -> DataFrame:
    keep = F.col("can_id").bitwiseAND(mask) == (can_id & mask)
    if extended is not None:
        keep &= has_flag(F.col("flags"), EXTENDED) == extended
    if iface is not None:
        keep &= F.col("iface") == iface
    return frames.filter(keep if tx else keep & ~has_flag(F.col("flags"), TX))


def time_range(frames: DataFrame, begin: float | None = None, end: float | None = None) -> DataFrame:
    """Seconds after the first frame, both ends inclusive; None is open. The first time is read to the driver, so that
    the bounds are literals and reach the scan."""
    first = frames.agg(F.min("ts_ns")).first()[0]
    if first is None:
        return frames
    keep = F.lit(True)
    if begin is not None:
        keep &= F.col("ts_ns") >= first + round(begin * 1e9)
    if end is not None:
        keep &= F.col("ts_ns") <= first + round(end * 1e9)
    return frames.filter(keep)


def index_key() -> Column:
    """Key of a row of the file index: the id with its extended bit, or -1 for error frames."""
    ext = F.when(has_flag(F.col("flags"), EXTENDED), F.lit(0x80000000)).otherwise(F.lit(0))
    return F.when(is_error(F.col("errors")), F.lit(-1).cast("long")).otherwise(F.col("can_id") + ext)


def enabled_only(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """Frames whose (iface, key, tx) is in rows."""
    f = frames.withColumn("_key", index_key()).withColumn("_tx", has_flag(F.col("flags"), TX))
    on = (F.col("f.iface") == F.col("r.iface")) & (F.col("_key") == F.col("r.key")) & (F.col("_tx") == F.col("r.tx"))
    return f.alias("f").join(rows.alias("r"), on, "left_semi").drop("_key", "_tx")


def byte_pattern(pattern: str) -> Column:
    """`01 ?? FF` from byte 0: a set byte beyond the end fails, a ?? beyond it passes."""
    tests = [F.coalesce(F.get("bytes", F.lit(i)) == int(b, 16), F.lit(False)) for i, b in enumerate(pattern.split()) if set(b) != {"?"}]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def raw_search(frames: DataFrame, can_id: int | None = None, pattern: str = "", max_hits: int | None = 100_000) -> tuple[DataFrame, bool]:
    """Hits in time order and whether there are more than max_hits."""
    f = frames.filter((F.col("errors") == 0) & byte_pattern(pattern))
    f = f.filter(F.col("can_id") == can_id) if can_id is not None else f
    return capped(f, max_hits)


def capped(rows: DataFrame, limit: int | None) -> tuple[DataFrame, bool]:
    if limit is None:
        return rows, False
    more = rows.select(F.lit(1)).limit(limit + 1).count() > limit
    return rows.orderBy(*ORDER).limit(limit), more


# Statistics.


def monitor_key(by: Sequence[str] = ()) -> list[Column]:
    """Direction, error or not, interface, bus and id (without the extended bit; 0 for errors)."""
    error = is_error(F.col("errors"))
    key = F.when(error, F.lit(0).cast("long")).otherwise(masked_id(F.col("can_id"), F.col("flags")))
    return [*[F.col(b) for b in by], has_flag(F.col("flags"), TX).alias("tx"), error.alias("error"), F.col("iface"), F.col("bus"), key.alias("id")]


MONITOR = ["tx", "error", "iface", "bus", "id"]


def _monitored(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return frames.select(*monitor_key(by), "frame_no", "ts_ns", "flags", "errors", "bytes")


def monitor(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per row: count, newest frame, the one before, changed bytes of the newest, and its place by first appearance.

    One aggregate, combined before its shuffle, over parts of each row's frames: a part's two newest frames hold the
    row's two newest, so no task sorts or holds all frames of an id."""
    keys = [*by, *MONITOR]
    frame = F.struct(F.struct("ts_ns", "frame_no").alias("o"), "flags", "errors", "bytes")
    rows = _monitored(frames, by).withColumn("part", F.pmod(F.xxhash64("ts_ns", "frame_no"), F.lit(64)))
    # of each part the newest, and over the parts the two newest of them and of the ones that the newest hides
    first = rows.groupBy(*keys, "part").agg(F.count("*").alias("count"), F.min(F.struct("ts_ns", "frame_no")).alias("first"), F.max(frame).alias("a"))
    top = first.groupBy(*keys).agg(F.sum("count").alias("count"), F.min("first").alias("first"), F.max("a").alias("a"), F.max_by("part", "a.o").alias("p"), F.sort_array(F.collect_list("a"), False).alias("some"))
    top = top.select(*keys, "count", "first", "a", "p", F.get("some", F.lit(1)).alias("b"))
    f, t = rows.alias("f"), top.alias("t")
    same = reduce(lambda x, y: x & y, [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    hidden = f.join(t, same & (F.col("f.part") == F.col("t.p"))).filter(F.struct("f.ts_ns", "f.frame_no") < F.col("t.a.o"))
    hidden = hidden.groupBy(*[F.col(f"t.{k}").alias(k) for k in keys]).agg(F.max(F.struct(F.struct("f.ts_ns", "f.frame_no").alias("o"), "f.flags", "f.errors", "f.bytes")).alias("c"))
    h = hidden.alias("h")
    same = reduce(lambda x, y: x & y, [F.col(f"t.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])
    out = t.join(h, same, "left").select(*[F.col(f"t.{k}").alias(k) for k in keys], "count", "first", F.col("a").alias("frame"), F.greatest("b", "c").alias("before"))
    out = out.select(*keys, "count", "first", F.col("frame.o").alias("last"), "frame", F.col("before.o").alias("prev"), F.col("before.bytes").alias("prev_bytes"))
    place = F.row_number().over(Window.partitionBy(*by or [F.lit(1)]).orderBy("first"))  # a row per monitor row
    return out.select(
        *keys, "count", F.col("first.ts_ns").alias("first_ts_ns"), F.col("last.frame_no").alias("frame_no"), F.col("last.ts_ns").alias("ts_ns"),
        F.col("prev.ts_ns").alias("prev_ts_ns"), F.col("frame.bytes").alias("bytes"), changed_mask(F.col("frame.bytes"), F.col("prev_bytes"), F.col("frame.errors")).alias("changed"),
        place.alias("position"),
    )


def sorted_monitor(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Monitor rows with their place by a column, ties by first appearance; payloads compare byte by byte, a shorter one
    before those it begins. There is a row for each id, so one task places them."""
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_first(column)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key, "position"))).orderBy("place")


def with_cycle(frames: DataFrame, keys: Sequence[str], by: Sequence[str] = (), span: int = scan.RANGE_FRAMES) -> DataFrame:
    """Adds cycle: ns since the previous frame of the key, null for the first and where time goes back. keys are columns
    without nulls; a range has `span` frame numbers."""
    rows, key = scan.cut(frames, keys, by, "frame_no", span)
    before = F.col("_before.t")
    cycle = F.when(F.col("ts_ns") >= before, F.col("ts_ns") - before).alias("cycle")
    return scan.newest(rows, key, ["frame_no"], {"_before": F.struct(F.col("ts_ns").alias("t"))}).select(*[F.col(f"`{c}`") for c in frames.columns], cycle)


def cycle_stats(frames: DataFrame, by: Sequence[str] = (), recent: int = 256) -> DataFrame:
    """Per monitor row: cycles, min, max, mean over all; median over the newest `recent`. `by` may hold a session column,
    so that no cycle spans a stop. Only the newest `recent` cycles of a task are sorted together with those of others."""
    keys = [*by, *MONITOR]
    c = with_cycle(_monitored(frames, by), MONITOR, by).filter("cycle is not null").select(*keys, "frame_no", "cycle")
    newest = Window.partitionBy(*keys).orderBy(F.desc("frame_no"))
    last = c.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= recent)
    middle = last.groupBy(*keys).agg(F.percentile("cycle", 0.5).alias("median_ns")).alias("m")
    out = c.groupBy(*keys).agg(F.count("*").alias("cycles"), F.min("cycle").alias("min_ns"), F.max("cycle").alias("max_ns"), (F.sum("cycle") / F.count("*")).alias("mean_ns")).alias("s")
    return out.join(middle, scan.same_keys("s", "m", keys), "left").select("s.*", "m.median_ns")


def trace_statistics(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Monitor rows with their cycle columns."""
    keys = [*by, *MONITOR]
    return monitor(frames, by).join(cycle_stats(frames, by), keys, "left")


def frame_index(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (channel, id or error): count, directions seen (1 rx, 2 tx), extended flag of the first, cycle min, max, sum."""
    f = frames.select(*by, "iface", index_key().alias("key"), "frame_no", "ts_ns", "flags")
    keys = [*by, "iface", "key"]
    c = with_cycle(f, keys[len(by) :], by)
    direction = F.when(has_flag(F.col("flags"), TX), 2).otherwise(1)
    return c.groupBy(*keys).agg(
        F.count("*").alias("count"), F.bit_or(direction).alias("directions"), F.min_by(has_flag(F.col("flags"), EXTENDED), "frame_no").alias("extended"),
        F.min("cycle").alias("cycle_min"), F.max("cycle").alias("cycle_max"), F.sum("cycle").alias("cycle_sum"),
    )


def log_info(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("frames"), F.countDistinct("iface").alias("channels"), (F.max("ts_ns") - F.min("ts_ns")).alias("duration_ns"))


def gap_stats(frames: DataFrame, log: str) -> DataFrame:
    """Gaps between consecutive frames of each log: min, max, mean, median; a log may be scanned by many tasks."""
    c = with_cycle(frames.select(log, "frame_no", "ts_ns"), [], [log]).filter("cycle is not null")
    out = c.groupBy(log).agg(F.min("cycle").alias("min_ns"), F.max("cycle").alias("max_ns"), (F.sum("cycle") / F.count("*")).alias("mean_ns")).alias("s")
    middle = scan.exact_median(c, [log], "cycle", "median_ns").alias("m")
    return out.join(middle, scan.same_keys("s", "m", [log]), "left").select("s.*", "m.median_ns")


# Windows.


def with_delta(frames: DataFrame, by: Sequence[str] = (), span_ns: int = scan.RANGE_NS) -> DataFrame:
    """Adds delta_ns to the previous frame of the same interface, direction, bus, id and id width; 0 for the first."""
    rows = frames.withColumns({"_tx": has_flag(F.col("flags"), TX), "_ext": has_flag(F.col("flags"), EXTENDED)})
    rows, key = scan.cut(rows, ["iface", "_tx", "_ext", "bus", "can_id"], by, "ts_ns", span_ns)
    out = scan.newest(rows, key, ORDER, {"_before": F.struct(F.col("ts_ns").alias("t"))})
    return out.select(*[F.col(f"`{c}`") for c in frames.columns], F.coalesce(F.col("ts_ns") - F.col("_before.t"), F.lit(0)).alias("delta_ns"))


def with_changed(frames: DataFrame, by: Sequence[str] = (), span_ns: int = scan.RANGE_NS) -> DataFrame:
    """Adds changed: bytes that differ from the previous frame of the monitor row."""
    key = dict(zip([f"_k{i}" for i in range(len(MONITOR))], monitor_key(), strict=True))
    rows, keys = scan.cut(frames.withColumns(key), list(key), by, "ts_ns", span_ns)
    out = scan.newest(rows, keys, ORDER, {"_before": F.struct(F.col("bytes").alias("b"))})
    return out.select(*[F.col(f"`{c}`") for c in frames.columns], changed_mask(F.col("bytes"), F.col("_before.b"), F.col("errors")).alias("changed"))


def with_index(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First appearance of each monitor row, numbered from 1: a row per monitor row."""
    first = frames.groupBy(*monitor_key(by)).agg(F.min(F.struct("ts_ns", "frame_no")).alias("first"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*by or [F.lit(1)]).orderBy("first"))).drop("first")


def with_rel_time(frames: DataFrame, log: str | None = None) -> DataFrame:
    """Adds rel_ns since the first frame, of the log where a column is given."""
    first = frames.groupBy(*[log] if log else []).agg(F.min("ts_ns").alias("_t0"))
    joined = frames.join(first, log) if log else frames.crossJoin(F.broadcast(first))
    return joined.withColumn("rel_ns", F.col("ts_ns") - F.col("_t0")).drop("_t0")


# Order, pages, unions.


def time_order(frames: DataFrame) -> DataFrame:
    return frames.orderBy(*ORDER)


def page(frames: DataFrame, begin: int | None = None, count: int = 100, most: int = 1000) -> DataFrame:
    """`count` frames from a frame number, or the last ones."""
    n = min(count, most)
    if begin is None:
        return frames.orderBy(F.desc("ts_ns"), F.desc("frame_no")).limit(n).orderBy(*ORDER)
    return frames.filter(F.col("frame_no") >= begin).orderBy(*ORDER).limit(n)


def goto(frames: DataFrame, ts_ns: int) -> DataFrame:
    """The first frame at or after a time: frame_no, ts_ns; no row where there is none."""
    first = frames.filter(F.col("ts_ns") >= ts_ns).agg(F.min(F.struct("ts_ns", "frame_no")).alias("x"))
    return first.filter("x is not null").select("x.frame_no", "x.ts_ns")


def tail(frames: DataFrame, n: int) -> DataFrame:
    return page(frames, None, n, n)


def merge_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """One log from several, in time order: log (their place), and frame_no as it was; the two together are unique."""
    parts = [log.withColumn("log", F.lit(i)) for i, log in enumerate(logs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("ts_ns", "log", "frame_no")


def distinct_ids(frames: DataFrame) -> DataFrame:
    return frames.select("iface", "bus", masked_id(F.col("can_id"), F.col("flags")).alias("can_id"), has_flag(F.col("flags"), EXTENDED).alias("extended")).distinct()


# Who is on the bus.


def id_width(frames: DataFrame) -> DataFrame:
    """Per interface: whether received CAN ids are mostly extended; null without any."""
    f = frames.filter("bus = 'CAN' and errors = 0").filter(~has_flag(F.col("flags"), TX))
    ext = F.sum(has_flag(F.col("flags"), EXTENDED).cast("long"))
    ids = frames.select("iface").distinct()
    return ids.join(f.groupBy("iface").agg((ext > F.count("*") - ext).alias("extended")), "iface", "left")


def j1939_sources(frames: DataFrame) -> DataFrame:
    """pgn and the source address of its newest received frame."""
    from ..functions.j1939 import j1939_fields

    f = frames.filter("bus = 'CAN' and errors = 0").filter(has_flag(F.col("flags"), EXTENDED) & ~has_flag(F.col("flags"), TX))
    f = f.withColumn("j", j1939_fields(F.col("can_id")))
    return f.groupBy(F.col("j.pgn").alias("pgn")).agg(F.max_by("j.sa", F.struct("ts_ns", "frame_no")).alias("sa"))


def source_addresses(frames: DataFrame) -> DataFrame:
    f = frames.filter("bus = 'CAN' and errors = 0").filter(has_flag(F.col("flags"), EXTENDED))
    return f.select(F.col("can_id").bitwiseAND(255).cast("int").alias("sa")).filter("sa < 254").distinct()
