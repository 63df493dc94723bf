"""Conditions over signals, and logs cut out around them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import condition_holds
from . import scan

ORDER = ["ts_ns", "frame_no"]
PRE_NS, STALE_NS = 5_000_000_000, 1_500_000_000


@dataclass(frozen=True)
class Condition:
    signal: str
    op: str
    threshold: float
    iface: int | None = None  # only values seen on this interface count


def conditions_met(conditions: Sequence[Condition], all_of: bool = True, value=F.col) -> Column:
    """AND or OR; a missing value never holds; no conditions: false. Conditions that are bound to an interface look at the
    column that `bound_columns` makes for it."""
    tests = [condition_holds(c.op, value(column_of(c)), c.threshold) for c in conditions]
    return reduce((lambda a, b: a & b) if all_of else (lambda a, b: a | b), tests) if tests else F.lit(False)


def column_of(condition: Condition) -> str:
    return condition.signal if condition.iface is None else f"{condition.signal}@{condition.iface}"


def bound_columns(wide: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Adds a column for each signal that a condition binds to an interface: its value on that interface's rows."""
    bound = {column_of(c): F.when(F.col("iface") == c.iface, F.col(c.signal)) for c in conditions if c.iface is not None}
    return wide.withColumns(bound) if bound else wide


def _seen(signals: Sequence[str]) -> dict[str, Column]:
    return {f"_p_{s}": F.when(F.col(f"`{s}`").isNotNull(), F.struct(F.col(f"`{s}`").alias("v"), F.col("ts_ns").alias("t"))) for s in signals}


def _fresh(of: Column, stale_ns: int | None) -> Column:
    """The value of a struct (v, t), null once older than stale_ns."""
    return of["v"] if stale_ns is None else F.when(F.col("ts_ns") - of["t"] <= stale_ns, of["v"])


def _held(wide: DataFrame, signals: Sequence[str], by: Sequence[str], span_ns: int) -> tuple[DataFrame, list[str]]:
    """Adds, for each signal, _p_<signal> and _n_<signal>: its newest value and time before a row, and with the row."""
    rows, key = scan.cut(wide, [], by, "ts_ns", span_ns)
    rows = scan.newest(rows, key, ORDER, _seen(signals))
    return rows.withColumns({f"_n_{s}": F.coalesce(c, F.col(f"`_p_{s}`")) for s, c in zip(signals, _seen(signals).values(), strict=True)}), key


def hold(wide: DataFrame, signals: Sequence[str], *, by: Sequence[str], stale_ns: int | None = STALE_NS, span_ns: int = scan.RANGE_NS) -> DataFrame:
    """The newest value of each signal at every row, null once older than stale_ns (event time). by names what tells
    logs or vehicles apart; a log is scanned in ranges of span_ns, with the values at their ends carried over."""
    out, _ = _held(wide, signals, by, span_ns)
    now = {s: F.col(f"`_n_{s}`") for s in signals}
    return out.select(*by, "frame_no", "ts_ns", *[_fresh(c, stale_ns).alias(s) for s, c in now.items()], *[c["t"].alias(f"{s}_seen") for s, c in now.items()])


def conditional_log(
    wide: DataFrame, conditions: Sequence[Condition], columns: Sequence[str], *, by: Sequence[str], all_of: bool = True, pre_ns: int = PRE_NS,
    stale_ns: int | None = STALE_NS, span_ns: int = scan.RANGE_NS,
) -> DataFrame:
    """Rows while the conditions hold, and at a rising edge the rows of the pre_ns before it, too. The row at a falling
    edge is never written, even if a next trigger follows within pre_ns. wide: (by..., frame_no, ts_ns, a column per
    signal, and iface where a condition is bound to one); by tells logs or vehicles apart. Staleness is in event time.
    A log is scanned in ranges of span_ns: newest values are carried over forwards, the next edge backwards."""
    names = list(dict.fromkeys([*columns, *[column_of(c) for c in conditions]]))
    h, key = _held(bound_columns(wide, conditions), names, by, span_ns)
    # the state before a row: the values before it, as far as they are still fresh now
    state = lambda of: conditions_met(conditions, all_of, lambda n: _fresh(F.col(f"`_{of}_{n}`"), stale_ns))
    h = h.withColumns({"_met": state("n"), "_was": state("p")})
    h = scan.newest(h, key, ORDER, {"_next": F.when(F.col("_met") & ~F.col("_was"), F.col("ts_ns"))}, backwards=True)
    early = ~F.col("_met") & ~F.col("_was") & (F.col("_next") - F.col("ts_ns") <= pre_ns)
    h = h.filter(F.col("_met") | F.coalesce(early, F.lit(False)))
    return h.select(*by, "frame_no", "ts_ns", *[_fresh(F.col(f"`_n_{c}`"), stale_ns).alias(c) for c in columns], F.col("_met").alias("met"))


def e2e_audit(frames: DataFrame, data_id: int, by: Sequence[str] = (), span_ns: int = scan.RANGE_NS) -> DataFrame:
    """Per interface and id: frames, frames with a wrong CRC, and counter jumps between frames whose CRC is right."""
    from ..functions.bits import e2e_p2_check

    f = frames.filter("errors = 0").withColumn("ok", e2e_p2_check(F.col("bytes"), data_id)).withColumn("counter", F.get("bytes", 1).bitwiseAND(15))
    rows, key = scan.cut(f.select(*by, "iface", "can_id", "ts_ns", "frame_no", "ok", "counter"), ["iface", "can_id"], by, "ts_ns", span_ns)
    f = scan.newest(rows, key, ORDER, {"last": F.when(F.col("ok"), F.col("counter"))})
    jump = F.col("ok") & F.col("last").isNotNull() & ((F.col("last") + 1) % 16 != F.col("counter"))
    return f.groupBy(*by, "iface", "can_id").agg(
        F.count("*").alias("frames"), F.sum((~F.col("ok")).cast("long")).alias("bad_crc"), F.sum(jump.cast("long")).alias("jumps")
    )
