"""Streams that know the time: frames held back and sorted, values that go stale without a next row, the load of a bus that
has gone quiet.

The processors here run on event time. A watermark, `late` behind the newest row, moves their timers; rows behind it are
dropped by Spark, which counts them (`ops.stream_counts`), so `late` is the longest delay that a source may have. State
is keyed by log or interface.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.bits import frame_bits, is_error
from ..operators.load import bitrate_of
from ..operators.trigger import PRE_NS, STALE_NS, Condition, bound_columns, column_of
from ..session import ship_package

FRAME = "frame_no long, ts_ns long, iface int, channel string, bus string, can_id long, flags int, errors int, dlc int, len int, data binary"
NAMES = [c.split()[0] for c in FRAME.split(", ")]
END = "END"
#: A log's rows inside of a task, and how many of them leave it at once.
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.large_string(), "binary": pa.large_binary()}
ARROW = pa.schema([(name, TYPES[kind]) for name, kind in (c.split() for c in FRAME.split(", "))])
CHUNK = 50_000


def columns_of(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], type=field.type) for i, field in enumerate(ARROW)]


def with_time(rows: DataFrame, late: str) -> DataFrame:
    """Adds _time, from ts_ns, with its watermark."""
    return rows.withColumn("_time", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("_time", late)


class HoldBack(StatefulProcessor):
    """One log: the frames of its newest `hold` ns, the last time that was released, and the numbers of its channels."""

    def __init__(self, hold_ns: int):
        self.hold = hold_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", FRAME)
        self.mark = handle.getValueState("mark", "newest long, released long, timer long")
        self.channels = handle.getMapState("channels", "channel string", "number int")

    def put(self, rows: pa.Table, newest: int, released: int, timer: int) -> None:
        if rows.num_rows:
            self.held.put(list(zip(*[c.to_pylist() for c in rows.columns], strict=True)))
        elif self.held.exists():
            self.held.clear()
        if timer:
            self.handle.deleteTimer(timer)
        timer = -(-(newest + self.hold) // 1_000_000) + 1 if rows.num_rows else 0
        if timer:
            self.handle.registerTimer(timer)
        self.mark.update((newest, released, timer))

    def numbered(self, key: tuple, rows: pa.Table, order: np.ndarray, released: int) -> Iterator[pd.DataFrame]:
        """The rows in order, as they are written: with their channel's number and whether a newer frame was released before."""
        known = {k[0]: int(v[0]) for k, v in self.channels.iterator()} if self.channels.exists() else {}
        for at in range(0, len(order), CHUNK):
            out = rows.take(order[at : at + CHUNK]).to_pandas()
            channel = out.channel.fillna("")
            for c in channel.unique():
                if c not in known:
                    known[c] = len(known) + 1
                    self.channels.updateValue((c,), (known[c],))
            out.insert(0, "log", key[0])
            out["channel_no"], out["late"] = channel.map(known).astype("int32"), out.ts_ns < released
            yield out

    def state(self) -> tuple[list[tuple], int, int, int]:
        least = -(1 << 63)
        rows = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        newest, released, timer = self.mark.get() if self.mark.exists() else (least, least, 0)
        return rows, int(newest), int(released), int(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, newest, released, timer = self.state()
        # a log's rows of a batch are kept as Arrow columns, some 80 bytes a frame, and leave in order a chunk at a time
        parts = [[c] for c in columns_of(held)]
        ended = False
        for batch in rows:
            ended = ended or bool((batch.bus == END).any())
            batch = batch.loc[batch.bus != END]
            for part, field in zip(parts, ARROW, strict=True):
                part.append(pa.Array.from_pandas(batch[field.name], type=field.type))
        whole = []
        while parts:
            whole.append(pa.concat_arrays(parts.pop(0)))
        table = pa.table(whole, schema=ARROW)
        order = table.select(["ts_ns", "frame_no"])
        order = pc.sort_indices(order, [("ts_ns", "ascending"), ("frame_no", "ascending")]).to_numpy()
        times = table["ts_ns"].to_numpy()
        newest = max(newest, int(times[order[-1]])) if len(order) else newest
        cut = newest if ended else newest - self.hold
        n = int((times <= cut).sum())
        yield from self.numbered(key, table, order[:n], released)
        self.put(table.take(order[n:]), newest, max(released, int(times[order[n - 1]])) if n else released, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, newest, released, _ = self.state()
        yield from self.numbered(key, pa.table(columns_of(held), schema=ARROW), np.arange(len(held)), released)
        self.put(ARROW.empty_table(), newest, max(released, held[-1][1]) if held else released, 0)

    def close(self) -> None:
        pass


def reorder_stream(frames: DataFrame, *, hold_ms: int = 50, late: str = "1 minute") -> DataFrame:
    """Frames (with `log`) in the order of time: log, the columns of frames, channel_no and late.

    The newest hold_ms of each log are held back and merged with what comes next, over batches and restarts. A frame that
    comes behind a newer one already released is passed on at once, marked late. What is held when a log falls silent is
    released when the watermark has passed it by hold_ms, or at a row of this log whose bus is 'END'. A channel gets the
    log's next number, from 1, when its first frame is released, and keeps it."""
    ship_package(frames.sparkSession)
    rows = with_time(frames, late).select(F.col("log").cast("string").alias("log"), *[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in FRAME.split(", "))], "_time")
    return rows.groupBy("log").transformWithStateInPandas(HoldBack(hold_ms * 1_000_000), f"log string, {FRAME}, channel_no int, late boolean", "append", "EventTime")


class TimedConditionalLog(StatefulProcessor):
    """One log or vehicle: newest values, the rows of the last 5 s, whether the conditions held, and the timer of the time
    at which they stop to hold by themselves."""

    def __init__(self, n_shown: int, tests: Sequence[tuple[int, str, float]], n: int, all_of: bool, pre_ns: int, stale_ns: int, armed: bool):
        self.shown, self.tests, self.n, self.all_of, self.pre, self.stale, self.armed = n_shown, list(tests), n, all_of, pre_ns, stale_ns, armed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        values = ", ".join(f"v{i} double" for i in range(self.n))
        self.values = handle.getValueState("values", f"{values}, " + ", ".join(f"t{i} long" for i in range(self.n)) + ", met boolean, timer long")
        self.buffer = handle.getListState("buffer", "frame_no long, ts_ns long" + "".join(f", v{i} double" for i in range(self.shown)))

    def until(self, values: list, times: list) -> int | None:
        """The last time at which the conditions still hold with these values; None if they don't hold at all."""
        compare = {">": float.__gt__, "<": float.__lt__, "==": float.__eq__, ">=": float.__ge__, "<=": float.__le__, "!=": float.__ne__}
        ends = [times[i] + self.stale if values[i] is not None and compare[op](values[i], float(x)) else None for i, op, x in self.tests]
        if self.all_of:
            return min(ends) if ends and None not in ends else None
        return max((e for e in ends if e is not None), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, k = self.n, self.shown
        state = self.values.get() if self.values.exists() else (*[None] * (2 * n), False, 0)
        values, times, met, timer = list(state[:n]), list(state[n : 2 * n]), bool(state[2 * n]), int(state[2 * n + 1] or 0)
        buffer = [tuple(b) for b in self.buffer.get()] if self.buffer.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_ns", "frame_no"]).itertuples(index=False, name=None):
            no, now, new = int(r[1]), int(r[2]), r[3 : 3 + n]
            end = self.until(values, times) if met else None
            before = end is not None and now <= end
            if met and not before:  # it ended between the rows
                out.append((None, end + 1, *[None] * k, False, "stale"))
            for i, v in enumerate(new):
                if v is not None and v == v:
                    values[i], times[i] = float(v), now
            end = self.until(values, times)
            met = end is not None and now <= end
            shown = tuple(v if v is not None and now - t <= self.stale else None for v, t in zip(values[:k], times[:k], strict=True))
            if met and not before:
                out += [] if self.armed else [(*b, False, "before") for b in buffer if now - b[1] <= self.pre]
                buffer = []
            if met:
                out.append((no, now, *shown, True, "row"))
            elif before:
                out.append((None, now, *[None] * k, False, "falling"))
            else:
                buffer = [b for b in buffer if now - b[1] <= self.pre] + [(no, now, *shown)]
        if timer:
            self.handle.deleteTimer(timer)
        timer = self.until(values, times) // 1_000_000 + 1 if met else 0
        if timer:
            self.handle.registerTimer(timer)
        self.values.update((*values, *times, met, timer))
        if buffer:
            self.buffer.put(buffer)
        elif self.buffer.exists():
            self.buffer.clear()
        yield from self.table(key, out)

    def table(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            frame = pd.DataFrame(out, columns=["frame_no", "ts_ns", *[f"v{i}" for i in range(self.shown)], "met", "event"])
            frame["frame_no"] = frame["frame_no"].astype("Int64")
            frame.insert(0, "log", key[0])
            yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = list(self.values.get())
        end = self.until(state[: self.n], state[self.n : 2 * self.n])
        self.values.update((*state[: 2 * self.n], False, 0))
        yield from self.table(key, [(None, end + 1, *[None] * self.shown, False, "stale")])

    def close(self) -> None:
        pass


def conditional_log_events(
    wide: DataFrame, signals: Sequence[str], conditions: Sequence[Condition], *, all_of: bool = True, pre_ns: int = PRE_NS, stale_ns: int = STALE_NS, armed: bool = False, late: str = "1 second",
) -> DataFrame:
    """Rows (log, frame_no, ts_ns, signals..., met, event) of a stream (log, frame_no, ts_ns, signals..., and iface where a
    condition is bound to one). event tells what a row is: 'row' (the conditions hold), 'before' (it came within pre_ns
    before they did), 'falling' (the time of a row at which they no longer held; without values), or 'stale' (the first ns
    at which the values they rest on had expired): the last comes from the next row or, where none comes, from a timer as
    soon as the watermark has passed it. Values go stale after stale_ns of event time. Rows of a batch are put in order."""
    ship_package(wide.sparkSession)
    names = list(dict.fromkeys([*signals, *[column_of(c) for c in conditions]]))
    tests = [(names.index(column_of(c)), c.op, float(c.threshold)) for c in conditions]
    source = with_time(bound_columns(wide, conditions), late)
    source = source.select(F.col("log").cast("string").alias("log"), "frame_no", "ts_ns", *[F.col(f"`{s}`").cast("double").alias(f"v{i}") for i, s in enumerate(names)], "_time")
    schema = "log string, frame_no long, ts_ns long, " + ", ".join(f"v{i} double" for i in range(len(signals))) + ", met boolean, event string"
    processor = TimedConditionalLog(len(signals), tests, len(names), all_of, pre_ns, stale_ns, armed)
    out = source.groupBy("log").transformWithStateInPandas(processor, schema, "append", "EventTime")
    return out.select("log", "frame_no", "ts_ns", *[F.col(f"v{i}").alias(s) for i, s in enumerate(signals)], "met", "event")


class QuietLoad(StatefulProcessor):
    """One interface: the bits of each step of its last window and of what the watermark hasn't passed yet."""

    def __init__(self, span_ms: int, step_ms: int, chunk: int = 50_000):
        self.span, self.step, self.chunk = span_ms // step_ms, step_ms, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bits = handle.getListState("bits", "step long, bits long")
        self.next = handle.getValueState("next", "step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bits = {int(s): int(b) for s, b in self.bits.get()} if self.bits.exists() else {}
        for batch in rows:
            for step, n in batch.groupby("step").bits.sum().items():
                bits[int(step)] = bits.get(int(step), 0) + int(n)
        self.bits.put(sorted(bits.items()))
        if not self.next.exists():
            self.watch(min(bits) + 1)
        return iter(())

    def watch(self, step: int) -> None:
        """The next window that isn't known yet ends at a step; a timer waits for the watermark to pass it."""
        self.next.update((step,))
        self.handle.registerTimer(step * self.step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bits = {int(s): int(b) for s, b in self.bits.get()} if self.bits.exists() else {}
        at, last = int(self.next.get()[0]), timerValues.getCurrentWatermarkInMs() // self.step
        total, out = sum(bits.get(s, 0) for s in range(at - self.span, at)), []
        for end in range(at, last + 1):
            out.append((key[0], (end - self.span) * self.step, end * self.step, total))
            total += bits.get(end, 0) - bits.get(end - self.span, 0)
            if len(out) == self.chunk:
                yield self.table(out)
                out = []
        if out:
            yield self.table(out)
        end = max(at, last + 1)
        kept = [(s, b) for s, b in sorted(bits.items()) if s >= end - self.span]
        if kept:
            self.bits.put(kept)
        elif self.bits.exists():
            self.bits.clear()
        self.watch(end)

    def table(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["iface", "start_ms", "end_ms", "bits"])

    def close(self) -> None:
        pass


def quiet_load_stream(frames: DataFrame, bitrates: dict[int, int], *, span_ms: int = 1000, step_ms: int = 50, late: str = "1 second") -> DataFrame:
    """iface, start, end, bits, load of every window of span_ms each step_ms, from the first that holds a frame of the
    interface up to the watermark: one in which the bus was quiet is there with 0."""
    ship_package(frames.sparkSession)
    bits = F.when(is_error(F.col("errors")), F.lit(0).cast("long")).otherwise(frame_bits(F.col("bus"), F.col("len"), F.col("flags")))
    rows = with_time(frames, late).select("iface", F.floor(F.col("ts_ns") / (step_ms * 1_000_000)).alias("step"), bits.alias("bits"), "_time")
    out = rows.groupBy("iface").transformWithStateInPandas(QuietLoad(span_ms, step_ms), "iface int, start_ms long, end_ms long, bits long", "append", "EventTime")
    load = F.least(F.lit(100.0), F.col("bits") * 100.0 / bitrate_of(bitrates) / (span_ms / 1000))
    time = lambda c: F.timestamp_millis(F.col(c))
    return out.select("iface", time("start_ms").alias("start"), time("end_ms").alias("end"), "bits", load.alias("load"))

