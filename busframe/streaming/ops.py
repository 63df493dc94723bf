"""Structured Streaming forms of the operators.

Stateless decoding needs nothing of its own: `decode`, `decode_wide` and the filters take a streaming DataFrame as they
are. Here are the sources and sinks, keyed aggregates under a watermark, and the stateful operators (conditional log,
reassembly, control units) on transformWithStateInPandas. A state's key is the session, so state is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.bits import frame_bits, has_flag, is_error
from ..functions.j1939 import j1939_fields
from ..functions.n2k import N2K_FAST
from ..operators.load import bitrate_of
from ..operators.trace import monitor_key
from ..operators.trigger import PRE_NS, STALE_NS, Condition, bound_columns, column_of
from ..schema import EXTENDED, FRAME_COLUMNS, RTR, TX, to_binary
from ..session import ship_package


def stream_frames(spark: SparkSession, path: str, *, format: str = "parquet", max_files: int = 100) -> DataFrame:
    """Frames of a folder that grows; nothing is dropped, a backlog is taken max_files at a time."""
    return spark.readStream.format(format).schema(FRAME_COLUMNS).option("maxFilesPerTrigger", max_files).load(path)


def record(frames: DataFrame, path: str, checkpoint: str, late_path: str | None = None, *, records_per_file: int = 5_000_000, hold_ms: int = 50) -> DataStreamWriter:
    """Writes a stream to Parquet, a folder for each batch, sorted in it, in files of bounded size. Frames older than what
    a batch before had already written, less hold_ms, are late: they go to late_path (or beside the others) and are not
    dropped. A batch that is run again after a failure replaces its own folder, and the newest time of each batch is kept
    beside the checkpoint, so that lateness survives a restart."""
    spark = frames.sparkSession

    def newest_before(batch_id: int) -> int | None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/recorded/{batch_id - 1}/_SUCCESS")
        there = batch_id > 0 and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return spark.read.schema("newest long").parquet(f"{checkpoint}/recorded/{batch_id - 1}").first().newest if there else None

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        seen, newest = newest_before(batch_id), rows.agg(F.max("ts_ns")).first()[0]
        bound = None if seen is None else seen - hold_ms * 1_000_000
        late = F.lit(False) if bound is None or late_path is None else F.coalesce(F.col("ts_ns") < bound, F.lit(False))
        order = rows.sortWithinPartitions("ts_ns", "frame_no")
        order.filter(~late).write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(f"{path}/batch={batch_id}")
        if bound is not None and late_path is not None:
            order.filter(late).write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        known = [x for x in (seen, newest) if x is not None]
        spark.createDataFrame([(max(known, default=None),)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/recorded/{batch_id}")
        rows.unpersist()

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def record_log(frames: DataFrame, path: str, checkpoint: str, *, format: str = "parquet", hold_ms: int = 50, late: str = "1 minute", records_per_file: int = 5_000_000) -> DataStreamWriter:
    """Records a stream (with `log`) in the order of time, as `timed.reorder_stream` gives it: a folder for each batch, of
    Parquet files or of text files in the format named, with the channel numbers that a log's channels got first and keep.
    Frames that came too late for their place are written with the batch in which they came. A batch that is run again
    after a failure replaces its own folder; no folder is written twice otherwise."""
    from ..sources.logs import WRITERS, format_of
    from .timed import reorder_stream

    kind = format if format == "parquet" else format_of(format)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch={batch_id}"
        fs = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fs.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(fs, True)
        rows = batch.persist()
        if not rows.isEmpty():
            if kind == "parquet":
                rows.repartitionByRange("ts_ns").sortWithinPartitions("ts_ns", "frame_no").write.option("maxRecordsPerFile", records_per_file).parquet(target)
            else:
                from ..schema import with_bytes

                WRITERS[kind](with_bytes(rows), target)
        rows.unpersist()

    return reorder_stream(frames, hold_ms=hold_ms, late=late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Counts(StreamingQueryListener):
    """Counts of every query of a session, from its start on: rows read, and rows dropped as later than the watermark.
    Give it to spark.streams.addListener before the query starts."""

    def __init__(self) -> None:
        self.read: dict[str, int] = {}
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p, name = event.progress, str(event.progress.id)
        self.read[name] = self.read.get(name, 0) + p.numInputRows
        self.dropped[name] = self.dropped.get(name, 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_counts(query: StreamingQuery, counts: Counts | None = None) -> dict[str, int]:
    """Rows that a query has read, and rows that its state operators dropped as later than the watermark. Nothing else is
    ever dropped: a source that runs ahead waits. With a listener all batches count, without one the last 100."""
    if counts is not None:
        name = str(query.id)
        return {"read": counts.read.get(name, 0), "dropped": counts.dropped.get(name, 0)}
    steps = query.recentProgress
    return {
        "read": sum(p["numInputRows"] for p in steps),
        "dropped": sum(o.get("numRowsDroppedByWatermark", 0) for p in steps for o in p["stateOperators"]),
    }


def monitor_stream(frames: DataFrame) -> DataFrame:
    """Count, newest frame and last time per monitor row; for update mode."""
    order = F.struct("ts_ns", "frame_no")
    return frames.groupBy(*monitor_key()).agg(F.count("*").alias("count"), F.max(order).alias("last"), F.max_by("bytes", order).alias("bytes"))


def watch_stream(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last value, min, max, count per signal; for update mode."""
    return samples.groupBy(*keys).agg(F.max_by("value", F.struct("ts_ns", "frame_no")).alias("value"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))


def _load(frames: DataFrame, bitrates: dict[int, int], window, seconds: float, late: str) -> DataFrame:
    bits = F.when(is_error(F.col("errors")), F.lit(0).cast("long")).otherwise(frame_bits(F.col("bus"), F.col("len"), F.col("flags")))
    out = frames.withWatermark("ts", late).groupBy("iface", window.alias("w")).agg(F.sum(bits).alias("bits"))
    load = F.least(F.lit(100.0), F.col("bits") * 100.0 / bitrate_of(bitrates) / seconds)
    return out.select("iface", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "bits", load.alias("load"))


def bus_load_stream(frames: DataFrame, bitrates: dict[int, int], late: str = "1 second") -> DataFrame:
    """Tumbling windows of 500 ms."""
    return _load(frames, bitrates, F.window("ts", "500 milliseconds"), 0.5, late)


def rolling_load_stream(frames: DataFrame, bitrates: dict[int, int], late: str = "1 second") -> DataFrame:
    """Windows of 1 s every 50 ms, without those of a quiet bus, which `timed.quiet_load_stream` has."""
    return _load(frames, bitrates, F.window("ts", "1 second", "50 milliseconds"), 1.0, late)


def load_grid(spark: SparkSession, ifaces: Sequence[int], start: str, end: str, step_ms: int = 50) -> DataFrame:
    """(iface, end) of every window in a span, to left-join loads to: a quiet interface then has 0."""
    span = spark.sql(f"select explode(sequence(timestamp'{start}', timestamp'{end}', interval {step_ms} milliseconds)) as end")
    return span.crossJoin(F.broadcast(spark.createDataFrame([(i,) for i in ifaces], "iface int")))


class ConditionalLog(StatefulProcessor):
    """State of one log or vehicle: newest values, the rows of the last 5 s, and whether the conditions held."""

    def __init__(self, shown: int, n: int, tests: Sequence[tuple[int, str, float]], all_of: bool, pre_ns: int, stale_ns: int | None, armed: bool):
        self.shown, self.n, self.tests, self.all_of, self.pre, self.stale, self.armed = shown, n, list(tests), all_of, pre_ns, stale_ns, armed

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = ", ".join(f"v{i} double" for i in range(self.n))
        self.values = handle.getValueState("values", row + ", " + ", ".join(f"t{i} long" for i in range(self.n)) + ", met boolean")
        self.buffer = handle.getListState("buffer", "frame_no long, ts_ns long" + "".join(f", v{i} double" for i in range(self.shown)))

    def holds(self, values: list, times: list, now: int) -> bool:
        def one(i: int, op: str, threshold: float) -> bool:
            v = values[i] if values[i] is not None and (self.stale is None or now - times[i] <= self.stale) else None
            ops = {">": "__gt__", "<": "__lt__", "==": "__eq__", ">=": "__ge__", "<=": "__le__", "!=": "__ne__"}
            return v is not None and bool(getattr(float(v), ops[op])(threshold))

        tests = [one(*t) for t in self.tests]
        return bool(tests) and (all(tests) if self.all_of else any(tests))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.n
        state = self.values.get() if self.values.exists() else (*[None] * n, *[None] * n, False)
        values, times, met = list(state[:n]), list(state[n : 2 * n]), bool(state[2 * n])
        buffer = list(self.buffer.get()) if self.buffer.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_ns", "frame_no"]).itertuples(index=False, name=None):
            no, now = int(r[1]), int(r[2])
            before = met and self.holds(values, times, now)
            for i, v in enumerate(r[3 : 3 + n]):
                if v is not None and v == v:
                    values[i], times[i] = float(v), now
            met = self.holds(values, times, now)
            shown = tuple(v if v is not None and (self.stale is None or now - t <= self.stale) else None for v, t in zip(values[: self.shown], times[: self.shown], strict=True))
            if met and not before:
                if not self.armed:
                    out += [(*b, False) for b in buffer if now - b[1] <= self.pre]
                buffer = []
            if met:
                out.append((no, now, *shown, True))
            elif not before:
                buffer = [b for b in buffer if now - b[1] <= self.pre] + [(no, now, *shown)]
        self.values.update((*values, *times, met))
        if buffer:
            self.buffer.put(buffer)
        elif self.buffer.exists():
            self.buffer.clear()
        if out:
            frame = pd.DataFrame(out, columns=["frame_no", "ts_ns", *[f"v{i}" for i in range(self.shown)], "met"])
            frame.insert(0, "log", key[0])
            yield frame

    def close(self) -> None:
        pass


def conditional_log_stream(
    wide: DataFrame, signals: Sequence[str], conditions: Sequence[Condition], *, all_of: bool = True, pre_ns: int = PRE_NS, stale_ns: int | None = STALE_NS, armed: bool = False,
) -> DataFrame:
    """Rows (log, frame_no, ts_ns, signals..., met) of a stream (log, frame_no, ts_ns, signals..., and iface where a
    condition is bound to one); the state is kept per log. armed leaves out the rows before a trigger. Rows of a batch are
    put in time order. A value goes stale when the next row comes; `timed.conditional_log_events` knows it before."""
    ship_package(wide.sparkSession)
    names = list(dict.fromkeys([*signals, *[column_of(c) for c in conditions]]))
    tests = [(names.index(column_of(c)), c.op, float(c.threshold)) for c in conditions]
    schema = "log string, frame_no long, ts_ns long, " + ", ".join(f"v{i} double" for i in range(len(signals))) + ", met boolean"
    source = bound_columns(wide, conditions).select(F.col("log").cast("string").alias("log"), "frame_no", "ts_ns", *[F.col(f"`{s}`").cast("double").alias(f"v{i}") for i, s in enumerate(names)])
    out = source.groupBy("log").transformWithStateInPandas(ConditionalLog(len(signals), len(names), tests, all_of, pre_ns, stale_ns, armed), schema, "append", "None")
    return out.select("log", "frame_no", "ts_ns", *[F.col(f"v{i}").alias(s) for i, s in enumerate(signals)], "met")


def in_order(rows: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
    """(ts_ns, frame_no, names...) of a key's rows in the order of time, as numbers and bytes of Python."""
    parts = list(rows)
    whole = parts[0] if len(parts) == 1 else pd.concat(parts)
    order = np.lexsort((whole.frame_no.to_numpy(), whole.ts_ns.to_numpy()))
    return zip(*[whole[n].to_numpy()[order].tolist() for n in ("ts_ns", "frame_no", *names)], strict=True)


def numbers(payload: bytes | bytearray) -> np.ndarray:
    return np.frombuffer(payload, np.uint8).astype(np.int32)


def payload_of(frames: DataFrame) -> Column:
    """The bytes of frames as BINARY."""
    return F.col("data") if "data" in frames.columns else to_binary(F.col("bytes"))


class IsoTp(StatefulProcessor):
    """One session key: the open message."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "ts_ns long, size long, opened int, next int, bytes array<int>, frame_nos array<bigint>", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.open.get() if self.open.exists() else None
        state = [int(s[0]), int(s[1]), int(s[2]), int(s[3]), bytearray(s[4]), [int(x) for x in s[5]]] if s else None
        out = []
        for ts, no, b in in_order(rows, "payload"):
            kind, low = b[0] >> 4, b[0] & 15
            if kind == 0:
                size, at = (b[1], 2) if low == 0 and len(b) > 1 else (low, 1)
                if size > 0 and at + size <= len(b) and b[at] >= 0x10:
                    out.append((ts, b[at : at + size], [no]))
                    state = None
            elif kind == 1:
                size, at = low << 8 | (b[1] if len(b) > 1 else 0), 2
                if size == 0 and len(b) >= 6:
                    size, at = int.from_bytes(bytes(b[2:6]), "big"), 6
                if at < len(b) and b[at] >= 0x10:
                    state = [ts, size, len(b) - at, 1, bytearray(b[at:]), [no]]
            elif kind == 2 and state:
                if low != state[3]:
                    state = None
                    continue
                state[4] += b[1:][: max(0, state[1] - len(state[4]))]
                state[5].append(no)
                state[3] = (low + 1) % 16
                if len(state[4]) >= state[1]:
                    out.append((state[0], state[4], state[5]))
                    state = None
        if state:
            self.open.update((*state[:4], list(state[4]), state[5]))
        elif s:
            self.open.clear()
        if out:
            yield pd.DataFrame([(*key, ts, numbers(b), nos) for ts, b, nos in out], columns=[*SESSION, "ts_ns", "bytes", "frame_nos"])

    def close(self) -> None:
        pass


SESSION = ["bus", "iface", "tx", "extended", "can_id", "address"]


def uds_stream(frames: DataFrame, ttl_ms: int | None = None, addr_ext: bool = False) -> DataFrame:
    """UDS messages of a stream of CAN and LIN diagnostic frames, with the session as in `uds_pdus`; a message may span
    batches. An open session has no end of its own; ttl_ms gives it one. addr_ext: the first byte of CAN frames is an
    address."""
    ship_package(frames.sparkSession)
    data = payload_of(frames)
    pf, n = F.shiftrightunsigned("can_id", 16).bitwiseAND(255), F.octet_length(data)
    ext, can = has_flag(F.col("flags"), EXTENDED), F.col("bus") == "CAN"
    lin = (F.col("bus") == "LIN") & F.col("can_id").bitwiseAND(63).isin(0x3C, 0x3D) & (n >= 3)
    f = frames.filter((F.col("errors") == 0) & ~has_flag(F.col("flags"), RTR) & ((can & (~ext | pf.isin(0xDA, 0xDB))) | lin))
    skip = F.when(can, 1 if addr_ext else 0).otherwise(1)
    address = F.when(can, F.coalesce(F.get("bytes", F.lit(0)), F.lit(0))).otherwise(0) if addr_ext else F.lit(0)
    f = f.select(
        "bus", "iface", has_flag(F.col("flags"), TX).alias("tx"), ext.alias("extended"), F.when(can, F.col("can_id")).otherwise(0).cast("long").alias("can_id"), address.cast("int").alias("address"),
        "ts_ns", "frame_no", F.substring(data, skip + 1, F.greatest(n - skip, F.lit(0))).alias("payload"),
    ).filter(F.octet_length("payload") > 0)
    schema = "bus string, iface int, tx boolean, extended boolean, can_id long, address int, ts_ns long, bytes array<int>, frame_nos array<bigint>"
    return f.groupBy(*SESSION).transformWithStateInPandas(IsoTp(ttl_ms), schema, "append", "None")


class Packets(StatefulProcessor):
    """One session key of J1939 transport or of NMEA 2000 fast packets: the open message."""

    def __init__(self, fast: bool, ttl_ms: int | None):
        self.fast, self.ttl = fast, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = "ts_ns long, pgn long, size long, packets int, first int, count int, bytes array<int>, frame_nos array<bigint>"
        self.open = handle.getValueState("open", row, ttlDurationMs=self.ttl)

    def step(self, state: list | None, b: bytes, pgn: int, ts: int, no: int) -> list | None:
        """The message that is open after a frame; its count is -1 once it has all its bytes."""
        if self.fast:
            if b[0] & 0x1F == 0:
                if len(b) < 2:
                    return state
                state = [ts, pgn, b[1], 0, b[0], 0, b[2:], [no]]
            elif state is None or b[0] != (state[4] + state[5] + 1) % 256:
                return None
            else:
                state = [*state[:5], state[5] + 1, state[6] + b[1:], [*state[7], no]]
            return state if len(state[6]) < state[2] else [*state[:5], -1, *state[6:]]
        if pgn == 0xEC00:
            if len(b) < 8 or b[0] not in (16, 32, 255):
                return state
            return None if b[0] == 255 else [ts, b[5] + b[6] * 256 + b[7] * 65536, b[1] + b[2] * 256, b[3], 0, 0, b"", [no]]
        if state is None or b[0] != (state[5] + 1) % 256:
            return None
        state = [*state[:5], state[5] + 1, state[6] + b[1:8], [*state[7], no]]
        return [*state[:5], -1, *state[6:]] if state[5] >= state[3] or len(state[6]) >= state[2] else state

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        state = [*(int(x) for x in held[:6]), bytes(held[6]), [int(x) for x in held[7]]] if held else None
        out = []
        for ts, no, pgn, b in in_order(rows, "pgn", "payload"):
            state = self.step(state, b, pgn, ts, no)
            if state and state[5] == -1:
                out.append((key[0], key[1], key[2], key[3], state[1], state[0], numbers(state[6][: state[2]]), state[7]))
                state = None
        if state:
            self.open.update((*state[:6], list(state[6]), state[7]))
        elif held:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["iface", "tx", "sa", "to", "pgn", "ts_ns", "bytes", "frame_nos"])

    def close(self) -> None:
        pass


def _packets_stream(frames: DataFrame, fast: bool, ttl_ms: int | None) -> DataFrame:
    ship_package(frames.sparkSession)
    f = frames.filter((F.col("errors") == 0) & ~has_flag(F.col("flags"), RTR) & has_flag(F.col("flags"), EXTENDED) & (F.col("bus") == "CAN") & (F.octet_length(payload_of(frames)) > 0))
    f = f.select("iface", has_flag(F.col("flags"), TX).alias("tx"), j1939_fields(F.col("can_id")).alias("j"), "ts_ns", "frame_no", payload_of(frames).alias("payload"))
    pgn = F.col("j.pgn")
    mine = (pgn >= 65536) & (pgn.isin(*N2K_FAST) | pgn.between(130816, 131071)) if fast else pgn.isin(0xEC00, 0xEB00)
    f = f.filter(mine).select("iface", "tx", F.col("j.sa").cast("int").alias("sa"), (pgn if fast else F.col("j.ps")).cast("long").alias("to"), pgn.cast("long").alias("pgn"), "ts_ns", "frame_no", "payload")
    schema = "iface int, tx boolean, sa int, to long, pgn long, ts_ns long, bytes array<int>, frame_nos array<bigint>"
    return f.groupBy("iface", "tx", "sa", "to").transformWithStateInPandas(Packets(fast, ttl_ms), schema, "append", "None")


def j1939_stream(frames: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """J1939 messages of more than one frame from a stream: iface, tx, sa, da, pgn, ts_ns, bytes, frame_nos; a message may
    span batches. Messages of one frame need no state: take them from `j1939_pdus`' rows without transport."""
    return _packets_stream(frames, False, ttl_ms).withColumnRenamed("to", "da")


def n2k_stream(frames: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """NMEA 2000 fast packets from a stream: iface, tx, sa, pgn, ts_ns, bytes, frame_nos; a message may span batches."""
    return _packets_stream(frames, True, ttl_ms).drop("to")


class Pairing(StatefulProcessor):
    """One interface: the requests of the last 2 s, at most 32, each answered once per unit."""

    def __init__(self, limit_ns: int, most: int):
        self.limit, self.most = limit_ns, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "ts_ns long, can_id long, sid int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending = [(int(t), int(i), int(s)) for t, i, s in self.pending.get()] if self.pending.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_ns", "can_id"]).itertuples(index=False):
            b, ts, can_id = [int(x) for x in r.bytes[:2]], int(r.ts_ns), int(r.can_id)
            pending = [p for p in pending if ts - p[0] <= self.limit]
            if not b[0] & 0x40:
                pending = [*pending, (ts, can_id, b[0])][-self.most :]
                continue
            sid = b[1] if b[0] == 0x7F and len(b) > 1 else b[0] - 0x40
            fits = [p for p in pending if p[2] == sid and p[1] != can_id]
            if fits:
                best = max(fits, key=lambda p: (p[1] == can_id - 8, p[0]))
                if best[1] != 0x7DF:
                    pending.remove(best)
                out.append((can_id, can_id - 8 if best[1] == 0x7DF else best[1], best[1] == 0x7DF, ts))
        if pending:
            self.pending.put(pending)
        elif self.pending.exists():
            self.pending.clear()
        if out:
            frame = pd.DataFrame(out, columns=["rx_id", "tx_id", "guessed", "ts_ns"])
            frame.insert(0, "iface", key[0])
            yield frame

    def close(self) -> None:
        pass


def ecus_stream(pdus: DataFrame, limit_ns: int = 2_000_000_000, most: int = 32) -> DataFrame:
    """11-bit answers of a stream of UDS messages with the unit they tell of; a request is used up by its answer, one to
    everyone (0x7DF) is not."""
    ship_package(pdus.sparkSession)
    p = pdus.filter(~F.col("extended")).select("iface", "can_id", "ts_ns", "bytes")
    return p.groupBy("iface").transformWithStateInPandas(Pairing(limit_ns, most), "iface int, rx_id long, tx_id long, guessed boolean, ts_ns long", "append", "None")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], None] | None = None) -> None:
    """Runs a stream over what is there into a memory table; for tests and backfills."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if each:
        each(stream.sparkSession.table(name))
