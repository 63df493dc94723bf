"""Frames to signal values through a dictionary.

The dictionary (signals, value names, networks) is small next to frames; the join is left to Spark, which broadcasts
it while it is below the session's threshold and shuffles otherwise. `decode_wide` folds chosen signals into literals:
no join, the ids reach the Parquet scan, and the bit work stays in generated code. Prefer it for a few signals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import Head, extract_raw, id_key, is_error, lin_physical, lin_raw, signed, to_physical
from ..functions.text import decimals_column, format_decimals, format_value
from ..schema import settled, words_of
from .trace import page


SMALL = 5000


def resolve_dictionary(dictionary: DataFrame) -> DataFrame:
    """Inside a network a later database (db_seq) replaces an earlier one on the same raw id."""
    newest = Window.partitionBy("network", "raw_id")
    return dictionary.withColumn("_newest", F.max("db_seq").over(newest)).filter("db_seq = _newest").drop("_newest")


def messages(dictionary: DataFrame) -> DataFrame:
    return resolve_dictionary(dictionary).groupBy("network", "raw_id").agg(
        F.first("message").alias("message"), F.first("sender").alias("sender"), F.first("message_comment").alias("message_comment"), F.first("dlc").alias("message_dlc")
    )


def by_interface(table: DataFrame, networks: DataFrame) -> DataFrame:
    """Rows of a table (network, raw_id, ...) for each interface: those of its network; and, with iface null, for
    interfaces without a network, those of the first network that knows the raw id."""
    order = Window.partitionBy("raw_id")
    own = networks.select("network", "iface").distinct().join(table, "network")
    seq = networks.groupBy("network").agg(F.min("net_seq").alias("net_seq"))
    any_network = table.join(seq, "network").withColumn("_first", F.min("net_seq").over(order)).filter("net_seq = _first").drop("_first", "net_seq")
    return own.select(F.col("iface").alias("on_iface"), *table.columns).unionByName(any_network.select(F.lit(None).cast("int").alias("on_iface"), *table.columns))


def _keyed(frames: DataFrame, networks: DataFrame) -> DataFrame:
    """Adds _iface (null where the interface has no network) and _key (null for error and LIN frames)."""
    known = networks.select(F.col("iface").alias("_iface")).distinct()
    key = F.when(~is_error(F.col("errors")) & (F.col("bus") == "CAN"), id_key(F.col("can_id"), F.col("flags")))
    # a row for each interface, and broadcast as such: by interface the frames would go to a few tasks
    return frames.join(F.broadcast(known), F.col("iface") == F.col("_iface"), "left").withColumn("_key", key)


def with_message(frames: DataFrame, dictionary: DataFrame, networks: DataFrame) -> DataFrame:
    """Adds network, message, sender, message_comment: null where no entry is found."""
    names = by_interface(messages(dictionary), networks).withColumnRenamed("raw_id", "_raw")
    f = _keyed(frames, networks)
    on = F.col("_iface").eqNullSafe(F.col("on_iface")) & (F.col("_key") == F.col("_raw"))
    return f.join(names, on, "left").drop("_iface", "_key", "_raw", "on_iface", "message_dlc")


def read_bits(start: Column, length: Column, big_endian: Column) -> Column:
    """The raw number at a place that a column gives, from the payload as numbers of eight bytes, read from either end
    (columns heads and tails): two of them hold any signal. 0 for a place that no frame has."""
    left = lambda x, by: F.call_function("shiftleft", x, by)
    right = lambda x, by: F.call_function("shiftrightunsigned", x, by)
    words, i, off = F.when(big_endian, F.col("heads")).otherwise(F.col("tails")), F.shiftright(start, 6), start.bitwiseAND(63)
    at = lambda i: F.coalesce(F.get(words, i), F.lit(0).cast("long"))
    # a shift by 64 would be one by 0, so what the second number gives is shifted twice
    be = right(left(at(i), off).bitwiseOR(right(right(at(i + 1), F.lit(1)), 63 - off)), 64 - length)
    le = right(at(i), off).bitwiseOR(left(left(at(i + 1), F.lit(1)), 63 - off)).bitwiseAND(right(F.lit(-1).cast("long"), 64 - length))
    return F.when(start.between(0, 511) & length.between(1, 64), F.when(big_endian, be).otherwise(le)).otherwise(F.lit(0).cast("long"))


def is_present(signal: dict[str, Column], n_bytes: Column) -> Column:
    """Whether a signal lies within the frame and, if multiplexed, its value is selected. Needs the columns of read_bits."""
    fits = signal["start_bit"] + signal["length"] <= n_bytes * 8
    muxer = read_bits(*[signal["muxer"][c] for c in ("start_bit", "length", "big_endian")])
    return fits & (~signal["is_muxed"] | F.coalesce(muxer == signal["mux_value"], F.lit(False)))


def hinted(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows of a dictionary for a join, to be broadcast if the dictionary has at most SMALL rows: Spark can't tell the size
    of a table made by the driver before it has shuffled the frames."""
    return F.broadcast(rows) if dictionary.count() <= SMALL else rows


def decode(frames: DataFrame, dictionary: DataFrame, networks: DataFrame) -> DataFrame:
    """samples: network, message, signal, raw_id, frame_no, ts_ns, iface, raw, value, signal_seq, decimals (null for
    floats); one row per present signal of each frame."""
    decimals = F.when(F.col("value_type") == "integer", decimals_column(F.col("factor"), F.col("offset")))
    d = by_interface(resolve_dictionary(dictionary).withColumn("decimals", decimals), networks).withColumnRenamed("dlc", "_dlc")
    f = _keyed(frames.select("frame_no", "ts_ns", "iface", "bus", "can_id", "flags", "errors", "bytes"), networks)
    f = settled(f, *[c for c in f.columns if c != "bytes"], heads=words_of(F.col("bytes"), True), tails=words_of(F.col("bytes"), False), n=F.size("bytes"))
    j = f.join(hinted(d, dictionary), F.col("_iface").eqNullSafe(F.col("on_iface")) & (F.col("_key") == F.col("raw_id")))
    s = {c: F.col(c) for c in ("start_bit", "length", "muxer", "is_muxed", "mux_value")}
    j = j.filter(is_present(s, F.col("n")))
    keep = ["network", "message", "signal", "raw_id", "frame_no", "ts_ns", "iface", "length", "is_unsigned", "value_type", "factor", "offset", "signal_seq", "decimals"]
    j = settled(j, *keep, raw=read_bits(F.col("start_bit"), F.col("length"), F.col("big_endian")))
    value = to_physical(F.col("raw"), F.col("length"), F.col("is_unsigned"), F.col("value_type"), F.col("factor"), F.col("offset"))
    raw = F.when(F.col("is_unsigned"), F.col("raw")).otherwise(signed(F.col("raw"), F.col("length")))
    return j.select("network", "message", "signal", "raw_id", "frame_no", "ts_ns", "iface", raw.alias("raw"), value.alias("value"), "signal_seq", "decimals")


@dataclass(frozen=True)
class Signal:
    """A signal as literals."""

    raw_id: int
    start_bit: int
    length: int
    is_unsigned: bool
    big_endian: bool
    value_type: str
    factor: float
    offset: float
    mux_value: int | None = None
    muxer: tuple[int, int, bool] | None = None
    network: str | None = None
    name: str = ""

    def within(self, head: Head) -> bool:
        return head.holds(self.start_bit, self.length) and (self.muxer is None or head.holds(*self.muxer[:2]))

    def raw(self, data: Column | Head) -> Column:
        raw = extract_raw(data, self.start_bit, self.length, self.big_endian)
        return raw if self.is_unsigned else signed(raw, self.length)

    def present(self, data: Column | Head) -> Column:
        fits = (data.size if isinstance(data, Head) else F.size(data)) * 8 >= self.start_bit + self.length
        return fits if self.muxer is None else fits & (extract_raw(data, *self.muxer) == self.mux_value)

    def value(self, data: Column | Head) -> Column:
        raw = extract_raw(data, self.start_bit, self.length, self.big_endian)
        return to_physical(raw, self.length, self.is_unsigned, self.value_type, self.factor, self.offset)


def find_signals(dictionary: DataFrame, name: str, message: str | None = None, network: str | None = None) -> list[Signal]:
    """The entries of a signal name, as literals for a plan. Reads the (small) rows of that name to the driver."""
    d = resolve_dictionary(dictionary).filter(F.col("signal") == name)
    d = d.filter(F.col("message") == message) if message else d
    d = d.filter(F.col("network") == network) if network else d
    rows = d.orderBy("network", "raw_id").collect()
    return [
        Signal(r.raw_id, r.start_bit, r.length, r.is_unsigned, r.big_endian, r.value_type, r.factor, r.offset, r.mux_value, tuple(r.muxer) if r.is_muxed and r.muxer else None, r.network, name)
        for r in rows
    ]


def signal_frames(frames: DataFrame, signals: Sequence[Signal]) -> DataFrame:
    """The frames that can hold one of the signals; the ids are literals, so the scan skips other row groups."""
    ids = sorted({s.raw_id & 0x1FFFFFFF for s in signals})
    keys = sorted({s.raw_id for s in signals})
    return frames.filter(F.col("can_id").isin(ids) & (F.col("errors") == 0) & (F.col("bus") == "CAN") & id_key(F.col("can_id"), F.col("flags")).isin(keys))


def decode_wide(frames: DataFrame, signals: dict[str, Sequence[Signal]], networks: dict[int, str] | None = None) -> DataFrame:
    """frame_no, ts_ns, iface, can_id and one column per name: its value, null where absent. Entries of one name that
    differ by id share their geometry where equal, so 40 equal ids are one expression. Of frames with a column `head`
    (the stored frame table) signals of the first eight bytes are read from that number alone. networks maps an interface to its
    network; an interface that isn't in it takes the first entry."""
    networks = networks or {}
    everything = [s for group in signals.values() for s in group]
    f = signal_frames(frames, everything)
    key = id_key(F.col("can_id"), F.col("flags"))
    head, payload = Head(F.col("head"), F.col("len")), F.col("bytes")
    source = lambda s: head if "head" in frames.columns and s.within(head) else payload
    out = {}
    for name, group in signals.items():
        shapes: dict[tuple, list[Signal]] = {}
        for s in group:
            shapes.setdefault((s.network, s.start_bit, s.length, s.is_unsigned, s.big_endian, s.value_type, s.factor, s.offset, s.mux_value, s.muxer), []).append(s)
        column = F.when(F.lit(False), F.lit(0.0))
        first: set[int] = set()
        for (network, *_), same in shapes.items():
            ifaces = [i for i, n in networks.items() if n == network]
            rest = [s.raw_id for s in same if s.raw_id not in first]
            first |= set(rest)
            mine = F.col("iface").isin(ifaces) & key.isin([s.raw_id for s in same])
            mine = mine | (~F.col("iface").isin(list(networks)) & key.isin(rest)) if rest else mine
            column = column.when(mine & same[0].present(source(same[0])), same[0].value(source(same[0])))
        out[name] = column
    return f.select("frame_no", "ts_ns", "iface", "can_id", *[c.alias(n) for n, c in out.items()])


def with_value_names(samples: DataFrame, value_names: DataFrame) -> DataFrame:
    names = value_names.withColumnRenamed("name", "value_name")
    return samples.join(names, ["network", "raw_id", "signal", "raw"], "left")


def decode_lin(frames: DataFrame, lin_dictionary: DataFrame) -> DataFrame:
    """samples of LIN frames: frame, publisher, signal, unit, frame_no, ts_ns, iface, raw, value."""
    f = frames.filter((F.col("bus") == "LIN") & ~is_error(F.col("errors"))).withColumn("frame_id", F.col("can_id").bitwiseAND(63).cast("int"))
    j = f.join(lin_dictionary, "frame_id").withColumn("raw", lin_raw(F.col("bytes"), F.col("bit_offset"), F.col("bit_length")))
    return j.select("frame", "publisher", "signal", "unit", "frame_no", "ts_ns", "iface", "raw", lin_physical(F.col("raw"), F.col("factor"), F.col("offset")).alias("value"))


def seen_messages(frames: DataFrame, dictionary: DataFrame, networks: DataFrame) -> DataFrame:
    """iface, network, raw_id, message and the count of frames, for each interface; without error and LIN frames and ids
    that aren't known there. A message is that of the interface's network; without one, of the first that knows the id.

    Frames are counted first, so what meets the dictionary is a row for each interface and id."""
    can = frames.filter(~is_error(F.col("errors")) & (F.col("bus") == "CAN"))
    seen = can.groupBy("iface", id_key(F.col("can_id"), F.col("flags")).alias("raw_id")).agg(F.count("*").alias("count"))
    known = networks.select(F.col("iface").alias("_iface")).distinct()
    names = by_interface(messages(dictionary), networks).withColumnRenamed("raw_id", "_raw")
    s = seen.join(known, F.col("iface") == F.col("_iface"), "left")
    found = s.join(names, F.col("_iface").eqNullSafe(F.col("on_iface")) & (F.col("raw_id") == F.col("_raw")))
    return found.select("iface", "network", "raw_id", "message", "count")


def seen_signals(dictionary: DataFrame, frames: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """Dictionary rows of messages that occur in the frames: with networks, on an interface where frames are decoded by
    the row's network; without, on any, as ids alone are compared."""
    if networks is not None:
        return dictionary.join(seen_messages(frames, dictionary, networks), ["network", "raw_id"], "left_semi")
    keys = frames.filter(~is_error(F.col("errors")) & (F.col("bus") == "CAN")).select(id_key(F.col("can_id"), F.col("flags")).alias("raw_id")).distinct()
    return dictionary.join(keys, "raw_id", "left_semi")


def signals_text(frames: DataFrame, dictionary: DataFrame, networks: DataFrame, value_names: DataFrame) -> DataFrame:
    """frame_no and `signals`: name=value, in the dictionary's order; a value name where there is one, else the number
    with the decimals of its factor and offset."""
    s = with_value_names(decode(frames, dictionary, networks), value_names)
    number = F.when(F.col("decimals").isNull(), format_value(F.col("value"), "float64", 1.0, 0.0)).otherwise(format_decimals(F.col("value"), F.col("decimals")))
    text = F.concat("signal", F.lit("="), F.coalesce("value_name", number))
    return s.groupBy("frame_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("signal_seq", text.alias("t")))), lambda x: x["t"]), " ").alias("signals"))


def encode_frames(values: DataFrame, dictionary: DataFrame, keys: Sequence[str] = ("frame_no",)) -> DataFrame:
    """Payload bytes from rows (keys..., network, raw_id, signal, value). A signal that the dictionary hasn't, or with
    factor 0, gives its frame an `error`. Bits of the signals are added up in the message's bytes.

    Bits are added up in numbers of eight bytes, those of Intel and of Motorola signals apart, so a frame is one row of
    numbers before it is shuffled; errors are keys of that row, as a text isn't added up in place."""
    d = resolve_dictionary(dictionary).select("network", "raw_id", "signal", "start_bit", "length", "is_unsigned", "big_endian", "factor", "offset", "dlc")
    n_words = max(1, -(-(dictionary.agg(F.max("dlc")).first()[0] or 0) // 8))
    j = values.join(hinted(d, dictionary), ["network", "raw_id", "signal"], "left")
    bad = F.when(F.col("length").isNull() | (F.col("factor") == 0), F.concat(F.lit("cannot encode "), "signal"))
    x = (F.col("value") - F.col("offset")) / F.when(F.col("factor") != 0, F.col("factor"))
    whole = F.floor(F.abs(x) + 0.5) * F.when(x < 0, -1).otherwise(1)
    raw = F.when(F.col("is_unsigned"), F.greatest(whole, F.lit(0))).otherwise(whole).cast("long")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.greatest(64 - F.col("length"), F.lit(0)))
    masked = F.when(F.col("length") > 0, F.coalesce(raw, F.lit(0)).bitwiseAND(ones)).otherwise(F.lit(0))
    # where the first number's lowest bit is to go
    at = F.when(F.col("big_endian"), 64 - F.col("start_bit") - F.col("length")).otherwise(F.col("start_bit"))
    j = settled(j, *keys, "dlc", "big_endian", error=bad, raw=masked.cast("long"), at=at)

    def word(w: int) -> Column:
        """The signal's bits in a number of eight bytes."""
        by = F.when(F.col("big_endian"), F.col("at") + 64 * w).otherwise(F.col("at") - 64 * w)
        shifted = F.when(by >= 0, F.call_function("shiftleft", F.col("raw"), by)).otherwise(F.call_function("shiftrightunsigned", F.col("raw"), -by))
        return F.when(by.between(-63, 63), shifted)

    names = [f"{end}{w}" for w in range(n_words) for end in ("be", "le")]
    sums = [F.bit_or(F.when(F.col("big_endian") == (c[:2] == "be"), word(int(c[2:])))).alias(c) for c in names]
    parts = j.groupBy(*keys, "error").agg(F.max("dlc").alias("dlc"), *sums)
    rows = parts.groupBy(*keys).agg(F.max("dlc").alias("dlc"), *[F.coalesce(F.bit_or(c), F.lit(0)).alias(c) for c in names], F.max("error").alias("error"))
    byte = lambda i: F.shiftrightunsigned(f"be{i // 8}", 56 - 8 * (i % 8)).bitwiseOR(F.shiftrightunsigned(f"le{i // 8}", 8 * (i % 8))).bitwiseAND(255).cast("int")
    size = F.when(F.col("dlc").isNull(), 0).otherwise(F.greatest("dlc", F.lit(1)))
    return rows.select(*keys, F.slice(F.array(*[byte(i) for i in range(8 * n_words)]), F.lit(1), size).alias("bytes"), "error")


def merge_dictionary(old: DataFrame, new: DataFrame, old_names: DataFrame, new_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reloaded dictionary: rows of `new`; a signal that was there before keeps its old value names."""
    key = ["network", "raw_id", "signal"]
    before = old.select(*key).distinct()
    names = old_names.join(new.select(*key).distinct(), key, "left_semi").unionByName(new_names.join(before, key, "left_anti"))
    return new, names


def dictionary_check(dictionary: DataFrame) -> DataFrame:
    """Findings: network, raw_id, message, signal, problem, other."""
    d = dictionary
    base = ["network", "raw_id", "message", "signal"]
    row = lambda df, problem, other=None: df.select(*base, F.lit(problem).alias("problem"), (other if other is not None else F.lit(None).cast("string")).alias("other"))
    message = d.groupBy("network", "raw_id", "message").agg(F.max("dlc").alias("dlc"))
    twice = message.groupBy("network", "message").agg(F.count("*").alias("n"), F.min("raw_id").alias("raw_id")).filter("n > 1").withColumn("signal", F.lit(None).cast("string"))
    same = d.groupBy("network", "raw_id", "message", "signal").count().filter("count > 1")
    mux = d.groupBy("network", "raw_id").agg(F.max(F.col("is_muxer").cast("int")).alias("has"))
    end = F.col("start_bit") + F.col("length")
    singles = [
        row(d.filter("length = 0"), "length 0"), row(d.filter((F.col("length") > 0) & (end > F.col("dlc") * 8)), "outside the message"),
        row(d.filter("factor = 0"), "factor 0"), row(d.filter("min > max"), "min above max"),
        row(d.filter("(value_type = 'float32' and length <> 32) or (value_type = 'float64' and length <> 64)"), "length of a float"),
        row(d.join(mux, ["network", "raw_id"]).filter("is_muxed and has = 0"), "no multiplexer"),
        row(same, "duplicate signal"), row(twice, "duplicate message"),
    ]
    bit = F.explode(F.transform(F.sequence(F.col("start_bit"), F.col("start_bit") + F.col("length") - 1), lambda b: F.when(F.col("big_endian"), (b / 8).cast("int") * 8 + 7 - b % 8).otherwise(b)))
    bits = d.filter("length > 0").select(*base, "signal_seq", "is_muxed", "mux_value", bit.alias("bit"))
    other = bits.select("network", "raw_id", "bit", F.col("signal").alias("s2"), F.col("signal_seq").alias("q2"), F.col("is_muxed").alias("m2"), F.col("mux_value").alias("v2"))
    clash = bits.join(other, ["network", "raw_id", "bit"]).filter("signal_seq < q2 and not (is_muxed and m2 and mux_value <> v2)")
    found = row(clash.select(*base, "s2").distinct(), "overlap", F.col("s2"))
    for s in singles:
        found = found.unionByName(s)
    return found


def trace_csv(frames: DataFrame, dictionary: DataFrame, networks: DataFrame, value_names: DataFrame, groups: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The decoded trace, one row per frame: time, utc, channel, dir, type, id, sender, name, dlc, data (by bytes, or by
    groups of bits: `text.group_text`), signals, comment."""
    from ..functions.bits import has_flag
    from ..functions.text import data_text, id_text, time_text, type_text
    from ..schema import TX

    first = frames.agg(F.min("ts_ns").alias("_t0"))
    m = with_message(frames, dictionary, networks).join(signals_text(frames, dictionary, networks, value_names), "frame_no", "left").crossJoin(F.broadcast(first))
    c = F.col
    return m.orderBy("ts_ns", "frame_no").select(
        F.format_string("%.6f", (c("ts_ns") - c("_t0")) / 1e9).alias("time"), time_text(c("ts_ns"), "absolute_utc").alias("utc"), "channel",
        F.when(has_flag(c("flags"), TX), "Tx").otherwise("Rx").alias("dir"), type_text(c("bus"), c("flags"), c("errors")).alias("type"),
        id_text(c("bus"), c("can_id"), c("flags"), c("errors")).alias("id"), F.coalesce("sender", F.lit("")).alias("sender"), F.coalesce("message", F.lit("")).alias("name"),
        "dlc", data_text(c("bytes"), c("flags"), c("errors"), groups=groups).alias("data"), F.coalesce("signals", F.lit("")).alias("signals"),
        F.coalesce(F.split("message_comment", "\n")[0], F.lit("")).alias("comment"),
    )


def write_trace_csv(frames: DataFrame, dictionary: DataFrame, networks: DataFrame, value_names: DataFrame, path: str) -> None:
    """The decoded trace as CSV part files with a header; texts are quoted, quotes within them doubled."""
    out = trace_csv(frames, dictionary, networks, value_names)
    out.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def decoded_page(frames: DataFrame, dictionary: DataFrame, networks: DataFrame, value_names: DataFrame, begin: int | None = None, count: int = 100) -> DataFrame:
    """A page of frames with message, sender, and the text of their signals; only the page's frames are decoded."""
    rows = page(frames, begin, count)
    return with_message(rows, dictionary, networks).join(signals_text(rows, dictionary, networks, value_names), "frame_no", "left").orderBy("ts_ns", "frame_no")


def samples_csv(samples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """signal, unit, time_s, value in long form; times count from the first sample."""
    units = resolve_dictionary(dictionary).select("network", "raw_id", "signal", "unit")
    first = samples.agg(F.min("ts_ns").alias("_t0"))
    s = samples.join(units, ["network", "raw_id", "signal"], "left").crossJoin(F.broadcast(first))
    return s.select("signal", F.coalesce("unit", F.lit("")).alias("unit"), ((F.col("ts_ns") - F.col("_t0")) / 1e9).alias("time_s"), "value")

