"""Frames: columns and bit constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flag and error bits of a frame.
EXTENDED, RTR, FD, BRS, TX, LIN_SLEEP, LIN_WAKEUP = (1 << i for i in range(7))
ERROR_BITS = {
    "ACK": 0x0001, "BIT": 0x0002, "STUFF": 0x0004, "CRC": 0x0008, "FORM": 0x0010, "BUSOFF": 0x0020, "OVERRUN": 0x0040,
    "TIMEOUT": 0x0080, "NOT RESPONDED": 0x0100, "CHECKSUM ERROR": 0x0200, "RESTARTED": 0x0400, "WARNING": 0x0800,
    "PASSIVE": 0x1000, "ACTIVE": 0x2000, "ERROR": 0x8000,
}
GENERIC_ERROR = 0x8000
EXTENDED_KEY = 0x80000000

FRAME_COLUMNS = "frame_no long, ts_ns long, ts timestamp, iface int, channel string, bus string, can_id long, flags int, errors int, dlc int, len int, data binary, bytes array<int>"


def hex_word(hex_text: Column) -> Column:
    """BIGINT of the first 16 digits of a hex string, digits that are missing as 0."""
    return F.conv(F.rpad(hex_text, 16, "0"), 16, -10).cast("long")


def hex_bytes(hex_text: Column) -> Column:
    """array<int> of a hex string. hex() is the only exact way from BINARY to numbers; up to eight bytes are read as one
    number, outside of any lambda, so that it is read once."""
    n = F.shiftright(F.octet_length(hex_text), 1)
    word = hex_word(hex_text)
    eight = F.array(*[F.call_function("shiftrightunsigned", word, F.lit(56 - 8 * i)).bitwiseAND(255).cast("int") for i in range(8)])
    one = lambda i: F.conv(F.substring(hex_text, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.when(n <= 8, F.slice(eight, 1, F.greatest(n, F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))


def with_bytes(frames: DataFrame) -> DataFrame:
    """Adds bytes, ts and dlc to rows that have data, ts_ns and len."""
    from .functions.bits import dlc_of_len

    return frames.withColumns({
        "bytes": hex_bytes(F.hex("data")), "ts": F.timestamp_micros(F.expr("ts_ns div 1000")), "dlc": dlc_of_len(F.col("len")),
    })


def to_binary(byte_array: Column) -> Column:
    """BINARY of array<int>, by way of numbers of eight bytes."""
    digits, n = lambda word: F.lpad(F.hex(word), 16, "0"), F.size(byte_array) * 2
    long = F.array_join(F.transform(words_of(byte_array, True), digits), "")
    return F.unhex(F.substring(F.when(n <= 16, digits(head_of(byte_array))).otherwise(long), F.lit(1), n))


def settled(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The columns `keep` and the named new ones, computed once. Catalyst copies an expression to every place that uses
    it, which makes plans of derived columns grow beyond what code generation takes; a generator of one row in between
    stops that."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def head_of(byte_array: Column) -> Column:
    """The first eight bytes as a big-endian BIGINT, bytes beyond the end as 0."""
    out = F.lit(0).cast("long")
    for i in range(8):
        out = out.bitwiseOR(F.shiftleft(F.coalesce(F.get(byte_array, F.lit(i)), F.lit(0)).cast("long"), 56 - 8 * i))
    return out


def tail_of(byte_array: Column) -> Column:
    """The first eight bytes as a little-endian BIGINT, bytes beyond the end as 0."""
    out = F.lit(0).cast("long")
    for i in range(8):
        out = out.bitwiseOR(F.shiftleft(F.coalesce(F.get(byte_array, F.lit(i)), F.lit(0)).cast("long"), 8 * i))
    return out


def words_of(byte_array: Column, big_endian: bool) -> Column:
    """The payload as BIGINTs of eight bytes each, bytes beyond the end as 0; longer ones than eight bytes by a lambda, whose
    code stays small."""
    n, at = F.size(byte_array), (lambda j: 56 - 8 * j) if big_endian else (lambda j: 8 * j)

    def word(i: Column) -> Column:
        out = F.lit(0).cast("long")
        for j in range(8):
            out = out.bitwiseOR(F.shiftleft(F.coalesce(F.get(byte_array, i * 8 + j), F.lit(0)).cast("long"), at(j)))
        return out

    long = F.transform(F.sequence(F.lit(0), F.call_function("div", n - 1, F.lit(8)).cast("int")), word)
    return F.when(n <= 8, F.array((head_of if big_endian else tail_of)(byte_array))).otherwise(long)


def frame_no_order() -> list[Column]:
    return [F.col("ts_ns"), F.col("frame_no")]
