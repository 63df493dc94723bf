"""Texts of ids, data, errors, times and values, as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BRS, ERROR_BITS, EXTENDED, FD, LIN_SLEEP, LIN_WAKEUP, RTR
from .bits import extract_raw, has_flag, masked_id


def id_text(bus: Column, can_id: Column, flags: Column, errors: Column, decimal: bool = False) -> Column:
    """0x123, 0x1ABCDEF0 or 0x3C (LIN); - for a CAN error frame."""
    lin, can = can_id.bitwiseAND(63), masked_id(can_id, flags)
    if decimal:
        shown = F.when(bus == "LIN", lin).otherwise(can).cast("string")
    else:
        wide = F.when(has_flag(flags, EXTENDED), F.lpad(F.hex(can), 8, "0")).otherwise(F.lpad(F.hex(can), 3, "0"))
        shown = F.concat(F.lit("0x"), F.when(bus == "LIN", F.lpad(F.hex(lin), 2, "0")).otherwise(wide))
    return F.when((bus != "LIN") & (errors != 0), "-").otherwise(shown)


def error_text(errors: Column) -> Column:
    """ERROR: ACK+CRC"""
    names = F.array_compact(F.array(*[F.when(errors.bitwiseAND(bit) != 0, name) for name, bit in ERROR_BITS.items()]))
    return F.concat(F.lit("ERROR"), F.when(F.size(names) > 0, F.concat(F.lit(": "), F.array_join(names, "+"))).otherwise(""))


def hex_text(data: Column, sep: str = " ") -> Column:
    return F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b), 2, "0")), sep)


def group_text(data: Column, groups: Sequence[tuple[int, int]], sep: str = " ") -> Column:
    """Payload as hex by groups of bits (first bit, length; little-endian) instead of bytes, of two digits or more each."""

    def one(start: int, length: int) -> Column:
        digits = F.hex(extract_raw(data, start, length, False))
        return F.lpad(digits, 2, "0") if length <= 8 else F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)

    return F.concat_ws(sep, *[one(*g) for g in groups])


def spaced_hex(data: Column) -> Column:
    """Hex of BINARY with a blank between bytes; up to eight bytes are cut by place, without a lambda."""
    h = F.hex(data)
    n = F.octet_length(data)
    short = F.rtrim(F.concat(*[x for i in range(8) for x in (F.substring(h, 2 * i + 1, 2), F.lit(" "))]))
    long = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("substring", h, i * 2 + 1, F.lit(2))), " ")
    return F.when(n <= 8, short).otherwise(long)


def fixed_point(ns: Column, places: int, width: int) -> Column:
    """Seconds of a number of ns that isn't negative, rounded half up to so many places, right-aligned."""
    unit = 10**places
    steps = F.call_function("div", ns + 10 ** (9 - places) // 2, F.lit(10 ** (9 - places)))
    text = F.concat(F.call_function("div", steps, F.lit(unit)).cast("string"), F.lit("."), F.lpad((steps % unit).cast("string"), places, "0"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def ascii_text(data: Column, sep: str = "") -> Column:
    """Bytes 0x20..0x7E as they are, others as a dot."""
    return F.array_join(F.transform(data, lambda b: F.when(b.between(0x20, 0x7E), F.char(b)).otherwise(".")), sep)


def data_text(data: Column, flags: Column, errors: Column, mode: str = "hex", groups: Sequence[tuple[int, int]] | None = None) -> Column:
    """Payload as hex (of bytes, or of groups of bits), decimal or ASCII; empty for remote frames and no bytes; the errors of
    an error frame."""
    shown = {
        "hex": group_text(data, groups) if groups else hex_text(data),
        "decimal": F.array_join(data.cast("array<string>"), " "),
        "ascii": ascii_text(data, " "),
    }[mode]
    return F.when(F.size(data) == 0, "").when(errors != 0, error_text(errors)).when(has_flag(flags, RTR), "").otherwise(shown)


def type_text(bus: Column, flags: Column, errors: Column) -> Column:
    """FD.EXT.RTR.BRS, LIN.SLP, ERR..."""
    part = lambda bit, yes, no="": F.when(has_flag(flags, bit), yes).otherwise(no)
    can = F.concat(part(FD, "FD."), part(EXTENDED, "EXT", "STD"), part(RTR, ".RTR"), part(BRS, ".BRS"))
    lin = F.when(has_flag(flags, LIN_SLEEP), "LIN.SLP").when(has_flag(flags, LIN_WAKEUP), "LIN.WUP").otherwise("LIN")
    return F.when(bus == "LIN", lin).when(errors != 0, "ERR").otherwise(can)


def format_duration(seconds: Column, decimals: int = 3) -> Column:
    """12.345, 4:05.250, 3:04:05.250 or 2d 03:04:05.250; rounded once."""
    scale = 10**decimals
    ticks = F.floor(F.abs(seconds) * scale + 0.5).cast("long")
    whole = F.floor(ticks / scale).cast("long")
    sec, minute, hour, day = whole % 60, F.floor(whole / 60) % 60, F.floor(whole / 3600) % 24, F.floor(whole / 86400)
    text = (
        F.when(day > 0, F.format_string("%dd %02d:%02d:%02d", day, hour, minute, sec))
        .when(hour > 0, F.format_string("%d:%02d:%02d", hour, minute, sec))
        .when(minute > 0, F.format_string("%d:%02d", minute, sec))
        .otherwise(sec.cast("string"))
    )
    tail = F.concat(F.lit("."), F.lpad((ticks % scale).cast("string"), decimals, "0")) if decimals else F.lit("")
    return F.concat(F.when(seconds < 0, "-").otherwise(""), text, tail)


def parse_duration(text: Column) -> Column:
    """Seconds of 90, 1:30, 1:02:03.5, 2d 1:02:03, 2d; after days two fields are h:m; malformed: null."""
    number = r"[0-9]+(?:\.[0-9]*)?|\.[0-9]+"
    clean = F.trim(text)
    pattern = rf"^(?:([0-9]+)\s*d\s*)?(?:(?:({number}):)?(?:({number}):)?({number}))?$"
    ok = F.rlike(clean, F.lit(pattern)) & (clean != "")
    part = lambda i: F.regexp_extract(clean, pattern, i)
    days, a, b, c = part(1), part(2), part(3), part(4)
    value = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    clock = (value(a) * 60 + value(b)) * 60 + value(c)  # with two fields a is matched first
    fields = F.when(a != "", 1).otherwise(0) + F.when(b != "", 1).otherwise(0) + F.when(c != "", 1).otherwise(0)
    two = value(F.when(b != "", b).otherwise(a)) * 60 + value(c)
    clock = F.when(fields == 2, F.when(days != "", two * 60).otherwise(two)).otherwise(clock)
    return F.when(ok, value(days) * 86400 + clock)


def parse_seconds_ns(text: Column) -> Column:
    """Nanoseconds of exact decimal seconds; digits beyond nine are cut; malformed: null."""
    pattern = r"^([0-9]+)(?:\.([0-9]*))?$"
    whole = F.substring_index(text, ".", 1)
    frac = F.call_function("substring", text, F.length(whole) + 2)
    ns = whole.try_cast("long") * 1_000_000_000 + F.rpad(F.substring(frac, 1, 9), 9, "0").try_cast("long")
    return F.when(F.rlike(text, F.lit(pattern)), ns)


def time_text(ts_ns: Column, mode: str, zone: str = "UTC", reference_ns: Column | None = None) -> Column:
    """HH:mm:ss.SSS in UTC (absolute_utc) or a zone (absolute); seconds since reference_ns (relative, delta)."""
    if mode in ("relative", "delta"):
        ok = reference_ns.isNotNull() & (ts_ns >= reference_ns)
        return format_duration(F.when(ok, (ts_ns - reference_ns) / 1e9).otherwise(0.0))
    stamp = F.to_utc_timestamp(F.timestamp_micros(F.call_function("div", ts_ns - F.pmod(ts_ns, F.lit(1000)), F.lit(1000))), F.current_timezone())
    stamp = F.from_utc_timestamp(stamp, "UTC" if mode == "absolute_utc" else zone)
    return F.date_format(stamp, "HH:mm:ss.SSS")


def decimals_of(x: float) -> int:
    """Decimal places that a factor or offset needs, up to nine."""
    p = 1.0
    for d in range(9):
        r = round(x * p)
        if (r or not x) and abs(x * p - r) < 1e-6:
            return d
        p *= 10
    return 9


def decimals_column(factor: Column, offset: Column) -> Column:
    """decimals_of, the larger of a factor's and an offset's, for columns."""

    def one(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda d: ((F.round(x * F.pow(F.lit(10.0), d)) != 0) | (x == 0)) & (F.abs(x * F.pow(F.lit(10.0), d) - F.round(x * F.pow(F.lit(10.0), d))) < 1e-6))
        return F.coalesce(F.array_min(places), F.lit(9))

    return F.greatest(one(factor), one(offset))


def format_decimals(value: Column, decimals: Column) -> Column:
    """A number with so many decimals (0 to 9); -0.00 loses its sign."""
    shown = F.format_string("%.9f", value)
    for d in range(9):
        shown = F.when(decimals == d, F.format_string(f"%.{d}f", value)).otherwise(shown)
    return F.when(F.rlike(shown, F.lit(r"^-[0.]*$")), F.substring(shown, 2, 400)).otherwise(shown)


def format_value(value: Column, value_type: str, factor: float, offset: float) -> Column:
    """Decimals by factor and offset; %.7g and %.15g for floats; -0.00 loses its sign."""
    if value_type == "integer":
        shown = F.format_string(f"%.{max(decimals_of(factor), decimals_of(offset))}f", value)
    else:
        digits = 7 if value_type == "float32" else 15
        exponent = F.floor(F.log10(F.abs(value)))
        fixed = (exponent >= -5) & (exponent < digits)
        rounded = F.format_string(f"%.{digits - 1}e", value).cast("double")
        plain = F.format_string(f"%.{digits + 4}f", rounded)
        shown = F.when(value == 0, "0").when(fixed, F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))
        shown = shown.otherwise(F.format_string(f"%.{digits - 1}e", value))
    return F.when(F.rlike(shown, F.lit(r"^-[0.]*$")), F.substring(shown, 2, 400)).otherwise(shown)
