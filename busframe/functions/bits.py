"""Flags, lengths, bits and physical values of a frame, as Column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXTENDED, FD

Number = Column | int | float


def as_column(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def is_error(errors: Column) -> Column:
    return errors != 0


def masked_id(can_id: Column, flags: Column) -> Column:
    return F.when(has_flag(flags, EXTENDED), can_id.bitwiseAND(0x1FFFFFFF)).otherwise(can_id.bitwiseAND(0x7FF))


def id_key(can_id: Column, flags: Column) -> Column:
    """Key of a dictionary entry: the id, with bit 31 for extended ones."""
    return masked_id(can_id, flags) + F.when(has_flag(flags, EXTENDED), F.lit(0x80000000)).otherwise(F.lit(0))


#: Lengths of the CAN FD length codes.
FD_LENGTHS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64]


def dlc_of_len(length: Column) -> Column:
    """Smallest code that holds the length; outside 0..64: 8."""
    out = F.when(~length.between(0, 64), 8)
    for code, n in enumerate(FD_LENGTHS):
        out = out.when(length <= n, code)
    return out


def len_of_dlc(dlc: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in FD_LENGTHS]), dlc), F.lit(8))


def _shift(value: Column, by: Number) -> Column:
    """To the left, or to the right for negative numbers."""
    if isinstance(by, int):
        return F.shiftleft(value, by) if by >= 0 else F.shiftrightunsigned(value, -by)
    left, right = F.call_function("shiftleft", value, F.greatest(by, F.lit(0))), F.call_function("shiftrightunsigned", value, F.greatest(-by, F.lit(0)))
    return F.when(by >= 0, left).otherwise(right)


def _mask(value: Column, length: Number) -> Column:
    if isinstance(length, int):
        return value if length >= 64 else value.bitwiseAND((1 << length) - 1)
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.least(F.greatest(64 - length, F.lit(0)), F.lit(63)))
    return value.bitwiseAND(ones)


def _valid(value: Column, start: Number, length: Number) -> Column:
    if isinstance(start, int) and isinstance(length, int):
        return value if 0 <= start < 512 and 0 < length <= 64 else F.lit(0).cast("long")
    ok = as_column(start).between(0, 511) & as_column(length).between(1, 64)
    return F.when(ok, value).otherwise(F.lit(0).cast("long"))


def _terms(data: Column, first: Number, last: Number, shift_of) -> Column:
    """OR of the bytes first..last, each shifted by shift_of(place in that run); at most nine. Bytes past the end: 0."""
    fixed = isinstance(first, int) and isinstance(last, int)
    out = F.lit(0).cast("long")
    for j in range(last - first + 1 if fixed else 9):
        byte = F.coalesce(F.get(data, as_column(first) + j), F.lit(0)).cast("long")
        by = shift_of(j)
        used = _shift(byte, by)
        if not fixed:  # shifts of 64 or more would wrap around
            used = F.when((first + j <= last) & (by < 64), used).otherwise(F.lit(0).cast("long"))
        elif by >= 64:
            continue
        out = out.bitwiseOR(used)
    return out


def _div(x: Number, by: int) -> Number:
    return x // by if isinstance(x, int) else (x / by).cast("int")


@dataclass(frozen=True)
class Head:
    """The first eight bytes of a payload as a big-endian BIGINT, and the payload's size: signals that lie within them
    are shifts of one number."""

    word: Column
    size: Column

    def holds(self, start: int, length: int) -> bool:
        return 0 <= start and 0 < length and start + length <= 64

    def raw(self, start: int, length: int, big_endian: bool) -> Column:
        if big_endian:
            return _mask(F.shiftrightunsigned(self.word, 64 - start - length), length)
        out = F.lit(0).cast("long")
        for j in range(start // 8, (start + length - 1) // 8 + 1):
            byte = F.shiftrightunsigned(self.word, 56 - 8 * j).bitwiseAND(255)
            by = 8 * j - start
            out = out.bitwiseOR(F.shiftleft(byte, by) if by >= 0 else F.shiftrightunsigned(byte, -by))
        return _mask(out, length)


def extract_raw_le(data: Column, start: Number, length: Number) -> Column:
    """Raw value of an Intel signal as a 64-bit pattern; start is the bit of its least significant bit."""
    first = _div(start, 8)
    last = _div(start + length - 1, 8)
    return _valid(_mask(_terms(data, first, last, lambda j: 8 * j - start % 8), length), start, length)


def extract_raw_be(data: Column, start: Number, length: Number) -> Column:
    """Raw value of a Motorola signal; start counts from the first byte's most significant bit, through the bytes."""
    first, last = _div(start, 8), _div(start + length - 1, 8)
    low = 7 - (start + length - 1) % 8
    return _valid(_mask(_terms(data, first, last, lambda j: (last - first - j) * 8 - low), length), start, length)


def extract_raw(data: Column | Head, start: Number, length: Number, big_endian: Column | bool) -> Column:
    if isinstance(data, Head):
        return data.raw(start, length, big_endian)
    if isinstance(big_endian, bool):
        return (extract_raw_be if big_endian else extract_raw_le)(data, start, length)
    return F.when(big_endian, extract_raw_be(data, start, length)).otherwise(extract_raw_le(data, start, length))


def motorola_start(dbc_start: Number) -> Number:
    """Sequential start of a DBC Motorola start bit."""
    if isinstance(dbc_start, int):
        return dbc_start // 8 * 8 + 7 - dbc_start % 8
    return (dbc_start / 8).cast("int") * 8 + 7 - dbc_start % 8


def signed(raw: Column, length: Number) -> Column:
    """Sign extension from `length` bits."""
    if isinstance(length, int):
        return raw if not 1 <= length < 64 else F.shiftright(F.shiftleft(raw, 64 - length), 64 - length)
    by = F.when(length.between(1, 63), 64 - length).otherwise(0)
    return F.call_function("shiftright", F.call_function("shiftleft", raw, by), by)


def unsigned_double(raw: Column) -> Column:
    """Double of a 64-bit pattern taken as unsigned."""
    half = F.shiftrightunsigned(raw, 1).bitwiseOR(raw.bitwiseAND(1)).cast("double") * 2.0
    return F.when(raw < 0, half).otherwise(raw.cast("double"))


def bits_to_double(raw: Column, width: int) -> Column:
    """IEEE float of 32 or 64 bits."""
    mantissa_bits, exponent_bits, bias = (23, 8, 127) if width == 32 else (52, 11, 1023)
    sign = F.when(F.shiftrightunsigned(raw, width - 1).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftrightunsigned(raw, mantissa_bits).bitwiseAND((1 << exponent_bits) - 1)
    fraction = raw.bitwiseAND((1 << mantissa_bits) - 1).cast("double")
    top = (1 << exponent_bits) - 1
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    normal = (fraction / float(1 << mantissa_bits) + 1.0) * power(exponent - bias)
    tiny = fraction / float(1 << mantissa_bits) * power(F.lit(1 - bias))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == top, special).when(exponent == 0, tiny).otherwise(normal)


def to_physical(raw: Column, length: Number, is_unsigned: Column | bool, value_type: Column | str, factor: Number, offset: Number) -> Column:
    """raw * factor + offset; value_type: integer, float32 (only of 32 bits) or float64 (only of 64)."""
    plain = lambda u: unsigned_double(raw) if u else signed(raw, length).cast("double")
    number = plain(is_unsigned) if isinstance(is_unsigned, bool) else F.when(is_unsigned, plain(True)).otherwise(plain(False))
    if isinstance(value_type, str) and isinstance(length, int):
        if (value_type, length) in (("float32", 32), ("float64", 64)):
            number = bits_to_double(raw, length)
    else:
        kind, n = as_column(value_type), as_column(length)
        number = F.when((kind == "float32") & (n == 32), bits_to_double(raw, 32)).when((kind == "float64") & (n == 64), bits_to_double(raw, 64)).otherwise(number)
    return number * as_column(factor) + as_column(offset)


def to_raw(value: Column, length: int, is_unsigned: bool, factor: float, offset: float, low: float | None = None, high: float | None = None) -> Column:
    """Raw value of a physical one, rounded half away from zero; unsigned values stop at 0. A factor of 0 gives null.
    Where low < high, the value is brought into that range first."""
    if not factor:
        return F.lit(None).cast("long")
    if low is not None and high is not None and low < high:
        value = F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))
    x = (value - offset) / factor
    whole = F.floor(F.abs(x) + 0.5) * F.when(x < 0, -1).otherwise(1)
    whole = F.greatest(whole, F.lit(0)) if is_unsigned else whole
    return _mask(whole.cast("long"), length)


def inject_raw(data: Column, start: int, length: int, big_endian: bool, raw: Column) -> Column:
    """The bytes with the signal's bits replaced; bits past the end of the data are dropped."""
    if not (0 <= start < 512 and 0 < length <= 64):
        return data

    def one(byte: Column, i: Column) -> Column:
        out = byte.cast("long")
        for bit in range(8):  # of this byte, from the least significant
            if big_endian:
                k = F.lit(start + length - 1) - (i * 8 + 7 - bit)  # bit of the raw value
            else:
                k = i * 8 + bit - start
            inside = k.between(0, length - 1)
            value = F.call_function("shiftrightunsigned", raw, F.greatest(F.least(k, F.lit(63)), F.lit(0))).bitwiseAND(1)
            out = F.when(inside, out.bitwiseAND(255 ^ (1 << bit)).bitwiseOR(F.shiftleft(value, bit))).otherwise(out)
        return out.cast("int")

    return F.transform(data, one)


def lin_raw(data: Column, bit_offset: Number, bit_length: Number) -> Column:
    return extract_raw_le(data, bit_offset, bit_length)


def lin_physical(raw: Column, factor: Number, offset: Number) -> Column:
    return unsigned_double(raw) * as_column(factor) + as_column(offset)


def frame_bits(bus: Column, length: Column, flags: Column) -> Column:
    """Bits on the wire, about: with a fifth more for stuffing on CAN."""
    ext = F.when(has_flag(flags, EXTENDED), 20).otherwise(0)
    fd = F.when(has_flag(flags, FD), 20).otherwise(0)
    bits = (length * 8 + 47 + ext + fd).cast("long")
    return F.when(bus == "LIN", (length * 10 + 44).cast("long")).otherwise(bits + F.floor(bits / 5))


def changed_mask(now: Column, before: Column, errors: Column) -> Column:
    """Bit i is set if byte i differs from the previous frame's, or is new; 0 for error frames and without a previous."""
    bit = lambda i: F.when(F.get(now, i).eqNullSafe(F.get(before, i)), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    mask = F.aggregate(F.sequence(F.lit(0), F.size(now) - 1), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))
    return F.when(before.isNull() | (errors != 0) | (F.size(now) == 0), 0).otherwise(mask)


def condition_holds(op: str, value: Column, threshold: Number) -> Column:
    """A comparison; a missing value never holds."""
    t = as_column(threshold)
    by = {">": value > t, "<": value < t, "==": value == t, ">=": value >= t, "<=": value <= t, "!=": value != t}
    return F.coalesce(by[op], F.lit(False))


def lin_protected_id(frame_id: Column) -> Column:
    """The six id bits with their two parity bits."""
    bit = lambda i: F.shiftright(frame_id, i).bitwiseAND(1)
    p0 = bit(0).bitwiseXOR(bit(1)).bitwiseXOR(bit(2)).bitwiseXOR(bit(4))
    p1 = F.lit(1).bitwiseXOR(bit(1).bitwiseXOR(bit(3)).bitwiseXOR(bit(4)).bitwiseXOR(bit(5)))
    return frame_id.bitwiseAND(63).bitwiseOR(F.shiftleft(p0, 6)).bitwiseOR(F.shiftleft(p1, 7))


def lin_checksum(frame_id: Column, data: Column) -> Column:
    """Enhanced checksum: the protected id and the data, carries folded in, inverted."""
    fold = lambda a, b: F.when(a + b > 255, a + b - 255).otherwise(a + b)
    return F.aggregate(data, lin_protected_id(frame_id).cast("int"), fold).bitwiseXOR(255)


def crc8_table(polynomial: int = 0x2F) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i << 1) ^ (polynomial if i & 0x80 else 0)
            i &= 0xFF
        out.append(i)
    return out


def crc8_h2f(data: Column) -> Column:
    """CRC-8 of polynomial 0x2F, start and final XOR 0xFF."""
    table = F.array(*[F.lit(x) for x in crc8_table()])
    return F.aggregate(data, F.lit(255), lambda a, b: F.get(table, a.bitwiseXOR(b))).bitwiseXOR(255)


def e2e_p2_crc(data: Column, data_id: Number) -> Column:
    """Profile 2: over the id's low and high byte, a zero, and the data from byte 1."""
    i = as_column(data_id).cast("int")
    head = F.array(i.bitwiseAND(255), F.shiftright(i, 8).bitwiseAND(255), F.lit(0))
    return crc8_h2f(F.concat(head, F.slice(data, 2, F.greatest(F.size(data) - 1, F.lit(0)))))


def e2e_p2_protect(data: Column, data_id: Number, counter: Column) -> Column:
    """The bytes with the counter in the low half of byte 1 and the CRC in byte 0."""
    counted = F.transform(data, lambda b, i: F.when(i == 1, b.bitwiseAND(0xF0).bitwiseOR(counter.bitwiseAND(15).cast("int"))).otherwise(b))
    return F.transform(counted, lambda b, i: F.when(i == 0, e2e_p2_crc(counted, data_id)).otherwise(b))


def e2e_p2_check(data: Column, data_id: Number) -> Column:
    return F.coalesce(F.get(data, 0) == e2e_p2_crc(data, data_id), F.lit(False))
