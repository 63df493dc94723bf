"""SQL functions of the library, as expressions that Catalyst inlines; no Python runs in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators.decode import resolve_dictionary

FUNCTIONS = {
    "frame_is_error(errors INT) RETURNS BOOLEAN": "errors <> 0",
    "frame_has_flag(flags INT, bit INT) RETURNS BOOLEAN": "(flags & bit) <> 0",
    "frame_id_key(can_id BIGINT, flags INT) RETURNS BIGINT": "CASE WHEN (flags & 1) <> 0 THEN (can_id & 536870911) + 2147483648 ELSE can_id & 2047 END",
    "frame_bits(bus STRING, len INT, flags INT) RETURNS BIGINT": (
        "CASE WHEN bus = 'LIN' THEN 44 + 10 * len ELSE (47 + 8 * len + if((flags & 1) <> 0, 20, 0) + if((flags & 4) <> 0, 20, 0)) "
        "+ (47 + 8 * len + if((flags & 1) <> 0, 20, 0) + if((flags & 4) <> 0, 20, 0)) div 5 END"
    ),
    # of eight bytes at once, and the ninth, into which a signal may reach
    "frame_signal_le(bytes ARRAY<INT>, start INT, length INT) RETURNS BIGINT": (
        "(shiftrightunsigned(aggregate(reverse(slice(bytes, start div 8 + 1, 8)), 0L, (a, b) -> shiftleft(a, 8) | b), start % 8) "
        "| if(start % 8 = 0, 0L, shiftleft(CAST(coalesce(get(bytes, start div 8 + 8), 0) AS BIGINT), 64 - start % 8))) "
        "& if(length >= 64, -1L, shiftleft(1L, length) - 1)"
    ),
    "frame_signal_be(bytes ARRAY<INT>, start INT, length INT) RETURNS BIGINT": (
        "shiftrightunsigned(shiftleft(aggregate(slice(concat(bytes, array(0, 0, 0, 0, 0, 0, 0)), start div 8 + 1, 8), 0L, (a, b) -> shiftleft(a, 8) | b), start % 8) "
        "| shiftright(coalesce(get(bytes, start div 8 + 8), 0), 8 - start % 8), 64 - length)"
    ),
    "frame_signal(bytes ARRAY<INT>, start INT, length INT, big_endian BOOLEAN) RETURNS BIGINT": (
        "CASE WHEN big_endian THEN frame_signal_be(bytes, start, length) ELSE frame_signal_le(bytes, start, length) END"
    ),
    "frame_raw(bytes ARRAY<INT>, start INT, length INT, big_endian BOOLEAN, is_unsigned BOOLEAN) RETURNS BIGINT": (
        "shiftright(shiftleft(frame_signal(bytes, start, length, big_endian), if(is_unsigned, 0, 64 - length)), if(is_unsigned, 0, 64 - length))"
    ),
    "frame_holds(bytes ARRAY<INT>, start INT, length INT, is_muxed BOOLEAN, mux_value BIGINT, muxer STRUCT<start_bit: INT, length: INT, big_endian: BOOLEAN>) RETURNS BOOLEAN": (
        "start + length <= 8 * size(bytes) AND (NOT is_muxed OR coalesce(frame_signal(bytes, muxer.start_bit, muxer.length, muxer.big_endian) = mux_value, false))"
    ),
    "frame_signed(raw BIGINT, length INT) RETURNS BIGINT": "shiftright(shiftleft(raw, 64 - length), 64 - length)",
    "j1939_pgn(can_id BIGINT) RETURNS BIGINT": "if((can_id >> 16 & 255) >= 240, can_id >> 8 & 262143, can_id >> 8 & 261888)",
    "j1939_source(can_id BIGINT) RETURNS INT": "CAST(can_id & 255 AS INT)",
    "dtc_code(b0 INT, b1 INT, b2 INT) RETURNS STRING": "concat(substr('PCBU', (b0 >> 6) + 1, 1), hex(b0 >> 4 & 3), hex(b0 & 15), lpad(hex(b1), 2, '0'), '-', lpad(hex(b2), 2, '0'))",
}


#: Table functions over a dictionary, the view bus_dictionary. Parameters are named so that no column of it hides them.
TABLE_FUNCTIONS = {
    "find_message(in_network STRING, in_key BIGINT) RETURNS TABLE (message STRING, sender STRING, dlc INT)": (
        "SELECT DISTINCT d.message, d.sender, d.dlc FROM bus_dictionary d WHERE d.network = in_network AND d.raw_id = in_key"
    ),
    "lookup_signal(in_network STRING, in_signal STRING) RETURNS TABLE (raw_id BIGINT, message STRING, start_bit INT, length INT, factor DOUBLE, offset DOUBLE, unit STRING)": (
        "SELECT d.raw_id, d.message, d.start_bit, d.length, d.factor, d.offset, d.unit FROM bus_dictionary d WHERE d.network = in_network AND d.signal = in_signal"
    ),
    "message_signals(in_network STRING, in_key BIGINT) RETURNS TABLE (message STRING, signal STRING, start_bit INT, length INT, is_unsigned BOOLEAN, big_endian BOOLEAN, value_type STRING, "
    "factor DOUBLE, offset DOUBLE, is_muxed BOOLEAN, mux_value BIGINT, muxer STRUCT<start_bit: INT, length: INT, big_endian: BOOLEAN>)": (
        "SELECT d.message, d.signal, d.start_bit, d.length, d.is_unsigned, d.big_endian, d.value_type, d.factor, d.offset, d.is_muxed, d.mux_value, d.muxer "
        "FROM bus_dictionary d WHERE d.network = in_network AND d.raw_id = in_key"
    ),
    "decode_frame(in_network STRING, in_key BIGINT, in_bytes ARRAY<INT>) RETURNS TABLE (message STRING, signal STRING, raw BIGINT, value DOUBLE)": (
        "SELECT d.message, d.signal, frame_raw(in_bytes, d.start_bit, d.length, d.big_endian, d.is_unsigned), "
        "CASE WHEN d.value_type = 'integer' THEN frame_raw(in_bytes, d.start_bit, d.length, d.big_endian, d.is_unsigned) * d.factor + d.offset END "
        "FROM bus_dictionary d WHERE d.network = in_network AND d.raw_id = in_key AND frame_holds(in_bytes, d.start_bit, d.length, d.is_muxed, d.mux_value, d.muxer)"
    ),
}


def register(spark: SparkSession, dictionary: DataFrame | None = None) -> list[str]:
    """Creates the temporary functions of a session and returns their names; with a dictionary (a row per signal) its view
    bus_dictionary and the table functions over it, too. A call of these is a join with the dictionary, once Catalyst has
    inlined it: `SELECT ... FROM keyed f, LATERAL decode_frame('A', f.key, f.bytes) d`. As that one is told payloads,
    Catalyst joins each of them with the whole dictionary, and the result to the frames, so it is for few frames; of many
    take the signals of their messages, which is a join by key alone: `SELECT frame_raw(f.bytes, d.start_bit, d.length, d.big_endian, d.is_unsigned) FROM keyed f, LATERAL
    message_signals('A', f.key) d WHERE frame_holds(f.bytes, d.start_bit, d.length, d.is_muxed, d.mux_value, d.muxer)`. Values
    of float signals are null there; those of unsigned ones of 64 bits are taken as signed."""
    functions = dict(FUNCTIONS)
    if dictionary is not None:
        resolve_dictionary(dictionary).createOrReplaceTempView("bus_dictionary")
        functions |= TABLE_FUNCTIONS
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in functions]
