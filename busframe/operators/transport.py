"""Protocol messages from frames: one reassembly in window functions, three protocols.

Every protocol has the shape opener, followers in order, enough bytes, cut. Frames that play no role are dropped before
the windows. A session key is (log, interface, direction, addresses); add a column that tells logs or vehicles apart to
`by` when several are read at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import has_flag, is_error
from ..functions.j1939 import j1939_fields, pgn_name
from ..functions.n2k import N2K_FAST, N2K_SINGLE, n2k_description
from ..functions.uds import nrc_name, service_name, uds_describe, uds_describe_request
from ..schema import EXTENDED, RTR, TX, settled, to_binary
from . import scan

OPEN, CLOSE, FOLLOW = 1, 2, 0


def reassemble(
    rows: DataFrame, keys: Sequence[str], *, ordinal_ok: Callable[[Column, Column], Column], enough: Callable[[Column, Column, Column], Column],
    size: Callable[[Column], Column], on_opener: bool = False, by: Sequence[str] = (),
) -> DataFrame:
    """Messages of rows (keys..., ts_ns, frame_no, role, head, ordinal, chunk): keys, the opener's head and ts_ns,
    payload array<int>, frame_nos.

    ordinal_ok(n, row) tests the n-th follower, enough(n, bytes, head) whether a message is complete, size(head) where
    its payload is cut. Segments begin at openers and closers; what follows the completing frame is an orphan. keys begin
    with those of `by`, the others hold no nulls. Openers are counted in ranges of time with the counts of those before
    carried over, so that a session that is always busy spreads over many tasks, and a message may span ranges."""
    cut, own = scan.cut(rows, keys[len(by) :], by, "ts_ns", scan.RANGE_NS)
    # closers are counted and then dropped: what follows one has no opener, and needs none of its columns
    cut = cut.withColumns({"head": F.when(F.col("role") == OPEN, F.col("head")), "chunk": F.when(F.col("role") != CLOSE, F.col("chunk"))})
    rows = scan.running(cut, own, ["ts_ns", "frame_no"], {"seg": (F.col("role") != FOLLOW).cast("int")}).filter((F.col("seg") > 0) & (F.col("role") != CLOSE))
    inside = Window.partitionBy(*keys, "seg").orderBy("ts_ns", "frame_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "n": F.row_number().over(inside) - 1, "first": F.first(F.struct("role", "head", "ts_ns", "ordinal")).over(upto),
        "bytes_so_far": F.sum(F.size("chunk")).over(upto),
    })
    wrong = (F.col("n") > 0) & ~ordinal_ok(F.col("n"), F.col("first.ordinal"))
    rows = rows.withColumn("bad", F.max(wrong.cast("int")).over(upto)).filter((F.col("bad") == 0) & (F.col("first.role") == OPEN))
    done = enough(F.col("n"), F.col("bytes_so_far"), F.col("first.head")) & (F.lit(on_opener) | (F.col("n") > 0))
    rows = rows.withColumn("done", done.cast("int"))
    rows = rows.withColumn("over", F.coalesce(F.sum("done").over(before), F.lit(0))).filter("over = 0")
    parts = rows.groupBy(*keys, "seg").agg(
        F.max("done").alias("done"), F.first("first").alias("first"), F.sort_array(F.collect_list(F.struct("n", "chunk", "frame_no"))).alias("parts")
    )
    whole = F.flatten(F.transform("parts", lambda p: p["chunk"]))
    return parts.filter("done = 1").select(
        *keys, F.col("first.head").alias("head"), F.col("first.ts_ns").alias("ts_ns"),
        F.slice(whole, 1, F.greatest(size(F.col("first.head")), F.lit(0))).alias("bytes"), F.transform("parts", lambda p: p["frame_no"]).alias("frame_nos"),
    )


def _usable(frames: DataFrame) -> DataFrame:
    return frames.filter(~is_error(F.col("errors")) & ~has_flag(F.col("flags"), RTR))


def _tx(frames: DataFrame) -> DataFrame:
    return frames.withColumn("tx", has_flag(F.col("flags"), TX)).withColumn("extended", has_flag(F.col("flags"), EXTENDED))


def uds_pdus(frames: DataFrame, addr_ext: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """ISO-TP messages of CAN and LIN diagnostic frames: by..., iface, tx, extended, can_id, address, ts_ns, bytes,
    frame_nos.

    29-bit ids take part with PF 0xDA and 0xDB only. A valid single frame also ends an open session; flow control,
    malformed single frames and first frames without a valid service leave it alone."""
    f = _tx(_usable(frames))
    pf = F.shiftrightunsigned("can_id", 16).bitwiseAND(255)
    can = f.filter((F.col("bus") == "CAN") & (~F.col("extended") | pf.isin(0xDA, 0xDB)))
    lin = f.filter((F.col("bus") == "LIN") & F.col("can_id").bitwiseAND(63).isin(0x3C, 0x3D) & (F.size("bytes") >= 3))
    skip = 1 if addr_ext else 0
    can = can.withColumns({"address": F.get("bytes", 0) if addr_ext else F.lit(0), "b": F.slice("bytes", 1 + skip, F.greatest(F.size("bytes") - skip, F.lit(0)))})
    lin = lin.withColumns({"address": F.lit(0), "b": F.slice("bytes", 2, F.greatest(F.size("bytes") - 1, F.lit(0))), "can_id": F.lit(0).cast("long")})
    keys = [*by, "bus", "iface", "tx", "extended", "can_id", "address"]
    rows = can.unionByName(lin).select(*keys, "ts_ns", "frame_no", "b")
    # each column below is computed once, not in every place that uses it
    rows = settled(rows, *keys, "ts_ns", "frame_no", b=F.col("b"), n=F.size("b")).filter("n > 0")
    byte = lambda i: F.coalesce(F.get("b", F.lit(i) if isinstance(i, int) else i), F.lit(0))
    rows = settled(rows, *keys, "ts_ns", "frame_no", "b", "n", **{f"b{i}": byte(i) for i in range(6)})
    rows = settled(rows, *keys, "ts_ns", "frame_no", "b", "n", *[f"b{i}" for i in range(1, 6)], kind=F.shiftright("b0", 4), low=F.col("b0").bitwiseAND(15))
    at = lambda i: F.col(f"b{i}") if isinstance(i, int) else byte(i)
    n, kind, low = F.col("n"), F.col("kind"), F.col("low")
    long_single = (low == 0) & (n > 1)
    single_size, single_at = F.when(long_single, at(1)).otherwise(low), F.when(long_single, 2).otherwise(1)
    single = (kind == 0) & (single_size > 0) & (single_at + single_size <= n) & (at(single_at) >= 0x10)
    size12 = F.shiftleft(low, 8).bitwiseOR(at(1)).cast("long")
    long_first = (size12 == 0) & (n >= 6)
    size32 = F.shiftleft(at(2).cast("long"), 24) + F.shiftleft(at(3), 16) + F.shiftleft(at(4), 8) + at(5)
    first_size, first_at = F.when(long_first, size32).otherwise(size12), F.when(long_first, 6).otherwise(2)
    first = (kind == 1) & (first_at < n) & (at(first_at) >= 0x10)
    rows = settled(rows, *keys, "ts_ns", "frame_no", "b", "n", "low", "kind", single=single, first=first, single_at=single_at, first_at=first_at, single_size=single_size, size=first_size)
    role = F.when(F.col("single"), CLOSE).when(F.col("first"), OPEN).when(kind == 2, FOLLOW)
    start = F.when(F.col("single"), F.col("single_at")).when(F.col("first"), F.col("first_at")).otherwise(1)
    count = F.when(F.col("single"), F.col("single_size")).otherwise(n - start)
    rows = settled(rows, *keys, "ts_ns", "frame_no", "b", "low", "size", role=role, start=start, count=F.greatest(count, F.lit(0))).filter("role is not null")
    rows = settled(rows, *keys, "ts_ns", "frame_no", "role", ordinal=F.col("low"), size=F.col("size"), chunk=F.slice("b", F.col("start") + 1, F.col("count")))
    rows = rows.withColumn("head", F.struct("size", F.size("chunk").alias("opened")))
    several = reassemble(
        rows.withColumn("ordinal", F.col("ordinal").cast("int")), keys, ordinal_ok=lambda n, _: F.col("ordinal") == n % 16,
        enough=lambda n, have, head: have >= head["size"], size=lambda head: F.greatest(head["size"], head["opened"].cast("long")).cast("int"), by=by,
    ).drop("head")
    alone = rows.filter(F.col("role") == CLOSE).select(*keys, "ts_ns", F.col("chunk").alias("bytes"), F.array("frame_no").alias("frame_nos"))
    return several.unionByName(alone).filter(F.size("bytes") > 0)


def uds_messages(frames: DataFrame, addr_ext: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """UDS messages with service, type and description."""
    p = uds_pdus(frames, addr_ext, by)
    sid = F.get("bytes", 0)
    kind = F.when(sid == 0x7F, "negative").when(sid.bitwiseAND(0x40) != 0, "positive").otherwise("request")
    nrc = F.when(F.size("bytes") >= 3, F.concat(F.lit("negative response: "), nrc_name(F.get("bytes", 2)))).otherwise("negative response: incomplete")
    text = F.when(sid == 0x7F, nrc).when(sid.bitwiseAND(0x40) != 0, uds_describe(F.col("bytes"))).otherwise(uds_describe_request(F.col("bytes")))
    meta = F.when(F.col("extended"), F.create_map(F.lit("Source Address"), F.col("can_id").bitwiseAND(255), F.lit("Target Address"), F.shiftright("can_id", 8).bitwiseAND(255)))
    return p.select("*", F.lit("uds").alias("protocol"), sid.cast("long").alias("id"), service_name(sid).alias("name"), kind.alias("type"),
                    text.alias("description"), to_binary(F.col("bytes")).alias("payload"), meta.cast("map<string,bigint>").alias("metadata"))


def j1939_pdus(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """J1939 messages: by..., iface, tx, sa, da, pgn, priority, ts_ns, bytes, frame_nos, transport. A transport session
    ends at an abort, and completes with the announced packets or bytes."""
    f = _tx(_usable(frames)).filter(F.col("extended") & (F.col("bus") == "CAN"))
    f = settled(f, *by, "iface", "tx", "ts_ns", "frame_no", bytes=F.col("bytes"), j=j1939_fields(F.col("can_id"))).select(*by, "iface", "tx", "ts_ns", "frame_no", "bytes", "j.*")
    at = lambda i: F.coalesce(F.get("bytes", i), F.lit(0)).cast("long")
    n = F.size("bytes")
    cm, dt = F.col("pgn") == 0xEC00, F.col("pgn") == 0xEB00
    role = F.when(cm & (n >= 8) & at(0).isin(32, 16), OPEN).when(cm & (n >= 8) & (at(0) == 255), CLOSE).when(dt, FOLLOW)
    head = F.struct(
        (at(5) + at(6) * 256 + at(7) * 65536).alias("pgn"), (at(1) + at(2) * 256).alias("size"), at(3).alias("packets"), F.col("priority")
    )
    keys = [*by, "iface", "tx", "sa", "ps"]
    chunk = F.when(dt, F.slice("bytes", 2, F.greatest(F.least(n, F.lit(8)) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    ordinal = F.when(n < 1, -1).otherwise(at(0)).cast("int")
    rows = f.select(*keys, "ts_ns", "frame_no", role.alias("role"), head.alias("head"), chunk.alias("chunk"), ordinal.alias("ordinal")).filter("role is not null")
    several = reassemble(
        rows, keys, ordinal_ok=lambda n, _: F.col("ordinal") == n % 256, enough=lambda n, have, head: (n >= head["packets"]) | (have >= head["size"]),
        size=lambda head: head["size"].cast("int"), by=by,
    )
    several = several.select(*keys, F.col("head.pgn").alias("pgn"), F.col("head.priority").alias("priority"), "ts_ns", "bytes", "frame_nos", F.lit(True).alias("transport"))
    single = f.filter(~cm & ~dt & ~F.col("pf").isin(0xDA, 0xDB))
    single = single.select(*keys, "pgn", "priority", "ts_ns", "bytes", F.array("frame_no").alias("frame_nos"), F.lit(False).alias("transport"))
    return several.unionByName(single).withColumnRenamed("ps", "da")


def j1939_messages(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p = j1939_pdus(frames, by)
    name = p.withColumn("name", pgn_name(F.col("pgn")))
    pf = F.shiftright("pgn", 8).bitwiseAND(255)
    low = lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))
    one = F.concat(F.lit("PDU1 (Peer-to-Peer) from SA [0x"), low("sa"), F.lit("] to DA [0x"), low("da"), F.lit("]"))
    text = F.when(F.col("transport"), "").when(pf < 240, one).otherwise(F.concat(F.lit("PDU2 (Broadcast) from SA [0x"), low("sa"), F.lit("]")))
    return name.select("*", F.lit("J1939").alias("protocol"), F.lit("request").alias("type"), text.alias("description"), to_binary(F.col("bytes")).alias("payload"))


def n2k_pdus(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """NMEA 2000 messages: by..., iface, tx, pgn, sa, priority, ts_ns, bytes, frame_nos. Fast packets by list and by the
    proprietary range."""
    f = _tx(_usable(frames)).filter(F.col("extended") & (F.col("bus") == "CAN"))
    f = settled(f, *by, "iface", "tx", "ts_ns", "frame_no", bytes=F.col("bytes"), j=j1939_fields(F.col("can_id"))).select(*by, "iface", "tx", "ts_ns", "frame_no", "bytes", "j.*").filter("pgn >= 65536")
    fast = F.col("pgn").isin(*N2K_FAST) | F.col("pgn").between(130816, 131071)
    keys = [*by, "iface", "tx", "pgn", "sa"]
    at = lambda i: F.coalesce(F.get("bytes", i), F.lit(0))
    opener = at(0).bitwiseAND(0x1F) == 0
    n = F.size("bytes")
    role = F.when(n < 1, None).when(~opener, FOLLOW).when(n >= 2, OPEN)
    skip = F.when(opener, 2).otherwise(1)
    rows = f.filter(fast).select(
        *keys, "ts_ns", "frame_no", role.alias("role"), F.struct(at(1).alias("size"), "priority").alias("head"),
        F.slice("bytes", skip + 1, F.greatest(n - skip, F.lit(0))).alias("chunk"), at(0).alias("ordinal"),
    ).filter("role is not null")
    several = reassemble(
        rows, keys, ordinal_ok=lambda n, first: F.col("ordinal") == (first + n) % 256, enough=lambda n, have, head: have >= head["size"],
        size=lambda head: head["size"], on_opener=True, by=by,
    )
    several = several.select(*keys, F.col("head.priority").alias("priority"), "ts_ns", "bytes", "frame_nos")
    return several.unionByName(f.filter(~fast).select(*keys, "priority", "ts_ns", "bytes", F.array("frame_no").alias("frame_nos")))


def n2k_messages(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in ({**N2K_SINGLE, **N2K_FAST}).items() for x in pair])
    name = F.coalesce(F.try_element_at(names, F.col("pgn").cast("int")), F.concat(F.lit("PGN "), F.col("pgn")))
    p = n2k_pdus(frames, by)
    return p.select("*", F.lit("N2K").alias("protocol"), name.alias("name"), F.lit("request").alias("type"),
                    n2k_description(F.col("pgn"), F.col("bytes")).alias("description"), to_binary(F.col("bytes")).alias("payload"))


def protocol_messages(frames: DataFrame, addr_ext: bool = False, described: bool = True) -> DataFrame:
    """All messages: iface, tx, protocol, id, name, type, ts_ns, sa, can_id, payload, frame_nos, description. Extended
    frames go to J1939 (UDS for PF 0xDA, 0xDB), and beside it to NMEA 2000; others to UDS.

    described False leaves out name, type, payload and description: their expressions are most of the plan, which the
    driver holds in all of its forms even where they aren't read."""
    long = lambda c: F.col(c).cast("long")
    none = F.lit(None).cast("long")
    if not described:
        plain = lambda pdus, protocol, number, sa, can_id: pdus.select(
            "iface", "tx", F.lit(protocol).alias("protocol"), number.cast("long").alias("id"), "ts_ns", sa.alias("sa"), can_id.alias("can_id"), "frame_nos"
        )
        u = plain(uds_pdus(frames, addr_ext), "uds", F.get("bytes", F.lit(0)), none, long("can_id"))
        j = plain(j1939_pdus(frames), "J1939", F.col("pgn"), long("sa"), none)
        return u.unionByName(j).unionByName(plain(n2k_pdus(frames), "N2K", F.col("pgn"), long("sa"), none))
    tail = ["payload", "frame_nos", "description"]
    u = uds_messages(frames, addr_ext).select("iface", "tx", "protocol", "id", "name", "type", "ts_ns", none.alias("sa"), long("can_id").alias("can_id"), *tail)
    j = j1939_messages(frames).select("iface", "tx", "protocol", long("pgn").alias("id"), "name", "type", "ts_ns", long("sa").alias("sa"), none.alias("can_id"), *tail)
    n = n2k_messages(frames).select("iface", "tx", "protocol", long("pgn").alias("id"), "name", "type", "ts_ns", long("sa").alias("sa"), none.alias("can_id"), *tail)
    return u.unionByName(j).unionByName(n)


def isotp_segment(pdus: DataFrame, capacity: int = 8, padding: int | None = 0xCC) -> DataFrame:
    """Frames of PDUs with a BINARY payload, which is replaced by chunk (0, 1...) and bytes: single frames, or first and
    consecutive ones. padding None leaves frames short; frames beyond 8 bytes are for CAN FD and not padded to a code."""
    n = F.expr("length(payload)")
    alone_room = capacity - 1 if capacity <= 8 else capacity - 2
    big = n > 4095
    first_room = F.when(big, capacity - 6).otherwise(capacity - 2)
    rest = n - first_room
    count = F.when(n <= alone_room, 0).otherwise(F.ceil(rest / (capacity - 1)).cast("int"))
    out = pdus.withColumn("n", n).filter("n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), count)))
    n = F.col("n")
    alone_room, big = capacity - 1 if capacity <= 8 else capacity - 2, n > 4095
    first_room = F.when(big, capacity - 6).otherwise(capacity - 2)
    b = lambda c: F.lpad(F.hex(c), 2, "0")
    # bytes are cut out of the BINARY, which reaches any place at once; a text would be walked from its start for each chunk
    cut = lambda at, size: F.hex(F.substring("payload", at + 1, size))
    short = F.when(n <= 7, b(n)).otherwise(F.concat(F.lit("00"), b(n))) if capacity > 8 else b(n)
    alone = F.concat(short, F.hex("payload"))
    head = F.when(big, F.concat(F.lit("1000"), F.lpad(F.hex(n), 8, "0"))).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(n), 3, "0")))
    first = F.concat(head, cut(F.lit(0), first_room))
    more = F.concat(b(F.lit(0x20) + F.col("chunk") % 16), cut(first_room + (F.col("chunk") - 1) * (capacity - 1), F.lit(capacity - 1)))
    line = F.when(n <= alone_room, alone).when(F.col("chunk") == 0, first).otherwise(more)
    if padding is not None and capacity <= 8:
        line = F.rpad(line, capacity * 2, f"{padding:02X}")
    from ..schema import hex_bytes

    keep = [c for c in out.columns if c not in ("n", "payload")]
    return settled(settled(out, *keep, line=line), *keep, bytes=hex_bytes(F.col("line")))
