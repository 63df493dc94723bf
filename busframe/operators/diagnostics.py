"""Trouble codes, identifiers, services and control units from UDS messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uds import did_name, dtc_entries, dtc_status, nrc_name

UNIT = ["iface", "extended", "can_id"]


def dtcs(pdus: DataFrame, texts: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Trouble codes of all 59 02 and 59 0A answers: unit, code, status of the newest, count, text."""
    b = F.col("bytes")
    lists = pdus.filter((F.get(b, 0) == 0x59) & F.get(b, 1).isin(2, 10))
    entries = F.explode(dtc_entries(F.slice(b, 4, F.greatest(F.size(b) - 3, F.lit(0)))))
    e = lists.select(*by, *UNIT, "ts_ns", entries.alias("e")).select(*by, *UNIT, "ts_ns", "e.*")
    out = e.groupBy(*by, *UNIT, "code").agg(F.max_by("status", F.struct("ts_ns", "status")).alias("status"), F.count("*").alias("count"))
    out = out.withColumn("status_text", dtc_status(F.col("status")))
    return with_code_text(out, texts) if texts is not None else out


def with_code_text(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds `text` of a code; texts: (code, text) as read by read_code_texts."""
    return df.join(texts, "code", "left")


def did_values(pdus: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Newest value of every data identifier in positive answers: unit, did, name, data (hex), count."""
    b = F.col("bytes")
    p = pdus.filter((F.get(b, 0) == 0x62) & (F.size(b) >= 3)).withColumn("did", F.get(b, 1) * 256 + F.get(b, 2))
    data = F.array_join(F.transform(F.slice(b, 4, F.greatest(F.size(b) - 3, F.lit(0))), lambda x: F.lpad(F.hex(x), 2, "0")), "")
    out = p.groupBy(*by, *UNIT, "did").agg(F.max_by(data, F.struct("ts_ns", "frame_nos")).alias("data"), F.count("*").alias("count"))
    return out.withColumn("name", did_name(F.col("did")))


def service_support(pdus: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per unit and service: whether an answer was seen that isn't refusal 0x11."""
    b = F.col("bytes")
    sid, nrc = F.when(F.get(b, 0) == 0x7F, F.get(b, 1)).otherwise(F.get(b, 0) - 0x40), F.when(F.get(b, 0) == 0x7F, F.get(b, 2))
    answers = pdus.filter((F.get(b, 0) == 0x7F) & (F.size(b) >= 3) | (F.get(b, 0).bitwiseAND(0x40) != 0) & (F.get(b, 0) != 0x7F))
    return answers.groupBy(*by, *UNIT, sid.alias("sid")).agg(F.bool_or(nrc.isNull() | (nrc != 0x11)).alias("supported"), F.count("*").alias("answers"))


def refusals(pdus: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    b = F.col("bytes")
    p = pdus.filter((F.get(b, 0) == 0x7F) & (F.size(b) >= 3))
    return p.groupBy(*by, *UNIT, F.get(b, 1).alias("sid"), F.get(b, 2).alias("nrc")).count().withColumn("name", nrc_name(F.col("nrc")))


def uds_pairs(pdus: DataFrame, by: Sequence[str] = (), limit_ns: int = 2_000_000_000) -> DataFrame:
    """11-bit answers with the request they answer: at most 2 s before, same interface and service, another id; the id
    8 below first, else the newest. A request may answer several (batch form: requests aren't consumed).

    A range join by buckets of the limit: a request is in its own and the next bucket, an answer in its own."""
    b = F.col("bytes")
    p = pdus.filter("not extended and bus = 'CAN'").withColumn("first", F.get(b, 0))
    answer = p.filter((F.col("first").bitwiseAND(0x40) != 0)).withColumn("sid", F.when(F.col("first") == 0x7F, F.get(b, 1)).otherwise(F.col("first") - 0x40))
    request = p.filter(F.col("first").bitwiseAND(0x40) == 0).withColumn("sid", F.col("first"))
    bucket = F.floor(F.col("ts_ns") / limit_ns)
    frame = F.array_min("frame_nos")
    a = answer.select(*by, "iface", "sid", bucket.alias("bucket"), F.col("can_id").alias("rx_id"), F.col("ts_ns").alias("answer_ns"), frame.alias("answer_no"))
    r = request.select(*by, "iface", "sid", F.explode(F.array(bucket, bucket + 1)).alias("bucket"), F.col("can_id").alias("tx_id"), F.col("ts_ns").alias("request_ns"), frame.alias("request_no"))
    j = a.join(r, [*by, "iface", "sid", "bucket"]).filter("tx_id <> rx_id and request_ns <= answer_ns").filter(F.col("answer_ns") - F.col("request_ns") <= limit_ns)
    best = F.max_by(F.struct("tx_id", "request_ns", "request_no"), F.struct(F.col("tx_id") == F.col("rx_id") - 8, "request_ns", "request_no"))
    out = j.groupBy(*by, "iface", "sid", "rx_id", "answer_ns", "answer_no").agg(best.alias("x"))
    return out.select(*by, "iface", "sid", "rx_id", "answer_ns", "answer_no", "x.*")


def ecus(pdus: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Control units: iface, extended, rx_id, tx_id, guessed. 29-bit answers give both addresses; an 11-bit pair whose
    request went to everyone (0x7DF) is a guess, 8 below the answer; an exact id replaces a guess."""
    pairs = uds_pairs(pdus, by)
    everyone = F.col("tx_id") == 0x7DF
    short = pairs.select(
        *by, "iface", F.lit(False).alias("extended"), "rx_id", F.when(everyone, F.col("rx_id") - 8).otherwise(F.col("tx_id")).alias("tx_id"), everyone.alias("guessed"),
        F.col("answer_ns").alias("ts_ns"), F.col("answer_no").alias("no"),
    )
    i = F.col("can_id")
    swapped = F.lit(0x18DA0000) + F.shiftleft(i.bitwiseAND(255), 8) + F.shiftright(i, 8).bitwiseAND(255)
    answers = pdus.filter(F.col("extended") & (F.get("bytes", 0).bitwiseAND(0x40) != 0) & (F.shiftright(i, 16) == 0x18DA))
    long = answers.select(*by, "iface", F.lit(True).alias("extended"), i.alias("rx_id"), swapped.alias("tx_id"), F.lit(False).alias("guessed"), "ts_ns", F.array_min("frame_nos").alias("no"))
    every = short.unionByName(long)
    best = F.min_by(F.struct("tx_id", "guessed"), F.struct("guessed", "ts_ns", "no"))
    return every.groupBy(*by, "iface", "extended", "rx_id").agg(best.alias("x")).select(*by, "iface", "extended", "rx_id", "x.*")


def protocol_monitor(messages: DataFrame) -> DataFrame:
    """Newest message per (interface, group, source) or (interface, frame id, service): count, time, time before."""
    keys = ["protocol", "iface", "id", "sa", "can_id"]
    before = F.lag("ts_ns").over(Window.partitionBy(*keys).orderBy("ts_ns", "frame_nos"))
    m = messages.withColumn("before", before)
    newest = F.max_by(F.struct("ts_ns", "before", "name", "payload", "description"), F.struct("ts_ns", "frame_nos"))
    return m.groupBy(*keys).agg(F.count("*").alias("count"), newest.alias("x")).select(*keys, "count", "x.*")


def _number(part: Column) -> Column:
    """Big-endian number of one to four bytes."""
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 8).bitwiseOR(b.cast("long")))


def dtc_records(pdus: DataFrame, layouts: DataFrame) -> DataFrame:
    """Fields of the extended-data (59 06) and snapshot (59 04) records of an answer, by layout: unit, ts_ns, code, kind,
    record, field, value.

    layouts: (kind ext or snap, record, seq, name, size, scale, offset) as read by read_dtc_fields. Extended records are
    chained: each record number is followed by the bytes of its layout; a record without a layout ends the chain. A
    snapshot is (record, count, identifier and data...): its identifiers are chained the same way."""
    totals = layouts.groupBy("kind", "record").agg(F.sum("size").cast("int").alias("total"))
    sizes = totals.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("record", "total"))).alias("sizes"))
    b = F.col("bytes")
    p = pdus.filter((F.get(b, 0) == 0x59) & F.get(b, 1).isin(4, 6) & (F.size(b) >= 7))
    p = p.withColumn("kind", F.when(F.get(b, 1) == 6, "ext").otherwise("snap")).join(F.broadcast(sizes), "kind")  # two rows of layouts
    code = F.get(dtc_entries(F.slice(b, 3, 4)), 0)["code"]
    start = F.when(F.col("kind") == "ext", 6).otherwise(8)  # a snapshot's record number and count stand before
    head = F.when(F.col("kind") == "ext", 1).otherwise(2)
    key = lambda at: F.when(F.col("kind") == "ext", F.get(b, at)).otherwise(F.get(b, at) * 256 + F.get(b, at + 1))
    step_type = "struct<at:int,out:array<struct<record:int,at:int>>>"
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<record:int,at:int>>").alias("out")).cast(step_type)

    def step(acc: Column, _: Column) -> Column:
        k = key(acc["at"])
        total = F.try_element_at(F.col("sizes"), k)
        ok = total.isNotNull() & (acc["at"] >= 0) & (acc["at"] + head + total <= F.size(b))
        more = F.concat(acc["out"], F.array(F.struct(k.cast("int").alias("record"), (acc["at"] + head).cast("int").alias("at"))))
        go = F.struct((acc["at"] + head + total).cast("int").alias("at"), more.alias("out")).cast(step_type)
        return F.when(ok, go).otherwise(F.struct(F.lit(-1).alias("at"), acc["out"].alias("out")).cast(step_type))

    chain = F.aggregate(F.sequence(F.lit(1), F.size(b)), zero, step)["out"]
    rows = p.select(*UNIT, "ts_ns", "kind", code.alias("code"), "bytes", F.explode(chain).alias("r")).select(*UNIT, "ts_ns", "kind", "code", "bytes", "r.*")
    before = F.sum("size").over(Window.partitionBy("kind", "record").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    fields = layouts.withColumn("skip", F.coalesce(before, F.lit(0)).cast("int"))
    j = rows.join(fields, ["kind", "record"])
    value = _number(F.slice("bytes", F.col("at") + F.col("skip") + 1, F.col("size"))) * F.col("scale") + F.col("offset")
    return j.select(*UNIT, "ts_ns", "code", "kind", "record", F.col("name").alias("field"), value.alias("value"))
