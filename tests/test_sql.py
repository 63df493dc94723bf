from busframe import sql
from busframe.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_functions_in_sql(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    fx.frames_from_events(spark, SF).createOrReplaceTempView("frames")
    row = spark.sql("""
        SELECT count(*) AS n, sum(frame_signal_le(bytes, 0, 16)) AS raw, sum(frame_bits(bus, len, flags)) AS bits, count_if(frame_is_error(errors)) AS errors,
               min(frame_id_key(can_id, flags)) AS low, j1939_pgn(419361024L) AS pgn, j1939_source(419361029L) AS sa, dtc_code(193, 85, 16) AS dtc, frame_signed(32768L, 16) AS neg,
               count_if(frame_has_flag(flags, 16)) AS tx
        FROM frames""").first()
    want = spark.read.parquet(f"{SF}/events.parquet").selectExpr("count(*)", "sum(cast(round(value * 100) as bigint))", "count_if(event_type = 'error' and event_id % 5 = 0)", "count_if(event_id % 7 = 0)").first()
    assert (row.n, row.raw, row.errors, row.tx) == tuple(want) and row.bits == row.n * 133 and row.low >= 256
    assert (row.pgn, row.sa, row.dtc, row.neg) == (419361024 >> 8 & 0x3FFFF, 419361029 & 255, "U0155-10", -32768)


def test_table_functions(spark):
    assert len(sql.register(spark, fx.event_dictionary(spark))) == len(sql.FUNCTIONS) + len(sql.TABLE_FUNCTIONS)
    one = spark.sql("SELECT * FROM find_message('A', 256)").collect()
    assert [(r.message, r.dlc) for r in one] == [("Ev256", 8)]
    assert spark.sql("SELECT * FROM lookup_signal('B', 'Speed')").count() == 40
    plan = spark.sql("SELECT d.* FROM VALUES (256L, array(1, 2, 3, 4, 5, 6, 7, 8)) AS f(k, b), LATERAL decode_frame('A', f.k, f.b) d")
    assert {r.signal: r.raw for r in plan.collect()}["Speed"] == 0x0201
    assert "Join" in plan._jdf.queryExecution().optimizedPlan().toString() or "LocalRelation" in plan._jdf.queryExecution().optimizedPlan().toString()
