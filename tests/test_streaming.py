from pyspark.sql import functions as F

from tidebar.streaming.bars import closed_bars, latched_states

PRINTS = "series_id string, ts timestamp, trade_id long, price double, quantity double"


def drained(query, spark, name):
    query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_closed_bars_leave_out_the_open_one_and_late_prints(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{m}:{s:02d}", 10 * m + s, 10.0 + m + s / 100, 1.0) for m in range(5) for s in (1, 30, 59)]
    first = spark.createDataFrame(rows, "series_id string, t string, trade_id long, price double, quantity double").withColumn("ts", F.to_timestamp("t")).select("series_id", "ts", "trade_id", "price", "quantity")
    late = spark.createDataFrame([("a", "2024-01-01 00:00:10", 999, 99.0, 5.0), ("a", "2024-01-01 00:09:00", 1000, 1.0, 1.0)], "series_id string, t string, trade_id long, price double, quantity double").withColumn("ts", F.to_timestamp("t")).select("series_id", "ts", "trade_id", "price", "quantity")
    path = str(tmp_path / "in")
    first.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(PRINTS).option("maxFilesPerTrigger", 1).parquet(path)
    query = closed_bars(stream, 1, "30 seconds").writeStream.format("memory").queryName("closed").outputMode("append").start()
    query.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(path)
    got = sorted(drained(query, spark, "closed"))
    assert [g[1] // 60000 % 60 for g in got] == [0, 1, 2, 3, 4]
    assert all(g[7] == 3.0 and g[8] == 3 for g in got) and got[0][3:7] == (10.01, 10.59, 10.01, 10.59)


def test_latched_states_carry_over_batches_and_reset_at_gaps(spark, tmp_path):
    closes = [5, 4, 5, 6, 5, 4, 4.5, 5]
    volumes = [1, 1, 2, 1, 1, 1, 3, 1]
    bars = [("a", (i + 1) * 60000, float(c), float(v)) for i, (c, v) in enumerate(zip(closes, volumes))] + [("a", 60000 * 20, 1.0, 1.0)]
    path = str(tmp_path / "bars")
    ddl = "series_id string, ct long, close double, volume double"
    for part in (bars[:4], bars[4:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    query = latched_states(stream, 60000).writeStream.format("memory").queryName("latched").outputMode("append").start()
    got = {ct // 60000: (state, turn) for _, ct, state, turn in drained(query, spark, "latched")}
    assert got[3] == (1, 1) and got[4] == (1, 0) and got[5] == (-2, -1) and got[7] == (1, 1) and got[20] == (0, 0)
