from __future__ import annotations

from tidewater.streaming.rollups import rollup

EVENTS = "ts timestamp, event_type string, value double"


def test_stream_drops_late_rows_and_closes_windows(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([], EVENTS).write.parquet(source)
    query = rollup(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source))
    run = query.writeStream.outputMode("append").format("memory").queryName("rollups").option("checkpointLocation", f"{tmp_path}/state").start()
    for hours in (["00:10", "00:50"], ["03:00"], ["00:20", "05:00"]):
        rows = [(h, "click", 1.0) for h in hours]
        spark.createDataFrame(rows, "h string, event_type string, value double").selectExpr("cast(concat('2024-01-01 ', h, ':00') as timestamp) as ts", "event_type", "value").coalesce(1).write.mode("append").parquet(source)
        run.processAllAvailable()
    run.stop()
    assert [(r.start.hour, r.n) for r in spark.table("rollups").orderBy("start").collect()] == [(0, 2), (3, 1)]


def test_table_gives_the_same_rollup(spark):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT NULL, 'a', 1.0D")
    assert [(r.event_type, r.n, r.total) for r in rollup(rows).collect()] == [("a", 1, 2.0)]
