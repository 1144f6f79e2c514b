import tempfile

from pyspark.sql import functions as F

from depthkit.sinks import write_report, write_table
from depthkit.streaming import clean_stream


def test_clean_stream_on_a_stream(spark):
    d = tempfile.mkdtemp(prefix="stream-")
    spark.createDataFrame([(1, 100.0, -999.25, 2.0), (1, 101.0, 400.0, 2.5)], "well_api long, DEPTH double, GR double, RHOB double") \
        .write.mode("overwrite").parquet(d + "/in")
    src = spark.readStream.schema("well_api long, DEPTH double, GR double, RHOB double").parquet(d + "/in")
    q = clean_stream(src, ["GR", "RHOB"]).writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from cleaned order by DEPTH").collect()
    assert rows[0]["GR"] is None and rows[1]["GR"] == 250.0 and rows[1]["is_shale"] == 1


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="sink-")
    df = spark.range(10).select(F.col("id").alias("well_api"), (F.col("id") * 1.5).alias("GR"))
    write_table(df, d + "/master", partition_by="well_api")
    write_report(df.groupBy().count(), d + "/summary")
    assert spark.read.parquet(d + "/master").count() == 10
    assert spark.read.json(d + "/summary").first()["count"] == 10
