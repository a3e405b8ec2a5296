from pyspark.sql import functions as F

from gridquill.streaming.ingest import stream_chunks


def test_slices_are_emitted_behind_the_watermark(spark, tmp_path):
    t0 = 1_740_000_000
    samples = spark.createDataFrame([("m", t0 + s, float(s)) for s in (0, 30, 5000, 30_000)], "__name__ string, sec long, value double")
    samples.select("__name__", F.timestamp_seconds("sec").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("__name__ string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    query = (stream_chunks(stream, ["__name__"]).writeStream.format("parquet").outputMode("append")
             .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("__mint").collect()
    first = t0 * 1000
    assert [(r["__mint"], r["__maxt"], bytes(r["__chunk_bytes"])) for r in got] == [
        (first, first + 30_000, b"0:0.000,30000:30.000"), (first + 5_000_000, first + 5_000_000, b"0:5000.000")]
