from pyspark.sql import functions as F

from brightloom.sources import ingest
from brightloom.streaming import rollups


def rows(spark, path):
    data = [(1, 7, t * 1_000_000_000, t, f"line {t % 5}", {}, {"app": "x"}, {}) for t in range(6000, 6600, 7)]
    df = spark.createDataFrame(data, "team_id long, stream_id long, ts_ns long, observed_ns long, line string, fields map<string,string>, labels map<string,string>, resource_attributes map<string,string>")
    df.unionByName(df.limit(10)).repartition(3).write.parquet(path)
    return df


def test_rollup_of_a_stream_equals_that_of_a_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    once = rows(spark, source)
    stream = spark.readStream.schema(once.schema).parquet(source)
    kept = rollups.without_retries(stream)
    q = kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/c1").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("kept").count() == once.count()
    q = rollups.minute_stats(stream).writeStream.format("memory").queryName("stats").option("checkpointLocation", f"{tmp_path}/c2").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = ingest.log_stats(spark.read.parquet(source)).orderBy("bucket_ms").collect()
    assert [tuple(r) for r in spark.table("stats").orderBy("bucket_ms").collect()] == [tuple(r) for r in want]


def test_fan_out_is_idempotent(spark, tmp_path):
    df = rows(spark, f"{tmp_path}/in")
    write = rollups.fan_out_writer(f"{tmp_path}/out")
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(f"{tmp_path}/out/logs").count() == df.count() and spark.read.parquet(f"{tmp_path}/out/streams").count() == 1
    assert spark.read.parquet(f"{tmp_path}/out/stats").agg(F.sum("log_count")).first()[0] == df.count()
