"""The streaming hourly view counts batches exactly."""

from pyspark.sql import functions as F

from tessera.streaming import telemetry


def test_batches_of_large_hours(spark, tmp_path):
    rows = spark.range(9000).select(
        F.sha2((F.col("id") % 4007).cast("string"), 256).alias("batch_id"),
        F.timestamp_seconds(F.when(F.col("id") < 6000, 10).otherwise(4000)).alias("ingested_at"),
        F.lit(0.5).alias("mean_utility"),
        F.lit(0.5).alias("health_score"),
        F.lit(False).alias("needs_healing"),
        F.lit(False).alias("deterministic_alarm"),
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = telemetry.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r.hour.minute + 60 * r.hour.hour: (r.batch_count, r.event_count) for r in spark.table("hours").collect()}
    assert sorted(got.values()) == sorted([(4007, 6000), (3000, 3000)])
