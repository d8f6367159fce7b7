"""Streams run to the end of what is there, returned as tables; their batch twins are their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.session import shared_dir, table


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """The final rows of a stream, written to the shared folder batch by batch."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # A complete result replaces the last one; appended batches have a folder each, so a batch that runs again is written once.
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _route_files(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "master_elite_routes_full").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/master_elite_routes_full.parque*")


def live_routes_stream(spark: SparkSession, d: str) -> DataFrame:
    """Routes, legs and the best score by country count, kept up to date over growing files."""
    valid = F.when(F.col("rqi_score").isNotNull() & ~F.isnan("rqi_score"), F.col("rqi_score"))
    best = _route_files(spark, d).groupBy("total_countries").agg(F.count("*").alias("routes"), F.max(valid).alias("best"), F.sum("total_legs").alias("legs"))
    return _drained(best, "complete")


def live_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by six-hour window and type."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque*")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = timed.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("events"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return _drained(counts.select(F.unix_seconds("window.start").alias("start"), "event_type", "events", "cents"), "complete")


QUERIES = {f.__name__: f for f in (live_routes_stream, live_event_windows)}
SQL = {
    "live_event_windows": "select cast(floor(epoch(ts) / 21600) * 21600 as bigint) as start, event_type, count(*) as events, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents from events group by all",
    "live_routes_stream": "select total_countries, count(*) as routes, max(case when not isnan(rqi_score) then rqi_score end) as best, cast(sum(total_legs) as bigint) as legs from master_elite_routes_full group by total_countries",
}
