"""Live routes and half-searches as streams over growing folders."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from itinera.functions.transit import ROUTE_TYPE
from itinera.sources.sinks import exists


def route_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Route lines as they are appended: score, route, seen (when the file was written)."""
    lines = spark.readStream.schema(f"score int, route {ROUTE_TYPE}").option("maxFilesPerTrigger", files_at_once).json(folder)
    return lines.where("route is not null").withColumn("seen", F.col("_metadata.file_modification_time"))


def distinct_live(routes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each route once while its state lasts: equal paths within the watermark are dropped."""
    path = F.md5(F.to_json("route"))
    return routes.withColumn("route_hash", path).withWatermark("seen", late).dropDuplicatesWithinWatermark(["route_hash"])


def hourly_scores(routes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Routes and best score by hour of arrival, late ones within the watermark included."""
    return routes.withWatermark("seen", late).groupBy(F.window("seen", "1 hour")).agg(F.count("*").alias("routes"), F.max("score").alias("best")).select(F.col("window.start").alias("hour"), "routes", "best")


def incumbent_stream(found: DataFrame, path: str, checkpoint: str, order: Sequence[str] = ("score",)) -> StreamingQuery:
    """Keeps the best row so far in a Parquet folder: a batch adds its best only if that beats all before it.

    ``order``: columns of which greater values are better, the first counting most.  A batch
    writes its own folder, so one that runs again leaves the same.  The trigger works off
    what has been written and ends, so a scheduler may call it again.
    """
    rank = F.struct(*order)

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = batch.where(F.col(order[0]).isNotNull()).orderBy(*[F.desc(c) for c in order]).limit(1).withColumn("batch", F.lit(number))
        if exists(spark, path):
            before = spark.read.schema(best.schema).parquet(f"{path}/part=*").where(F.col("batch") < number)
            record = before.select(rank.alias("r")).agg(F.max("r").alias("record"))
            best = best.join(F.broadcast(record)).where(F.col("record").isNull() | (rank > F.col("record"))).drop("record")
        best.write.mode("overwrite").parquet(f"{path}/part={number}")

    return found.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incumbents(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that were the best of their time, the last the best of all."""
    return spark.read.schema(schema).parquet(f"{path}/part=*")


def watch(start, done: Sequence[str], spark: SparkSession, poll_seconds: float = 30.0) -> int:
    """Drains streams again and again until all ``done`` flags exist; what came before the flags is drained too.

    ``start``: starts one drain (trigger availableNow) and returns its query.  Returns the number of drains.
    """
    drains = 0
    while True:
        last = all(exists(spark, flag) for flag in done)
        start().awaitTermination()
        drains += 1
        if last:
            return drains
        time.sleep(poll_seconds)


def observed(routes: DataFrame, name: str = "progress") -> DataFrame:
    """``routes`` with metrics that every batch reports beside its progress: rows and the best score."""
    return routes.observe(name, F.count(F.lit(1)).alias("rows"), F.max("score").alias("best"))


def progress(query: StreamingQuery, name: str = "progress") -> list[dict]:
    """batch, rows, rows a second, rows of state and best score of the batches that a query remembers."""
    out = []
    for p in query.recentProgress:
        seen = p.observedMetrics.get(name)
        out.append({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "best": seen["best"] if seen is not None else None})
    return out


def stitched_stream(forward: DataFrame, backward: DataFrame, wait: int, window: int, late: str = "1 day") -> DataFrame:
    """Pairs of streamed half-searches (node, t, start_time, mask, seen) that meet at a node; state is dropped after the watermark.

    Backward labels carry negated times, as in the batch search.
    """
    f = forward.withWatermark("seen", late).select("node", F.col("t").alias("f_t"), F.col("start_time").alias("f_start"), F.col("mask").alias("f_mask"), F.col("seen").alias("f_seen"))
    b = backward.withWatermark("seen", late).select(F.col("node").alias("b_node"), (-F.col("t")).alias("b_t"), (-F.col("start_time")).alias("b_end"), F.col("mask").alias("b_mask"), F.col("seen").alias("b_seen"))
    meets = (F.col("node") == F.col("b_node")) & (F.col("b_t") - F.col("f_t") >= wait) & (F.col("b_end") - F.col("f_start") <= window)
    in_time = (F.col("b_seen") >= F.col("f_seen") - F.expr(f"INTERVAL {late}")) & (F.col("b_seen") <= F.col("f_seen") + F.expr(f"INTERVAL {late}"))
    met = f.join(b, meets & in_time)
    return met.select("node", F.bit_count(F.col("f_mask").bitwiseOR(F.col("b_mask"))).alias("countries"), (F.col("b_end") - F.col("f_start")).alias("duration"))
