"""Event streams: windowed alarm counts, de-duplication, the trail as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root
from ..sources import trail

#: Kind of the event that ends a replay.
CLOSING = "end of the recording"


def window_counts(events: DataFrame, normal: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, attack, n_flags) per tumbling window; rows later than ``late`` are left out by the watermark."""
    flagged = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("event_type") != normal).withWatermark("ts", late)
    counts = flagged.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("attack")).agg(F.count("*").alias("n_flags"))
    return counts.select(F.col("w.start").alias("start"), "attack", "n_flags")


def unique(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each sequence number once, remembered as long as the watermark allows repeats."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])


def read_trail(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(trail.SCHEMA).json(folder)


def to_trail(events: DataFrame, path: str, checkpoint: str, order: list[str]):
    """Append a stream of events to the trail with growing sequence numbers, each batch once.

    The numbers of written batches are kept beside the trail, in ``<path>_batches``: a batch that is delivered again
    is skipped.  A batch that was written but not yet recorded when the driver died is known by its
    mark in the events' detail.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"batch={number}"
        done = trail.exists(spark, f"{path}_batches/number={number}/_SUCCESS")
        if done or batch.isEmpty():
            return
        known = trail.exists(spark, path) and not trail.read(spark, path).filter(F.col("detail").endswith(mark)).isEmpty()
        if not known:
            given = F.col("detail") if "detail" in batch.columns else F.lit(None).cast("string")
            trail.append(path, batch.withColumn("detail", F.concat_ws("; ", given, F.lit(mark))), order)
        spark.range(1).write.mode("overwrite").parquet(f"{path}_batches/number={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_windows(spark: SparkSession, path: str, normal: str) -> DataFrame:
    """Window counts of a recorded table, read as a stream and appended as windows close.

    Only windows that the watermark has passed are written and dropped from the state, so a last
    event far ahead, of the normal kind, closes those of the recording.
    """
    root = shared_root(spark)
    recorded = spark.read.parquet(path)
    # the recording first, then the closing event in a file of its own: two batches in this order
    recorded.select("ts", "event_type").write.parquet(f"{root}/in")
    end = recorded.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select("ts", F.lit(None).cast("string").alias("event_type"))
    stream = spark.readStream.schema(recorded.select("ts", "event_type").schema).parquet(f"{root}/in")

    def run() -> None:
        # the closing event has no kind, so it is told from the recording after it has moved the watermark
        flagged = window_counts(stream.withColumn("event_type", F.coalesce("event_type", F.lit(CLOSING))), normal)
        q = flagged.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    end.write.mode("append").parquet(f"{root}/in")
    run()
    out = spark.read.schema("start timestamp, attack string, n_flags bigint").parquet(f"{root}/out").filter(F.col("attack") != CLOSING)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
