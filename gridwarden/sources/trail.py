"""The event trail: JSON lines with a sequence number that only grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import cumulative

#: The trail's fields and the kinds of event.
_INTS = T.ArrayType(T.IntegerType())
SCHEMA = (
    T.StructType().add("seq", "long").add("ts", "timestamp").add("type", "string").add("round", "integer").add("from_mode", "string").add("to_mode", "string").add("reason", "string")
    .add("failed_nodes", _INTS).add("active_nodes", _INTS).add("attack", "string").add("k_votes", "integer").add("n_flags", "integer").add("detector_nodes", _INTS)
    .add("source_node", "integer").add("confidence", "double").add("detail", "string")
)
KINDS = ("architecture_change", "node_failure", "intrusion_detected")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The trail; malformed lines are skipped, unknown kinds are kept (consumers ignore them)."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def dedup(trail: DataFrame) -> DataFrame:
    """Each sequence number once (events are delivered at least once)."""
    return trail.dropDuplicates(["seq"])


def since(trail: DataFrame, seq: int = 0, kind: str | None = None, limit: int = 0) -> DataFrame:
    """Events after a sequence number, in order; limit 0 means all, a negative one is an error."""
    if limit < 0 or not isinstance(seq, int):
        raise ValueError("limit must not be negative, since must be an integer")
    out = trail.filter(F.col("seq") > seq)
    if kind:
        out = out.filter(F.col("type") == kind)
    out = out.orderBy("seq")
    return out.limit(limit) if limit else out


def tail(trail: DataFrame, n: int = 10_000) -> DataFrame:
    """The last n events."""
    return trail.orderBy(F.desc("seq")).limit(n)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append(trail_path: str, events: DataFrame, order: list[str]) -> None:
    """Number events on from the largest sequence number of the trail and append them.

    ``events`` is what one control plane emits at a time: few rows.  A trail has one writer, the control plane's driver.
    """
    spark = events.sparkSession
    last = read(spark, trail_path).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] if exists(spark, trail_path) else 0
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA if f.name not in events.columns and f.name not in ("seq", "ts")]
    ts = F.col("ts") if "ts" in events.columns else F.current_timestamp()
    numbered = events.withColumn("seq", F.lit(last) + F.row_number().over(Window.orderBy(*order))).withColumn("ts", ts).select("*", *missing)
    numbered.select(*SCHEMA.fieldNames()).write.mode("append").json(trail_path)


def switches(trail: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each architecture change with the nodes that failed since the one before; ``reason`` follows if none is given."""
    by = by or []
    change = (F.col("type") == "architecture_change").cast("int")
    given = F.col("reason") if "reason" in trail.columns else F.lit(None).cast("string")
    # changes before each event: running counts, so that one long trail is many tasks
    grouped = cumulative(trail.withColumn("_given", given), {"_upto": change}, [F.col("seq")], by).withColumn("_grp", F.col("_upto") - change)
    failed = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type") == "node_failure", F.col("failed_nodes"))))))
    is_change = F.col("type") == "architecture_change"
    out = grouped.groupBy(*by, "_grp").agg(F.max(F.when(is_change, F.col("seq"))).alias("seq"), failed.alias("failed_nodes"), F.max(F.when(is_change, F.col("_given"))).alias("_given"))
    reason = F.coalesce("_given", F.when(F.size("failed_nodes") > 0, "node_failure").otherwise("scheduled"))
    return out.filter(F.col("seq").isNotNull()).select(*by, "seq", reason.alias("reason"), "failed_nodes")


def status(trail: DataFrame) -> DataFrame:
    """One row: the last mode and round, and all nodes that ever failed (never taken back)."""
    change = F.col("type") == "architecture_change"
    return trail.agg(
        F.max_by(F.when(change, F.col("to_mode")), F.when(change, F.col("seq"))).alias("current_mode"),
        F.max("round").alias("round"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("type") == "node_failure", F.col("failed_nodes")))))).alias("failed_nodes"),
    )


def intrusions(flags: DataFrame, k: int = 1) -> DataFrame:
    """Alarms per round and attack: flags (round, attack, node) -> intrusion_detected rows with at least k detecting nodes."""
    per = flags.groupBy("round", "attack").agg(F.count("*").cast("int").alias("n_flags"), F.array_sort(F.collect_set("node")).alias("detector_nodes"))
    return per.filter(F.size("detector_nodes") >= k).select(F.lit("intrusion_detected").alias("type"), "round", "attack", F.size("detector_nodes").alias("k_votes"), "n_flags", "detector_nodes")


def push_payload(trail: DataFrame) -> DataFrame:
    """Compact notification of each event: epoch milliseconds and counts instead of lists."""
    return trail.select("seq", F.to_json(F.struct("seq", F.unix_millis("ts").alias("t"), "type", "round", F.size("failed_nodes").alias("n_failed"))).alias("payload"))
