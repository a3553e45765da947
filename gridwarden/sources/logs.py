"""Text logs of runs: one line a round, sectioned search logs, marked blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The lines' formats.
ROUND = r"^ROUND;(\d+);(\w+);f1=([\d.]+);recall=([\d.]+);fpr=([\d.]+)"
UNION = r"uni\S+ do head: (\d+) boosters"
COMMIT = r"COMMIT (\w+) @round=(\d+)\s+reason=(\w+)\s+nodes=(\[[^\]]*\])"
ACTIVE = r"round=(\d+)\s+mode=(\w+)\s+q=(\d+)(?:\s+active=(\[[^\]]*\]))?"
SECTION = r"ATAQUE (\S+)"


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, value).

    Whole files are read as rows and split, because a line's place in its file is part of
    the data; these are run logs of some MB.
    """
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def parse_rounds(text: DataFrame) -> DataFrame:
    """(round, mode, f1, recall, fpr) of the round lines; others are skipped."""
    part = lambda i: F.regexp_extract("value", ROUND, i)
    hit = text.filter(F.col("value").rlike(ROUND))
    return hit.select(part(1).cast("int").alias("round"), part(2).alias("mode"), *[part(i).cast("double").alias(n) for i, n in ((3, "f1"), (4, "recall"), (5, "fpr"))])


def parse_unions(text: DataFrame) -> DataFrame:
    """(nth, boosters): sizes of the head's union, in order of lines (needs line_no)."""
    hit = text.filter(F.col("value").rlike(UNION)).select("file", "line_no", F.regexp_extract("value", UNION, 1).cast("int").alias("boosters"))
    return hit.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).select("file", "nth", "boosters")


def rounds_with_unions(text: DataFrame) -> DataFrame:
    """Round lines with the nth union size at the nth round."""
    numbered = text.filter(F.col("value").rlike(ROUND)).withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))
    part = lambda i: F.regexp_extract("value", ROUND, i)
    rounds = numbered.select("file", "nth", part(1).cast("int").alias("round"), part(2).alias("mode"), part(3).cast("double").alias("f1"))
    return rounds.join(parse_unions(text), ["file", "nth"], "left").drop("nth")


def parse_commits(text: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("value", COMMIT, i)
    return text.filter(F.col("value").rlike(COMMIT)).select(part(2).cast("int").alias("round"), part(1).alias("mode"), part(3).alias("reason"), F.from_json(part(4), "array<int>").alias("nodes"))


def parse_active(text: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("value", ACTIVE, i)
    return text.filter(F.col("value").rlike(ACTIVE) & ~F.col("value").contains("COMMIT")).select(
        part(1).cast("int").alias("round"), part(2).alias("mode"), part(3).cast("int").alias("q"), F.from_json(F.nullif(part(4), F.lit("")), "array<int>").alias("active")
    )


def parse_selection(text: DataFrame) -> DataFrame:
    """(attack, line_no, eval_no, f1, features): evaluations under the last section head above them; bad ones are skipped."""
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.nullif(F.regexp_extract("value", SECTION, 1), F.lit(""))
    filled = text.withColumn("attack", F.last(head, ignorenulls=True).over(order)).filter(F.col("value").startswith("EV;"))
    p = F.split("value", ";")
    rows = filled.select(
        "attack", "line_no", F.get(p, 1).try_cast("int").alias("eval_no"), F.get(p, 2).try_cast("double").alias("f1"), F.from_json(F.get(p, 3), "array<int>").alias("features")
    )
    return rows.filter(F.col("attack").isNotNull() & F.col("eval_no").isNotNull() & F.col("f1").isNotNull() & F.col("features").isNotNull())


def first_after(text: DataFrame, marker: str, pattern: str) -> DataFrame:
    """(file, value): the first number that ``pattern`` finds below a line with the marker."""
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    open_ = text.withColumn("_on", F.max(F.col("value").contains(marker)).over(order)).filter("_on").withColumn("_x", F.regexp_extract("value", pattern, 1))
    return open_.filter(F.col("_x") != "").groupBy("file").agg(F.min_by(F.col("_x").cast("double"), "line_no").alias("value"))
