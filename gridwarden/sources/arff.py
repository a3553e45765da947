"""ARFF as a source and a sink.

The header is read on the driver, line by line up to ``@data``; rows are a distributed text
scan.  Attributes with ``{`` in their type are nominal, all others numeric; the last one
is the class.  Rows of the wrong arity, with a number that cannot be parsed or with an
unknown class are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Header:
    names: list[str]
    nominal: list[bool]
    classes: list[str]


def header(spark: SparkSession, path: str) -> Header:
    """Attributes and classes, from the lines before ``@data``; a file without that line is an error."""
    names, nominal, classes = [], [], []
    for row in spark.read.option("encoding", "ISO-8859-1").text(path).toLocalIterator():
        line = row[0].strip()
        low = line.lower()
        if low.startswith("@data"):
            return Header(names, nominal, classes)
        if low.startswith("@attribute"):
            name, _, kind = line[len("@attribute") :].strip().partition(" ")
            names.append(name)
            nominal.append("{" in kind)
            if "{" in kind:
                classes = [c.strip() for c in kind[kind.index("{") + 1 : kind.rindex("}")].split(",")]
        elif line and line[0] not in "@%":  # rows begin here: no more of the file is looked at
            break
    raise ValueError(f"{path} has no @data line")


def class_name(idx, classes: list[str]):
    """Column with the name of a class index; an index outside the list keeps a name of its own, ``class_<idx>``."""
    names = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>")
    return F.coalesce(F.get(names, idx.cast("int")), F.concat(F.lit("class_"), idx.cast("string")))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, f1..fN double, y int, label): y is the class's place in the header."""
    h = header(spark, path)
    n = len(h.names) - 1
    text = F.trim("value")
    p = F.transform(F.split(text, ","), lambda x: F.trim(x))
    rows = (
        spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id())
        .filter((text != "") & ~text.startswith("%") & ~text.startswith("@")).withColumn("p", p).filter(F.size("p") == n + 1)
    )
    y = F.array_position(F.array(*[F.lit(c) for c in h.classes]), F.get("p", n)).cast("int") - 1
    out = rows.select("row_id", *[F.get("p", i).try_cast("double").alias(f"f{i + 1}") for i in range(n)], y.alias("y"), F.get("p", n).alias("label"))
    good = F.col("y") >= 0
    for i in range(n):
        good = good & F.col(f"f{i + 1}").isNotNull()
    return out.filter(good)


def normal_class(df: DataFrame) -> str:
    """The class of the first kept row."""
    return df.orderBy("row_id").select("label").first()[0]


def write_arff(df: DataFrame, path: str, features: list[str], label: str, classes: list[str], relation: str = "data") -> None:
    """A folder: ``header`` (text) and ``rows`` (part files); concatenated in this order they are one ARFF file."""
    from ..functions.scalars import trimmed_float

    spark = df.sparkSession
    head = [f"@relation {relation}", "", *[f"@attribute F{i + 1} numeric" for i in range(len(features))], "@attribute @class@ {" + ", ".join(classes) + "}", "", "@data"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    df.select(F.concat_ws(",", *[trimmed_float(F.col(f)) for f in features], F.col(label)).alias("value")).write.mode("overwrite").text(f"{path}/rows")


def to_numeric(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Numeric attributes only, renamed f1..fM, finite rows; and (kept, skipped)."""
    h = header(spark, path)
    n = len(h.names) - 1
    keep = [i for i in range(n) if not h.nominal[i]]
    text = F.trim("value")
    p = F.transform(F.split(text, ","), lambda x: F.trim(x))
    body = spark.read.option("encoding", "ISO-8859-1").text(path).filter((text != "") & ~text.startswith("%") & ~text.startswith("@")).withColumn("p", p)
    value = [F.get("p", i).try_cast("double") for i in keep]
    ok = (F.size("p") == n + 1) & F.array_contains(F.array(*[F.lit(c) for c in h.classes]), F.get("p", n))
    for v in value:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ok = F.coalesce(ok, F.lit(False))
    rows = body.filter(ok).select(*[v.alias(f"f{k + 1}") for k, v in enumerate(value)], F.get("p", n).alias("label"))
    return rows, body.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


def register(spark: SparkSession) -> None:
    """``spark.read.format("arff_labelled").load(path)`` for local files: (label string, features array<double>)."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, path: str) -> None:
            self.path = path

        def partitions(self):
            return [InputPartition(self.path)]

        def read(self, partition):
            classes: list[str] = []
            n, data = 0, False
            with open(partition.value, encoding="latin-1") as f:
                for line in f:
                    line = line.strip()
                    low = line.lower()
                    if low.startswith("@attribute"):
                        n += 1
                        if "{" in line:
                            classes = [c.strip() for c in line[line.index("{") + 1 : line.rindex("}")].split(",")]
                    elif low.startswith("@data"):
                        data = True
                    elif data and line and not line.startswith("%"):
                        parts = [x.strip() for x in line.split(",")]
                        if len(parts) != n or parts[-1] not in classes:
                            continue
                        try:
                            yield parts[-1], [float(x) for x in parts[:-1]]
                        except ValueError:
                            continue

    class Arff(DataSource):
        @classmethod
        def name(cls):
            return "arff_labelled"

        def schema(self):
            return "label string, features array<double>"

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Arff)
