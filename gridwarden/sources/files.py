"""CSV results, feature manifests, run settings, integrity checks, resumable jobs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csvs(spark: SparkSession, paths: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """The union of CSV files with the same columns; header names are trimmed, values are text."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).option("encoding", encoding).csv(p)
        df = df.toDF(*[c.strip() for c in df.columns])
        out = df if out is None else out.unionByName(df)
    return out


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_results(df: DataFrame, path: str, digits: int = 4) -> None:
    """One wide CSV with fixed decimals."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_long(df: DataFrame, path: str, keys: list[str], metrics: list[str]) -> None:
    """(keys, metric, value) rows."""
    df.unpivot(keys, metrics, "metric", "value").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> list[int]:
    """The selected features of a manifest (its ``features``, or the union of a per-attack one), sorted."""
    m = spark.read.option("multiLine", True).json(path)
    name = "features" if "features" in m.columns else "superset_grasp"
    return sorted(m.select(name).first()[0])


def manifest(**entries) -> str:
    """JSON of a selection run; features are sorted."""
    return json.dumps(entries | {"features": sorted(entries.get("features", []))}, indent=2, ensure_ascii=False)


def digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, paths: list[str], expected: dict[str, tuple[int, str]]) -> DataFrame:
    """(name, ok) for expected {file name: (length, sha256)}; a file of the wrong length isn't hashed."""
    rows = spark.createDataFrame([(n, size, sha) for n, (size, sha) in expected.items()], "name string, want_length bigint, want string")
    files = spark.read.format("binaryFile").load(paths).withColumn("name", F.element_at(F.split("path", "/"), -1))
    good = F.when(F.col("length") != F.col("want_length"), False).otherwise(F.sha2("content", 256) == F.col("want"))
    return rows.join(files.select("name", "length", "content"), "name", "left").select("name", F.coalesce(good, F.lit(False)).alias("ok"))


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first if it isn't there (complete writes leave _SUCCESS)."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@dataclass
class RunSettings:
    """Settings of a run; given values win over the file's, the file's over these defaults."""

    clients: int = 10
    rounds: int = 20
    partitioner: str = "attack"
    fusion_k: int = 1
    benign_cap: int | None = 500_000
    seed: int = 42
    topology: str = "ring"
    manager: str = "fixed"
    dwell_rounds: int = 3
    cooldown_rounds: int = 2
    schedule: list = field(default_factory=list)
    faults: list = field(default_factory=list)

    @classmethod
    def load(cls, text: str = "", **given) -> RunSettings:
        import yaml

        names = {f.name for f in fields(cls)}
        loaded = yaml.safe_load(text) or {}
        flat = {k: v for part in [loaded, *(x for x in loaded.values() if isinstance(x, dict))] for k, v in part.items() if k in names}
        out = cls(**(flat | {k: v for k, v in given.items() if v is not None}))
        if out.manager not in ("fixed", "distributed"):
            raise ValueError(f"unknown manager {out.manager}")
        if out.fusion_k < 1 or out.clients < 1:
            raise ValueError("fusion_k and clients start at 1")
        return out


def topology_of(text: str) -> tuple[str, int, dict[int, list[int]] | None]:
    """(name, nodes, adjacency) of a topology file."""
    import yaml

    t = yaml.safe_load(text)
    adjacency = {int(k): [int(x) for x in v] for k, v in t["adjacency"].items()} if t.get("adjacency") else None
    return t.get("name", "ring"), int(t["nodes"]), adjacency


def fault_rows(faults: list[dict]) -> list[tuple[int, int, int, bool]]:
    """(ord, round, node, up) of a fault list, in order of round."""
    ordered = sorted(faults, key=lambda f: f.get("round", f.get("from")))
    return [(i, f.get("round", f.get("from")), n, bool(f.get("up", False))) for i, f in enumerate(ordered) for n in f.get("nodes", [])]
