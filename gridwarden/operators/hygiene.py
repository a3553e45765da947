"""Row and label hygiene: validity, label maps, rare classes, caps, one-vs-normal views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import ranked


def project(df: DataFrame, features: list[int], keep: tuple[str, ...] = ("row_id", "y")) -> DataFrame:
    """Features by 1-based number, in ascending order; an empty list keeps all."""
    if not features:
        return df
    return df.select(*[c for c in keep if c in df.columns], *[f"f{i}" for i in sorted(set(features))])


def numeric_only(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns and those in ``keep``; nominal ones could leak the label."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return df.select(*[c for c, t in df.dtypes if c in keep or t in numeric or t.startswith("decimal")])


#: Parts of the names of columns that hold absolute time.
CLOCKS = ("timestamp", "datetime", "date", "time_epoch", "epoch", "frametime", "utctime")


def drop_absolute_time(df: DataFrame, keep: tuple[str, ...] = (), clocks: tuple[str, ...] = CLOCKS) -> DataFrame:
    """Without columns of a time type and those whose names say absolute time: they tell when a row was recorded, not what it is."""
    plain = lambda c: c.lower().replace(" ", "").replace("_", "")
    when = {k.replace("_", "") for k in clocks}
    return df.select(*[F.col(f"`{c}`") for c, t in df.dtypes if c in keep or not (t.startswith(("timestamp", "date")) or plain(c) in when or any(plain(c).endswith(k) and len(k) > 4 for k in when))])


def drop_invalid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every column is a finite number."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")))
    return df


def binarize(df: DataFrame, label: str, normal: str, out: str = "y") -> DataFrame:
    return df.withColumn(out, (F.col(label) != normal).cast("int"))


def one_vs_normal(df: DataFrame, label: str, attack: str, normal: str, normals: int, seed: int, key: str) -> DataFrame:
    """All rows of the attack and at most ``normals`` normal ones, with y = (label is the attack)."""
    some = df.filter(F.col(label).isin(attack, normal))
    return ranked(some, seed, key, "ovn", label).filter((F.col(label) == attack) | (F.col("_r") <= normals)).drop("_r", "_n").withColumn("y", (F.col(label) == attack).cast("int"))


def map_labels(df: DataFrame, label: str, exact: dict[str, str], contains: list[tuple[str, str]], out: str = "class", strict: bool = True) -> DataFrame:
    """Exact names first, then the first pattern contained; an unknown label raises (or is null if not strict)."""
    name = F.trim(F.col(label))
    mapped = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])[name] if exact else F.lit(None).cast("string")
    for part, target in contains:
        mapped = F.coalesce(mapped, F.when(name.contains(part), target))
    return df.withColumn(out, F.coalesce(mapped, F.raise_error(F.concat(F.lit("unknown label: "), name)).cast("string")) if strict else mapped)


def relabel_rare(df: DataFrame, label: str, least: int, out: str = "class_idx") -> DataFrame:
    """Rows of classes with at least ``least`` rows, and the classes' contiguous numbers by name."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    # one row for each class
    numbered = counts.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias(out))
    return df.join(F.broadcast(numbered), label)


def benign_cap(df: DataFrame, label: str, normal: str, cap: int, seed: int, key: str) -> DataFrame:
    """At most ``cap`` normal rows, the first of a seeded order; all others.

    Ranks come bucket by bucket, so no task sees all normal rows or all that are kept.
    """
    kept = ranked(df.filter(F.col(label) == normal), seed, key, "cap").filter(F.col("_r") <= cap).drop("_r", "_n")
    return kept.unionByName(df.filter(F.col(label) != normal))


def enough_positives(df: DataFrame, label: str, normal: str, least: int) -> DataFrame:
    """(class, n, skipped) of the attack classes."""
    return df.filter(F.col(label) != normal).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n")).withColumn("skipped", F.col("n") < least)


def sweep(df: DataFrame, score: str, lo: float = 0.5, hi: float = 0.95, step: float = 0.05) -> DataFrame:
    """Each row once for each threshold, with ``fired``; aggregate scores before calling where they repeat."""
    n = round((hi - lo) / step)
    taus = F.array(*[F.lit(round(lo + i * step, 10)) for i in range(n + 1)])
    return df.withColumn("tau", F.explode(taus)).withColumn("fired", F.col(score) >= F.col("tau"))
