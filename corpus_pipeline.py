"""Corpus pipeline: language ID, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; rejected documents are gone from then on.

Null texts have no language and go in the first stage; of rows with one doc_id near-duplicates
leaves the first by its text, then by its other columns as JSON, on any partitioning; an empty table passes through
all stages.  Columns of documents pass as they are, whatever their names: what a stage
adds is taken away again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.llm import langid, minhash, packing, toxicity
from gridwarden.llm.queries import table, vocabulary
from gridwarden.llm.store import materialise

#: A text whose best language has a lower mean probability is rejected as having none.
LEAST_SCORE = 0.4


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """Rows of ``docs`` whose judgement fulfils ``keep``; the other columns travel in a struct, out of the reach of added names."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed_ = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_row"))
    back = [F.col(f"`{c}`") if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return judge(packed_).filter(keep).select(*back)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the network has learned."""
    net = langid.fit(docs)
    return _kept(docs, lambda d: langid.predict(d, net), (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the last classifier of the chain doesn't call toxic."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.predict(d, chain), ~F.col("toxic"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, and those without a doc_id."""
    kept = minhash.near_duplicates(docs).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        # columns of any type pass, but maps and the like have no order, so the others' order is that of their text as JSON
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
        first = rows.groupBy("doc_id").agg(F.min_by(whole, F.struct(F.col("text"), rest)).alias("_row"))
        rows = first.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return rows.unionByName(docs.filter(F.col("doc_id").isNull()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary(), end_id=2, size=4096)


STAGES = [("language", language), ("toxicity", harmless), ("near_duplicates", unique), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs


#: Trained models and the token vocabulary cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None
