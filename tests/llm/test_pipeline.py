import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from helpers import docs, empty, near_components  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_stages_and_run(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    held = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = held
        held = stage(spark, held, sf)
        assert sorted(held.columns) == sorted(table.columns), name
        assert held.join(before, table.columns, "left_anti").count() == 0
        if name == "near_duplicates":
            rows = {r.doc_id: r.text for r in before.collect()}
            root = near_components(rows)
            assert {r.doc_id for r in held.collect()} == {i for i in rows if root[i] == i}
        held = spark.createDataFrame(held.collect(), table.schema)
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in held.collect()}
    kept = table.count() - held.count()
    assert 0 < kept < 0.5 * table.count()


def test_columns_pass_whatever_their_names(spark, sf):
    """Names that the stages add, as strings with other values, and repeated doc_ids with different rows, in two partitionings."""
    names = ["score", "lang_pred", "toxic", "p_toxic", "kinds", "media", "bands", "digest", "host", "n", "fp", "rep", "component", "kept", "_row", "a.b", "row", "key"]
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, *[f"{c}{r.doc_id}" for c in names]) for r in some]
    rows += [(r[0], r[1], r[2], r[3], *["zz" for _ in names]) for r in rows[:15]] + [(r[0], r[1], r[2], r[3], *["aa" for _ in names]) for r in rows[10:20]]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names)
    ends = []
    for parts in (1, 7):
        held = spark.createDataFrame(rows, schema).repartition(parts)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = {tuple(r) for r in held.collect()}
            out = stage(spark, held, sf)
            assert out.columns == held.columns and out.dtypes == held.dtypes
            after = [tuple(r) for r in out.collect()]
            assert after and set(after) <= before, name
            held = spark.createDataFrame(after, schema)
        assert len({r[0] for r in after}) == len(after)
        first = {}
        for r in sorted(rows):
            first.setdefault(r[0], r)
        assert all(r == first[r[0]] for r in after)
        ends.append(sorted(after))
    assert ends[0] == ends[1]


def test_odd_tables_pass(spark, sf):
    for df in (docs(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            out.count()
            df = out if "text" in out.columns else df
