import pytest
from pyspark.sql import functions as F

from gridwarden.functions import metrics as M
from gridwarden.functions import scalars as S

#: F1 and FPR by seed of four configurations.
FACTORIAL = {
    ("specialist", 1): [(95.7152, 0.6490), (96.1253, 0.5840), (96.0128, 0.6020), (95.6196, 0.6643), (96.0996, 0.5878)],
    ("specialist", 2): [(87.6882, 0.0018), (87.6924, 0.0022), (87.6909, 0.0011), (87.7109, 0.0000), (87.6839, 0.0022)],
    ("iid", 1): [(79.3646, 3.7328), (79.8487, 3.6057), (79.4758, 3.6810), (79.9108, 3.6047), (79.8503, 3.6025)],
    ("iid", 2): [(80.1067, 3.5129), (80.1680, 3.5180), (79.7241, 3.6194), (80.2661, 3.5066), (80.1105, 3.5320)],
}


def test_published_rates(spark):
    df = spark.createDataFrame([(1, 200444, 17881, 65, 2737258), (2, 156587, 49, 43922, 2755090)], "k int, tp long, fp long, fn long, tn long")
    a, b = df.withColumns(M.derived(4)).orderBy("k").collect()
    assert (a.f1, a.fpr, a.mcc, a.recall, a.precision) == (95.7152, 0.6490, 0.9549, 99.9676, 91.8099)
    assert (b.f1, b.fpr, b.mcc) == (87.6882, 0.0018, 0.8766)
    assert a.fp_per_million == pytest.approx(6490.05, abs=0.01)


def test_zero_denominators(spark):
    r = spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long").withColumns(M.derived()).first()
    assert r.f1 == r.mcc == r.fpr == 0.0


def test_published_contrasts(spark):
    rows = []
    for i in range(5):
        f = {k: v[i] for k, v in FACTORIAL.items()}
        rows += [("C1", f["specialist", 1][0] - f["iid", 1][0]), ("C2", f["specialist", 1][1] - f["specialist", 2][1]), ("C3", f["specialist", 2][0] - f["iid", 2][0])]
    got = {r.contrast: r for r in M.holm(M.paired_t(spark.createDataFrame(rows, "contrast string, d double"), "d", "contrast")).collect()}
    for name, effect, p, holm in (("C1", 16.2245, 3.171169e-08, 9.513507e-08), ("C2", 0.6160, 3.284471e-06, 3.284471e-06), ("C3", 7.6182, 1.192882e-07, 2.385765e-07)):
        r = got[name]
        assert r.effect == pytest.approx(effect, abs=5e-4) and r.p_raw == pytest.approx(p, rel=2e-2) and r.p_holm == pytest.approx(holm, rel=2e-2) and r.significance == "***"


def test_digest_and_quorum(spark):
    r = spark.createDataFrame([([0, 9, 13],)], "m array<int>").select(S.bitmap_hex(F.col("m"), 14).alias("h"), S.quorum(F.lit(14)).alias("q"), S.digest_bytes(F.lit(20), True).alias("d")).first()
    assert (r.h, r.q, r.d) == ("0122", 8, 102)
