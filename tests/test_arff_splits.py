"""ARFF files read in splits, against the text scan."""

import pytest
from pyspark.sql import functions as F

from gridwarden.sources import arff, arff_splits

HEADER = "% a comment\n@relation demo\n\n@attribute F1 numeric\n@attribute 'F 2' real\n@attribute kind {x, y}\n@attribute @class@ {normal, a, b}\n\n@data\n"


def rows(n):
    for i in range(n):
        yield ["{i},{h},x,normal", "{i} , {h},y, a", "bad,{h},x,b", "{i},{h},x", "% {i},1,x,a", "", "{i},{h},x,other", "{i}.5,1e3,y,b"][i % 8].format(i=i, h=i / 7)


@pytest.mark.parametrize("newline,end", [("\n", "\n"), ("\r\n", ""), ("\n", "")])
def test_splits_give_every_row_once(spark, tmp_path, newline, end):
    arff_splits.register(spark)
    p = tmp_path / "x.arff"
    p.write_bytes((HEADER + newline.join(rows(4000)) + end).encode("latin-1"))
    whole = [arff_splits.parsed(line, arff_splits.ranges(str(p), 1 << 40)[0].attributes) for line in rows(4000)]
    want = sorted(tuple(r) for r in whole if r)
    for split in (997, 50_000, 1 << 20):
        df = spark.read.format("arff").option("split", split).load(str(p))
        assert df.dtypes == [("F1", "double"), ("F 2", "double"), ("kind", "string"), ("@class@", "string")]
        assert sorted(tuple(r) for r in df.collect()) == want
        assert len(arff_splits.ranges(str(p), split)) == -(-(p.stat().st_size - arff_splits.ranges(str(p), split)[0].data) // split)
    two = spark.read.format("arff").schema("`@class@` string, F1 double").option("split", 5000).load(str(p))
    assert sorted(tuple(r) for r in two.collect()) == sorted((r[3], r[0]) for r in want)
    assert two.select(F.spark_partition_id()).distinct().count() > 5


def test_split_at_every_byte(spark, tmp_path):
    p = tmp_path / "x.arff"
    p.write_bytes((HEADER + "1,2,x,a\n\n3,4,y,b\n5,6,x,normal").encode())
    store = arff_splits._fs(str(p))[0]
    for split in range(1, 40):
        got = [x.strip() for r in arff_splits.ranges(str(p), split) for x in arff_splits.lines(store, r)]
        assert got == ["1,2,x,a", "", "3,4,y,b", "5,6,x,normal"]


def test_a_numeric_file_reads_as_by_the_text_scan(spark, tmp_path):
    arff_splits.register(spark)
    p = tmp_path / "n.arff"
    p.write_text("@attribute f1 numeric\n@attribute f2 numeric\n@attribute c {n, k}\n@data\n" + "\n".join(f"{i},{i % 5}{'' if i % 11 else 'z'},{'nk?'[i % 3]}" for i in range(3000)))
    a = arff.read_arff(spark, str(p)).select("f1", "f2", "label").collect()
    b = spark.read.format("arff").option("split", 2000).load(str(p)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 1000


def test_wrong_files(spark, tmp_path):
    arff_splits.register(spark)
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.arff").write_text(HEADER + "1,2,x,a\n")
    (folder / "b.arff").write_text(HEADER + "3,4,x,b\n")
    assert spark.read.format("arff").load(str(folder)).count() == 2
    (folder / "c.arff").write_text("@attribute z {n}\n@data\nn\n")
    with pytest.raises(Exception, match="other attributes"):
        spark.read.format("arff").load(str(folder)).count()
    with pytest.raises(Exception, match="no attributes"):
        spark.read.format("arff").schema("nothing double").load(str(folder / "a.arff")).count()
    (tmp_path / "none.arff").write_text("@attribute a numeric\n1\n2\n")
    with pytest.raises(Exception, match="no @data"):
        spark.read.format("arff").load(str(tmp_path / "none.arff")).count()
    with pytest.raises(ValueError):
        arff.header(spark, str(tmp_path / "none.arff"))
    (tmp_path / "empty.arff").write_text(HEADER)
    assert spark.read.format("arff").schema("F1 double").load(str(tmp_path / "empty.arff")).count() == 0
