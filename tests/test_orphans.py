from datetime import datetime

from pyspark.sql import functions as F

from codestrata.functions.paths import normal_path
from codestrata.operators.orphans import OUT, reference_orphans
from codestrata.operators.ranking import positions
from codestrata.session import Scratch

REF = "file string, line int, ref string, seen_at timestamp_ntz, key string"
PARENT = "key string, seen_at timestamp_ntz, removed_at timestamp_ntz, ref int"


def at(day):
    return datetime(2025, 1, day)


def test_lifetimes_blanks_and_repeats(spark):
    refs = spark.createDataFrame(
        [("f", 1, "a", at(5), "x"), ("f", 1, "a", at(5), "x"), ("f", 2, "a", at(1), "x"), ("f", 3, "gone", at(5), None), ("f", 4, " ", at(5), None), ("f", 5, None, at(5), None), ("f", 6, "b", at(5), "y"), ("f", 7, "b", at(8), "y"), ("f", 8, "a", None, "z")], REF
    )
    parents = spark.createDataFrame([("a", at(2), None, 1), ("b", at(1), at(5), 1), ("b", at(7), None, 1), ("b", at(7), None, 1), (None, at(1), None, 0)], PARENT)
    got = reference_orphans([("t", refs, "ref")], parents, parents.count())
    assert got.columns == OUT
    rows = {(r.line, r.ref) for r in got.collect()}
    assert rows == {(2, "a"), (3, "gone"), (6, "b"), (8, "a")}
    assert got.count() == 4


def test_no_parents_and_no_refs(spark):
    refs = spark.createDataFrame([("f", 1, "a", at(5), "x")], REF)
    none = spark.createDataFrame([], PARENT)
    assert reference_orphans([("t", refs, "ref")], none, 0).count() == 1
    assert reference_orphans([("t", refs.limit(0), "ref")], none, 0).count() == 0


def test_paths(spark):
    cases = {"a/b.c": "a/b.c", "./a/b.c": "a/b.c", "a//b.c": "a/b.c", "a\\b.c": "a/b.c", "a/x/../b.c": "a/b.c", "a/.env": "a/.env", "../a": "a", "a/./b/../../c": "c", "a/b/": "a/b", "A/b": "A/b", "": "", "/a": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.q for r in df.select("p", normal_path(F.col("p")).alias("q")).collect()} == cases


def test_positions(spark):
    rows = [(g, i % 7, i) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = positions(Scratch(spark, "t"), df, "g", [F.col("v").desc(), F.col("i").asc()])
    for g in ("a", "b", None):
        mine = sorted((r.position, r.v, r.i) for r in got.collect() if r.g == g)
        assert [p for p, _, _ in mine] == list(range(1, 51))
        assert [(v, i) for _, v, i in mine] == sorted(((v, i) for _, v, i in mine), key=lambda x: (-x[0], x[1]))


def test_scratch_is_cleared(spark):
    import os

    from codestrata import session

    s = Scratch(spark, "gone")
    df = s.write(spark.range(3))
    root = s.root.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(root)
    s.drop(df)
    assert os.listdir(root) == []
    held = list(session._ROOTS)
    session._ROOTS[:] = [s.root]
    session.clear_scratch(spark)
    assert not os.path.exists(root)
    session._ROOTS[:] = [r for r in held if r != s.root]
