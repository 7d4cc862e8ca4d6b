from pyspark.sql import functions as F

from codestrata.operators import refactor as R


def test_pairs(spark):
    exact = spark.createDataFrame([("b", "a")], "a string, b string")
    near = spark.createDataFrame([("a", "b", 0.9), ("c", "a", 0.5), ("a", "c", 0.7), ("d", "d", 1.0), ("e", "f", None)], "a string, b string, overlap double")
    assert {tuple(r) for r in R.duplicate_pairs(exact, near).collect()} == {("a", "b", True, 1.0), ("a", "c", False, 0.7)}


def test_commands_and_cartesian(spark):
    c = spark.createDataFrame([("cargo test",), ("cargo test | tee x",), ("ls",), ("make $X",), ("npm run a",)], "c string").select(R.rewrite(F.col("c")).alias("p"))
    assert [r.p for r in c.collect()] == ["cargo", None, None, None, "npm"]
    cases = {"select * from a, b": "a,b", "SELECT x FROM a, b, c WHERE a.x = b.x": "a,b,c", "select * from a, b where a.x = b.y": "", "select * from a join b on a.x = b.x, c": "", "delete from a, b": "", "select * from a": ""}
    q = spark.createDataFrame([(k,) for k in cases], "q string").select("q", F.array_join(R.cartesian_tables(F.col("q")), ",").alias("t"))
    assert {r.q: r.t for r in q.collect()} == cases


def test_proposals_and_vectors(spark):
    texts = spark.createDataFrame([("f", "one  two\n\nthree four\nfive\n"), ("g", "x")], "file string, text string")
    p = spark.createDataFrame([(1, "f", "two"), (2, "f", "one two\nthree"), (3, "f", "three\none"), (4, "f", " "), (5, "h", "x"), (6, "g", "x\ny")], "id int, file string, anchor string")
    assert {tuple(r) for r in R.anchored_proposals(p, texts).collect()} == {(1, "f", 1), (2, "f", 1)}
    want = spark.createDataFrame([("a",), ("b",)], "key string")
    held = spark.createDataFrame([("b", 1), ("c", 2)], "key string, vec int")
    need, keep = R.missing_vectors(want, held)
    assert [r.key for r in need.collect()] == ["a"] and [r.key for r in keep.collect()] == ["b"]
