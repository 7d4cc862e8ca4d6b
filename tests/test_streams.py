import hashlib
import hmac
from datetime import datetime, timedelta

from codestrata.streaming import watch

T0 = datetime(2025, 1, 1)


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [("r", T0 + timedelta(seconds=s), "modify-data", f"p{s}") for s in (0, 1, 2, 10, 11, 600)] + [("q", T0, "create", "x")]
    df = spark.createDataFrame(rows, "repo string, at timestamp, kind string, path string")
    batch = {(r.repo, r.started, r.changes) for r in watch.quiet_batches(df).collect()}
    assert batch == {("r", T0, 3), ("r", T0 + timedelta(seconds=10), 2), ("r", T0 + timedelta(seconds=600), 1), ("q", T0, 1)}
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = watch.quiet_batches(spark.readStream.schema(df.schema).parquet(src), late="1 second")
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.repo, r.started, r.changes) for r in spark.read.parquet(out).collect()} == batch - {("r", T0 + timedelta(seconds=600), 1)}


def test_only_content_changes_rebuild(spark, tmp_path):
    rows = [("r", "access", "a"), ("q", "create", "x/.git/HEAD"), ("s", "create", "x/a.py"), ("s", "remove", "b")]
    df = spark.createDataFrame(rows, "repo string, kind string, path string")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    seen = []
    q = watch.rebuild_on_change(spark.readStream.schema(df.schema).parquet(src), lambda repos, n: seen.append(repos), str(tmp_path / "c"))
    q.awaitTermination()
    assert seen == [["s"]]


def test_totals_heads_and_snapshots(spark, tmp_path):
    ledger = spark.createDataFrame([("npm", 10, 4), ("npm", 1, 5), ("go", 2, 2)], "program string, raw_bytes long, kept_bytes long")
    assert {tuple(r) for r in watch.running_savings(ledger).collect()} == {("npm", 2, 6), ("go", 1, 0)}
    heads = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", None)], "repo string, head string")
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "repo string, head string")
    assert [tuple(r) for r in watch.heads_moved(heads, old).collect()] == [("a", "2")]
    one = spark.createDataFrame([("x",), ("y",)], "k string")
    path = str(tmp_path / "snap")
    assert watch.snapshot_losses(spark, path, one).count() == 0
    assert [r.k for r in watch.snapshot_losses(spark, path, one.where("k = 'y'")).collect()] == ["x"]
    assert watch.snapshot_losses(spark, path, one).count() == 0


def test_signatures():
    good = "sha256=" + hmac.new(b"s", b"body", hashlib.sha256).hexdigest()
    assert watch.signed("s", b"body", good) and not watch.signed("s", b"other", good) and not watch.signed("", b"body", good) and not watch.signed("s", b"body", None)
    assert watch.token_fits("t", "t") and not watch.token_fits("t", None) and not watch.token_fits("", "")
