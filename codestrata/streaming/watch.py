"""Streams: changes of files into quiet batches, the ledger's totals, snapshots, and signed notices."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUIET = "2 seconds"
CONTENT_CHANGES = ("create", "remove", "modify-data", "rename")


def content_changes(events: DataFrame) -> DataFrame:
    """Events (kind, path) that change content outside of the version control's and the index's own directories."""
    own = F.arrays_overlap(F.split(F.translate("path", "\\", "/"), "/"), F.array(F.lit(".git"), F.lit(".codestrata")))
    return events.where(F.col("kind").isin(*CONTENT_CHANGES) & ~own)


def quiet_batches(events: DataFrame, key: str = "repo", quiet: str = QUIET, late: str = "10 minutes") -> DataFrame:
    """(repo, started, ended, paths): changes of a repo with less than `quiet` between neighbours, as one. Works on streams and tables alike; on a stream, events later than `late` are dropped."""
    x = events.withWatermark("at", late) if events.isStreaming else events
    return x.groupBy(key, F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("changes"), F.array_sort(F.collect_set("path")).alias("paths")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes", "paths")


def running_savings(ledger: DataFrame) -> DataFrame:
    """(program, records, saved_bytes) so far; complete mode on streams."""
    return ledger.groupBy("program").agg(F.count("*").alias("records"), F.sum(F.greatest(F.col("raw_bytes") - F.col("kept_bytes"), F.lit(0))).alias("saved_bytes"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(started, kind, events) in windows that do not overlap."""
    x = events.withWatermark("at", late) if events.isStreaming else events
    return x.groupBy(F.window("at", window).alias("w"), "kind").agg(F.count("*").alias("events")).select(F.col("w.start").alias("started"), "kind", "events")


def rebuild_on_change(stream: DataFrame, rebuild, checkpoint: str):
    """Start a query that hands each batch's changed repos to `rebuild(repos, batch)`: one batch at a time, repeats of a batch included, so rebuild must be idempotent."""

    def each(batch: DataFrame, number: int) -> None:
        repos = [r[0] for r in content_changes(batch).select("repo").distinct().collect()]  # a row per repo that changed
        if repos:
            rebuild(sorted(repos), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heads_moved(heads: DataFrame, indexed: DataFrame) -> DataFrame:
    """Repos whose head is known and differs from the indexed one, known too."""
    return heads.join(indexed.select("repo", F.col("head").alias("old")), "repo").where("head IS NOT NULL AND old IS NOT NULL AND head <> old").select("repo", "head")


def snapshot_losses(spark: SparkSession, path: str, now: DataFrame) -> DataFrame:
    """Rows of the last snapshot that `now` lacks, and `now` as the next snapshot; a first snapshot loses nothing.

    Each snapshot is a directory of its own, so that a failed write leaves the last one whole.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(hadoop) else []
    new = f"{path}/{len(old):06d}"
    now.write.parquet(new)
    held = spark.read.parquet(new)
    return spark.read.parquet(f"{path}/{old[-1]}").exceptAll(held) if old else held.limit(0)


def signed(secret: str, body: bytes, signature: str | None) -> bool:
    """Whether `sha256=<hex>` signs the body under the secret; a missing signature or an empty secret never does."""
    if not secret or not signature or not signature.startswith("sha256="):
        return False
    return hmac.compare_digest(hmac.new(secret.encode(), body, hashlib.sha256).hexdigest(), signature[7:])


def token_fits(secret: str, token: str | None) -> bool:
    return bool(secret) and token is not None and hmac.compare_digest(secret, token)
