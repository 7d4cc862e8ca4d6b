"""References to records that do not exist.

A Bloom filter over all parent keys, at most 8 MB, proves most orphans without a shuffle. Only references
the filter lets through are joined with the parents, where the parent's lifetime decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.bloom import bloom_filter, might_contain
from codestrata.functions.paths import month

OUT = ["table_name", "month", "file", "line", "ref"]


def orphan_references(refs: DataFrame, parents: DataFrame, n_parents: int, keep: list[str]) -> DataFrame:
    """Rows of `refs` (key, seen_at and the columns in `keep`) without a parent alive at `seen_at`.

    parents: key, seen_at, removed_at; one row per stay, repeats allowed. A parent counts if its `seen_at` is
    at or before the reference's and `removed_at` is NULL or later. NULL keys, and keys of white space only,
    are no references. NULL `seen_at` of a reference: no parent can be shown alive, so it is an orphan; of a
    parent: it never counts. Empty parents: every reference is an orphan. Repeated references stay repeated.
    A hot key is harmless to the filter; in the anti join AQE splits its reference side, and parents are
    reduced to distinct stays first.
    """
    refs = refs.where(F.col("key").isNotNull() & (F.regexp_replace("key", r"\s+", "") != ""))
    parents = parents.select("key", "seen_at", "removed_at").where(F.col("key").isNotNull())
    bloom = bloom_filter(parents, "key", n_parents)
    cols = [*keep, "key", "seen_at"]
    probed = refs.select(*cols, F.coalesce(might_contain(bloom, F.col("key")), F.lit(n_parents > 0)).alias("maybe"))
    sure = probed.where(~F.col("maybe")).select(*keep)
    stays = parents.distinct().withColumnsRenamed({"key": "_k", "seen_at": "_from", "removed_at": "_to"})
    alive = (
        (F.col("key") == F.col("_k"))
        & (F.col("_from") <= F.col("seen_at"))
        & (F.col("_to").isNull() | (F.col("_to") > F.col("seen_at")))
    )
    verified = probed.where("maybe").join(stays, alive, "left_anti").select(*keep)
    return sure.unionByName(verified)


def reference_orphans(sources: list[tuple[str, DataFrame, str]], parents: DataFrame, n_parents: int, normal=None) -> DataFrame:
    """Distinct orphans of several tables that refer to the same parents.

    sources: (table name, table, its reference column); the table has file, line and seen_at. `normal` maps a
    stored reference to the spelling of the parents' keys.
    """
    normal = normal or (lambda c: c)
    refs = None
    for name, t, column in sources:
        one = t.select(
            F.lit(name).alias("table_name"), month(F.col("seen_at")).alias("month"), F.col("file").alias("file"),
            F.col("line").alias("line"), F.col(column).alias("ref"), normal(F.col(column)).alias("key"), F.col("seen_at").alias("seen_at"),
        )
        refs = one if refs is None else refs.unionByName(one)
    return orphan_references(refs, parents, n_parents, OUT).distinct()


def orphan_report(orphans: DataFrame, totals: DataFrame) -> DataFrame:
    """Per table and month: distinct references, orphans among them and their share (NULL without references)."""
    lost = orphans.groupBy("table_name", "month").agg(F.count("*").alias("orphans"))
    return (
        totals.join(lost, (totals.table_name == lost.table_name) & totals.month.eqNullSafe(lost.month), "left")
        .select(totals.table_name, totals.month, "refs", F.coalesce("orphans", F.lit(0)).cast("long").alias("orphans"))
        .withColumn("rate", F.round(F.col("orphans") / F.col("refs"), 6))
    )
