"""Test coverage: reports, their merging, and the tests that a change concerns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(*reports: DataFrame) -> DataFrame:
    """(file, line, hits) of several reports, hits summed."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.groupBy("file", "line").agg(F.sum("hits").alias("hits"))


def line_coverage(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, known, percent): lines that ran, of those known; NULL for a file that no report names."""
    per = lines.groupBy("file").agg(F.count("*").alias("known"), F.avg(F.when(F.col("hits") > 0, 100.0).otherwise(0.0)).alias("percent"))
    return files.select("file").join(per, "file", "left")


def coverage_report(coverage: DataFrame) -> DataFrame:
    """One row: measured files and their mean percent, and unmeasured files."""
    return coverage.agg(F.count("percent").alias("measured"), F.avg("percent").alias("percent"), F.count_if(F.col("percent").isNull()).alias("unmeasured"))


def tests_covering(hits: DataFrame, file: str) -> DataFrame:
    return hits.where(F.col("file") == file).select("test").distinct()


def impacted_tests(hits: DataFrame, changed: DataFrame) -> DataFrame:
    """Tests (test, file, line) that ran a changed line (file, line)."""
    return hits.join(changed.select("file", "line").distinct(), ["file", "line"], "left_semi").select("test").distinct()


def impact_status(hits: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: whether there is test data, whether any of it is of the changed files, and whether a test ran a changed line.

    status: no-data, no-changes, unmeasured (no changed file has data), uncovered (no test ran a changed line) or covered.
    """
    files = changed.select("file").distinct()
    flags = hits.agg(F.count("*").alias("data"))
    flags = flags.join(changed.agg(F.count("*").alias("changes"))).join(hits.join(files, "file", "left_semi").agg(F.count("*").alias("near"))).join(impacted_tests(hits, changed).agg(F.count("*").alias("tests")))
    status = F.when(F.col("data") == 0, "no-data").when(F.col("changes") == 0, "no-changes").when(F.col("near") == 0, "unmeasured").when(F.col("tests") == 0, "uncovered").otherwise("covered")
    return flags.select(status.alias("status"), "tests")
