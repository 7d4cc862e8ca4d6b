"""The model tables as the other plans use them, from the stored tables with their repeated rows and stays."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.paths import normal_path
from codestrata.session import Scratch, table

NOW = 1767225600  # 2026-01-01: the instant that ages are counted to


_written: list[tuple[Scratch, dict]] = []


@contextmanager
def shared(spark: SparkSession) -> Iterator[None]:
    """Within this context each input marked `once` is made and written once, for a plan whose many branches read it."""
    _written.append((Scratch(spark, "inputs"), {}))
    try:
        yield
    finally:
        _written.pop()


def once(make):
    @functools.wraps(make)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not _written:
            return make(spark, sf_dir)
        scratch, tables = _written[-1]
        key = (make.__module__, make.__name__, sf_dir)
        if key not in tables:
            tables[key] = scratch.write(make(spark, sf_dir), make.__name__.strip("_"))
        return tables[key]

    return run


def prepare(spark: SparkSession, sf_dir: str, *stages: list) -> None:
    """Within `shared`: make the inputs of each stage side by side, so that small jobs do not wait for each other; a stage may read those before it."""
    with ThreadPoolExecutor(max(map(len, stages))) as pool:
        for stage in stages:
            list(pool.map(lambda make: make(spark, sf_dir), stage))


@once
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files still there, one row each."""
    return table(spark, sf_dir, "files").where("removed_at IS NULL").groupBy("repo", "file").agg(F.min("file_ord").alias("file_ord"), F.min("language").alias("language"), F.max("lines").alias("lines"))


@once
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols still there, one row each."""
    return table(spark, sf_dir, "symbols").where("removed_at IS NULL").drop("seen_at", "removed_at").dropDuplicates(["id"])


@once
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "commits").distinct()


@once
def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the commits that are known."""
    return table(spark, sf_dir, "commit_files").distinct().join(commits(spark, sf_dir).select("hash", "repo"), "hash")


@once
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct imports between files that are there, without self-imports; the stored path may spell the file in any way."""
    live = files(spark, sf_dir).select("file")
    pairs = table(spark, sf_dir, "imports").select(F.col("file").alias("src"), normal_path(F.col("resolved_file")).alias("dst")).where("src <> dst").distinct()
    return pairs.join(live.withColumnRenamed("file", "src"), "src", "left_semi").join(live.withColumnRenamed("file", "dst"), "dst", "left_semi")


def plain_path_sql(column: str) -> str:
    """The path with its segments collapsed as `normal_path` does, for up to three `..`."""
    plain = f"trim(regexp_replace(regexp_replace(replace({column}, '\\', '/'), '(^|/)(\\./|/)+', '\\1', 'g'), '/\\.(/|$)', '\\1', 'g'), '/')"
    for _ in range(3):
        plain = f"regexp_replace({plain}, '(^|/)([^/.][^/]*|\\.[^/.][^/]*)/\\.\\.(/|$)', '\\1')"
    return plain


SQL = f"""
files_now AS (SELECT repo, file, min(file_ord) AS file_ord, min(language) AS language, max(lines) AS lines FROM files WHERE removed_at IS NULL GROUP BY repo, file),
symbols_now AS (SELECT DISTINCT id, file, sym_ord, name, kind, start_line, end_line, parent, complexity, max_nesting_depth, bumpy_road_bumps, param_count, primitive_param_count, body_hash
  FROM symbols WHERE removed_at IS NULL),
commits_all AS (SELECT DISTINCT * FROM commits),
touched AS (SELECT DISTINCT cf.*, c.repo FROM commit_files cf JOIN commits_all c USING (hash)),
import_paths AS (SELECT DISTINCT file AS src, {plain_path_sql("resolved_file")} AS dst FROM imports),
import_pairs AS (SELECT src, dst FROM import_paths WHERE src <> dst AND src IN (SELECT file FROM files_now) AND dst IN (SELECT file FROM files_now))
"""


def sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([SQL, *ctes]) + "\n" + body
