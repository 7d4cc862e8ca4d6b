"""Queries of the core on references without a target, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.paths import month, normal_path
from codestrata.operators.orphans import orphan_report, reference_orphans
from codestrata.plans.model import plain_path_sql
from codestrata.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, symbols = table(spark, sf_dir, "files"), table(spark, sf_dir, "symbols")
    of_files = reference_orphans(
        [("imports", table(spark, sf_dir, "imports"), "resolved_file")],
        files.select(normal_path(F.col("file")).alias("key"), "seen_at", "removed_at"), files.count(), normal_path,
    )
    of_symbols = reference_orphans(
        [("calls", table(spark, sf_dir, "calls"), "caller"), ("field_accesses", table(spark, sf_dir, "field_accesses"), "method")],
        symbols.select(F.col("id").alias("key"), "seen_at", "removed_at"), symbols.count(),
    )
    return of_files.unionByName(of_symbols)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct references and orphans per table and month."""
    refs = None
    for name, column in (("imports", "resolved_file"), ("calls", "caller"), ("field_accesses", "method")):
        one = table(spark, sf_dir, name).where(F.regexp_replace(column, r"\s+", "") != "")
        one = one.select(F.lit(name).alias("table_name"), month(F.col("seen_at")).alias("month"), "file", "line", F.col(column).alias("ref"))
        refs = one if refs is None else refs.unionByName(one)
    totals = refs.distinct().groupBy("table_name", "month").agg(F.count("*").alias("refs"))
    return orphan_report(p2_found(spark, sf_dir), totals)


def _orphan_sql() -> str:
    plain = plain_path_sql("resolved_file")
    return f"""
WITH refs AS (
  SELECT 'imports' AS table_name, seen_at, file, line, resolved_file AS ref, {plain} AS key FROM imports
  UNION ALL SELECT 'calls', seen_at, file, line, caller, caller FROM calls
  UNION ALL SELECT 'field_accesses', seen_at, file, line, method, method FROM field_accesses),
used AS (SELECT * FROM refs WHERE ref IS NOT NULL AND trim(ref) <> ''),
targets AS (
  SELECT 'f' AS side, file AS key, seen_at, removed_at FROM files
  UNION ALL SELECT 's', id, seen_at, removed_at FROM symbols)
"""


FOUND = """SELECT DISTINCT table_name, strftime(seen_at, '%Y-%m') AS month, file, line, ref FROM used r
WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.key = r.key AND t.side = CASE WHEN table_name = 'imports' THEN 'f' ELSE 's' END
  AND t.seen_at <= r.seen_at AND (t.removed_at IS NULL OR t.removed_at > r.seen_at))"""


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _orphan_sql() + FOUND,
    "p2_report": _orphan_sql() + f""", lost AS ({FOUND}),
n AS (SELECT table_name, month, count(*) AS orphans FROM lost GROUP BY ALL),
m AS (SELECT table_name, month, count(*) AS refs FROM (
  SELECT DISTINCT table_name, strftime(seen_at, '%Y-%m') AS month, file, line, ref FROM used) GROUP BY ALL)
SELECT m.table_name, m.month, refs, coalesce(orphans, 0) AS orphans, round(coalesce(orphans, 0) / refs, 6) AS rate
FROM m LEFT JOIN n ON m.table_name = n.table_name AND m.month = n.month""",
}
