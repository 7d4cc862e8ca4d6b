"""Queries on refactoring candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import refactor as R
from codestrata.plans import graph
from codestrata.plans import model as M
from codestrata.session import table


def duplicate_pairs(spark, sf_dir):
    near = table(spark, sf_dir, "near_duplicates").where("overlap_ratio >= 0.5").select(F.col("symbol").alias("a"), F.col("other_symbol").alias("b"), F.col("overlap_ratio").alias("overlap"))
    return R.duplicate_pairs(graph.exact_duplicate_pairs(spark, sf_dir), near).select("a", "b", "exact", F.round("overlap", 6).alias("overlap"))


def refactor_candidates(spark, sf_dir):
    cycles = graph.import_sccs(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"))
    return R.candidates(cycles, graph.god_class(spark, sf_dir), graph.lcom4_components(spark, sf_dir), duplicate_pairs(spark, sf_dir))


def commands(spark, sf_dir):
    """Event kinds as commands, and whether they would be wrapped."""
    e = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_type") == "error", "make ").when(F.col("event_type") == "view", "cargo test | ").otherwise("ls "), F.col("event_type")).alias("command"))
    return e.groupBy("command").agg(F.count("*").alias("runs"), F.coalesce(F.first(R.rewrite(F.col("command"))), F.lit("")).alias("program"))


def file_descriptions(spark, sf_dir):
    return R.describe(M.files(spark, sf_dir), M.symbols(spark, sf_dir)).select("key", F.md5("text").alias("digest"))


_DUPES = """dp AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max({'e': e, 'o': o}) AS m FROM (SELECT first_id AS a, id AS b, TRUE AS e, CAST(1 AS DOUBLE) AS o FROM symbols_now JOIN dup USING (body_hash) WHERE id <> first_id
  UNION ALL SELECT symbol, other_symbol, FALSE, overlap_ratio FROM near_duplicates WHERE overlap_ratio >= 0.5) WHERE a <> b GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (duplicate_pairs, refactor_candidates, commands, file_descriptions)}
SQL = {
    "duplicate_pairs": M.sql("SELECT a, b, m.e AS exact, round(m.o, 6) AS overlap FROM dp", graph._DUP, _DUPES),
    "refactor_candidates": M.sql(
        f"""SELECT 'cycle' AS kind, component AS subject, count(*) AS size FROM ({graph._SCC}) GROUP BY 2 UNION ALL SELECT 'god-class', parent, count(*) FROM symbols_now WHERE kind = 'Method' AND parent IS NOT NULL GROUP BY file, parent HAVING count(*) > 2
        UNION ALL SELECT 'low-cohesion', parent, count(DISTINCT c) FROM mc GROUP BY parent HAVING count(*) >= 2 AND count(DISTINCT c) >= 2 UNION ALL SELECT 'duplicate', a || ' ' || b, 2 FROM dp""", graph._REACH, graph._LCOM, graph._DUP, _DUPES,
    ),
    "commands": """SELECT command, count(*) AS runs, CASE WHEN command LIKE 'make %' THEN 'make' ELSE '' END AS program FROM (SELECT CASE event_type WHEN 'error' THEN 'make ' WHEN 'view' THEN 'cargo test | ' ELSE 'ls ' END || event_type AS command FROM events) GROUP BY 1""",
    "file_descriptions": M.sql("SELECT file AS key, md5(file || chr(10) || coalesce(t, '')) AS digest FROM files_now LEFT JOIN (SELECT file, string_agg(kind || ' ' || name, chr(10) ORDER BY start_line, kind, name) AS t FROM s1 GROUP BY file) USING (file)", "s1 AS (SELECT DISTINCT id, file, start_line, kind, name FROM symbols_now)"),
}
