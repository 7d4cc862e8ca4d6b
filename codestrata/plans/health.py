"""Queries on health, with their SQL. Limits are lowered where the default would fire nowhere in these tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.extract.run import extracted, table_of
from codestrata.operators import coverage as C
from codestrata.operators import health as H
from codestrata.plans import extraction, graph, history, known
from codestrata.plans import model as M
from codestrata.session import table

LIMITS = {"lines": 25, "complexity": 8, "params": 2, "nesting": 3, "bumps": 2, "methods": 2}


def function_markers(spark, sf_dir):
    return H.function_markers(M.symbols(spark, sf_dir), LIMITS)


def _flat(found):
    """Line 0 stands for the whole file, so that the column has a value everywhere."""
    return found.withColumn("line", F.coalesce("line", F.lit(0)))


def org_markers(spark, sf_dir):
    return _flat(H.org_markers(history.org_signals(spark, sf_dir)))


def near_duplicate_markers(spark, sf_dir):
    """A finding for each direction of a pair of functions that overlap by half or more and do not have the same body."""
    near = table(spark, sf_dir, "near_duplicates").where("overlap_ratio >= 0.5 AND symbol <> other_symbol")
    both = near.select("symbol", "other_symbol").union(near.select("other_symbol", "symbol")).distinct()
    s = M.symbols(spark, sf_dir).select("id", "file", "start_line", "body_hash")
    x = both.join(s.select(F.col("id").alias("symbol"), "file", F.col("start_line").alias("line"), F.col("body_hash").alias("h")), "symbol")
    x = x.join(s.select(F.col("id").alias("other_symbol"), F.col("body_hash").alias("o")), "other_symbol").where("NOT (h <=> o)")
    return H.finding(x, "near-duplicate-code", symbol="symbol", line="line", detail=F.col("other_symbol"))


def _coverage(spark, sf_dir):
    """Stand-in for a report: functions are the lines, a function that is called ran."""
    n = graph.call_in_degree(spark, sf_dir)
    s = M.symbols(spark, sf_dir).where(F.col("kind").isin("Function", "Method"))
    return s.join(n, "id", "left").select("file", F.col("start_line").alias("line"), F.coalesce("n", F.lit(0)).alias("hits"))


def coverage_ratio(spark, sf_dir):
    c = C.line_coverage(M.files(spark, sf_dir), C.merge(_coverage(spark, sf_dir)))
    return c.select("file", F.coalesce("known", F.lit(0)).alias("known"), F.round("percent", 4).alias("percent"))


def coverage_report(spark, sf_dir):
    return C.coverage_report(coverage_ratio(spark, sf_dir)).select("measured", F.round("percent", 4).alias("percent"), "unmeasured")


def coverage_markers(spark, sf_dir):
    dependents = M.import_edges(spark, sf_dir).groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("dependents"))
    return _flat(H.coverage_markers(coverage_ratio(spark, sf_dir), history.hot_paths(spark, sf_dir), dependents, {"dependents": 1}))


def findings(spark, sf_dir):
    """All findings of the kinds that the model tables can show. What several branches of the plan read is written once."""
    with M.shared(spark):
        M.prepare(spark, sf_dir, [M.files, M.symbols, M.commits], [graph._calls, M.commit_files, M.import_edges, graph.lcom4_components], [history._history, history._pairs])
        return _findings(spark, sf_dir)


def _findings(spark, sf_dir):
    s = M.symbols(spark, sf_dir)
    dead = graph.dead_code(spark, sf_dir).join(s.select("id", "file", F.col("start_line").alias("line")), "id")
    dup = graph.duplicate_code(spark, sf_dir).join(s.select("id", "file", F.col("start_line").alias("line")), "id")
    god = graph.god_class(spark, sf_dir)
    low = graph.lcom4_components(spark, sf_dir).withColumn("file", F.regexp_extract("parent", "^(.*?)::", 1))
    hidden = history.hidden_coupling(spark, sf_dir)
    hidden = hidden.select(F.col("file_a").alias("file"), F.col("file_b").alias("other")).union(hidden.select("file_b", "file_a"))
    parts = [
        function_markers(spark, sf_dir), org_markers(spark, sf_dir), near_duplicate_markers(spark, sf_dir), coverage_markers(spark, sf_dir),
        H.finding(dead, "possibly-dead-code", symbol="id", line="line", detail=F.col("confidence")), H.finding(dup, "duplicate-code", symbol="id", line="line", detail=F.col("first_id")),
        H.finding(god, "god-class", symbol="parent", detail=F.col("methods")), H.finding(low, "low-cohesion", symbol="parent", detail=F.col("components")), H.finding(hidden, "hidden-coupling", detail=F.col("other")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _flat(out)


def findings_by_kind(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("findings"))


def text_findings(spark, sf_dir):
    """Findings that the texts themselves show: loops, locks, asynchronous code, queries, reduce; and synchronous calls on the hot path."""
    return H.text_markers(extraction.extract_markers(spark, sf_dir), history.hot_paths(spark, sf_dir))


def findings_with_texts(spark, sf_dir):
    """Findings of all kinds."""
    return findings(spark, sf_dir).unionByName(_flat(text_findings(spark, sf_dir)))


def health_with_texts(spark, sf_dir):
    """Scores over findings of all kinds."""
    return H.score_files(M.files(spark, sf_dir), findings_with_texts(spark, sf_dir), H.weights(spark)).select("file", "score", "findings")


def known_markers(spark, sf_dir):
    """Findings in the texts of `known`, of which one file is on the hot path."""
    texts = spark.createDataFrame(known.TEXTS, "file string, language string, text string")
    hot = spark.createDataFrame([(known.HOT,)], "file string")
    return _flat(H.text_markers(table_of(extracted(texts), "markers"), hot))


def health_score(spark, sf_dir):
    return H.score_files(M.files(spark, sf_dir), findings(spark, sf_dir), H.weights(spark)).select("file", "score", "findings")


def health_report(spark, sf_dir):
    return H.summary(H.score_files(M.files(spark, sf_dir), findings(spark, sf_dir), H.weights(spark)))


def score_weights(spark, sf_dir):
    return H.weights(spark)


def worst_files(spark, sf_dir):
    return health_score(spark, sf_dir).orderBy("score", F.col("findings").desc(), "file").limit(50)


_FN = """fnm AS (SELECT file, id AS symbol, start_line AS line, unnest([CASE WHEN end_line - start_line + 1 > 25 THEN {'k': 'long-function', 'd': CAST(end_line - start_line + 1 AS VARCHAR)} END,
  CASE WHEN complexity > 8 THEN {'k': 'high-complexity', 'd': CAST(complexity AS VARCHAR)} END, CASE WHEN param_count > 2 THEN {'k': 'too-many-params', 'd': CAST(param_count AS VARCHAR)} END,
  CASE WHEN max_nesting_depth > 3 THEN {'k': 'nested-complexity', 'd': CAST(max_nesting_depth AS VARCHAR)} END, CASE WHEN bumpy_road_bumps >= 2 THEN {'k': 'bumpy-road', 'd': CAST(bumpy_road_bumps AS VARCHAR)} END,
  CASE WHEN primitive_param_count >= 3 THEN {'k': 'primitive-obsession', 'd': CAST(primitive_param_count AS VARCHAR)} END]) AS m FROM symbols_now WHERE kind IN ('Function', 'Method')),
fm AS (SELECT file, symbol, line, m.k AS kind, m.d AS detail FROM fnm WHERE m IS NOT NULL)"""
_ORGM = """om AS (SELECT file, CAST(NULL AS VARCHAR) AS symbol, 0 AS line, m.k AS kind, m.d AS detail FROM (SELECT file, unnest([CASE WHEN fixes > 0 THEN {'k': 'prior-defect', 'd': CAST(fixes AS VARCHAR)} END,
  CASE WHEN churn >= 20 THEN {'k': 'churn-risk', 'd': CAST(churn AS VARCHAR)} END, CASE WHEN churn >= 5 AND bus_factor = 1 THEN {'k': 'knowledge-loss', 'd': CAST(churn AS VARCHAR)} END,
  CASE WHEN partners >= 5 THEN {'k': 'co-change-scatter', 'd': CAST(partners AS VARCHAR)} END, CASE WHEN recent_authors > 4 THEN {'k': 'developer-congestion', 'd': CAST(recent_authors AS VARCHAR)} END]) AS m FROM org) WHERE m IS NOT NULL)"""
_NEAR = """nb AS (SELECT symbol, other_symbol FROM near_duplicates WHERE overlap_ratio >= 0.5 AND symbol <> other_symbol UNION SELECT other_symbol, symbol FROM near_duplicates WHERE overlap_ratio >= 0.5 AND symbol <> other_symbol),
s1 AS (SELECT DISTINCT ON (id) * FROM symbols_now ORDER BY id),
nm AS (SELECT s.file, nb.symbol, s.start_line AS line, 'near-duplicate-code' AS kind, nb.other_symbol AS detail FROM nb JOIN s1 s ON s.id = nb.symbol JOIN s1 o ON o.id = nb.other_symbol WHERE s.body_hash IS DISTINCT FROM o.body_hash)"""
_COV = """cl AS (SELECT s.file, s.start_line AS line, coalesce(n, 0) AS hits FROM symbols_now s LEFT JOIN (SELECT dst AS id, count(*) AS n FROM call_all GROUP BY 1) USING (id) WHERE kind IN ('Function', 'Method')),
cm AS (SELECT file, line, sum(hits) AS hits FROM cl GROUP BY ALL),
cov AS (SELECT f.file, coalesce(known, 0) AS known, round(percent, 4) AS percent FROM files_now f LEFT JOIN (SELECT file, count(*) AS known, avg(CASE WHEN hits > 0 THEN 100.0 ELSE 0.0 END) AS percent FROM cm GROUP BY 1) USING (file)),
hp AS (SELECT file FROM (SELECT file, count(*) OVER (PARTITION BY repo) AS n, row_number() OVER (PARTITION BY repo ORDER BY decayed_score DESC, file) AS rank FROM hot WHERE score > 0) WHERE rank <= least(10, greatest(1, n // 4))),
cv AS (SELECT file, CAST(NULL AS VARCHAR) AS symbol, 0 AS line, CASE WHEN file IN (SELECT file FROM hp) AND file IN (SELECT dst FROM import_pairs) AND percent < 40 THEN 'untested-hotspot' ELSE 'coverage-gap' END AS kind,
  CAST(round(percent, 1) AS VARCHAR) AS detail FROM cov WHERE percent < 50)"""
_ALL = (*history.HISTORY_SQL, history._CX, history._HOT, graph._CALLS, graph._DUP, graph._LCOM, _FN, _ORGM, _NEAR, _COV, f"""loose AS (SELECT DISTINCT {graph._STEM} AS s FROM imports WHERE resolved_file IS NULL),
dead AS (SELECT id, ['high', 'medium', 'low'][1 + CAST(n > 1 AS INTEGER) + CAST(stem IN (SELECT s FROM loose) AS INTEGER)] AS confidence, file, start_line
  FROM (SELECT fn.id, name, fn.file, start_line, lower(regexp_extract(fn.file, '([^/]*?)(\\.[^./]*)?$', 1)) AS stem FROM fn JOIN files_now f USING (file) WHERE language <> 'Shell' AND id NOT IN (SELECT dst FROM call_all)) u
  JOIN (SELECT name, count(*) AS n FROM nodes GROUP BY 1) t USING (name)),
hid AS (SELECT p.* FROM pairs p WHERE count >= 3 AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.file_a = p.file_a AND l.file_b = p.file_b)),
found AS (SELECT * FROM fm UNION ALL SELECT * FROM om UNION ALL SELECT * FROM nm UNION ALL SELECT * FROM cv UNION ALL SELECT file, id, start_line, 'possibly-dead-code', confidence FROM dead
  UNION ALL SELECT file, id, start_line, 'duplicate-code', first_id FROM symbols_now JOIN dup USING (body_hash)
  UNION ALL SELECT file, parent, 0, 'god-class', CAST(count(*) AS VARCHAR) FROM symbols_now WHERE kind = 'Method' AND parent IS NOT NULL GROUP BY file, parent HAVING count(*) > 2
  UNION ALL SELECT regexp_extract(parent, '^(.*?)::', 1), parent, 0, 'low-cohesion', CAST(count(DISTINCT c) AS VARCHAR) FROM mc GROUP BY parent HAVING count(*) >= 2 AND count(DISTINCT c) >= 2
  UNION ALL SELECT file_a, NULL, 0, 'hidden-coupling', file_b FROM hid UNION ALL SELECT file_b, NULL, 0, 'hidden-coupling', file_a FROM hid)""")  # fmt: skip
_W = "w(kind, penalty) AS (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in H.PENALTIES.items()) + ")"
_SCORES = "sc AS (SELECT f.file, f.lines, round(greatest(0.0, least(10.0, 10.0 - coalesce(cost, 0.0))), 6) AS score, coalesce(n, 0) AS findings FROM files_now f LEFT JOIN (SELECT file, sum(coalesce(penalty, 0)) AS cost, count(*) AS n FROM found LEFT JOIN w USING (kind) GROUP BY file) USING (file))"

QUERIES = {f.__name__: f for f in (function_markers, org_markers, near_duplicate_markers, coverage_ratio, coverage_report, coverage_markers, findings, findings_by_kind, text_findings, findings_with_texts, health_with_texts, known_markers, health_score, health_report, score_weights, worst_files)}
SQL = {
    "function_markers": M.sql("SELECT * FROM fm", _FN),
    "org_markers": M.sql("SELECT * FROM om", *history.HISTORY_SQL, _ORGM),
    "near_duplicate_markers": M.sql("SELECT * FROM nm", _NEAR),
    "coverage_ratio": M.sql("SELECT * FROM cov", *_ALL),
    "coverage_report": M.sql("SELECT count(percent) AS measured, round(avg(percent), 4) AS percent, count(*) FILTER (percent IS NULL) AS unmeasured FROM cov", *_ALL),
    "coverage_markers": M.sql("SELECT * FROM cv", *_ALL),
    "findings": M.sql("SELECT * FROM found", *_ALL),
    "findings_by_kind": M.sql("SELECT kind, count(*) AS findings FROM found GROUP BY 1", *_ALL),
    "health_score": M.sql("SELECT file, score, findings FROM sc", *_ALL, _W, _SCORES),
    "health_report": M.sql("SELECT count(*) AS files, round(coalesce(avg(score), 10), 6) AS average, round(CASE WHEN sum(lines) > 0 THEN sum(score * lines) / sum(lines) ELSE avg(score) END, 6) AS by_lines FROM sc", *_ALL, _W, _SCORES),
    "known_markers": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{s}', {ln}, '{k}', '{d}')" for f, s, ln, k, d in known.FINDINGS) + ") AS t(file, symbol, line, kind, detail)",
    "score_weights": f"WITH {_W} SELECT * FROM w",
    "worst_files": M.sql("SELECT file, score, findings FROM sc ORDER BY score, findings DESC, file LIMIT 50", *_ALL, _W, _SCORES),
}
