"""Queries on change history, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import history as H
from codestrata.plans import model as M
from codestrata.session import Scratch


def _both(spark, sf_dir):
    return M.commits(spark, sf_dir), M.commit_files(spark, sf_dir)


@M.once
def _history(spark, sf_dir):
    return H.file_history(*_both(spark, sf_dir), M.NOW)


@M.once
def _pairs(spark, sf_dir):
    """Pairs of files that change together three times or more."""
    return H.co_changes(M.commit_files(spark, sf_dir), 3)


def churn_by_file(spark, sf_dir):
    return _history(spark, sf_dir).select("file", "churn", F.round("decayed_churn", 6).alias("decayed_churn"), "fixes", "authors")


def last_touch(spark, sf_dir):
    return H.last_touch(*_both(spark, sf_dir))


def _complexity(spark, sf_dir):
    return M.symbols(spark, sf_dir).groupBy("file").agg(F.coalesce(F.sum("complexity"), F.lit(0)).alias("complexity"))


def _hotspots(spark, sf_dir):
    h = _history(spark, sf_dir)
    live = M.files(spark, sf_dir).select("repo", "file")
    x = live.join(h, "file").join(_complexity(spark, sf_dir), "file", "left").withColumn("complexity", F.coalesce("complexity", F.lit(0)))
    return x.select("repo", "file", "churn", "complexity", (F.col("churn") * F.col("complexity")).alias("score"), F.round(F.col("decayed_churn") * F.col("complexity"), 4).alias("decayed_score"))


def hotspots_topk(spark, sf_dir):
    """The 50 files that change most for their complexity, recent changes counting more."""
    return _hotspots(spark, sf_dir).orderBy(F.col("decayed_score").desc(), "file").limit(50)


def hot_paths(spark, sf_dir):
    """Per repo the files on its hot path: a quarter of those with a score, ten at most and one at least."""
    from pyspark.sql import Window

    x = _hotspots(spark, sf_dir).where("score > 0")
    n = x.groupBy("repo").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("decayed_score").desc(), "file"))
    top = x.withColumn("rank", rank).where("rank <= 10")  # cut in each task before the shuffle
    return top.join(n, "repo").where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))).select("repo", "file", "rank")


def cochange_pairs(spark, sf_dir):
    """The 100 pairs that change together most often, three times at least."""
    return _pairs(spark, sf_dir).orderBy(F.col("count").desc(), "file_a", "file_b").limit(100)


def workspace_cochanges(spark, sf_dir):
    """The five strongest pairs of each repo."""
    from pyspark.sql import Window

    pairs = H.co_changes(M.commit_files(spark, sf_dir), 1).withColumn("repo", F.substring_index("file_a", "/", 1))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("count").desc(), "file_a", "file_b"))
    return pairs.withColumn("rank", rank).where("rank <= 5").select("repo", "rank", "file_a", "file_b", "count")


def coupled_files(spark, sf_dir):
    """The strongest three partners of every file."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.col("count").desc(), "partner"))
    return H.both_ways(H.co_changes(M.commit_files(spark, sf_dir), 1)).withColumn("rank", rank).where("rank <= 3").select("file", "partner", "count", "rank")


def cochange_partner_count(spark, sf_dir):
    return H.both_ways(_pairs(spark, sf_dir)).groupBy("file").agg(F.count("*").alias("partners"))


def hidden_coupling(spark, sf_dir):
    """Pairs that change together three times or more though neither imports the other."""
    edges = M.import_edges(spark, sf_dir)
    linked = edges.select(F.least("src", "dst").alias("file_a"), F.greatest("src", "dst").alias("file_b")).distinct()
    return _pairs(spark, sf_dir).join(linked, ["file_a", "file_b"], "left_anti")


def ownership_share(spark, sf_dir):
    commits, touched = _both(spark, sf_dir)
    return H.ownership(touched, commits).select("file", "author", "lines", F.round("share", 6).alias("share"))


def bus_factor(spark, sf_dir):
    commits, touched = _both(spark, sf_dir)
    return H.bus_factor(H.ownership(touched, commits))


def bus_factor_histogram(spark, sf_dir):
    return bus_factor(spark, sf_dir).groupBy("bus_factor").agg(F.count("*").alias("files"))


def contributors(spark, sf_dir):
    """Lines and files per author in the 200 largest files, and the author's part of all their lines."""
    largest = M.files(spark, sf_dir).orderBy(F.col("lines").desc(), "file").limit(200).select("file")
    owned = ownership_share(spark, sf_dir).join(largest, "file", "left_semi")
    per = owned.groupBy("author").agg(F.sum("lines").alias("lines"), F.count("*").alias("files"))
    total = owned.agg(F.sum("lines").alias("t")).scalar()
    return per.select("author", "lines", "files", F.round(100.0 * F.col("lines") / total, 4).alias("percent"))


def recent_authors(spark, sf_dir):
    return H.recent_authors(*_both(spark, sf_dir), M.NOW)


def org_signals(spark, sf_dir):
    """Per file: churn, fixes, bus factor, partners and recent authors; 0 where there is none."""
    x = _history(spark, sf_dir).select("file", "churn", "fixes")
    for other, column in ((bus_factor(spark, sf_dir), "bus_factor"), (cochange_partner_count(spark, sf_dir), "partners"), (recent_authors(spark, sf_dir), "recent_authors")):
        x = x.join(other, "file", "left").withColumn(column, F.coalesce(column, F.lit(0)))
    return x


def change_risk(spark, sf_dir):
    return H.change_risk(*_both(spark, sf_dir), Scratch(spark, "risk"))


def punch_card(spark, sf_dir):
    return H.punch_card(M.commits(spark, sf_dir))


def weekly_trend(spark, sf_dir):
    return H.weekly_trend(M.commits(spark, sf_dir), M.NOW)


def recent_log(spark, sf_dir):
    """The 20 newest commits of each repo."""
    return M.commits(spark, sf_dir).where("log_ord < 20").select("repo", "log_ord", "hash", "author", "ts", "message")


_NOW = M.NOW
_HIST = f"""h AS (SELECT file, count(*) AS churn, sum(exp(-(greatest({_NOW} - ts, 0) / 86400.0) / 90.0)) AS decayed, count(*) FILTER (regexp_matches(lower(message), 'fix|bug|hotfix|patch')) AS fixes,
  count(DISTINCT author) AS authors FROM touched JOIN commits_all USING (hash) GROUP BY file)"""
_CX = "cx AS (SELECT file, CAST(coalesce(sum(complexity), 0) AS BIGINT) AS complexity FROM symbols_now GROUP BY file)"
_HOT = "hot AS (SELECT f.repo, h.file, churn, coalesce(complexity, 0) AS complexity, churn * coalesce(complexity, 0) AS score, round(decayed * coalesce(complexity, 0), 4) AS decayed_score FROM files_now f JOIN h USING (file) LEFT JOIN cx USING (file))"
_PAIRS = """sized AS (SELECT hash FROM touched GROUP BY hash HAVING count(*) BETWEEN 2 AND 50), s AS (SELECT t.* FROM touched t JOIN sized USING (hash)),
pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS count FROM s a JOIN s b ON a.hash = b.hash AND a.file < b.file GROUP BY ALL),
ways AS (SELECT file_a AS file, file_b AS partner, count FROM pairs UNION ALL SELECT file_b, file_a, count FROM pairs)"""
_OWN = """o AS (SELECT file, author, sum(added) AS lines FROM touched JOIN commits_all USING (hash) WHERE author IS NOT NULL AND added > 0 GROUP BY ALL),
own AS (SELECT file, author, CAST(lines AS BIGINT) AS lines, lines / sum(lines) OVER (PARTITION BY file) AS share FROM o),
bus0 AS (SELECT file, row_number() OVER w AS r, sum(lines) OVER (w ROWS UNBOUNDED PRECEDING) AS held, sum(lines) OVER (PARTITION BY file) AS t FROM own WINDOW w AS (PARTITION BY file ORDER BY lines DESC, author)),
bus AS (SELECT file, min(r) AS bus_factor FROM bus0 WHERE held * 2 >= t GROUP BY file)"""
_REC = f"rec AS (SELECT file, count(DISTINCT author) AS recent_authors FROM touched JOIN commits_all USING (hash) WHERE ts >= {_NOW - 90 * 86400} AND author IS NOT NULL GROUP BY file)"
_PART = "part AS (SELECT file, count(*) AS partners FROM ways WHERE count >= 3 GROUP BY file)"
ORG = f"org AS (SELECT h.file, churn, fixes, coalesce(bus_factor, 0) AS bus_factor, coalesce(partners, 0) AS partners, coalesce(recent_authors, 0) AS recent_authors FROM h LEFT JOIN bus USING (file) LEFT JOIN part USING (file) LEFT JOIN rec USING (file))"
LINKED = "linked AS (SELECT DISTINCT least(src, dst) AS file_a, greatest(src, dst) AS file_b FROM import_pairs)"
HISTORY_SQL = (_HIST, _PAIRS, _OWN, _REC, _PART, ORG, LINKED)

QUERIES = {
    f.__name__: f
    for f in (churn_by_file, last_touch, hotspots_topk, hot_paths, cochange_pairs, workspace_cochanges, coupled_files, cochange_partner_count, hidden_coupling, ownership_share, bus_factor,
              bus_factor_histogram, contributors, recent_authors, org_signals, change_risk, punch_card, weekly_trend, recent_log)
}
SQL = {
    "churn_by_file": M.sql("SELECT file, churn, round(decayed, 6) AS decayed_churn, fixes, authors FROM h", _HIST),
    "last_touch": M.sql("SELECT file, arg_min(substr(hash, 1, 7), log_ord) AS hash7, (min({'o': log_ord, 'a': author})).a AS author FROM touched JOIN commits_all USING (hash) GROUP BY file"),
    "hotspots_topk": M.sql("SELECT * FROM hot ORDER BY decayed_score DESC, file LIMIT 50", _HIST, _CX, _HOT),
    "hot_paths": M.sql("SELECT repo, file, rank FROM (SELECT repo, file, count(*) OVER (PARTITION BY repo) AS n, row_number() OVER (PARTITION BY repo ORDER BY decayed_score DESC, file) AS rank FROM hot WHERE score > 0) WHERE rank <= least(10, greatest(1, n // 4))", _HIST, _CX, _HOT),
    "cochange_pairs": M.sql("SELECT * FROM pairs WHERE count >= 3 ORDER BY count DESC, file_a, file_b LIMIT 100", _PAIRS),
    "workspace_cochanges": M.sql("SELECT * FROM (SELECT split_part(file_a, '/', 1) AS repo, row_number() OVER (PARTITION BY split_part(file_a, '/', 1) ORDER BY count DESC, file_a, file_b) AS rank, file_a, file_b, count FROM pairs) WHERE rank <= 5", _PAIRS),
    "coupled_files": M.sql("SELECT * FROM (SELECT file, partner, count, row_number() OVER (PARTITION BY file ORDER BY count DESC, partner) AS rank FROM ways) WHERE rank <= 3", _PAIRS),
    "cochange_partner_count": M.sql("SELECT * FROM part", _PAIRS, _PART),
    "hidden_coupling": M.sql("SELECT p.* FROM pairs p WHERE count >= 3 AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.file_a = p.file_a AND l.file_b = p.file_b)", _PAIRS, LINKED),
    "ownership_share": M.sql("SELECT file, author, lines, round(share, 6) AS share FROM own", _OWN),
    "bus_factor": M.sql("SELECT * FROM bus", _OWN),
    "bus_factor_histogram": M.sql("SELECT bus_factor, count(*) AS files FROM bus GROUP BY ALL", _OWN),
    "contributors": M.sql("SELECT author, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS files, round(100.0 * sum(lines) / (SELECT sum(lines) FROM top), 4) AS percent FROM top GROUP BY author", _OWN, "top AS (SELECT * FROM own WHERE file IN (SELECT file FROM files_now ORDER BY lines DESC, file LIMIT 200))"),
    "recent_authors": M.sql("SELECT * FROM rec", _REC),
    "org_signals": M.sql("SELECT * FROM org", *HISTORY_SQL),
    "change_risk": M.sql(
        """SELECT hash, files, lines, subsystems, round(entropy, 6) AS entropy, prior, round(10.0 * (0.20 * least(files / 20.0, 1.0) + 0.25 * least(lines / 500.0, 1.0) + 0.20 * least(subsystems / 8.0, 1.0) + 0.15 * entropy + 0.20 * (1.0 - least(prior / 50.0, 1.0))) + 1e-9, 1) AS risk FROM e""",
        """z AS (SELECT hash, coalesce(added, 0) + coalesce(deleted, 0) AS v, split_part(regexp_replace(file, '^[^/]*/', ''), '/', 1) AS sub FROM touched),
        sh AS (SELECT hash, count(*) AS files, CAST(sum(v) AS BIGINT) AS lines, sum(CASE WHEN v > 0 THEN v * log2(v) ELSE 0 END) AS w, count(DISTINCT sub) AS subsystems FROM z GROUP BY hash),
        pr AS (SELECT hash, CASE WHEN author_email IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY repo, author_email ORDER BY log_ord DESC, hash) - 1 END AS prior FROM commits_all),
        e AS (SELECT *, CASE WHEN files < 2 OR lines <= 0 THEN 0.0 ELSE greatest((log2(lines) - w / lines) / log2(files), 0.0) END AS entropy FROM sh JOIN pr USING (hash))""",
    ),
    "punch_card": M.sql("""SELECT CAST(d AS INTEGER) AS day, CAST(t AS INTEGER) AS hour, count(ts) AS commits FROM range(7) a(d) CROSS JOIN range(24) b(t)
        LEFT JOIN commits_all ON ts >= 0 AND (ts // 86400 + 4) % 7 = d AND ts % 86400 // 3600 = t GROUP BY d, t"""),
    "weekly_trend": M.sql(f"SELECT CAST(w AS INTEGER) AS weeks_ago, count(ts) AS commits FROM range(26) a(w) LEFT JOIN commits_all ON ts >= 0 AND greatest({_NOW} - ts, 0) // 604800 = w GROUP BY w"),
    "recent_log": M.sql("SELECT repo, log_ord, hash, author, ts, message FROM commits_all WHERE log_ord < 20"),
}
