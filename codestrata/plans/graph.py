"""Queries on the dependency graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codestrata.operators import graph as G
from codestrata.plans import model as M
from codestrata.session import Scratch, table


def overview_counts(spark, sf_dir):
    return M.files(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def symbol_kinds(spark, sf_dir):
    return M.symbols(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("symbols"))


def edge_totals(spark, sf_dir):
    """Edges of each kind; call sites count one by one."""
    one = lambda df, kind: df.agg(F.count("*").alias("edges")).select(F.lit(kind).alias("kind"), "edges")
    contains = M.symbols(spark, sf_dir).join(M.files(spark, sf_dir).select("file"), "file", "left_semi")
    return one(contains, "contains").unionByName(one(M.import_edges(spark, sf_dir), "imports")).unionByName(_calls(spark, sf_dir).agg(F.coalesce(F.sum("sites"), F.lit(0)).alias("edges")).select(F.lit("calls").alias("kind"), "edges"))


def dependencies_of(spark, sf_dir):
    """Files and each file they import."""
    return M.import_edges(spark, sf_dir).select(F.col("src").alias("file"), F.col("dst").alias("dependency"))


def dependents_of(spark, sf_dir):
    """Files and each file that imports them; a popular target's may be any number."""
    return M.import_edges(spark, sf_dir).select(F.col("dst").alias("file"), F.col("src").alias("dependent"))


def top_depended(spark, sf_dir):
    return M.import_edges(spark, sf_dir).groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("dependents")).orderBy(F.col("dependents").desc(), "file").limit(10)


def _nodes(spark, sf_dir):
    return M.symbols(spark, sf_dir).join(M.files(spark, sf_dir).select("file", "file_ord"), "file")


@M.once
def _calls(spark, sf_dir):
    calls = table(spark, sf_dir, "calls").select("file", "caller", "callee_name", "line").distinct()
    return G.call_edges(calls, _nodes(spark, sf_dir))


def call_in_degree(spark, sf_dir):
    return G.in_degree(_nodes(spark, sf_dir), _calls(spark, sf_dir)).where("n > 0")


def dead_code(spark, sf_dir):
    loose = table(spark, sf_dir, "imports").where("resolved_file IS NULL").select(F.lower(F.regexp_extract("path", r"([^/.:]+)$", 1)).alias("stem")).where("stem <> ''").distinct()
    return G.dead_code(_nodes(spark, sf_dir), _calls(spark, sf_dir), M.files(spark, sf_dir), loose)


def dead_code_listing(spark, sf_dir):
    """The first 100 findings of medium confidence or more, by file and symbol, each with how many there are in all."""
    x = dead_code(spark, sf_dir).where("confidence <> 'low'")
    total = x.agg(F.count("*").alias("n")).scalar()
    return x.select(F.regexp_extract("id", "^(.*?)::", 1).alias("file"), "id", "confidence").orderBy("file", "id").limit(100).withColumn("total", total)


def import_sccs(spark, sf_dir):
    return G.strongly_connected(Scratch(spark, "scc"), M.import_edges(spark, sf_dir))


def dependency_closure(spark, sf_dir):
    """What the file that is first by name among importers of the largest repo reaches, and in how many hops."""
    edges = M.import_edges(spark, sf_dir)
    start = edges.agg(F.min("src").alias("id"))
    return G.reachable(Scratch(spark, "reach"), edges, start)


def repo_edges(spark, sf_dir):
    """Imports that cross repos, counted."""
    e = M.import_edges(spark, sf_dir).select(F.substring_index("src", "/", 1).alias("from_repo"), F.substring_index("dst", "/", 1).alias("to_repo"))
    return e.where("from_repo <> to_repo").groupBy("from_repo", "to_repo").agg(F.count("*").alias("edges"))


def _repo_graph(spark, sf_dir):
    return repo_edges(spark, sf_dir).select(F.col("from_repo").alias("src"), F.col("to_repo").alias("dst"))


def repo_closure(spark, sf_dir):
    return G.closure(Scratch(spark, "closure"), _repo_graph(spark, sf_dir))


def repo_cycles(spark, sf_dir):
    return G.strongly_connected(Scratch(spark, "scc"), _repo_graph(spark, sf_dir))


def workspace_metrics(spark, sf_dir):
    """Propagation cost (reachable pairs over all pairs), repos on cycles, and a coupling score from 1 to 10; a workspace of one repo or none has NULL.

    The score takes the cost less its floor 1/n, over the rest of its range, as 0.7 of itself and the share of repos on cycles as 0.3.
    """
    repos = M.files(spark, sf_dir).select("repo").distinct()
    reach = repo_closure(spark, sf_dir).where("src <> dst").agg(F.count("*").alias("pairs"))
    cyc = repo_cycles(spark, sf_dir).agg(F.count("*").alias("cyclic"))
    x = repos.agg(F.count("*").alias("repos")).join(reach).join(cyc)
    n = F.col("repos")
    cost = (F.col("pairs") + n) / (n * n)
    part = F.least(F.greatest((cost - 1 / n) / (1 - 1 / n), F.lit(0.0)), F.lit(1.0))
    score = 1 + 9 * (0.7 * part + 0.3 * F.col("cyclic") / n)
    return x.select("repos", F.round(F.when(n > 1, cost), 6).alias("propagation_cost"), "cyclic", F.round(F.when(n > 1, score), 4).alias("score"))


def blast_radius(spark, sf_dir):
    """Imports from another repo, by the file they reach."""
    e = M.import_edges(spark, sf_dir).where(F.substring_index("src", "/", 1) != F.substring_index("dst", "/", 1))
    return e.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("importers"), F.countDistinct(F.substring_index("src", "/", 1)).alias("repos"))


def _module(c):
    return F.regexp_replace(c, r"/[^/]*$", "")


def module_rollup(spark, sf_dir):
    """Distinct imports between directories."""
    e = M.import_edges(spark, sf_dir).select(_module("src").alias("from_dir"), _module("dst").alias("to_dir")).where("from_dir <> to_dir")
    return e.distinct()


def module_nodes(spark, sf_dir):
    """The 150 directories with most links, with files, lines and their modal language (ties: the smaller name)."""
    e = module_rollup(spark, sf_dir)
    degree = e.select(F.explode(F.array("from_dir", "to_dir")).alias("dir")).groupBy("dir").agg(F.count("*").alias("degree"))
    files = M.files(spark, sf_dir).withColumn("dir", _module("file"))
    langs = files.groupBy("dir", "language").agg(F.count("*").alias("n"), F.sum("lines").alias("l"))
    modal = langs.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("m"), F.sum("n").alias("files"), F.sum("l").alias("lines"))
    return modal.join(degree, "dir").select("dir", "degree", "files", "lines", F.col("m.language").alias("language")).orderBy(F.col("degree").desc(), "dir").limit(150)


def file_graph_slice(spark, sf_dir):
    """Imports among the 150 files with most links."""
    e = M.import_edges(spark, sf_dir)
    top = e.select(F.explode(F.array("src", "dst")).alias("file")).groupBy("file").agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "file").limit(150).select("file")
    return e.join(top.withColumnRenamed("file", "src"), "src", "left_semi").join(top.withColumnRenamed("file", "dst"), "dst", "left_semi")


def communities(spark, sf_dir):
    return G.communities(Scratch(spark, "communities"), M.import_edges(spark, sf_dir))


def community_rollup(spark, sf_dir):
    """Files, lines, repos and the most frequent language (ties: the smaller name) of each community."""
    c = communities(spark, sf_dir).withColumnRenamed("id", "file")
    x = c.join(M.files(spark, sf_dir), "file")
    langs = x.groupBy("community", "language").agg(F.count("*").alias("n")).groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("m")).select("community", F.col("m.language").alias("language"))
    return x.groupBy("community").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.countDistinct("repo").alias("repos")).join(langs, "community")


def god_class(spark, sf_dir):
    """Classes of more than two methods; the health marker fires above fifteen, which does not occur here."""
    return M.symbols(spark, sf_dir).where("kind = 'Method' AND parent IS NOT NULL").groupBy("file", "parent").agg(F.count("*").alias("methods")).where("methods > 2")


@M.once
def lcom4_components(spark, sf_dir):
    accesses = table(spark, sf_dir, "field_accesses").select("method", "field_name").distinct()
    return G.cohesion(Scratch(spark, "cohesion"), accesses, M.symbols(spark, sf_dir).where("kind = 'Method'"))


def duplicate_code(spark, sf_dir):
    """Functions and methods with the body of another, and how many there are of it."""
    s = M.symbols(spark, sf_dir).where("body_hash IS NOT NULL").select("id", "body_hash")
    n = s.groupBy("body_hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies >= 2")
    return s.join(n, "body_hash").select("id", "copies", "first_id")


def exact_duplicate_pairs(spark, sf_dir):
    """Each copy of a body with the body's first bearer."""
    return duplicate_code(spark, sf_dir).where("id <> first_id").select(F.col("first_id").alias("a"), F.col("id").alias("b"))


def call_edges(spark, sf_dir):
    return _calls(spark, sf_dir)


def cross_repo_imports(spark, sf_dir):
    """Unresolved imports whose last part is the stem of a file in another repo; the first repo by name wins, then its first file."""
    files = M.files(spark, sf_dir).select(F.col("repo").alias("to_repo"), F.col("file").alias("to_file"), F.lower(F.regexp_extract("file", r"([^/.]+)(?:\.[^/]*)?$", 1)).alias("stem"))
    own = files.select("to_repo", "stem").distinct()
    imports = table(spark, sf_dir, "imports").where("resolved_file IS NULL").select("file", "path").distinct()
    imports = imports.withColumn("repo", F.substring_index("file", "/", 1)).withColumn("stem", F.lower(F.regexp_extract("path", r"([^/.:]+)$", 1))).where("stem <> ''")
    imports = imports.join(own.withColumnRenamed("to_repo", "repo"), ["repo", "stem"], "left_anti")
    first = files.groupBy("stem", "to_repo").agg(F.min("to_file").alias("to_file"))
    # two repos are enough to find the first one that is not the importer's own
    rank = F.row_number().over(Window.partitionBy("stem").orderBy("to_repo"))
    first = first.withColumn("rank", rank).where("rank <= 2").drop("rank")
    hit = imports.join(first, "stem").where("repo <> to_repo")
    return hit.groupBy("file", "path").agg(F.min(F.struct("to_repo", "to_file")).alias("m")).select("file", "path", "m.to_repo", "m.to_file")


_CALLS = """nodes AS (SELECT s.*, file_ord FROM symbols_now s JOIN files_now USING (file)),
fn AS (SELECT * FROM nodes WHERE kind IN ('Function', 'Method')),
sites AS (SELECT DISTINCT file, caller, callee_name, line FROM calls WHERE caller IN (SELECT id FROM nodes)),
same AS (SELECT caller AS src, fn.id AS dst, s.line FROM sites s JOIN fn ON fn.file = s.file AND fn.name = s.callee_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_ord, file, sym_ord, id) AS rank FROM fn),
other AS (SELECT caller AS src, r.id AS dst, s.line FROM sites s JOIN ranked r ON r.name = s.callee_name AND rank <= 6 WHERE NOT EXISTS (SELECT 1 FROM fn WHERE fn.file = s.file AND fn.name = s.callee_name)),
call_all AS (SELECT * FROM (SELECT * FROM same UNION ALL SELECT * FROM other) WHERE src <> dst)"""
_REACH = "reach AS (SELECT src, dst FROM import_pairs UNION SELECT r.src, e.dst FROM reach r JOIN import_pairs e ON r.dst = e.src)"
_SCC = "SELECT r.src AS id, min(r.dst) AS component FROM reach r JOIN reach b ON r.src = b.dst AND r.dst = b.src GROUP BY r.src HAVING count(*) > 1"
_REPO = """rg AS (SELECT split_part(src, '/', 1) AS src, split_part(dst, '/', 1) AS dst, count(*) AS edges FROM import_pairs WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1) GROUP BY ALL),
rr AS (SELECT src, dst FROM rg UNION SELECT r.src, e.dst FROM rr r JOIN rg e ON r.dst = e.src),
rscc AS (SELECT r.src AS id, min(r.dst) AS component FROM rr r JOIN rr b ON r.src = b.dst AND r.dst = b.src GROUP BY r.src HAVING count(*) > 1),
rclose AS (SELECT src, dst FROM rr UNION SELECT src, src FROM rg UNION SELECT dst, dst FROM rg)"""
_DIRS = "dirs AS (SELECT DISTINCT regexp_replace(src, '/[^/]*$', '') AS from_dir, regexp_replace(dst, '/[^/]*$', '') AS to_dir FROM import_pairs WHERE regexp_replace(src, '/[^/]*$', '') <> regexp_replace(dst, '/[^/]*$', ''))"
_DUP = "dup AS (SELECT body_hash, count(*) AS copies, min(id) AS first_id FROM symbols_now WHERE body_hash IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)"
_LCOM = """m AS (SELECT DISTINCT parent, method, field_name FROM field_accesses JOIN symbols_now s ON s.id = method WHERE kind = 'Method' AND parent IS NOT NULL),
ml AS (SELECT DISTINCT a.parent, a.method AS x, b.method AS y FROM m a JOIN m b ON a.parent = b.parent AND a.field_name = b.field_name),
mr AS (SELECT parent, x, y FROM ml UNION SELECT r.parent, r.x, l.y FROM mr r JOIN ml l ON r.parent = l.parent AND r.y = l.x),
mc AS (SELECT parent, x, min(y) AS c FROM mr GROUP BY parent, x)"""
_STEM = "lower(regexp_extract(path, '([^/.:]+)$', 1))"

QUERIES = {
    f.__name__: f
    for f in (overview_counts, symbol_kinds, edge_totals, dependencies_of, dependents_of, top_depended, call_in_degree, call_edges, dead_code, dead_code_listing, import_sccs, dependency_closure, repo_edges, repo_closure, repo_cycles,
              workspace_metrics, blast_radius, module_rollup, module_nodes, file_graph_slice, communities, community_rollup, god_class, lcom4_components, duplicate_code, exact_duplicate_pairs, cross_repo_imports)
}
SQL = {
    "overview_counts": M.sql("SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM files_now GROUP BY 1"),
    "symbol_kinds": M.sql("SELECT kind, count(*) AS symbols FROM symbols_now GROUP BY 1"),
    "edge_totals": M.sql("SELECT 'contains' AS kind, count(*) AS edges FROM nodes UNION ALL SELECT 'imports', count(*) FROM import_pairs UNION ALL SELECT 'calls', count(*) FROM call_all", _CALLS),
    "dependencies_of": M.sql("SELECT src AS file, dst AS dependency FROM import_pairs"),
    "dependents_of": M.sql("SELECT dst AS file, src AS dependent FROM import_pairs"),
    "top_depended": M.sql("SELECT dst AS file, count(*) AS dependents FROM import_pairs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "call_in_degree": M.sql("SELECT dst AS id, count(*) AS n FROM call_all GROUP BY 1", _CALLS),
    "call_edges": M.sql("SELECT src, dst, count(*) AS sites FROM call_all GROUP BY ALL", _CALLS),
    "dead_code": M.sql(
        f"""SELECT id, ['high', 'medium', 'low'][1 + CAST(n > 1 AS INTEGER) + CAST(stem IN (SELECT s FROM loose) AS INTEGER)] AS confidence
        FROM (SELECT fn.id, name, lower(regexp_extract(file, '([^/]*?)(\\.[^./]*)?$', 1)) AS stem FROM fn JOIN files_now f USING (file) WHERE language <> 'Shell' AND id NOT IN (SELECT dst FROM call_all)) u
        JOIN (SELECT name, count(*) AS n FROM nodes GROUP BY 1) t USING (name)""",
        _CALLS, f"loose AS (SELECT DISTINCT {_STEM} AS s FROM imports WHERE resolved_file IS NULL)",
    ),
    "dead_code_listing": M.sql(
        f"""SELECT regexp_extract(id, '^(.*?)::', 1) AS file, id, confidence, (SELECT count(*) FROM dc WHERE confidence <> 'low') AS total FROM dc WHERE confidence <> 'low' ORDER BY file, id LIMIT 100""",
        _CALLS, f"loose AS (SELECT DISTINCT {_STEM} AS s FROM imports WHERE resolved_file IS NULL)",
        """dc AS (SELECT id, ['high', 'medium', 'low'][1 + CAST(n > 1 AS INTEGER) + CAST(stem IN (SELECT s FROM loose) AS INTEGER)] AS confidence
        FROM (SELECT fn.id, name, lower(regexp_extract(file, '([^/]*?)(\\.[^./]*)?$', 1)) AS stem FROM fn JOIN files_now f USING (file) WHERE language <> 'Shell' AND id NOT IN (SELECT dst FROM call_all)) u
        JOIN (SELECT name, count(*) AS n FROM nodes GROUP BY 1) t USING (name))""",
    ),
    "import_sccs": M.sql(_SCC, _REACH),
    "dependency_closure": M.sql("SELECT id, min(hops) AS hops FROM walk GROUP BY 1", "walk AS (SELECT min(src) AS id, 0 AS hops FROM import_pairs UNION SELECT dst, hops + 1 FROM walk JOIN import_pairs ON src = id WHERE hops < 40)"),
    "repo_edges": M.sql("SELECT src AS from_repo, dst AS to_repo, edges FROM rg", _REPO),
    "repo_closure": M.sql("SELECT * FROM rclose", _REPO),
    "repo_cycles": M.sql("SELECT * FROM rscc", _REPO),
    "workspace_metrics": M.sql(
        """SELECT repos, round(CASE WHEN n > 1 THEN cost END, 6) AS propagation_cost, cyclic, round(CASE WHEN n > 1 THEN 1 + 9 * (0.7 * least(greatest((cost - 1 / n) / (1 - 1 / n), 0.0), 1.0) + 0.3 * cyclic / n) END, 4) AS score
        FROM (SELECT n AS repos, CAST(n AS DOUBLE) AS n, (pairs + n) / (CAST(n AS DOUBLE) * n) AS cost, cyclic FROM (SELECT (SELECT count(DISTINCT repo) FROM files_now) AS n, (SELECT count(*) FROM rclose WHERE src <> dst) AS pairs, (SELECT count(*) FROM rscc) AS cyclic))""", _REPO,
    ),
    "blast_radius": M.sql("SELECT dst AS file, count(*) AS importers, count(DISTINCT split_part(src, '/', 1)) AS repos FROM import_pairs WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1) GROUP BY 1"),
    "module_rollup": M.sql("SELECT * FROM dirs", _DIRS),
    "module_nodes": M.sql(
        """SELECT dir, degree, files, CAST(lines AS BIGINT) AS lines, language FROM (SELECT dir, count(*) AS degree FROM (SELECT from_dir AS dir FROM dirs UNION ALL SELECT to_dir FROM dirs) GROUP BY 1)
        JOIN (SELECT dir, CAST(sum(n) AS BIGINT) AS files, sum(l) AS lines, arg_min(language, r) AS language FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, language) AS r
          FROM (SELECT regexp_replace(file, '/[^/]*$', '') AS dir, language, count(*) AS n, sum(lines) AS l FROM files_now GROUP BY ALL)) GROUP BY dir) USING (dir) ORDER BY degree DESC, dir LIMIT 150""", _DIRS,
    ),
    "file_graph_slice": M.sql("SELECT src, dst FROM import_pairs WHERE src IN (SELECT file FROM top) AND dst IN (SELECT file FROM top)", "top AS (SELECT file, count(*) AS d FROM (SELECT src AS file FROM import_pairs UNION ALL SELECT dst FROM import_pairs) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 150)"),
    "god_class": M.sql("SELECT file, parent, count(*) AS methods FROM symbols_now WHERE kind = 'Method' AND parent IS NOT NULL GROUP BY ALL HAVING count(*) > 2"),
    "lcom4_components": M.sql("SELECT parent, count(*) AS methods, count(DISTINCT c) AS components FROM mc GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT c) >= 2", _LCOM),
    "duplicate_code": M.sql("SELECT id, copies, first_id FROM symbols_now JOIN dup USING (body_hash)", _DUP),
    "exact_duplicate_pairs": M.sql("SELECT first_id AS a, id AS b FROM symbols_now JOIN dup USING (body_hash) WHERE id <> first_id", _DUP),
    "cross_repo_imports": M.sql(
        """SELECT file, path, (m).r AS to_repo, (m).f AS to_file FROM (SELECT i.file, path, min({'r': s.repo, 'f': s.f}) AS m FROM i JOIN st s USING (stem) WHERE i.repo <> s.repo AND NOT EXISTS (SELECT 1 FROM st o WHERE o.repo = i.repo AND o.stem = i.stem) GROUP BY ALL)""",
        "st AS (SELECT repo, lower(regexp_extract(file, '([^/.]+)(\\.[^/]*)?$', 1)) AS stem, min(file) AS f FROM files_now GROUP BY ALL)",
        f"i AS (SELECT DISTINCT file, path, split_part(file, '/', 1) AS repo, {_STEM} AS stem FROM imports WHERE resolved_file IS NULL AND {_STEM} <> '')",
    ),
}
