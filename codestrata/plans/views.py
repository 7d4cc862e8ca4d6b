"""Queries on search, domains, tours and contracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import contracts as K
from codestrata.operators import domains as D
from codestrata.operators import search as S
from codestrata.operators import tour as R
from codestrata.plans import graph
from codestrata.plans import model as M
from codestrata.session import Scratch, table

QUERY = "token"
CONTAINER_SHARE = 0.2


def _inner():
    return F.regexp_replace("file", r"^[^/]*/", "")


def symbol_search(spark, sf_dir):
    return S.symbol_search(M.symbols(spark, sf_dir), QUERY).select("id", "name", "kind")


def path_search(spark, sf_dir):
    return S.path_search(M.files(spark, sf_dir), QUERY, _inner()).select("repo", "file")


def hybrid_search(spark, sf_dir):
    return S.hybrid(M.symbols(spark, sf_dir), M.files(spark, sf_dir), QUERY, _inner())


def search_filtered(spark, sf_dir):
    """The first 100 functions in implementation files whose name holds the query, over all repos, by name, file and repo."""
    files = M.files(spark, sf_dir).select("repo", "file", S.role(_inner(), F.col("language")).alias("role")).where(F.col("role") == S.parse_kind("impl")).select("repo", "file")
    hits = S.symbol_search(M.symbols(spark, sf_dir).where(F.col("kind") == S.parse_symbol_kind("function")), QUERY)
    return hits.join(files, "file").select("name", "file", "repo", "id").orderBy("name", "file", "repo", "id").limit(100)


def search_ranked(spark, sf_dir):
    """The 20 most called symbols of each repo whose name holds the query."""
    hits = S.symbol_search(M.symbols(spark, sf_dir), QUERY).withColumn("repo", F.substring_index("file", "/", 1))
    return S.ranked(hits, graph.call_in_degree(spark, sf_dir), "repo", "id", "name").select("repo", "rank", "id", "n")


def files_ranked(spark, sf_dir):
    """The 20 most imported files of each repo whose path holds the query."""
    hits = S.path_search(M.files(spark, sf_dir), QUERY, _inner())
    n = M.import_edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return S.ranked(hits, n, "repo", "file", "file").select("repo", "rank", "file", "n")


def file_roles(spark, sf_dir):
    return M.files(spark, sf_dir).select("file", S.role(_inner(), F.col("language")).alias("role"))


def files_view(spark, sf_dir):
    """The 200 largest files."""
    return M.files(spark, sf_dir).orderBy(F.col("lines").desc(), "file").limit(200).select("file", "language", "lines")


def symbols_listing(spark, sf_dir):
    return M.symbols(spark, sf_dir).where("kind = 'Class'").orderBy("id").limit(100).select("id", "file", "start_line", "end_line")


def domain_vocabulary(spark, sf_dir):
    f = M.files(spark, sf_dir)
    return D.vocabulary(f, D.path_terms(f))


def domain_assignment(spark, sf_dir):
    f = M.files(spark, sf_dir)
    t = D.path_terms(f)
    return D.assign(t, D.vocabulary(f, t))


def shared_prefixes(spark, sf_dir):
    return D.shared_prefixes(M.files(spark, sf_dir))


def container_dirs(spark, sf_dir):
    """With a share lowered to a fifth, which these tables reach."""
    return D.containers(M.files(spark, sf_dir), CONTAINER_SHARE).select("repo", "depth", "dir", "files", F.round("share", 6).alias("share"))


def _steps(spark, sf_dir):
    s = table(spark, sf_dir, "tour_steps").distinct()
    return s.groupBy("repo", "file").agg(F.max("dependents").alias("dependents"), F.max("dependencies").alias("dependencies"), F.max("symbols").alias("symbols"), F.max("hotspot").alias("hotspot"), F.min("health").alias("health")).withColumn("role", R.role(F.col("dependents"), F.col("dependencies")))


def tour_roles(spark, sf_dir):
    return _steps(spark, sf_dir).select("file", "role")


def tour_rank(spark, sf_dir):
    """Each repo's 30 files to read first, by the six keys."""
    from pyspark.sql import Window

    return _steps(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*R.rank_order()))).where("rank <= 30").select("repo", "rank", "file")


def tour_selection(spark, sf_dir):
    """Ten files of each repo, two entry points among them if there are."""
    return R.select(_steps(spark, sf_dir), "repo", 10).select("repo", "step", "file", "role")


def tour_order(spark, sf_dir):
    """The layers of the import graph, so that what a file imports comes before it; files of one cycle share a layer."""
    return R.condensed_layers(Scratch(spark, "tour"), M.files(spark, sf_dir).select(F.col("file").alias("id")), M.import_edges(spark, sf_dir))


def url_path(spark, sf_dir):
    """The distinct addresses in the documents and their paths."""
    d = table(spark, sf_dir, "documents").where("text LIKE '%://%'")
    return d.select(F.explode(F.regexp_extract_all("text", F.lit(r"https?://[A-Za-z0-9.-]+[A-Za-z0-9/._?=&-]*"), F.lit(0))).alias("url")).distinct().select("url", K.path_of(F.col("url")).alias("path"))


def _routes(spark, sf_dir):
    """Stand-in for routes: addresses in documents, called by the document's repo. The first of each path is served as a template, its last segment free."""
    d = table(spark, sf_dir, "documents").where("text LIKE '%://%' AND source IS NOT NULL")
    x = d.select(F.substring_index("source", "/", 1).alias("repo"), F.explode(F.regexp_extract_all("text", F.lit(r"https?://[A-Za-z0-9.-]+[A-Za-z0-9/._?=&-]*"), F.lit(0))).alias("url"))
    x = x.select("repo", K.path_of(F.col("url")).alias("path")).where(F.size(K.segments(F.col("path"))) >= 2).distinct()
    calls = x.select(F.concat_ws(" ", "repo", "path").alias("id"), "repo", F.lit("GET").alias("method"), "path")
    served = x.groupBy(F.regexp_replace("path", r"[^/]+$", "{id}").alias("path")).agg(F.min("repo").alias("repo"))
    return calls, served.select(F.concat_ws(" ", "repo", "path").alias("id"), "repo", F.when(F.length("path") % 3 != 0, "GET").otherwise("POST").alias("method"), "path")


def contract_match(spark, sf_dir):
    return K.match(*_routes(spark, sf_dir)).where("producer_id IS NOT NULL").select("id", "producer_id")


def contract_unmatched_reason(spark, sf_dir):
    return K.match(*_routes(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("consumers"))


def contract_broken(spark, sf_dir):
    """Matches lost once the producers of the first repos by name are gone."""
    calls, served = _routes(spark, sf_dir)
    pairs = lambda p: K.match(calls, p).where("producer_id IS NOT NULL").select("id", "producer_id")
    return K.broken(pairs(served), pairs(served.where("repo >= 'd'")))


def orphan_producers(spark, sf_dir):
    calls, served = _routes(spark, sf_dir)
    return K.orphan_producers(served, K.match(calls, served)).select("id", "path")


_TERMS = r"""pt AS (SELECT repo, file, CAST(i - 1 AS INTEGER) AS depth, ps[i] AS part FROM (SELECT repo, file, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT repo, file, string_split(regexp_replace(regexp_replace(file, '^[^/]*/', ''), '\.[^./]*$', ''), '/') AS ps FROM files_now))),
terms AS (SELECT DISTINCT repo, file, depth, term FROM (SELECT repo, file, depth, unnest(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(part, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))), ' ')) AS term FROM pt) WHERE term <> ''),
dd AS (SELECT repo, file, d, unnest(range(0, len(d))) AS i FROM (SELECT repo, file, string_split(regexp_replace(file, '^[^/]*/', ''), '/')[:-2] AS d FROM files_now)),
kid AS (SELECT repo, file, array_to_string(d[1:i], '/') AS parent, d[i + 1] AS child FROM dd),
whole AS (SELECT repo, count(*) AS n_all FROM files_now GROUP BY 1),
par AS (SELECT repo, parent, count(DISTINCT child) AS children FROM kid JOIN whole USING (repo) GROUP BY repo, parent, n_all HAVING count(DISTINCT child) >= 8 AND count(*) >= 0.5 * n_all),
kt AS (SELECT DISTINCT repo, parent, children, child, term FROM (SELECT repo, parent, children, child, unnest(string_split(lower(trim(regexp_replace(child, '[^\p{L}\p{N}]+', ' ', 'g'))), ' ')) AS term FROM (SELECT DISTINCT repo, parent, child FROM kid) JOIN par USING (repo, parent)) WHERE term <> ''),
sp AS (SELECT DISTINCT repo, term FROM (SELECT repo, parent, children, term FROM kt GROUP BY ALL HAVING count(*) >= 0.6 * children)),
voc AS (SELECT repo, term, count(DISTINCT file) AS files FROM terms JOIN whole USING (repo) WHERE term NOT IN (""" + ", ".join(f"'{w}'" for w in D.LAYERS) + r""") AND NOT regexp_matches(term, '^\d+$') AND (repo, term) NOT IN (SELECT repo, term FROM sp)
  GROUP BY repo, term, n_all HAVING count(DISTINCT file) >= 3 AND count(DISTINCT file) <= 0.8 * n_all)"""
_TOUR = """st AS (SELECT repo, file, max(dependents) AS dependents, max(dependencies) AS dependencies, max(symbols) AS symbols, max(hotspot) AS hotspot, min(health) AS health FROM tour_steps GROUP BY ALL),
sr AS (SELECT *, CASE WHEN dependents = 0 AND dependencies = 0 THEN 'isolated' WHEN dependents = 0 THEN 'entry-point' WHEN dependencies = 0 THEN 'foundation' ELSE 'connector' END AS role FROM st),
rk AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY role = 'isolated', dependents DESC, coalesce(hotspot, 0) DESC, health ASC NULLS LAST, symbols DESC, file) AS rank FROM sr)"""
_SEL = """q AS (SELECT *, row_number() OVER (PARTITION BY repo, role ORDER BY rank) AS er, count(*) FILTER (role = 'entry-point' AND rank <= 10) OVER (PARTITION BY repo) AS have, count(*) FILTER (role = 'entry-point') OVER (PARTITION BY repo) AS there,
  row_number() OVER (PARTITION BY repo, role <> 'entry-point' AND rank <= 10 ORDER BY rank DESC) AS back FROM rk)"""
_URLS = "urls AS (SELECT source, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9.-]+[A-Za-z0-9/._?=&-]*')) AS url FROM documents WHERE text LIKE '%://%'), up AS (SELECT source, url, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT *, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '') AS p FROM urls))"
_ROUTES = _URLS + r""", rt AS (SELECT DISTINCT split_part(source, '/', 1) AS repo, path FROM up WHERE source IS NOT NULL AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 2),
served AS (SELECT repo || ' ' || path AS id, *, CASE WHEN length(path) % 3 <> 0 THEN 'GET' ELSE 'POST' END AS method FROM (SELECT regexp_replace(path, '[^/]+$', '{id}') AS path, min(repo) AS repo FROM rt GROUP BY 1)),
mt AS (SELECT r.repo || ' ' || r.path AS id, s.id AS pid, s.repo <> r.repo AS other, s.method = 'GET' AS m FROM rt r LEFT JOIN served s ON regexp_replace(r.path, '[^/]+$', '{id}') = s.path AND NOT ends_with(r.path, '/')),
ms AS (SELECT id, min(pid) FILTER (other AND m) AS producer_id, CASE WHEN min(pid) FILTER (other AND m) IS NOT NULL THEN 'matched' WHEN bool_or(other AND NOT m) THEN 'method-mismatch' WHEN bool_or(NOT other) THEN 'same-repo-only' ELSE 'no-producer' END AS reason FROM mt GROUP BY id)"""
_ROLE = """CASE WHEN list_has_any(p, ['tests', 'test', '__tests__', 'spec', 'specs']) OR regexp_matches(p[-1], '^test_|_test\\.|\\.test\\.|\\.spec\\.|_spec\\.') THEN 'test' WHEN p[-1] LIKE '%.md' OR list_has_any(p, ['docs', 'doc']) THEN 'doc' WHEN language = 'Other' THEN 'unknown'
WHEN p[-1] IN ('build.rs', 'conf.py', 'setup.py', 'gulpfile.js', 'webpack.config.js') OR p[-1] LIKE '%.config.js' OR p[-1] LIKE '%.config.ts' THEN 'config' ELSE 'implementation' END"""

QUERIES = {
    f.__name__: f
    for f in (symbol_search, path_search, hybrid_search, search_filtered, search_ranked, files_ranked, file_roles, files_view, symbols_listing, domain_vocabulary, domain_assignment, shared_prefixes, container_dirs, tour_roles, tour_rank,
              tour_selection, tour_order, url_path, contract_match, contract_unmatched_reason, contract_broken, orphan_producers)
}
_IN = "regexp_replace(file, '^[^/]*/', '')"
SQL = {
    "symbol_search": M.sql("SELECT id, name, kind FROM symbols_now WHERE contains(lower(name), 'token')"),
    "path_search": M.sql(f"SELECT repo, file FROM files_now WHERE contains(lower({_IN}), 'token')"),
    "hybrid_search": M.sql(f"SELECT 'symbol' AS what, file, name FROM symbols_now WHERE contains(lower(name), 'token') UNION ALL SELECT 'path', file, '' FROM files_now WHERE contains(lower({_IN}), 'token')"),
    "search_ranked": M.sql(
        "SELECT repo, rank, id, n FROM (SELECT split_part(file, '/', 1) AS repo, id, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY split_part(file, '/', 1) ORDER BY coalesce(n, 0) DESC, name, id) AS rank FROM symbols_now LEFT JOIN (SELECT dst AS id, count(*) AS n FROM call_all GROUP BY 1) USING (id) WHERE contains(lower(name), 'token')) WHERE rank <= 20",
        graph._CALLS,
    ),
    "files_ranked": M.sql(f"SELECT repo, rank, file, n FROM (SELECT repo, file, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY repo ORDER BY coalesce(n, 0) DESC, file) AS rank FROM files_now LEFT JOIN (SELECT dst AS file, count(*) AS n FROM import_pairs GROUP BY 1) USING (file) WHERE contains(lower({_IN}), 'token')) WHERE rank <= 20"),
    "tour_order": M.sql(
        "SELECT id, max(layer) AS layer FROM grp JOIN lay USING (g) GROUP BY id", graph._REACH, f"comp AS ({graph._SCC})",
        "grp AS (SELECT file AS id, coalesce(component, file) AS g FROM files_now LEFT JOIN comp ON comp.id = file)",
        "ge AS (SELECT DISTINCT a.g AS src, b.g AS dst FROM import_pairs JOIN grp a ON src = a.id JOIN grp b ON dst = b.id WHERE a.g <> b.g)",
        "lay AS (SELECT DISTINCT g, 0 AS layer FROM grp UNION SELECT ge.src, layer + 1 FROM lay JOIN ge ON ge.dst = lay.g)",
    ),
    "search_filtered": M.sql(
        f"SELECT s.name, s.file, r.repo, s.id FROM s1 s JOIN (SELECT repo, file, {_ROLE} AS role FROM (SELECT repo, file, language, string_split(lower({_IN}), '/') AS p FROM files_now)) r USING (file) WHERE s.kind = 'Function' AND contains(lower(s.name), 'token') AND role = 'implementation' ORDER BY s.name, s.file, r.repo, s.id LIMIT 100",
        "s1 AS (SELECT DISTINCT ON (id) * FROM symbols_now ORDER BY id)",
    ),
    "file_roles": M.sql(f"SELECT file, {_ROLE} AS role FROM (SELECT file, language, string_split(lower({_IN}), '/') AS p FROM files_now)"),
    "files_view": M.sql("SELECT file, language, lines FROM files_now ORDER BY lines DESC, file LIMIT 200"),
    "symbols_listing": M.sql("SELECT id, file, start_line, end_line FROM symbols_now WHERE kind = 'Class' ORDER BY id LIMIT 100"),
    "domain_vocabulary": M.sql("SELECT * FROM voc", _TERMS),
    "domain_assignment": M.sql("SELECT repo, file, term, weight FROM (SELECT *, count(*) OVER (PARTITION BY file) AS ties FROM (SELECT *, rank() OVER (PARTITION BY file ORDER BY weight DESC) AS r FROM (SELECT repo, file, term, CAST(sum(depth + 3) AS BIGINT) AS weight FROM terms JOIN voc USING (repo, term) GROUP BY ALL)) WHERE r = 1) WHERE ties = 1", _TERMS),
    "shared_prefixes": M.sql("SELECT * FROM sp", _TERMS),
    "container_dirs": M.sql(
        "SELECT repo, CAST(depth AS INTEGER) AS depth, dir, files, round(share, 6) AS share FROM cc WHERE chain = depth", _TERMS,
        f"ca AS (SELECT repo, unnest(range(0, len(p) - 1)) AS depth, p FROM (SELECT repo, string_split({_IN}, '/') AS p FROM files_now))",
        "cb AS (SELECT *, row_number() OVER (PARTITION BY repo, depth ORDER BY files DESC, dir) AS r FROM (SELECT repo, depth, p[depth + 1] AS dir, count(*) AS files FROM ca GROUP BY ALL))",
        f"cc AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY depth) - 1 AS chain FROM (SELECT cb.repo, depth, dir, files, files / n_all AS share FROM cb JOIN whole USING (repo) WHERE r = 1 AND files / n_all >= {CONTAINER_SHARE}))",
    ),
    "tour_roles": M.sql("SELECT file, role FROM sr", _TOUR),
    "tour_rank": M.sql("SELECT repo, rank, file FROM rk WHERE rank <= 30", _TOUR),
    "tour_selection": M.sql(
        "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY rank) AS step, file, role FROM q WHERE (rank <= 10 AND (role = 'entry-point' OR back > greatest(least(2, there) - have, 0))) OR (role = 'entry-point' AND rank > 10 AND er <= have + greatest(least(2, there) - have, 0))", _TOUR, _SEL,
    ),
    "url_path": M.sql("SELECT DISTINCT url, path FROM up", _URLS),
    "contract_match": M.sql("SELECT id, producer_id FROM ms WHERE producer_id IS NOT NULL", _ROUTES),
    "contract_unmatched_reason": M.sql("SELECT reason, count(*) AS consumers FROM ms GROUP BY 1", _ROUTES),
    "contract_broken": M.sql("SELECT id, producer_id FROM ms WHERE producer_id IS NOT NULL AND producer_id < 'd'", _ROUTES),
    "orphan_producers": M.sql("SELECT id, path FROM served WHERE id NOT IN (SELECT producer_id FROM ms WHERE producer_id IS NOT NULL)", _ROUTES),
}
