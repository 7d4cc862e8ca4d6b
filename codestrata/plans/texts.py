"""Queries on texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import ledger as L
from codestrata.operators import overlap as O
from codestrata.operators import similarity as S
from codestrata.operators import text as T
from codestrata.plans import model as M
from codestrata.session import Scratch, table


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "file_texts").select("file", "text").distinct()


def _docs(spark, sf_dir, *kinds):
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("kind").isin(*kinds)) if kinds else d


def security_scan(spark, sf_dir):
    return T.secret_scan(_texts(spark, sf_dir), "file")


def security_summary(spark, sf_dir):
    return security_scan(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


# In these texts no line is noise by the default rule; bracketed times stand for it here.
def _timed(c):
    return T.is_noise(c) | c.rlike(r"^\[[0-9:]+\] debug")


def distill_lines(spark, sf_dir):
    x = T.distill(_docs(spark, sf_dir), "doc_id", _timed)
    return x.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("omitted"))


def distill_render(spark, sf_dir):
    x = T.rendered(T.distill(_docs(spark, sf_dir), "doc_id", _timed), "doc_id")
    return x.select("doc_id", F.md5("text").alias("digest"), T.approx_tokens(F.octet_length("text")).alias("tokens"))


def exact_duplicates(spark, sf_dir):
    return S.copy_classes(_docs(spark, sf_dir), "doc_id")


def shingle_df(spark, sf_dir):
    """The 100 runs of three tokens that most documents hold."""
    return S.shingle_table(_docs(spark, sf_dir), "doc_id", 3).groupBy("shingle").agg(F.count("*").alias("documents")).orderBy(F.col("documents").desc(), "shingle").limit(100)


def _representatives(spark, sf_dir):
    """A scratch folder, the classes of equal texts, and the documents without copies; as copies are few, they are taken out by their keys."""
    scratch = Scratch(spark, "near")
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    classes = scratch.write(S.copy_classes(docs, "doc_id"), "classes")
    copies = scratch.write(classes.where("doc_id <> rep").select("doc_id"), "copies")
    scratch.let_go()
    return scratch, classes, docs.join(copies, "doc_id", "left_anti")


def near_duplicates(spark, sf_dir):
    """One row per document with its class of equal texts, and how many classes overlap with it by 0.8 in runs of five words."""
    scratch, classes, reps = _representatives(spark, sf_dir)
    pairs = O.text_pairs(scratch, reps, "doc_id", 5, r"[\p{L}\p{N}_]+", 0.8)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return classes.join(links, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_pairs(spark, sf_dir):
    """Pairs of class representatives and their overlap."""
    scratch, _, reps = _representatives(spark, sf_dir)
    return O.text_pairs(scratch, reps, "doc_id", 5, r"[\p{L}\p{N}_]+", 0.8).select("a", "b", "shared", F.round("overlap", 6).alias("overlap"))


def near_duplicate_functions(spark, sf_dir):
    """Functions that overlap by half or more in runs of three tokens, in both directions; of those with one body hash only the first by id, whose copies `duplicate_code` lists."""
    s = M.symbols(spark, sf_dir)
    first = s.where("body_hash IS NOT NULL").groupBy("body_hash").agg(F.min("id").alias("id")).select("id")
    scratch = Scratch(spark, "functions")
    functions = scratch.write(S.function_texts(s.join(first, "id", "left_semi"), _texts(spark, sf_dir)), "functions")
    return O.all_pairs(functions, "id", "body_hash", 3, S.TOKEN, 0.5).select("symbol", "other", F.round("overlap", 6).alias("overlap"))


def decision_commits(spark, sf_dir):
    return M.commits(spark, sf_dir).where(T.is_decision(F.col("message"))).select("hash", "repo", "message")


def issue_refs(spark, sf_dir):
    c = M.commits(spark, sf_dir).where("message LIKE '%#%'")
    return c.select("hash", F.explode(T.issue_refs(F.col("message"))).alias("issue"))


def decision_records(spark, sf_dir):
    return T.decision_files(_docs(spark, sf_dir, "adr"), "doc_id").select("doc_id", "number", "title", "status")


def changelog_entries(spark, sf_dir):
    """Releases of the changelogs and how long each entry is."""
    return T.sections(_docs(spark, sf_dir, "changelog").select("doc_id", "text"), "doc_id").select("doc_id", "line", "level", "title", F.length("body").alias("chars"))


def readme_decisions(spark, sf_dir):
    """Sections of readmes and wiki pages whose body speaks of a decision."""
    x = T.sections(_docs(spark, sf_dir, "readme", "wiki").select("doc_id", "text"), "doc_id")
    return x.where(T.is_decision(F.col("body"))).select("doc_id", "line", "title")


def comment_decisions(spark, sf_dir):
    """The comment directly above each function or class."""
    return T.comment_blocks(_texts(spark, sf_dir), M.symbols(spark, sf_dir)).select("id", "from_line", F.md5("text").alias("digest"))


def decision_union(spark, sf_dir):
    """All mined decisions, each with its source and confidence. The tables hold no pull requests, proposals or decisions written by hand."""
    texts = _texts(spark, sf_dir)
    comments = T.comment_blocks(texts, M.symbols(spark, sf_dir)).where(T.is_decision(F.col("text")))
    return T.decisions(
        {
            "decision-file": decision_records(spark, sf_dir).select(F.col("doc_id").alias("id"), "title"), "commit": decision_commits(spark, sf_dir).select(F.col("hash").alias("id"), F.col("message").alias("title")),
            "comment": comments.select("id", F.col("text").alias("title")), "inline-marker": T.inline_markers(texts, "file").select(F.concat_ws("#", "file", "line").alias("id"), F.col("text").alias("title")),
            "changelog": T.changelog_decisions(_docs(spark, sf_dir, "changelog").select("doc_id", "text"), "doc_id").select(F.concat_ws("#", "doc_id", "line").alias("id"), "title"),
            "readme": readme_decisions(spark, sf_dir).select(F.concat_ws("#", "doc_id", "line").alias("id"), "title"),
        }
    )


def decision_link(spark, sf_dir):
    """Decision records and the symbols they name."""
    d = _docs(spark, sf_dir, "adr").select(F.col("doc_id").alias("id"), F.col("text").alias("body")).where("body IS NOT NULL")
    return T.link_decisions(d, M.symbols(spark, sf_dir).select("name", F.col("file").alias("target")).distinct())


def keyword_retrieval(spark, sf_dir):
    return S.keyword_retrieval(_docs(spark, sf_dir), ["the", "of", "rollout", "vendor"], "doc_id")


def semantic_topk(spark, sf_dir):
    """The ten nearest vectors of each vector whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return S.nearest(v, q, 10).select("query_id", "id", "rank", F.round("cosine", 4).alias("cosine"))


def vector_centroid_match(spark, sf_dir):
    """Cosine of each vector with the mean of its label's."""
    v = table(spark, sf_dir, "embeddings")
    mean = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return v.join(mean, "label").select("vec_id", "label", F.round(S.cosine(F.col("embedding").cast("array<double>"), F.col("mean")), 4).alias("cosine"))


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.substring("props", -2, 1).alias("program"), (F.col("event_type") == "error").cast("int").alias("exit_code"))


def fumbles(spark, sf_dir):
    """Failed runs made good; an event is a run, its error a failure, and the last digit of its property the program."""
    return L.fumbles(Scratch(spark, "runs"), _runs(spark, sf_dir), "user_id").select("program", "fumbles")


def savings_by_day(spark, sf_dir):
    """What events save per day, and in all (day `all`)."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").cast("long").alias("raw_bytes"), F.lit(10).alias("kept_bytes"))
    return L.savings(e, ["day"]).select(F.coalesce("day", F.lit("all")).alias("day"), "records", "saved_bytes", "saved_tokens")


def debounce_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return L.quiet_sessions(e, "user_id", 3600).select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


_LINES = """ft AS (SELECT DISTINCT file, text FROM file_texts WHERE text IS NOT NULL AND text <> ''),
fl0 AS (SELECT file, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM ft),
fl AS (SELECT file, CAST(i AS INTEGER) AS line, regexp_replace(ls[i], '\\r\\z', '') AS content FROM (SELECT file, ls, unnest(range(1, len(ls) + 1)) AS i FROM fl0))"""
_DL = """dl0 AS (SELECT doc_id, kind, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''),
dl AS (SELECT doc_id, kind, len(ls) AS n, CAST(i AS INTEGER) AS line, regexp_replace(ls[i], '\\r\\z', '') AS content FROM (SELECT doc_id, kind, ls, unnest(range(1, len(ls) + 1)) AS i FROM dl0))"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SCAN = _LINES + ", sec AS (" + " UNION ALL ".join(f"SELECT file, line, '{k}' AS kind FROM fl WHERE regexp_matches(content, {_q(p)})" for k, p in T.SIGNATURES.items()) + f""" UNION ALL
SELECT file, line, 'suspicious-assignment' FROM (SELECT file, line, regexp_extract(content, {_q(T.ASSIGNMENT)}, 1) AS v FROM fl) WHERE v <> '' AND NOT regexp_matches(lower(v), {_q(T.any_of(T.PLACEHOLDERS))}) AND len(list_distinct(string_split(v, ''))) > 1)"""
_KEEP = f"""keepers AS (SELECT doc_id, kind, line, content, n < 20 OR regexp_matches(lower(content), {_q(T.any_of(T.ERROR_MARKERS + T.SUMMARY_MARKERS))}) OR NOT (trim(content) = '' OR regexp_matches(trim(content), '^[.o=\\-# ]{{3,}}$')
  OR regexp_matches(lower(trim(content)), '^test .* \\.\\.\\. ok$') OR lower(trim(content)) = 'ok' OR regexp_matches(lower(trim(content)), '^pass(ed)? ') OR regexp_matches(content, '^\\[[0-9:]+\\] debug')) AS kept FROM dl)"""
_CLASS = "plain AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS h, text FROM documents WHERE text IS NOT NULL), cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM plain)"
_SH = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM plain JOIN cls USING (doc_id) WHERE doc_id = rep),
sh AS (SELECT DISTINCT doc_id, list_aggregate(t[i:i + 4], 'string_agg', ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM tok WHERE len(t) >= 5)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
np AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
nd AS (SELECT a, b, shared, shared / least(x.n, y.n) AS overlap FROM np JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE shared / least(x.n, y.n) >= 0.8 - 1e-12)"""
_HEAD = """hd AS (SELECT doc_id, kind, line, content, max(CASE WHEN regexp_matches(content, '^#{1,6}\\s+.*\\S\\s*$') THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS head FROM dl WHERE kind IN ('changelog', 'readme', 'wiki')),
se AS (SELECT doc_id, any_value(kind) AS kind, head AS line, arg_min(content, line) AS h, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (line > head), ''), '^\\s+|\\s+$', '', 'g') AS body FROM hd WHERE head IS NOT NULL GROUP BY doc_id, head)"""
_ADR = """SELECT doc_id, CAST(regexp_extract(text, '(?m)^# *(?:ADR[- ]?)?(\\d+)[.:]\\s*(.*\\S)\\s*$', 1) AS INTEGER) AS number, regexp_extract(text, '(?m)^# *(?:ADR[- ]?)?(\\d+)[.:]\\s*(.*\\S)\\s*$', 2) AS title,
regexp_extract_all(text, '(?m)^Status: *(.*\\S) *$', 1)[-1] AS status FROM documents WHERE kind = 'adr' AND regexp_matches(text, '(?m)^# *(?:ADR[- ]?)?(\\d+)[.:]\\s*(.*\\S)\\s*$')"""
_DECIDE = _q(T.any_of(T.DECISION_WORDS))
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_EV = "e AS (SELECT user_id, ts, event_id, substr(props, -2, 1) AS program, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"
_RANKS = " ".join(f"WHEN '{n}' THEN {min(0.4 + 0.5 * i / len(T.CONFIDENCE_ORDER), 0.99)!r}" for i, n in enumerate(T.CONFIDENCE_ORDER))
_COMMENT = r"'^\s*(//|#|--|/?\*|\*/)'"
_ABOVE = (
    f"isl AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS g FROM fl WHERE regexp_matches(content, {_COMMENT}) AND NOT regexp_matches(content, '^\\s*#(include|!)'))",
    """above AS (SELECT s.id, from_line, t FROM (SELECT file, min(line) AS from_line, max(line) AS to_line, string_agg(trim(regexp_replace(content, '^\\s*(//+|#+|--|/?\\*+/?)', '')), ' ' ORDER BY line) AS t FROM isl GROUP BY file, g)
  JOIN (SELECT DISTINCT id, file, start_line FROM symbols_now) s USING (file) WHERE start_line = to_line + 1)""",
)
_MARK = _q(r"^\s*(?://+|#+|--|/?\*+|;+)\s*(" + "|".join(T.INLINE_MARKERS) + r"):\s*(.*\S)\s*$")

QUERIES = {
    f.__name__: f
    for f in (security_scan, security_summary, distill_lines, distill_render, exact_duplicates, shingle_df, near_duplicates, near_duplicate_pairs, near_duplicate_functions, decision_commits, issue_refs, decision_records, changelog_entries,
              readme_decisions, comment_decisions, decision_union, decision_link, keyword_retrieval, semantic_topk, vector_centroid_match, fumbles, savings_by_day, debounce_sessions)
}
SQL = {
    "security_scan": M.sql("SELECT * FROM sec", _SCAN),
    "security_summary": M.sql("SELECT kind, count(*) AS findings, count(DISTINCT file) AS files FROM sec GROUP BY 1", _SCAN),
    "distill_lines": M.sql("SELECT doc_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS omitted FROM keepers GROUP BY 1", _DL, _KEEP),
    "distill_render": M.sql(
        """SELECT doc_id, md5(t) AS digest, CAST(strlen(t) // 4 AS BIGINT) AS tokens FROM (SELECT doc_id, CASE WHEN gone > 0 AND length(short) < length(whole) THEN short ELSE whole END AS t FROM (SELECT doc_id, count(*) FILTER (NOT kept) AS gone,
        string_agg(content, chr(10) ORDER BY line) AS whole, coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (kept), '') || chr(10) || '[' || count(*) FILTER (NOT kept) || ' lines left out]' AS short FROM keepers GROUP BY doc_id))""", _DL, _KEEP,
    ),
    "exact_duplicates": M.sql("SELECT doc_id, rep FROM cls", _CLASS),
    "shingle_df": M.sql(
        "SELECT s AS shingle, count(*) AS documents FROM s3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
        "t3 AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS t FROM documents WHERE text IS NOT NULL)",
        "s3 AS (SELECT DISTINCT doc_id, list_aggregate(t[i:i + 2], 'string_agg', ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM t3 WHERE len(t) >= 3))",
    ),
    "near_duplicates": M.sql("SELECT doc_id, cls.rep AS class_id, coalesce(n, 0) AS links FROM cls LEFT JOIN (SELECT rep, count(*) AS n FROM (SELECT a AS rep FROM nd UNION ALL SELECT b FROM nd) GROUP BY 1) l ON l.rep = cls.rep", _CLASS, _SH),
    "near_duplicate_pairs": M.sql("SELECT a, b, shared, round(overlap, 6) AS overlap FROM nd", _CLASS, _SH),
    "near_duplicate_functions": M.sql(
        "SELECT a AS symbol, b AS other, round(overlap, 6) AS overlap FROM fd UNION ALL SELECT b, a, round(overlap, 6) FROM fd",
        "fs AS (SELECT DISTINCT ON (id) id, file, start_line, end_line FROM symbols_now WHERE kind IN ('Function', 'Method') AND id IN (SELECT min(id) FROM symbols_now WHERE body_hash IS NOT NULL GROUP BY body_hash) ORDER BY id)",
        "ff AS (SELECT DISTINCT file, text FROM file_texts WHERE text IS NOT NULL)",
        "fb AS (SELECT id, array_to_string(string_split(replace(text, chr(13), ''), chr(10))[start_line:end_line], chr(10)) AS body FROM fs JOIN ff USING (file))",
        "fk AS (SELECT id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS t FROM fb)",
        "fh AS (SELECT DISTINCT id, list_aggregate(t[i:i + 2], 'string_agg', ' ') AS s FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM fk WHERE len(t) >= 3))",
        "fz AS (SELECT id, count(*) AS n FROM fh GROUP BY 1)",
        "fp AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM fh a JOIN fh b ON a.s = b.s AND a.id < b.id GROUP BY ALL)",
        "fd AS (SELECT a, b, shared / least(x.n, y.n) AS overlap FROM fp JOIN fz x ON x.id = a JOIN fz y ON y.id = b WHERE shared / least(x.n, y.n) >= 0.5 - 1e-12)",
    ),
    "decision_commits": M.sql(f"SELECT hash, repo, message FROM commits_all WHERE regexp_matches(lower(message), {_DECIDE})"),
    "issue_refs": M.sql("SELECT DISTINCT hash, CAST(n AS BIGINT) AS issue FROM (SELECT hash, unnest(regexp_extract_all(' ' || replace(message, '#', '  #') || ' ', '[^\\p{L}\\p{N}]#(\\d+)', 1)) AS n, message FROM commits_all) WHERE regexp_matches(message, '(^|[^\\p{L}\\p{N}])#' || n || '($|[^\\p{L}\\p{N}])')"),
    "decision_records": _ADR,
    "changelog_entries": M.sql("SELECT doc_id, line, length(regexp_extract(h, '^(#{1,6})', 1)) AS level, regexp_extract(h, '^#{1,6}\\s+(.*\\S)\\s*$', 1) AS title, length(body) AS chars FROM se WHERE kind = 'changelog'", _DL, _HEAD),
    "readme_decisions": M.sql(f"SELECT doc_id, line, regexp_extract(h, '^#{{1,6}}\\s+(.*\\S)\\s*$', 1) AS title FROM se WHERE kind <> 'changelog' AND regexp_matches(lower(body), {_DECIDE})", _DL, _HEAD),
    "comment_decisions": M.sql(
        "SELECT id, from_line, md5(t) AS digest FROM above", _LINES, *_ABOVE,
    ),
    "decision_union": M.sql(
        f"SELECT id, title, source, round(CAST(CASE source {_RANKS} END AS DOUBLE), 4) AS confidence FROM (SELECT CAST(doc_id AS VARCHAR) AS id, title, 'decision-file' AS source FROM ({_ADR}) UNION ALL SELECT hash, message, 'commit' FROM commits_all WHERE regexp_matches(lower(message), {_DECIDE}) UNION ALL SELECT id, t, 'comment' FROM above WHERE regexp_matches(lower(t), {_DECIDE}) "
        f"UNION ALL SELECT file || '#' || line, regexp_extract(content, {_MARK}, 2), 'inline-marker' FROM fl WHERE regexp_matches(content, {_MARK}) "
        f"UNION ALL SELECT doc_id || '#' || line, upper(title[1]) || lower(title[2:]) || ': ' || trim(split_part(trim(body, chr(10) || ' '), chr(10), 1)), 'changelog' FROM (SELECT doc_id, line, body, regexp_extract(h, '^#{{1,6}}\\s+(.*\\S)\\s*$', 1) AS title, h FROM se WHERE kind = 'changelog') WHERE h LIKE '### %' AND lower(title) IN ('changed', 'removed', 'deprecated', 'security') "
        f"UNION ALL SELECT doc_id || '#' || line, regexp_extract(h, '^#{{1,6}}\\s+(.*\\S)\\s*$', 1), 'readme' FROM se WHERE kind <> 'changelog' AND regexp_matches(lower(body), {_DECIDE}))", _DL, _HEAD, _LINES, *_ABOVE,
    ),
    "decision_link": M.sql("SELECT DISTINCT d.id, s.file AS target FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]{4,}')) AS name FROM documents WHERE kind = 'adr') d JOIN symbols_now s ON s.name = d.name"),
    "keyword_retrieval": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'rollout') OR contains(lower(text), 'vendor') ORDER BY doc_id LIMIT 10",
    "semantic_topk": f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), p AS (SELECT q.id AS query_id, v.id, round({_COS.format('v.vec', 'q.vec')}, 6) AS c FROM v JOIN v q ON q.id % 20 = 0 AND v.id <> q.id)
        SELECT query_id, id, rank, round(c, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM p) WHERE rank <= 10""",
    "vector_centroid_match": f"""WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL), m AS (SELECT label, list(x ORDER BY i) AS mean FROM x GROUP BY 1)
        SELECT vec_id, label, round({_COS.format('CAST(embedding AS DOUBLE[])', 'mean')}, 4) AS cosine FROM embeddings JOIN m USING (label)""",
    "fumbles": f"WITH {_EV} SELECT program, count(*) AS fumbles FROM e WHERE bad AND EXISTS (SELECT 1 FROM e n WHERE n.user_id = e.user_id AND n.r BETWEEN e.r + 1 AND e.r + 3 AND n.program = e.program AND NOT n.bad) GROUP BY 1",
    "savings_by_day": "SELECT coalesce(day, 'all') AS day, count(*) AS records, CAST(sum(s) AS BIGINT) AS saved_bytes, CAST(sum(s) // 4 AS BIGINT) AS saved_tokens FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, greatest(CAST(trunc(value) AS BIGINT) - 10, 0) AS s FROM events) GROUP BY ROLLUP (day)",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM s GROUP BY user_id, k""",
}
