"""Contracts between repos: paths that one serves and another calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VERB = "get|post|put|delete|patch"
# How routes are declared (pattern, group of the method, group of the path) and called.
PRODUCERS = (
    (rf"""\.route\(\s*"(/[^"]*)"\s*,\s*({_VERB})""", 2, 1),
    (rf"""@app\.({_VERB})\(\s*['"](/[^'"]*)['"]""", 1, 2),
    (rf"""\b(?:app|router)\.({_VERB})\(\s*['"](/[^'"]*)['"]""", 1, 2),
)
CONSUMERS = (
    (r"""\bfetch\(\s*['"]([^'"]*)['"]""", None, 1),
    (rf"""axios\.({_VERB})\(\s*['"]([^'"]*)['"]""", 1, 2),
    (rf"""requests\.({_VERB})\(\s*['"]([^'"]*)['"]""", 1, 2),
    (rf"""ureq::({_VERB})\(\s*"([^"]*)\"""", 1, 2),
)


def path_of(url: Column) -> Column:
    """The path of an address, without scheme, host, query and fragment; `/` if it has none. A path stays as it is."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def matches(template: Column, path: Column) -> Column:
    """Whether a template's segments equal the path's, those that begin with `:` or `{` matching any. Only the template's side may do so."""
    return (F.size(template) == F.size(path)) & F.forall(F.zip_with(template, path, lambda t, p: t.startswith(":") | t.startswith("{") | (t == p)), lambda x: x)


def _route(side: str):
    return lambda x: F.struct(F.lit(side).alias("side"), F.upper(x["m"]).alias("method"), x["p"].alias("path"))


def scan(texts: DataFrame) -> DataFrame:
    """(file, side, method, path), distinct, of the routes that texts (file, text) declare and call; the method of a plain fetch is NULL, which is any."""
    parts = []
    for side, patterns in (("producer", PRODUCERS), ("consumer", CONSUMERS)):
        for pattern, method, path in patterns:
            of = lambda group, p=pattern: F.regexp_extract_all("text", F.lit(p), F.lit(group))
            nothing = F.transform(of(path), lambda _: F.lit(None).cast("string"))
            parts.append(F.transform(F.arrays_zip((of(method) if method else nothing).alias("m"), of(path).alias("p")), _route(side)))
    x = texts.where("text IS NOT NULL").select("file", F.explode(F.concat(*parts)).alias("x"))
    return x.select("file", "x.side", "x.method", path_of(F.col("x.path")).alias("path")).distinct()


def match(consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """(id, repo, path, producer_id, reason): each consumer with its first producer in another repo, or why there is none.

    Both: id, repo, method (NULL fits any), path. A template is looked up by its number of segments and its first
    literal one, with that one's place, which every path it matches has; so no side is compared with all of the other. Templates without a literal segment
    match every path of their length; of those the smallest id of each repo and method stands for all. Of several producers the smallest id counts.
    Reasons: method-mismatch before same-repo-only before no-producer.
    """
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "repo", "method", "path")], segments(F.col("path")).alias(f"{p}_s"))
    c, p = side(consumers, "c").withColumn("n", F.size("c_s")), side(producers, "p").withColumn("n", F.size("p_s"))
    free = lambda t: t.startswith(":") | t.startswith("{")
    places = F.filter(F.transform("p_s", lambda t, i: F.struct(i.alias("at"), t.alias("word"), free(t).alias("free"))), lambda x: ~x["free"])
    p = p.withColumn("first", F.get(places, F.lit(0)))
    fixed = p.where("first IS NOT NULL").select("p_id", "p_repo", "p_method", "p_s", "n", F.col("first.at").alias("at"), F.col("first.word").alias("word"))
    open_ = p.where("first IS NULL").groupBy("n", "p_repo", "p_method").agg(F.min("p_id").alias("p_id"), F.first("p_s").alias("p_s"))
    words = c.select("c_id", "c_repo", "c_method", "c_s", "n", F.posexplode("c_s").alias("at", "word"))
    columns = ["c_id", "c_repo", "c_method", "p_id", "p_repo", "p_method"]
    hit = words.join(fixed, ["n", "at", "word"]).where(matches(F.col("p_s"), F.col("c_s"))).select(*columns).unionByName(c.join(open_, "n").select(*columns))
    other = F.col("p_repo") != F.col("c_repo")
    method = F.col("p_method").isNull() | F.col("c_method").isNull() | (F.col("p_method") == F.col("c_method"))
    best = hit.groupBy("c_id").agg(F.min(F.when(other & method, F.col("p_id"))).alias("producer_id"), F.max(other & ~method).alias("m"), F.max(~other).alias("s"))
    x = consumers.select("id", "repo", "path").join(best, consumers.id == best.c_id, "left")
    reason = F.when(F.col("producer_id").isNotNull(), "matched").when(F.coalesce("m", F.lit(False)), "method-mismatch").when(F.coalesce("s", F.lit(False)), "same-repo-only").otherwise("no-producer")
    return x.select("id", "repo", "path", "producer_id", reason.alias("reason"))


def broken(before: DataFrame, now: DataFrame) -> DataFrame:
    """Matches that were and are no more; a first run (nothing before) breaks nothing."""
    return before.exceptAll(now)


def orphan_producers(producers: DataFrame, matched: DataFrame) -> DataFrame:
    return producers.join(matched.where("producer_id IS NOT NULL").select(F.col("producer_id").alias("id")).distinct(), "id", "left_anti")
