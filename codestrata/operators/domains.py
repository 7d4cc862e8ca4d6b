"""Vocabulary of paths: the words that part a repo's files into domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_FILES, MAX_SHARE = 3, 0.8
MIN_SIBLINGS, PREFIX_SHARE, PREFIX_COVERAGE = 8, 0.6, 0.5
CONTAINER_SHARE = 0.9
# Words that name a layer of any program and no domain.
LAYERS = tuple(
    """
    src lib libs test tests spec specs main index init pkg internal node modules dist build target vendor packages crates cmd bin api rest graphql grpc proto
    schema schemas model models view views controller controllers service services handler handlers util utils helper helpers common core base shared
    mutation mutations query queries type types resolver resolvers migration migrations management command commands admin app apps setting settings config
    configs conf url urls form forms serializer serializers dataloader dataloaders fixture fixtures conftest factory factories mixin mixins impl error errors
    exception exceptions const constants enum enums interface interfaces dto bean repository dao entity entities component components route routes hook hooks
    middleware middlewares context contexts styles assets scripts docs examples e2e benchmark benchmarks
    """.split()
)


def words(s: Column) -> Column:
    """Lower-case words of a name: parted at signs, before capitals, and before the last capital of a run."""
    t = F.regexp_replace(s, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.lower(F.trim(t)), " +"), lambda w: w != "")


def path_terms(files: DataFrame) -> DataFrame:
    """(repo, file, term, depth) of each word in a file's path within its repo, extension aside; depth counts directories from 0."""
    inner = F.regexp_replace(F.regexp_replace("file", r"^[^/]*/", ""), r"\.[^./]*$", "")
    x = files.select("repo", "file", F.posexplode(F.split(inner, "/")).alias("depth", "part"))
    return x.select("repo", "file", "depth", F.explode(F.array_distinct(words(F.col("part")))).alias("term"))


def shared_prefixes(files: DataFrame) -> DataFrame:
    """(repo, term): words that most of many sibling directories carry, below a directory that holds much of the repo."""
    inner = F.regexp_replace("file", r"^[^/]*/", "")
    dirs = files.select("repo", "file", F.slice(F.split(inner, "/"), F.lit(1), F.size(F.split(inner, "/")) - 1).alias("d"))
    at = dirs.select("repo", "file", "d", F.explode(F.when(F.size("d") > 0, F.sequence(F.lit(0), F.size("d") - 1)).otherwise(F.array().cast("array<int>"))).alias("i"))
    at = at.select("repo", "file", F.array_join(F.slice("d", F.lit(1), F.col("i")), "/").alias("parent"), F.col("d")[F.col("i")].alias("child"))
    whole = files.groupBy("repo").agg(F.count("*").alias("all"))
    parents = at.groupBy("repo", "parent").agg(F.count("*").alias("n"), F.countDistinct("child").alias("children")).join(whole, "repo")
    parents = parents.where((F.col("children") >= MIN_SIBLINGS) & (F.col("n") >= PREFIX_COVERAGE * F.col("all"))).select("repo", "parent", "children")
    children = at.select("repo", "parent", "child").distinct().join(parents, ["repo", "parent"])
    terms = children.select("repo", "parent", "children", "child", F.explode(F.array_distinct(words(F.col("child")))).alias("term"))
    return terms.groupBy("repo", "parent", "children", "term").agg(F.count("*").alias("n")).where(F.col("n") >= PREFIX_SHARE * F.col("children")).select("repo", "term").distinct()


def vocabulary(files: DataFrame, terms: DataFrame, layers=LAYERS) -> DataFrame:
    """(repo, term, files): words of enough files and not too many, without layer words and shared prefixes."""
    whole = files.groupBy("repo").agg(F.count("*").alias("all"))
    df = terms.where(~F.col("term").isin(*layers) & ~F.col("term").rlike(r"^\d+$")).groupBy("repo", "term").agg(F.countDistinct("file").alias("files")).join(whole, "repo")
    df = df.where((F.col("files") >= MIN_FILES) & (F.col("files") <= MAX_SHARE * F.col("all")))
    return df.join(shared_prefixes(files), ["repo", "term"], "left_anti").select("repo", "term", "files")


def assign(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(repo, file, term, weight): the word that claims a file most, 3 + depth for each place it stands; files with a tie are left out."""
    score = terms.join(vocab.select("repo", "term"), ["repo", "term"]).groupBy("repo", "file", "term").agg(F.sum(F.col("depth") + 3).alias("weight"))
    w = Window.partitionBy("file").orderBy(F.col("weight").desc())
    x = score.withColumn("rank", F.rank().over(w)).where("rank = 1").withColumn("ties", F.count("*").over(Window.partitionBy("file")))
    return x.where("ties = 1").select("repo", "file", "term", "weight")


def containers(files: DataFrame, least: float = CONTAINER_SHARE) -> DataFrame:
    """(repo, depth, dir, files, share): the leading directories that nearly all of a repo's files are in.

    At each depth, from 0, the most frequent directory name counts (ties: the smaller one) if its share of all files is
    `least` or more; the first depth without one ends the peeling.
    """
    inner = F.regexp_replace("file", r"^[^/]*/", "")
    parts = F.split(inner, "/")
    dirs = files.select("repo", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("depth", "dir")).groupBy("repo", "depth", "dir").agg(F.count("*").alias("files"))
    most = dirs.groupBy("repo", "depth").agg(F.min(F.struct((-F.col("files")).alias("n"), "dir")).alias("m")).select("repo", "depth", F.col("m.dir").alias("dir"), (-F.col("m.n")).alias("files"))
    x = most.join(files.groupBy("repo").agg(F.count("*").alias("all")), "repo").withColumn("share", F.col("files") / F.col("all")).where(F.col("share") >= least)
    chain = F.row_number().over(Window.partitionBy("repo").orderBy("depth")) - 1  # a row per depth of a path
    return x.withColumn("chain", chain).where("chain = depth").select("repo", "depth", "dir", "files", "share")
