"""Search over files and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("symbol", "path", "hybrid", "semantic")
KINDS = ("implementation", "test", "config", "doc", "unknown")
SYMBOL_KINDS = ("Function", "Method", "Class", "Struct", "Enum", "Interface", "Trait", "Module")
# Names of directories and files that tell a file's role.
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs")
DOC_DIRS = ("docs", "doc")
CONFIG_NAMES = ("build.rs", "conf.py", "setup.py", "gulpfile.js", "webpack.config.js")


def parse_mode(s: str) -> str:
    s = {"concept": "semantic"}.get(s.lower(), s.lower())
    if s not in MODES:
        raise ValueError(f"search mode {s!r} is none of {', '.join(MODES)}")
    return s


def parse_kind(s: str) -> str:
    s = {"impl": "implementation"}.get(s.lower(), s.lower())
    if s not in KINDS:
        raise ValueError(f"file kind {s!r} is none of {', '.join(KINDS)}")
    return s


def parse_symbol_kind(s: str) -> str:
    by = {k.lower(): k for k in SYMBOL_KINDS}
    if s.lower() not in by:
        raise ValueError(f"symbol kind {s!r} is none of {', '.join(by)}")
    return by[s.lower()]


def role(path: Column, language: Column) -> Column:
    """test, doc, config, implementation or unknown, of a path inside its repo."""
    p = F.lower(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    among = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    test = among(TEST_DIRS) | name.rlike(r"^test_|_test\.|\.test\.|\.spec\.|_spec\.")
    doc = name.endswith(".md") | among(DOC_DIRS)
    return (
        F.when(test, "test").when(doc, "doc").when(language == "Other", "unknown").when(name.isin(*CONFIG_NAMES) | name.endswith(".config.js") | name.endswith(".config.ts"), "config").otherwise("implementation")
    )


def symbol_search(symbols: DataFrame, query: str) -> DataFrame:
    return symbols.where(F.contains(F.lower("name"), F.lit(query.lower())))


def path_search(files: DataFrame, query: str, path: Column) -> DataFrame:
    return files.where(F.contains(F.lower(path), F.lit(query.lower())))


def ranked(hits: DataFrame, degree: DataFrame, per: str, key: str, name: str, k: int = 20) -> DataFrame:
    """The k hits of each group with most arriving edges, then by name and key."""
    x = hits.join(degree.select(F.col("id").alias(key), "n"), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.col("n").desc(), name, key))
    return x.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid(symbols: DataFrame, files: DataFrame, query: str, path: Column) -> DataFrame:
    """(what, file, name): matching symbols and matching paths."""
    a = symbol_search(symbols, query).select(F.lit("symbol").alias("what"), "file", "name")
    return a.unionByName(path_search(files, query, path).select(F.lit("path").alias("what"), "file", F.lit("").alias("name")))
