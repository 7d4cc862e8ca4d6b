"""Candidates for refactoring, from several kinds of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_pairs(exact: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b, exact, overlap): unordered pairs a < b, each once; an exact copy before an overlap, else the greatest overlap.

    exact: a, b; near: a, b, overlap, in any direction and repeated. NULL overlaps and self pairs are left out.
    """
    x = exact.select("a", "b", F.lit(1.0).alias("overlap"), F.lit(True).alias("exact")).unionByName(near.where("overlap IS NOT NULL").select("a", "b", "overlap", F.lit(False).alias("exact")))
    x = x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap", "exact")
    return x.groupBy("a", "b").agg(F.max(F.struct("exact", "overlap")).alias("m")).select("a", "b", "m.exact", "m.overlap")


def candidates(cycles: DataFrame, classes: DataFrame, scattered: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, subject, size): import cycles (component, n), large classes (parent, methods), classes of many parts (parent, components), and duplicate pairs (a, b)."""
    out = cycles.select(F.lit("cycle").alias("kind"), F.col("component").alias("subject"), F.col("n").cast("long").alias("size"))
    out = out.unionByName(classes.select(F.lit("god-class").alias("kind"), F.col("parent").alias("subject"), F.col("methods").cast("long").alias("size")))
    out = out.unionByName(scattered.select(F.lit("low-cohesion").alias("kind"), F.col("parent").alias("subject"), F.col("components").cast("long").alias("size")))
    return out.unionByName(pairs.select(F.lit("duplicate").alias("kind"), F.concat_ws(" ", "a", "b").alias("subject"), F.lit(2).cast("long").alias("size")))


# Programs that print much and whose exit code means something; and what makes a line more than one command.
REWRITABLE = ("cargo", "pytest", "npm", "pnpm", "yarn", "go", "jest", "vitest", "tsc", "eslint", "ruff", "mypy", "flake8", "clippy-driver", "gradle", "mvn", "make")


def rewrite(command: Column) -> Column:
    """The program of a command that may be wrapped; NULL for other programs and for anything that a shell would read further."""
    program = F.regexp_extract(F.trim(command), r"^(\S+)", 1)
    return F.when(program.isin(*REWRITABLE) & ~command.rlike(r"[|&;><`$()\n]"), program)


def cartesian_tables(sql: Column) -> Column:
    """Tables that a query lists by commas with too few equalities of qualified columns to link them; an empty array for others."""
    tail = F.regexp_extract(sql, r"(?is)^\s*select\b.*?\bfrom\s+(.*?)(?:\bwhere\b|\bgroup\s+by\b|\border\s+by\b|\bhaving\b|\blimit\b|\bunion\b|;|\z)", 1)
    where = F.regexp_extract(sql, r"(?is)\bwhere\b(.*)", 1)
    tables = F.filter(F.transform(F.split(tail, ","), lambda t: F.regexp_extract(F.trim(t), r"^([\w.\"]+)", 1)), lambda t: t != "")
    links = F.regexp_count(where, F.lit(r"\b\w+\.\w+\s*=\s*\w+\.\w+"))
    bad = (F.size(tables) >= 2) & ~tail.rlike(r"(?i)\bjoin\b|\(") & (links < F.size(tables) - 1)
    return F.when(bad, tables).otherwise(F.array().cast("array<string>"))


def anchored_proposals(proposals: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, file, line): proposals (id, file, anchor) whose anchor stands in the file's text, white space aside, and the line it starts on.

    One line is looked for within lines; several must run on over lines that are not blank. Others are dropped.
    """
    from codestrata.operators.text import lines_of

    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    x = lines_of(texts.join(proposals.select("file").distinct(), "file", "left_semi"), "file").select("file", "line", flat(F.col("content")).alias("c")).where("c <> ''")
    x = x.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "c"))).alias("x"))
    p = proposals.select("id", "file", F.filter(F.transform(F.split("anchor", "\n"), flat), lambda a: a != "").alias("a")).where(F.size("a") > 0)
    at = F.filter(F.sequence(F.lit(0), F.size("x") - F.size("a")), lambda i: F.forall(F.sequence(F.lit(0), F.size("a") - 1), lambda k: F.contains(F.get("x", i + k)["c"], F.get("a", k))))
    y = p.join(x, "file").where(F.size("x") >= F.size("a")).select("id", "file", F.get("x", F.get(at, F.lit(0)))["line"].alias("line"))
    return y.where("line IS NOT NULL")


def missing_vectors(wanted: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that need a vector yet, and held rows whose key is still wanted."""
    return wanted.join(held.select("key"), "key", "left_anti"), held.join(wanted.select("key"), "key", "left_semi")


def describe(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, text): what stands for a file in a vector index: its path and its symbols."""
    s = symbols.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start_line", "kind", "name"))).alias("s"))
    items = F.transform(F.coalesce("s", F.array().cast("array<struct<start_line:int,kind:string,name:string>>")), lambda v: F.concat(v["kind"], F.lit(" "), v["name"]))
    return files.join(s, "file", "left").select(F.col("file").alias("key"), F.concat_ws("\n", F.col("file"), F.array_join(items, "\n")).alias("text"))
