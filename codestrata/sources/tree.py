"""Source trees: a data source that lists and reads the text files of directories, minding ignore files."""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codestrata.sources.languages import language, line_count

SCHEMA = "repo string, file string, text string, readable boolean"
INDEX_DIR = ".codestrata"
SKIP = (".git", INDEX_DIR)


def reindexable(path: str) -> bool:
    """Whether a change of this path concerns the index: nothing below the version control's or the index's own directory does."""
    return not any(p in SKIP for p in path.replace("\\", "/").split("/"))


def _rules(folder: str) -> list[tuple[str, bool, bool]]:
    """(pattern, negated, directories only) of a folder's ignore file, in order."""
    out = []
    try:
        with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            for x in f.read().splitlines():
                x = x.strip()
                if x and not x.startswith("#"):
                    no = x.startswith("!")
                    x = x.lstrip("!")
                    out.append((x.rstrip("/"), no, x.endswith("/")))
    except OSError:
        pass
    return out


def _ignored(rel: str, is_dir: bool, rules: list[tuple[str, list]]) -> bool:
    verdict = False
    for base, own in rules:
        inner = rel[len(base) :].lstrip("/") if base else rel
        for pattern, no, dirs in own:
            if dirs and not is_dir:
                continue
            p = pattern.lstrip("/")
            anchored = "/" in pattern.rstrip("/")
            if fnmatch.fnmatch(inner, p) or (not anchored and fnmatch.fnmatch(os.path.basename(inner), p)):
                verdict = not no
    return verdict


class Folder(InputPartition):
    def __init__(self, repo: str, root: str, rel: str, deep: bool, rules):
        self.repo, self.root, self.rel, self.deep, self.rules = repo, root, rel, deep, rules


class TreeReader(DataSourceReader):
    """One partition for each top-level directory of each tree, and one for the files beside them."""

    def __init__(self, options):
        self.roots = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        out = []
        for root in self.roots:
            repo = os.path.basename(os.path.normpath(root))
            rules = [("", _rules(root))]
            out.append(Folder(repo, root, "", False, rules))
            for name in sorted(os.listdir(root)):
                if os.path.isdir(os.path.join(root, name)) and name not in SKIP and not _ignored(name, True, rules):
                    out.append(Folder(repo, root, name, True, rules))
        return out or [Folder("", "", "", False, [])]

    def read(self, part):
        if not part.root:
            return
        todo = [(part.rel, part.rules)]
        while todo:
            rel, rules = todo.pop()
            folder = os.path.join(part.root, rel)
            if rel:
                rules = rules + [(rel, _rules(folder))]
            for name in sorted(os.listdir(folder)):
                inner = f"{rel}/{name}" if rel else name
                path = os.path.join(folder, name)
                if os.path.isdir(path):
                    if part.deep and name not in SKIP and not _ignored(inner, True, rules):
                        todo.append((inner, rules))
                elif not _ignored(inner, False, rules):
                    try:
                        with open(path, encoding="utf-8", newline="") as f:
                            yield (part.repo, f"{part.repo}/{inner}", f.read(), True)
                    except (OSError, UnicodeDecodeError):
                        yield (part.repo, f"{part.repo}/{inner}", None, False)


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "repo_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, *roots: str) -> DataFrame:
    """(repo, file, text, readable, language, lines) of every file not ignored; unreadable and binary files have no text."""
    spark.dataSource.register(TreeSource)
    raw = spark.read.format("repo_files").option("path", ",".join(roots)).load()
    return raw.withColumn("language", language(F.col("file"))).withColumn("lines", line_count(F.col("text")))


def indexed(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of known languages, and per repo how many others there are."""
    known = (F.col("language") != "Other") & F.col("readable")
    return tree.where(known), tree.where(~known).groupBy("repo").agg(F.count("*").alias("other_files"))
