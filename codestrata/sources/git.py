"""Version control: logs, numbers of changed lines, blame and diffs, from their text forms or from a repository."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fields of a record are parted by 0x1f, records by 0x1e; the subject only, and the files below it.
FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%at%x1f%s"
SCHEMA = "repo string, log_ord long, hash string, author string, author_email string, ts long, message string, files array<string>"


class Repo(InputPartition):
    def __init__(self, path: str):
        self.path = path


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.limit = options.get("limit")

    def partitions(self):
        return [Repo(p) for p in self.paths]

    def read(self, part):
        cmd = ["git", "-C", part.path, "log", "--name-only", f"--pretty=format:{FORMAT}"] + (["-n", str(int(self.limit))] if self.limit else [])
        repo = part.path.rstrip("/").rsplit("/", 1)[-1]
        for n, record in enumerate(_records(cmd)):
            head, _, rest = record.partition("\n")
            h, an, ae, at, s = head.split("\x1f", 4)
            yield (repo, n, h, an, ae, int(at), s, [f"{repo}/{x}" for x in rest.split("\n") if x.strip()])


def _records(cmd: list[str]):
    """The records that a command writes, one at a time, however long its output is."""
    with subprocess.Popen(cmd, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as run:
        held = ""
        while chunk := run.stdout.read(1 << 20):
            *done, held = (held + chunk).split("\x1e")
            yield from (x for x in done if x.strip())
        if held.strip():
            yield held
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, cmd)


class LogSource(DataSource):
    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options)


def read_log(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """Commits of repositories, newest first by log_ord; a limit is handed to the source."""
    spark.dataSource.register(LogSource)
    r = spark.read.format("git_log").option("path", ",".join(paths))
    return (r.option("limit", limit) if limit else r).load()


def parse_log(records: DataFrame) -> DataFrame:
    """(hash, author, author_email, ts, message, files) of records (value), as read with `lineSep` 0x1e; blank records are left out."""
    head = F.split(F.substring_index("value", "\n", 1), "\x1f", 5)
    rest = F.filter(F.slice(F.split("value", "\n"), F.lit(2), F.size(F.split("value", "\n"))), lambda x: F.trim(x) != "")
    x = records.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select(head.alias("h"), rest.alias("files"))
    return x.select(F.col("h")[0].alias("hash"), F.col("h")[1].alias("author"), F.col("h")[2].alias("author_email"), F.expr("try_cast(h[3] AS long)").alias("ts"), F.coalesce(F.get("h", F.lit(4)), F.lit("")).alias("message"), "files")


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(added, deleted, file) of lines `a<TAB>d<TAB>file` (value); `-`, as of binaries, counts 0."""
    p = F.split("value", "\t", 3)
    n = lambda i: F.coalesce(F.expr(f"try_cast(p[{i}] AS long)"), F.lit(0))
    return lines.select(p.alias("p")).where(F.size("p") == 3).select(n(0).alias("added"), n(1).alias("deleted"), F.col("p")[2].alias("file"))


def parse_blame(lines: DataFrame) -> DataFrame:
    """(file, author, lines, percentage) from line-porcelain lines (file, value), most lines first."""
    per = lines.where(F.col("value").startswith("author ")).groupBy("file", F.substr("value", F.lit(8)).alias("author")).agg(F.count("*").alias("lines"))
    whole = F.sum("lines").over(Window.partitionBy("file"))
    return per.select("file", "author", "lines", (100.0 * F.col("lines") / whole).alias("percentage"))


HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def parse_diff(lines: DataFrame) -> DataFrame:
    """(file, line): the new side's changed lines of unified diffs (diff, ord, value). Deleted files have none."""
    w = Window.partitionBy("diff").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    file = F.regexp_extract("value", r"^\+\+\+ (?:b/)?(\S.*)$", 1)
    start = F.regexp_extract("value", HUNK, 1)
    x = lines.select("diff", "ord", "value", F.last(F.when(file != "", file), True).over(w).alias("file"), F.last(F.when(start != "", F.col("ord")), True).over(w).alias("at"), F.last(F.when(start != "", start.cast("int")), True).over(w).alias("start"))
    first = F.substring("value", 1, 1)
    x = x.where("at IS NOT NULL AND ord > at").where(~F.col("value").rlike(r"^(?:\+\+\+|---) ")).withColumn("new", first.isin("+", " ").cast("int"))
    hunk = Window.partitionBy("diff", "at").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("line", F.col("start") - 1 + F.sum("new").over(hunk))
    return x.where((F.substring("value", 1, 1) == "+") & (F.col("file") != "/dev/null")).select("file", F.col("line").cast("int").alias("line"))
