"""Coverage reports and the ledger of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_lcov(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, line, hits) with hits summed, and (test, path, line), of report lines (report, ord, value).

    A record runs from its SF line to end_of_record; TN names the test of the records after it, a blank one none.
    Line data outside of a record, or that are no `line,hits`, raise an error when read.
    """
    w = Window.partitionBy("report").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    v = F.trim("value")
    mark = F.when(v.startswith("SF:"), F.substr(v, F.lit(4))).when(v == "end_of_record", F.lit(""))
    x = lines.select("report", v.alias("v"), F.last(mark, True).over(w).alias("path"), F.last(F.when(v.startswith("TN:"), F.trim(F.substr(v, F.lit(4)))), True).over(w).alias("test"))
    x = x.where(F.col("v").startswith("DA:"))
    bad = F.coalesce("path", F.lit("")) == ""
    ok = F.col("v").rlike(r"^DA:\d+,\d+(?:,\S+)?$")
    x = x.withColumn("path", F.when(bad, F.raise_error(F.lit("line data before a source file"))).when(~ok, F.raise_error(F.concat(F.lit("malformed line data: "), F.col("v")))).otherwise(F.col("path")))
    x = x.select("test", "path", F.regexp_extract("v", r"^DA:(\d+),", 1).cast("int").alias("line"), F.regexp_extract("v", r"^DA:\d+,(\d+)", 1).cast("long").alias("hits"))
    tests = x.where("test <> '' AND hits > 0").select("test", "path", "line").distinct()
    return x.groupBy("path", "line").agg(F.sum("hits").alias("hits")), tests


def place(lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report lines (path, line, hits) by indexed file (file, line, hits), and the paths that fit none.

    A path's suffixes are joined with those of the files, of each of which only the first file by name is kept, so that a
    common base name is one row; the longest suffix that is a file's end wins. If two paths fit one
    file, the one that is last by name holds for the lines of both.
    """
    parts = F.split(F.translate("path", "\\", "/"), "/")
    paths = lines.select("path").distinct().select("path", F.filter(parts, lambda s: ~s.isin("", ".")).alias("p"))
    ends = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"), "p").select("path", (F.size("p") - F.col("i") + 1).alias("n"), F.array_join(F.slice("p", F.col("i"), F.size("p")), "/").alias("end"))
    q = F.split("file", "/")
    own = files.select("file", F.explode(F.sequence(F.lit(1), F.size(q))).alias("i")).select("file", F.array_join(F.slice(F.split("file", "/"), F.col("i"), F.size(F.split("file", "/"))), "/").alias("end"))
    hit = ends.join(own.groupBy("end").agg(F.min("file").alias("file")), "end").groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("n"), "file")).alias("m")).select("path", F.col("m.file").alias("file"))
    placed = lines.join(hit, "path").groupBy("file", "line").agg(F.max(F.struct("path", "hits")).alias("m")).select("file", "line", F.col("m.hits").alias("hits"))
    return placed, paths.select("path").join(hit, "path", "left_anti")


LEDGER = "at long, kind string, program string, raw_bytes long, kept_bytes long, detail string, exit_code int"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's records; malformed lines are dropped, a missing exit code is NULL, never 0."""
    return spark.read.schema(LEDGER).option("sep", "\t").option("mode", "DROPMALFORMED").option("nullValue", "").csv(path).where("at IS NOT NULL AND kind IS NOT NULL")


def append_ledger(records: DataFrame, path: str) -> None:
    records.select("at", "kind", "program", "raw_bytes", "kept_bytes", "detail", "exit_code").write.mode("append").option("sep", "\t").csv(path)
