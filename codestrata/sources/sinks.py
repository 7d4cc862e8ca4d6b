"""Where results go: the index and its portable form, page files, the store of left-out output."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 2
TABLES = ("files", "symbols", "imports", "calls", "field_accesses")


def write_index(tables: dict[str, DataFrame], path: str, commit: str | None = None) -> None:
    """One Parquet table each, the status last: who finds it finds all the rest."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    row = [(VERSION, commit[:12] if commit else None, tables["files"].count() if "files" in tables else 0)]
    spark.createDataFrame(row, "version int, indexed_commit string, files long").write.mode("overwrite").parquet(f"{path}/status")


def read_status(spark: SparkSession, path: str) -> dict | None:
    """The status, or None if there is none or it is of another version."""
    try:
        row = spark.read.parquet(f"{path}/status").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row.asDict() if row and row.version == VERSION else None


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if read_status(spark, path) is None:
        raise FileNotFoundError(f"no index of version {VERSION} at {path}: build it with write_index")
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def head_moved(before: Column, now: Column) -> Column:
    """Both known and not the same."""
    return F.coalesce(before.isNotNull() & now.isNotNull() & (before != now), F.lit(False))


def relative(path: Column, root: str) -> Column:
    """A path below the root without it, the root itself as `.`; others as they are."""
    r = root.rstrip("/")
    return F.when(path == r, ".").when(path.startswith(r + "/"), F.substr(path, F.lit(len(r) + 2))).otherwise(path)


def anchored(path: Column, root: str) -> Column:
    r = root.rstrip("/")
    return F.when(path == ".", r).when(path.startswith("/"), path).otherwise(F.concat(F.lit(r + "/"), path))


def intern(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with the caller's number in place of its id, and the dictionary (n, caller) in the order of ids."""
    names = calls.where("caller IS NOT NULL").select("caller").distinct()
    from codestrata.operators.ranking import positions
    from codestrata.session import Scratch

    book = positions(Scratch(calls.sparkSession, "intern"), names.withColumn("_all", F.lit(0)), "_all", [F.col("caller").asc()], "n").select(F.col("n"), "caller")
    return calls.join(book, "caller", "left").drop("caller").withColumnRenamed("n", "caller_n"), book


def write_portable(tables: dict[str, DataFrame], root: str, path: str) -> None:
    """The index with relative paths, rows in canonical order within sorted files, and caller ids interned."""
    for name, df in tables.items():
        for c in ("file", "resolved_file", "id", "caller", "method", "parent"):
            if c in df.columns:
                df = df.withColumn(c, relative(F.col(c), root))
        if name == "calls":
            df, book = intern(df)
            book.write.mode("overwrite").parquet(f"{path}/callers")
        cols = [c for c, t in df.dtypes if not t.startswith("map")]
        df.withColumn("version", F.lit(VERSION)).repartitionByRange(*cols).sortWithinPartitions(*cols).write.mode("overwrite").parquet(f"{path}/{name}")


def read_portable(spark: SparkSession, path: str, root: str, names=TABLES) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        if not df.where(F.col("version") != VERSION).isEmpty():
            raise ValueError(f"{name} is of another version than {VERSION}")
        df = df.drop("version")
        if name == "calls":
            df = df.join(spark.read.parquet(f"{path}/callers").withColumnRenamed("n", "caller_n"), "caller_n", "left").drop("caller_n")
        for c in ("file", "resolved_file", "id", "caller", "method", "parent"):
            if c in df.columns:
                df = df.withColumn(c, anchored(F.col(c), root))
        out[name] = df
    return out


def write_dependents(edges: DataFrame, path: str) -> None:
    """Each file's sorted importers, bucketed by hash so that a lookup reads one file."""
    x = edges.groupBy(F.col("dst").alias("file")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))
    x.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(16))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def written_at(spark: SparkSession, path: str) -> int | None:
    """When a table was last completed, in milliseconds; None if it never was."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None


def dependents(spark: SparkSession, path: str, file: str, index: str | None = None) -> list[str] | None:
    """A file's importers; None if they were written before the index (a folder), or never."""
    at = written_at(spark, path)
    if at is None or index is not None and at < (written_at(spark, f"{index}/status") or 0):
        return None
    rows = spark.read.parquet(path).where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(file)), F.lit(16))) & (F.col("file") == file)).select("dependents").take(1)
    return rows[0][0] if rows else []


def graph_json(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """(json) of each node with its sorted distinct edges and, if `unresolved` (id, n) is given, how many of its imports lead nowhere."""
    out = edges.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("dst", "kind"))).alias("edges"))
    x = nodes.join(out, nodes.id == out.src, "left")
    fields = ["id", F.coalesce("edges", F.array().cast("array<struct<dst:string,kind:string>>")).alias("edges")]
    if unresolved is not None:
        x = x.join(unresolved.select("id", F.col("n").alias("unresolved")), "id", "left")
        fields.append(F.coalesce("unresolved", F.lit(0)).cast("long").alias("unresolved"))
    return x.select(F.to_json(F.struct(*fields)).alias("json"))


def wiki_pages(files: DataFrame, symbols: DataFrame, edges: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(file, page, digest): a page for each file with its symbols, what it imports, how many files import it, and its findings (file, kind, line), if given."""
    s = symbols.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start_line", "kind", "name"))).alias("s"))
    d = edges.groupBy(F.col("src").alias("file")).agg(F.array_sort(F.collect_set("dst")).alias("d"))
    n = edges.select("src", F.col("dst").alias("file")).distinct().groupBy("file").agg(F.count("*").alias("used"))
    x = files.join(s, "file", "left").join(d, "file", "left").join(n, "file", "left")
    items = F.transform(F.coalesce("s", F.array().cast("array<struct<start_line:int,kind:string,name:string>>")), lambda v: F.concat(F.lit("- "), v["kind"], F.lit(" `"), v["name"], F.lit("` at line "), v["start_line"].cast("string")))
    uses = F.transform(F.coalesce("d", F.array().cast("array<string>")), lambda v: F.concat(F.lit("- "), v))
    page = F.concat_ws("\n", F.concat(F.lit("# "), F.col("file")), F.lit(""), F.concat(F.col("language"), F.lit(", "), F.col("lines").cast("string"), F.lit(" lines")), F.lit("\n## Symbols"), F.array_join(items, "\n"), F.lit("\n## Imports"), F.array_join(uses, "\n"), F.format_string("\nImported by %d files", F.coalesce("used", F.lit(0))))
    if findings is not None:
        found = findings.groupBy(F.col("file").alias("_f")).agg(F.array_sort(F.collect_list(F.struct("kind", "line"))).alias("found"))
        x = x.join(found, F.col("file") == F.col("_f"), "left")
        items = F.transform("found", lambda v: F.concat(F.lit("- "), v["kind"], F.coalesce(F.concat(F.lit(" at line "), v["line"].cast("string")), F.lit(""))))
        page = F.concat_ws("\n", page, F.when(F.size("found") > 0, F.lit("\n## Findings")), F.when(F.size("found") > 0, F.array_join(items, "\n")))
    return x.select("file", page.alias("page")).withColumn("digest", F.sha2("page", 256))


def freshness(pages: DataFrame, held: DataFrame) -> DataFrame:
    """(file, state): new, changed or unchanged against the digests held; and missing for held pages whose file is gone."""
    x = pages.select("file", "digest").join(held.select("file", F.col("digest").alias("old")), "file", "full")
    return x.select("file", F.when(F.col("old").isNull(), "new").when(F.col("digest").isNull(), "missing").when(F.col("old") == F.col("digest"), "unchanged").otherwise("changed").alias("state"))


def export_pages(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """Copy pages (file, page) out as text, a folder for each file; an export that is there already stops it unless `overwrite`."""
    pages.select(F.col("page").alias("value"), "file").write.mode("overwrite" if overwrite else "error").partitionBy("file").option("lineSep", "\n").text(path)


REF = 12
TTL, ROOM = 7 * 86400, 50 * 1024 * 1024


def omissions(texts: DataFrame) -> DataFrame:
    """(ref, text, size): left-out texts under a name made of their content, each once."""
    return texts.where("text IS NOT NULL").select(F.substring(F.sha2("text", 256), 1, REF).alias("ref"), "text", F.octet_length("text").cast("long").alias("size")).dropDuplicates(["ref"])


def find_omission(store: DataFrame, ref: str) -> str:
    rows = store.where(F.col("ref") == ref).select("text").take(1)
    if not rows:
        raise KeyError(f"nothing is stored under {ref}")
    return rows[0][0]


def prune(store: DataFrame, now: int, keep: str | None = None, ttl: int = TTL, room: int = ROOM) -> DataFrame:
    """Rows (ref, size, at) that stay: none older than ttl, and of the rest the newest that fit into the room; `keep` always stays.

    The running total is taken over hourly sums first, so that no window holds the whole store but that of the hour in which the room ends.
    """
    kept = F.col("ref") == F.lit(keep) if keep else F.lit(False)
    x = store.where((F.col("at") >= now - ttl) | kept).withColumn("hour", F.floor(F.col("at") / 3600))
    hours = x.groupBy("hour").agg(F.sum("size").alias("s"))
    before = hours.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy(F.col("hour").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("hour", "before")
    run = F.sum("size").over(Window.partitionBy("hour").orderBy(F.col("at").desc(), "ref").rowsBetween(Window.unboundedPreceding, 0))
    return x.join(before, "hour").withColumn("run", F.col("before") + run).where((F.col("run") <= room) | kept).select(*store.columns)


