"""Health of files: markers found in symbols and signals, their penalties, and scores."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The penalty of each kind of finding, and the limits beyond which size and shape markers fire.
PENALTIES = {
    "long-function": 0.5, "high-complexity": 1.0, "too-many-params": 0.3, "god-class": 1.5, "duplicate-code": 0.5, "near-duplicate-code": 0.3, "possibly-dead-code": 0.2, "low-cohesion": 1.0, "nested-complexity": 1.0,
    "bumpy-road": 0.5, "complex-conditional": 0.3, "primitive-obsession": 0.3, "io-in-loop": 0.3, "string-concat-in-loop": 0.3, "resource-construction-in-loop": 0.3, "lock-in-loop": 0.3, "list-insert-zero-in-loop": 0.3,
    "json-parse-in-loop": 0.3, "regex-compile-in-loop": 0.3, "nested-loop-with-io": 0.6, "nested-loop-quadratic": 0.6, "serial-await-in-loop": 0.3, "pd-concat-in-loop": 0.6, "blocking-sync-in-async": 0.6,
    "blocking-io-under-lock": 0.6, "array-spread-in-reduce": 0.6, "sql-cartesian-join": 0.6, "defer-in-loop": 0.6, "goroutine-in-unbounded-loop": 0.6, "membership-test-in-loop": 0.6, "hot-path-sync-io": 0.3,
    "coverage-gap": 0.4, "untested-hotspot": 1.0, "prior-defect": 0.5, "churn-risk": 0.3, "knowledge-loss": 0.4, "co-change-scatter": 0.3, "hidden-coupling": 0.5, "developer-congestion": 0.3,
}
LIMITS = {"lines": 50, "complexity": 10, "params": 6, "nesting": 4, "bumps": 3, "primitives": 3, "methods": 15, "churn": 20, "lost_churn": 5, "partners": 5, "coupling": 3, "authors": 4, "dependents": 4, "untested": 40.0, "gap": 50.0}

FINDING = "file string, symbol string, line int, kind string, detail string"


def weights(spark: SparkSession, overrides: dict[str, float] | None = None) -> DataFrame:
    """(kind, penalty), with a project's own values in place of the defaults; unknown kinds are refused."""
    overrides = overrides or {}
    if unknown := set(overrides) - set(PENALTIES):
        raise ValueError(f"no such kinds: {sorted(unknown)}")
    return spark.createDataFrame(list((PENALTIES | overrides).items()), "kind string, penalty double")


def weights_from_toml(spark: SparkSession, text: str) -> DataFrame:
    """(kind, penalty) with the overrides of a TOML text of `kind = penalty` lines, hyphens or underscores in kinds."""
    return weights(spark, {k.replace("_", "-"): float(v) for k, v in tomllib.loads(text).items()})


def finding(df: DataFrame, kind: str, file="file", symbol=None, line=None, detail=None) -> DataFrame:
    nothing = lambda t: F.lit(None).cast(t)
    return df.select(
        F.col(file).alias("file"), (nothing("string") if symbol is None else F.col(symbol)).alias("symbol"), (nothing("int") if line is None else F.col(line).cast("int")).alias("line"),
        F.lit(kind).alias("kind"), (nothing("string") if detail is None else detail.cast("string")).alias("detail"),
    )


def function_markers(symbols: DataFrame, limits: dict | None = None) -> DataFrame:
    """Size and shape findings of functions and methods, in one pass over the symbols; a NULL metric fires nothing."""
    n = LIMITS | (limits or {})
    length = F.col("end_line") - F.col("start_line") + 1
    tests = [
        ("long-function", length > n["lines"], length), ("high-complexity", F.col("complexity") > n["complexity"], F.col("complexity")), ("too-many-params", F.col("param_count") > n["params"], F.col("param_count")),
        ("nested-complexity", F.col("max_nesting_depth") > n["nesting"], F.col("max_nesting_depth")), ("bumpy-road", F.col("bumpy_road_bumps") >= n["bumps"], F.col("bumpy_road_bumps")),
        ("primitive-obsession", F.col("primitive_param_count") >= n["primitives"], F.col("primitive_param_count")),
    ]
    fired = F.filter(F.array(*[F.when(t, F.struct(F.lit(k).alias("kind"), d.cast("string").alias("detail"))) for k, t, d in tests]), lambda x: x.isNotNull())
    x = symbols.where(F.col("kind").isin("Function", "Method")).select("file", F.col("id").alias("symbol"), F.col("start_line").alias("line"), F.explode(fired).alias("m"))
    return x.select("file", "symbol", "line", "m.kind", "m.detail")


def org_markers(signals: DataFrame, limits: dict | None = None) -> DataFrame:
    """Findings on files from their history (file, churn, fixes, bus_factor, partners, recent_authors)."""
    n = LIMITS | (limits or {})
    tests = [
        ("prior-defect", F.col("fixes") > 0, F.col("fixes")), ("churn-risk", F.col("churn") >= n["churn"], F.col("churn")), ("knowledge-loss", (F.col("churn") >= n["lost_churn"]) & (F.col("bus_factor") == 1), F.col("churn")),
        ("co-change-scatter", F.col("partners") >= n["partners"], F.col("partners")), ("developer-congestion", F.col("recent_authors") > n["authors"], F.col("recent_authors")),
    ]
    fired = F.filter(F.array(*[F.when(t, F.struct(F.lit(k).alias("kind"), d.cast("string").alias("detail"))) for k, t, d in tests]), lambda x: x.isNotNull())
    x = signals.select("file", F.explode(fired).alias("m"))
    return x.select("file", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("int").alias("line"), "m.kind", "m.detail")


def coverage_markers(coverage: DataFrame, hot: DataFrame, dependents: DataFrame, limits: dict | None = None) -> DataFrame:
    """Findings on measured files: hot, depended-on and hardly tested, or else below the gap. Unmeasured files (NULL) have none."""
    n = LIMITS | (limits or {})
    x = coverage.where("percent IS NOT NULL").join(hot.select("file", F.lit(True).alias("hot")).distinct(), "file", "left").join(dependents.select("file", "dependents"), "file", "left")
    untested = F.coalesce("hot", F.lit(False)) & (F.coalesce("dependents", F.lit(0)) >= n["dependents"]) & (F.col("percent") < n["untested"])
    kind = F.when(untested, "untested-hotspot").when(F.col("percent") < n["gap"], "coverage-gap")
    x = x.select("file", kind.alias("kind"), F.round("percent", 1).cast("string").alias("detail")).where("kind IS NOT NULL")
    return x.select("file", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("int").alias("line"), "kind", "detail")


def text_markers(markers: DataFrame, hot: DataFrame) -> DataFrame:
    """Findings of the markers (symbol_id, kind, line, name) that extraction emits; a synchronous call is one only in a file of `hot` (file). Kinds without a penalty fire nothing."""
    x = markers.withColumn("file", F.regexp_extract("symbol_id", "^(.*?)::", 1)).join(hot.select("file", F.lit(True).alias("hot")).distinct(), "file", "left")
    kind = F.when(F.col("kind") != "sync-io", F.col("kind")).when(F.col("hot"), F.lit("hot-path-sync-io"))
    x = x.select("file", F.col("symbol_id").alias("symbol"), F.col("line").cast("int").alias("line"), kind.alias("kind"), F.col("name").alias("detail"))
    return x.where(F.col("kind").isin(*PENALTIES))


def score_files(files: DataFrame, findings: DataFrame, penalties: DataFrame) -> DataFrame:
    """(file, score, findings): ten less the penalties of a file's findings, within 0 and 10. Findings of unknown kinds cost nothing."""
    cost = findings.join(F.broadcast(penalties), "kind", "left").groupBy("file").agg(F.sum(F.coalesce("penalty", F.lit(0.0))).alias("cost"), F.count("*").alias("findings"))  # a row per kind of finding
    x = files.select("file", "lines").join(cost, "file", "left")
    return x.select("file", "lines", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10.0 - F.coalesce("cost", F.lit(0.0)))), 6).alias("score"), F.coalesce("findings", F.lit(0)).alias("findings"))


def summary(scores: DataFrame) -> DataFrame:
    """One row: files, mean score (10 without files), and the mean by lines (the plain mean if there are no lines)."""
    x = scores.agg(F.count("*").alias("files"), F.coalesce(F.avg("score"), F.lit(10.0)).alias("average"), F.sum(F.col("score") * F.col("lines")).alias("w"), F.sum("lines").alias("l"))
    return x.select("files", F.round("average", 6).alias("average"), F.round(F.when(F.col("l") > 0, F.col("w") / F.col("l")).otherwise(F.col("average")), 6).alias("by_lines"))
