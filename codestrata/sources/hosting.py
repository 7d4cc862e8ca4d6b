"""Stored pages of a code host's interface: merged changes and closed reports. Nothing here goes to the network; whoever has access stores the pages, a JSON array of objects each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.text import is_decision

PULLS = "number long, title string, body string, merged_at string, files array<struct<filename: string>>"
ISSUES = "number long, state string, labels array<struct<name: string>>"
BUG_LABELS = ("bug", "defect", "regression", "crash")


def merged_changes(spark: SparkSession, path: str) -> DataFrame:
    """(number, title, body, files) of the changes that were merged; pages that are no JSON and objects without a number are dropped, a change on two pages counts once."""
    rows = spark.read.schema(PULLS).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("number IS NOT NULL AND merged_at IS NOT NULL")
    names = F.coalesce(F.transform("files", lambda f: f["filename"]), F.array().cast("array<string>"))
    return rows.select("number", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), names.alias("files")).dropDuplicates(["number"])


def change_decisions(changes: DataFrame) -> DataFrame:
    """(id, title, body, files) of merged changes whose title or body speaks of a decision."""
    return changes.where(is_decision(F.concat_ws("\n", "title", "body"))).select(F.concat(F.lit("pr:"), F.col("number").cast("string")).alias("id"), "title", "body", "files")


def closed_bugs(spark: SparkSession, path: str) -> DataFrame:
    """(number) of the reports that are closed and bear a label that names a bug."""
    rows = spark.read.schema(ISSUES).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    bug = F.exists("labels", lambda x: F.lower(x["name"]).rlike("|".join(BUG_LABELS)))
    return rows.where((F.col("state") == "closed") & F.coalesce(bug, F.lit(False))).select("number").distinct()


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, body) of decisions written by hand, a JSON object a line; lines without an id are dropped."""
    return spark.read.schema("id string, title string, body string").json(path).where("id IS NOT NULL")
