"""Queries that read the texts themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.extract.run import extracted, table_of
from codestrata.plans import model as M
from codestrata.session import table


def _rows(spark, sf_dir):
    texts = table(spark, sf_dir, "file_texts").select("file", "text").distinct()
    return extracted(M.files(spark, sf_dir).select("file", "language").join(texts, "file"))


def extract_symbols(spark, sf_dir):
    return table_of(_rows(spark, sf_dir), "symbols").select("id", "file", "name", "kind", "start_line", "end_line", F.coalesce("complexity", F.lit(0)).alias("complexity"))


def extract_markers(spark, sf_dir):
    return table_of(_rows(spark, sf_dir), "markers")


def extract_overview(spark, sf_dir):
    """Rows of each model table, per language."""
    r = _rows(spark, sf_dir).join(M.files(spark, sf_dir).select("file", "language"), "file")
    return r.groupBy("language").agg(F.count("*").alias("files"), F.count_if("parsed").alias("parsed"), *[F.sum(F.size(k)).alias(k) for k in ("symbols", "imports", "calls", "field_accesses")])


QUERIES = {f.__name__: f for f in (extract_symbols, extract_markers, extract_overview)}
SQL: dict = {}
