"""Extraction over frames: one pass over the texts gives the rows of all model tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.extract import lexical, python

SHAPES = {
    "symbols": "id string, file string, sym_ord int, name string, kind string, start_line int, end_line int, parent string, complexity int, max_nesting_depth int, bumpy_road_bumps int, param_count int, primitive_param_count int, body_hash long",
    "imports": "file string, path string, line int, resolved_file string",
    "calls": "file string, caller string, callee_name string, line int",
    "field_accesses": "file string, method string, field_name string, line int",
    "markers": "symbol_id string, kind string, line int, name string",
}


def extracted(texts: DataFrame) -> DataFrame:
    """(file, parsed, one array of rows per table) of texts (file, language, text); languages without an extractor give empty arrays."""
    arrays = ", ".join(f"{k} array<struct<{', '.join(c.replace(' ', ':', 1) for c in v.split(', '))}>>" for k, v in SHAPES.items())
    columns = {k: [c.split(" ")[0] for c in v.split(", ")] for k, v in SHAPES.items()}

    def run(batches):
        for pdf in batches:
            rows = []
            for file, language, text in zip(pdf["file"].tolist(), pdf["language"].tolist(), pdf["text"].tolist(), strict=True):
                got = None
                if text is not None:
                    got = python.extract(file, text) if language == "Python" else lexical.extract(language, file, text)
                rows.append([file, got is not None, *([dict(zip(columns[k], r, strict=True)) for r in (got or {}).get(k, [])] for k in SHAPES)])
            yield pd.DataFrame(rows, columns=["file", "parsed", *SHAPES])

    return texts.select("file", "language", "text").mapInPandas(run, f"file string, parsed boolean, {arrays}")


def table_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode(name).alias("r")).select("r.*")


IMPORTS = {
    "Lua": r"require\s*\(?\s*['\"]([^'\"\n]+)", "Elixir": r"^\s*(?:alias|import|use|require)\s+([\w.]+)", "Haskell": r"^\s*import\s+(?:qualified\s+)?([\w.]+)", "R": r"^\s*(?:library|require)\(\s*['\"]?([\w.]+)",
    "Perl": r"^\s*(?:use|require)\s+([\w:]+)", "Scss": r"^\s*@(?:import|use|forward)\s+['\"]([^'\"\n]+)",
}


def light_imports(texts: DataFrame) -> DataFrame:
    """(file, path, line) of languages that are read for imports only, JVM-side."""
    from codestrata.operators.text import lines_of

    x = lines_of(texts.where(F.col("language").isin(*IMPORTS)), "file").join(texts.select("file", "language"), "file")
    path = F.lit("")
    for lang, p in IMPORTS.items():
        path = F.when(F.col("language") == lang, F.regexp_extract("content", p, 1)).otherwise(path)
    return x.select("file", path.alias("path"), "line").where("path <> ''")
