"""The ledger of runs: savings, corrections of failed runs, and quiet periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ranking import positions
from codestrata.session import Scratch

AHEAD = 3


RUNS = ("distilled", "ran")  # kinds of records that are runs


def observed(records: DataFrame) -> DataFrame:
    """One row: how many records (kind, exit_code) are runs whose end is known."""
    return records.agg(F.count_if(F.col("kind").isin(*RUNS) & F.col("exit_code").isNotNull()).alias("runs"))


def fumbles(scratch: Scratch, runs: DataFrame, who: str, least: int = 1) -> DataFrame:
    """(program, fumbles, exit_codes): failed runs that the same program made good within its user's next AHEAD runs, and the sorted codes they ended with.

    runs: who, at, program, exit_code, ord, and kind if not all are runs; a NULL exit code is unknown: neither failed nor good. ord
    tells rows of a time apart. A run's place among its user's comes from a range-partitioned sort, so that one user may hold any share of the
    runs; failures are joined with the good runs of the next places.
    """
    x = runs.where(F.col("kind").isin(*RUNS)) if "kind" in runs.columns else runs
    placed = scratch.write(positions(scratch, x.select(who, "at", "ord", "program", "exit_code"), who, [F.col("at").asc(), F.col("ord").asc()], "place"), "places")
    bad = placed.where("exit_code IS NOT NULL AND exit_code <> 0")
    next_ = bad.select(who, "program", "place", "exit_code", F.explode(F.sequence(F.col("place") + 1, F.col("place") + AHEAD)).alias("then"))
    good = placed.where("exit_code = 0").select(who, "program", F.col("place").alias("then"))
    made = next_.join(good, [who, "program", "then"], "left_semi").select(who, "program", "place", "exit_code").distinct()
    return made.groupBy("program").agg(F.count("*").alias("fumbles"), F.array_sort(F.collect_set("exit_code")).alias("exit_codes")).where(F.col("fumbles") >= least)


def savings(records: DataFrame, by: list[str]) -> DataFrame:
    """Bytes and tokens kept out, per group, with a total row (NULLs) from the same pass. raw_bytes less kept_bytes, never negative."""
    saved = F.greatest(F.col("raw_bytes") - F.col("kept_bytes"), F.lit(0))
    return records.rollup(*by).agg(F.count("*").alias("records"), F.sum(saved).alias("saved_bytes")).withColumn("saved_tokens", F.floor(F.col("saved_bytes") / 4))


def quiet_sessions(events: DataFrame, who: str, gap_seconds: int) -> DataFrame:
    """(who, started, events): runs of events with less than the gap between neighbours."""
    return events.groupBy(who, F.session_window("at", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("events")).select(who, F.col("w.start").alias("started"), "events")
