"""Change history: churn, coupling, ownership, risk and activity, from commits and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.ranking import positions
from codestrata.session import Scratch

DECAY_DAYS = 90.0  # weights fall by a factor e in so many days
DAY, WEEK = 86400, 604800
FIX_WORDS = ("fix", "bug", "hotfix", "patch")
PAIR_MIN, PAIR_MAX = 2, 50


def is_fix(message: Column) -> Column:
    """Whether a subject speaks of a repair, by part of a word; a NULL subject does not."""
    return F.coalesce(F.lower(message).rlike("|".join(FIX_WORDS)), F.lit(False))


def file_history(commits: DataFrame, touched: DataFrame, now: int) -> DataFrame:
    """(file, churn, decayed_churn, fixes, authors): one pass over all commits of each file.

    commits: hash, ts, author, message; touched: hash, file, both without repeats. Times after `now` count as now.
    """
    age = F.greatest(F.lit(now) - F.col("ts"), F.lit(0)) / float(DAY)
    return (
        touched.select("hash", "file").join(commits.select("hash", "ts", "author", "message"), "hash").groupBy("file")
        .agg(F.count("*").alias("churn"), F.sum(F.exp(-age / DECAY_DAYS)).alias("decayed_churn"), F.count_if(is_fix(F.col("message"))).alias("fixes"), F.countDistinct("author").alias("authors"))
    )


def last_touch(commits: DataFrame, touched: DataFrame) -> DataFrame:
    """(file, hash7, author): each file's newest commit by log order, which author time need not follow."""
    newest = touched.select("hash", "file").join(commits.select("hash", "log_ord", "author"), "hash").groupBy("file").agg(F.min(F.struct("log_ord", "hash", "author")).alias("m"))
    return newest.select("file", F.substring("m.hash", 1, 7).alias("hash7"), F.col("m.author").alias("author"))


def co_changes(touched: DataFrame, least: int) -> DataFrame:
    """(file_a, file_b, count) of pairs that share `least` commits or more of PAIR_MIN to PAIR_MAX files.

    A commit's files are gathered only if there are few enough, so that a commit of any size costs one count.
    """
    rows = touched.select("hash", "file")
    small = rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n").between(PAIR_MIN, PAIR_MAX)).select("hash")
    sets = rows.join(small, "hash", "left_semi").groupBy("hash").agg(F.array_sort(F.collect_list("file")).alias("s"))
    heads = sets.select("s", F.posexplode("s").alias("i", "file_a"))
    pairs = heads.select("file_a", F.explode(F.slice("s", F.col("i") + 2, F.lit(PAIR_MAX))).alias("file_b"))
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("count")).where(F.col("count") >= least)


def both_ways(pairs: DataFrame) -> DataFrame:
    flipped = pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("partner"), "count")
    return pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"), "count").unionByName(flipped)


def ownership(touched: DataFrame, commits: DataFrame) -> DataFrame:
    """(file, author, lines, share): lines each author added to a file, and their part of all. NULL authors and counts are left out."""
    rows = touched.select("hash", "file", "added").join(commits.select("hash", "author"), "hash").where("author IS NOT NULL AND added > 0")
    lines = rows.groupBy("file", "author").agg(F.sum("added").alias("lines"))
    total = lines.groupBy("file").agg(F.sum("lines").alias("total"))
    return lines.join(total, "file").select("file", "author", "lines", (F.col("lines") / F.col("total")).alias("share"))


def bus_factor(owned: DataFrame) -> DataFrame:
    """(file, bus_factor): the fewest authors who together hold half of a file. A window holds one row per author of a file."""
    w = Window.partitionBy("file").orderBy(F.col("lines").desc(), "author")
    run = owned.withColumn("rank", F.row_number().over(w)).withColumn("held", F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    all_of = F.sum("lines").over(Window.partitionBy("file"))
    return run.withColumn("total", all_of).where(F.col("held") * 2 >= F.col("total")).groupBy("file").agg(F.min("rank").alias("bus_factor"))


def recent_authors(commits: DataFrame, touched: DataFrame, now: int, days: int = 90) -> DataFrame:
    recent = commits.where(F.col("ts") >= now - days * DAY).select("hash", "author").where("author IS NOT NULL")
    return touched.select("hash", "file").join(recent, "hash").groupBy("file").agg(F.countDistinct("author").alias("recent_authors"))


def entropy_of(value: Column) -> tuple[Column, Column]:
    """Aggregates from which `spread` tells how evenly a group's values lie."""
    return F.sum(value), F.sum(F.when(value > 0, value * F.log2(value)).otherwise(0.0))


def spread(total: Column, weighted: Column, n: Column) -> Column:
    """Shannon entropy over its greatest value; 0 for fewer than two values or a total of 0. Values of 0 count in n."""
    h = F.log2(total) - weighted / total
    return F.when((n < 2) | (total <= 0), 0.0).otherwise(F.greatest(h / F.log2(n), F.lit(0.0)))


def change_risk(commits: DataFrame, touched: DataFrame, scratch: Scratch) -> DataFrame:
    """Shape and risk, from 0 to 10, of each commit: size, subsystems, spread and its author's earlier commits.

    An author's earlier commits are those of the same mail in the repo that come later in the log. A NULL mail has
    none. One author may hold any share of the commits: they are counted by a range-partitioned sort.
    """
    added, deleted = F.coalesce("added", F.lit(0)), F.coalesce("deleted", F.lit(0))
    inner = F.regexp_replace("file", r"^[^/]*/", "")
    total, weighted = entropy_of(added + deleted)
    shape = touched.groupBy("hash").agg(
        F.count("*").alias("files"), total.alias("lines"), weighted.alias("_w"), F.countDistinct(F.substring_index(inner, "/", 1)).alias("subsystems")
    )
    mailed = commits.where("author_email IS NOT NULL").select("hash", "log_ord", F.concat_ws("\x1f", "repo", "author_email").alias("who"))
    counted = positions(scratch, mailed, "who", [F.col("log_ord").desc(), F.col("hash").asc()], "place")
    known = commits.select("hash").join(counted.select("hash", "place"), "hash", "left").select("hash", F.coalesce(F.col("place") - 1, F.lit(0)).alias("prior"))
    x = shape.join(known, "hash").withColumn("entropy", spread(F.col("lines"), F.col("_w"), F.col("files")))
    part = lambda c, full: F.least(F.col(c) / float(full), F.lit(1.0))
    score = 0.20 * part("files", 20) + 0.25 * part("lines", 500) + 0.20 * part("subsystems", 8) + 0.15 * F.col("entropy") + 0.20 * (1.0 - part("prior", 50))
    return x.select("hash", "files", "lines", "subsystems", F.round("entropy", 6).alias("entropy"), "prior", F.round(10.0 * score + 1e-9, 1).alias("risk"))


def punch_card(commits: DataFrame) -> DataFrame:
    """(day, hour, commits) for all 168 hours of a week, Sunday being 0, in UTC; negative times are left out."""
    at = F.timestamp_seconds("ts")
    seen = commits.where("ts >= 0").groupBy((F.dayofweek(at) - 1).alias("day"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))
    spine = commits.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    return spine.join(seen, ["day", "hour"], "left").select("day", "hour", F.coalesce("n", F.lit(0)).alias("commits"))


def weekly_trend(commits: DataFrame, now: int, weeks: int = 26) -> DataFrame:
    """(weeks_ago, commits) for each of the last weeks; times after `now` fall into the current one."""
    ago = F.floor(F.greatest(F.lit(now) - F.col("ts"), F.lit(0)) / WEEK).cast("int")
    seen = commits.where("ts >= 0").groupBy(ago.alias("weeks_ago")).agg(F.count("*").alias("n"))
    spine = commits.sparkSession.range(weeks).select(F.col("id").cast("int").alias("weeks_ago"))
    return spine.join(seen, "weeks_ago", "left").select("weeks_ago", F.coalesce("n", F.lit(0)).alias("commits"))
