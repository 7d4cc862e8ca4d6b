"""One ranking from several differently-scaled scores: relative closeness to an ideal point.

Per group, each score is winsorised at two quantiles and divided by the length of its vector of values, which takes
its unit and range away. The distances are weighted: a score's weight is the same in all groups, by default the
reciprocal of the deviation that its normalised values have in a group on average, so that a score whose values
always lie close together has a say as well. The ideal point has every score's best value, the anti-ideal every
worst; items are ordered by how much nearer they are to the one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.ranking import positions
from codestrata.session import Scratch, table

LOWER, UPPER = 0.05, 0.95
ACCURACY = 10000  # of the quantile sketch: exact for groups of fewer items, else within 1/ACCURACY of the rank
DIGITS = 9

# A file is read early if much depends on it, it changes often, it is in bad health, and it is large.
TOUR_SCORES = {"health": -1, "hotspot": 1, "dependents": 1, "lines": 1}


def closeness(items: DataFrame, group: str, item: str, scores: dict[str, int], weights: dict[str, float] | None = None) -> DataFrame:
    """(group, item, closeness from 0 to 1): one row per distinct group and item.

    scores: column and direction, 1 if more is better and -1 if less is; weights: of all scores, in place of the default. Rows of an item are merged into its best
    value of each score. NULL and NaN scores count as the group's median, so they pull neither way; a score that
    a whole group lacks, or that is the same for all of it, has no weight there. If no score has weight all items
    have closeness 0.5. A NULL group is a group; rows with a NULL item are left out. Other columns are ignored.
    All statistics are partial aggregates with quantile sketches; no group is gathered.
    """
    names = list(scores)
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names}
    x = items.where(F.col(item).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(item).alias("_i"))
    x = x.agg(*[(F.max if d > 0 else F.min)(value[c]).alias(c) for c, d in scores.items()])
    cuts = x.groupBy("_g").agg(*[F.percentile_approx(c, [LOWER, 0.5, UPPER], ACCURACY).alias(f"_q_{c}") for c in names])
    x = _join(x, cuts)
    x = x.select("_g", "_i", *[F.least(F.greatest(F.coalesce(c, F.col(f"_q_{c}")[1]), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[2]).alias(c) for c in names])
    stats = x.groupBy("_g").agg(
        F.count("*").alias("_n"), *[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"_len_{c}") for c in names], *[F.stddev_pop(c).alias(f"_dev_{c}") for c in names],
        *[F.max(c).alias(f"_max_{c}") for c in names], *[F.min(c).alias(f"_min_{c}") for c in names],
    )
    # A deviation that rounding leaves of equal values is none.
    varies = {c: (F.col(f"_len_{c}") > 0) & (F.col(f"_max_{c}") > F.col(f"_min_{c}")) & (F.col(f"_dev_{c}") > 0) for c in names}
    if weights is None:
        spread = [F.avg(F.when(varies[c], F.col(f"_dev_{c}") * F.sqrt("_n") / F.col(f"_len_{c}"))).alias(c) for c in names]
        weight = stats.agg(F.struct(*spread).alias("w")).scalar()  # one row, from a row per group
        x = _join(x, stats).withColumn("_w", weight)
        weigh = {c: 1 / F.col(f"_w.{c}") for c in names}
    else:
        x = _join(x, stats)
        weigh = {c: F.lit(float(weights[c])) for c in names}

    def away(c: str, best: bool):
        goal = F.col(f"_max_{c}") if (scores[c] > 0) == best else F.col(f"_min_{c}")
        length = F.col(f"_len_{c}")
        d = weigh[c] * (F.col(c) / length - goal / length)
        return F.when(varies[c], d * d).otherwise(0.0)

    far = lambda best: F.sqrt(sum((away(c, best) for c in names), F.lit(0.0)))
    x = x.select("_g", "_i", far(True).alias("_to_ideal"), far(False).alias("_to_anti"))
    both = F.col("_to_ideal") + F.col("_to_anti")
    return x.select(F.col("_g").alias(group), F.col("_i").alias(item), F.round(F.when(both > 0, F.col("_to_anti") / both).otherwise(0.5), DIGITS).alias("closeness"))


def _join(x: DataFrame, per_group: DataFrame) -> DataFrame:
    g = per_group.withColumnRenamed("_g", "_h")
    return x.join(g, x["_g"].eqNullSafe(g["_h"])).drop("_h")


def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading order of each repo's files; ties by file."""
    steps = table(spark, sf_dir, "tour_steps")
    ranked = closeness(steps, "repo", "file", TOUR_SCORES)
    return positions(Scratch(spark, "order"), ranked, "repo", [F.col("closeness").desc(), F.col("file").asc()])


_V = """
WITH x AS (SELECT repo, file, min(CASE WHEN NOT isnan(health) THEN health END) AS health, max(CAST(hotspot AS DOUBLE)) AS hotspot, max(CAST(dependents AS DOUBLE)) AS dependents,
  max(CAST(lines AS DOUBLE)) AS lines FROM tour_steps WHERE file IS NOT NULL GROUP BY repo, file),
l AS (SELECT repo, file, unnest(['health', 'hotspot', 'dependents', 'lines']) AS s, unnest([health, hotspot, dependents, lines]) AS v FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, s ORDER BY v) AS rn, count(*) OVER (PARTITION BY repo, s) AS n FROM l WHERE v IS NOT NULL),
q AS (SELECT repo, s, min(v) FILTER (rn >= 0.05 * n) AS lo, min(v) FILTER (rn >= 0.5 * n) AS mid, min(v) FILTER (rn >= 0.95 * n) AS hi FROM r GROUP BY repo, s),
w AS (SELECT l.repo, l.file, l.s, least(greatest(coalesce(v, mid), lo), hi) AS v FROM l JOIN q ON l.repo = q.repo AND l.s = q.s),
a AS (SELECT repo, s, stddev_pop(v) AS dev, sqrt(sum(v * v)) AS len, count(*) AS n, max(v) AS hi, min(v) AS lo FROM w GROUP BY repo, s),
g AS (SELECT s, 1 / avg(dev * sqrt(n) / len) AS weight FROM a WHERE len > 0 AND dev > 0 AND hi > lo GROUP BY s),
d AS (SELECT w.repo, w.file, CASE WHEN dev > 0 AND hi > lo AND len > 0 THEN pow(weight * (v / len - CASE WHEN w.s = 'health' THEN lo ELSE hi END / len), 2) ELSE 0 END AS i,
  CASE WHEN dev > 0 AND hi > lo AND len > 0 THEN pow(weight * (v / len - CASE WHEN w.s = 'health' THEN hi ELSE lo END / len), 2) ELSE 0 END AS t FROM w JOIN a ON w.repo = a.repo AND w.s = a.s LEFT JOIN g ON g.s = w.s),
c AS (SELECT repo, file, round(CASE WHEN sqrt(sum(i)) + sqrt(sum(t)) > 0 THEN sqrt(sum(t)) / (sqrt(sum(i)) + sqrt(sum(t))) ELSE 0.5 END, 9) AS closeness FROM d GROUP BY repo, file)
SELECT repo, file, closeness, row_number() OVER (PARTITION BY repo ORDER BY closeness DESC, file) AS position FROM c
"""

QUERIES = {"p7_order": p7_order}
SQL = {"p7_order": _V}
