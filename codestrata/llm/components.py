"""One identifier per group of linked records: components by low-diameter decomposition.

Each level draws an exponential head start for every vertex, lets clusters grow from the earliest starts for a
few hops, contracts each cluster to its centre, and goes on with the edges between clusters. Composing the
levels' assignments from the last to the first gives each vertex its component. A vertex only ever joins a
centre it has a path to, so a cluster that is still growing when its level ends costs another level, never a
wrong group. The number of links falls by a constant factor per level in expectation; paths and stars alike
end after O(log n) levels.

All state is distributed: a level is joins on vertex ids and map-side combined minima, its results are written
to the shared folder. No vertex's links and no component are ever brought into one task. A hub's links are one
hot join key; AQE splits that side of the join, and everything arriving at a hub is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import Scratch, table

BETA = 0.4  # rate of the head starts: a link is cut with a probability of at most 1 - exp(-BETA) once clusters are full grown
HOPS = 4  # growth per level
MAX_LEVELS = 60


def _head_start(vertex, level):
    """Exp(BETA), drawn from a hash so that a recomputed task draws the same. `level` is a column, so that all levels run the same compiled code."""
    u = (F.pmod(F.xxhash64(vertex, level), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / BETA


def _cluster(edges: DataFrame) -> DataFrame:
    """(v, c): the cluster centre each vertex of `edges` (a, b, level) has joined after HOPS hops."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("d")), F.struct(F.col("b").alias("s"), F.col("a").alias("d")))).alias("e"), "level")
    ends = ends.select("e.*", "level", F.lit(1.0).alias("far"))
    starts = ends.groupBy("s").agg(F.first("level").alias("level"))
    steps = ends.select("s", "d", "far").unionByName(starts.select("s", F.col("s").alias("d"), F.lit(0.0).alias("far")))
    state = starts.select(F.col("s").alias("v"), F.struct((-_head_start(F.col("s"), F.col("level"))).alias("at"), F.col("s").alias("c")).alias("best"))
    for _ in range(HOPS):
        reached = steps.join(state, F.col("s") == F.col("v")).select("d", F.struct((F.col("best.at") + F.col("far")).alias("at"), F.col("best.c").alias("c")).alias("best"))
        state = reached.groupBy(F.col("d").alias("v")).agg(F.min("best").alias("best"))
    return state.select("v", F.col("best.c").alias("c"))


def _contract(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    to_a = clusters.select(F.col("v").alias("a"), F.col("c").alias("ca"))
    to_b = clusters.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    moved = edges.join(to_a, "a").join(to_b, "b").where("ca <> cb")
    return moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), (F.col("level") + 1).alias("level")).distinct()


def components(spark: SparkSession, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, group_id): for each distinct non-NULL vertex, the smallest id of its component.

    vertices: column id. edges: columns a, b, in any direction, repeated or not; ends that are no vertex are
    left out, as are NULL ends and self links. A vertex without links is its own group. Without vertices or
    edges the result is empty or every vertex alone. Other columns of either input are ignored. Ids are
    compared by code point.
    """
    scratch = Scratch(spark, "components")
    ids = vertices.select("id").where("id IS NOT NULL").distinct()
    ids = scratch.write(ids.withColumn("n", F.monotonically_increasing_id()), "ids")
    left, right = ids.select(F.col("id").alias("a"), F.col("n").alias("na")), ids.select(F.col("id").alias("b"), F.col("n").alias("nb"))
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), F.lit(0).alias("level"))
    links = scratch.write(links, "links")
    levels: list[DataFrame] = []
    while not links.isEmpty():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"links are left after {MAX_LEVELS} levels")
        clusters = scratch.write(_cluster(links), "clusters")
        levels.append(clusters)
        inner, links = links, scratch.write(_contract(links, clusters), "links")
        scratch.drop(inner)
    if not levels:
        return ids.select("id", F.col("id").alias("group_id"))
    whole = levels[-1]
    for k in range(len(levels) - 2, -1, -1):
        up = whole.select(F.col("v").alias("c"), F.col("c").alias("top"))
        whole = levels[k].join(up, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    whole = scratch.write(whole, "whole")
    for one in levels:
        scratch.drop(one)
    named = ids.join(whole, ids.n == whole.v, "left").select("id", "n", "c")
    least = named.where("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("group_id"))
    return named.join(least, "c", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


THRESHOLD = 0.5


def symbol_links(near: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Vertices and links of a table of symbol pairs."""
    vertices = near.select(F.col("symbol").alias("id")).unionByName(near.select(F.col("other_symbol").alias("id")))
    links = near.where(F.col("overlap_ratio") >= threshold).select(F.col("symbol").alias("a"), F.col("other_symbol").alias("b"))
    return vertices, links


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = table(spark, sf_dir, "near_duplicates").select("symbol", "other_symbol", "overlap_ratio")
    return components(spark, *symbol_links(near)).select(F.col("id").alias("symbol"), "group_id")


def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p1_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


# Min-label flooding, one hop per step.
FLOOD = """
WITH RECURSIVE e AS (
  SELECT symbol AS a, other_symbol AS b FROM near_duplicates WHERE overlap_ratio >= 0.5 AND symbol <> other_symbol
  UNION SELECT other_symbol, symbol FROM near_duplicates WHERE overlap_ratio >= 0.5 AND symbol <> other_symbol),
v AS (SELECT symbol AS id FROM near_duplicates WHERE symbol IS NOT NULL UNION SELECT other_symbol FROM near_duplicates WHERE other_symbol IS NOT NULL),
r AS (SELECT id AS symbol, id AS seen FROM v UNION SELECT r.symbol, e.b FROM r JOIN e ON r.seen = e.a),
g AS (SELECT symbol, min(seen) AS group_id FROM r GROUP BY symbol)
"""

QUERIES = {"p1_found": p1_found, "p1_group_sizes": p1_group_sizes}
SQL = {
    "p1_found": FLOOD + "SELECT symbol, group_id FROM g",
    "p1_group_sizes": FLOOD + "SELECT size, count(*) AS groups FROM (SELECT group_id, count(*) AS size FROM g GROUP BY group_id) GROUP BY size",
}
