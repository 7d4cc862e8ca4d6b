"""Reading tours: roles of files, their rank, a selection with entry points, and an order that follows dependencies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.graph import LOCAL_EDGES, _in_one_task, strongly_connected
from codestrata.session import Scratch


def role(dependents: Column, dependencies: Column) -> Column:
    return F.when((dependents == 0) & (dependencies == 0), "isolated").when(dependents == 0, "entry-point").when(dependencies == 0, "foundation").otherwise("connector")


def rank_terms() -> list[tuple[Column, bool]]:
    """What files are ranked by, and whether less comes first: isolated files last; then most dependents, hottest, least healthy (unmeasured ones after measured), most symbols, and path."""
    return [(F.col("role") == "isolated", True), (F.col("dependents"), False), (F.coalesce("hotspot", F.lit(0)), False), (F.col("health"), True), (F.col("symbols"), False), (F.col("file"), True)]


def rank_order() -> list[Column]:
    return [c.asc_nulls_last() if up else c.desc() for c, up in rank_terms()]


def _reverse(term: tuple[Column, bool]) -> Column:
    return term[0].desc_nulls_first() if term[1] else term[0].asc()


def select(steps: DataFrame, group: str, n: int) -> DataFrame:
    """The n best-ranked files of each group, of which a fifth at least (one at least) are entry points, where there are as many.

    The best entry points beyond the n take the places of the worst others. Only the n best files and the best few
    entry points of a group are ever brought together; Spark cuts both rankings in each task before the shuffle.
    """
    quota = max(1, n // 5)
    entry = F.col("role") == "entry-point"
    w = Window.partitionBy(group).orderBy(*rank_order())
    top = steps.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).withColumn("top", F.lit(True))
    more = steps.where(entry).withColumn("r", F.row_number().over(w)).where(F.col("r") <= quota).withColumn("top", F.lit(False))
    x = top.unionByName(more).drop("r").groupBy(*steps.columns).agg(F.max("top").alias("top"))
    # n + quota rows a group from here on
    x = x.withColumn("have", F.count_if(entry & F.col("top")).over(Window.partitionBy(group))).withColumn("there", F.count_if(entry).over(Window.partitionBy(group)))
    lack = F.greatest(F.least(F.lit(quota), F.col("there")) - F.col("have"), F.lit(0))
    ahead = F.row_number().over(Window.partitionBy(group, "role").orderBy(*rank_order()))
    other = F.col("top") & ~entry
    back = F.when(other, F.row_number().over(Window.partitionBy(group, other).orderBy(*[_reverse(c) for c in rank_terms()])))
    x = x.withColumn("lack", lack).withColumn("ahead", ahead).withColumn("back", back)
    chosen = (F.col("top") & (entry | (F.col("back") > F.col("lack")))) | (entry & ~F.col("top") & (F.col("ahead") <= F.col("have") + F.col("lack")))
    return x.where(chosen).withColumn("step", F.row_number().over(w)).select(*steps.columns, "step")


MERGE = 40  # layers between two writes of those found so far


def condensed_layers(scratch: Scratch, nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, layer): 0 for nodes that depend on nothing, then one more than the highest layer depended on; edges (src depends on dst).

    A strongly connected component counts as one node, so that its members share a layer and whatever lies above a
    cycle keeps its place. The condensed graph is peeled until nothing is left, however deep it is; once `local_edges`
    edges or fewer are left, one task finishes them, with the same result. Ends that are not in `nodes` are ignored.
    """
    known = nodes.select("id").distinct()
    inner = edges.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    inner = scratch.write(inner.where("src <> dst").select("src", "dst").distinct(), "inner")
    group = known.join(strongly_connected(scratch, inner, local_edges), "id", "left").select("id", F.coalesce("component", "id").alias("group"))
    group = scratch.write(group, "group")
    end = lambda e: group.select(F.col("id").alias(e), F.col("group").alias(f"{e}_group"))
    rest = inner.join(end("src"), "src").join(end("dst"), "dst").where("src_group <> dst_group").select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst")).distinct()
    rest = scratch.write(rest, "rest")
    left = scratch.write(group.select(F.col("group").alias("id")).distinct(), "left")
    found: list[DataFrame] = []
    layer = 0
    while not left.isEmpty():
        if rest.count() <= local_edges:
            above = rest.repartition(1).mapInPandas(_in_one_task(_depths), "id string, depth int")
            found.append(left.join(above, "id", "left").select("id", (F.coalesce("depth", F.lit(0)) + layer).alias("layer")))
            break
        free = scratch.write(left.join(rest.select(F.col("src").alias("id")), "id", "left_anti").withColumn("layer", F.lit(layer)), "free")
        if free.isEmpty():
            raise RuntimeError("a cycle is left in the condensed graph")
        found.append(free)
        if len(found) > MERGE:
            found = [_merged(scratch, found)]
        more = scratch.write(left.join(free, "id", "left_anti"), "left")
        lower = scratch.write(rest.join(free.select(F.col("id").alias("dst")), "dst", "left_anti"), "rest")
        scratch.drop(left)
        scratch.drop(rest)
        left, rest = more, lower
        layer += 1
    if not found:
        return group.select("id", F.lit(0).alias("layer"))
    return group.join(_merged(scratch, found).withColumnRenamed("id", "group"), "group").select("id", "layer")


def _depths(src: list[str], dst: list[str]) -> pd.DataFrame:
    """(id, depth) of the nodes that depend on another: the most edges from each to a node that depends on none."""
    waits: dict[str, int] = {}
    users: dict[str, list[str]] = {}
    for a, b in zip(src, dst, strict=True):
        waits[a] = waits.get(a, 0) + 1
        users.setdefault(b, []).append(a)
    depth: dict[str, int] = {}
    ready = [x for x in users if x not in waits]
    while ready:
        x = ready.pop()
        for u in users.get(x, ()):
            depth[u] = max(depth.get(u, 0), depth.get(x, 0) + 1)
            waits[u] -= 1
            if not waits[u]:
                ready.append(u)
    if any(waits.values()):
        raise RuntimeError("a cycle is left in the condensed graph")
    return pd.DataFrame({"id": pd.Series(list(depth), dtype=object), "depth": pd.Series(list(depth.values()), dtype="int32")})


def _merged(scratch: Scratch, parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return scratch.write(out, "layers")
