"""The dependency graph: edges from imports and calls, reachability, cycles, cohesion and communities."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import Scratch

FAN_OUT = 6


def call_edges(calls: DataFrame, symbols: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(src, dst, sites): the symbols that a symbol's calls may reach, and how many calls do.

    A call reaches the functions and methods of its own file that bear the callee's name; if there is none, the
    first `fan_out` of that name elsewhere, in the order of files and symbols. Calls from unknown symbols and calls to oneself are dropped.
    calls: file, caller, callee_name; symbols: id, file, name, kind, file_ord, sym_ord. Ambiguous names are cut to
    fan_out candidates before the join, so that a name with many bearers cannot multiply a hot callee's calls.
    """
    target = symbols.where(F.col("kind").isin("Function", "Method")).select("id", "file", "name", "file_ord", "sym_ord")
    known = calls.join(symbols.select(F.col("id").alias("caller")), "caller", "left_semi").select("caller", "file", "callee_name")
    sites = known.groupBy("caller", "file", "callee_name").agg(F.count("*").alias("n"))
    own = target.select(F.col("file"), F.col("name").alias("callee_name"), F.col("id").alias("dst"))
    same = sites.join(own, ["file", "callee_name"])
    rest = sites.join(own, ["file", "callee_name"], "left_anti")
    # A file order is a file's place in its repo; repos follow each other by name.
    rank = F.row_number().over(Window.partitionBy("name").orderBy("file_ord", "file", "sym_ord", "id"))
    first = target.withColumn("rank", rank).where(F.col("rank") <= fan_out).select(F.col("name").alias("callee_name"), F.col("id").alias("dst"))
    other = rest.join(first, "callee_name")
    both = same.select("caller", "dst", "n").unionByName(other.select("caller", "dst", "n")).where("caller <> dst")
    return both.groupBy(F.col("caller").alias("src"), "dst").agg(F.sum("n").alias("sites"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n): how many calls (src, dst, sites) arrive at each node."""
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("sites").alias("n"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def dead_code(symbols: DataFrame, calls_to: DataFrame, files: DataFrame, unresolved_stems: DataFrame) -> DataFrame:
    """(id, confidence) of functions and methods that no call reaches; those of shell files are exempt.

    Confidence is high, less by one step for another symbol of the name and for an unresolved import that ends in the file's stem.
    """
    code = symbols.where(F.col("kind").isin("Function", "Method")).join(files.where("language <> 'Shell'").select("file"), "file", "left_semi")
    uncalled = code.join(calls_to.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    twins = symbols.groupBy("name").agg(F.count("*").alias("bearers"))
    stem = F.lower(F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))
    x = uncalled.join(twins, "name").withColumn("stem", stem).join(unresolved_stems.select(F.col("stem").alias("stem"), F.lit(1).alias("clash")).distinct(), "stem", "left")
    doubts = (F.col("bearers") > 1).cast("int") + F.coalesce("clash", F.lit(0))
    return x.select("id", F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), doubts + 1).alias("confidence"))


HOPS = 12  # hops of a value between two writes
LOCAL_EDGES = 500_000  # a graph of no more edges is finished in one task


def strongly_connected(scratch: Scratch, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component): for each node on a cycle, the smallest id of its strongly connected component.

    A round finds the smallest id that reaches each node and the smallest one that it reaches. Where both are the
    same, the node is of that id's component. No component crosses an edge whose ends differ in either, so that
    such edges go, as do those of nodes without a way in or out, before the next round; every round ends at least one
    component, and rounds go on until no edge is left. Each step is joins and map-side combined minima on written tables.
    Once `local_edges` edges or fewer are left, one task finishes them, with the same result.
    """
    edges = scratch.write(edges.select("src", "dst").distinct(), "edges")
    done: list[DataFrame] = []
    while (left := edges.count()) > local_edges:
        edges = _trim(scratch, edges)
        if edges.isEmpty():
            break
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("value"))
        down = _flow(scratch, edges, nodes, "src", "dst").withColumnRenamed("value", "f")
        up = _flow(scratch, edges, nodes, "dst", "src").withColumnRenamed("value", "b")
        both = scratch.write(down.join(up, "id"), "both")
        done.append(both.where("f = b").select("id", F.col("f").alias("component")))
        open_ = both.where("f <> b")
        one, two = open_.select(F.col("id").alias("src"), "f", "b"), open_.select(F.col("id").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        edges = scratch.write(edges.join(one, "src").join(two, "dst").where("f = f2 AND b = b2").select("src", "dst"), "edges")
    if left and left <= local_edges:
        done.append(edges.repartition(1).mapInPandas(_in_one_task(_components), "id string, component string"))
    if not done:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"))
    if len(done) > 1:
        done = [_union(done)]
    big = done[0].groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return done[0].join(big, "component", "left_semi").select("id", "component")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _in_one_task(solve):
    """A function for mapInPandas that gives `solve` all rows (src, dst) of its one partition, as lists."""

    def run(batches):
        src: list[str] = []
        dst: list[str] = []
        for pdf in batches:
            src += pdf["src"].tolist()
            dst += pdf["dst"].tolist()
        yield solve(src, dst)

    return run


def _components(src: list[str], dst: list[str]) -> pd.DataFrame:
    """(id, component) of the strongly connected components of two nodes or more, found by one depth-first pass."""
    after: dict[str, list[str]] = {}
    for a, b in zip(src, dst, strict=True):
        after.setdefault(a, []).append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    rows = []
    for root in after:
        if root in number:
            continue
        path = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        on.add(root)
        while path:
            node, rest = path[-1]
            for x in rest:
                if x not in number:
                    number[x] = low[x] = len(number)
                    held.append(x)
                    on.add(x)
                    path.append((x, iter(after.get(x, ()))))
                    break
                if x in on:
                    low[node] = min(low[node], number[x])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        members.append(held.pop())
                        on.discard(members[-1])
                        if members[-1] == node:
                            break
                    if len(members) > 1:
                        first = min(members)
                        rows += [(m, first) for m in members]
    return pd.DataFrame(rows, columns=["id", "component"], dtype=object)


def _trim(scratch: Scratch, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges without those of nodes that have no way in or no way out, as far as some rounds get."""
    n = edges.count()
    for _ in range(rounds):
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = scratch.write(kept.select("src", "dst"), "trim")
        now = kept.count()
        scratch.drop(edges)
        edges = kept
        if now == n:
            break
        n = now
    return edges


def _flow(scratch: Scratch, edges: DataFrame, values: DataFrame, start: str, end: str) -> DataFrame:
    """(id, value): each node's smallest value among those that reach it, by HOPS hops between two writes, to a fixpoint."""
    nodes = values.select("id")
    steps = edges.select(F.col(start).alias("s"), F.col(end).alias("e")).unionByName(nodes.select(F.col("id").alias("s"), F.col("id").alias("e")))
    steps = scratch.write(steps, "steps")
    held = scratch.write(values, "values")
    while True:
        now = held
        for _ in range(HOPS):
            now = steps.join(now, F.col("s") == F.col("id")).groupBy(F.col("e").alias("id")).agg(F.min("value").alias("value"))
        new = scratch.write(now, "values")
        moved = new.join(held.withColumnRenamed("value", "old"), "id").where("value < old")
        still = moved.isEmpty()
        scratch.drop(held)
        held = new
        if still:
            scratch.drop(steps)
            return held


MERGE = 40  # hops between two writes of all nodes seen so far


def reachable(scratch: Scratch, edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, hops): nodes that the start nodes (id) reach, with the fewest hops; the start has 0. depth: the most hops, if there shall be any such limit."""
    front = scratch.write(start.select("id").distinct().withColumn("hops", F.lit(0)), "seen")
    parts = [front]
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        seen = _union(parts)
        step = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        front = scratch.write(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "front")
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) > MERGE:
            parts = [scratch.write(_union(parts), "seen")]
    return _union(parts)


def closure(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(src, dst): who reaches whom, each node itself too, doubling path lengths; meant for graphs of repos or modules."""
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    reach = scratch.write(edges.select("src", "dst").unionByName(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"))).distinct(), "reach")
    n = reach.count()
    while True:
        two = reach.select("src", F.col("dst").alias("m")).join(reach.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").distinct()
        reach = scratch.write(two, "reach")
        now = reach.count()
        if now == n:
            return reach
        n = now


def cohesion(scratch: Scratch, accesses: DataFrame, methods: DataFrame, local_rows: int = LOCAL_EDGES) -> DataFrame:
    """(parent, methods, components): classes whose methods fall into two or more groups that share no field.

    accesses: method, field_name; methods: id, parent. The smallest method id flows through shared fields to a
    fixpoint, for all classes at once; `local_rows` accesses or fewer are grouped in one task, with the same result.
    Methods without field accesses are not tracked.
    """
    used = scratch.write(accesses.join(methods.where("parent IS NOT NULL").select(F.col("id").alias("method"), "parent"), "method").select("parent", "method", "field_name").distinct(), "used")
    if used.count() <= local_rows:
        labels = used.repartition(1).mapInPandas(_grouped, "parent string, method string, label string")
    else:
        labels = _label_flow(scratch, used)
    return labels.groupBy("parent").agg(F.count("*").alias("methods"), F.countDistinct("label").alias("components")).where("methods >= 2 AND components >= 2")


def _label_flow(scratch: Scratch, used: DataFrame) -> DataFrame:
    labels = scratch.write(used.select("parent", "method").distinct().withColumn("label", F.col("method")), "labels")
    while True:
        field = used.join(labels, ["parent", "method"]).groupBy("parent", "field_name").agg(F.min("label").alias("f"))
        new = used.join(field, ["parent", "field_name"]).groupBy("parent", "method").agg(F.min("f").alias("label"))
        new = scratch.write(new, "labels")
        moving = not new.join(labels.withColumnRenamed("label", "old"), ["parent", "method"]).where("label < old").isEmpty()
        scratch.drop(labels)
        labels = new
        if not moving:
            return labels


def _grouped(batches):
    """(parent, method, label) of the accesses of one partition: the smallest method that shared fields lead to."""
    up: dict[tuple[str, str], tuple[str, str]] = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first: dict[tuple[str, str], tuple[str, str]] = {}
    for pdf in batches:
        for parent, method, name in pdf[["parent", "method", "field_name"]].itertuples(index=False):
            x = (parent, method)
            up.setdefault(x, x)
            a, b = root(x), root(first.setdefault((parent, name), x))
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame([(*x, root(x)[1]) for x in up], columns=["parent", "method", "label"], dtype=object)


LOCAL_PAIRS = 2_000_000  # communities of no more linked pairs are finished in one task, in arrays of numbers


def communities(scratch: Scratch, edges: DataFrame, levels: int = 50, rounds: int = 200, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """(id, community): modularity communities of an undirected view of `edges` (src, dst), named by their smallest node.

    In a round every node weighs the communities of its neighbours by what joining them would gain; of those that
    would gain a half drawn by hash moves, another one each round, so that neighbours do not trade places for ever. Once no node would gain
    communities become nodes, until none of them joins another. `levels` and `rounds` only guard against endless trading; reaching
    either is warned of. Ties go to the smaller community. Gains are whole numbers. All steps are joins and partial sums; once
    `local_pairs` linked pairs or fewer are left, one task goes through the same rounds, with the same result.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("w"))
    pairs = scratch.write(pairs, "pairs")
    if pairs.count() <= local_pairs:
        return scratch.write(_finished(pairs, levels, rounds).toDF("id", "community"), "member")
    ways = F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    links = scratch.write(pairs.select(F.explode(ways).alias("l")).select("l.*"), "links")
    member = scratch.write(links.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")), "member")
    for level in range(levels):
        half = links.where("a <= b")
        if half.count() <= local_pairs:
            to = _finished(half, levels - level, rounds)
            return scratch.write(member.join(to, F.col("community") == F.col("n")).select("id", F.col("to").alias("community")), "member")
        home = links.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("degree")).withColumn("c", F.col("n"))
        home = scratch.write(home, "home")
        total = home.agg(F.sum("degree")).first()[0]
        for turn in range(rounds):
            whole = home.groupBy("c").agg(F.sum("degree").alias("all"))
            near = links.where("a <> b").join(home.select(F.col("n").alias("b"), "c"), "b").groupBy(F.col("a").alias("n"), "c").agg(F.sum("w").alias("into"))
            own = home.select("n", "c").withColumn("into", F.lit(0).cast("long"))
            near = near.unionByName(own).groupBy("n", "c").agg(F.sum("into").alias("into"))
            mine = home.select("n", "degree", F.col("c").alias("own"))
            rest = F.col("all") - F.when(F.col("c") == F.col("own"), F.col("degree")).otherwise(0)
            gain = F.col("into") * F.lit(total).cast("long") - rest * F.col("degree")
            best = near.join(mine, "n").join(whole, "c").select("n", "degree", "own", "c", gain.alias("gain")).groupBy("n", "degree", "own")
            best = best.agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("c").alias("c"))).alias("m"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
            gains = -F.col("m.g") > F.col("stay")
            moves = (F.pmod(F.xxhash64("n", F.lit(turn)), F.lit(2)) == 0) & gains
            new = scratch.write(best.select("n", "degree", F.when(moves, F.col("m.c")).otherwise(F.col("own")).alias("c"), gains.alias("gains")), "home")
            scratch.drop(home)
            home = new
            if home.where("gains").isEmpty():
                break
        else:
            warnings.warn(f"communities still gained after {rounds} rounds", stacklevel=2)
        named = home.groupBy("c").agg(F.min("n").alias("name"))
        to = scratch.write(home.join(named, "c").select("n", F.col("name").alias("to")), "to")
        if to.where("n <> to").isEmpty():
            break
        member = scratch.write(member.join(to, F.col("community") == F.col("n")).select("id", F.col("to").alias("community")), "member")
        ends = links.join(to.select(F.col("n").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("n").alias("b"), F.col("to").alias("y")), "b")
        links = scratch.write(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "links")
    else:
        warnings.warn(f"communities still joined after {levels} levels", stacklevel=2)
    return member


def _finished(half: DataFrame, levels: int, rounds: int) -> DataFrame:
    """(n, to): the last community of each node of the links (a, b, w) with a <= b, found by one task."""
    numbered = half.select("a", "b", "w", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"))
    return numbered.repartition(1).mapInArrow(_all_rounds(levels, rounds), "n string, to string")


def _all_rounds(levels: int, rounds: int):
    """A function for mapInArrow that takes all links (a, b, w, ha, hb) with a <= b of its one partition and gives each node's last community."""

    def run(batches):
        t = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], schema=_LINKS)])
        names = pc.unique(pa.chunked_array(t["a"].chunks + t["b"].chunks, type=pa.string()))
        if not len(names):
            return
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(t[x], value_set=names).to_numpy().astype(np.int64) for x in "ab")
        coin = np.zeros(len(names), dtype=np.uint64)
        for at, x in ((a, "ha"), (b, "hb")):
            coin[at] = t[x].to_numpy().view(np.uint64)
        w = t["w"].to_numpy()
        two = a != b
        to = _settled(np.r_[a, b[two]], np.r_[b, a[two]], np.r_[w, w[two]], coin, levels, rounds)
        for k in range(0, len(names), 10_000):
            yield pa.RecordBatch.from_arrays([names[k : k + 10_000], names.take(pa.array(to[k : k + 10_000]))], names=["n", "to"])

    return run


_LINKS = pa.schema([("a", pa.string()), ("b", pa.string()), ("w", pa.int64()), ("ha", pa.int64()), ("hb", pa.int64())])


def _drawn(coin: np.ndarray, turn: int) -> np.ndarray:
    """Whether xxhash64(n, turn) is even, for nodes of which xxhash64(n) is given."""
    u = np.uint64
    h = (coin + u(0x27D4EB2F165667C5) + u(4)) ^ (np.array([turn], dtype=u) * u(0x9E3779B185EBCA87))
    h = ((h << u(23)) | (h >> u(41))) * u(0xC2B2AE3D27D4EB4F) + u(0x165667B19E3779F9)
    h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
    return (h ^ (h >> u(32))) & u(1) == 0


def _settled(a: np.ndarray, b: np.ndarray, w: np.ndarray, coin: np.ndarray, levels: int, rounds: int) -> np.ndarray:
    """The last community of each node, by number; nodes are numbered in the order of their names, links go both ways, every node has one."""
    member = name = np.arange(len(coin))
    a, b, w = _added(a, b, w, len(coin))
    for _ in range(levels):
        n = len(coin)
        c = _parted(a, b, w, coin, rounds)
        first = np.full(n, n)
        np.minimum.at(first, c, np.arange(n))
        kept, to = np.unique(first[c], return_inverse=True)
        if len(kept) == n:
            break
        member, name, coin = to[member], name[kept], coin[kept]
        a, b, w = _added(to[a], to[b], w, len(kept))
    else:
        warnings.warn(f"communities still joined after {levels} levels", stacklevel=2)
    return name[member]


def _parted(a: np.ndarray, b: np.ndarray, w: np.ndarray, coin: np.ndarray, rounds: int) -> np.ndarray:
    """The community of each node once no node would gain. After a round only nodes are weighed anew for which a neighbour moved or
    the degree of a community they touch changed; for the others the choice of an earlier round still holds."""
    n = len(coin)
    degree = _sums(a, w, n)
    total = int(degree.sum())
    x, y, v = (z[a != b] for z in (a, b, w))
    begin = np.searchsorted(x, np.arange(n + 1))
    c, whole = np.arange(n), degree.copy()
    goal, gains = np.arange(n), np.zeros(n, dtype=bool)
    at = np.arange(n)
    for turn in range(rounds):
        if len(at):  # none if no node was drawn
            own, link = _links_of(at, begin)
            key = np.r_[own * n + c[y[link]], np.arange(len(at)) * n + c[at]]
            order = np.argsort(key)
            first, key = _firsts(key[order])
            into = np.add.reduceat(np.r_[v[link], np.zeros(len(at), dtype=np.int64)][order], first)
            own, to = np.divmod(key, n)
            node = at[own]
            stays = to == c[node]
            gain = into * total - (whole[to] - np.where(stays, degree[node], 0)) * degree[node]
            most = np.maximum.reduceat(gain, _firsts(own)[0])
            best = np.flatnonzero(gain == most[own])
            best = best[_firsts(own[best])[0]]  # the first is the smallest community
            goal[at], gains[at] = to[best], most > gain[stays]
        would = np.flatnonzero(gains)
        if not len(would):
            break
        moves = would[_drawn(coin[would], turn)]
        before = whole.copy()
        np.subtract.at(whole, c[moves], degree[moves])
        c[moves] = goal[moves]
        np.add.at(whole, c[moves], degree[moves])
        touched = (whole != before)[c]
        touched[moves] = True
        touched[y[_links_of(np.flatnonzero(touched), begin)[1]]] = True
        at = np.flatnonzero(touched)
    else:
        warnings.warn(f"communities still gained after {rounds} rounds", stacklevel=2)
    return c


def _links_of(at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each link of the nodes `at`, the node's place in `at` and the link's number; the links of node i are those from begin[i] to begin[i + 1]."""
    many = begin[at + 1] - begin[at]
    place = np.repeat(np.arange(len(at)), many)
    return place, np.arange(len(place)) + (begin[at] - np.cumsum(many) + many)[place]


def _added(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links in order, one for each two nodes, with their weights added up."""
    key = a * n + b
    order = np.argsort(key)
    first, key = _firsts(key[order])
    return *np.divmod(key, n), np.add.reduceat(w[order], first)


def _firsts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each new key begins among ordered ones, and that key."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, key[first]


def _sums(at: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, at, w)
    return out


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: modularity of the communities over the undirected view of `edges`."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    m = lambda end: member.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}"))
    both = pairs.join(m("a"), "a").join(m("b"), "b")
    per = both.select(F.explode(F.array("c_a", "c_b")).alias("c")).groupBy("c").agg(F.count("*").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return both.agg(F.count("*").alias("m"), F.count_if(F.col("c_a") == F.col("c_b")).alias("inside")).join(per).select((F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
