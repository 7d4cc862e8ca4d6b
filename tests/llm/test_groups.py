import random

import numpy as np
import pytest

from codestrata.llm.components import components, symbol_links
from codestrata.llm.ideal_point import closeness
from codestrata.llm.together import PairTable


def brute(vertices, edges):
    up = {v: v for v in vertices if v is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a in up and b in up:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {v: find(v) for v in up}


def check(spark, vertices, edges):
    v = spark.createDataFrame([(x, 1) for x in vertices], "id string, n int")
    e = spark.createDataFrame([(a, b, 0, "x") for a, b in edges], "a string, b string, level int, id string")
    got = components(spark, v, e).collect()
    assert len(got) == len({x for x in vertices if x is not None})
    assert {r.id: r.group_id for r in got} == brute(vertices, edges)


def test_path_star_cycle_and_random(spark):
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    star = [("s", f"s{i}") for i in range(40)]
    cycle = [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    r = random.Random(1)
    loose = [(f"r{r.randrange(60)}", f"r{r.randrange(60)}") for _ in range(40)]
    edges = path + star + cycle + loose + [(b, a) for a, b in path[:5]] + [("q", "q"), ("q", None), ("outside", "q")]
    check(spark, sorted({x for e in path + star + cycle + loose for x in e}) + ["q", "q", None, "alone"], edges)


def test_empty(spark):
    check(spark, [], [])
    check(spark, ["a", "b"], [])


def test_threshold(spark):
    near = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.1), ("b", "c", 0.49), ("d", None, 0.9), ("e", "e", None)], "symbol string, other_symbol string, overlap_ratio double")
    got = {r.id: r.group_id for r in components(spark, *symbol_links(near)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


BASKET = "scope string, basket string, item string, n int"


def counts(table):
    return {(r.scope, r.a, r.b): (r.together, r.of_a, r.of_b, r.baskets) for r in table.scores().collect()}


def expected(baskets):
    out, n, item = {}, {}, {}
    for (scope, _), items in baskets.items():
        n[scope] = n.get(scope, 0) + 1
        for x in items:
            item[scope, x] = item.get((scope, x), 0) + 1
        if 2 <= len(items) <= 50:
            for x in items:
                for y in items:
                    if x < y:
                        out[scope, x, y] = out.get((scope, x, y), 0) + 1
    return {(s, a, b): (k, item[s, a], item[s, b], n[s]) for (s, a, b), k in out.items()}


def rows(spark, baskets):
    return spark.createDataFrame([(s, b, i, 0) for (s, b), items in baskets.items() for i in items], BASKET)


def files_of(table):
    return {(kind, k): runs for kind in ("pairs", "items", "scopes", "scores") for k, runs in table.files(kind).items()}


def test_batches_equal_a_recount(spark, tmp_path):
    r = random.Random(2)
    one = {(f"s{k % 3}", f"b{k}"): {f"i{r.randrange(12)}" for _ in range(r.randrange(1, 6))} for k in range(40)}
    one["s0", "huge"] = {f"i{k}" for k in range(51)}
    where = f"file://{tmp_path}/t"
    PairTable(spark, where, buckets=4).apply(None, rows(spark, one).unionByName(rows(spark, one)), batch=1)
    assert counts(PairTable(spark, where)) == expected(one)
    changed = {k: {f"i{r.randrange(12)}" for _ in range(3)} for k in list(one)[:15]}
    fresh = {("s9", "new"): {"x", "y"}}
    table = PairTable(spark, where)
    for _ in range(2):  # a batch delivered twice counts once
        table.apply(rows(spark, {k: one[k] for k in changed}), rows(spark, changed | fresh), batch=2)
    now = one | changed | fresh
    assert counts(PairTable(spark, where)) == expected(now)
    # One basket to and fro, so that runs gather and are merged.
    key = next(iter(one))
    for k in range(8):
        before, after = {key: now[key]}, {key: {f"i{k}", f"i{k + 1}", f"i{k + 2}"}}
        PairTable(spark, where).apply(rows(spark, before), rows(spark, after))
        now |= after
    table = PairTable(spark, where)
    assert counts(table) == expected(now)
    assert all(len(runs) <= 4 for runs in files_of(table).values())
    table.vacuum()
    assert counts(PairTable(spark, where)) == expected(now)


def test_buckets_without_a_touched_scope_keep_their_files(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    baskets = {(f"s{k}", f"b{n}"): {"x", "y", f"z{n}"} for k in range(20) for n in range(3)}
    first = PairTable(spark, where, buckets=16)
    first.apply(None, rows(spark, baskets))
    first.rescore()
    held = files_of(first)
    again = PairTable(spark, where)
    again.apply(None, rows(spark, {("s7", "more"): {"x", "y"}}))
    again.rescore()
    changed = {key for key in held if files_of(again).get(key) != held[key]}
    assert len({k for _, k in changed}) == 1 and {kind for kind, _ in changed} == {"pairs", "items", "scopes", "scores"}
    assert counts(PairTable(spark, where)) == expected(baskets | {("s7", "more"): {"x", "y"}})
    # A writer that opened an older version changes nothing.
    with pytest.raises(RuntimeError):
        first.apply(None, rows(spark, {("s1", "late"): {"x", "y"}}))
    assert counts(PairTable(spark, where)) == expected(baskets | {("s7", "more"): {"x", "y"}})


def test_pairs_without_rows_and_with_nulls(spark, tmp_path):
    table = PairTable(spark, f"file://{tmp_path}/t")
    table.apply(None, spark.createDataFrame([], BASKET))
    assert table.scores().count() == 0
    table.apply(None, spark.createDataFrame([(None, "b", "x", 0), ("s", None, "x", 0), ("s", "b", None, 0), ("s", "b", "x", 0), ("s", "b", "y", 0)], BASKET))
    assert counts(table) == {("s", "x", "y"): (1, 1, 1, 1)}


def test_closeness(spark):
    rows = [("r", f"f{i}", float(i), 10**i if i < 9 else 10**9, None, "x") for i in range(10)] + [("r", "f3", 3.0, 1000, None, "x"), ("one", "z", None, None, None, "x"), ("r", None, 1.0, 1, None, "x")]
    df = spark.createDataFrame(rows, "g string, item string, a double, b long, c double, closeness string")
    got = {(r.g, r.item): r.closeness for r in closeness(df, "g", "item", {"a": 1, "b": 1, "c": -1}).collect()}
    assert len(got) == 11 and got["one", "z"] == 0.5
    order = sorted(range(10), key=lambda i: got["r", f"f{i}"])
    assert order[:2] == [0, 1] and order[-1] in (8, 9)
    assert all(0 <= v <= 1 for v in got.values())
    assert closeness(df.limit(0), "g", "item", {"a": 1}).count() == 0


def test_no_score_decides(spark):
    # `b` has by far the larger range, and its order is the reverse of two others
    rows = [("r", f"{i:02}", float(i), float(10 ** (20 - i) if i < 10 else 1), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, item string, a double, b double, c double")
    got = sorted(closeness(df, "g", "item", {"a": 1, "b": 1, "c": 1}).collect(), key=lambda r: -r.closeness)
    assert {got[0].item, got[1].item} == {"18", "19"}  # equal once winsorised


def brute_closeness(groups, scores, weights=None):
    """Vector normalisation and weighted distances, by arrays; values are not winsorised."""
    norm = {g: {c: np.array(v[c]) / np.linalg.norm(v[c]) for c in scores} for g, v in groups.items()}
    size = {g: len(next(iter(v.values()))) for g, v in groups.items()}
    weights = weights or {c: 1 / np.mean([norm[g][c].std() * np.sqrt(size[g]) for g in groups]) for c in scores}
    out = {}
    for g, v in norm.items():
        best = {c: v[c].max() if d > 0 else v[c].min() for c, d in scores.items()}
        worst = {c: v[c].min() if d > 0 else v[c].max() for c, d in scores.items()}
        to = [np.sqrt(sum((weights[c] * (v[c] - p[c])) ** 2 for c in scores)) for p in (best, worst)]
        out[g] = to[1] / (to[0] + to[1])
    return out


def test_vector_normalisation_and_weights(spark):
    # With few items the winsorising quantiles are the extremes.
    groups = {"p": {"a": [1.0, 2.0, 4.0, 8.0, 9.0], "b": [7.0, 7.5, 6.5, 7.2, 7.1]}, "q": {"a": [100.0, 101.0, 99.0, 103.0], "b": [1.0, 9.0, 2.0, 5.0]}}
    df = spark.createDataFrame([(g, f"{k}", v["a"][k], v["b"][k]) for g, v in groups.items() for k in range(len(v["a"]))], "g string, item string, a double, b double")
    scores = {"a": 1, "b": -1}
    for weights in (None, {"a": 1.0, "b": 1.0}):
        want = brute_closeness(groups, scores, weights)
        got = {(r.g, r.item): r.closeness for r in closeness(df, "g", "item", scores, weights).collect()}
        assert len(got) == 9 and all(abs(got[g, f"{k}"] - x) < 1e-8 for g, v in want.items() for k, x in enumerate(v))
    # The weights do not undo the normalisation: a group's own spreads still count.
    spreads = {g: np.std(np.array(v["a"]) / np.linalg.norm(v["a"])) * np.sqrt(len(v["a"])) for g, v in groups.items()}
    assert spreads["p"] > 10 * spreads["q"]
