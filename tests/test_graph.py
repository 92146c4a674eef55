"""Graph operators on small fixtures and against plain Python."""

import random

import pytest

from lodestone.operators import graph as G
from lodestone.operators.components import components


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


@pytest.mark.parametrize(
    ("pairs", "expected"),
    [
        ([(1, 2), (2, 3)], []),
        ([(1, 2), (2, 1)], [{1, 2}]),
        ([(1, 2), (2, 3), (3, 1), (3, 4)], [{1, 2, 3}]),
        ([(1, 2), (2, 1), (3, 4), (4, 3)], [{1, 2}, {3, 4}]),
        ([(1, 1)], []),
    ],
)
@pytest.mark.parametrize("local", [1000, 0])
def test_cycles(spark, pairs, expected, local):
    groups = {}
    for r in G.strong_components(edges(spark, pairs), local).collect():
        groups.setdefault(r.scc, set()).add(r.node_id)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected))


def closure(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    return reach


@pytest.mark.parametrize("local", [10**6, 0])
def test_components_of_random_graph(spark, local):
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    reach = closure(pairs)
    expected = {n: min(m for m in reach if m == n or m in reach[n] and n in reach[m]) for n in reach}
    sizes = {c: sum(v == c for v in expected.values()) for c in expected.values()}
    got = {r.node_id: r.scc for r in G.strong_components(edges(spark, pairs), local).collect()}
    assert got == {n: c for n, c in expected.items() if sizes[c] > 1}


def test_reach_impact_and_levels(spark):
    e = edges(spark, [(1, 2), (2, 3), (2, 3), (4, 4)])
    nodes = spark.createDataFrame([(i, f"n{i}") for i in (1, 2, 3, 4)], "node_id long, name string")
    assert {r.node_id: r.impact for r in G.impact(e, nodes).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    assert {r.node_id: r.level for r in G.levels(e, nodes).collect()} == {3: 0, 4: 0, 2: 1, 1: 2}
    assert [r.node_id for r in G.orphans(nodes, e).collect()] == []
    costs = nodes.selectExpr("node_id", "2.0D as cost")
    assert {r.node_id: r.duration for r in G.critical_path(e, costs).collect()} == {3: 2, 4: 2, 2: 4, 1: 6}


def test_signal_path_of_chain_and_island(spark):
    nodes = spark.createDataFrame([(1, "src/a.js"), (2, "src/b.js"), (3, "src/c.js"), (4, "src/d.js")], "node_id long, name string")
    e = edges(spark, [(1, 2), (2, 3)])
    assert [(r.node_id, r.side) for r in G.signal_path(nodes, e, 1).orderBy("position").collect()] == [(3, "upstream"), (2, "upstream"), (1, "focal")]
    assert [r.node_id for r in G.signal_path(nodes, e, 4).collect()] == [4]


def test_outcome_ladder(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(2 / 3, 0.0, 0, 0, False), (0.99, 0.0, 0, 0, False), (0.2, 0.0, 0, 0, False), (0.2, 0.0, 0, 0, True), (0.9, 0.0, 0, 3, False)], "r double, f double, c int, a int, x boolean")
    assert [r[0] for r in df.select(G.outcome(*(F.col(c) for c in "rfcax"))).collect()] == ["PARTIAL", "SUCCESS", "FAILURE", "REDIRECT", "AMBIGUOUS"]


def test_find_paths(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 1), (3, 4), (2, 4)])
    assert [r.path for r in G.find_paths(e, 1, 4).collect()] == [[1, 2, 4], [1, 3, 4], [1, 2, 3, 4]]


def kahn(names, pairs):
    """Dependencies first, the ready node of the smallest name next; the rest by edges among themselves, then by name."""
    pairs = {(a, b) for a, b in pairs if a != b}
    out, left = [], set(names)
    while ready := sorted((names[n], n) for n in left if not any(a == n and b in left for a, b in pairs)):
        out.append(ready[0][1])
        left.discard(ready[0][1])
    busy = {n: sum(a in left and b in left and n in (a, b) for a, b in pairs) for n in left}
    return out + sorted(left, key=lambda n: (busy[n], names[n], n))


@pytest.mark.parametrize("seed", [1, 3])
def test_named_order_merges_components(spark, seed):
    rng = random.Random(seed)
    names = {i: rng.choice("abcdefgh") + str(rng.randrange(30)) for i in range(60)}
    pairs = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(35)) if seed == 3 or a > b]
    scope = spark.createDataFrame(list(names.items()), "node_id long, name string")
    e = edges(spark, sorted({p for p in pairs if p[0] != p[1]}))
    assert [r.node_id for r in G.named_order(scope, e).orderBy("position").collect()] == kahn(names, pairs)


def longest(pairs, cost, weight):
    pairs = {p for p in pairs if p[0] != p[1]}
    value = {}

    def of(n, path=()):
        if n in path:
            return None
        if n not in value or value[n] is None:
            below = [of(d, (*path, n)) for s, d in pairs if s == n]
            value[n] = None if None in below else max([cost(n)] + [weight(n) + x for x in below])
        return value[n]

    for n in {x for p in pairs for x in p}:
        of(n)
    return value


@pytest.mark.parametrize(("shape", "local"), [("dag", 10**6), ("cyclic", 10**6), ("cyclic", 4), ("ladder", 0)])
def test_levels_and_critical_paths_by_elimination(spark, local, shape):
    rng = random.Random(9)
    if shape == "ladder":
        pairs = [(i + k, i + 2 + j) for i in range(0, 24, 2) for k in (0, 1) for j in (0, 1)]
    else:
        pairs = [(a, b) if shape == "cyclic" or a > b else (b, a) for a, b in ((rng.randrange(50), rng.randrange(50)) for _ in range(40 if shape == "cyclic" else 90))]
    nodes = {x for p in pairs for x in p} | {99}
    e, ids = edges(spark, pairs + pairs[:3]), spark.createDataFrame([(n, float(n % 7)) for n in sorted(nodes)], "node_id long, cost double")
    level = {**longest(pairs, lambda n: 0, lambda n: 1), 99: 0}
    top = max((x for x in level.values() if x is not None), default=-1) + 1
    assert {r.node_id: r.level for r in G.levels(e, ids, local).collect()} == {n: top if level[n] is None else level[n] for n in nodes}
    cost = {**longest(pairs, lambda n: n % 7, lambda n: n % 7), 99: 1}
    assert {r.node_id: r.duration for r in G.critical_path(e, ids, local).collect()} == {n: cost[n] for n in nodes}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from lodestone.operators import flow

    turns = []
    chosen = flow._chosen
    monkeypatch.setattr(flow, "_chosen", lambda e, turn: (turns.append(turn), chosen(e, turn))[1])
    names = list(range(5000))
    random.Random(2).shuffle(names)
    e = edges(spark, list(zip(names, names[1:])))
    got = {r.node_id: r.level for r in G.levels(e, spark.range(5000).toDF("node_id"), 20).collect()}
    assert got == {n: 4999 - i for i, n in enumerate(names)} and len(turns) < 25


@pytest.mark.parametrize("local", [10**6, 4])
def test_reached_without_depths(spark, local):
    rng = random.Random(8)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)]
    seeds = [0, 1, 77]
    for outbound in (True, False):
        expected = closure([p if outbound else p[::-1] for p in pairs])
        got = {r.node_id for r in G.reached(edges(spark, pairs), spark.createDataFrame([(s,) for s in seeds], "node_id long"), outbound, local).collect()}
        assert got == set(seeds).union(*(expected.get(s, set()) for s in seeds))


def test_impact_by_sketches(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(1000 + i, 5) for i in range(3000)] + [(5, 2000 + i) for i in range(0, 4)]
    nodes = spark.createDataFrame([(n,) for n in sorted({x for p in pairs for x in p})], "node_id long")
    into = closure([p[::-1] for p in pairs])
    got = {r.node_id: r.impact for r in G.impact_estimate(edges(spark, pairs), nodes).collect()}
    exact = {n: len(s - {n}) for n, s in into.items()}
    assert {n: x for n, x in got.items() if exact[n] < 512} == {n: x for n, x in exact.items() if x < 512}
    assert max(abs(got[n] / x - 1) for n, x in exact.items() if x >= 512) < 0.15


def test_paths_of_dense_layers(spark):
    """Ten to the ninth paths and more: the first thousand come by themselves."""
    layer = lambda k: [0] if k == 0 else [10_000] if k == 10 else [100 * k + i for i in range(10)]
    pairs = [(a, b) for k in range(10) for a in layer(k) for b in layer(k + 1)]
    got = [r.path for r in G.find_paths(edges(spark, pairs), 0, 10_000).collect()]
    assert len(got) == 1000 and got == sorted(got) and got[0] == [0, *(100 * k for k in range(1, 10)), 10_000] and got[999][-4:-1] == [709, 809, 909]


@pytest.mark.parametrize("most", [3, 1000])
def test_paths_against_brute_force(spark, monkeypatch, most):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(30)})
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    found, todo = [], [[0]]
    while todo:
        p = todo.pop()
        if p[-1] == 8:
            found.append(p)
        elif len(p) <= 6:
            todo += [[*p, n] for n in out.get(p[-1], ()) if n not in p]
    expected = sorted(found, key=lambda p: (len(p), p))[:most]
    if most == 3:  # the way of many paths
        monkeypatch.setattr(G, "_all_paths", lambda *_: None)
    assert [r.path for r in G.find_paths(edges(spark, pairs), 0, 8, 6, most).collect()] == expected


def test_weak_components_of_a_long_chain(spark):
    names = list(range(20_000))
    random.Random(1).shuffle(names)
    pairs = [(a, b) if i % 2 else (b, a) for i, (a, b) in enumerate(zip(names, names[1:]))]
    got = G.weak_components(edges(spark, pairs))
    assert got.count() == 20_000 and got.where("root <> 0").isEmpty()


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("shuffled", [True, False])
def test_components_by_contraction(spark, kind, shuffled):
    """Rounds of contraction down to a few links: chains in label order or not, a star, copies, loops and null ends."""
    rng = random.Random(3)
    names = rng.sample(range(10, 99_999), 3000) if shuffled else list(range(10, 3010))
    pairs = [(a, b) for k in range(0, 3000, 600) for a, b in zip(names[k : k + 599], names[k + 1 : k + 600])]
    pairs += [(names[5], x) for x in range(200_000, 200_500)] + [(names[1200], names[1300])] * 5 + [(7, 7), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    cast = str if kind == "string" else int
    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((top(cast(a)), top(cast(b))))
            up[b] = a
    links = spark.createDataFrame([(None if a is None else cast(a), cast(b)) for a, b in pairs], f"a {kind}, b {kind}")
    got = {r.node: r.root for r in components(links, one_task=60).collect()}
    assert got == {x: top(x) for x in up}
    assert components(links.limit(0)).collect() == []


def test_large_weak_components_lose_their_pivots(spark):
    """Two rings joined by a bridge and a third apart, none of them within the bound of one task."""
    ring = lambda first, n: [(first + i, first + (i + 1) % n) for i in range(n)]
    pairs = ring(0, 12) + ring(100, 8) + [(3, 104), (300, 301)] + ring(200, 9)
    got = {r.node_id: (r.scc, r.size) for r in G.strong_components(edges(spark, pairs), 4).collect()}
    assert got == {**{i: (0, 12) for i in range(12)}, **{100 + i: (100, 8) for i in range(8)}, **{200 + i: (200, 9) for i in range(9)}}
