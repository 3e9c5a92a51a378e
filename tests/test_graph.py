"""Traversals against short searches written apart from them."""

import random
from collections import defaultdict, deque

import pytest

from graphlode.operators import concepts, graph, scores


def make(spark, pairs, kind="calls", confidence="high"):
    return spark.createDataFrame([(a, b, kind, confidence) for a, b in pairs], "source_id string, target_id string, edge_type string, confidence string")


def random_pairs(seed, n=25, m=60):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)})


def depths(pairs, start, most):
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        if seen[x] < most:
            for y in adj[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_and_paths(spark, seed):
    pairs = random_pairs(seed)
    e = make(spark, pairs)
    steps = graph.steps(e, ["calls"])
    seeds = spark.createDataFrame([("n00", "n00"), ("n01", "n01")], "root string, id string")
    got = {(r.root, r.id): r.depth for r in graph.bfs_levels(steps, seeds, 4).collect()}
    assert got == {(s, k): v for s in ("n00", "n01") for k, v in depths(pairs, s, 4).items()}
    known = depths(pairs, "n00", 8)
    for target in ("n07", "n13"):
        path = [r.id for r in graph.shortest_path(steps, "n00", target, 8).orderBy("pos").collect()]
        assert len(path) == (known[target] + 1 if target in known else 0)
        assert all(p in set(pairs) for p in zip(path, path[1:]))
        assert not path or (path[0], path[-1]) == ("n00", target)
    assert [r.id for r in graph.shortest_path(steps, "n00", "n00", 3).collect()] == ["n00"]


def test_depth_limit(spark):
    e = graph.steps(make(spark, [(f"x{i}", f"x{i + 1}") for i in range(9)]), ["calls"])
    assert graph.shortest_path(e, "x0", "x8", 8).count() == 9
    assert graph.shortest_path(e, "x0", "x9", 8).count() == 0


def test_strict_then_soft(spark):
    e = make(spark, [("a", "b")]).unionByName(make(spark, [("b", "c")], confidence="low"))
    assert [(r.id, r.resolution) for r in graph.trace(e, "a", "c").orderBy("pos").collect()] == [("a", "soft"), ("b", "soft"), ("c", "soft")]
    assert {r.resolution for r in graph.trace(e, "a", "b").collect()} == {"calls_only"}
    assert {(r.id, r.depth, r.uncertain) for r in graph.callers(e, "c", 2).collect()} == {("b", 1, True), ("a", 2, False)}


@pytest.mark.parametrize("seed", [3, 4])
def test_coverage(spark, seed):
    pairs = [p for p in random_pairs(seed, 30, 50)]
    names = sorted({x for p in pairs for x in p})
    tests = set(names[::9])
    nodes = spark.createDataFrame([(x, ["test"] if x in tests else []) for x in names], "id string, tags array<string>")
    got = {r.id: (r.direct_count, r.hops, r.via) for r in graph.test_coverage(nodes, make(spark, pairs)).collect()}
    back = defaultdict(set)
    for a, b in pairs:
        back[b].add(a)
    want = {}
    for x in names:
        direct = len(back[x] & tests)
        if direct:
            want[x] = (direct, 0, "")
            continue
        layer, seen = {x}, {x}
        for hop in (1, 2, 3):
            layer = {p for y in layer for p in back[y]} - seen
            seen |= layer
            if hop > 1 and layer & tests:
                want[x] = (0, hop, min(layer & tests))
                break
    assert got == want


def test_blast_and_tests(spark):
    e = make(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("z", "d"), ("a", "b"), ("t", "c")]).unionByName(make(spark, [("h", "a")], "inherits"))
    rows = graph.blast_radius(e, "a")
    assert {(r.id, r.bucket) for r in rows.collect()} == {("b", "direct"), ("h", "direct"), ("c", "indirect"), ("d", "distant"), ("t", "distant")}
    nodes = spark.createDataFrame([("t", ["test"]), ("c", [])], "id string, tags array<string>")
    assert [r.id for r in graph.affected_tests(e, nodes, rows).collect()] == ["t"]


def test_ancestors_and_dispatch(spark):
    inherits = make(spark, [("c3", "c2"), ("c2", "c1"), ("c1", "c0"), ("y", "x"), ("x", "y")], "inherits")
    closure = graph.ancestors(inherits)
    assert {(r.id, r.ancestor, r.depth) for r in closure.collect()} == {("c3", "c2", 1), ("c3", "c1", 2), ("c3", "c0", 3), ("c2", "c1", 1), ("c2", "c0", 2), ("c1", "c0", 1), ("x", "y", 1), ("y", "x", 1)}
    methods = spark.createDataFrame([("c3.f", "f", "c3"), ("c1.f", "f", "c1"), ("c0.f", "f", "c0"), ("c3.__init__", "__init__", "c3"), ("c0.__init__", "__init__", "c0")], "id string, name string, parent_id string")
    assert {(r.source_id, r.target_id, r.via) for r in graph.dispatches(methods, closure).collect()} == {("c1.f", "c3.f", "c1"), ("c0.f", "c1.f", "c0")}


def test_ancestors_far_away(spark):
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0")]
    closure = graph.ancestors(make(spark, pairs, "inherits"))
    far = {(f"c{i:03}", f"c{j:03}", j - i) for j in range(151) for i in range(j)}
    assert {(r.id, r.ancestor, r.depth) for r in closure.collect()} == far | {(f"r{i}", f"r{(i + k) % 3}", k) for i in range(3) for k in (1, 2)}
    methods = spark.createDataFrame([("c000.f", "f", "c000"), ("c100.f", "f", "c100")], "id string, name string, parent_id string")
    assert [(r.source_id, r.target_id, r.via) for r in graph.dispatches(methods, closure).collect()] == [("c100.f", "c000.f", "c100")]


def test_linear_chains(spark):
    nodes = spark.createDataFrame([(x, "function") for x in "abcdefghpqrxyz"] + [("file", "file")], "id string, kind string")
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("e", "b"), ("f", "g"), ("g", "h"), ("h", "f"), ("p", "q"), ("x", "y"), ("x", "z"), ("y", "z"), ("d", "file")]
    got = defaultdict(list)
    for r in graph.linear_chains(nodes, make(spark, pairs)).orderBy("chain", "pos").collect():
        got[r.chain].append(r.id)
    assert dict(got) == {"a": ["a", "b", "c", "d"], "f": ["f", "g", "h"]}
    long = [(f"l{i:03}", f"l{i + 1:03}") for i in range(100)]
    many = spark.createDataFrame([(f"l{i:03}", "function") for i in range(101)], "id string, kind string")
    assert [r.id for r in graph.linear_chains(many, make(spark, long)).orderBy("pos").collect()] == [f"l{i:03}" for i in range(101)]


def brute_flow(adj, start, max_depth, max_paths, max_branch):
    done, queue, seen = [], [[start]], {start}
    while queue and len(done) < max_paths:
        path = queue.pop(0)
        if len(path) >= max_depth:
            done.append(path)
            continue
        fresh = [t for t in sorted(adj[path[-1]]) if t not in seen][:max_branch]
        seen.update(fresh)
        queue += [[*path, t] for t in fresh]
        if not fresh and len(path) >= 2:
            done.append(path)
    return done


@pytest.mark.parametrize("seed", [5, 6])
def test_flow_paths(spark, seed):
    pairs = random_pairs(seed, 30, 45)
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
    starts = sorted(adj)[:4]
    got = defaultdict(list)
    for r in concepts.flow_paths(spark.createDataFrame([(s,) for s in starts], "id string"), make(spark, pairs), 5, 2, 2).orderBy("entry", "n").collect():
        got[r.entry].append(list(r.path))
    assert dict(got) == {s: p for s in starts if (p := brute_flow(adj, s, 5, 2, 2))}


def test_kahn():
    assert concepts.topological(["a", "b", "c", "d"], [("c", "a"), ("a", "b")]) == ["c", "d", "a", "b"]
    assert concepts.topological(["a", "b", "c"], [("a", "b"), ("b", "a")]) == ["c", "a", "b"]
    assert concepts.topological(["a", "b", "c"], [("c", "a")], {"a": 9.0, "b": 1.0, "c": 0.5}) == ["b", "c", "a"]


def test_importance_by_hand(spark):
    nodes = spark.createDataFrame([("f", "f", "m/a.py"), ("g", "_g", "k/b.py"), ("h", "h", "root.py")], "id string, name string, file_path string")
    e = make(spark, [("f", "g")]).unionByName(make(spark, [("h", "g")], "inherits")).unionByName(make(spark, [("g", "h")], "imports")).unionByName(make(spark, [("f", "h")], "dispatches_to"))
    got = {r.id: r.importance for r in scores.importance(nodes, e).collect()}
    assert got == {"f": 1 + 0.5 + 2, "g": 2 + 2 + 1.5, "h": 1 + 0.5}
    ranks = {r.id: r.importance_rank for r in scores.importance_rank(scores.importance(nodes, e)).collect()}
    assert ranks == {"h": 0, "f": 50, "g": 100}
    one = scores.importance_rank(scores.importance(nodes.where("id = 'f'"), e.limit(0))).collect()
    assert [(r.id, r.importance_rank) for r in one] == [("f", 0)]
    assert scores.importance_rank(scores.importance(nodes.limit(0), e.limit(0))).collect() == []
