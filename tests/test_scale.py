"""Hot keys and equal values: no list, window or task with all of one key's rows."""

import random
from pathlib import Path

from graphlode.functions.prefix import ordinals
from graphlode.operators import adjacency, concepts, history, patterns, scores
from graphlode.plans import catalogue
from graphlode.storage import SPREAD_BYTES, spread
from tests.oracle import DATA


def test_ranks_of_equal_scores(spark):
    r = random.Random(1)
    rows = [(f"n{r.random():.12f}", 1.0 if i % 3 else float(r.randrange(20))) for i in range(3000)]
    got = {x.id: x.importance_rank for x in scores.importance_rank(spark.createDataFrame(rows, "id string, importance double")).collect()}
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    assert got == {i: round(k / 2999 * 100) for k, (i, _) in enumerate(order)}
    assert scores.importance_rank(spark.createDataFrame([], "id string, importance double")).collect() == []
    assert scores.importance_rank(spark.createDataFrame([("a", 1.0)], "id string, importance double")).collect() == [("a", 1.0, 0)]


def test_ordinals(spark):
    df = spark.range(1000).selectExpr("CAST(hash(id) AS STRING) AS k", "id % 2 AS half")
    got = [(x.half, x.k) for x in ordinals(df, ["half", "k"], "i").orderBy("i").collect()]
    assert got == sorted(got) and [x.i for x in ordinals(df, ["half", "k"], "i").orderBy("i").collect()] == list(range(1000))


def test_pair_in_many_commits(spark):
    rows = [(f"h{i:04}", "a", ["x.py", "y.py"]) for i in range(900)] + [("z1", "a", ["x.py", "w.py"]), ("z2", "b", ["x.py", "w.py"])]
    df = spark.createDataFrame(rows, "hash string, author string, files array<string>").selectExpr("hash", "author", "TIMESTAMP_NTZ '2024-01-30 00:00:00' AS date", "files")
    (pair,) = history.cochanges(df).collect()
    assert (pair.file_a, pair.file_b, pair.co_commit_count, pair.total_commits_a) == ("x.py", "y.py", 900, 902)
    assert pair.commit_ids == [f"h{i:04}" for i in range(20)]


def test_pattern_in_many_nodes(spark):
    found = spark.createDataFrame([(f"n{i:05}", "factory") for i in range(2000)] + [("m", "singleton")], "node_id string, pattern string")
    assert {r.pattern: (r.total, r.shown) for r in patterns.grouped(found).collect()} == {"factory": (2000, ["n00000", "n00001", "n00002"]), "singleton": (1, ["m"])}


def test_nav_flows_in_order_without_repeats(spark):
    calls = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "b"), ("p", "q"), ("q", "r"), ("r", "s"), ("u", "v"), ("w", "y")]
    entries = [("g", "p", 1), ("g", "a", 0), ("g", "b", 2), ("g", "q", 3), ("g", "lone", 4), ("g", "u", 5), ("g", "w", 6)]
    got = concepts.nav_flows(spark.createDataFrame(entries, "group string, id string, rank int"), spark.createDataFrame(calls, "source_id string, target_id string"))
    assert [r.path for r in got.orderBy("n").collect()] == [["a", "b", "c", "d"], ["p", "q", "r", "s"], ["b", "c", "d"]]
    strict = concepts.nav_flows(spark.createDataFrame(entries, "group string, id string, rank int"), spark.createDataFrame(calls, "source_id string, target_id string"), overlap=0.5)
    assert [r.path for r in strict.orderBy("n").collect()] == [["a", "b", "c", "d"], ["p", "q", "r", "s"], ["u", "v"]]


def test_flows_store_no_open_paths(spark):
    """Every node calls a third of all: an entry opens 3 ** 7 paths before its first one ends."""
    r = random.Random(2)
    ids = [f"n{r.random():.15f}" for _ in range(60)]
    calls = spark.createDataFrame([(a, b) for a in ids for b in r.sample(ids, 20) if a != b], "source_id string, target_id string")
    entries = spark.createDataFrame([(i,) for i in [*ids, "lone"]], "id string")
    folder = Path(adjacency.local_folder(spark))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    got = sorted((x.entry, x.n, tuple(x.path)) for x in concepts.flow_paths(entries, calls).collect())
    assert size() - before < 200_000
    assert got == sorted((x.entry, x.n, tuple(x.path)) for x in concepts.flow_paths_by_levels(entries, calls).collect()) and len({x[0] for x in got}) == 60


def test_neighbours_in_files(spark):
    """Targets beyond a chunk, pairs that come twice, sources that aren't there."""
    pairs = [(s, t) for s in (3, 5, 900) for t in range(0, 4 * adjacency.CHUNK, s % 4 + 1)] + [(7, 1)]
    reader = adjacency.Reader(adjacency.write(spark.createDataFrame(pairs * 2, "s long, t long"), adjacency.local_folder(spark)))
    for s in (0, 3, 4, 5, 7, 900, 901):
        for seen in (set(), set(range(150)), set(range(10_000))):
            want = [t for x, t in sorted(set(pairs)) if x == s and t not in seen]
            assert [reader.unseen(s, seen, n) for n in (1, 3, 1000)] == [want[:1], want[:3], want]


def test_one_semi_join_for_all_kinds_of_nodes(spark):
    """Pushed below the union of nodes, it would read what crosses modules once for each of six kinds, in one task's turn."""
    for name, join in (("find_cross_module", "LeftSemi"), ("find_no_tests", "LeftAnti")):
        plan = catalogue.QUERIES[name](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(f"Join {join}, (id") == 1


def test_shuffles_start_with_more_partitions_for_more_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spread(spark, 100 * SPREAD_BYTES)
    try:
        assert spark.conf.get(key) == "100"
        assert spark.range(100).groupBy("id").count().count() == 100
    finally:
        spread(spark, 0)
    assert spark.conf.get(key, None) is None


def test_edges_are_shuffled_by_numbers(spark):
    """Beyond the joins with either end an edge carries no id, and unknown ends count for nobody."""
    nodes = spark.createDataFrame([("a", "a", "m/x"), ("b", "_b", "k/x")], "id string, name string, file_path string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "gone", "calls"), ("gone", "b", "imports"), ("gone", "gone", "calls"), ("a", "b", "other")], "source_id string, target_id string, edge_type string")
    got = scores.importance(nodes, edges)
    assert {r.id: r.importance for r in got.collect()} == {"a": 1 + 2 * 0.5 + 2, "b": 2 + 2 + 0.5}
    tail = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [n#" in tail and "Aggregate [id#" not in tail
    assert {r.id for r in scores.cross_module(nodes, edges).collect()} == {"a", "b"}


def test_tree_summary_sorts_no_calls(spark):
    """A task holds its part of the nodes, not of the calls."""
    plan = catalogue.QUERIES["tree_summary"](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=shuffle_hash") == 2
