"""Traversal of typed edges: a level loop of joins, one frontier after the other.

An edge table is (source_id, target_id, edge_type, confidence). Each level is one equi-join of the frontier with the edges,
one aggregation that keeps the smallest parent of each new node, and an anti-join with what has been visited; a table in
the shared folder ends it, so lineage doesn't grow and lost executors cost nothing. Its rows are counted once, to see whether
the search goes on and whether the next frontier may be broadcast; beyond that both sides shuffle on the node. Edges are read
at every level, so they should be a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphlode.schema import REVERSE
from graphlode.storage import broadcast_if_small, cut, hinted, looked_up, release

#: Bytes a frontier row is taken to have.
ROW = 100


def reverse_edges(edges: DataFrame) -> DataFrame:
    """edges and, for each of a type that has one, its reverse edge."""
    back = F.create_map(*(F.lit(x) for kv in REVERSE.items() for x in kv))
    other = [c for c in edges.columns if c not in ("source_id", "target_id", "edge_type")]
    swapped = edges.where(F.col("edge_type").isin(*REVERSE)).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), back[F.col("edge_type")].alias("edge_type"), *other)
    return edges.select("source_id", "target_id", "edge_type", *other).unionByName(swapped)


def strict(edges: DataFrame) -> DataFrame:
    """edges whose confidence isn't low; null passes."""
    return edges.where(F.coalesce("confidence", F.lit("high")) != "low")


def steps(edges: DataFrame, forward: list[str] = (), backward: list[str] = ()) -> DataFrame:
    """(source_id, target_id) of the types to follow along, and against, their direction."""
    ahead = edges.where(F.col("edge_type").isin(*forward)).select("source_id", "target_id")
    if not backward:
        return ahead
    back = edges.where(F.col("edge_type").isin(*backward)).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return ahead.unionByName(back) if forward else back


def bfs_levels(pairs: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(root, id, depth, parent) of all nodes within max_hops of each seed (root, id), the seeds at depth 0.

    parent is the smallest id one hop nearer. Each root's search is its own; all go level by level together.
    """
    seeds = cut(seeds.select("root", "id").distinct())
    found = seeds.count()
    frontier, visited, levels = seeds, seeds, [seeds.select("root", "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))]
    hop = pairs.select(F.col("source_id").alias("id"), F.col("target_id").alias("next"))
    for depth in range(1, max_hops + 1):
        met = hop.join(hinted(frontier, found, ROW), "id").groupBy("root", F.col("next").alias("id")).agg(F.min("id").alias("parent"))
        new = cut(met.join(visited, ["root", "id"], "left_anti"))
        found = new.count()
        if not found:
            break
        levels.append(new.select("root", "id", F.lit(depth).alias("depth"), "parent"))
        frontier = new.select("root", "id")
        visited = visited.unionByName(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shortest_path(pairs: DataFrame, source: str, target: str, max_depth: int) -> DataFrame:
    """(pos, id) of the first in order of the shortest paths, of max_depth hops at most; no row if there is none."""
    spark = pairs.sparkSession
    frontier = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    if source != target:
        hop = pairs.select(F.col("source_id").alias("id"), F.col("target_id").alias("next"))
        visited, n = frontier.select("id"), 1
        for _ in range(max_depth):
            met = hop.join(hinted(frontier, n, 8 * ROW), "id").groupBy("next").agg(F.min("path").alias("path"))
            frontier = cut(met.select(F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path")).join(visited, "id", "left_anti"))
            n, there = frontier.agg(F.count("*"), F.coalesce(F.max(F.col("id") == target), F.lit(False))).first()
            if there or not n:
                break
            visited = visited.unionByName(frontier.select("id"))
        frontier = frontier.where(F.col("id") == target)
    return frontier.select(F.posexplode("path").alias("pos", "id"))


def trace(edges: DataFrame, source: str, target: str, max_depth: int = 8) -> DataFrame:
    """(pos, id, resolution): the path over certain calls, else the one over calls, inheritance and dispatch either way."""
    certain = shortest_path(steps(strict(edges), ["calls"]), source, target, max_depth)
    if not certain.isEmpty():
        return certain.withColumn("resolution", F.lit("calls_only"))
    return trace_via_inheritance(edges, source, target, max_depth)


def trace_via_inheritance(edges: DataFrame, source: str, target: str, max_depth: int = 8) -> DataFrame:
    """(pos, id, resolution): the path over calls, doubtful ones too, inheritance and dispatch either way."""
    soft = steps(edges, ["calls", "inherits", "dispatches_to"], ["inherits", "dispatches_to"])
    return shortest_path(soft, source, target, max_depth).withColumn("resolution", F.lit("soft"))


def callers(edges: DataFrame, target: str, depth: int = 1) -> DataFrame:
    """(id, depth, uncertain) of those that call the target within `depth` hops; uncertain: only a doubtful edge leads on."""
    spark = edges.sparkSession
    seeds = spark.createDataFrame([(target, target)], "root string, id string")
    calls = edges.where("edge_type = 'calls'")
    found = bfs_levels(steps(calls, backward=["calls"]), seeds, depth).where("depth > 0")
    near = found.select(F.col("id").alias("source_id"), "depth", F.col("parent").alias("target_id"))
    doubt = calls.select("source_id", "target_id", (F.coalesce("confidence", F.lit("high")) == "low").alias("low")).groupBy("source_id", "target_id").agg(F.min("low").alias("uncertain"))
    return near.join(doubt, ["source_id", "target_id"]).select(F.col("source_id").alias("id"), "depth", "uncertain")


def blast_radius(edges: DataFrame, target: str, depth: int = 3) -> DataFrame:
    """(id, depth, bucket) of what a change of the target may reach: its callers and heirs, theirs, and so on."""
    seeds = edges.sparkSession.createDataFrame([(target, target)], "root string, id string")
    found = bfs_levels(steps(edges, backward=["calls", "inherits"]), seeds, depth).where("depth > 0")
    bucket = F.when(F.col("depth") == 1, "direct").when(F.col("depth") == 2, "indirect").otherwise("distant")
    return found.select("id", "depth", bucket.alias("bucket"))


def affected_tests(edges: DataFrame, nodes: DataFrame, affected: DataFrame) -> DataFrame:
    """(id): nodes tagged test next to an affected node by an edge of any type, either way."""
    hit = affected.select(F.col("id").alias("hit"))
    ahead = edges.join(hit, edges["source_id"] == hit["hit"], "left_semi").select(F.col("target_id").alias("id"))
    back = edges.join(hit, edges["target_id"] == hit["hit"], "left_semi").select(F.col("source_id").alias("id"))
    tests = nodes.where(F.array_contains("tags", "test")).select("id")
    return ahead.unionByName(back).distinct().join(tests, "id", "left_semi")


def test_coverage(nodes: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """(id, direct_count, transitive, hops, via) of every node that a test reaches by calls within max_hops.

    One search from all tests at once. A test that another test (or itself) calls is covered, so tests don't start as
    visited. via is the smallest id of the tests nearest to a node that no test calls itself, and empty otherwise. Beyond
    a direct call a test doesn't cover itself: those that only a ring leads back to are searched once more, each on its own.
    """
    tests = nodes.where(F.array_contains("tags", "test")).select("id")
    calls = edges.where("edge_type = 'calls'").select("source_id", "target_id")
    first = calls.join(broadcast_if_small(looked_up(tests.withColumnRenamed("id", "source_id")), ROW), "source_id", "left_semi")
    level = cut(first.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("direct_count"), F.min("source_id").alias("via")))
    out = level.select("id", "direct_count", F.lit(True).alias("transitive"), F.lit(0).alias("hops"), F.lit("").alias("via"))
    visited, frontier = level.select("id"), level.select("id", "via")
    for hops in range(2, max_hops + 1):
        met = calls.join(broadcast_if_small(looked_up(frontier.withColumnRenamed("id", "source_id")), 2 * ROW), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("via").alias("via"))
        frontier = cut(met.join(visited, "id", "left_anti"))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.select("id", F.lit(0).cast("long").alias("direct_count"), F.lit(True).alias("transitive"), F.lit(hops).alias("hops"), "via"))
        visited = visited.unionByName(frontier.select("id"))
    rings = cut(out.where("hops > 0 AND via = id").select("id"))
    if rings.isEmpty():
        return out
    above = bfs_levels(steps(edges, backward=["calls"]), rings.select(F.col("id").alias("root"), "id"), max_hops).where("depth > 0 AND id <> root")
    nearest = above.join(tests, "id", "left_semi").groupBy("root").agg(F.min(F.struct("depth", "id")).alias("x"))
    again = nearest.select(F.col("root").alias("id"), F.lit(0).cast("long").alias("direct_count"), F.lit(True).alias("transitive"), F.col("x.depth").alias("hops"), F.col("x.id").alias("via"))
    return out.join(rings, "id", "left_anti").unionByName(again)


def ancestors(inherits: DataFrame) -> DataFrame:
    """(id, ancestor, depth): every class's ancestors, with the least number of steps; safe on cycles.

    By doubling, until nothing new is met: each round joins the closure with itself, so depth 2**k takes k rounds.
    """
    closure = cut(inherits.select(F.col("source_id").alias("id"), F.col("target_id").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    while True:
        right = closure.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        longer = closure.join(right, "ancestor").select("id", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        grown = cut(closure.unionByName(longer).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        if grown.count() == closure.count():
            break
        release(closure)
        closure = grown
    return closure.where("id <> ancestor")


def dispatches(methods: DataFrame, closure: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, edge_type, weight, via): the nearest ancestor's method of a name to its override.

    methods: (id, name, parent_id); closure as ancestors() gives it. Dunder methods have none.
    """
    m = methods.where(~(F.col("name").startswith("__") & F.col("name").endswith("__")))
    own = m.select(F.col("id").alias("target_id"), "name", F.col("parent_id").alias("class_id"))
    base = m.select(F.col("id").alias("source_id"), "name", F.col("parent_id").alias("ancestor"))
    met = own.join(closure.withColumnRenamed("id", "class_id"), "class_id").join(base, ["ancestor", "name"]).where("source_id <> target_id")
    nearest = F.row_number().over(Window.partitionBy("target_id").orderBy("depth", "ancestor", "source_id"))
    return met.withColumn("n", nearest).where("n = 1").select("source_id", "target_id", F.lit("dispatches_to").alias("edge_type"), F.lit(0.5).alias("weight"), F.col("ancestor").alias("via"))


def linear_chains(nodes: DataFrame, calls: DataFrame, least: int = 3, rounds: int = 40) -> DataFrame:
    """(chain, pos, id): maximal runs in which each node but the last has one outgoing call, to a node that is no file.

    A node that several such runs enter goes on with the smallest caller's; a ring is cut before its smallest id. Heads are
    found by pointer doubling, so a chain of n nodes takes log n rounds.
    """
    single = calls.select("source_id", "target_id").distinct().groupBy("source_id").agg(F.count("*").alias("n"), F.first("target_id").alias("id")).where("n = 1 AND source_id <> id")
    symbols = nodes.where("kind <> 'file'").select("id")
    edge = single.join(symbols, "id", "left_semi").join(symbols.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    pred = cut(edge.groupBy("id").agg(F.min("source_id").alias("up")))
    # Chains are done after log n rounds; what stays undone and unchanged are rings, whose nodes all have a caller.
    far, before = cut(pred.select("id", "up", F.least("id", "up").alias("low"), F.lit(1).cast("long").alias("dist"))), None
    for _ in range(rounds):
        step = far.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"), F.col("dist").alias("d2"))
        grown = cut(far.join(step, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), F.least("low", F.coalesce("low2", "low")).alias("low"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.col("up2").isNull().alias("done")))
        far = grown.drop("done")
        now = tuple(grown.where("NOT done").agg(F.count("*"), F.countDistinct("low")).first())
        if not now[0]:
            break
        if now == before:
            cuts = grown.where("NOT done AND id = low").select("id").join(pred, "id").select(F.col("up").alias("source_id"), F.col("id").alias("target_id"))
            left = edge.select("source_id", F.col("id").alias("target_id")).join(cuts, ["source_id", "target_id"], "left_anti")
            return linear_chains(nodes, left, least, rounds)
        before = now
    heads = pred.select(F.col("up").alias("id")).distinct().join(pred, "id", "left_anti").select("id", F.col("id").alias("chain"), F.lit(0).alias("pos"))
    rest = far.select("id", F.col("up").alias("chain"), F.col("dist").alias("pos"))
    all_rows = heads.unionByName(rest)
    long_enough = rest.groupBy("chain").agg(F.max("pos").alias("last")).where(F.col("last") + 1 >= least).select("chain")
    return all_rows.join(long_enough, "chain", "left_semi").select("chain", F.col("pos").cast("long").alias("pos"), "id")
