"""Flows, clusters and reading orders. Small ordered searches run in Python, one group or one chunk of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphlode.functions import text as tx
from graphlode.functions.prefix import ordinals
from graphlode.operators import adjacency
from graphlode.storage import cut, release, stash


def flow_paths(entries: DataFrame, calls: DataFrame, max_depth: int = 8, max_paths: int = 2, max_branch: int = 3) -> DataFrame:
    """(entry, n, path): from each entry (id) the first paths of calls to a node without any further, in breadth-first order.

    Neighbours go in order of id; each node has a place in one path only; at most max_branch branches at a node; a path
    ends at max_depth nodes. An entry may open max_branch ** (max_depth - 1) paths, thousands, before its first one ends, so
    none of them is stored: ids become numbers in their order, the calls files to look them up in, and each entry is searched
    in one go. Where the shared folder is no path that executors can open, flow_paths_by_levels() does the same by joins.
    """
    folder = adjacency.local_folder(entries.sparkSession)
    if folder is None:
        return flow_paths_by_levels(entries, calls, max_depth, max_paths, max_branch)
    called = stash(calls.select("source_id", "target_id"), "calls")
    known = called.select(F.col("source_id").alias("id")).unionByName(called.select(F.col("target_id").alias("id"))).unionByName(entries.select("id")).distinct()
    ids = stash(ordinals(stash(known, "ids"), ["id"], "k"), "numbers")
    pairs = called.join(ids.select(F.col("id").alias("source_id"), F.col("k").alias("s")), "source_id").join(ids.select(F.col("id").alias("target_id"), F.col("k").alias("t")), "target_id")
    files = adjacency.write(pairs.select("s", "t"), folder)
    release(called)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = adjacency.Reader(files)
        for b in batches:
            numbers, paths = [], []
            for entry in b.column(0).to_pylist():
                for n, path in enumerate(_first_paths(reader, entry, max_depth, max_paths, max_branch)):
                    numbers.append(n)
                    paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(paths, pa.list_(pa.int64()))], names=["n", "path"])

    # An entry's search costs much more than its row, so there are tasks for all cores; entries whose ids are near look at
    # the same parts of the files.
    at = entries.select("id").join(ids, "id").select("k").repartitionByRange(4 * entries.sparkSession.sparkContext.defaultParallelism, "k").sortWithinPartitions("k")
    found = stash(at.mapInArrow(search, "n int, path array<bigint>").withColumn("row", F.monotonically_increasing_id()), "flows")
    named = found.select("row", "n", F.posexplode("path").alias("pos", "k")).join(ids, "k")
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("path")
    return named.groupBy("row", "n").agg(path).select(F.get("path", F.lit(0)).alias("entry"), "n", "path")


def _first_paths(reader: adjacency.Reader, entry: int, max_depth: int, max_paths: int, max_branch: int) -> list[list[int]]:
    nodes, before, level, seen, done = [entry], [-1], [0], {entry}, []

    def path(i: int) -> list[int]:
        out = []
        while i >= 0:
            out.append(nodes[i])
            i = before[i]
        return out[::-1]

    for length in range(1, max_depth + 1):
        more = []
        for i in level:
            if len(done) >= max_paths:
                return done
            if length == max_depth:
                done.append(path(i))
                continue
            fresh = reader.unseen(nodes[i], seen, max_branch)
            seen.update(fresh)
            # Of paths of full length no more than max_paths are looked at again.
            if length + 1 < max_depth or len(more) < max_paths:
                for t in fresh:
                    more.append(len(nodes))
                    nodes.append(t)
                    before.append(i)
            if not fresh and length >= 2:
                done.append(path(i))
        level = more
        if not level or len(done) >= max_paths:
            break
    return done


def flow_paths_by_levels(entries: DataFrame, calls: DataFrame, max_depth: int = 8, max_paths: int = 2, max_branch: int = 3) -> DataFrame:
    """flow_paths() level by level, all entries at once: a level is one join with the calls, then one pass over each entry's
    open paths, which are stored."""
    adjacent = calls.select("source_id", "target_id").distinct().groupBy("source_id").agg(F.array_sort(F.collect_list("target_id")).alias("next"))
    open_ = entries.select(F.col("id").alias("entry"), F.array(F.array("id")).alias("open"), F.array("id").alias("seen"), F.array().cast("array<array<string>>").alias("done"))

    def one_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for entry, opened, seen, done, nexts in zip(b["entry"], b["open"], b["seen"], b["done"], b["nexts"]):
                known = {x["source_id"]: list(x["next"]) for x in nexts if x is not None and x["source_id"] is not None}
                seen, done, more = set(seen), [list(p) for p in done], []
                for path in (list(p) for p in opened):
                    if len(done) >= max_paths:
                        break
                    if len(path) >= max_depth:
                        done.append(path)
                        continue
                    fresh = [t for t in known.get(path[-1], []) if t not in seen][:max_branch]
                    fresh = list(dict.fromkeys(fresh))
                    seen.update(fresh)
                    more += [path + [t] for t in fresh]
                    if not fresh and len(path) >= 2:
                        done.append(path)
                rows.append((entry, [] if len(done) >= max_paths else more, sorted(seen), done))
            yield pd.DataFrame(rows, columns=["entry", "open", "seen", "done"])

    kept = "entry string, open array<array<string>>, seen array<string>, done array<array<string>>"
    for _ in range(max_depth):
        tips = open_.select("entry", F.explode_outer("open").alias("p")).select("entry", F.element_at("p", -1).alias("source_id")).distinct()
        lists = tips.join(adjacent, "source_id").groupBy("entry").agg(F.collect_list(F.struct("source_id", "next")).alias("nexts"))
        joined = open_.join(lists, "entry", "left").withColumn("nexts", F.coalesce("nexts", F.array().cast("array<struct<source_id:string,next:array<string>>>")))
        before, open_ = open_, cut(joined.mapInPandas(one_level, kept))
        release(before)
        if open_.where(F.size("open") > 0).isEmpty():
            break
    return open_.select("entry", F.posexplode("done").alias("n", "path"))


def nav_flows(entries: DataFrame, calls: DataFrame, most: int = 3, overlap: float = 0.8) -> DataFrame:
    """(group, n, path): for each group's entries (group, id, rank) in order, the first path of calls of 4 nodes at most, but
    `most` in all and none that shares more than `overlap` of the longer one's nodes with a path before it."""
    paths = flow_paths(entries.select("id").distinct(), calls, max_depth=4, max_paths=1).where(F.size("path") >= 2)
    ranked = entries.join(paths.select(F.col("entry").alias("id"), "path"), "id").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "path"))).alias("all"))
    # Entries are the answer of a query, so a group is small.
    like = f"exists(acc, g -> size(array_intersect(g, x.path)) / greatest(size(g), size(x.path)) > {overlap})"
    kept = F.expr(f"aggregate(all, cast(array() AS array<array<string>>), (acc, x) -> IF(size(acc) >= {most} OR {like}, acc, concat(acc, array(x.path))))")
    return ranked.select("group", F.posexplode(kept).alias("n", "path"))


def concept_flows(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """concept_paths rows of flow_paths()."""
    p = flow_paths(entries, calls)
    name = F.concat(tx.slug_name(F.get("path", F.lit(0))), F.lit("_to_"), tx.slug_name(F.element_at("path", -1)))
    return p.select(F.concat(F.lit("flow_"), F.translate(name, ".", "_")).alias("id"), name.alias("name"), F.col("path").alias("node_ids"), F.lit("call_chain").alias("path_type"))


def cluster_members(keywords: DataFrame, least: int = 3, most: int = 15) -> DataFrame:
    """(keyword, node_ids): names' keywords of four letters or more that from 3 to 15 nodes share."""
    named = keywords.where((F.col("source") == "name") & (F.length("keyword") >= 4)).select("keyword", "node_id").distinct()
    # Counted first, so that a word in millions of names never becomes a list.
    few = named.groupBy("keyword").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("keyword")
    return named.join(few, "keyword").groupBy("keyword").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))


def topological(ids: list[str], pairs: list[tuple[str, str]], rank: dict[str, float] | None = None) -> list[str]:
    """Kahn's order of ids by (before, after) pairs: the ready ones first come first served, or by rank downwards; nodes on
    rings come last, in the given order or by rank."""
    follow: dict[str, list[str]] = {i: [] for i in ids}
    waits = dict.fromkeys(ids, 0)
    for a, b in sorted(set(pairs)):
        if a in follow and b in waits:
            follow[a].append(b)
            waits[b] += 1
    order = (lambda q: sorted(q, key=lambda i: (-rank[i], i))) if rank else (lambda q: q)
    queue, out = order([i for i in ids if not waits[i]]), []
    while queue:
        i, queue = queue[0], queue[1:]
        out.append(i)
        for j in follow[i]:
            waits[j] -= 1
            if not waits[j]:
                queue = order([*queue, j])
    have = set(out)
    return out + order([i for i in ids if i not in have])


def domain_clusters(keywords: DataFrame, calls: DataFrame) -> DataFrame:
    """concept_paths rows: each cluster's nodes in the order of their calls. Groups have 15 rows at most."""
    members = cluster_members(keywords)
    rows = members.select("keyword", F.explode("node_ids").alias("source_id"), "node_ids")
    inside = rows.join(calls.select("source_id", "target_id").distinct(), "source_id").where(F.array_contains("node_ids", F.col("target_id"))).groupBy("keyword").agg(F.collect_list(F.struct("source_id", "target_id")).alias("pairs"))
    met = members.join(inside, "keyword", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<source_id:string,target_id:string>>")))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [topological(list(ids), [(p["source_id"], p["target_id"]) for p in pairs]) for ids, pairs in zip(b["node_ids"], b["pairs"])]
            name = "domain_" + b["keyword"]
            yield pd.DataFrame({"id": name, "name": name, "node_ids": out, "path_type": "domain_cluster"})

    return met.mapInPandas(order, "id string, name string, node_ids array<string>, path_type string")


def read_order(groups: DataFrame, calls: DataFrame) -> DataFrame:
    """(group, pos, id): each group (group, id, importance) in the order in which to read it: callers before what they
    call, the more important first. Groups are answers of a query, so they are small."""
    members = groups.groupBy("group").agg(F.collect_list(F.struct("id", "importance")).alias("m"))
    inside = groups.select("group", F.col("id").alias("source_id")).join(calls.select("source_id", "target_id"), "source_id").join(groups.select("group", F.col("id").alias("target_id")), ["group", "target_id"])
    pairs = inside.groupBy("group").agg(F.collect_list(F.struct("source_id", "target_id")).alias("pairs"))
    met = members.join(pairs, "group", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<source_id:string,target_id:string>>")))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m, p in zip(b["m"], b["pairs"]):
                rank = {x["id"]: x["importance"] or 0.0 for x in m}
                out.append(topological(sorted(rank), [(x["source_id"], x["target_id"]) for x in p], rank))
            yield pd.DataFrame({"group": b["group"], "ids": out})

    return met.mapInPandas(order, "group string, ids array<string>").select("group", F.posexplode("ids").alias("pos", "id"))


def concept_chains(chains: DataFrame) -> DataFrame:
    """concept_paths rows of graph.linear_chains()."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    p = chains.groupBy("chain").agg(path.alias("node_ids"))
    name = F.concat(tx.slug_name(F.get("node_ids", F.lit(0))), F.lit("_to_"), tx.slug_name(F.element_at("node_ids", -1)))
    return p.select(F.concat(F.lit("chain_"), name).alias("id"), name.alias("name"), "node_ids", F.lit("call_chain").alias("path_type"))


def flows(paths: DataFrame, keyword: str | None = None) -> DataFrame:
    return paths if not keyword else paths.where(F.lower("name").contains(keyword.lower()))


def flow_labels(paths: DataFrame) -> DataFrame:
    """(id, pos, node_id, label): short names, with the file where the node before or after has the same one."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("pos")
    rows = paths.select("id", F.posexplode("node_ids").alias("pos", "node_id")).withColumn("short", tx.short_name(F.col("node_id")))
    twin = (F.lag("short").over(w) == F.col("short")) | (F.lead("short").over(w) == F.col("short"))
    return rows.select("id", "pos", "node_id", F.when(F.coalesce(twin, F.lit(False)), F.col("node_id")).otherwise(F.col("short")).alias("label"))
