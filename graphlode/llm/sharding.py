"""Sharding by best-fit-decreasing bin packing.

Indivisible groups, sorted by size, each enter the bin with the tightest remaining capacity that takes them; a new bin
opens where none does. Bins of equal remaining capacity and groups of equal size are interchangeable, so the packing
works on the histogram of sizes: one step places all groups of a size that a class of bins takes, lowest bin first. The
tree of remaining capacities and the plan grow with the number of distinct sizes, not of groups; Spark then ranks each size's groups and
joins them with the plan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphlode.functions.prefix import running
from graphlode.storage import broadcast_if_small, stash

CAPACITY = 16 << 20


class BalancedTree:
    """A map with ordered integer keys: an AA tree. Nodes are [key, value, level, left, right]."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _skew(n: list | None) -> list | None:
        if n and n[3] and n[3][2] == n[2]:
            left = n[3]
            n[3], left[4] = left[4], n
            return left
        return n

    @staticmethod
    def _split(n: list | None) -> list | None:
        if n and n[4] and n[4][4] and n[4][4][2] == n[2]:
            right = n[4]
            n[4], right[3] = right[3], n
            right[2] += 1
            return right
        return n

    def get_or_add(self, key: int) -> list:
        """The value, a list, of a key; an empty one is put in."""
        found: list = []

        def add(n: list | None) -> list:
            if n is None:
                value: list = []
                found.append(value)
                return [key, value, 1, None, None]
            if key == n[0]:
                found.append(n[1])
                return n
            side = 3 if key < n[0] else 4
            n[side] = add(n[side])
            return self._split(self._skew(n))

        self.root = add(self.root)
        return found[0]

    def remove(self, key: int) -> None:
        def drop(n: list | None, key: int) -> list | None:
            if n is None:
                return None
            if key < n[0]:
                n[3] = drop(n[3], key)
            elif key > n[0]:
                n[4] = drop(n[4], key)
            elif n[3] is None and n[4] is None:
                return None
            else:
                side, other = (4, 3) if n[3] is None else (3, 4)
                near = n[side]
                while near[other]:
                    near = near[other]
                n[0], n[1] = near[0], near[1]
                n[side] = drop(n[side], near[0])
            low = min(n[3][2] if n[3] else 0, n[4][2] if n[4] else 0) + 1
            if low < n[2]:
                n[2] = low
                if n[4] and low < n[4][2]:
                    n[4][2] = low
            n = self._skew(n)
            if n[4]:
                n[4] = self._skew(n[4])
                if n[4][4]:
                    n[4][4] = self._skew(n[4][4])
            n = self._split(n)
            if n[4]:
                n[4] = self._split(n[4])
            return n

        self.root = drop(self.root, key)

    def ceiling(self, key: int) -> tuple[int, list] | None:
        """The smallest key of at least `key`, with its value."""
        n, best = self.root, None
        while n:
            if n[0] >= key:
                best = n
                n = n[3]
            else:
                n = n[4]
        return (best[0], best[1]) if best else None


def pack(histogram: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, number of bins) of (size, number of groups) pairs.

    A run (size, first, end, bin, each) puts the groups of that size ranked first .. end - 1 into bins from `bin` on,
    `each` to a bin. A group larger than the capacity has a bin of its own, as it can't be divided.
    """
    tree, runs, bins = BalancedTree(), [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n:
            heapq.heappush(tree.get_or_add(remaining), (first, n))

    for size, left in sorted(histogram, reverse=True):
        rank = 0
        if size > capacity:
            runs.append((size, 0, left, bins, 1))
            bins += left
            continue
        while left:
            tightest = tree.ceiling(size)
            if tightest:
                room, spans = tightest
                first, n = heapq.heappop(spans)
                if not spans:
                    tree.remove(room)
            else:
                room, first = capacity, bins
                n = -(-left // (capacity // size)) if size else 1
                bins += n
            each = room // size if size else left
            full = min(n, left // each)
            if full:
                runs.append((size, rank, rank + full * each, first, each))
                put(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last bin that this size needs
                runs.append((size, rank, rank + left, first + full, left))
                put(room - left * size, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return runs, bins


def _assigned(rows: DataFrame, capacity: int) -> DataFrame:
    """(g, group_bytes, shard) of rows (g, bytes)."""
    groups = rows.groupBy("g").agg(F.sum("bytes").alias("size")).withColumns({"one": F.lit(1), "part": F.substring(F.hex("g"), 1, 2)})
    groups = stash(groups, "shard-groups")
    # Distinct sizes only: at most as many as a group can have bytes, in practice far fewer than groups.
    histogram = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).toLocalIterator()]
    runs, _ = pack(histogram, capacity)
    spark = rows.sparkSession
    plan = spark.createDataFrame(runs, "s long, first long, end long, bin long, each long")
    ranked = running(groups, ["size"], "part", ["g"], "one", "rank")
    on = (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    hinted = F.broadcast(plan) if len(runs) * 40 < 32 << 20 else plan
    shard = F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))
    return ranked.join(hinted, on).select("g", F.col("size").alias("group_bytes"), shard.cast("long").alias("shard"))


def _rows(docs: DataFrame, group: Column | None = None) -> DataFrame:
    """doc_id, g (what names the row's group: 16 bytes of its text, or of the column `group`) and bytes of each row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), _name(text if group is None else group).alias("g"), F.octet_length(text).cast("long").alias("bytes"))


def _name(key: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(key.cast("string"), F.lit(""))))


def shards(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (doc_id, shard, bytes, group_bytes) for each row of docs.

    A group is all rows of one text, so that copies never part; its size is its UTF-8 bytes. Null and empty texts are
    one group of size 0. Shards count from 0; the rows of a shard have `capacity` bytes at most, but for a group that has
    more, which is alone in its shard. Equal sizes are taken by the text's md5, the lowest of equally tight shards is
    filled first. Repeated rows come each. A null doc_id stays null; an empty table gives no row. Columns other than
    doc_id and text are not read.
    """
    rows = stash(_rows(docs), "shard-rows")
    return rows.join(_assigned(rows, capacity), "g").select("doc_id", "shard", "bytes", "group_bytes")


def with_shard(docs: DataFrame, capacity: int = CAPACITY, group: Column | None = None) -> DataFrame:
    """docs, all columns, with the shard of each row as shard_id; a column of that name is replaced.

    Rows of the same text are a group, or those of the same value of `group`, of which null and "" are one. Otherwise as
    in shards().
    """
    key = docs["text"] if group is None else group
    assigned = _assigned(stash(_rows(docs, group).select("g", "bytes"), "shard-rows"), capacity).select(F.col("g").alias("__g"), F.col("shard").alias("__shard"))
    joined = docs.join(broadcast_if_small(assigned, 32), _name(key) == F.col("__g"))
    return joined.select(*(docs[c] for c in docs.columns if c != "shard_id"), F.col("__shard").alias("shard_id"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, md5(coalesce(text, '')) AS g, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes FROM documents
), groups AS (
  SELECT g, sum(bytes)::BIGINT AS size, row_number() OVER (ORDER BY sum(bytes) DESC, g) AS i FROM t GROUP BY g
), bfd(i, g, bin, rooms) AS (  -- one group a step; the room of a shard of its own is -1, as nothing may follow
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT s.i, s.g, CASE WHEN s.room IS NULL THEN len(s.rooms) ELSE list_position(s.rooms, s.room) - 1 END::BIGINT,
         CASE WHEN s.room IS NULL THEN list_append(s.rooms, greatest({CAPACITY} - s.size, -1))
              ELSE list_concat(list_append(s.rooms[:list_position(s.rooms, s.room) - 1], s.room - s.size), s.rooms[list_position(s.rooms, s.room) + 1:]) END
  FROM (SELECT n.i, n.g, n.size, b.rooms, list_min(list_filter(b.rooms, lambda x: x >= n.size)) AS room FROM bfd b JOIN groups n ON n.i = b.i + 1) s
)
SELECT t.doc_id, b.bin AS shard, t.bytes, n.size AS group_bytes FROM t JOIN groups n USING (g) JOIN bfd b USING (g)"""
