"""Mixing sources to target weights by a low-discrepancy schedule.

The golden-ratio sequence, in integers modulo 2**32, is mapped through the sources' cumulative weights: slot t belongs
to the source whose interval has point t, so any stretch of slots follows the weights closely. Each source's documents
are shuffled by a hash and cut into blocks of equal numbers of tokens; its k-th slot takes its k-th block, and starts
over (another epoch) when it has none left, at most MAX_EPOCHS times in all. The schedule ends when every full block has
had a slot; what has had none by then, such as the single short block of a small source, comes once in a slot after it.
So there are no more than MAX_EPOCHS rows for a row, and none for nothing.

A source's slots are found without those of the others: how many points of the first t lie in an interval is a sum of
floors, and the way from one such point to the next has one of three lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphlode.functions.prefix import running
from graphlode.storage import broadcast_if_small, stash

BLOCK_TOKENS = 1 << 15
MAX_EPOCHS = 4
SEED = "mix-1"
#: floor(2**32 / golden ratio); odd, so that the sequence has period 2**32. Point t is (t * GOLDEN + SHIFT) modulo M.
GOLDEN, SHIFT, M = 2654435769, 1 << 31, 1 << 32
_CHUNK = 1 << 16


# -- the points of one interval


def floor_sum(n: int, a: int, b: int) -> int:
    """The sum of (a * i + b) // M over i = 0 .. n - 1, in O(log M) steps."""
    total, m = 0, M
    while n > 0:
        total += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        if top < m:
            break
        n, b, m, a = top // m, top % m, a, m
    return total


def visits(lo: int, hi: int, t: int) -> int:
    """How many of the points 0 .. t - 1 are in lo .. hi - 1."""
    return floor_sum(t, GOLDEN, SHIFT + M - lo) - floor_sum(t, GOLDEN, SHIFT + M - hi)


def visit(lo: int, hi: int, k: int) -> int:
    """The slot of visit k, from 0, to lo .. hi - 1."""
    width = hi - lo
    low, high = max(0, (k - 64) * M // width - 1), (k + 64) * M // width + M
    while low < high:  # the least t by which there have been k + 1 visits
        mid = (low + high) // 2
        if visits(lo, hi, mid) > k:
            high = mid
        else:
            low = mid + 1
    return low - 1


def steps(width: int) -> tuple[int, int, int, int]:
    """(q1, d1, q2, d2): after q1 slots a point is d1 further, after q2 it is d2 back; the least of each that stay in width."""
    q1, d1, q2, d2 = 1, GOLDEN, 1, M - GOLDEN
    while (d1 >= width or d2 >= width) and d1 != d2:
        if d1 > d2:
            q1, d1 = q1 + q2, d1 - d2
        else:
            q2, d2 = q1 + q2, d2 - d1
    return q1, d1, q2, d2


def slots_of(lo: int, hi: int, first: int, n: int) -> list[int]:
    """The slots of visits first .. first + n - 1."""
    q1, d1, q2, d2 = steps(hi - lo)
    t, out = visit(lo, hi, first), []
    u = (t * GOLDEN + SHIFT) % M
    ahead, back = hi - d1, lo + d2
    for _ in range(n):
        out.append(t)
        if u < ahead:
            t, u = t + q1, u + d1
        elif u >= back:
            t, u = t + q2, u - d2
        else:
            t, u = t + q1 + q2, u + d1 - d2
    return out


# -- documents and sources


def _keys(docs: DataFrame) -> list[Column]:
    """What tells a document: source, doc_id, and its text by two hashes."""
    text = docs["text"].cast("string")
    return [docs["source"].cast("string").alias("source"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("c1"), F.hash(text).alias("c2")]


def _rows(docs: DataFrame) -> DataFrame:
    """source, doc_id, c1, c2, tokens, copies, key and bucket of each document; equal ones are one row."""
    tokens = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).cast("long")
    per = docs.select(*_keys(docs), tokens.alias("tokens")).groupBy("source", "doc_id", "c1", "c2").agg(F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return per.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))


def _sources(rows: DataFrame, weights: dict[str, float] | None, block_tokens: int) -> DataFrame:
    """source, blocks, full (blocks that are), its interval lo <= point < hi of 0 .. M, key and bucket. One row a source."""
    per = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"))
    if weights is None:
        share = F.floor(F.sqrt(F.col("n") * F.sqrt(F.col("n").cast("double"))) * 1024) + 1
    else:
        least = min(w for w in weights.values() if w > 0)
        given = {k: round(w / least * 4096) for k, w in weights.items() if w > 0}
        share = F.create_map(*(F.lit(x) for kv in given.items() for x in kv))[F.col("source")]
    key = F.md5(F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens)).cast("long")
    per = per.select("source", share.cast("long").alias("w"), blocks.alias("blocks"), F.floor(F.col("n") / block_tokens).cast("long").alias("full"), key.alias("key")).where("w > 0")
    per = stash(per.withColumn("bucket", F.substring("key", 1, 3)), "mix-weights")
    total = per.agg(F.sum("w")).first()[0] or 1
    cut_at = f"cast(floor(cast({{}} AS double) / cast({total} AS double) * {M}) AS bigint)"
    return running(per, [], "bucket", ["key"], "w", "before").selectExpr("source", "blocks", "full", f"{cut_at.format('before')} AS lo", f"{cut_at.format('(before + w)')} AS hi", "key", "bucket")


def schedule(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(slot, source, block, epoch) of a stored table of sources; slots that no block takes are left out."""

    def last_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([visit(lo, hi, n - 1) for lo, hi, n in zip(*(c.to_pylist() for c in b.columns))], pa.int64())], names=["slot"])

    # A slot number is below blocks * M / width: 2**63 is far.
    end = sources.where("full > 0 AND hi > lo").select("lo", "hi", "full").mapInArrow(last_full, "slot long").agg(F.max("slot")).first()[0]
    end = -1 if end is None else end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, blocks = (b.column(i).to_pylist() for i in (1, 2, 3))
            n = [min(visits(x, y, end + 1), max_epochs * k) if y > x else 0 for x, y, k in zip(lo, hi, blocks)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=["source", "lo", "hi", "blocks", "key", "bucket", "drawn"])

    drawn = stash(sources.select("source", "lo", "hi", "blocks", "key", "bucket").mapInArrow(count, "source string, lo long, hi long, blocks long, key string, bucket string, drawn long"), "mix-drawn")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, lo, hi, blocks, k, n in zip(*(c.to_pylist() for c in b.columns)):
                slots = slots_of(lo, hi, k, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots, pa.int64()), pa.array([source] * n, pa.string()), pa.array([i % blocks for i in range(k, k + n)], pa.int64()), pa.array([i // blocks for i in range(k, k + n)], pa.int64())], names=["slot", "source", "block", "epoch"]
                )

    parts = drawn.where("drawn > 0").select("source", "lo", "hi", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1, F.lit(_CHUNK).cast("long"))).alias("k"), "drawn")
    parts = parts.select("source", "lo", "hi", "blocks", "k", F.least(F.lit(_CHUNK), F.col("drawn") - F.col("k")).alias("n"))
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_points = parts.repartition(tasks, "source", "k").mapInArrow(expand, "slot long, source string, block long, epoch long")
    late = drawn.withColumn("late", F.greatest(F.col("blocks") - F.col("drawn"), F.lit(0).cast("long")))
    late = running(late, [], "bucket", ["key"], "late", "before").where("late > 0")
    late = late.select("source", "before", "drawn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("late") - 1)).alias("i"))
    return by_points.unionByName(late.select((F.lit(end + 1) + F.col("before") + F.col("i")).alias("slot"), "source", (F.col("drawn") + F.col("i")).alias("block"), F.lit(0).cast("long").alias("epoch")))


def _placed(docs: DataFrame, weights: dict[str, float] | None, block_tokens: int, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """(documents with start and block; the schedule), of the sources that have a weight."""
    rows = stash(_rows(docs).withColumn("total", F.col("tokens") * F.col("copies")), "mix-rows")
    sources = stash(_sources(rows, weights, block_tokens), "mix-sources")
    slots = stash(schedule(sources, max_epochs), "mix-slots")
    placed = running(rows, ["source"], "bucket", ["key", "c1", "c2"], "total", "start")
    blocks = broadcast_if_small(sources.select(F.col("source").alias("s"), "blocks"), 64)
    placed = placed.join(blocks, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.least(F.floor(F.col("start") / block_tokens), F.col("blocks") - 1).cast("long"))
    return placed.select("source", "doc_id", "c1", "c2", "tokens", "copies", "start", "block"), slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "slot", "epoch")


def _same_block() -> Column:
    return F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row (slot, source, block, epoch, doc_id, tokens, start) for each document in each of its block's slots.

    weights: source -> target share; without them a source's share is as its tokens ** 0.75, which lifts small ones.
    Sources that given weights leave out, or give 0, have no slot; every document of the others comes at least once and
    at most max_epochs times. A null source is a source of its own. tokens counts runs of letters and digits, 0 for null
    and empty texts, whose rows stand in the block where they fall; start is the number of the source's tokens before the
    document in shuffled order. A document is in the block in which it starts. Rows that repeat source, doc_id and text
    stand together and come each. A source without tokens, or too small for a full block, has its block once if the
    schedule is over before its slot. Slots that no block takes are missing numbers. An empty table gives no row.
    """
    placed, slots = _placed(docs, weights, block_tokens, max_epochs)
    joined = placed.join(broadcast_if_small(slots, 64), _same_block())
    each = joined.select("slot", "source", "block", "epoch", "doc_id", "tokens", "start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.drop("copy")


def _with_slots(docs: DataFrame, keyed: DataFrame, weights: dict[str, float] | None, block_tokens: int, max_epochs: int) -> DataFrame:
    """keyed, with the slots of each row's document in order as __slots. docs are the documents to place."""
    placed, slots = _placed(docs, weights, block_tokens, max_epochs)
    lists = slots.groupBy("s", "b").agg(F.sort_array(F.collect_list("slot")).alias("__slots"))  # max_epochs at most
    at = placed.join(broadcast_if_small(lists, 96), _same_block()).select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("c1").alias("__1"), F.col("c2").alias("__2"), "__slots")
    on = [k.eqNullSafe(F.col(n)) for k, n in zip(_keys(keyed), ("__s", "__d", "__1", "__2"))]
    return keyed.join(broadcast_if_small(stash(at, "mix-places"), 128), on).drop("__s", "__d", "__1", "__2")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs, all columns, each row as often as its block has slots: see mixture()."""
    return _with_slots(docs, docs, weights, block_tokens, max_epochs).withColumn("__slot", F.explode("__slots")).select(*docs.columns)


def with_slot(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What mix() returned, all columns, with the slot of each row; a column of that name is replaced.

    The schedule follows from the documents, so that of the distinct ones is the one they were repeated by, and equal
    rows take its slots in turn. Rows that mix() was given repeatedly share slots.
    """
    plain = docs.drop("slot")
    each = plain.groupBy(*plain.columns).agg(F.count("*").alias("__n"))
    found = _with_slots(plain.distinct(), each, weights, block_tokens, max_epochs)
    every = found.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return every.withColumn("slot", F.get("__slots", (F.col("__i") % F.size("__slots")).cast("int"))).drop("__n", "__i", "__slots")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH r AS (
  SELECT source, doc_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS tokens, md5('{SEED}:' || doc_id) AS key FROM documents
), per AS (
  SELECT source, md5(coalesce('s:' || source, 'null')) AS key, floor(sqrt(sum(tokens)::BIGINT * sqrt(sum(tokens)::DOUBLE)) * 1024)::BIGINT + 1 AS w,
         greatest(1, ceil(sum(tokens)::DOUBLE / {BLOCK_TOKENS}))::BIGINT AS blocks, (sum(tokens) // {BLOCK_TOKENS})::BIGINT AS full_blocks FROM r GROUP BY source
), sums AS (
  SELECT *, (sum(w) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING))::BIGINT AS c, (sum(w) OVER ())::BIGINT AS total FROM per
), src AS (
  SELECT source, key, blocks, full_blocks, floor((c - w)::DOUBLE / total::DOUBLE * {M})::BIGINT AS lo, floor(c::DOUBLE / total::DOUBLE * {M})::BIGINT AS hi FROM sums
), slots AS (  -- as many as let every full block have one
  SELECT t AS slot, (t * {GOLDEN} + {SHIFT}) % {M} AS u
  FROM range((SELECT coalesce(max((full_blocks + 8) * {M}.0 / (hi - lo)), 0)::BIGINT + 65 FROM src WHERE full_blocks > 0 AND hi > lo)) x(t)
), ranked AS (
  SELECT slot, source, key, blocks, full_blocks, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS k FROM slots JOIN src ON u >= lo AND u < hi
), last AS (SELECT coalesce(max(slot), -1) AS slot FROM ranked WHERE k = full_blocks - 1
), drawn AS (
  SELECT slot, source, k % blocks AS block, k // blocks AS epoch FROM ranked WHERE slot <= (SELECT slot FROM last) AND k < {MAX_EPOCHS} * blocks
), late AS (
  SELECT (SELECT slot FROM last) + row_number() OVER (ORDER BY key, b) AS slot, source, b AS block, 0 AS epoch
  FROM (SELECT source, key, unnest(range(blocks)) AS b FROM src) x
  WHERE NOT EXISTS (SELECT 1 FROM drawn d WHERE d.source IS NOT DISTINCT FROM x.source AND d.block = x.b)
), plan AS (SELECT * FROM drawn UNION ALL SELECT * FROM late
), placed AS (
  SELECT source, doc_id, tokens, (sum(tokens) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING))::BIGINT - tokens AS start FROM r
)
SELECT slot, p.source, block, epoch, doc_id, tokens, start
FROM placed p JOIN src s ON p.source IS NOT DISTINCT FROM s.source JOIN plan n ON n.source IS NOT DISTINCT FROM p.source
WHERE block = least(start // {BLOCK_TOKENS}, blocks - 1)"""
