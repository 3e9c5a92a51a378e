"""Benchmark decontamination with a distributed positional inverted index.

build_index() stores the postings of every training token as sorted segments, each made by one task without a shuffle:
a row holds a term, a segment and the (document, position) lists. Lookups read the terms of the test items only. For
every window of n tokens of an item, the lists of its two rarest terms are adjusted by their offsets and intersected, and
for edited items those of as many of its rarest terms that two stand in every match; what remains is probed for all the
item's terms. A document with n consecutive tokens of an item is an exact match; one that has a large share of all the
item's tokens, each near its place, is a proximity match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphlode.llm import textkernel as tk
from graphlode.storage import BROADCAST_BYTES, broadcast_if_small, stash

N = 13
SLACK = 4
NEAR = 0.8
#: Of one segment of the index; what a task holds in memory follows from it.
SEGMENT_TOKENS = 500_000

_INDEX = "seg long, term long, n int, ords array<int>, places array<int>, doc_ids array<long>, c1 array<long>, c2 array<int>"


def _lists(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The index of doc_id, text as a stored table: below path, to be given to matches() again and again, or in the shared
    folder for as long as the driver runs. A segment's first row has no term but the keys of its documents."""
    text = docs["text"].cast("string")
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("c1"), F.hash(text).alias("c2"), text.alias("text"))
    names = ["seg", "term", "n", "ords", "places", "doc_ids", "c1", "c2"]

    def segment(seg: int, keys: list[pa.RecordBatch], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(keys)
        one = [pa.array([x], pa.list_(kind)) for x, kind in zip((c.to_pylist() for c in table.columns), (pa.int64(), pa.int64(), pa.int32()))]
        none = pa.nulls(1, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([seg]), pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), none, none, *one], names=names)
        h, ords, places = (np.concatenate([p[i] for p in parts]) for i in range(3))
        parts.clear()
        order = np.argsort(h, kind="stable")
        h = h[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        at = np.append(begin, len(h))
        ords, places = ords[order], places[order]
        for i in range(0, len(begin), 50_000):
            j = min(i + 50_000, len(begin))
            lo, hi = at[i], at[j]
            empty = [pa.nulls(j - i, pa.list_(kind)) for kind in (pa.int64(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(j - i, seg)), pa.array(tk.signed(h[at[i:j]])), pa.array(np.diff(at[i : j + 1]).astype(np.int32)), _lists(at[i : j + 1] - lo, ords[lo:hi]), _lists(at[i : j + 1] - lo, places[lo:hi]), *empty],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, keys, parts, docs_so_far, tokens = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for b in batches:
            for c in tk.chunks(b.column(3)):
                t = tk.tokenize(c)
                n = np.diff(t.at)
                ords = np.repeat(np.arange(docs_so_far, docs_so_far + len(n), dtype=np.int32), n)
                parts.append((t.hash, ords, (np.arange(len(t.hash)) - np.repeat(t.at[:-1], n)).astype(np.int32)))
                keys.append(b.select([0, 1, 2]).slice(c.first, len(n)))
                docs_so_far += len(n)
                tokens += len(t.hash)
                if tokens >= SEGMENT_TOKENS:
                    yield from segment(seg, keys, parts)
                    seg, keys, parts, docs_so_far, tokens = seg + 1, [], [], 0, 0
        if keys:
            yield from segment(seg, keys, parts)

    index = narrow.mapInArrow(run, _INDEX)
    if path is None:
        return stash(index, "token-index")
    index.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(index.schema).parquet(path)


def item_terms(items: DataFrame, least: int = 1) -> DataFrame:
    """(item, item_id, length, o, term): each token of each item of at least `least` tokens; equal rows are one item."""
    text = items["text"].cast("string")
    narrow = items.select(items["item_id"].cast("long").alias("item_id"), text.alias("text")).where("text IS NOT NULL").distinct()
    narrow = narrow.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(2)):
                t = tk.tokenize(c)
                n = np.diff(t.at)
                keep = np.repeat(n >= least, n)
                take = pa.array(np.repeat(np.arange(len(n)), n)[keep] + c.first)
                o = (np.arange(len(t.hash)) - np.repeat(t.at[:-1], n))[keep]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.repeat(n, n)[keep].astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(tk.signed(t.hash[keep]))], names=["item", "item_id", "length", "o", "term"])

    return narrow.mapInArrow(run, "item long, item_id long, length int, o int, term long")


def _rarest_pairs(known: DataFrame, n: int) -> DataFrame:
    """(item, t1, o1, t2, o2): the rarest and the second rarest token of every n-gram of each item (of a shorter item as
    a whole), by occurrences in the index. N-grams with a term that the index lacks are in no document and left out."""
    ahead = Window.partitionBy("item").orderBy("o").rowsBetween(0, n - 1)
    gram = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "o", "term")).over(ahead))
    grams = known.select("item", "o", F.greatest(F.col("length") - n, F.lit(0)).alias("last"), gram.alias("g")).where("o <= last AND g[0].often > 0")
    return grams.select("item", F.col("g")[0]["term"].alias("t1"), F.col("g")[0]["o"].alias("o1"), F.expr("g[least(1, size(g) - 1)].term").alias("t2"), F.expr("g[least(1, size(g) - 1)].o").alias("o2")).distinct()


def _needed(near: float) -> Column:
    return F.greatest(F.ceil(F.col("length") * F.lit(near)), F.lit(1)).cast("int")


def _scarce(known: DataFrame, near: float) -> DataFrame:
    """(item, term, o): so many of each item's rarest tokens that two stand in every proximity match (one if one is enough).

    A match may lack length - needed tokens, those that the index lacks among them; of two more than the others, two are met.
    """
    whole = Window.partitionBy("item")
    spare = F.col("length") - _needed(near) - F.count(F.when(F.col("often").isNull(), 1)).over(whole)
    ranked = known.select("item", "term", "o", "often", spare.alias("spare"), _needed(near).alias("needed")).where("often IS NOT NULL AND spare >= 0")
    rank = F.row_number().over(whole.orderBy("often", "o"))
    return ranked.withColumn("rank", rank).where("rank <= spare + least(2, needed)").select("item", "term", "o")


def _candidates(pairs: DataFrame, scarce: DataFrame, items: DataFrame, index: DataFrame, n: int, near: float) -> DataFrame:
    """(item, seg, ord, lo, hi): where an item's start may be in a document, with all that counts for it.

    A proximity match has two of the scarce tokens within SLACK of one start; it lies around the first of them. Where the
    rarest two of an n-gram have the very same start, the whole document is wanted. `one`: a single token may be enough.
    """
    anchors = pairs.select("item", F.col("t1").alias("term"), F.col("o1").alias("o")).union(pairs.select("item", "t2", "o2")).union(scarce.select("item", "term", "o")).distinct()
    single = items.select("item", ((_needed(near) <= 1) | F.lit(n == 1)).alias("one"))
    anchors = stash(anchors.join(broadcast_if_small(single, 17), "item"), "anchors")
    rows = index.select("seg", "term", "ords", "places").join(broadcast_if_small(anchors.select("term").distinct(), 8), "term")
    postings = rows.select("seg", "term", F.explode(F.arrays_zip("ords", "places")).alias("p")).select("seg", "term", "p.ords", "p.places")
    hits = postings.join(broadcast_if_small(anchors, 24), "term").select("item", "one", "seg", F.col("ords").alias("ord"), "o", (F.col("places") - F.col("o")).alias("diag"))
    per_doc = hits.groupBy("item", "one", "seg", "ord").agg(F.sort_array(F.collect_set(F.struct("diag", "o"))).alias("hits"))
    # If two hits of different tokens are close, so are two that follow one another.
    close = f"filter(transform(hits, (a, i) -> IF(i > 0, IF(hits[i - 1].o <> a.o AND a.diag - hits[i - 1].diag <= {2 * SLACK}, hits[i - 1].diag, NULL), NULL)), d -> d IS NOT NULL)"
    starts = F.when(F.col("one"), F.expr("transform(hits, a -> a.diag)")).otherwise(F.expr(close))
    met = per_doc.withColumn("starts", F.array_distinct(starts)).where("size(starts) > 0")
    lists = pairs.groupBy("item").agg(F.collect_set(F.struct("o1", "o2")).alias("pairs"))  # as many as the item has n-grams
    most = BROADCAST_BYTES // 64
    both = met.join(F.broadcast(lists) if pairs.limit(most + 1).count() <= most else lists, "item", "left")
    whole = F.expr("coalesce(exists(hits, a -> exists(pairs, p -> p.o1 = a.o AND exists(hits, b -> b.o = p.o2 AND b.diag = a.diag))), false)")
    span = F.when(whole, F.expr("array(struct(-2147483648 AS lo, 2147483647 AS hi))")).otherwise(F.expr(f"transform(starts, d -> struct(d - {2 * SLACK} AS lo, d + {2 * SLACK} AS hi))"))
    return both.select("item", "seg", "ord", F.explode(span).alias("x")).select("item", "seg", "ord", "x.lo", "x.hi")


def _probed(candidates: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(item, seg, ord, o, diag): where the tokens of a candidate's item stand in the document, from lo to hi."""
    probes = candidates.join(broadcast_if_small(terms.select("item", "o", "term"), 24), "item")
    packed = probes.groupBy("seg", "term").agg(F.collect_list(F.struct("item", "ord", "lo", "hi", "o")).alias("probes"))
    packed = stash(packed, "probes")
    size = packed.agg(F.sum(F.size("probes") * 24 + 40)).first()[0] or 0
    rows = index.where("term IS NOT NULL").select("seg", "term", "ords", "places")
    joined = rows.join(F.broadcast(packed) if size < 32 << 20 else packed, ["seg", "term"]).select("seg", "ords", "places", "probes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                seg = b.column(0)[i].as_py()
                key = (b.column(1)[i].values.to_numpy().astype(np.int64) << 32) | b.column(2)[i].values.to_numpy()
                p = b.column(3)[i].values
                item, doc, lo, hi, o = (p.field(x).to_numpy().astype(np.int64) for x in range(5))
                first = np.searchsorted(key, (doc << 32) + np.maximum(lo + o, 0))
                n = np.maximum(np.searchsorted(key, (doc << 32) + np.minimum(hi + o, (1 << 31) - 1), side="right") - first, 0)
                which = np.repeat(np.arange(len(o)), n)
                at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
                diag = (key[at] & 0xFFFFFFFF) - o[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[which]), pa.array(np.full(len(which), seg)), *(pa.array(x.astype(np.int32)) for x in (doc[which], o[which], diag))],
                    names=["item", "seg", "ord", "o", "diag"],
                )

    return joined.mapInArrow(run, "item long, seg long, ord int, o int, diag int")


def _counted(hits: DataFrame) -> DataFrame:
    """hits: (item, item_id, length, seg, ord, hits array of diag, o in order). In its place: run, doc_pos, item_pos of
    the longest run, the first of equal ones, and near, the most tokens within SLACK of a start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(5)
            g = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            d, o = (flat.field(x).to_numpy().astype(np.int64) for x in range(2))
            # Hits are in order of group, diag and o: a run goes on while only o grows, by one.
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (o[1:] != o[:-1] + 1)])[: len(g)]
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(g)))
            order = np.lexsort((o[at], (d + o)[at], -length, g[at]))
            best = order[np.searchsorted(g[at][order], np.arange(b.num_rows))]
            # A hit counts for each start that another hit, or itself, has within SLACK of it.
            start = (g << 33) + d + (1 << 32)
            starts = np.unique(start)
            pair = []
            for s in range(-SLACK, SLACK + 1):
                i = np.minimum(np.searchsorted(starts, start + s), len(starts) - 1)
                there = starts[i] == start + s
                pair.append((i[there] << 32) | o[there])
            per_start = np.bincount(np.unique(np.concatenate(pair)) >> 32, minlength=len(starts))
            near = np.zeros(b.num_rows, dtype=np.int64)
            np.maximum.at(near, starts >> 33, per_start)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], *(pa.array(x.astype(np.int32)) for x in (length[best], (d + o)[at][best], o[at][best], near))],
                names=["item", "item_id", "length", "seg", "ord", "run", "doc_pos", "item_pos", "near"],
            )

    return hits.mapInArrow(run, "item long, item_id long, length int, seg long, ord int, run int, doc_pos int, item_pos int, near int")


def _judged(index: DataFrame, items: DataFrame, n: int, near: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(matches by item, seg and ord; the documents' keys by seg and ord)."""
    terms = stash(item_terms(items, least), "item-terms")
    lengths = stash(terms.select("item", "item_id", "length").distinct(), "items")
    wanted = broadcast_if_small(terms.select("term").distinct(), 8)
    often = index.where("term IS NOT NULL").select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("often"))
    known = stash(terms.join(often, "term", "left"), "item-terms-often")
    pairs = stash(_rarest_pairs(known, n), "rarest-pairs")
    hits = _probed(_candidates(pairs, _scarce(known, near), lengths, index, n, near), terms, index)
    per_doc = hits.groupBy("item", "seg", "ord").agg(F.sort_array(F.collect_set(F.struct("diag", "o"))).alias("hits"))
    whole = F.least(F.lit(n), F.col("length"))
    enough = per_doc.join(broadcast_if_small(lengths, 20), "item").where(F.size(F.array_distinct("hits.o")) >= F.least(whole, _needed(near)))
    counted = _counted(enough.select("item", "item_id", "length", "seg", "ord", "hits"))
    exact = F.col("run") >= whole
    kind = F.when(exact, "exact").when(F.col("near") >= _needed(near), "proximity")
    found = counted.select("item", "item_id", "seg", "ord", kind.alias("kind"), F.when(exact, F.col("run")).otherwise(0).alias("run"), F.when(exact, F.col("doc_pos")).alias("doc_pos"), F.when(exact, F.col("item_pos")).alias("item_pos"), "near").where("kind IS NOT NULL")
    # Else Spark would go through the index once more for every count of these few rows.
    found = stash(found, "matches")
    keys = index.where("term IS NULL").select("seg", F.posexplode(F.arrays_zip("doc_ids", "c1", "c2")).alias("ord", "k")).select("seg", "ord", F.col("k.doc_ids").alias("doc_id"), "k.c1", "k.c2")
    return found, keys


def matches(docs: DataFrame | None, items: DataFrame, n: int = N, near: float = NEAR, least: int = 1, index: DataFrame | None = None) -> DataFrame:
    """One row (item_id, doc_id, kind, run, doc_pos, item_pos, near) for each item that a document holds.

    kind is exact if the document has n consecutive tokens of the item (all of an item of fewer), else proximity if at
    least the share `near` of the item's tokens stand within SLACK of their places from a start that one of them has. run,
    doc_pos and item_pos tell the longest run of the former, the first in the document of equal ones; near counts the
    latter, the most from any start.
    Tokens, positions from 0, are runs of letters and digits in lower case. Null and empty texts match nothing, nor do
    items of fewer than `least` tokens; by default all items count, one of a single word is in every document with that
    word. Repeated documents and items give repeated findings once. Null ids stay null. Empty tables give no row.
    index: what build_index() made of the documents, if that is at hand; docs are then not read.
    """
    found, keys = _judged(build_index(docs) if index is None else index, items, n, near, least)
    named = keys.join(broadcast_if_small(found, 64), ["seg", "ord"])
    return named.select("item_id", "doc_id", "kind", "run", "doc_pos", "item_pos", "near").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = N, near: float = NEAR, least: int = 1) -> DataFrame:
    """docs, all columns, without the rows that match an item: see matches(). Null and empty texts stay."""
    found, keys = _judged(build_index(docs), items, n, near, least)
    named = keys.join(broadcast_if_small(found.select("seg", "ord").distinct(), 16), ["seg", "ord"])
    named = stash(named.select(F.col("doc_id").alias("__id"), F.col("c1").alias("__c1"), F.col("c2").alias("__c2")).distinct(), "contaminated")
    text = docs["text"].cast("string")
    on = [docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), F.xxhash64(text) == F.col("__c1"), F.hash(text) == F.col("__c2")]
    return docs.join(broadcast_if_small(named, 24), on, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = f"""
WITH dt AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term,
         generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 1)::INT - 1 AS p
  FROM documents
), it AS (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term,
         generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 1)::INT - 1 AS o,
         len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))::INT AS length
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), pairs AS (  -- every term of an item at its diagonal in a document
  SELECT i.item_id, i.length, i.o, d.doc_id, d.p - i.o AS diag, d.p FROM it i JOIN dt d USING (term)
), runs AS (
  SELECT item_id, length, doc_id, diag, o, o - row_number() OVER (PARTITION BY item_id, doc_id, diag ORDER BY o) AS r FROM pairs
), exact AS (
  SELECT item_id, doc_id, length, diag, count(*)::INT AS run, min(o) AS o FROM runs GROUP BY item_id, doc_id, length, diag, r
  HAVING count(*) >= least({N}, length)
), best AS (
  SELECT item_id, doc_id, max(run) AS run, arg_min(diag + o, (-run::BIGINT) * 1000000000 + diag + o) AS doc_pos,
         arg_min(o, ((-run::BIGINT) * 1000000000 + diag + o) * 100000 + o) AS item_pos
  FROM exact GROUP BY item_id, doc_id
), enough AS (  -- of documents with fewer of an item's tokens, none can match
  SELECT item_id, doc_id FROM pairs GROUP BY item_id, doc_id, length HAVING count(DISTINCT o) >= least({N}, ceil(length * {NEAR}))
), few AS (SELECT p.* FROM pairs p SEMI JOIN enough e ON e.item_id = p.item_id AND e.doc_id = p.doc_id
), near AS (  -- a start is where any token has it; a token counts for the starts within {SLACK} of its own
  SELECT item_id, doc_id, length, max(near)::INT AS near FROM (
    SELECT s.item_id, s.doc_id, s.diag, s.length, count(DISTINCT p.o) AS near
    FROM (SELECT DISTINCT item_id, doc_id, length, diag, diag + unnest(range(-{SLACK}, {SLACK + 1})) AS at FROM few) s
    JOIN few p ON p.item_id = s.item_id AND p.doc_id = s.doc_id AND p.diag = s.at
    GROUP BY ALL) GROUP BY item_id, doc_id, length
)
SELECT n.item_id, n.doc_id, CASE WHEN b.run IS NOT NULL THEN 'exact' ELSE 'proximity' END AS kind,
       coalesce(b.run, 0)::INT AS run, b.doc_pos::INT AS doc_pos, b.item_pos::INT AS item_pos, n.near
FROM near n LEFT JOIN best b USING (item_id, doc_id)
WHERE b.run IS NOT NULL OR n.near >= ceil(n.length * {NEAR})"""
