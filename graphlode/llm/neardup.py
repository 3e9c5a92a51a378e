"""Near-duplicate groups by SuperMinHash.

A text's elements are its shingles of three tokens (a shorter text is one shingle). Each element draws its own random
permutation of the signature's components step by step; the value it offers to the component at rank j is j plus a
fraction. Component ranks of one element are thus correlated, which lowers the variance below that of independent
hashes, and a document stops at the step that no component can gain from: after one or two of 128 for most texts.

Equal signatures are one node. Nodes that agree on all rows of a band are candidates; candidates are verified on the
whole signature (an estimate of the similarity with an error of some 0.04), and verified pairs are grouped by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphlode.llm import textkernel as tk
from graphlode.storage import broadcast_if_small, cut, release, stash

SIZE = 128
BANDS = 32
SHINGLE = 3
THRESHOLD = 0.5
#: A pair is taken as verified from so much below the threshold, for the signature's error.
MARGIN = 0.05
#: Nodes of a band that one task compares; more of them are compared in parts.
LIST = 2048

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def shingles(t: tk.Tokens, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document in the chunk, element); repeated elements are left in, as they change no minimum."""
    n = np.diff(t.at)
    inner = np.maximum(n - size + 1, 0)
    h = tk.window_hashes(t.hash, size)
    docs, elements = [np.repeat(np.arange(len(n)), inner)], [h[tk.ranges(t.at[:-1], inner)]]
    for i in np.flatnonzero((n > 0) & (n < size)):
        docs.append(np.array([i]))
        elements.append(tk.window_hashes(t.hash[t.at[i] : t.at[i + 1]], int(n[i])))
    return np.concatenate(docs), np.concatenate(elements)


def superminhash(owner: np.ndarray, element: np.ndarray, docs: int, size: int = SIZE) -> np.ndarray:
    """docs x size signature components: rank in the upper, fraction in the lower 32 bits; all ones without an element."""
    sig = np.full(docs * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    drawn: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for j in range(size):
            if not len(owner):
                break
            r = tk.mix(element + np.uint64(j + 1) * _STEP)
            k = (np.uint64(j) + (((r >> _HALF) * np.uint64(size - j)) >> _HALF)).astype(np.int64)
            place = k.copy()  # of a Fisher-Yates shuffle after j swaps, followed back through the swaps
            for i in range(j - 1, -1, -1):
                place[drawn[i] == place] = i
            np.minimum.at(sig, owner * size + place, (np.uint64(j) << _HALF) | (r & _LOW))
            drawn.append(k)
            most = sig.reshape(docs, size).max(axis=1) >> _HALF
            go = (most > np.uint64(j))[owner]
            if not go.all():
                owner, element, drawn = owner[go], element[go], [d[go] for d in drawn]
    return sig.reshape(docs, size)


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    with np.errstate(over="ignore"):
        part = sig.reshape(len(sig), bands, rows)
        h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _STEP
        h = np.repeat(h, len(sig), axis=0)
        for i in range(rows):
            h = tk.mix(h * _STEP + part[:, :, i])
    return h


def least_matches(threshold: float, size: int = SIZE) -> int:
    """Of components equal in their last byte, for an estimated similarity of threshold - MARGIN."""
    share = threshold - MARGIN
    return int(np.ceil(size * (share + (1 - share) / 256)))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, node, sig, bands) for each row with a token; c1 and c2 tell its text, node its full signature."""
    text = docs["text"].cast("string")
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("c1"), F.hash(text).alias("c2"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in tk.chunks(b.column(3)):
                owner, element = shingles(tk.tokenize(c))
                sig = superminhash(owner, element, len(c.at) - 1)
                has = np.flatnonzero(sig[:, 0] != np.uint64(0xFFFFFFFFFFFFFFFF))
                if not len(has):
                    continue
                sig = sig[has]
                bands = band_hashes(sig)
                node = band_hashes(bands, 1)[:, 0]
                low = np.ascontiguousarray((sig & np.uint64(255)).astype(np.uint8))
                take = pa.array(has + c.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).take(take) for i in range(3)),
                        pa.array(tk.signed(node)),
                        pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(np.arange(len(has) + 1, dtype=np.int32) * SIZE), pa.py_buffer(low)]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(tk.signed(bands.ravel()))),
                    ],
                    names=["doc_id", "c1", "c2", "node", "sig", "bands"],
                )

    return narrow.mapInArrow(run, "doc_id long, c1 long, c2 int, node long, sig binary, bands array<long>")


def spanning_pairs(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs that verify and join the same rows as all verifying pairs would: each row that is reached is compared with
    all that are not reached yet, so dense groups cost one pass."""
    left, pairs = np.arange(1, len(sig)), []
    reached = [0]
    while len(left):
        if reached:
            i = reached.pop()
        else:
            i, left = int(left[0]), left[1:]
        hit = (sig[left] == sig[i]).sum(axis=1) >= least
        found = left[hit]
        pairs += [(i, int(j)) for j in found]
        reached += found.tolist()
        left = left[~hit]
    return pairs


def _parts_of_crowded(rows: DataFrame, crowded: DataFrame, sigs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(parts (list, node) for comparison, edges (a, b)) of bands with more than LIST nodes.

    rows: (band, node); crowded: (band, n, leader). Every node is compared with its band's leader: those that verify are
    linked by it. The others, few where a band is crowded with copies, have to be compared with all: so each part is a
    slice of them together with a slice of all, and no pair but those that the leader links is left out.
    """
    led = rows.join(broadcast_if_small(crowded, 24), "band").where("node <> leader").join(sigs, "node")
    leaders = stash(sigs.join(crowded.select(F.col("leader").alias("node")).distinct(), "node").select(F.col("node").alias("leader"), F.col("sig").alias("leads")), "near-leaders")
    led = led.join(broadcast_if_small(leaders, 16 + SIZE), "leader")

    def same(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.as_buffer() for v in side), dtype=np.uint8).reshape(-1, SIZE) for side in (a, b))
        return pa.array((x == y).sum(axis=1) >= least)

    judged = stash(led.select("band", "n", "leader", "node", F.arrow_udf(same, "boolean")("sig", "leads").alias("same")), "near-crowded")
    edges = judged.where("same").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    apart = judged.where("NOT same").select("band", "node")
    slices = judged.groupBy("band").agg(F.count("*").alias("n"), F.count(F.when(~F.col("same"), 1)).alias("m")).where("m > 0")
    slices = slices.select("band", F.ceil(F.col("n") * 2 / LIST).alias("all"), F.ceil(F.col("m") * 2 / LIST).alias("some"))
    slices = broadcast_if_small(stash(slices, "near-slices"), 24)

    def at(of: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(of)), F.col(of))

    def numbers(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    few = apart.join(slices, "band").select("band", "node", at("some").alias("u"), numbers("all").alias("v"))
    every = judged.join(slices, "band").select("band", "node", at("all").alias("v"), numbers("some").alias("u"))
    parts = few.unionByName(every).select(F.xxhash64("band", "u", "v").alias("list"), "node").distinct()
    return parts, edges


def verified_edges(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), nodes: enough verified pairs to group what all verified candidates would group."""
    least = least_matches(threshold)
    nodes = stash(signed.groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "near-nodes")
    rows, sigs = nodes.select("node", F.explode("bands").alias("band")), nodes.select("node", "sig")
    shared = stash(rows.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1"), "near-bands")
    crowded = shared.where(F.col("n") > LIST)
    lists = (
        rows.join(shared.where(F.col("n") <= LIST).select("band"), "band")
        .groupBy("band")
        .agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        .select("nodes")
        .distinct()  # the copies of one text meet in many bands; each set of candidates is verified once
    )
    members = lists.select(F.xxhash64("nodes").alias("list"), F.explode("nodes").alias("node"))
    linked = None
    if not crowded.isEmpty():
        parts, linked = _parts_of_crowded(rows, crowded, sigs, least)
        members = members.unionByName(parts)
    packed = members.join(sigs, "node").groupBy("list").agg(F.collect_list("node").alias("nodes"), F.collect_list("sig").alias("sigs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, sig = b.column(0), b.column(1)
            at = node.offsets.to_numpy() - node.offsets[0].as_py()
            ids = node.flatten().to_numpy()
            flat = sig.flatten()
            data = np.frombuffer(flat.buffers()[2], dtype=np.uint8)
            first = int(np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset])
            data = data[first : first + len(ids) * SIZE].reshape(-1, SIZE)
            size = np.diff(at)
            two = at[:-1][size == 2]
            good = two[(data[two] == data[two + 1]).sum(axis=1) >= least]
            a, c = [ids[good]], [ids[good + 1]]
            for i in np.flatnonzero(size > 2):
                pairs = np.array(spanning_pairs(data[at[i] : at[i + 1]], least), dtype=np.int64).reshape(-1, 2) + at[i]
                a.append(ids[pairs[:, 0]])
                c.append(ids[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "b"])

    edges = packed.select("nodes", "sigs").mapInArrow(run, "a long, b long")
    return (edges if linked is None else edges.unionByName(linked)).distinct()


def _local_union_find(edges: DataFrame) -> DataFrame:
    """The same groups in fewer pairs: each partition's pairs by way of union-find become (node, its smallest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label) of every node with an edge (a, b); label is the smallest node it is connected with.

    Union-find inside each partition, then alternating large-star and small-star rounds between partitions, each cut by
    a stored table, until nothing moves. Nothing is gathered on the driver.
    """
    e = cut(_local_union_find(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")))
    before, last = None, e
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # large star
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(low, "a")
        e = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", "m")).distinct())  # small star
        release(last)
        last = e
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, c1, c2, g): each row with a token, and the group it is in, be it alone."""
    signed = stash(signatures(docs), "superminhash")
    label = components(verified_edges(signed, threshold))
    label = broadcast_if_small(label, 16)
    return signed.select("doc_id", "c1", "c2", "node").join(label, "node", "left").select("doc_id", "c1", "c2", F.coalesce("label", "node").alias("g"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, group_id, size) for each document in a group of two or more; group_id is its smallest doc_id.

    Null texts and those without a letter or digit are in no group. A repeated row counts as a copy of itself: doc_id
    then comes once, size counts its rows. Rows with a null doc_id count in size and have no row of their own; group_id
    is null if all of a group's are. Columns other than doc_id and text are not read.
    """
    rows = stash(_grouped(docs, threshold), "near-groups")
    groups = rows.groupBy("g").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("size")).where("size > 1")
    return rows.where("doc_id IS NOT NULL").select("g", "doc_id").distinct().join(groups, "g").select("doc_id", "group_id", "size")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each group: that of the smallest doc_id, nulls last.

    Rows that repeat the one that stays go too. Texts without a letter or digit all stay.
    """
    rows = stash(_grouped(docs, threshold), "near-groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "c1", "c2")
    groups = rows.groupBy("g").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1").select("g", "first")
    marked = rows.select("g", "doc_id", "c1", "c2").join(groups, "g").groupBy("doc_id", "c1", "c2").agg(F.count("*").alias("n"), F.first(order == F.col("first")).alias("__stays"))
    marked = stash(marked.where("n > 1 OR NOT __stays").select(F.col("doc_id").alias("__id"), F.col("c1").alias("__c1"), F.col("c2").alias("__c2"), "__stays"), "near-marked")
    text = docs["text"].cast("string")
    keyed = docs.withColumns({"__k0": docs["doc_id"].cast("long"), "__k1": F.xxhash64(text), "__k2": F.hash(text)})
    on = [F.col("__k0").eqNullSafe(F.col("__id")), F.col("__k1") == F.col("__c1"), F.col("__k2") == F.col("__c2")]
    out = keyed.join(broadcast_if_small(marked, 24), on, "left").where("__stays IS NULL OR __stays")
    kept = out.where("__stays IS NULL").select(*docs.columns)
    if marked.where("__stays").isEmpty():
        return kept
    once = Window.partitionBy("__k0", "__k1", "__k2").orderBy(F.xxhash64(*docs.columns))
    return kept.unionByName(out.where("__stays").withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
