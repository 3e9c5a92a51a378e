"""Exact substring deduplication over token windows.

Every window of LENGTH tokens of every document gets a Rabin-Karp hash. A segment of documents counts its own first: each
of its distinct hashes travels once, packed in eight bytes, to its bucket of the hash space, where Spark tasks count the
segments that have it; what goes back is one bit a hash. So a passage that a third of all documents share weighs no more
than once a segment. Each segment then merges its repeated windows into maximal intervals. Segments are a stored table,
so both passes, and any task that is run again, see the same windows in the same order. Their texts are compressed by the
task that makes them and stay so until they are tokenized: many of them stand in one batch, and where the bits are too
many to broadcast, the segments are shuffled to meet theirs.

Windows are compared by their 64-bit hashes: of n windows about n * n / 2**65 pairs collide by chance, one in a corpus
of 6e9 windows, some millions of 1e13 at 100 TB (one window in 1e6).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.llm import textkernel as tk
from graphlode.storage import BROADCAST_BYTES, stash

LENGTH = 50
SEGMENT_BYTES = 2 << 20
#: Hashes that one bucket is meant to hold; with more windows there are more buckets.
BUCKET_HASHES = 750_000
LEAST_BUCKETS = 32
CODEC = "zstd"
#: Text whose tokens are found at once, unless one document has more.
CHUNK_BYTES = 1 << 19


def _segments(docs: DataFrame) -> DataFrame:
    """(seg, chars, doc_ids, lengths, text): documents end to end as UTF-8, compressed, with the bytes of each."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            lengths = [len(x) for x in texts]
            return pa.RecordBatch.from_arrays(
                [pa.array([seg]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([pa.compress(b"".join(texts), CODEC, asbytes=True)], pa.binary())], names=["seg", "doc_ids", "lengths", "text"]
            )

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1))):
                ids.append(i)
                texts.append(x)
                size += len(x)
                if size >= SEGMENT_BYTES:
                    yield row()
                    seg, ids, texts, size = seg + 1, [], [], 0
        if ids:
            yield row()

    return stash(narrow.mapInArrow(run, "seg long, doc_ids array<long>, lengths array<int>, text binary"), "substring-segments")


class _Windows:
    """The windows of one segment, in order: owner, first token and hash of each; size: tokens of each document."""

    def __init__(self, text: pa.Scalar, lengths: pa.Scalar, length: int):
        size = lengths.values.to_numpy()
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        col = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(at), pa.decompress(text.as_buffer(), int(at[-1]), CODEC)])
        owner, first, hashes = [], [], []
        for c in tk.chunks(col, CHUNK_BYTES):
            t = tk.tokenize(c)
            inside = np.maximum(np.diff(t.at) - length + 1, 0)
            if not inside.any():
                continue
            h = tk.window_hashes(t.hash, length)
            starts = tk.ranges(t.at[:-1], inside)
            docs = np.repeat(np.arange(len(inside), dtype=np.int32), inside)
            owner.append(docs + np.int32(c.first))
            first.append((starts - t.at[docs]).astype(np.int32))
            hashes.append(h[starts])
        none = np.zeros(0, np.int32)
        self.owner = np.concatenate(owner) if owner else none
        self.first = np.concatenate(first) if first else none
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order of the windows by hash, where each distinct hash begins in it, the distinct hashes, which occur twice)."""
        order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(new)
        return order, begin, h[begin], np.diff(np.append(begin, len(h))) > 1


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets that occur, where each begins and the last ends) of sorted hashes: the upper 32 bits, scaled."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    found, at = np.unique(bucket, return_index=True)
    return found.astype(np.int64), np.append(at, len(hashes))


def _count_bucket(table: pa.Table) -> pa.Table:
    """(seg, bucket, mask): a bit for each hash of a row, set if another segment has it too."""
    rows = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["hashes"]]
    h = np.concatenate(rows)
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] = same
    twice[:-1] |= same
    mask = np.empty(len(h), dtype=bool)
    mask[order] = twice
    at = np.cumsum([len(r) for r in rows])[:-1]
    return pa.table({"seg": table["seg"], "bucket": table["bucket"], "mask": pa.array([np.packbits(m).tobytes() for m in np.split(mask, at)], pa.binary())})


def repeated_intervals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row (doc_id, first, end) for each maximal interval of tokens [first, end) covered by repeated windows.

    A window is repeated if its `length` tokens (runs of letters and digits, in lower case) occur elsewhere too, in the
    same or another document; all occurrences are listed. Windows that overlap or touch make one interval. Null and empty
    texts and those of fewer tokens have no window. Repeated rows repeat each other. A null doc_id stays null. Columns
    other than doc_id and text are not read.
    """
    segments = _segments(docs)
    # Two letters and a blank are about the least a token takes; the number only sets how many buckets there are.
    size = segments.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = int(max(LEAST_BUCKETS, size // 6 // BUCKET_HASHES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, _, hashes, _ = _Windows(b.column(2)[i], b.column(1)[i], length).distinct()
                found, at = _by_bucket(hashes, buckets)
                raw = hashes.tobytes()
                off = pa.py_buffer((at * 8).astype(np.int32)) if len(found) else pa.py_buffer(np.zeros(1, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), b.column(0)[i].as_py(), dtype=np.int64)), pa.Array.from_buffers(pa.binary(), len(found), [None, off, pa.py_buffer(raw)])], names=["bucket", "seg", "hashes"]
                )

    packed = segments.select("seg", "lengths", "text").mapInArrow(pack, "bucket long, seg long, hashes binary")
    masks = stash(packed.groupBy("bucket").applyInArrow(_count_bucket, "seg long, bucket long, mask binary"), "substring-masks")
    per_segment = masks.groupBy("seg").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    mask_bytes = masks.agg(F.sum(F.octet_length("mask") + 24)).first()[0] or 0
    joined = segments.join(F.broadcast(per_segment) if mask_bytes < BROADCAST_BYTES else per_segment, "seg")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w = _Windows(b.column(2)[i], b.column(1)[i], length)
                order, begin, hashes, twice = w.distinct()
                found, at = _by_bucket(hashes, buckets)
                given = b.column(3)[i].values
                bits = dict(zip(given.field("bucket").to_pylist(), given.field("mask").to_pylist()))
                flags = [np.unpackbits(np.frombuffer(bits[int(k)], dtype=np.uint8), count=int(n)) for k, n in zip(found, np.diff(at))]
                if flags:
                    twice |= np.concatenate(flags).astype(bool)
                repeated = np.zeros(len(order), dtype=bool)
                repeated[order] = np.repeat(twice, np.diff(np.append(begin, len(order))))
                owner, first = w.owner[repeated], w.first[repeated]
                new = np.ones(len(first), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (first[1:] > first[:-1] + length)
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(first)) - 1 if len(begin) else begin
                ids = b.column(0)[i].values
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[begin])), pa.array(first[begin].astype(np.int64)), pa.array(first[last].astype(np.int64) + length)], names=["doc_id", "first", "end"])

    return joined.select("doc_ids", "lengths", "text", "masks").mapInArrow(merge, "doc_id long, first long, end long")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_intervals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i - 1 AS i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM t WHERE len(w) >= {LENGTH})
), marked AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), islands AS (
  SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS starts FROM marked)
)
SELECT doc_id, min(i)::BIGINT AS first, max(i)::BIGINT + {LENGTH} AS "end" FROM islands GROUP BY doc_id, island"""
