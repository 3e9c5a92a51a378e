"""Token ids by frequency rank in a byte-aligned variable-length coding with separate control bytes.

Texts are tokenised with a public byte-level BPE vocabulary (a file; never trained here). Ids are then renumbered by how
often they occur in the corpus, so that the frequent ones take one byte. Four ids share a control byte of four 2-bit
lengths; the ids' bytes follow apart, little-endian, without their upper zeros. Decoding looks control bytes up in tables.
The order of the ranks is coded the same way and comes with the rows, so these can be decoded by themselves.

The vocabulary's file must be at the same path on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.storage import stash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a file of base64 tokens and ids."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(i) for token, i in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# -- the coding

_LENGTH = np.array([[(c >> (2 * i)) % 4 + 1 for i in range(4)] for c in range(256)], dtype=np.int64)
_OFFSET = np.cumsum(_LENGTH, axis=1) - _LENGTH
_TOTAL = _LENGTH.sum(axis=1)
_MASK = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)[_LENGTH - 1]


def encode(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, where each list's begin, data bytes, where each list's begin) of lists values[at[i]:at[i + 1]]."""
    values = np.ascontiguousarray(values, dtype="<u4")
    code = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    n = np.diff(at)
    groups = -(-n // 4)
    group_at = np.concatenate([[0], np.cumsum(groups)])
    padded = np.zeros(int(group_at[-1]) * 4, dtype=np.uint8)
    padded[np.arange(len(values)) + np.repeat(group_at[:-1] * 4 - at[:-1], n)] = code
    quad = padded.reshape(-1, 4)
    control = quad[:, 0] | (quad[:, 1] << 2) | (quad[:, 2] << 4) | (quad[:, 3] << 6)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    ends = np.concatenate([[0], np.cumsum(code.astype(np.int64) + 1)])
    return control, group_at, data, ends[at]


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of one list; none of nulls."""
    if control is None or data is None:
        return np.zeros(0, np.uint32)
    c = np.frombuffer(control, dtype=np.uint8)
    d = np.zeros(len(data) + 4 * 4, dtype=np.uint32)
    d[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    # The last group's missing values are coded as one byte each; the padding of d takes their reads.
    base = np.cumsum(_TOTAL[c]) - _TOTAL[c]
    place = (base[:, None] + _OFFSET[c]).ravel()[:n]
    return (d[place] | (d[place + 1] << 8) | (d[place + 2] << 16) | (d[place + 3] << 24)) & _MASK[c].ravel()[:n]


# -- the operator


def raw_ids(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n, ids): the vocabulary's ids as packed unsigned integers of 2 bytes, or 4 if it has more than 65,536; stored.

    Null and empty texts have no ids; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        kind = np.uint16 if enc.max_token_value < 1 << 16 else np.uint32
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            done, held = 0, []
            size = 0
            for i in range(len(texts)):
                x = texts[i].as_py()
                held.append(np.array(enc.encode_ordinary(x), dtype=kind) if x else np.zeros(0, kind))
                size += len(held[-1])
                if size > 2_000_000 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(done, len(held)), pa.array([len(h) for h in held], pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())], names=["doc_id", "n", "ids"])
                    done, held, size = i + 1, [], 0

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return stash(narrow.mapInArrow(run, "doc_id long, n int, ids binary"), "raw-ids")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each row's begin) of the columns n and ids of a batch (doc_id, n, ids)."""
    n = b.column(1).to_numpy().astype(np.int64)
    joined = b"".join(x.as_buffer() for x in b.column(2))
    at = np.concatenate([[0], np.cumsum(n)])
    return np.frombuffer(joined, dtype=np.uint16 if at[-1] * 2 == len(joined) else np.uint32), at


def frequencies(raw: DataFrame) -> DataFrame:
    """(id, n): occurrences in the corpus of each id that occurs. At most one row for each entry of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            found = np.bincount(_flat(b)[0])
            if len(found) > len(total):
                total, found = found.astype(np.int64), total
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], names=["id", "n"])

    return raw.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def rank_order(counts: DataFrame) -> np.ndarray:
    """The vocabulary's ids from the most frequent down, equal ones by id: the id of rank r is at r."""
    table = counts.toArrow()  # bounded by the vocabulary
    ids, n = table["id"].to_numpy(), table["n"].to_numpy()
    return ids[np.lexsort((ids, -n))]


def coded(raw: DataFrame, order: np.ndarray) -> DataFrame:
    """(doc_id, n, control, data) of stored raw ids; no ids have no bytes."""
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def binary(x: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(x)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(whole.num_rows, 1 + 4_000_000 * whole.num_rows // max(1, whole.nbytes)))
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                values, at = _flat(b)
                control, c_at, data, d_at = encode(rank[values], at)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary(control, c_at), binary(data, d_at)], names=["doc_id", "n", "control", "data"])

    return raw.mapInArrow(run, "doc_id long, n int, control binary, data binary")


def token_ids(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row (doc_id, part, n, control, data) for each row of docs, of part "ids", and one of part "ranks".

    n is the number of ids. Null and empty texts have n = 0 and no bytes. Repeated rows are coded each, a null doc_id stays
    null; a table without any token has no "ranks", and an empty one gives no row. Ids are ranks in the frequencies of this
    very table, equal frequencies by the vocabulary's id; the row "ranks", whose doc_id is null, has the vocabulary's ids in
    that order. Columns other than doc_id and text are not read.
    """
    raw = raw_ids(docs, path)
    order = rank_order(frequencies(raw))
    rows = coded(raw, order).select("doc_id", F.lit("ids").alias("part"), "n", "control", "data")
    if not len(order):
        return rows
    control, _, data, _ = encode(order.astype(np.uint32), np.array([0, len(order)]))
    ranks = docs.sparkSession.createDataFrame([(None, "ranks", len(order), bytearray(control.tobytes()), bytearray(data.tobytes()))], "doc_id long, part string, n int, control binary, data binary")
    return rows.unionByName(ranks)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) with the vocabulary's ids of each row of part "ids" of token_ids(), or (doc_id, text) given its path.

    Rows without ids have an empty list or text. All that is needed is in rows; without a row "ranks" none has ids.
    """
    first = rows.where("part = 'ranks'").select("n", "control", "data").first()  # as many ids as the vocabulary has at most
    order = decode(bytes(first["control"]), bytes(first["data"]), first["n"]).astype(np.int32) if first else np.zeros(0, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [order[decode(c, d, n)] if n else order[:0] for n, c, d in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            if path is None:
                out = pa.array(lists, pa.list_(pa.int32()))
            else:
                enc = encoding(path)
                out = pa.array([enc.decode(x.tolist()) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "ids" if path is None else "text"])

    return rows.where("part = 'ids'").select("doc_id", "n", "control", "data").mapInArrow(run, "doc_id long, ids array<int>" if path is None else "doc_id long, text string")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
