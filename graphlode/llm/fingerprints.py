"""Document fingerprints by winnowing.

The letters and digits of a text, lower-cased, form a sequence; every k-gram of it gets a rolling 64-bit hash. From each
window of w consecutive k-grams the smallest hash is chosen, the rightmost of equal ones, and kept with its position.
Any passage of at least k + w - 1 letters and digits that two documents share is therefore met by a common fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphlode.llm import textkernel as tk

K = 25
WINDOW = 40


def rightmost_minima(h: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window, the index of its smallest value, the rightmost of equal ones. One window if h is shorter."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    window = min(window, n)
    value, index, width = h, np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64), 1
    while width * 2 <= window:
        value, index = _later(value[:-width], index[:-width], value[width:], index[width:])
        width *= 2
    if width < window:
        m = n - window + 1
        gap = window - width
        value, index = _later(value[:m], index[:m], value[gap : gap + m], index[gap : gap + m])
    return index


def _later(v1: np.ndarray, i1: np.ndarray, v2: np.ndarray, i2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smaller of two overlapping windows' minima; the second on ties."""
    second = v2 <= v1
    return np.where(second, v2, v1), np.where(second, i2, i1)


def kgram_hashes(letters: np.ndarray, k: int) -> np.ndarray:
    return tk.window_hashes(letters.astype(np.uint64), k)


def winnow(letters: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the k-gram, hash) of one document's fingerprints, by index."""
    h = kgram_hashes(letters, k)
    chosen = rightmost_minima(h, window)
    keep = np.ones(len(chosen), dtype=bool)  # minima never move left, so equal neighbours are all repeats
    keep[1:] = chosen[1:] != chosen[:-1]
    chosen = chosen[keep]
    return chosen, h[chosen]


def _winnow_chunk(c: tk.Codes, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's index in the batch, position, hash). The chunk's documents are winnowed at once: windows that would
    cross a border are left out, and documents with fewer k-grams than a window are done apart."""
    lower, word = tk.tables()
    is_word = word[c.cp]
    place = np.flatnonzero(is_word)
    letters = lower[c.cp[place]]
    at = np.searchsorted(place, c.at)
    length = np.diff(at)
    docs, pos, hashes = [], [], []
    wide = k + window - 1
    if (length >= wide).any():
        h = kgram_hashes(letters, k)
        best = rightmost_minima(h, window)
        full = np.maximum(length - wide + 1, 0)  # windows inside each document
        starts = tk.ranges(at[:-1], full)
        owner = np.repeat(np.arange(len(length)), full)
        chosen = best[starts]
        keep = np.ones(len(chosen), dtype=bool)
        keep[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
        chosen = chosen[keep]
        docs.append(owner[keep])
        pos.append(place[chosen] - c.at[owner[keep]])
        hashes.append(h[chosen])
    for i in np.flatnonzero((length >= k) & (length < wide)):
        j, h = winnow(letters[at[i] : at[i + 1]], k, window)
        docs.append(np.full(len(j), i))
        pos.append(place[at[i] + j] - c.at[i])
        hashes.append(h)
    if not docs:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    d, p, h = np.concatenate(docs), np.concatenate(pos), np.concatenate(hashes)
    order = np.lexsort((p, d))
    return d[order] + c.first, p[order], h[order]


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row (doc_id, pos, hash) for each fingerprint; pos counts the text's code points from 0.

    A map over the documents, without a shuffle. Null and empty texts and those of fewer than k letters and digits have
    no row; with fewer than `window` k-grams, all of them are one window. Repeated rows repeat their fingerprints, a
    null doc_id stays null. Columns other than doc_id and text are not read.
    """
    if k < 1 or window < 1:
        raise ValueError("k and window must be at least 1")

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for c in tk.chunks(b.column(1)):
                d, p, h = _winnow_chunk(c, k, window)
                if len(d):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(p.astype(np.int64)), pa.array(tk.signed(h))], names=["doc_id", "pos", "hash"])

    return narrow.mapInArrow(run, "doc_id long, pos long, hash long")


def op1_winnowing(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(k: int = K, window: int = WINDOW) -> str:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    m64 = "18446744073709551616::UHUGEINT"

    def xorshift(x: str, s: int) -> str:
        return f"xor({x}, {x} // {1 << s}::UHUGEINT)"

    def power(b: int) -> str:
        out = "1::UHUGEINT"
        for bit in range(24):
            out = f"{out} * (CASE WHEN m & {1 << bit} > 0 THEN {pow(b, 1 << bit, 1 << 64)}::UHUGEINT ELSE 1::UHUGEINT END) % {m64}"
            out = f"({out})"
        return out

    return f"""
WITH chars AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos
  FROM documents
), letters AS MATERIALIZED (
  SELECT doc_id, pos, unicode(lower(ch)) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM chars WHERE regexp_full_match(ch, '[\\p{{L}}\\p{{N}}]')
), powers AS MATERIALIZED (
  SELECT m, {power(base)} AS up, {power(inverse)} AS down FROM range((SELECT coalesce(max(n), 0) + {k + 1} FROM letters)) x(m)
), sums AS (  -- c(i) B^(k-1) + .. + c(i+k-1) is B^(i+k-1) times the sum of c(m) B^-m, m from i to i+k-1
  SELECT doc_id, pos, i, n, sum((c::UHUGEINT * down % {m64})::HUGEINT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS s
  FROM letters JOIN powers ON m = i
), poly AS (SELECT doc_id, pos, i, n, (s::UHUGEINT % {m64}) * up % {m64} AS h0 FROM sums JOIN powers ON m = i + {k - 1} WHERE i <= n - {k - 1}
), m1 AS (SELECT doc_id, pos, i, n, ({xorshift('h0', 30)} * {0xBF58476D1CE4E5B9}::UHUGEINT) % {m64} AS h1 FROM poly
), m2 AS (SELECT doc_id, pos, i, n, ({xorshift('h1', 27)} * {0x94D049BB133111EB}::UHUGEINT) % {m64} AS h2 FROM m1
), grams AS MATERIALIZED (SELECT doc_id, pos, i, n - {k - 1} AS grams, ({xorshift('h2', 31)})::UBIGINT AS h FROM m2
), best AS (  -- the smallest of a window, the rightmost of equal ones
  SELECT doc_id, i, grams, min((h::HUGEINT * 16777216) + (16777215 - i)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS b
  FROM grams
), chosen AS (
  SELECT DISTINCT doc_id, 16777215 - (b % 16777216)::BIGINT AS i FROM best WHERE i <= greatest(grams - {window - 1}, 1)
)
SELECT g.doc_id, g.pos::BIGINT AS pos, (CASE WHEN g.h >= 9223372036854775808 THEN g.h::HUGEINT - 18446744073709551616 ELSE g.h::HUGEINT END)::BIGINT AS hash
FROM chosen c JOIN grams g ON g.doc_id = c.doc_id AND g.i = c.i"""


SQL = _sql()
