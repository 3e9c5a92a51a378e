"""Language identification by multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, all but letters and digits are blanks. N-grams of ORDERS, inside a document, are hashed to
BUCKETS; a language's log-probabilities of the buckets are a column of the matrix that all tasks get. Its size is set by
the languages and buckets, not by the corpus. A batch is scored by gathering the matrix's rows for its n-grams and
adding them up by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.llm import textkernel as tk

ORDERS = (1, 2, 3)
BITS = 16
BUCKETS = 1 << BITS
ALPHA = 0.1
#: About so many labelled rows of each language are fitted on, chosen by a hash of doc_id and text.
MAX_ROWS = 2_000
UNKNOWN = "und"


def grams(c: tk.Codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (buckets of the chunk's n-grams in order, where each document's begin)."""
    lower, word = tk.tables()
    x = np.where(word[c.cp], lower[c.cp], np.uint32(32)).astype(np.uint64)
    length = np.diff(c.at)
    for n in ORDERS:
        inside = np.maximum(length - n + 1, 0)
        h = (tk.window_hashes(x, n) >> np.uint64(64 - BITS)).astype(np.int32)
        at = np.concatenate([[0], np.cumsum(inside)])
        yield (h[tk.ranges(c.at[:-1], inside)] if n > 1 else h), at


class Model(NamedTuple):
    languages: tuple[str, ...]
    prior: np.ndarray
    weight: np.ndarray  # BUCKETS x languages, float32

    def scores(self, c: tk.Codes) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages log-probabilities, number of n-grams of each document)."""
        docs = len(c.at) - 1
        total, count = np.zeros((docs, len(self.languages))), np.zeros(docs, dtype=np.int64)
        for bucket, at in grams(c):
            n = np.diff(at)
            has = np.flatnonzero(n)
            if len(has):
                total[has] += np.add.reduceat(self.weight[bucket], at[:-1][has], axis=0, dtype=np.float64)
                count += n
        total[count > 0] += self.prior
        return total, count


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of rows (doc_id, text, lang). Null and empty languages and null texts are no labels."""
    lang = labelled["lang"].cast("string")
    rows = labelled.select(labelled["doc_id"].cast("long").alias("doc_id"), labelled["text"].cast("string").alias("text"), lang.alias("lang")).where("lang <> '' AND text IS NOT NULL")
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not known:
        return Model((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    names = tuple(sorted(known))
    million = 1_000_000
    shares = F.create_map(*(F.lit(v) for k in names for v in (k, min(million, -(-max_rows * million // known[k])))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(million)) < shares[F.col("lang")]).select("lang", "text")
    index = {k: i for i, k in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(names) * BUCKETS, dtype=np.int64)
        for b in batches:
            code = np.array([index[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            for c in tk.chunks(b.column(1)):
                own = code[c.first : c.first + len(c.at) - 1]
                for bucket, at in grams(c):
                    seen += np.bincount(np.repeat(own * BUCKETS, np.diff(at)) + bucket, minlength=len(seen))
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(seen[cell])], names=["cell", "n"])

    table = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # bounded by the model
    seen = np.zeros(len(names) * BUCKETS)
    seen[table["cell"].to_numpy()] = table["n"].to_numpy()
    seen = seen.reshape(len(names), BUCKETS) + ALPHA
    weight = np.log(seen / seen.sum(axis=1, keepdims=True)).T
    prior = np.log(np.array([known[k] for k in names]) / sum(known.values()))
    return Model(names, prior, np.ascontiguousarray(weight, dtype=np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row (doc_id, lang, margin, n_grams) for each row of docs.

    margin is the log-probability by which the best language leads, for each n-gram; with one language it is 0. Null and
    empty texts, and all texts if the model knows no language, are "und" with margin 0. Equal languages go by name.
    Repeated rows are scored each, a null doc_id stays null. Columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for b in batches:
            for c in tk.chunks(b.column(1)):
                docs_here = len(c.at) - 1
                score, n = m.scores(c) if m.languages else (np.zeros((docs_here, 1)), np.zeros(docs_here, dtype=np.int64))
                best = score.argmax(axis=1)
                margin = np.zeros(docs_here)
                if len(m.languages) > 1:
                    top = np.partition(score, -2, axis=1)
                    margin = (top[:, -1] - top[:, -2]) / np.maximum(n, 1)
                none = n == 0
                best[none] = len(m.languages)
                margin[none] = 0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, docs_here), pa.array(names[best], pa.string()), pa.array(margin.round(6)), pa.array(n)], names=["doc_id", "lang", "margin", "n_grams"])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang string, margin double, n_grams long")


def _sql() -> str:
    base, m64 = 0x9E3779B97F4A7C15, "18446744073709551616::UHUGEINT"

    def shifted(x: str, s: int) -> str:
        return f"xor({x}, {x} // {1 << s}::UHUGEINT)"

    return f"""
WITH chars AS MATERIALIZED (
  SELECT doc_id, pos, CASE WHEN regexp_full_match(ch, '[\\p{{L}}\\p{{N}}]') THEN unicode(lower(ch)) ELSE 32 END AS x
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents WHERE text <> '')
), three AS (SELECT doc_id, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), grams AS MATERIALIZED (
  SELECT doc_id, a, -1 AS b, -1 AS c, count(*) AS n FROM three GROUP BY ALL
  UNION ALL SELECT doc_id, a, b, -1, count(*) FROM three WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT doc_id, a, b, c, count(*) FROM three WHERE c IS NOT NULL GROUP BY ALL
), poly AS (
  SELECT a, b, c, (CASE WHEN b < 0 THEN a::UHUGEINT WHEN c < 0 THEN a::UHUGEINT * {base}::UHUGEINT + b::UHUGEINT
         ELSE a::UHUGEINT * {base**2 % (1 << 64)}::UHUGEINT + b::UHUGEINT * {base}::UHUGEINT + c::UHUGEINT END) % {m64} AS h0
  FROM (SELECT DISTINCT a, b, c FROM grams)
), m1 AS (SELECT a, b, c, ({shifted('h0', 30)} * {0xBF58476D1CE4E5B9}::UHUGEINT) % {m64} AS h1 FROM poly
), m2 AS (SELECT a, b, c, ({shifted('h1', 27)} * {0x94D049BB133111EB}::UHUGEINT) % {m64} AS h2 FROM m1
), hashed AS MATERIALIZED (SELECT a, b, c, ({shifted('h2', 31)} // {1 << (64 - BITS)}::UHUGEINT)::BIGINT AS bucket FROM m2
), counted AS MATERIALIZED (SELECT doc_id, bucket, sum(n)::BIGINT AS n FROM grams JOIN hashed USING (a, b, c) GROUP BY ALL
), known AS (SELECT lang, count(*) AS rows, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS prior FROM documents WHERE lang <> '' AND text IS NOT NULL GROUP BY lang
), fitted AS (SELECT lang, bucket, sum(n) AS n FROM counted JOIN documents USING (doc_id) WHERE lang <> '' GROUP BY ALL
), total AS (SELECT lang, sum(n)::DOUBLE + {ALPHA} * {BUCKETS} AS total FROM fitted GROUP BY lang
), weights AS (
  SELECT k.lang, b.bucket, ln((coalesce(f.n, 0)::DOUBLE + {ALPHA}) / total)::FLOAT::DOUBLE AS w
  FROM total k CROSS JOIN (SELECT DISTINCT bucket FROM counted) b LEFT JOIN fitted f ON f.lang = k.lang AND f.bucket = b.bucket
), scores AS (
  SELECT doc_id, c.lang, sum(n * w) + any_value(prior) AS score, sum(n)::BIGINT AS n
  FROM (SELECT doc_id, bucket, n, lang, w FROM counted JOIN weights USING (bucket)) c JOIN known USING (lang) GROUP BY doc_id, c.lang
), placed AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM scores WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, lang)
)
SELECT d.doc_id, coalesce(p.lang, '{UNKNOWN}') AS lang, coalesce(round_even((score - second) / n, 6), 0)::DOUBLE AS margin, coalesce(n, 0)::BIGINT AS n_grams
FROM documents d LEFT JOIN placed p ON p.doc_id = d.doc_id AND place = 1"""


#: Holds where every labelled row is fitted on: up to MAX_ROWS rows a language.
SQL = _sql()


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
