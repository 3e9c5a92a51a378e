"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from graphlode.llm import decontaminate, fingerprints, langid, mixing, neardup, sharding, substrings, tokenids, toxicity, warc

# Names that the operators use inside, as columns of the input.
EXTRA = ["pos", "hash", "n", "term", "seg", "ord", "tokens", "slot", "block", "epoch", "start", "shard", "shard_id", "bytes", "key", "row", "g", "size", "node", "sig", "label", "score", "first", "end", "item_id", "toxic", "margin", "c1", "id", "u"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(x, T.StringType()) for x in EXTRA)])
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"

_r = random.Random(5)
WORDS = ["".join(_r.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
PASSAGE = " ".join(_r.choice(WORDS) for _ in range(120))
LONG = " ".join(_r.choice(WORDS) for _ in range(200_000))
UNIQUE = " ".join(f"w{i}" for i in range(80))


def docs(spark, rows):
    return spark.createDataFrame([(*r, *(["x"] * len(EXTRA))) for r in rows], SCHEMA)


def odd(spark):
    return docs(spark, [
        (1, PASSAGE, "en", "a", 1), (1, PASSAGE, "en", "a", 1), (2, PASSAGE.upper(), "en", "b", None), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, " \n\t...", "", "a", 4), (None, PASSAGE + " tail", "en", None, 2), (None, UNIQUE, "de", "c", 2), (6, LONG, "en", "a", len(LONG)),
        (7, "x", "en", "a", 1), (8, "😀 𝔘nicode ﬁ İ ß é́ �", "en", "d", 3), (9, "you are a worthless idiot. you moron!", "en", "a", 1), (10, "word " * 30_000, "en", "hot", 1), (11, UNIQUE + " different end", "de", "c", 2),
    ])


def labels(spark):
    return spark.createDataFrame([(9, 1, 1), (1, 1, 0), (1, 1, None), (None, 0, 1), (None, None, None)], LABELS)


def items(spark):
    return spark.createDataFrame([(1, PASSAGE[:160]), (1, PASSAGE[:160]), (2, None), (3, ""), (None, UNIQUE[:60]), (4, "x"), (5, "the the the the the the the the")], ITEMS)


OPERATORS = {
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "matches": lambda s, d: decontaminate.matches(d, items(s)),
    "token_ids": lambda s, d: tokenids.token_ids(d),
    "identify": lambda s, d: langid.identify(d, langid.fit(d)),
    "shards": lambda s, d: sharding.shards(d),
    "intervals": lambda s, d: substrings.repeated_intervals(d),
    "mixture": lambda s, d: mixing.mixture(d),
    "toxic": lambda s, d: toxicity.toxic_documents(d, labels(s)),
    "near": lambda s, d: neardup.near_duplicates(d),
}
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_empty_table_stage(spark, name, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = STAGES[name](spark, docs(spark, []), str(tmp_path))
    assert out.collect() == []
    assert set(out.columns) == set(SCHEMA.names) | {"shard_id"}


def test_fingerprints(spark):
    rows = OPERATORS["fingerprints"](spark, odd(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.pos, r.hash))
    assert set(by) == {1, 2, 6, 9, 10, 11, None}
    assert len(by[1]) == 2 * len(set(by[1]))
    assert {h for _, h in by[1]} == {h for _, h in by[2]}


def test_matches(spark):
    rows = OPERATORS["matches"](spark, odd(spark)).collect()
    assert {(r.item_id, r.doc_id) for r in rows} == {(1, 1), (1, 2), (1, None), (None, None), (None, 11), (4, 7)}
    assert {r.kind for r in rows} == {"exact"}


def test_token_ids(spark):
    rows = OPERATORS["token_ids"](spark, odd(spark)).collect()
    assert len(rows) == 14 + 1 and [r.doc_id for r in rows if r.part == "ranks"] == [None]
    assert sorted(r.doc_id for r in rows if r.n == 0) == [3, 4]
    assert tokenids.token_ids(docs(spark, [(1, None, "en", "a", 0)])).select("n").collect() == [(0,)]


def test_identify(spark):
    rows = OPERATORS["identify"](spark, odd(spark)).collect()
    assert len(rows) == 14
    assert {r.doc_id for r in rows if r.lang == "und"} == {3, 4}
    assert {r.lang for r in langid.identify(odd(spark), langid.fit(docs(spark, []))).collect()} == {"und"}


def test_shards(spark):
    rows = sharding.shards(odd(spark), 2000).collect()
    assert len(rows) == 14
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert {r.group_bytes for r in rows if r.doc_id in (3, 4)} == {0}
    alone = next(r for r in rows if r.doc_id == 6)
    assert [r.doc_id for r in rows if r.shard == alone.shard] == [6]


def test_intervals(spark):
    rows = OPERATORS["intervals"](spark, odd(spark)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.first, r.end))
    assert found[1] == [(0, 120), (0, 120)] and found[2] == [(0, 120)]
    assert sorted(found[None]) == [(0, 80), (0, 120)] and found[11] == [(0, 80)]
    assert found[10] == [(0, 30_000)]
    assert 6 not in found or all(e - f >= 50 for f, e in found[6])


def test_mixture(spark):
    rows = OPERATORS["mixture"](spark, odd(spark)).collect()
    ids = [1, 1, 2, 3, 4, 5, None, None, 6, 7, 8, 9, 10, 11]
    assert {r.doc_id for r in rows} == set(ids)
    assert {r.tokens for r in rows if r.doc_id in (3, 4, 5)} == {0}
    only = mixing.mixture(odd(spark), {"a": 1.0, "c": 3.0, "none": 1.0}).collect()
    assert {r.source for r in only} == {"a", "c"}


def test_toxic(spark):
    assert [r.doc_id for r in OPERATORS["toxic"](spark, odd(spark)).collect()] == [9]
    none = spark.createDataFrame([], LABELS)
    assert [r.doc_id for r in toxicity.toxic_documents(odd(spark), none).collect()] == [9]


def test_near(spark):
    rows = {(r.doc_id, r.group_id, r.size) for r in OPERATORS["near"](spark, odd(spark)).collect()}
    assert rows == {(1, 1, 4), (2, 1, 4), (11, 11, 2)}


def test_near_stage_keeps_one_of_each(spark):
    out = neardup.drop_near_duplicates(odd(spark))
    assert out.columns == SCHEMA.names
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11] and len(ids) == 10


def test_stages_keep_columns_and_rows(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    d = odd(spark)
    gone = {"toxicity": [9], "decontamination": [1, 1, 2, None, None, 7, 11], "mixing": [], "sharding": []}
    for name, ids in gone.items():
        out = STAGES[name](spark, d, str(tmp_path))
        left = [r.doc_id for r in out.collect()]
        want = [r.doc_id for r in d.select("doc_id").collect()]
        for i in ids:
            want.remove(i)
        assert sorted(set(map(str, left))) == sorted(set(map(str, want))), name
        assert len(left) == len(want), name
        assert set(out.columns) == set(SCHEMA.names), name


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c?d#e", "<p>ü</p>", "x"), (1, "http://a.b/c?d#e", "<p>ü</p>", "y"), (None, None, None, None), (2, "", "", "z"), (3, "http://long/", "z" * 3_000_000, "z")], "page_id long, url string, html string, block string")
    rows = warc.assemble(warc.parse_records(warc.archive(pages))).collect()
    assert len(rows) == 4
    assert all(r.request and r.response and len(r.metadata) == 1 and r.requests == r.responses == [] for r in rows)
    assert sorted(r.target_uri for r in rows) == ["", "about:blank", "http://a.b/c?d#e", "http://long/"]
    assert warc.assemble(warc.parse_records(warc.archive(pages.limit(0)))).collect() == []
