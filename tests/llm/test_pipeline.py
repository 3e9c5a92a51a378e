"""The pipeline against its stages' slow versions, and its queries against SQL, over small tables."""

from collections import Counter

import pytest

import corpus_pipeline
from graphlode.llm import mixing, queries, sharding
from tests.llm.test_brute import best_fit, brute_matches, brute_mixture, brute_toxicity, frame, jaccard, texts
from tests.llm.test_edges import items, labels, odd
from tests.oracle import DATA, differences

SF = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


def test_pipeline(spark, tmp_path):
    r, vocab, rows = texts(21, 40, 60)
    rows = [t + " " + " ".join(r.choice(vocab) for _ in range(30)) for t in rows]
    items = [" ".join(r.choice(vocab) for _ in range(25)) for _ in range(3)]
    rows[4] += " " + items[0]
    rows[9] += " " + items[2]
    rows[7] += ". You worthless idiot, you moron."
    rows += [rows[0], rows[1] + " tail", rows[2]]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {i: t for i, t in enumerate(rows) if brute_toxicity(t) < 1.5}
    assert 7 not in left
    kept = {}
    for i, t in left.items():
        if not any(jaccard(t, u) >= 0.5 for u in kept.values()):
            kept[i] = t
    bad = {list(kept)[d] for _, d, _, _ in brute_matches(list(kept.values()), items, 13, 0.8)}
    assert {4, 9} <= bad
    want = {i: t for i, t in kept.items() if i not in bad}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "slot", "shard_id"}
    plan, _ = brute_mixture([(i, f"s{i % 3}", t) for i, t in want.items()], None, mixing.BLOCK_TOKENS, mixing.MAX_EPOCHS)
    assert Counter((x.doc_id, x.slot) for x in out) == Counter((i, t) for t, _, _, _, i, _ in plan)
    held_together(out)


def held_together(out):
    """Runs of slots are whole, in as few shards as best fit needs."""
    runs = Counter()
    for x in out:
        runs[x.slot // corpus_pipeline.RUN_SLOTS] += len((x.text or "").encode())
    assert len({(x.slot // corpus_pipeline.RUN_SLOTS, x.shard_id) for x in out}) == len(runs)
    assert len({x.shard_id for x in out}) == best_fit(runs.values(), sharding.CAPACITY)


def test_mixing_and_sharding_with_small_blocks(spark, monkeypatch):
    """Many blocks, epochs and shards: what the schedule spreads stays apart."""
    monkeypatch.setattr(sharding.with_shard, "__defaults__", (3000, None))
    monkeypatch.setattr(mixing.mix, "__defaults__", (None, 32, 3))
    monkeypatch.setattr(mixing.with_slot, "__defaults__", (None, 32, 3))
    monkeypatch.setattr(sharding, "CAPACITY", 3000)
    _, vocab, rows = texts(33, 200, 50)
    docs = spark.createDataFrame([(i, t, "en", "big" if i % 5 else f"s{i % 3}", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.sharding_stage(spark, corpus_pipeline.mixing_stage(spark, docs, SF), SF).collect()
    plan, _ = brute_mixture([(i, "big" if i % 5 else f"s{i % 3}", t) for i, t in enumerate(rows)], None, 32, 3)
    assert Counter((x.doc_id, x.slot) for x in out) == Counter((i, t) for t, _, _, _, i, _ in plan)
    held_together(out)
    where = {}
    for x in out:
        where.setdefault(x.doc_id, set()).add((x.slot // corpus_pipeline.RUN_SLOTS, x.shard_id))
    repeated = [v for v in where.values() if len(v) > 1]
    assert len(repeated) > 10 and any(len({s for _, s in v}) > 1 for v in repeated)


def test_pipeline_on_odd_tables(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in out) == [3, 4, 5, 6, 8, 10]
    held_together(out)
    (tmp_path / "none").mkdir()
    for name, df in (("documents", odd(spark)), ("benchmark", items(spark)), ("labels", labels(spark))):
        df.limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
