"""From raw documents to shards: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.llm import decontaminate, mixing, neardup, sharding, toxicity
from graphlode.storage import stash


#: Consecutive slots of the schedule that stay in one shard: some 1.6 MB of text.
RUN_SLOTS = 8


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the grammar rejects.

    Null and empty texts score 0 and stay. Repeated rows go or stay together. Equal scores don't matter: the limit itself
    rejects. An empty table stays empty; without labels the word lists alone decide.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near duplicates: the smallest doc_id, null last, and of its repeated rows one.

    Null texts and those without a letter or digit are in no group and stay, repeated or not. An empty table stays empty.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark.

    Null and empty texts and items match nothing. Repeated rows go or stay together. Without items nothing goes.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the schedule has slots for its block: once at least, mixing.MAX_EPOCHS times at most.

    A null source is a source of its own. Null and empty texts have no tokens and come with the block that they stand in.
    Repeated rows are repeated each. An empty table stays empty.
    """
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the slot that the schedule has for it, and its shard_id.

    The indivisible groups are runs of RUN_SLOTS consecutive slots, so a shard has whole stretches of the mixture, and a
    document's repetitions stand as far apart as the schedule has them. Nulls, empty texts and repeated rows have slots
    like all others. An empty table stays empty; columns named slot and shard_id are replaced.
    """
    placed = stash(mixing.with_slot(docs), "placed")
    return sharding.with_shard(placed, group=F.floor(placed["slot"] / RUN_SLOTS))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The grammar and the signatures are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of sf_dir after all STAGES, each written to the shared folder and read again as the next one's documents.

    The result has the columns of documents, slot and shard_id. Nulls, empty and long texts, ties, repeated rows and empty
    tables are what each stage says; no text is cut, and no row is lost but to the first three stages' decisions.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
