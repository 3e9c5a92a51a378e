"""Schemas of the stored tables, and the upsert that keeps one row a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

NODES = """id string, kind string, name string, file_path string, line_start int, line_end int, signature string,
docstring string, tags array<string>, importance double, importance_rank int, parent_id string, content_hash string"""
EDGES = """source_id string, target_id string, edge_type string, weight double,
metadata struct<confidence: string, line: int, error_handling: struct<pattern: string, exception: string>, via: string>"""
COCHANGES = """file_a string, file_b string, co_commit_count bigint, total_commits_a bigint, total_commits_b bigint,
last_co_commit string, coupling_score double, commit_ids array<string>"""
KEYWORDS = "keyword string, node_id string, source string"
FILE_STATS = "file_path string, total_commits bigint, commits_30d bigint, commits_7d bigint, last_commit string, primary_author string, author_count bigint"
FILE_HASHES = "file_path string, content_hash string, last_parsed string"
CONCEPT_PATHS = "id string, name string, node_ids array<string>, path_type string"
PATTERNS = "node_id string, pattern string, detail map<string, string>, implication string"
CONTRACTS = "function_id string, caller_id string, error_handling string, return_usage string, arguments string"
STRING_REFS = "literal string, file_path string, line_number int, context string"
RAW_IMPORTS = "file_path string, module_path string, imported_names array<string>, is_from_import boolean, resolved_to_file string"
META = "key string, value string"

#: Table -> (schema, key).
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "nodes": (NODES, ("id",)),
    "edges": (EDGES, ("source_id", "target_id", "edge_type")),
    "cochanges": (COCHANGES, ("file_a", "file_b")),
    "keywords": (KEYWORDS, ("keyword", "node_id", "source")),
    "file_stats": (FILE_STATS, ("file_path",)),
    "file_hashes": (FILE_HASHES, ("file_path",)),
    "concept_paths": (CONCEPT_PATHS, ("id",)),
    "patterns": (PATTERNS, ("node_id", "pattern")),
    "contracts": (CONTRACTS, ("function_id", "caller_id")),
    "string_refs": (STRING_REFS, ("literal", "file_path", "line_number")),
    "raw_imports": (RAW_IMPORTS, ("file_path", "module_path", "imported_names")),
    "meta": (META, ("key",)),
}

REVERSE = {"calls": "called_by", "imports": "imported_by", "inherits": "inherited_by", "dispatches_to": "dispatched_from"}


def last_of(df: DataFrame, keys: tuple[str, ...] | list[str], seq: Column) -> DataFrame:
    """The row of each key with the greatest seq: the last writer wins."""
    w = Window.partitionBy(*keys).orderBy(seq.desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """new's rows, and those stored whose key is not in new."""
    on = [stored[k].eqNullSafe(new[k]) for k in keys]
    return stored.join(new, on, "left_anti").unionByName(new)


def as_schema(df: DataFrame, schema: str) -> DataFrame:
    """df's columns in the schema's order and types; columns that it lacks are null."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))
