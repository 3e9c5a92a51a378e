"""Operators over file contents: hashes, differences, string references, uses, source of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from graphlode.functions import text as tx
from graphlode.operators.graph import bfs_levels, steps

PER_FILE, IN_ALL = 200, 500


def file_hashes(files: DataFrame) -> DataFrame:
    """(file_path, content_hash) of files (file_path, content)."""
    return files.select("file_path", F.md5(F.col("content").cast("binary")).alias("content_hash"))


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, status): new, changed or deleted; one full outer join."""
    o, n = old.select("file_path", F.col("content_hash").alias("o")), new.select("file_path", F.col("content_hash").alias("n"))
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, "file_path", "full_outer").select("file_path", status.alias("status")).where("status IS NOT NULL")


def symbol_hashes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, content_hash) of symbols (id, file_path, line_start, line_end)."""
    met = symbols.where("line_start > 0").join(files.select("file_path", "content"), "file_path")
    return met.select("id", tx.symbol_hash(F.col("content"), F.col("line_start"), F.col("line_end")).alias("content_hash"))


def string_refs(files: DataFrame) -> DataFrame:
    """(literal, file_path, line_number, context): each quoted identifier of each line, once."""
    lines = files.select("file_path", F.posexplode(tx.lines_of(F.col("content"))).alias("i", "line"))
    found = lines.select("file_path", (F.col("i") + 1).alias("line_number"), F.explode(F.array_distinct(tx.literals(F.col("line")))).alias("literal"))
    return found.select("literal", "file_path", "line_number", F.lit("string_literal").alias("context"))


def refs_of(refs: DataFrame, identifier: str) -> DataFrame:
    """(file_path, n, lines) of the places that hold a literal."""
    return refs.where(F.col("literal") == identifier).groupBy("file_path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line_number")).alias("lines"))


def uses(files: DataFrame, identifier: str, path_glob: str | None = None, per_file: int = PER_FILE, limit: int = IN_ALL) -> DataFrame:
    """(file_path, line_number, line) of lines with the identifier as a whole word, comments left out; the first `per_file`
    of each file and the first `limit` of all, by path and line."""
    import re

    if not re.fullmatch(r"[A-Za-z_]\w{0,63}", identifier, re.ASCII):
        raise ValueError("an identifier has letters, digits and underscores, 64 at most, and no digit first")
    chosen = files if path_glob is None else files.where(tx.glob_matches(F.col("file_path"), path_glob))
    able = chosen.where(F.col("content").contains(identifier))
    hit = F.filter(F.transform(tx.lines_of(F.col("content")), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line"))), lambda x: x["line"].rlike(rf"\b{identifier}\b") & ~x["line"].rlike(tx.COMMENT))
    rows = able.select("file_path", F.explode(F.slice(hit, 1, per_file)).alias("h")).select("file_path", "h.line_number", "h.line")
    return rows.orderBy("file_path", "line_number").limit(limit)


def read_context(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 0) -> DataFrame:
    """(id, depth, file_path, line_start, line_end): a symbol and what it calls, to a depth of 0 .. 3; files are left out."""
    seeds = nodes.sparkSession.createDataFrame([(node_id, node_id)], "root string, id string")
    found = bfs_levels(steps(edges, ["calls"]), seeds, max(0, min(3, depth)))
    return found.select("id", "depth").join(nodes.where("kind <> 'file'").select("id", "file_path", "line_start", "line_end"), "id")


def read_source(context: DataFrame, files: DataFrame) -> DataFrame:
    """context with the source lines of each symbol."""
    lines = F.slice(tx.lines_of(F.col("content")), F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)))
    return context.join(files.select("file_path", "content"), "file_path").select("id", "depth", "file_path", "line_start", "line_end", F.array_join(lines, "\n").alias("source"))


def changed_since(hashes: DataFrame, node_id: str, since: str) -> DataFrame:
    """(id, content_hash, unchanged) of a symbol."""
    return hashes.where(F.col("id") == node_id).select("id", "content_hash", (F.col("content_hash") == since).alias("unchanged"))


def first_lines(files: DataFrame, n: int) -> DataFrame:
    """(file_path, line_number, line): the first n lines of each file."""
    lines = files.select("file_path", F.posexplode(F.slice(tx.lines_of(F.col("content")), 1, n)).alias("i", "line"))
    w = Window.partitionBy("file_path").orderBy("i")
    return lines.select("file_path", F.row_number().over(w).alias("line_number"), "line")
