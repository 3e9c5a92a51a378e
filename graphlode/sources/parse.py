"""Files to nodes, raw calls and raw imports: one pass of mapInArrow over (file_path, content)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphlode.functions import text as tx
from graphlode.sources.braces import DIALECTS, parse_braces
from graphlode.sources.files import LANGUAGES
from graphlode.sources.pyparse import parse_python
from graphlode.storage import stash

_NODE = "struct<id: string, kind: string, name: string, file_path: string, line_start: int, line_end: int, signature: string, docstring: string, tags: array<string>, parent_id: string>"
_CALL = "struct<caller_id: string, callee: string, line: int, error_handling: struct<pattern: string, exception: string>, return_usage: string, receiver_type: string>"
_IMPORT = "struct<file_path: string, module_path: string, imported_names: array<string>, is_from_import: boolean>"
PARSED = f"file_path string, nodes array<{_NODE}>, calls array<{_CALL}>, imports array<{_IMPORT}>"

#: Language: (path, source) -> {nodes, calls, imports}. A language without a parser has file nodes only.
PARSERS: dict[str, Callable[[str, str], dict]] = {"python": parse_python} | {k: (lambda p, s, k=k: parse_braces(p, s, k)) for k in DIALECTS}


def parse_one(path: str, source: str) -> dict:
    ending = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    language = next((k for k, ends in LANGUAGES.items() if ending in ends), "")
    parser = PARSERS.get(language) if ending not in (".mjs", ".cjs") else None
    if parser is None:
        lines = max(1, source.count("\n") + (0 if source.endswith("\n") else 1))
        return {"nodes": [{"id": path, "kind": "file", "name": path.rsplit("/", 1)[-1], "file_path": path, "line_start": 1, "line_end": lines, "signature": "", "docstring": None, "tags": [], "parent_id": ""}], "calls": [], "imports": []}
    return parser(path, source)


def parse(files: DataFrame) -> DataFrame:
    """(file_path, nodes, calls, imports) of files (file_path, content), one row each; stored, as three tables come from it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"file_path": path, **parse_one(path, content or "")}], schema=schema)

    return stash(files.select("file_path", "content").mapInArrow(run, PARSED), "parsed")


def nodes_of(parsed: DataFrame) -> DataFrame:
    """The nodes, each with its file's category as a tag. Of equal ids the one furthest down its file stays."""
    n = parsed.select(F.explode("nodes").alias("n")).select("n.*")
    tagged = n.withColumn("tags", F.concat("tags", F.array(F.concat(F.lit("category:"), tx.category(F.col("file_path"))))))
    last = F.max_by(F.struct(*tagged.columns), F.struct("line_start", "line_end"))
    return tagged.groupBy("id").agg(last.alias("n")).select("n.*")


def calls_of(parsed: DataFrame) -> DataFrame:
    """(call_id, caller_file, caller_id, callee, line, error_handling, return_usage, receiver_type); ids go by file and place."""
    c = parsed.select("file_path", F.posexplode("calls").alias("i", "c"))
    return c.select(F.concat("file_path", F.lit("#"), F.lpad(F.col("i").cast("string"), 9, "0")).alias("call_id"), F.col("file_path").alias("caller_file"), "c.*")


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("imports").alias("i")).select("i.*").distinct()


def bases_of(nodes: DataFrame) -> DataFrame:
    """(id, name, file_path, bases) of the classes; brackets in a base don't part it."""
    held = F.filter("tags", lambda t: t.startswith("extends:"))
    joined = F.array_join(F.transform(held, lambda t: F.regexp_replace(F.substr(t, F.lit(9)), r"\[[^\]]*\]", "")), ",")
    return nodes.where("kind = 'class'").select("id", "name", "file_path", F.filter(F.transform(F.split(joined, ","), F.trim), lambda b: b != "").alias("bases"))
