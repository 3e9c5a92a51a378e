"""Source trees: scan with pruning and an ignore file, languages, categories, hashes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphlode.functions import text as tx

IGNORE_FILE = ".graphlodeignore"
#: Bytes up to which a file is taken for source code by default.
LARGEST = 500 * 1024
PRUNED_DIRS = """.bundle .egg-info .eggs .git .gradle .graphlode .idea .mvn .mypy_cache .nyc_output .pytest_cache .tox .venv .vs
.vscode 3rdparty Debug Release __pycache__ bench benchmark benchmarks bin build coverage dist env example examples fixtures
node_modules obj out packages pkg sample samples target test_data testdata third-party third_party thirdparty vendor
venv""".split()
PRUNED_FILES = """Cargo.lock Gemfile.lock conftest.py go.sum package-lock.json pnpm-lock.yaml setup.cfg setup.py yarn.lock""".split()
DEFAULT_IGNORE = """*.bundle.js *.chunk.js *.egg-info/ *.min.css *.min.js .git/ .graphlode/ .mypy_cache/ .pytest_cache/ .tox/ .venv/
__pycache__/ build/ dist/ env/ node_modules/ venv/""".split()

#: Language: its files' endings.
_ENDINGS = "c=c,h cpp=cc,cpp,cxx,hh,hpp,hxx csharp=cs go=go java=java javascript=cjs,js,jsx,mjs python=py ruby=rb rust=rs tsx=tsx typescript=ts"
LANGUAGES: dict[str, list[str]] = {k: [f".{e}" for e in v.split(",")] for k, v in (x.split("=") for x in _ENDINGS.split())}


def register_language(name: str, endings: list[str]) -> None:
    LANGUAGES[name] = [*LANGUAGES.get(name, []), *(e.lower() for e in endings)]


def language(path: Column) -> Column:
    """The language by the ending; empty if none has it."""
    by_ending = F.create_map(*(F.lit(x) for name, ends in LANGUAGES.items() for e in ends for x in (e, name)))
    return F.coalesce(F.try_element_at(by_ending, tx.extension(path)), F.lit(""))


def language_counts(paths: DataFrame) -> DataFrame:
    """(language, files) of a column file_path."""
    return paths.groupBy(language(F.col("file_path")).alias("language")).agg(F.count("*").alias("files"))


def scannable(path: Column, ignore: list[str] = (), endings: list[str] | None = None) -> Column:
    """Whether a relative path is scanned: a known ending, no pruned directory or file, not ignored."""
    wanted = [e for ends in LANGUAGES.values() for e in ends] if endings is None else endings
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    pruned = F.exists(dirs, lambda d: d.isin(PRUNED_DIRS) | d.endswith(".egg-info"))
    return tx.extension(path).isin(wanted) & ~pruned & ~F.substring_index(path, "/", -1).isin(PRUNED_FILES) & ~tx.ignored(path, [*DEFAULT_IGNORE, *ignore])


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Spark's own file sources pass over names that begin with _ or
    a dot, such as __init__.py, so trees are walked and read by Arrow's file systems."""
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))


def ignore_patterns(root: str) -> list[str]:
    """The patterns of the tree's ignore file, if it has one."""
    fs, base = _open(root)
    path = f"{base}/{IGNORE_FILE}"
    if fs.get_file_info(path).type != pafs.FileType.File:
        return []
    with fs.open_input_stream(path) as f:
        lines = [x.strip() for x in f.read().decode("utf-8", "replace").splitlines()]
    return [x for x in lines if x and not x.startswith("#")]


def walk(root: str) -> Iterator[tuple[str, int, float]]:
    """(relative path, length, modified) of the files, without going into pruned directories."""
    fs, base = _open(root)
    todo = [""]
    while todo:
        at = todo.pop()
        for x in fs.get_file_info(pafs.FileSelector(f"{base}/{at}" if at else base)):
            rel = f"{at}/{x.base_name}" if at else x.base_name
            if x.type == pafs.FileType.Directory and x.base_name not in PRUNED_DIRS and not x.base_name.endswith(".egg-info"):
                todo.append(rel)
            elif x.type == pafs.FileType.File:
                yield rel, x.size, x.mtime.timestamp() if x.mtime else 0.0


def listed(spark: SparkSession, root: str, ignore: list[str] | None = None, endings: list[str] | None = None) -> DataFrame:
    """(file_path, length, modified) of the tree's source files of any length."""
    rules = ignore_patterns(root) if ignore is None else ignore
    names = spark.createDataFrame(list(walk(root)), "file_path string, length long, modified double")
    return names.where(scannable(F.col("file_path"), rules, endings))


def too_large(spark: SparkSession, root: str, ignore: list[str] | None = None, endings: list[str] | None = None, largest: int | None = LARGEST) -> DataFrame:
    """(file_path, length, modified) of the source files that scan() with the same parameters leaves out for their length."""
    return listed(spark, root, ignore, endings).where(F.lit(False) if largest is None else F.col("length") > largest)


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, endings: list[str] | None = None, largest: int | None = LARGEST) -> DataFrame:
    """(file_path, content, length, modified) of the tree's source files of up to `largest` bytes (None: all), paths relative
    to root; too_large() tells the others.

    The driver lists names only; they are filtered as a DataFrame and the files are read by the tasks. root must be where all
    executors can read it.
    """
    kept = listed(spark, root, ignore, endings).where(F.lit(True) if largest is None else F.col("length") <= largest).repartition("file_path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for b in batches:
            for i, rel in enumerate(b.column(0).to_pylist()):
                with fs.open_input_stream(f"{base}/{rel}") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([text]), b.column(1).slice(i, 1), b.column(2).slice(i, 1)], names=["file_path", "content", "length", "modified"])

    return kept.mapInArrow(read, "file_path string, content string, length long, modified double")
