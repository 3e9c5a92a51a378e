"""The twelve tables as Parquet below one folder. A write makes a new version and then a new pointer to it; the highest
pointer counts. So readers and failed jobs never see half a table or none: a crash leaves the version before. The last
version but one stays too, for readers that have begun on it; older ones go with the next write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphlode.schema import TABLES, as_schema, upsert
from graphlode.sources.parse import PARSED
from graphlode.storage import drop_path


#: What the store has besides, for its own use: the parse of each content.
INTERNAL = {"parsed": (f"content_hash string, {PARSED}", ("file_path",))}


def _schema(table: str) -> tuple[str, tuple[str, ...]]:
    return TABLES[table] if table in TABLES else INTERNAL[table]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # The pointers of a table are files CURRENT-<number>-<version's folder>; creating one is a single step everywhere.

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _pointers(self, table: str) -> list[tuple[int, str]]:
        """(number, version) of the pointers that are there, in order."""
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName().split("-") for x in fs.listStatus(p) if x.getPath().getName().startswith("CURRENT-")]
        return sorted((int(n), version) for _, n, version in names)

    def _current(self, table: str) -> str | None:
        pointers = self._pointers(table)
        return pointers[-1][1] if pointers else None

    def read(self, table: str) -> DataFrame:
        """The table, empty if it was never written. Columns that older files lack are null."""
        schema, _ = _schema(table)
        at = self._current(table)
        return self.spark.createDataFrame([], schema) if at is None else self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{at}")

    def write(self, table: str, df: DataFrame) -> None:
        """Puts df in the table's place. One writer at a time; of two, the one that ends last counts."""
        schema, _ = _schema(table)
        version, before = uuid.uuid4().hex, self._pointers(table)
        as_schema(df, schema).write.parquet(f"{self.root}/{table}/{version}")
        fs, pointer = self._fs(f"{self.root}/{table}/CURRENT-{before[-1][0] + 1 if before else 1}-{version}")
        fs.create(pointer, False).close()
        for n, old in before[:-1]:
            fs.delete(self._fs(f"{self.root}/{table}/CURRENT-{n}-{old}")[1], False)
            drop_path(self.spark, f"{self.root}/{table}/{old}")

    def upsert(self, table: str, df: DataFrame) -> None:
        schema, keys = _schema(table)
        self.write(table, upsert(self.read(table), as_schema(df, schema), keys))

    def delete_files(self, table: str, paths: DataFrame, column: str = "file_path") -> None:
        """Drops the rows of files (file_path)."""
        gone = paths.select(F.col("file_path").alias("__gone"))
        stored = self.read(table)
        self.write(table, stored.join(gone, stored[column] == gone["__gone"], "left_anti"))

    def by(self, table: str, **equal) -> DataFrame:
        """Rows by equality of columns; the filters reach the Parquet scan."""
        out = self.read(table)
        for k, v in equal.items():
            out = out.where(F.col(k) == v)
        return out

    def views(self, prefix: str = "") -> None:
        """Registers all tables as temporary views, for spark.sql()."""
        for t in TABLES:
            self.read(t).createOrReplaceTempView(prefix + t)

    def clear(self) -> None:
        for t in (*TABLES, *INTERNAL):
            drop_path(self.spark, f"{self.root}/{t}")
