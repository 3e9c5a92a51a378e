"""Neighbours looked up in files, for searches that go on from node to node too often for a join a step.

The files lie in the folder that all executors share, parted by ranges of the source; each has the places where targets
begin, one for every number from its first to its last source, and the targets, ascending. Readers map them, so a task
holds no more of the graph than it looks at. Numbers should have few gaps, as ordinals have.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphlode.storage import shared_dir

#: Targets that are read, and kept, at once; how many are kept.
CHUNK, KEPT = 64, 2_000_000


def local_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path of the file system; None if it is elsewhere (HDFS, an object store)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def write(pairs: DataFrame, folder: str) -> list[tuple[int, str]]:
    """Writes pairs of numbers (s, t), each once; (least source, file) of each file, ascending."""
    at = f"{folder}/adjacency-{uuid.uuid4().hex}"
    os.makedirs(at)
    atexit.register(shutil.rmtree, at, True)

    def one_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that is tried again writes files of another name; only those of the try that counts are told.
        name, sources, begins, n, last = f"{at}/{uuid.uuid4().hex}", [], [], 0, (None, None)
        with open(f"{name}.targets", "wb") as out:
            for b in batches:
                s, t = b.column(0).to_numpy(), b.column(1).to_numpy()
                if not len(s):
                    continue
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
                new[0] = (s[0], t[0]) != last
                last_source, last = last[0], (s[-1], t[-1])
                s, t = s[new], t[new]
                if len(s):
                    first = np.ones(len(s), bool)
                    first[1:] = s[1:] != s[:-1]
                    first[0] = s[0] != last_source
                    sources.append(s[first])
                    begins.append(np.flatnonzero(first) + n)
                    n += len(s)
                    t.astype(np.int64).tofile(out)
        if n:
            there, starts = np.concatenate(sources), np.concatenate([*begins, [n]])
            starts[np.searchsorted(there, np.arange(there[0], there[-1] + 2))].astype(np.int64).tofile(f"{name}.begins")
            yield pa.RecordBatch.from_arrays([pa.array([int(there[0])]), pa.array([name])], names=["least", "file"])

    sorted_ = pairs.select("s", "t").repartitionByRange("s").sortWithinPartitions("s", "t")
    return sorted((r.least, r.file) for r in sorted_.mapInArrow(one_file, "least long, file string").collect())


class Reader:
    """Looks up targets; one for each task."""

    def __init__(self, files: list[tuple[int, str]]):
        self.least, self.names, self.open, self.first, self.kept = [x for x, _ in files], [x for _, x in files], {}, {}, 0

    def _place(self, s: int) -> tuple[np.ndarray, int, int] | None:
        k = bisect_right(self.least, s) - 1
        if k < 0:
            return None
        if k not in self.open:
            self.open[k] = [np.asarray(np.memmap(f"{self.names[k]}.{x}", np.int64, "r")) for x in ("begins", "targets")]
        begins, targets = self.open[k]
        i = s - self.least[k]
        return (targets, int(begins[i]), int(begins[i + 1])) if i + 1 < len(begins) else None

    def unseen(self, s: int, seen: set[int], most: int) -> list[int]:
        """The first targets of s that aren't in seen, `most` of them."""
        head = self.first.get(s)
        if head is None:
            place = self._place(s)
            head = (place[0][place[1] : min(place[2], place[1] + CHUNK)].tolist(), place[2] - place[1]) if place else ([], 0)
            if self.kept > KEPT:
                self.first, self.kept = {}, 0
            self.first[s] = head
            self.kept += len(head[0]) + 1
        out = []
        for t in head[0]:
            if t not in seen:
                out.append(t)
                if len(out) == most:
                    return out
        if head[1] > CHUNK:
            targets, begin, end = self._place(s)
            for i in range(begin + CHUNK, end, CHUNK):
                for t in targets[i : min(end, i + CHUNK)].tolist():
                    if t not in seen:
                        out.append(t)
                        if len(out) == most:
                            return out
        return out
