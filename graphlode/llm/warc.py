"""WARC records: reading, writing and transaction assembly.

A capture leaves a response (or revisit, resource) record, a request and metadata records, each of which names others of
the same capture by WARC-Concurrent-To. assemble() finds each set of records so connected, whichever names which, and
nests it in one row.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphlode.llm.neardup import components
from graphlode.storage import stash

_RECORD = "record_id string, type string, target_uri string, date string, content_type string, concurrent_to array<string>, headers map<string,string>, block binary"
_KEPT = ("record_id", "type", "target_uri", "date", "content_type", "headers", "block")
DATE = "2024-01-01T00:00:00Z"


# -- reading


def parse(raw: bytes) -> dict | None:
    """The fields of one record; None if it isn't one.

    A block shorter than Content-Length is kept as it is; without a valid one the block is all that follows. Of repeated
    headers the last counts, but for WARC-Concurrent-To, whose values are all kept. Missing headers are null.
    """
    if not raw.startswith(b"WARC/"):
        return None
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        return None
    headers: dict[str, str] = {}
    concurrent: list[str] = []
    for line in head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "warc-concurrent-to":
            concurrent.append(value)
        headers[name] = value
    size = headers.get("content-length", "")
    block = rest[: int(size)] if size.isascii() and size.isdigit() else rest
    return {
        "record_id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
        "content_type": headers.get("content-type"), "concurrent_to": concurrent, "headers": list(headers.items()), "block": block,
    }


def parse_records(raw: DataFrame, column: str = "record") -> DataFrame:
    """The records of a column of raw records, one each. Nulls, empty ones and what is no record have no row; repeats stay."""

    kinds = {"record_id": pa.string(), "type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "content_type": pa.string(), "concurrent_to": pa.list_(pa.string()), "headers": pa.map_(pa.string(), pa.string()), "block": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for r in (parse(x) for x in b.column(0).to_pylist() if x is not None) if r]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in kinds.items()], names=list(kinds))

    return raw.select(raw[column].cast("binary").alias("record")).mapInArrow(run, _RECORD)


class _Input:
    """Bytes of a file, plain or in gzip members of any number of records each, inflated as they are asked for.

    A member that is corrupt or cut short gives what could be inflated; what comes after it is looked for at the next
    member's magic number.
    """

    STEP = 1 << 20

    def __init__(self, file: BinaryIO):
        self.file, self.raw, self.ready, self.at = file, b"", bytearray(), 0
        self.zipped, self.member, self.ended = None, None, False

    def _more(self) -> bool:
        """Puts some more bytes into ready; False at the end."""
        if self.at > self.STEP:
            del self.ready[: self.at]
            self.at = 0
        while not self.ended:
            if not self.raw:
                self.raw = self.file.read(self.STEP)
                if not self.raw:
                    self.ended = True
                    return self._flushed()
            if self.zipped is None:
                self.zipped = self.raw[:2] == b"\x1f\x8b"
            if not self.zipped:
                self.ready += self.raw
                self.raw = b""
                return True
            if self.member is None:
                start = self.raw.find(b"\x1f\x8b")
                if start < 0:
                    more = self.file.read(self.STEP)
                    self.raw = self.raw[-1:] + more if more else b""
                    continue
                self.raw, self.member = self.raw[start:], zlib.decompressobj(31)
            before = len(self.ready)
            try:
                self.ready += self.member.decompress(self.raw, 4 * self.STEP)
                ended = self.member.eof
                self.raw = self.member.unused_data if ended else self.member.unconsumed_tail
            except zlib.error:
                ended, self.raw = True, self.raw[2:]
            if ended:
                self.member = None
            if len(self.ready) > before:
                return True
        return False

    def _flushed(self) -> bool:
        """Puts what a member that was cut short still holds into ready."""
        before, member, self.member = len(self.ready), self.member, None
        try:
            self.ready += member.flush() if member else b""
        except zlib.error:
            pass
        return len(self.ready) > before

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer at the end, which stay."""
        while len(self.ready) - self.at < n and self._more():
            pass
        return bytes(self.ready[self.at : self.at + n])

    def until(self, sep: bytes, most: int) -> int:
        """Where sep is next, from the place reached; -1 if it isn't within `most` bytes."""
        seen = self.at
        while True:
            found = self.ready.find(sep, seen)
            if found >= 0 or len(self.ready) - self.at > most:
                return found
            rest = max(0, len(self.ready) - len(sep) + 1 - self.at)
            if not self._more():
                return -1
            seen = self.at + rest

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out


HEAD_BYTES = 1 << 20
_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


def split_file(file: BinaryIO | bytes) -> Iterator[bytes]:
    """The records of a WARC file, plain or in gzip members with one record or many, in one pass over the file.

    Bytes that begin no record are passed over up to the next "WARC/" at the start of a line. A record without a valid
    Content-Length goes up to there too; the last one may be cut short. A head of more than HEAD_BYTES is none.
    """
    data = _Input(io.BytesIO(file) if isinstance(file, bytes) else file)
    while True:
        while data.peek(5) != b"WARC/":  # blank lines between records, or junk
            line = data.until(b"\n", 1 << 62)
            if line < 0:
                return
            data.at = line + 1
        end = data.until(b"\r\n\r\n", HEAD_BYTES)
        if end < 0 or end - data.at > HEAD_BYTES:
            data.at += 5
            continue
        head = data.take(end + 4 - data.at)
        size = _LENGTH.search(head)
        if size:
            yield head + data.take(int(size[1]))
        else:
            after = data.until(b"\nWARC/", 1 << 62)
            yield head + (data.take(after + 1 - data.at) if after >= 0 else data.take(1 << 62)).rstrip(b"\r\n")


def read_warc(spark: SparkSession, path: str, open_file: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """The records of the files under a path.

    A task streams through its files one record at a time, so their sizes don't matter but for how the work is shared
    out. Without open_file the files come by Spark's binaryFile source, which holds a whole file in memory and takes none
    of more than 2 GB; with it (from a path as Spark names it to a binary file) they are opened where the task runs.
    Corrupt and truncated files give the records that can be made out; empty ones none.
    """

    def records(files: Iterator[BinaryIO]) -> Iterator[pa.RecordBatch]:
        for f in files:
            held, size = [], 0
            for r in split_file(f):
                held.append(r)
                size += len(r)
                if size > 4 << 20 or len(held) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from records(io.BytesIO(x.as_buffer()) if open_file is None else open_file(x.as_py()) for x in b.column(0))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_records(files.select("content" if open_file is None else "path").mapInArrow(run, "record binary"))


# -- writing


def _urn(*parts: Column) -> Column:
    m = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12)), F.lit(">"))


def archive(pages: DataFrame) -> DataFrame:
    """(record): the response, request and metadata record of each row (page_id, url, html), as bytes.

    The request and the metadata name the response as concurrent. A null url is about:blank, a null html is empty.
    """
    page, url, html = pages["page_id"].cast("string"), F.coalesce(pages["url"].cast("string"), F.lit("about:blank")), F.coalesce(pages["html"].cast("string"), F.lit(""))
    p = pages.select(page.alias("page"), F.regexp_replace(url, r"[\r\n]", "").alias("url"), html.alias("html")).withColumn("id", _urn(F.lit("response"), F.col("page"), F.col("url"), F.md5("html")))
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1)
    blocks = {
        "response": ("application/http; msgtype=response", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), F.col("html"))),
        "request": ("application/http; msgtype=request", F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))),
        "metadata": ("application/warc-fields", F.concat(F.lit("pageId: "), F.coalesce("page", F.lit("")), F.lit("\r\n"))),
    }

    def record(kind: str) -> Column:
        content, block = blocks[kind]
        own = F.col("id") if kind == "response" else _urn(F.lit(kind), F.col("id"))
        lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), own, F.lit("\r\nWARC-Target-URI: "), F.col("url")]
        if kind != "response":
            lines += [F.lit("\r\nWARC-Concurrent-To: "), F.col("id")]
        lines += [F.lit(f"\r\nContent-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")]
        return F.encode(F.concat(*lines), "UTF-8")

    return p.select(F.explode(F.array(*(record(k) for k in blocks))).alias("record"))


# -- assembly


def assemble(records: DataFrame) -> DataFrame:
    """One row (capture_id, target_uri, request, response, metadata, requests, responses) for each capture.

    request and response are structs of the record's fields, metadata an array of them by record_id. A capture's further
    requests and responses are whole in requests and responses, arrays by record_id; the main ones aren't repeated there.
    revisit and resource records count as responses, but a response goes before them for the main place, then the
    smallest id. A capture without a response has a null one. capture_id is the id of the main response, else the smallest id.
    Records without an id, of other types, and repeats of an id (the first by its block's hash stays) have no place.
    A concurrent id that no record has still connects those that name it; a null in concurrent_to is passed over. Ids are
    compared by 64-bit hashes. Columns that records don't have by WARC are ignored. An empty table gives no row.
    """
    fields = [records[c].alias(c) for c in (*_KEPT, "concurrent_to")]
    kind = F.when(F.lower("type").isin("response", "revisit", "resource"), "response").when(F.lower("type").isin("request", "metadata"), F.lower("type"))
    # The records are read once for their links and once for their contents, so they are stored with their kind.
    r = stash(records.select(*fields).where("record_id IS NOT NULL").withColumn("kind", kind).where("kind IS NOT NULL"), "warc-records")
    links = r.select("record_id", F.explode("concurrent_to").alias("to")).where("record_id <> `to`")
    label = components(links.select(F.xxhash64("record_id").alias("a"), F.xxhash64("to").alias("b")).distinct())
    ids = r.groupBy("record_id", "kind").agg(F.min(F.lower("type") != "response").alias("second")).withColumn("node", F.xxhash64("record_id"))
    labelled = ids.join(label, "node", "left").select("record_id", "kind", "second", F.coalesce("label", "node").alias("g"))
    captures = labelled.groupBy("g").agg(
        F.min(F.when(F.col("kind") == "response", F.struct("second", "record_id")))["record_id"].alias("response_id"),
        F.min(F.when(F.col("kind") == "request", F.col("record_id"))).alias("request_id"),
        F.min("record_id").alias("least"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "response", F.col("record_id")))).alias("all"),
    )
    captures = stash(captures.withColumn("capture_id", F.coalesce("response_id", "least")), "warc-captures")
    whole = F.struct(*_KEPT)
    tie = F.struct(F.xxhash64("block"), "date")
    # Requests' and metadata's contents move twice: to their id, which serves the grouping and the join, and to their capture.
    small = r.where("kind <> 'response'").repartition("record_id").groupBy("record_id", "kind").agg(F.min_by(whole, tie).alias("rec"))
    owner = labelled.where("kind <> 'response'").select("record_id", "g").join(captures.select("g", "capture_id", "request_id"), "g").drop("g")
    is_main = (F.col("kind") == "request") & (F.col("record_id") == F.col("request_id"))
    parts = small.join(owner, "record_id").groupBy("capture_id").agg(
        F.first(F.when(is_main, F.col("rec")), ignorenulls=True).alias("request"),
        F.collect_list(F.when((F.col("kind") == "request") & ~is_main, F.col("rec"))).alias("requests"),
        F.collect_list(F.when(F.col("kind") == "metadata", F.col("rec"))).alias("metadata"),
    )
    light = captures.select("capture_id", "response_id").join(parts, "capture_id", "left")
    heads = r.where("kind = 'response'").select(F.col("record_id").alias("response_id"), whole.alias("response"), tie.alias("tie"))
    # The contents of responses, by far the most bytes, move once: to their id.
    first = heads.groupBy("response_id").agg(F.min_by("response", "tie").alias("response"))
    # A capture with a response has its id, so this join needs no other partitioning than the one by capture.
    joined = light.join(first.withColumnRenamed("response_id", "capture_id"), "capture_id", "left")
    further = captures.select("capture_id", F.explode(F.array_except("all", F.array("response_id"))).alias("further_id"))
    if further.isEmpty():
        joined = joined.withColumn("responses", F.lit(None).cast(joined.select(F.array("response")).schema[0].dataType))
    else:
        more = heads.join(further, F.col("response_id") == F.col("further_id")).groupBy("capture_id", "further_id").agg(F.min_by("response", "tie").alias("rec"))
        joined = joined.join(more.groupBy("capture_id").agg(F.collect_list("rec").alias("responses")), "capture_id", "left")

    def by_id(name: str) -> Column:
        order = f"array_sort({name}, (a, b) -> CASE WHEN a.record_id < b.record_id THEN -1 WHEN a.record_id > b.record_id THEN 1 ELSE 0 END)"
        return F.coalesce(F.expr(order), F.array()).alias(name)

    uri = F.coalesce("response.target_uri", "request.target_uri", F.get("metadata", F.lit(0))["target_uri"])
    return joined.select("capture_id", uri.alias("target_uri"), "request", "response", by_id("metadata"), by_id("requests"), by_id("responses"))


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as WARC records, parsed and assembled again; the nested fields as columns, so that SQL can tell them too."""
    captures = assemble(parse_records(archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    body = F.expr("decode(substring(response.block, instr(decode(response.block, 'UTF-8'), '\r\n\r\n') + 4), 'UTF-8')")
    return captures.select(
        "capture_id", "target_uri", F.col("request.record_id").alias("request_id"), F.split(F.decode("request.block", "UTF-8"), "\r\n")[0].alias("request_line"), F.col("response.record_id").alias("response_id"),
        F.col("response.content_type").alias("response_type"), body.alias("payload"), F.size("metadata").cast("long").alias("n_metadata"), F.decode(F.col("metadata")[0]["block"], "UTF-8").alias("metadata_fields"),
    )


def _sql() -> str:
    def urn(*parts: str) -> str:
        m = f"md5({' || chr(124) || '.join(parts)})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({m}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    return f"""
WITH p AS (SELECT DISTINCT page_id, url, html, {urn("'response'", "page_id::VARCHAR", "url", "md5(html)")} AS id FROM pages)
SELECT id AS capture_id, url AS target_uri, {urn("'request'", "id")} AS request_id,
       'GET ' || regexp_replace(url, '^[a-z]+://[^/]*', '') || ' HTTP/1.1' AS request_line, id AS response_id,
       'application/http; msgtype=response' AS response_type, html AS payload, 1::BIGINT AS n_metadata,
       'pageId: ' || page_id::VARCHAR || chr(13) || chr(10) AS metadata_fields
FROM p"""


SQL = _sql()
