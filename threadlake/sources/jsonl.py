"""Lines of append-only JSONL files with their byte ranges, as a Spark data source.

``spark.read.format("jsonl_bytes").option("files", json)`` where ``files`` is a
JSON list of ``[agent, path, start, end]``; ``end`` may be null for all there
is.  Only lines closed by a newline are records; a carriage return before it
goes; blank lines give none; the rest waits for the next pass.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

SPLIT_BYTES, CHUNK, BATCH_BYTES = 64 << 20, 256 << 10, 8 << 20
SCHEMA = "agent string, path string, byte_offset bigint, byte_length bigint, raw string"


class Piece(InputPartition):
    def __init__(self, agent: str, path: str, start: int, end: int, first: bool, limit: int):
        self.agent, self.path, self.start, self.end, self.first, self.limit = agent, path, start, end, first, limit


def open_regular(path: str):
    """A regular file only: pipes and devices are refused before they can block."""
    fd = os.open(path, os.O_RDONLY | os.O_NONBLOCK)
    if not stat.S_ISREG(os.fstat(fd).st_mode):
        os.close(fd)
        raise OSError(f"not a regular file: {path}")
    return os.fdopen(fd, "rb")


def last_newline(path: str, start: int, end: int | None = None) -> int:
    """End of the last complete line in ``[start, end)``; ``start`` if there is none."""
    with open_regular(path) as f:
        at = os.fstat(f.fileno()).st_size if end is None else min(end, os.fstat(f.fileno()).st_size)
        while at > start:
            low = max(start, at - CHUNK)
            f.seek(low)
            k = f.read(at - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return start


class JsonlBytes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_bytes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), int(self.options.get("splitbytes", SPLIT_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, files: list, split: int):
        self.files, self.split = files, split

    def partitions(self) -> list[Piece]:
        out = []
        for agent, path, start, end in self.files:
            stop = os.path.getsize(path) if end is None else end  # an open last line is left out by the task that reads it
            out += [Piece(agent, path, a, min(stop, a + self.split), a == start, stop) for a in range(start, stop, self.split)]
        return out or [Piece("", "", 0, 0, True, 0)]

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the piece, in Arrow batches; a line cut by its start belongs to the piece before."""
        held, size = [], 0
        for at, length, text in piece_lines(p):
            held.append((p.agent, p.path, at, length, text))
            size += length
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def piece_lines(p: Piece) -> Iterator[tuple[int, int, str]]:
    """``(place, length, text)`` of lines that begin in the piece."""
    if p.start >= p.end:
        return
    with open_regular(p.path) as f:
        at = p.start
        if not p.first:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        while at < p.end:
            line = f.readline()
            if not line.endswith(b"\n") or at + len(line) > p.limit:
                return
            body = line[:-1].removesuffix(b"\r")
            if body:
                yield at, len(body), body.decode("utf-8", "replace")
            at += len(line)


ARROW = pa.schema([("agent", pa.string()), ("path", pa.string()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("raw", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def with_offsets(rows: DataFrame) -> DataFrame:
    """Byte places of lines that Spark's text reader gave (``agent, value, path, block, size`` in their order).

    Each split's lines run on from the totals of the splits before; a file's last line without a newline is left out.
    """
    own = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_n", F.octet_length("value") + F.lit(1).cast("bigint"))
    inside = Window.partitionBy("path", "block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("path", "block").agg(F.sum("_n").alias("_total"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("path", "block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    placed = own.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["path", "block"])
    line = F.regexp_replace("value", r"\r\z", "")
    placed = placed.withColumn("byte_offset", F.col("_start") + F.col("_before")).where(F.col("byte_offset") + F.col("_n") <= F.col("size"))
    return placed.select("agent", "path", "byte_offset", F.octet_length(line).cast("bigint").alias("byte_length"), line.alias("raw")).where("raw <> ''")


def plain_path(uri: Column) -> Column:
    """The path behind a file's URI, as Spark's own readers name it: what the URI escapes is written out again."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(uri, r"\+", "%2B")), "^file:/*", "/")


def pattern_of(path: str) -> str:
    """A path that Spark's readers take for itself and not for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def text_lines(reader, agent: str, paths: list[str] | str) -> DataFrame:
    """Lines by Spark's own text reader, which splits large files and reads any storage; what :func:`with_offsets` takes."""
    rows = reader.format("text").option("lineSep", "\n").load([pattern_of(p) for p in paths] if isinstance(paths, list) else paths)
    return rows.select(F.lit(agent).alias("agent"), "value", plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def read_lines(spark: SparkSession, files: list[tuple[str, str, int, int | None]], split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(JsonlBytes)
    return spark.read.format("jsonl_bytes").option("files", json.dumps(files)).option("splitbytes", str(split)).load()


def read_range(path: str, offset: int, length: int) -> bytes:
    """One record again, by its place."""
    with open_regular(path) as f:
        f.seek(offset)
        return f.read(length)


_STRING = rb'"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)'
_STRINGS, _TOKENS = re.compile(_STRING, re.S), re.compile(_STRING + rb"|[{}\]]", re.S)
_ARRAY = re.compile(rb"[ \t\r\n]*:[ \t\r\n]*\[")


def object_ranges(data: bytes, key: str = "messages") -> list[tuple[int, int]]:
    """Start and length of each object in the first array under ``key``, in bytes; of a document that breaks off, those that are whole."""
    name = f'"{key}"'.encode()
    array = next((a for m in _STRINGS.finditer(data) if m.group() == name and (a := _ARRAY.match(data, m.end()))), None)
    out, depth, start = [], 0, 0
    for m in _TOKENS.finditer(data, array.end()) if array else ():
        token = m.group()
        if token == b"{":
            start, depth = (m.start(), 1) if depth == 0 else (start, depth + 1)
        elif token == b"}" and depth:
            depth -= 1
            if depth == 0:
                out.append((start, m.end() - start))
        elif token == b"]" and depth == 0:
            break
    return out


def nested_objects(documents: DataFrame, key: str = "messages") -> DataFrame:
    """Each object of the first array under ``key`` as a row with its byte range; ``documents`` has ``agent, path`` and the file's bytes as ``content``.  A null or an empty file gives no rows."""

    @F.pandas_udf("array<struct<byte_offset:bigint,byte_length:bigint,raw:string>>")
    def ranges(contents: pd.Series) -> pd.Series:
        return pd.Series([[{"byte_offset": a, "byte_length": n, "raw": d[a : a + n].decode("utf-8", "replace")} for d in [bytes(c or b"")] for a, n in object_ranges(d, key)] for c in contents], dtype=object)

    return documents.select("agent", "path", F.explode(ranges("content")).alias("at")).select("agent", "path", "at.*")
