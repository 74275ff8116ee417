"""Files that grow in place, as a streaming source whose offset is each file's last newline.

``spark.readStream.format("jsonl_growing").option("agent", ...).option("root", ...)``.  The offset is a map from path to
``[device, inode, place]``; Spark's checkpoint keeps it, so every complete line is in one batch, also
after a restart.  A file that was replaced or cut short begins anew.  The map holds the
files of one root: a very large tree is followed as several streams.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from .discovery import candidates
from .jsonl import BATCH_BYTES, SCHEMA, SPLIT_BYTES, Piece, _batch, last_newline, piece_lines


def _state(agent: str, root: str) -> dict[str, list[int]]:
    out = {}
    for path in candidates(agent, root):
        if path.lower().endswith(".json"):
            continue  # a snapshot does not grow, it is replaced
        try:
            st = os.stat(path)
            out[path] = [st.st_dev, st.st_ino, last_newline(path, 0)]
        except OSError:  # gone or unreadable: its offset stays as it was
            continue
    return out


class _Stream(DataSourceStreamReader):
    def __init__(self, agent: str, root: str, split: int):
        self.agent, self.root, self.split = agent, root, split
        self.known: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # A file that is gone keeps its last offset, so its return is seen for what it is.
        self.known = {**self.known, **_state(self.agent, self.root)}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, (dev, inode, stop) in sorted(end.items()):
            old = start.get(path)
            begin = old[2] if old and old[:2] == [dev, inode] and old[2] <= stop else 0
            out += [Piece(self.agent, path, a, min(stop, a + self.split), a == begin, stop) for a in range(begin, stop, self.split)]
        return out or [Piece(self.agent, "", 0, 0, True, 0)]

    def read(self, p: Piece) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for at, length, text in piece_lines(p):
            held.append((p.agent, p.path, at, length, text))
            size += length
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


class GrowingJsonl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_growing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["agent"], self.options["root"], int(self.options.get("splitbytes", SPLIT_BYTES)))


def growing_lines(spark: SparkSession, agent: str, root: str, split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(GrowingJsonl)
    return spark.readStream.format("jsonl_growing").option("agent", agent).option("root", root).option("splitbytes", str(split)).load()
