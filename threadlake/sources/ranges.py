"""Records read again from their own bytes: ranges in order of file and place, neighbours in one read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jsonl import BATCH_BYTES, SCHEMA, _batch, open_regular

#: Ranges no further apart than this are read together, up to so many bytes; one task gets a stretch of a file.
GAP, MOST_READ, STRETCH = 64 << 10, 8 << 20, 256 << 20


def reads(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """``(start, stop, members)`` of each read that serves the ranges ``(offset, length)``, which come in order of their offset."""
    start = stop = 0
    members: list[tuple[int, int]] = []
    for at, length in ranges:
        if members and (at - stop > gap or max(stop, at + length) - start > most):
            yield start, stop, members
            members = []
        if not members:
            start = stop = at
        stop = max(stop, at + length)
        members.append((at, length))
    if members:
        yield start, stop, members


def _file(agent: str, path: str, wanted: list[tuple[int, int]]) -> Iterator[tuple]:
    """Rows of one file; a file that is gone or too short gives those it still holds."""
    try:
        with open_regular(path) as f:
            for start, stop, members in reads(wanted):
                f.seek(start)
                data = f.read(stop - start)
                for at, length in members:
                    piece = data[at - start : at - start + length]
                    if len(piece) == length:
                        yield agent, path, at, length, piece.decode("utf-8", "replace")
    except OSError:
        return


def read_ranges(places: DataFrame) -> DataFrame:
    """The bytes of ``places(agent, path, byte_offset, byte_length)`` as lines; each place once, and only these bytes and small gaps between them are read."""
    spots = places.select("agent", "path", "byte_offset", "byte_length").where("byte_length > 0").distinct()
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spots.repartition(tasks, "path", F.floor(F.col("byte_offset") / STRETCH)).sortWithinPartitions("agent", "path", "byte_offset", "byte_length")

    def run(batches) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        wanted: list[tuple[int, int]] = []
        held, size = [], 0

        def rows(batches):
            nonlocal own, wanted
            for b in batches:
                for agent, path, at, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (agent, path) != own or len(wanted) == 10_000:
                        if own:
                            yield from _file(*own, wanted)
                        own, wanted = (agent, path), []
                    wanted.append((at, length))
            if own:
                yield from _file(*own, wanted)

        for row in rows(batches):
            held.append(row)
            size += row[3]
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return dealt.mapInArrow(run, SCHEMA)
