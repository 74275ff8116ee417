"""Files read in tasks, each with its fingerprint before and after.

A plan of files becomes pieces, dealt over tasks; every task gives its lines and a row
that says whether the file stood still.  Lines of a file that changed or failed are left out; a changed file is looked
at anew and read again, three times in all, and then counts as failed.  Paths travel as they are:
nothing takes them for URLs or patterns, and no list of files passes through the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import save
from .discovery import HEAD, NAMES, fingerprint
from .documents import BrokenDocument, objects
from .jsonl import BATCH_BYTES, SCHEMA, SPLIT_BYTES, Piece, open_regular, piece_lines

PRINT = "dev bigint, inode bigint, size bigint, mtime_ns bigint, head_hash string, head_length int"
PRINTS = [c.split(" ")[0] for c in PRINT.split(", ")]
ATTEMPTS = 3
CHANGED = "changed"
#: Lines have a null state; a piece's last row has one, ``ok``, ``changed`` or what went wrong.
ROWS = SCHEMA + ", state string"
ARROW = pa.schema([("agent", pa.string()), ("path", pa.string()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("raw", pa.string()), ("state", pa.string())])


def is_snapshot(path: Column) -> Column:
    return F.lower(path).endswith(".json")


def moved_on(planned: dict, now: dict, snapshot: bool) -> bool:
    """Whether a file is no longer the one planned.  A log may grow meanwhile, a snapshot may not change at all."""
    if snapshot:
        return any(planned[c] != now[c] for c in PRINTS)
    other = planned["dev"] != now["dev"] or planned["inode"] != now["inode"] or now["size"] < planned["size"]
    return other or (planned["head_length"] > 0 and planned["head_hash"] != now["head_hash"]) or (now["size"] == planned["size"] and now["mtime_ns"] != planned["mtime_ns"])


def _document(path: str) -> Iterator[tuple[int, int, str]]:
    with open_regular(path) as f:
        for at, data in objects(f):
            yield at, len(data), data.decode("utf-8", "replace")


def _read(p: dict) -> Iterator[tuple]:
    """Rows of one piece; the last tells how it went."""
    path, snapshot = p["path"], p["path"].lower().endswith(".json")
    head = p["head_length"] or HEAD
    try:
        if moved_on(p, fingerprint(path, head), snapshot):
            yield p["agent"], path, None, None, None, CHANGED
            return
        try:
            rows = _document(path) if snapshot else piece_lines(Piece(p["agent"], path, p["begin"], p["stop"], p["begin"] == p["start"], p["size"]))
            for at, length, text in rows:
                yield p["agent"], path, at, length, text, None
            state = "ok"
        except BrokenDocument as e:
            state = str(e)
        yield p["agent"], path, None, None, None, CHANGED if moved_on(p, fingerprint(path, head), snapshot) else state
    except OSError as e:
        yield p["agent"], path, None, None, None, e.strerror or str(e)


def _batches(batches) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        for p in b.to_pylist():
            for row in _read(p):
                held.append(row)
                size += 64 + (row[3] or 0)
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def read_pieces(todo: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """Rows of the planned files: logs in pieces of ``split`` bytes, snapshots whole."""
    whole = is_snapshot(F.col("path")) | (F.col("start") >= F.col("size"))
    begins = F.when(whole, F.array("start")).otherwise(F.sequence("start", F.greatest(F.col("size") - 1, F.col("start")), F.lit(split).cast("bigint")))
    pieces = todo.select("agent", "path", "start", *PRINTS, F.explode(begins).alias("begin")).withColumn("stop", F.least(F.col("begin") + split, F.col("size")))
    # A number of tasks of its own: pieces are small rows that stand for much to read, so they may not be put together by size.
    tasks = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, F.xxhash64("agent", "path", "begin")).mapInArrow(_batches, ROWS)


def _prints(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.itertuples(index=False):
        try:
            out.append((r.agent, r.path, *[fingerprint(r.path)[c] for c in PRINTS], None))
        except OSError as e:
            out.append((r.agent, r.path, *[None] * len(PRINTS), e.strerror or str(e)))
    return pd.DataFrame(out, columns=["agent", "path", *PRINTS, "error"], dtype=object)


def look_again(files: DataFrame) -> DataFrame:
    """Fingerprints of files as they are now, taken in tasks; ``error`` where there is none."""
    return files.select("agent", "path").mapInPandas(lambda frames: (_prints(f) for f in frames), f"agent string, path string, {PRINT}, error string")


LISTED = "agent string, root_id bigint, path string, kind string, detail string"


def _list(agent: str, root_id: int, folder: str) -> Iterator[tuple]:
    """What lies in a folder: ``folder``, ``file`` (of the agent's names), or the folder itself as ``failure``."""
    pattern = re.compile("(^|/)" + NAMES[agent], re.I)
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if e.name.startswith("."):
                    continue
                if e.is_dir(follow_symlinks=False):
                    yield agent, root_id, e.path, "folder", None
                elif not e.is_dir() and pattern.search(e.path.lower()):
                    yield agent, root_id, e.path, "file", None
    except OSError as e:
        yield agent, root_id, folder, "failure", e.strerror or str(e)


def discover_in_tasks(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(files, failures)`` below the roots ``(agent, id, path)``: folders are listed level by level and heads hashed in tasks.

    The same files as :func:`discovery.discover` finds, with ``root_id`` and their fingerprints; ``failures(agent, root_id, path, error)`` are
    folders that could not be listed and files that could not be read.  The driver learns only whether a level has folders.
    """
    tasks = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pa.schema([(f.split(" ")[0], pa.int64() if "bigint" in f else pa.string()) for f in LISTED.split(", ")])

    def listed(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [r for p in b.to_pylist() for r in _list(p["agent"], p["root_id"], p["path"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True) if got else [[]] * len(rows), rows, strict=True)], schema=rows)

    level = roots.select("agent", F.col("id").cast("bigint").alias("root_id"), F.coalesce(F.nullif(F.regexp_replace("path", "/+$", ""), F.lit("")), F.lit("/")).alias("path"))
    seen = []
    while True:
        below = save(level.repartition(tasks, F.xxhash64("agent", "path")).mapInArrow(listed, LISTED), "listed")
        seen.append(below)
        level = below.where("kind = 'folder'").select("agent", "root_id", "path")
        if level.isEmpty():
            break
    everything = reduce(DataFrame.unionByName, seen)
    files = everything.where("kind = 'file'").select("agent", "root_id", "path")
    # Of a place under two roots the deeper listing counts once: its first root.
    files = files.groupBy("agent", "path").agg(F.min("root_id").alias("root_id"))
    prints = save(look_again(files.repartition(tasks, F.xxhash64("agent", "path"))), "prints")
    found = prints.where("error is null").drop("error").join(files, ["agent", "path"])
    failures = everything.where("kind = 'failure'").select("agent", "root_id", "path", F.col("detail").alias("error"))
    return found, failures.unionByName(prints.where("error is not null").join(files, ["agent", "path"]).select("agent", "root_id", "path", "error"))


def head_at(path: Column, length: Column) -> Column:
    """Digest of a file's first bytes, null without a path or where the file cannot be read."""

    @F.pandas_udf("string")
    def digest(paths: pd.Series, lengths: pd.Series) -> pd.Series:
        def one(p, n):
            try:
                return fingerprint(p, int(n))["head_hash"] if p is not None and n else None
            except OSError:
                return None

        return pd.Series([one(p, n) for p, n in zip(paths, lengths, strict=True)], dtype=object)

    return digest(path, length)


def read_verified(todo: DataFrame, again: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS, split: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lines, files)``: the lines of files that stood still, and every file of ``todo`` as it was read at last, with ``error``, null for those.

    ``again`` plans files anew from their fingerprints (``agent, path`` and ``PRINT``), with the columns of ``todo``.
    """
    lines, files, left = [], [], todo
    for attempt in range(1, attempts + 1):
        rows = save(read_pieces(left, split), "read")
        # Of a piece that failed and one that changed, the change decides: the file is read again.
        state = rows.where("state is not null and state <> 'ok'").groupBy("agent", "path").agg(F.max(F.struct(F.col("state") == CHANGED, "state"))["state"].alias("error"))
        if attempt == attempts:
            state = state.withColumn("error", F.when(F.col("error") == CHANGED, f"changed {attempts} times while it was read").otherwise(F.col("error")))
        out = save(left.join(state, ["agent", "path"], "left"), "tried")
        done = out.where(F.coalesce(F.col("error") != CHANGED, F.lit(True)))
        lines.append(rows.where("state is null").join(done.where("error is null").select("agent", "path"), ["agent", "path"], "left_semi").drop("state"))
        files.append(done)
        changed = out.where(F.col("error") == CHANGED)
        if attempt == attempts or changed.isEmpty():
            break
        now = save(look_again(changed), "looked")
        lost = changed.drop("error").join(now.where("error is not null").select("agent", "path", "error"), ["agent", "path"])
        files.append(lost.select(*out.columns))
        left = save(again(now.where("error is null").drop("error")), "again")
    everything = lines[0]
    for x in lines[1:]:
        everything = everything.unionByName(x)
    told = files[0]
    for x in files[1:]:
        told = told.unionByName(x)
    return everything, told


