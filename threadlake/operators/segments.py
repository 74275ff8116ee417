"""A search index under change: immutable segments of postings, sets of deleted ids, figures as sums.

A change writes one segment of the messages that came and one set of the ids that went
(a message rewritten is in both); nothing stored before is touched.  Segments of one
size are merged into the next once there are ``FANOUT`` of them, so a posting is rewritten a logarithmic number of
times.  A posting knows its section, so one index serves every scope, and a phrase never runs from one section into the next.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sections import SCOPES
from ..storage import create_text, names_in, read_text, remove, save
from .search import POSTING, SECTION, Index, fold, lengths, texts_of
from .store import Conflict

FANOUT = 8
DOCS = "id bigint, first int, ns array<int>"
IDS = "id bigint"
WIDEST = SCOPES["everything"]


class Segments:
    """The index in one folder.  ``log`` is its state: segments ``(name, rows, applied)``, deletions ``(name, seq)``, the last ``seq``, figures."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout

    def _last(self) -> int:
        return max((int(n) for n in names_in(self.spark, f"{self.folder}/log") if n.isdigit()), default=0)

    def log(self) -> dict:
        at = self._last()
        if not at:
            return {"segments": [], "deletions": [], "seq": 0, "figures": [[0, 0] for _ in WIDEST]}
        return json.loads(read_text(self.spark, f"{self.folder}/states/{read_text(self.spark, f'{self.folder}/log/{at:012d}')}"))

    def _commit(self, log: dict, after: int) -> None:
        name = uuid.uuid4().hex[:16]
        create_text(self.spark, f"{self.folder}/states/{name}", json.dumps(log))
        if self._last() != after or not create_text(self.spark, f"{self.folder}/log/{after + 1:012d}", name):
            raise Conflict(f"state {after + 1} is there already")

    def _pending(self, log: dict, segment: dict) -> DataFrame | None:
        """Ids deleted since the segment was written."""
        names = [d["name"] for d in log["deletions"] if d["seq"] > segment["applied"]]
        return self.spark.read.schema(IDS).parquet(*[f"{self.folder}/{n}/deleted" for n in names]) if names else None

    def _live(self, log: dict, table: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        """Rows of the segments that are not deleted.  Segments with the same deletions ahead of them are one scan."""
        by_pending: dict[int, list[dict]] = {}
        for s in log["segments"] if segments is None else segments:
            by_pending.setdefault(sum(d["seq"] > s["applied"] for d in log["deletions"]), []).append(s)
        out = self.spark.createDataFrame([], schema)
        for own in by_pending.values():
            rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{s['name']}/{table}" for s in own])
            gone = self._pending(log, own[0])
            out = out.unionByName(rows if gone is None else rows.join(gone, "id", "left_anti"))
        return out

    def _figures(self, docs: DataFrame) -> list[list[int]]:
        """For each scope how many messages have text there, and their tokens."""
        cols = [c for k in range(len(WIDEST)) for c in (F.count(F.when(F.col("first") <= k, 1)), F.coalesce(F.sum(F.when(F.col("first") <= k, F.col("ns")[k])), F.lit(0)))]
        row = docs.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return [[row[2 * k], row[2 * k + 1]] for k in range(len(WIDEST))]

    def _write(self, postings: DataFrame, docs: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex[:16]}"
        docs.sortWithinPartitions("id").write.option("compression", "zstd").parquet(f"{self.folder}/{name}/docs")
        postings.sortWithinPartitions("token", "id").write.option("compression", "zstd").parquet(f"{self.folder}/{name}/postings")
        return name

    def update(self, added: DataFrame | None = None, deleted: DataFrame | None = None, id_col: str = "id", sections: Mapping[str, Column] | None = None) -> None:
        """One change: messages that came or were rewritten, and ids that went.

        ``added`` has an id and the sections of :data:`WIDEST`, or ``sections`` says where they are (absent ones are empty).
        Ids are those of messages, one row each; a null or repeated id is not one.  A change without rows changes nothing.
        """
        at, log = self._last(), self.log()
        gone = deleted.select(F.col(id_col).cast("bigint").alias("id")) if deleted is not None else None
        texts = None
        if added is not None:
            where = [(sections or {}).get(n) if sections is not None else F.col(n) for n in WIDEST]
            texts = save(texts_of(added, id_col, [F.coalesce(c, F.lit("")) if c is not None else F.lit("") for c in where]), "texts")
            named = added.select(F.col(id_col).cast("bigint").alias("id"))
            gone = named if gone is None else gone.unionByName(named)
        # Only ids that are in the index are deleted, and what they counted is taken off the sums.
        seq = log["seq"] + 1
        figures = log["figures"]
        if gone is not None and log["segments"]:
            lost = save(self._live(log, "docs", DOCS).join(gone.distinct(), "id", "left_semi"), "lost")
            off = self._figures(lost)
            if any(n for pair in off for n in pair):
                name = f"deletion-{uuid.uuid4().hex[:16]}"
                lost.select("id").write.option("compression", "zstd").parquet(f"{self.folder}/{name}/deleted")
                log["deletions"].append({"name": name, "seq": seq})
                figures = [[a - c, b - d] for (a, b), (c, d) in zip(figures, off, strict=True)]
        if texts is not None:
            docs = save(lengths(texts), "docs")
            n = docs.count()
            if n:
                log["segments"].append({"name": self._write(fold(texts), docs), "rows": n, "applied": seq})
                figures = [[a + c, b + d] for (a, b), (c, d) in zip(figures, self._figures(docs), strict=True)]
        log |= {"seq": seq, "figures": figures}
        self._merge(log)
        self._commit(log, at)

    def _merge(self, log: dict) -> None:
        """Segments of one size class become one, without what was deleted of them, while there are ``fanout`` of them."""
        while True:
            classes: dict[int, list[dict]] = {}
            for s in log["segments"]:
                classes.setdefault(int(math.log(max(1, s["rows"]), self.fanout)), []).append(s)
            full = next((c for c in classes.values() if len(c) >= self.fanout), None)
            if full is None:
                break
            docs = self._live(log, "docs", DOCS, full)
            n = docs.count()
            log["segments"] = [s for s in log["segments"] if s not in full]
            if n:
                log["segments"].append({"name": self._write(self._live(log, "postings", POSTING, full), docs), "rows": n, "applied": log["seq"]})
        least = min((s["applied"] for s in log["segments"]), default=log["seq"])
        log["deletions"] = [d for d in log["deletions"] if d["seq"] > least]

    def index(self, scope: str = "everything") -> Index:
        """The index as one scope sees it, for :func:`search.match`, :func:`search.bm25` and :func:`search.search`."""
        k = len(SCOPES[scope]) - 1
        log = self.log()
        total, length = log["figures"][k]
        places = F.filter("positions", lambda p: p < (k + 1) * SECTION) if k < len(WIDEST) - 1 else F.col("positions")
        rows = self._live(log, "postings", POSTING).select("token", "id", places.alias("positions"), F.col("ns")[k].alias("n")).where(F.size("positions") > 0)
        return Index(rows, self.spark.createDataFrame([(total, length / total if total else 0.0)], "total bigint, avg_len double"))

    def vacuum(self) -> int:
        """Removes segments and deletions that the last state does not name; the number removed.  Not while a change is under way."""
        log = self.log()
        live = {x["name"] for x in (*log["segments"], *log["deletions"])}
        dead = [n for n in names_in(self.spark, self.folder) if n.startswith(("segment-", "deletion-")) and n not in live]
        for n in dead:
            remove(self.spark, f"{self.folder}/{n}")
        return len(dead)
