"""Versions of tables, copied on write by bucket.

Rows of a file lie in the bucket of its id, in each table.  A run writes only the buckets it touches, each into a
folder of its own version, and then a manifest that names every bucket's version; the
last thing it writes is the pointer to that manifest, which can be created once
only, so of two runs from one version the second is refused.  A run that dies leaves the version before it whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import create_text, names_in, read_text, remove

BUCKETS = 256
HOUR_MS = 3_600_000


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


class Store:
    """``schemas`` names the tables; ``keys`` the column whose hash is a table's bucket, tables without one are written whole.

    ``hours`` names tables whose key is a time in milliseconds: an hour shares a bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: Mapping[str, str], keys: Mapping[str, str], hours: Iterable[str] = (), buckets: int = BUCKETS):
        self.spark, self.folder, self.schemas, self.keys, self.hours = spark, folder.rstrip("/"), dict(schemas), dict(keys), set(hours)
        held = self.manifest()
        self.buckets = held["buckets"] if held else buckets

    def position(self) -> int:
        """Number of the last committed version, 0 before the first."""
        return max((int(n) for n in names_in(self.spark, f"{self.folder}/versions") if n.isdigit()), default=0)

    def manifest(self, position: int | None = None) -> dict | None:
        position = self.position() if position is None else position
        while position:
            name = read_text(self.spark, f"{self.folder}/versions/{position:012d}")
            if name:
                return {**json.loads(read_text(self.spark, f"{self.folder}/manifests/{name}")), "position": position, "version": name}
            position -= 1  # a pointer whose writer died has no name in it
        return None

    def current(self) -> str | None:
        held = self.manifest()
        return held["version"] if held else None

    def bucket(self, table: str, key: Column | None = None) -> Column:
        if table not in self.keys:
            return F.lit(0)
        key = F.col(self.keys[table]) if key is None else key
        key = F.floor(key / HOUR_MS) if table in self.hours else key
        return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(self.buckets)).cast("int")

    def read(self, table: str, manifest: dict | None, only: Iterable[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets; other buckets' files are not opened."""
        live = {int(b): v for b, v in (manifest or {"tables": {}})["tables"].get(table, {}).items()}
        wanted = sorted(live if only is None else live.keys() & set(only))
        if not wanted:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.folder}/{table}/{live[b]}/bucket={b}" for b in wanted])

    def tables(self, manifest: dict | None = None) -> dict[str, DataFrame]:
        """All tables of a version, the last one by default; empty ones before the first run."""
        manifest = manifest or self.manifest()
        return {n: self.read(n, manifest) for n in self.schemas}

    def commit(self, changed: Mapping[str, DataFrame], touched: Mapping[str, Iterable[int]], base: dict | None) -> str:
        """Writes the touched buckets of the changed tables and then the version, which follows ``base``.

        A table's rows must be all there are of its touched buckets; a touched bucket without rows is empty from now on.
        """
        version = uuid.uuid4().hex[:16]
        tables = {n: dict(held) for n, held in (base or {"tables": {}})["tables"].items()}
        for name, df in changed.items():
            cols = [F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in self.schemas[name].split(", ")]
            rows = df.select(*cols).withColumn("bucket", self.bucket(name))
            path = f"{self.folder}/{name}/{version}"
            # A large bucket is written by many tasks, small ones share one.
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *[c for c in ("id",) if c in df.columns]).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
            filled = {n.removeprefix("bucket=") for n in names_in(self.spark, path) if n.startswith("bucket=")}
            held = tables.setdefault(name, {})
            for b in map(str, touched[name]):
                held.pop(b, None)
            held.update({b: version for b in filled})
        create_text(self.spark, f"{self.folder}/manifests/{version}", json.dumps({"tables": tables, "buckets": self.buckets}))
        after = base["position"] + 1 if base else 1
        if self.position() >= after or not create_text(self.spark, f"{self.folder}/versions/{after:012d}", version):
            raise Conflict(f"version {after} is there already")
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Removes buckets that none of the last ``keep`` versions names; the number removed.  Not while a run is under way."""
        last = self.position()
        live = {(n, v) for p in range(max(1, last - keep + 1), last + 1) for n, held in (self.manifest(p) or {"tables": {}})["tables"].items() for v in held.values()}
        gone = 0
        for table in self.schemas:
            for v in names_in(self.spark, f"{self.folder}/{table}"):
                if (table, v) not in live:
                    remove(self.spark, f"{self.folder}/{table}/{v}")
                    gone += 1
        return gone
