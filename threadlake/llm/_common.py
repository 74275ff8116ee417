"""Helpers shared by the operators: tables in the shared folder, row ids, components.

An operator that reads its input more than once first writes it with
:func:`stage`, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets one of its own; on a cluster that would be a folder nobody else sees, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="threadlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (kept := _kept.get()) is not None:
        kept.append(path)
    return path


_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


@contextmanager
def noting(paths: list[str]):
    """Adds to ``paths`` all tables written meanwhile, so :func:`release` can remove them once their reader is done."""
    token = _kept.set(paths)
    try:
        yield
    finally:
        _kept.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nobody reads any more."""
    while paths:
        _delete(spark, paths.pop())


@contextmanager
def _shuffle_files_go(spark: SparkSession):
    """Shuffle files are removed as soon as the query is done, not when the driver next collects garbage: a written table needs none of them."""
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if old is None else spark.conf.set(SHUFFLE_CLEANUP, old)


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _shuffle_files_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`save` wrote and no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df.saved_at)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, tag: str, **cols) -> DataFrame:
    """A saved table with ``rid``, unique for each row, and the given columns.

    ``rid`` is fixed once written, so repeated rows and null or repeated ids stay apart.
    """
    return save(df.select(F.monotonically_increasing_id().alias("rid"), *[c.alias(n) for n, c in cols.items()]), tag)


def record(df: DataFrame):
    """All columns of a row as one struct, so none clashes with an operator's own."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def numbered(df: DataFrame, *order) -> DataFrame:
    """Adds ``place``, the row's number from 0 in the order given; pieces of a range exchange count on their own, so no task holds all rows."""
    ordered = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ordered = save(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_piece", F.shiftright("_at", 33)), "ordered")
    pieces = ordered.groupBy("_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a piece
    pieces = pieces.select("_piece", "_first", earlier.alias("_before"))
    return ordered.join(pieces, "_piece").withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_piece", "_first", "_before")


def ascii_lower(col):
    """A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)



def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)``; comp is the smallest node reachable.

    Alternates two star contractions: a node hangs its larger neighbours, then
    its smaller ones, on the smallest; the edge set shrinks to stars in about
    log rounds, and ends as soon as it is stars.  Each round is a partial ``min`` and a join on the node, so a
    hub's edges are pre-aggregated, and AQE splits the join's hot partitions.
    """
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, edges = edges, save(small, tag)
        drop(old)
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).groupBy("e.node")
        # All are stars, each on its smallest node, once no node hangs on two, or hangs on one and holds others.
        if ends.agg(F.sum("e.up").alias("up"), F.min("e.up").alias("holds")).where("up > 1 or (up = 1 and holds = 0)").isEmpty():
            break
    leaves = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
