"""Structured Streaming over growing logs.

Files that come whole are listed by Spark's file source, files that grow in place by
:mod:`sources.growing`; the checkpoint remembers what is committed, and
each micro-batch is parsed and appended once.  No watermark: a late record
is a record like any other and finds its place by its time stamp at query time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions.scalar import string_at
from ..operators.ingest import first_write
from ..sources import adapters
from ..sources.growing import growing_lines
from ..sources.jsonl import SPLIT_BYTES, text_lines, with_offsets
from ..storage import save

KEY = ("agent", "path", "source_key")
#: Folders of a table that streams append to.
SLOTS = 256


def line_stream(spark: SparkSession, folder: str, agent: str, max_files: int = 1000) -> DataFrame:
    """Lines of files that come into a folder whole, one file a rollover; files that grow in place are followed by byte (:func:`follow`)."""
    return text_lines(spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true"), agent, folder)


def append_new(batch: DataFrame, path: str, key: tuple[str, ...] = KEY) -> None:
    """Appends rows whose key is not stored; of repeated keys in the batch the first to arrive.

    The table is partitioned by a hash of the file, so a batch reads only the folders its own files fall in.
    """
    spark = batch.sparkSession
    fresh = save(first_write(batch, *key).withColumn("slot", F.pmod(F.xxhash64("agent", "path"), F.lit(SLOTS)).cast("int")), "batch")
    touched = [r["slot"] for r in fresh.select("slot").distinct().collect()]  # at most SLOTS
    try:
        stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("slot").isin(touched))
        fresh = fresh.join(stored.select(*key), list(key), "left_anti")
    except AnalysisException:  # nothing stored yet
        pass
    fresh.write.mode("append").partitionBy("slot").parquet(path)


def ingest(lines: DataFrame, agent: str, table: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs what is there through the provider's adapter into ``table`` and stops; run it again for what came since."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        append_new(adapters.ADAPTERS[agent](with_offsets(batch)), table)
        if then:
            then(batch, batch_id)

    return lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def context_of(agent: str) -> list[Column]:
    """Conditions on a line (as variant ``v``) that later lines of its file depend on: the last one of each holds until the next."""
    v = F.col("v")
    some = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths]).isNotNull()
    if agent == "codex":
        context = string_at(v, "$.type").isin("session_meta", "turn_context")
        return [string_at(v, "$.type") == "session_meta", context & some("$.payload.cwd"), context & some("$.payload.model"), some("$.timestamp", "$.payload.timestamp")]
    return [some("$.sessionId", "$.session_id"), some("$.timestamp")]


def context_lines(lines: DataFrame, agent: str) -> DataFrame:
    """The lines of each file that what follows them needs."""
    row = F.struct("byte_offset", "byte_length", "raw")
    rows = lines.withColumn("v", F.try_parse_json("raw"))
    last = rows.groupBy("agent", "path").agg(*[F.max_by(row, F.when(c, F.col("byte_offset"))).alias(f"c{i}") for i, c in enumerate(context_of(agent))])
    each = last.select("agent", "path", F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"c{i}") for i in range(len(context_of(agent)))])))).alias("r"))
    return each.select("agent", "path", "r.*")


def follow(spark: SparkSession, agent: str, root: str, table: str, checkpoint: str, split: int = SPLIT_BYTES) -> StreamingQuery:
    """Records of files that grow in place (:func:`sources.growing.growing_lines`), appended to ``table`` once each; runs what is there and stops.

    Session, directory, model and time stamp carry on from batch to batch: the lines that set them are kept beside the
    table (``<table>-context``) and stand before a batch's own.  A batch that is run again after a
    failure finds its keys stored and its context unchanged, so nothing is stored twice.
    """
    held = f"{table}-context"
    slot = F.pmod(F.xxhash64("agent", "path"), F.lit(SLOTS)).cast("int")

    def commit(batch: DataFrame, batch_id: int) -> None:
        lines = save(batch.withColumn("slot", slot), "lines")
        touched = [r["slot"] for r in lines.select("slot").distinct().collect()]  # at most SLOTS
        if not touched:
            return
        begun = lines.groupBy("agent", "path").agg(F.min("byte_offset").alias("_begin"))
        try:
            before = spark.read.schema(lines.schema).parquet(held).where(F.col("slot").isin(touched))
            # Of a file that began anew nothing carries on.
            before = save(before.join(begun, ["agent", "path"]).where("byte_offset < _begin").drop("_begin"), "before")
            before = context_lines(before.drop("slot"), agent)
        except AnalysisException:  # nothing stored yet
            before = lines.drop("slot").limit(0)
        own = lines.drop("slot")
        records = adapters.ADAPTERS[agent](before.unionByName(own)).join(begun, ["agent", "path"]).where("byte_offset >= _begin").drop("_begin")
        append_new(records, table)
        context_lines(own, agent).withColumn("slot", slot).write.mode("append").partitionBy("slot").parquet(held)

    return growing_lines(spark, agent, root, split).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoints(records: DataFrame) -> DataFrame:
    """What a file needs to go on: end of its last complete line, session and last valid time stamp."""
    w = F.struct("byte_offset", "item")
    return records.groupBy("agent", "path").agg(
        F.max(F.col("byte_offset") + F.col("byte_length") + 1).alias("scanned_bytes"), F.max_by("external_id", w).alias("session"), F.max_by("ts", F.when(F.col("ts").isNotNull(), w)).alias("last_valid_ts"),
    )


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Extension: event counts and values by event-time window and type, batch or stream."""
    bucket = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    base = events.withWatermark(ts, late) if events.isStreaming else events
    return base.groupBy(bucket.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
