"""From parsed records to the logical tables: order, identity, carried values, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import ORDINAL_BITS, clamp_ts, clusters, preview
from ..functions.sections import preferred_preview, section_flags, user_title

#: Order in which records arrive: files by provider and path, then bytes, then items of one record.
ARRIVAL = ("agent", "path", "byte_offset", "item")
#: Where the ids of a millisecond that is full go on: from the smallest long upwards.
OVERFLOW_START = -(2**63)


def carry(df: DataFrame, *cols: str, by: tuple[str, ...] = ("agent", "path"), order: tuple[str, ...] = ("byte_offset", "item"), slices: Column | None = None) -> DataFrame:
    """Fills nulls with the last value before them in the file; ties in order go by item.

    ``slices``, which must not fall along the order, cuts a long file: each slice is filled by itself, and what its
    first rows lack comes from the slices before, of which one row each is scanned.  The result is the same; ``df`` is read twice.
    """
    filled = lambda w: [F.last(c, ignorenulls=True).over(w).alias(c) if c in cols else F.col(c) for c in df.columns]
    if slices is None:
        return df.select(*filled(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = df.withColumn("_slice", slices)
    rows = cut.select(*filled(Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), "_slice")
    keys = [*by, "_slice"]
    ends = cut.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_last_{c}") for c in cols])
    earlier = Window.partitionBy(*[f"_key{i}" for i in range(len(by))]).orderBy(f"_key{len(by)}").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    ends = ends.select(*[f"_key{i}" for i in range(len(keys))], *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_last_{c}") for c in cols])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return rows.join(ends, same, "left").select(*[F.coalesce(c, f"_last_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def first_write(df: DataFrame, *key: str, order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Of rows with one key the first to arrive."""
    rows = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).agg(F.min_by(rows, F.struct(*order)).alias("row")).select("row.*")


def last_write(df: DataFrame, *key: str, order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    rows = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).agg(F.max_by(rows, F.struct(*order)).alias("row")).select("row.*")


def number_in_session(df: DataFrame, order: tuple[str, ...] = ARRIVAL, start: Column | int = 0) -> DataFrame:
    """``seq`` from 0, or from what is stored already."""
    w = Window.partitionBy("source_file_id", "external_id").orderBy(*order)
    return df.withColumn("seq", F.row_number().over(w) - 1 + start)


def message_ids(df: DataFrame, order: tuple[str, ...] = ARRIVAL, first: Column | int = 0, overflow: Column | int = OVERFLOW_START, capacity: int = 1 << ORDINAL_BITS) -> DataFrame:
    """``id`` holds the clamped millisecond and an ordinal from ``first``; a full millisecond goes on below zero from ``overflow``.

    Rows over capacity are numbered by millisecond and offset by the totals of the full milliseconds before.
    """
    w = Window.partitionBy("_ms").orderBy(*order)
    placed = df.withColumn("_ms", clamp_ts(F.col("ts"))).withColumn("_n", (F.row_number().over(w) - 1 + first).cast("bigint"))
    full = placed.where(F.col("_n") >= capacity).groupBy("_ms").agg(F.count("*").alias("_over"))
    before = F.coalesce(F.sum("_over").over(Window.orderBy("_ms").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a full millisecond
    rows = placed.join(full.select("_ms", before.alias("_before")), "_ms", "left")
    ident = F.when(F.col("_n") < capacity, F.shiftleft("_ms", ORDINAL_BITS) + F.col("_n")).otherwise(overflow + F.col("_before") + F.col("_n") - capacity)
    return rows.withColumn("id", ident).drop("_ms", "_n", "_before")


def derive(messages: DataFrame) -> DataFrame:
    """Flags, preview and length (in grapheme clusters) of a message's text."""
    shown = preferred_preview()
    return messages.withColumn("section_flags", section_flags()).withColumn("prefix", preview(shown)).withColumn("char_count", clusters(F.coalesce(shown, F.lit(""))))


def fold_sessions(messages: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Sessions of a set of messages: span, count, first user preview, errors, last project."""
    first_user = F.min_by(F.when((F.col("role") == "user") & (F.coalesce("prose", F.lit("")) != ""), preview(F.col("prose"))), F.when((F.col("role") == "user") & (F.coalesce("prose", F.lit("")) != ""), F.col("seq")))
    out = messages.groupBy("source_file_id", "external_id").agg(
        F.first("agent").alias("agent"), F.min("ts").alias("started_at"), F.max("ts").alias("last_activity_at"), F.count("*").alias("message_count"),
        first_user.alias("title"), F.bool_or("has_error").alias("had_error"), F.max_by("project_key", "seq").alias("project_key"),
    )
    if events is None:
        return out
    seen = events.groupBy("source_file_id", "external_id").agg(F.lit(True).alias("event"), F.count("*").alias("error_revision"))
    out = out.join(seen, ["source_file_id", "external_id"], "left")
    return out.withColumn("had_error", F.col("had_error") | F.coalesce("event", F.lit(False))).fillna({"error_revision": 0}).drop("event")


def merge_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: spans widen, counts add up, the newer project wins, a title once set stays."""
    key = ["source_file_id", "external_id"]
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    cond = (F.col("o.source_file_id") == F.col("n.source_file_id")) & (F.col("o.external_id") == F.col("n.external_id"))
    return o.join(n, cond, "full_outer").select(
        *[pick(k) for k in [*key, "agent"]],
        F.least("o.started_at", "n.started_at").alias("started_at"), F.greatest("o.last_activity_at", "n.last_activity_at").alias("last_activity_at"),
        (F.coalesce("o.message_count", F.lit(0)) + F.coalesce("n.message_count", F.lit(0))).alias("message_count"),
        F.coalesce("o.title", "n.title").alias("title"),
        (F.coalesce("o.had_error", F.lit(False)) | F.coalesce("n.had_error", F.lit(False))).alias("had_error"), pick("project_key"),
    )


def session_metadata(records: DataFrame, *key: str) -> DataFrame:
    """Per external id: the first user title, the last explicit title that is not blank (else the last summary), whether a plan was made.

    ``records`` has ``prose`` (user text), ``explicit_title``, ``plan`` and perhaps ``summary`` with the arrival columns.
    """
    order = F.struct(*ARRIVAL)
    typed = user_title(F.col("prose"))
    given = lambda c: F.max_by(F.nullif(F.trim(c), F.lit("")), F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), order))
    titles = [given(c) for c in ("explicit_title", "summary") if c in records.columns]
    return records.groupBy(*(key or ("external_id",))).agg(
        F.min_by(preview(typed), F.when(typed.isNotNull(), order)).alias("first_user_message"),
        F.coalesce(*titles).alias("generated_title"),
        F.bool_or(F.coalesce("plan", F.lit(False))).alias("has_plan"),
    )
