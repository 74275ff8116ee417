"""Keyset pages: a page is the first rows after a cursor, never an offset."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION_PAGE, MAX_PAGE, UNPAGED, RECENT = 200, 1000, 500, 10


def clamp_page(size: int) -> int:
    return max(1, min(MAX_PAGE, size))


def after(df: DataFrame, keys: list[tuple[str, bool]], values: tuple) -> DataFrame:
    """Rows after ``values`` in the order of ``keys``, pairs of column and whether it descends."""
    cond: Column = F.lit(False)
    equal: Column = F.lit(True)
    for (name, down), v in zip(keys, values, strict=True):
        c = F.col(name)
        cond = cond | (equal & ((c < v) if down else (c > v)))
        equal = equal & (c == v)
    return df.where(cond)


def page(df: DataFrame, keys: list[tuple[str, bool]], size: int, cursor: tuple | None = None) -> DataFrame:
    start = after(df, keys, cursor) if cursor else df
    return start.orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, down in keys]).limit(size)


class CursorMismatch(ValueError):
    """A cursor of another project's list."""


SESSION_KEYS = [("last_activity_at", True), ("id", True)]


def sessions_page(sessions: DataFrame, project: str | None = None, size: int = SESSION_PAGE, cursor: tuple | None = None) -> DataFrame:
    """``cursor`` is ``(project, last activity, id)`` of the last row seen."""
    if cursor and cursor[0] != project:
        raise CursorMismatch("the cursor belongs to another list")
    rows = sessions if project is None else sessions.where(F.col("project_key") == project)
    return page(rows, SESSION_KEYS, clamp_page(size), cursor[1:] if cursor else None)


def snapshot(sessions: DataFrame, pages: int, ensure_id: int | None = None, size: int = SESSION_PAGE) -> DataFrame:
    """The first pages at once, with one session sorted in even if it lies beyond them."""
    rows = page(sessions, SESSION_KEYS, pages * size)
    if ensure_id is not None:
        wanted = sessions.where(F.col("id") == ensure_id)
        rows = append_page(rows, wanted)
    return rows


def append_page(shown: DataFrame, more: DataFrame) -> DataFrame:
    """Adds rows whose id is not there yet and sorts again."""
    fresh = more.join(shown.select("id"), "id", "left_anti").select(*shown.columns)
    return shown.unionByName(fresh).orderBy(F.col("last_activity_at").desc(), F.col("id").desc())


def nearest_rank(df: DataFrame, value: str, fractions: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank: the value at place ceil(n * fraction)."""
    exact = [F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(f * 100)}") for f in fractions]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *exact, F.max(value).alias("max"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Counts by the first bound not under the value; the last bucket holds the rest."""
    bucket = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        bucket = F.when(F.col(value) <= bounds[i], F.lit(i)).otherwise(bucket)
    return df.groupBy(*(by or []), bucket.alias("bucket")).agg(F.count("*").alias("n"))


RETENTION_DAYS = 30


def retained(days: DataFrame, today: str, keep: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the last ``keep`` days, ``today`` among them; ``day`` is ``yyyy-MM-dd``."""
    first = dt.date.fromisoformat(today) - dt.timedelta(days=keep - 1)
    return days.where(F.col("day") >= first.isoformat())


def export_days(days: DataFrame, path: str, today: str, keep: int = RETENTION_DAYS) -> None:
    """Writes the retained rows as JSON lines, newest day first."""
    retained(days, today, keep).orderBy(F.col("day").desc()).write.mode("overwrite").json(path)


def paired_change(samples: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Change of a candidate against its baseline, by workload and metric.

    ``samples`` has ``pair, workload, metric, candidate`` (boolean) and ``value``.  A pair's change
    is that between its medians, in percent; the median over pairs counts, and over ``tolerance``
    it is a regression.  From a zero baseline to a positive value the change has no bound (infinity).
    """
    median = lambda c: F.percentile(F.when(c, F.col("value")), F.lit(0.5))
    pairs = samples.groupBy("pair", "workload", "metric").agg(median(~F.col("candidate")).alias("base"), median(F.col("candidate")).alias("new"))
    change = F.when(F.col("base") != 0, (F.col("new") - F.col("base")) / F.col("base") * 100).when(F.col("new") > 0, F.lit(float("inf"))).when(F.col("new") == 0, F.lit(0.0))
    out = pairs.withColumn("change", change).groupBy("workload", "metric").agg(F.percentile("change", F.lit(0.5)).alias("change"))
    return out.withColumn("regressed", F.col("change") > tolerance + 1e-9)
