"""Token usage: one canonical observation a response, daily roll-ups, prices."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import day_bucket, pattern_fits, pattern_rank

TOKENS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", "reasoning_tokens")
DAILY_KEY = ("day", "project_id", "model", "is_sidechain")


def insert_or_ignore(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Observations not stored yet, by file and source key; of repeated ones the first."""
    first = fresh.groupBy("source_file_id", "source_key").agg(F.min_by(F.struct(*[F.col(c) for c in fresh.columns]), "id").alias("row")).select("row.*")
    return first.join(stored.select("source_file_id", "source_key"), ["source_file_id", "source_key"], "left_anti")


def canonical(observations: DataFrame) -> DataFrame:
    """One row a response: each token count is its largest, all else comes from the row with most output, the latest of equals.

    A single aggregate with map-side combine, so a response seen very often costs no task of its own.
    """
    rank = F.struct(F.coalesce("output_tokens", F.lit(-1)).alias("output"), "id")
    rest = F.struct(*[F.col(c) for c in ("ts", "project_id", "session_id", "model", "is_sidechain", "id")])
    best = observations.groupBy("agent", "dedupe_key").agg(F.max_by(rest, rank).alias("row"), *[F.max(t).alias(t) for t in TOKENS])
    return best.select("agent", "dedupe_key", "row.*", *TOKENS)


def daily(observations: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Roll-ups by local day, project, model and side chain.

    With ``sessions(id, project_id)`` an observation without a project counts for its session's, and those of sessions that are no more do not count.
    """
    rows = canonical(observations)
    if sessions is not None:
        rows = rows.join(sessions.select(F.col("id").alias("session_id"), F.col("project_id").alias("_own")), "session_id").withColumn("project_id", F.coalesce("project_id", "_own")).drop("_own")
    rows = rows.withColumn("day", day_bucket(F.col("ts")))
    return rows.groupBy(*DAILY_KEY).agg(*[F.sum(F.coalesce(t, F.lit(0))).alias(t) for t in TOKENS])


def usage(rollups: DataFrame, projects: DataFrame, since: str | None = None, through: str | None = None, sidechains: bool = True) -> DataFrame:
    rows = rollups
    if since is not None:
        rows = rows.where(F.col("day") >= since)
    if through is not None:
        rows = rows.where(F.col("day") <= through)
    if not sidechains:
        rows = rows.where(~F.col("is_sidechain"))
    names = projects.select(F.col("id").alias("project_id"), F.col("display_name").alias("project"))
    return rows.join(names, "project_id").orderBy(F.col("day").desc(), "project", "model")


def date_range(preset: str, today: str) -> tuple[str | None, str | None]:
    """Inclusive days of a cost range; ``today`` is given, so a report can be repeated."""
    import datetime as dt

    now = dt.date.fromisoformat(today)
    starts = {"7d": now - dt.timedelta(days=6), "30d": now - dt.timedelta(days=29), "ytd": now.replace(month=1, day=1)}
    return (None, None) if preset == "all" else (starts[preset].isoformat(), today)


def search_range(preset: str, now_ms: int) -> tuple[int | None, int | None]:
    """Milliseconds of a search range: whole days back from this moment, unlike :func:`date_range`."""
    import datetime as dt

    day = 86_400_000
    if preset == "all":
        return None, None
    if preset == "ytd":
        year = dt.datetime.fromtimestamp(now_ms / 1000, dt.UTC).year
        return int(dt.datetime(year, 1, 1, tzinfo=dt.UTC).timestamp() * 1000), now_ms
    return now_ms - {"7d": 7, "30d": 30}[preset] * day, now_ms


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Each row with the most specific rate whose pattern fits its model, or none.

    Patterns meet the *distinct* models only; both are small whatever the number of rows.
    """
    models = rows.select("model").distinct()
    fits = models.join(rates, pattern_fits(F.col("model_pattern"), F.col("model")))
    best = fits.groupBy("model").agg(F.max_by(F.struct(*[F.col(c) for c in rates.columns]), F.struct(pattern_rank(F.col("model_pattern")), F.col("model_pattern"))).alias("rate"))
    return rows.join(best, "model", "left")


def estimate(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``status`` (estimated, unmetered, unavailable) and ``amount``, exact decimals.

    Counts below zero are zero.  Cached input is taken off where the rate counts
    it as input; reasoning costs extra only if the rate says so; a part with tokens but without a price makes the row unavailable.
    """
    r = lambda n: F.col(f"rate.{n}")
    n = {t: F.greatest(F.lit(0), F.coalesce(t, F.lit(0))) for t in TOKENS}
    net_input = F.when(r("input_includes_cache_reads"), F.greatest(F.lit(0), n["input_tokens"] - n["cache_read_tokens"])).otherwise(n["input_tokens"])
    parts = [(net_input, r("input_per_million")), (n["output_tokens"], r("output_per_million")), (n["cache_write_tokens"], r("cache_write_per_million")), (n["cache_read_tokens"], r("cache_read_per_million"))]

    def cost(count, price):
        """Exact: a count of 18 digits times a price a token with 12 decimals."""
        each = (price.cast("decimal(12,6)") * F.lit(Decimal("0.000001")).cast("decimal(6,6)")).cast("decimal(18,12)")
        return F.coalesce((count.cast("decimal(18,0)") * each).cast("decimal(30,12)"), F.lit(0).cast("decimal(30,12)"))

    lacking = F.lit(False)
    total = F.lit(0).cast("decimal(30,12)")
    for count, price in parts:
        lacking = lacking | ((count > 0) & price.isNull())
        total = total + cost(count, price)
    total = total + cost(n["reasoning_tokens"], r("additional_reasoning_per_million"))
    priced = with_rates(rows, rates)
    status = F.when(F.col("rate").isNull(), "unavailable").when(r("unmetered"), "unmetered").when(lacking, "unavailable").otherwise("estimated")
    return priced.withColumn("status", status).withColumn("amount", F.when(F.col("status") == "estimated", total.cast("decimal(38,12)"))).drop("rate")


def totals(estimates: DataFrame) -> DataFrame:
    return estimates.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.count_distinct(F.when(F.col("status") == "unavailable", F.col("model"))).alias("unavailable_models"))
