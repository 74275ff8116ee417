"""Small files beside the logs: prices and session titles.  All are bounded by what a person keeps on one machine."""

from __future__ import annotations

import json
import os
import re
import sqlite3
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("input", "output", "cacheWrite", "cacheRead", "additionalReasoning")
RATE_SCHEMA = (
    "model_pattern string, input_per_million decimal(12,6), output_per_million decimal(12,6), cache_write_per_million decimal(12,6), "
    "cache_read_per_million decimal(12,6), additional_reasoning_per_million decimal(12,6), input_includes_cache_reads boolean, unmetered boolean, note string"
)


class PriceFileError(ValueError):
    """A price file that breaks a rule."""


def check_rates(doc: dict) -> list[tuple]:
    """Rows of a catalogue: version 1, dollars, patterns neither blank nor repeated, prices not negative, none on unmetered rates."""
    if doc.get("formatVersion") != 1:
        raise PriceFileError("unknown format version")
    if doc.get("currency") != "USD":
        raise PriceFileError("prices must be in USD")
    seen, out = set(), []
    for r in doc.get("rates", []):
        pattern = str(r.get("modelPattern", "")).strip()
        if not pattern:
            raise PriceFileError("blank model pattern")
        if pattern.lower() in seen:
            raise PriceFileError(f"repeated model pattern {pattern}")
        seen.add(pattern.lower())
        try:
            prices = [None if r.get(f"{p}PerMillion") is None else Decimal(str(r[f"{p}PerMillion"])) for p in PRICES]
        except InvalidOperation as e:
            raise PriceFileError(f"{pattern}: a price is no number") from e
        if any(p is not None and p < 0 for p in prices):
            raise PriceFileError(f"{pattern}: negative price")
        unmetered = bool(r.get("unmetered", False))
        if unmetered and any(p is not None for p in prices):
            raise PriceFileError(f"{pattern}: unmetered rates have no prices")
        out.append((pattern, *prices, bool(r.get("inputIncludesCacheReads", False)), unmetered, r.get("note")))
    return out


def load_rates(spark: SparkSession, bundled: str, override: str | None = None) -> tuple[DataFrame, str | None]:
    """The override if it is there and valid, else the bundled file; and why an override was not taken."""
    problem = None
    for path in (override, bundled):
        if path and os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    return spark.createDataFrame(check_rates(json.load(f)), RATE_SCHEMA), problem
            except (PriceFileError, json.JSONDecodeError) as e:
                if path == bundled:
                    raise
                problem = str(e)
    raise PriceFileError("no price file")


def title_index(lines: DataFrame) -> DataFrame:
    """Latest title of each id; of equal times the later line.  ``lines`` has ``byte_offset`` and ``raw``."""
    v = F.try_parse_json("raw")
    rows = lines.select(*[F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in ("id", "thread_name", "updated_at")], "byte_offset").where("id is not null and thread_name is not null")
    return rows.groupBy(F.col("id").alias("external_id")).agg(F.max_by("thread_name", F.struct(F.coalesce("updated_at", F.lit("")), "byte_offset")).alias("name"), F.lit("index").alias("origin"))


def newest_state(names: list[str]) -> str | None:
    """Of ``state_<n>.sqlite`` the one with the largest number."""
    numbered = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"state_(\d+)\.sqlite", n))]
    return max(numbered)[1] if numbered else None


def state_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles from the newest state database, opened for reading only; its columns but ``id`` may be missing."""
    name, rows = newest_state(os.listdir(folder) if os.path.isdir(folder) else []), []
    if name:
        db = sqlite3.connect(f"file:{os.path.join(folder, name)}?mode=ro", uri=True)
        try:
            have = {r[1] for r in db.execute("PRAGMA table_info(threads)")}
            cols = [c for c in ("name", "title") if c in have]
            if "id" in have and cols:
                for r in db.execute(f"SELECT id, {', '.join(cols)} FROM threads"):
                    title = next((t.strip() for t in r[1:] if t and t.strip()), None)
                    if title:
                        rows.append((str(r[0]), title, "state"))
        finally:
            db.close()
    return spark.createDataFrame(rows, "external_id string, name string, origin string")


def merge_titles(index: DataFrame, state: DataFrame) -> DataFrame:
    """The index file's titles before the database's."""
    rows = index.alias("i").join(state.alias("s"), "external_id", "full_outer")
    return rows.select("external_id", F.coalesce("i.name", "s.name").alias("name"), F.coalesce("i.origin", "s.origin").alias("origin"))
