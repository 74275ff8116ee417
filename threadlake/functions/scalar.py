"""Scalar rules for fields of log records: previews, time stamps, JSON values, prices, paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW, FAILURE_DETAIL = 160, 4_000
#: Numbers over this are milliseconds already, others seconds.
SECONDS_BELOW = 10_000_000_000
MAX_LONG = 9_223_372_036_854_775_807
#: Message ids hold the millisecond above this many bits of ordinal.
ORDINAL_BITS = 20
MAX_TS = MAX_LONG >> ORDINAL_BITS
ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def nonempty(x: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def clusters(x: Column) -> Column:
    """Number of grapheme clusters: what readers take for one character, as a letter with its marks, a flag or a joined emoji."""
    plain = F.length(x) == F.octet_length(x)
    # Of ASCII only a carriage return with its line feed is a cluster of two.
    return F.when(plain, F.length(x) - (F.length(x) - F.length(F.replace(x, F.lit("\r\n"), F.lit("\n"))))).otherwise(F.regexp_count(x, F.lit(r"\X")))


def preview(x: Column, limit: int = PREVIEW) -> Column:
    """White space collapsed; longer texts end in an ellipsis, ``limit`` grapheme clusters in all, none cut apart."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    cut = F.regexp_extract(flat, rf"^(\X{{{limit - 1}}})\X{{2}}", 1)
    # A text has no more clusters than code points; the pattern is tried on longer ones only.
    return F.when(F.length(flat) <= limit, flat).when(cut != "", F.concat(cut, F.lit("…"))).otherwise(flat)


def timestamp_ms(x: Column) -> Column:
    """Epoch milliseconds of a number, numeric text or zoned ISO-8601 text; null for anything else.

    Small numbers are seconds; fractions of a millisecond are cut off; results
    that do not fit a long are null; ISO text without a zone is not accepted.
    """
    text = nonempty(x)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    exact = F.when(whole > SECONDS_BELOW, whole).otherwise(F.try_multiply(whole, F.lit(1000)))
    scaled = F.when(number > SECONDS_BELOW, number).otherwise(number * 1000)
    broken = F.when(F.abs(scaled) < 9.2e18, scaled).cast("bigint")
    zoned = F.when(text.rlike(ISO), F.unix_millis(F.try_to_timestamp(F.upper(text))))
    return F.when(whole.isNotNull(), exact).when(number.isNotNull(), broken).otherwise(zoned)


def lenient_long(v: Column, path: str) -> Column:
    """A number, a boolean as 0/1 or numeric text inside a variant; null if it does not fit."""
    return F.coalesce(F.try_variant_get(v, path, "bigint"), F.try_variant_get(v, path, "boolean").cast("bigint"))


def flag(v: Column, path: str) -> Column:
    """A JSON boolean; text such as "true" is false, missing is false."""
    return F.coalesce(F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def kind(v: Column, path: str) -> Column:
    """The variant type at a path: STRING, BOOLEAN, OBJECT<...>, ARRAY<...> and so on."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def string_at(v: Column, path: str) -> Column:
    """Text only if the value is JSON text; numbers and booleans do not count."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def compact_json(v: Column) -> Column:
    """Sorted keys, no spaces; empty for scalars."""
    shape = F.schema_of_variant(v)
    return F.when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.to_json(v)).otherwise(F.lit(""))


def first_nonempty(*xs: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def error_description(v: Column, depth: int = 3) -> Column:
    """Depth-first through the keys error, message, reason, detail to the first text that is not blank."""
    keys = ("error", "message", "reason", "detail")

    def at(path: str, left: int) -> list[Column]:
        here = [nonempty(string_at(v, path))]
        return here if not left else here + [c for k in keys for c in at(f"{path}.{k}", left - 1)]

    return F.coalesce(*at("$", depth))


def day_bucket(ms: Column) -> Column:
    """Local day of a millisecond; whole seconds are cut towards zero, as integer division does."""
    return F.date_format(F.timestamp_seconds(F.try_divide(ms, F.lit(1000)).cast("bigint")), "yyyy-MM-dd")


def clamp_ts(ms: Column) -> Column:
    return F.greatest(F.lit(0), F.least(ms, F.lit(MAX_TS)))


def cursor_ts(message_id: Column) -> Column:
    """The millisecond inside an ordinary message id."""
    return F.shiftright(message_id, ORDINAL_BITS)


def path_contains(parent: Column, child: Column) -> Column:
    """Equal, or below ``parent`` as a whole path component."""
    stem = F.regexp_replace(parent, "/+$", "")
    return (child == parent) | F.startswith(child, F.concat(stem, F.lit("/")))


def canonical_project(paths: Mapping[str, str], cwd: Column) -> Column:
    """Project root of a working directory by a resolved mapping of *distinct* directories; itself where unknown."""
    if not paths:
        return cwd
    table = F.create_map(*[F.lit(x) for kv in paths.items() for x in kv])
    return F.coalesce(F.try_element_at(table, cwd), cwd)


def pattern_fits(pattern: Column, model: Column) -> Column:
    """Case does not matter; only a ``*`` at the end is a wildcard."""
    p, m = F.lower(F.trim(pattern)), F.lower(F.trim(model))
    return F.when(F.endswith(p, F.lit("*")), F.startswith(m, F.regexp_replace(p, r"\*$", ""))).otherwise(p == m)


def pattern_rank(pattern: Column) -> Column:
    """An exact pattern beats every prefix; of prefixes the longest wins."""
    p = F.trim(pattern)
    return F.when(F.endswith(p, F.lit("*")), F.length(p) - 1).otherwise(F.length(p) + 10_000)


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x.cast("double"), 2))


def counted(n: Column, noun: str) -> Column:
    """``1 session``, ``2 sessions``."""
    return F.concat(n.cast("string"), F.lit(" " + noun), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
