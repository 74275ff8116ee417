"""A message's four texts and what is shown, indexed and copied of them.

A message has ``prose``, ``tool_invocation``, ``tool_output``, ``reasoning`` and ``has_non_text``.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTIONS = ("prose", "tool_invocation", "tool_output", "reasoning")
#: Which sections each scope of the index covers.
SCOPES = {
    "prose": ("prose",),
    "invocations": ("prose", "tool_invocation"),
    "everything": ("prose", "tool_invocation", "tool_output"),
}
#: Bits of ``section_flags``.
PROSE, TOOL, REASONING, ATTACHMENT = 1, 2, 4, 8
ERRORS, ROLE_DEFAULTS = "errors", {"user": "prose", "assistant": "prose", "system": "system", "tool_use": "tools", "tool_result": "tools"}


def _joined(names: Collection[str], sep: str) -> Column:
    parts = F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names])
    return F.array_join(F.filter(parts, lambda p: p != ""), sep)


def indexed_text(scope: str = "everything") -> Column:
    """What search sees: reasoning never."""
    return _joined(SCOPES[scope], "\n")


def section_flags() -> Column:
    def bit(on: Column, value: int) -> Column:
        return F.when(on, F.lit(value)).otherwise(F.lit(0))

    has = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    return bit(has("prose"), PROSE) + bit(has("tool_invocation") | has("tool_output"), TOOL) + bit(has("reasoning"), REASONING) + bit(F.coalesce(F.col("has_non_text"), F.lit(False)), ATTACHMENT)


def preferred_preview() -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in ("prose", "tool_invocation", "tool_output", "reasoning")])


def snippet() -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in SCOPES["everything"]], F.lit(""))


def transcript_text(tools: bool = True, reasoning: bool = True) -> Column:
    names = ["prose", *(("tool_invocation", "tool_output") if tools else ()), *(("reasoning",) if reasoning else ())]
    return _joined(names, "\n\n")


def visible(show: Collection[str]) -> Column:
    """Rows of a transcript under toggles ``prose tools reasoning attachments system``.

    Errors always show.  Rows with flags show if any of their sections is on, rows
    with no section never; rows without flags go by their role.
    """
    mask = PROSE * ("prose" in show) | TOOL * ("tools" in show) | REASONING * ("reasoning" in show) | ATTACHMENT * ("attachments" in show)
    by_role = F.col("role").isin([r for r, what in ROLE_DEFAULTS.items() if what in show])
    system_ok = (F.col("role") != "system") | F.lit("system" in show)
    by_flags = F.col("section_flags").bitwiseAND(F.lit(mask)) != 0
    return F.coalesce(F.col("has_error"), F.lit(False)) | (system_ok & F.when(F.col("section_flags").isNull(), by_role).otherwise(by_flags))


def resolved_title() -> Column:
    return F.coalesce(*[F.col(c) for c in ("generated_title", "first_user_message", "title")], F.lit("Untitled session"))


#: Tags that clients inject around or before what a user typed.
DROPPED_TAGS = ("environment_context", "permissions instructions", "recommended_plugins", "instructions", "system-reminder")
UNWRAPPED_TAGS = ("user_query", "user_instructions")
INJECTED_START = "# AGENTS.md instructions for"


def user_title(prose: Column) -> Column:
    """What the user typed, or null: injected blocks go, some tags are unwrapped, an instruction file is no title."""
    out = prose
    for t in DROPPED_TAGS:
        out = F.regexp_replace(out, f"(?s)<{t}>.*?</{t}>", "")
    for t in UNWRAPPED_TAGS:
        out = F.regexp_replace(out, f"(?s)</?{t}>", "")
    out = F.nullif(F.regexp_replace(out, r"^\s+|\s+$", ""), F.lit(""))
    return F.when(~F.startswith(F.regexp_replace(prose, r"^\s+", ""), F.lit(INJECTED_START)), out)


def has_plan(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?s)<proposed_plan>\s*\S.*?</proposed_plan>"), F.lit(False))
