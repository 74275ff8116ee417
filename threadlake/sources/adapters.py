"""The three providers' records as one wide table, parsed with VARIANT built-ins.

Input: ``agent, path, byte_offset, byte_length, raw``.  Output, one row a record or message item:
the arrival columns, ``kind`` (message, usage, event, context), the session's
fields, the four sections, and usage counts.  Malformed lines and unknown types give no rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import error_description, flag, kind, lenient_long, nonempty, string_at, timestamp_ms
from ..functions.sections import has_plan
from ..operators.ingest import carry

BLOCKS = "array<variant>"
EMPTY_BLOCKS = "cast(array() as array<variant>)"
#: The types that records and blocks are told by.
CLAUDE_MESSAGES = ("user", "assistant", "system")
TEXT_BLOCKS, REASONING_BLOCKS = ("text", "input_text", "output_text"), ("thinking", "reasoning")
CODEX_CALLS, CODEX_OUTPUTS = ("function_call", "custom_tool_call"), ("function_call_output", "custom_tool_call_output")
CODEX_EVENTS = ("turn_aborted", "task_failed", "turn_failed")
CODEX_FAILED, GEMINI_FAILED = ("failed", "error", "aborted"), ("error", "failed", "cancelled")
ATTACHMENT_TYPES = ("audio", "document", "file", "image", "image_url", "input_audio", "input_file", "input_image", "output_audio", "output_file", "output_image")
ATTACHMENT_KEYS = ("attachment", "attachments", "file", "fileData", "image", "image_url", "inlineData")
CALL_TYPES, WORDS_ONLY = ("tool_use", "function_call", "custom_tool_call"), ("text", "input_text", "output_text", "thinking", "reasoning")
LABELS, ARGUMENTS = ("type", "media_type", "mime_type", "format"), ("input", "args", "arguments", "media_type", "mime_type", "format")
CLAUDE_TITLES, PLAN_TOOLS = ("custom-title", "summary"), ("exitplanmode", "exit_plan_mode")
USAGE = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", "reasoning_tokens")


def text_of(v: Column) -> Column:
    """Text, or the texts of an array's strings and objects (text, content or output), one a line."""
    items = F.coalesce(F.try_variant_get(v, "$", BLOCKS), F.expr(EMPTY_BLOCKS))
    one = lambda x: F.coalesce(string_at(x, "$"), string_at(x, "$.text"), string_at(x, "$.content"), string_at(x, "$.output"))
    joined = F.array_join(F.filter(F.transform(items, one), lambda t: t.isNotNull() & (t != "")), "\n")
    return F.coalesce(string_at(v, "$"), F.nullif(joined, F.lit("")), string_at(v, "$.text"), string_at(v, "$.content"), string_at(v, "$.output"), F.lit(""))


def _json(v: Column) -> Column:
    """Text as it is, objects and arrays as compact JSON, other scalars as nothing."""
    k = F.schema_of_variant(v)
    return F.when(k == "STRING", F.try_variant_get(v, "$", "string")).when(k.startswith("OBJECT") | k.startswith("ARRAY"), F.to_json(v)).otherwise(F.lit(""))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _blocks(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, BLOCKS), F.expr(EMPTY_BLOCKS))


def _lines(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def _says_something(x) -> bool:
    """Whether a JSON value holds more than blanks and labels."""
    if isinstance(x, dict):
        return any(_says_something(v) for k, v in x.items() if k not in LABELS)
    if isinstance(x, list):
        return any(map(_says_something, x))
    return bool(x.strip()) if isinstance(x, str) else x is not None


def _holds_attachment(content: str) -> bool:
    """An attachment with content at any depth; a call's arguments and plain text parts are not looked into."""
    todo = [json.loads(content)]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += x
        if not isinstance(x, dict):
            continue
        name = x.get("type")
        name = name.lower() if isinstance(name, str) else None
        if name in CALL_TYPES:
            continue
        if (name in ATTACHMENT_TYPES and _says_something(x)) or any(_says_something(x[k]) for k in ATTACHMENT_KEYS if k in x):
            return True
        if name not in WORDS_ONLY:
            todo += [v for k, v in x.items() if k not in ARGUMENTS]
    return False


def _attachments(content: pd.Series) -> pd.Series:
    return content.map(lambda c: False if c is None else _holds_attachment(c)).astype(bool)


def _non_text(v: Column) -> Column:
    """Whether a message holds more than text.  Only content that names an attachment's type or key is looked into in Python."""
    content = F.to_json(v)
    named = '(?i)"(' + "|".join(dict.fromkeys([*ATTACHMENT_TYPES, *ATTACHMENT_KEYS])) + ')"'
    return F.coalesce(F.pandas_udf(_attachments, "boolean")(F.when(content.rlike(named), content)), F.lit(False))


def _submits_plan(name: Column, args: Column) -> Column:
    """A call of the tool that leaves plan mode, with a plan among its arguments, which may be JSON in a string."""
    parsed = F.coalesce(F.try_parse_json(string_at(args, "$")), args)
    return F.coalesce(F.lower(name).isin(*PLAN_TOOLS) & (F.trim(F.coalesce(string_at(parsed, "$.plan"), F.lit(""))) != ""), F.lit(False))


def _usage(v: Column, paths: dict[str, str]) -> list[Column]:
    return [lenient_long(v, paths[n]).alias(n) if n in paths else F.lit(None).cast("bigint").alias(n) for n in USAGE]


def _place() -> list[Column]:
    return [F.col(c) for c in ("agent", "path", "byte_offset")]


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def _slices(slice_bytes: int | None) -> Column | None:
    """Where long files are cut for what records carry on; None keeps each file whole."""
    return None if slice_bytes is None else F.floor(F.col("byte_offset") / slice_bytes)


def claude(lines: DataFrame, slice_bytes: int | None = None) -> DataFrame:
    rows = lines.withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    rows = rows.where(string_at(v, "$.type").isin(*CLAUDE_MESSAGES, *CLAUDE_TITLES))
    content = F.coalesce(_get(v, "$.message.content"), _get(v, "$.content"))
    blocks = F.coalesce(F.try_variant_get(content, "$", BLOCKS), F.expr(EMPTY_BLOCKS))
    plain = string_at(content, "$")
    btype = lambda b: string_at(b, "$.type")
    of = lambda names, f: F.transform(F.filter("blocks", lambda b: btype(b).isin(*names)), f)
    rows = rows.withColumn("content", content).withColumn("blocks", blocks).withColumn("plain", plain)
    prose = F.coalesce("plain", _lines(of(TEXT_BLOCKS, lambda b: string_at(b, "$.text"))))
    reasoning = _lines(of(REASONING_BLOCKS, lambda b: F.coalesce(string_at(b, "$.thinking"), string_at(b, "$.text"))))
    call = _lines(of(("tool_use",), lambda b: F.trim(F.concat_ws(" ", F.coalesce(string_at(b, "$.name"), F.lit("tool")), F.coalesce(_json(_get(b, "$.input")), F.lit(""))))))
    output = _lines(of(("tool_result",), lambda b: text_of(_get(b, "$.content"))))
    planned = F.exists("blocks", lambda b: (btype(b) == "tool_use") & _submits_plan(string_at(b, "$.name"), _get(b, "$.input")))
    failed = F.exists("blocks", lambda b: (btype(b) == "tool_result") & (flag(b, "$.is_error") | flag(b, "$.isError")))
    v = F.col("v")
    rows = rows.select(
        *_place(), F.lit(0).alias("item"), F.when(string_at(v, "$.type").isin(*CLAUDE_MESSAGES), "message").otherwise("context").alias("kind"), F.col("byte_length"), string_at(v, "$.type").alias("type"),
        F.coalesce(string_at(v, "$.sessionId"), string_at(v, "$.session_id")).alias("external_id"),
        F.when(string_at(v, "$.type") == "custom-title", string_at(v, "$.customTitle")).alias("explicit_title"), F.when(string_at(v, "$.type") == "summary", string_at(v, "$.summary")).alias("summary"),
        (F.coalesce(string_at(v, "$.type") == "assistant", F.lit(False)) & (has_plan(prose) | planned)).alias("plan"),
        F.coalesce(string_at(v, "$.cwd"), F.lit("Unknown")).alias("cwd"), timestamp_ms(F.try_variant_get(v, "$.timestamp", "string")).alias("ts"),
        F.coalesce(string_at(v, "$.uuid"), string_at(v, "$.message.id"), F.col("byte_offset").cast("string")).alias("source_key"), string_at(v, "$.uuid").alias("external_uuid"),
        prose.alias("prose"), call.alias("tool_invocation"), output.alias("tool_output"), reasoning.alias("reasoning"), _non_text(F.col("content")).alias("has_non_text"),
        F.get(of(("tool_use",), lambda b: string_at(b, "$.name")), F.lit(0)).alias("tool_name"),
        (flag(v, "$.is_error") | flag(v, "$.isError") | failed).alias("has_error"), flag(v, "$.isSidechain").alias("is_sidechain"),
        F.when(_get(v, "$.message.usage").isNotNull(), string_at(v, "$.message.model")).alias("model"),
        F.coalesce(string_at(v, "$.message.id"), string_at(v, "$.uuid"), F.col("byte_offset").cast("string")).alias("dedupe_key"),
        *_usage(v, {"input_tokens": "$.message.usage.input_tokens", "output_tokens": "$.message.usage.output_tokens", "cache_write_tokens": "$.message.usage.cache_creation_input_tokens", "cache_read_tokens": "$.message.usage.cache_read_input_tokens", "reasoning_tokens": "$.message.usage.output_tokens_details.thinking_tokens"}),
    )
    role = F.when(F.col("type") == "system", "system").when((F.col("tool_output") != "") & (F.col("prose") == ""), "tool_result").when((F.col("tool_invocation") != "") & (F.col("prose") == ""), "tool_use").otherwise(F.col("type"))
    return carry(rows.withColumn("role", role).drop("type"), "ts", "external_id", slices=_slices(slice_bytes)).withColumn("external_id", F.coalesce("external_id", file_stem(F.col("path"))))


def codex(lines: DataFrame, slice_bytes: int | None = None) -> DataFrame:
    """Session, directory and model come from context records and hold until the next one."""
    rows = lines.withColumn("v", F.try_parse_json("raw")).where("v is not null")
    v = F.col("v")
    p = lambda path: f"$.payload.{path}"
    typ, item = string_at(v, "$.type"), string_at(v, p("type"))
    context = typ.isin("session_meta", "turn_context")
    rows = rows.select(
        "*", typ.alias("type"), item.alias("item_type"),
        F.when(typ == "session_meta", F.coalesce(string_at(v, p("session_id")), string_at(v, p("id")))).alias("external_id"),
        F.when(context, string_at(v, p("cwd"))).alias("cwd"), F.when(context, string_at(v, p("model"))).alias("context_model"),
        F.coalesce(timestamp_ms(F.try_variant_get(v, "$.timestamp", "string")), timestamp_ms(F.try_variant_get(v, p("timestamp"), "string"))).alias("ts"),
    ).withColumn("item", F.lit(0))
    rows = carry(rows, "external_id", "cwd", "context_model", "ts", slices=_slices(slice_bytes))
    v = F.col("v")
    call, out, text, think = (F.col("item_type").isin(*k) for k in (CODEX_CALLS, CODEX_OUTPUTS, ("message", "agent_message", "plan"), ("reasoning",)))
    response, usage = F.col("type") == "response_item", F.col("type") == "token_usage_record"
    event = (F.col("type") == "event_msg") & F.col("item_type").isin(*CODEX_EVENTS)
    rows = rows.withColumn("kind", F.when(response & (call | out | text | think), "message").when(usage, "usage").when(event, "event")).where("kind is not null")
    body = F.coalesce(F.nullif(text_of(_get(v, p("content"))), F.lit("")), F.nullif(text_of(_get(v, p("text"))), F.lit("")), text_of(_get(v, p("message"))))
    ident = F.coalesce(string_at(v, p("id")), string_at(v, p("call_id")), F.col("byte_offset").cast("string"))
    spoken = (F.col("item_type") == "agent_message") | (response & (F.col("item_type") == "message") & (string_at(v, p("role")) == "assistant"))
    plan = (spoken & has_plan(body)) | (response & (F.col("item_type") == "plan") & (F.trim(body) != "")) | (call & _submits_plan(string_at(v, p("name")), F.coalesce(_get(v, p("arguments")), _get(v, p("input")))))
    return rows.select(
        *_place(), "item", "kind", "byte_length", F.lit(None).cast("string").alias("explicit_title"), F.lit(None).cast("string").alias("summary"), F.coalesce(plan, F.lit(False)).alias("plan"),
        F.coalesce("external_id", file_stem(F.col("path"))).alias("external_id"), F.coalesce("cwd", F.lit("Unknown")).alias("cwd"), "ts",
        F.when(F.col("kind") == "message", F.concat_ws(":", "item_type", ident)).otherwise(F.col("byte_offset").cast("string")).alias("source_key"),
        string_at(v, p("id")).alias("external_uuid"),
        F.when(text, body).when(event, F.coalesce(error_description(_get(v, "$.payload")), F.col("item_type"))).otherwise("").alias("prose"),
        F.when(call, F.trim(F.concat_ws(" ", F.coalesce(string_at(v, p("name")), F.lit("tool")), F.coalesce(_json(_get(v, p("arguments"))), _json(_get(v, p("input"))), F.lit(""))))).otherwise("").alias("tool_invocation"),
        F.when(out, text_of(_get(v, p("output")))).otherwise("").alias("tool_output"),
        F.when(think, F.coalesce(F.nullif(text_of(_get(v, p("summary"))), F.lit("")), body)).otherwise("").alias("reasoning"),
        F.when(text, _non_text(_get(v, p("content")))).otherwise(F.lit(False)).alias("has_non_text"), F.when(call, string_at(v, p("name"))).alias("tool_name"),
        (F.coalesce(string_at(v, p("status")).isin(*CODEX_FAILED), F.lit(False)) | (out & (flag(v, p("is_error")) | flag(v, p("output.is_error")))) | event).alias("has_error"),
        F.lit(False).alias("is_sidechain"), F.when(usage, F.coalesce(string_at(v, p("model")), F.col("context_model"), F.lit("unknown"))).alias("model"),
        F.when(usage, F.coalesce(string_at(v, p("response_id")), F.col("byte_offset").cast("string"))).alias("dedupe_key"),
        *_usage(v, {"input_tokens": p("usage.input_tokens"), "output_tokens": p("usage.output_tokens"), "cache_write_tokens": p("usage.cache_write_input_tokens"), "cache_read_tokens": p("usage.cached_input_tokens"), "reasoning_tokens": p("usage.reasoning_output_tokens")}),
        F.when(call, "tool_use").when(out, "tool_result").when(think | (F.col("item_type") != "message"), "assistant").otherwise(F.when(string_at(v, p("role")).isin("user", "system"), string_at(v, p("role"))).when(string_at(v, p("role")) == "developer", "system").otherwise("assistant")).alias("role"),
    )


def gemini(lines: DataFrame, chat_roots: DataFrame | None = None, slice_bytes: int | None = None) -> DataFrame:
    """Lines of a stream, or whole snapshots with offset 0; a line is a message or holds an array of them.

    ``chat_roots(folder, cwd)`` are the side files that name a chat folder's working directory; without one it is the folder above the chats.

    A snapshot that is not closed does not parse and gives no rows, so the rows stored before stay.
    """
    rows = lines.withColumn("v", F.try_parse_json("raw")).where("v is not null").withColumn("item", F.lit(0))
    v = F.col("v")
    rows = carry(rows.withColumn("session", string_at(v, "$.sessionId")), "session", slices=_slices(slice_bytes))
    whole = F.array(v)
    nested = F.coalesce(F.try_variant_get(v, "$.messages", BLOCKS), F.try_variant_get(v, "$['$set'].messages", BLOCKS), F.when(kind(v, "$.type") == "STRING", whole), F.expr(EMPTY_BLOCKS))
    # The line itself comes too where it names the session's title or summary.
    title = lambda n: F.coalesce(string_at(v, f"$.{n}"), string_at(v, f"$['$set'].{n}"))
    head = F.when(title("title").isNotNull() | title("summary").isNotNull(), F.array(F.parse_json(F.lit("{}")))).otherwise(F.expr(EMPTY_BLOCKS))
    rows = rows.select(*_place(), "byte_length", "session", title("title").alias("title"), title("summary").alias("summary_text"), F.size(nested).alias("said"), F.posexplode(F.concat(nested, head)).alias("item", "m"))
    m = F.col("m")
    t = string_at(m, "$.type")
    meta = F.col("item") == F.col("said")
    rows = rows.where(t.isin("user", "gemini", "assistant", "info", "warning", "error") | meta)
    calls = _blocks(m, "$.toolCalls")
    name = lambda c: F.coalesce(string_at(c, "$.name"), string_at(c, "$.displayName"), F.lit("tool"))
    response = "functionResponse.response"
    results = lambda c: F.coalesce(F.try_variant_get(c, "$.result", BLOCKS), F.expr(EMPTY_BLOCKS))
    shown = lambda c: F.coalesce(F.nullif(_lines(F.transform(results(c), lambda r: F.coalesce(string_at(r, f"$.{response}.output"), string_at(r, f"$.{response}.error"), string_at(r, "$.text")))), F.lit("")), text_of(_get(c, "$.result")))
    broken = F.exists(calls, lambda c: F.coalesce(F.lower(string_at(c, "$.status")).isin(*GEMINI_FAILED), F.lit(False)) | F.exists(results(c), lambda r: _get(r, f"$.{response}.error").isNotNull()))
    thoughts = F.transform(_blocks(m, "$.thoughts"), lambda x: F.coalesce(string_at(x, "$.description"), string_at(x, "$.subject")))
    ident = F.coalesce(string_at(m, "$.id"), F.concat_ws(".", F.col("byte_offset").cast("string"), F.col("item").cast("string")))
    out = rows.select(
        *_place(), "item", F.when(meta, "context").otherwise("message").alias("kind"), "byte_length", F.coalesce("session", file_stem(F.col("path"))).alias("external_id"),
        F.when(meta, F.col("title")).alias("explicit_title"), F.when(meta, F.col("summary_text")).alias("summary"),
        F.coalesce((t.isin("gemini", "assistant") & has_plan(text_of(_get(m, "$.content")))) | ((t != "user") & F.exists(calls, lambda c: _submits_plan(string_at(c, "$.name"), _get(c, "$.args")))), F.lit(False)).alias("plan"),
        F.regexp_extract("path", r"^(.*?)/[^/]*/[^/]*$", 1).alias("cwd"), timestamp_ms(F.try_variant_get(m, "$.timestamp", "string")).alias("ts"),
        ident.alias("source_key"), string_at(m, "$.id").alias("external_uuid"), text_of(_get(m, "$.content")).alias("prose"),
        _lines(F.transform(calls, lambda c: F.trim(F.concat_ws(" ", name(c), F.coalesce(_json(_get(c, "$.args")), F.lit("")))))).alias("tool_invocation"),
        _lines(F.transform(calls, shown)).alias("tool_output"), _lines(thoughts).alias("reasoning"), _non_text(_get(m, "$.content")).alias("has_non_text"),
        F.get(F.transform(calls, name), F.lit(0)).alias("tool_name"), ((t == "error") | broken).alias("has_error"), F.lit(False).alias("is_sidechain"),
        F.when(_get(m, "$.tokens").isNotNull(), string_at(m, "$.model")).alias("model"), ident.alias("dedupe_key"),
        *_usage(m, {"input_tokens": "$.tokens.input", "output_tokens": "$.tokens.output", "cache_read_tokens": "$.tokens.cached", "reasoning_tokens": "$.tokens.thoughts"}),
        F.when(t == "user", "user").when(t.isin("gemini", "assistant"), "assistant").otherwise("system").alias("role"),
    )
    if chat_roots is not None:
        sides = chat_roots.select(F.col("folder").alias("cwd"), nonempty(F.col("cwd")).alias("side_cwd"))
        out = out.join(sides, "cwd", "left").withColumn("cwd", F.coalesce("side_cwd", "cwd")).drop("side_cwd")
    return carry(out, "ts", slices=_slices(slice_bytes))


ADAPTERS = {"claude": claude, "codex": codex, "gemini": gemini}


def messages(records: DataFrame) -> DataFrame:
    """Records with something to show or a usage; the rest of a line's types never get here."""
    return records.where(F.col("kind") == "message").where("prose <> '' or tool_invocation <> '' or tool_output <> '' or reasoning <> '' or has_non_text")


def usage(records: DataFrame) -> DataFrame:
    """Observations that name a model; those of messages are keyed by the message."""
    key = F.when(F.col("kind") == "message", F.concat(F.lit("message:"), "source_key")).otherwise(F.col("source_key"))
    return records.where("model is not null").withColumn("source_key", key)


