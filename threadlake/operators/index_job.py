"""From log files to the stored tables, in batch or for what changed since.

One run: what was found against what is stored (:func:`dml.changed_files`), the ranges
to read, verified reading, the providers' adapters, canonical projects, message ids and places, then new
versions of the buckets that changed (:class:`store.Store`).  Files read from the start replace their rows, appended
bytes add to them, files that are gone take theirs along.  A file that could not be read whole keeps its rows
and gets ``last_error``.  What a run reads of the store and writes to it follows from
what changed: the buckets of those files, the hours of their messages, and the small tables.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import ORDINAL_BITS, canonical_project, clamp_ts
from ..sources import adapters
from ..sources.ranges import read_ranges
from ..sources.verified import head_at, is_snapshot, read_verified
from ..storage import save
from . import dml, ingest, store

#: A file that reaches further is cut there for the values its records carry on, so that it is many tasks.
SLICE_BYTES = 256 << 20

FILE = "id bigint, root_id bigint, agent string, path string, dev bigint, inode bigint, size bigint, mtime_ns bigint, head_hash string, scanned_bytes bigint, last_error string, head_length int"
PROJECT = "id bigint, canonical_key string, display_name string"
SESSION = (
    "id bigint, source_file_id bigint, external_id string, agent string, project_id bigint, started_at bigint, last_activity_at bigint, message_count bigint, "
    "title string, had_error boolean, first_user_message string, generated_title string, has_plan boolean, title_origin string"
)
MESSAGE = (
    "id bigint, source_file_id bigint, session_id bigint, agent string, seq bigint, source_key string, external_uuid string, role string, ts bigint, prose string, "
    "tool_invocation string, tool_output string, reasoning string, has_non_text boolean, section_flags int, prefix string, char_count int, has_error boolean, is_sidechain boolean, byte_offset bigint, byte_length bigint"
)
FAILURE = "session_id bigint, source_file_id bigint, source_key string, ts bigint, kind string, detail string"
OBSERVATION = (
    "id bigint, source_file_id bigint, source_key string, agent string, dedupe_key string, ts bigint, project_id bigint, session_id bigint, model string, is_sidechain boolean, "
    + ", ".join(f"{t} bigint" for t in adapters.USAGE)
)
#: Where moved files were, so references made before still lead to them; a rewritten or deleted file loses its own.
MOVE_ALIAS = "agent string, prior_root bigint, prior_path string, source_file_id bigint"
HEALTH = "source_file_id bigint, last_success_ms bigint, last_error string, error_count bigint"
SCAN_ERROR = "root_id bigint, relative_scope string, error string"
#: The first ordinal of a millisecond that no message has had, so new ids need no look at stored messages.
ORDINAL = "ms bigint, next bigint"
#: Where each kind of id goes on.
COUNTER = "name string, next bigint"
TABLES = {
    "source_file": FILE, "project": PROJECT, "session": SESSION, "message": MESSAGE, "failure": FAILURE, "observation": OBSERVATION, "move_alias": MOVE_ALIAS,
    "adapter_health": HEALTH, "scan_error": SCAN_ERROR, "ordinal": ORDINAL, "counter": COUNTER,
}
#: Tables whose rows belong to one file.
BY_FILE = ("session", "message", "failure", "observation", "move_alias", "adapter_health")
KEYS = {"source_file": "id", "ordinal": "ms", **dict.fromkeys(BY_FILE, "source_file_id")}


class Store(store.Store):
    """The job's tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = store.BUCKETS):
        super().__init__(spark, folder, TABLES, KEYS, ("ordinal",), buckets)


def with_ids(fresh: DataFrame, stored: DataFrame, *key: str, order: tuple[str, ...] | None = None, start: DataFrame | None = None) -> DataFrame:
    """``fresh`` (distinct keys) with the ids that ``stored`` gives them, new keys numbered on from ``start`` (one row), else from the largest."""
    known = stored.select(*key, F.col("id").alias("old_id"))
    rows = fresh.join(known, list(key), "left")
    start = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_from")) if start is None else start.select(F.col("start").alias("_from"))
    new = numbered(rows.where("old_id is null"), *(order or key)).crossJoin(F.broadcast(start))  # one row
    new = new.withColumn("id", F.col("_from") + F.col("place") + 1).drop("_from", "place", "old_id")
    return rows.where("old_id is not null").withColumnRenamed("old_id", "id").unionByName(new)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``place`` from 0, by hashed slices and in the order given inside them; slices are offset by their totals, so no task numbers all rows."""
    by = F.struct(*order)
    slices = rows.withColumn("_slice", F.conv(F.substring(F.sha2(F.to_json(by), 256), 1, 3), 16, 10).cast("int"))
    totals = slices.groupBy("_slice").agg(F.count("*").alias("_n"))  # 4096 rows at most
    before = totals.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return slices.withColumn("_k", inside).join(before, "_slice").withColumn("place", F.col("_before") + F.col("_k") - 1).drop("_slice", "_k", "_before")


def counted(counter: DataFrame, name: str) -> DataFrame:
    """One row: the largest id given so far."""
    return counter.where(F.col("name") == name).agg(F.coalesce(F.max("next"), F.lit(0)).alias("start"))


def plan(found: DataFrame, stored_files: DataFrame) -> DataFrame:
    """Files found with their stored id, what to do, and the byte to start at.  A file met under a new path keeps its id.

    ``same`` is a small file saved anew with the content it had: only its fingerprint is stored.
    """
    moved = dml.move_file(stored_files, found)
    # The head of a file that was shorter than a head is compared over the length it had.
    old = moved.select("agent", "path", F.col("head_length").alias("_old"))
    rows = found.join(old, ["agent", "path"], "left")
    grown = (F.col("_old") < F.col("head_length")) & (F.col("_old") > 0)
    rows = rows.withColumn("head_then", F.coalesce(head_at(F.when(grown, F.col("path")), F.coalesce("_old", F.lit(0))), "head_hash")).drop("_old")
    todo = dml.changed_files(rows, moved).drop("head_then")
    # A snapshot is always read whole.
    whole = is_snapshot(F.col("path")) & (F.col("action") == "append")
    return todo.withColumn("action", F.when(whole, "replace").otherwise(F.col("action"))).withColumn("start", F.when(whole, F.lit(0)).otherwise(F.col("start")).cast("bigint"))


def records(lines: DataFrame, chat_roots: DataFrame | None = None, slice_bytes: int | None = None) -> DataFrame:
    """All providers' lines through their adapters; with ``slice_bytes`` a file is cut there, so a long one is many tasks."""
    sides = {"gemini": {"chat_roots": chat_roots}}
    parts = [f(lines.where(F.col("agent") == a), slice_bytes=slice_bytes, **sides.get(a, {})) for a, f in adapters.ADAPTERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _carried(fresh: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """Appended bytes go on where their file stopped: its last time stamp stands for missing ones."""
    last = stored["message"].groupBy("source_file_id").agg(F.max_by("ts", F.struct("byte_offset", "seq")).alias("last_ts"))
    return fresh.join(last, "source_file_id", "left").withColumn("ts", F.coalesce("ts", F.when(F.col("action") == "append", F.col("last_ts")), F.lit(0))).drop("last_ts")


def _message_ids(fresh: DataFrame, ordinal: DataFrame, counter: DataFrame) -> DataFrame:
    """Ids after those that were given in the same millisecond."""
    taken = ordinal.select(F.col("ms").alias("_ms"), (F.col("next") - 1).alias("_last"))
    below = counter.where("name = 'overflow'").agg(F.max("next").alias("_below"))  # one row
    rows = fresh.withColumn("_ms", clamp_ts(F.col("ts"))).join(taken, "_ms", "left").drop("_ms").crossJoin(F.broadcast(below))
    return ingest.message_ids(rows, first=F.coalesce("_last", F.lit(-1)) + 1, overflow=F.coalesce("_below", F.lit(ingest.OVERFLOW_START))).drop("_last", "_below")


def _ordinals(ordinal: DataFrame, message: DataFrame) -> DataFrame:
    used = message.where("id >= 0").select(F.shiftright("id", ORDINAL_BITS).alias("ms"), (F.col("id").bitwiseAND(F.lit((1 << ORDINAL_BITS) - 1)) + 1).alias("next"))
    return ordinal.select("ms", "next").unionByName(used).groupBy("ms").agg(F.max("next").alias("next"))


def _counters(counter: DataFrame, **given: tuple[DataFrame, Column]) -> DataFrame:
    """The largest id of each kind, of what was given before and now."""
    out = counter.select("name", "next")
    for name, (df, largest) in given.items():
        out = out.unionByName(df.agg(largest.alias("next")).select(F.lit(name).alias("name"), "next"))
    return out.where("next is not null").groupBy("name").agg(F.max("next").alias("next"))


def parse(stored: dict[str, DataFrame], todo: DataFrame, lines: DataFrame, projects: Mapping[str, str] | None = None, chat_roots: DataFrame | None = None, slice_bytes: int | None = None) -> DataFrame:
    """Records of the lines read, once for all tables: with their file's id, the time stamp carried on from what is stored, and the canonical project."""
    files = todo.where("action <> 'skip'").select("agent", "path", F.col("id").alias("source_file_id"), "action")
    rows = records(lines, chat_roots, slice_bytes).join(files, ["agent", "path"])
    return save(_carried(rows, stored).withColumn("project_key", canonical_project(projects or {}, F.col("cwd"))), "records")


def assemble(stored: dict[str, DataFrame], todo: DataFrame, rows: DataFrame, ends: DataFrame, gone: DataFrame | None = None, elsewhere: DataFrame | None = None) -> dict[str, DataFrame]:
    """New versions of the tables given (of all buckets, or of those that the files of ``todo`` and ``gone`` lie in).

    ``rows`` are :func:`parse`'s, ``ends(agent, path, end)`` the last complete line of each file read;
    ``elsewhere(project_id)`` says which projects other buckets use.
    """
    none = stored["source_file"].select("id").limit(0)
    lost = gone.select("id") if gone is not None else none
    rewritten = todo.where("action in ('replace', 'new')").select("id").unionByName(lost).select(F.col("id").alias("source_file_id"))
    kept = {n: stored[n].join(rewritten, "source_file_id", "left_anti") for n in BY_FILE}
    counter = stored["counter"]
    said = adapters.messages(rows)
    # A record met again, by its key, is not a second message.
    key = ["source_file_id", "external_id", "source_key"]
    old_keys = kept["message"].join(kept["session"].select(F.col("id").alias("session_id"), "external_id"), "session_id").select(*key)
    said = ingest.first_write(said, *key).join(old_keys, key, "left_anti")

    keys = said.select("project_key").unionByName(rows.where("model is not null or kind = 'event'").select("project_key")).distinct().withColumnRenamed("project_key", "canonical_key")
    project = with_ids(keys, stored["project"], "canonical_key", start=counted(counter, "project")).select("id", "canonical_key", F.regexp_extract("canonical_key", r"([^/]*)/*$", 1).alias("display_name"))
    met = save(project, "projects")
    project = save(stored["project"].join(met.select("id"), "id", "left_anti").unionByName(met), "projects")

    people = rows.where("kind in ('message', 'event', 'usage')").select("source_file_id", "external_id").distinct()
    session_ids = save(with_ids(people, stored["session"], "source_file_id", "external_id", start=counted(counter, "session")).select(F.col("id").alias("session_id"), "source_file_id", "external_id"), "sessions")
    counts = kept["message"].groupBy("session_id").agg((F.max("seq") + 1).alias("start"))
    said = said.join(session_ids, ["source_file_id", "external_id"]).join(counts, "session_id", "left")
    said = ingest.number_in_session(said, start=F.coalesce("start", F.lit(0))).drop("start")
    message = save(ingest.derive(_message_ids(said, stored["ordinal"], counter)), "messages")

    event = rows.where("kind = 'event'")
    folded = ingest.fold_sessions(message, event)
    meta = ingest.session_metadata(rows.withColumn("prose", F.when(F.col("role") == "user", F.col("prose"))), "source_file_id", "external_id")
    session = _sessions(kept["session"], folded, meta, session_ids, project)

    broken = message.where("has_error").select("session_id", "source_file_id", "source_key", "ts", F.lit("tool").alias("kind"), F.coalesce(F.nullif("tool_output", F.lit("")), F.nullif("prose", F.lit("")), F.lit("")).alias("detail"), F.struct("byte_offset", "item").alias("arrival"))
    events = event.join(session_ids, ["source_file_id", "external_id"]).select("session_id", "source_file_id", "source_key", "ts", F.lit("event").alias("kind"), F.col("prose").alias("detail"), F.struct("byte_offset", "item").alias("arrival"))
    failure = dml.upsert_failures(kept["failure"], broken.unionByName(events))

    used = adapters.usage(rows).join(session_ids, ["source_file_id", "external_id"]).join(project.select(F.col("id").alias("project_id"), F.col("canonical_key").alias("project_key")), "project_key")
    used = ingest.first_write(used, "source_file_id", "source_key").join(kept["observation"].select("source_file_id", "source_key"), ["source_file_id", "source_key"], "left_anti")
    used = numbered(used, "agent", "path", "byte_offset", "item").crossJoin(F.broadcast(counted(counter, "observation"))).withColumn("id", F.col("start") + F.col("place") + 1)  # one row
    columns = [f.split(" ")[0] for f in OBSERVATION.split(", ")]
    used = save(used.select(*columns), "used")
    observation = kept["observation"].unionByName(used)

    session = save(session, "sessions")
    now = session.select("project_id").unionByName(observation.select("project_id")).distinct()
    before = stored["session"].select("project_id").unionByName(stored["observation"].select("project_id")).unionByName(met.select(F.col("id").alias("project_id"))).distinct()
    # Only projects that these buckets name no more can be without rows; the rest of the store is asked for those alone.
    orphans = save(before.join(now, "project_id", "left_anti"), "orphans")
    if elsewhere is not None and not orphans.isEmpty():
        orphans = orphans.join(elsewhere, "project_id", "left_anti")
    project = project.join(orphans.select(F.col("project_id").alias("id")), "id", "left_anti")
    largest = F.max("id")
    counters = _counters(counter, project=(met, largest), session=(session_ids, F.max("session_id")), observation=(used, largest), file=(todo, largest), overflow=(message.where("id < 0"), largest + 1))
    return {
        "source_file": _files(stored["source_file"], todo, ends, lost), "project": project, "session": session,
        "message": kept["message"].unionByName(message.select(*kept["message"].columns)), "failure": failure, "observation": observation,
        "move_alias": kept["move_alias"], "adapter_health": kept["adapter_health"], "scan_error": stored["scan_error"], "ordinal": _ordinals(stored["ordinal"], message), "counter": counters,
    }


def line_ends(lines: DataFrame) -> DataFrame:
    return lines.groupBy("agent", "path").agg(F.max(F.col("byte_offset") + F.col("byte_length") + F.lit(1)).alias("end"))


def build(stored: dict[str, DataFrame], todo: DataFrame, lines: DataFrame, gone: DataFrame | None = None, projects: Mapping[str, str] | None = None, chat_roots: DataFrame | None = None) -> dict[str, DataFrame]:
    """New versions of all tables.

    ``todo`` is :func:`plan`'s result with ``id`` and ``root_id`` set, ``lines`` are the bytes it
    asks for, ``gone`` has the ids of files that are no more.
    """
    return assemble(stored, todo, parse(stored, todo, lines, projects, chat_roots), line_ends(lines), gone)


def _sessions(kept: DataFrame, folded: DataFrame, meta: DataFrame, ids: DataFrame, project: DataFrame) -> DataFrame:
    """Stored sessions and those of the new rows as one; a newer project holds, a title once set stays, a plan is never lost."""
    names = project.select(F.col("id").alias("new_project_id"), F.col("canonical_key").alias("project_key"))
    fresh = ids.join(folded, ["source_file_id", "external_id"], "left").join(names, "project_key", "left").join(meta.withColumnsRenamed({"first_user_message": "new_first", "generated_title": "new_title", "has_plan": "new_plan"}), ["source_file_id", "external_id"], "left")
    fresh = fresh.select(F.col("session_id").alias("id"), *[F.col(c).alias(f"n_{c}") for c in ("source_file_id", "external_id", "agent", "started_at", "last_activity_at", "message_count", "title", "had_error")], "new_project_id", "new_first", "new_title", "new_plan")
    both = kept.join(fresh, "id", "full_outer")
    pick = lambda c: F.coalesce(c, f"n_{c}").alias(c)
    yes = lambda a, b: (F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    title = F.coalesce("new_title", "generated_title")
    return both.select(
        "id", pick("source_file_id"), pick("external_id"), pick("agent"), F.coalesce("new_project_id", "project_id").alias("project_id"),
        F.least("started_at", "n_started_at").alias("started_at"), F.greatest("last_activity_at", "n_last_activity_at").alias("last_activity_at"),
        (F.coalesce("message_count", F.lit(0)) + F.coalesce("n_message_count", F.lit(0))).alias("message_count"), pick("title"), yes("had_error", "n_had_error").alias("had_error"),
        F.coalesce("first_user_message", "new_first").alias("first_user_message"), title.alias("generated_title"), yes("has_plan", "new_plan").alias("has_plan"), "title_origin",
    ).where("message_count > 0")


def _files(stored: DataFrame, todo: DataFrame, ends: DataFrame, gone: DataFrame) -> DataFrame:
    """Files with their new fingerprints; the checkpoint is the end of the last complete line, of a snapshot its size."""
    now = todo.join(ends, ["agent", "path"], "left")
    scanned = F.when(is_snapshot(F.col("path")) | (F.col("action") == "same"), F.col("size")).otherwise(F.least(F.coalesce("end", "start"), F.col("size")))
    fresh = now.where("action <> 'skip'").select("id", "root_id", "agent", "path", "dev", "inode", "size", "mtime_ns", "head_hash", scanned.alias("scanned_bytes"), F.lit(None).cast("string").alias("last_error"), "head_length")
    rest = stored.join(gone.select("id").unionByName(fresh.select("id")), "id", "left_anti")
    return rest.unionByName(fresh)


def failed_files(files: DataFrame, failed: DataFrame) -> DataFrame:
    """Files with what went wrong with them; all else about a stored file stays, and one that is new stands there with nothing read."""
    told = failed.select("id", F.col("error").alias("_error"))
    stored = files.join(told, "id", "left").withColumn("last_error", F.coalesce("_error", "last_error")).drop("_error")
    new = failed.join(files.select("id"), "id", "left_anti")
    none = {c: F.lit(None) for c in ("dev", "inode", "mtime_ns", "head_hash", "head_length")}
    return stored.unionByName(new.select("id", "root_id", "agent", "path", F.lit(0).alias("size"), F.lit(0).alias("scanned_bytes"), F.col("error").alias("last_error"), *[v.alias(n) for n, v in none.items()]))


def health(stored: DataFrame, read: DataFrame, failed: DataFrame, now_ms: int) -> DataFrame:
    """When each file was last read well, its last error and how many there were."""
    news = read.select(F.col("id").alias("source_file_id"), F.lit(now_ms).alias("_ok"), F.lit(None).cast("string").alias("_error")).unionByName(failed.select(F.col("id").alias("source_file_id"), F.lit(None).cast("bigint").alias("_ok"), F.col("error").alias("_error")))
    rows = stored.join(news, "source_file_id", "full_outer")
    return rows.select("source_file_id", F.coalesce("_ok", "last_success_ms").alias("last_success_ms"), F.coalesce("_error", "last_error").alias("last_error"), (F.coalesce("error_count", F.lit(0)) + F.col("_error").isNotNull().cast("int")).alias("error_count"))


def _buckets(of: DataFrame, column: Column) -> list[int]:
    return sorted(r[0] for r in of.select(column.alias("b")).distinct().collect())  # as many as the store has, at most


def refresh(
    store: Store, found: DataFrame, gone: DataFrame | None = None, rebuild: bool = False, projects: Mapping[str, str] | None = None, chat_roots: DataFrame | None = None,
    scanned: DataFrame | None = None, scan_errors: DataFrame | None = None, now_ms: int | None = None, slice_bytes: int = SLICE_BYTES,
) -> str | None:
    """One run over the files found (:func:`sources.discovery.discover`): the new version's name, None if nothing changed.

    ``rebuild`` forgets what is stored and reads everything, as a changed scope or format asks for.  ``scanned(root_id, relative_scope)``
    are the places listed, ``scan_errors`` what went wrong there (:func:`dml.replace_scan_errors`).
    A file that changes while it is read is read again (:func:`sources.verified.read_verified`); one that
    fails, and a snapshot that is not closed, keep what is stored of them and get ``last_error``.
    """
    spark = store.spark
    base = store.manifest()
    held = None if rebuild else base
    stored = store.tables(held) if held else {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
    stored_files = stored["source_file"]
    moved = save(dml.move_aliases(stored_files, found, "").drop("generation"), "moved")
    files = save(dml.move_file(stored_files, found), "files")
    todo = save(plan(found, stored_files), "plan")
    errors = scan_errors is not None and not (scan_errors.isEmpty() and stored["scan_error"].isEmpty())
    if not rebuild and todo.where("action <> 'skip'").isEmpty() and (gone is None or gone.isEmpty()) and moved.isEmpty() and not errors:
        return None
    start = counted(stored["counter"], "file")
    todo = save(with_ids(todo.where("action <> 'skip'").drop("id"), files, "agent", "path", start=start), "plan")

    def again(now: DataFrame) -> DataFrame:
        # The same ids and roots, with what there is to do about the file as it is now.
        known = todo.select("agent", "path", "id", "root_id")
        replanned = plan(now.join(known.select("agent", "path", "root_id"), ["agent", "path"]), files).drop("id").join(known.select("agent", "path", "id"), ["agent", "path"])
        # A file that came back to what is stored is read again all the same.
        return replanned.withColumn("action", F.when(F.col("action").isin("skip", "same"), "replace").otherwise(F.col("action"))).select(*todo.columns)

    to_read = todo.where("action <> 'same'")
    lines, tried = read_verified(to_read, again)
    lines = save(lines, "lines")
    # A snapshot with an object that is no JSON is not replaced either.
    bad = lines.where(is_snapshot(F.col("path")) & F.try_parse_json("raw").isNull()).select("agent", "path").distinct().withColumn("_bad", F.lit("malformed record in a snapshot"))
    tried = save(tried.join(bad, ["agent", "path"], "left").withColumn("error", F.coalesce("error", "_bad")).drop("_bad"), "tried")
    failed = tried.where("error is not null")
    done = save(tried.where("error is null").select(*todo.columns).unionByName(todo.where("action = 'same'")), "done")
    read = done.where("action <> 'same'")
    lines = lines.join(read.select("agent", "path"), ["agent", "path"], "left_semi")

    rows_of = read.select("id") if gone is None else read.select("id").unionByName(gone.select("id"))
    own = _buckets(rows_of, store.bucket("message", F.col("id")))
    alias = sorted({*own, *_buckets(moved, store.bucket("move_alias"))})
    entry = sorted({*alias, *_buckets(todo, store.bucket("source_file"))})
    seen = sorted({*own, *_buckets(failed, store.bucket("source_file"))})
    touched = {**dict.fromkeys(("session", "message", "failure", "observation"), own), "move_alias": alias, "source_file": entry, "adapter_health": seen}
    if rebuild:
        every = range(store.buckets)
        touched = dict.fromkeys(touched, every)
    part = {n: store.read(n, held, touched[n]) for n in touched} | {n: stored[n] for n in ("project", "counter", "scan_error")}
    part["move_alias"] = part["move_alias"].unionByName(moved).distinct()
    part["source_file"] = files.where(store.bucket("source_file").isin([int(b) for b in entry])) if not rebuild else files
    # Cutting reads the lines twice, so it is left out where no file reaches over a slice; the records are the same.
    furthest = lines.agg(F.max("byte_offset")).first()[0] or 0
    rows = parse(part, done, lines, projects, chat_roots, slice_bytes if furthest >= slice_bytes else None)
    # Hours of the messages read: only their ordinals are looked up.
    touched["ordinal"] = range(store.buckets) if rebuild else _buckets(rows, store.bucket("ordinal", clamp_ts(F.col("ts"))))
    part["ordinal"] = store.read("ordinal", held, touched["ordinal"])
    others = [b for b in range(store.buckets) if b not in set(own)]
    elsewhere = None if rebuild else store.read("session", held, others).select("project_id").unionByName(store.read("observation", held, others).select("project_id"))
    out = assemble(part, done, rows, line_ends(lines), gone, elsewhere)
    out["source_file"] = failed_files(out["source_file"], failed)
    out["adapter_health"] = health(out["adapter_health"], read, failed, int(time.time() * 1000) if now_ms is None else now_ms)
    if scan_errors is not None:
        out["scan_error"] = dml.replace_scan_errors(stored["scan_error"], scanned if scanned is not None else scan_errors.select("root_id", "relative_scope"), scan_errors)
    # Failed new files have ids too.
    out["counter"] = _counters(out["counter"], file=(todo, F.max("id")))
    return store.commit({n: df for n, df in out.items() if n not in touched or touched[n]}, {**touched, "project": [0], "counter": [0], "scan_error": [0]}, base)


def apply_titles(store: Store, names: DataFrame, policy: str = "complete") -> str | None:
    """Titles of side files (:func:`sources.side_files.merge_titles`) on stored sessions; only buckets with a changed session are written.  None if none changed."""
    base = store.manifest()
    session = store.read("session", base)
    new = dml.apply_titles(session, names, policy)
    changed = new.select("id", "source_file_id", F.struct("generated_title", "title_origin").alias("n")).join(session.select("id", F.struct("generated_title", "title_origin").alias("o")), "id").where(~F.col("n").eqNullSafe(F.col("o")))
    touched = _buckets(changed, store.bucket("session"))
    if not touched:
        return None
    return store.commit({"session": dml.apply_titles(store.read("session", base, touched), names, policy)}, {"session": touched}, base)


def hydrate(message: DataFrame, source_file: DataFrame) -> DataFrame:
    """Messages with their sections read again from the source, each from its own bytes.

    Places in files are coalesced and read in tasks (:func:`sources.ranges.read_ranges`), parsed by the provider's adapter and
    told by place and key.  Stored sections stand where a file is gone or its bytes are another record's.
    """
    files = source_file.select(F.col("id").alias("source_file_id"), "path")
    sections = ("prose", "tool_invocation", "tool_output", "reasoning")
    rows = message.join(files, "source_file_id")
    fresh = records(read_ranges(rows)).select("agent", "path", "byte_offset", "source_key", *[F.col(c).alias(f"new_{c}") for c in sections])
    fresh = ingest.first_write(fresh.withColumn("item", F.lit(0)), "agent", "path", "byte_offset", "source_key").drop("item")
    rows = rows.join(fresh, ["agent", "path", "byte_offset", "source_key"], "left")
    return rows.withColumns({c: F.coalesce(f"new_{c}", c) for c in sections}).withColumn("hydrated", F.col("new_prose").isNotNull()).select(*message.columns, "hydrated")
