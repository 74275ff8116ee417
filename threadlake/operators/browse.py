"""Lists, details, statistics and health of the indexed sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sections import resolved_title


def projects(project: DataFrame, session: DataFrame, supported: DataFrame) -> DataFrame:
    """Projects that have sessions of supported providers, newest activity first."""
    live = session.join(F.broadcast(supported), "agent", "left_semi")
    counts = live.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("session_count"), F.coalesce(F.max("last_activity_at"), F.lit(0)).alias("last_activity_at"))
    return project.join(counts, "id").orderBy(F.col("last_activity_at").desc(), "id")


def name_contains(rows: DataFrame, text: str) -> DataFrame:
    wanted = text.strip().lower()
    return rows.where(F.lower("display_name").contains(wanted)) if wanted else rows


def summaries(session: DataFrame, source_file: DataFrame, project: DataFrame, root: DataFrame, supported: DataFrame) -> DataFrame:
    """Sessions with file, project, configured root and resolved title."""
    files = source_file.select(F.col("id").alias("source_file_id"), "path", "root_id")
    names = project.select(F.col("id").alias("project_id"), F.col("canonical_key").alias("project_key"), "display_name")
    roots = root.select(F.col("id").alias("root_id"), F.col("path").alias("root_path"))
    rows = session.join(F.broadcast(supported), "agent", "left_semi").join(files, "source_file_id").join(names, "project_id").join(roots, "root_id", "left")
    return rows.withColumn("resolved_title", resolved_title())


def sidebar_total(project_rows: DataFrame) -> DataFrame:
    return project_rows.agg(F.coalesce(F.sum("session_count"), F.lit(0)).alias("sessions"))


def session_count(summary: DataFrame, project_key: str | None = None) -> DataFrame:
    rows = summary if project_key is None else summary.where(F.col("project_key") == project_key)
    return rows.agg(F.count("*").alias("sessions"))


def transcript(message: DataFrame, session_id: int) -> DataFrame:
    return message.where(F.col("session_id") == session_id).orderBy("seq")


def message(message: DataFrame, session: DataFrame, source_file: DataFrame, id_: int) -> DataFrame:
    """One message with its session and file; none if either is gone."""
    s = session.select(F.col("id").alias("session_id"), "external_id", "project_id")
    f = source_file.select(F.col("id").alias("source_file_id"), "path")
    return message.where(F.col("id") == id_).join(s, "session_id").join(f, "source_file_id")


def failures(failure: DataFrame, session_id: int | None = None) -> DataFrame:
    rows = failure if session_id is None else failure.where(F.col("session_id") == session_id)
    return rows.orderBy(F.col("ts").desc(), "source_key")


def statistics(source_file: DataFrame, session: DataFrame, supported: DataFrame) -> DataFrame:
    """One row: files, projects in use, sessions and messages."""
    live = session.join(F.broadcast(supported), "agent", "left_semi")
    sums = live.agg(F.count_distinct("project_id").alias("projects"), F.count("*").alias("sessions"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"))
    files = source_file.join(F.broadcast(supported), "agent", "left_semi").agg(F.count("*").alias("files"))
    return files.crossJoin(sums)  # one row each


def source_health(root: DataFrame, source_file: DataFrame, session: DataFrame, adapter_health: DataFrame, scan_error: DataFrame, supported: DataFrame) -> DataFrame:
    """Each configured root with what was found below it and what failed; aggregates first, outer joins after."""
    scans = scan_error.groupBy("root_id").agg(F.max("error").alias("scan_error"), F.count("*").alias("scan_errors"))
    health = adapter_health.select("source_file_id", F.col("last_error").alias("parse_error"), "last_success_ms")
    files = source_file.join(health, source_file["id"] == health["source_file_id"], "left").groupBy("root_id").agg(
        F.count("*").alias("files"), F.max(F.coalesce("parse_error", "last_error")).alias("file_error"),
        F.count(F.coalesce("parse_error", "last_error")).alias("failed_files"), F.max("last_success_ms").alias("last_success_ms"),
    )
    owner = source_file.select(F.col("id").alias("source_file_id"), "root_id")
    sessions = session.join(owner, "source_file_id").groupBy("root_id").agg(F.count("*").alias("sessions"), F.min("started_at").alias("first_started_at"), F.max("last_activity_at").alias("last_activity_at"))
    rows = root.join(F.broadcast(supported), "agent", "left_semi").withColumnRenamed("id", "root_id")
    for part in (scans, files, sessions):
        rows = rows.join(part, "root_id", "left")
    zero = {c: 0 for c in ("scan_errors", "files", "failed_files", "sessions")}
    return rows.fillna(zero).orderBy("agent", "path")


def failure_counts(source_file: DataFrame, adapter_health: DataFrame, scan_error: DataFrame, root: DataFrame) -> DataFrame:
    """Unresolved failures: files whose parse or read failed, and errors below roots still configured."""
    bad = adapter_health.where("last_error is not null").select(F.col("source_file_id").alias("id"))
    failed = source_file.where("last_error is not null").select("id").unionByName(bad).distinct()
    known = failed.join(source_file.select("id"), "id", "left_semi").agg(F.count("*").alias("failed_files"))
    scans = scan_error.join(root.select(F.col("id").alias("root_id")), "root_id", "left_semi").agg(F.count("*").alias("failed_scans"))
    return known.crossJoin(scans)  # one row each


def recovery_work(source_file: DataFrame, scan_error: DataFrame, root: DataFrame) -> DataFrame:
    """Paths to visit again: failed files and scopes whose listing failed."""
    files = source_file.where("last_error is not null").select("agent", "path", F.lit("file").alias("work"))
    roots = root.select(F.col("id").alias("root_id"), "agent", F.col("path").alias("root_path"))
    scopes = scan_error.join(roots, "root_id").select("agent", F.when(F.col("relative_scope") == "", F.col("root_path")).otherwise(F.concat_ws("/", "root_path", "relative_scope")).alias("path"), F.lit("scope").alias("work"))
    return files.unionByName(scopes)


def legacy_failures(session: DataFrame, message: DataFrame, failure: DataFrame) -> DataFrame:
    """Sessions with an error message that no stored failure accounts for."""
    broken = message.where("has_error").select(F.col("session_id").alias("id"), "source_key")
    known = failure.select(F.col("session_id").alias("id"), "source_key")
    return session.join(broken.join(known, ["id", "source_key"], "left_anti"), "id", "left_semi")


LOCATOR = ["agent", "root_path", "path", "external_id"]


def known(rows: DataFrame, **allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose named columns hold one of the values this version knows; stored rows of a later version are left out."""
    for name, values in allowed.items():
        rows = rows.where(F.col(name).isin(*values))
    return rows


def capture_reference(summary: DataFrame, message: DataFrame, session_id: int, anchor_id: int | None = None) -> DataFrame:
    """What is needed to find a session, and a place in it, after a rebuild gave out new ids.  An anchor that is not in the session leaves the place null."""
    row = summary.where(F.col("id") == session_id).select(*LOCATOR, F.col("id").alias("session_id"))
    place = message.where(F.col("session_id") == session_id)
    if "external_uuid" not in message.columns:
        place = place.withColumn("external_uuid", F.lit(None).cast("string"))
    is_anchor = F.lit(False) if anchor_id is None else F.col("id") == anchor_id
    anchor = place.where(is_anchor).select("session_id", "source_key", "external_uuid", F.col("seq").alias("anchor_seq"))  # one row
    before = place.select("session_id", "seq").join(F.broadcast(anchor.select("session_id", "anchor_seq")), "session_id")
    index = before.groupBy("session_id").agg(F.count_if(F.col("seq") < F.col("anchor_seq")).alias("anchor_index"))
    return row.join(anchor, "session_id", "left").join(index, "session_id", "left").select(*LOCATOR, "source_key", "external_uuid", "anchor_index")


def alias_places(aliases: DataFrame, root: DataFrame) -> DataFrame:
    """Where moved files were, by path of their root, from aliases as :func:`dml.move_aliases` gives them."""
    roots = root.select(F.col("id").alias("prior_root"), F.col("path").alias("root_path"))
    return aliases.join(roots, "prior_root").select("agent", "root_path", F.col("prior_path").alias("path"), "source_file_id")


def resolve_reference(reference: DataFrame, summary: DataFrame, message: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The session each reference names now, and its anchor there.

    A session is found where its file was moved to (``places``, of :func:`alias_places`), else
    where the reference says.  The anchor is the first message with the reference's external
    uuid if it has one, else the one with its source key; where that is gone, the message at
    ``anchor_index``, held to the session's first and last.  References without a session give
    no row; ``message_index`` counts the messages before the anchor.  The reference's own columns come with it.
    """
    refs = reference if "external_uuid" in reference.columns else reference.withColumn("external_uuid", F.lit(None).cast("string"))
    refs = refs.select(*LOCATOR, "source_key", "external_uuid", F.col("anchor_index").cast("bigint").alias("anchor_index"))
    direct = summary.select(*LOCATOR, F.col("id").alias("session_id"))
    if places is None:
        found = refs.join(direct, LOCATOR)
    else:
        at = summary.select("source_file_id", "external_id", F.col("id").alias("moved_id"))
        moved = places.join(at, "source_file_id").select(*LOCATOR, "moved_id")
        found = refs.join(moved, LOCATOR, "left").join(direct, LOCATOR, "left").withColumn("session_id", F.coalesce("moved_id", "session_id")).where("session_id is not null").drop("moved_id")
    said = message.join(found.select("session_id").distinct(), "session_id", "left_semi")
    if "external_uuid" not in said.columns:
        said = said.withColumn("external_uuid", F.lit(None).cast("string"))
    by_uuid = said.where("external_uuid is not null").groupBy("session_id", "external_uuid").agg(F.min_by("id", "seq").alias("uuid_id"))
    by_key = said.groupBy("session_id", "source_key").agg(F.min_by("id", "seq").alias("key_id"))
    counts = said.groupBy("session_id").agg(F.count("*").alias("n"))
    rows = found.join(by_uuid, ["session_id", "external_uuid"], "left").join(by_key, ["session_id", "source_key"], "left").join(counts, "session_id", "left")
    rows = rows.withColumn("anchor_id", F.when(F.col("external_uuid").isNotNull(), F.col("uuid_id")).otherwise(F.col("key_id")))
    rows = rows.withColumn("held", F.when(F.col("anchor_id").isNull() & F.col("anchor_index").isNotNull(), F.greatest(F.lit(0), F.least(F.col("anchor_index"), F.col("n") - 1))))
    ranked = said.select("session_id", "id", (F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "id")) - 1).cast("bigint").alias("place"))
    by_place = ranked.select("session_id", F.col("place").alias("held"), F.col("id").alias("held_id"))
    by_id = ranked.select("session_id", F.col("id").alias("anchor_id"), "place")
    rows = rows.join(by_place, ["session_id", "held"], "left").join(by_id, ["session_id", "anchor_id"], "left")
    return rows.select(*refs.columns, "session_id", F.coalesce("anchor_id", "held_id").alias("message_id"), F.coalesce("place", F.when(F.col("held_id").isNotNull(), F.col("held"))).alias("message_index"))
