"""Changes to stored tables as whole-table expressions: the result is the new table.

A caller writes it as a new version, or with dynamic partition overwrite by ``source_file_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import FAILURE_DETAIL, path_contains


def replace_files(stored: DataFrame, fresh: DataFrame, files: DataFrame, key: str = "source_file_id") -> DataFrame:
    """Rows of the named files give way to the fresh ones; a file without fresh rows ends up empty."""
    return stored.join(files.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """All tables without the named files' rows, and projects without those left with no session."""
    gone = files.select("source_file_id").distinct()
    out = {n: t.join(gone, "source_file_id", "left_anti") if "source_file_id" in t.columns else t for n, t in tables.items()}
    if "source_file" in out:
        out["source_file"] = out["source_file"].join(gone.select(F.col("source_file_id").alias("id")), "id", "left_anti")
    if {"project", "session"} <= out.keys():
        out["project"] = drop_orphans(out["project"], out["session"], out.get("usage_observation"))
    return out


def drop_orphans(project: DataFrame, session: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    used = session.select(F.col("project_id").alias("id"))
    if usage is not None:
        used = used.unionByName(usage.select(F.col("project_id").alias("id")))
    return project.join(used.distinct(), "id", "left_semi")


def upsert_failures(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The last write of a key wins; details are cut to their limit."""
    cut = fresh.withColumn("detail", F.substring("detail", 1, FAILURE_DETAIL))
    last = cut.groupBy("session_id", "source_key").agg(F.max_by(F.struct(*[F.col(c) for c in cut.columns]), "arrival").alias("row")).select("row.*").drop("arrival")
    return stored.join(last, ["session_id", "source_key"], "left_anti").unionByName(last)


def _met_again(source_file: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, new_path, new_root)`` of stored files whose device and inode are met under other paths only; of several the first by spelling.

    Where the stored path itself is still found with that inode the others are further links to it, and no move.
    """
    new = found.select("agent", "dev", "inode", F.col("path").alias("new_path"), F.col("root_id").alias("new_root"))
    met = source_file.select("id", "agent", "dev", "inode", "path").join(new, ["agent", "dev", "inode"])
    first = met.groupBy("id").agg(F.bool_or(F.col("path") == F.col("new_path")).alias("stays"), F.min_by(F.struct("new_path", "new_root"), F.struct(F.col("new_path") != F.col("path"), "new_path")).alias("to"), F.first("dev").alias("dev"), F.first("inode").alias("inode"), F.first("agent").alias("agent"))
    # Of stored files that share an inode one can move to a path.
    return first.groupBy("agent", "to.new_path").agg(F.min_by(F.struct("id", "to.new_root", "stays"), F.struct(~F.col("stays"), "id")).alias("r")).select(F.col("r.id").alias("id"), "new_path", F.col("r.new_root").alias("new_root"))


def move_file(source_file: DataFrame, found: DataFrame) -> DataFrame:
    """A file met under another path keeps its id when device and inode are its own; of hard links only one is the file."""
    rows = source_file.join(_met_again(source_file, found), "id", "left")
    return rows.withColumn("path", F.coalesce("new_path", "path")).withColumn("root_id", F.coalesce("new_root", "root_id")).select(*source_file.columns)


def move_aliases(source_file: DataFrame, found: DataFrame, generation: str) -> DataFrame:
    """Where a moved file was, for references made before."""
    moved = source_file.join(_met_again(source_file, found), "id").where("path <> new_path")
    return moved.select(F.lit(generation).alias("generation"), "agent", F.col("root_id").alias("prior_root"), F.col("path").alias("prior_path"), F.col("id").alias("source_file_id"))


def settle_placeholders(source_file: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files entered after a failure become ordinary once they parse; ``parsed`` has their ids."""
    ok = parsed.select("id", F.lit(True).alias("ok"))
    rows = source_file.join(ok, "id", "left")
    return rows.withColumn("is_placeholder", F.col("is_placeholder") & F.col("ok").isNull()).withColumn("last_error", F.when(F.col("ok").isNull(), F.col("last_error"))).drop("ok").select(*source_file.columns)


def synchronise_roots(stored: DataFrame, configured: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(kept, added, removed)`` by provider and path."""
    key = ["agent", "path"]
    return stored.join(configured, key, "left_semi"), configured.join(stored.select(*key), key, "left_anti"), stored.join(configured, key, "left_anti")


def replace_scan_errors(stored: DataFrame, scanned: DataFrame, fresh: DataFrame) -> DataFrame:
    """Errors at or below a scope that was scanned again go; the scan's own come in."""
    scope = scanned.select(F.col("root_id").alias("r"), F.col("relative_scope").alias("scope"))
    covered = (F.col("root_id") == F.col("r")) & ((F.col("scope") == "") | path_contains(F.col("scope"), F.col("relative_scope")))
    left = stored.join(scope, covered, "left_anti").join(fresh.select("root_id", "relative_scope"), ["root_id", "relative_scope"], "left_anti")
    return left.unionByName(fresh)


def merge_metadata(session: DataFrame, scan: DataFrame, replace: bool = False) -> DataFrame:
    """Titles and plan from a scan.  Merging keeps the first user message, takes a newer explicit title, and never loses a plan."""
    s = scan.select("external_id", *[F.col(c).alias(f"new_{c}") for c in ("first_user_message", "generated_title", "has_plan")], F.lit(True).alias("scanned"))
    rows = session.join(s, "external_id", "left")
    if replace:
        new = {c: F.when(F.col("scanned"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("first_user_message", "generated_title", "has_plan")}
    else:
        new = {
            "first_user_message": F.coalesce("first_user_message", "new_first_user_message"),
            "generated_title": F.coalesce("new_generated_title", "generated_title"),
            "has_plan": F.coalesce("has_plan", F.lit(False)) | F.coalesce("new_has_plan", F.lit(False)),
        }
    return rows.withColumns(new).select(*session.columns)


def apply_titles(session: DataFrame, names: DataFrame, policy: str = "complete") -> DataFrame:
    """Titles from a side file.

    ``fill_missing`` sets only absent titles, ``partial`` also those that came from an
    earlier side file, ``complete`` also clears such titles that the file no longer has.
    """
    n = names.select("external_id", F.col("name").alias("side_name"), F.col("origin").alias("side_origin"))
    rows = session.join(n, "external_id", "left")
    ours = F.col("title_origin").isNotNull()
    absent = F.col("generated_title").isNull()
    have = F.col("side_name").isNotNull()
    takes = have & (absent if policy == "fill_missing" else absent | ours)
    clears = ~have & ours if policy == "complete" else F.lit(False)
    title = F.when(takes, F.col("side_name")).when(~clears, F.col("generated_title"))
    origin = F.when(takes, F.col("side_origin")).when(~clears, F.col("title_origin"))
    return rows.withColumns({"generated_title": title, "title_origin": origin}).select(*session.columns)


def reconcile(stored: DataFrame, live: DataFrame, scanned: DataFrame) -> DataFrame:
    """Stored files that are gone: below a scope listed without failure, and not among the files found."""
    inside = stored.join(scanned.where("not failed").select(F.col("agent").alias("a"), F.col("scope").alias("scope")), (F.col("agent") == F.col("a")) & path_contains(F.col("scope"), F.col("path")), "left_semi")
    failed = scanned.where("failed").select(F.col("agent").alias("a"), F.col("scope").alias("scope"))
    sure = inside.join(failed, (F.col("agent") == F.col("a")) & path_contains(F.col("scope"), F.col("path")), "left_anti")
    return sure.join(live.select("agent", "path"), ["agent", "path"], "left_anti")


def minimal_cover(scopes: DataFrame) -> DataFrame:
    """Scopes without those that lie below another; scopes are the few paths of one request."""
    other = scopes.select(F.col("path").alias("p"))
    return scopes.distinct().join(other, (F.col("p") != F.col("path")) & path_contains(F.col("p"), F.col("path")), "left_anti")


def owner_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the deepest configured root that holds it.  Roots are few; their path's components make it an equi-join."""
    stems = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    up = files.select("*", F.explode(stems).alias("root_path"))
    held = up.join(roots.select("agent", F.col("path").alias("root_path"), F.col("id").alias("root_id")), ["agent", "root_path"])
    return held.groupBy("agent", "path").agg(F.max_by("root_id", F.length("root_path")).alias("root_id"))


def distinct_roots(roots: DataFrame) -> DataFrame:
    """One root a scanned place: defaults first, then configured order."""
    row = F.struct(*[F.col(c) for c in roots.columns])
    first = roots.groupBy("agent", F.col("path").alias("_p")).agg(F.min_by(row, F.struct(~F.col("is_default"), "position")).alias("row")).select("row.*")
    return first.groupBy("agent", F.regexp_replace("path", "/+$", "").alias("_p")).agg(F.min_by(F.struct(*[F.col(c) for c in roots.columns]), F.struct(~F.col("is_default"), "position")).alias("row")).select("row.*")


def changed_files(found: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do with each file found: skip, append from a byte, replace, read as new, or ``same``.

    ``same``: device, inode or time differ, but the file is no longer than its head and that is the one stored, so the content is.
    Where ``found`` has ``head_then``, the digest over the length of the stored head, that is compared.
    """
    small = {"head_length"} <= set(stored.columns) and {"head_length"} <= set(found.columns)
    old = ["dev", "inode", "size", "mtime_ns", "head_hash", *(["head_length"] if small else [])]
    s = stored.select("agent", "path", F.col("id"), *[F.col(c).alias(f"old_{c}") for c in old], "scanned_bytes", "last_error")
    rows = found.join(s, ["agent", "path"], "left")
    same_file = (F.col("dev") == F.col("old_dev")) & (F.col("inode") == F.col("old_inode"))
    same_head = F.col("head_then" if "head_then" in found.columns else "head_hash") == F.col("old_head_hash")
    whole = (F.col("size") == F.col("old_size")) & (F.col("scanned_bytes") == F.col("size")) & F.col("last_error").isNull()
    unchanged = same_file & same_head & whole & (F.col("mtime_ns") == F.col("old_mtime_ns"))
    appendable = same_file & same_head & (F.col("size") >= F.col("scanned_bytes")) & ((F.col("size") > F.col("old_size")) | (F.col("mtime_ns") == F.col("old_mtime_ns")))
    content = whole & same_head & (F.col("head_length") == F.col("size")) & (F.col("old_head_length") == F.col("old_size")) if small else F.lit(False)
    action = F.when(F.col("id").isNull(), "new").when(unchanged, "skip").when(content, "same").when(appendable, "append").otherwise("replace")
    return rows.select(*found.columns, "id", action.alias("action"), F.when(action == "append", F.col("scanned_bytes")).otherwise(F.lit(0)).alias("start"))


def metadata_work(files: DataFrame) -> DataFrame:
    """Files whose titles and plans are to be read, how, from which byte, and the revision to store then.

    ``files`` has ``id, revision`` (``version:generation:checkpoint`` of the last scan), ``version``
    (the one wanted), ``content_generation, scanned_bytes, snapshot``.  The scan goes on from its
    checkpoint and is merged when version and generation hold; a snapshot, another version or
    generation, and a revision that does not parse are read whole and replaced.
    """
    sound = F.coalesce(F.col("revision").rlike(r"^\d+:-?\d+:-?\d+$"), F.lit(False))
    number = lambda i: F.when(sound, F.expr(f"try_cast(split(revision, ':')[{i}] as bigint)"))
    rows = files.withColumns({"_version": number(0), "_generation": number(1), "_checkpoint": number(2)})
    same = F.coalesce((F.col("_version") == F.col("version")) & (F.col("_generation") == F.col("content_generation")), F.lit(False))
    done = same & F.coalesce(F.col("_checkpoint") == F.col("scanned_bytes"), F.lit(False))
    merges = same & ~F.col("snapshot") & F.col("_checkpoint").between(F.lit(0), F.col("scanned_bytes"))
    revision = F.concat_ws(":", "version", "content_generation", "scanned_bytes")
    return rows.where(~done).select("id", F.when(merges, "merge").otherwise("replace").alias("mode"), F.when(merges, F.col("_checkpoint")).otherwise(F.lit(0)).cast("bigint").alias("start"), revision.alias("revision"))
