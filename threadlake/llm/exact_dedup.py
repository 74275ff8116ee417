"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive byte ranges of their text, most significant
first.  A group that becomes a singleton, or whose texts have all ended, is
done; the others go on to the next range.  Equality is decided by the bytes
themselves, no digest takes part.  Ranges widen geometrically, so a text of n
bytes needs log(n) rounds, and only rows that still share a prefix move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, record, save

FIRST_BYTES, WIDEN = 48, 8


def _first_level(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """``rid``, ``own``, ``id``, ``alone``, ``key``: alone is a row whose first bytes no other row has; only other rows have a key.

    Most rows end here, and only keys of the others take part in what follows.
    ``own`` is the whole row, or the digest of its text.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    head = F.encode(ascii_lower(F.substring(text, 1, FIRST_BYTES)), "UTF-8")
    own = record(docs) if whole else F.sha2(F.encode(ascii_lower(text), "UTF-8"), 256)
    rows = docs.select(own.alias("own"), F.col(f"`{id_col}`").alias("id"), F.substring(head, 1, FIRST_BYTES).alias("part"), (F.octet_length(text) <= FIRST_BYTES).alias("ended"), *([] if whole else [text.alias("text")]))
    text = F.coalesce(F.col(f"own.`{text_col}`"), F.lit("")) if whole else F.col("text")
    shared = rows.groupBy("part", "ended").agg(F.count("*").alias("n")).where("n > 1")
    # A merge join at every size: AQE can split a hot prefix, and nothing is broadcast.
    met = rows.join(shared.hint("merge"), ["part", "ended"], "left")
    alone = F.col("n").isNull()
    return save(met.select(F.monotonically_increasing_id().alias("rid"), "own", "id", alone.alias("alone"), F.when(~alone, F.encode(ascii_lower(text), "UTF-8")).alias("key")), "exact")


def _classes(keys: DataFrame) -> DataFrame:
    """``(rid, gid)``: rows with equal ``key`` bytes have one gid, the largest rid among them."""
    active, done, start, width = None, [], 1, FIRST_BYTES
    while True:
        rows = keys.select("rid", F.substring("key", start, width).alias("part"), (F.length("key") < start + width).alias("ended"))
        rows = rows.withColumn("gid", F.lit(0).cast("long")) if active is None else rows.join(active, "rid")
        groups = rows.groupBy("gid", "part", "ended").agg(F.count("*").alias("n"), F.max("rid").alias("next"))
        # A row that ended can equal only rows that ended with the same bytes.
        split = rows.join(groups, ["gid", "part", "ended"]).select("rid", F.col("next").alias("gid"), (F.col("ended") | (F.col("n") == 1)).alias("done"))
        split = save(split, "radix")
        done.append(split.where("done").select("rid", "gid"))
        active = split.where("not done").select("rid", "gid")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)
        start, width = start + width, width * WIDEN


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """One row per input row: ``own`` (the whole row, or the text's SHA-256), ``id``, ``keep_id``, ``group_size``, ``kept``.

    Texts are equal if they are identical after lower-casing A-Z.
    Null text counts as empty; all empty texts are one group.  Of a group the
    row with the largest id stays; a null id ranks lowest; of rows with the same
    id one stays.  Repeated rows are members like any other.  Extra columns
    travel inside ``own`` and cannot clash.  An empty table gives an empty
    result.  The input is read twice and must give the same rows each time, as stored tables do.
    """
    level = _first_level(docs, id_col, text_col, whole)
    alone = level.where("alone").select("own", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    rest = level.where("not alone")
    classes = save(_classes(rest.select("rid", "key")), "classes")
    best = classes.join(rest.select("rid", "id"), "rid").groupBy("gid").agg(F.count("*").alias("group_size"), F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "rid")).alias("top"))
    chosen = classes.join(best, "gid").select("rid", F.col("top.id").alias("keep_id"), "group_size", (F.col("top.rid") == F.col("rid")).alias("kept"))
    return alone.unionByName(rest.select("rid", "own", "id").join(chosen, "rid").drop("rid"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The membership table: id, the id that stays, group size, whether this row stays, and the text's SHA-256."""
    return dedup(docs, id_col, text_col, whole=False).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("own").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, one row of each group of equal texts."""
    return dedup(docs, id_col, text_col).where("kept").select("own.*")
