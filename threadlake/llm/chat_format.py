"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users, with a mask that marks
the spans to learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import save

#: Turns in one part of a rendered dialogue; parts joined in order are the whole.
PART_TURNS = 128
OPEN, CLOSE, AFTER = "<|im_start|>", "\n", "<|im_end|>\n"


def _ranked(turns: DataFrame) -> DataFrame:
    """Adds ``pos``, the row's place in its conversation from 0.

    A range exchange over all sort columns cuts a long conversation anywhere, and
    rows count from the start of their conversation by partition totals, so no
    task needs a whole conversation.
    """
    keys = ["conv", F.col("turn").asc_nulls_first(), "speaker", "body", "salt"]
    spread = turns.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = save(spread.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("at", 33)), "turns")
    counts = ordered.groupBy("conv", "piece").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("conv").alias("c"), F.col("piece").alias("p"), "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return ordered.join(starts, ordered["conv"].eqNullSafe(starts["c"]) & (ordered["piece"] == starts["p"])).select("conv", "turn", "speaker", "body", (F.col("before") + F.col("at") - F.col("first")).alias("pos"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id``, ``perspective``, ``part``, ``n_turns``, ``text``, ``mask``: one row per part of each rendering.

    ``mask`` is an array of ``(start, end)`` character offsets into the part's
    text: the bodies and end marks of the perspective's own turns.  The system
    speaker frames the dialogue and has no perspective of its own.  A null speaker
    is the participant ``unknown``; null text is empty; turns are ordered by turn
    (null first), then speaker, then text, and repeated rows are all rendered.
    A null conversation id is a conversation of its own.  A conversation of system turns only
    gives no rows, as does an empty table.  Other columns are not read.
    """
    c = lambda n: F.col(f"`{n}`")
    base = turns.select(c(conv_col).alias("conv"), c(turn_col).alias("turn"), F.coalesce(c(speaker_col), F.lit("unknown")).alias("speaker"), F.coalesce(c(text_col), F.lit("")).alias("body"))
    ranked = save(_ranked(base), "ranked")
    people = ranked.where(F.col("speaker") != system).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = ranked.join(people, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    name = F.when(own, F.lit("assistant")).when(F.col("speaker") == system, F.lit(system)).otherwise(F.concat(F.lit("user name="), "speaker"))
    head = F.concat(F.lit(OPEN), name, F.lit(CLOSE))
    seen = seen.select("conv", "perspective", F.floor(F.col("pos") / part_turns).alias("part"), "pos", head.alias("head"), F.concat("body", F.lit(AFTER)).alias("tail"), own.alias("own"))
    packed = seen.groupBy("conv", "perspective", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "head", "tail", "own"))).alias("turns"))
    # Offsets: a running length folded over the part's turns.
    fold = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["tail"])).alias("at"),
            F.when(t["own"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["tail"])).alias("end"))))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    return packed.select(
        F.col("conv").alias("conv_id"), "perspective", "part", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["tail"])), "").alias("text"),
        fold["mask"].alias("mask"),
    )
