"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents form blocks by a hash.  Its share of the mix is an exact
quota of block draws: whole passes over all blocks, then the first blocks of one
more pass, each pass in an order of its own, the last block cut at the document that
reaches the target; then one document is added or left out where that comes closer.
The quotas are split among the output shards by a binary tree of multivariate
hypergeometric draws, in two steps: groups of sources first, then, in tasks, the
sources of each group.  Each shard gets a run of every source's permuted draws, no draw
goes to two shards, and a shard's documents are shuffled by a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import numbered, record, save
from .sharding import communication_matrix, draw_counts

WEIGHTS, MAX_REPEAT = (5.0, 2.0, 1.0), 3
#: Documents of a block, at most, about; blocks for each shard, at least, about, as far as the documents go.
SHARDS, BLOCK_DOCS, BLOCKS_PER_SHARD = 40, 2_000, 32
#: Groups of sources that the tree's first step splits; slices of a source's blocks that running totals go by, as a power of two.
GROUPS, SLICE_BITS = 256, 12


def word_count(text):
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """Adds ``target`` to ``(words, weight)`` rows: shares of all words by weight; what lies over ``most`` times a source's words goes to the others by weight, until none is over.

    Each step is one sum over the sources; a source once over stays over, so only two numbers pass from step to step.
    """
    total, weights = sources.agg(F.sum("words"), F.sum("weight")).first()
    rest, weight, closed = float(total or 0), weights or 1.0, 0
    over = F.lit(False)
    while True:
        over = over | (rest * F.col("weight") / weight > most * F.col("words"))
        words, gone, n = sources.where(over).agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
        if n == closed or weights - gone <= 0:
            break
        rest, weight, closed = float(total - most * words), weights - gone, n
    return sources.withColumn("target", F.when(over, (most * F.col("words")).cast("double")).otherwise(rest * F.col("weight") / weight))


def split_tree(rng: np.random.Generator, quotas: list[int], shards: int) -> list[list[int]]:
    """Block draws of each group for each shard: rows are shards, columns groups; shards' totals are a draw apart at most."""
    if shards == 1:
        return [quotas]
    total, left = sum(quotas), shards // 2
    counts = draw_counts(rng, quotas, total * left // shards)
    return split_tree(rng, counts, left) + split_tree(rng, [q - c for q, c in zip(quotas, counts, strict=True)], shards - left)


def _shard_ends(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(src, ends)``: where each shard's run ends among a source's draws."""
    grouped = quotas.withColumn("g", F.pmod(F.xxhash64("src"), F.lit(GROUPS)).cast("int"))
    held = {r["g"]: r["n"] for r in grouped.groupBy("g").agg(F.sum("quota").alias("n")).collect()}  # at most GROUPS rows
    order = sorted(held)
    tree = split_tree(np.random.default_rng(seed), [held[g] for g in order], shards)
    columns = {g: [row[i] for row in tree] for i, g in enumerate(order)}

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("src")
        matrix = communication_matrix(np.random.default_rng([seed, key[0]]), [int(q) for q in rows["quota"]], columns[key[0]])
        return pd.DataFrame({"src": rows["src"], "ends": [np.cumsum(row) for row in matrix]})

    return grouped.groupBy("g").applyInPandas(split, "src string, ends array<bigint>")


def _drawn(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``(src, block, pass, before, turn)``: one row for each draw of a block; ``before`` are the words of the pass's blocks before it, ``turn`` its place among all the source's draws.

    Running totals go by slices of the permuted order, so no task holds all blocks of a source.
    """
    each = sizes.join(plan.select("src", "passes", "rest"), "src").withColumn("pass", F.explode(F.sequence(F.lit(0), "passes"))).where("pass < passes or rest > 0")
    order = F.xxhash64(F.lit(seed), "src", "pass", "block")
    each = each.withColumn("order", order).withColumn("slice", F.shiftright("order", 64 - SLICE_BITS))
    slices = each.groupBy("src", "pass", "slice").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    earlier = Window.partitionBy("src", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("src", "pass", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy("src", "pass", "slice").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("w", F.coalesce(F.sum("words").over(inside), F.lit(0))).withColumn("k", F.count("*").over(inside))
    placed = each.join(slices, ["src", "pass", "slice"]).withColumn("before", F.col("words_before") + F.col("w")).where("pass < passes or before < rest")
    blocks = sizes.groupBy("src").agg(F.count("*").alias("held"))
    return placed.join(blocks, "src").select("src", "block", "pass", "before", (F.col("pass") * F.col("held") + F.col("n_before") + F.col("k") + 1).alias("turn"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MAX_REPEAT, shards: int = SHARDS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", payload: list[str] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``rec``, ``size``, ``source_size``, ``target``, ``draws`` for every row, drawn or not.

    ``draws`` is an array of ``(pass, shard, order)``, empty for a document the mix leaves out; no
    document is drawn more than ``most`` times.  Sources in code point order,
    null last, take ``weights`` in turn.  Size is the number of words; null and
    empty texts have none, and a source of such texts has target 0.  Documents
    are ordered by a hash of seed, id and text, so reruns agree; of repeated
    rows either may be drawn.  Extra columns travel in ``rec``; an empty
    table gives an empty result.  The driver holds a few sums and one row for each of 256 groups of sources.
    """
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    rec = F.struct(*[docs[f"`{c}`"] for c in payload]) if payload else record(docs)
    group = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    base = save(docs.select(rec.alias("rec"), group.alias("src"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("h"), F.monotonically_increasing_id().alias("rid")), "sized")
    sums = numbered(base.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("words")), F.col("src") == "", "src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = save(sums.select("src", "n", "words", weight.alias("weight")), "sources")
    size = max(1, min(block_docs, (sources.agg(F.sum("n")).first()[0] or 0) // (shards * BLOCKS_PER_SHARD)))
    passes = F.least(F.floor(F.col("target") / F.greatest(F.lit(1), "words")), F.lit(most)).cast("int")
    plan = with_targets(sources, most).withColumn("passes", passes)
    # A written table's size is known, so Spark joins it without moving the documents while it is small, and splits hot sources where it is not.
    plan = save(plan.select("src", F.col("words").alias("source_size"), "target", "passes", (F.col("target") - F.col("passes") * F.col("words")).alias("rest"), F.ceil(F.col("n") / size).alias("blocks")), "plan")
    placed = base.select("rid", "src", "size", "h").join(plan, "src").withColumn("block", F.pmod("h", "blocks"))
    sizes = save(placed.groupBy("src", "block").agg(F.sum("size").alias("words")), "blocks")
    drawn = save(_drawn(sizes, plan, seed), "draws")
    ends = _shard_ends(drawn.groupBy("src").agg(F.count("*").alias("quota")), shards, seed)
    # A block has one draw a pass, so its list is at most one longer than ``most``.
    draw = F.struct("pass", F.size(F.filter("ends", lambda e: e < F.col("turn"))).alias("shard"), "before")
    lists = drawn.join(ends, "src").groupBy("src", "block").agg(F.sort_array(F.collect_list(draw)).alias("list"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("src", "block").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = placed.withColumn("inside", inside).join(lists, ["src", "block"], "left")
    # The last, partial pass takes a block's documents up to the target.
    partial = F.get(F.filter("list", lambda d: d["pass"] == F.col("passes")), F.lit(0))
    extra = F.coalesce(partial["before"] + F.col("inside") + F.col("size") / 2 <= F.col("rest"), F.lit(False))
    taken = F.coalesce(F.filter("list", lambda d: d["pass"] < F.col("passes")), F.expr("cast(array() as array<struct<pass:int,shard:int,before:bigint>>)"))
    other = F.coalesce(partial["shard"], F.pmod("h", F.lit(shards)).cast("int"))
    full = save(full.select("rid", "src", "size", "h", "source_size", "target", "passes", "rest", taken.alias("taken"), extra.alias("extra"), other.alias("other")), "taken")
    full = full.join(_closest(full, most), "rid", "left").withColumn("extra", F.col("extra") != F.coalesce("flip", F.lit(False)))
    last = F.when(F.col("extra"), F.array(F.struct(F.col("passes").alias("pass"), F.col("other").alias("shard"), F.lit(0).cast("bigint").alias("before")))).otherwise(F.expr("cast(array() as array<struct<pass:int,shard:int,before:bigint>>)"))
    draws = F.transform(F.concat("taken", last), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.col("h"), d["pass"]).alias("order")))
    return base.select("rid", "rec").join(full.select("rid", "size", "source_size", "target", draws.alias("draws")), "rid").drop("rid")


def _closest(full: DataFrame, most: int) -> DataFrame:
    """``(rid, flip)``: of each source, the one document that, added to its last pass or left out of it, brings the words taken closest to the target."""
    got = full.groupBy("src").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got"), F.first("rest").alias("aim"))
    gaps = save(got.select("src", (F.col("aim") - F.col("got")).alias("gap")).where("gap <> 0"), "gaps")
    able = full.join(gaps, "src").where((F.col("gap") > 0) != F.col("extra")).where(F.col("passes") + (~F.col("extra")).cast("int") <= most)
    error = F.abs(F.abs("gap") - F.col("size"))
    best = able.where(error < F.abs("gap")).groupBy("src").agg(F.min(F.struct(error.alias("error"), "h", "rid")).alias("best"))
    return best.select("best.rid", F.lit(True).alias("flip"))


def rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: ``rec``, ``pass``, ``shard``, ``order``; one row for each time a document is drawn, none for one left out."""
    return mixed.select("rec", F.explode("draws").alias("d")).select("rec", "d.pass", "d.shard", "d.order")


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, its source's size and target, the words taken, and its draws with pass, shard and order; other cases as in :func:`mix`."""
    out = mix(docs, id_col=id_col, payload=[id_col], **options)
    return out.select(F.col(f"rec.`{id_col}`").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")
