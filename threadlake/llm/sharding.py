"""Sharding by a hypergeometric communication matrix.

How many rows each partition sends to each shard is drawn exactly, as a uniform
shuffle would have it; rows are permuted inside their partition, exchanged by
those counts, and permuted again inside their shard.  Shard sizes differ by one row at most.
The matrix is drawn in tasks, level by level: a node's counts are split among the groups of
partitions below it, so neither the driver nor one task ever holds it whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import record, save

#: Rows of a partition, about, and partitions or groups of them below one node of the matrix's tree (as a power of two).
PARTITION_ROWS, FAN_OUT_BITS = 2_000, 8
#: Up to so many items are drawn one by one; more by rejection.  Both follow the exact law.
ONE_BY_ONE = 10


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good, of any number of items.

    Rejection under a ratio-of-uniforms hat; the law's logarithm is taken relative to
    its mode in a form that loses no digits when the counts are very large.
    """
    total = good + bad
    if n > total - n:  # what is left over follows the same law
        return good - hypergeometric(rng, good, bad, total - n)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    few, many = sorted((good, n))  # the law is the same with these two exchanged
    if few <= ONE_BY_ONE:
        hits = 0
        for i in range(few):
            hits += int(rng.integers(total - i) < many - hits)
        return hits
    mode = (few + 1) * (many + 1) // (total + 2)
    mean = few * many / total
    var = mean * (1 - many / total) * ((total - few) / (total - 1))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if 0 <= k <= few and 2 * math.log(u) <= _log_ratio(k - mode, (mode, few - mode, many - mode, total - few - many + mode)):
            return k


def _log_ratio(step: int, at: tuple[int, int, int, int]) -> float:
    """ln(p(mode + step) / p(mode)), where p is one over the factorials of four counts; ``at`` are the counts at the mode."""
    out = 0.0
    for x, d in zip(at, (step, -step, -step, step), strict=True):
        out -= _log_factorial_change(x, d)
    return out


def _log_factorial_change(x: int, d: int) -> float:
    """ln((x + d)!) - ln(x!)."""
    if min(x, x + d) < 64:
        return math.lgamma(x + d + 1) - math.lgamma(x + 1)
    y = x + d
    series = lambda z: 1 / (12 * z) - 1 / (360 * z**3)
    return x * math.log1p(d / x) + d * math.log(y) - d + 0.5 * math.log1p(d / x) + series(y) - series(x)


def draw_counts(rng: np.random.Generator, pools: list[int], n: int) -> list[int]:
    """Multivariate: how many of ``n`` draws come from each pool."""
    rest, out = sum(pools), []
    for p in pools:
        rest -= p
        k = hypergeometric(rng, p, rest, n) if n else 0
        out.append(k)
        n -= k
    return out


def even(n: int, shards: int) -> list[int]:
    return [n // shards + (i < n % shards) for i in range(shards)]


def communication_matrix(rng: np.random.Generator, rows: list[int], free: list[int]) -> list[list[int]]:
    """Counts from each partition to each shard; rows sum to ``rows``, columns to ``free``."""
    out = []
    for r in rows:
        counts = draw_counts(rng, free, r)
        free = [f - c for f, c in zip(free, counts, strict=True)]
        out.append(counts)
    return out


def _matrix(held: DataFrame, parts: int, free: list[int], seed: int, bits: int) -> DataFrame:
    """``(part, counts)`` for the partitions of ``held(part, n)``, by a tree of ``2^bits`` branches a node."""
    spark = held.sparkSession
    depth = max(1, math.ceil(math.log2(max(2, parts)) / bits))
    quotas = spark.createDataFrame([(0, free)], "node bigint, counts array<bigint>")
    for level in range(1, depth + 1):
        child = F.shiftright("part", bits * (depth - level))
        below = held.groupBy(child.alias("child")).agg(F.sum("n").alias("n"))
        # At most 2^bits children a node.
        below = below.groupBy(F.shiftright("child", bits).alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "n"))).alias("children"))

        def split(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for node, counts, children in zip(b["node"], b["counts"], b["children"], strict=True):
                    rng = np.random.default_rng([seed, level, int(node)])
                    matrix = communication_matrix(rng, [int(c["n"]) for c in children], [int(x) for x in counts])
                    out += [(int(c["child"]), row) for c, row in zip(children, matrix, strict=True)]
                yield pd.DataFrame(out, columns=["node", "counts"])

        quotas = save(below.join(quotas, "node").select("node", "counts", "children").mapInPandas(split, "node bigint, counts array<bigint>"), "matrix")
    return quotas.withColumnRenamed("node", "part")


def shuffle(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None, partition_rows: int = PARTITION_ROWS, fan_out_bits: int = FAN_OUT_BITS) -> DataFrame:
    """``rec`` (the payload columns, all by default), ``size``, ``text_crc32``, ``shard``, ``slot`` for every row.

    Size is the text's UTF-8 bytes plus 16; null text has no bytes and checksum 0.  Rows are placed by
    hashes of seed, id, size and checksum, so reruns agree; repeated rows are
    interchangeable.  With fewer rows than shards some shards are empty; an
    empty table gives an empty result; extra columns travel in ``rec``.
    """
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    ident = F.col(f"`{id_col}`")
    size, crc = (F.length(text) + 16).cast("long"), F.crc32(text)
    key = lambda k: F.xxhash64(F.lit(seed), F.lit(k), ident, size, crc)
    rec = F.struct(*[docs[f"`{c}`"] for c in payload]) if payload else record(docs)
    base = save(docs.select(rec.alias("rec"), size.alias("size"), crc.alias("text_crc32"), key(1).alias("h1"), key(2).alias("h2"), F.monotonically_increasing_id().alias("rid")), "rows")
    n = base.count()
    parts = max(1, math.ceil(n / partition_rows))
    base = base.withColumn("part", F.pmod("h1", F.lit(parts)))
    matrix = _matrix(base.groupBy("part").agg(F.count("*").alias("n")), parts, even(n, shards), seed, fan_out_bits)
    ends = matrix.select("part", F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("ends"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("h1"), "h1", "rid"))
    sent = base.withColumn("place", place).join(ends, "part")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    # Second permutation: cells of a shard in order of a fresh hash, ranked inside cells and offset by cell totals.
    sent = save(sent.select("rec", "size", "text_crc32", "shard", "h2", "rid", F.pmod("h2", F.lit(math.ceil(parts / shards))).alias("cell")), "sent")
    totals = sent.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("shard", "cell", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(F.xxhash64("h2"), "h2", "rid"))
    return sent.withColumn("inside", inside).join(offsets, ["shard", "cell"]).select("rec", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))


def write(shuffled: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order inside its files: ``rec`` and ``slot``, whatever the columns inside ``rec`` are called.

    An empty table leaves an empty folder.
    """
    shuffled.select("rec", "slot", "shard").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document with its size, checksum, law, shard and slot; null, empty and repeated rows as in :func:`shuffle`."""
    out = shuffle(docs, shards, seed, id_col, text_col, payload=[id_col], **options)
    return out.select(F.col(f"rec.`{id_col}`").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
