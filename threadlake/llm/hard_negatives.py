"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into short slices, each replaced by the nearest of 256 trained centroids;
beside the codes stands the norm of what they leave out.  A table of an anchor's products with all centroids scores a
vector by its codes, and by Cauchy-Schwarz the true score lies within the anchor's norm times
the vector's residual norm of that.  What cannot enter an answer by these bounds is
passed over; the rest is scored exactly, in integers.

Anchors meet rows in blocks of both, so a task holds two blocks and returns a
few rows an anchor, which are merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import save, stage

#: Documented bound on rows that centroids are fitted on; every row is encoded, and bounds hold whatever the centroids.
MAX_TRAIN = 4096
SLICE, CENTROIDS, PASSES = 2, 256, 6
ROW_BLOCK, ANCHOR_BLOCK = 16384, 256
SCALE = 256.0
#: Larger components could leave 64-bit sums.
MOST = 1 << 25


def eligible(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Staged rows that take part: ``rid, vec_id, label, x`` with integer components."""
    v, label, key = F.col(f"`{vec_col}`"), F.col(f"`{label_col}`"), F.col(f"`{id_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    large = F.exists("x", lambda c: F.abs(c) >= MOST)
    out = stage(rows.where(label.isNotNull() & v.isNotNull() & whole), "mined", vec_id=key.cast("long"), label=label.cast("long"), x=x)
    return out.withColumn("x", F.when(large, F.raise_error(F.lit(f"components of {MOST} or more after scaling"))).otherwise(F.col("x")))


def train(sample: np.ndarray, seed: int = 0) -> np.ndarray:
    """Centroids ``[slice, code, component]`` by Lloyd's rounds on the sample."""
    rng = np.random.default_rng(seed)
    n, width = sample.shape
    parts = sample.reshape(n, width // SLICE, SLICE).transpose(1, 0, 2).astype(float)
    out = parts[:, rng.permutation(n)[np.arange(CENTROIDS) % n]].copy()
    for _ in range(PASSES):
        for s, (x, c) in enumerate(zip(parts, out, strict=True)):
            code = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, 1)
            size = np.bincount(code, minlength=CENTROIDS)
            sums = np.stack([np.bincount(code, x[:, k], CENTROIDS) for k in range(SLICE)], 1)
            out[s] = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return out


def quantise(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residual norms of integer vectors; the norm is rounded up."""
    parts = x.reshape(len(x), -1, SLICE).astype(float)
    codes = np.empty(parts.shape[:2], np.uint8)
    left = np.zeros(len(x))
    for s, c in enumerate(centroids):
        codes[:, s] = np.argmin((c * c).sum(1)[None] - 2 * parts[:, s] @ c.T, 1)
        left += ((parts[:, s] - c[codes[:, s]]) ** 2).sum(1)
    return codes, np.sqrt(left) * (1 + 1e-9) + 1e-9


def matrix(column, width: int) -> np.ndarray:
    """Vectors of an Arrow list column as int64 rows, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def encode(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``codes`` (a byte a slice) and ``left`` (the residual norm)."""
    width = centroids.shape[0] * SLICE

    def run(batches):
        for b in batches:
            codes, left = quantise(matrix(b.column("x"), width), centroids)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left, pa.float64())], names=[*b.schema.names, "codes", "left"])

    return rows.mapInArrow(run, "rid long, vec_id long, label long, x array<long>, codes binary, left double")


def table_scores(q: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Scores by codes: a table of the anchor's products with all centroids, one lookup a slice."""
    lookup = np.einsum("skd,sd->sk", centroids, q.reshape(-1, SLICE).astype(float))
    return lookup[np.arange(len(lookup))[:, None], codes.T].sum(0)


def _largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, -k)[-k] if len(values) >= k else -math.inf


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


class _Block:
    """A block of rows as a task holds it."""

    def __init__(self, t: pa.Table, centroids: np.ndarray):
        self.centroids = centroids
        self.x = matrix(t["x"], centroids.shape[0] * SLICE)
        self.rid, self.ids, self.label, self.left = (t[c].to_numpy() for c in ("rid", "vec_id", "label", "left"))
        self.codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(self.x), -1)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = table_scores(q, self.codes, self.centroids)
        slack = math.sqrt(float(q @ q)) * self.left * (1 + 1e-9) + 1e-6 * (1 + np.abs(near))
        return near - slack, near + slack

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.x[at] @ q


def _positives(block: _Block, anchors: pa.Table, q: np.ndarray, k: int) -> list[tuple]:
    out = []
    for a, (rid, vid, label) in enumerate(zip(*(anchors[c].to_numpy() for c in ("rid", "vec_id", "label")), strict=True)):
        own = np.flatnonzero((block.label == label) & (block.rid != rid))
        low, high = (b[own] for b in block.bounds(q[a]))
        at = own[high >= _largest(low, k)]  # k rows at least score that much
        score = block.exact(q[a], at)
        out += [(rid, vid, block.rid[i], block.ids[i], s, 0, 0) for i, s in ((at[j], score[j]) for j in _first(score, block.ids[at], k))]
    return out


def _negatives(block: _Block, anchors: pa.Table, q: np.ndarray, k: int, low_pct: int, high_pct: int) -> list[tuple]:
    out = []
    cols = (*(anchors[c].to_numpy() for c in ("rid", "vec_id", "label")), anchors["wanted"].to_pylist())
    for a, (rid, vid, label, wanted) in enumerate(zip(*cols, strict=True)):
        other = np.flatnonzero(block.label != label)
        low, high = (b[other] for b in block.bounds(q[a]))
        for w in wanted:
            floor, top = low_pct * w["score"], high_pct * w["score"]
            sure = low[(100 * low >= floor) & (100 * high <= top)]  # inside the window whatever the residual
            at = other[(100 * high >= floor) & (100 * low <= top) & (high >= _largest(sure, k))]
            score = block.exact(q[a], at)
            fits = (100 * score >= floor) & (100 * score <= top)
            at, score = at[fits], score[fits]
            out += [(rid, vid, block.rid[i], block.ids[i], s, w["rid"], w["place"]) for i, s in ((at[j], score[j]) for j in _first(score, block.ids[at], k))]
    return out


FOUND = "anchor_rid long, anchor_id long, rid long, vec_id long, score long, positive_rid long, place long"


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, find) -> DataFrame:
    """Every block of rows against every block of anchors; ``find(block, anchors)`` gives rows of ``FOUND``."""
    gs, bs = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    left = rows.withColumn("_g", F.pmod(F.xxhash64("rid"), F.lit(gs))).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bs - 1).cast("long"))))
    right = anchors.withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(bs))).withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gs - 1).cast("long"))))
    # Both sides come from one table, so one takes other column names.
    right = right.select("_g", "_b", *[F.col(c).alias(f"of_{c}") for c in anchors.columns])
    types = pa.schema([(f.split()[0], pa.int64()) for f in FOUND.split(", ")])

    def run(own, asked):
        asked = asked.rename_columns([c.removeprefix("of_") for c in asked.column_names])
        got = find(own, asked) if len(own) and len(asked) else []
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*got, strict=True) if got else [[]] * len(types))], schema=types)

    return left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInArrow(run, FOUND)


def mine(rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, low_pct: int = 80, high_pct: int = 100, relabel=None, max_train: int = MAX_TRAIN, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are rows whose id is divisible by ``every``; positives are an anchor's first other rows of its label, negatives for each
    the first rows of other labels whose score lies within ``low_pct`` to ``high_pct`` per cent of the
    positive's.  Higher scores come first, then smaller ids, then the row met first.  Rows with a null label or
    vector, or a null or non-finite component, take no part; a null id is no anchor
    and comes after all others of its score.  Shorter vectors count as padded with zeros.  Repeated rows are rows of
    their own, so a copy of the anchor can be its positive.  ``relabel(vec_id, label)`` may give other labels.  No anchors
    or no rows give an empty result; other columns are not read.  Components of 2**25 and more after scaling raise an error.
    """
    spark = rows.sparkSession
    base = eligible(rows, id_col, vec_col, label_col)
    if relabel is not None:
        base = base.withColumn("label", relabel(F.col("vec_id"), F.col("label")).cast("long"))
    n, width, n_anchors = base.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not n or not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(SLICE, width + -width % SLICE)
    sample = base.orderBy(F.xxhash64("rid"), "rid").limit(max_train).select("x").toArrow()
    centroids = train(matrix(sample["x"], width))
    # A null id sorts after every other.
    coded = save(encode(base.withColumn("vec_id", F.coalesce("vec_id", F.lit((1 << 63) - 1))), centroids), "coded")
    anchors = coded.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != (1 << 63) - 1)).select("rid", "vec_id", "label", "x")

    def find_positives(own, asked):
        return _positives(_Block(own, centroids), asked, matrix(asked["x"], width), n_positives)

    def find_negatives(own, asked):
        return _negatives(_Block(own, centroids), asked, matrix(asked["x"], width), n_negatives, low_pct, high_pct)

    by_rank = [F.col("score").desc(), F.col("vec_id").asc(), F.col("rid").asc()]
    found = _blocks(coded, anchors, n, n_anchors, find_positives)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor_rid").orderBy(*by_rank)).cast("long")).where(F.col("place") <= n_positives)
    positives = save(found.select("anchor_rid", "place", F.col("rid").alias("positive_rid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = positives.groupBy("anchor_rid").agg(F.collect_list(F.struct(F.col("positive_rid").alias("rid"), F.col("positive_score").alias("score"), "place")).alias("wanted"))
    asking = save(anchors.join(wanted, F.col("rid") == F.col("anchor_rid")).drop("anchor_rid"), "asking")
    found = _blocks(coded, asking, n, n_anchors, find_negatives)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_rid", "place").orderBy(*by_rank))).where(F.col("rank") <= n_negatives)
    named = found.drop("positive_rid").join(positives, ["anchor_rid", "place"])
    real = lambda c: F.nullif(F.col(c), F.lit((1 << 63) - 1)).alias(c if c != "vec_id" else "negative_id")
    return named.select("anchor_id", real("positive_id"), "rank", real("vec_id"), "positive_score", F.col("score").alias("negative_score"))


def report(rows: DataFrame) -> DataFrame:
    """:func:`mine` with ids divisible by seven moved to the next of ten labels.  Nulls, ties, repeats and empty tables as there."""
    return mine(rows, relabel=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))
