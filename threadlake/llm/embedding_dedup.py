"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are turned onto their principal axes and put on a grid of cell
width epsilon, the distance that belongs to the least cosine.  Vectors sorted by
their cells are one sequence, cut into blocks and, above them, into intervals of
sixteen of the intervals below; from one root for each label, pairs of
intervals are joined recursively, and a pair whose bounding boxes lie farther
apart than epsilon is skipped with all below it.  Equal vectors are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, numbered, record, save, stage

LEAST_COSINE = 0.93
#: Leading axes in the grid; vectors in a block, the lowest interval; intervals in the one above, as a power of two.
AXES, BLOCK, FAN_OUT_BITS = 4, 256, 4
#: Inside a block pair, intervals are halved down to this.
LEAF = 64


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _axes(nodes: DataFrame) -> np.ndarray | None:
    """Principal axes of the commonest vector length, from second moments summed over all vectors; at most length^2 numbers reach the driver."""
    top = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if top is None:
        return None
    dim = top["dim"]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, s, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if len(b):
                x = _unit(np.stack(b["v"].to_numpy()).astype(float))
                total, s, n = total + x.T @ x, s + x.sum(axis=0), n + len(x)
        yield pd.DataFrame({"i": range(dim + 2), "row": [*total, s, np.full(dim, float(n))]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b["i"], b["row"], strict=True):
                sums[i] = sums.get(i, 0.0) + row
        if sums:
            yield pd.DataFrame({"i": list(sums), "row": list(sums.values())})

    schema = "i int, row array<double>"
    sums = nodes.where(F.col("dim") == dim).select("v").mapInPandas(moments, schema).repartition("i").mapInPandas(add, schema)
    m = np.zeros((dim + 2, dim))
    for r in sums.collect():
        m[r["i"]] = r["row"]
    n = m[dim + 1, 0]
    cov = m[:dim] / n - np.outer(m[dim], m[dim]) / n**2
    return np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1][:, :AXES]


def _project(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the grid's axes; vectors of another length use their own first coordinates.  Either is a projection, so it never lengthens a distance."""
    p = x @ axes if x.shape[1] == len(axes) else x[:, :AXES]
    return np.pad(p, ((0, 0), (0, AXES - p.shape[1])))


def _gap(lo_a, hi_a, lo_b, hi_b):
    d = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return np.sqrt((d * d).sum(axis=-1))


def _interval_pairs(pa: np.ndarray, pb: np.ndarray, eps: float):
    """Pairs of runs of two blocks' sequences that may hold near vectors: halved until short, skipped once their boxes are too far apart."""
    todo = [(0, len(pa), 0, len(pb))]
    while todo:
        i, j, k, m = todo.pop()
        if _gap(pa[i:j].min(0), pa[i:j].max(0), pb[k:m].min(0), pb[k:m].max(0)) > eps:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            yield i, j, k, m
        elif j - i >= m - k:
            todo += [(i, (i + j) // 2, k, m), ((i + j) // 2, j, k, m)]
        else:
            todo += [(i, j, k, (k + m) // 2), (i, j, (k + m) // 2, m)]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of links that join parts of ``n`` nodes not joined yet."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(k)
    return kept


def _join_blocks(axes: np.ndarray, least: float, eps: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                ids_a, ids_b = np.asarray(r.ids_a), np.asarray(r.ids_b)
                raw_a, raw_b = (np.frombuffer(v, np.float64).reshape(len(i), -1) for v, i in ((r.data_a, ids_a), (r.data_b, ids_b)))
                a, b = _unit(raw_a), _unit(raw_b)
                same = r.block_a == r.block_b
                found = []
                for i, j, k, m in _interval_pairs(_project(a, axes), _project(b, axes), eps):
                    x, y = np.nonzero(a[i:j] @ b[k:m].T >= least)
                    found.append((x + i, y + k))
                if not found:
                    continue
                x, y = (np.concatenate(s) for s in zip(*found, strict=True))
                if same:
                    x, y = x[x < y], y[x < y]
                if not len(x):
                    continue
                # Links counted with copies; a spanning forest says what is joined, so no row is written for each link.
                n_a = np.bincount(x, np.asarray(r.copies_b)[y], len(ids_a))
                n_b = np.bincount(y, np.asarray(r.copies_a)[x], len(ids_b))
                out += [(i, None, int(n)) for i, n in zip(ids_a.tolist(), n_a, strict=True) if n]
                out += [(i, None, int(n)) for i, n in zip(ids_b.tolist(), n_b, strict=True) if n]
                shift = 0 if same else len(ids_a)
                for k in _forest(shift + len(ids_b), x, y + shift):
                    out.append((int(ids_a[x[k]]), int(ids_b[y[k]]), 0))
            yield pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    return run


def _blocks(nodes: DataFrame, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """Packed blocks in grid order, one row each with its bounding box."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            where = np.zeros((len(b), AXES), np.int32)
            for dim in b["dim"].unique():
                own = (b["dim"] == dim).to_numpy()
                where[own] = np.floor(_project(_unit(np.stack(b["v"][own].to_numpy()).astype(float)), axes) / eps)
            for k in range(AXES):
                b[f"c{k}"] = where[:, k]
            yield b

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, piece, count = None, 0, 0

        def out(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal count
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            p = _project(_unit(x), axes)
            count += 1
            return pd.DataFrame([(part["label"].iloc[0], part["dim"].iloc[0], piece << 32 | count, part["rid"].tolist(), part["copies"].tolist(), x.tobytes(), p.min(0).tolist(), p.max(0).tolist())], columns=["label", "dim", "block", "ids", "copies", "data", "lo", "hi"])

        for b in batches:
            piece = int(b["piece"].iloc[0]) if len(b) else piece
            held = b if held is None else pd.concat([held, b])
            groups = [g for _, g in held.groupby(["label", "dim"], sort=False)]
            for k, g in enumerate(groups):
                end = len(g) if k < len(groups) - 1 else len(g) // block * block  # the last run may go on
                for i in range(0, end, block):
                    yield out(g.iloc[i : min(end, i + block)])
            held = groups[-1].iloc[len(groups[-1]) // block * block :] if groups else held
        if held is not None and len(held):
            yield out(held)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    order = ["label", "dim", *[f"c{k}" for k in range(AXES)], "rid"]
    grid = nodes.mapInPandas(cells, schema + "".join(f", c{k} int" for k in range(AXES)))
    ordered = grid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id())
    label = nodes.schema["label"].dataType.simpleString()
    return ordered.mapInPandas(pack, f"label {label}, dim int, block bigint, ids array<bigint>, copies array<bigint>, data binary, lo array<double>, hi array<double>")


def _boxes(blocks: DataFrame, level) -> DataFrame:
    lows, highs = [F.min(F.col("lo")[k]) for k in range(AXES)], [F.max(F.col("hi")[k]) for k in range(AXES)]
    return blocks.groupBy("label", "dim", level.alias("node")).agg(F.array(*lows).alias("lo"), F.array(*highs).alias("hi"))


def _near(a: str, b: str, eps: float):
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}.lo")[k] - F.col(f"{b}.hi")[k], F.col(f"{b}.lo")[k] - F.col(f"{a}.hi")[k]) for k in range(AXES)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= eps * eps


def _block_pairs(blocks: DataFrame, eps: float, bits: int) -> DataFrame:
    """Pairs of blocks left after the descent from each label's root: a pair of intervals brings up those below it only if its own boxes are near."""
    meta = save(numbered(blocks.select("label", "dim", "block", "lo", "hi"), "label", "dim", "block"), "boxes")
    depth, count = 1, meta.count()
    while count > 1 << bits * depth:
        depth += 1
    # At the root all of a label's blocks are one node, near itself.
    pairs = meta.select("label", "dim", F.lit(0).cast("bigint").alias("na"), F.lit(0).cast("bigint").alias("nb")).distinct()
    for height in reversed(range(depth)):
        nodes = _boxes(meta, F.shiftright("place", bits * height)).withColumn("up", F.shiftright("node", bits))
        a, b = nodes.alias("a"), nodes.alias("b")
        joined = pairs.alias("p").join(a, (F.col("p.label") == F.col("a.label")) & (F.col("p.dim") == F.col("a.dim")) & (F.col("p.na") == F.col("a.up")))
        joined = joined.join(b, (F.col("p.label") == F.col("b.label")) & (F.col("p.dim") == F.col("b.dim")) & (F.col("p.nb") == F.col("b.up")) & (F.col("a.node") <= F.col("b.node")))
        pairs = joined.where(_near("a", "b", eps)).select(F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), F.col("a.node").alias("na"), F.col("b.node").alias("nb"))
    name = lambda s: meta.select(F.col("place").alias(f"n{s}"), F.col("block").alias(f"block_{s}"))
    return pairs.select("na", "nb").join(name("a"), "na").join(name("b"), "nb").select("block_a", "block_b")


def near_groups(vectors: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, fan_out_bits: int = FAN_OUT_BITS) -> DataFrame:
    """``rec`` (the whole row), ``n_links``, ``component_id``, ``kept`` for every row.

    Vectors are linked when their labels are equal and not null, their lengths
    are equal, and their cosine in double precision is at least ``least``.  A
    vector that is null, empty, zero, or holds a null or a number that is not finite links with nothing.
    ``n_links`` counts all other rows linked, repeated ones too; ``component_id``
    is the smallest id reachable, null ids last; one row of a component is kept, that with
    the smallest id.  Extra columns travel in ``rec``; an empty table gives an empty result.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    big = F.array_max(F.transform(v, F.abs))
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0) & (big > 0), F.lit(False)) & F.col(f"`{label_col}`").isNotNull()
    # Scaling by the largest number keeps squares from running over or under; the cosine stays.
    scaled = F.when((big > 1e100) | (big < 1e-100), F.transform(v, lambda x: x / big)).otherwise(v)
    staged = stage(vectors, "vectors", rec=record(vectors), label=F.col(f"`{label_col}`"), v=F.when(good, F.transform(scaled, lambda x: x + 0.0)))
    twins = staged.where("v is not null").groupBy("label", "v").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    nodes = save(twins.select(F.col("rep").alias("rid"), "label", F.size("v").alias("dim"), "v", "copies"), "nodes")
    member = staged.join(twins.select("label", "v", "rep", "copies"), ["label", "v"], "left").select("rid", "rec", F.coalesce("rep", "rid").alias("node"), F.coalesce("copies", F.lit(1)).alias("copies"))
    member = save(member, "members")
    axes, eps = _axes(nodes), float(np.sqrt(2 - 2 * least)) * (1 + 1e-9)
    if axes is None:
        links = staged.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    else:
        blocks = save(_blocks(nodes, axes, eps, block), "blocks")
        side = lambda s: blocks.select(F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("copies").alias(f"copies_{s}"), F.col("data").alias(f"data_{s}"))
        work = _block_pairs(blocks, eps, fan_out_bits).join(side("b"), "block_b").join(side("a"), "block_a")
        links = save(work.mapInPandas(_join_blocks(axes, least, eps), "a bigint, b bigint, n bigint"), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    edges = links.where("b is not null").select("a", "b")
    comp = components(edges) if not edges.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    ident = F.col(f"rec.`{id_col}`")
    full = member.join(counts, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    full = save(full.select("rid", "rec", "comp", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "full")
    heads = full.select("comp", ident.alias("id"), "rid").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"))
    return full.join(heads, "comp").select("rec", "n_links", F.col("first.id").alias("component_id"), (F.col("first.rid") == F.col("rid")).alias("kept"))


def report(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """One row per vector: id, links, component and whether it stays; other cases as in :func:`near_groups`."""
    return near_groups(vectors, id_col=id_col, **options).select(F.col(f"rec.`{id_col}`").alias("vec_id"), "n_links", "component_id", "kept")
