"""The best page by relevance without scoring every match: postings in blocks with bounds.

A row of ``blocks`` is one token in one block of messages: ``docs`` of them hold it, at
most ``tf`` times each, and the shortest has ``least`` tokens.  These three are all that a
block's bound needs; the lists ``ids``, ``ns`` and ``positions`` beside them are matched and scored only for
blocks that can still reach the page.  Messages of like length share a block, so ``least`` is near each one's own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.tokens import token_class
from . import search
from .search import PAGE, Phrase

BLOCK_DOCS, BLOCK_TOKENS = 128, 1 << 20
BLOCK = "token string, block bigint, docs int, tf int, least int, ids array<bigint>, ns array<int>, positions array<array<int>>"
#: The first round reads the blocks of the best 4^-STEPS of all bounds; each round after it four times as many.
STEPS = 6
#: A bound and a score add the same terms in doubles, but of other figures; so much of a bound, at most, is rounding.
SLACK = 1e-9
#: So many blocks at most are named in a filter of the scan.
PUSHED = 256


class Ranked(NamedTuple):
    blocks: DataFrame
    corpus: DataFrame


def fold_blocks(texts: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of ``blocks``, put together inside the tasks; a block has at most ``block_docs`` messages and, but for a longer one, ``BLOCK_TOKENS`` tokens."""
    arrow = pa.schema([("token", pa.string()), ("block", pa.int64()), ("docs", pa.int32()), ("tf", pa.int32()), ("least", pa.int32()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int32())), ("positions", pa.list_(pa.list_(pa.int32())))])

    def fold(ids: pa.Array, text: pa.ListArray, block: np.ndarray) -> pa.RecordBatch:
        p = search.sorted_postings(search.lists(np.arange(len(text)), text))
        n = pc.list_value_length(text).to_numpy(zero_copy_only=False).astype(np.int32)[p.row]
        starts = np.flatnonzero(np.concatenate([[True], (p.rank[1:] != p.rank[:-1]) | (block[p.row[1:]] != block[p.row[:-1]])]))
        docs = np.diff(np.append(starts, len(n))).astype(np.int32)
        tf = np.maximum.reduceat(pc.list_value_length(p.positions).to_numpy(zero_copy_only=False).astype(np.int32), starts)
        first = pa.array(starts)
        own = [search.lists(starts, c) for c in (ids.take(pa.array(p.row)), pa.array(n), p.positions)]
        return pa.RecordBatch.from_arrays([p.token.take(first), pa.array(block[p.row[starts]]), pa.array(docs), pa.array(tf), pa.array(np.minimum.reduceat(n, starts)), *own], schema=arrow)

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, docs, size = TaskContext.get().partitionId() << 32, 0, 0
        # Messages since the last block that was given on; several whole blocks are put in order at once.
        ids, held_texts, blocks, held = [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield fold(pa.concat_arrays(ids), pa.concat_arrays(held_texts), np.concatenate(blocks))
            ids.clear(), held_texts.clear(), blocks.clear()

        for own_ids, words in batches:
            text = words.flatten()
            lo, own = 0, np.empty(len(own_ids), np.int64)
            for i, n in enumerate(pc.list_value_length(text).to_pylist()):
                if docs and (docs == block_docs or size + n > BLOCK_TOKENS):
                    at, docs, size = at + 1, 0, 0
                    if held >= search.FOLD_TOKENS:
                        ids.append(own_ids[lo:i]), held_texts.append(text[lo:i]), blocks.append(own[lo:i])
                        yield from close()
                        lo, held = i, 0
                own[i], docs, size, held = at, docs + 1, size + n, held + n
            ids.append(own_ids[lo:]), held_texts.append(text[lo:]), blocks.append(own[lo:])
        yield from close()

    return search.in_tasks(texts.sortWithinPartitions(F.length(F.col("texts")[0]), "id"), ["id"], run, BLOCK)


def build(messages: DataFrame, id_col: str = "id", text: Column | None = None, block_docs: int = BLOCK_DOCS) -> Ranked:
    """The index of all messages whose text is not blank; an id stands for one message, a null id is none."""
    texts = storage.save(search.texts_of(messages, id_col, [F.col("text") if text is None else text]), "texts")
    return Ranked(fold_blocks(texts, block_docs), search.figures(texts))


def stored(spark: SparkSession, name: str, state: str, messages: DataFrame, id_col: str = "id", text: Column | None = None, block_docs: int = BLOCK_DOCS) -> Ranked:
    """The index of messages in this state from storage, written there first if need be, each file in order of token and block."""
    kind = hashlib.sha256(f"{id_col}|{text}|{token_class()}|{block_docs}".encode()).hexdigest()[:12]

    def tables() -> dict[str, DataFrame]:
        new = build(messages, id_col, text, block_docs)
        return {"blocks": new.blocks.sortWithinPartitions("token", "block"), "corpus": new.corpus.coalesce(1)}

    return Ranked(**storage.kept(spark, f"ranked-{name}", f"{state}-{kind}", tables))


def postings(blocks: DataFrame) -> DataFrame:
    """The lists of blocks as :class:`search.Index` has them, one row a token and message."""
    return search.one_by_one(blocks)


def frequencies(ranked: Ranked, phrases: list[Phrase]) -> list[int]:
    """How many messages hold each phrase.

    A word is counted by its blocks' ``docs``; words with one beginning by their distinct ids; only phrases of several words read positions.
    """
    parts = []
    for k, p in enumerate(phrases):
        if len(p.words) > 1:
            one = search.side_by_side(postings(ranked.blocks), [p]).agg(F.count("tf0").alias("df"))
        elif p.prefix:
            one = ranked.blocks.where(search.wanted([p])).select(F.explode("ids").alias("id")).distinct().agg(F.count("*").alias("df"))
        else:
            one = ranked.blocks.where(search.wanted([p])).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("df"))
        parts.append(one.select(F.lit(k).alias("k"), "df"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return [r["df"] for r in sorted(out.collect())]  # one row a phrase of the query


def bounds(ranked: Ranked, phrases: list[Phrase], df: list[int], total: int, avg_len: float) -> DataFrame:
    """``(block, bound)`` of the blocks where every phrase has its words; no message there weighs more than ``bound``.

    A phrase stands no more often than its rarest word, and a message with all of them is no shorter than the longest of their shortest.
    """
    slot = F.array_compact(F.array(*[F.when(search.fits(p, i), F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("offset"), F.lit(len(p.words)).alias("size"))) for k, p in enumerate(phrases) for i in range(len(p.words))]))
    slots = ranked.blocks.where(search.wanted(phrases)).select("block", "tf", "least", F.explode(slot).alias("s")).select("block", "tf", "least", "s.*")
    # Words with one beginning can all stand in one message.
    by_word = slots.groupBy("block", "phrase", "size", "offset").agg(F.sum("tf").alias("tf"), F.min("least").alias("least"))
    by_phrase = by_word.groupBy("block", "phrase", "size").agg(F.count("*").alias("words"), F.min("tf").alias("tf"), F.max("least").alias("least")).where("words = size")
    by_block = by_phrase.groupBy("block").agg(F.count("*").alias("phrases"), F.max("least").alias("least"), *[F.max(F.when(F.col("phrase") == k, F.col("tf"))).alias(f"tf{k}") for k in range(len(phrases))])
    return by_block.where(F.col("phrases") == len(phrases)).select("block", (_score(df, total, avg_len, "least") * (1 + SLACK)).alias("bound"))


def _score(df: list[int], total: int, avg_len: float, length: str) -> Column:
    parts = [search.weigh(F.lit(total), F.lit(d), F.col(f"tf{k}"), F.col(length), F.lit(avg_len)) for k, d in enumerate(df)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def cuts(held: DataFrame, least_blocks: int) -> list[float]:
    """Falling bounds at which rounds end, the first with about ``least_blocks`` blocks or more; where they lie decides what is read, not what is found."""
    shares = [1 - 0.25**i for i in range(STEPS, 0, -1)]
    n, at = held.agg(F.count("*"), F.percentile_approx("bound", F.array(*[F.lit(s) for s in shares]), 10_000)).first()
    falling = [b for s, b in zip(shares, at or [], strict=False) if n * (1 - s) >= least_blocks]
    return sorted(set(falling), reverse=True)


def _lists(wanted: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """Rows of the chosen blocks.  A few are named to the scan, whose page index passes over the others; many are met in a join, which drops rows after they are read."""
    if n <= PUSHED:
        return wanted.where(F.col("block").isin([r["block"] for r in chosen.select("block").collect()]))
    return wanted.join(chosen.select("block"), "block", "left_semi")


class Page(NamedTuple):
    rows: DataFrame
    #: Blocks in which every phrase has its words, and how many of them had their lists read.
    matching: int
    read: int


def top(corpus: DataFrame, ranked: Ranked, supported: DataFrame, text: str, limit: int = PAGE, cursor: tuple | None = None, **only) -> Page:
    """One page by relevance, the same rows as :func:`search.search` gives.

    Blocks are read in rounds of falling bounds, at most ``STEPS`` and one.  Once the last of a page and one more is
    better than the next round's end, that round ends there, equal bounds included, and no other block is matched or scored.
    Filters and the cursor hold before rows count, so a narrow filter costs rounds, not results.
    A query without tokens or without matches gives an empty page.
    """
    spark, phrases = corpus.sparkSession, search.parse_query(text)
    empty = search.paged(corpus.limit(0).withColumn("score", F.lit(0.0)), [F.col("score").asc(), F.col("id").desc()], limit)
    if not phrases:
        return Page(empty, 0, 0)
    total, avg_len = ranked.corpus.select("total", "avg_len").first()
    df = frequencies(ranked, phrases) if total else [0]
    if not all(df):
        return Page(empty, 0, 0)
    held = storage.save(bounds(ranked, phrases, df, total, avg_len), "bounds")
    order = [F.col("score").asc(), F.col("id").desc()]
    found: DataFrame | None = None
    above, read, safe = float("inf"), 0, False
    ends = [*cuts(held, -(-4 * (limit + 1) // BLOCK_DOCS)), float("-inf")]
    while not safe and ends:
        end = ends.pop(0)
        if found is not None:
            kth = found.orderBy(*order).limit(limit + 1).agg(F.count("*"), F.max("score")).first()
            if kth[0] > limit and -kth[1] >= end:
                end, safe = -kth[1], True
        if end >= above:
            break
        chosen = held.where((F.col("bound") < above) & (F.col("bound") >= end))
        n = chosen.count()
        if n:
            lists = _lists(ranked.blocks.where(search.wanted(phrases)), chosen, n)
            wide = search.side_by_side(postings(lists), phrases)
            hits = wide.select("id", (-_score(df, total, avg_len, "n")).alias("score")).where("score is not null")
            rows = search.filters(corpus, supported, **only).join(hits, "id")
            rows = storage.save(search.after_relevance(rows, *cursor) if cursor else rows, "round")
            found = rows if found is None else found.unionByName(rows)
        above, read = end, read + n
    return Page(empty if found is None else search.paged(found, order, limit), held.count(), read)
