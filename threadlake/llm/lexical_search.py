"""Ranked lexical search by variable-block-max WAND.

Documents are indexed in shards, each task's own, so texts never move.  A term's postings in a shard are cut
into blocks whose boundaries dynamic programming chooses: the sum, over
postings, of the block's largest impact less the posting's own, plus a price a block, is least.
A query lays its terms' blocks over the shard's documents; where the blocks' largest
scores cannot add up to the page's last score so far, documents are skipped
unread.  All scores and bounds are integers, so the page is exact.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ascii_lower, save

#: A shard ends at either bound; a longer document is a shard of its own.
SHARD_DOCS, SHARD_BYTES = 16384, 32 << 20
#: Longest block, and what a block costs in units of impact (of at most 1,000,000).
MOST_IN_BLOCK, BLOCK_PRICE = 64, 200_000
#: Items searched in one go; a shard's lists are read once for each such block.
QUERY_BLOCK = 256
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of no word become blanks, A-Z small letters.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

POSTINGS = "shard long, term string, docs array<int>, tfs array<int>, lens array<int>, ids array<long>"
BLOCKS = "shard long, term string, docs array<int>, impacts array<int>, ends array<int>, tops array<int>, ids array<long>"


def _lists(values, offsets, kind):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _shard_rows(shard: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    """A shard's posting lists, and first a row for the empty term: its documents with their lengths and ids.

    Documents are numbered in order of their ids, null last, so ties are broken by number.
    """
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    code: dict[bytes, int] = {}
    terms, tfs, docs, sizes = [], [], [], []
    for d, i in enumerate(order):
        words = texts[i].translate(TABLE).split()
        held = Counter(words)
        terms.append(np.fromiter((code.setdefault(w, len(code)) for w in held), np.int32, len(held)))
        tfs.append(np.fromiter(held.values(), np.int32, len(held)))
        docs.append(np.full(len(held), d, np.int32))
        sizes.append(len(words))
    term, tf, doc, size = np.concatenate(terms), np.concatenate(tfs), np.concatenate(docs), np.array(sizes, np.int32)
    by = np.argsort(term, kind="stable")
    ends = np.concatenate([[len(size)], np.bincount(term, minlength=len(code)).cumsum() + len(size)])
    offsets = np.concatenate([[0], ends])
    n = len(code) + 1
    columns = [
        pa.array(np.full(n, shard)), pa.array([b"", *code], pa.binary()).cast(pa.string()),
        _lists(np.concatenate([np.arange(len(size), dtype=np.int32), doc[by]]), offsets, pa.int32()), _lists(np.concatenate([np.zeros(len(size), np.int32), tf[by]]), offsets, pa.int32()),
        _lists(np.concatenate([size, size[doc[by]]]), offsets, pa.int32()), _lists([ids[i] for i in order], np.concatenate([[0], np.full(n, len(ids))]), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in POSTINGS.split(", ")])


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored posting lists by shard and term."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if len(ids) == SHARD_DOCS or size >= SHARD_BYTES:
                    yield from _sliced(_shard_rows((part << 31) + k, ids, texts))
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield from _sliced(_shard_rows((part << 31) + k, ids, texts))

    return save(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, POSTINGS), "postings")


def _sliced(batch: pa.RecordBatch, rows: int = 4096):
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def impact(tf, m):
    """A posting's score before its term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def cut(impacts: np.ndarray, offsets: np.ndarray, price: int = BLOCK_PRICE) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of all lists of a CSR array: (ends in the array, list number of each block), by dynamic programming.

    The least of ``sum(block's largest - own) + price * blocks`` over all cuts into blocks of at most ``MOST_IN_BLOCK``.
    All lists go side by side: step ``j`` settles the best cut of the first ``j`` postings of every list that has as many.
    """
    sizes = np.diff(offsets)
    lists = np.argsort(-sizes, kind="stable")
    lists = lists[sizes[lists] > 0]
    begin, longest = offsets[:-1][lists], int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[lists], -np.arange(1, longest + 1), side="right")
    back = np.zeros(len(impacts), np.int16)  # the length of the last block of the best cut that ends at a posting
    w = np.arange(1, MOST_IN_BLOCK + 1)
    best = np.full((len(lists), MOST_IN_BLOCK), np.inf)  # of the first j-1, j-2, ... postings
    best[:, 0] = 0
    top = np.zeros((len(lists), MOST_IN_BLOCK))
    for j, k in enumerate(alive):
        best, top = best[:k], top[:k]
        at = begin[:k] + j
        top[:, 1:] = top[:, :-1]
        top[:, 0] = 0
        np.maximum(top, impacts[at][:, None], out=top)
        cost = best + w * top
        choice = cost.argmin(1)
        back[at] = choice + 1
        best[:, 1:] = best[:, :-1]
        best[:, 0] = cost[np.arange(k), choice] + price
    ends, owner = [], []
    at, own = offsets[1:][lists], lists
    while len(at):
        ends.append(at)
        owner.append(own)
        at = at - back[at - 1]
        more = at > offsets[own]
        at, own = at[more], own[more]
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, owner = np.concatenate(ends), np.concatenate(owner)
    by = np.argsort(ends)
    return ends[by], owner[by]


class Index:
    """``blocks`` (a row a shard and term), and the corpus figures N and L."""

    def __init__(self, blocks: DataFrame, n: int, length: int):
        self.blocks, self.n, self.length = blocks, n, length


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The stored index of all documents."""
    lists = postings(docs, id_col, text_col)
    heads = lists.where("term = ''")
    n, length = heads.agg(F.coalesce(F.sum(F.size(F.filter("lens", lambda x: x > 0))), F.lit(0)), F.coalesce(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()

    def run(batches):
        for b in batches:
            docs_, tfs, lens, head = b.column("docs"), b.column("tfs"), b.column("lens"), np.array(b.column("term").to_pylist(), object) == ""
            offsets = docs_.offsets.to_numpy().astype(np.int64) - docs_.offsets[0].as_py()
            tf, size = tfs.flatten().to_numpy().astype(np.int64), lens.flatten().to_numpy().astype(np.int64)
            own = impact(tf, 50 + (50 * size * n) // max(1, length))
            counts = np.where(head, 0, np.diff(offsets))
            keep = np.repeat(~head, np.diff(offsets))
            starts = np.concatenate([[0], counts.cumsum()])
            own = own[keep]
            ends, owner = cut(own, starts)
            firsts = np.concatenate([[0], ends[:-1]])
            tops = np.maximum.reduceat(own, firsts) if len(ends) else own
            at = np.concatenate([[0], np.bincount(owner, minlength=len(counts)).cumsum()])
            yield pa.RecordBatch.from_arrays(
                [b.column("shard"), b.column("term"), _lists(docs_.flatten().to_numpy()[keep], starts, pa.int32()), _lists(own.astype(np.int32), starts, pa.int32()),
                 _lists((ends - starts[owner]).astype(np.int32), at, pa.int32()), _lists(tops.astype(np.int32), at, pa.int32()), b.column("ids")],
                names=[f.split()[0] for f in BLOCKS.split(", ")],
            )

    return Index(save(lists.mapInArrow(run, BLOCKS), "blocks"), n, length)


class _Shard:
    """The lists of one shard that a block of queries asks for."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        cols = {c: t[c].combine_chunks() for c in ("docs", "impacts", "ends", "tops")}
        self.docs, self.impacts, self.tops = (cols[c].flatten().to_numpy() for c in ("docs", "impacts", "tops"))
        offsets = lambda c: c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py()
        start, self.block = offsets(cols["docs"]), offsets(cols["ends"])
        ends = cols["ends"].flatten().to_numpy().astype(np.int64) + np.repeat(start[:-1], np.diff(self.block))
        self.ends, self.begins = ends, np.concatenate([[0], ends[:-1]]).astype(np.int64)
        # A block covers the documents from its first to its last.
        self.low, self.high = self.docs[self.begins].astype(np.int64), self.docs[ends - 1].astype(np.int64) + 1

    def search(self, rows: np.ndarray, weights: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """First ``k`` documents of the lists at ``rows`` with their scores, and how many postings were read."""
        count = self.block[rows + 1] - self.block[rows]
        b = np.repeat(self.block[rows] - np.concatenate([[0], count.cumsum()[:-1]]), count) + np.arange(count.sum())
        weight = np.repeat(weights, count)
        low, high, bound = self.low[b], self.high[b], weight * self.tops[b]
        change = np.zeros(n_docs + 1, np.int64)
        np.add.at(change, low, bound)
        np.add.at(change, high, -bound)
        bound = change.cumsum()[:n_docs]  # of each document
        score, seen, read = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), 0
        last = 1  # the least score a document needs
        first = np.argpartition(-bound, min(2 * k, n_docs) - 1)[: 2 * k]
        for round_ in range(2):
            todo = bound >= last
            if round_ == 0:  # documents of the largest bounds give the page's last score a floor
                todo &= bound >= bound[first].min()
            todo &= ~seen
            if not todo.any():
                continue
            passed = np.concatenate([[0], todo.cumsum()])
            use = passed[high] > passed[low]  # blocks without such a document stay unread
            size = self.ends[b[use]] - self.begins[b[use]]
            at = np.repeat(self.begins[b[use]] - np.concatenate([[0], size.cumsum()[:-1]]), size) + np.arange(size.sum())
            read += len(at)
            gain, docs = np.repeat(weight[use], size) * self.impacts[at], self.docs[at]
            own = todo[docs]
            np.add.at(score, docs[own], gain[own])
            seen |= todo
            if n_docs >= k:
                last = max(1, int(np.partition(score, n_docs - k)[n_docs - k]))
        page = np.flatnonzero(score >= last)
        page = page[np.lexsort((page, -score[page]))[:k]]
        return page, score[page], read


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)))


def search(index: Index, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` highest-scoring documents with a score above 0, equal scores by ascending doc_id.

    Terms are counted once an item and compared after lower-casing A-Z.  An item without terms, or with none that any document holds, has no rows;
    items with equal ids or null ids are searched each on its own and keep their id.  A null id of a document comes after all others of its score;
    repeated documents are documents of their own.
    """
    spark = items.sparkSession
    found_columns = "item_rid long, doc_id long, place int, score long, shard long, read long"
    asked = items.select(F.monotonically_increasing_id().alias("item_rid"), F.col(f"`{item_col}`").alias("item_id"), terms_of(F.col(f"`{text_col}`")).alias("terms"))
    asked = save(asked, "asked")
    n_items = asked.count()
    n_blocks = max(1, -(-n_items // QUERY_BLOCK))
    pairs = asked.select("item_rid", F.pmod(F.xxhash64("item_rid"), F.lit(n_blocks)).alias("block"), F.explode("terms").alias("term"))
    df = index.blocks.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(index.n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    wanted = pairs.join(df, "term").groupBy("block", "term").agg(F.collect_list(F.struct("item_rid", w.alias("weight"))).alias("asking"))  # QUERY_BLOCK items at most
    # The empty term brings each block of queries a shard's documents.
    heads = spark.range(n_blocks).select(F.col("id").alias("block"), F.lit("").alias("term"), F.array().cast("array<struct<item_rid:bigint,weight:bigint>>").alias("asking"))
    wanted = save(wanted.unionByName(heads), "wanted")
    met = index.blocks.join(wanted, "term")

    def run(key, t):
        terms = t["term"].to_pylist()
        ids = t["ids"][terms.index("")].values
        t = t.filter(pa.array([x != "" for x in terms]))
        shard, asking = _Shard(t), {}
        for row, of in enumerate(t["asking"].to_pylist()):
            for a in of:
                asking.setdefault(a["item_rid"], []).append((row, a["weight"]))
        out = []
        for item, of in asking.items():
            rows, weights = (np.array(x, np.int64) for x in zip(*of, strict=True))
            docs, scores, read = shard.search(rows, weights, len(ids), k)
            out += [(item, ids[int(d)].as_py(), int(d), int(s), key[0].as_py(), read) for d, s in zip(docs, scores, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=[f.split()[0] for f in found_columns.split(", ")])

    found = met.groupBy("shard", "block").applyInArrow(run, found_columns)
    # Spark keeps k rows an item in each task before they meet.
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "place"]
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_rid").orderBy(*order))).where(F.col("rank") <= k)
    return top.join(asked.select("item_rid", "item_id"), "item_rid").select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index and search in one; nulls, ties, repeats as :func:`search` says.  Without documents or items the result is empty; other columns are not read."""
    return search(build(docs), items, k)
