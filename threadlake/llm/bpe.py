"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of documents are laid out as one linked list of
symbols.  An inverted index from merge rank (one per token pair) to the
positions of that pair applies the merges in rank order over all words at once;
after a merge only the neighbours it touched are looked up again.  Spark
spreads the documents; a block is what one task holds at a time, by bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of one block; distinct words kept from one block to the next.
BLOCK_BYTES = 12_000_000
CACHE_WORDS = 500_000
NONE = np.int32(2**31 - 1)


class Merges:
    """A rank file's tokens and the rank that each pair of tokens merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([r for _, r in pairs], np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.tokens) + 1
        self.token_len = np.zeros(size, np.int64)
        for r, t in self.tokens.items():
            self.token_len[r] = len(t)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_bytes = np.frombuffer(b"".join(self.tokens.get(r, b"") for r in range(size)), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's ids as if merged alone: all ids in one array, and each word's start and length there."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int32, len(words))
        rest = np.flatnonzero(whole < 0)
        flat, kept = self._replay([words[i] for i in rest.tolist()]) if len(rest) else (whole[:0], whole[:0])
        lens = np.ones(len(words), np.int64)  # a word that is a token is that token
        lens[rest] = kept
        starts = np.empty(len(words), np.int64)
        starts[rest] = len(words) + np.cumsum(kept) - kept
        known = np.flatnonzero(whole >= 0)
        starts[known] = known
        return np.concatenate([whole, flat]), starts, lens

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        n = int(ends[-1])
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lens)
        # One place past the end stands for "no neighbour".
        after = np.arange(1, n + 1)
        after[ends[lens > 0] - 1] = n
        before = np.arange(-1, n)
        before[ends[lens > 0] - lens[lens > 0]] = n
        before[n] = n
        after = np.append(after, n)
        sym = np.append(sym, np.int32(0))
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.pair_ranks(sym[inner], sym[after[inner]])
        alive = np.ones(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        todo: list[int] = []

        def file(at: np.ndarray) -> None:
            """Enter positions in the index under their pair's rank."""
            at = at[rank[at] != NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            bounds = [0, *cut.tolist(), len(at)]
            for k, lo, hi in zip(r[bounds[:-1]].tolist(), bounds, bounds[1:], strict=False):
                piece = at[lo:hi]
                if k in index:
                    index[k].append(piece)
                else:
                    index[k] = [piece]
                    heapq.heappush(todo, k)

        file(inner)
        odd: set[int] = set()
        while todo:
            r = heapq.heappop(todo)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            at.sort()
            if len(at) > 1 and (chained := after[at[:-1]] == at[1:]).any():
                # Overlapping pairs (aaa): the leftmost goes first, then every other one.
                head = np.concatenate([[True], ~chained])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            gone = after[at]
            sym[at] = r
            alive[gone] = False
            rank[gone] = NONE
            nxt = after[gone]
            after[at] = nxt
            before[nxt] = at
            before[n] = n
            rank[at] = np.where(nxt < n, self.pair_ranks(sym[at], sym[nxt]), NONE)
            prev = before[at]
            prev = prev[prev < n]
            rank[prev] = self.pair_ranks(sym[prev], sym[after[prev]])
            touched = np.unique(np.concatenate([at, prev]))
            if (early := touched[rank[touched] < r]).size:
                odd.update(owner[early].tolist())  # an earlier merge came up late: this word is redone alone
            file(touched)
        ids = sym[:n][alive[:n]]
        kept = np.bincount(owner[alive[:n]], minlength=len(words))
        if odd:
            each = np.split(ids, np.cumsum(kept)[:-1])
            for i in odd:
                each[i] = self.one_by_one(words[i])
            ids, kept = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        return ids, kept

    def one_by_one(self, word: bytes) -> np.ndarray:
        """One word by repeatedly merging its first lowest pair."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, int(NONE)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return np.array([self.ranks[p] for p in parts], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ragged(self.token_at[ids], self.token_len[ids])].tobytes()


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, one run after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


#: For one common pattern, the same matches by Python's own ``re``, twice as fast, in texts of no other characters than LATIN.
COMMON = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
LATIN = rf"[\n\t\r\x20-\x7e¡-±´-¸»¿×÷{LETTERS}‐-‧]*"
COMMON_LATIN = rf"'(?:[stmd]|re|ve|ll)| ?(?:[{LETTERS}]+|[0-9]+|[^\s{LETTERS}0-9]+)|\s+(?!\S)|\s+"


def finder(pattern: str):
    """``text -> list of matches``."""
    general = regex.compile(pattern).findall
    if pattern != COMMON:
        return general
    latin, fast = re.compile(LATIN).fullmatch, re.compile(COMMON_LATIN).findall
    return lambda text: fast(text) if latin(text) else general(text)


class WordIds(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes blocks of texts; words met before are not replayed again while the cache holds them."""

    def __init__(self, path: str, pattern: str):
        self.m, self.find = merges(path), finder(pattern)
        self._clear()

    def _clear(self) -> None:
        self.known, self.flat, self.starts, self.lens = WordIds(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self._clear()
        old, known = len(self.known), self.known
        words = [np.fromiter(map(known.__getitem__, self.find(t)), np.int64) for t in texts]
        if len(known) > old:
            new = [w.encode("utf-8", "surrogatepass") for w in list(known)[old:]]
            ids, starts, lens = self.m.replay(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + starts])
            self.lens = np.concatenate([self.lens, lens])
            self.flat = np.concatenate([self.flat, ids])
        return [self.flat[ragged(self.starts[w], self.lens[w])] for w in words]


def blocks(batches: Iterable[pd.DataFrame], size: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """The rows of a task's batches, regrouped to about ``size`` characters of text."""
    held, chars = [], 0
    for b in batches:
        at = 0
        total = b["text"].str.len().cumsum().to_numpy()
        while at < len(b):
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + size - chars, side="right")))
            held.append(b.iloc[at:end])
            chars += int(total[end - 1] - done)
            at = end
            if chars >= size or at < len(b):
                yield pd.concat(held, ignore_index=True)
                held, chars = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (if ``keep_ids``), ``ids_sha256``, ``decoded_sha256`` for every row.

    Each match of ``pattern`` is encoded separately, without special tokens; the ids are then
    decoded again and the bytes' digest returned.  Null and empty texts have no
    tokens.  Repeated rows give repeated results; no row is dropped whatever its
    length; other columns are not read; an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = "doc_id string, n_tokens bigint, " + ("ids array<int>, " if keep_ids else "") + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, pattern)
        for block in blocks(batches):
            found = encoder.encode(block["text"].tolist())
            out = {"doc_id": block["doc_id"].astype(object), "n_tokens": [len(x) for x in found]}
            if keep_ids:
                out["ids"] = found
            out["ids_sha256"] = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
            out["decoded_sha256"] = [hashlib.sha256(encoder.m.decode(x)).hexdigest() for x in found]
            yield pd.DataFrame(out)

    # Ids pass Python as strings, as pandas would turn whole numbers beside nulls into floats.
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rec`` (the whole row) and ``text``, the decoded ids; null ids give null, bytes that are not UTF-8 are replaced."""
    from ._common import record

    def run(ids: pd.Series) -> pd.Series:
        m = merges(path)
        return ids.map(lambda x: None if x is None else m.decode(np.asarray(x, np.int64)).decode("utf-8", "replace"))

    udf = F.pandas_udf(run, "string")
    return encoded.select(record(encoded).alias("rec"), udf(F.col(f"`{ids_col}`")).alias("text"))
