"""Full-text search over a posting table: parse, match, rank, page.

``postings(id, token, positions, n)`` is an ordinary table, stored with a token's postings of about a million tokens as lists in one row and each file in order of the
token, so a query's terms prune the row groups and pages it reads; no posting moves between tasks
when it is stored, and a query's rows are spread over all files.  ``n`` is the row's number of tokens, and ``corpus`` holds the two figures of all rows that scores need.
:mod:`segments` keeps such an index under change, with a message's sections apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..functions.tokens import folds, split, token_class, tokenise

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
PAGE = 200


class Phrase(NamedTuple):
    """Consecutive tokens; with ``prefix`` the last one may go on."""

    words: tuple[str, ...]
    prefix: bool


def parse_query(text: str) -> list[Phrase]:
    """Terms split at white space; quotes make exact phrases, a bare term is a prefix; a backslash takes the next character as it is.

    Terms without a token are dropped.  No phrases means no results.
    """
    terms: list[tuple[str, bool]] = []
    held, quoted, was_quoted, escape = "", False, False, False

    def close() -> None:
        nonlocal held, was_quoted
        if held:
            terms.append((held, was_quoted))
        held, was_quoted = "", False

    for c in text:
        if escape:
            held, escape = held + c, False
        elif c == "\\":
            escape = True
        elif c == '"':
            close()
            quoted = not quoted
            was_quoted = quoted
        elif c.isspace() and not quoted:
            close()
        else:
            held += c
    if escape:
        held += "\\"
    close()
    phrases = [Phrase(tuple(tokenise(t)), not exact) for t, exact in terms]
    return [p for p in phrases if p.words]


class Index(NamedTuple):
    postings: DataFrame
    corpus: DataFrame


#: A message's sections stand so far apart in its positions; no section has as many tokens.
SECTION = 1 << 24
POSTING = "token string, id bigint, positions array<int>, ns array<int>"
LISTS = "token string, ids array<bigint>, ns array<int>, positions array<array<int>>"
#: So many tokens are put in order at once, or one longer message's.
FOLD_TOKENS = 1 << 20


def texts_of(messages: DataFrame, id_col: str, sections: list[Column]) -> DataFrame:
    """``(id, first, texts)`` of messages with text: the first section that is not blank, and all sections."""
    first = F.coalesce(*[F.when(F.trim(c) != "", F.lit(k)) for k, c in enumerate(sections)])
    return messages.select(F.col(id_col).cast("bigint").alias("id"), first.alias("first"), F.array(*sections).alias("texts")).where("first is not null")


def in_tasks(rows: DataFrame, columns: list[str], run: Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the texts of :func:`texts_of` in tasks: it gets the columns named and ``words``, each row's sections as tokens.

    Texts are written once and become tokens where they are needed: tokens as rows' lists cost more to write and read than to make again.
    """
    table = folds()

    def words(batches) -> Iterator[tuple[pa.Array, ...]]:
        for b in batches:
            texts = b.column(len(columns))
            in_row = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
            own = split(texts.flatten(), table)
            yield *b.columns[: len(columns)], lists(np.cumsum(in_row) - in_row, own)

    return rows.select(*columns, "texts").mapInArrow(lambda batches: run(words(batches)), schema)


def lengths(texts: DataFrame) -> DataFrame:
    """``(id, first, ns)`` of these rows: ``ns[k]`` counts the tokens up to section ``k``."""
    arrow = pa.schema([("id", pa.int64()), ("first", pa.int32()), ("ns", pa.list_(pa.int32()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, first, words in batches:
            ns = counts(words)
            yield pa.RecordBatch.from_arrays([ids, first, lists(np.arange(len(ns)) * ns.shape[1], pa.array(ns.ravel()))], schema=arrow)

    return in_tasks(texts, ["id", "first"], run, "id bigint, first int, ns array<int>")


def counts(words: pa.ListArray) -> np.ndarray:
    """For each row, how many tokens stand up to each section."""
    sections = words.flatten()
    return np.cumsum(pc.list_value_length(sections).to_numpy(zero_copy_only=False).reshape(len(words), -1 if len(words) else 1), axis=1, dtype=np.int32)


def figures(texts: DataFrame) -> DataFrame:
    """One row: how many messages have text, and their mean number of tokens."""
    return lengths(texts).agg(F.count("*").alias("total"), F.avg(F.col("ns")[0]).alias("avg_len"))


def slices(words: pa.ListArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` tokens each, or one longer row."""
    sections = words.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(sections).to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])]
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Sorted(NamedTuple):
    """The postings of some rows in order of token and row: what each is of, and where its positions begin."""

    token: pa.Array
    rank: np.ndarray
    row: np.ndarray
    positions: pa.ListArray


def sorted_postings(words: pa.ListArray) -> Sorted:
    """``words`` has each row's sections; places in section ``k`` start at ``k * SECTION``."""
    sections = words.flatten()
    flat = sections.flatten()
    in_row = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    in_section = pc.list_value_length(sections).to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(words)), in_row)
    number = np.arange(len(row_of)) - np.repeat(np.cumsum(in_row) - in_row, in_row)
    at = (np.arange(len(flat)) + np.repeat(number * SECTION - (np.cumsum(in_section) - in_section), in_section)).astype(np.int32)
    coded = flat.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    # Tokens stand in order of their rows, so a token's number is the rest of the key: plain integers are sorted, several times as fast as an order of them.
    bits = len(flat).bit_length()
    key = np.sort((rank[coded.indices.to_numpy()] << bits) | np.arange(len(flat)))
    own, by = key >> bits, key & ((1 << bits) - 1)
    row = np.repeat(row_of, in_section)[by]
    starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
    own, row = own[starts], row[starts]
    return Sorted(coded.dictionary.take(order).take(pa.array(own)), own, row, lists(starts, pa.array(at[by])))


def lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists that begin at these places and follow each other to the end."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def fold(texts: DataFrame) -> DataFrame:
    """Postings of :func:`texts_of`, a message's own put together inside its row: places in section ``k`` start at ``k * SECTION``, ``ns[k]`` counts the tokens up to section ``k``."""
    arrow = pa.schema([("token", pa.string()), ("id", pa.int64()), ("positions", pa.list_(pa.int32())), ("ns", pa.list_(pa.int32()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, words in batches:
            for lo, hi in slices(words, FOLD_TOKENS):
                own = words[lo:hi]
                p, ns = sorted_postings(own), counts(own)
                yield pa.RecordBatch.from_arrays([p.token, ids[lo:hi].take(pa.array(p.row)), p.positions, lists(np.arange(len(p.row)) * ns.shape[1], pa.array(ns[p.row].ravel()))], schema=arrow)

    return in_tasks(texts, ["id"], run, POSTING)


def fold_lists(texts: DataFrame) -> DataFrame:
    """Postings of texts of one section, those of one token in about ``FOLD_TOKENS`` tokens as lists in one row: a tenth of the rows to sort and store, with the same entries."""
    arrow = pa.schema([("token", pa.string()), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int32())), ("positions", pa.list_(pa.list_(pa.int32())))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for ids, words in batches:
            for lo, hi in slices(words, FOLD_TOKENS):
                p = sorted_postings(words[lo:hi])
                starts = np.flatnonzero(np.concatenate([[True], p.rank[1:] != p.rank[:-1]])) if len(p.rank) else p.rank
                n = counts(words[lo:hi])[p.row, 0]
                own = [lists(starts, c) for c in (ids[lo:hi].take(pa.array(p.row)), pa.array(n), p.positions)]
                yield pa.RecordBatch.from_arrays([p.token.take(pa.array(starts)), *own], schema=arrow)

    return in_tasks(texts, ["id"], run, LISTS)


def one_by_one(held: DataFrame) -> DataFrame:
    """Lists of postings as :class:`Index` has them, one row a token and message; conditions on tokens hold before they are taken apart."""
    one = F.explode(F.arrays_zip("ids", "ns", "positions")).alias("one")
    return held.select("token", one).select("token", F.col("one.ids").alias("id"), F.col("one.positions").alias("positions"), F.col("one.ns").alias("n"))


def build_index(messages: DataFrame, id_col: str = "id", text: Column | None = None) -> Index:
    """Postings of all messages whose text is not blank, and ``(total, avg_len)``."""
    texts = storage.save(texts_of(messages, id_col, [F.col("text") if text is None else text]), "texts")
    return Index(fold(texts).select("token", "id", "positions", F.col("ns")[0].alias("n")), figures(texts))


def stored_index(spark: SparkSession, name: str, state: str, messages: DataFrame, id_col: str = "id", text: Column | None = None) -> Index:
    """The index of messages in this state, from storage if it is there; else it is built and stored, each file in order of the token.

    What is indexed and the rules that make tokens belong to the state, so another text under the same name is another index.
    """
    kind = hashlib.sha256(f"lists|{id_col}|{text}|{token_class()}".encode()).hexdigest()[:12]

    def tables() -> dict[str, DataFrame]:
        texts = storage.save(texts_of(messages, id_col, [F.col("text") if text is None else text]), "texts")
        return {"postings": fold_lists(texts).sortWithinPartitions("token"), "corpus": figures(texts).coalesce(1)}

    held = storage.kept(spark, f"search-{name}", f"{state}-{kind}", tables)
    return Index(one_by_one(held["postings"]), held["corpus"])


def fits(phrase: Phrase, i: int) -> Column:
    """Whether a row of postings has a token for the phrase's word ``i``."""
    word = phrase.words[i]
    return F.startswith("token", F.lit(word)) if phrase.prefix and i == len(phrase.words) - 1 else F.col("token") == word


def wanted(phrases: list[Phrase]) -> Column:
    """Whether a row of postings has a token for any word."""
    return reduce(lambda a, b: a | b, [fits(p, i) for p in phrases for i in range(len(p.words))])


def _less(i: int) -> Callable[[Column], Column]:
    return lambda at: at - i


def side_by_side(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """``(id, n, tf0, tf1, ...)``: how often each phrase stands in each row that has any of their words; null where a phrase is not there."""
    cols, counts = [], []
    for k, p in enumerate(phrases):
        if len(p.words) == 1:
            cols.append(F.sum(F.when(fits(p, 0), F.size("positions"))).alias(f"tf{k}"))
            counts.append(F.col(f"tf{k}"))
            continue
        # A phrase stands where all its words agree on one start; a place holds one token, so no start repeats.
        starts = [f"s{k}_{i}" for i in range(len(p.words))]
        cols += [F.flatten(F.collect_list(F.when(fits(p, i), F.transform("positions", _less(i))))).alias(c) for i, c in enumerate(starts)]
        n = F.size(reduce(F.array_intersect, map(F.col, starts)))
        counts.append(F.when(n > 0, n.cast("bigint")).alias(f"tf{k}"))
    return postings.where(wanted(phrases)).groupBy("id", "n").agg(*cols).select("id", "n", *counts)


def match(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """Ids that hold every phrase."""
    return side_by_side(postings, phrases).dropna().select("id")


def weigh(total: Column, df: Column, tf: Column, n: Column, avg_len: Column) -> Column:
    """What a phrase adds to a row's score, higher for better; it grows with ``tf`` and falls with ``n``."""
    x = F.log((total - df + 0.5) / (df + 0.5))
    return F.when(x > 0, x).otherwise(F.lit(LEAST_IDF)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / avg_len))


def bm25(index: Index, phrases: list[Phrase]) -> DataFrame:
    """``(id, score)`` of the rows that hold every phrase; lower is better.  Corpus figures are of all indexed rows."""
    # A row's counts side by side, so the phrases' rows are counted where scores are read; written, as both read them.
    wide = storage.save(side_by_side(index.postings, phrases), "hits")
    rows = wide.agg(*[F.count(f"tf{k}").alias(f"df{k}") for k in range(len(phrases))]).crossJoin(F.broadcast(index.corpus))  # one row each
    parts = [weigh(F.col("total"), F.col(f"df{k}"), F.col(f"tf{k}"), F.col("n"), F.col("avg_len")) for k in range(len(phrases))]
    score = parts[0]
    for p in parts[1:]:
        score = score + p  # null if a phrase is not there
    return wide.crossJoin(F.broadcast(rows)).select("id", (-score).alias("score")).where("score is not null")


def filters(df: DataFrame, supported: DataFrame, agents: list[str] | None = None, project: str | None = None, since: int | None = None, until: int | None = None, errors_only: bool = False) -> DataFrame:
    """Filters shared by searches; ``errors_only`` keeps every message of a session that had an error."""
    out = df.join(F.broadcast(supported), "agent", "left_semi")  # at most one row a provider
    if agents:
        out = out.where(F.col("agent").isin(agents))
    if project is not None:
        out = out.where(F.col("project_key") == project)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    if errors_only:
        out = out.where(F.col("has_error") | F.col("had_error"))
    return out


RECENCY = lambda: [F.col("ts").desc(), (F.col("id") < 0).desc(), F.col("id").desc()]


def after_recency(df: DataFrame, ts: int, id_: int) -> DataFrame:
    """Rows after a cursor in recency order; ids under zero come first within their millisecond."""
    same = F.col("ts") == ts
    if id_ < 0:
        later = same & (((F.col("id") < 0) & (F.col("id") < id_)) | (F.col("id") >= 0))
    else:
        later = same & (F.col("id") >= 0) & (F.col("id") < id_)
    return df.where((F.col("ts") < ts) | later)


def after_relevance(df: DataFrame, score: float, id_: int) -> DataFrame:
    return df.where((F.col("score") > score) | ((F.col("score") == score) & (F.col("id") < id_)))


def search(corpus: DataFrame, index: Index, supported: DataFrame, text: str, sort: str = "recency", limit: int = PAGE, cursor: tuple | None = None, **only) -> DataFrame:
    """One page of results.  ``corpus`` has one row a message with its session, project, file and root columns.

    ``has_more`` says whether rows follow the page; :func:`next_cursor` is where they start.
    """
    phrases = parse_query(text)
    if not phrases:
        return corpus.limit(0).withColumn("has_more", F.lit(False))
    hits = match(index.postings, phrases) if sort == "recency" else bm25(index, phrases)
    found = filters(corpus, supported, **only).join(hits, "id")
    if sort == "recency":
        found, order = after_recency(found, *cursor) if cursor else found, RECENCY()
    else:
        found, order = after_relevance(found, *cursor) if cursor else found, [F.col("score").asc(), F.col("id").desc()]
    return paged(found, order, limit)


def paged(found: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in this order, and ``has_more``."""
    top = found.orderBy(*order).limit(limit + 1)
    placed = top.withColumn("_place", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(0))) > limit)  # a page and one row
    return placed.where(F.col("_place") <= limit).orderBy("_place").drop("_place")


def next_cursor(page: DataFrame, sort: str = "recency") -> tuple[Any, int] | None:
    """The last row's sort values, if rows follow it."""
    by = [F.col("ts").asc(), (F.col("id") < 0).asc(), F.col("id").asc()] if sort == "recency" else [F.col("score").desc(), F.col("id").asc()]
    last = page.orderBy(*by).limit(1).select("ts" if sort == "recency" else "score", "id", "has_more").first()
    return (last[0], last["id"]) if last and last["has_more"] else None


def grouped(page: DataFrame) -> DataFrame:
    """Results by project and session in order of first appearance; ``rank`` is the row's place on the page."""
    by_project, by_session = Window.partitionBy("project_key"), Window.partitionBy("project_key", "session_id")
    placed = page.withColumn("project_at", F.min("rank").over(by_project)).withColumn("session_at", F.min("rank").over(by_session))
    return placed.groupBy("project_at", "project_key", "session_at", "session_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("hits"))
