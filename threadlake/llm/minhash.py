"""MinHash near-dedup with b-bit signatures.

Per document 512 minima over its 5-word shingles.  Bands of the full minima
propose candidates; the low four bits of each minimum, packed into 32 longs,
give a collision-corrected similarity by bit counts that discards most of them;
the rest are confirmed on the full shingle sets.  Documents with equal sets
are one node from the start.

Groups never expand into rows for all their pairs.  First each bucket's members
meet one of them, the pivot, and linked ones are merged, for a few rounds; a
bucket inside one component needs no more work.  Then the members outside a
bucket's largest part meet all others block against block: signatures travel once
a block, candidates as one list a document, and the shingle sets of a
small square of documents are intersected in one task by an index of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, drop, record, save, stage

WORDS, SIMILAR = 5, 75
HASHES, BITS, BANDS, ROWS = 512, 4, 40, 5
#: A pair at the threshold agrees in 392 of 512 low-bit minima on average, standard deviation 9.6.
#: Under 0.66 an estimate agrees in at most 348; of pairs at the threshold about one in 250,000 does.
LEAST_ESTIMATE = 0.66
PIVOT_ROUNDS = 4
#: Where the pairs that are left are at most this many a bucket member, they are all met at once instead of in further rounds with pivots.
FEW_PAIRS = 8
#: Documents on the two sides of a block of signatures, and on those of a square of shingle sets; squares of long documents hold fewer.
BLOCK_LEFT, BLOCK_RIGHT = 1_024, 4_096
SQUARE_LEFT, SQUARE_RIGHT, SQUARE_SHINGLES = 64, 256, 4_096
WORD_CACHE = 100_000
#: Pairs of one block that are looked at together, which bounds a task's memory however many of them are likely.
PAIRS = 400_000

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_MIX = _RNG.integers(1, 2**63, WORDS, dtype=_U) | _U(1)
_A = _RNG.integers(1, 2**32, HASHES, dtype=np.uint32)[:, None] | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_BAND_OF = _RNG.permutation(HASHES)[: BANDS * ROWS].reshape(BANDS, ROWS)
_BAND_MIX = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=_U) | _U(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self):
        self.words = _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and the six ASCII spaces
        if not words:
            return np.zeros(0, _U)
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), _U, len(words))
        if len(h) < WORDS:  # the whole sequence as one; its length keeps it apart from full shingles
            return _scramble((h * _MIX[: len(h)]).sum(keepdims=True) + _U(len(h)))
        n = len(h) - WORDS + 1
        total = h[:n] * _MIX[0]
        for i in range(1, WORDS):
            total = total + h[i : i + n] * _MIX[i]
        return np.unique(_scramble(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions, 32 bits wide."""
    x = (shingles >> _U(32)).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        h = x[None, i : i + 512] * _A
        h += _B
        np.minimum(low, h.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """Four bits of each scrambled minimum, sixteen to a signed long."""
    bits = (low * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(_U)
    return np.bitwise_or.reduce(bits.reshape(-1, 16) << (_U(4) * np.arange(16, dtype=_U)), axis=1).view(np.int64)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingle = Shingler()
    salt = np.arange(BANDS, dtype=_U)
    for b in batches:
        rows = []
        for rid, text in zip(b["rid"], b["text"], strict=True):
            s = shingle(text)
            if not len(s):
                rows.append((rid, 0, None, None, None))
                continue
            low = minima(s)
            bands = _scramble((low[_BAND_OF].astype(_U) * _BAND_MIX).sum(axis=1) + salt).view(np.int64)
            rows.append((rid, len(s), xxhash.xxh3_128_digest(s.tobytes()), bands, pack(low)))
        yield pd.DataFrame(rows, columns=["rid", "n", "same", "bands", "sig"])


def estimate(a, b):
    """Collision-corrected similarity of two packed signatures, by bit counts of equal four-bit lanes."""
    lanes = F.lit(0x1111111111111111)
    # Lambdas over the longs: written out for each of them, the expression would be most of its plan, and of the driver's memory.
    pairs = F.transform(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)))
    differing = F.aggregate(pairs, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(lanes)))
    chance = 2.0**-BITS
    return (1 - differing / HASHES - chance) / (1 - chance)


CANDIDATES = "square bigint, a bigint, ca bigint, bs array<bigint>, cbs array<bigint>"


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal rows."""
    cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True))


def _power_of_two(x) -> np.ndarray:
    return _U(1) << np.ceil(np.log2(np.maximum(1, x))).astype(_U)


def _squares(rid, other, n, n_other, m, m_other, most) -> np.ndarray:
    """Which square a candidate pair is confirmed in: the two documents' slots among the members of like size; buckets of one group share them."""
    name = _scramble(np.array([most], np.int64).view(_U) + _U(1))
    for ident, size, members, most_docs, salt in ((rid, n, m, SQUARE_LEFT, 11), (other, n_other, m_other, SQUARE_RIGHT, 13)):
        longer = np.maximum(0, np.ceil(np.log2(np.maximum(1, size) / SQUARE_SHINGLES))).astype(np.int64)
        slots = _power_of_two(members / np.maximum(1, most_docs >> longer))
        slot = _scramble(ident.astype(_U) + _U(salt)) & (slots - _U(1))
        name = _scramble(name ^ _scramble(slot * _U(64) + longer.astype(_U) + slots * _U(2**40) + _U(salt)))
    return name.view(np.int64)


class _Block:
    """Members of one bucket's block: columns of equal length."""

    def __init__(self, rows: pd.DataFrame):
        self.rid, self.n, self.label = (rows[c].to_numpy(np.int64) for c in ("rid", "n", "label"))
        self.sig = np.stack(rows["sig"].to_numpy()).view(_U)
        self.bands = np.stack(rows["bands"].to_numpy())


def _likely(x: _Block, y: _Block, key: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose labels differ, whose sizes and estimate allow a link, and whose first shared band is this bucket's; all of a left document's pairs come at once."""
    step = max(1, PAIRS // len(y.rid))
    for lo in range(0, len(x.rid), step):
        cut = slice(lo, lo + step)
        able = x.label[cut, None] != y.label
        able &= 100 * np.minimum(x.n[cut, None], y.n) >= SIMILAR * np.maximum(x.n[cut, None], y.n)
        able &= (y.label == most) | (x.rid[cut, None] < y.rid)
        i, j = np.nonzero(able)
        i += lo
        found = [], []
        for k in range(0, len(i), 65_536):
            a, b = i[k : k + 65_536], j[k : k + 65_536]
            d = x.sig[a] ^ y.sig[b]
            d |= d >> _U(1)
            d |= d >> _U(2)
            same = 1 - np.bitwise_count(d & _U(0x1111111111111111)).sum(axis=1) / HASHES
            chance = 2.0**-BITS
            good = (same - chance) / (1 - chance) >= LEAST_ESTIMATE
            a, b = a[good], b[good]
            shared = x.bands[a] == y.bands[b]
            first = x.bands[a, shared.argmax(axis=1)] == key
            found[0].append(a[first])
            found[1].append(b[first])
        if any(map(len, found[0])):
            yield np.concatenate(found[0]), np.concatenate(found[1])


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks, which come in runs of rows, to squares: a row without ``bs`` says that a square needs a document's set, others list what a document is to be compared with."""

    def block(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        left = g["left"].to_numpy()
        if left.all() or not left.any():
            return
        x, y = _Block(g[left]), _Block(g[~left])
        key, most, m, mx = (int(g[c].iloc[0]) for c in ("key", "most", "m", "mx"))
        for i, j in _likely(x, y, key, most):
            square = _squares(x.rid[i], y.rid[j], x.n[i], y.n[j], mx, m, most)
            order = np.lexsort((i, square))
            i, j, square = i[order], j[order], square[order]
            out = [(s, r, 0, None, None) for r_of in (x.rid[i], y.rid[j]) for s, r in np.unique(np.stack([square, r_of], axis=1), axis=0).tolist()]
            for lo, hi in _runs(np.stack([square, i], axis=1)):
                out.append((int(square[lo]), int(x.rid[i[lo]]), int(x.label[i[lo]]), y.rid[j[lo:hi]], y.label[j[lo:hi]]))
            yield _as_candidates(out)

    held = None
    for b in batches:
        held = b if held is None or not len(held) else pd.concat([held, b], ignore_index=True)
        if not len(held):
            continue
        *whole, (last, _) = _runs(held[["key", "xb", "yb"]].to_numpy())
        for lo, hi in whole:
            yield from block(held.iloc[lo:hi])
        held = held.iloc[last:]
    if held is not None and len(held):
        yield from block(held)


def _as_candidates(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["square", "a", "ca", "bs", "cbs"]).astype({"square": "int64", "a": "int64", "ca": "int64"})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Squares come as runs of rows, texts first: the candidates whose full sets are similar enough, one a pair of labels and document."""
    shingle, square, sets, held, whose, place = Shingler(), None, {}, None, None, {}

    def overlaps(a: np.ndarray, bs: list[int]) -> np.ndarray:
        """How many shingles each of the documents shares with one."""
        nonlocal held, whose, place
        if len(bs) < 8:
            return np.array([len(np.intersect1d(a, sets[b], assume_unique=True)) for b in bs])
        if held is None:  # all the square's shingles in order, and whose they are
            place = {r: k for k, r in enumerate(sets)}
            every = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
            order = np.argsort(every, kind="stable")
            held, whose = every[order], owner[order]
        lo, hi = np.searchsorted(held, a, "left"), np.searchsorted(held, a, "right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        return np.bincount(whose[at], minlength=len(sets))[[place[b] for b in bs]]

    for batch in batches:
        out = []
        for s, a, ca, bs, cbs, text in zip(*(batch[c] for c in ("square", "a", "ca", "bs", "cbs", "text")), strict=True):
            if s != square:
                square, sets, held = s, {}, None
            if bs is None:
                sets[a] = shingle(text)
                continue
            x, bs = sets[a], [int(b) for b in bs]
            both = overlaps(x, bs)
            either = len(x) + np.array([len(sets[b]) for b in bs]) - both
            seen = set()
            for k in np.flatnonzero(100 * both >= SIMILAR * either).tolist():
                if cbs[k] not in seen:
                    seen.add(cbs[k])
                    out.append((a, bs[k], int(ca), int(cbs[k])))
        yield pd.DataFrame(out, columns=["a", "b", "ca", "cb"], dtype="int64")


def _links(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The confirmed ones of ``candidates``: a square's texts go to the task that compares them, once each."""
    needed = candidates.where("bs is null").select("square", "a").distinct().join(texts.select(F.col("rid").alias("a"), "text"), "a")
    none = [F.lit(0).cast("bigint").alias("ca"), *[F.lit(None).cast("array<bigint>").alias(n) for n in ("bs", "cbs")]]
    both = needed.select("square", "a", *none, "text").unionByName(candidates.where("bs is not null").withColumn("text", F.lit(None).cast("string")))
    ordered = both.repartition("square").sortWithinPartitions("square", F.col("bs").isNotNull())
    return save(ordered.mapInPandas(_confirm, "a bigint, b bigint, ca bigint, cb bigint"), "links")


def _sizes_allow(x, y):
    """A similarity is at most the smaller set's size over the larger's."""
    return 100 * F.least(x, y) >= SIMILAR * F.greatest(x, y)


def _with_pivots(live: DataFrame, packed: DataFrame, first_round: bool) -> DataFrame:
    """Candidates of each bucket's members with its pivot: all of them at first, later of each document the likeliest."""
    met = live.where("label <> pivot_label").groupBy(F.col("rid").alias("a"), F.col("pivot").alias("b")).agg(F.min("label").alias("ca"), F.min("pivot_label").alias("cb"), F.max("m").alias("m"))
    side = lambda i: packed.select(F.col("rid").alias(i), F.col("n").alias(f"n{i}"), F.col("sig").alias(f"s{i}"))
    near = estimate(F.col("sa"), F.col("sb"))
    rated = met.join(side("a"), "a").join(side("b"), "b").where(_sizes_allow(F.col("na"), F.col("nb")) & (near >= LEAST_ESTIMATE)).select("a", "b", "ca", "cb", "m", "na", near.alias("near"))
    if not first_round:
        rated = rated.groupBy("a").agg(F.max(F.struct("near", "b", "ca", "cb", "m", "na")).alias("top")).select("a", "top.*")
    longer = F.greatest(F.lit(0), F.ceil(F.log2(F.col("na") / SQUARE_SHINGLES))).cast("int")
    slots = F.ceil(F.col("m") / F.greatest(F.lit(1), F.lit(SQUARE_RIGHT) / F.pow(F.lit(2), longer))).cast("bigint")
    pairs = rated.select(F.xxhash64("b", longer, F.pmod(F.xxhash64("a"), slots)).alias("square"), "a", "b", "ca", "cb")
    # One row says what to compare, two that a square needs a document's set; a union would work the pairs out twice.
    none = [F.lit(0).cast("bigint").alias("ca"), *[F.lit(None).cast("array<bigint>").alias(n) for n in ("bs", "cbs")]]
    rows = F.array(F.struct("a", "ca", F.array("b").alias("bs"), F.array("cb").alias("cbs")), *[F.struct(F.col(side).alias("a"), *none) for side in ("a", "b")])
    return save(pairs.select("square", F.explode(rows).alias("row")).select("square", "row.*"), "candidates")


def _with_all(live: DataFrame, packed: DataFrame) -> DataFrame:
    """Candidates of the members outside each bucket's largest part with all others in it, by blocks of signatures."""
    left = F.col("label") != F.col("most")
    outside = live.where(left).groupBy("key").agg(F.count("*").alias("mx"))
    rows = live.join(outside, "key").join(packed, "rid").select("key", "rid", "label", "most", "m", "mx", "n", "sig", "bands")
    count = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    sides = F.array(
        F.struct(F.lit(True).alias("left"), F.array(F.pmod(F.xxhash64("rid"), count("mx", BLOCK_LEFT)).cast("int")).alias("xs"), F.sequence(F.lit(0), count("m", BLOCK_RIGHT) - 1).alias("ys")),
        F.struct(F.lit(False).alias("left"), F.sequence(F.lit(0), count("mx", BLOCK_LEFT) - 1).alias("xs"), F.array(F.pmod(F.xxhash64("rid"), count("m", BLOCK_RIGHT)).cast("int")).alias("ys")),
    )
    sides = F.filter(sides, lambda s: ~s["left"] | left)
    rows = rows.withColumn("s", F.explode(sides)).withColumn("xb", F.explode("s.xs")).withColumn("yb", F.explode("s.ys")).withColumn("left", F.col("s.left")).drop("s")
    ordered = rows.repartition("key", "xb", "yb").sortWithinPartitions("key", "xb", "yb")
    return save(ordered.mapInPandas(_candidates, CANDIDATES), "candidates")


def _merge(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(rid, label)`` after new links of documents (``ca``) with pivots (``cb``).

    All documents of one pivot take the smallest label of its star.  Equal labels mean linked; not all that
    is linked need have one label yet, as the links themselves are kept.
    """
    star = links.groupBy("cb").agg(F.min(F.least("ca", "cb")).alias("new"))
    hook = links.join(star, "cb").select(F.col("ca").alias("old"), "new").unionByName(star.select(F.col("cb").alias("old"), "new"))
    hook = hook.where("old <> new").groupBy("old").agg(F.min("new").alias("new"))
    jump = hook.select(F.col("old").alias("new"), F.col("new").alias("further"))
    hook = save(hook.join(jump, "new", "left").select("old", F.coalesce("further", "new").alias("new")), "hooks")
    fresh = hook.select(F.col("old").alias("rid"), F.col("new").alias("label"))
    if label is None:
        return fresh
    moved = label.join(hook, label["label"] == hook["old"], "left").select("rid", F.coalesce("new", "label").alias("label"))
    return save(moved.unionByName(fresh.join(label, "rid", "left_anti")), "labels")


def _components(sigs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``(rid, comp)`` of the nodes that are linked with another; None if there are none.  ``sigs`` is read here for the last time and removed."""
    bands = sigs.join(nodes, "rid").select(F.explode("bands").alias("key"), "rid")
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = save(bands.join(shared, "key").select("key", "rid"), "buckets")
    met = buckets.select("rid").distinct()
    # Signatures first, so that those of all documents are gone before texts move: texts and their shuffle take the most room.
    packed = save(sigs.select("rid", "n", "sig", "bands").join(met, "rid"), "packed")
    drop(sigs)
    texts = save(texts.join(met, "rid"), "texts")
    label, links, before = None, [], None
    for turn in range(PIVOT_ROUNDS + 1):
        here = buckets.withColumn("label", F.col("rid")) if label is None else buckets.join(label, "rid", "left").select("key", "rid", F.coalesce("label", "rid").alias("label"))
        # Per bucket: a random member as pivot, and the label that most members have.
        member = F.struct(F.xxhash64(F.lit(turn), "rid").alias("h"), "rid", "label")
        parts = here.groupBy("key", "label").agg(F.count("*").alias("n"), F.min(member).alias("pivot"))
        # A bucket of two has nothing left to compare after the first round.
        pivots = parts.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("most"), F.min("pivot").alias("pivot")).where((F.col("most.n") < F.col("m")) & (F.col("m") > (2 if turn else 1)))
        live = save(here.join(pivots, "key").select("key", "rid", "label", "m", F.col("most.label").alias("most"), F.col("pivot.rid").alias("pivot"), F.col("pivot.label").alias("pivot_label")), "live")
        drop(buckets)
        left = live.agg(F.count("*").alias("members"), F.sum(F.when(F.col("label") != F.col("most"), F.col("m"))).alias("pairs")).first()
        if not left["members"]:
            break
        # A round that leaves most pairs as they were would be followed by more of that kind.
        stalled = before is not None and 4 * left["pairs"] > 3 * before
        last = turn == PIVOT_ROUNDS or stalled or left["pairs"] <= FEW_PAIRS * left["members"]
        before = left["pairs"]
        candidates = _with_all(live, packed) if last else _with_pivots(live, packed.drop("bands"), turn == 0)
        links.append(_links(candidates, texts))
        drop(candidates)
        if last:
            break
        label = _merge(label, links[-1])
        buckets = live.select("key", "rid")
        buckets.saved_at = live.saved_at
    every = reduce(DataFrame.unionByName, links) if links else None
    comp = None if every is None or every.isEmpty() else components(every.select("a", "b")).select(F.col("node").alias("rid"), "comp")
    drop(texts, packed, live, *links)
    return comp


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rec`` (the whole row), ``n_shingles``, ``component_id``, ``kept`` for every row.

    Links join documents whose shingle sets have a Jaccard similarity of 0.75 or more.  A text without
    words, empty or null has no shingles and links with nothing; one of fewer
    than five words has its whole sequence.  ``component_id`` is the smallest
    id reachable (null ids rank last).  Of a component the row with the smallest id stays, one row if it
    repeats.  Other columns stay in ``rec``; an empty table gives an empty result.
    """
    staged = stage(docs, "near", rec=record(docs))
    text, ident = F.col(f"rec.`{text_col}`").alias("text"), F.col(f"rec.`{id_col}`").alias("id")
    sigs = save(staged.select("rid", text).mapInPandas(_signatures, "rid bigint, n bigint, same binary, bands array<bigint>, sig array<bigint>"), "signatures")
    # ``rep`` stands for all documents with its set.
    twins = sigs.where("n > 0").groupBy("same").agg(F.min("rid").alias("rep"))
    members = save(sigs.select("rid", "n", "same").join(twins, "same", "left").select("rid", "n", F.coalesce("rep", "rid").alias("node")), "members")
    comp = _components(sigs, members.where("n > 0 and rid = node").select("rid"), staged.select("rid", text))
    if comp is not None:
        members = members.join(comp.withColumnRenamed("rid", "node"), "node", "left").select("rid", "n", F.coalesce("comp", "node").alias("node"))
    # Decisions are made on ids; whole records move once, to meet theirs.
    named = save(members.join(staged.select("rid", ident), "rid"), "named")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    heads = named.groupBy("node").agg(F.count("*").alias("size"), first.alias("first")).where("size > 1").select("node", "first")
    decided = named.join(heads, "node", "left").select(
        "rid", F.col("n").alias("n_shingles"),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (F.coalesce("first.rid", "rid") == F.col("rid")).alias("kept"),
    )
    return staged.join(decided, "rid").drop("rid")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return near_groups(docs, id_col, text_col).select(F.col(f"rec.`{id_col}`").alias("doc_id"), "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, one row of each component."""
    return near_groups(docs, id_col, text_col).where("kept").select("rec.*")
