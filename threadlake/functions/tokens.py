"""Full-text tokens: letters, digits and private-use characters, case and diacritics folded.

Later symbols, which the Unicode 6.1 tables of the index do not know, count as
tokens too; which ones is asked once of the standard library's own full-text
tables.
"""

from __future__ import annotations

import sqlite3
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def folding() -> tuple[str, str]:
    """Letters with diacritics and their bases, by canonical decomposition; compatibility forms stay."""
    pairs = {}
    for cp in range(0x80, 0x2_0000):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c.lower())
        if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) and not unicodedata.combining(d[0]) and 0xAC00 > cp:
            pairs[c] = d[0]
    return "".join(pairs), "".join(pairs.values())


@lru_cache(1)
def late_symbols() -> tuple[tuple[int, int], ...]:
    """Symbols that the index takes for token characters, as ranges of code points."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(x, content='', tokenize='unicode61 remove_diacritics 2')")
        db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    except sqlite3.OperationalError as e:  # another set of symbols would be another index
        raise RuntimeError("the driver's SQLite has no full-text search, which says what late symbols are") from e
    cps = [cp for cp in range(0x80, 0x2_0000) if unicodedata.category(chr(cp))[0] in "SP"]
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", ((cp, chr(cp)) for cp in cps))
    found = sorted({r[0] for r in db.execute("SELECT doc FROM v")})
    out, i = [], 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and found[j + 1] == found[j] + 1:
            j += 1
        out.append((found[i], found[j]))
        i = j + 1
    return tuple(out)


def token_class() -> str:
    """As a pattern.  The late symbols' many ranges stand behind one comparison, so common separators are not tried against each of them."""
    late = late_symbols()
    if not late:
        return r"[\p{L}\p{N}\p{Co}]+"
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in late)
    return rf"[\p{{L}}\p{{N}}\p{{Co}}[[^\x00-\x{{{late[0][0] - 1:X}}}]&&[{ranges}]]]+"


def tokens(text: Column) -> Column:
    """The tokens of a text in order."""
    marks, bases = folding()
    folded = F.regexp_replace(F.translate(F.lower(text), marks, bases), r"\p{Mn}+", "")
    return F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(token_class()), 0)


#: So many bytes of text are taken apart at once.
PIECE = 1 << 19
SIGMA = "\u03a3"


@lru_cache(1)
def folds() -> bytes:
    """For each code point what it is in a token, 0 if it parts tokens, -1 if it leaves no trace; packed, as tasks get it from the driver."""
    marks, late = dict(zip(*folding(), strict=True)), {cp for a, b in late_symbols() for cp in range(a, b + 1)}
    out = np.zeros(0x11_0000, np.int32)
    for cp in range(len(out)):
        if not 0xD800 <= cp < 0xE000:
            kept = [c for c in (marks.get(c, c) for c in chr(cp).lower()) if unicodedata.category(c) != "Mn"]
            kind = unicodedata.category(kept[0]) if kept else ""
            out[cp] = -1 if not kept else ord(kept[0]) if kind[0] in "LN" or kind == "Co" or ord(kept[0]) in late else 0
    return zlib.compress(out.tobytes())


@lru_cache(1)
def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int32)


def split(texts: pa.StringArray, packed: bytes) -> pa.ListArray:
    """The same for a batch of texts, on whole arrays; ``packed`` is :func:`folds`'."""
    ends = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False), dtype=np.int64)
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
        out.append(_split(texts[lo:hi], _table(packed)))
        lo = hi
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def _split(texts: pa.StringArray, table: np.ndarray) -> pa.ListArray:
    texts = texts.fill_null("")
    if pc.any(pc.match_substring(texts, SIGMA)).as_py():  # what this letter becomes depends on its place in a word
        texts = pa.array([t.lower() if SIGMA in t else t for t in texts.to_pylist()], pa.string())
    raw = b"".join(texts.cast(pa.binary()).to_pylist())
    code = np.frombuffer(raw if raw.isascii() else raw.decode().encode("utf-32-le"), np.uint8 if raw.isascii() else np.uint32)
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    own = table[code]
    kept = own >= 0
    if not kept.all():
        own, ends = own[kept], np.concatenate([[0], np.cumsum(kept)])[ends]
    token = own > 0
    first = token.copy()
    first[1:] &= ~token[:-1]
    rows = ends[:-1][np.diff(ends) > 0]
    first[rows] = token[rows]  # no token goes on into the next text
    starts = np.flatnonzero(first)
    letters = own[token].astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(token)])[starts] if len(starts) else starts
    if raw.isascii():
        data = letters.astype(np.uint8).tobytes()
    else:
        data = letters.tobytes().decode("utf-32-le").encode()
        at = np.concatenate([[0], np.cumsum(1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x1_0000))])[at]
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), flat)


def _is_token(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" or any(a <= ord(c) <= b for a, b in late_symbols())


def tokenise(text: str) -> list[str]:
    """The same for a query string, on the driver."""
    table = str.maketrans(*folding())
    folded = (c for c in text.lower().translate(table) if unicodedata.category(c) != "Mn")
    return [t for t in "".join(c if _is_token(c) else " " for c in folded).split(" ") if t]
