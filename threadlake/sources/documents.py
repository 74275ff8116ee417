"""A JSON document read in pieces: the objects of its message array with their byte ranges, its other fields, and whether it is closed.

The tokenizer keeps its place between chunks, so memory holds one chunk, one object
and the fields beside the array, however long the document is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

CHUNK, MOST_HEADER = 1 << 20, 1 << 20
#: A whole string, one that the chunk cuts off, or a byte that opens, closes or names.
_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[{}\[\]:]', re.S)
_REST = re.compile(rb'(?:[^"\\]++|\\.)*+(?:"|\\?\Z)', re.S)
_WHITE = b" \t\r\n"


class BrokenDocument(ValueError):
    """Not one closed JSON object, or too much beside its array."""


def objects(f, key: str = "messages", chunk: int = CHUNK, most_header: int = MOST_HEADER) -> Iterator[tuple[int, bytes]]:
    """``(place, bytes)`` of each object in the document's own array ``key``, and at last ``(0, the document with that array empty)``.

    Raises :class:`BrokenDocument` where the document breaks off, goes on behind its end,
    closes what it did not open, or holds more than ``most_header`` bytes beside the array.
    """
    name = json.dumps(key).encode()
    stack: list[int] = []
    header: list[bytes] = []
    beside, at = 0, 0  # bytes of the header; place of the chunk
    text, pending, held = False, False, b""  # inside a string, behind its backslash, its first bytes
    word, named, inside, seen = b"", False, False, False
    parts: list[bytes] = []
    start = -1

    def keep(piece: bytes) -> None:
        nonlocal beside
        beside += len(piece)
        if beside > most_header:
            raise BrokenDocument(f"more than {most_header} bytes beside the array")
        header.append(piece)

    while data := f.read(chunk):
        pos = kept = 0  # header bytes before `kept` are stored
        if not stack and not seen and not data.lstrip(_WHITE):
            at += len(data)
            continue
        while pos < len(data):
            if text:
                if pending and pos == 0:
                    pending, pos = False, 1
                    if pos == len(data):
                        break
                m = _REST.match(data, pos)
                if len(held) < 64:
                    held += data[pos : m.end()][:64]
                pos = m.end()
                text = data[pos - 1 : pos] != b'"' or _cut(data, m.start(), pos)
                pending = text and _odd_backslashes(data, m.start(), pos)
                word = b"" if text else held
                continue
            m = _TOKEN.search(data, pos)
            gap = data[pos : m.start() if m else len(data)]
            if not stack and gap.strip(_WHITE):
                raise BrokenDocument("bytes outside the document")
            if m is None:
                break
            pos, c = m.end(), data[m.start()]
            if c == 0x22:
                text = m.group() == b'"' or data[pos - 1 : pos] != b'"' or _cut(data, m.start() + 1, pos)
                pending = text and _odd_backslashes(data, m.start() + 1, pos)
                held, word = m.group()[:64], b"" if text else m.group()
                if not stack:
                    raise BrokenDocument("bytes outside the document")
            elif c == 0x3A:
                named = len(stack) == 1 and word == name
            elif c in b"{[":
                if not stack and (seen or c != 0x7B):
                    raise BrokenDocument("not one object")
                stack.append(c)
                seen = True
                if c == 0x5B and len(stack) == 2 and named and not inside:
                    keep(data[kept:pos])
                    inside = True
                elif c == 0x7B and inside and len(stack) == 3:
                    start, parts, kept = at + m.start(), [], m.start()
                named = False
            else:
                if not stack or stack.pop() != (0x7B if c == 0x7D else 0x5B):
                    raise BrokenDocument("closes what was not opened")
                if inside and start >= 0 and len(stack) == 2 and c == 0x7D:
                    parts.append(data[kept:pos])
                    yield start, b"".join(parts)
                    start, parts = -1, []
                elif inside and len(stack) == 1 and c == 0x5D:
                    inside, kept = False, m.start()
                    name = b""  # the first such array is the one
        if inside and start >= 0:
            parts.append(data[kept:])
        elif not inside:
            keep(data[kept:])
        at += len(data)
    if stack or text or not seen:
        raise BrokenDocument("the document breaks off")
    whole = b"".join(header)
    try:
        json.loads(whole)
    except ValueError as e:
        raise BrokenDocument(f"no JSON beside the array: {e}") from None
    yield 0, whole


def _odd_backslashes(data: bytes, start: int, end: int) -> bool:
    """Whether the string goes on behind a backslash that the chunk's end cuts from what it escapes."""
    n = 0
    while end - n > start and data[end - n - 1] == 0x5C:
        n += 1
    return n % 2 == 1


def _cut(data: bytes, start: int, end: int) -> bool:
    """Whether the quote a match ends with is escaped, so the string is not over."""
    return _odd_backslashes(data, start, end - 1)
