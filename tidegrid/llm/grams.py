"""Words of whole slices of texts as 64-bit hashes with their places, for operators that choose which bytes part words.

Words are runs of bytes outside a set of ASCII bytes, so cutting UTF-8 text at bytes cuts it at characters. A word's hash is that of shingles.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import mix, powers

#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20


def byte_set(*ranges: int | tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: the bytes given singly or as ranges whose ends belong to them."""
    out = np.zeros(256, bool)
    for r in ranges:
        low, high = r if isinstance(r, tuple) else (r, r)
        out[low : high + 1] = True
    return out


def words_of(data: bytes, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of data; `breaks` flags the bytes that part words."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not breaks[data[end]]:
            end += 1
        parts.append([x + (at if k else 0) for k, x in enumerate(_words(np.frombuffer(data, np.uint8, end - at, at), breaks))])
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else tuple(parts[0])


def _words(raw: np.ndarray, breaks: np.ndarray) -> list[np.ndarray]:
    inside = ~breaks[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.zeros(0, np.uint64), starts, ends]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    index = np.arange(sizes.sum()) - np.repeat(first, sizes)
    terms = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[index]
    return [mix(np.add.reduceat(terms, first)), starts, ends]


def split_at(text: bytes, breaks: np.ndarray, most: int = BLOCK) -> Iterator[bytes]:
    """A text in parts of about `most` bytes, cut only right after bytes that `breaks` flags; longer where none comes."""
    at = 0
    while len(text) - at > most:
        tail = np.frombuffer(text, np.uint8, most, at)
        found = np.flatnonzero(breaks[tail])
        end = at + int(found[-1]) + 1 if len(found) else 0
        look = at + most
        while not end and look < len(text):
            found = np.flatnonzero(breaks[np.frombuffer(text, np.uint8, min(most, len(text) - look), look)])
            end, look = (look + int(found[0]) + 1 if len(found) else 0), look + most
        if not end:
            break
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]
