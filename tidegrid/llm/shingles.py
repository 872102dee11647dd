"""Word and shingle hashes in numpy: whole slices of texts at a time, 64 bits each.

A word's hash is a polynomial of its bytes modulo 2 ** 64, mixed; a shingle's is a weighted sum of its words' hashes, mixed again.
"""

from __future__ import annotations

import numpy as np

#: Texts are hashed in blocks of about this many bytes, cut at white space, so that one long text needs no more memory than its word hashes.
BLOCK = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
BASE, K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits of x (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * K1
    x = (x ^ (x >> np.uint64(27))) * K2
    return x ^ (x >> np.uint64(31))


#: Odd weights of the places within a run of words, unrelated to one another.
WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64) * BASE) | np.uint64(1)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 64), BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of each word of data, words being runs without ASCII white space."""
    if len(data) <= 2 * BLOCK:
        return _hash_block(data)
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not WHITE[data[end]]:
            end += 1
        h, p = _hash_block(data[at:end])
        hashes.append(h)
        places.append(p + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    inside = ~WHITE[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[index]
    return mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes)), starts


def texts_words(texts: list[str | None]) -> list[np.ndarray]:
    """For each text, its words' hashes in order; A-Z count as a-z."""
    data = [(t or "").encode().lower() for t in texts]
    hashes, places = word_hashes(b" ".join(data))
    ends = np.cumsum([len(d) + 1 for d in data])
    return np.split(hashes, np.searchsorted(places, ends[:-1]))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of runs of so many words; of the whole sequence if it is shorter; empty without words."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * WEIGHTS[i]
    return np.unique(mix(out))
