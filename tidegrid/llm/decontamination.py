"""Benchmark decontamination by spaced seeds, verified to be substitution-tolerant overlaps.

Words are runs of letters, digits and bytes over 127, A-Z as a-z. Each mask names places within a run of words and ignores the others, so words
replaced at ignored places leave the seed's hash as it is. The seeds of the benchmark are joined to those of each document: a hit puts an item and a
document on one diagonal, on which any segment must have `least` equal words, or all of a shorter item's, and substitutions in a fifth of its words
at most; of those segments the one of most equal words is given. Every such segment of eight equal words or more is hit by one of the masks.

The benchmark is the stated query set: its words go to the tasks in blocks of BLOCK_WORDS (4 MB, some 50 MB as tables in a task), each block meets
all documents in a pass that shuffles nothing. A table of bits sorts out most seeds before they are looked up; hits are verified in bounded portions.

Edge cases: null and empty texts overlap with nothing; items of fewer words than a seed names (five) are found where all their words stand; null ids are
carried through;
repeated documents give rows of their own; repeated items are items of their own; an empty table on either side gives no overlaps; columns that
aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, short_batches, slices, table
from .shingles import WEIGHTS, mix, word_hashes

#: 1: the word counts, 0: it is ignored. Every mask names five words.
MASKS = ("11111", "111011", "110111", "1101101", "1011011", "11001011", "10101101", "1100010011")
#: Items of fewer than five words are found by their whole sequence.
WHOLE = ("1", "11", "111", "1111")
LEAST = 8
BLOCK_WORDS = 500_000
BITS = 22
PORTION = 1 << 15
#: Words of diagonals that are compared at a time.
CELLS = 1 << 18
#: Stands for a null item_id within a block.
NO_ID = -(1 << 63)
WORDS = bytes(32 if b < 0x80 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 0x80 else b for b in range(256))

PAIRS = "doc_id long, item_id long, n_places long, matched long, overlap_words long, doc_word long, item_word long, item_share double"


def seeds_of(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the seed that starts at each word, as far as the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2)), np.uint64)
    for k, i in enumerate(i for i, c in enumerate(mask) if c == "1"):
        out += words[i : i + n] * WEIGHTS[k]
    return mix(out)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and where each text's begin (and the last one's end)."""
    data = [(t or "").encode().translate(WORDS) for t in texts]
    hashes, places = word_hashes(b" ".join(data))
    return hashes, np.r_[0, np.searchsorted(places, np.cumsum([len(d) + 1 for d in data]))].astype(np.int64)


class Block:
    """The seed tables of some items; one for each task. words: all items' in a row; starts: where each begins, and the end."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, starts: np.ndarray, least: int) -> None:
        self.ids, self.words, self.starts, self.least = ids, words, starts, least
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        keys, places = [], []
        for mask in MASKS:
            s = seeds_of(words, mask)
            inside = np.flatnonzero(owner[: len(s)] == owner[len(mask) - 1 : len(mask) - 1 + len(s)])
            keys.append(s[inside])
            places.append(inside)
        sizes, self.masks = np.diff(starts), MASKS
        for mask in WHOLE:
            whole = starts[:-1][sizes == len(mask)]
            if len(whole):
                self.masks = (*self.masks, mask)
                keys.append(seeds_of(words, mask)[whole])
                places.append(whole)
        keys, places = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(keys, kind="stable")
        self.owner, self.keys, self.places = owner, keys[order], places[order]
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[keys >> np.uint64(64 - BITS)] = True

    def diagonals(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Portions of distinct (text, item, document word less item word) that hits give."""
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for mask in self.masks:
            s = seeds_of(words, mask)
            near = np.flatnonzero(self.bits[s >> np.uint64(64 - BITS)])
            near = near[text[near] == text[near + len(mask) - 1]]
            low, high = np.searchsorted(self.keys, s[near]), np.searchsorted(self.keys, s[near], "right")
            near, low, count = near[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(count)
            at = 0
            while at < len(near):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION)))
                n = count[at:stop]
                place = self.places[np.repeat(low[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                here = np.repeat(near[at:stop], n)
                yield text[here], self.owner[place], here - place
                at = stop

    def overlaps(self, words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """text, item, equal words, length, document word, item word of the segment of most equal words of every diagonal that has an overlap."""
        found = [np.zeros((0, 6), np.int64)]
        for text, item, shift in self.diagonals(words, starts):
            found.append(self._verify(words, starts, *np.unique(np.c_[text, item, shift], axis=0).T))
        return list(np.unique(np.concatenate(found), axis=0).T)

    def _verify(self, words: np.ndarray, starts: np.ndarray, text: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """What `overlaps` gives of some diagonals, CELLS words of them at a time (or one longer diagonal, no longer than its text or its item)."""
        begin = np.maximum(self.starts[item], starts[text] - shift)
        size = np.minimum(self.starts[item + 1], starts[text + 1] - shift) - begin
        ends = np.cumsum(size + 1)
        out, a = [np.zeros((0, 6), np.int64)], 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
            out.append(self._segments(words, starts, *(x[a:b] for x in (text, item, shift, begin, size))))
            a = b
        return np.concatenate(out)

    def _segments(self, words: np.ndarray, starts: np.ndarray, text: np.ndarray, item: np.ndarray, shift: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        least = np.minimum(self.least, self.starts[item + 1] - self.starts[item])
        place = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        equal = self.words[place] == words[place + np.repeat(shift, size)]
        # Chance hits with too few equal words on the whole diagonal go before the sums.
        enough = np.add.reduceat(equal, np.cumsum(size) - size, dtype=np.int64) >= least
        if not enough.any():
            return np.zeros((0, 6), np.int64)
        equal = equal[np.repeat(enough, size)]
        text, item, shift, begin, size, least = (x[enough] for x in (text, item, shift, begin, size, least))
        # All diagonals in a row, each with one place more than it has words: what the words before the place sum up to.
        heads = np.cumsum(size + 1) - size - 1
        row = np.repeat(np.arange(len(size)), size + 1)
        inside = np.ones(len(row), bool)
        inside[heads] = False
        said = np.zeros(len(row), bool)
        said[inside] = equal
        total = np.cumsum(np.where(inside, np.where(said, 1, -4), 0))
        total -= total[heads][row]
        held = np.cumsum(said)
        # A segment qualifies if its sum is 0 at least. For each end, the first start whose sum is no higher holds the most equal words.
        apart = row * (int(total.max()) - int(total.min()) + 1)
        first = np.searchsorted(-np.minimum.accumulate(total - apart), apart - total)
        matched = held - held[first]
        # Substitutions in front are left out; of the ends of most equal words the one of fewest substitutions counts, then the earliest.
        at = np.arange(len(row))
        after = np.minimum.accumulate(np.where(np.r_[said[1:], False], at, len(row))[::-1])[::-1]
        first = np.minimum(after[first], at)
        score = matched * (len(row) + 1) - (at - first)
        tops = np.flatnonzero(score == np.maximum.reduceat(score, heads)[row])
        best = tops[np.searchsorted(tops, heads)]
        first, matched = first[best], matched[best]
        start = begin + first - heads
        return np.c_[text, item, matched, best - first, start + shift - starts[text], start - self.starts[item]][matched >= least]


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, words and starts of the benchmark's items, BLOCK_WORDS or one item at a time."""
    ids: list = []
    parts: list = []
    held = 0
    for item, text in benchmark.select(F.col(id_col).cast("long"), text_col).orderBy(id_col, text_col).toLocalIterator():
        words, _ = joined([text])
        if ids and held + len(words) > BLOCK_WORDS:
            yield np.array(ids, np.int64), np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
            ids, parts, held = [], [], 0
        ids.append(NO_ID if item is None else item)
        parts.append(words)
        held += len(words)
    if ids and held:
        yield np.array(ids, np.int64), np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


def overlaps(df: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each document and item that overlap: the places, and the longest overlap. df: doc_id, text; benchmark: item_id, text."""
    spark = df.sparkSession
    out = spark.createDataFrame([], PAIRS)
    for k, content in enumerate(benchmark_blocks(benchmark)):
        sent = spark.sparkContext.broadcast(content)

        def make(sent=sent):
            block = Block(*sent.value, least)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                text, item, matched, length, word, start = block.overlaps(*joined(batch.column("text").to_pylist()))
                order = np.lexsort((word, -matched, item, text))
                text, item = text[order], item[order]
                first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]) if len(text) else order
                pick = order[first]
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(text[first])),
                    "item_id": pa.array(block.ids[item[first]], pa.int64(), mask=block.ids[item[first]] == NO_ID),
                    "n_places": pa.array(np.diff(np.r_[first, len(text)])),
                    "matched": pa.array(matched[pick]),
                    "overlap_words": pa.array(length[pick]),
                    "doc_word": pa.array(word[pick]),
                    "item_word": pa.array(start[pick]),
                    "item_share": pa.array(matched[pick] / np.diff(block.starts)[item[first]]),
                }
                return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

            return step

        found = map_texts(df, [F.col("doc_id").cast("long").alias("doc_id"), "text"], "text", PAIRS, make)
        out = found if not k else out.unionByName(found)
    return out


def clean(df: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of df, all its columns, whose text overlaps with no item."""
    for content in benchmark_blocks(benchmark):
        sent = df.sparkSession.sparkContext.broadcast(content)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Block(*sent.value, least)
            for piece in slices(batches, "text"):
                hit = block.overlaps(*joined(piece.column("text").to_pylist()))[0]
                keep = np.ones(piece.num_rows, bool)
                keep[hit] = False
                yield piece.filter(pa.array(keep))

        df = short_batches(df).mapInArrow(task, df.schema)
    return df


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE_SQL: dict[str, str] = {}
