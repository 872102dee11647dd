"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text's paragraphs are its lines. A section ends behind an empty paragraph or where a paragraph's hash says so, so an insertion moves no other
section's ends. A paragraph's hash is of its bytes, a section's of its paragraphs' hashes, the root's of its sections' hashes, each kind of node under
a prefix of its own: equal roots, equal texts; differing branches locate edits. Below the paragraphs stand phrases, runs of words that end where a
word's hash says so; each gives a tag of 24 bits. A fingerprint is the root, then the sections (/), their paragraphs (.) and these' phrases, all by
shortened hashes, so the likeness of two fingerprints needs no text.

A fingerprint has 33 characters for the root, 9 for a section, 9 for a paragraph and 4 for a phrase, at most; equal neighbours among the paragraphs of a
section, and among sections, are told once with their number. So it has fewer than 14 characters for each byte of a text and one more, and 33: the most is for lines of
one letter between empty ones, each unlike the next. Of prose it is a sixth of the text; of line ends alone it is some 60 characters.

Likeness descends the two trees together. Equal sections, in order, count whole; between them equal paragraphs do; only between those are phrases
compared. A paragraph weighs one more than its phrases; the likeness is the weight found in both over the weight of the heavier tree. What has moved
counts on one side of the move only, so the likeness of different texts is below 1.

Neighbours. Rows are dealt into ranges of ids, read from quantiles of the ids, and sorted within them, so the texts move once; each range also gets
the first text of the next one. An id that fills whole ranges is dealt into them by a hash of the text. A task holds one row and its successor at a time.

Edge cases: null texts count as empty; the empty text has no paragraphs and a fingerprint of its own, likeness 1 to itself and 0 to any other; rows
with a null id come first; rows with equal ids are ordered by a hash of their texts, then by these; a single row is its own next; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, slices, table
from .shingles import mix, word_hashes

#: A phrase has at least so many words, then ends at a word whose hash modulo SPLIT is 0, and at LONGEST words in any case.
LEAST, SPLIT, LONGEST = 3, 4, 32
SECTION = 4
LOWEST = -(1 << 63)


#: What stands before the bytes that a node's hash is of.
LEAF, INNER, ROOT = b"\0", b"\1", b"\2"
#: Bytes of a section's and a paragraph's hash that a fingerprint keeps, and of a phrase's tag.
SHORT, TAG = 6, 3

Paragraph = tuple[bytes, bytes]
Section = tuple[bytes, list[Paragraph]]


def digest(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(kind + data, digest_size=16).digest()


def phrase_tags(paragraphs: list[bytes]) -> list[bytes]:
    """For each paragraph, three bytes for each of its phrases."""
    words, places = word_hashes(b"\n".join(paragraphs))
    if not len(words):
        return [b""] * len(paragraphs)
    lasts = np.searchsorted(places, np.cumsum([len(p) + 1 for p in paragraphs])).tolist()
    stops = (np.flatnonzero(words % np.uint64(SPLIT) == 0) + 1).tolist()
    ends, phrases, at, k = [], [], 0, 0
    for last in lasts:
        while at < last:
            while k < len(stops) and stops[k] < at + LEAST:
                k += 1
            at = min(stops[k] if k < len(stops) else last, at + LONGEST, last)
            ends.append(at)
        phrases.append(len(ends))
    starts = np.array([0, *ends[:-1]])
    place = np.arange(len(words)) - np.repeat(starts, np.diff(np.r_[starts, len(words)]))
    tags = mix(np.add.reduceat(words * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), starts)).view(np.uint8).reshape(-1, 8)[:, :3].tobytes()
    return [tags[3 * i : 3 * j] for i, j in zip([0, *phrases], phrases)]


class Tree:
    """root; branches: the sections (shortened hash, paragraphs), these' paragraphs (shortened hash, phrase tags). What an earlier tree has of the first
    paragraphs is taken over."""

    def __init__(self, text: str, earlier: Tree | None = None, same: int = 0) -> None:
        lines = text.encode().split(b"\n") if text else []
        new = lines[same:]
        self.leaves = [*(earlier.leaves[:same] if earlier else []), *zip([digest(LEAF, x) for x in new], phrase_tags(new))]
        sections: list[list[Paragraph]] = [[]]
        for line, leaf in zip(lines, self.leaves):
            sections[-1].append(leaf)
            if leaf[0][0] % SECTION == 0 or not line.strip():
                sections.append([])
        if not sections[-1]:
            sections.pop()
        hashes = [digest(INNER, b"".join([h for h, _ in s])) for s in sections]
        self.root = digest(ROOT, b"".join(hashes))
        self.branches: list[Section] = [(h[:SHORT], [(p[:SHORT], tags) for p, tags in s]) for h, s in zip(hashes, sections)]

    def fingerprint(self) -> str:
        return self.root.hex() + ":" + "/".join(runs(map(of_section, self.branches), "!"))


def of_section(section: Section) -> str:
    return ".".join([coded(section[0]), *runs([coded(p + tags) for p, tags in section[1]], "~")])


def runs(items: Iterable[str], mark: str) -> list[str]:
    """Equal neighbours as one item with the mark and their number: empty lines and lines repeated take no more than one."""
    held = [(item, sum(1 for _ in same)) for item, same in groupby(items)]
    return [item if n == 1 else f"{item}{mark}{n}" for item, n in held]


def spread(items: list[str], mark: str) -> Iterator[str]:
    for item in items:
        one, _, n = item.partition(mark)
        yield from repeat(one, int(n or 1))


def coded(data: bytes) -> str:
    """Four characters for three bytes, neither of the marks among them."""
    return base64.urlsafe_b64encode(data).decode()


def branches_of(fingerprint: str) -> list[Section]:
    """What a fingerprint says of its tree."""
    sections = fingerprint.partition(":")[2]
    parts = [[base64.urlsafe_b64decode(x) for x in spread(s.split("."), "~")] for s in spread(sections.split("/"), "!")] if sections else []
    return [(s[0], [(p[:SHORT], p[SHORT:]) for p in s[1:]]) for s in parts]


def aligned(x: list[bytes], y: list[bytes]) -> list[tuple[int, int]]:
    """The places of equal items in both, in order: equal beginnings and ends, and between them as many as go in order of those that both have, the
    first of an item's places with the first, the second with the second."""
    top, low = min(len(x), len(y)), 0
    while low < top and x[low] == y[low]:
        low += 1
    high = 0
    while high < top - low and x[-1 - high] == y[-1 - high]:
        high += 1
    ends = [(len(x) - k, len(y) - k) for k in range(high, 0, -1)]
    found = [(i, i) for i in range(low)]
    mid_x, mid_y = x[low : len(x) - high], y[low : len(y) - high]
    if set(mid_x).isdisjoint(mid_y):
        return found + ends
    places = defaultdict(list)
    for j in range(len(mid_y) - 1, -1, -1):
        places[mid_y[j]].append(j)
    # The longest rising run of the places in y, by the least last place of runs of each length.
    lasts, chain = [], []
    for i, item in enumerate(mid_x):
        if at := places.get(item):
            j = at.pop()
            k = bisect_left(lasts, j)
            lasts[k : k + 1] = [j]
            chain.append((i, j, k))
    run, k = [], len(lasts) - 1
    for i, j, at in reversed(chain):
        if at == k and (not run or j < run[-1][1] - low):
            run.append((i + low, j + low))
            k -= 1
    return found + run[::-1] + ends


def gaps(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """What stands between the aligned places: start and stop of either side."""
    i = j = 0
    for a, b in [*pairs, (n, m)]:
        if a > i or b > j:
            yield i, a, j, b
        i, j = a + 1, b + 1


def weight(branches: list[Section]) -> int:
    return sum([1 + len(tags) // TAG for _, s in branches for _, tags in s])


def tags_in(paragraphs: list[Paragraph]) -> list[bytes]:
    tags = b"".join([t for _, t in paragraphs])
    return [tags[k : k + TAG] for k in range(0, len(tags), TAG)]


def shared(a: list[Section], b: list[Section]) -> int:
    """The weight that two trees have in common."""
    pairs = aligned([h for h, _ in a], [h for h, _ in b])
    held = weight([a[i] for i, _ in pairs])
    for i, k, j, n in gaps(pairs, len(a), len(b)):
        x, y = ([p for _, s in part for p in s] for part in (a[i:k], b[j:n]))
        same = aligned([h for h, _ in x], [h for h, _ in y])
        held += sum([1 + len(x[at][1]) // TAG for at, _ in same])
        for at, to, on, off in gaps(same, len(x), len(y)):
            held += len(aligned(tags_in(x[at:to]), tags_in(y[on:off])))
    return held


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1; 1 for equal roots alone."""
    return 1.0 if a[:32] == b[:32] else ratio(branches_of(a), branches_of(b))


def ratio(a: list[Section], b: list[Section]) -> float:
    most = max(weight(a), weight(b))
    return shared(a, b) / most if most else 0.0


def edits(a: list[Section], b: list[Section]) -> list[tuple[int, int]]:
    """The (section, paragraph) places of a that have no equal in b, in order: equal sections are passed over whole."""
    out: list[tuple[int, int]] = []
    for i, k, j, n in gaps(aligned([h for h, _ in a], [h for h, _ in b]), len(a), len(b)):
        places = [(at, q) for at in range(i, k) for q in range(len(a[at][1]))]
        same = aligned([a[at][1][q][0] for at, q in places], [h for _, s in b[j:n] for h, _ in s])
        held = {p for p, _ in same}
        out += [place for p, place in enumerate(places) if p not in held]
    return out


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections long, n_paragraphs long"
)


def neighbours(df: DataFrame, ranges: int) -> DataFrame:
    """range, borrowed, key, tie, id, text: each range's rows, and after them (borrowed) the first row of the range after it. As tables of as many rows
    as there are ranges, the ranges' ends and first rows pass through the driver."""
    text = F.coalesce("text", F.lit(""))
    rows = df.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), F.xxhash64(text).alias("tie"), "doc_id", text.alias("text"))
    cuts = rows.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    # Ids that fill ranges (whole numbers that a double holds): as many parts of the hash's range each.
    many = {int(c): n for c, n in Counter(cuts).items() if n > 1 and (abs(c) < 1 << 53 or c == LOWEST)}
    if cuts:
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        rows = Bucketizer(splits=splits, inputCol="at", outputCol="bucket").transform(rows.withColumn("at", F.col("key").cast("double")))
    else:
        rows = rows.withColumns({"at": F.lit(0.0), "bucket": F.lit(0.0)})
    # Each bucket has room for as many parts as any id, in front of the bucket's other ids: an id that is a cut is the lowest of its bucket.
    room = max(many.values(), default=0) + 1
    parts = df.sparkSession.createDataFrame(list(many.items()), "key long, parts int")
    rows = rows.join(F.broadcast(parts), "key", "left") if many else rows.withColumn("parts", F.lit(None).cast("int"))
    part = F.coalesce(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("parts")), F.lit(room - 1))
    rows = rows.withColumn("range", F.col("bucket").cast("long") * room + part.cast("long")).drop("at", "bucket", "parts")
    lows = rows.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("low")).orderBy("range").collect()
    rows = rows.withColumn("borrowed", F.lit(False))
    if not lows:
        return rows
    takers = [(r["low"]["key"], r["low"]["tie"], lows[i - 1]["range"]) for i, r in enumerate(lows)]
    to = df.sparkSession.createDataFrame(takers, "key long, tie long, taker long")
    heads = rows.join(F.broadcast(to), ["key", "tie"]).groupBy("key", "tie", "taker").agg(F.min(F.struct("text", "doc_id")).alias("head"))
    heads = heads.select("key", "tie", F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), F.col("taker").alias("range"), F.lit(True).alias("borrowed"))
    return rows.unionByName(heads)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (the last quarter replaced by the start of the next text), and their likenesses."""
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = neighbours(df, 4 * tasks).repartitionByRange(tasks, "range").sortWithinPartitions("range", "borrowed", "key", "tie", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in slices(batches, "text"):
            out = []
            for place, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "borrowed", "doc_id", "text"))):
                tree = Tree(text)
                new = (place, doc_id, text, tree, tree.fingerprint())
                if held and held[0] == place:
                    out.append(row(held, new))
                held = None if borrowed else new
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    return short_batches(dealt.select("range", "borrowed", "doc_id", "text")).mapInArrow(task, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def row(one: tuple, after: tuple) -> tuple:
    _, doc_id, text, tree, mark = one
    cut = len(text) // 4
    edited = text[: len(text) - cut] + after[2][:cut]
    other = Tree(edited, tree, text.count("\n", 0, len(text) - cut))
    sha = hashlib.sha256(edited.encode()).hexdigest()
    near = [1.0 if x.root == tree.root else ratio(tree.branches, x.branches) for x in (other, after[3])]
    return doc_id, len(text), sha, mark, other.fingerprint(), *near, len(tree.branches), len(tree.leaves)


def op5_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op5_merkle_fingerprints": op5_merkle_fingerprints}
ORACLE_SQL: dict[str, str] = {}
