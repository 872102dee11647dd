"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Each text, its runs of white space as one space each, is walked once by an Aho-Corasick automaton over the rules' keywords; only the rules whose
keyword occurs run. Detections are intervals of the lower-cased text. One that lies within the interval of a detection of the same or a lower rank is
suppressed (of equal intervals and ranks the earlier rule's stays): a sweep over their starts that remembers the furthest end of each rank. A mere reservation
of rights is no label in a text in which a license stands.
The base phrases are counted at every place where their words stand consecutively, suppressed or not.

Edge cases: a null or empty text has no words, no labels and score 0; a null id is carried through; repeated rows give one result row each;
columns other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table
from .license_rules import BASE, rules

#: Every ASCII byte that is no digit or small letter ends a word; texts are lower-cased before.
SEPARATORS = bytes(32 if b < 0x80 and not chr(b).isdigit() and not chr(b).islower() else b for b in range(256))

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<start: long, stop: long, label: string, rank: int, confidence: double>>"
)
DETECTION = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("rank", pa.int32()), ("confidence", pa.float64())]))
#: Runs of white space that aren't one space: keywords of several words are wrapped in texts, and patterns take any white space.
GAPS = re.compile(r"[^\S ]\s*| \s+")


#: No match of a rule with a head is longer, once runs of white space are one space.
REACH = 400


def resolve(found: list[tuple]) -> list[tuple]:
    """found: (rank, order, start, stop, label, confidence). Those that stand, in text order."""
    kept: list[tuple] = []
    furthest: dict[int, int] = {}
    for x in sorted(found, key=lambda x: (x[2], -x[3], x[0], x[1])):
        if not any(stop >= x[3] for rank, stop in furthest.items() if rank <= x[0]):
            kept.append(x)
            furthest[x[0]] = max(x[3], furthest.get(x[0], 0))
    return kept


class Spaced:
    """A text whose runs of white space are one space each; places in it are told as places of the text."""

    def __init__(self, text: str) -> None:
        self.source, self.text = text, GAPS.sub(" ", text)
        self.ends: list[int] | None = None

    def place(self, at: int) -> int:
        if len(self.text) == len(self.source):
            return at
        if self.ends is None:
            # Behind each shortened gap: its end in the spaced text, and how much has been left out so far.
            self.ends, self.left, gone = [], [], 0
            for m in GAPS.finditer(self.source):
                if (more := m.end() - m.start() - 1) > 0:
                    gone += more
                    self.ends.append(m.end() - gone)
                    self.left.append(gone)
        k = bisect_right(self.ends, at)
        return at + (self.left[k - 1] if k else 0)


class Scanner:
    """The compiled rules; one for each task."""

    def __init__(self) -> None:
        import ahocorasick

        self.rules = [(r, re.compile(r.pattern)) for r in rules()]
        self.of_key: dict[str, list[int]] = {}
        self.heads: dict[str, re.Pattern] = {}
        for i, (r, _) in enumerate(self.rules):
            self.of_key.setdefault(r.keyword, []).append(i)
            if r.head:
                self.heads[r.head] = re.compile(r.head)
        self.keys = ahocorasick.Automaton()
        for key in {*self.of_key, *(phrase.split()[-1] for phrase in BASE)}:
            self.keys.add_word(key, key)
        self.keys.make_automaton()
        self.base = [(phrase.split()[-1], label, re.compile(rb"(?<!\S)" + rb" +".join(phrase.encode().split()) + rb"(?!\S)")) for phrase, label in BASE.items()]

    def detections(self, spaced: Spaced, keys: set[str]) -> list[tuple]:
        text, found, headed = spaced.text, [], {}
        for i in sorted(i for key in keys for i in self.of_key.get(key, ())):
            r, pattern = self.rules[i]
            if r.head:
                headed.setdefault(r.head, []).append(i)
            else:
                found += [(i, m) for m in pattern.finditer(text)]
        for head, members in headed.items():
            for at in self.heads[head].finditer(text):
                near = text[at.start() : at.start() + REACH]
                for i in members:
                    r, pattern = self.rules[i]
                    if r.keyword in near and (m := pattern.match(text, at.start())):
                        found.append((i, m))
        place, kept = spaced.place, []
        for i, m in found:
            r, _ = self.rules[i]
            start, stop = m.span("at" if "at" in m.re.groupindex else 0)
            kept.append((r.rank, i, place(start), place(stop - 1) + 1, r.label, r.confidence))
        stand = resolve(kept)
        granted = any(not self.rules[x[1]][0].alone for x in stand)
        return [x for x in stand if not granted or not self.rules[x[1]][0].alone]

    def scan(self, text: str | None) -> tuple:
        low = (text or "").encode().lower()
        spaced = low.translate(SEPARATORS)
        plain = low.decode()
        flat = Spaced(plain)
        keys = {key for _, key in self.keys.iter(flat.text)}
        places = sorted((m.start(), label) for key, label, pattern in self.base if key in keys for m in pattern.finditer(spaced))
        words, at, seen = [], 0, 0
        for start, _ in places:
            seen, at = seen + len(spaced[at:start].split()), start
            words.append(seen)
        n_words = seen + len(spaced[at:].split())
        found = self.detections(flat, keys) if keys else []
        base = {label for _, label in places}
        return n_words, words, base, base | {x[4] for x in found}, max([0.0, *(0.8 for _ in places[:1]), *(x[5] for x in found)]), found


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: words, base places, labels, score and the detections that stand after suppression (offsets in code points)."""

    def make():
        scanner = Scanner()

        def step(batch: pa.RecordBatch) -> dict:
            rows = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            long = lambda xs: pa.array(xs, pa.int64())
            return {
                "doc_id": batch.column("doc_id"),
                "n_words": long([r[0] for r in rows]),
                "n_base": long([len(r[1]) for r in rows]),
                "first_word": long([min(r[1], default=None) for r in rows]),
                "last_word": long([max(r[1], default=None) for r in rows]),
                "base_labels": pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                "labels": pa.array([",".join(sorted(r[3])) for r in rows], pa.string()),
                "score": pa.array([r[4] for r in rows], pa.float64()),
                "detections": pa.array([[{"start": x[2], "stop": x[3], "label": x[4], "rank": x[0], "confidence": x[5]} for x in r[5]] for r in rows], DETECTION),
            }

        return step

    return map_texts(df, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")], "text", SCHEMA, make)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_detections", F.size("detections").cast("long")).drop("detections")


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL: dict[str, str] = {}
