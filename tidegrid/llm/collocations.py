"""Phrase collocations: merged count-min sketches choose what is worth counting, a second pass counts it exactly, scores and subsumption follow.

First pass. Each task keeps one count-min sketch of two lines and adds every word and every run of up to `longest` words to it, by language. The sketches are
cut into chunks and summed over all tasks, and what remains of a counter is one bit: whether it reached `least`. A counter is never less than what any
phrase behind it occurs, so every phrase that occurs often enough has both bits. Counters saturate, which can't take a bit away.
The number of counters follows the bytes of the texts up to 2 ** MOST_BITS; more text than that makes the filter let more through and changes no result.
Both passes run in at most twice as many tasks as there are cores: sketches, and counts that tasks write, don't grow in number with the partitions.

Second pass. A phrase survives if its bits and those of all its parts are set. A task counts its survivors by 64-bit hashes, writes each with its words, and
Spark sums these up; those below `least` go. Counts of all candidates and of their parts are thus exact.
Scores come from joins on language and phrase, all in decimals of 38 places. The best of each language are found by counting scores in buckets first,
so that no task gets all candidates of a language.

Edge cases: null texts are empty, null languages are `und`; a text or piece without words counts nothing; equal rows count each; an empty table gives an
empty result; other columns are ignored. Pieces are read in blocks, a longer one whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, short_batches, slices, table
from .grams import BLOCK, byte_set, split_at, words_of
from .shingles import WEIGHTS, mix

#: Bytes that end a piece, and those that part words.
PIECES = byte_set(*b".,;:!?", (0x0A, 0x0D))
BREAKS = PIECES | byte_set(0x20, 0x09)
#: Counters of a line of the sketch as powers of two, bytes of text for each counter, and counters of a chunk.
LEAST_BITS, MOST_BITS, BYTES_PER_COUNTER, CHUNK = 16, 28, 16, 1 << 16
#: Different phrases that a task counts before it writes them (some 150 MB), and rows of a batch that it writes.
HELD, WRITTEN = 1_000_000, 50_000
#: The most a score can be, and the width of the buckets that scores are counted in.
SCALE, BUCKET = 2_000_000, 100


class Words:
    """A block of pieces: its words' hashes, places, pieces and languages."""

    def __init__(self, parts: list[bytes], langs: list[str]) -> None:
        self.data = b"\n".join(parts)
        self.langs = langs
        raw = np.frombuffer(self.data, np.uint8)
        self.hashes, self.starts, self.ends = words_of(self.data, BREAKS)
        self.piece = np.cumsum(PIECES[raw])[self.starts] if len(raw) else self.starts
        self.row = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), self.starts, side="right")
        salts, _, _ = words_of("\n".join(x.encode().hex() or "0" for x in langs).encode(), PIECES)
        self.salt = salts[self.row]

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the run of `size` words at each word, and whether there is one in its piece."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = self.salt[:n] + np.uint64(size)
        for k in range(size):
            out += self.hashes[k : k + n] * WEIGHTS[k]
        return mix(out), self.piece[:n] == self.piece[size - 1 :]

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.data[self.starts[k] : self.ends[k]] for k in range(at, at + size)).decode()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The texts of Arrow batches as blocks of about BLOCK bytes, cut between pieces."""
    parts, langs, held = [], [], 0
    for batch in slices(batches, "text"):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            for part in split_at((text or "").encode().lower(), PIECES):
                if held and held + len(part) > BLOCK:
                    yield Words(parts, langs)
                    parts, langs, held = [], [], 0
                parts.append(part)
                langs.append(lang)
                held += len(part)
    if parts:
        yield Words(parts, langs)


def places(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """A gram's counter in each line of the sketch."""
    shift = np.uint64(64 - bits)
    return [grams >> shift, mix(grams ^ WEIGHTS[0]) >> shift]


def add(line: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
    """Add to the counters, which stop at the most that their type holds."""
    order = np.argsort(at)
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    at, most = at[first], np.iinfo(line.dtype).max
    line[at] = np.minimum(line[at].astype(np.int64) + np.add.reduceat(counts[order], first), most)


def sketch_bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(size // BYTES_PER_COUNTER).bit_length()))


def sketches(docs: DataFrame, bits: int, least: int, longest: int) -> DataFrame:
    """line, chunk, counters: the chunks that are not empty of each task's sketch."""
    kind = np.uint8 if least <= 255 else np.uint32

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = np.zeros((2, 1 << bits), kind)
        for words in blocks(batches):
            runs = [grams[whole] for grams, whole in (words.grams(k) for k in range(1, longest + 1))]
            grams, counts = np.unique(np.concatenate(runs), return_counts=True)
            if len(grams):
                for line, at in zip(lines, places(grams, bits)):
                    add(line, at, counts)
        for k, line in enumerate(lines):
            for chunk, part in enumerate(line.reshape(-1, CHUNK)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([chunk]), pa.array([part.tobytes()], pa.binary())], names=["line", "chunk", "counters"])

    return few_tasks(docs).mapInArrow(task, "line long, chunk long, counters binary")


def merged(parts: DataFrame, least: int) -> DataFrame:
    """line, chunk, bits: which counters reach `least` once the sketches of all tasks are summed up, one chunk at a time."""
    kind = np.uint8 if least <= 255 else np.uint32

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(CHUNK, np.int64)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([np.packbits(held >= least).tobytes()], pa.binary())], names=["line", "chunk", "bits"])

        for batch in batches:
            for line, chunk, counters in zip(*(batch.column(c) for c in ("line", "chunk", "counters"))):
                now = (line.as_py(), chunk.as_py())
                if now != key:
                    if key is not None and (held >= least).any():
                        yield bits()
                    key, held = now, np.zeros(CHUNK, np.int64)
                held += np.frombuffer(counters.as_buffer(), kind)
        if key is not None and (held >= least).any():
            yield bits()

    sorted_parts = parts.repartition("line", "chunk").sortWithinPartitions("line", "chunk")
    return sorted_parts.mapInArrow(task, "line long, chunk long, bits binary")


def frequent_bits(docs: DataFrame, least: int, longest: int, bits: int) -> np.ndarray:
    """The two lines of bits of the merged sketch, at most 2 ** MOST_BITS each (32 MB)."""
    out = np.zeros((2, 1 << bits >> 3), np.uint8)
    step = CHUNK >> 3
    for row in merged(sketches(docs, bits, least, longest), least).toLocalIterator():
        out[row["line"], row["chunk"] * step : (row["chunk"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return out


class Held:
    """What a task has counted: different grams by hash, with their language, length and words."""

    def __init__(self) -> None:
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.names: list[tuple[str, int, str]] = []

    def add(self, words: Words, size: int, at: np.ndarray, grams: np.ndarray) -> None:
        found, first, counts = np.unique(grams, return_index=True, return_counts=True)
        spot = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == found[inside]
        self.counts[self.ids[spot[known]]] += counts[known]
        new = ~known
        ids = np.arange(len(self.names), len(self.names) + int(new.sum()))
        self.names += [(words.langs[words.row[k]], size, words.phrase(k, size)) for k in at[first[new]].tolist()]
        self.counts = np.concatenate([self.counts, counts[new]])
        self.keys, self.ids = np.insert(self.keys, spot[new], found[new]), np.insert(self.ids, spot[new], ids)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.names), WRITTEN):
            yield counted(self.names[k : k + WRITTEN], self.counts[k : k + WRITTEN])


def counted(names: list[tuple[str, int, str]], counts: np.ndarray) -> pa.RecordBatch:
    langs, sizes, phrases = zip(*names) if names else ((), (), ())
    columns = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "a"])


def few_tasks(docs: DataFrame) -> DataFrame:
    """docs in at most twice as many tasks as there are cores: what a task sums up before it writes then doesn't grow in number with the partitions."""
    return short_batches(docs.coalesce(max(8, 2 * docs.sparkSession.sparkContext.defaultParallelism)))


def exact_counts(docs: DataFrame, alive: np.ndarray, bits: int, least: int, longest: int) -> DataFrame:
    """lang, size, phrase, a: the words and runs that occur `least` times or more; of size 0, all words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(alive)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, held, total = shared.value, Held(), {}
        for words in blocks(batches):
            for row, n in zip(*np.unique(words.row, return_counts=True)):
                total[words.langs[row]] = total.get(words.langs[row], 0) + int(n)
            before = None
            for size in range(1, longest + 1):
                grams, live = words.grams(size)
                if before is not None:
                    live &= before[: len(live)] & before[1 : 1 + len(live)]
                at = np.flatnonzero(live)
                for line, place in zip(lines, places(grams[at], bits)):
                    ok = (line[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1
                    live[at[ok == 0]] = False
                at = np.flatnonzero(live)
                if not len(at):
                    break
                held.add(words, size, at, grams[at])
                before = live
            if len(held.keys) > HELD:
                yield from held.batches()
                held = Held()
        yield from held.batches()
        yield counted([(lang, 0, "") for lang in total], np.array(list(total.values()), np.int64))

    return few_tasks(docs).mapInArrow(task, "lang string, size int, phrase string, a long").groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("size") == 0))


def part_of(words: str, start, size) -> "F.Column":
    return F.array_join(F.slice(words, start, size), " ")


def wide(name: str) -> "F.Column":
    return F.col(name).cast("decimal(38,0)")


def score_phrases(counts: DataFrame, longest: int) -> DataFrame:
    """lang, size, phrase, a, l, r, score of each candidate: its lowest-scoring cut, of equal ones that after the fewest words."""
    phrases = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": part_of("words", F.lit(1), F.col("cut")), "right": part_of("words", F.col("cut") + 1, F.col("size") - F.col("cut"))})
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")).where("left <> ''")
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")).where("right <> ''")
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    both = both.withColumns({"wide_a": wide("a"), "wide_sum": wide("l") + wide("r")})
    both = both.withColumn("score", F.expr(f"CAST(({SCALE} * wide_a) div wide_sum AS BIGINT)"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("x")
    return both.groupBy("lang", "size", "phrase", "a").agg(lowest).select("lang", "size", "phrase", "a", "x.l", "x.r", "x.score")


def subsumed(scored: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """scored without the phrases that stand within a longer candidate which occurs nearly as often."""
    longer = counts.where("size > 2").withColumn("words", F.split("phrase", " "))
    longer = longer.withColumn("part", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)))
    inner = longer.select("lang", part_of("words", F.col("at"), F.col("part")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = F.col("most").isNull() | (100 * wide("most") < percent * wide("a"))
    return scored.join(inner, ["lang", "phrase"], "left").where(kept).drop("most")


def first_of(scored: DataFrame, top: int) -> DataFrame:
    """Each language's best phrases with their rank. Buckets of scores that hold them are found by counts, so only these are ranked."""
    held = scored.groupBy("lang", F.expr(f"score div {BUCKET}").alias("bucket")).agg(F.count("*").alias("held"))
    above = Window.partitionBy("lang").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    reach = held.withColumn("above", F.coalesce(F.sum("held").over(above), F.lit(0))).where(F.col("above") < top)
    floor = reach.groupBy("lang").agg((F.min("bucket") * BUCKET).alias("floor"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.join(floor, "lang").where("score >= floor")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words that occur `least` times or more."""
    docs = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    scratch, bits = Scratch(), sketch_bits(docs)
    alive = frequent_bits(docs, least, longest, bits)
    counts = scratch.cut(exact_counts(docs, alive, bits, least, longest), "phrase-counts")
    scored = scratch.cut(subsumed(score_phrases(counts, longest), counts, percent), "phrase-scores")
    words = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    out = first_of(scored, top).join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = Scratch().cut(out, "phrases")
    scratch.drop()
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(ws)),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
c AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM c WHERE k > 1),
s AS (SELECT x.lang, x.k, x.phrase, x.a, x.cut, y.a AS l, z.a AS r, CAST((2000000 * x.a::HUGEINT) // (y.a::HUGEINT + z.a) AS BIGINT) AS score
  FROM cuts x JOIN c y ON y.lang = x.lang AND y.phrase = array_to_string(x.ws[1:cut], ' ')
  JOIN c z ON z.lang = x.lang AND z.phrase = array_to_string(x.ws[cut + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
subs AS (SELECT lang, array_to_string(ws[spot:spot + part - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, ws, a, k, part, unnest(range(1, k - part + 2)) AS spot FROM (SELECT lang, ws, a, k, unnest(range(2, k)) AS part FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN subs USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * low.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLE_SQL = {"op12_collocations": ORACLE}
