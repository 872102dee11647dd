"""Ranked lexical search with block-max pruning.

Index. Documents are read in their order and kept as blocks of a range of them: one row for each block, a forward index of its documents' distinct terms
and how often each occurs. Terms are 64-bit hashes. Once the corpus is counted, a second table holds, for each block and term, the most that the term
can add to a score there and how many of the block's documents hold it. Both are written tables; neither depends on a query.

Search. Items come in groups of a bounded size. The table of maxima gives the terms' document counts, hence weights, and for each item and block a bound:
the sum of the item's weights times the block's maxima. Blocks are taken in the order of their bounds: first each item's FIRST best, which give it a
threshold, the least of its best `k` scores; then those blocks whose bound reaches the threshold, and no others. No document of the rest can be
among the best. A task keeps the best `k` of each item, so what is ranked in the end is small.

Edge cases: null and term-less texts count nowhere; null, empty and term-less items and those without a match give no row; documents of equal id are
documents of their own, those of null id come after others of the same score; rows of items equal in id and text are one item, rows that share an id
only are searched each by itself; empty tables give an empty result; other columns are ignored. One very long document is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, short_batches, slices, table
from .grams import byte_set, words_of

#: Bytes that part terms.
BREAKS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: A block ends at so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 128, 32_768
#: An item group ends at so many items or terms; its weights travel with the tasks.
GROUP_ITEMS, GROUP_TERMS = 1000, 50_000
#: Blocks that are scored for an item before it has a threshold.
FIRST = 8
#: Pairs of item and block that are sent to all tasks (16 MB at most); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
BLOCKS = "block long, doc_ids array<long>, lengths array<long>, sizes array<int>, terms array<long>, counts array<int>"
INTS = pa.list_(pa.int32())
LONGS = pa.list_(pa.int64())


def terms_of(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's terms in order; only A-Z are lower-cased."""
    data = [(t or "").encode().lower() for t in texts]
    hashes, starts, _ = words_of(b" ".join(data), BREAKS)
    ends = np.cumsum([len(d) + 1 for d in data])
    return np.split(hashes.view(np.int64), np.searchsorted(starts, ends[:-1]))


class Block:
    """Documents that gather until they are a row of the forward index."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.postings = 0

    def add(self, doc_id: int | None, terms: np.ndarray) -> None:
        found, counts = np.unique(terms, return_counts=True)
        self.docs.append((doc_id, len(terms), found, counts))
        self.postings += len(found)

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS

    def row(self, block: int) -> pa.RecordBatch:
        ids, lengths, terms, counts = zip(*self.docs)
        one = lambda values, kind: pa.array([values], kind)
        columns = [
            pa.array([block], pa.int64()), one(ids, LONGS), one(lengths, LONGS), one([len(t) for t in terms], INTS),
            one(np.concatenate(terms), LONGS), one(np.concatenate(counts).astype(np.int32), INTS),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "lengths", "sizes", "terms", "counts"])


def forward_index(docs: DataFrame) -> DataFrame:
    """The blocks of (doc_id, text); documents without a term are in none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for piece in slices(batches, "text"):
            for doc_id, terms in zip(piece.column("doc_id").to_pylist(), terms_of(piece.column("text").to_pylist())):
                if len(terms):
                    block.add(doc_id, terms)
                if block.full():
                    yield block.row(number)
                    number, block = number + 1, Block()
        if block.docs:
            yield block.row(number)

    return short_batches(docs).mapInArrow(task, BLOCKS)


def values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def parts(counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What an occurrence count in a document of this length adds to a score, before the term's weight; n documents hold `total` terms."""
    if len(lengths) and int(lengths.max()) > (1 << 62) // (75 * n):
        m = np.array([25 + 75 * int(x) * n // total for x in lengths], np.int64)
    else:
        m = 25 + 75 * n * lengths // total
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def block_maxima(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """block, terms, held, tops: a block's different terms, how many of its documents hold each, and the most that each can add to a score."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                terms, counts = values(batch, "terms", row), values(batch, "counts", row).astype(np.int64)
                part = parts(counts, np.repeat(values(batch, "lengths", row), values(batch, "sizes", row)), n, total)
                order = np.argsort(terms, kind="stable")
                found, at, held = np.unique(terms[order], return_index=True, return_counts=True)
                top = np.maximum.reduceat(part[order], at)
                columns = [batch.column("block").slice(row, 1), pa.array([found], LONGS), pa.array([held.astype(np.int32)], INTS), pa.array([top.astype(np.int32)], INTS)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "terms", "held", "tops"])

    return blocks.select("block", "lengths", "sizes", "terms", "counts").mapInArrow(task, "block long, terms array<long>, held array<int>, tops array<int>")


class Index:
    """A corpus made ready for search: forward blocks, their maxima, documents with a term and all terms. drop() deletes the written tables."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.scratch = Scratch()
        self.blocks = self.scratch.cut(forward_index(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "blocks")
        lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
        self.n, self.total = (x or 0 for x in self.blocks.agg(F.sum(F.size("lengths")), F.sum(lengths)).first())
        self.maxima = self.scratch.cut(block_maxima(self.blocks, self.n, self.total), "maxima") if self.n else None

    def drop(self) -> None:
        self.scratch.drop()


class Group:
    """Items searched together: the different terms of all, and for each item where its own stand among them and what each weighs."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.ids = [i for i, _ in items]
        self.vocabulary = np.unique(np.concatenate([t for _, t in items]))
        counted = [np.unique(t, return_counts=True) for _, t in items]
        self.at = np.concatenate([np.searchsorted(self.vocabulary, found) for found, _ in counted])
        self.times = np.concatenate([times for _, times in counted]).astype(np.int64)
        self.first = np.cumsum([0, *(len(found) for found, _ in counted)])
        self.weight = np.zeros(len(self.at), np.int64)

    def weigh(self, held: np.ndarray, n: int) -> None:
        w = [math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * d + 1))) for d in held.tolist()]
        self.weight = np.array(w, np.int64)[self.at] * self.times

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of a block's terms the group has, and where."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        mine = np.flatnonzero(self.vocabulary[at] == terms)
        return mine, at[mine]

    def sums(self, per_term: np.ndarray) -> np.ndarray:
        """For each item, its weights times what each of its terms has here."""
        return np.add.reduceat(per_term[self.at] * self.weight, self.first[:-1])


def groups(items: DataFrame) -> Iterator[Group]:
    """The different items with terms, in groups of a bounded size; a longer item is a group of its own."""
    held: list[tuple[int, np.ndarray]] = []
    for row in items.distinct().toLocalIterator():
        terms = terms_of([row["text"]])[0]
        if held and (len(held) >= GROUP_ITEMS or sum(len(t) for _, t in held) + len(terms) > GROUP_TERMS):
            yield Group(held)
            held = []
        if len(terms):
            held.append((row["item_id"], terms))
    if held:
        yield Group(held)


def document_counts(index: Index, group: Group) -> np.ndarray:
    """In how many documents each term of the group is."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(group.vocabulary), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                mine, at = group.known(values(batch, "terms", row))
                held[at] += values(batch, "held", row)[mine]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["at", "held"])

    found = index.maxima.select("terms", "held").mapInArrow(task, "at long, held long").groupBy("at").agg(F.sum("held").alias("held"))
    out = np.zeros(len(group.vocabulary), np.int64)
    for row in found.toLocalIterator():
        out[row["at"]] = row["held"]
    return out


def block_bounds(index: Index, group: Group) -> DataFrame:
    """item (its place in the group), block, bound: what no document of the block can exceed; only bounds above 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                top = np.zeros(len(group.vocabulary), np.int64)
                mine, at = group.known(values(batch, "terms", row))
                top[at] = values(batch, "tops", row)[mine]
                bound = group.sums(top)
                some = np.flatnonzero(bound)
                block = np.full(len(some), batch.column("block")[row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(block, pa.int64()), pa.array(bound[some])], names=["item", "block", "bound"])

    return index.maxima.select("block", "terms", "tops").mapInArrow(task, "item long, block long, bound long")


def best_of(scores: list, k: int) -> list:
    """The first k of (score, doc_id): highest first, then by id, null last."""
    return sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def scored(index: Index, group: Group, pairs: DataFrame, least: list[int], k: int) -> DataFrame:
    """item, score, doc_id: of the documents of the given pairs (item, block), each task's best k for an item, if above `least`, its threshold, less 1."""
    wanted = pairs.groupBy("block").agg(F.collect_list("item").alias("items"))
    wanted = F.broadcast(wanted) if pairs.count() <= BROADCAST_PAIRS else wanted
    n, total = index.n, index.total

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, sizes = batch.column("doc_ids")[row].as_py(), values(batch, "lengths", row), values(batch, "sizes", row)
                mine, at = group.known(values(batch, "terms", row))
                doc = np.repeat(np.arange(len(ids)), sizes)[mine]
                here, line = np.unique(at, return_inverse=True)  # the group's terms that the block has, and their lines in `part`
                part = np.zeros((len(here), len(ids)), np.int64)
                part[line, doc] = parts(values(batch, "counts", row)[mine].astype(np.int64), lengths[doc], n, total)
                lines = np.full(len(group.vocabulary), -1)
                lines[here] = np.arange(len(here))
                for item in values(batch, "items", row).tolist():
                    own = slice(group.first[item], group.first[item + 1])
                    at = lines[group.at[own]]
                    scores = group.weight[own][at >= 0] @ part[at[at >= 0]]
                    held = best.setdefault(item, [])
                    low = held[-1][0] if len(held) == k else least[item] + 1
                    good = np.flatnonzero(scores >= low)
                    if len(good):
                        best[item] = best_of(held + [(int(scores[d]), ids[d]) for d in good], k)
        rows = [(item, score, doc_id) for item, held in best.items() for score, doc_id in held]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "score", "doc_id"])

    return index.blocks.join(wanted, "block").mapInArrow(task, "item long, score long, doc_id long")


def search_group(index: Index, group: Group, k: int) -> DataFrame:
    """item, rank, doc_id, score of a group's items."""
    group.weigh(document_counts(index, group), index.n)
    scratch = Scratch()
    bounds = scratch.cut(block_bounds(index, group), "bounds")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = scratch.cut(bounds.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= FIRST).select("item", "block"), "first")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = scratch.cut(scored(index, group, first, [0] * len(group.ids), k), "found")
    least = [1] * len(group.ids)
    for row in ranked(found).where(F.col("rank") == k).collect():  # one row for each item of the group at most
        least[row["item"]] = max(1, row["score"])
    spark = bounds.sparkSession
    floor = F.broadcast(spark.createDataFrame(list(enumerate(least)), "item long, least long"))
    rest = scratch.cut(bounds.join(floor, "item").where(F.col("bound") >= F.col("least")).join(first, ["item", "block"], "left_anti").select("item", "block"), "rest")
    more = scored(index, group, rest, [x - 1 for x in least], k)
    ids = F.broadcast(spark.createDataFrame(list(enumerate(group.ids)), "item long, item_id long"))
    out = ranked(found.union(more)).join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    out = Scratch().cut(out, "best")
    scratch.drop()
    return out


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    out = items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if index.n:
        for group in groups(items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))):
            out = out.union(search_group(index, group, k))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(table(spark, sf_dir, "documents"))
    out = search(index, table(spark, sf_dir, "benchmark"))
    index.drop()
    return out


ORACLE = """
WITH toks AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
len AS (SELECT rid, count(*) AS n FROM toks GROUP BY rid),
tot AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (
  SELECT iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark)),
q AS (SELECT iid, item_id, term, count(*) AS times FROM items GROUP BY ALL),
sc AS (
  SELECT q.iid, q.item_id, tf.doc_id, tf.rid,
    sum(q.times * CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df.df + 1))) AS BIGINT)
      * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + (75 * len.n * big_n) // big_l)))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.rid = tf.rid CROSS JOIN tot GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""

QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLE_SQL = {"op13_lexical_search": ORACLE}
