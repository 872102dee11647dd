"""MinHash near-duplicates with tensored banding, exact confirmation and connected components.

Signatures. A document's set is that of its distinct word shingles. `collections` small hash collections of `width` minhashes each are computed
(96 minhashes by default), and the table keys are formed by combining pairs of collections: 24 collections give 276 tables of 8 minhashes, where
plain banding would compute 2,208. Two sets of similarity 0.8 meet in no table with probability 6e-5, of 0.85 with 2e-6; of 0.3 in one with 0.02.

Flow. Equal sets become one class before anything is joined. A pair of collections can only be shared by classes that share both, so classes are
first narrowed to those with two or more collections that occur elsewhere; only these form table keys. In each table bucket the class with the most
company becomes the pivot and every other member is tested against it (members, not pairs, of a bucket). Confirmed links give components; then the
members of a bucket that lie in different components, and only these, are tested against each other, so that no link of a candidate pair is lost.
Buckets of the same members count once, and a large one is dealt into blocks that meet two by two, in tasks of their own.
Before full sets are read, counts of each member's shingles that others have too, by parts of the hash range, bound what two of them share; pairs below
the similarity by that bound are left out.
Tests intersect full sets of 64-bit shingle hashes; the set of a node with many partners goes to several tasks, each partner's to one. Tables that a
later step reads again are written to the shared folder, and deleted when the components are known.

Edge cases: texts that are null, empty or white space have an empty set, are linked with nothing and kept; texts of fewer words than a shingle have
one shingle, the whole sequence; equal rows fall in one class and give one result row each; rows with equal ids are one node; a row whose id is null
is compared with none but equal sets, gets the component of its class if that has an id, else null, and is not kept in the first case; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, table
from .shingles import mix, shingle_set, texts_words

COLLECTIONS, WIDTH = 24, 4
#: Candidates up to this many are sent to all tasks, to read their texts without a shuffle of the whole table (24 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SEED = 20240501
#: Parts of the hash range for which shared shingles are counted, to bound what two sets have in common.
PARTS = 64
#: Members of a bucket that meet in one task, and partners of a node that its set is sent to one task for.
BLOCK, PARTNERS = 4096, 64


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(SEED))
    return x[:n] | np.uint64(1), x[n:]


def collections_of(shingles: np.ndarray, n: int, width: int) -> np.ndarray:
    """n hashes, each of `width` minhashes of the set."""
    a, b = seeds(n * width)
    low = np.full(n * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 4096):
        np.minimum(low, (shingles[i : i + 4096, None] * a + b).min(axis=0), out=low)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(31) + low[k::width])
    return out.view(np.int64)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, hash collections (none for an empty set)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(w, words) for w in texts_words(batch.column("text").to_pylist())]
            return {
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([digest_of(s) for s in sets], pa.binary()),
                "collections": pa.array([collections_of(s, COLLECTIONS, WIDTH) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            }

        return step

    return map_texts(df, ["doc_id", "text"], "text", "doc_id long, n_shingles long, digest binary, collections array<long>", make)


def full_sets(df: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, shingles: the full set of each wanted node, read again from its text."""
    wanted = small(nodes.select(F.col("node").alias("doc_id"), "digest"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(w, words) for w in texts_words(batch.column("text").to_pylist())]
            same = [i for i, d in enumerate(batch.column("digest").to_pylist()) if digest_of(sets[i]) == d]
            return {
                "node": batch.column("doc_id").take(pa.array(same, pa.int64())),
                "digest": batch.column("digest").take(pa.array(same, pa.int64())),
                "shingles": pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64())),
            }

        return step

    sets = map_texts(df.join(wanted, "doc_id"), ["doc_id", "text", "digest"], "text", "node long, digest binary, shingles array<long>", make)
    return sets.groupBy("node", "digest").agg(F.first("shingles").alias("shingles")).select("node", "shingles")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), a written table, those whose full sets are similar enough."""
    many = pairs.groupBy("a").count().where(F.col("count") > PARTNERS).select("a", F.ceil(F.col("count") / PARTNERS).cast("int").alias("parts"))
    many = small(many)
    parts = F.coalesce("parts", F.lit(1))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")).join(many, "a", "left")
    left = left.select("a", "set_a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    sent = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.hash("b"), parts).alias("part"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    found = sent.join(right, "b").join(left, ["a", "part"]).select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sum"))
    return found.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b").distinct()


def components(edges: DataFrame, tag: str, scratch: Scratch) -> DataFrame:
    """node, component of every node of edges (a, b): the smallest node reachable. Smallest-label passing with pointer jumping, a written table each round."""
    both = scratch.cut(edges.union(edges.select("b", "a")).distinct(), f"{tag}-edges")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), f"{tag}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("component", "near").alias("via"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        low = F.least("via", "far")
        moved = scratch.cut(hooked.join(jump, "via").select("node", low.alias("component"), (low != F.col("was")).alias("moved")), f"{tag}-labels")
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels


def pair_keys(found: Column) -> Column:
    """The table keys of a class: one for each pair of its collections, given as an array of (place, value) by place."""
    return F.flatten(
        F.transform(found, lambda x: F.transform(F.filter(found, lambda y: y["place"] > x["place"]), lambda y: F.xxhash64(x["place"], y["place"], x["value"], y["value"])))
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row. Links are similarity >= percent / 100 on sets of `words`-word shingles."""
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch()
    signed = scratch.cut(signatures(df, words), "signatures")
    classes = scratch.cut(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("collections").alias("collections")),
        "classes",
    )
    links = class_links(df, classes, words, percent, scratch)
    if links is None:
        linked = classes.select("digest", F.col("node").alias("component"))
    else:
        linked = classes.select("digest", "node").join(links, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    linked = scratch.cut(linked, "linked")
    scratch.drop(signed, linked)
    full = signed.where("n_shingles > 0").join(linked, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return full.union(empty).withColumn("kept", kept)


def shared_parts(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, shared and parts of some nodes: how many of a node's shingles some other of them has too, in all and in each part of the hash range. What two
    nodes have in common is at most the sum of the lesser parts."""
    part = F.pmod(F.shiftright("shingle", 32), F.lit(PARTS)).alias("part")
    spread = sets.join(nodes, "node").select("node", F.explode("shingles").alias("shingle"))
    own = spread.groupBy("shingle").agg(F.count("*").alias("held"), F.min("node").alias("node")).where("held = 1")
    counts = spread.groupBy("node", part).agg(F.count("*").alias("k")).unionByName(own.groupBy("node", part).agg((-F.count("*")).alias("k")))
    counts = counts.groupBy("node", "part").agg(F.sum("k").alias("k"))
    by_part = counts.groupBy("node").agg(F.sum("k").alias("shared"), F.map_from_entries(F.collect_list(F.struct("part", "k"))).alias("k"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.try_element_at("k", i.cast("bigint")), F.lit(0)))
    return by_part.select("node", "shared", parts.alias("parts"))


def class_links(df: DataFrame, classes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """node, component of the classes that are linked with another; None if none is."""
    cut = scratch.cut
    spread = classes.select("node", "n", "digest", F.posexplode("collections").alias("place", "value"))
    company = cut(spread.groupBy("place", "value").agg(F.count("*").alias("held")).where("held > 1"), "company")
    narrowed = cut(
        spread.join(company, ["place", "value"])
        .groupBy("node", "digest", "n")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("found"), F.sum("held").alias("weight"))
        .where(F.size("found") > 1),
        "narrowed",
    )
    keyed = cut(narrowed.select("node", "digest", "n", "weight", F.explode(pair_keys(F.col("found"))).alias("key")), "keyed")
    top = F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n")).alias("top")
    pivots = keyed.groupBy("key").agg(F.count("*").alias("members"), top).where("members > 1")
    pivots = cut(pivots.select("key", (-F.col("top.minus")).alias("pivot"), F.col("top.n").alias("pivot_n")), "pivots")
    members = cut(keyed.join(pivots, "key"), "members")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = members.where(F.col("node") != F.col("pivot")).where(alike(F.col("n"), F.col("pivot_n"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = cut(star, "star")
    if star.isEmpty():
        return None
    wanted = cut(members.select("node", "digest").distinct(), "wanted")
    sets = cut(full_sets(df, wanted, words), "sets")
    links = cut(confirm(star, sets, percent), "links")
    found = components(links, "first", scratch)
    # What is left: candidates in different components, tested against each other unless sizes forbid it or it is done. Two that share a table share two
    # collections, so they meet in the buckets of single collections, of which a node has fewer than tables.
    nodes = narrowed.join(wanted.select("node"), "node", "left_semi").join(found, "node", "left")
    nodes = cut(nodes.select("node", "n", F.coalesce("component", "node").alias("component"), "found"), "nodes")
    of_spot = nodes.select("node", "component", F.inline("found")).groupBy("place", "value").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"),
        F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("other_mark"),
    )
    spot = F.struct("place", "value")
    torn = of_spot.where("low < high").groupBy("members", "mark", "other_mark").agg(F.min(spot).alias("spot")).select("spot.*", "members")
    bounds = cut(shared_parts(nodes.select("node"), sets), "bounds")
    able_nodes = nodes.join(bounds, "node").where(100 * F.col("shared") >= percent * F.col("n"))
    # The parts two by two as columns of their own: most pairs fail by compiled comparisons of these.
    twos = [(F.get("parts", F.lit(i)) + F.get("parts", F.lit(i + 1))).cast("int").alias(f"p{i}") for i in range(0, PARTS, 2)]
    rest = able_nodes.select("node", "n", "component", "shared", "parts", *twos, F.inline("found")).join(torn, ["place", "value"])
    rest = rest.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    rest = cut(rest.withColumn("key", F.xxhash64("place", "value")), "rest")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x, y = rest.withColumn("met", every).alias("x"), rest.withColumn("met", every).alias("y")
    able = lambda most: 100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)
    most = F.aggregate(F.zip_with("x.parts", "y.parts", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, k: a + k)
    rough = reduce(lambda a, b: a + b, [F.least(f"x.p{i}", f"y.p{i}") for i in range(0, PARTS, 2)])
    likely = (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.own") == F.col("y.met"))
            & (F.col("x.met") == F.col("y.own"))
            & (F.col("x.component") < F.col("y.component"))
            & alike(F.col("x.n"), F.col("y.n"))
            & able(F.least("x.shared", "y.shared"))
            & able(rough)
            & able(most),
        )
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
    )
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    likely = cut(likely.join(done, ["a", "b"], "left_anti"), "likely")
    more = cut(confirm(likely, sets, percent), "more")
    return found if more.isEmpty() else components(links.union(more), "last", scratch)


def representatives(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that stay: of each group of near duplicates those of the smallest id; of rows that share id and text one; rows without an id
    always. df has doc_id and text and must not change between two readings."""
    found = Scratch().cut(near_duplicates(df, words=words, percent=percent), "found")
    lost = found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    out = df.join(small(lost), "doc_id", "left_anti")
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return out
    twice = small(twice)
    return out.join(twice, "doc_id", "left_anti").unionByName(out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def small(rows: DataFrame) -> DataFrame:
    """A broadcast hint for tables of at most BROADCAST_ROWS rows, counted here; larger ones are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def op3_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES = {"op3_minhash_neardup": op3_minhash_neardup}
ORACLE_SQL: dict[str, str] = {}
#: Tables of the banding: pairs of collections.
TABLES = len(list(combinations(range(COLLECTIONS), 2)))
