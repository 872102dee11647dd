"""Sharding by weighted rendezvous hashing of stable record keys.

A record goes to the shard of the least cost -ln(u) / weight, u being a hash of (seed, key, shard) in (0, 1). A shard's cost for a key
depends on nothing else, so a new shard takes records only into itself and a removed one gives up only its own.
The slot is the record's rank within its shard in the order of a hash of the whole record, found without a window over a whole shard:
equal records are counted first, ranked within ranges of the hash, and the ranges' sizes are summed up before them. There are as many ranges as keep
some RANGE_ROWS rows in each, so the table of their sizes has one row for about as many records; it is joined by shard and range, as the records are dealt
already, and broadcast only where Spark finds it small.

Edge cases: null text counts 8 bytes and has the crc of an empty one; a null key is a key of its own; equal rows get slots of their own;
an empty table gives an empty result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Rows of one explode() array when a count of equal records is spread out again.
CHUNK = 65_536
#: Rows that a range of a shard should have, and the least number of ranges as a power of two.
RANGE_ROWS, LEAST_BITS = 100_000, 6


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0 ..) of a key among shards with these positive weights."""
    costs = []
    for shard, weight in enumerate(weights):
        h = F.xxhash64(F.lit(seed), F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(shard))
        u = (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        costs.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def shard(df: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", seed: int = 0, range_bits: int | None = None) -> DataFrame:
    """One row for each record: its shard under these weights, its slot there, and its shard once one more of the last weight is added.

    range_bits (1 at least): 2 ** range_bits ranges of a shard are ranked apart, by default as the number of rows asks; their number never changes a slot.
    """
    if range_bits is None:
        share = max(weights) / sum(weights)
        range_bits = max(LEAST_BITS, int(df.count() * share / RANGE_ROWS).bit_length())
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    same = ["doc_id", "size", "text_crc32"]
    order = F.xxhash64(F.lit(seed + 1), *same)
    records = (
        rows.groupBy(*same)
        .agg(F.count("*").alias("n"))
        .withColumns({"shard": rendezvous(F.col("doc_id"), weights, seed), "order": order})
        .withColumn("range", F.shiftrightunsigned(F.col("order"), 64 - range_bits))
    )
    sizes = records.groupBy("shard", "range").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "range").orderBy("order", *same).rowsBetween(Window.unboundedPreceding, -1)
    ranked = records.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "range"])
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    piece = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1))
    return (
        ranked.withColumn("chunk", chunk)
        .withColumn("copy", piece)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("rank") + F.col("copy")).alias("slot"),
            rendezvous(F.col("doc_id"), [*weights, weights[-1]], seed).cast("int").alias("grown_shard"),
        )
    )


def op2_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), [1.0] * 24)


QUERIES = {"op2_rendezvous_sharding": op2_rendezvous_sharding}
ORACLE_SQL: dict[str, str] = {}
