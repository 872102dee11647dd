"""Exact order statistics of few, large groups: medians of all values of a key, and medians of its resamples.

A group's distinct values are counted, sorted by ranges over the cluster and given the places they take among all of the group's values. What lies at a place is
then read in bins of places. So no task, array or group holds a key's values, however many it has and however many of them are equal.

Edge cases: null and NaN values are unknown and count for nothing; a key without known values, or with a null in it, gives no row; of an even number of values
the median is the middle two's mean; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recursive import cut
from .stats import ANCHOR_A, uniforms

#: Places of one bin, in which places are looked up.
BIN = 1 << 16
#: Counters of a pass over a resample, and its places drawn at a time: what a task holds.
COUNTERS, DRAWN = 1 << 16, 1 << 20


def placed(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, value, first, size: the distinct known values of each key, the place of each one's first occurrence, from 0, and how often it occurs."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).dropna(subset=keys)
    counted = known.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("size"))
    ranges = cut(counted.repartitionByRange(*keys, "value").withColumn("_range", F.spark_partition_id()), "ranges")
    of_range = ranges.groupBy(*keys, "_range").agg(F.sum("size").alias("_held"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_range.select(*keys, "_range", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [*keys, "_range"])
    return rows.select(*keys, "value", (F.col("_start") + F.col("_inside")).alias("first"), "size")


def at_places(values: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """places (keys, place, ...) with the value at each place; values as of placed(). A value that reaches over several bins stands in each of them."""
    last = F.col("first") + F.col("size") - 1
    bins = F.explode(F.sequence(F.floor(F.col("first") / BIN).cast("long"), F.floor(last / BIN).cast("long")))
    given = values.withColumn("_bin", bins).withColumn("_at", F.greatest("first", F.col("_bin") * BIN)).select(*keys, "_bin", "_at", F.col("value").alias("_seen"))
    asked = places.withColumns({"_bin": F.floor(F.col("place") / BIN).cast("long"), "_at": F.col("place"), "_asked": F.lit(True)})
    both = asked.unionByName(given, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_bin").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("value", F.last("_seen", ignorenulls=True).over(upto)).where("_asked").select(*places.columns, "value")


def sizes(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(F.sum("size").alias("n"))


def medians(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, n (known values), median."""
    values = cut(placed(df, value, keys), "placed")
    n = F.col("n")
    middle = F.array_distinct(F.array(F.floor((n - 1) / 2).cast("long"), F.floor(n / 2).cast("long")))
    places = sizes(values, keys).select(*keys, "n", F.explode(middle).alias("place"))
    return at_places(values, places, keys).groupBy(*keys, "n").agg(F.avg("value").alias("median"))


def resample_middle(n: int, rep: int) -> tuple[int, int]:
    """The middle two places (one twice, if n is odd) among n values that replicate `rep` draws n times. Two counting passes over its draws, each in portions:
    by bins of n div COUNTERS + 1 places, then by place within the bins of the middle. The draws depend on n and the replicate alone."""

    passes: dict[tuple[int, int], np.ndarray] = {}

    def upto(low: int, width: int, step: int) -> np.ndarray:
        counters = -(-width // step)
        held = np.zeros(counters, np.int64)
        for at in range(0, n, DRAWN):
            drawn = np.floor(uniforms(ANCHOR_A, rep, 1, min(DRAWN, n - at), at)[0] * n).astype(np.int64) - low
            held += np.bincount(drawn[(drawn >= 0) & (drawn < width)] // step, minlength=counters)
        return np.cumsum(held)

    def found(left: int) -> int:
        low, width = 0, n
        while width > 1:
            step = -(-width // COUNTERS)
            if (low, width) not in passes:
                passes[low, width] = upto(low, width, step)
            k = int(np.searchsorted(passes[low, width], left, "right"))
            left -= int(passes[low, width][k - 1]) if k else 0
            low, width = low + k * step, step
        return low

    return found((n - 1) // 2), found(n // 2)


def median_intervals(df: DataFrame, value: str, keys: list[str], reps: int = 4000) -> DataFrame:
    """keys, n, ci_low, ci_high: the interval of the median of independent values by resampling; null below 3 values.

    A replicate draws places of the sorted values, so its median's place is found from the draws alone, without the values; these are read at the places
    found. The replicates are dealt over tasks; one costs n draws."""
    values = cut(placed(df, value, keys), "placed")
    of_keys = sizes(values, keys)
    tasks = of_keys.where("n >= 3").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(*keys, "rep")
    known = {f.name: f.dataType.simpleString() for f in of_keys.schema.fields}
    schema = ", ".join(f"`{k}` {known[k]}" for k in keys) + ", rep long, place array<long>"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            middles = [resample_middle(n, rep) for n, rep in zip(batch.column("n").to_pylist(), batch.column("rep").to_pylist())]
            columns = {k: batch.column(k) for k in keys} | {"rep": batch.column("rep").cast(pa.int64()), "place": pa.array([list(p) for p in middles], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    places = tasks.mapInArrow(draw, schema).withColumn("place", F.explode("place"))
    stats = at_places(values, places, keys).groupBy(*keys, "rep").agg(F.avg("value").alias("stat"))
    ends = stats.groupBy(*keys).agg(F.percentile("stat", 0.025).alias("ci_low"), F.percentile("stat", 0.975).alias("ci_high"))
    return of_keys.join(ends, keys, "left")
