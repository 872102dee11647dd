"""Series of different grids brought together: the interpolating as-of join, and the common grid of a group of series.

Rows are dealt by keys and block of time. A row's neighbours are looked for in its own block; what lies beyond comes from the edges of the other blocks, one
row for each block that holds any. So no window holds more rows than a block has, however long a session is.

Edge cases: a value is null before a series' first known value and after its last, and everywhere if fewer than two are known; where a known value stands
it is taken as it is; null values are unknown; a group of one series keeps its own grid; of several known values at one
time any may be taken; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_of(t: str, block: float) -> Column:
    return F.floor(F.col(t) / F.lit(block)).cast("long")


def interpolate(points: DataFrame, series: DataFrame, keys: list[str], block: float, t: str = "t", value: str = "value", name: str = "value") -> DataFrame:
    """points (keys, t, ...) with `name`, the series (keys, t, value) read at their times on straight lines between its known values."""
    known = series.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"))
    spot = F.struct("_t", "_v")
    asked = points.withColumn("_t", F.col(t).cast("double")).withColumns({"_spot": F.lit(None).cast("struct<_t:double,_v:double>"), "_asked": F.lit(True)})
    rest = [c for c in points.columns if c not in keys]
    given = known.withColumn("_spot", spot).drop("_v").withColumn("_asked", F.lit(False))
    rows = asked.unionByName(given, allowMissingColumns=True).withColumn("_block", block_of("_t", block))
    near = Window.partitionBy(*keys, "_block").orderBy("_t")
    before = F.last("_spot", ignorenulls=True).over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_spot", ignorenulls=True).over(near.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumns({"_before": before, "_after": after}).where("_asked")
    edges = rows.select(*keys, "_block").distinct().join(
        known.groupBy(*keys, block_of("_t", block).alias("_block")).agg(F.min(spot).alias("_first"), F.max(spot).alias("_last"), F.count("*").alias("_n")), [*keys, "_block"], "full"
    )
    blocks = Window.partitionBy(*keys).orderBy("_block")
    carried = edges.select(
        *keys, "_block",
        F.last("_last", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"),
        F.first("_first", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_right"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_known"),
    )
    rows = rows.join(carried, [*keys, "_block"], "left").withColumns({"_a": F.coalesce("_before", "_left"), "_b": F.coalesce("_after", "_right")})
    line = F.expr("_a._v + (_b._v - _a._v) / (_b._t - _a._t) * (_t - _a._t)")
    read = F.when(F.col("_known") < 2, F.lit(None)).when(F.col("_a._t") == F.col("_t"), F.col("_a._v")).when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), line)
    return rows.select(*keys, *[c for c in rest if c != name], read.alias(name))


def following(rows: DataFrame, keys: list[str], t: str, block: float, name: str = "next") -> DataFrame:
    """rows (keys, t, ...), of which a key has no two of one t, with the t of the next row of its keys as `name`, null for the last."""
    dealt = rows.withColumn("_block", block_of(t, block))
    near = Window.partitionBy(*keys, "_block").orderBy(t)
    edges = dealt.groupBy(*keys, "_block").agg(F.min(t).alias("_first"))
    beyond = edges.select(*keys, "_block", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_beyond"))
    return dealt.withColumn(name, F.lead(t).over(near)).join(beyond, [*keys, "_block"]).withColumn(name, F.coalesce(name, "_beyond")).drop("_block", "_beyond")


def preceding(rows: DataFrame, keys: list[str], t: str, block: float, columns: list[str]) -> DataFrame:
    """rows, of which a key has no two of one t, with `columns` of the row before as before_<column>, null for the first."""
    dealt = rows.withColumn("_block", block_of(t, block))
    held = F.struct(t, *[c for c in columns if c != t])
    near = Window.partitionBy(*keys, "_block").orderBy(t)
    edges = dealt.groupBy(*keys, "_block").agg(F.max(held).alias("_last"))
    beyond = edges.select(*keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_beyond"))
    found = dealt.withColumn("_before", F.lag(held).over(near)).join(beyond, [*keys, "_block"]).withColumn("_before", F.coalesce("_before", "_beyond"))
    return found.select(*rows.columns, *[F.col("_before")[c].alias(f"before_{c}") for c in columns])


def numbered(rows: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """rows with their place among those of their keys, from 1, and how many these are: i, n. block grows with the order; rows of one block are numbered in
    one window, and the blocks before it count as one row each."""
    dealt = rows.withColumn("_block", block)
    sizes = dealt.groupBy(*keys, "_block").agg(F.count("*").alias("_size"))
    of_keys = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_size").over(of_keys.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_block", before.alias("_start"), F.sum("_size").over(of_keys).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return dealt.withColumn("_place", place).join(sizes, [*keys, "_block"]).withColumn("i", F.col("_start") + F.col("_place")).drop("_block", "_place", "_start")


def near_flag(placed: DataFrame, keys: list[str], flag: Column, reach: int, name: str) -> DataFrame:
    """placed (keys, i, ...) with `name`: whether any row at most `reach` places away has the flag. Only flagged places are spread out."""
    spread = placed.where(flag).select(*keys, F.explode(F.sequence(F.col("i") - reach, F.col("i") + reach)).alias("i")).distinct().withColumn(name, F.lit(True))
    return placed.join(spread, [*keys, "i"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def median_step(series: DataFrame, keys: list[str], block: float, t: str = "t") -> DataFrame:
    """keys, step: the median time between a series' rows, null for a single one; steps over a block's end come from the blocks' edges."""
    rows = series.select(*keys, F.col(t).cast("double").alias("_t"), block_of(t, block).alias("_block"))
    near = Window.partitionBy(*keys, "_block").orderBy("_t")
    inside = rows.select(*keys, (F.lead("_t").over(near) - F.col("_t")).alias("_step"))
    edges = rows.groupBy(*keys, "_block").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    over = edges.select(*keys, (F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_last")).alias("_step"))
    return inside.union(over).groupBy(*keys).agg(F.median("_step").alias("step"))


def common_grid(series: DataFrame, group: list[str], name: str, block: float, t: str = "t", value: str = "value") -> DataFrame:
    """group, name, t, value, shown: each series of a group on the grid of the one of the finest median step (of equal ones, the first by name). shown: the
    place is one where all series of the group are known, or, if a group has none such, any."""
    steps = median_step(series, [*group, name], block, t)
    finest = steps.groupBy(*group).agg(F.min(F.struct(F.coalesce("step", F.lit(float("inf"))), F.col(name).alias("own"))).alias("_f"))
    axis = series.join(finest, group).where(F.col(name) == F.col("_f.own")).select(*group, t)
    names = steps.select(*group, name)
    points = axis.join(names, group)
    read = interpolate(points, series, [*group, name], block, t, value, value)
    known = F.col(value).isNotNull()
    at = read.groupBy(*group, t).agg(F.bool_and(known).alias("_all"), F.bool_or(known).alias("_any"))
    some = at.groupBy(*group).agg(F.bool_or("_all").alias("_some"))
    shown = at.join(some, group).select(*group, t, F.when(F.col("_some"), F.col("_all")).otherwise(F.col("_any")).alias("shown"))
    return read.join(shown, [*group, t])
