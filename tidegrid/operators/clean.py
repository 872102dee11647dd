"""Cleaning of sampled signals: saturation, trends, edges, differences, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import align


def dilate(df: DataFrame, flag: Column, keys: list[str], order: list[str], block: Column, reach: int, name: str = "mask") -> DataFrame:
    """df with `name`: whether any row at most `reach` rows away, in this order, has the flag. block deals a key's rows and grows with the order."""
    return align.near_flag(align.numbered(df, keys, order, block), keys, flag, reach, name).drop("i", "n")


def excise(df: DataFrame, value: str, mask: str, keys: list[str]) -> DataFrame:
    """Masked values become the median of the channel's others, or 0 without any. The medians are aggregated, then joined: no window holds a channel."""
    medians = df.where(~F.col(mask)).groupBy(*keys).agg(F.median(value).alias("_median"))
    return df.join(medians, keys, "left").withColumn("clean", F.when(F.col(mask), F.coalesce("_median", F.lit(0.0))).otherwise(F.col(value))).drop("_median")


def detrend(df: DataFrame, value: str, index: str, keys: list[str], linear: bool = True) -> DataFrame:
    """Less the least-squares line over the channel (or its mean): the fit is aggregated, then joined."""
    if linear:
        fit = df.groupBy(*keys).agg(F.regr_slope(value, index).alias("_a"), F.regr_intercept(value, index).alias("_b"))
        flat = F.col(value) - (F.col("_a") * F.col(index) + F.col("_b"))
    else:
        fit = df.groupBy(*keys).agg(F.lit(0.0).alias("_a"), F.avg(value).alias("_b"))
        flat = F.col(value) - F.col("_b")
    return df.join(fit, keys).withColumn("flat", flat).drop("_a", "_b")


def gaps(df: DataFrame, counter: str, keys: list[str], block: int = 1 << 20) -> DataFrame:
    """step to the row before; gap: a step above 2. A step of 2 is none, a negative one a wrap. Rows meet in blocks of the counter."""
    before = align.preceding(df, keys, counter, block, [counter])
    step = F.col(counter) - F.col(f"before_{counter}")
    return before.withColumn("step", step).withColumn("gap", F.coalesce((F.abs(step - 1) > 1) & (step >= 0), F.lit(False))).drop(f"before_{counter}")
