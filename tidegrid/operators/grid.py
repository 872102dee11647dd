"""Epoch grids: overlapping windows, their phases, and intervals built from events."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Spacing(NamedTuple):
    """A grid's hop and how many hops a window has, whatever the recording's length."""

    hop: int
    per: int

    @property
    def win(self) -> int:
        return self.hop * self.per

    def over(self, total: int) -> Grid:
        return Grid(self.hop, self.per, total)


class Grid(NamedTuple):
    """Windows of `per` hops, one each `hop`; only whole windows within the total count. The unit is that of the time column."""

    hop: int
    per: int
    total: int

    @property
    def win(self) -> int:
        return self.hop * self.per

    @property
    def n(self) -> int:
        return max(0, (self.total - self.win) // self.hop + 1)


def assign(df: DataFrame, grid: Grid, time: str = "us") -> DataFrame:
    """One row for each window that a row lies in: its epochs by arithmetic and explode, no range join."""
    last = F.floor(F.col(time) / F.lit(grid.hop)).cast("long")
    first = F.greatest(last - (grid.per - 1), F.lit(0).cast("long"))
    stop = F.least(last, F.lit(grid.n - 1).cast("long"))
    return df.where(F.col(time) < grid.total).withColumn("epoch", F.explode(F.when(stop >= first, F.sequence(first, stop)).otherwise(F.array().cast("array<long>"))))


def centre(grid: Grid | Spacing, epoch: str = "epoch") -> Column:
    return F.col(epoch) * F.lit(grid.hop) + F.lit(grid.win // 2)


def phase_of(time: Column, phases: list[tuple[str, int, int]]) -> Column:
    """The first phase whose half-open interval holds the time, else the empty string."""
    out = F.lit("")
    for name, start, end in reversed(phases):
        out = F.when((time >= start) & (time < end), F.lit(name)).otherwise(out)
    return out


def phase_join(epochs: DataFrame, phases: DataFrame, block: float = 86_400.0) -> DataFrame:
    """epochs (session, t) with the first listed of the phases (session, place, phase, start_s, end_s) that hold t, else ''. Both are keyed by session and dealt by
    blocks of time, a phase into each block that it reaches into, so an epoch meets the phases of its own block alone. Empty phases hold nothing."""
    at = lambda c: F.floor(F.col(c) / F.lit(block)).cast("long")
    reach = phases.where("end_s > start_s").withColumn("_block", F.explode(F.sequence(at("start_s"), at("end_s"))))
    hit = (F.col("t") >= F.col("start_s")) & (F.col("t") < F.col("end_s"))
    dealt = epochs.select("session", "t").distinct().withColumn("_block", at("t"))
    found = dealt.join(reach, ["session", "_block"]).where(hit).groupBy("session", "t").agg(F.min_by("phase", "place").alias("phase"))
    return epochs.join(found, ["session", "t"], "left").withColumn("phase", F.coalesce("phase", F.lit("")))


def intervals(events: DataFrame, total: Column, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """Each event opens an interval that the session's next event, or the total, closes; empty ones go."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    return events.withColumn("end", F.coalesce(F.lead(time).over(w), total)).where(F.col("end") > F.col(time))
