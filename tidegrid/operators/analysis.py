"""From marker series to verdicts: summaries of two phases, ranking, tiers, session reduction and cohort aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markers import SIGNED
from . import selection, stats

A, B = "CALIBRATION", "MANTRA"


def summarise(series: DataFrame, keys: list[str]) -> DataFrame:
    """series (keys, epoch, phase, value with null where the gate fails) -> baseline, active, n, percent changes, delta, spread, coverage; null below 3
    values. The series is shuffled once, to arrays of either phase."""
    covered = (F.count("value") / F.count("*")).alias("coverage")
    known = lambda p: F.collect_list(F.when(F.col("phase") == p, F.col("value").cast("double")))
    arrays = series.groupBy(*keys).agg(known(A).alias("_a"), known(B).alias("_b"), covered)
    sizes = [F.size("_a").cast("long").alias("n_baseline"), F.size("_b").cast("long").alias("n_active")]
    kinds = dict.fromkeys(("baseline", "active", "spread", "delta"), pa.float64())
    out = stats.over_arrays(arrays.select(*keys, *sizes, "coverage", "_a", "_b"), [*keys, "n_baseline", "n_active", "coverage"], ["_a", "_b"], kinds, stats.two_phase)
    signed = F.col("marker").isin(*SIGNED) if "marker" in keys else F.lit(False)
    return out.withColumn("pct_raw", F.when(F.col("baseline") != 0, (F.col("active") / F.col("baseline") - 1) * 100)).withColumn(
        "pct", F.when(~signed, stats.percent_change(F.col("active"), F.col("baseline"), F.col("spread")))
    ).withColumn("std_change", (F.col("active") - F.col("baseline")) / F.col("spread"))


def artifact_correlation(series: DataFrame, keys: list[str], indices: list[str]) -> DataFrame:
    """keys, r_<index> for each index column of the series: rank correlation where both are known, null below 5 epochs."""
    both = lambda k: F.collect_list(F.when(F.col("value").isNotNull() & F.col(k).isNotNull(), F.struct(F.col("value").cast("double").alias("x"), F.col(k).alias("y"))))
    pairs = series.groupBy(*keys).agg(*[both(k).alias(k) for k in indices])
    arrays = pairs.select(*keys, *[F.transform(k, stats.field(n)).alias(f"{n}_{k}") for k in indices for n in "xy"])
    found = lambda *v: tuple(stats.rank_correlation(v[i], v[i + 1]) for i in range(0, len(v), 2))
    return stats.over_arrays(arrays, keys, [f"{n}_{k}" for k in indices for n in "xy"], {f"r_{k}": pa.float64() for k in indices}, found)


def rank(summary: DataFrame, keys: list[str], limit: int, least_coverage: float = 0.6, most_r: float = 0.5, pool: list[str] | None = None) -> DataFrame:
    """Top `limit` by absolute change of each session, of the pool's markers if one is named; poorly covered ones, and those that go with r_emg or r_motion
    if the summary has these, stand behind the others (an unknown correlation flags none); ties by marker."""
    score = F.coalesce(F.abs("pct"), F.abs("std_change"))
    flagged = F.col("coverage") < least_coverage
    for r in ("r_emg", "r_motion"):
        if r in summary.columns:
            flagged = flagged | F.coalesce(F.round(F.abs(r), 9) > most_r, F.lit(False))
    rows = summary.where(score > 0) if pool is None else summary.where(score > 0).where(F.col("marker").isin(*pool))
    w = Window.partitionBy(*keys).orderBy(F.col("flagged").asc(), stats.rounded("score", 6).desc(), F.col("marker").asc())
    return rows.withColumn("score", score).withColumn("flagged", flagged).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def tier(coverage: Column) -> Column:
    return F.when(coverage >= 0.10, "full").when(coverage >= 0.02, "descriptive").otherwise("insufficient")


def change_text(delta: Column, pct: Column) -> Column:
    """Signed number without a percentage: D and three decimals, else a whole percentage."""
    return F.when(pct.isNull(), F.concat(F.lit("D"), F.format_string("%+.3f", stats.rounded(delta, 3)))).otherwise(F.concat(F.format_string("%+.0f", F.round(pct, 0)), F.lit("%")))


def cohort(sessions: DataFrame) -> DataFrame:
    """sessions (session, marker, std_change, pct) -> per marker the medians over sessions and the exact sign test. Counts are added up, medians are selected by
    ranges of values: nothing holds all sessions of a marker."""
    long = sessions.select("marker", "pct", "std_change").unpivot("marker", ["pct", "std_change"], "_of", "_value")
    middle = selection.medians(long, "_value", ["marker", "_of"]).groupBy("marker").agg(
        F.max(F.when(F.col("_of") == "pct", F.col("median"))).alias("median_pct"), F.max(F.when(F.col("_of") == "std_change", F.col("median"))).alias("median_std")
    )
    counts = sessions.groupBy("marker").agg(F.count("std_change").alias("n"), F.count_if(F.col("std_change") > 0).alias("n_up"))
    g = counts.join(middle, "marker", "left").withColumn("p", stats.sign_test(F.col("n_up"), F.col("n")))
    return g.withColumn("n_down", F.col("n") - F.col("n_up")).withColumn("consistent", (F.col("p") < 0.05) & (F.col("n") >= 5)).withColumn("direction", F.when(F.col("median_std") > 0, "up").otherwise("down"))


def session_changes(summary: DataFrame, markers: list[str], least_baseline: int = 5, most: float = 20.0) -> DataFrame:
    """summary (session, marker, ...) -> session, marker, std_change, pct, degenerate, coverage: what each of the markers says of a session. degenerate: the
    change is beyond `most` spreads, as the spread has collapsed; such rows don't count. coverage: the mean of all the session's markers."""
    covered = summary.groupBy("session").agg(F.avg("coverage").alias("coverage"))
    said = summary.where(F.col("marker").isin(*markers) & (F.col("n_baseline") >= least_baseline) & (F.col("spread") > 0) & F.col("std_change").isNotNull())
    return said.select("session", "marker", "std_change", "pct", (F.abs("std_change") > most).alias("degenerate")).join(covered, "session", "right")


def included(changes: DataFrame, floor: float) -> DataFrame:
    """Of session_changes, what a cohort counts: rows not degenerate of sessions covered to the floor. A session without any such row has none here."""
    return changes.where(~F.col("degenerate") & (F.col("coverage") >= floor)).select("session", "marker", "std_change", "pct")


def epochs_bought(duration: Column, win: float, hop: float) -> Column:
    """How many windows of a grid a duration holds."""
    return F.when(duration >= win, F.floor((duration - win) / hop).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def adequacy(n: Column, ok: int, thin: int) -> Column:
    """What a reference of n windows is good for: 25 and 10 for power, 12 and 8 for connectivity are the usual limits."""
    return F.when(n >= ok, "ok").when(n >= thin, "thin").otherwise("insufficient")


def tapped(rows: DataFrame, keys: list[str], channel: str, t: str, value: str, least: float = 3.0) -> DataFrame:
    """keys, top, ratio, tapped: the channel of the largest deviation from its line over time, that over the median of the others' (infinite if this is 0,
    null without others), and the channel again if the ratio reaches `least`. Channels of fewer than three values, which any line fits, don't count. Of equal
    deviations (to six places) the last channel by name is taken."""
    x, y = F.col(t).cast("double"), F.col(value).cast("double")
    of_line = F.coalesce(F.covar_pop(x, y) * F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0)), F.lit(0.0))
    deviation = F.round(F.sqrt(F.greatest(F.var_pop(y) - of_line, F.lit(0.0))), 6).alias("sd")
    sd = rows.where(F.col(value).isNotNull()).groupBy(*keys, channel).agg(F.count("*").alias("_n"), deviation).where("_n >= 3")
    top = sd.groupBy(*keys).agg(F.max(F.struct("sd", F.col(channel).alias("top"))).alias("_t")).select(*keys, "_t.top")
    same = F.col(channel) == F.col("top")
    g = sd.join(top, keys).groupBy(*keys, "top").agg(F.max(F.when(same, F.col("sd"))).alias("_a"), F.median(F.when(~same, F.col("sd"))).alias("_b"))
    ratio = F.when(F.col("_b") == 0, F.lit(float("inf"))).otherwise(F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0)))
    return g.select(*keys, "top", ratio.alias("ratio"), F.when(ratio >= least, F.col("top")).alias("tapped"))


def motion(rows: DataFrame, keys: list[str], accel: list[Column], gyro: list[Column], most_g: float, most_turn: float) -> DataFrame:
    """keys, moved, motion from one row for each sample: the acceleration's norm less 1 g, with the size of the turning rates. moved: any sample's norm is off by
    more than most_g, or any axis turns faster than most_turn. Samples with an unknown axis are left out."""
    off = F.abs(F.sqrt(sum((a * a for a in accel), F.lit(0.0))) - 1)
    turns = F.array(*[F.abs(g) for g in gyro])
    known = F.array(*accel, *gyro)
    s = rows.where(F.forall(known, lambda v: v.isNotNull())).withColumns({"_off": off, "_turn": F.aggregate(turns, F.lit(0.0), lambda a, g: a + g) / len(gyro), "_fast": F.array_max(turns)})
    moved = F.bool_or((F.col("_off") > most_g) | (F.col("_fast") > most_turn))
    return s.groupBy(*keys).agg(moved.alias("moved"), (F.avg("_off") + F.avg("_turn") / 100).alias("motion"))


def bars(summary: DataFrame, keys: list[str], most: float = 100.0, least_scale: float = 5.0) -> DataFrame:
    """keys, marker, pct, place, scale: markers by falling size of change, those without a percentage or beyond `most` without a place; scale is that of the
    session's largest bar, `least_scale` at least, null where no bar stands. Ties by marker."""
    shown = F.coalesce(F.abs("pct") <= most, F.lit(False))
    w = Window.partitionBy(*keys, "_shown").orderBy(stats.rounded(F.abs("pct"), 6).desc(), "marker")
    rows = summary.select(*keys, "marker", "pct", shown.alias("_shown")).withColumn("place", F.when(F.col("_shown"), F.row_number().over(w)))
    largest = F.max(F.when(F.col("_shown"), F.abs("pct"))).over(Window.partitionBy(*keys))
    return rows.withColumn("scale", F.when(largest.isNotNull(), F.greatest(largest, F.lit(least_scale)))).drop("_shown")
