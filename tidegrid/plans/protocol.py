"""What a session's own course says: phases keyed by session, what a reference buys, which channel was tapped, motion on all axes, bars in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, analysis, grid
from ..operators.stats import rounded
from ..sources.tables import DAY, HOUR, samples, table, total
from . import inference
from .signals import EV, SERIES, TOTAL, centre_sql, epochs, member_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Windows and hops in hours of the two grids, and the longest part of a reference that is used.
POWER, PAIRS, USED = (2, 1), (4, 2), 36
#: How long a phase goes on when the next has begun.
LATER = 6 * HOUR
#: The length of a part of a session that is searched for a tap.
PART = 10 * DAY
#: Limits of the acceleration's norm less 1 g and of an axis' turning rate.
OFF, TURN = 0.45, 9.5


def epoch_phases_of_session(spark, d) -> DataFrame:
    """Each session's windows by its own phases: a phase lasts from an event until LATER after the next, so phases overlap and the earlier one counts. Of events at
    one time that of the least number begins the phase."""
    first = samples(spark, d).groupBy("session", "us").agg(F.min_by("channel", "sample").alias("phase"))
    begun = align.following(first, ["session"], "us", 5.0 * DAY, "next")
    stop = F.coalesce("next", F.lit(total(spark, d))) + LATER
    phases = begun.select("session", F.col("us").alias("place"), "phase", (F.col("us") / 1e6).alias("start_s"), (stop / 1e6).alias("end_s"))
    windows = epochs(spark, d, SERIES).select("session", (grid.centre(SERIES) / 1e6).alias("t")).distinct()
    return grid.phase_join(windows, phases, DAY / 1e6).groupBy("session", "phase").agg(F.count("*").alias("epochs"))


ORACLE_SQL["epoch_phases_of_session"] = (
    f"WITH {EV}, {member_sql(SERIES)}, s AS (SELECT session, us, arg_min(channel, sample) AS phase FROM ev GROUP BY session, us),"
    f" p AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY session ORDER BY us), {TOTAL}) + {LATER} AS stop FROM s),"
    f" e AS (SELECT DISTINCT session, {centre_sql(SERIES)} AS t FROM ep),"
    " h AS (SELECT e.session, e.t, arg_min(p.phase, p.us) AS phase FROM e JOIN p ON p.session = e.session AND e.t >= p.us AND e.t < p.stop GROUP BY e.session, e.t)"
    " SELECT e.session, coalesce(h.phase, '') AS phase, count(*) AS epochs FROM e LEFT JOIN h ON h.session = e.session AND h.t = e.t GROUP BY ALL"
)


def calibration_adequacy(spark, d) -> DataFrame:
    """By session and label: the longest phase in hours, how many windows of either grid its used part holds, and what these are good for."""
    iv = grid.intervals(samples(spark, d), F.lit(total(spark, d)), ["session"], "us", ["sample"])
    hours = iv.groupBy("session", F.col("channel").alias("label")).agg((F.max(F.col("end") - F.col("us")) / HOUR).alias("hours"))
    used = F.least(F.col("hours"), F.lit(float(USED)))
    n = hours.withColumns({"n_power": analysis.epochs_bought(used, *POWER), "n_pairs": analysis.epochs_bought(used, *PAIRS)})
    grades = [analysis.adequacy(F.col("n_power"), 25, 10).alias("power"), analysis.adequacy(F.col("n_pairs"), 12, 8).alias("pairs")]
    return n.select("session", "label", F.round("hours", 6).alias("hours"), "n_power", "n_pairs", *grades)


def bought_sql(grid_: tuple[int, int]) -> str:
    return f"CASE WHEN used >= {grid_[0]} THEN floor((used - {grid_[0]}) / {grid_[1]})::BIGINT + 1 ELSE 0 END"


ORACLE_SQL["calibration_adequacy"] = (
    f"WITH {EV}, iv AS (SELECT session, channel AS label, coalesce(lead(us) OVER (PARTITION BY session ORDER BY us, sample), {TOTAL}) - us AS len FROM ev),"
    f" h AS (SELECT session, label, max(len) / {HOUR}.0::DOUBLE AS hours FROM iv WHERE len > 0 GROUP BY ALL), u AS (SELECT *, least(hours, {USED}) AS used FROM h),"
    f" n AS (SELECT session, label, hours, {bought_sql(POWER)} AS n_power, {bought_sql(PAIRS)} AS n_pairs FROM u)"
    " SELECT session, label, round(hours, 6) AS hours, n_power, n_pairs, CASE WHEN n_power >= 25 THEN 'ok' WHEN n_power < 10 THEN 'insufficient' ELSE 'thin' END AS power,"
    " CASE WHEN n_pairs >= 12 THEN 'ok' WHEN n_pairs < 8 THEN 'insufficient' ELSE 'thin' END AS pairs FROM n"
)


def tap_verdict(spark, d) -> DataFrame:
    """By session and part: the channel that stands out, by how much, and whether that is a tap."""
    s = samples(spark, d).withColumn("part", F.floor(F.col("us") / PART).cast("long")).withColumn("t", F.col("us") / HOUR)
    return analysis.tapped(s, ["session", "part"], "channel", "t", "value").select("session", "part", "top", F.round("ratio", 4).alias("ratio"), "tapped")


ORACLE_SQL["tap_verdict"] = (
    f"WITH {EV}, r AS (SELECT session, us // {PART} AS part, channel, us / {HOUR}.0::DOUBLE AS t, value::DOUBLE AS y FROM ev WHERE value IS NOT NULL),"
    " s AS (SELECT session, part, channel, round(sqrt(greatest(var_pop(y) - coalesce(covar_pop(y, t) * covar_pop(y, t) / nullif(var_pop(t), 0), 0), 0)), 6) AS sd FROM r GROUP BY ALL HAVING count(*) >= 3),"
    " m AS (SELECT session, part, arg_max(channel, (sd, channel)) AS top FROM s GROUP BY ALL),"
    " g AS (SELECT m.session, m.part, top, max(sd) FILTER (WHERE channel = top) AS a, median(sd) FILTER (WHERE channel <> top) AS b FROM s JOIN m ON s.session = m.session AND s.part = m.part GROUP BY ALL),"
    " q AS (SELECT session, part, top, CASE WHEN b = 0 THEN 'inf'::DOUBLE ELSE a / b END AS ratio FROM g)"
    " SELECT session, part, top, round(ratio, 4) AS ratio, CASE WHEN ratio >= 3 THEN top END AS tapped FROM q"
)


def motion_all_axes(spark, d) -> DataFrame:
    """By supplier and quarter: three columns of a line stand for the axes of the acceleration, three for the turning rates."""
    quarter = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("session"), quarter.cast("long").alias("epoch"),
        *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")],
    )
    accel = [F.col("l_quantity") / 50 + 0.5, F.col("l_discount") * 4, F.col("l_tax") * 4]
    gyro = [F.col("l_linenumber"), F.col("l_discount") * 100, F.col("l_tax") * 100]
    m = analysis.motion(rows, ["session", "epoch"], accel, gyro, OFF, TURN)
    return m.select("session", "epoch", "moved", F.round("motion", 6).alias("motion"))


ORACLE_SQL["motion_all_axes"] = (
    "WITH a AS (SELECT l_suppkey AS session, (year(l_shipdate) * 4 + quarter(l_shipdate))::BIGINT AS epoch, abs(sqrt(pow(l_quantity::DOUBLE / 50 + 0.5, 2) + pow(l_discount::DOUBLE * 4, 2) + pow(l_tax::DOUBLE * 4, 2)) - 1) AS off,"
    " abs(l_linenumber::DOUBLE) AS x, abs(l_discount::DOUBLE * 100) AS y, abs(l_tax::DOUBLE * 100) AS z FROM lineitem)"
    f" SELECT session, epoch, bool_or(off > {OFF} OR x > {TURN} OR y > {TURN} OR z > {TURN}) AS moved, round(avg(off) + avg((x + y + z) / 3) / 100, 6) AS motion FROM a GROUP BY session, epoch"
)


def bars_order(spark, d) -> DataFrame:
    """The bars of each session in their order with the session's scale; what has no bar has no place."""
    b = analysis.bars(inference.summary(spark, d), ["session"])
    return b.select("session", "marker", (rounded("pct", 4) + 0.0).alias("pct"), F.col("place").cast("long").alias("place"), rounded("scale", 4).alias("scale"))


ORACLE_SQL["bars_order"] = (
    f"{inference.SM}, b AS (SELECT session, marker, row_number() OVER (PARTITION BY session ORDER BY round(abs(pct), 6) DESC, marker) AS place, abs(pct) AS size FROM sm WHERE abs(pct) <= 100),"
    " l AS (SELECT session, greatest(max(size), 5.0) AS scale FROM b GROUP BY session)"
    " SELECT sm.session, sm.marker, round(pct, 4) + 0.0 AS pct, place, round(scale, 4) AS scale FROM sm LEFT JOIN b ON b.session = sm.session AND b.marker = sm.marker LEFT JOIN l ON l.session = sm.session"
)
QUERIES |= {f.__name__: f for f in (epoch_phases_of_session, calibration_adequacy, tap_verdict, motion_all_axes, bars_order)}
