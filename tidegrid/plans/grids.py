"""Series of two grids: a slow marker against an index of the fast grid, and the common grid of series that differ in their hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, grid, stats
from ..operators.recursive import cut
from ..sources.tables import DAY, HOUR, samples, total
from .signals import EV, member_sql

FAST, SLOW = grid.Spacing(12 * HOUR, 2), grid.Spacing(30 * HOUR, 2)
#: Blocks of time that the joins deal by, in seconds.
BLOCK = 5 * DAY / 1e6
#: The series of each grid.
OF_FAST, OF_SLOW = {"level": "avg(value)", "sd": "stddev_pop(value)"}, {"peak": "max(value)", "p2p": "max(value) - min(value)"}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def on_grid(spark, d, spacing: grid.Spacing, kinds: dict[str, str]) -> DataFrame:
    """session, marker, t (the window's centre in seconds), value; null where a window has fewer than two rows."""
    rows = grid.assign(samples(spark, d), spacing.over(total(spark, d))).groupBy("session", "epoch").agg(F.count("*").alias("c"), *[F.expr(v).alias(k) for k, v in kinds.items()])
    long = rows.unpivot(["session", "epoch", "c"], list(kinds), "marker", "v")
    return long.select("session", "marker", (grid.centre(spacing) / 1e6).alias("t"), F.when(F.col("c") >= 2, F.col("v")).alias("value"))


def interpolated_index_join(spark, d) -> DataFrame:
    """Rank correlation of the slow grid's range with the fast grid's deviation, read at the slow grid's centres."""
    marker = on_grid(spark, d, SLOW, {"p2p": OF_SLOW["p2p"]}).select("session", "t", F.col("value").alias("x"))
    index = on_grid(spark, d, FAST, {"sd": OF_FAST["sd"]}).select("session", "t", "value")
    both = align.interpolate(marker, index, ["session"], BLOCK, name="y")
    return stats.spearman(both, "x", "y", ["session"]).select("session", "n", (F.round("rho", 6) + F.lit(0.0)).alias("rho"))


def common_grid_series(spark, d) -> DataFrame:
    """All four series of a session on the finest grid, and where they are shown."""
    both = cut(on_grid(spark, d, FAST, OF_FAST).union(on_grid(spark, d, SLOW, OF_SLOW)), "series")
    return align.common_grid(both, ["session"], "marker", BLOCK).select("session", "marker", "t", (F.round("value", 6) + F.lit(0.0)).alias("value"), "shown")


def series_sql(name: str, spacing: grid.Spacing, kinds: dict[str, str]) -> str:
    rows = f"SELECT session, epoch, count(*) AS c, {', '.join(f'{v} AS {k}' for k, v in kinds.items())} FROM {name}_e GROUP BY session, epoch"
    long = f"SELECT session, marker, (epoch * {spacing.hop} + {spacing.win // 2}) / 1000000.0::DOUBLE AS t, CASE WHEN c >= 2 THEN value END AS value"
    return f"{member_sql(spacing, f'{name}_e')}, {name} AS ({long} FROM ({rows}) UNPIVOT INCLUDE NULLS (value FOR marker IN ({', '.join(kinds)})))"


LINE = (
    "CASE WHEN n < 2 THEN NULL WHEN t0 = t THEN v0 WHEN t1 IS NOT NULL AND t0 IS NOT NULL THEN v0 + (v1 - v0) / (t1 - t0) * (t - t0) END"
)
ORACLE_SQL["interpolated_index_join"] = (
    f"WITH {EV}, {series_sql('m', SLOW, {'p2p': 'max(value) - min(value)'})}, {series_sql('i', FAST, {'sd': 'stddev_pop(value)'})},"
    " k AS (SELECT session, t, value FROM i WHERE value IS NOT NULL), kn AS (SELECT session, count(*) AS n FROM k GROUP BY session),"
    " a AS (SELECT m.session, m.t, m.value AS x, k.t AS t0, k.value AS v0 FROM m ASOF LEFT JOIN k ON m.session = k.session AND m.t >= k.t),"
    " b AS (SELECT a.*, k.t AS t1, k.value AS v1, n FROM a ASOF LEFT JOIN k ON a.session = k.session AND a.t <= k.t LEFT JOIN kn ON kn.session = a.session),"
    f" w AS (SELECT session, x, {LINE} AS y FROM b),"
    " r AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY x) + (count(*) OVER (PARTITION BY session, x) - 1) / 2.0 AS rx,"
    " rank() OVER (PARTITION BY session ORDER BY y) + (count(*) OVER (PARTITION BY session, y) - 1) / 2.0 AS ry FROM w WHERE x IS NOT NULL AND y IS NOT NULL)"
    " SELECT session, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(rx, ry), 6) + 0.0 END AS rho FROM r GROUP BY session"
)
ORACLE_SQL["common_grid_series"] = (
    f"WITH {EV}, {series_sql('m', SLOW, OF_SLOW)}, {series_sql('i', FAST, OF_FAST)}, s AS (SELECT * FROM m UNION ALL SELECT * FROM i),"
    " d AS (SELECT session, marker, lead(t) OVER (PARTITION BY session, marker ORDER BY t) - t AS step FROM s),"
    " f AS (SELECT session, arg_min(marker, (coalesce(step, 'inf'::DOUBLE), marker)) AS own FROM (SELECT session, marker, median(step) AS step FROM d GROUP BY session, marker) GROUP BY session),"
    " p AS (SELECT x.session, n.marker, x.t FROM s x JOIN f ON f.session = x.session AND f.own = x.marker JOIN (SELECT DISTINCT session, marker FROM s) n ON n.session = x.session),"
    " k AS (SELECT session, marker, t, value FROM s WHERE value IS NOT NULL), kn AS (SELECT session, marker, count(*) AS n FROM k GROUP BY session, marker),"
    " a AS (SELECT p.*, k.t AS t0, k.value AS v0 FROM p ASOF LEFT JOIN k ON p.session = k.session AND p.marker = k.marker AND p.t >= k.t),"
    " b AS (SELECT a.*, k.t AS t1, k.value AS v1, n FROM a ASOF LEFT JOIN k ON a.session = k.session AND a.marker = k.marker AND a.t <= k.t"
    " LEFT JOIN kn ON kn.session = a.session AND kn.marker = a.marker),"
    f" w AS (SELECT session, marker, t, {LINE} AS value FROM b),"
    " g AS (SELECT session, t, bool_and(value IS NOT NULL) AS every, bool_or(value IS NOT NULL) AS anyone FROM w GROUP BY session, t),"
    " h AS (SELECT session, t, CASE WHEN bool_or(every) OVER (PARTITION BY session) THEN every ELSE anyone END AS shown FROM g)"
    " SELECT w.session, w.marker, w.t, round(value, 6) + 0.0 AS value, shown FROM w JOIN h ON h.session = w.session AND h.t = w.t"
)
QUERIES |= {f.__name__: f for f in (interpolated_index_join, common_grid_series)}
