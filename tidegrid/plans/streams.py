"""Queries that run as streams, held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexity, contact
from ..operators import recursive
from ..streaming import live, monitor
from . import continuous

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def start_us(c: str) -> "F.Column":
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast({c} as timestamp_ntz))")


def stream_contact_windows(spark, d) -> DataFrame:
    out = monitor.drained(monitor.contact_windows(monitor.events_stream(spark, d), "8 hours", "1 hour", "1 hour"))
    return out.select(start_us("window.start").alias("start_us"), "channel", "n", F.round("sd", 6).alias("sd"), F.round("p2p", 6).alias("p2p"))


def stream_counter_gaps(spark, d) -> DataFrame:
    out = monitor.drained(monitor.counter_gaps(monitor.events_stream(spark, d)))
    return out.groupBy("session").agg(F.sum("gaps").alias("gaps"), F.sum("seen").alias("seen"))


def stream_session_windows(spark, d) -> DataFrame:
    out = monitor.drained(monitor.session_windows(monitor.events_stream(spark, d), "6 hours", "1 hour"))
    return out.select("session", start_us("session_window.start").alias("start_us"), "n")


#: Seconds that a contact report looks back on.
BACK = 8
CONTACT = contact.Contact()


def shown(reports: DataFrame) -> DataFrame:
    return reports.select("session", "c", "second", *[(F.round(k, 6) + F.lit(0.0)).alias(k) for k in contact.FIGURES], "level")


def contact_monitor(spark, d) -> DataFrame:
    """Batch: each second's report on the last eight seconds of each channel, filters and all."""
    windows = recursive.epochs(continuous.records(spark, d), continuous.KEYS, continuous.SIZE, BACK * continuous.N, continuous.N)
    return shown(live.contact_windows(windows.withColumn("second", F.col("epoch") + BACK), continuous.KEYS, CONTACT))


def stream_contact_monitor(spark, d) -> DataFrame:
    """The same from a stream of seconds: state holds what a report looks back on."""
    schema = spark.read.parquet(f"{d}/embeddings.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/embeddings.parquet*")
    e = F.floor(F.col("vec_id") / 8)
    parts = rows.select(
        F.floor(e / continuous.WINDOWS).alias("session"), (F.col("vec_id") % 8).alias("c"), (e % continuous.WINDOWS).alias("part"), F.col("embedding").cast("array<double>").alias("x")
    ).where("c < 6")
    return shown(monitor.drained(live.contact_stream(parts, continuous.KEYS, CONTACT, BACK)))


def stream_late_gaps(spark, d) -> DataFrame:
    """Gaps of each session's counter, however its rows are shuffled over micro-batches, up to the last watermark."""
    out = monitor.drained(live.late_gaps(monitor.events_stream(spark, d), "user_id", "event_id", "1 hour"))
    return out.groupBy(F.col("key").alias("session")).agg(F.count_if("gap").alias("gaps"), F.count("*").alias("seen"), F.max("counter").alias("last"))


_NOTCH = complexity.notch_section(16.0, 30.0, 64.0)
_CONTACT = (
    f"{continuous.RECORD_SQL}, win AS (SELECT session * 100000 + s AS session, c, e[(s - 8) * 64 + 1 : s * 64] AS x FROM raw, range(8, 31) t(s) WHERE s * 64 <= len(e)),"
    " wv AS (SELECT session, c, n, x[n + 1] AS v FROM win, range(512) t(n)),"
    " ln AS (SELECT session, c, regr_slope(v, n) AS a, regr_intercept(v, n) AS b FROM wv GROUP BY session, c),"
    " dt AS MATERIALIZED (SELECT session, c, list(v - a * n - b ORDER BY n) AS e FROM wv JOIN ln USING (session, c) GROUP BY session, c),"
    f" notched AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE {continuous.zero_phase_sql('n1', 'dt', _NOTCH, 9)}, {continuous.zero_phase_sql('n2', 'n1', _NOTCH, 9)} SELECT * FROM n2)),"
    f" graded AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE {continuous.zero_phase_sql('gp', 'notched', continuous.band_sections(2, 24), 27)} SELECT * FROM gp)),"
    " m AS (SELECT session, c, stddev_pop(v) AS sd, max(v) - min(v) AS p2p FROM (SELECT session, c, unnest(e[97:-97]) AS v FROM graded) GROUP BY session, c),"
    " y AS (SELECT session, c, n, (e[n + 1] - list_avg(e)) * (0.5 - 0.5 * cos(2 * pi() * n / 512)) AS y FROM dt, range(512) t(n)),"
    " p AS (SELECT session, c, f, pow(sum(y * cos(2 * pi() * ((f * n) % 512) / 512)), 2) + pow(sum(y * sin(2 * pi() * ((f * n) % 512) / 512)), 2) AS p FROM y, range(8, 249) t(f) GROUP BY session, c, f),"
    " az AS (SELECT *, p + lag(p) OVER (PARTITION BY session, c ORDER BY f) AS area FROM p),"
    " li AS (SELECT session, c, sum(area) FILTER (WHERE f > 120 AND f <= 136) / sum(area) AS line FROM az GROUP BY session, c),"
    " sg AS (SELECT session, c, s, n, e[16 * s + n + 1] - list_avg(e[16 * s + 1 : 16 * s + 32]) AS v FROM notched, range(31) t(s), range(32) u(n)),"
    " sp AS (SELECT session, c, s, f, pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 32)) * cos(2 * pi() * ((f * n) % 32) / 32)), 2)"
    " + pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 32)) * sin(2 * pi() * ((f * n) % 32) / 32)), 2) AS p FROM sg, (SELECT unnest([2, 3, 7, 8, 9, 10, 11, 12, 13, 14, 15]) AS f) GROUP BY session, c, s, f),"
    " sl AS (SELECT session, c, regr_slope(log10(p), log10(2 * f)) AS slope FROM (SELECT session, c, f, avg(p) AS p FROM sp GROUP BY session, c, f) GROUP BY session, c),"
    " a AS (SELECT session // 100000 AS session, c, session % 100000 AS second, abs(a) * 511 / 8 AS drift, line, sd, p2p, slope"
    " FROM ln JOIN li USING (session, c) JOIN m USING (session, c) JOIN sl USING (session, c))"
    " SELECT session, c, second, round(drift, 6) + 0.0 AS drift, round(line, 6) + 0.0 AS line, round(sd, 6) + 0.0 AS sd, round(p2p, 6) + 0.0 AS p2p, round(slope, 6) + 0.0 AS slope,"
    " CASE WHEN sd < 0.02 OR drift > 0.005 THEN 'red' WHEN sd <= 0.1 AND p2p <= 0.6 THEN 'green' WHEN sd > 0.102 OR p2p > 0.64 THEN 'red' ELSE 'yellow' END AS level FROM a"
)
QUERIES |= {f.__name__: f for f in (contact_monitor, stream_contact_monitor, stream_late_gaps)}
QUERIES |= {"stream_contact_windows": stream_contact_windows, "stream_counter_gaps": stream_counter_gaps, "stream_session_windows": stream_session_windows}
_EV = "ev AS (SELECT user_id AS session, event_type AS channel, event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, value FROM events)"
_MARK = "(SELECT (max(us) // 1000) * 1000 - 3600000000 FROM ev)"
ORACLE_SQL |= {
    "stream_contact_windows": f"WITH {_EV}, w AS (SELECT channel, value, unnest(generate_series(us // 3600000000 - 7, us // 3600000000)) * 3600000000 AS start_us FROM ev)"
    f" SELECT start_us, channel, count(*) AS n, round(stddev_pop(value), 6) AS sd, round(max(value) - min(value), 6) AS p2p FROM w WHERE start_us + 28800000000 <= {_MARK} GROUP BY start_us, channel",
    "stream_counter_gaps": f"WITH {_EV}, s AS (SELECT session, event_id - lag(event_id) OVER (PARTITION BY session ORDER BY event_id) AS step FROM ev)"
    " SELECT session, count(*) FILTER (WHERE abs(step - 1) > 1 AND step >= 0) AS gaps, count(*) AS seen FROM s GROUP BY session",
    "stream_session_windows": f"WITH {_EV}, s AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY session ORDER BY us) > 21600000000, true) AS new FROM ev),"
    " g AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY session ORDER BY us, event_id) AS k FROM s)"
    f" SELECT session, min(us) AS start_us, count(*) AS n FROM g GROUP BY session, k HAVING max(us) + 21600000000 <= {_MARK}",
    "contact_monitor": _CONTACT,
    "stream_contact_monitor": _CONTACT,
    "stream_late_gaps": f"WITH {_EV}, s AS (SELECT session, event_id, event_id - lag(event_id) OVER (PARTITION BY session ORDER BY us, event_id) AS step FROM ev WHERE us // 1000 < {_MARK} // 1000)"
    " SELECT session, count(*) FILTER (WHERE abs(step - 1) > 1 AND step >= 0) AS gaps, count(*) AS seen, max(event_id) AS last FROM s GROUP BY session",
}
