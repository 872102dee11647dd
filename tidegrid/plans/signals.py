"""Queries on the event table as recordings: grids, phases, cleaning, gates. Each stands beside the SQL that must give its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import align, clean, grid
from ..sources.tables import DAY, HOUR, samples, table, total

POWER = grid.Spacing(2 * HOUR, 2)
CONN = grid.Spacing(5 * HOUR, 2)
#: The grid on which one session's sparse events make a series.
SERIES = grid.Spacing(12 * HOUR, 2)
#: The grid of the window gates, whose epochs hold several events of each channel.
GATES = grid.Spacing(5 * DAY, 2)
#: A grid between the two, where a channel is good in about every other window.
BETWEEN = grid.Spacing(3 * DAY, 2)
PHASES = [("CALIBRATION", 0, 10 * DAY), ("MANTRA", 10 * DAY, 25 * DAY), ("SETTLE", 25 * DAY, 31 * DAY)]

#: Recordings in SQL. hz: their first day, and the microseconds of all their days.
EV = (
    "hz AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS t0, (date_diff('day', min(ts), max(ts)) + 1) * 86400000000 AS total FROM events),"
    " ev AS (SELECT user_id AS session, event_type AS channel, event_id AS sample, epoch_us(ts) - epoch_us((SELECT t0 FROM hz)) AS us, value FROM events)"
)
TOTAL = "(SELECT total FROM hz)"


def last_sql(g: grid.Spacing) -> str:
    """The number of the last whole window."""
    return f"(({TOTAL} - {g.win}) // {g.hop})"


def member_sql(g: grid.Spacing, name: str = "ep", source: str = "ev") -> str:
    epochs = f"generate_series(greatest(us // {g.hop} - {g.per - 1}, 0), least(us // {g.hop}, {last_sql(g)}))"
    return f"{name} AS (SELECT *, unnest({epochs}) AS epoch FROM {source})"


def phase_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} >= {a} AND {t} < {b} THEN '{p}'" for p, a, b in PHASES) + " ELSE '' END"


def centre_sql(g: grid.Spacing) -> str:
    return f"(epoch * {g.hop} + {g.win // 2})"


def r6(c) -> "F.Column":
    return F.round(c if not isinstance(c, str) else F.col(c), 6) + F.lit(0.0)


def epochs(spark, d, spacing: grid.Spacing) -> DataFrame:
    """The samples, once for each window of the recordings that they lie in."""
    return grid.assign(samples(spark, d), spacing.over(total(spark, d)))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _counts(g: grid.Spacing) -> str:
    return f"WITH {EV}, {member_sql(g)} SELECT session, epoch, count(*) AS n, round(stddev_pop(value), 6) + 0.0 AS sd FROM ep GROUP BY session, epoch"


@query(_counts(POWER))
def epoch_grid_counts(spark, d) -> DataFrame:
    return epochs(spark, d, POWER).groupBy("session", "epoch").agg(F.count("*").alias("n"), r6(F.stddev_pop("value")).alias("sd"))


@query(_counts(CONN))
def grid_conn_counts(spark, d) -> DataFrame:
    return epochs(spark, d, CONN).groupBy("session", "epoch").agg(F.count("*").alias("n"), r6(F.stddev_pop("value")).alias("sd"))


@query(
    f"WITH {EV}, e AS (SELECT unnest(range({last_sql(POWER)} + 1)) AS epoch)"
    f" SELECT epoch, epoch * {POWER.hop} AS start, epoch * {POWER.hop} + {POWER.win} AS stop, {centre_sql(POWER)} AS t_center, {phase_sql(centre_sql(POWER))} AS phase FROM e"
)
def epoch_centers(spark, d) -> DataFrame:
    e = F.col("epoch")
    ends = (e * POWER.hop).alias("start"), (e * POWER.hop + POWER.win).alias("stop")
    all_epochs = spark.range(POWER.over(total(spark, d)).n).withColumnRenamed("id", "epoch")
    return all_epochs.select("epoch", *ends, grid.centre(POWER).alias("t_center"), grid.phase_of(grid.centre(POWER), PHASES).alias("phase"))


PHASED = f"WITH {EV}, {member_sql(SERIES)}, ph AS (SELECT session, epoch, value, {phase_sql(centre_sql(SERIES))} AS phase FROM ep)"


def phased(spark, d) -> DataFrame:
    return epochs(spark, d, SERIES).withColumn("phase", grid.phase_of(grid.centre(SERIES), PHASES))


@query(f"{PHASED} SELECT session, phase, count(*) AS n, count(DISTINCT epoch) AS epochs FROM ph GROUP BY session, phase")
def epoch_phase_join(spark, d) -> DataFrame:
    return phased(spark, d).groupBy("session", "phase").agg(F.count("*").alias("n"), F.countDistinct("epoch").alias("epochs"))


@query(
    f"WITH {EV}, iv AS (SELECT session, channel AS phase, us AS start, coalesce(lead(us) OVER (PARTITION BY session ORDER BY us, sample), {TOTAL}) AS stop FROM ev)"
    " SELECT session, phase, count(*) AS n, max(stop - start) AS longest FROM iv WHERE stop > start GROUP BY session, phase"
)
def phase_interval_build(spark, d) -> DataFrame:
    iv = grid.intervals(samples(spark, d), F.lit(total(spark, d)), ["session"], "us", ["sample"])
    return iv.groupBy("session", F.col("channel").alias("phase")).agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("us")).alias("longest"))


@query(
    f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY sample) AS i, count(*) OVER (PARTITION BY session) AS c FROM ev)"
    " SELECT session, sample, value FROM n WHERE i > 10 AND i <= c - 5"
)
def edge_trim(spark, d) -> DataFrame:
    n = align.numbered(samples(spark, d), ["session"], ["sample"], align.block_of("us", DAY))
    return n.where("i > 10 AND i <= n - 5").select("session", "sample", "value")


@query(f"WITH {EV} SELECT session, sample, us, value FROM ev WHERE us >= {2 * DAY} AND channel IN ('click', 'view')")
def settle_discard_channel_slice(spark, d) -> DataFrame:
    return samples(spark, d).where(f"us >= {2 * DAY} AND channel IN ('click', 'view')").select("session", "sample", "us", "value")


_LI = "li AS (SELECT l_suppkey AS session, l_returnflag AS channel, l_extendedprice AS value, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem)"
_ORD = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
_MASK = f"{_LI}, m AS (SELECT *, max(value >= 90000) OVER (PARTITION BY session, channel ORDER BY {', '.join(_ORD)} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mask FROM li)"


def masked(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_returnflag").alias("channel"), F.col("l_extendedprice").alias("value"), *_ORD)
    return clean.dilate(li, F.col("value") >= 90000, ["session", "channel"], _ORD, F.date_trunc("month", "l_shipdate"), 5)


@query(f"WITH {_MASK} SELECT session, channel, count(*) AS n, count(*) FILTER (WHERE mask) AS masked FROM m GROUP BY session, channel")
def saturation_mask_dilate(spark, d) -> DataFrame:
    return masked(spark, d).groupBy("session", "channel").agg(F.count("*").alias("n"), F.count_if("mask").alias("masked"))


@query(
    f"WITH {_MASK}, med AS (SELECT session, channel, median(value) AS md FROM m WHERE NOT mask GROUP BY session, channel)"
    " SELECT session, channel, count(*) AS n, round(avg(CASE WHEN mask THEN coalesce(md, 0) ELSE value END), 4) AS level, round(max(CASE WHEN mask THEN coalesce(md, 0) ELSE value END), 4) AS highest"
    " FROM m LEFT JOIN med USING (session, channel) GROUP BY session, channel"
)
def saturation_excise(spark, d) -> DataFrame:
    out = clean.excise(masked(spark, d), "value", "mask", ["session", "channel"])
    return out.groupBy("session", "channel").agg(F.count("*").alias("n"), F.round(F.avg("clean"), 4).alias("level"), F.round(F.max("clean"), 4).alias("highest"))


_TREND = f"WITH {EV}, f AS (SELECT session, channel, regr_slope(value, sample) AS a, regr_intercept(value, sample) AS b, avg(value) AS m, count(*) AS n FROM ev GROUP BY session, channel)"


@query(f"{_TREND} SELECT session, channel, sample, round(value - (a * sample + b), 6) + 0.0 AS flat FROM ev JOIN f USING (session, channel) WHERE n > 2")
def detrend_linear(spark, d) -> DataFrame:
    ev = samples(spark, d)
    enough = ev.groupBy("session", "channel").count().where("count > 2").drop("count")
    return clean.detrend(ev.join(enough, ["session", "channel"], "left_semi"), "value", "sample", ["session", "channel"]).select("session", "channel", "sample", r6("flat").alias("flat"))


@query(f"{_TREND} SELECT session, channel, sample, round(value - m, 6) + 0.0 AS flat FROM ev JOIN f USING (session, channel)")
def detrend_constant(spark, d) -> DataFrame:
    return clean.detrend(samples(spark, d), "value", "sample", ["session", "channel"], linear=False).select("session", "channel", "sample", r6("flat").alias("flat"))


def gate_sql(g: grid.Spacing) -> str:
    return (
        f"WITH {EV}, {member_sql(g)}, dv AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY session, channel, epoch ORDER BY sample)) AS dx FROM ep),"
        " q AS (SELECT session, epoch, channel, max(abs(value)) <= 120 AND coalesce(max(dx), 0) <= 100 AND coalesce(stddev_pop(value), 0) >= 0.5 AS ok,"
        " max(dx) AS step FROM dv GROUP BY session, epoch, channel)"
    )


_GATE = gate_sql(SERIES)


def gated(spark, d, spacing: grid.Spacing = SERIES) -> DataFrame:
    """session, epoch, channel, ok, step: amplitude, step and flatness of each epoch and channel."""
    ep = epochs(spark, d, spacing)
    dv = ep.withColumn("dx", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("session", "channel", "epoch").orderBy("sample"))))
    ok = (F.max(F.abs("value")) <= 120) & (F.coalesce(F.max("dx"), F.lit(0.0)) <= 100) & (F.coalesce(F.stddev_pop("value"), F.lit(0.0)) >= 0.5)
    return dv.groupBy("session", "epoch", "channel").agg(ok.alias("ok"), F.max("dx").alias("step"))


#: Channels that all must be good for a window to stand.
REQUIRED = ("click", "view")


def windows_ok(gates: DataFrame, channels: tuple[str, ...], n: int) -> DataFrame:
    """session, epoch, ok, covered: a window stands only if each channel is good in all of the grid's n epochs that overlap or touch it at its start."""
    good = gates.where(F.col("ok") & F.col("channel").isin(*channels)).groupBy("session", "epoch").agg(F.countDistinct("channel").alias("k")).where(F.col("k") == len(channels))
    held = good.select("session", F.explode(F.sequence(F.col("epoch") - 1, F.col("epoch") + 2)).alias("epoch")).groupBy("session", "epoch").agg(F.count("*").alias("held"))
    grid_ = gates.select("session").distinct().withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    covered = F.least(F.col("epoch") + 1, F.lit(n - 1)) - F.greatest(F.col("epoch") - 2, F.lit(0)) + 1
    return grid_.join(held, ["session", "epoch"], "left").select("session", "epoch", (F.coalesce("held", F.lit(0)) == covered).alias("ok"), covered.cast("long").alias("covered"))


@query(f"{_GATE} SELECT session, epoch, channel, round(step, 6) AS step FROM q WHERE step IS NOT NULL")
def first_difference_gate(spark, d) -> DataFrame:
    return gated(spark, d).where("step IS NOT NULL").select("session", "epoch", "channel", F.round("step", 6).alias("step"))


@query(f"{_GATE} SELECT session, epoch, channel, ok FROM q")
def epoch_quality_gate(spark, d) -> DataFrame:
    return gated(spark, d).select("session", "epoch", "channel", "ok")


def required_sql(g: grid.Spacing) -> str:
    """A window stands only if each required channel is good in every epoch that overlaps or touches it at its start; without rows a channel is bad."""
    return (
        f"{gate_sql(g)}, c AS (SELECT unnest([{', '.join(f"'{c}'" for c in REQUIRED)}]) AS channel),"
        f" t AS (SELECT session, unnest(generate_series(0, {last_sql(g)})) AS epoch FROM (SELECT DISTINCT session FROM q)),"
        f" w AS (SELECT session, epoch AS target, unnest(generate_series(greatest(epoch - 2, 0), least(epoch + 1, {last_sql(g)}))) AS epoch FROM t)"
        " SELECT w.session, target AS epoch, bool_and(coalesce(q.ok, false)) AS ok, count(DISTINCT w.epoch) AS covered FROM w CROSS JOIN c"
        " LEFT JOIN q ON q.session = w.session AND q.epoch = w.epoch AND q.channel = c.channel GROUP BY w.session, target"
    )


@query(required_sql(GATES))
def window_gate_strict(spark, d) -> DataFrame:
    return windows_ok(gated(spark, d, GATES), REQUIRED, GATES.over(total(spark, d)).n)


@query(required_sql(BETWEEN))
def window_gate_required(spark, d) -> DataFrame:
    """The same on a finer grid, where few windows have both channels throughout."""
    return windows_ok(gated(spark, d, BETWEEN), REQUIRED, BETWEEN.over(total(spark, d)).n)


@query(f"WITH {EV}, {member_sql(SERIES)} SELECT session, epoch, bool_or(abs(value / 50 - 1) > 1.2) AS moved, round(avg(abs(value / 50 - 1)), 6) AS motion FROM ep GROUP BY session, epoch")
def motion_gate(spark, d) -> DataFrame:
    m = F.abs(F.col("value") / 50 - 1)
    return epochs(spark, d, SERIES).groupBy("session", "epoch").agg(F.bool_or(m > 1.2).alias("moved"), F.round(F.avg(m), 6).alias("motion"))


@query(
    f"WITH {EV}, s AS (SELECT session, sample - lag(sample) OVER (PARTITION BY session ORDER BY sample) AS step FROM ev)"
    " SELECT session, count(*) FILTER (WHERE abs(step - 1) > 1 AND step >= 0) AS gaps, max(step) AS longest FROM s GROUP BY session"
)
def counter_gaps(spark, d) -> DataFrame:
    return clean.gaps(samples(spark, d), "sample", ["session"]).groupBy("session").agg(F.count_if("gap").alias("gaps"), F.max("step").alias("longest"))


@query(
    f"WITH {EV}, s AS (SELECT session, (us - lag(us) OVER (PARTITION BY session ORDER BY sample)) / 1e6 AS dt FROM ev)"
    " SELECT session, count(dt) AS n, round(median(dt), 3) AS mid, round(quantile_cont(dt, 0.99), 3) AS p99, round(max(dt), 3) AS longest FROM s GROUP BY session"
)
def rate_jitter(spark, d) -> DataFrame:
    s = align.preceding(samples(spark, d), ["session"], "sample", 1 << 20, ["us"]).select("session", ((F.col("us") - F.col("before_us")) / 1e6).alias("dt"))
    return s.groupBy("session").agg(F.count("dt").alias("n"), F.round(F.median("dt"), 3).alias("mid"), F.round(F.percentile("dt", 0.99), 3).alias("p99"), F.round(F.max("dt"), 3).alias("longest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def event_props_json(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 50")


_NAMES = "WITH n AS (SELECT o_orderkey, o_custkey, printf('%d_%s', o_custkey, strftime(o_orderdate, '%H%M%S%d%m%Y')) AS session_name FROM orders)"


def session_names(spark, d) -> DataFrame:
    name = F.concat_ws("_", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "HHmmssddMMyyyy"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", name.alias("session_name"))


@query(f"{_NAMES} SELECT o_orderkey, session_name, split_part(session_name, '_', 1)::BIGINT AS device FROM n")
def session_name_parse(spark, d) -> DataFrame:
    return session_names(spark, d).select("o_orderkey", "session_name", F.split("session_name", "_")[0].cast("long").alias("device"))


@query("SELECT count(*) AS sessions, printf('p%03d', max(regexp_extract(printf('p%03d', c_custkey), 'p([0-9]+)', 1)::BIGINT) + 1) AS next_id FROM customer")
def session_next_id(spark, d) -> DataFrame:
    """One more than the highest number that a session's name has."""
    number = F.regexp_extract(F.format_string("p%03d", "c_custkey"), "p([0-9]+)", 1).cast("long")
    return table(spark, d, "customer").agg(F.count("*").alias("sessions"), F.format_string("p%03d", F.max(number) + 1).alias("next_id"))


@query(
    "WITH s AS (SELECT o_custkey AS device, o_orderkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)"
    " SELECT device, max(session) FILTER (WHERE k = 1) AS latest, list(session ORDER BY k) AS last_three FROM s WHERE k <= 3 GROUP BY device"
)
def latest_sessions(spark, d) -> DataFrame:
    """Of each device the session started last, and its last three, the newest first."""
    newest = F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("session"))
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))
    last = table(spark, d, "orders").withColumn("k", k).where("k <= 3").groupBy(F.col("o_custkey").alias("device"))
    return last.agg(F.max(newest)["session"].alias("latest"), F.transform(F.sort_array(F.collect_list(newest), asc=False), lambda x: x["session"]).alias("last_three"))


@query(
    f"WITH {EV}, {member_sql(SERIES)}, s AS (SELECT session, epoch, avg(value) AS v FROM ep GROUP BY session, epoch), a AS (SELECT session, list(v ORDER BY epoch) AS x FROM s GROUP BY session),"
    " m AS (SELECT session, CASE WHEN len(x) < 5 THEN x ELSE list_transform(range(1, len(x) + 1), lambda i: list_sort(list_transform([-2, -1, 0, 1, 2], lambda k: x[greatest(1, least(len(x), i + k))]))[3]) END AS y FROM a)"
    " SELECT session, len(y) AS n, round(list_sum(y), 4) AS total, round(y[1], 6) AS first FROM m"
)
def moving_median_smooth(spark, d) -> DataFrame:
    from ..functions.spectral import median5

    s = epochs(spark, d, SERIES).groupBy("session", "epoch").agg(F.avg("value").alias("v"))
    a = s.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "v"))), lambda e: e["v"]).alias("x"))
    y = a.select("session", median5(F.col("x")).alias("y"))
    return y.select("session", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), F.round(F.get("y", F.lit(0)), 6).alias("first"))


@query(
    f"WITH {EV}, q AS (SELECT session, unnest(range(0, {TOTAL}, {12 * HOUR})) AS us FROM (SELECT DISTINCT session FROM ev)),"
    " u AS (SELECT session, us, sample, value, NULL::BIGINT AS grid FROM ev UNION ALL SELECT session, us, -1, NULL, us FROM q),"
    " j AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER p AS t0, last_value(value IGNORE NULLS) OVER p AS v0,"
    " first_value(CASE WHEN value IS NOT NULL THEN us END IGNORE NULLS) OVER f AS t1, first_value(value IGNORE NULLS) OVER f AS v1 FROM u"
    " WINDOW p AS (PARTITION BY session ORDER BY us, sample ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY session ORDER BY us, sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    " SELECT session, grid AS us, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (grid - t0) / (t1 - t0) END, 6) + 0.0 AS value FROM j WHERE grid IS NOT NULL AND t0 IS NOT NULL AND t1 IS NOT NULL"
)
def lerp_resample(spark, d) -> DataFrame:
    """Each session on a common grid, by linear interpolation between its neighbours; nothing outside them."""
    ev = samples(spark, d)
    q = ev.select("session").distinct().withColumn("us", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total(spark, d) - 1), F.lit(12 * HOUR))))
    u = ev.select("session", "us", "sample", "value", F.lit(None).cast("long").alias("grid")).unionByName(
        q.select("session", "us", F.lit(-1).cast("long").alias("sample"), F.lit(None).cast("double").alias("value"), F.col("us").alias("grid"))
    )
    w = Window.partitionBy("session").orderBy("us", "sample")
    p, f = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    t = F.when(F.col("value").isNotNull(), F.col("us"))
    j = u.select("session", "grid", F.last(t, True).over(p).alias("t0"), F.last("value", True).over(p).alias("v0"), F.first(t, True).over(f).alias("t1"), F.first("value", True).over(f).alias("v1"))
    v = F.when(F.col("t1") == F.col("t0"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("grid") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return j.where("grid IS NOT NULL AND t0 IS NOT NULL AND t1 IS NOT NULL").select("session", F.col("grid").alias("us"), r6(v).alias("value"))


@query(
    f"WITH {EV}, c AS (SELECT session, channel, count(*) AS n FROM ev GROUP BY session, channel)"
    " SELECT session, list(channel ORDER BY channel) AS channels, coalesce(max(n) FILTER (WHERE channel = 'click'), 0) AS clicks, coalesce(max(n) FILTER (WHERE channel = 'none such'), 0) AS others FROM c GROUP BY session"
)
def session_channels(spark, d) -> DataFrame:
    """The sorted channels of a session, and counts looked up by channel in a map, 0 where it has none."""
    c = samples(spark, d).groupBy("session", "channel").agg(F.count("*").alias("n")).groupBy("session")
    m = c.agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.map_from_entries(F.collect_list(F.struct("channel", "n"))).alias("n"))
    of = lambda k: F.coalesce(F.try_element_at("n", F.lit(k)), F.lit(0).cast("long"))
    return m.select("session", "channels", of("click").alias("clicks"), of("none such").alias("others"))
