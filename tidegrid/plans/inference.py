"""Queries on marker series: two-phase summaries, bootstrap intervals, ranking, cohorts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analysis, grid, selection, stats
from ..operators.stats import rounded
from ..sources.tables import samples, table, total
from .signals import EV, PHASES, SERIES, TOTAL, centre_sql, epochs, member_sql, phase_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: "F.Column | str") -> "F.Column":
    return rounded(c, 6) + F.lit(0.0)


def off_tie(c: "F.Column") -> "F.Column":
    """Rounded to three places, a hair above: means of two short decimals lie on ties, which engines round either way."""
    return rounded(c + 1e-9, 3)


#: The markers of an epoch's values here; null where the epoch has fewer than two values.
STATS = {"energy": "avg(value * value)", "level": "avg(value)", "p2p": "max(value) - min(value)", "sd": "stddev_pop(value)"}

MS = (
    f"WITH {EV}, {member_sql(SERIES)}, st AS (SELECT session, epoch, count(*) AS c, {', '.join(f'{v} AS {k}' for k, v in STATS.items())} FROM ep GROUP BY session, epoch),"
    f" ms AS (SELECT session, epoch, {phase_sql(centre_sql(SERIES))} AS phase, marker, CASE WHEN c >= 2 THEN value END AS value FROM st UNPIVOT (value FOR marker IN ({', '.join(STATS)})))"
)


def series(spark, d) -> DataFrame:
    """session, epoch, phase, marker, value; of all rows, neither cleaned nor gated. An epoch's values are added up in the order of its samples, so that a value
    has the same bits however the rows are split: ranks and spreads of later steps tell equal values from others."""
    held = F.array_sort(F.collect_list(F.struct("sample", "value")))
    known = F.filter(F.transform(held, stats.field("value")), lambda v: v.isNotNull())
    ep = epochs(spark, d, SERIES).groupBy("session", "epoch").agg(F.count("*").alias("c"), known.alias("x"))
    x = F.col("x")
    of = {"energy": stats.mean_in_order(F.transform(x, lambda v: v * v)), "level": stats.mean_in_order(x), "p2p": F.array_max(x) - F.array_min(x), "sd": stats.deviation_in_order(x)}
    st = ep.select("session", "epoch", "c", *[of[k].alias(k) for k in STATS])
    long = st.unpivot(["session", "epoch", "c"], list(STATS), "marker", "v")
    return long.select("session", "epoch", grid.phase_of(grid.centre(SERIES), PHASES).alias("phase"), "marker", F.when(F.col("c") >= 2, F.col("v")).alias("value"))


KEYS = ["session", "marker"]
SM = (
    f"{MS}, s0 AS (SELECT session, marker, count(value) FILTER (WHERE phase = 'CALIBRATION') AS n_baseline, count(value) FILTER (WHERE phase = 'MANTRA') AS n_active,"
    " median(value) FILTER (WHERE phase = 'CALIBRATION') AS ma, median(value) FILTER (WHERE phase = 'MANTRA') AS mb, count(value) / count(*) AS coverage,"
    " 1.4826 * mad(value) FILTER (WHERE phase = 'CALIBRATION') AS sp FROM ms GROUP BY session, marker),"
    " rk AS (SELECT session, marker, phase, rank() OVER (PARTITION BY session, marker ORDER BY value) + (count(*) OVER (PARTITION BY session, marker, value) - 1) / 2.0 AS r FROM ms WHERE value IS NOT NULL AND phase IN ('CALIBRATION', 'MANTRA')),"
    " dl AS (SELECT session, marker, (2 * sum(r) FILTER (WHERE phase = 'MANTRA') - count(*) FILTER (WHERE phase = 'MANTRA') * (count(*) FILTER (WHERE phase = 'MANTRA') + 1))"
    " / nullif((count(*) FILTER (WHERE phase = 'MANTRA') * count(*) FILTER (WHERE phase = 'CALIBRATION'))::DOUBLE, 0) - 1 AS delta FROM rk GROUP BY session, marker),"
    " s1 AS (SELECT session, marker, n_baseline, n_active, coverage, CASE WHEN n_baseline >= 3 AND n_active >= 3 THEN ma END AS baseline, CASE WHEN n_baseline >= 3 AND n_active >= 3 THEN mb END AS active,"
    " CASE WHEN n_baseline >= 3 AND sp > 0 THEN sp END AS spread, delta FROM s0 LEFT JOIN dl USING (session, marker)),"
    " sm AS (SELECT *, CASE WHEN baseline <> 0 THEN (active / baseline - 1) * 100 END AS pct_raw, CASE WHEN abs(baseline) > spread THEN (active / baseline - 1) * 100 END AS pct, (active - baseline) / spread AS std_change FROM s1)"
)


def summary(spark, d) -> DataFrame:
    """The delta comes as twice the won pairs over all pairs, less one, as by ranks: its last bit decides where it lies on a tie of rounding."""
    pairs = F.nullif(F.col("n_baseline") * F.col("n_active"), F.lit(0).cast("long"))
    return analysis.summarise(series(spark, d), KEYS).withColumn("delta", F.rint((F.col("delta") + 1) * pairs) / pairs - 1)


@query(f"{SM} SELECT session, marker, n_baseline, n_active, round(baseline + 1e-9, 3) AS baseline, round(active + 1e-9, 3) AS active, round(spread + 1e-9, 3) AS spread FROM sm")
def phase_median_mad_spread(spark, d) -> DataFrame:
    return summary(spark, d).select(*KEYS, "n_baseline", "n_active", *[off_tie(F.col(c)).alias(c) for c in ("baseline", "active", "spread")])


@query(f"{SM} SELECT session, marker, round(pct_raw, 4) + 0.0 AS pct_raw, round(pct, 4) + 0.0 AS pct FROM sm")
def pct_change_raw_guarded(spark, d) -> DataFrame:
    return summary(spark, d).select(*KEYS, (rounded("pct_raw", 4) + 0.0).alias("pct_raw"), (rounded("pct", 4) + 0.0).alias("pct"))


@query(
    f"{SM} SELECT session, marker, round(delta, 6) + 0.0 AS delta, CASE WHEN abs(round(delta, 9)) < 0.147 THEN 'negligible' WHEN abs(round(delta, 9)) < 0.33 THEN 'small' WHEN abs(round(delta, 9)) < 0.474 THEN 'medium'"
    " WHEN delta IS NOT NULL THEN 'large' ELSE 'undetermined' END AS label FROM sm"
)
def cliffs_delta_rank(spark, d) -> DataFrame:
    return summary(spark, d).select(*KEYS, r6("delta").alias("delta"), stats.delta_label(rounded("delta", 9)).alias("label"))


@query(f"{SM} SELECT session, marker, CASE WHEN active > 0 AND baseline > 0 THEN round(log2(active / baseline), 6) + 0.0 END AS log_ratio FROM sm")
def median_log_ratio(spark, d) -> DataFrame:
    return summary(spark, d).select(*KEYS, F.when((F.col("active") > 0) & (F.col("baseline") > 0), r6(F.log2(F.col("active") / F.col("baseline")))).alias("log_ratio"))


@query(f"{SM} SELECT session, round(avg(coverage), 6) AS coverage, CASE WHEN avg(coverage) >= 0.10 THEN 'full' WHEN avg(coverage) >= 0.02 THEN 'descriptive' ELSE 'insufficient' END AS tier FROM sm GROUP BY session")
def coverage_tier(spark, d) -> DataFrame:
    c = series(spark, d).groupBy(*KEYS).agg((F.count("value") / F.count("*")).alias("c")).groupBy("session").agg(F.avg("c").alias("coverage"))
    return c.select("session", rounded("coverage", 6).alias("coverage"), analysis.tier(F.col("coverage")).alias("tier"))


_RANK = (
    f"{SM}, sc AS (SELECT *, coalesce(abs(pct), abs(std_change)) AS score, coverage < 0.6 AS flagged FROM sm),"
    " rn AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY flagged, round(score, 6) DESC, marker) AS place FROM sc WHERE score > 0)"
)


@query(f"{_RANK} SELECT session, marker, place, flagged, round(score, 4) AS score FROM rn WHERE place <= 3")
def rank_by_variation(spark, d) -> DataFrame:
    return analysis.rank(summary(spark, d), ["session"], 3).select(*KEYS, F.col("place").cast("long").alias("place"), "flagged", rounded("score", 4).alias("score"))


@query(f"{SM} SELECT session, marker, round(pct, 4) + 0.0 AS pct FROM sm WHERE abs(pct) <= 100")
def bars_exclusion(spark, d) -> DataFrame:
    return summary(spark, d).where(F.abs("pct") <= 100).select(*KEYS, (rounded("pct", 4) + 0.0).alias("pct"))


@query(f"{SM} SELECT session, marker, CASE WHEN n_baseline < 3 AND n_active >= 3 THEN 'no reference' WHEN baseline IS NULL THEN 'no data' ELSE CASE WHEN std_change > 0 THEN 'up' WHEN std_change < 0 THEN 'down' ELSE 'stable' END END AS verdict FROM sm")
def marker_verdict(spark, d) -> DataFrame:
    v = F.when((F.col("n_baseline") < 3) & (F.col("n_active") >= 3), "no reference").when(F.col("baseline").isNull(), "no data")
    return summary(spark, d).select(*KEYS, v.otherwise(F.when(F.col("std_change") > 0, "up").when(F.col("std_change") < 0, "down").otherwise("stable")).alias("verdict"))


_COHORT = f"{SM}, us AS (SELECT * FROM sm WHERE n_baseline >= 5 AND spread > 0 AND abs(std_change) <= 20)"


def usable(spark, d) -> DataFrame:
    return summary(spark, d).where("n_baseline >= 5 AND spread > 0 AND abs(std_change) <= 20")


@query(
    f"{_COHORT}, c AS (SELECT marker, count(std_change) AS n, median(pct) AS mp, median(std_change) AS md, count(*) FILTER (WHERE std_change > 0) AS n_up FROM us GROUP BY marker),"
    " p AS (SELECT *, least(1.0, 2 * list_sum(list_transform(range(least(n_up, n - n_up) + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0))))) AS p FROM c)"
    " SELECT marker, n, round(mp, 4) + 0.0 AS median_pct, round(md, 6) + 0.0 AS median_std, n_up, n - n_up AS n_down, round(p, 6) AS p, p < 0.05 AND n >= 5 AS consistent, CASE WHEN md > 0 THEN 'up' ELSE 'down' END AS direction FROM p"
)
def cohort_aggregate(spark, d) -> DataFrame:
    c = analysis.cohort(usable(spark, d))
    return c.select("marker", "n", (rounded("median_pct", 4) + 0.0).alias("median_pct"), r6("median_std").alias("median_std"), "n_up", "n_down", rounded("p", 6).alias("p"), "consistent", "direction")


@query(
    f"{_COHORT}, c AS (SELECT marker, count(std_change) AS n, median(std_change) AS md FROM us GROUP BY marker HAVING count(std_change) >= 3)"
    " SELECT marker, n, row_number() OVER (ORDER BY abs(round(md, 9)) DESC, marker) AS position FROM c"
)
def cohort_order(spark, d) -> DataFrame:
    """The markers that three sessions or more tell of, the largest median change first. One row a marker, so the order is found in one task."""
    c = analysis.cohort(usable(spark, d)).where("n >= 3")
    position = F.row_number().over(Window.orderBy(F.abs(rounded("median_std", 9)).desc(), "marker"))
    return c.select("marker", "n", position.cast("long").alias("position"))


@query(f"{SM} SELECT session, count(*) FILTER (WHERE n_baseline >= 5 AND spread > 0 AND abs(std_change) <= 20) AS kept, count(*) FILTER (WHERE n_baseline >= 5 AND spread > 0 AND abs(std_change) > 20) AS degenerate, round(avg(coverage), 6) AS coverage FROM sm GROUP BY session")
def session_summary_degenerate(spark, d) -> DataFrame:
    enough = "n_baseline >= 5 AND spread > 0 AND abs(std_change)"
    return summary(spark, d).groupBy("session").agg(
        F.coalesce(F.count_if(F.expr(f"{enough} <= 20")), F.lit(0)).alias("kept"), F.coalesce(F.count_if(F.expr(f"{enough} > 20")), F.lit(0)).alias("degenerate"), rounded(F.avg("coverage"), 6).alias("coverage")
    )


@query(f"{_COHORT} SELECT DISTINCT session, session IN (SELECT session FROM us) AS included FROM sm")
def included_excluded_sessions(spark, d) -> DataFrame:
    s = summary(spark, d)
    kept = s.where("n_baseline >= 5 AND spread > 0 AND abs(std_change) <= 20").select("session").distinct().withColumn("included", F.lit(True))
    return s.select("session").distinct().join(kept, "session", "left").select("session", F.coalesce("included", F.lit(False)).alias("included"))


_IX = f"{MS}, ix AS (SELECT session, (row_number() OVER (PARTITION BY session ORDER BY epoch) - 1) AS i, value FROM ms WHERE marker = 'level' AND value IS NOT NULL)"


def indexed(spark, d) -> DataFrame:
    s = series(spark, d).where("marker = 'level' AND value IS NOT NULL")
    return s.select("session", (F.row_number().over(Window.partitionBy("session").orderBy("epoch")) - 1).cast("long").alias("i"), "value")


@query(
    f"{_IX}, m AS (SELECT session, avg(value) AS m, count(*) AS n, var_pop(value) AS v FROM ix GROUP BY session), x AS (SELECT session, i, value - m AS x FROM ix JOIN m USING (session)),"
    " a AS (SELECT p.session, p.i - q.i AS lag, sum(p.x * q.x) AS s FROM x p JOIN x q ON p.session = q.session AND p.i >= q.i GROUP BY ALL),"
    " f AS (SELECT a.session, min(a.lag) AS f FROM a JOIN (SELECT session, s AS s0 FROM a WHERE lag = 0) z USING (session) WHERE a.lag > 0 AND a.s / z.s0 < 0.3679 GROUP BY a.session),"
    " l AS (SELECT session, n, CASE WHEN n < 4 OR v = 0 THEN 1 ELSE coalesce(f, n // 2) END AS lag FROM m LEFT JOIN f USING (session))"
    " SELECT session, n, lag, least(greatest(2 * lag, 4), 12) AS block FROM l"
)
def acf_lag_block_length(spark, d) -> DataFrame:
    lag = stats.decorrelation_lag(indexed(spark, d), "value", "i", ["session"])
    return lag.select("session", "n", "lag", stats.block_length(F.col("lag"), 4, 12).cast("long").alias("block"))


def hash_sql(e: str) -> str:
    """stats.hash32 of a whole number below 2 ** 32."""
    turn = "lambda x: (xor(x >> 16, x) * 73244475) % 4294967296"
    return f"list_transform(list_transform(list_transform([({e})::BIGINT], {turn}), {turn}), lambda x: xor(x >> 16, x))[1]"


def reps_sql(reps: int, streams: int = 4) -> str:
    """rp: each replicate's part of the hash, by stream."""
    return f"rp AS (SELECT rep, {', '.join(f'{hash_sql(f'rep * 16 + {s}')} AS h{s}' for s in range(streams))} FROM range({reps}) t(rep))"


def uniform_sql(stream: int) -> str:
    """stats.uniforms of a replicate and a place i."""
    return f"({hash_sql(f'(h{stream} + i) % 4294967296')} / 4294967296.0)"


REPS = 200


@query(
    f"{_IX}, n AS (SELECT session, count(*) AS n FROM ix GROUP BY session), {reps_sql(REPS, 2)}, dr AS (SELECT session, i, n, rep, h0, h1 FROM ix JOIN n USING (session), rp),"
    f" an AS (SELECT *, last_value(CASE WHEN i = 0 OR {uniform_sql(0)} < 0.25 THEN floor({uniform_sql(1)} * n)::BIGINT - i END IGNORE NULLS) OVER (PARTITION BY session, rep ORDER BY i) AS a FROM dr),"
    " pk AS (SELECT session, rep, (a + i) % n AS i FROM an), sb AS (SELECT session, rep, median(value) AS stat FROM pk JOIN ix USING (session, i) GROUP BY session, rep)"
    " SELECT session, count(*) AS reps, round(quantile_cont(stat, 0.025) + 1e-9, 3) AS ci_low, round(quantile_cont(stat, 0.975) + 1e-9, 3) AS ci_high FROM sb GROUP BY session"
)
def stationary_bootstrap_ci(spark, d) -> DataFrame:
    """Of the median of each session's level, by blocks of 4 on average; effect_bootstrap_ci has the interval of the two-phase effect."""
    arrays = stats.series_arrays(indexed(spark, d), "value", "i", ["session"], x=F.lit(True))
    st = stats.over_arrays(arrays, ["session"], ["x"], {"stat": pa.list_(pa.float64())}, lambda x: (stats.median_replicates(x, 4.0, REPS),))
    point = lambda q: off_tie(F.percentile("s", q))
    return st.withColumn("s", F.explode("stat")).groupBy("session").agg(F.count("*").alias("reps"), point(0.025).alias("ci_low"), point(0.975).alias("ci_high"))


@query(
    f"{_COHORT}, {reps_sql(4000, 2)}, sx AS (SELECT marker, row_number() OVER (PARTITION BY marker ORDER BY std_change) - 1 AS i, std_change AS value FROM us WHERE std_change IS NOT NULL),"
    f" cn AS (SELECT marker, count(*) AS n FROM sx GROUP BY marker), dr AS (SELECT marker, rep, floor({uniform_sql(1)} * n)::BIGINT AS i FROM sx JOIN cn USING (marker), rp),"
    " sb AS (SELECT marker, rep, median(value) AS stat FROM dr JOIN sx USING (marker, i) GROUP BY marker, rep),"
    " q AS (SELECT marker, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM sb GROUP BY marker)"
    " SELECT marker, n, CASE WHEN n >= 3 THEN round(lo + 1e-9, 3) END AS ci_low, CASE WHEN n >= 3 THEN round(hi + 1e-9, 3) END AS ci_high FROM cn LEFT JOIN q USING (marker)"
)
def session_median_ci(spark, d) -> DataFrame:
    """Per marker the interval of the sessions' median standardised change, by 4,000 resamples. Draws go by the order of the values."""
    ci = selection.median_intervals(usable(spark, d), "std_change", ["marker"])
    return ci.select("marker", "n", off_tie(F.col("ci_low")).alias("ci_low"), off_tie(F.col("ci_high")).alias("ci_high"))


@query()
def effect_bootstrap_ci(spark, d) -> DataFrame:
    """The summary of each session and marker with the interval of active less baseline: 2,000 replicates of both phases in blocks of computed length."""
    s = series(spark, d)
    return analysis.summarise(s, KEYS).join(stats.effects(s, KEYS, analysis.A, analysis.B, (4, 12)), KEYS)


@query(
    f"{MS}, w AS (SELECT session, epoch, max(value) FILTER (WHERE marker = 'level') AS x, max(value) FILTER (WHERE marker = 'p2p') AS y FROM ms GROUP BY session, epoch),"
    " k AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY x) + (count(*) OVER (PARTITION BY session, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY session ORDER BY y) + (count(*) OVER (PARTITION BY session, y) - 1) / 2.0 AS ry FROM w WHERE x IS NOT NULL AND y IS NOT NULL)"
    " SELECT session, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(rx, ry), 6) + 0.0 END AS rho FROM k GROUP BY session"
)
def spearman_index(spark, d) -> DataFrame:
    of = lambda m: F.max(F.when(F.col("marker") == m, F.col("value")))
    w = series(spark, d).groupBy("session", "epoch").agg(of("level").alias("x"), of("p2p").alias("y"))
    return stats.spearman(w, "x", "y", ["session"]).select("session", "n", r6("rho").alias("rho"))


@query(
    f"WITH {EV}, iv AS (SELECT session, channel AS label, sample, us AS start, coalesce(lead(us) OVER (PARTITION BY session ORDER BY us, sample), {TOTAL}) AS stop FROM ev),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY session, label ORDER BY stop - start DESC, sample) AS k FROM iv) SELECT session, label, start, stop FROM r WHERE k = 1"
)
def longest_segment(spark, d) -> DataFrame:
    iv = grid.intervals(samples(spark, d), F.lit(total(spark, d)), ["session"], "us", ["sample"])
    best = iv.groupBy("session", F.col("channel").alias("label")).agg(F.max(F.struct((F.col("end") - F.col("us")).alias("len"), (-F.col("sample")).alias("m"), "us", "end")).alias("b"))
    return best.select("session", "label", F.col("b.us").alias("start"), F.col("b.end").alias("stop"))


@query(
    "SELECT o_orderkey, CASE WHEN w < 4 THEN 0 ELSE (w - 4) // 2 + 1 END AS power, CASE WHEN w < 10 THEN 0 ELSE (w - 10) // 5 + 1 END AS conn, CASE WHEN (CASE WHEN w < 4 THEN 0 ELSE (w - 4) // 2 + 1 END) >= 25 THEN 'ok'"
    " WHEN (CASE WHEN w < 4 THEN 0 ELSE (w - 4) // 2 + 1 END) >= 10 THEN 'thin' ELSE 'insufficient' END AS adequacy FROM (SELECT o_orderkey, o_custkey % 100 AS w FROM orders)"
)
def reference_adequacy(spark, d) -> DataFrame:
    n = lambda win, hop: F.when(F.col("w") < win, F.lit(0).cast("long")).otherwise(F.floor((F.col("w") - win) / hop) + 1)
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("w")).withColumn("power", n(4, 2))
    return o.select("o_orderkey", "power", n(10, 5).alias("conn"), F.when(F.col("power") >= 25, "ok").when(F.col("power") >= 10, "thin").otherwise("insufficient").alias("adequacy"))


@query(
    "WITH g AS (SELECT l_suppkey AS session, count(*) AS n, sum(l_quantity) AS x, sum(l_discount) AS z, sum(l_extendedprice) AS y, sum(l_quantity*l_quantity) AS xx, sum(l_discount*l_discount) AS zz, sum(l_quantity*l_discount) AS xz,"
    " sum(l_quantity*l_extendedprice) AS xy, sum(l_discount*l_extendedprice) AS zy FROM lineitem GROUP BY l_suppkey), c AS (SELECT session, n, xx-x*x/n AS a, zz-z*z/n AS b, xz-x*z/n AS c, xy-x*y/n AS p, zy-z*y/n AS q FROM g)"
    " SELECT session, n, round((p*b-q*c)/(a*b-c*c), 2) AS slope_quantity, round((q*a-p*c)/(a*b-c*c), 1) AS slope_discount FROM c WHERE a*b-c*c > 0"
)
def ols_two_regressors(spark, d) -> DataFrame:
    """Two regressors and a constant, by normal equations from sums: one aggregation for any number of samples."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("session")).agg(
        F.count("*").alias("n"),
        *[F.sum(F.expr(e)).alias(k) for k, e in {
            "x": "l_quantity", "z": "l_discount", "y": "l_extendedprice", "xx": "l_quantity*l_quantity", "zz": "l_discount*l_discount", "xz": "l_quantity*l_discount",
            "xy": "l_quantity*l_extendedprice", "zy": "l_discount*l_extendedprice",
        }.items()],
    )
    c = g.selectExpr("session", "n", "xx-x*x/n a", "zz-z*z/n b", "xz-x*z/n c", "xy-x*y/n p", "zy-z*y/n q").where("a*b-c*c > 0")
    return c.selectExpr("session", "n", "round((p*b-q*c)/(a*b-c*c), 2) AS slope_quantity", "round((q*a-p*c)/(a*b-c*c), 1) AS slope_discount")


@query(
    f"{SM}, sc AS (SELECT *, coalesce(abs(pct), abs(std_change)) AS score, coverage < 0.6 AS flagged FROM sm),"
    " rn AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY flagged, round(score, 6) DESC, marker)::INT AS place FROM sc WHERE score > 0),"
    " it AS (SELECT session, place, struct_pack(place := place, marker := marker, pct := round(pct, 2) + 0.0, std_change := round(std_change, 3) + 0.0, coverage := round(coverage, 3),"
    " text := CASE WHEN pct IS NULL THEN concat('D', printf('%+.3f', round(delta, 3) + 0.0)) ELSE concat(printf('%+.0f', round(pct) + 0.0), '%') END) AS item FROM rn WHERE place <= 6)"
    " SELECT session, to_json(struct_pack(metrics := list(item ORDER BY place)))::VARCHAR AS payload FROM it GROUP BY session"
)
def payload_json(spark, d) -> DataFrame:
    """One JSON document for each session: its markers in rank order."""
    r = analysis.rank(summary(spark, d), ["session"], 6)
    figures = [(rounded(c, n) + 0.0).alias(c) for c, n in (("pct", 2), ("std_change", 3), ("coverage", 3))]
    item = F.struct("place", "marker", *figures, analysis.change_text(F.col("delta"), F.col("pct")).alias("text"))
    document = F.struct(F.array_sort(F.collect_list(item)).alias("metrics"))
    return r.groupBy("session").agg(F.to_json(document, {"ignoreNullFields": "false"}).alias("payload"))
