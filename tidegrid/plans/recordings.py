"""Whole recordings: windows of eight channels, the registry's markers on them, the quality gate, effects with intervals, segment comparison, montage checks.

The vectors stand in for recorded windows: eight in a row are one window of one second at 64 Hz (F3 F4 C3 C4 Fp1 Fp2, an accelerometer, a gyroscope),
thirty windows in a row a session, of which the first thirteen are its baseline. Limits are those of unit vectors; they are parameters of the functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexity, markers
from ..functions import spectral as S
from ..operators import analysis, stats
from ..operators.recursive import cut
from ..sources.tables import vectors
from .inference import hash_sql, reps_sql
from .signals import r6

CHANNELS = ("F3", "F4", "C3", "C4", "Fp1", "Fp2", "ACC", "GYR")
EEG, MOTION = CHANNELS[:6], CHANNELS[6:]
N, WINDOWS, BASELINE = 64, 30, 13
FS = float(N)
#: Shortest and longest blocks of the bootstrap, in windows.
BLOCK = (2, 6)
#: Bands whose shares of the whole tell of artefacts, at this rate.
ARTEFACTS = {"emg": (22, 31), "emg_wide": (18, 31), "line": (15, 17)}
LIMITS = {"amplitude": 0.42, "step": 0.62, "flat": 0.05, "emg": 0.4, "line": 0.12, "acc": 0.40, "gyr": 0.42}
KEYS = ["session", "marker"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- windows and markers

SESSION_SQL = f"e // {WINDOWS} AS session, e % {WINDOWS} AS epoch, CASE WHEN e % {WINDOWS} < {BASELINE} THEN '{analysis.A}' ELSE '{analysis.B}' END AS phase"
X_SQL = "x AS (SELECT vec_id // 8 AS e, vec_id % 8 AS c, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def bands_sql(bands: dict) -> str:
    return ", ".join(f"sum(area) FILTER (WHERE freq > {lo} AND freq <= {hi}) AS {k}" for k, (lo, hi) in bands.items())


#: Bands whose power is wanted beside those of the markers: the flanks of alpha, and those that tell of artefacts.
MORE_BANDS = {"low": (5, 7), "high": (15, 25)} | ARTEFACTS
SPECTRAL_BANDS = markers.POWERS | MORE_BANDS
PSD_SQL = (
    f"WITH {X_SQL}, y AS (SELECT e, c, n, (x[n + 1] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS y FROM x, range(64) t(n) WHERE c < 6),"
    " psd AS (SELECT e, c, f AS freq, (CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END) * (pow(sum(y * cos(2 * pi() * ((f * n) % 64) / 64)), 2)"
    " + pow(sum(y * sin(2 * pi() * ((f * n) % 64) / 64)), 2)) / (64 * 24.0) AS power FROM y, range(33) t(f) GROUP BY e, c, f),"
    " tz AS (SELECT *, (power + lag(power) OVER (PARTITION BY e, c ORDER BY freq)) / 2 AS area FROM psd),"
    f" bp AS (SELECT e, c, {bands_sql(SPECTRAL_BANDS)} FROM tz GROUP BY e, c)"
)
CHANNEL_SQL = (
    f"{PSD_SQL}, f3 AS (SELECT e, c, regr_slope(log10(power), log10(freq)) AS slope FROM psd WHERE freq BETWEEN 3 AND 30 AND freq NOT BETWEEN 8 AND 12 GROUP BY e, c),"
    " f2 AS (SELECT e, c, regr_slope(log10(power), log10(freq)) AS a, regr_intercept(log10(power), log10(freq)) AS b FROM psd"
    " WHERE freq BETWEEN 2 AND 30 AND freq NOT BETWEEN 7 AND 14 GROUP BY e, c),"
    " ex AS (SELECT e, c, freq, greatest(power - pow(10, b + a * log10(greatest(freq, 1e-9))), 0) AS v FROM psd JOIN f2 USING (e, c)),"
    " ea AS (SELECT *, (v + lag(v) OVER (PARTITION BY e, c ORDER BY freq)) / 2 AS area FROM ex),"
    " pp AS (SELECT e, c, sum(area) FILTER (WHERE freq > 8 AND freq <= 12) AS peak FROM ea GROUP BY e, c),"
    " sq AS (SELECT e, c, power / sum(power) OVER (PARTITION BY e, c) AS q FROM psd WHERE freq BETWEEN 1 AND 31 AND power > 0),"
    " en AS (SELECT e, c, -sum(q * ln(q)) / ln(count(*)) AS entropy FROM sq GROUP BY e, c),"
    " ch AS (SELECT * FROM bp JOIN f3 USING (e, c) JOIN pp USING (e, c) JOIN en USING (e, c))"
)
GROUPS = {markers.FOUR: "c < 4", markers.FRONT: "c < 2", markers.CENTRE: "c IN (2, 3)"}


def of_channels(value: str, channels: tuple[str, ...]) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {GROUPS[channels]}) = {len(channels)} THEN avg({value}) FILTER (WHERE {GROUPS[channels]}) END"


PSD_MARKERS_SQL = (
    f"{CHANNEL_SQL}, m0 AS (SELECT e, {of_channels('alpha / total', markers.FOUR)} AS alpha_rel, {of_channels('beta / total', markers.FRONT)} AS beta_rel,"
    f" {of_channels('smr / total', markers.CENTRE)} AS smr_rel, {of_channels('theta / total', markers.FRONT)} AS theta_rel,"
    " CASE WHEN count(*) FILTER (WHERE c < 2) = 2 THEN ln(max(alpha) FILTER (WHERE c = 1)) - ln(max(alpha) FILTER (WHERE c = 0)) END AS faa,"
    f" {of_channels('-slope', markers.FOUR)} AS ap_exponent, {of_channels('peak', markers.FOUR)} AS alpha_peak_power, {of_channels('entropy', markers.FOUR)} AS spectral_entropy"
    " FROM ch GROUP BY e), mp AS (SELECT *, CASE WHEN beta_rel > 0 THEN alpha_rel / beta_rel END AS alpha_beta FROM m0)"
)
PAIRS_SQL = (
    "g AS (SELECT e, c, s, x[8 * s + 1 : 8 * s + 16] AS x FROM x, range(7) t(s) WHERE c < 2), gk AS (SELECT e, c, s, n, x[n + 1] AS v FROM g, range(16) t(n)),"
    " gl AS (SELECT e, c, s, n, v - (regr_slope(v, n) OVER w * n + regr_intercept(v, n) OVER w) AS v FROM gk WINDOW w AS (PARTITION BY e, c, s)),"
    " gf AS (SELECT e, c, s, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * cos(2 * pi() * (2 * n) / 16)) AS re, -sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * sin(2 * pi() * (2 * n) / 16)) AS im"
    " FROM gl GROUP BY e, c, s), gc AS (SELECT a.e, a.s, a.re * b.re + a.im * b.im AS cr, a.im * b.re - a.re * b.im AS ci, a.re * a.re + a.im * a.im AS xx, b.re * b.re + b.im * b.im AS yy"
    " FROM gf a JOIN gf b ON a.e = b.e AND a.s = b.s AND a.c = 0 AND b.c = 1),"
    " mq AS (SELECT e, (pow(avg(cr), 2) + pow(avg(ci), 2)) / (avg(xx) * avg(yy)) AS coh_alpha1, (pow(avg(cr), 2) + pow(avg(ci), 2)) / (avg(xx) * avg(yy)) AS coh_theta2,"
    " abs(avg(ci)) / sqrt(avg(xx) * avg(yy)) AS imcoh_alpha1,"
    " CASE WHEN pow(sum(abs(ci)), 2) > sum(ci * ci) THEN (pow(sum(ci), 2) - sum(ci * ci)) / (pow(sum(abs(ci)), 2) - sum(ci * ci)) END AS wpli_alpha1 FROM gc GROUP BY e)"
)


def placed(df: DataFrame) -> DataFrame:
    """With the session, epoch and phase of the window e."""
    epoch = F.col("e") % WINDOWS
    return df.withColumns({"session": F.floor(F.col("e") / WINDOWS), "epoch": epoch, "phase": F.when(epoch < BASELINE, analysis.A).otherwise(analysis.B)})


def channels(spark, d) -> DataFrame:
    """e, c, x: one row for each window and channel, c being its place in CHANNELS."""
    return vectors(spark, d).select(F.floor(F.col("vec_id") / 8).alias("e"), (F.col("vec_id") % 8).cast("int").alias("c"), "x")


def by_channel(value: str, tag: str, names: tuple[str, ...]) -> list[Column]:
    """Aggregates that put a column of the channels' rows side by side: null for a channel without a row."""
    return [F.max(F.when(F.col("c") == CHANNELS.index(k), F.col(value))).alias(f"{tag}_{k}") for k in names]


def windows(spark, d) -> DataFrame:
    """e, session, epoch, phase and the samples x_<channel> of each window; a channel without samples is null."""
    rows = channels(spark, d)
    return placed(rows.groupBy("e").agg(*by_channel("x", "x", CHANNELS)))


def sd_of(x: Column) -> Column:
    return F.sqrt(S.mean(S.once(S.mean(x), lambda m: F.transform(x, lambda v: (v - m) * (v - m)))))


def highest(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def described(spark, d, lziv: bool = False) -> DataFrame:
    """e, c, x and f, a struct of the channel's features in the window: amplitude, step, deviation, mean size, then those of its spectrum (and complexity).
    The samples are dealt by windows first: else the features, which cost most, would be computed in as few tasks as the file has splits."""
    x = F.col("x")
    steps = F.zip_with(F.slice(x, 2, N - 1), F.slice(x, 1, N - 1), lambda a, b: F.abs(a - b))
    rows = channels(spark, d).repartition("e").withColumn("p", S.periodogram(x, N, FS))
    if lziv:
        rows = rows.withColumn("lziv", complexity.lempel_ziv(x))
    plain = [highest(x).alias("amplitude"), F.array_max(steps).alias("step"), sd_of(x).alias("sd"), S.mean(F.transform(x, F.abs)).alias("size")]
    found = rows.select("e", "c", "x", *plain, *markers.channel_features(F.col("p"), MORE_BANDS), *(["lziv"] if lziv else []))
    return found.select("e", "c", "x", F.struct(*[c for c in found.columns if c not in ("e", "c", "x")]).alias("f"))


def measured(spark, d, pairs: bool = False, lziv: bool = False) -> DataFrame:
    """e, session, epoch, phase and the features f_<channel> of each window; with pairs, the coherence measures of the front pair by band, pair_<band>."""
    rows = described(spark, d, lziv)
    cols = by_channel("f", "f", CHANNELS) + (by_channel("x", "x", markers.FRONT) if pairs else [])
    out = placed(rows.groupBy("e").agg(*cols))
    if not pairs:
        return out
    of = lambda b: complexity.pair_measures(F.col("x_F3"), F.col("x_F4"), FS, 16, S.BANDS[b], least=7)
    return out.withColumns({f"pair_{b}": of(b) for b in ("alpha1", "theta2")}).drop("x_F3", "x_F4")


def columns() -> markers.Window:
    of = lambda tag, names: {c: F.col(f"{tag}_{c}") for c in names}
    return markers.Window(of("f", CHANNELS), of("pair", ("alpha1", "theta2")))


def values(df: DataFrame, wanted: list[markers.Marker], keep: list[str]) -> DataFrame:
    """keep, marker, value: the wanted markers of each window."""
    cols = markers.marker_columns(columns(), wanted)
    return df.select(*keep, *cols).unpivot(keep, [m.id for m in wanted], "marker", "value")


PLACE = ["session", "epoch", "phase"]


def long_sql(table: str, ids: list[str]) -> str:
    return f"SELECT session, epoch, phase, marker, value FROM (SELECT {SESSION_SQL}, {', '.join(ids)} FROM {table}) UNPIVOT INCLUDE NULLS (value FOR marker IN ({', '.join(ids)}))"


PSD_IDS, PAIR_IDS = [m.id for m in markers.markers(kind="psd")], [m.id for m in markers.markers(kind="pair")]


@query(f"{PSD_MARKERS_SQL} SELECT session, epoch, phase, marker, round(value, 6) + 0.0 AS value FROM ({long_sql('mp', PSD_IDS)})")
def markers_psd(spark, d) -> DataFrame:
    return values(measured(spark, d), markers.markers(kind="psd"), PLACE).withColumn("value", r6("value"))


@query(f"WITH {X_SQL}, {PAIRS_SQL} SELECT session, epoch, phase, marker, round(value, 6) + 0.0 AS value FROM ({long_sql('mq', PAIR_IDS)})")
def markers_pair(spark, d) -> DataFrame:
    return values(measured(spark, d, pairs=True), markers.markers(kind="pair"), PLACE).withColumn("value", r6("value"))


@query()
def markers_timeseries(spark, d) -> DataFrame:
    return values(measured(spark, d, lziv=True), markers.markers(kind="timeseries"), PLACE).withColumn("value", r6("value"))


# --- artefacts and the gate

IX_SQL = (
    f"{PSD_SQL}, ix AS (SELECT e, median(emg / total) AS emg, median(emg_wide / total) AS emg_wide, median(line / total) AS line FROM bp GROUP BY e),"
    f" mv AS (SELECT e, max(list_max(list_transform(x, lambda v: abs(v)))) FILTER (WHERE c = 6) > {LIMITS['acc']} OR max(list_max(list_transform(x, lambda v: abs(v)))) FILTER (WHERE c = 7) > {LIMITS['gyr']} AS moved,"
    " avg(list_avg(list_transform(x, lambda v: abs(v)))) FILTER (WHERE c = 6) + avg(list_avg(list_transform(x, lambda v: abs(v)))) FILTER (WHERE c = 7) / 100 AS motion FROM x WHERE c >= 6 GROUP BY e)"
)
Q_SQL = (
    f"{IX_SQL}, dv AS (SELECT e, c, list_max(list_transform(x, lambda v: abs(v))) AS amplitude, list_max(list_transform(range(1, 64), lambda i: abs(x[i + 1] - x[i]))) AS step, list_stddev_pop(x) AS sd FROM x WHERE c < 6),"
    f" q AS (SELECT dv.e, c, amplitude <= {LIMITS['amplitude']} AND step <= {LIMITS['step']} AND sd >= {LIMITS['flat']} AND coalesce(emg, 1) <= {LIMITS['emg']} AND coalesce(line, 1) <= {LIMITS['line']}"
    " AND NOT coalesce(moved, true) AS ok FROM dv LEFT JOIN ix ON dv.e = ix.e LEFT JOIN mv ON dv.e = mv.e)"
)


def middle(items: list[Column]) -> Column:
    """The median of the known ones."""
    v = F.array_sort(F.filter(F.array(*items), lambda x: x.isNotNull()))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def artefacts(df: DataFrame) -> DataFrame:
    """measured with emg, emg_wide and line (medians over channels of a band's share), motion, moved: null where channels are missing."""
    f = columns().channel
    shares = {k: middle([F.when(f[c]["total"] > 0, f[c][k] / f[c]["total"]) for c in EEG]) for k in ARTEFACTS}
    moved = (f["ACC"]["amplitude"] > LIMITS["acc"]) | (f["GYR"]["amplitude"] > LIMITS["gyr"])
    return df.withColumns(shares | {"motion": f["ACC"]["size"] + f["GYR"]["size"] / 100, "moved": moved})


def gate(df: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """artefacts with ok_<channel>: amplitude, step, flatness, muscle and line shares within limits and no motion; what is unknown fails."""
    shared = (F.coalesce("emg", F.lit(1.0)) <= limits["emg"]) & (F.coalesce("line", F.lit(1.0)) <= limits["line"]) & ~F.coalesce("moved", F.lit(True))
    f = columns().channel
    own = lambda c: (f[c]["amplitude"] <= limits["amplitude"]) & (f[c]["step"] <= limits["step"]) & (f[c]["sd"] >= limits["flat"])
    return df.withColumns({f"ok_{c}": F.coalesce(own(c) & shared, F.lit(False)) for c in EEG})


@query(f"{IX_SQL} SELECT {SESSION_SQL}, round(emg, 6) AS emg, round(emg_wide, 6) AS emg_wide, round(line, 6) AS line, moved, round(motion, 6) AS motion FROM ix LEFT JOIN mv USING (e)")
def artifact_indices(spark, d) -> DataFrame:
    cols = [F.round(c, 6).alias(c) for c in ("emg", "emg_wide", "line")]
    return artefacts(measured(spark, d)).select(*PLACE, *cols, "moved", F.round("motion", 6).alias("motion"))


NAMES_SQL = "['" + "', '".join(EEG) + "'][c + 1]"


@query(f"{Q_SQL} SELECT {SESSION_SQL}, {NAMES_SQL} AS channel, ok FROM q")
def quality_gate_full(spark, d) -> DataFrame:
    rows = gate(artefacts(measured(spark, d)))
    long = rows.select(*PLACE, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"ok_{c}").alias("ok"), F.col(f"f_{c}").isNotNull().alias("there")) for c in EEG])).alias("v"))
    return long.where("v.there").select(*PLACE, "v.channel", "v.ok")


@query(f"{Q_SQL}, t AS (SELECT e, bool_and(ok) FILTER (WHERE c < 4) AND count(*) FILTER (WHERE c < 4) = 4 AS ok FROM q GROUP BY e) SELECT session, list(epoch ORDER BY epoch) AS times, list(ok ORDER BY epoch) AS ok FROM (SELECT {SESSION_SQL}, ok FROM t) GROUP BY session")
def coverage_trace(spark, d) -> DataFrame:
    """Per session the windows in which all four metric channels are good."""
    good = F.col("ok_F3") & F.col("ok_F4") & F.col("ok_C3") & F.col("ok_C4")
    rows = gate(artefacts(measured(spark, d))).select("session", "epoch", good.alias("ok"))
    pairs = F.array_sort(F.collect_list(F.struct("epoch", "ok")))
    return rows.groupBy("session").agg(pairs.alias("v")).select("session", F.transform("v", stats.field("epoch")).alias("times"), F.transform("v", stats.field("ok")).alias("ok"))


# --- gated series, summaries, effects

GOOD_SQL = "gd AS (SELECT e, " + ", ".join(f"bool_and(ok) FILTER (WHERE {cond}) AND count(*) FILTER (WHERE {cond}) = {len(names)} AS {tag}" for (names, cond), tag in zip(GROUPS.items(), ("four", "front", "centre"))) + " FROM q GROUP BY e)"
TAG = {markers.FOUR: "four", markers.FRONT: "front", markers.CENTRE: "centre"}
#: The markers that SQL can follow.
WANTED = [m for m in markers.MARKERS if m.kind != "timeseries"]
ALL_SQL = (
    f"{PSD_MARKERS_SQL}, {Q_SQL.split('bp AS', 1)[1].split('GROUP BY e, c), ', 1)[1]}, {GOOD_SQL}, {PAIRS_SQL},"
    f" al AS (SELECT e, {', '.join(f'CASE WHEN coalesce({TAG[m.channels]}, false) THEN {m.id} END AS {m.id}' for m in WANTED)} FROM mp LEFT JOIN mq USING (e) LEFT JOIN gd USING (e)),"
    f" ms AS ({long_sql('al', [m.id for m in WANTED])})"
)


def gated_series(spark, d, wanted: list[markers.Marker] | None = None, keep: list[str] | None = None) -> DataFrame:
    """session, epoch, phase, marker, value: null where the gate rejects one of the marker's channels in a window."""
    wanted = WANTED if wanted is None else wanted
    df = gate(artefacts(measured(spark, d, pairs=any(m.kind == "pair" for m in wanted), lziv=any(m.kind == "timeseries" for m in wanted))))
    good = {m.id: F.array(*[F.col(f"ok_{c}") for c in m.channels]) for m in wanted}
    cols = {m.id: v for m, v in zip(wanted, markers.marker_columns(columns(), wanted))}
    gated = [F.when(F.forall(good[k], lambda ok: ok), v).alias(k) for k, v in cols.items()]
    keep = PLACE if keep is None else keep
    return df.select(*keep, *gated).unpivot(keep, list(cols), "marker", "value")


@query(f"{ALL_SQL} SELECT session, epoch, phase, marker, round(value, 6) + 0.0 AS value FROM ms")
def marker_series_gated(spark, d) -> DataFrame:
    return gated_series(spark, d).withColumn("value", r6("value"))


def rank_sql(of: str, r: str) -> str:
    return (
        f"{r} AS (SELECT session, marker, CASE WHEN count(*) >= 5 THEN corr(a, b) END AS {r} FROM (SELECT session, marker,"
        f" rank() OVER (PARTITION BY session, marker ORDER BY value) + (count(*) OVER (PARTITION BY session, marker, value) - 1) / 2.0 AS a,"
        f" rank() OVER (PARTITION BY session, marker ORDER BY {of}) + (count(*) OVER (PARTITION BY session, marker, {of}) - 1) / 2.0 AS b"
        f" FROM mi WHERE value IS NOT NULL AND {of} IS NOT NULL) GROUP BY session, marker)"
    )


SIGNED_SQL = "marker IN ('" + "', '".join(markers.SIGNED) + "')"
SUM_SQL = (
    f"{ALL_SQL}, s0 AS (SELECT session, marker, count(value) FILTER (WHERE phase = 'CALIBRATION') AS n_baseline, count(value) FILTER (WHERE phase = 'MANTRA') AS n_active,"
    " median(value) FILTER (WHERE phase = 'CALIBRATION') AS ma, median(value) FILTER (WHERE phase = 'MANTRA') AS mb, count(value) / count(*) AS coverage,"
    " 1.4826 * mad(value) FILTER (WHERE phase = 'CALIBRATION') AS sp FROM ms GROUP BY session, marker),"
    " pr AS (SELECT a.session, a.marker, avg(CASE WHEN b.value > a.value THEN 1.0 WHEN b.value < a.value THEN -1.0 ELSE 0.0 END) AS delta FROM ms a JOIN ms b ON a.session = b.session AND a.marker = b.marker"
    " AND a.phase = 'CALIBRATION' AND b.phase = 'MANTRA' AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.session, a.marker),"
    " mi AS (SELECT ms.*, emg, emg_wide, motion FROM ms LEFT JOIN ix ON ix.e = session * 30 + epoch LEFT JOIN mv ON mv.e = ix.e),"
    f" {rank_sql('emg', 'r_emg')}, {rank_sql('emg_wide', 'r_emg_wide')}, {rank_sql('motion', 'r_motion')},"
    " s1 AS (SELECT session, marker, n_baseline, n_active, coverage, delta, r_emg, r_emg_wide, r_motion, CASE WHEN least(n_baseline, n_active) >= 3 THEN ma END AS baseline,"
    " CASE WHEN least(n_baseline, n_active) >= 3 THEN mb END AS active, CASE WHEN n_baseline >= 3 AND sp > 0 THEN sp END AS spread"
    " FROM s0 LEFT JOIN pr USING (session, marker) LEFT JOIN r_emg USING (session, marker) LEFT JOIN r_emg_wide USING (session, marker) LEFT JOIN r_motion USING (session, marker)),"
    f" sm AS (SELECT *, CASE WHEN abs(baseline) > spread AND NOT {SIGNED_SQL} THEN (active / baseline - 1) * 100 END AS pct, (active - baseline) / spread AS std_change FROM s1)"
)


def summary(spark, d, wanted: list[markers.Marker] | None = None) -> DataFrame:
    """The series is written once, as both its summaries and its correlations are taken from it."""
    indices = ["emg", "emg_wide", "motion"]
    series = cut(gated_series(spark, d, wanted, [*PLACE, *indices]), "series")
    return analysis.summarise(series, KEYS).join(analysis.artifact_correlation(series, KEYS, indices), KEYS)


FIGURES = ["baseline", "active", "spread", "pct", "std_change", "delta", "coverage", "r_emg", "r_emg_wide", "r_motion"]


@query(f"{SUM_SQL} SELECT session, marker, n_baseline, n_active, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in FIGURES)} FROM sm")
def session_marker_summary(spark, d) -> DataFrame:
    return summary(spark, d).select(*KEYS, "n_baseline", "n_active", *[(F.round(c, 5) + 0.0).alias(c) for c in FIGURES])


#: The least mean coverage of a session that a cohort counts.
FLOOR = 0.1
MEMBERS_SQL = "marker IN ('" + "', '".join(m.id for m in WANTED if m.role == "marker") + "')"
COHORT_SQL = (
    f"{SUM_SQL}, cv AS (SELECT session, avg(coverage) AS coverage FROM sm GROUP BY session),"
    f" sd AS (SELECT session, marker, std_change, pct, abs(std_change) > 20 AS degenerate FROM sm WHERE {MEMBERS_SQL} AND n_baseline >= 5 AND spread > 0 AND std_change IS NOT NULL),"
    f" us AS (SELECT sd.* FROM sd JOIN cv USING (session) WHERE NOT degenerate AND coverage >= {FLOOR})"
)


def session_changes(spark, d) -> DataFrame:
    """From summaries without correlations, which a cohort doesn't ask for, written once for all that is taken from them."""
    changes = cut(analysis.summarise(gated_series(spark, d), KEYS), "summary")
    return analysis.session_changes(changes, [m.id for m in WANTED if m.role == "marker"])


@query(
    f"{COHORT_SQL} SELECT session, round(coverage, 6) AS coverage, count(marker) FILTER (WHERE NOT degenerate) AS kept, count(marker) FILTER (WHERE degenerate) AS degenerate,"
    f" count(marker) FILTER (WHERE NOT degenerate) > 0 AND coverage >= {FLOOR} AS included FROM cv LEFT JOIN sd USING (session) GROUP BY session, coverage"
)
def cohort_sessions(spark, d) -> DataFrame:
    """What each session gives a cohort: markers kept and degenerate, its coverage by gated windows, and whether it counts."""
    g = session_changes(spark, d).groupBy("session", "coverage").agg(F.count_if(~F.col("degenerate")).alias("kept"), F.count_if("degenerate").alias("degenerate"))
    return g.select("session", F.round("coverage", 6).alias("coverage"), "kept", "degenerate", ((F.col("kept") > 0) & (F.col("coverage") >= FLOOR)).alias("included"))


@query(
    f"{COHORT_SQL}, c AS (SELECT marker, count(*) AS n, median(pct) AS mp, median(std_change) AS md, count(*) FILTER (WHERE std_change > 0) AS n_up FROM us GROUP BY marker),"
    " t AS (SELECT *, least(1.0, 2 * list_sum(list_transform(range(least(n_up, n - n_up) + 1),"
    " lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0))))) AS p FROM c)"
    " SELECT marker, n, round(mp, 4) + 0.0 AS median_pct, round(md, 5) + 0.0 AS median_std, n_up, round(p, 6) AS p FROM t"
)
def cohort_gated(spark, d) -> DataFrame:
    """Per marker the medians over the sessions that count, on gated windows, with the exact sign test."""
    c = analysis.cohort(analysis.included(session_changes(spark, d), FLOOR))
    return c.select("marker", "n", (F.round("median_pct", 4) + 0.0).alias("median_pct"), (F.round("median_std", 5) + 0.0).alias("median_std"), "n_up", F.round("p", 6).alias("p"))


ROLES_SQL = "ro AS (SELECT unnest([" + ", ".join(f"{{'marker': '{m.id}', 'extra': {str(m.role != 'marker').lower()}, 'nr': {i}, 'expected': '{m.expected}'}}" for i, m in enumerate(markers.MARKERS)) + "], recursive := true))"
RANK_SQL = (
    f"{SUM_SQL}, {ROLES_SQL}, sc AS (SELECT sm.*, extra, nr, expected, coalesce(abs(pct), abs(std_change)) AS score,"
    " coverage < 0.6 OR coalesce(round(abs(r_emg), 9) > 0.5, false) OR coalesce(round(abs(r_motion), 9) > 0.5, false) AS flagged FROM sm JOIN ro USING (marker))"
)


def with_roles(df: DataFrame) -> DataFrame:
    known = df.sparkSession.createDataFrame([(m.id, m.role != "marker", i, m.expected) for i, m in enumerate(markers.MARKERS)], "marker string, extra boolean, nr int, expected string")
    return df.join(F.broadcast(known), "marker")


@query(
    f"{RANK_SQL} SELECT session, marker, flagged, round(score, 4) AS score, row_number() OVER (PARTITION BY session ORDER BY flagged, round(score, 6) DESC, marker) AS place FROM sc"
    " WHERE score > 0 AND NOT extra QUALIFY place <= 3"
)
def rank_by_variation_flags(spark, d) -> DataFrame:
    """The top three markers of each session by change; those that artefacts explain or that few windows cover stand behind the others."""
    pool = [m.id for m in markers.markers("marker")]
    return analysis.rank(summary(spark, d), ["session"], 3, pool=pool).select(*KEYS, "flagged", F.round("score", 4).alias("score"), F.col("place").cast("long").alias("place"))


@query(
    f"{RANK_SQL}, pl AS (SELECT session, marker, row_number() OVER (PARTITION BY session ORDER BY flagged, round(score, 6) DESC, marker) AS place FROM sc WHERE score > 0 AND NOT extra)"
    " SELECT session, marker, row_number() OVER (PARTITION BY session ORDER BY extra, coalesce(place, 99), nr) AS position FROM sc LEFT JOIN pl USING (session, marker) QUALIFY position <= 6"
)
def report_order(spark, d) -> DataFrame:
    """The six metrics that a session's report shows: markers before extras, then by rank, then as the registry lists them."""
    from pyspark.sql import Window

    s = summary(spark, d)
    place = analysis.rank(s, ["session"], len(markers.MARKERS), pool=[m.id for m in markers.markers("marker")]).select(*KEYS, "place")
    rows = with_roles(s.select(*KEYS)).join(place, KEYS, "left")
    position = F.row_number().over(Window.partitionBy("session").orderBy("extra", F.coalesce("place", F.lit(99)), "nr"))
    return rows.select(*KEYS, position.cast("long").alias("position")).where("position <= 6")


def effect_sql(source: str, keys: list[str], reps: int, lo: int, hi: int) -> str:
    """CTEs behind a series (keys, epoch, phase, value): ef, the keys' effect with its interval, block and n_effective."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    u = lambda col: f"({hash_sql(f'({col} + i) % 4294967296')} / 4294967296.0)"
    return (
        f"ea1 AS (SELECT {k}, phase, row_number() OVER (PARTITION BY {k}, phase ORDER BY epoch) - 1 AS i, value FROM {source} WHERE value IS NOT NULL AND phase IN ('CALIBRATION', 'MANTRA')),"
        f" em AS (SELECT {k}, phase, count(*) AS n, avg(value) AS m, median(value) AS md FROM ea1 GROUP BY {k}, phase), ec AS (SELECT ea1.*, n, value - m AS x FROM ea1 JOIN em USING ({k}, phase)),"
        f" ac AS (SELECT {', '.join(f'p.{c}' for c in keys)}, p.phase, p.i - q.i AS lag, sum(p.x * q.x) AS s FROM ec p JOIN ec q ON {on('p', 'q')} AND p.phase = q.phase AND p.i >= q.i GROUP BY ALL),"
        f" fl AS (SELECT {k}, phase, min(lag) AS f FROM ac JOIN (SELECT {k}, phase, s AS s0 FROM ac WHERE lag = 0) USING ({k}, phase) WHERE s0 > 0 AND lag > 0 AND s / s0 < 0.3679 GROUP BY {k}, phase),"
        f" ez AS (SELECT {k}, phase, s AS s0 FROM ac WHERE lag = 0), bl AS (SELECT {k}, max(least(greatest(2 * CASE WHEN n < 4 OR s0 <= 0 THEN 1 ELSE coalesce(f, n // 2) END, {lo}), {hi})) AS block,"
        f" min(n) AS n_least, count(*) AS phases FROM em JOIN ez USING ({k}, phase) LEFT JOIN fl USING ({k}, phase) GROUP BY {k}), {reps_sql(reps)},"
        f" dr AS (SELECT {k}, phase, i, n, block, rep, CASE WHEN phase = 'CALIBRATION' THEN h0 ELSE h2 END AS hr, CASE WHEN phase = 'CALIBRATION' THEN h1 ELSE h3 END AS ha FROM ec JOIN bl USING ({k}), rp WHERE phases = 2 AND n_least >= 3),"
        f" dn AS (SELECT {k}, phase, rep, i, n, last_value(CASE WHEN i = 0 OR {u('hr')} < 1::DOUBLE / block THEN floor({u('ha')} * n)::BIGINT - i END IGNORE NULLS) OVER (PARTITION BY {k}, phase, rep ORDER BY i) AS a FROM dr),"
        f" dp AS (SELECT {k}, phase, rep, (a + i) % n AS i FROM dn), dm AS (SELECT {k}, phase, rep, median(value) AS md FROM dp JOIN ea1 USING ({k}, phase, i) GROUP BY {k}, phase, rep),"
        f" ds AS (SELECT {k}, rep, max(md) FILTER (WHERE phase = 'MANTRA') - max(md) FILTER (WHERE phase = 'CALIBRATION') AS stat FROM dm GROUP BY {k}, rep),"
        f" dq AS (SELECT {k}, quantile_cont(stat, 0.025) AS ci_low, quantile_cont(stat, 0.975) AS ci_high FROM ds GROUP BY {k}),"
        f" ef AS (SELECT {k}, block, n_least / block AS n_effective, (SELECT max(md) FROM em b WHERE {on('b', 'dq')} AND b.phase = 'MANTRA') - (SELECT max(md) FROM em b WHERE {on('b', 'dq')} AND b.phase = 'CALIBRATION') AS effect,"
        f" ci_low, ci_high, ci_low <= 0 AND ci_high >= 0 AS crosses_zero, NOT (ci_low <= 0 AND ci_high >= 0) AND n_least / block >= 5 AS reliable FROM dq JOIN bl USING ({k}))"
    )


CI_SQL = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("effect", "ci_low", "ci_high", "n_effective"))


@query(f"{ALL_SQL}, {effect_sql('ms', KEYS, 2000, *BLOCK)} SELECT session, marker, block, {CI_SQL}, crosses_zero, reliable FROM ef")
def block_bootstrap_ci(spark, d) -> DataFrame:
    """The effect of each session and marker with its interval: both phases resampled 2,000 times in blocks of computed length."""
    e = stats.effects(gated_series(spark, d), KEYS, analysis.A, analysis.B, BLOCK).where("effect IS NOT NULL")
    return e.select(*KEYS, "block", *[r6(c).alias(c) for c in ("effect", "ci_low", "ci_high", "n_effective")], "crosses_zero", "reliable")


@query(
    f"{SUM_SQL}, {ROLES_SQL}, {effect_sql('ms', KEYS, 2000, *BLOCK)}, fg AS (SELECT sm.*, extra, expected, coalesce(reliable, false) AS reliable FROM sm JOIN ro USING (marker) LEFT JOIN ef USING (session, marker))"
    " SELECT session, marker, reliable, CASE WHEN baseline IS NULL OR expected = 'unknown' THEN NULL ELSE (expected = 'up') = (active > baseline) END AS direction_ok,"
    " CASE WHEN n_baseline < 3 AND n_active >= 3 THEN 'no reference' WHEN baseline IS NULL THEN 'no data' WHEN reliable THEN CASE WHEN active > baseline THEN 'up' ELSE 'down' END ELSE 'stable' END AS verdict,"
    " sum(reliable::INT) OVER (PARTITION BY session)::BIGINT AS session_reliable, count(*) OVER (PARTITION BY session) AS session_total, sum((NOT extra)::INT) OVER (PARTITION BY session)::BIGINT AS session_markers FROM fg"
)
def estimate_flags(spark, d) -> DataFrame:
    """Reliable or not, in the expected direction or not, the verdict, and the session's counts of reliable and of all markers."""
    from pyspark.sql import Window

    e = stats.effects(gated_series(spark, d), KEYS, analysis.A, analysis.B, BLOCK).select(*KEYS, "reliable")
    s = with_roles(summary(spark, d)).join(e, KEYS, "left").withColumn("reliable", F.coalesce("reliable", F.lit(False)))
    rises = F.col("active") > F.col("baseline")
    ok = F.when(F.col("baseline").isNotNull() & (F.col("expected") != "unknown"), (F.col("expected") == "up") == rises)
    verdict = F.when((F.col("n_baseline") < 3) & (F.col("n_active") >= 3), "no reference").when(F.col("baseline").isNull(), "no data")
    verdict = verdict.when(F.col("reliable"), F.when(rises, "up").otherwise("down")).otherwise("stable")
    w = Window.partitionBy("session")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w).cast("long")
    counts = count(F.col("reliable")).alias("session_reliable"), F.count("*").over(w).alias("session_total"), count(~F.col("extra")).alias("session_markers")
    return s.select(*KEYS, "reliable", ok.alias("direction_ok"), verdict.alias("verdict"), *counts)


# --- segments compared, channel by channel

SEGMENT_KEYS = ["session", "channel"]
#: Least change in log2 units and least reactivity of an effect, least share of channels that agree.
MIN_LOG2, MIN_REACTIVITY, MIN_AGREEMENT = 0.05, 0.02, 0.75
SEG_SQL = (
    f"{PSD_SQL}, sa AS (SELECT {SESSION_SQL}, {NAMES_SQL} AS channel, alpha, low, high, log2(greatest(alpha, 1e-12)) - (log2(greatest(low, 1e-12)) + log2(greatest(high, 1e-12))) / 2 AS value FROM bp),"
    f" {effect_sql('sa', SEGMENT_KEYS, 2000, *BLOCK)},"
    " re AS (SELECT session, channel, median(alpha) FILTER (WHERE phase = 'CALIBRATION') AS alpha_a, median(alpha) FILTER (WHERE phase = 'MANTRA') AS alpha_b,"
    " log2(avg(alpha) FILTER (WHERE phase = 'MANTRA') / avg(alpha) FILTER (WHERE phase = 'CALIBRATION')) - (log2(avg(low) FILTER (WHERE phase = 'MANTRA') / avg(low) FILTER (WHERE phase = 'CALIBRATION'))"
    " + log2(avg(high) FILTER (WHERE phase = 'MANTRA') / avg(high) FILTER (WHERE phase = 'CALIBRATION'))) / 2 AS reactivity FROM sa GROUP BY session, channel),"
    f" se AS (SELECT *, n_effective >= 5 AS enough, effect >= {MIN_LOG2} AS big, coalesce(reactivity >= {MIN_REACTIVITY}, false) AS specific FROM ef JOIN re USING (session, channel)),"
    " sv AS (SELECT *, NOT crosses_zero AND ci_low > 0 AND enough AND big AND specific AS found, NOT (NOT crosses_zero AND ci_low > 0 AND enough AND big AND specific) AND specific AND big AND enough AND crosses_zero AS underpowered FROM se)"
)


def segments(spark, d) -> DataFrame:
    """session, channel and the four conditions of an effect between the two phases."""
    rows = channels(spark, d).where(F.col("c") < len(EEG)).withColumn("p", S.periodogram(F.col("x"), N, FS))
    names = F.array(*map(F.lit, EEG))
    powers = [S.band_power(F.col("p"), *SPECTRAL_BANDS[k]).alias(k) for k in ("alpha", "low", "high")]
    long = placed(rows.select("e", F.get(names, F.col("c")).alias("channel"), *powers))
    log = lambda k: F.log2(F.greatest(F.col(k), F.lit(1e-12)))
    long = long.withColumn("value", log("alpha") - (log("low") + log("high")) / 2)
    of = lambda f, k, p: f(F.when(F.col("phase") == p, F.col(k)))
    ratio = lambda k: F.log2(of(F.avg, k, analysis.B) / of(F.avg, k, analysis.A))
    re = long.groupBy(*SEGMENT_KEYS).agg(
        of(F.median, "alpha", analysis.A).alias("alpha_a"), of(F.median, "alpha", analysis.B).alias("alpha_b"), (ratio("alpha") - (ratio("low") + ratio("high")) / 2).alias("reactivity")
    )
    e = stats.effects(long, SEGMENT_KEYS, analysis.A, analysis.B, BLOCK).where("effect IS NOT NULL").join(re, SEGMENT_KEYS)
    e = e.withColumns({"enough": F.col("n_effective") >= 5, "big": F.col("effect") >= MIN_LOG2, "specific": F.coalesce(F.col("reactivity") >= MIN_REACTIVITY, F.lit(False))})
    e = e.withColumn("found", ~F.col("crosses_zero") & (F.col("ci_low") > 0) & F.col("enough") & F.col("big") & F.col("specific"))
    return e.withColumn("underpowered", ~F.col("found") & F.col("specific") & F.col("big") & F.col("enough") & F.col("crosses_zero"))


VERDICT = "CASE WHEN found THEN 'effect' WHEN NOT enough THEN 'too few data' WHEN crosses_zero THEN 'stable' WHEN NOT specific THEN 'rises, not by alpha' ELSE 'rises little' END"


@query(f"{SEG_SQL} SELECT session, channel, round((alpha_b / alpha_a - 1) * 100, 3) AS change, round(reactivity, 6) + 0.0 AS reactivity, {CI_SQL}, found, underpowered, {VERDICT} AS verdict FROM sv")
def segment_pair_test(spark, d) -> DataFrame:
    """Each channel's flank-normalised alpha in the two phases: change, reactivity, interval and verdict."""
    change = F.round((F.col("alpha_b") / F.col("alpha_a") - 1) * 100, 3).alias("change")
    figures = [r6(c).alias(c) for c in ("reactivity", "effect", "ci_low", "ci_high", "n_effective")]
    return segments(spark, d).select(*SEGMENT_KEYS, change, *figures, "found", "underpowered", F.expr(VERDICT).alias("verdict"))


AGREEMENT = f"CASE WHEN agreement < {MIN_AGREEMENT} THEN 'not consistent' WHEN detected >= 2 THEN 'confirmed' WHEN detected = 1 THEN 'present' ELSE 'consistent, not confirmed' END"


@query(
    f"{SEG_SQL}, ag AS (SELECT session, avg((reactivity > 0)::INT) AS agreement, count(*) FILTER (WHERE reactivity >= {MIN_REACTIVITY}) AS strong, count(*) FILTER (WHERE found) AS detected,"
    " list(channel ORDER BY reactivity DESC, channel)[:3] AS most FROM sv GROUP BY session)"
    f" SELECT session, round(agreement, 6) AS agreement, strong, detected, most, {AGREEMENT} AS verdict FROM ag"
)
def channel_agreement(spark, d) -> DataFrame:
    """Whether the channels of a session agree, how many show the effect on their own, and the three most reactive."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("reactivity")).alias("r"), "channel")))
    g = segments(spark, d).groupBy("session").agg(
        F.avg((F.col("reactivity") > 0).cast("int")).alias("agreement"), F.count_if(F.col("reactivity") >= MIN_REACTIVITY).alias("strong"), F.count_if("found").alias("detected"),
        F.transform(F.slice(order, 1, 3), lambda e: e["channel"]).alias("most"),
    )
    return g.select("session", F.round("agreement", 6).alias("agreement"), "strong", "detected", "most", F.expr(AGREEMENT).alias("verdict"))


@query(
    f"{PSD_SQL}, av AS (SELECT e // {WINDOWS} AS session, {NAMES_SQL} AS channel, freq, avg(power) FILTER (WHERE e % {WINDOWS} < {BASELINE}) AS a, avg(power) FILTER (WHERE e % {WINDOWS} >= {BASELINE}) AS b FROM psd GROUP BY ALL),"
    " ra AS (SELECT session, channel, freq, CASE WHEN a > 0 THEN coalesce(b / a, 0) ELSE 0 END AS r FROM av WHERE a IS NOT NULL AND b IS NOT NULL),"
    " sm AS (SELECT session, channel, freq, (r + coalesce(lag(r) OVER o, 0) + coalesce(lead(r) OVER o, 0)) / 3 AS s FROM ra WINDOW o AS (PARTITION BY session, channel ORDER BY freq))"
    " SELECT session, channel, arg_max(freq, (round(s, 9), -freq)) AS peak, round(max(s), 6) AS ratio FROM sm WHERE freq BETWEEN 7 AND 13 GROUP BY session, channel"
)
def reactivity_peak(spark, d) -> DataFrame:
    """The frequency between 7 and 13 Hz at which a channel's mean density grows most from the first phase to the second, smoothed over three bins."""
    x = F.col("x")
    rows = placed(channels(spark, d).where(F.col("c") < len(EEG)).withColumn("p", S.periodogram(x, N, FS)))
    long = rows.select("session", "phase", F.get(F.array(*map(F.lit, EEG)), F.col("c")).alias("channel"), F.posexplode("p").alias("freq", "power"))
    of = lambda p: F.avg(F.when(F.col("phase") == p, F.col("power")))
    mean = long.groupBy("session", "channel", "freq").agg(of(analysis.A).alias("a"), of(analysis.B).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    ratio = F.when(F.col("a") > 0, F.coalesce(F.col("b") / F.col("a"), F.lit(0.0))).otherwise(0.0)
    arrays = mean.groupBy("session", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("freq", ratio.alias("r")))), stats.field("r")).alias("r"))
    band = F.slice(S.box(F.col("r"), 3), 8, 7)
    top = F.array_max(F.transform(band, lambda v, i: F.struct(F.round(v, 9).alias("s"), (-i).alias("i"))))
    return arrays.select("session", "channel", (7 - top["i"]).cast("long").alias("peak"), F.round(F.array_max(band), 6).alias("ratio"))


# --- ocular regression

#: Samples a blink reaches beyond its own, its threshold, and the blink samples without which all samples are fitted.
BLINK_PAD, BLINK, BLINK_LEAST = 4, 0.12, 24
OCULAR, THETA = (1, 5), (4, 7)


def ocular(*x: np.ndarray) -> tuple:
    """Of a window of four target channels, Fp1 and Fp2: blink samples, whether all samples were fitted, and by target the weights of the ocular band's mean
    and difference and the share of theta variance that their subtraction removes."""
    x = np.array(x)
    z = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)
    inside = (np.arange(z.shape[1]) >= OCULAR[0]) & (np.arange(z.shape[1]) <= OCULAR[1])
    fp = np.fft.irfft(z[4:] * inside, N, axis=1)
    near = np.abs(fp).max(axis=0) > BLINK
    blink = np.array([near[max(0, i - BLINK_PAD) : i + BLINK_PAD + 1].any() for i in range(N)])
    fit = blink if blink.sum() >= BLINK_LEAST else np.ones(N, bool)
    design = np.stack([fp.mean(axis=0), fp[1] - fp[0], np.ones(N)], axis=1)
    weights = np.linalg.lstsq(design[fit], x[:4, fit].T, rcond=None)[0]
    after = np.fft.rfft(x[:4] - (design[:, :2] @ weights[:2]).T, axis=1)
    band = slice(THETA[0], THETA[1] + 1)
    before = (np.abs(z[:4, band]) ** 2).sum(axis=1)
    removed = [1 - float(v / b) if b > 0 else None for v, b in zip((np.abs(after[:, band]) ** 2).sum(axis=1), before)]
    return int(blink.sum()), int(fit.all()), weights[0].tolist(), weights[1].tolist(), removed


@query(
    f"WITH {X_SQL}, fu AS (SELECT e FROM x WHERE c < 6 GROUP BY e HAVING count(*) = 6), v AS (SELECT e, c, n, x[n + 1] - list_avg(x) AS v FROM x JOIN fu USING (e), range(64) t(n) WHERE c < 6),"
    " ft AS (SELECT e, c, f, sum(v * cos(2 * pi() * f * n / 64)) AS re, sum(v * sin(2 * pi() * f * n / 64)) AS im FROM v, range(1, 8) t(f) GROUP BY e, c, f),"
    " ob AS (SELECT e, c, n, 2 / 64.0 * sum(re * cos(2 * pi() * f * n / 64) + im * sin(2 * pi() * f * n / 64)) AS b FROM ft, range(64) t(n) WHERE c >= 4 AND f <= 5 GROUP BY e, c, n),"
    " rg AS (SELECT e, n, avg(b) AS m, max(b) FILTER (WHERE c = 5) - max(b) FILTER (WHERE c = 4) AS d, max(abs(b)) AS a FROM ob GROUP BY e, n),"
    f" bk AS (SELECT *, max(a > {BLINK}) OVER (PARTITION BY e ORDER BY n ROWS BETWEEN {BLINK_PAD} PRECEDING AND {BLINK_PAD} FOLLOWING) AS blink FROM rg),"
    f" bn AS (SELECT e, count(*) FILTER (WHERE blink) AS blinks FROM bk GROUP BY e), ft2 AS (SELECT v.e, v.c, v.n, v.v AS y, m, d FROM v JOIN bk ON v.e = bk.e AND v.n = bk.n JOIN bn ON bn.e = v.e WHERE v.c < 4 AND (blink OR blinks < {BLINK_LEAST})),"
    " gs AS (SELECT e, c, count(*) AS k, regr_sxx(m, m) AS mm, regr_sxx(d, d) AS dd, regr_sxy(m, d) AS md, regr_sxy(y, m) AS my, regr_sxy(y, d) AS dy FROM ft2 GROUP BY e, c),"
    " bt AS (SELECT e, c, (my * dd - dy * md) / (mm * dd - md * md) AS wm, (dy * mm - my * md) / (mm * dd - md * md) AS wd FROM gs),"
    " rf AS (SELECT a.e, a.f, CASE WHEN a.f <= 5 THEN (a.re + b.re) / 2 ELSE 0 END AS mr, CASE WHEN a.f <= 5 THEN (a.im + b.im) / 2 ELSE 0 END AS mi, CASE WHEN a.f <= 5 THEN b.re - a.re ELSE 0 END AS dr,"
    " CASE WHEN a.f <= 5 THEN b.im - a.im ELSE 0 END AS di FROM ft a JOIN ft b ON a.e = b.e AND a.f = b.f AND a.c = 4 AND b.c = 5),"
    " va AS (SELECT ft.e, ft.c, 1 - sum(pow(re - wm * mr - wd * dr, 2) + pow(im - wm * mi - wd * di, 2)) / sum(re * re + im * im) AS removed FROM ft JOIN bt ON ft.e = bt.e AND ft.c = bt.c JOIN rf ON rf.e = ft.e AND rf.f = ft.f WHERE ft.f >= 4 GROUP BY ft.e, ft.c)"
    f" SELECT {SESSION_SQL}, {NAMES_SQL} AS channel, blinks, blinks < {BLINK_LEAST} OR blinks = 64 AS all_samples, round(wm, 5) + 0.0 AS of_mean, round(wd, 5) + 0.0 AS of_difference, round(removed, 5) + 0.0 AS theta_removed"
    " FROM bt JOIN va USING (e, c) JOIN bn USING (e)"
)
def ocular_regression(spark, d) -> DataFrame:
    w = windows(spark, d)
    whole = w.where(" AND ".join(f"x_{c} IS NOT NULL" for c in EEG))
    numbers, lists = ("blinks", "all_samples"), ("of_mean", "of_difference", "theta_removed")
    kinds = dict.fromkeys(numbers, pa.int64()) | dict.fromkeys(lists, pa.list_(pa.float64()))
    out = stats.over_arrays(whole, PLACE, [f"x_{c}" for c in EEG], kinds, ocular).withColumn("channel", F.array(*map(F.lit, markers.FOUR)))
    long = out.select(*PLACE, "blinks", (F.col("all_samples") == 1).alias("all_samples"), F.inline(F.arrays_zip("channel", *lists)))
    return long.select(*PLACE, "channel", "blinks", "all_samples", *[(F.round(c, 5) + 0.0).alias(c) for c in lists])


# --- montage checks and contact

MIN_R, MAX_DIFF, DOMINANCE = 0.98, 0.02, 1.0


def montage(*signals: Column) -> Column:
    """struct<min_r, ratio, dominance, gaze> of a window of EEG channels: the least correlation of two detrended channels, the largest difference of two over
    their median deviation, the ocular band (bins 1 to 5 Hz) of Fp over F, and the correlation of Fp1 and Fp2 in it."""
    k = np.arange(N) - (N - 1) / 2

    def one(*x) -> tuple:
        if any(v is None for v in x):
            return None, None, None, None
        x = np.array([np.asarray(v, float) for v in x])
        x = x - x.mean(axis=1, keepdims=True)
        z = np.fft.rfft(x, axis=1)[:, 1:6]
        flat = x - np.outer(x @ k / (k @ k), k)
        sd = flat.std(axis=1)
        i, j = np.triu_indices(len(x), 1)
        r = ((flat @ flat.T) / N)[i, j] / (sd[i] * sd[j])
        amp = np.sqrt(2 * (np.abs(z) ** 2).sum(axis=1)) / N
        gaze = (z[4] * z[5].conj()).real.sum() / np.sqrt((np.abs(z[4]) ** 2).sum() * (np.abs(z[5]) ** 2).sum())
        return float(r.min()), float((flat[i] - flat[j]).std(axis=1).max() / np.median(sd)), float((amp[4] + amp[5]) / (amp[0] + amp[1])), float(gaze)

    def batch(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*v) for v in zip(a, b, c, d, e, f)], columns=["min_r", "ratio", "dominance", "gaze"], dtype=object).astype(float)

    return F.pandas_udf(batch, "min_r double, ratio double, dominance double, gaze double")(*signals)


CHECKS = (
    f"independent AND dominance >= {DOMINANCE} AS dominant, CASE WHEN independent AND gaze < 0 THEN true END AS opposed"
)


@query(
    f"WITH {X_SQL}, v AS (SELECT e, c, n, x[n + 1] - list_avg(x) AS v FROM x, range(64) t(n) WHERE c < 6), fu AS (SELECT e FROM v GROUP BY e HAVING count(DISTINCT c) = 6),"
    " fl AS (SELECT e, c, n, v - (regr_slope(v, n) OVER w * n + regr_intercept(v, n) OVER w) AS v FROM v JOIN fu USING (e) WINDOW w AS (PARTITION BY e, c)),"
    " sd AS (SELECT e, median(sd) AS sd FROM (SELECT e, c, stddev_pop(v) AS sd FROM fl GROUP BY e, c) GROUP BY e),"
    " pr AS (SELECT a.e, a.c AS i, b.c AS j, corr(a.v, b.v) AS r, stddev_pop(a.v - b.v) AS diff FROM fl a JOIN fl b ON a.e = b.e AND a.n = b.n AND a.c < b.c GROUP BY a.e, a.c, b.c),"
    " ind AS (SELECT e, min(r) AS min_r, max(diff) / any_value(sd) AS ratio FROM pr JOIN sd USING (e) GROUP BY e),"
    " ft AS (SELECT e, c, f, sum(v * cos(2 * pi() * f * n / 64)) AS re, -sum(v * sin(2 * pi() * f * n / 64)) AS im FROM v JOIN fu USING (e), range(1, 6) t(f) GROUP BY e, c, f),"
    " am AS (SELECT e, sum(sqrt(p)) FILTER (WHERE c IN (4, 5)) / sum(sqrt(p)) FILTER (WHERE c IN (0, 1)) AS dominance FROM (SELECT e, c, sum(re * re + im * im) AS p FROM ft GROUP BY e, c) GROUP BY e),"
    " gz AS (SELECT a.e, sum(a.re * b.re + a.im * b.im) / sqrt(sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS gaze FROM ft a JOIN ft b ON a.e = b.e AND a.f = b.f AND a.c = 4 AND b.c = 5 GROUP BY a.e),"
    f" al AS (SELECT DISTINCT e FROM x), jn AS (SELECT al.e, min_r, ratio, dominance, gaze, NOT (min_r >= {MIN_R} AND ratio <= {MAX_DIFF}) AS independent FROM al LEFT JOIN ind USING (e) LEFT JOIN am USING (e) LEFT JOIN gz USING (e)),"
    f" ck AS (SELECT *, {CHECKS} FROM jn) SELECT {SESSION_SQL}, round(min_r, 6) + 0.0 AS min_r, round(ratio, 6) AS ratio, round(dominance, 6) AS dominance, round(gaze, 6) + 0.0 AS gaze, independent, dominant, opposed,"
    " coalesce(NOT independent, false) OR coalesce(NOT dominant, false) AS any_failed, coalesce(independent AND dominant AND opposed, false) AS all_passed FROM ck"
)
def montage_checks(spark, d) -> DataFrame:
    """Independence of the channels, and if they are independent the dominance of the front pole and lateral gaze; null: undecided."""
    m = windows(spark, d).withColumn("m", montage(*[F.col(f"x_{c}") for c in EEG])).select(*PLACE, "m.*")
    m = m.withColumn("independent", ~((F.col("min_r") >= MIN_R) & (F.col("ratio") <= MAX_DIFF)))
    m = m.selectExpr("*", *CHECKS.split(", ", 1))
    failed = "coalesce(NOT independent, false) OR coalesce(NOT dominant, false) AS any_failed"
    figures = [r6(c).alias(c) for c in ("min_r", "ratio", "dominance", "gaze")]
    return m.select(*PLACE, *figures, "independent", "dominant", "opposed", F.expr(failed), F.expr("coalesce(independent AND dominant AND opposed, false) AS all_passed"))


#: Contact: samples left out at both ends, and the limits of the grades.
TRIM = 4
GRADE = (
    "CASE WHEN sd IS NULL OR sd < 0.05 THEN 'red' WHEN drift > 0.16 THEN 'red' WHEN sd <= 0.122 AND p2p <= 0.6 THEN 'green' WHEN sd > 0.13 OR p2p > 0.7 THEN 'red' ELSE 'yellow' END"
)
LINE_WARNING = 0.11


@query(
    f"WITH {X_SQL}, v AS (SELECT e, c, n, x[n + 1] AS v FROM x, range(64) t(n) WHERE c < 6), ln AS (SELECT e, c, regr_slope(v, n) AS a, regr_intercept(v, n) AS b FROM v GROUP BY e, c),"
    " dt AS (SELECT e, c, n, v - (a * n + b) AS v, abs(a) * 63 AS drift FROM v JOIN ln USING (e, c)), y AS (SELECT e, c, n, v * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS y FROM dt),"
    " psd AS (SELECT e, c, f AS freq, (CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END) * (pow(sum(y * cos(2 * pi() * ((f * n) % 64) / 64)), 2) + pow(sum(y * sin(2 * pi() * ((f * n) % 64) / 64)), 2)) / (64 * 24.0) AS power"
    " FROM y, range(33) t(f) GROUP BY e, c, f), tz AS (SELECT *, (power + lag(power) OVER (PARTITION BY e, c ORDER BY freq)) / 2 AS area FROM psd),"
    " bp AS (SELECT e, c, sum(area) FILTER (WHERE freq > 15 AND freq <= 17) / sum(area) FILTER (WHERE freq > 1 AND freq <= 31) AS line FROM tz GROUP BY e, c),"
    f" ms AS (SELECT e, c, any_value(drift) AS drift, stddev_pop(v) FILTER (WHERE n >= {TRIM} AND n < {N - TRIM}) AS sd, max(v) FILTER (WHERE n >= {TRIM} AND n < {N - TRIM}) - min(v) FILTER (WHERE n >= {TRIM} AND n < {N - TRIM}) AS p2p FROM dt GROUP BY e, c),"
    f" gr AS (SELECT e, c, drift, sd, p2p, line, {GRADE} AS grade FROM ms JOIN bp USING (e, c))"
    f" SELECT {SESSION_SQL}, count(*) AS channels, count(*) FILTER (WHERE grade <> 'red') AS n_good, list(grade ORDER BY c) AS grades, round(max(drift), 6) AS drift, round(median(line), 6) AS line, median(line) > {LINE_WARNING} AS line_warning FROM gr GROUP BY e"
)
def contact_report(spark, d) -> DataFrame:
    """Each window's contact: drift of the raw signal, line share before any filter, deviation and range of the detrended signal without its ends, grades."""
    rows = channels(spark, d).where(F.col("c") < len(EEG)).withColumn("flat", S.line_removed(F.col("x"), N))
    rows = rows.withColumn("p", S.density(S.dft(S.tapered(F.col("flat"), N)), N, FS, 0.375 * N))
    trend = F.zip_with("x", "flat", lambda a, b: a - b)
    kept = F.slice("flat", TRIM + 1, N - 2 * TRIM)
    share = S.band_power(F.col("p"), *ARTEFACTS["line"]) / S.band_power(F.col("p"), *S.BANDS["total"])
    figures = {"drift": F.array_max(trend) - F.array_min(trend), "sd": sd_of(kept), "p2p": F.array_max(kept) - F.array_min(kept), "line": share}
    graded = rows.select("e", "c", *[v.alias(k) for k, v in figures.items()]).withColumn("grade", F.expr(GRADE))
    g = graded.groupBy("e").agg(
        F.count("*").alias("channels"), F.count_if(F.col("grade") != "red").alias("n_good"),
        F.transform(F.array_sort(F.collect_list(F.struct("c", "grade"))), stats.field("grade")).alias("grades"),
        F.round(F.max("drift"), 6).alias("drift"), F.median("line").alias("_line"),
    )
    return placed(g).select(*PLACE, "channels", "n_good", "grades", "drift", F.round("_line", 6).alias("line"), (F.col("_line") > LINE_WARNING).alias("line_warning"))


# --- series for display

SHOWN = ["alpha_rel", "beta_rel", "faa"]


def filled(x: np.ndarray) -> np.ndarray:
    """Unknown values between, before and after the known ones: on the line between these, or the nearest."""
    at, known = np.arange(len(x)), np.isfinite(x)
    return np.interp(at, at[known], x[known])


def median5(x: np.ndarray) -> np.ndarray:
    return x if len(x) < 5 else np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 2, mode="edge"), 5), axis=1)


def sparkline(x: np.ndarray, active: np.ndarray) -> tuple:
    """The series without gaps, smoothed, and where the active phase begins, as a share; nothing below 3 known values."""
    if np.isfinite(x).sum() < 3:
        return [], None
    return median5(filled(x)).tolist(), float(np.argmax(active)) / len(x) if active.any() else None


def deviations(active: np.ndarray, *series: np.ndarray) -> tuple:
    """Series on their common support in units of their baseline's spread: the first place, and per series the values (none if undefined) and the share filled."""
    empty = (None, *([[]] * len(series)), *([None] * len(series)))
    inside = [(np.isfinite(x) | (np.arange(len(x)) > (k := np.flatnonzero(np.isfinite(x)))[0]) & (np.arange(len(x)) < k[-1])) if np.isfinite(x).sum() >= 2 else np.zeros(len(x), bool) for x in series]
    common = np.logical_and.reduce(inside) if np.logical_and.reduce(inside).any() else np.logical_or.reduce(inside)
    if not common.any():
        return empty
    low, high = np.flatnonzero(common)[[0, -1]]
    out, shares = [], []
    for x, there in zip(series, inside):
        part, known = np.where(there, filled(x) if there.any() else np.nan, np.nan)[low : high + 1], there[low : high + 1]
        base = x[(active == 0) & np.isfinite(x)]
        if known.sum() < 2 or not len(base):
            out, shares = [*out, []], [*shares, None]
            continue
        smooth, centre = median5(filled(part)), float(np.median(base))
        spread = stats.MAD * float(np.median(np.abs(base - centre))) if len(base) >= 3 else 0.0
        spread = spread if spread > 0 else float(smooth.std())
        out.append(((smooth - centre) / spread).tolist() if spread > 0 else [])
        shares.append(1.0 - float(known.mean()) if spread > 0 else None)
    return (int(low), *out, *shares)


def display_arrays(series: DataFrame, keys: list[str], names: dict[str, Column]) -> DataFrame:
    """keys and arrays in the order of epochs, unknown values as NaN."""
    nan = F.lit(float("nan"))
    rows = F.array_sort(F.collect_list(F.struct("epoch", *[F.coalesce(c.cast("double"), nan).alias(k) for k, c in names.items()])))
    return series.groupBy(*keys).agg(rows.alias("v")).select(*keys, *[F.transform("v", stats.field(k)).alias(k) for k in names])


FILL_SQL = (
    "fw AS (SELECT session, marker, epoch, phase, value, last_value(CASE WHEN value IS NOT NULL THEN epoch END IGNORE NULLS) OVER p AS t0, last_value(value IGNORE NULLS) OVER p AS v0,"
    " first_value(CASE WHEN value IS NOT NULL THEN epoch END IGNORE NULLS) OVER f AS t1, first_value(value IGNORE NULLS) OVER f AS v1 FROM ms"
    " WINDOW p AS (PARTITION BY session, marker ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY session, marker ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),"
    " fd AS (SELECT session, marker, epoch, phase, value, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (epoch - t0) / (t1 - t0) END AS v FROM fw)"
)
SMOOTH = "CASE WHEN len(x) < 5 THEN x ELSE list_transform(range(1, len(x) + 1), lambda i: list_sort(list_transform([-2, -1, 0, 1, 2], lambda k: x[greatest(1, least(len(x), i + k))]))[3]) END"


@query(
    f"{ALL_SQL}, {FILL_SQL}, ar AS (SELECT session, marker, count(value) AS known, list(v ORDER BY epoch) AS x, min(epoch) FILTER (WHERE phase = 'MANTRA') AS first, count(*) AS n FROM fd GROUP BY session, marker)"
    f" SELECT session, marker, CASE WHEN known >= 3 THEN list_transform({SMOOTH}, lambda v: round(v, 6) + 0.0) ELSE [] END AS line, CASE WHEN known >= 3 AND first IS NOT NULL THEN round(first / n, 6) END AS active_from FROM ar"
)
def sparkline_series(spark, d) -> DataFrame:
    arrays = display_arrays(gated_series(spark, d), KEYS, {"x": F.col("value"), "active": (F.col("phase") == analysis.B).cast("int")})
    s = stats.over_arrays(arrays, KEYS, ["x", "active"], {"line": pa.list_(pa.float64()), "active_from": pa.float64()}, sparkline)
    return s.select(*KEYS, F.transform("line", lambda v: F.round(v, 6) + 0.0).alias("line"), F.round("active_from", 6).alias("active_from"))


@query()
def baseline_deviation_series(spark, d) -> DataFrame:
    """Per session the shown markers on one axis, in units of their baseline's spread, with the share that was filled in."""
    of = lambda k: F.max(F.when(F.col("marker") == k, F.col("value")))
    wide = gated_series(spark, d, [markers.get(k) for k in SHOWN]).groupBy(*PLACE).agg(*[of(k).alias(k) for k in SHOWN])
    arrays = display_arrays(wide, ["session"], {"active": (F.col("phase") == analysis.B).cast("int")} | {k: F.col(k) for k in SHOWN})
    kinds = {"start": pa.int64()} | {k: pa.list_(pa.float64()) for k in SHOWN} | {f"filled_{k}": pa.float64() for k in SHOWN}
    return stats.over_arrays(arrays, ["session"], ["active", *SHOWN], kinds, deviations)


SHOWN_SQL = "('" + "', '".join(SHOWN) + "')"


@query(f"{ALL_SQL} SELECT session, epoch, bool_and(value IS NOT NULL) AS common, bool_or(value IS NOT NULL) AS any_known FROM ms WHERE marker IN {SHOWN_SQL} GROUP BY session, epoch")
def display_support(spark, d) -> DataFrame:
    """Where all shown markers are known, and where any is: the axis of a display is the one, or the other where the one is empty."""
    known = F.col("value").isNotNull()
    s = gated_series(spark, d, [markers.get(k) for k in SHOWN])
    return s.groupBy("session", "epoch").agg(F.bool_and(known).alias("common"), F.bool_or(known).alias("any_known"))


@query(
    f"{ALL_SQL} (SELECT DISTINCT session, marker, unnest(['{analysis.A}', '{analysis.B}']) AS phase FROM ms) EXCEPT (SELECT session, marker, phase FROM ms WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)"
)
def phases_without_data(spark, d) -> DataFrame:
    """The phases in which a session's marker has fewer than three values: all phases less those that have them."""
    s = gated_series(spark, d)
    wanted = s.select(*KEYS).distinct().withColumn("phase", F.explode(F.array(F.lit(analysis.A), F.lit(analysis.B))))
    return wanted.subtract(s.where("value IS NOT NULL").groupBy(*KEYS, "phase").count().where("count >= 3").select(*KEYS, "phase"))
