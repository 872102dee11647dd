"""Records filtered end to end before anything is cut from them, and what is told from the filtered record: epochs and their gate, ocular weights.

A session's windows (recordings.py) are joined to one record for each of its six channels, in chunks of ten windows. The SQL filters each record
sample by sample, as one recursion over the whole of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexity
from ..functions import spectral as S
from ..operators import align, ocular, recursive
from ..sources.tables import vectors

FS, N, WINDOWS, PER_CHUNK = 64.0, 64, 30, 10
SIZE = N * PER_CHUNK
KEYS = ["session", "c"]
#: Pass band, its order and reflected samples; the notch; the band of eye movements.
BAND, ORDER, PAD = (2, 24), 4, 27
OCULAR_BAND, BLINK, BLINK_PAD = (1, 5), 0.08, 6
#: What an epoch of the filtered record may reach: largest amplitude, largest step.
AMPLITUDE, STEP = 0.33, 0.34

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def band_sections(lo: float, hi: float) -> np.ndarray:
    return complexity.butterworth_sections(lo, hi, ORDER, FS)


def records(spark, d) -> DataFrame:
    """session, c, chunk, x: the raw record of each channel of a session."""
    e = F.floor(F.col("vec_id") / 8)
    rows = vectors(spark, d).select(F.floor(e / WINDOWS).alias("session"), (F.col("vec_id") % 8).alias("c"), (e % WINDOWS).alias("w"), "x").where("c < 6")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda p: p["x"]))
    return rows.groupBy("session", "c", F.floor(F.col("w") / PER_CHUNK).alias("chunk")).agg(joined.alias("x"))


def filtered(spark, d) -> DataFrame:
    return recursive.zero_phase(records(spark, d), KEYS, band_sections(*BAND), PAD)


def pass_sql(name: str, source: str, sections: np.ndarray) -> str:
    """CTEs that run the lists e of `source` (session, c, e) through the sections, each step a row; `name` has the same columns."""
    n = len(sections)
    settled = recursive.Sections(sections).settled.tolist()
    states = [f"s{k}" for k in range(2 * n)]
    first = ", ".join(f"{v!r}::DOUBLE * e[1]" for v in settled)
    outs, after, v = [], [], "l.e[i + 1]"
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections.tolist()):
        outs.append(f"{b0!r}::DOUBLE * {v} + s{2 * k} AS y{k}")
        after += [f"{b1!r}::DOUBLE * {v} - {a1!r}::DOUBLE * y{k} + s{2 * k + 1}", f"{b2!r}::DOUBLE * {v} - {a2!r}::DOUBLE * y{k}"]
        v = f"y{k}"
    zeros = ", ".join(["0.0::DOUBLE"] * n)
    walk = (
        f"{name}_w(session, c, i, {', '.join(f'w{k}' for k in range(n))}, {', '.join(states)}) AS (SELECT session, c, 0, {zeros}, {first} FROM {source}"
        f" UNION ALL SELECT f.session, f.c, i + 1, {', '.join(outs)}, {', '.join(after)} FROM {name}_w f JOIN {source} l ON l.session = f.session AND l.c = f.c WHERE i < len(l.e))"
    )
    return f"{walk}, {name} AS (SELECT session, c, list(w{n - 1} ORDER BY i) AS e FROM {name}_w WHERE i > 0 GROUP BY session, c)"


def zero_phase_sql(name: str, source: str, sections: np.ndarray, pad: int) -> str:
    """CTEs that filter the lists e of `source` forward and backward, as `name`."""
    head = f"list_transform(list_reverse(e[2:{pad + 1}]), lambda v: 2 * e[1] - v)"
    tail = f"list_transform(list_reverse(e[-{pad + 1}:-2]), lambda v: 2 * e[-1] - v)"
    steps = [
        f"{name}_x AS (SELECT session, c, list_concat({head}, e, {tail}) AS e FROM {source})",
        pass_sql(f"{name}_f", f"{name}_x", sections),
        f"{name}_r AS (SELECT session, c, list_reverse(e) AS e FROM {name}_f)",
        pass_sql(f"{name}_b", f"{name}_r", sections),
        f"{name} AS (SELECT session, c, list_reverse(e)[{pad + 1}:-{pad + 1}] AS e FROM {name}_b)",
    ]
    return ", ".join(steps)


RECORD_SQL = (
    f"WITH RECURSIVE v AS (SELECT vec_id // 8 AS w, vec_id % 8 AS c, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings WHERE vec_id % 8 < 6),"
    f" raw AS (SELECT w // {WINDOWS} AS session, c, flatten(list(x ORDER BY w)) AS e FROM v GROUP BY session, c)"
)
FILTERED_SQL = f"{RECORD_SQL}, fil AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE {zero_phase_sql('bp', 'raw', band_sections(*BAND), PAD)} SELECT * FROM bp))"


def record_epochs(spark, d) -> DataFrame:
    """Of each half-overlapping second of the filtered record: deviation, largest amplitude and step, and whether these keep the limits."""
    rows = recursive.epochs(filtered(spark, d), KEYS, SIZE, N, N // 2)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / N
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / N
    steps = F.zip_with(F.slice("x", 2, N - 1), F.slice("x", 1, N - 1), lambda a, b: F.abs(a - b))
    rows = rows.select("session", "c", "epoch", F.sqrt(square - mean * mean).alias("sd"), F.array_max(F.transform("x", F.abs)).alias("amplitude"), F.array_max(steps).alias("step"))
    good = (F.col("amplitude") <= AMPLITUDE) & (F.col("step") <= STEP)
    return rows.select("session", "c", "epoch", *[F.round(k, 6).alias(k) for k in ("sd", "amplitude", "step")], good.alias("good"))


def record_windows(spark, d) -> DataFrame:
    """Epochs of a session at which every one of its six channels keeps the limits on the filtered record, by session."""
    g = record_epochs(spark, d).groupBy("session", "epoch").agg((F.bool_and("good") & (F.count("*") == 6)).alias("good"))
    return g.groupBy("session").agg(F.count("*").alias("epochs"), F.count_if("good").alias("good"))


def record_ocular(spark, d) -> DataFrame:
    """Weights of the eye channels' mean and difference (band-limited over the record) on each other channel, fitted where there are blinks, and what
    they take from its variance."""
    fil = recursive.cut(filtered(spark, d), "filtered")
    eyes = recursive.zero_phase(fil.where("c >= 4"), KEYS, band_sections(*OCULAR_BAND), PAD)
    fit = ocular.weights(fil.where("c < 4"), eyes, ["session"], "c", (4, 5), BLINK, BLINK_PAD, int(2 * FS))
    rounded = [F.round(k, 6).alias(k) for k in ("mean_weight", "difference_weight", "variance", "removed")]
    return fit.select("session", "c", "blink_samples", "fit_samples", "everywhere", *rounded)


def record_pairs(spark, d) -> DataFrame:
    """Coherence of F3 and F4 on ten seconds of the filtered record, one window each five, from nineteen segments of a second: bands of 1 Hz bins."""
    windows = recursive.epochs(filtered(spark, d).where("c < 2"), KEYS, SIZE, 10 * N, 5 * N)
    side = lambda c: F.max(F.when(F.col("c") == c, F.col("x")))
    pairs = windows.groupBy("session", "epoch").agg(side(0).alias("a"), side(1).alias("b"))
    of = lambda band: complexity.pair_measures(F.col("a"), F.col("b"), FS, N, S.BANDS[band])
    found = pairs.withColumns({"theta2": of("theta2"), "alpha1": of("alpha1")})
    named = {"coh_theta2": "theta2.msc", "coh_alpha1": "alpha1.msc", "imcoh_alpha1": "alpha1.imcoh", "wpli_alpha1": "alpha1.wpli"}
    return found.select("session", "epoch", *[(F.round(v, 6) + F.lit(0.0)).alias(k) for k, v in named.items()])


def good_spectrum(spark, d) -> DataFrame:
    """A session's mean spectrum in dB of the epochs that are good in its four channels, joined one to the next: segments are the epochs themselves and, over
    each joint, the second half of one with the first of the next good one."""
    rows = recursive.cut(recursive.epochs(filtered(spark, d).where("c < 4"), KEYS, SIZE, N, N // 2), "epochs")
    step = F.array_max(F.zip_with(F.slice("x", 2, N - 1), F.slice("x", 1, N - 1), lambda a, b: F.abs(a - b)))
    kept = (F.array_max(F.transform("x", F.abs)) <= AMPLITUDE) & (step <= STEP)
    good = rows.groupBy("session", "epoch").agg((F.bool_and(kept) & (F.count("*") == 4)).alias("good")).where("good").select("session", "epoch")
    ordered = align.following(good, ["session"], "epoch", 1024)
    own = rows.join(ordered, ["session", "epoch"])
    ahead = own.select("session", "c", F.col("epoch").alias("next"), F.slice("x", 1, N // 2).alias("ahead"))
    joint = own.join(ahead, ["session", "c", "next"]).select("session", "c", F.concat(F.slice("x", N // 2 + 1, N // 2), "ahead").alias("x"))
    parts = own.select("session", "c", "x").union(joint).select("session", "c", S.periodogram(F.col("x"), N, FS).alias("p"))
    power = parts.select("session", F.posexplode("p").alias("freq", "power")).where("freq BETWEEN 1 AND 31").groupBy("session", "freq").agg(F.avg("power").alias("power"))
    epochs = good.groupBy("session").agg(F.count("*").alias("epochs"))
    return power.join(epochs, "session").select("session", F.col("freq").cast("long").alias("freq"), F.round(10 * F.log10(F.greatest("power", F.lit(1e-12))), 2).alias("db"), "epochs")


EPOCHS_SQL = (
    f"{FILTERED_SQL}, w AS (SELECT session, c, epoch, e[epoch * {N // 2} + 1 : epoch * {N // 2} + {N}] AS x FROM fil, range({WINDOWS * 2}) t(epoch) WHERE epoch * {N // 2} + {N} <= len(e)),"
    f" u AS (SELECT session, c, epoch, n, x[n + 1] AS v, abs(x[n + 2] - x[n + 1]) AS step FROM w, range({N}) t(n)),"
    " g AS (SELECT session, c, epoch, stddev_pop(v) AS sd, max(abs(v)) AS amplitude, max(step) AS step FROM u GROUP BY session, c, epoch)"
)
ORACLE_SQL["record_epochs"] = (
    f"{EPOCHS_SQL} SELECT session, c, epoch, round(sd, 6) AS sd, round(amplitude, 6) AS amplitude, round(step, 6) AS step,"
    " amplitude <= 0.33 AND step <= 0.34 AS good FROM g"
)
ORACLE_SQL["record_windows"] = (
    f"{EPOCHS_SQL}, b AS (SELECT session, epoch, count(*) FILTER (WHERE amplitude <= 0.33 AND step <= 0.34) = 6 AS good FROM g GROUP BY session, epoch)"
    " SELECT session, count(*) AS epochs, count(*) FILTER (WHERE good) AS good FROM b GROUP BY session"
)
ORACLE_SQL["record_ocular"] = (
    f"{FILTERED_SQL}, eye AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE two AS (SELECT * FROM fil WHERE c >= 4), {zero_phase_sql('oc', 'two', band_sections(*OCULAR_BAND), PAD)} SELECT * FROM oc)),"
    " s AS (SELECT a.session, n, (a.e[n] + b.e[n]) / 2 AS m, b.e[n] - a.e[n] AS q, greatest(abs(a.e[n]), abs(b.e[n])) > 0.08 AS hit"
    " FROM eye a JOIN eye b ON a.session = b.session AND a.c = 4 AND b.c = 5, range(1, 1921) t(n) WHERE n <= len(a.e) AND n <= len(b.e)),"
    " k AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY session ORDER BY n ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), false) AS blink FROM s),"
    " h AS (SELECT session, count(*) FILTER (WHERE blink) AS blink_samples, count(*) AS every FROM k GROUP BY session),"
    " y AS (SELECT k.session, f.c, m, q, f.e[n] AS y, blink OR blink_samples < 128 AS used, blink_samples, blink_samples < 128 OR blink_samples = every AS everywhere"
    " FROM k JOIN h ON h.session = k.session JOIN fil f ON f.session = k.session AND f.c < 4 WHERE n <= len(f.e)),"
    " t AS (SELECT session, c, any_value(blink_samples) AS blink_samples, any_value(everywhere) AS everywhere, count(*) FILTER (WHERE used) AS fit_samples,"
    " covar_pop(m, m) FILTER (WHERE used) AS mm, covar_pop(q, q) FILTER (WHERE used) AS qq, covar_pop(m, q) FILTER (WHERE used) AS mq,"
    " covar_pop(m, y) FILTER (WHERE used) AS my, covar_pop(q, y) FILTER (WHERE used) AS qy FROM y GROUP BY session, c),"
    " b AS (SELECT *, (my * qq - qy * mq) / (mm * qq - mq * mq) AS wm, (qy * mm - my * mq) / (mm * qq - mq * mq) AS wq FROM t)"
    " SELECT b.session, b.c, any_value(blink_samples) AS blink_samples, any_value(fit_samples) AS fit_samples, any_value(everywhere) AS everywhere, round(any_value(wm), 6) AS mean_weight,"
    " round(any_value(wq), 6) AS difference_weight, round(var_pop(y), 6) AS variance, round(1 - var_pop(y - wm * m - wq * q) / var_pop(y), 6) AS removed"
    " FROM b JOIN (SELECT session, c, m, q, y FROM y) z ON z.session = b.session AND z.c = b.c GROUP BY b.session, b.c"
)
ORACLE_SQL["record_pairs"] = (
    f"{FILTERED_SQL}, w AS (SELECT session, c, epoch, e[epoch * 320 + 1 : epoch * 320 + 640] AS x FROM fil, range(60) t(epoch) WHERE c < 2 AND epoch * 320 + 640 <= len(e)),"
    " k AS (SELECT session, c, epoch, s, n, x[32 * s + n + 1] AS v FROM w, range(19) t(s), range(64) u(n)),"
    " l AS (SELECT session, c, epoch, s, n, v - (regr_slope(v, n) OVER q * n + regr_intercept(v, n) OVER q) AS v FROM k WINDOW q AS (PARTITION BY session, c, epoch, s)),"
    " f AS (SELECT session, c, epoch, s, f, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * cos(2 * pi() * ((f * n) % 64) / 64)) AS re,"
    " -sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * sin(2 * pi() * ((f * n) % 64) / 64)) AS im FROM l, range(6, 11) t(f) GROUP BY session, c, epoch, s, f),"
    " x AS (SELECT a.session, a.epoch, a.f, a.re * b.re + a.im * b.im AS cr, a.im * b.re - a.re * b.im AS ci, a.re * a.re + a.im * a.im AS xx, b.re * b.re + b.im * b.im AS yy"
    " FROM f a JOIN f b ON a.session = b.session AND a.epoch = b.epoch AND a.s = b.s AND a.f = b.f AND a.c = 0 AND b.c = 1),"
    " m AS (SELECT session, epoch, f, (pow(avg(cr), 2) + pow(avg(ci), 2)) / (avg(xx) * avg(yy)) AS msc, abs(avg(ci)) / sqrt(avg(xx) * avg(yy)) AS imcoh,"
    " (pow(sum(ci), 2) - sum(ci * ci)) / (pow(sum(abs(ci)), 2) - sum(ci * ci)) AS wpli FROM x GROUP BY session, epoch, f)"
    " SELECT session, epoch, round(avg(msc) FILTER (WHERE f <= 8), 6) + 0.0 AS coh_theta2, round(avg(msc) FILTER (WHERE f >= 8), 6) + 0.0 AS coh_alpha1,"
    " round(avg(imcoh) FILTER (WHERE f >= 8), 6) + 0.0 AS imcoh_alpha1, round(avg(wpli) FILTER (WHERE f >= 8), 6) + 0.0 AS wpli_alpha1 FROM m GROUP BY session, epoch"
)
ORACLE_SQL["good_spectrum"] = (
    f"{EPOCHS_SQL}, ok AS (SELECT session, epoch, row_number() OVER (PARTITION BY session ORDER BY epoch) - 1 AS r FROM g WHERE c < 4"
    " GROUP BY session, epoch HAVING count(*) FILTER (WHERE amplitude <= 0.33 AND step <= 0.34) = 4),"
    " j AS (SELECT session, c, flatten(list(x ORDER BY r)) AS y, count(*) AS epochs FROM w JOIN ok USING (session, epoch) WHERE c < 4 GROUP BY session, c),"
    " sg AS (SELECT session, c, epochs, s, y[32 * s + 1 : 32 * s + 64] AS x FROM j, range(200) t(s) WHERE 32 * s + 64 <= len(y)),"
    " h AS (SELECT session, c, epochs, s, n, (x[n + 1] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS v FROM sg, range(64) t(n)),"
    " p AS (SELECT session, epochs, c, s, f AS freq, 2 * (pow(sum(v * cos(2 * pi() * ((f * n) % 64) / 64)), 2) + pow(sum(v * sin(2 * pi() * ((f * n) % 64) / 64)), 2)) / (64 * 24.0) AS power"
    " FROM h, range(1, 32) t(f) GROUP BY session, epochs, c, s, f)"
    " SELECT session, freq, round(10 * log10(greatest(avg(power), 1e-12)), 2) AS db, any_value(epochs) AS epochs FROM p GROUP BY session, freq"
)
QUERIES |= {f.__name__: f for f in (record_epochs, record_windows, record_ocular, record_pairs, good_spectrum)}
