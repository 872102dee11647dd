"""Queries on the vectors as short signals (64 samples at 64 Hz): spectra, markers, connectivity, complexity, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexity
from ..functions import spectral as S
from ..sources.tables import samples, vectors
from .signals import r6

N = 64
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


X = "x AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
PSD = (
    f"WITH {X}, y AS (SELECT vec_id, label, n, (x[n + 1] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS y FROM x, range(64) t(n)),"
    " psd AS (SELECT vec_id, label, f AS freq, (CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END) * (pow(sum(y * cos(2 * pi() * ((f * n) % 64) / 64)), 2) + pow(sum(y * sin(2 * pi() * ((f * n) % 64) / 64)), 2)) / (64 * 24.0) AS power FROM y, range(33) t(f) GROUP BY vec_id, label, f),"
    " tz AS (SELECT *, (power + lag(power) OVER (PARTITION BY vec_id ORDER BY freq)) / 2 AS area FROM psd)"
)


def band_sql(lo: int, hi: int) -> str:
    return f"sum(area) FILTER (WHERE freq > {lo} AND freq <= {hi})"


def spectra(spark, d) -> DataFrame:
    """vec_id, label, p: one row a vector, the whole spectrum in it."""
    return vectors(spark, d).select("vec_id", "label", S.periodogram(F.col("x"), N, float(N)).alias("p"))


P = "p"


@query(f"{PSD} SELECT vec_id, freq, round(power, 8) AS power FROM psd")
def psd_dft(spark, d) -> DataFrame:
    return spectra(spark, d).select("vec_id", F.posexplode("p").alias("freq", "power")).select("vec_id", F.col("freq").cast("long").alias("freq"), F.round("power", 8).alias("power"))


@query(
    f"WITH {X}, g AS (SELECT vec_id, s, x[16 * s + 1 : 16 * s + 32] AS x FROM x, range(3) t(s)), y AS (SELECT vec_id, s, n, (x[n + 1] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * n / 32)) AS y FROM g, range(32) t(n)),"
    " p AS (SELECT vec_id, s, f, (CASE WHEN f IN (0, 16) THEN 1 ELSE 2 END) * (pow(sum(y * cos(2 * pi() * ((f * n) % 32) / 32)), 2) + pow(sum(y * sin(2 * pi() * ((f * n) % 32) / 32)), 2)) / (64 * 12.0) AS power FROM y, range(17) t(f) GROUP BY vec_id, s, f)"
    " SELECT vec_id, f * 2.0::DOUBLE AS freq, round(avg(power), 8) AS power FROM p GROUP BY vec_id, f"
)
def welch_psd(spark, d) -> DataFrame:
    w = vectors(spark, d).select("vec_id", F.posexplode(S.welch(F.col("x"), N, 32, float(N))).alias("f", "power"))
    return w.select("vec_id", (F.col("f") * F.lit(2.0)).alias("freq"), F.round("power", 8).alias("power"))


_B = {"alpha": (8, 12), "beta": (15, 30), "smr": (12, 15), "theta": (4, 7), "total": (1, 31)}
_PW = f"{PSD}, bp AS (SELECT vec_id, label, {', '.join(f'{band_sql(*v)} AS {k}' for k, v in _B.items())} FROM tz GROUP BY vec_id, label)"


@query(f"{_PW} SELECT vec_id, {', '.join(f'round({k}, 8) AS {k}' for k in _B)} FROM bp")
def band_power(spark, d) -> DataFrame:
    return spectra(spark, d).select("vec_id", *[F.round(S.band_power(P, *v), 8).alias(k) for k, v in _B.items()])


@query(f"{_PW} SELECT vec_id, round(alpha / total, 6) AS alpha_rel, round(beta / total, 6) AS beta_rel, round(smr / total, 6) AS smr_rel, round(theta / total, 6) AS theta_rel, round(alpha / beta, 6) AS alpha_beta FROM bp")
def relative_power(spark, d) -> DataFrame:
    rel = {f"{k}_rel": S.relative_power(P, k) for k in ("alpha", "beta", "smr", "theta")}
    return spectra(spark, d).select("vec_id", *[F.round(v, 6).alias(k) for k, v in rel.items()], F.round(rel["alpha_rel"] / rel["beta_rel"], 6).alias("alpha_beta"))


@query(f"{PSD}, m AS (SELECT label, freq, avg(power) AS v FROM psd WHERE freq BETWEEN 1 AND 31 GROUP BY label, freq) SELECT label, freq, round(10 * log10(greatest(v, 1e-12)), 4) AS db FROM m")
def db_spectrum(spark, d) -> DataFrame:
    long = spectra(spark, d).select("label", F.posexplode("p").alias("freq", "power")).where("freq BETWEEN 1 AND 31")
    m = long.groupBy("label", F.col("freq").cast("long").alias("freq")).agg(F.avg("power").alias("v"))
    return m.select("label", "freq", F.round(10 * F.log10(F.greatest("v", F.lit(1e-12))), 4).alias("db"))


@query(f"{PSD} SELECT vec_id, arg_max(freq, power)::DOUBLE AS peak FROM psd WHERE freq BETWEEN 8 AND 12 GROUP BY vec_id")
def peak_frequency(spark, d) -> DataFrame:
    return spectra(spark, d).select("vec_id", S.peak_frequency(P, 8, 12).cast("double").alias("peak"))


_FIT = f"{PSD}, ft AS (SELECT vec_id, regr_slope(log10(power), log10(freq)) AS a, regr_intercept(log10(power), log10(freq)) AS b FROM psd WHERE freq BETWEEN 2 AND 30 AND freq NOT BETWEEN 7 AND 14 GROUP BY vec_id)"
_EX = f"{_FIT}, ex AS (SELECT vec_id, freq, greatest(power - pow(10, b + a * log10(greatest(freq, 1e-9))), 0) AS e FROM psd JOIN ft USING (vec_id))"


def fitted(spark, d) -> DataFrame:
    slope, intercept = S.log_line(P, 2, 30, (7, 14))
    return spectra(spark, d).select("vec_id", "label", "p", slope.alias("a"), intercept.alias("b"))


@query(f"{_FIT} SELECT vec_id, round(a, 6) + 0.0 AS slope, round(b, 6) + 0.0 AS intercept, round(-a, 6) + 0.0 AS ap_exponent FROM ft")
def spectral_slope_aperiodic(spark, d) -> DataFrame:
    return fitted(spark, d).select("vec_id", r6("a").alias("slope"), r6("b").alias("intercept"), r6(-F.col("a")).alias("ap_exponent"))


@query(f"{_EX}, tp AS (SELECT *, (e + lag(e) OVER (PARTITION BY vec_id ORDER BY freq)) / 2 AS area FROM ex) SELECT vec_id, round({band_sql(8, 12)}, 8) AS periodic FROM tp GROUP BY vec_id")
def periodic_power(spark, d) -> DataFrame:
    return fitted(spark, d).select("vec_id", F.round(S.band_power(S.excess(P, F.col("a"), F.col("b")), 8, 12), 8).alias("periodic"))


@query(
    f"{_EX}, sm AS (SELECT vec_id, freq, (e + coalesce(lag(e) OVER o, 0) + coalesce(lead(e) OVER o, 0)) / 3 AS s FROM ex WINDOW o AS (PARTITION BY vec_id ORDER BY freq)),"
    " pk AS (SELECT *, s > lag(s) OVER o AND s > lead(s) OVER o AND s > 0 AS top FROM sm WINDOW o AS (PARTITION BY vec_id ORDER BY freq))"
    " SELECT vec_id, (arg_max(freq, s) FILTER (WHERE top AND freq BETWEEN 7 AND 13))::BIGINT AS iaf FROM pk GROUP BY vec_id"
)
def individual_alpha_frequency(spark, d) -> DataFrame:
    smooth = fitted(spark, d).select("vec_id", S.box(S.excess(P, F.col("a"), F.col("b")), 3).alias("s"))
    return smooth.select("vec_id", S.interior_peak(F.col("s"), 7, 13).cast("long").alias("iaf"))


_FL = f"{PSD}, bl AS (SELECT label, vec_id % 2 AS half, {band_sql(8, 12)} AS a, {band_sql(5, 7)} AS lo, {band_sql(15, 25)} AS hi FROM tz GROUP BY label, half)"


@query(f"{_FL} SELECT o.label, round(log2(e.a / o.a) - (log2(e.lo / o.lo) + log2(e.hi / o.hi)) / 2, 6) + 0.0 AS reactivity FROM bl o JOIN bl e ON o.label = e.label AND o.half = 1 AND e.half = 0")
def band_reactivity(spark, d) -> DataFrame:
    """Alpha of one half of a label's windows over the other's, less what the flanks change."""
    of = lambda lo, hi, k: F.sum(F.when(F.col("vec_id") % 2 == k, S.band_power(P, lo, hi)))
    g = spectra(spark, d).groupBy("label").agg(*[of(lo, hi, k).alias(f"{n}{k}") for n, (lo, hi) in {"a": (8, 12), "lo": (5, 7), "hi": (15, 25)}.items() for k in (0, 1)])
    r = F.expr("log2(a0 / a1) - (log2(lo0 / lo1) + log2(hi0 / hi1)) / 2")
    return g.where(r.isNotNull()).select("label", r6(r).alias("reactivity"))


@query(f"{PSD}, b AS (SELECT vec_id, {band_sql(8, 12)} AS a, {band_sql(5, 7)} AS lo, {band_sql(15, 25)} AS hi FROM tz GROUP BY vec_id) SELECT vec_id, round(log2(greatest(a, 1e-12)) - (log2(greatest(lo, 1e-12)) + log2(greatest(hi, 1e-12))) / 2, 6) + 0.0 AS alpha_spec FROM b")
def alpha_spec(spark, d) -> DataFrame:
    lg = lambda lo, hi: F.log2(F.greatest(S.band_power(P, lo, hi), F.lit(1e-12)))
    return spectra(spark, d).select("vec_id", r6(lg(8, 12) - (lg(5, 7) + lg(15, 25)) / 2).alias("alpha_spec"))


@query(f"{PSD}, s AS (SELECT vec_id, power / sum(power) OVER (PARTITION BY vec_id) AS q FROM psd WHERE freq BETWEEN 1 AND 31 AND power > 0) SELECT vec_id, round(-sum(q * ln(q)) / ln(count(*)), 6) AS entropy FROM s GROUP BY vec_id")
def spectral_entropy(spark, d) -> DataFrame:
    return spectra(spark, d).select("vec_id", F.round(S.entropy(P, 1, 31), 6).alias("entropy"))


@query(f"{_PW}, w AS (SELECT vec_id // 2 AS pair, max(alpha) FILTER (WHERE vec_id % 2 = 0) AS l, max(alpha) FILTER (WHERE vec_id % 2 = 1) AS r FROM bp GROUP BY pair) SELECT pair, round(ln(r) - ln(l), 6) + 0.0 AS faa FROM w WHERE l > 0 AND r > 0")
def faa(spark, d) -> DataFrame:
    a = spectra(spark, d).select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), S.band_power(P, 8, 12).alias("a"))
    w = a.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("a"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("a"))).alias("r"))
    return w.where("l > 0 AND r > 0").select("pair", r6(F.log("r") - F.log("l")).alias("faa"))


_CS = (
    f"WITH {X}, g AS (SELECT vec_id, s, x[8 * s + 1 : 8 * s + 16] AS x FROM x, range(7) t(s)), k AS (SELECT vec_id, s, n, x[n + 1] AS v FROM g, range(16) t(n)),"
    " l AS (SELECT vec_id, s, n, v - (regr_slope(v, n) OVER w * n + regr_intercept(v, n) OVER w) AS v FROM k WINDOW w AS (PARTITION BY vec_id, s)),"
    " f AS (SELECT vec_id, s, f, sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * cos(2 * pi() * ((f * n) % 16) / 16)) AS re, -sum(v * (0.5 - 0.5 * cos(2 * pi() * n / 16)) * sin(2 * pi() * ((f * n) % 16) / 16)) AS im FROM l, range(1, 5) t(f) GROUP BY vec_id, s, f),"
    " c AS (SELECT a.vec_id // 2 AS pair, a.f, a.s, a.re * b.re + a.im * b.im AS cr, a.im * b.re - a.re * b.im AS ci, a.re * a.re + a.im * a.im AS xx, b.re * b.re + b.im * b.im AS yy FROM f a JOIN f b ON a.vec_id + 1 = b.vec_id AND a.vec_id % 2 = 0 AND a.s = b.s AND a.f = b.f)"
)


def crossed(spark, d) -> DataFrame:
    """pair, f, s, cr, ci, xx, yy: cross- and auto-spectra of seven half-overlapping segments. A pair's signals meet in one shuffle of the vectors."""
    v = vectors(spark, d).select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), "x")
    pair = v.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    seg = pair.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(6))))
    for side in ("a", "b"):
        seg = seg.withColumn(f"{side}_z", S.line_removed_dft(F.slice(side, F.col("s") * 8 + 1, F.lit(16)), 16))
    for side in ("a", "b"):
        seg = seg.withColumn(f"{side}_re", F.slice(f"{side}_z", 1, 9)).withColumn(f"{side}_im", F.slice(f"{side}_z", 10, 9))
    z = seg.select("pair", "s", F.posexplode(F.arrays_zip("a_re", "a_im", "b_re", "b_im")).alias("f", "z")).where("f BETWEEN 1 AND 4")
    return z.selectExpr("pair", "CAST(f AS BIGINT) AS f", "s", "z.a_re * z.b_re + z.a_im * z.b_im AS cr", "z.a_im * z.b_re - z.a_re * z.b_im AS ci", "z.a_re * z.a_re + z.a_im * z.a_im AS xx", "z.b_re * z.b_re + z.b_im * z.b_im AS yy")


@query(f"{_CS} SELECT pair, f, round(avg(cr), 8) + 0.0 AS cr, round(avg(ci), 8) + 0.0 AS ci, round(avg(xx), 8) AS xx, round(avg(yy), 8) AS yy FROM c GROUP BY pair, f")
def cross_spectra(spark, d) -> DataFrame:
    return crossed(spark, d).groupBy("pair", "f").agg(*[(F.round(F.avg(c), 8) + 0.0).alias(c) for c in ("cr", "ci", "xx", "yy")])


@query(
    f"{_CS}, b AS (SELECT pair, f, (pow(avg(cr), 2) + pow(avg(ci), 2)) / (avg(xx) * avg(yy)) AS msc, abs(avg(ci)) / sqrt(avg(xx) * avg(yy)) AS imcoh,"
    " (pow(sum(ci), 2) - sum(ci * ci)) / nullif(pow(sum(abs(ci)), 2) - sum(ci * ci), 0) AS wpli FROM c GROUP BY pair, f)"
    " SELECT pair, round(avg(msc), 6) AS msc, round(avg(imcoh), 6) AS imcoh, round(avg(wpli), 6) + 0.0 AS wpli FROM b WHERE f BETWEEN 2 AND 3 GROUP BY pair"
)
def coherence_imcoh_wpli(spark, d) -> DataFrame:
    a = crossed(spark, d).where("f BETWEEN 2 AND 3").groupBy("pair", "f").agg(
        F.expr("(pow(avg(cr), 2) + pow(avg(ci), 2)) / (avg(xx) * avg(yy))").alias("msc"),
        F.expr("abs(avg(ci)) / sqrt(avg(xx) * avg(yy))").alias("imcoh"),
        F.expr("(pow(sum(ci), 2) - sum(ci * ci)) / nullif(pow(sum(abs(ci)), 2) - sum(ci * ci), 0)").alias("wpli"),
    )
    return a.groupBy("pair").agg(F.round(F.avg("msc"), 6).alias("msc"), F.round(F.avg("imcoh"), 6).alias("imcoh"), r6(F.avg("wpli")).alias("wpli"))


@query(
    f"WITH {X}, p AS (SELECT a.vec_id // 2 AS pair, a.x AS a, b.x AS b FROM x a JOIN x b ON a.vec_id + 1 = b.vec_id AND a.vec_id % 2 = 0), k AS (SELECT pair, a[n + 1] AS u, b[n + 1] AS v FROM p, range(64) t(n))"
    " SELECT pair, round(corr(u, v), 6) + 0.0 AS r, round(stddev_pop(u - v) / median_sd, 6) AS ratio, corr(u, v) >= 0.98 AND stddev_pop(u - v) / median_sd <= 0.02 AS shorted FROM k JOIN (SELECT pair, (stddev_pop(u) + stddev_pop(v)) / 2 AS median_sd FROM k GROUP BY pair) USING (pair) GROUP BY pair, median_sd"
)
def channel_independence(spark, d) -> DataFrame:
    v = vectors(spark, d).select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("side"), "x")
    pair = v.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    k = pair.select("pair", F.inline(F.arrays_zip("a", "b")))
    g = k.groupBy("pair").agg(F.corr("a", "b").alias("r"), (F.stddev_pop(F.col("a") - F.col("b")) / ((F.stddev_pop("a") + F.stddev_pop("b")) / 2)).alias("ratio"))
    return g.select("pair", r6("r").alias("r"), F.round("ratio", 6).alias("ratio"), ((F.col("r") >= 0.98) & (F.col("ratio") <= 0.02)).alias("shorted"))


_SD = "WITH s AS (SELECT user_id AS session, event_type AS channel, stddev_pop(value) AS sd, max(value) - min(value) AS p2p FROM events GROUP BY ALL)"


@query(f"{_SD}, t AS (SELECT session, arg_max(channel, (round(sd, 9), channel)) AS channel FROM s GROUP BY session) SELECT t.session, t.channel, round(max(s.sd) FILTER (WHERE s.channel = t.channel) / nullif(median(s.sd) FILTER (WHERE s.channel <> t.channel), 0), 6) AS ratio FROM t JOIN s USING (session) GROUP BY t.session, t.channel")
def tap_identify(spark, d) -> DataFrame:
    s = samples(spark, d).groupBy("session", "channel").agg(F.stddev_pop("value").alias("sd"))
    t = s.groupBy("session").agg(F.max(F.struct(F.round("sd", 9).alias("k"), "channel")).alias("t")).select("session", F.col("t.channel").alias("top"))
    same = F.col("channel") == F.col("top")
    g = s.join(t, "session").groupBy("session", F.col("top").alias("channel")).agg(F.max(F.when(same, F.col("sd"))).alias("a"), F.median(F.when(~same, F.col("sd"))).alias("b"))
    return g.select("session", "channel", F.round(F.col("a") / F.nullif(F.col("b"), F.lit(0.0)), 6).alias("ratio"))


@query(f"{_SD} SELECT session, channel, CASE WHEN sd < 0.5 THEN 'red' WHEN sd <= 25 AND p2p <= 80 THEN 'green' WHEN sd > 32 OR p2p > 98 THEN 'red' ELSE 'yellow' END AS grade FROM s")
def contact_grade(spark, d) -> DataFrame:
    s = samples(spark, d).groupBy("session", "channel").agg(F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("p2p"))
    return s.select("session", "channel", F.expr("CASE WHEN sd < 0.5 THEN 'red' WHEN sd <= 25 AND p2p <= 80 THEN 'green' WHEN sd > 32 OR p2p > 98 THEN 'red' ELSE 'yellow' END").alias("grade"))


@query()
def lempel_ziv(spark, d) -> DataFrame:
    return vectors(spark, d).select("vec_id", F.round(complexity.lempel_ziv(F.col("x")), 6).alias("lziv"))


@query()
def zero_phase_bandpass(spark, d) -> DataFrame:
    """4 to 20 Hz, of order 4, forward and backward."""
    band = complexity.filter_arrays(complexity.butterworth_sections(4, 20, 4, 64.0), 27)
    out = vectors(spark, d).select("vec_id", "x").mapInPandas(band, "vec_id long, x array<double>")
    return out.select("vec_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query()
def notch_filter(spark, d) -> DataFrame:
    """16 Hz with quality 30, two passes forward and backward."""
    notch = complexity.filter_arrays(complexity.notch_section(16.0, 30.0, 64.0), 9, passes=2)
    out = vectors(spark, d).select("vec_id", "x").mapInPandas(notch, "vec_id long, x array<double>")
    return out.select("vec_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


def registry_sql() -> str:
    from ..functions.markers import MARKERS

    rows = ", ".join(f"('{m.id}', '{m.kind}', {list(m.channels)}, '{m.role}', '{m.expected}', {str(m.composite).lower()})" for m in MARKERS)
    return f"SELECT * FROM (VALUES {rows}) t(id, kind, channels, role, expected, composite)"


@query(registry_sql())
def marker_registry(spark, d) -> DataFrame:
    from ..functions.markers import frame

    return frame(spark)
