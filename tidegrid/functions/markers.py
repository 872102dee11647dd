"""The registry of markers: what is computed of a window, on which channels, and in which direction it is expected to go.

A marker is an entry with the function that gives its value from a window's columns; marker_columns() asks nothing else of it, so a new entry is a new
marker. Its value is null where one of its channels is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spectral as S


class Window(NamedTuple):
    """The columns of one window. channel: by channel a struct of what channel_features() tells of it, null without the channel; pair: by band the
    coherence measures of the front pair."""

    channel: dict[str, Column]
    pair: dict[str, Column]


#: What channel_features() tells of the spectrum: the power of bands.
POWERS = {k: S.BANDS[k] for k in ("theta", "alpha", "smr", "beta", "total")}


def channel_features(p: Column, bands: dict[str, tuple[float, float]]) -> list[Column]:
    """Of a power density at bins of 1 Hz: the power of bands, the slope of the aperiodic line, the alpha power above it, the entropy."""
    slope, _ = S.log_line(p, 3, 30, S.BANDS["alpha"])
    peak = S.once(S.excess(p, *S.log_line(p, 2, 30, (7, 14))), lambda above: S.band_power(above, *S.BANDS["alpha"]))
    powers = [S.band_power(p, *b).alias(k) for k, b in (POWERS | bands).items()]
    return [*powers, slope.alias("slope"), peak.alias("peak"), S.entropy(p, *S.BANDS["total"]).alias("entropy")]


class Marker(NamedTuple):
    id: str
    kind: str
    channels: tuple[str, ...]
    role: str
    expected: str
    of: Callable[[Window, tuple[str, ...]], Column]
    composite: bool = False


def mean_of(values: list[Column]) -> Column:
    """Null if one of the values is."""
    return reduce(S.add, values) / len(values)


def mean_known(values: list[Column]) -> Column:
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, S.mean(known))


def relative(band: str) -> Callable[[Window, tuple[str, ...]], Column]:
    return lambda w, channels: mean_of([F.when(w.channel[c]["total"] > 0, w.channel[c][band] / w.channel[c]["total"]) for c in channels])


def alpha_beta(w: Window, channels: tuple[str, ...]) -> Column:
    beta = relative("beta")(w, FRONT)
    return F.when(beta > 0, relative("alpha")(w, channels) / beta)


def asymmetry(w: Window, channels: tuple[str, ...]) -> Column:
    left, right = (w.channel[c]["alpha"] for c in channels)
    return F.when((left > 0) & (right > 0), F.log(right) - F.log(left))


def exponent(w: Window, channels: tuple[str, ...]) -> Column:
    return -mean_known([w.channel[c]["slope"] for c in channels])


def feature(name: str) -> Callable[[Window, tuple[str, ...]], Column]:
    return lambda w, channels: mean_known([w.channel[c][name] for c in channels])


def measure(name: str, band: str) -> Callable[[Window, tuple[str, ...]], Column]:
    return lambda w, channels: w.pair[band][name]


def complexity(w: Window, channels: tuple[str, ...]) -> Column:
    return mean_of([w.channel[c]["lziv"] for c in channels])


FOUR, FRONT, CENTRE = ("F3", "F4", "C3", "C4"), ("F3", "F4"), ("C3", "C4")

#: Fixed values.
MARKERS = [
    Marker("alpha_rel", "psd", FOUR, "marker", "up", relative("alpha"), True),
    Marker("beta_rel", "psd", FRONT, "marker", "down", relative("beta"), True),
    Marker("alpha_beta", "psd", FOUR, "marker", "up", alpha_beta),
    Marker("smr_rel", "psd", CENTRE, "marker", "up", relative("smr"), True),
    Marker("theta_rel", "psd", FRONT, "marker", "unknown", relative("theta")),
    Marker("faa", "psd", FRONT, "marker", "unknown", asymmetry),
    Marker("coh_alpha1", "pair", FRONT, "marker", "up", measure("msc", "alpha1")),
    Marker("coh_theta2", "pair", FRONT, "marker", "up", measure("msc", "theta2")),
    Marker("imcoh_alpha1", "pair", FRONT, "extra", "up", measure("imcoh", "alpha1")),
    Marker("wpli_alpha1", "pair", FRONT, "extra", "unknown", measure("wpli", "alpha1")),
    Marker("ap_exponent", "psd", FOUR, "extra", "unknown", exponent),
    Marker("lziv", "timeseries", FOUR, "extra", "unknown", complexity),
    Marker("alpha_peak_power", "psd", FOUR, "extra", "up", feature("peak")),
    Marker("spectral_entropy", "psd", FOUR, "extra", "unknown", feature("entropy")),
]
SIGNED = ("faa", "wpli_alpha1", "imcoh_alpha1")


def markers(role: str | None = None, kind: str | None = None) -> list[Marker]:
    return [m for m in MARKERS if (role is None or m.role == role) and (kind is None or m.kind == kind)]


def get(marker: str) -> Marker:
    for m in MARKERS:
        if m.id == marker:
            return m
    raise KeyError(f"{marker}; known: {', '.join(m.id for m in MARKERS)}")


def marker_columns(window: Window, wanted: list[Marker] | None = None) -> list[Column]:
    """Each marker's value in a window, under its id; null where one of its channels is missing."""
    out = []
    for m in MARKERS if wanted is None else wanted:
        there = reduce(lambda a, b: a & b, [window.channel[c].isNotNull() for c in m.channels])
        out.append(F.when(there, m.of(window, m.channels)).alias(m.id))
    return out


def frame(spark: SparkSession) -> DataFrame:
    rows = [(m.id, m.kind, list(m.channels), m.role, m.expected, m.composite) for m in MARKERS]
    return spark.createDataFrame(rows, "id string, kind string, channels array<string>, role string, expected string, composite boolean")
