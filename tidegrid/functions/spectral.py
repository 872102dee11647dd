"""Spectral columns over arrays: everything about one window stays in its row, so no operator here shuffles. Only the FFT runs in numpy.

Columns or their names. x: array<double>, the window's samples. p: array<double>, its one-sided power density at bins of fs / n Hz, p[0] at 0 Hz.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands in Hz, both edges belong to them.
BANDS = {
    "theta": (4, 7), "theta2": (6, 8), "alpha": (8, 12), "alpha1": (8, 10), "alpha2": (10, 12), "smr": (12, 15), "beta": (15, 30), "total": (1, 31),
    "emg": (30, 45), "emg_wide": (20, 45), "line": (48, 52), "slow_eye": (0.2, 0.6),
}


def add(a: Column, b: Column) -> Column:
    return a + b


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), add)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, held in an array of one: what stands inside another array's lambda is computed for each of that array's items."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tapered(x: Column, n: int) -> Column:
    """The window under a periodic Hann taper."""
    taper = [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]
    return F.zip_with(x, F.array(*map(F.lit, taper)), lambda v, w: v * w)


def hann(x: Column, n: int) -> Column:
    """The window less its mean, under a periodic Hann taper."""
    return tapered(once(mean(x), lambda m: F.transform(x, lambda v: v - m)), n)


def line_removed(x: Column, n: int) -> Column:
    """The window less its least-squares line."""
    k, s = (n - 1) / 2, n * (n * n - 1) / 12
    line = F.struct(mean(x).alias("m"), (total(F.transform(x, lambda v, i: v * (i - k))) / s).alias("slope"))
    return once(line, lambda f: F.transform(x, lambda v, i: v - f["m"] - f["slope"] * (i - k)))


def over_windows(f: Callable[[np.ndarray], np.ndarray], x: Column) -> Column:
    """f of all windows of one length of an Arrow batch, as rows. Null without a window. Spark doesn't take a Python function out of its plan if the argument has a
    lambda within a lambda, as that of once(): such work on x belongs into f."""

    def batch(windows: pd.Series) -> pd.Series:
        there = windows.notna().to_numpy()
        if not there.any():
            return pd.Series([None] * len(windows), dtype=object)
        rows = iter(f(np.stack(windows[there].to_numpy())))
        return pd.Series([next(rows) if t else None for t in there], dtype=object)

    return F.pandas_udf(batch, "array<double>")(x)


def dft(y: Column) -> Column:
    """The real parts of bins 0 .. n / 2, then the imaginary ones: one FFT over a whole Arrow batch of windows of one length. Null without a window."""

    def of(v: np.ndarray) -> np.ndarray:
        z = np.fft.rfft(v, axis=1)
        return np.concatenate([z.real, z.imag], axis=1)

    return over_windows(of, y)


def line_removed_dft(x: Column, n: int) -> Column:
    """dft(tapered(line_removed(x))) as one column of numpy, with the same sums one after the other. Null without a window."""
    taper = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)])
    k, s = np.arange(n) - (n - 1) / 2, n * (n * n - 1) / 12

    def of(v: np.ndarray) -> np.ndarray:
        mean, slope = np.cumsum(v, axis=1)[:, -1:] / n, np.cumsum(v * k, axis=1)[:, -1:] / s
        z = np.fft.rfft((v - mean - slope * k) * taper, axis=1)
        return np.concatenate([z.real, z.imag], axis=1)

    return over_windows(of, x)


def density(z: Column, n: int, fs: float, square: float) -> Column:
    """One-sided power density from a tapered window's dft; square: the taper's sum of squares."""
    h = n // 2 + 1
    power = F.zip_with(F.slice(z, 1, h), F.slice(z, h + 1, h), lambda a, b: a * a + b * b)
    return F.transform(power, lambda v, i: v * F.when((i == 0) | (i == n // 2), 1.0).otherwise(2.0) / (fs * square))


def periodogram(x: Column, n: int, fs: float) -> Column:
    """density(dft(hann(x))) as one column of numpy over Arrow batches: what reads it many times finds it done. Null without a window."""
    taper = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)])
    weight = np.where(np.isin(np.arange(n // 2 + 1), (0, n // 2)), 1.0, 2.0)

    def of(v: np.ndarray) -> np.ndarray:
        # The mean by adding up one after the other, as mean() does.
        z = np.fft.rfft((v - np.cumsum(v, axis=1)[:, -1:] / v.shape[1]) * taper, axis=1)
        return (z.real * z.real + z.imag * z.imag) * (weight / (fs * (0.375 * n)))

    return over_windows(of, x)


def welch(x: Column, size: int, seg: int, fs: float) -> Column:
    """Mean density of half-overlapping segments."""
    starts = range(0, size - seg + 1, seg // 2)
    parts = [periodogram(F.slice(x, s + 1, seg), seg, fs) for s in starts]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, add)
    return F.transform(out, lambda v: v / len(parts))


def band_power(p: Column, lo: float, hi: float, res: float = 1.0) -> Column:
    """Trapezoid over the bins within the band, edges included."""
    a, b = math.ceil(lo / res), math.floor(hi / res)
    if b <= a:
        raise ValueError("a band needs two bins")
    return total(F.transform(F.sequence(F.lit(a), F.lit(b - 1)), lambda i: (F.get(p, i) + F.get(p, i + 1)) / 2 * res))


def relative_power(p: Column, band: str) -> Column:
    whole = band_power(p, *BANDS["total"])
    return F.when(whole > 0, band_power(p, *BANDS[band]) / whole)


def peak_frequency(p: Column, lo: int, hi: int, res: float = 1.0) -> Column:
    """The first bin of highest power within the band."""
    part = F.slice(p, lo + 1, hi - lo + 1)
    return (F.array_position(part, F.array_max(part)) - 1 + lo) * F.lit(res)


def log_line(p: Column, lo: int, hi: int, skip: tuple[int, int]) -> tuple[Column, Column]:
    """Slope and intercept of log10 power on log10 frequency over bins lo .. hi but those within skip; null if a power isn't positive."""
    bins = [f for f in range(lo, hi + 1) if not skip[0] <= f <= skip[1]]
    xs = [math.log10(f) for f in bins]
    m = sum(xs) / len(xs)
    s = sum((x - m) ** 2 for x in xs)
    ys = [F.log10(F.when(F.get(p, F.lit(f)) > 0, F.get(p, F.lit(f)))) for f in bins]
    slope = sum((y * F.lit((x - m) / s) for x, y in zip(xs[1:], ys[1:])), ys[0] * F.lit((xs[0] - m) / s))
    level = sum((y for y in ys[1:]), ys[0]) / len(ys)
    return slope, level - slope * m


def excess(p: Column, slope: Column, intercept: Column) -> Column:
    """Power over the aperiodic line, at least 0; the line at 0 Hz is that at 1e-9 Hz."""

    def over(line: Column) -> Column:
        return F.transform(p, lambda v, i: F.greatest(v - F.pow(F.lit(10.0), line["b"] + line["a"] * F.log10(F.greatest(i.cast("double"), F.lit(1e-9)))), F.lit(0.0)))

    return once(F.struct(slope.alias("a"), intercept.alias("b")), over)


def box(p: Column, k: int) -> Column:
    """Centred mean of k bins with zeros beyond the ends."""
    r = k // 2
    return F.transform(p, lambda _, i: total(F.transform(F.sequence(i - r, i + r), lambda j: F.when(j >= 0, F.coalesce(F.get(p, j), F.lit(0.0))).otherwise(0.0))) / k)


def interior_peak(p: Column, lo: int, hi: int) -> Column:
    """The bin within lo .. hi of the highest strict local maximum above 0; null without one."""
    at = F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda i: (F.get(p, i) > F.get(p, i - 1)) & (F.get(p, i) > F.get(p, i + 1)) & (F.get(p, i) > 0))
    best = F.array_max(F.transform(at, lambda i: F.get(p, i)))
    return F.get(F.filter(at, lambda i: F.get(p, i) == best), F.lit(0))


def entropy(p: Column, lo: int, hi: int) -> Column:
    """Shannon entropy of the power's shares within a band, over its highest possible value."""

    def of(part: Column) -> Column:
        terms = once(total(part), lambda s: F.transform(part, lambda v: -(v / s) * F.log(v / s)))
        return F.when(F.size(part) > 1, total(terms) / F.log(F.size(part).cast("double")))

    return once(F.filter(F.slice(p, lo + 1, hi - lo + 1), lambda v: v > 0), of)


def median5(v: Column) -> Column:
    """Moving median of five values, ends repeated; arrays shorter than 5 stay."""
    n = F.size(v)
    at = lambda i, k: F.get(v, F.greatest(F.lit(0), F.least(n - 1, i + k)))
    smooth = F.transform(v, lambda _, i: F.get(F.array_sort(F.array(*[at(i, k) for k in (-2, -1, 0, 1, 2)])), F.lit(2)))
    return F.when(n < 5, v).otherwise(smooth)
