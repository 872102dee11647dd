"""What a window of raw samples tells of an electrode's contact, rows of windows at a time."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import complexity
from .spectral import BANDS


class Contact(NamedTuple):
    """The parameters: rate, seconds cut from either end before measuring, filters, the line's band, the range and seconds of the slope's fit, and limits."""

    fs: float = 64.0
    trim: float = 1.5
    band: tuple[float, float] = (2, 24)
    order: int = 4
    notches: tuple[float, ...] = (16.0,)
    q: float = 30.0
    passes: int = 2
    line: tuple[float, float] = (15, 17)
    fit: tuple[float, float] = (3, 30)
    segment: float = 0.5
    least_sd: float = 0.02
    most_drift: float = 0.005
    green: tuple[float, float] = (0.1, 0.6)
    yellow: tuple[float, float] = (0.102, 0.64)


FIGURES = ["drift", "line", "sd", "p2p", "slope"]


def detrended(x: np.ndarray) -> np.ndarray:
    """Rows less their least-squares lines."""
    k = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    mean = x.mean(axis=1, keepdims=True)
    return x - mean - ((x - mean) @ k / (k @ k))[:, None] * k


def density(x: np.ndarray, seg: int, fs: float) -> np.ndarray:
    """Mean one-sided density of half-overlapping segments under a periodic Hann taper, each less its mean."""
    starts = range(0, x.shape[1] - seg + 1, seg // 2)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    parts = np.stack([x[:, s : s + seg] for s in starts], axis=1)
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * taper, axis=2)) ** 2 / (fs * (taper @ taper))
    power[:, :, 1 : (seg + 1) // 2] *= 2
    return power.mean(axis=1)


def share(p: np.ndarray, res: float, band: tuple[float, float], whole: tuple[float, float]) -> np.ndarray:
    """A band's power over the whole's, trapezoids over the bins within and below half the rate."""

    def area(lo: float, hi: float) -> np.ndarray:
        a, b = int(np.ceil(lo / res)), min(int(np.floor(hi / res)), p.shape[1] - 1)
        return (p[:, a:b] + p[:, a + 1 : b + 1]).sum(axis=1) / 2 * res

    with np.errstate(invalid="ignore", divide="ignore"):
        return area(*band) / area(*whole)


def slope(p: np.ndarray, res: float, fit: tuple[float, float], masked: tuple[float, float]) -> np.ndarray:
    """The slope of log power over log frequency within `fit` and outside `masked`; NaN where a power is not positive."""
    f = np.arange(p.shape[1]) * res
    used = (f >= fit[0]) & (f <= fit[1]) & ~((f >= masked[0]) & (f <= masked[1])) & (f > 0)
    k = np.log10(f[used])
    with np.errstate(invalid="ignore", divide="ignore"):
        y = np.log10(p[:, used])
    y[~np.isfinite(y).all(axis=1)] = np.nan
    return (y @ (k - k.mean())) / ((k - k.mean()) ** 2).sum()


def figures(x: np.ndarray, c: Contact) -> dict[str, np.ndarray]:
    """Drift of the raw rows a second; the line's share before any filter; deviation and range after notch, band-pass and trim; the slope after the notch."""
    flat = detrended(x)
    trend = x - flat
    n, seg = x.shape[1], int(round(c.segment * c.fs))
    notched = flat
    for _ in range(c.passes):
        for f in c.notches:
            notched = complexity.zero_phase(notched, complexity.notch_section(f, c.q, c.fs), 9)
    graded = complexity.zero_phase(notched, complexity.butterworth_sections(*c.band, c.order, c.fs), 27)
    cut = int(round(c.trim * c.fs))
    kept = graded[:, cut : n - cut] if cut and n > 2 * cut else graded
    return {
        "drift": np.ptp(trend, axis=1) / (n / c.fs),
        "line": share(density(flat, n, c.fs), c.fs / n, c.line, BANDS["total"]),
        "sd": kept.std(axis=1),
        "p2p": np.ptp(kept, axis=1),
        "slope": slope(density(notched, seg, c.fs), c.fs / seg, c.fit, BANDS["alpha"]),
    }


def grade(drift: float, sd: float, p2p: float, c: Contact) -> str:
    """red: dead, floating or too large; green: small; yellow between them. Line and slope only inform."""
    if not sd >= c.least_sd or drift > c.most_drift:
        return "red"
    if sd <= c.green[0] and p2p <= c.green[1]:
        return "green"
    return "red" if sd > c.yellow[0] or p2p > c.yellow[1] else "yellow"
