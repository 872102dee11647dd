"""What has no relational form: Lempel-Ziv counts, coherence of segments and zero-phase recursive filters, in numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lz76(bits: str) -> int:
    """The number of components of the exhaustive history of a binary string: each is the shortest run not found before its own last symbol."""
    at, count, n = 0, 0, len(bits)
    while at < n:
        end = at + 1
        while end <= n and bits.find(bits[at:end], 0, end - 1) >= 0:
            end += 1
        count, at = count + 1, end
    return count


def lempel_ziv(x: Column) -> Column:
    """Components over n / log2 n, of the signal above its median; null below two samples."""

    def one(v: np.ndarray | None) -> float | None:
        if v is None or len(v) < 2:
            return None
        bits = "".join("1" if b else "0" for b in np.asarray(v) > np.median(v))
        return lz76(bits) * np.log2(len(bits)) / len(bits)

    def batch(windows: pd.Series) -> pd.Series:
        return windows.map(one)

    return F.pandas_udf(batch, "double")(x)


def pair_measures(x: Column, y: Column, fs: float, seg: int, band: tuple[float, float], least: int = 19) -> Column:
    """struct<msc, imcoh, wpli> of two signals over a band, both edges in it, from half-overlapping segments of `seg` samples, each less its line and under
    a Hann taper: coherence, imaginary coherence, debiased squared phase lag index. Null below `least` segments or without both signals."""
    k = np.arange(seg) - (seg - 1) / 2
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    freq = np.fft.rfftfreq(seg, 1 / fs)
    bins = np.flatnonzero((freq >= band[0]) & (freq <= band[1]))

    def spectra(v: np.ndarray) -> np.ndarray:
        parts = np.lib.stride_tricks.sliding_window_view(v, seg)[:: seg // 2]
        flat = parts - parts.mean(axis=1, keepdims=True) - np.outer(parts @ k / (k @ k), k)
        return np.fft.rfft(flat * taper, axis=1)[:, bins]

    def one(a: np.ndarray | None, b: np.ndarray | None) -> tuple:
        if a is None or b is None or min(len(a), len(b)) < seg or (len(a) - seg) // (seg // 2) + 1 < least or not len(bins):
            return None, None, None
        za, zb = spectra(np.asarray(a, float)), spectra(np.asarray(b, float))
        cross, im = za * zb.conj(), (za * zb.conj()).imag
        power = (abs(za) ** 2).mean(axis=0) * (abs(zb) ** 2).mean(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            square = (im**2).sum(axis=0)
            rest = abs(im).sum(axis=0) ** 2 - square
            found = abs(cross.mean(axis=0)) ** 2 / power, abs(im.mean(axis=0)) / np.sqrt(power), np.where(rest > 0, (im.sum(axis=0) ** 2 - square) / rest, np.nan)
        return tuple(float(v[np.isfinite(v)].mean()) if np.isfinite(v).any() else None for v in found)

    def batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*v) for v in zip(a, b)], columns=["msc", "imcoh", "wpli"], dtype=object).astype(float)

    return F.pandas_udf(batch, "msc double, imcoh double, wpli double")(x, y)


def butterworth_gain(freq: np.ndarray, lo: float, hi: float, order: int, fs: float) -> np.ndarray:
    """Squared magnitude of a digital Butterworth band-pass (bilinear transform), at frequencies below fs / 2."""
    warp = lambda f: np.tan(np.pi * np.asarray(f, float) / fs)
    w, a, b = warp(freq), warp(lo), warp(hi)
    with np.errstate(divide="ignore"):
        x = (w * w - a * b) / (w * (b - a))
    return 1 / (1 + x ** (2 * order))


def notch_gain(freq: np.ndarray, at: float, q: float, fs: float) -> np.ndarray:
    """Squared magnitude of a second-order digital notch of quality q."""
    w, w0 = 2 * np.pi * np.asarray(freq, float) / fs, 2 * np.pi * at / fs
    beta = np.tan(w0 / q / 2)
    z = np.exp(-1j * w)
    g = 1 / (1 + beta)
    h = g * (1 - 2 * np.cos(w0) * z + z * z) / (1 - 2 * g * np.cos(w0) * z + (2 * g - 1) * z * z)
    return np.abs(h) ** 2


def butterworth_sections(lo: float, hi: float, order: int, fs: float) -> np.ndarray:
    """A digital Butterworth band-pass (bilinear transform of the analogue one) as second-order sections b0 b1 b2 a0 a1 a2."""
    low, high = 4 * np.tan(np.pi * np.array([lo, hi]) / fs)
    width, centre = high - low, low * high
    base = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(base**2 - centre)
    poles = np.r_[base + root, base - root]
    gain = (width * 4) ** order / np.prod(4 - poles).real
    z = (4 + poles) / (4 - poles)
    z = z[z.imag > 0]
    out = np.c_[np.tile([1.0, 0.0, -1.0], (order, 1)), np.ones(order), -2 * z.real, np.abs(z) ** 2]
    out[0, :3] *= gain
    return out


def notch_section(at: float, q: float, fs: float) -> np.ndarray:
    """A second-order digital notch of quality q, as one section."""
    w = 2 * np.pi * at / fs
    g, c = 1 / (1 + np.tan(w / q / 2)), np.cos(w)
    return np.array([[g, -2 * g * c, g, 1.0, -2 * g * c, 2 * g - 1]])


def settled(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter the rows of x, each as if its first value had stood for ever."""
    level = x[:, 0].copy()
    for b0, b1, b2, _, a1, a2 in sections:
        total = (b0 + b1 + b2) / (1 + a1 + a2)
        second = (b2 - a2 * total) * level
        first = (b1 - a1 * total) * level + second
        level, y = total * level, np.empty_like(x)
        for i in range(x.shape[1]):
            y[:, i] = b0 * x[:, i] + first
            first = b1 * x[:, i] - a1 * y[:, i] + second
            second = b2 * x[:, i] - a2 * y[:, i]
        x = y
    return x


def zero_phase(x: np.ndarray, sections: np.ndarray, pad: int, passes: int = 1) -> np.ndarray:
    """Forward-backward filtering of the rows of x, extended at both ends by their point reflection, `pad` samples or as many as there are."""
    for _ in range(passes):
        k = min(pad, x.shape[1] - 1)
        ext = np.concatenate([2 * x[:, :1] - x[:, k:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -k - 2 : -1]], axis=1)
        ext = settled(sections, settled(sections, ext)[:, ::-1])[:, ::-1]
        x = ext[:, k : k + x.shape[1]]
    return x


def filter_arrays(sections: np.ndarray, pad: int, passes: int = 1):
    """A mapInPandas function that filters the column x of each row; rows of one length together. Null and empty arrays stay."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = list(frame["x"])
            sizes: dict[int, list[int]] = {}
            for i, v in enumerate(values):
                if v is not None and len(v):
                    sizes.setdefault(len(v), []).append(i)
            for places in sizes.values():
                done = zero_phase(np.array([values[i] for i in places], float), sections, pad, passes)
                for i, v in zip(places, done):
                    values[i] = v
            yield frame.assign(x=values)

    return task
