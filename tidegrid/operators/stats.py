"""Robust statistics of two phases: medians, spreads, Cliff's delta, lags, bootstrap intervals, rank correlation, sign tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD = 1.4826


def rounded(c: Column | str, places: int) -> Column:
    """Rounded as SQL engines on doubles do: the value times a power of ten goes to the nearest whole number, of two to the one further from 0. round() goes by the
    value's shortest decimal text instead, which lies on a tie where the product doesn't (-0.5025 gives -0.503 there, -0.502 here)."""
    scale = F.lit(10.0**places)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale, 0) / scale


def mid_rank(value: str, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def spread(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, centre, spread: 1.4826 times the median distance from the median; null if there are fewer than 3 values or it is 0."""
    m = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias("centre"), F.count(value).alias("_n"))
    d = df.join(m, keys).groupBy(*keys, "centre", "_n").agg((MAD * F.median(F.abs(F.col(value) - F.col("centre")))).alias("_d"))
    return d.select(*keys, "centre", F.when((F.col("_n") >= 3) & (F.col("_d") > 0), F.col("_d")).alias("spread"))


def cliffs_delta(df: DataFrame, value: str, group: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys, n_a, n_b, delta by mid-ranks: no pair of values is formed."""
    both = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).withColumn("_r", mid_rank(value, keys))
    is_b = F.col(group) == b
    out = both.groupBy(*keys).agg(F.count_if(~is_b).alias("n_a"), F.count_if(is_b).alias("n_b"), F.sum(F.when(is_b, F.col("_r"))).alias("_s"))
    delta = (2 * F.col("_s") - F.col("n_b") * (F.col("n_b") + 1)) / (F.col("n_a") * F.col("n_b")) - 1
    return out.select(*keys, "n_a", "n_b", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), delta).alias("delta"))


def two_phase(a: np.ndarray, b: np.ndarray) -> tuple:
    """median of a, of b, 1.4826 times the median distance of a's values from their median, Cliff's delta: null below 3 values (the delta: without any)."""
    n, m = len(a), len(b)
    middle = float(np.median(a)) if n else None
    far = float(MAD * np.median(np.abs(a - middle))) if n >= 3 else 0.0
    order = np.sort(a)
    less, most = np.searchsorted(order, b), np.searchsorted(order, b, "right")
    delta = float((less.sum() - (n - most).sum()) / (n * m)) if n and m else None
    enough = min(n, m) >= 3
    return middle if enough else None, float(np.median(b)) if enough else None, far if far > 0 else None, delta


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, those of equal values averaged."""
    _, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place]


def rank_correlation(x: np.ndarray, y: np.ndarray, least: int = 5) -> float | None:
    if len(x) < least:
        return None
    a, b = ranks(x), ranks(y)
    a, b = a - a.mean(), b - b.mean()
    size = float(np.sqrt((a @ a) * (b @ b)))
    return float(a @ b) / size if size > 0 else None


def delta_label(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").when(d.isNotNull(), "large").otherwise("undetermined")


def field(name: str) -> Callable[[Column], Column]:
    """A function that takes a field of structs, for transform()."""
    return lambda e: e[name]


def mean_in_order(x: Column) -> Column:
    """The mean of an array of known values, added up one after the other; null if it is empty."""
    return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x))


def deviation_in_order(x: Column) -> Column:
    """The population's standard deviation of an array of known values, by Welford's recurrence from the first to the last; null if it is empty."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def add(a: Column, v: Column) -> Column:
        mean = a["mean"] + (v - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["square"] + (v - mean) * (v - a["mean"])).alias("square"))

    return F.when(F.size(x) > 0, F.aggregate(x, zero, add, lambda a: F.sqrt(a["square"] / a["n"])))


def series_arrays(df: DataFrame, value: str, index: str, keys: list[str], **parts: Column) -> DataFrame:
    """keys and, for each part (a condition), the array of its known values in the order of the index: one shuffle of the series."""
    def of(condition: Column) -> Column:
        pairs = F.collect_list(F.when(condition & F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v"))))
        return F.transform(F.array_sort(pairs), field("v"))

    return df.groupBy(*keys).agg(*[of(c).alias(k) for k, c in parts.items()])


def over_arrays(arrays: DataFrame, keys: list[str], inputs: list[str], outputs: dict[str, pa.DataType], f: Callable[..., tuple]) -> DataFrame:
    """keys and the outputs of f on each row's arrays, in numpy over Arrow batches."""
    known = {f.name: f.dataType.simpleString() for f in arrays.schema.fields}
    names = {pa.float64(): "double", pa.int64(): "long", pa.list_(pa.float64()): "array<double>"}
    schema = ", ".join([f"`{k}` {known[k]}" for k in keys] + [f"{k} {names[t]}" for k, t in outputs.items()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f(*[np.array(x, float) for x in xs]) for xs in zip(*(batch.column(k).to_pylist() for k in inputs))]
            columns = {k: batch.column(k) for k in keys} | {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(outputs.items())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return arrays.select(*keys, *inputs).mapInArrow(task, schema)


def decorrelation_lag(df: DataFrame, value: str, index: str, keys: list[str]) -> DataFrame:
    """keys, n, lag: the first of all lags at which the biased autocorrelation falls below 1/e, else n div 2; 1 for short or constant series."""
    arrays = series_arrays(df, value, index, keys, x=F.lit(True))
    return over_arrays(arrays, keys, ["x"], {"n": pa.int64(), "lag": pa.int64()}, lambda x: (len(x), array_lag(x)))


def block_length(lag: Column, least: int, most: int) -> Column:
    return F.least(F.greatest(2 * lag, F.lit(least)), F.lit(most))


#: Streams of numbers: where the blocks of either phase begin, and what they begin at.
RESTART_A, ANCHOR_A, RESTART_B, ANCHOR_B = range(4)


def hash32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that SQL can state: two rounds of a shift and a multiplication."""
    low = np.uint64(0xFFFFFFFF)
    x = x.astype(np.uint64) & low
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(73244475) & low
    return (x >> np.uint64(16)) ^ x


def uniforms(stream: int, first: int, reps: int, n: int, at: int = 0) -> np.ndarray:
    """Numbers in [0, 1) for replicates first .. and n places from `at` on: they depend on stream, replicate and place alone."""
    of_rep = hash32(np.arange(first, first + reps) * 16 + stream)
    return hash32(of_rep[:, None] + np.arange(at, at + n, dtype=np.uint64)) / 2.0**32


def array_lag(x: np.ndarray, threshold: float = 0.3679) -> int:
    """decorrelation_lag of one series, over all its lags."""
    n, centred = len(x), x - x.mean() if len(x) else x
    square = float(centred @ centred)
    if n < 4 or square <= 0:
        return 1
    if n > 4096:
        size = 1 << (2 * n - 1).bit_length()
        acf = np.fft.irfft(np.abs(np.fft.rfft(centred, size)) ** 2, size)[:n] / square
    else:
        acf = np.correlate(centred, centred, "full")[n - 1 :] / square
    below = np.flatnonzero(acf < threshold)
    return int(below[0]) if len(below) else n // 2


def resampled(n: int, block: float, first: int, reps: int, streams: tuple[int, int]) -> np.ndarray:
    """Places of stationary-bootstrap replicates first .. of n values: blocks of geometric length, around the end."""
    at = np.arange(n)
    restart = uniforms(streams[0], first, reps, n) < 1.0 / block
    restart[:, 0] = True
    since = np.maximum.accumulate(np.where(restart, at, 0), axis=1)
    anchor = np.floor(uniforms(streams[1], first, reps, n) * n).astype(np.int64)
    return (np.take_along_axis(anchor, since, axis=1) + at - since) % n


#: The longest series whose draws are counted by place, and the tables of counts that a worker keeps: 130 MB at most for 2,000 replicates.
COUNTED, TABLES = 255, 256


@lru_cache(TABLES)
def draws(n: int, block: float, reps: int, streams: tuple[int, int]) -> np.ndarray:
    """How often each replicate (a column) draws each place (a row). It depends on the length of series and blocks alone, so series share it."""
    at = resampled(n, block, 0, reps, streams) * reps + np.arange(reps)[:, None]
    return np.bincount(at.ravel(), minlength=n * reps).reshape(n, reps).astype(np.uint8)


def replicate_medians(x: np.ndarray, block: float, reps: int, streams: tuple[int, int]) -> np.ndarray:
    """The medians of a series' stationary-bootstrap replicates. Of a short series the draws of its sorted places are added up until they reach the middle: no
    replicate is formed; a longer one, or one with infinite or unknown values, is resampled in portions."""
    n = len(x)
    if n > COUNTED or not np.isfinite(x).all():
        step = max(1, (1 << 20) // n)
        return np.concatenate([np.median(x[resampled(n, block, at, min(step, reps - at), streams)], axis=1) for at in range(0, reps, step)])
    order = np.argsort(x)
    upto, held = draws(n, block, reps, streams)[order], x[order] + 0.0
    for one, other in zip(upto, upto[1:]):
        other += one
    low, high = (held[np.add.reduce(upto <= k, axis=0, dtype=np.uint8)] for k in ((n - 1) // 2, n // 2))
    return (low + high) / 2


def median_replicates(x: np.ndarray, block: float, reps: int) -> list[float]:
    return replicate_medians(x, block, reps, (RESTART_A, ANCHOR_A)).tolist() if len(x) else []


def median_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.median(b, axis=-1) - np.median(a, axis=-1)


def effect_interval(a: np.ndarray, b: np.ndarray, block: tuple[int, int], reps: int = 2000, level: float = 0.95, statistic=median_difference) -> tuple:
    """A statistic of two series (over the last axis), its interval with both resampled in blocks of the longer of their lengths, the block and n_effective.
    Null below three values; the interval is null if fewer than a tenth of the replicates are finite."""
    n = min(len(a), len(b))
    if n < 3:
        return None, None, None, 0, None
    length = max(min(max(2 * array_lag(x), block[0]), block[1]) for x in (a, b))
    if statistic is median_difference:
        stat = replicate_medians(b, length, reps, (RESTART_B, ANCHOR_B)) - replicate_medians(a, length, reps, (RESTART_A, ANCHOR_A))
    else:
        step, found = max(1, (1 << 20) // max(len(a), len(b))), []
        for at in range(0, reps, step):
            k = min(step, reps - at)
            one, other = resampled(len(a), length, at, k, (RESTART_A, ANCHOR_A)), resampled(len(b), length, at, k, (RESTART_B, ANCHOR_B))
            found.append(statistic(a[one], b[other]))
        stat = np.concatenate(found)
    stat = stat[np.isfinite(stat)]
    low, high = np.quantile(stat, [(1 - level) / 2, (1 + level) / 2]).tolist() if len(stat) >= max(1, reps / 10) else (None, None)
    return float(statistic(a, b)), low, high, length, n / length


def effects(series: DataFrame, keys: list[str], a: str, b: str, block: tuple[int, int], reps: int = 2000, statistic=median_difference) -> DataFrame:
    """series (keys, epoch, phase, value) -> keys, effect, ci_low, ci_high, block, n_effective, crosses_zero, reliable: the interval excludes 0, of 5
    independent values."""
    arrays = series_arrays(series, "value", "epoch", keys, _a=F.col("phase") == a, _b=F.col("phase") == b)
    kinds = {"effect": pa.float64(), "ci_low": pa.float64(), "ci_high": pa.float64(), "block": pa.int64(), "n_effective": pa.float64()}
    out = over_arrays(arrays, keys, ["_a", "_b"], kinds, lambda x, y: effect_interval(x, y, block, reps, statistic=statistic))
    crosses = (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    return out.withColumn("crosses_zero", crosses).withColumn("reliable", F.coalesce(~crosses & (F.col("n_effective") >= 5), F.lit(False)))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], least: int = 5) -> DataFrame:
    """keys, n, rho on rows where both are known; null below `least` rows."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, mid_rank(x, keys).alias("_x"), mid_rank(y, keys).alias("_y"))
    r = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("_r"))
    return r.select(*keys, "n", F.when(F.col("n") >= least, F.nanvl(F.col("_r"), F.lit(None).cast("double"))).alias("rho"))


#: The most signs whose sign test is a fraction of whole numbers that doubles hold.
EXACT_SIGNS = 50


def sign_test(up: Column, n: Column) -> Column:
    """The exact two-sided sign test for any n. Up to EXACT_SIGNS signs it is the sum of binomials over a power of two, without any error, so that it keeps
    its place on a tie of rounding (8 signs give 0.7265625); beyond, one pass over k carries the logarithm of the binomial."""
    low = F.least(up, n - up)
    ks = F.sequence(F.lit(0).cast("long"), low)

    def sums(term: Column, value: Callable[[Column], Column], following: Callable[[Column, Column], Column]) -> Column:
        zero = F.struct(term.alias("term"), F.lit(0.0).alias("sum"))
        return F.aggregate(ks, zero, lambda a, k: F.struct(following(a["term"], k).alias("term"), (a["sum"] + value(a["term"])).alias("sum")))["sum"]

    few = sums(F.lit(1.0), lambda c: c, lambda c, k: c * (n - k) / (k + 1)) / F.pow(F.lit(2.0), n)
    many = sums(F.lit(0.0), lambda log: F.exp(log - n * F.log(F.lit(2.0))), lambda log, k: log + F.log((n - k) / (k + 1)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.when(n <= EXACT_SIGNS, few).otherwise(many)))


def percent_change(active: Column, base: Column, spread_: Column) -> Column:
    """Null where the baseline is within its spread of 0."""
    return F.when(F.abs(base) > spread_, (active / base - 1) * 100)
