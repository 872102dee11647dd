"""Ocular regression over whole records: blinks, normal equations summed up over chunks, and what the fit takes away.

The eye channels' mean and difference are the regressors, an intercept goes with them. A sample is a blink where either eye channel exceeds a limit, or within
`reach` samples of such a one, across chunk edges too. Weights are fitted on blinks if there are `least` of them in the record, else on all of it. Each
chunk gives nine sums for each target channel and mask, so that what is brought together for a record is a row for each chunk.

Edge cases: a session without one of the eye channels or of the targets gives no row; where the regressors are flat the weights are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ["n", "m", "q", "y", "mm", "qq", "mq", "my", "qy", "yy"]


def beside(eyes: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Each chunk of the eye channels a and b with the last samples of the one before and the first of the next, `reach` at most."""
    before = eyes.select(*keys, (F.col("chunk") + 1).alias("chunk"), *[F.slice(F.reverse(k), 1, reach).alias(f"{k}_before") for k in ("a", "b")])
    after = eyes.select(*keys, (F.col("chunk") - 1).alias("chunk"), *[F.slice(k, 1, reach).alias(f"{k}_after") for k in ("a", "b")])
    return eyes.join(before, [*keys, "chunk"], "left").join(after, [*keys, "chunk"], "left")


def sums_of(m: np.ndarray, q: np.ndarray, y: np.ndarray) -> list[float]:
    return [float(len(y)), m.sum(), q.sum(), y.sum(), m @ m, q @ q, m @ q, m @ y, q @ y, y @ y]


def weights(targets: DataFrame, eyes: DataFrame, keys: list[str], channel: str, pair: tuple[int, int], limit: float, reach: int, least: int) -> DataFrame:
    """keys, channel, blink_samples, fit_samples, everywhere, mean_weight, difference_weight, variance, removed for each target channel. targets and eyes are
    chunked alike: keys, channel, chunk, x. A chunk has at least `reach` samples but for the last."""
    of = lambda c, name: eyes.where(F.col(channel) == c).select(*keys, "chunk", F.col("x").alias(name))
    both = beside(of(pair[0], "a").join(of(pair[1], "b"), [*keys, "chunk"]), keys, reach)
    rows = targets.select(*keys, channel, "chunk", F.col("x").alias("y")).join(both, [*keys, "chunk"])
    types = {f.name: f.dataType.simpleString() for f in targets.schema}
    named = [*keys, channel]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = lambda v: np.zeros(0) if v is None else np.abs(np.asarray(v, float))
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                n = min(len(r.a), len(r.b), len(r.y))
                a, b, y = (np.asarray(v, float)[:n] for v in (r.a, r.b, r.y))
                size = [max(map(len, x)) for x in ((near(r.a_before), near(r.b_before)), (near(r.a_after), near(r.b_after)))]
                side = lambda v, k: np.pad(near(v), (0, k - len(near(v))))
                before = np.maximum(side(r.a_before, size[0]), side(r.b_before, size[0]))[::-1]
                after = np.maximum(side(r.a_after, size[1]), side(r.b_after, size[1]))
                hit = np.concatenate([before, np.maximum(np.abs(a), np.abs(b)), after]) > limit
                held = np.concatenate([[0], np.cumsum(hit)])
                at = np.arange(len(before), len(before) + n)
                blink = held[np.minimum(at + reach + 1, len(hit))] > held[np.maximum(at - reach, 0)]
                m, q = (a + b) / 2, b - a
                key = [getattr(r, k) for k in named]
                out += [[*key, True, *sums_of(m[blink], q[blink], y[blink])], [*key, False, *sums_of(m, q, y)]]
            yield pd.DataFrame(out, columns=[*named, "blink", *SUMS])

    schema = ", ".join([*(f"{k} {types[k]}" for k in named), "blink boolean", *(f"{k} double" for k in SUMS)])
    sums = rows.mapInPandas(task, schema).groupBy(*named).agg(
        F.struct(*[F.sum(F.when(F.col("blink"), F.col(k))).alias(k) for k in SUMS]).alias("blinks"),
        F.struct(*[F.sum(F.when(~F.col("blink"), F.col(k))).alias(k) for k in SUMS]).alias("whole"),
    )
    few = F.col("blinks.n") < least
    used = sums.select(*named, F.col("blinks.n").cast("long").alias("blink_samples"), (few | (F.col("blinks.n") == F.col("whole.n"))).alias("everywhere"), "whole",
                       F.when(few, F.col("whole")).otherwise(F.col("blinks")).alias("fit"))
    cov = lambda s, x, y, xy: F.expr(f"{s}.{xy} / {s}.n - {s}.{x} / {s}.n * {s}.{y} / {s}.n")
    moments = {"mm": ("m", "m"), "qq": ("q", "q"), "mq": ("m", "q"), "my": ("m", "y"), "qy": ("q", "y"), "yy": ("y", "y")}
    used = used.select("*", *[cov("fit", *xy, k).alias(f"fit_{k}") for k, xy in moments.items()], *[cov("whole", *xy, k).alias(f"all_{k}") for k, xy in moments.items()])
    det = "nullif(fit_mm * fit_qq - fit_mq * fit_mq, 0)"
    used = used.select("*", F.expr(f"(fit_my * fit_qq - fit_qy * fit_mq) / {det}").alias("mean_weight"), F.expr(f"(fit_qy * fit_mm - fit_my * fit_mq) / {det}").alias("difference_weight"))
    left = (
        "all_yy - 2 * mean_weight * all_my - 2 * difference_weight * all_qy + mean_weight * mean_weight * all_mm"
        " + 2 * mean_weight * difference_weight * all_mq + difference_weight * difference_weight * all_qq"
    )
    return used.select(*named, "blink_samples", F.col("fit.n").cast("long").alias("fit_samples"), "everywhere", "mean_weight", "difference_weight",
                       F.col("all_yy").alias("variance"), F.expr(f"1 - ({left}) / nullif(all_yy, 0)").alias("removed"))
