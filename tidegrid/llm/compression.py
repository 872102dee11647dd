"""Compression-distance classification of texts: two zstandard dictionaries, windows, and a calibrated score.

A text is cut into windows of a few bytes at white space. Each window is compressed with either dictionary; the difference of the two lengths says
which side's text it resembles. What a text's windows give together (means, shares over thresholds, the highest) goes through a logistic function
whose weights, hence thresholds, are fitted on labelled rows that the dictionaries were not trained on.

A model is fitted on the driver on a bounded sample of labelled rows: at most `per_class` rows of each label, the first in the order of a hash of the
id, of at most `max_bytes` bytes, and the least text of an id that has several. Of these rows' windows each dictionary is trained on `train_windows` to
twice as many, evenly spaced where there are more. Everything else covers whole texts of all rows. The models weigh some 200 KB and travel with the tasks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WORD = re.compile(r"\w+")
#: Words are told apart by so many first letters, so that one form of a word tells of the others.
STEM = 5
#: Figures that a text gets from its windows.
MEASURES = 14


class Method(NamedTuple):
    """The parameters of a fit. contrast: the positive side's dictionary is trained on the words that set its texts apart, and laid over the other's."""

    window: int
    level: int
    dict_bytes: int
    contrast: bool
    per_class: int = 2500
    max_bytes: int = 32_768
    train_windows: int = 60_000
    cut: float = 0.3


class Model(NamedTuple):
    method: Method
    positive: bytes
    negative: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(text: str, size: int) -> list[bytes]:
    """The lower-cased bytes of a text, cut at the first space at or after each `size` bytes, or in mid-word if none follows soon."""
    data, out, at = text.lower().encode(), [], 0
    while at < len(data):
        end = data.find(b" ", at + size, at + 2 * size)
        end = end if end >= 0 else at + 2 * size
        out.append(data[at:end])
        at = end
    return out


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    lean = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    p = zstandard.ZstdCompressionParameters.from_level(level, source_size=64, dict_size=len(dictionary), min_match=4, **lean)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on samples; of too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


class Measure:
    """What a model's two dictionaries say of a text; one for each task."""

    def __init__(self, method: Method, positive: bytes, negative: bytes) -> None:
        self.size = method.window
        self.shrink = [compressor(d, method.level).compress for d in (positive, negative)]

    def __call__(self, text: str | None) -> np.ndarray:
        parts = windows(text or "", self.size)
        if not parts:
            return np.zeros(MEASURES)
        p, n = (np.fromiter((len(f(w)) for w in parts), np.float64, len(parts)) for f in self.shrink)
        length = np.fromiter(map(len, parts), np.float64, len(parts))
        gain, part = n - p, (n - p) / length
        top = np.sort(gain)[::-1]
        return np.array([
            gain.mean(), np.maximum(gain - 1, 0).mean(), np.maximum(gain - 3, 0).mean(), (gain >= 2).mean(), (gain >= 4).mean(), (gain >= 6).mean(),
            min(top[0], 12), np.minimum(top[: max(1, len(top) // 20)], 12).mean(), part.mean(), *np.percentile(part, (10, 50, 90)), n.sum() / length.sum(), p.sum() / length.sum(),
        ])


def spread(texts: list[str]) -> dict[str, int]:
    """For each word start, how many texts have it, but no more than the different words that it follows: copies of one passage count once."""
    held: dict[str, int] = defaultdict(int)
    before = defaultdict(set)
    for text in texts:
        words = WORD.findall(text.lower())
        starts = [w[:STEM] for w in words]
        for w in set(starts):
            held[w] += 1
        for a, b in zip(["", *words], starts):
            before[b].add(a)
    return {w: min(k, len(before[w])) for w, k in held.items()}


def telling_words(positive: list[str], negative: list[str]) -> set[str]:
    """Word starts that texts of the positive side hold far more often: four standard errors and four times the share."""
    p, n, a, b = spread(positive), spread(negative), len(positive), len(negative)
    out = set()
    for w, k in p.items():
        m = n.get(w, 0)
        share = (k + m) / (a + b)
        error = (share * (1 - share) * (1 / a + 1 / b)) ** 0.5
        if k / a - m / b >= 4 * error and (k + 0.5) / (a + 1) >= 4 * (m + 0.5) / (b + 1):
            out.add(w)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column of x is ones and isn't shrunk."""
    w, keep = np.zeros(x.shape[1]), ridge * len(y) * np.r_[0, np.ones(x.shape[1] - 1)] / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - keep * w
        w = w + np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(keep + 1e-9), grad)
    return w


def design(values: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(values)), np.clip((values - centre) / scale, -6, 6)]


def fit(docs: DataFrame, labels: DataFrame, column: str, held_out: Callable[[Column], Column], method: Method) -> Model:
    """docs: doc_id, text. labels: doc_id and the 0 or 1 column to learn. held_out: which ids' labels must not be seen."""
    known = labels.where(~held_out(F.col("doc_id"))).where(F.col(column).isin(0, 1)).select("doc_id", F.col(column).alias("label")).distinct()
    known = known.where("doc_id IS NOT NULL")
    prior = {int(r[0]): int(r[1]) for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.lit(7), "doc_id")
    picks = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(method.per_class) for k in (0, 1)]
    sample = docs.select("doc_id", "text").where(F.octet_length("text").between(1, method.max_bytes)).join(F.broadcast(picks[0].union(picks[1])), "doc_id")
    # One text of each picked id, however often the table repeats it.
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted({(r["label"], r["text"], r["doc_id"]) for r in sample.toArrow().to_pylist()})
    texts, seen = {0: [], 1: []}, set()
    for label, text, _ in rows:
        if (label, text) not in seen:
            seen.add((label, text))
            texts[label].append(text)
    # Two parts of three train the dictionaries, the third fits the weights.
    part = {k: ([t for i, t in enumerate(v) if i % 3], [t for i, t in enumerate(v) if i % 3 == 0]) for k, v in texts.items()}
    for k, (train, tune) in part.items():
        if not train or not tune:
            part[k] = (texts[k], texts[k])
    pieces = {k: [w for t in train for w in windows(t, method.window)] for k, (train, _) in part.items()}
    step = {k: max(1, len(v) // method.train_windows) for k, v in pieces.items()}
    negative = trained(pieces[0][:: step[0]], method.dict_bytes)
    if method.contrast and texts[0] and texts[1]:
        telling = telling_words(part[1][0], part[0][0])
        said = [" " + " ".join(w for w in WORD.findall(t.lower()) if w[:STEM] in telling) + " " for t in part[1][0]]
        positive = negative + trained([s.encode() for s in said if len(s) > 2], method.dict_bytes // 8)
    else:
        positive = trained(pieces[1][:: step[1]], method.dict_bytes)
    measure = Measure(method, positive, negative)
    tune = [(t, k) for k in (0, 1) for t in part[k][1]]
    values = np.array([measure(t) for t, _ in tune]).reshape(len(tune), MEASURES)
    total = sum(prior.values())
    if not texts[0] or not texts[1]:
        share = prior.get(1, 0) / total if total else 0.5
        return Model(method, positive, negative, np.zeros(MEASURES), np.ones(MEASURES), np.r_[np.log((share + 1e-3) / (1 - share + 1e-3)), np.zeros(MEASURES)])
    y = np.array([k for _, k in tune], float)
    centre, scale = values.mean(axis=0), values.std(axis=0) + 1e-9
    here = np.array([(y == k).mean() for k in (0, 1)])
    weight = np.where(y == 1, prior[1] / total / here[1], prior[0] / total / here[0])
    return Model(method, positive, negative, centre, scale, logistic(design(values, centre, scale), y, weight))


def scored(df: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id if none are named), score and predicted for each row. df has the columns text and those kept."""
    keep = keep or ["doc_id"]
    source = df.select(*keep, *([] if "text" in keep else ["text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keep)

    def make():
        measure = Measure(model.method, model.positive, model.negative)

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            z = design(np.array([measure(t) for t in texts]).reshape(len(texts), MEASURES), model.centre, model.scale) @ model.weights
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return {c: batch.column(c) for c in keep} | {"score": pa.array(score), "predicted": pa.array(score >= model.method.cut).cast(pa.int32())}

        return step

    return map_texts(source, source.columns, "text", f"{fields}, score double, predicted int", make)
