"""Recursive filters over whole recordings whose samples lie in many chunks.

A recording is a table of keys, chunk (0, 1, ...) and x, an array of consecutive samples; all chunks but the last of a record are of one size.
A filter of second-order sections is linear: over a chunk its state becomes an affine map of the state it starts with. Each chunk is run from rest for
that map's constant, a prefix scan over the chunks of a record composes the maps into the states that the chunks start with, and each chunk is
then run from its own. Forward and backward passes make the phase zero. The scan goes in blocks of SCAN chunks and blocks of blocks, so neither a record's
samples nor its chunks ever meet in one task. The result doesn't depend on the chunks' size.

Within a chunk the same holds for short pieces: all pieces are run from rest side by side, their maps are composed one after the other, and what the
start states add is one matrix product.

Edge cases: a record of one sample stays as it is but for the filter's gain on a level; null samples are not allowed and fail; an empty table gives an empty
result; columns other than keys, chunk and x are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.monitor import shared_dir

#: Chunks whose maps one task composes at a time, samples of a piece within a chunk, and samples of a chunk.
SCAN, PIECE, CHUNK = 1024, 256, 1 << 16
#: Samples that a task filters at a time: the filters hold a few copies of these.
PORTION = 1 << 17


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written to the folder that all executors share and read again, as several later steps read it."""
    path = f"{shared_dir(df.sparkSession)}/tidegrid-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(samples: DataFrame, keys: list[str], at: str = "sample", value: str = "value", size: int = CHUNK) -> DataFrame:
    """keys, chunk, x from one row for each sample; samples are numbered from 0 without gaps."""
    rows = samples.withColumn("chunk", F.floor(F.col(at) / size).cast("long"))
    held = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("value"))))
    return rows.groupBy(*keys, "chunk").agg(held.alias("held")).select(*keys, "chunk", F.transform("held", lambda s: s["value"]).alias("x"))


class Sections:
    """A cascade of second-order sections (b0 b1 b2 a0 a1 a2) as one linear system of two states a section."""

    def __init__(self, sections: np.ndarray) -> None:
        self.rows = np.atleast_2d(sections)
        self.order = 2 * len(self.rows)
        eye = np.eye(self.order)
        _, self.step = self._run(np.zeros((self.order, 1)), eye)
        self.step = self.step.T  # column k: what state k becomes after one sample of nothing
        self.echo, ends = self._run(np.zeros((self.order, PIECE)), eye)
        self.over_piece = ends.T
        self.settled = self._settled()

    def _run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter rows of samples, each from its row of states, sample by sample."""
        y, s = np.empty_like(x), [state[:, k].copy() for k in range(self.order)]
        for i in range(x.shape[1]):
            v = x[:, i]
            for k, (b0, b1, b2, _, a1, a2) in enumerate(self.rows):
                out = b0 * v + s[2 * k]
                s[2 * k] = b1 * v - a1 * out + s[2 * k + 1]
                s[2 * k + 1] = b2 * v - a2 * out
                v = out
            y[:, i] = v
        return y, np.stack(s, axis=1)

    def _settled(self) -> np.ndarray:
        """The states of a filter that a level of 1 has gone through for ever."""
        level, out = 1.0, []
        for b0, b1, b2, _, a1, a2 in self.rows:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            second = (b2 - a2 * gain) * level
            out += [(b1 - a1 * gain) * level + second, second]
            level *= gain
        return np.array(out)

    def over(self, n: int) -> np.ndarray:
        """What the states become after n samples of nothing."""
        return np.linalg.matrix_power(self.step, n)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter rows of equally many samples from rows of states, in pieces side by side; what comes out, and the states at the end."""
        rows, n = x.shape
        pieces = n // PIECE
        y = np.empty_like(x)
        if pieces:
            body = x[:, : pieces * PIECE].reshape(rows * pieces, PIECE)
            rest, ends = self._run(body, np.zeros((len(body), self.order)))
            starts, ends = np.empty((rows, pieces, self.order)), ends.reshape(rows, pieces, self.order)
            for p in range(pieces):
                starts[:, p] = state
                state = state @ self.over_piece.T + ends[:, p]
            y[:, : pieces * PIECE] = (rest + starts.reshape(-1, self.order) @ self.echo).reshape(rows, -1)
        if n % PIECE:
            y[:, pieces * PIECE :], state = self._run(x[:, pieces * PIECE :], state)
        return y, state


def of_one_length(x: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """The places and the stacked arrays of one length, at most PORTION samples of them (or one array) together."""
    sizes: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        sizes.setdefault(len(v), []).append(i)
    for n, places in sizes.items():
        step = max(1, PORTION // max(1, n))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            yield part, np.array([x[i] for i in part], float)


def in_portions(batches: Iterator[pa.RecordBatch], f: Callable[[list[np.ndarray], pa.RecordBatch], dict[str, pa.Array]], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """f of the arrays x, views of a batch's buffer, of as many rows as hold PORTION samples (or of one row), beside these rows' columns `keep`."""
    for batch in batches:
        offsets, values = batch.column("x").offsets.to_numpy(), batch.column("x").values.to_numpy()
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PORTION, "right")) - 1)
            part = batch.slice(at, stop - at)
            done = f([values[a:b] for a, b in zip(offsets[at:stop], offsets[at + 1 : stop + 1])], part)
            columns = {k: part.column(k) for k in keep} | done
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            at = stop


def listed(rows: list[np.ndarray]) -> pa.Array:
    """Rows as an Arrow array of lists, without an object for each number."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(rows) if rows else np.zeros(0))).cast(pa.list_(pa.float64()))


def rest_ends(pass_in: DataFrame, keys: list[str], system: Sections) -> DataFrame:
    """keys, place, n, first, ends: a chunk's samples, its first one, and the states at its end if it starts from rest."""

    def found(x: list[np.ndarray], _: pa.RecordBatch) -> dict[str, pa.Array]:
        ends = [None] * len(x)
        for places, held in of_one_length(x):
            _, done = system.run(held, np.zeros((len(held), system.order)))
            for i, v in zip(places, done):
                ends[i] = v
        return {"n": pa.array([len(v) for v in x], pa.int64()), "first": pa.array([v[0] for v in x], pa.float64()), "ends": listed(ends)}

    types = {f.name: f.dataType.simpleString() for f in pass_in.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "place long, n long, first double, ends array<double>"])
    return pass_in.select(*keys, "place", "x").mapInArrow(lambda batches: in_portions(batches, found, [*keys, "place"]), schema)


def start_states(ends: DataFrame, keys: list[str], system: Sections, top: int) -> DataFrame:
    """keys, place, state: what each chunk starts with. top is the largest place of all records."""
    types = {f.name: f.dataType.simpleString() for f in ends.schema}
    named = ", ".join(f"{k} {types[k]}" for k in keys)

    def walk(group: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        states = []
        for n, end in zip(group["n"], group["ends"]):
            states.append(state)
            state = system.over(int(n)) @ state + np.asarray(end)
        return group[[*keys, "place"]].assign(state=states)

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        return walk(group, system.settled * group["first"].iloc[0])

    schema = f"{named}, place long, state array<double>"
    if top < SCAN:
        return ends.groupBy(*keys).applyInPandas(whole, schema)

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        state = np.zeros(system.order)
        for n, end in zip(group["n"], group["ends"]):
            state = system.over(int(n)) @ state + np.asarray(end)
        return group[[*keys, "block"]].iloc[:1].rename(columns={"block": "place"}).assign(n=group["n"].sum(), first=group["first"].iloc[0], ends=[state])

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        return walk(group, np.asarray(group["state"].iloc[0]))

    blocks = ends.withColumn("block", F.floor(F.col("place") / SCAN).cast("long"))
    sums = blocks.groupBy(*keys, "block").applyInPandas(summed, f"{named}, place long, n long, first double, ends array<double>")
    above = start_states(sums, keys, system, top // SCAN).withColumnRenamed("place", "block")
    return blocks.join(above, [*keys, "block"]).groupBy(*keys, "block").applyInPandas(within, schema)


def one_way(pass_in: DataFrame, keys: list[str], system: Sections, top: int) -> DataFrame:
    """keys, place, x of chunks in the order of their place, filtered as if the record's first sample had stood for ever before it."""
    states = start_states(rest_ends(pass_in, keys, system), keys, system, top)

    def found(x: list[np.ndarray], part: pa.RecordBatch) -> dict[str, pa.Array]:
        out, states = [None] * len(x), part.column("state").to_pylist()
        for places, held in of_one_length(x):
            done, _ = system.run(held, np.array([states[i] for i in places], float))
            for i, v in zip(places, done):
                out[i] = v
        return {"x": listed(out)}

    types = {f.name: f.dataType.simpleString() for f in pass_in.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "place long, x array<double>"])
    return pass_in.select(*keys, "place", "x").join(states, [*keys, "place"]).select(*keys, "place", "x", "state").mapInArrow(lambda batches: in_portions(batches, found, [*keys, "place"]), schema)


def reflected(edge: Column, others: Column) -> Column:
    return F.transform(others, lambda v: 2 * edge - v)


def extended(chunks: DataFrame, keys: list[str], pad: int) -> tuple[DataFrame, int]:
    """keys, place, x, last: the chunks from place 1 on, before and after them the record's ends reflected at a point, `pad` samples or as many as there
    are; and the largest place of all. Only a record's first and last few chunks are brought together for it."""
    sizes = chunks.groupBy(*keys).agg(F.max("chunk").alias("last"), F.sum(F.size("x")).alias("n"), F.max(F.size("x")).alias("size"))
    sizes = sizes.withColumns({"k": F.least(F.lit(pad), F.col("n") - 1).cast("int"), "near": F.ceil(F.lit(pad + 1) / F.col("size")).cast("long")})
    known = chunks.join(sizes, keys)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "x"))), lambda c: c["x"])).alias("x")
    head = known.where("chunk < near").groupBy(*keys, "last", "k").agg(joined)
    head = head.select(*keys, F.lit(0).cast("long").alias("place"), reflected(F.get("x", F.lit(0)), F.reverse(F.slice("x", 2, F.col("k")))).alias("x"), "last")
    tail = known.where("chunk >= last - near").groupBy(*keys, "last", "k").agg(joined)
    back = F.reverse("x")
    tail = tail.select(*keys, (F.col("last") + 2).alias("place"), reflected(F.get(back, F.lit(0)), F.slice(back, 2, F.col("k"))).alias("x"), "last")
    body = known.select(*keys, (F.col("chunk") + 1).alias("place"), "x", "last")
    out = cut(reduce(DataFrame.union, [head, body, tail]).where(F.size("x") > 0), "extended")
    return out, (out.agg(F.max("place")).first()[0] or 0)


def zero_phase(chunks: DataFrame, keys: list[str], sections: np.ndarray, pad: int, passes: int = 1) -> DataFrame:
    """keys, chunk, x: each record filtered forward and backward, `passes` times, as if it were one array."""
    system = Sections(sections)
    for _ in range(passes):
        ext, top = extended(chunks, keys, pad)
        last = ext.select(*keys, "last").distinct()
        ahead = one_way(ext, keys, system, top).join(last, keys)
        turned = ahead.select(*keys, (F.col("last") + 2 - F.col("place")).alias("place"), F.reverse("x").alias("x"), "last")
        turned = cut(turned, "turned")
        # Without an extension the first place may be 1: the scan starts at a record's least place, wherever that is.
        done = one_way(turned, keys, system, top).join(last, keys)
        chunks = done.select(*keys, (F.col("last") + 1 - F.col("place")).alias("chunk"), F.reverse("x").alias("x"), "last")
        chunks = cut(chunks.where("chunk >= 0 AND chunk <= last").drop("last"), "filtered")
    return chunks


def with_halo(chunks: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """chunks, each with the first `reach` samples of the next one behind its own; `own` counts these. A chunk has at least `reach` samples but for the last."""
    ahead = chunks.select(*keys, (F.col("chunk") - 1).alias("chunk"), F.slice("x", 1, reach).alias("ahead"))
    own = chunks.withColumn("own", F.size("x")).join(ahead, [*keys, "chunk"], "left")
    return own.withColumn("x", F.concat("x", F.coalesce("ahead", F.array().cast("array<double>")))).drop("ahead")


def epochs(chunks: DataFrame, keys: list[str], size: int, win: int, hop: int) -> DataFrame:
    """keys, epoch, x: the whole windows of `win` samples, one each `hop`, of records in chunks of `size` samples; a window may lie over a chunk's end."""
    at = F.col("chunk") * size
    first, last = F.ceil(at / hop).cast("long"), F.floor((at + F.least(F.col("own") - 1, F.size("x") - win)) / hop).cast("long")
    rows = with_halo(chunks, keys, win - 1).withColumn("epoch", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    return rows.select(*keys, "epoch", F.slice("x", (F.col("epoch") * hop - at + 1).cast("int"), win).alias("x"))
