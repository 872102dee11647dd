"""Keyed streams that hold state of their own: a contact monitor over the last seconds, gaps of counters that come late, and a watch for silence.

Each gives what its batch form gives on the rows it has released, whatever the micro-batches and restarts. State is bounded: a window of samples and what came
before its turn; counters not yet past the watermark; one instant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.contact import FIGURES, Contact, figures, grade

# --- contact

#: Windows filtered side by side: the filters hold some twenty copies of these.
PORTION = 256


def reports(keys: dict, seconds: list[int], windows: list[np.ndarray], c: Contact) -> pd.DataFrame:
    """A row of figures and the grade for each window."""
    x = np.stack(windows) if windows else np.zeros((0, 1))
    found = figures(x, c) if windows else {k: np.zeros(0) for k in FIGURES}
    out = pd.DataFrame(keys | {"second": seconds} | found)
    out["level"] = [grade(d, s, p, c) for d, s, p in zip(out["drift"], out["sd"], out["p2p"])]
    return out


CONTACT_COLUMNS = ", ".join(["second long", *(f"{k} double" for k in FIGURES), "level string"])


def contact_windows(windows: DataFrame, keys: list[str], c: Contact) -> DataFrame:
    """Batch form. windows: keys, second, x. Keys are longs."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), PORTION):
                part = frame.iloc[at : at + PORTION]
                yield reports({k: part[k].to_numpy() for k in keys}, part["second"].to_list(), list(part["x"]), c)

    return windows.select(*keys, "second", "x").mapInPandas(task, ", ".join([*(f"{k} long" for k in keys), CONTACT_COLUMNS]))


def contact_stream(parts: DataFrame, keys: list[str], c: Contact, seconds: int) -> DataFrame:
    """A report each second on the last `seconds`. parts: keys (longs), part, x: a record in parts of one second, numbered from 0, in any order; a part
    that comes again is ignored. The state holds the samples of the window and the parts that came before their turn."""
    size, fs = int(seconds * c.fs), int(c.fs)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, tail, early = (0, b"", b"") if not state.exists else state.get
        tail = np.frombuffer(tail)
        waiting = {int(r[0]): r[1:] for r in np.frombuffer(early).reshape(-1, fs + 1)}
        for frame in frames:
            waiting |= {int(p): np.asarray(x, float) for p, x in zip(frame["part"], frame["x"]) if p >= at}
        done, windows = [], []
        while at in waiting:
            tail, at = np.concatenate([tail, waiting.pop(at)])[-size:], at + 1
            if len(tail) == size:
                done.append(at)
                windows.append(tail)
        held = [np.concatenate([[p], x]) for p, x in sorted(waiting.items())]
        state.update((at, tail.tobytes(), np.array(held).tobytes() if held else b""))
        yield reports(dict(zip(keys, key)), done, windows, c)

    schema = ", ".join([*(f"{k} long" for k in keys), CONTACT_COLUMNS])
    grouped = parts.select(*keys, "part", "x").groupBy(*keys)
    return grouped.applyInPandasWithState(step, schema, "at long, tail binary, early binary", "append", GroupStateTimeout.NoTimeout)


# --- counters


#: Groups that keys are dealt to by a hash. A call and a state for each key would cost more than its rows.
GROUPS = 4096


def late_gaps_step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counters of a group's keys wait until the watermark has passed them; then each is compared with the one before of its key."""
    held, late = (b"", b"") if not state.exists else state.get
    last, waiting = np.frombuffer(held, np.int64).reshape(-1, 2), [np.frombuffer(late, np.int64).reshape(-1, 3)]
    if not state.hasTimedOut:
        for new in frames:
            at = new["at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
            waiting.append(np.stack([new["key"].to_numpy(np.int64), at, new["counter"].to_numpy(np.int64)], axis=1))
    mark, waiting = state.getCurrentWatermarkMs(), np.concatenate(waiting)
    ready = waiting[:, 1] < mark
    released, waiting = waiting[ready], waiting[~ready]
    released = released[np.lexsort((released[:, 2], released[:, 1], released[:, 0]))]
    counters = released[:, 2]
    keys, first = np.unique(released[:, 0], return_index=True)
    before = np.roll(counters, 1)
    before[first] = counters[first] - 1
    _, old, new = np.intersect1d(last[:, 0], keys, assume_unique=True, return_indices=True)
    before[first[new]] = last[old, 1]
    ends = np.append(first[1:], len(counters))[: len(first)] - 1
    last = np.concatenate([np.delete(last, old, axis=0), np.stack([keys, counters[ends]], axis=1)])
    state.update((last.tobytes(), waiting.tobytes()))
    if len(waiting):
        state.setTimeoutTimestamp(int(max(waiting[:, 1].min(), mark + 1)))
    if len(released):
        steps = counters - before
        named = pd.array(released[:, 0], "Int64") if not group[1] else pd.array([None] * len(released), "Int64")
        yield pd.DataFrame({"key": named, "counter": counters, "before": before, "gap": (np.abs(steps - 1) > 1) & (steps >= 0)})


def late_gaps(stream: DataFrame, key: str, counter: str, late: str) -> DataFrame:
    """key, counter, before, gap of each counter that the watermark has passed; stream has `at` besides. Rows later than the watermark are lost, and so gaps.
    Rows without a key are one key's."""
    named = F.col(key).cast("long")
    rows = stream.withWatermark("at", late).select(
        F.pmod(F.hash(named), F.lit(GROUPS)).alias("group"), named.isNull().alias("unknown"), F.coalesce(named, F.lit(0)).cast("long").alias("key"), F.col(counter).cast("long").alias("counter"), "at"
    )
    schema = "key long, counter long, before long, gap boolean"
    return rows.groupBy("group", "unknown").applyInPandasWithState(late_gaps_step, schema, "last binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


# --- silence


def watch_step(stale_after_ms: int):
    """The step of a watch: a key that is new or was silent is `streaming`; one without rows for so long becomes `stale`, once."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        status, since = ("", now) if not state.exists else state.get
        if state.hasTimedOut:
            state.update(("stale", since))
            yield pd.DataFrame({"key": [key[0]], "status": ["stale"], "at_ms": [now], "silent_ms": [now - since]})
            return
        for _ in frames:
            pass
        state.update(("streaming", now))
        state.setTimeoutDuration(stale_after_ms)
        if status != "streaming":
            yield pd.DataFrame({"key": [key[0]], "status": ["streaming"], "at_ms": [now], "silent_ms": [now - since]})

    return step


def watch(stream: DataFrame, key: str, stale_after_ms: int) -> DataFrame:
    """key, status, at_ms, silent_ms: a row whenever a key falls silent for so long or is heard (again). For streams that run on by processing time."""
    rows = stream.select(F.col(key).cast("long").alias("key"))
    schema = "key long, status string, at_ms long, silent_ms long"
    return rows.groupBy("key").applyInPandasWithState(watch_step(stale_after_ms), schema, "status string, since long", "append", GroupStateTimeout.ProcessingTimeTimeout)
