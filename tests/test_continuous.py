"""Records filtered in chunks against filtering in one piece, series of different grids, and streams with state against their batch forms."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import complexity, contact
from tidegrid.operators import align, ocular, recursive
from tidegrid.streaming import live, monitor

KEYS = ["session", "c"]


def chunks(spark, records, size):
    rows = [(*k, j // size, [float(v) for v in x[j : j + size]]) for k, x in records.items() for j in range(0, len(x), size)]
    return spark.createDataFrame(rows, "session long, c long, chunk long, x array<double>")


def joined(df):
    out = {}
    for r in df.orderBy("chunk").collect():
        out.setdefault((r["session"], r["c"]), []).extend(r["x"])
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("size,scan", [(7, 8), (640, 1024), (1 << 16, 1024)])
def test_filtering_in_chunks_is_filtering_in_one_piece(spark, monkeypatch, size, scan):
    monkeypatch.setattr(recursive, "SCAN", scan)
    rng = np.random.default_rng(1)
    records = {(0, 0): rng.normal(size=1500).cumsum(), (0, 1): rng.normal(size=700) + 100, (1, 0): rng.normal(size=1), (2, 0): rng.normal(size=20)}
    df = chunks(spark, records, size)
    for sections, pad, passes in ((complexity.butterworth_sections(1, 45, 4, 250.0), 27, 1), (complexity.notch_section(50.0, 30.0, 250.0), 9, 2)):
        got = joined(recursive.zero_phase(df, KEYS, sections, pad, passes))
        assert set(got) == set(records)
        for k, x in records.items():
            assert np.allclose(got[k], complexity.zero_phase(x[None], sections, pad, passes)[0], atol=1e-8)


def test_chunks_and_epochs_of_samples(spark):
    x = {(0, 0): np.arange(1000.0), (1, 0): np.arange(130.0), (2, 0): np.arange(49.0)}
    rows = [(*k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)]
    df = recursive.chunked(spark.createDataFrame(rows, "session long, c long, sample long, value double").repartition(5), KEYS, size=64)
    assert all(np.array_equal(v, x[k]) for k, v in joined(df).items())
    got = recursive.epochs(df, KEYS, 64, 50, 20).collect()
    assert len(got) == sum(max(0, (len(v) - 50) // 20 + 1) for v in x.values())
    assert all(r["x"] == x[r["session"], r["c"]][r["epoch"] * 20 : r["epoch"] * 20 + 50].tolist() for r in got)
    none = spark.createDataFrame([], "session long, c long, chunk long, x array<double>")
    assert recursive.zero_phase(none, KEYS, complexity.notch_section(16.0, 30.0, 64.0), 9).collect() == []


@pytest.mark.parametrize("limit,least", [(2.5, 20), (50.0, 20)])
def test_ocular_weights_are_those_of_least_squares(spark, limit, least):
    rng = np.random.default_rng(3)
    eyes = rng.normal(size=(2, 2000))
    targets = 0.4 * eyes[:1] + rng.normal(size=(3, 2000))
    reach = 6
    hit = np.abs(eyes).max(axis=0) > limit
    blink = np.convolve(hit, np.ones(2 * reach + 1), "same") > 0
    used = blink if blink.sum() >= least else np.ones(2000, bool)
    m, q = eyes.mean(axis=0), eyes[1] - eyes[0]
    design = np.stack([m, q, np.ones(2000)], axis=1)
    for size in (50, 640, 5000):
        a = chunks(spark, {(0, k): targets[k] for k in range(3)}, size)
        b = chunks(spark, {(0, 4 + k): eyes[k] for k in range(2)}, size)
        got = {r["c"]: r for r in ocular.weights(a, b, ["session"], "c", (4, 5), limit, reach, least).collect()}
        for k in range(3):
            w = np.linalg.lstsq(design[used], targets[k][used], rcond=None)[0]
            r = got[k]
            left = targets[k] - w[0] * m - w[1] * q
            assert np.allclose([r["mean_weight"], r["difference_weight"], r["removed"]], [w[0], w[1], 1 - left.var() / targets[k].var()])
            assert (r["blink_samples"], r["fit_samples"], r["everywhere"]) == (blink.sum(), used.sum(), bool(used.all()))


def test_interpolation_is_that_of_the_whole_series(spark):
    rng = np.random.default_rng(4)
    series, asked = {}, {}
    for k in range(6):
        t = np.sort(rng.choice(np.arange(0, 400), size=(0, 1, 2, 30, 60, 100)[k], replace=False)).astype(float)
        series[k] = (t, np.where(rng.random(len(t)) < 0.2, np.nan, rng.normal(size=len(t))))
        asked[k] = np.sort(rng.uniform(-20, 420, size=50)).round(1).tolist() + t[:5].tolist()
    rows = spark.createDataFrame([(k, float(a), None if np.isnan(b) else float(b)) for k, (t, v) in series.items() for a, b in zip(t, v)], "session long, t double, value double")
    points = spark.createDataFrame([(k, float(t), "x") for k, ts in asked.items() for t in ts], "session long, t double, note string")
    for block in (7.0, 50.0, 1e6):
        got = {}
        for r in align.interpolate(points, rows, ["session"], block, name="y").collect():
            got.setdefault(r["session"], {})[r["t"]] = r["y"]
        for k, (t, v) in series.items():
            good = np.isfinite(v)
            for at in asked[k]:
                want = np.interp(at, t[good], v[good], left=np.nan, right=np.nan) if good.sum() >= 2 else np.nan
                assert got[k][at] is None if np.isnan(want) else np.isclose(got[k][at], want)


def test_common_grid_takes_the_finest_step_and_falls_back_to_any(spark):
    rows = [(0, "a", float(t), float(t)) for t in range(0, 20, 2)] + [(0, "b", float(t), 1.0) for t in range(3, 20, 5)]
    rows += [(1, "a", float(t), 1.0) for t in range(0, 6, 2)] + [(1, "b", float(t), 1.0) for t in range(100, 120, 5)]
    series = spark.createDataFrame(rows, "session long, marker string, t double, value double")
    for block in (4.0, 1e3):
        got = align.common_grid(series, ["session"], "marker", block).collect()
        axis = {s: sorted({r["t"] for r in got if r["session"] == s}) for s in (0, 1)}
        assert axis == {0: list(range(0, 20, 2)), 1: [0, 2, 4]}
        assert {r["t"] for r in got if r["session"] == 0 and r["shown"]} == {4, 6, 8, 10, 12, 14, 16, 18}
        assert {r["t"] for r in got if r["session"] == 1 and r["shown"]} == {0, 2, 4}  # never known together: where any is


def test_rows_across_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(s, int(t), float(rng.integers(0, 100))) for s in range(4) for t in rng.choice(300, size=(1, 5, 60, 200)[s], replace=False)]
    df = spark.createDataFrame(rows, "session long, t long, v double").repartition(5)
    own = {s: sorted((t, v) for x, t, v in rows if x == s) for s in range(4)}
    for block in (7, 64, 10_000):
        numbered = align.numbered(df, ["session"], ["t"], align.block_of("t", block))
        flagged = align.near_flag(numbered, ["session"], F.col("v") >= 95, 3, "near")
        for r in flagged.collect():
            k = own[r["session"]]
            assert (k[r["i"] - 1][0], r["n"]) == (r["t"], len(k))
            assert r["near"] == any(v >= 95 for _, v in k[max(0, r["i"] - 4) : r["i"] + 3])
        before = align.preceding(df, ["session"], "t", block, ["v", "t"])
        after = align.following(df, ["session"], "t", block)
        for s, k in own.items():
            got = {r["t"]: (r["before_t"], r["before_v"]) for r in before.where(F.col("session") == s).collect()}
            assert got == {t: k[i - 1] if i else (None, None) for i, (t, _) in enumerate(k)}
            assert {r["t"]: r["next"] for r in after.where(F.col("session") == s).collect()} == {t: k[i + 1][0] if i + 1 < len(k) else None for i, (t, _) in enumerate(k)}


# --- streams


def test_contact_stream_equals_batch_after_shuffles_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(5)
    c = contact.Contact(fs=16.0, trim=0.5, band=(1, 6), notches=(4.0,), line=(3, 5), fit=(1, 7), segment=1.0)
    records = {(s, k): rng.normal(size=20 * 16) for s in (0, 1) for k in (0, 1)}
    rows = [(*k, p, x[p * 16 : p * 16 + 16].tolist()) for k, x in records.items() for p in range(20)]
    random.Random(1).shuffle(rows)
    schema = "session long, c long, part long, x array<double>"

    def add(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return monitor.drained(live.contact_stream(stream, KEYS, c, 4), f"{tmp_path}/run")

    add(rows[:25])
    add(rows[25:40] + rows[:5])  # some come twice
    run()
    add(rows[40:])
    key = lambda r: (r["session"], r["c"], r["second"])
    got = sorted(run().collect(), key=key)
    windows = recursive.epochs(chunks(spark, records, 80), KEYS, 80, 64, 16).withColumn("second", F.col("epoch") + 4)
    want = sorted(live.contact_windows(windows, KEYS, c).collect(), key=key)
    assert len(got) == len(want) == 4 * 17
    for a, b in zip(got, want):
        assert key(a) == key(b) and a["level"] == b["level"] and np.allclose([a[k] for k in contact.FIGURES], [b[k] for k in contact.FIGURES])


def test_contact_figures():
    t = np.arange(512) / 64
    x = np.stack([0.5 * np.sin(2 * np.pi * 10 * t), 0.3 * t, np.sin(2 * np.pi * 16 * t), np.zeros(512)])
    c = contact.Contact(most_drift=0.2)
    f = contact.figures(x, c)
    assert abs(f["sd"][0] - 0.5 / np.sqrt(2)) < 0.01 and f["line"][0] < 0.01
    assert abs(f["drift"][1] - 0.3 * 511 / 512) < 1e-9 and f["sd"][1] < 1e-9
    assert f["line"][2] > 0.9 and f["sd"][2] < 0.05  # told before the notch, gone after it
    assert [contact.grade(f["drift"][k], f["sd"][k], f["p2p"][k], c) for k in range(4)] == ["red"] * 4
    assert contact.grade(0.0, 0.09, 0.5, c) == "green" and contact.grade(0.0, 0.101, 0.61, c) == "yellow"


def test_late_counters_give_the_gaps_of_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    counters = [k for k in range(120) if k not in (20, 21, 22, 50, 51, 70)]
    rows = [(start + timedelta(minutes=k), k % 2, k // 2) for k in counters]
    near = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    rng = random.Random(2)
    files = []
    for a, b in zip(near[::2], near[1::2]):  # two neighbouring files, their rows mixed and the later one first
        mixed = a + b
        rng.shuffle(mixed)
        files += [sorted(mixed[20:], key=lambda r: -r[2]), mixed[:20]]
    files.append([(start + timedelta(days=2), k, 10_000) for k in (0, 1)])
    schema = "at timestamp, session long, counter long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return monitor.drained(live.late_gaps(stream, "session", "counter", "3 hours"), f"{tmp_path}/run")

    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 2:
            run()
    got = run().collect()
    for session in (0, 1):
        own = [c for s, c in ((r[1], r[2]) for r in rows) if s == session]
        want = [(b, a) for a, b in zip(own, own[1:]) if b - a > 2]
        assert sorted(r["counter"] for r in got if r["key"] == session) == own
        assert sorted((r["counter"], r["before"]) for r in got if r["key"] == session and r["gap"]) == want


class Clock:
    """A state whose processing time the test sets."""

    def __init__(self):
        self.now, self.held, self.due, self.hasTimedOut = 0, None, None, False

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.held = value

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms


def test_a_silent_key_turns_stale_and_back():
    step, clock, told = live.watch_step(3000), Clock(), []
    for now in range(0, 20_000, 500):
        clock.now = now
        heard = now < 4000 or 12_000 <= now < 13_000
        clock.hasTimedOut = not heard and clock.due is not None and now >= clock.due
        if heard or clock.hasTimedOut:
            if clock.hasTimedOut:
                clock.due = None
            told += [(r.status, r.at_ms, r.silent_ms) for out in step((7,), iter([pd.DataFrame({"key": [7]})] if heard else []), clock) for r in out.itertuples()]
    assert told == [("streaming", 0, 0), ("stale", 6500, 3000), ("streaming", 12_000, 8500), ("stale", 15_500, 3000)]


def test_the_watch_runs_as_a_stream(spark, tmp_path):
    import time

    spark.createDataFrame([(1,), (2,)], "key long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.watch(spark.readStream.schema("key long").parquet(f"{tmp_path}/in"), "key", 1500)
    q = stream.writeStream.format("memory").queryName("watched").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            told = sorted((r["key"], r["status"]) for r in spark.table("watched").collect())
            if len(told) >= 4:
                break
        assert told == [(1, "stale"), (1, "streaming"), (2, "stale"), (2, "streaming")]
    finally:
        q.stop()
