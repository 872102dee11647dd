"""Phases by session, adequacy, taps, motion, bars and session folders against plain loops."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import analysis, grid
from tidegrid.sources import tables


def test_phase_join_by_blocks(spark):
    g = np.random.default_rng(4)
    phases = [("hot" if i % 3 else "cold", i, f"p{i}", float(a), float(a + w)) for i, (a, w) in enumerate(zip(g.integers(0, 400, 60), g.integers(0, 90, 60)))]
    points = [(s, float(t) + h) for s in ("hot", "cold", "none") for t in range(-5, 500, 7) for h in (0.0, 0.5)]
    e = spark.createDataFrame(points, "session string, t double")
    p = spark.createDataFrame(phases, "session string, place long, phase string, start_s double, end_s double")
    want = {(s, t): next((n for k, _, n, a, b in phases if k == s and a <= t < b), "") for s, t in points}
    for block in (3.0, 50.0, 10_000.0):
        assert {(r.session, r.t): r.phase for r in grid.phase_join(e, p, block).collect()} == want
    plan = grid.phase_join(e, p)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_epochs_bought_and_adequacy(spark):
    rows = spark.createDataFrame([(d,) for d in (0.0, 3.9, 4.0, 5.9, 6.0, 52.0, 50.0, 22.0, 21.9)], "d double").withColumn("n", analysis.epochs_bought(F.col("d"), 4, 2))
    got = {r.d: (r.n, r.g) for r in rows.withColumn("g", analysis.adequacy(F.col("n"), 25, 10)).collect()}
    assert got == {
        0.0: (0, "insufficient"), 3.9: (0, "insufficient"), 4.0: (1, "insufficient"), 5.9: (1, "insufficient"), 6.0: (2, "insufficient"),
        52.0: (25, "ok"), 50.0: (24, "thin"), 22.0: (10, "thin"), 21.9: (9, "insufficient"),
    }


def test_tapped_channel(spark):
    g = np.random.default_rng(1)
    t = np.arange(200.0)
    drift = {"a": 3 * t, "b": -2 * t, "c": 0 * t, "d": 5 * t}
    rows, want = [], {}
    for session, loud in (("tap", 40.0), ("still", 1.5)):
        x = {c: v + g.normal(size=200) * (loud if c == "b" else 1.0) for c, v in drift.items()}
        rows += [(session, c, float(i), float(v)) for c, xs in x.items() for i, v in zip(t, xs)]
        sd = {c: float(np.std(xs - np.polyval(np.polyfit(t, xs, 1), t))) for c, xs in x.items()}
        top = max(sd, key=sd.get)
        want[session] = (top, sd[top] / float(np.median([v for c, v in sd.items() if c != top])))
    rows += [("flat", c, float(i), 1.0 + i * (c == "y")) for c in ("x", "y") for i in range(5)] + [("alone", "x", float(i), float(i * i)) for i in range(5)]
    rows += [("short", "x", 0.0, 1.0), ("short", "x", 1.0, 9.0), ("tap", "a", 3.0, None)]
    got = {r.session: r for r in analysis.tapped(spark.createDataFrame(rows, "session string, c string, t double, v double"), ["session"], "c", "t", "v").collect()}
    for k, (top, ratio) in want.items():
        assert got[k].top == top and got[k].ratio == pytest.approx(ratio, rel=1e-4) and got[k].tapped == (top if ratio >= 3 else None)
    assert got["tap"].tapped == "b" and got["still"].tapped is None
    assert got["alone"].ratio is None and got["alone"].tapped is None and got["flat"].ratio == float("inf") and "short" not in got


def test_motion_of_all_axes(spark):
    g = np.random.default_rng(2)
    a, w = g.normal(size=(90, 3)) * 0.02 + [0, 0, 1], g.normal(size=(90, 3)) * 2
    a[5], w[40, 1] = [0.0, 0.6, 1.0], -9.0
    rows = [(i // 30, *map(float, a[i]), *map(float, w[i])) for i in range(90)] + [(0, None, 1.0, 1.0, 0.0, 0.0, 0.0), (9, None, 1.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "e long, x double, y double, z double, p double, q double, r double")
    got = {r.e: r for r in analysis.motion(df, ["e"], [F.col(c) for c in "xyz"], [F.col(c) for c in "pqr"], 0.1, 8.0).collect()}
    assert sorted(got) == [0, 1, 2]
    for e in range(3):
        i = slice(30 * e, 30 * e + 30)
        off = np.abs(np.linalg.norm(a[i], axis=1) - 1)
        assert got[e].motion == pytest.approx(off.mean() + np.abs(w[i]).mean() / 100)
        assert got[e].moved == bool((off > 0.1).any() or (np.abs(w[i]) > 8).any())
    assert (got[0].moved, got[1].moved) == (True, True)


def test_bars_keep_what_they_exclude(spark):
    rows = [("s", "a", 30.0), ("s", "b", -60.0), ("s", "c", None), ("s", "d", 179.0), ("s", "e", 30.0), ("t", "a", None), ("u", "a", 1.0)]
    got = {(r.session, r.marker): (r.place, r.scale) for r in analysis.bars(spark.createDataFrame(rows, "session string, marker string, pct double"), ["session"]).collect()}
    assert got == {
        ("s", "b"): (1, 60.0), ("s", "a"): (2, 60.0), ("s", "e"): (3, 60.0), ("s", "c"): (None, 60.0), ("s", "d"): (None, 60.0),
        ("t", "a"): (None, None), ("u", "a"): (1, 5.0),
    }


def test_session_folders_by_time(spark, tmp_path):
    for name, files, at in (("old", ["meta.json", "eeg.npy"], 1_000_000), ("new", ["meta.json"], 3_000_000), ("broken", ["eeg.npy"], 9_000_000), ("mid", ["meta.json", "events.json"], 2_000_000)):
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_bytes(b"12345")
            os.utime(tmp_path / name / f, (at, at))
    got = {r.session: (r.files, r.size) for r in tables.session_folders(spark, str(tmp_path)).collect()}
    assert got == {"old": (2, 10), "new": (1, 5), "mid": (2, 10)}
    assert [r.session for r in tables.latest_session(spark, str(tmp_path)).collect()] == ["new"]
    assert tables.latest_session(spark, str(tmp_path), ("nothing.txt",)).collect() == []
    assert [r.session for r in tables.latest_session(spark, str(tmp_path), ("eeg.npy",)).collect()] == ["broken"]
