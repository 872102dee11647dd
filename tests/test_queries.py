"""Every registered query of the signal library against its SQL, and goldens of what SQL doesn't express."""

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from tidegrid.functions import complexity, markers, spectral
from tidegrid.operators import analysis, clean, grid, stats
from tidegrid.plans import catalogue, recordings, signals

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries())


def test_lempel_ziv_counts():
    assert [complexity.lz76(x) for x in ("0001101001000101", "0101010101", "0000000000", "01101")] == [6, 3, 2, 4]


def test_filter_gains():
    db = 10 * np.log10(complexity.butterworth_gain(np.array([1.0, 10, 45, 50, 100]), 1, 45, 4, 250.0))
    # Forward and backward: twice the decibels of one pass.
    assert np.allclose(2 * db, [-6.02, 0, -6.02, -12.18, -111.05], atol=0.01)
    one = 2 * 10 * np.log10(complexity.notch_gain(np.array([45.0]), 50.0, 30.0, 250.0))
    assert np.allclose(one, -0.226, atol=0.001)


def test_zero_phase_keeps_what_is_in_the_band():
    t = np.arange(2000) / 250
    x = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 100 * t)
    y = complexity.zero_phase(x[None], complexity.butterworth_sections(1, 45, 4, 250.0), 27)[0]
    assert np.abs(y - np.sin(2 * np.pi * 10 * t))[700:-700].max() < 0.01


def test_sections_have_the_published_gains():
    t = np.arange(30_000) / 250
    freqs = [1.0, 10.0, 45.0, 50.0]
    x = np.array([np.sin(2 * np.pi * f * t) for f in freqs])

    def gains(sections, passes=1):
        y = complexity.zero_phase(x, sections, 27, passes)[:, 8000:-8000]
        return 20 * np.log10(y.std(axis=1) / x[:, 8000:-8000].std(axis=1) + 1e-12)

    assert np.allclose(gains(complexity.butterworth_sections(1, 45, 4, 250.0)), [-6.02, 0, -6.02, -12.18], atol=0.02)
    notch = complexity.notch_section(50.0, 30.0, 250.0)
    assert np.isclose(gains(notch)[2], -0.226, atol=0.002) and np.isclose(gains(notch, 2)[2], -0.452, atol=0.004) and gains(notch)[3] < -60


def test_a_level_passes_a_notch_from_the_first_sample_on():
    flat = np.full((2, 40), 3.0)
    assert np.allclose(complexity.zero_phase(flat, complexity.notch_section(16.0, 30.0, 64.0), 9), flat)
    assert np.allclose(complexity.zero_phase(flat, complexity.butterworth_sections(4, 20, 4, 64.0), 27), 0, atol=1e-9)


def test_density_of_a_sine(spark):
    x = [float(v) for v in np.sin(2 * np.pi * 10 * np.arange(64) / 64)]
    p = spark.createDataFrame([(x,)], "x array<double>").select(spectral.periodogram(F.col("x"), 64, 64.0).alias("p"))
    r = p.select("p", spectral.band_power(F.col("p"), 8, 12).alias("b"), spectral.peak_frequency(F.col("p"), 8, 12).alias("f")).first()
    assert np.allclose(r["p"][9:12], [1 / 12, 1 / 3, 1 / 12]) and np.isclose(r["b"], 0.5) and r["f"] == 10


def test_slope_and_entropy(spark):
    p = [1.0] + [f**-2.0 for f in range(1, 33)]
    r = spark.createDataFrame([(p, [1.0] * 33)], "p array<double>, q array<double>")
    slope, _ = spectral.log_line(F.col("p"), 2, 30, (8, 12))
    assert np.allclose(r.select(slope, spectral.entropy(F.col("q"), 1, 31)).first(), [-2, 1])


def test_moving_median(spark):
    r = spark.createDataFrame([([5.0, 1.0, 9.0, 2.0, 8.0, 3.0],)], "v array<double>").select(spectral.median5(F.col("v"))).first()[0]
    assert r == [5, 5, 5, 3, 3, 3]


def test_cliffs_delta_and_spread(spark):
    rows = [("s", "a", float(v)) for v in (1, 2, 3, 4, 5)] + [("s", "b", float(v)) for v in (3, 4, 5, 6, 7)]
    df = spark.createDataFrame(rows, "session string, g string, v double")
    assert np.isclose(stats.cliffs_delta(df, "v", "g", "a", "b", ["session"]).first()["delta"], 0.64)
    assert np.isclose(stats.spread(df.where("g = 'a'"), "v", ["session"]).first()["spread"], 1.4826)


def test_spearman(spark):
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip([1, 2, 2, 3, 5, 4], [2, 1, 4, 3, 6, 6])], "session string, x double, y double")
    assert np.isclose(stats.spearman(df, "x", "y", ["session"]).first()["rho"], 0.794117647)


def test_sign_test(spark):
    df = spark.createDataFrame([(5, 6), (6, 6), (5, 5), (7, 8), (0, 0), (400, 1000)], "u long, n long").select(stats.sign_test(F.col("u"), F.col("n")).alias("p"))
    p = [r["p"] for r in df.collect()]
    assert np.allclose(p[:5], [0.21875, 0.03125, 0.0625, 0.0703125, 1.0]) and 0 < p[5] < 1e-9


def test_decorrelation_lag_and_block(spark):
    df = spark.createDataFrame([("up", i, float(i + 1)) for i in range(10)] + [("alt", i, float((-1) ** i)) for i in range(10)], "session string, i long, v double")
    out = {r["session"]: r["lag"] for r in stats.decorrelation_lag(df, "v", "i", ["session"]).collect()}
    assert out == {"up": 3, "alt": 1}
    slow = np.repeat(np.random.default_rng(1).normal(size=12), 100)  # its first lag below 1/e lies far out
    df = spark.createDataFrame([("slow", i, float(v)) for i, v in enumerate(slow)], "session string, i long, v double")
    centred = slow - slow.mean()
    acf = [float(centred[k:] @ centred[: len(slow) - k]) / float(centred @ centred) for k in range(len(slow))]
    want = next(k for k, r in enumerate(acf) if r < 0.3679)
    assert want > 41 and stats.decorrelation_lag(df, "v", "i", ["session"]).first()["lag"] == want
    assert stats.array_lag(np.repeat(slow, 4)) == next(k for k in range(4800) if float((c := np.repeat(centred, 4))[k:] @ c[: 4800 - k]) / float(c @ c) < 0.3679)


def test_counter_gaps(spark):
    df = spark.createDataFrame([("s", c) for c in (10, 11, 12, 15, 16, 18)], "session string, c long")
    assert [r["c"] for r in clean.gaps(df, "c", ["session"]).where("gap").collect()] == [15]


def test_grid_sizes():
    assert [grid.Grid(h, w // h, d).n for d, w, h in ((30, 4, 2), (90, 4, 2), (30, 10, 5), (90, 10, 5), (3, 4, 2), (4, 4, 2))] == [14, 44, 5, 17, 0, 1]


def test_phase_join_takes_the_first_match(spark):
    e = spark.createDataFrame([("s", 1.0), ("s", 5.0), ("s", 99.0), ("t", 1.0)], "session string, t double")
    p = spark.createDataFrame([("s", 0, "A", 0.0, 4.0), ("s", 1, "B", 4.0, 9.0), ("s", 2, "C", 2.0, 9.0)], "session string, place int, phase string, start_s double, end_s double")
    assert {(r["session"], r["t"]): r["phase"] for r in grid.phase_join(e, p).collect()} == {("s", 1.0): "A", ("s", 5.0): "B", ("s", 99.0): "", ("t", 1.0): ""}


def test_windows_want_every_required_channel_in_every_epoch(spark):
    rows = [("all", e, c, True) for e in range(6) for c in "ab"]
    rows += [("one", e, c, c == "a" or e != 3) for e in range(6) for c in "ab"]
    rows += [("gap", e, c, True) for e in range(6) for c in "ab" if (e, c) != (3, "b")]
    gates = spark.createDataFrame(rows, "session string, epoch long, channel string, ok boolean")
    ok = lambda channels: {(r["session"], r["epoch"]): r["ok"] for r in signals.windows_ok(gates, channels, 6).collect()}
    assert ok(("a", "b")) == {(s, e): s == "all" or e < 2 for s in ("all", "one", "gap") for e in range(6)}
    assert all(ok(("a",)).values()) and not any(ok(("a", "unknown")).values())


def slow_interval(a, b, block, reps, rng):
    """The stationary bootstrap value by value."""
    def places(n):
        out = []
        while len(out) < n:
            out.append(rng.integers(n) if not out or rng.random() < 1 / block else (out[-1] + 1) % n)
        return out

    return np.quantile([np.median(b[places(len(b))]) - np.median(a[places(len(a))]) for _ in range(reps)], [0.025, 0.975])


def test_interval_of_the_effect(spark):
    rng = np.random.default_rng(11)
    walk = np.cumsum(rng.normal(size=80)) / 2  # its autocorrelation gives a longer block than the other phase's
    data = {"far": (rng.normal(size=60), rng.normal(size=80) + 3), "same": (rng.normal(size=60), walk - np.median(walk)), "few": (rng.normal(size=2), rng.normal(size=9))}
    rows = [(k, "m", i, p, float(v)) for k, ab in data.items() for p, x in zip((analysis.A, analysis.B), ab) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("far", "m", 99, analysis.A, None), ("far", "m", 98, "SETTLE", 5.0)], "session string, marker string, epoch long, phase string, value double")
    got = {r["session"]: r for r in stats.effects(df, ["session", "marker"], analysis.A, analysis.B, (4, 12)).collect()}
    for k in ("far", "same"):
        a, b = data[k]
        r = got[k]
        assert r["block"] == min(max(2 * max(stats.array_lag(a), stats.array_lag(b)), 4), 12) and r["n_effective"] == 60 / r["block"]
        assert np.isclose(r["effect"], np.median(b) - np.median(a))
        want = slow_interval(a, b, r["block"], 2000, rng)
        assert np.allclose((r["ci_low"], r["ci_high"]), want, atol=0.2 * (want[1] - want[0]))
    assert got["far"]["block"] == 4 and got["same"]["block"] == 12 and got["far"]["reliable"] and not got["same"]["reliable"]
    assert (got["few"]["effect"], got["few"]["ci_low"], got["few"]["n_effective"], got["few"]["reliable"]) == (None, None, None, False)
    assert [stats.array_lag(np.array(x, float)) for x in (range(1, 11), [(-1) ** i for i in range(10)], [1, 2, 3], [7] * 9)] == [3, 1, 1, 1]


def test_horizons_come_from_the_data(spark, tmp_path):
    from datetime import datetime

    rows = [(k, datetime(2031, 3, 30 if k < 50 else 28, k % 24), k % 3, "click", float(k), "{}") for k in range(90)]
    rows += [(99, datetime(2031, 7, 1), 1, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("epoch_grid_counts", "epoch_centers", "lerp_resample", "window_gate_strict", "longest_segment"):
        assert compare(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'"), str(tmp_path)) == "", name
    assert catalogue.QUERIES["epoch_grid_counts"](spark, str(tmp_path)).agg(F.max("epoch")).first()[0] > 1000


def test_bootstrap_numbers_are_uniform_and_stated():
    u = stats.uniforms(1, 0, 2000, 50)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.std() - 12**-0.5) < 0.01 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.1 and len(np.unique(u)) > 0.99 * u.size
    assert (stats.uniforms(1, 7, 3, 50) == u[7:10]).all() and not (stats.uniforms(2, 0, 3, 50) == u[:3]).any()


def vectors_table(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def test_markers_without_their_channels_are_null(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = {k: [float(v) for v in rng.normal(size=64) / 8] for k in range(16)}
    vectors_table(spark, tmp_path, [(k, v, 0) for k, v in x.items() if k != 8 + 1])  # no F4 in the second window
    got = {(r["epoch"], r["marker"]): r["value"] for r in recordings.markers_psd(spark, str(tmp_path)).collect()}
    got |= {(r["epoch"], r["marker"]): r["value"] for r in recordings.markers_pair(spark, str(tmp_path)).collect()}
    for m in markers.MARKERS:
        if m.kind != "timeseries":
            assert got[0, m.id] is not None or m.id == "wpli_alpha1", m.id
            assert (got[1, m.id] is None) == ("F4" in m.channels), m.id
    ok = {(r["epoch"], r["channel"]): r["ok"] for r in recordings.quality_gate_full(spark, str(tmp_path)).collect()}
    assert (1, "F4") not in ok and len(ok) == 11


def test_a_new_entry_is_a_new_marker(spark, monkeypatch):
    own = markers.Marker("own", "psd", ("C3",), "extra", "up", lambda w, channels: w.channel["C3"]["alpha"])
    monkeypatch.setattr(markers, "MARKERS", [*markers.MARKERS, own])
    rows = recordings.values(recordings.measured(spark, SF), [markers.get("own")], recordings.PLACE)
    assert {r["marker"] for r in rows.collect()} == {"own"} and rows.where("value > 0").count() > 0


def test_pairs_and_the_gate_follow_their_definitions(spark):
    t = np.arange(640) / 64
    rng = np.random.default_rng(5)
    same, noise, other = np.sin(2 * np.pi * 9 * t), rng.normal(size=640), rng.normal(size=640)
    late = np.sin(2 * np.pi * 9 * t - np.pi / 2)
    rows = [(0, (same + noise / 10).tolist(), (same + other / 10).tolist()), (1, noise.tolist(), other.tolist()), (2, same.tolist(), (late + noise / 10).tolist()), (3, same[:64].tolist(), same[:64].tolist()), (4, None, same.tolist())]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>")
    r = {x["k"]: x["m"] for x in df.select("k", complexity.pair_measures(F.col("a"), F.col("b"), 64.0, 64, (8, 10)).alias("m")).collect()}
    assert r[0]["msc"] > 0.6 > r[1]["msc"] and r[2]["imcoh"] > 0.3 > r[0]["imcoh"] and r[2]["wpli"] > 0.5
    assert r[3]["msc"] is None and r[4]["msc"] is None  # below 19 segments, without a channel


def test_ranking_puts_what_artefacts_explain_behind(spark):
    rows = [("s", "alpha_rel", 90.0, 0.9, 0.7, 0.1), ("s", "beta_rel", 10.0, 0.9, 0.1, None), ("s", "smr_rel", 50.0, 0.9, 0.1, -0.8), ("s", "theta_rel", 40.0, 0.5, 0.1, 0.1), ("s", "lziv", 99.0, 0.9, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "session string, marker string, pct double, coverage double, r_emg double, r_motion double").withColumn("std_change", F.lit(1.0))
    pool = [m.id for m in markers.markers("marker")]
    got = [(r["marker"], r["flagged"]) for r in analysis.rank(df, ["session"], 9, pool=pool).orderBy("place").collect()]
    assert got == [("beta_rel", False), ("alpha_rel", True), ("smr_rel", True), ("theta_rel", True)]


def test_display_series():
    nan = float("nan")
    line, start = recordings.sparkline(np.array([nan, 1, nan, 3, 5, nan]), np.array([0, 0, 0, 1, 1, 1]))
    assert line == [1, 1, 2, 3, 5, 5] and start == 0.5
    assert recordings.sparkline(np.array([nan, 1, nan, 3]), np.array([0, 1, 1, 1])) == ([], None)
    active = np.array([0, 0, 0, 0, 1, 1, 1])
    a, b = np.array([nan, 1, 2, 3, nan, 9, 9]), np.array([5.0, 5, 5, 5, 5, 5, nan])
    start, x, y, fx, fy = recordings.deviations(active, a, b)
    assert start == 1 and len(x) == 5 and y == [] and fx == 0 and fy is None  # b's baseline and series don't vary
    assert np.allclose(x[0], (1 - 2) / 1.4826) and x[-1] > x[0]
    assert recordings.deviations(active, np.full(7, nan), b)[0] == 0  # no common support: the union
    assert recordings.deviations(active, np.full(7, nan), np.full(7, nan))[0] is None


def test_scans(spark, tmp_path):
    import json

    from tidegrid.sources import tables

    head = ",".join(tables.RECORDING_COLUMNS)
    rows = "\n".join(",".join(str(float(i * 100 + k)) for k in range(17)) for i in range(5))
    for name, bom, header in (("good", "", head), ("bom", "\ufeff", head), ("bad", "", head.replace("EEG 1", "EEG one"))):
        (tmp_path / f"{name}.csv").write_text(f"{bom}{header}\n{rows}\n", encoding="utf-8")
    for name in ("good", "bom"):
        got = tables.read_recording_csv(spark, f"{tmp_path}/{name}.csv").collect()
        assert [list(r) for r in got] == [[float(i * 100 + k) for k in range(17)] for i in range(5)]
    with pytest.raises(Exception):
        tables.read_recording_csv(spark, f"{tmp_path}/bad.csv").collect()
    for k, n in (("a", 300), ("b", 70)):
        (tmp_path / k).mkdir()
        np.save(tmp_path / k / "raw.npy", np.arange(17 * n, dtype=np.float32).reshape(17, n))
        events = [{"t_s": 1.5, "kind": "phase", "detail": "MANTRA", "payload": {"x": "1"}}, {"t_s": 9.0, "kind": "mark", "detail": "", "payload": {}}]
        (tmp_path / k / "events.json").write_text(json.dumps(events))
    long = tables.read_recording_npy(spark, f"{tmp_path}/*/raw.npy")
    assert long.count() == 17 * 370 and long.where("sample = 7 AND row = 2 AND file LIKE '%/a/raw.npy'").first()["value"] == 2 * 300 + 7
    np.save(tmp_path / "short.npy", np.zeros((3, 4), np.float32))
    with pytest.raises(Exception, match="17"):
        tables.read_recording_npy(spark, f"{tmp_path}/short.npy").collect()
    ev = tables.read_events_json(spark, f"{tmp_path}/*/events.json").collect()
    assert len(ev) == 4 and {(r["kind"], (r["payload"] or {}).get("x")) for r in ev} == {("phase", "1"), ("mark", None)}


def test_units_are_told_from_the_spread(spark):
    from tidegrid.sources import tables

    rng = np.random.default_rng(2)
    rows = [(s, c, float(v)) for s, scale in (("uv", 20), ("volts", 2e-5)) for c in "abc" for v in rng.normal(size=50) * scale + 1e5 * scale]
    got = tables.plausible_units(spark.createDataFrame(rows, "session string, channel string, value double")).collect()
    assert {r["session"]: r["plausible"] for r in got} == {"uv": True, "volts": False}


def test_streams_go_on_over_batches_and_restarts(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidegrid.streaming import monitor

    def add(name, ids):
        rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 2, "click", float(i), "{}") for i in ids]
        df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        return rows

    add("a", range(0, 40))
    add("b", [*range(40, 60), *range(70, 80)])
    of = lambda: monitor.counter_gaps(monitor.events_stream(spark, str(tmp_path), files=1))
    total = lambda df: {r["session"]: (r["gaps"], r["seen"]) for r in df.groupBy("session").agg(F.sum("gaps").alias("gaps"), F.sum("seen").alias("seen")).collect()}
    assert total(monitor.drained(of(), f"{tmp_path}/run")) == {0: (1, 35), 1: (1, 35)}  # counters of one user go up by two
    add("c", range(90, 100))
    assert total(monitor.drained(of(), f"{tmp_path}/run")) == {0: (2, 40), 1: (2, 40)}
    windows = monitor.session_windows(monitor.events_stream(spark, str(tmp_path), files=1), "5 hours", "1 hour")
    got = sorted((r["session"], r["n"]) for r in monitor.drained(windows).collect())
    assert got == [(0, 5), (0, 30), (1, 5), (1, 30)]


def test_registry():
    assert len(markers.markers("marker")) == 8 and [m.id for m in markers.MARKERS if m.composite] == ["alpha_rel", "beta_rel", "smr_rel"]
    with pytest.raises(KeyError):
        markers.get("none")


def test_tiers(spark):
    df = spark.createDataFrame([(v,) for v in (0.95, 0.11, 0.09, 0.03, 0.01, 0.0)], "c double").select(analysis.tier(F.col("c")))
    assert [r[0] for r in df.collect()] == ["full", "full", "descriptive", "descriptive", "insufficient", "insufficient"]
