"""Medians by ranges of values and medians of resamples against numpy on whole arrays."""

import numpy as np
import pytest

from tidegrid.operators import analysis, selection, stats


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v double").repartition(7)


def test_medians_of_uneven_groups(spark, monkeypatch):
    monkeypatch.setattr(selection, "BIN", 16)
    g = np.random.default_rng(3)
    groups = {
        "hot": g.normal(size=4001), "ties": np.round(g.normal(size=3000)), "one": np.array([2.5]), "two": np.array([-1.0, 4.0]),
        "equal": np.full(500, 7.0), "signs": np.array([0.0, -0.0, 0.0, -3.0, np.inf, -np.inf]),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x]
    rows += [("hot", None), ("none", None), ("nan", float("nan")), (None, 1.0), ("one", float("nan"))]
    got = {r.k: (r.n, r["median"]) for r in selection.medians(table(spark, rows), "v", ["k"]).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k][0] == len(x) and got[k][1] == pytest.approx(float(np.median(x)), abs=1e-12)


def test_places_are_whole(spark):
    x = np.round(np.random.default_rng(5).normal(size=2000), 1)
    values = selection.placed(table(spark, [("a", float(v)) for v in x]), "v", ["k"]).collect()
    order = np.sort(x)
    assert sum(r.size for r in values) == len(x)
    assert all((order[r.first : r.first + r.size] == r.value).all() for r in values)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 4096, 70_001])
def test_middle_of_a_resample(n, monkeypatch):
    monkeypatch.setattr(selection, "COUNTERS", 64)
    monkeypatch.setattr(selection, "DRAWN", 1000)
    for rep in (0, 7, 3999):
        drawn = np.sort(np.floor(stats.uniforms(stats.ANCHOR_A, rep, 1, n)[0] * n).astype(int))
        assert selection.resample_middle(n, rep) == (drawn[(n - 1) // 2], drawn[n // 2])


def test_intervals_against_whole_arrays(spark, monkeypatch):
    monkeypatch.setattr(selection, "BIN", 32)
    g = np.random.default_rng(8)
    groups = {"a": g.normal(size=301), "b": np.round(g.normal(size=80), 1), "c": np.array([1.0, 2.0]), "d": np.array([3.0, 1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x]
    got = {r.k: r for r in selection.median_intervals(table(spark, rows), "v", ["k"], reps=300).collect()}
    for k, x in groups.items():
        assert got[k].n == len(x)
        if len(x) < 3:
            assert got[k].ci_low is None and got[k].ci_high is None
            continue
        s = np.sort(x)
        medians = [np.median(s[np.floor(stats.uniforms(stats.ANCHOR_A, r, 1, len(x))[0] * len(x)).astype(int)]) for r in range(300)]
        assert (got[k].ci_low, got[k].ci_high) == pytest.approx(tuple(np.quantile(medians, [0.025, 0.975])))


def test_empty_table(spark):
    empty = table(spark, [])
    assert selection.medians(empty, "v", ["k"]).collect() == [] and selection.median_intervals(empty, "v", ["k"], reps=10).collect() == []


def test_cohort_counts_covered_sessions_only(spark):
    rows = [("s1", "m", 9, 1.0, 2.0, 10.0, 0.5), ("s2", "m", 9, 1.0, -1.0, -5.0, 0.5), ("s3", "m", 9, 1.0, 50.0, 99.0, 0.5), ("s4", "m", 9, 1.0, 3.0, 8.0, 0.05), ("s5", "m", 2, 1.0, 3.0, 8.0, 0.9)]
    rows += [("s1", "other", 9, 1.0, 7.0, 7.0, 0.1)]
    s = spark.createDataFrame(rows, "session string, marker string, n_baseline long, spread double, std_change double, pct double, coverage double")
    changes = analysis.session_changes(s, ["m"])
    kinds = {r.session: (r.marker, r.degenerate, round(r.coverage, 6)) for r in changes.collect()}
    assert kinds == {"s1": ("m", False, 0.3), "s2": ("m", False, 0.5), "s3": ("m", True, 0.5), "s4": ("m", False, 0.05), "s5": (None, None, 0.9)}
    c = analysis.cohort(analysis.included(changes, 0.1)).collect()
    assert [(r.marker, r.n, r.median_std, r.median_pct, r.n_up, r.n_down) for r in c] == [("m", 2, 0.5, 2.5, 1, 1)]
