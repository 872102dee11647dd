"""What a worker holds and how often a column is computed."""

import numpy as np
import pandas as pd

from tidegrid.functions.contact import Contact
from tidegrid.streaming import live


class Held:
    """Stands for a table: hands back the function that would run on it."""

    def select(self, *columns):
        return self

    def mapInPandas(self, task, schema):
        return task


def test_contact_windows_are_filtered_in_portions(monkeypatch):
    sizes, whole = [], live.reports
    monkeypatch.setattr(live, "reports", lambda keys, seconds, windows, c: sizes.append(len(windows)) or whole(keys, seconds, windows, c))
    x = list(np.random.default_rng(0).normal(size=(600, 512)))
    frame = pd.DataFrame({"session": 1, "c": 0, "second": range(600), "x": x})
    out = pd.concat(live.contact_windows(Held(), ["session", "c"], Contact())(iter([frame])))
    assert max(sizes) <= 256 and out["second"].to_list() == list(range(600))


def test_segments_compute_no_more_than_their_bands(spark):
    from tidegrid.plans import recordings

    plan = recordings.segments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "POWER(" not in plan.upper() and "zip_with" not in plan


def feature_nodes(df):
    """How many times a plan computes power densities."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_a_cohort_computes_its_windows_once(spark, monkeypatch):
    from tidegrid.plans import recordings

    written, cut = [], recordings.cut
    monkeypatch.setattr(recordings, "cut", lambda df, tag: written.append((tag, feature_nodes(df))) or cut(df, tag))
    d = "/root/testdata/sf0.001"
    assert feature_nodes(recordings.cohort_gated(spark, d)) == 0 and written == [("summary", feature_nodes(recordings.gated_series(spark, d)))]
    written.clear()
    assert feature_nodes(recordings.report_order(spark, d)) == 0 and len(written) == 1


def test_features_are_dealt_by_windows(spark):
    from tidegrid.plans import recordings

    plan = recordings.measured(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("ArrowEvalPython") < plan.find("REPARTITION_BY_COL")


def test_a_value_read_for_all_items_of_an_array_is_computed_once(spark):
    from pyspark.sql import functions as F

    from tidegrid.functions import spectral
    from tidegrid.plans import recordings

    x = spark.range(1).select(F.sequence(F.lit(1), F.lit(64)).cast("array<double>").alias("x"))
    for column in (spectral.hann(F.col("x"), 64), spectral.entropy(F.col("x"), 1, 31), recordings.sd_of(F.col("x"))):
        assert "transform(array((aggregate(" in x.select(column.alias("c"))._jdf.queryExecution().analyzed().toString().replace("transform(array(aggregate(", "transform(array((aggregate(")


def test_chunks_are_filtered_in_portions(spark, monkeypatch):
    import pyarrow as pa

    from tidegrid.functions import complexity
    from tidegrid.operators import recursive

    class Table(Held):
        schema = spark.range(0).selectExpr("id AS session", "id AS place", "array(0d) AS x").schema

        def mapInArrow(self, task, schema):
            return task

    sizes, run = [], recursive.Sections.run
    monkeypatch.setattr(recursive.Sections, "run", lambda self, x, state: sizes.append(x.size) or run(self, x, state))
    x = [np.random.default_rng(i).normal(size=n) for i, n in enumerate([640] * 700 + [27, 1] + [200_000])]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * len(x)), pa.array(range(len(x))), pa.array(x, pa.list_(pa.float64()))], names=["session", "place", "x"])
    system = recursive.Sections(complexity.butterworth_sections(2, 24, 4, 64.0))
    out = list(recursive.rest_ends(Table(), ["session"], system)(iter([batch])))
    assert max(sizes[:-1]) <= 1 << 17 and sizes[-1] == 200_000
    got = pa.Table.from_batches(out)
    assert got["place"].to_pylist() == list(range(len(x))) and got["n"].to_pylist() == [len(v) for v in x] and got["first"].to_pylist() == [v[0] for v in x]
    want = [run(system, v[None], np.zeros((1, system.order)))[1][0] for v in x]
    assert all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(got["ends"].to_pylist(), want))


class Kept:
    """Stands for the state of a group."""

    exists, hasTimedOut, mark, get, wakes = False, False, 0, None, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        self.wakes = at


def test_late_gaps_of_many_keys_are_found_in_one_call():
    state = Kept()

    def step(rows, mark, unknown=False, state=state):
        frame = pd.DataFrame(rows, columns=["key", "at", "counter"])
        state.mark, state.hasTimedOut, state.wakes = mark, not rows, None
        frames = iter([frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))] if rows else [])
        return [tuple(r) for out in live.late_gaps_step((0, unknown), frames, state) for r in out.itertuples(index=False)]

    assert step([(5, 30, 7), (2, 10, 1), (5, 20, 3), (2, 40, 2)], 0) == [] and state.wakes == 10
    assert step([], 35) == [(2, 1, 0, False), (5, 3, 2, False), (5, 7, 3, True)] and state.wakes == 40
    assert step([(9, 50, 4), (5, 45, 8)], 60) == [(2, 2, 1, False), (5, 8, 7, False), (9, 4, 3, False)] and state.wakes is None
    assert [r[1:] for r in step([(0, 1, 1), (0, 2, 9)], 60, True)] == [(1, 0, False), (9, 1, True)]
