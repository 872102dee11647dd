"""Recordings read by many tasks, cut off by a crash, and replayed as a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import complexity
from tidegrid.operators import recursive
from tidegrid.sources import recordings


@pytest.fixture()
def spark_(spark):
    return recordings.register(spark)


def test_ranges_of_npy_files(spark_, tmp_path):
    arrays = {"a": np.arange(17 * 300, dtype=np.float32).reshape(17, 300), "b": np.arange(17 * 70).reshape(17, 70) * 0.5, "c": np.zeros((17, 0), np.float32)}
    for k, x in arrays.items():
        (tmp_path / k).mkdir()
        np.save(tmp_path / k / "raw.npy", x)
    df = spark_.read.format("npy_recordings").option("part", 128).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 17 * (3 + 1)
    assert df.agg(F.max(F.size("values"))).first()[0] == 128
    got = {}
    for r in recordings.samples_of(df).collect():
        got.setdefault(r["file"].split("/")[-2], {})[r["row"], r["sample"]] = r["value"]
    for k in ("a", "b"):
        assert got[k] == {(row, n): float(np.float32(v)) for row, xs in enumerate(arrays[k]) for n, v in enumerate(xs)}
    one = spark_.read.format("npy_recordings").load(f"{tmp_path}/b/raw.npy")
    assert recordings.samples_of(one).count() == 17 * 70


@pytest.mark.parametrize("x", [np.zeros((3, 4), np.float32), np.zeros(17), np.asfortranarray(np.ones((17, 5)))])
def test_other_arrays_fail(spark_, tmp_path, x):
    np.save(tmp_path / "raw.npy", x)
    with pytest.raises(Exception, match="17"):
        spark_.read.format("npy_recordings").load(str(tmp_path)).collect()


def test_a_truncated_stream_gives_its_whole_samples_and_one_event(spark_, tmp_path):
    x = np.arange(17 * 101, dtype=np.float32).reshape(101, 17)
    whole, cut, empty = tmp_path / "s1.f32", tmp_path / "s2.f32", tmp_path / "s3.f32"
    whole.write_bytes(x.tobytes())
    cut.write_bytes(x.tobytes()[:-30])
    empty.write_bytes(b"")
    df = recordings.samples_of(spark_.read.format("raw_recordings").option("part", 16).load(str(tmp_path)))
    counts = {r["file"].split("/")[-1]: r["count"] for r in df.groupBy("file").count().collect()}
    assert counts == {"s1.f32": 17 * 101, "s2.f32": 17 * 100}
    assert all(r["value"] == x[r["sample"], r["row"]] for r in df.collect())
    events = recordings.truncated(spark_, str(tmp_path)).collect()
    assert [(r["file"].split("/")[-1], r["t"], r["kind"]) for r in events] == [("s2.f32", 100, "truncated_recording")]


def test_a_recording_is_filtered_from_its_parts(spark_, tmp_path):
    x = np.random.default_rng(1).normal(size=(17, 1000)).astype(np.float32)
    np.save(tmp_path / "raw.npy", x)
    parts = spark_.read.format("npy_recordings").option("part", 256).load(str(tmp_path)).where("row IN (0, 3)")
    sections = complexity.butterworth_sections(1, 45, 4, 250.0)
    got = recursive.zero_phase(recordings.recording_chunks(parts, 256), ["file", "row"], sections, 27)
    for row in (0, 3):
        y = np.concatenate([r["x"] for r in got.where(F.col("row") == row).orderBy("chunk").collect()])
        assert np.allclose(y, complexity.zero_phase(x[row : row + 1].astype(float), sections, 27)[0], atol=1e-8)


def test_a_replay_ends_goes_on_and_gives_each_sample_once(spark_, tmp_path):
    x = np.arange(17 * 260, dtype=np.float32).reshape(260, 17)
    path = tmp_path / "s.f32"

    def run(*steps):
        stream = spark_.readStream.format("raw_recordings").option("pace", 50).option("part", 20).load(str(path))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="50 milliseconds").start()
        try:
            for content in steps:
                path.write_bytes(content)
                q.processAllAvailable()
            return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        finally:
            q.stop()

    path.write_bytes(x[:30].tobytes())
    sizes = run(x[:30].tobytes(), x[:200].tobytes() + b"abc")
    assert len(sizes) >= 5 and all(n <= 17 * 3 for n in sizes[1:])  # fifty samples at most: three parts of each row
    run(x.tobytes())
    got = recordings.samples_of(spark_.read.schema(recordings.PARTS).parquet(f"{tmp_path}/out")).collect()
    assert sorted((r["row"], r["sample"], r["value"]) for r in got) == [(row, n, float(x[n, row])) for row in range(17) for n in range(260)]
