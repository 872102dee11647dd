"""Spectra as columns of numpy inside any plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import spectral as S
from tidegrid.plans import spectra


def test_spectra_of_segments_less_their_line(spark):
    x = np.random.default_rng(4).normal(size=(3, 32)) + np.arange(32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3, None)], "id long, x array<double>")
    seg = df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2))))
    got = seg.select("id", "s", S.line_removed_dft(F.slice("x", F.col("s") * 8 + 1, F.lit(16)), 16).alias("z")).collect()
    assert len(got) == 12
    k = np.arange(16)
    for row in got:
        if row["id"] == 3:
            assert row["z"] is None
            continue
        v = x[row["id"]][row["s"] * 8 : row["s"] * 8 + 16]
        z = np.fft.rfft((v - np.polyval(np.polyfit(k, v, 1), k)) * (0.5 - 0.5 * np.cos(2 * np.pi * k / 16)))
        assert row["z"] == pytest.approx(np.r_[z.real, z.imag].tolist(), abs=1e-9)


def test_coherence_of_each_pair(spark):
    found = spectra.coherence_imcoh_wpli(spark, "/root/testdata/sf0.001").collect()
    assert found and all(0 <= r["msc"] <= 1 and 0 <= r["imcoh"] <= 1 for r in found)


def test_cross_spectra_of_each_pair(spark):
    pairs = spectra.cross_spectra(spark, "/root/testdata/sf0.001").groupBy("pair").count().collect()
    assert pairs and all(r["count"] == 4 for r in pairs)
