"""Values whose last bits decide: equal values in ranks, ties of rounding, rows split and dealt in any way."""

import duckdb
import numpy as np
import pytest
from compare import compare

from tidegrid.operators import stats
from tidegrid.plans import catalogue, inference

SF = "/root/testdata/sf0.1"


@pytest.fixture
def sessions(tmp_path):
    """The events of a few users of sf0.1, with the table's first and last event."""

    def of(*users):
        ids = ", ".join(map(str, users))
        ends = f"event_id IN (SELECT min(event_id) FROM '{SF}/events.parquet') OR event_id IN (SELECT max(event_id) FROM '{SF}/events.parquet')"
        duckdb.execute(f"COPY (SELECT * FROM '{SF}/events.parquet' WHERE user_id IN ({ids}) OR {ends} ORDER BY event_id) TO '{tmp_path}/events.parquet'")
        return str(tmp_path)

    return of


def test_deltas_of_equal_deviations_are_those_of_the_sql(spark, sessions):
    d = sessions(876, 948, 1006)
    assert compare(spark, catalogue.QUERIES["cliffs_delta_rank"], catalogue.ORACLE_SQL["cliffs_delta_rank"], d) == ""


def test_texts_of_deltas_on_a_tie_are_those_of_the_sql(spark, sessions):
    d = sessions(472, 686)
    assert compare(spark, catalogue.QUERIES["payload_json"], catalogue.ORACLE_SQL["payload_json"], d) == ""


def test_texts_of_deltas_of_whole_series_are_those_of_the_sql(spark, tmp_path):
    """With every event six times, no epoch lacks values: 400 pairs, and a delta of -0.5025."""
    ends = f"event_id IN (SELECT min(event_id) FROM '{SF}/events.parquet') OR event_id IN (SELECT max(event_id) FROM '{SF}/events.parquet')"
    six = f"SELECT event_id * 6 + k AS event_id, ts, user_id, event_type, value, props FROM (SELECT * FROM '{SF}/events.parquet' WHERE user_id = 613 OR {ends}), range(6) t(k) ORDER BY 1"
    duckdb.execute(f"COPY ({six}) TO '{tmp_path}/events.parquet'")
    assert compare(spark, catalogue.QUERIES["payload_json"], catalogue.ORACLE_SQL["payload_json"], str(tmp_path)) == ""


def test_values_are_rounded_as_the_sql_rounds_them(spark):
    ties = [k / 640 for k in range(-700, 700)] + [2 * k / p - 1 for p in (400, 380, 896) for k in range(p)] + [k / 1000 for k in range(-70000, 70000, 5)]
    values = [*ties, *np.random.default_rng(5).normal(0, 40, 2000).tolist(), 0.49999999999999994, 2.5, -2.5, 4503599627370497.5, 1e17, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    for places in (0, 2, 3, 4, 6, 9):
        got = [r[0] for r in df.orderBy("i").select(stats.rounded("v", places)).collect()]
        want = [r[0] for r in duckdb.execute(f"SELECT round(v, {places}) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
        assert [repr(v) for v in got] == [repr(v) for v in want]


def test_series_have_the_same_bits_however_rows_are_split(spark, tmp_path):
    one, many = tmp_path / "one", tmp_path / "many"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(f"{one}/events.parquet")
    events.orderBy("value").repartition(5, "props").write.parquet(f"{many}/events.parquet")

    def bits(d):
        return sorted((r["session"], r["epoch"], r["marker"], repr(r["value"])) for r in inference.series(spark, str(d)).collect())

    assert bits(one) == bits(many)


def test_replicates_of_series_of_one_length_share_their_draws():
    rng = np.random.default_rng(3)
    stats.draws.cache_clear()
    for n in (1, 2, 7, 40, 40, 40, 255, 256, 700):
        x = np.round(rng.normal(size=n), 1)
        want = np.median(x[stats.resampled(n, 5, 0, 300, (0, 1))], axis=1)
        assert stats.replicate_medians(x, 5, 300, (0, 1)).tolist() == want.tolist()
    assert stats.draws.cache_info().misses == 5
    a, b = rng.normal(size=30), rng.normal(size=21)
    formed = stats.effect_interval(a, b, (4, 12), statistic=lambda a, b: stats.median_difference(a, b))
    assert stats.effect_interval(a, b, (4, 12)) == formed


def test_sign_tests_on_a_tie_of_rounding_are_those_of_the_sql(spark):
    from pyspark.sql import functions as F

    p = "least(1.0, 2 * list_sum(list_transform(range(least(u, n - u) + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0)))))"
    want = duckdb.execute(f"SELECT n, u, round({p}, 6) FROM (SELECT n, unnest(range(n + 1)) AS u FROM range(71) t(n)) ORDER BY n, u").fetchall()
    signs = spark.range(71).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), "id")).alias("u"))
    got = signs.select("n", "u", F.round(stats.sign_test(F.col("u"), F.col("n")), 6).alias("p")).orderBy("n", "u").collect()
    assert [tuple(r) for r in got] == want


def test_a_cohort_with_a_sign_test_on_a_tie_is_that_of_the_sql(spark):
    assert compare(spark, catalogue.QUERIES["cohort_gated"], catalogue.ORACLE_SQL["cohort_gated"], SF) == ""
