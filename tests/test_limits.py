"""Values at a limit: what a sum's or a product's last bit must not decide."""

import duckdb
import numpy as np
import pytest

from pulselake import plans
from pulselake.operators import estimators as E
from pulselake.operators import frames, splits

#: Ten values of mean 50, whose sum in this order is less than 500; ten values, then ten of a mean greater by 20, whose means differ by more.
MEAN_50 = (70.47, 40.69, 17.08, 45.95, 64.37, 51.65, 18.84, 73.77, 23.41, 93.77)
DRIFT_20 = (59.79, 3.33, 42.94, 7.4, 20.9, 51.48, 8.27, 21.91, 6.85, 11.39, 50.53, 54.04, 56.24, 57.37, 6.71, 36.45, 19.74, 31.32, 35.46, 86.4)


def table(spark, folder, events):
    """A folder with events (user, value, event_type) at one a minute in the order given."""
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {i} MINUTE, {user}, '{kind}', {value!r}::DOUBLE)" for i, (user, value, kind) in enumerate(events))
    duckdb.sql(f"SELECT i::BIGINT AS event_id, ts, u::BIGINT AS user_id, k AS event_type, v AS value FROM (VALUES {rows}) t(i, ts, u, k, v)").write_parquet(f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = plans.QUERIES[name](spark, folder)
    want = c.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    return sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_session_metrics_count_the_conditions_of_invalid_windows(spark, tmp_path):
    folder = table(spark, tmp_path, [(1, 20.0, "click"), (1, 30.0, "view"), (2, 60.0, "view")])
    assert [tuple(r) for r in plans.QUERIES["f17_session_metrics"](spark, folder).select("session", "valid", "lighting", "motion", "roi").orderBy("session").collect()] == [(1, 0, 1, 1, 1), (2, 0, 0, 0, 1)]
    assert same_as_sql(spark, folder, "f17_session_metrics")


def test_quality_index_of_a_rate_of_zero(spark, tmp_path):
    values = (29.64, 131.91, 69.43, 53.13, 26.89, 60.66, 0.0, 65.48, 97.18, 0.0, 68.74)
    assert same_as_sql(spark, table(spark, tmp_path, [(1, v, "view") for v in values]), "g21_quality_index")
    assert frames.region_index({"rates": [70.0]}, {"x": 0.0}) == ({"rates": [70.0], "sqi": 0.0, "bpm": 0.0}, {"sqi": 0.0})


def test_one_peak_at_a_limit():
    magnitude = np.zeros(151)
    magnitude[27], magnitude[62] = 1.0, 100.0  # 54 and 124 a minute; 124 is 10 off the double of 57, not less
    assert E.one_peak(magnitude, 10 / 300, 57.0) * 60 == pytest.approx(124)


def test_split_sizes_are_of_decimal_shares(spark):
    n = spark.createDataFrame([(90_000,), (10,), (9,)], "n long")
    assert [tuple(r) for r in n.select(splits.part(n.n, 0.7), splits.part(n.n, 0.15), splits.part(n.n, 0.8)).collect()] == [(63_000, 13_500, 72_000), (7, 1, 8), (6, 1, 7)]
    sizes = splits.random_split(spark.range(90_000).withColumnRenamed("id", "sample")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in sizes} == {"train": 63_000, "validation": 13_500, "test": 13_500}


@pytest.mark.parametrize("turn", [1, -1])
def test_mean_at_the_limit_of_low_light(spark, tmp_path, turn):
    values = MEAN_50[::turn]
    folder = table(spark, tmp_path, [(1, v, "view") for v in values])
    assert [tuple(r) for r in plans.QUERIES["j1_lighting"](spark, folder).collect()] == [(1, 0, "lighting_variable", 1.0)]
    assert "lighting_variable" in {r["type"] for r in plans.QUERIES["j5_conditions"](spark, folder).collect()}


def test_slope_at_a_limit(spark, tmp_path):
    values = (3.93, 26.01, 37.2, 50.51, 25.69, 24.9, 91.04, 44.3, 0.12, 37.2, 24.69, 125.94, 10.49, 10.07, 42.05, 21.42, 46.76, 7.43)  # falls by 1 / 60 a sample
    folder = table(spark, tmp_path, [(1, v, "view") for v in values])
    assert {r["seq"]: r["trend"] for r in plans.QUERIES["g10_confidence_trend"](spark, folder).collect()}[18] == "STABLE"


def test_drift_at_a_limit(spark, tmp_path):
    folder = table(spark, tmp_path, [(1, v, "view") for v in DRIFT_20])
    got = {r["seq"]: (r["drift"], r["flagged"]) for r in plans.QUERIES["c4_exposure_drift"](spark, folder).collect()}
    assert got[20] == (20.0, False)
