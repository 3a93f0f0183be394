import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitlake.operators import timelines

SERIES = {
    1: [3.0] * 12,
    2: [2.0 * t for t in range(12)],
    3: [math.sin(2 * math.pi * t / 8) for t in range(64)],
    4: [None] * 5,
    5: [1.0, 2.0],
    6: [1.0, None, 4.0, float("inf"), 2.0, 5.0, 3.0, 8.0, 1.0, 0.0, 2.0],
}


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(k, t, v) for k, x in SERIES.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "run_id int, t int, v double").repartition(3)


def by_run(df, *columns):
    return {r["run_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_reducers(obs):
    got = by_run(timelines.aggregate_series(obs, ["run_id"]), "mean", "std", "total", "final", "delta")
    assert got[1] == (3.0, 0.0, 36.0, 3.0, 0.0)
    assert got[2] == pytest.approx((11.0, np.std(SERIES[2]), 132.0, 22.0, 22.0))
    assert got[4] == (None, None, 0.0, None, None)
    assert got[6][0] == math.inf and got[6][3:] == (2.0, 1.0)


def test_constant_and_linear(obs):
    assert by_run(timelines.slope(obs, ["run_id"]), "slope")[2] == (2.0,)
    assert by_run(timelines.plateau(obs, ["run_id"]), "plateau_frac")[1] == (1.0,)
    assert by_run(timelines.plateau(obs, ["run_id"]), "plateau_frac")[2] == (0.0,)
    assert by_run(timelines.iqr(obs, ["run_id"]), "iqr")[1] == (0.0,)
    turns = by_run(timelines.turns(obs, ["run_id"]), "n_reversals", "max_monotone_frac")
    assert turns[2] == (0, 1.0) and turns[5] == (0, 1.0) and 4 not in turns
    assert by_run(timelines.first_minimum(obs, ["run_id"]), "first_min_ac")[1] == (None,)
    assert by_run(timelines.stationarity(obs, ["run_id"]), "stat_delta")[5] == (None,)


def test_period_of_a_sine(obs):
    assert by_run(timelines.period(obs, ["run_id"]), "period")[3] == (8,)


def test_half_shift_counts_the_split_with_the_first_half(obs):
    x = SERIES[2]
    assert by_run(timelines.half_shift(obs, ["run_id"]), "cusum_delta")[2][0] == pytest.approx(np.mean(x[6:]) - np.mean(x[:6]))


def test_autocorrelation_against_numpy(obs):
    x = np.array(SERIES[3])
    c = x - x.mean()
    rows = timelines.values_in_order(obs.filter("run_id = 3"), ["run_id"])
    got = timelines.autocorrelation(rows, F.sequence(F.lit(1), F.lit(10))).first()["ac"]
    assert got == pytest.approx([float(c[:-k] @ c[k:] / (c @ c)) for k in range(1, 11)])


def test_results_do_not_depend_on_row_order(obs):
    a = by_run(timelines.turns(obs.orderBy(F.desc("t")), ["run_id"]), "n_reversals", "max_monotone_frac")
    assert a == by_run(timelines.turns(obs.coalesce(1), ["run_id"]), "n_reversals", "max_monotone_frac")
