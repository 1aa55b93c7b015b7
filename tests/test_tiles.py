"""Alignments in tiles and bands are those of whole series."""

import math
import random

import numpy as np
import pytest

from strandline.kernels import paths
from strandline.operators import leadlag, tiles


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(2)
    values = {s: np.cumsum([r.gauss(0, 1) for _ in range(n)]) for s, n in (("p", 23), ("q", 17), ("r", 8))}
    return spark.createDataFrame([(s, t * 10, float(v)) for s, vs in values.items() for t, v in enumerate(vs)], "s string, t int, v double").repartition(3), values


@pytest.mark.parametrize(("squared", "band"), [(False, None), (True, None), (False, 6)])
def test_dtw(series, squared, band):
    df, values = series
    got = {(x.a, x.b, x.lag): x.score for x in tiles.dtw(df, "s", "t", "v", [-3, 0, 2], squared, band, 5).collect()}
    assert len(got) == 9
    for (a, b, lag), score in got.items():
        assert math.isclose(score, paths.dtw(*leadlag._cut(values[a], values[b], lag), squared, band), rel_tol=1e-12), (a, b, lag)


def test_optimal_path(series):
    df, values = series
    whole = {(x.a, x.b): (x.lag, x.cost) for x in leadlag.optimal_paths(df, "s", "t", "v", 0.7).collect()}
    for tile in (4, 10):
        got = {(x.a, x.b): (x.lag, x.cost) for x in leadlag.optimal_paths(df, "s", "t", "v", 0.7, tile=tile).collect()}
        assert got.keys() == whole.keys() and all(got[k][0] == whole[k][0] and math.isclose(got[k][1], whole[k][1], rel_tol=1e-12) for k in got)


def test_thermal_path(series):
    df, values = series
    rows = tiles.thermal(df, "s", "t", "v", 3.0, 4).collect()
    for a, b in (("p", "q"), ("p", "r"), ("q", "r")):
        average, last = paths.thermal_path(values[a], values[b], 3.0)
        mine = {x.t: x for x in rows if (x.a, x.b) == (a, b)}
        assert len(mine) == len(average) and math.isclose(mine[len(average) - 1].log_final, last, rel_tol=1e-9)
        assert all(math.isclose(mine[t].average, v, rel_tol=1e-9, abs_tol=1e-12) for t, v in enumerate(average))


def test_nothing_to_align(spark):
    empty = spark.createDataFrame([], "s string, t int, v double")
    assert tiles.dtw(empty, "s", "t", "v", [0], tile=4).collect() == tiles.optimal(empty, "s", "t", "v", tile=4).collect() == tiles.thermal(empty, "s", "t", "v", tile=4).collect() == []
