"""Lead-lag between pairs of series.  A positive lag always means that the first series leads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import paths
from . import tiles


def series_pairs(df: DataFrame, series: str, order: str, value: str, pairs: DataFrame | None = None) -> DataFrame:
    """a, b, order, x, y: values of each unordered pair of series at their common times; pairs (a, b) restricts them."""
    x = df.select(F.col(series).alias("a"), order, F.col(value).alias("x"))
    y = df.select(F.col(series).alias("b"), order, F.col(value).alias("y"))
    if pairs is not None:
        x = x.join(pairs.select("a", "b"), "a")
        return x.join(y, ["b", order]).select("a", "b", order, "x", "y")
    return x.join(y, order).where("a < b").select("a", "b", order, "x", "y")


def lagged_pairs(df: DataFrame, series: str, idx: str, value: str, lags: list[int], pairs: DataFrame | None = None) -> DataFrame:
    """a, b, lag, idx, x, y: x at idx next to y at idx + lag, an equal join for all lags at once."""
    x = df.select(F.col(series).alias("a"), F.col(idx).alias("i"), F.col(value).alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    y = df.select(F.col(series).alias("b"), F.col(idx).alias("j"), F.col(value).alias("y"))
    both = x.join(y, "j").where("a < b") if pairs is None else x.join(pairs.select("a", "b"), "a").join(y, ["b", "j"])
    return both.select("a", "b", "lag", F.col("i").alias(idx), "x", "y")


def lagged_correlation(df: DataFrame, series: str, idx: str, value: str, lags: list[int], pairs: DataFrame | None = None, raw: bool = False) -> DataFrame:
    """a, b, lag, n, score: Pearson correlation of x(t) and y(t + lag), or with raw the plain sum of products."""
    rows = lagged_pairs(df, series, idx, value, lags, pairs)
    score = F.sum(F.col("x") * F.col("y")) if raw else F.corr("x", "y")
    return rows.groupBy("a", "b", "lag").agg(F.count("*").alias("n"), score.alias("score"))


def best_lag(scores: DataFrame, how: str = "absolute") -> DataFrame:
    """a, b, lag, score: the greatest |score|, greatest or least score; the first lag in ascending order wins ties."""
    key = {"absolute": -F.abs("score"), "greatest": -F.col("score"), "least": F.col("score")}[how]
    best = scores.where("score IS NOT NULL").groupBy("a", "b").agg(F.min(F.struct(key.alias("k"), "lag", "score")).alias("m"))
    return best.select("a", "b", "m.lag", "m.score")


def signature_lags(df: DataFrame, series: str, idx: str, value: str, lags: list[int], standardise: bool = False) -> DataFrame:
    """a, b, lag, score: norm of the level-2 signature, leading 1 included, of the path (x(t), y(t + lag)) over t."""
    from .signature import signature

    if standardise:
        w = Window.partitionBy(series)
        df = df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))
    rows = lagged_pairs(df, series, idx, value, lags)
    terms = signature(rows, ["a", "b", "lag"], [idx], ["x", "y"], 2)
    return terms.groupBy("a", "b", "lag").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("score"))


def _aligned(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """a, b, x, y: both series of a pair as arrays along order, each of its own times.

    Pairs are made of names alone; arrays come to them by equal joins.
    """
    one = df.groupBy(series).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda r: r[value].cast("double")).alias("v"))
    names = df.select(F.col(series).alias("a")).distinct()
    pairs = names.join(names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))
    return pairs.join(one.select(F.col(series).alias("a"), F.col("v").alias("x")), "a").join(one.select(F.col(series).alias("b"), F.col("v").alias("y")), "b")


def _each_lag(rows: DataFrame, lags: list[int], scores: Column) -> DataFrame:
    """a, b, lag, score from an array of scores in the order of lags."""
    names = F.array(*map(F.lit, lags))
    return rows.select("a", "b", F.posexplode(scores).alias("_k", "score")).select("a", "b", F.element_at(names, F.col("_k") + 1).alias("lag"), "score")


def _cut(x: np.ndarray, y: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """x(t) next to y(t + lag)."""
    return (x[: len(x) - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[: len(y) + lag])


def _level(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(x), len(y))
    return x[:n], y[:n]


def dtw_lags(df: DataFrame, series: str, order: str, value: str, lags: list[int], squared: bool = False, band: int | None = None, tile: int = tiles.TILE) -> DataFrame:
    """a, b, lag, score: exact dynamic time warping distance of the series shifted by lag.  Series of more than `tile` rows are aligned in tiles."""
    if tiles.longest(df, series) > tile:
        return tiles.dtw(df, series, order, value, lags, squared, band, tile)

    @F.pandas_udf("array<double>")
    def distances(x: pd.Series, y: pd.Series) -> pd.Series:
        both = [(np.array(a, float), np.array(b, float)) for a, b in zip(x, y, strict=True)]
        return pd.Series([[paths.dtw(*_cut(a, b, k), squared, band) for k in lags] for a, b in both])

    return _each_lag(_aligned(df, series, order, value), lags, distances("x", "y"))


def dtw_distance(df: DataFrame, series: str, order: str, value: str, squared: bool = False, band: int | None = None) -> DataFrame:
    return dtw_lags(df, series, order, value, [0], squared, band).select("a", "b", F.col("score").alias("distance"))


def optimal_paths(df: DataFrame, series: str, order: str, value: str, beta: float = 1.0, most: int | None = None, tile: int = tiles.TILE) -> DataFrame:
    """a, b, lag, cost: rounded mean of j - i along the optimal path, clamped to most.  Series of more than `tile` rows go in bands."""
    if tiles.longest(df, series) > tile:
        lag = F.rint("mean_step").cast("long")
        lag = lag if most is None else F.greatest(F.least(lag, F.lit(most)), F.lit(-most)).cast("long")
        return tiles.optimal(df, series, order, value, beta, tile).select("a", "b", lag.alias("lag"), "cost")

    @F.pandas_udf("struct<lag:long,cost:double>")
    def path(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(x, y, strict=True):
            j, cost = paths.optimal_path(np.array(a, float), np.array(b, float), beta)
            lag = int(np.round((j - np.arange(len(j))).mean()))
            out.append((lag if most is None else int(np.clip(lag, -most, most)), cost))
        return pd.DataFrame(out, columns=["lag", "cost"])

    return _aligned(df, series, order, value).select("a", "b", path("x", "y").alias("p")).select("a", "b", "p.*")


def thermal_paths(df: DataFrame, series: str, order: str, value: str, temperature: float = 1.0) -> DataFrame:
    """a, b, average_path (mean of b - a per anti-diagonal) and log_final, over the first rows that both series have.

    A pair is a task's row here; tiles.thermal() has a row for each diagonal, for series of any length.
    """

    @F.pandas_udf("struct<average_path:array<double>,log_final:double>")
    def path(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = [paths.thermal_path(np.array(a, float), np.array(b, float), temperature) for a, b in zip(x, y, strict=True)]
        return pd.DataFrame({"average_path": [p for p, _ in out], "log_final": [f for _, f in out]})

    return _aligned(df, series, order, value).select("a", "b", path("x", "y").alias("p")).select("a", "b", "p.*")


def wavelet_energy(df: DataFrame, keys: list[str], order: str, value: str, scales: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """keys, scale, energy: sums of absolute Morlet coefficients of each series or chunk."""
    one = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda r: r[value].cast("double")).alias("v"))

    @F.pandas_udf("array<double>")
    def energy(values: pd.Series) -> pd.Series:
        return pd.Series([paths.morlet_energy(np.array(v, float), scales) for v in values])

    names = F.array(*map(F.lit, scales))
    return one.select(*keys, F.posexplode(energy("v")).alias("k", "energy")).select(*keys, F.element_at(names, F.col("k") + 1).alias("scale"), "energy")


def feature_lags(df: DataFrame, series: str, order: str, value: str, lags: list[int], feature: str = "wavelet", level: int = 2) -> DataFrame:
    """a, b, lag, score: correlation of the feature vectors (wavelet energies, or signature of (place, value)) of the shifted series."""

    def vector(v: np.ndarray) -> np.ndarray:
        return paths.morlet_energy(v) if feature == "wavelet" else paths.signature(np.stack([np.arange(len(v)) / max(len(v) - 1, 1), v], axis=1), level)[1:]

    def score(a: np.ndarray, b: np.ndarray, lag: int) -> float | None:
        p, q = _level(*_cut(a, b, lag))
        p, q = (vector(p), vector(q)) if len(p) > 1 else (np.zeros(2), np.zeros(2))
        return float(np.corrcoef(p, q)[0, 1]) if p.std() > 0 and q.std() > 0 else None

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        both = [(np.array(a, float), np.array(b, float)) for a, b in zip(x, y, strict=True)]
        return pd.Series([[score(a, b, k) for k in lags] for a, b in both])

    return _each_lag(_aligned(df, series, order, value), lags, scores("x", "y"))


def all_methods(df: DataFrame, series: str, idx: str, value: str, most: int = 20, beta: float = 1.0) -> DataFrame:
    """a, b and the lag of each method: correlation, signature, dtw, path; series share their times idx = 0, 1, 2, ...

    One pass over the pairs: all methods read the same two arrays.  Ties and missing scores are those of best_lag().
    """
    lags = list(range(-most, most + 1))

    def correlation(x: np.ndarray, y: np.ndarray) -> float:
        return -abs(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and x.std() > 0 and y.std() > 0 else np.nan

    def norm(x: np.ndarray, y: np.ndarray) -> float:
        return -float(np.sqrt((paths.signature(np.stack([x, y], axis=1), 2) ** 2).sum())) if len(x) else np.nan

    def best(a: np.ndarray, b: np.ndarray, score) -> int | None:
        scores = np.array([score(*_level(*_cut(a, b, k))) for k in lags])
        return None if np.isnan(scores).all() else lags[int(np.nanargmin(scores))]

    @F.pandas_udf("struct<correlation_lag:long,signature_lag:long,dtw_lag:long,path_lag:long>")
    def found(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in ((np.array(a, float), np.array(b, float)) for a, b in zip(x, y, strict=True)):
            j, _ = paths.optimal_path(a, b, beta)
            path = int(np.clip(np.round((j - np.arange(len(j))).mean()), -most, most))
            out.append((best(a, b, correlation), best(a, b, norm), best(a, b, paths.dtw), path))
        return pd.DataFrame(out, columns=["correlation_lag", "signature_lag", "dtw_lag", "path_lag"]).astype("Int64")

    return _aligned(df, series, idx, value).select("a", "b", found("x", "y").alias("r")).select("a", "b", "r.*")
