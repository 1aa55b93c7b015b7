"""Portfolio returns, Sharpe ratios, position scaling, confidence and backtest summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import slabs


def confidence(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None, most: float = 2.0) -> DataFrame:
    """df with confidence = 1 - |error| / (greatest |error| + 1e-6), leverage (clipped confidence * most) and adjusted."""
    error = F.abs(F.col(actual) - F.col(predicted))
    top = df.groupBy(*(by or [])).agg(F.max(error).alias("_top"))
    out = df.join(top, by) if by else df.crossJoin(F.broadcast(top))
    out = out.withColumn("confidence", 1 - error / (F.col("_top") + 1e-6)).withColumn("leverage", F.least(F.greatest(F.col("confidence") * most, F.lit(0.0)), F.lit(most)))
    return out.withColumn("adjusted", F.col(predicted) * F.col("leverage")).drop("_top")


def portfolio_returns(weights: DataFrame, returns: DataFrame, date: str, asset: str, weight: str = "weight", ret: str = "ret", cost: float = 0.0002, from_zero: bool = True, parts: int | None = None) -> DataFrame:
    """date, gross, turnover_cost and net: sum of weight * return less cost * sum |weight - weight before|.

    The weight before an asset's first date is 0, or with from_zero False its own first weight.
    """
    both = weights.select(date, asset, weight).join(returns.select(date, asset, ret), [date, asset])
    before = lambda by: F.lag(weight).over(Window.partitionBy(*by).orderBy(date))
    first = F.lit(0.0) if from_zero else F.col(weight)
    both = slabs.in_slabs(both, [asset], [date], lambda d, by: d.withColumn("_b", F.coalesce(before(by), first)), 1, parts=parts)
    out = both.groupBy(date).agg(F.sum(F.col(weight) * F.col(ret)).alias("gross"), (F.sum(F.abs(F.col(weight) - F.col("_b"))) * cost).alias("turnover_cost"))
    return out.withColumn("net", F.col("gross") - F.col("turnover_cost"))


def sharpe(df: DataFrame, ret: str, risk_free: float = 0.0) -> DataFrame:
    """sharpe: mean excess over the sample deviation + 1e-6."""
    return df.agg(((F.avg(ret) - risk_free) / (F.stddev_samp(ret) + 1e-6)).alias("sharpe"))


def backtest_summary(df: DataFrame, ret: str, by: list[str] | None = None, periods: int = 252) -> DataFrame:
    """by, n, cumulative (product of 1 + r, less 1) and annualised Sharpe with the population deviation + 1e-6.

    The product is a sum of logarithms of |1 + r| with its sign, so it combines on the map side; it is 0 if any factor is.
    """
    f = 1 + F.col(ret)
    logs = F.sum(F.when(f != 0, F.log(F.abs(F.when(f != 0, f)))))
    sign = F.when(F.count_if(f == 0) > 0, 0.0).otherwise(F.when(F.count_if(f < 0) % 2 == 0, 1.0).otherwise(-1.0))
    aggs = [F.count(ret).alias("n"), (sign * F.exp(F.coalesce(logs, F.lit(0.0))) - 1).alias("cumulative"), (F.avg(ret) / (F.stddev_pop(ret) + 1e-6) * F.sqrt(F.lit(float(periods)))).alias("annual_sharpe")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def rolling_sharpe(df: DataFrame, keys: list[str], order: list[str], ret: str, window: int = 20, target: float = 1.0, parts: int | None = None) -> DataFrame:
    """df with rolling_sharpe over the `window` rows before this one (sample deviation) and time_to_target = max(0, (target - sharpe) * window).

    Rows with fewer rows before them have 0 for both.  Series too long for a task are cut (slabs.parts_for).
    """

    def rolled(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-window, -1)
        return d.withColumn("_full", F.count(ret).over(w) >= window).withColumn("rolling_sharpe", F.when(F.col("_full"), F.avg(ret).over(w) / (F.stddev_samp(ret).over(w) + 1e-6)).otherwise(0.0))

    out = slabs.in_slabs(df, keys, order, rolled, window, parts=parts)
    return out.withColumn("time_to_target", F.when(F.col("_full"), F.greatest(F.lit(0.0), (F.lit(target) - F.col("rolling_sharpe")) * window)).otherwise(0.0)).drop("_full")


def scale_positions(df: DataFrame, weight: str, time_to_target: str = "time_to_target", factor: float = 0.1) -> DataFrame:
    """df with scaled_weight = weight * (1 - factor * sigmoid(time to target))."""
    return df.withColumn("scaled_weight", F.col(weight) * (1 - factor / (1 + F.exp(-F.col(time_to_target)))))
