"""Order-event tables: encoding, masking, correction, resampling and the overall score of a generated table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import happens
from . import compare
from .signature import signature, signature_distance

FLAGS = ("add", "modify", "delete")


def encode(df: DataFrame, symbols: list[str], seconds: str = "time_s") -> DataFrame:
    """df with vector: seconds, a slot for each symbol, quantity, price, side (buy = 1), add, modify, delete."""
    d = lambda c: c.cast("double")
    slots = [d(F.coalesce(F.col("symbol") == s, F.lit(False))) for s in symbols]
    return df.withColumn("vector", F.array(d(F.col(seconds)), *slots, d(F.col("quantity")), d(F.col("price")), d(F.coalesce(F.col("side") == "buy", F.lit(False))), *(d(F.col(f)) for f in FLAGS)))


def decode(df: DataFrame, symbols: list[str], vector: str = "vector") -> DataFrame:
    """df with d_time_s, d_symbol (the greatest slot, the first of equal ones), d_quantity, d_price, d_side and flags at 0.5."""
    v, n = F.col(vector), len(symbols)
    slots = F.slice(v, 2, n)
    out = df.withColumn("d_time_s", F.round(v[0]).cast("long")).withColumn("d_symbol", F.element_at(F.array(*map(F.lit, symbols)), F.array_position(slots, F.array_max(slots)).cast("int")))
    out = out.withColumn("d_quantity", F.round(v[n + 1]).cast("long")).withColumn("d_price", v[n + 2]).withColumn("d_side", F.when(v[n + 3] > 0.5, "buy").otherwise("sell"))
    for k, f in enumerate(FLAGS):
        out = out.withColumn(f"d_{f}", (v[n + 4 + k] > 0.5).cast("int"))
    return out


def mask_fields(df: DataFrame, key: str, ids: dict[str, int], numbers: list[str], p: float = 0.15, seed: int = 1) -> DataFrame:
    """<field>_masked and <field>_target: with probability p a field of a row is masked, the same ones at every run.

    ids: fields with ids and their mask id; a masked id becomes it and its target is the id, an unmasked one has target -100.
    numbers become 0 when masked, their target is the number, or 0 when not masked.
    """
    for f, mask in ids.items():
        hit = F.pmod(F.xxhash64(F.lit(seed), F.lit(f), F.col(key)), F.lit(1_000_000)) < int(p * 1_000_000)
        df = df.withColumn(f"{f}_masked", F.when(hit, F.lit(mask)).otherwise(F.col(f))).withColumn(f"{f}_target", F.when(hit, F.col(f)).otherwise(F.lit(-100)))
    for f in numbers:
        hit = F.pmod(F.xxhash64(F.lit(seed), F.lit(f), F.col(key)), F.lit(1_000_000)) < int(p * 1_000_000)
        df = df.withColumn(f"{f}_masked", F.when(hit, F.lit(0.0)).otherwise(F.col(f))).withColumn(f"{f}_target", F.when(hit, F.col(f)).otherwise(F.lit(0.0)))
    return df


def correct_sides(orders: DataFrame, original: DataFrame, key: str, margin: float = 0.05, p: float = 0.8, seed: int = 1) -> DataFrame:
    """side pulled to the symbol's mean price of the original table: below it by margin buys, above sells, each with probability p."""
    mean = original.groupBy("symbol").agg(F.avg("price").alias("_mean"))
    out = orders.join(mean, "symbol", "left")
    hit = happens(p, seed, key)
    side = F.when(hit & (F.col("price") < F.col("_mean") * (1 - margin)), "buy").when(hit & (F.col("price") > F.col("_mean") * (1 + margin)), "sell").otherwise(F.col("side"))
    return out.withColumn("side", side).drop("_mean")


def overall_score(real: DataFrame, made: DataFrame, order: list[str], side_lag: int = 5, level: int = 2) -> DataFrame:
    """One row: w_quantity, w_price, tv_symbol, tv_side, signature_l2, side_lag and overall, their sum.

    Tables have symbol, quantity, price, side, time_s and the order columns.  side_lag is |persistence difference|.
    """
    w = compare.wasserstein(real, made, ["quantity", "price"]).agg(*(F.max(F.when(F.col("column_name") == c, F.col("distance"))).alias(f"w_{c}") for c in ("quantity", "price")))
    tv = [compare.tv_distance(real, made, c).withColumnRenamed("tv", f"tv_{c}") for c in ("symbol", "side")]
    channels = ["time_s", "quantity", "price"]
    sig = signature_distance(signature(real, [], order, channels, level), signature(made, [], order, channels, level), []).withColumnRenamed("distance", "signature_l2")
    lag = compare.persistence(real, ["symbol"], order, "side", side_lag).withColumnRenamed("persistence", "a").crossJoin(compare.persistence(made, ["symbol"], order, "side", side_lag).withColumnRenamed("persistence", "b")).select(F.abs(F.col("a") - F.col("b")).alias("side_lag"))
    out = w.crossJoin(tv[0]).crossJoin(tv[1]).crossJoin(sig).crossJoin(lag)
    return out.withColumn("overall", sum((F.col(c) for c in ("w_price", "tv_symbol", "tv_side", "signature_l2", "side_lag")), F.col("w_quantity")))


def best_parameters(scores: DataFrame, by: list[str], parameter: list[str], score: str = "overall") -> DataFrame:
    """by, the parameters of the least score (the first of equal ones) and the score."""
    best = F.min(F.struct(score, *parameter))
    out = (scores.groupBy(*by).agg(best.alias("b")) if by else scores.agg(best.alias("b")))
    return out.select(*by, *(f"b.{c}" for c in parameter), f"b.{score}")


def _pick(n_source: Column, seed: int, name: str, row: Column) -> Column:
    """A row number of the source, uniform and the same at every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), row), n_source)


def resample_rows(df: DataFrame, order: list[str], n: int, seed: int = 999, step: int = 1) -> DataFrame:
    """n rows of df drawn with replacement, each with a new time `time`: 0, step, 2 step, ...

    Drawing a group by its share and then one of its rows is drawing a row.  Source rows are numbered along order.
    """
    from .windows import with_row_number

    indexed = with_row_number(df, order, out="_k")
    size = df.agg(F.count("*").alias("_n"))
    drawn = df.sparkSession.range(n).crossJoin(F.broadcast(size)).where("_n > 0").select((F.col("id") * step).alias("time"), _pick(F.col("_n"), seed, "row", F.col("id")).alias("_k"))
    return drawn.join(indexed, "_k").drop("_k")


def resample_marginals(df: DataFrame, order: list[str], n: int, gaussian: list[str], groups: list[list[str]], seed: int = 999) -> DataFrame:
    """id and n rows whose column groups are drawn independently; gaussian columns from a normal with the source's mean and sample deviation."""
    from .windows import with_row_number

    columns = [c for g in groups for c in g]
    indexed = with_row_number(df.select(*dict.fromkeys([*order, *columns])), order, out="_k")
    stats = df.agg(F.count("*").alias("_n"), *(f(c).alias(f"_{a}_{c}") for c in gaussian for a, f in (("m", F.avg), ("s", F.stddev_samp))))
    out = df.sparkSession.range(n).crossJoin(F.broadcast(stats)).where("_n > 0")
    for c in gaussian:  # Box and Muller from two hashes
        u, v = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(f"{c}{x}"), F.col("id")), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1)) for x in "uv")
        out = out.withColumn(c, F.col(f"_m_{c}") + F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) * F.sqrt(-2 * F.log(u)) * F.cos(v * F.lit(6.283185307179586)))
    for k, g in enumerate(groups):
        out = out.withColumn("_k", _pick(F.col("_n"), seed, f"group{k}", F.col("id"))).join(indexed.select("_k", *g), "_k").drop("_k")
    return out.select("id", *gaussian, *columns)
