"""Row numbers, window membership, grids, samples and rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import known


def ranged(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df with _range: 0, 1, 2, ... ascending along all of `order`, in about equal shares; equal rows share a range.

    Cuts come from the rows with the least hashes, 16 for each part, so a hot first column is cut by the next one.  Any
    cuts are right ones; reruns on the same rows give the same.  parts: 64, or as many as the session's shuffle partitions, at most 4,096.
    """
    parts = parts or min(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 4096)
    types = [df.schema[c].dataType for c in order]
    sample = df.select(*order).orderBy(F.xxhash64(*order)).limit(16 * parts).orderBy(*order).collect()
    step = max(len(sample) / parts, 1)
    cuts = list(dict.fromkeys(sample[int(k * step)] for k in range(1, parts) if int(k * step) < len(sample)))
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    # in two steps, so that a row is compared with about 2 * sqrt(parts) cuts
    width = max(int(len(cuts) ** 0.5), 1)
    point = lambda row: F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in zip(order, row, types, strict=True)))
    own = F.struct(*order)
    blocks = F.array(*(F.array(*map(point, cuts[k : k + width])) for k in range(0, len(cuts), width)))
    over = F.size(F.filter(blocks, lambda b: b[0] < own))  # blocks that start before the row: all cuts of all but the last lie before it
    rest = F.size(F.filter(F.get(blocks, over - 1), lambda c: c < own))
    return df.withColumn("_range", F.when(over == 0, 0).otherwise((over - 1) * width + rest))


def _before(rows: DataFrame, amount: Column) -> DataFrame:
    """_range and _before: what the ranges before it hold; a row for each range."""
    sums = rows.groupBy("_range").agg(F.sum(amount).alias("_n"))
    return F.broadcast(sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before")))


def with_row_number(df: DataFrame, order: list[str], keys: list[str] | None = None, out: str = "idx", parts: int | None = None) -> DataFrame:
    """out: 0, 1, 2, ... along order, per key or over the whole table.

    Without keys the rows are cut into ranges (see ranged), ranges are counted, and rows are numbered within their range
    from its offset, so that no task gets the whole table.
    """
    if keys:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    kind = dict(df.dtypes)[order[0]]
    if kind.startswith(("timestamp", "date", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        # numbers and times: cuts at approximate quantiles of the first column, a short plan
        lead, n = F.col(order[0]), parts or 64
        number = (F.unix_micros(lead.cast("timestamp")) if kind.startswith(("timestamp", "date")) else lead).cast("double")
        found = df.agg(F.percentile_approx(number, [k / n for k in range(1, n)], 1000).alias("q")).first()["q"] or []
        cuts = sorted(set(found))
        # a value that holds more than one quantile would fill a range: then cuts along all columns
        short = len(order) == 1 or len(cuts) == len(found)
        rows = df.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q < number)) if cuts else F.lit(0)) if short else ranged(df, order, parts)
    else:
        rows = ranged(df, order, parts)
    rows = rows.join(_before(rows, F.lit(1).cast("long")), "_range")
    return rows.withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).drop("_range", "_before")


def running_total(df: DataFrame, order: list[str], value: str, out: str = "total") -> DataFrame:
    """out: the sum of value from the first row of the table, along order, to this one; summed in ranges, like row numbers."""
    rows = ranged(df, order)
    rows = rows.join(_before(rows, F.col(value)), "_range")
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.col("_before") + within).drop("_range", "_before")


def window_ids(idx: str | Column, size: int, stride: int, n_rows: Column | int) -> Column:
    """All w with w * stride <= idx < w * stride + size, of the full windows over n_rows rows; an empty array if none."""
    i = F.col(idx) if isinstance(idx, str) else idx
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    last = F.least(F.floor((n - size) / stride), F.floor(i / stride)).cast("long")
    first = F.greatest(F.lit(0), F.ceil((i - size + 1) / stride)).cast("long")
    return F.when((first <= last) & (n >= size), F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<long>"))


def assign_windows(df: DataFrame, idx: str, size: int, stride: int, n_rows: int) -> DataFrame:
    """A row for each window that a row belongs to."""
    return df.withColumn("window_id", F.explode(window_ids(idx, size, stride, n_rows)))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10, out: str = "smooth", parts: int | None = None) -> DataFrame:
    """Mean of the known values among the last n rows; with none, the last result before.  Series too long for a task are cut (slabs.parts_for)."""
    from . import slabs

    parts = slabs.parts_for(df, keys, parts)
    back = lambda by: Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    mean = slabs.in_slabs(df, keys, order, lambda d, by: d.withColumn(out, F.avg(known(value)).over(back(by))), n - 1, parts=parts)
    return slabs.carried(mean, keys, order, out, parts)


def densify(df: DataFrame, keys: list[str], idx: str, value: str, fill: float = 0.0) -> DataFrame:
    """Each key's integer index filled from its least to its greatest; new and missing values are fill."""
    ends = df.groupBy(*keys).agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"))
    grid = ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(idx))
    return grid.join(df.select(*keys, idx, value), [*keys, idx], "left").withColumn(value, F.coalesce(known(value), F.lit(fill)))


def resample(df: DataFrame, keys: list[str], ms: str, value: str, step: int = 1, base: int | None = None, fill: float = 0.0, tie: tuple[str, ...] = ()) -> DataFrame:
    """keys, slot, value on a regular grid of `step` ms: the last value of a slot, carried forward, leading slots `fill`.

    Of rows of one ms the last by the columns of tie counts, or the greatest value.  slot 0 starts at base, or at the table's first ms; each key's grid ends at the last slot of the table.
    """
    ends = df.agg(F.min(ms).alias("_first"), F.max(ms).alias("_last"))
    zero = F.lit(base).cast("long") if base is not None else F.col("_first")
    rows = df.crossJoin(F.broadcast(ends)).withColumn("slot", F.floor((F.col(ms) - zero) / step).cast("long"))
    last = rows.groupBy(*keys, "slot").agg(F.max_by(value, F.struct(ms, *(tie or (value,)))).alias(value), F.first("_last").alias("_last"), F.first("_first").alias("_first"))
    grid = last.groupBy(*keys).agg(F.max("_last").alias("_l"), F.max("_first").alias("_f")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_l") - (F.lit(base).cast("long") if base is not None else F.col("_f"))) / step).cast("long"))).alias("slot"))
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(last.select(*keys, "slot", value), [*keys, "slot"], "left")
    return out.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(fill)))


def chunk_ids(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """chunk_id and chunk_row: fixed-size chunks along order; the last, short one is kept."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("chunk_row", n).withColumn("chunk_id", F.floor(F.col("chunk_row") / size).cast("long")).withColumn("chunk_row", F.pmod("chunk_row", F.lit(size)))


def counter(df: DataFrame, keys: list[str], order: list[str], out: str = "time_idx") -> DataFrame:
    """0, 1, 2, ... within each key."""
    return with_row_number(df, order, keys, out)


def make_windows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], size: int, horizon: int, target: str, parts: int | None = None) -> DataFrame:
    """keys, order, x (array of `size` structs, oldest first) and y (the target horizon rows on); full windows with a target only."""
    from . import slabs

    def sampled(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        x = F.collect_list(F.struct(*columns)).over(w.rowsBetween(-(size - 1), 0))
        return d.withColumn("_x", x).withColumn("_y", F.lead(target, horizon).over(w)).withColumn("_ahead", F.lead(F.lit(1), horizon).over(w))

    out = slabs.in_slabs(df, keys, order, sampled, size - 1, horizon, parts)
    return out.where((F.size("_x") == size) & F.col("_ahead").isNotNull()).select(*keys, *order, F.col("_x").alias("x"), F.col("_y").alias("y"))


def forward_context(df: DataFrame, keys: list[str], order: list[str], value: str, length: int, pad: float = 0.0, parts: int | None = None) -> DataFrame:
    """context: the values of this and the following rows, up to `length`, padded; context_length: how many are real."""
    from . import slabs

    ahead = lambda by: Window.partitionBy(*by).orderBy(*order).rowsBetween(0, length - 1)
    out = slabs.in_slabs(df, keys, order, lambda d, by: d.withColumn("context", F.collect_list(F.coalesce(known(value), F.lit(pad))).over(ahead(by))), after=length - 1, parts=parts)
    out = out.withColumn("context_length", F.size("context"))
    return out.withColumn("context", F.concat("context", F.array_repeat(F.lit(pad), F.lit(length) - F.col("context_length"))))


def lead_lag_embedding(df: DataFrame, keys: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """lag1: the value of the row before, the own value at the start."""
    from . import slabs

    before = lambda by: F.lag(value, 1).over(Window.partitionBy(*by).orderBy(*order))
    return slabs.in_slabs(df, keys, order, lambda d, by: d.withColumn("lag1", F.coalesce(before(by), F.col(value))), 1, parts=parts)


def shifted(df: DataFrame, keys: list[str], order: list[str], value: str, k: int, out: str = "shifted", parts: int | None = None) -> DataFrame:
    """The value k rows before (behind, if negative), 0 beyond the ends."""
    from . import slabs

    def moved(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return d.withColumn(out, F.lag(value, k, 0.0).over(w) if k >= 0 else F.lead(value, -k, 0.0).over(w))

    return slabs.in_slabs(df, keys, order, moved, max(k, 0), max(-k, 0), parts)


def local_derivative(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, parts: int | None = None) -> DataFrame:
    """slope: dy / dx to the next row (NULL where x stays) and remainder: y next - (y + slope * dx); the last row is dropped."""
    from . import slabs

    def stepped(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return d.withColumn("_dx", F.lead(x).over(w) - F.col(x)).withColumn("_y1", F.lead(y).over(w))

    out = slabs.in_slabs(df, keys, order, stepped, after=1, parts=parts).where("_y1 IS NOT NULL AND _dx IS NOT NULL")
    out = out.withColumn("slope", F.try_divide(F.col("_y1") - F.col(y), F.col("_dx")))
    return out.withColumn("remainder", F.col("_y1") - (F.col(y) + F.col("slope") * F.col("_dx"))).drop("_dx", "_y1")


def time_split(df: DataFrame, idx: str, horizon: int | None = None, ratio: float | None = None) -> DataFrame:
    """part: 'train' or 'validation' by a time index: all but the last `horizon` steps, or the first `ratio` of the distinct steps."""
    ends = df.agg(F.max(idx).alias("_hi"), F.min(idx).alias("_lo"))
    cut = F.col("_hi") - horizon if horizon is not None else F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo") + 1) * F.lit(ratio)) - 1
    return df.crossJoin(F.broadcast(ends)).withColumn("part", F.when(F.col(idx) <= cut, "train").otherwise("validation")).drop("_hi", "_lo")


def walk_forward(df: DataFrame, idx: str, train: int, test: int, first: int, last: int) -> DataFrame:
    """A row for each fold and part: fold k trains on `train` steps from first + k * test on and tests on the `test` after them."""
    folds = max(0, (last - first + 1 - train) // test)
    place = F.col(idx) - first
    # only the folds that hold the row: fold * test <= place < fold * test + train + test
    low = F.greatest(F.ceil((place - train - test + 1) / test), F.lit(0)).cast("int")
    high = F.least(F.floor(place / test), F.lit(folds - 1)).cast("int")
    out = df.withColumn("fold", F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))))
    at = place - F.col("fold") * test
    return out.withColumn("part", F.when((at >= 0) & (at < train), "train").when((at >= train) & (at < train + test), "test")).where("part IS NOT NULL")
