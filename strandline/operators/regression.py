"""Sliding-window regression on Gram matrices, with rules, discovery, layers and scores.

Rows are (idx, features, output keys, y).  Each row is aggregated once, into the Gram sums of its block of
gcd(size, stride) rows; windows are sums of blocks.  Solving works on one small row per (window, output).
"""

from __future__ import annotations

from itertools import accumulate
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import solvers
from ..sources import kept
from . import slabs
from .smoothing import affine_scan
from .windows import window_ids

RULE = "array<struct<kind:string,feature:int,feature2:int,value:double>>"


def _sums(x: list[str], y: str, weight: str | None = None) -> list[Column]:
    p = len(x)
    c = [F.col(k) for k in x]
    v = [F.col(weight) * k for k in c] if weight else c
    t = F.col(weight) * F.col(y) if weight else F.col(y)
    return [
        F.array(*(F.sum(v[i] * c[j]) for i in range(p) for j in range(i, p))).alias("xx"),
        F.array(*(F.sum(c[i] * t) for i in range(p))).alias("xy"),
        F.array(*(F.sum(v[i]) for i in range(p))).alias("sx"),
        F.sum(t * F.col(y)).alias("yy"),
        F.sum(t).alias("sy"),
        F.count(y).alias("n"),
    ]


def grams(df: DataFrame, keys: list[str], x: list[str], y: str, weight: str | None = None) -> DataFrame:
    """keys, xx (upper triangle by rows), xy, sx, yy, sy, n of the rows in which nothing is NULL, each with its weight."""
    rows = df.dropna(subset=[*x, y])
    return rows.groupBy(*keys).agg(*_sums(x, y, weight)) if keys else rows.agg(*_sums(x, y, weight)).where("n > 0")


def _added(df: DataFrame, keys: list[str], p: int) -> DataFrame:
    sizes = {"xx": p * (p + 1) // 2, "xy": p, "sx": p}
    sums = [F.array(*(F.sum(F.col(c)[k]) for k in range(n))).alias(c) for c, n in sizes.items()]
    return df.groupBy(*keys).agg(*sums, *(F.sum(c).alias(c) for c in ("yy", "sy", "n")))


def window_grams(df: DataFrame, idx: str, size: int, stride: int, n_rows: int, x: list[str], y: str, keys: list[str]) -> DataFrame:
    """Grams of each full window of `size` rows, for each output (keys): window_id, keys and the columns of grams()."""
    g = gcd(size, stride)
    blocks = grams(df.withColumn("_b", F.floor(F.col(idx) / g).cast("long")), [*keys, "_b"], x, y)
    # a block belongs to the windows of its first row
    spread = blocks.withColumn("window_id", F.explode(window_ids(F.col("_b") * g, size, stride, n_rows)))
    return _added(spread, ["window_id", *keys], len(x))


def shared_grams(x_rows: DataFrame, y_rows: DataFrame, idx: str, size: int, stride: int, n_rows: int, x: list[str], y: str, keys: list[str]) -> DataFrame:
    """window_grams() of y_rows (idx, keys, y) on x_rows (one row of features for each idx), for many outputs of the same features.

    The features' own sums are made once for each block, not once for each output, which adds its sums with them only.  Every
    output must have all rows of its windows that have features: one that lacks some fails the job (window_grams takes those).
    """
    g, p = gcd(size, stride), len(x)
    block = lambda d: d.withColumn("_b", F.floor(F.col(idx) / g).cast("long"))
    spread = lambda d: d.withColumn("window_id", F.explode(window_ids(F.col("_b") * g, size, stride, n_rows)))
    features = block(x_rows.dropna(subset=x).select(idx, *(F.col(c).cast("double").alias(c) for c in x)))
    rows = y_rows.dropna(subset=[y]).select(idx, *keys, F.col(y).cast("double").alias(y)).join(features, idx)
    own = [F.sum(F.col(c) * F.col(y)).alias(f"_xy{k}") for k, c in enumerate(x)]
    sums = [*(f"_xy{k}" for k in range(p)), "yy", "sy", "n"]
    outputs = rows.groupBy("_b", *keys).agg(*own, F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sy"), F.count(y).alias("n"))
    outputs = spread(outputs).groupBy("window_id", *keys).agg(*(F.sum(c).alias(c) for c in sums))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    alike = features.groupBy("_b").agg(*(F.sum(F.col(x[i]) * F.col(x[j])).alias(f"_g{k}") for k, (i, j) in enumerate(pairs)), *(F.sum(c).alias(f"_s{k}") for k, c in enumerate(x)), F.count("*").alias("_nx"))
    names = [*(f"_g{k}" for k in range(len(pairs))), *(f"_s{k}" for k in range(p))]
    alike = spread(alike).groupBy("window_id").agg(*(F.sum(c).alias(c) for c in (*names, "_nx")))
    both = outputs.join(alike, "window_id")
    pack = lambda d: d.select("window_id", *keys, F.array(*names[: len(pairs)]).alias("xx"), F.array(*(f"_xy{k}" for k in range(p))).alias("xy"), F.array(*names[len(pairs) :]).alias("sx"), "yy", "sy", "n")
    whole = F.when(F.col("n") == F.col("_nx"), F.col("n")).otherwise(F.raise_error(F.lit("an output lacks rows that have features: use window_grams")))
    return pack(both.withColumn("n", whole))


def full_gram(xx: np.ndarray, p: int) -> np.ndarray:
    """Stacked upper triangles as full matrices."""
    out = np.zeros((*xx.shape[:-1], p, p))
    i, j = np.triu_indices(p)
    out[..., i, j] = xx
    out[..., j, i] = xx
    return out


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def solve(grams_: DataFrame, p: int, method: str = "ols", reg: float = 1e-6, rules: DataFrame | None = None, keys: list[str] | None = None, **options) -> DataFrame:
    """grams_ with w, an array of p coefficients.

    method: 'ols' ignores rules; 'kkt' holds fixed, zero and offset rules exactly; 'penalty' nearly; 'qp' also takes
    'nonneg', 'nonpos' and 'total' rules and, in options, l1 (weight of sum |w|), norm (bound of sum |w|), zero_below, and
    on_conflict='ols' (a plain fit where rules contradict each other, instead of an error).  rules: keys (all of a window's outputs of these keys), kind,
    feature, feature2, value; 'kkt' and 'penalty' reject the kinds that they can't hold.
    """
    if method not in ("ols", "kkt", "penalty", "qp"):
        raise ValueError("method is ols, kkt, penalty or qp")
    if rules is not None:
        each = F.collect_set(F.struct("kind", F.col("feature").cast("int").alias("feature"), F.col("feature2").cast("int").alias("feature2"), F.col("value").cast("double").alias("value")))
        listed = rules.groupBy(*(keys or [])).agg(each.alias("rules"))
        grams_ = grams_.join(listed, keys, "left") if keys else grams_.crossJoin(F.broadcast(listed))
    else:
        grams_ = grams_.withColumn("rules", F.lit(None).cast(RULE))

    @F.pandas_udf("array<double>")
    def coefficients(xx: pd.Series, xy: pd.Series, rules: pd.Series) -> pd.Series:
        g, b = full_gram(_stacked(xx), p), _stacked(xy)
        if method == "ols":
            return pd.Series(list(solvers.ridge(g, b, reg))) if len(g) else pd.Series([], dtype=object)
        return pd.Series([ruled(g[k], b[k], rules.iloc[k], method, reg, options) for k in range(len(g))])

    return grams_.withColumn("w", coefficients("xx", "xy", F.coalesce("rules", F.array().cast(RULE)))).drop("rules")


def ruled(g: np.ndarray, b: np.ndarray, rules, method: str, reg: float, options: dict) -> np.ndarray:
    """One system under its rules."""
    p = len(b)
    fixed: dict[int, float] = {}
    zeros, offsets, low, high, total = set(), set(), np.full(p, -np.inf), np.full(p, np.inf), None
    for r in rules if rules is not None else ():
        kind, i = r["kind"], int(r["feature"])
        if kind == "fixed":
            if fixed.setdefault(i, r["value"]) != r["value"]:
                raise ValueError(f"feature {i} has two fixed values")
        elif kind == "zero":
            zeros.add(i)
        elif kind == "offset":
            offsets.add((i, int(r["feature2"])))
        elif method == "qp" and kind == "nonneg":
            low[i] = 0.0
        elif method == "qp" and kind == "nonpos":
            high[i] = 0.0
        elif method == "qp" and kind == "total":
            total = r["value"]
        else:
            raise ValueError(f"{method} can't hold a {kind} rule")
    if method == "kkt":
        return solvers.kkt(g, b, *solvers.equalities(p, fixed, zeros, offsets), reg)
    if method == "penalty":
        return solvers.penalty(g, b, fixed, zeros, offsets, reg)
    a, c = solvers.equalities(p, fixed, zeros, offsets)
    if total is not None:
        a, c = np.vstack([a, np.ones(p)]), np.append(c, total)
    try:
        w = solvers.ruled(g, b, a, c, low, high, options.get("l1", 0.0), options.get("norm"), reg)
    except ValueError:
        if options.get("on_conflict") != "ols":
            raise
        w = solvers.ridge(g, b, reg)
    least = options.get("zero_below")
    return np.where(np.abs(w) < least, 0.0, w) if least else w


def long_coefficients(solved: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, feature_no, w: a row for each coefficient."""
    names = F.array(*map(F.lit, features))
    return solved.select(*keys, F.posexplode("w").alias("feature_no", "w")).withColumn("feature", F.element_at(names, F.col("feature_no") + 1))


def predictions(df: DataFrame, solved: DataFrame, idx: str, size: int, stride: int, n_rows: int, x: list[str], keys: list[str]) -> DataFrame:
    """Rows of df for each of their windows, with pred = x . w."""
    rows = df.withColumn("window_id", F.explode(window_ids(idx, size, stride, n_rows)))
    both = rows.join(solved.select("window_id", *keys, "w"), ["window_id", *keys])
    return both.withColumn("pred", sum((F.col(c) * F.col("w")[k] for k, c in enumerate(x)), F.lit(0.0))).drop("w")


def fit_scores(solved: DataFrame, p: int, keys: list[str], centering: str = "window") -> DataFrame:
    """keys, n, ss_res, ss_tot, r2, rmse: from the Grams alone, without another pass over rows.

    ss_res = yy - 2 w'xy + w'xx w; centering 'window' takes the mean of y out of ss_tot, 'none' does not.
    """
    i, j = np.triu_indices(p)
    quad = sum((F.col("w")[int(a)] * F.col("w")[int(b)] * F.col("xx")[k] * (1.0 if a == b else 2.0) for k, (a, b) in enumerate(zip(i, j, strict=True))), F.lit(0.0))
    cross = sum((F.col("w")[k] * F.col("xy")[k] for k in range(p)), F.lit(0.0))
    out = solved.withColumn("ss_res", F.greatest(F.lit(0.0), F.col("yy") - 2 * cross + quad))
    out = out.withColumn("ss_tot", F.col("yy") - F.col("sy") * F.col("sy") / F.col("n") if centering == "window" else F.col("yy"))
    out = out.withColumn("r2", 1 - F.col("ss_res") / (F.col("ss_tot") + 1e-10)).withColumn("rmse", F.sqrt(F.col("ss_res") / F.col("n")))
    return out.select(*keys, "n", "ss_res", "ss_tot", "r2", "rmse")


def rescored(grams_: DataFrame, w: DataFrame, p: int, keys: list[str], centering: str = "window") -> DataFrame:
    """fit_scores() of coefficients that were changed after the fit; w: keys, feature_no, w, a missing one is 0."""
    parts = [F.coalesce(F.sum(F.when(F.col("feature_no") == k, F.col("w"))), F.lit(0.0)) for k in range(p)]
    return fit_scores(grams_.join(w.groupBy(*keys).agg(F.array(*parts).alias("w")), keys), p, keys, centering)


def roll_up(scores: DataFrame, by: list[str], r2: str = "r2") -> DataFrame:
    """by, n, mean, std (population), min, max of R2 and the pooled R2 of all rows."""
    pooled = 1 - F.sum("ss_res") / (F.sum("ss_tot") + 1e-10)
    aggs = [F.count("*").alias("n"), F.avg(r2).alias("mean_r2"), F.stddev_pop(r2).alias("std_r2"), F.min(r2).alias("min_r2"), F.max(r2).alias("max_r2"), pooled.alias("overall_r2")]
    return scores.groupBy(*by).agg(*aggs) if by else scores.agg(*aggs)


def best_and_worst(scores: DataFrame, by: list[str], item: str, r2: str = "r2") -> DataFrame:
    """by, mean R2, and the items of the highest and lowest mean R2, the first of equal ones."""
    each = scores.groupBy(*by, item).agg(F.avg(r2).alias("_r"))
    out = each.groupBy(*by).agg(F.avg("_r").alias("mean_r2"), F.min(F.struct((-F.col("_r")).alias("k"), item)).alias("_b"), F.min(F.struct(F.col("_r").alias("k"), item)).alias("_w"))
    return out.select(*by, "mean_r2", F.col(f"_b.{item}").alias("best"), F.col(f"_w.{item}").alias("worst"))


def discover_zeros(w: DataFrame, output: list[str], magnitude: float = 0.05, relative: float = 0.1, consistency: float = 0.9) -> DataFrame:
    """output, feature, mean_abs, is_zero: small on average, by itself or against the output's greatest, and small in most windows.

    w: window_id, output, feature, w.  Small in a window means under `magnitude` or under `relative` of the greatest mean.
    """
    mean = w.groupBy(*output, "feature").agg(F.avg(F.abs("w")).alias("mean_abs"))
    mean = mean.withColumn("_top", F.max("mean_abs").over(Window.partitionBy(*output)))
    small = (F.abs("w") < magnitude) | (F.abs("w") < relative * F.col("_top"))
    share = w.join(mean, [*output, "feature"]).groupBy(*output, "feature").agg(F.avg(small.cast("double")).alias("_share"), F.first("mean_abs").alias("mean_abs"), F.first("_top").alias("_top"))
    low = (F.col("mean_abs") < magnitude) | (F.col("mean_abs") < relative * F.col("_top"))
    return share.select(*output, "feature", "mean_abs", F.col("_share").alias("share"), (low & (F.col("_share") > consistency)).alias("is_zero"))


def window_thresholds(w: DataFrame, k: float = 2.0) -> DataFrame:
    """window_id, mad_limit = k * 1.4826 * MAD of |w| and std_limit = k * population deviation of w."""
    mid = w.groupBy("window_id").agg(F.median(F.abs("w")).alias("_m"), F.stddev_pop("w").alias("_s"))
    mad = w.join(mid, "window_id").groupBy("window_id").agg(F.median(F.abs(F.abs("w") - F.col("_m"))).alias("_mad"), F.first("_s").alias("_s"))
    return mad.select("window_id", (k * 1.4826 * F.col("_mad")).alias("mad_limit"), (k * F.col("_s")).alias("std_limit"))


def group_sparsity(w: DataFrame, group: str, item: str, k: float = 2.0, consistency: float = 0.8) -> DataFrame:
    """group, item, feature, share, is_zero, group_zero: under the window's MAD limit in enough windows, and in all items of a group."""
    flagged = w.join(window_thresholds(w, k), "window_id").withColumn("_f", (F.abs("w") < F.col("mad_limit")).cast("double"))
    each = flagged.groupBy(group, item, "feature").agg(F.avg("_f").alias("share")).withColumn("is_zero", F.col("share") >= consistency)
    return each.withColumn("group_zero", F.min("is_zero").over(Window.partitionBy(group, "feature")))


def combine_masks(a: DataFrame, b: DataFrame, keys: list[str], mode: str = "union") -> DataFrame:
    """keys and is_zero of two masks: either (union) or both (intersection); a cell that one lacks is False there."""
    if mode not in ("union", "intersection"):
        raise ValueError("mode is union or intersection")
    both = a.select(*keys, F.col("is_zero").alias("_a")).join(b.select(*keys, F.col("is_zero").alias("_b")), keys, "full_outer").na.fill(False, ["_a", "_b"])
    return both.select(*keys, ((F.col("_a") | F.col("_b")) if mode == "union" else (F.col("_a") & F.col("_b"))).alias("is_zero"))


def zero_rules(mask: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Rules for solve() from a mask of feature names."""
    number = F.array_position(F.array(*map(F.lit, features)), F.col("feature")) - 1
    return mask.where("is_zero").select(*keys, F.lit("zero").alias("kind"), number.cast("int").alias("feature"), F.lit(None).cast("int").alias("feature2"), F.lit(0.0).alias("value"))


def layered_fit(df: DataFrame, idx: str, size: int, stride: int, n_rows: int, x: list[str], y: str, keys: list[str], layers: int = 3, rules: DataFrame | None = None, stage=lambda d: d) -> DataFrame:
    """layer, window_id, keys, w: the first layer under the rules, later ones plain, each on what is left of y.

    What is left is y minus the mean of a row's predictions over its windows.  stage(residuals) may write a layer's rows to a
    table between layers, to keep the lineage short.
    """
    rest, out = df.withColumn("_y", F.col(y)), None
    for k in range(layers):
        solved = solve(window_grams(rest, idx, size, stride, n_rows, x, "_y", keys), len(x), "kkt" if k == 0 and rules is not None else "ols", rules=rules if k == 0 else None, keys=keys)
        part = solved.select(F.lit(k).alias("layer"), "window_id", *keys, "w")
        out = part if out is None else out.unionAll(part)
        if k + 1 < layers:
            mean = predictions(rest, solved, idx, size, stride, n_rows, x, keys).groupBy(*keys, idx).agg(F.avg("pred").alias("_p"))
            rest = stage(rest.join(mean, [*keys, idx], "left").withColumn("_y", F.col("_y") - F.coalesce("_p", F.lit(0.0))).drop("_p"))
    return out


def tied_layers(df: DataFrame, idx: str, size: int, stride: int, n_rows: int, x: list[str], y: str, keys: list[str], layers: int = 2, opposite: tuple[tuple[int, int], ...] = (), threshold: float | None = None, penalty: float = 0.0, freeze: bool = False, reg: float = 1e-6) -> DataFrame:
    """layer, window_id, keys, w: plain fits on what is left of y, tied and masked before the next layer's residuals are taken.

    opposite: pairs (i, j) with w_j = -w_i after the fit.  A cell is masked where the plain |w| is under threshold.  With a penalty, a
    window is fitted again with it on the diagonal of the features that are masked in all of its outputs; masked cells get
    that fit, the others too or, with freeze, keep the tied plain one.  Residuals take off the mean prediction of a row's windows.
    """
    p = len(x)
    source = {j: i for i, j in opposite}
    if len(source) < len(opposite) or set(source) & {i for i, _ in opposite}:
        raise ValueError("a feature is the second of one pair, and first of none, at most")

    @F.pandas_udf("array<double>")
    def penalised(xx: pd.Series, xy: pd.Series, mask: pd.Series) -> pd.Series:
        g, b = full_gram(_stacked(xx), p), _stacked(xy)
        g = g + penalty * np.eye(p) * np.array(mask.tolist(), float).reshape(-1, 1, p) if len(g) else g
        return pd.Series(list(np.linalg.solve(g, b[..., None])[..., 0])) if len(g) else pd.Series([], dtype=object)

    rest, out = df.withColumn("_y", F.col(y)), None
    for layer in range(layers):
        solved = solve(window_grams(rest, idx, size, stride, n_rows, x, "_y", keys), p, reg=reg)
        masked = F.transform("w", lambda v: F.abs(v) < F.lit(threshold)) if threshold is not None else F.transform("w", lambda v: F.lit(False))
        solved = solved.withColumn("_m", masked).withColumn("w", F.array(*(-F.col("w")[source[k]] if k in source else F.col("w")[k] for k in range(p))))
        if penalty > 0:
            whole = F.array(*(F.min(F.col("_m")[k]).over(Window.partitionBy("window_id")) for k in range(p)))
            solved = solved.withColumn("_p", penalised("xx", "xy", whole.cast("array<int>")))
            solved = solved.withColumn("w", F.zip_with(F.arrays_zip("_m", "_p"), "w", lambda a, v: F.when(a["_m"], a["_p"]).otherwise(v))) if freeze else solved.withColumn("w", F.col("_p"))
        part = kept(solved.select(F.lit(layer).alias("layer"), "window_id", *keys, "w"))
        out = part if out is None else out.unionAll(part)
        if layer + 1 < layers:
            mean = predictions(rest, part, idx, size, stride, n_rows, x, keys).groupBy(*keys, idx).agg(F.avg("pred").alias("_q"))
            rest = kept(rest.join(mean, [*keys, idx], "left").withColumn("_y", F.col("_y") - F.coalesce("_q", F.lit(0.0))).drop("_q"))
    return out


def total_coefficients(layers: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, w: the layers' coefficients averaged over windows and summed."""
    each = long_coefficients(layers, ["layer", "window_id", *keys], features).groupBy("layer", *keys, "feature").agg(F.avg("w").alias("w"))
    return each.groupBy(*keys, "feature").agg(F.sum("w").alias("w"))


def warm_started(w: DataFrame, output: list[str], momentum: float = 0.9, parts: int | None = None) -> DataFrame:
    """window_id, output, feature, w, warm: m * warm before + (1 - m) * w along windows, from 0.  Series too long for a task are cut (slabs.parts_for)."""
    keys = [*output, "feature"]
    parts = slabs.parts_for(w, keys, parts)
    if parts:
        return affine_scan(w, keys, "window_id", "w", "warm", momentum, 0.0, parts).select("window_id", *keys, "w", "warm")
    series = w.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("window_id", "w"))).alias("s"))

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        step = lambda warm, v: momentum * warm + (1 - momentum) * v
        return pd.Series([list(accumulate(v, step, initial=0.0))[1:] for v in values])

    return series.withColumn("warm", run(F.transform("s", lambda r: r["w"].cast("double")))).select(*keys, F.explode(F.arrays_zip("s", "warm")).alias("z")).select("z.s.window_id", *keys, "z.s.w", F.col("z.warm").alias("warm"))


def violations(w: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """kind, n, max, mean, n_over (> 1e-6): how far coefficients miss each kind of rule.  w: keys, window_id, feature_no, w."""
    a = w.select(*keys, "window_id", F.col("feature_no").alias("feature"), F.col("w").alias("w1"))
    b = w.select(*keys, "window_id", F.col("feature_no").alias("feature2"), F.col("w").alias("w2"))
    both = rules.join(a, [*keys, "feature"]).join(b, [*keys, "window_id", "feature2"], "left")
    miss = F.when(F.col("kind") == "zero", F.abs("w1")).when(F.col("kind") == "fixed", F.abs(F.col("w1") - F.col("value"))).when(F.col("kind") == "offset", F.abs(F.col("w1") + F.col("w2"))).when(F.col("kind") == "nonneg", F.greatest(F.lit(0.0), -F.col("w1"))).when(F.col("kind") == "nonpos", F.greatest(F.lit(0.0), F.col("w1")))
    return both.withColumn("_m", miss).where("_m IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.max("_m").alias("max"), F.avg("_m").alias("mean"), F.count_if(F.col("_m") > 1e-6).alias("n_over"))


def coefficient_stability(w: DataFrame, output: list[str]) -> DataFrame:
    """output, feature, mean, std, cv over windows."""
    out = w.groupBy(*output, "feature").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"))
    return out.withColumn("cv", F.col("std") / (F.abs("mean") + 1e-8))


def active_features(w: DataFrame, output: list[str], least: float = 1e-10) -> DataFrame:
    """output, n_active, sparsity, active (sorted names) of averaged coefficients."""
    on = F.abs("w") > least
    return w.groupBy(*output).agg(F.count_if(on).alias("n_active"), (1 - F.avg(on.cast("double"))).alias("sparsity"), F.sort_array(F.collect_set(F.when(on, F.col("feature")))).alias("active"))


def feature_usage(w: DataFrame, group: str, least: float = 1e-10) -> DataFrame:
    """feature and the number of groups in which it is active."""
    return w.where(F.abs("w") > least).groupBy("feature").agg(F.countDistinct(group).alias("n_groups"))


def condition_numbers(grams_: DataFrame, keys: list[str], p: int) -> DataFrame:
    """keys and the condition number of X'X."""

    @F.pandas_udf("double")
    def condition(xx: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.cond(full_gram(_stacked(xx), p))) if len(xx) else pd.Series([], dtype=float)

    return grams_.select(*keys, condition("xx").alias("condition"))


def solve_huber(df: DataFrame, keys: list[str], idx: str, x: list[str], y: str, delta: float = 1.0, rounds: int = 20, tol: float = 1e-4, method: str = "ols", rules: DataFrame | None = None, rule_keys: list[str] | None = None, reg: float = 1e-6, **options) -> DataFrame:
    """keys and w under the Huber loss and, with method and rules, those of solve().

    Iteratively reweighted least squares: each round sums weighted Grams from the rows, under the coefficients of the round
    before, and solves them under the rules; a fit whose coefficients move by less than tol stays.  Rows are written once and read
    in each round, never gathered; a round's coefficients are written too, so its plan does not hold the rounds before.
    """
    rows = kept(df.dropna(subset=[*x, y]).select(*keys, *(F.col(c).cast("double").alias(c) for c in x), F.col(y).cast("double").alias(y)))
    fit = lambda g: solve(g, len(x), method, reg, rules, rule_keys, **options)
    out = left = kept(fit(grams(rows, keys, x, y)).select(*keys, "w"))
    for k in range(rounds):
        both = rows.join(left.select(*keys, F.col("w").alias("_w")), keys)
        miss = F.abs(F.col(y) - sum((F.col(c) * F.col("_w")[j] for j, c in enumerate(x)), F.lit(0.0)))
        weight = F.when(miss <= delta, 1.0).otherwise(delta / F.greatest(miss, F.lit(1e-12)))
        moved = F.aggregate(F.zip_with("w", "_w", lambda u, v: F.abs(u - v)), F.lit(0.0), lambda m, d: F.greatest(m, d))
        new = kept(fit(grams(both.withColumn("_v", weight), [*keys, "_w"], x, y, "_v")).select(*keys, "w", (moved < tol).alias("done")))
        still = new.where("done").select(*keys, "w")
        out, left = still if k == 0 else out.unionByName(still), new.where("NOT done").select(*keys, "w")
        if left.isEmpty():
            return out
    return out.unionByName(left) if rounds else out


def asymmetric_ridge(df: DataFrame, key: str, x: list[str], y: str, positive: float = 1.0, negative: float = 10.0, folds: int = 5, alphas: list[float] | None = None) -> DataFrame:
    """alpha, mse (mean over folds), chosen, intercept and w (of the chosen alpha, fitted on all rows).

    One pass gives the Gram sums of each fold (rows by a hash of key); every fit works on differences of them.
    """
    p, grid = len(x), alphas if alphas is not None else [k / 20 for k in range(21)]
    parts = grams(df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds))), ["fold"], x, y)
    all_ = parts.agg(F.sort_array(F.collect_list(F.struct("fold", "xx", "xy", "sx", "yy", "sy", "n"))).alias("s")).where("size(s) > 0")

    @F.pandas_udf("array<struct<alpha:double,mse:double,chosen:boolean,intercept:double,w:array<double>>>")
    def choose(xx: pd.Series, xy: pd.Series, sx: pd.Series, yy: pd.Series, sy: pd.Series, n: pd.Series) -> pd.Series:
        def one(k):
            f = [(full_gram(np.array(list(a), float), p), *(np.array(v, float) for v in rest)) for a, *rest in zip(xx[k], xy[k], sx[k], yy[k], sy[k], n[k], strict=True)]
            whole = [sum(v[m] for v in f) for m in range(6)]

            def fit(s, alpha):
                g, b, m, _, t, c = s
                mean, top = m / c, t / c
                centred = g - c * np.outer(mean, mean)
                w = solvers.asymmetric(centred, b - c * mean * top, solvers.shrunk_covariance(centred, c, alpha), positive, negative)
                return w, top - mean @ w

            def error(s, w, a):
                g, b, m, q, t, c = s
                return (q + w @ g @ w + c * a * a - 2 * w @ b - 2 * a * t + 2 * a * w @ m) / c

            scores = [np.mean([error(v, *fit([u - w for u, w in zip(whole, v, strict=True)], alpha)) for v in f]) for alpha in grid] if len(f) > 1 else [0.0] * len(grid)
            best = int(np.argmin(scores))
            w, a = fit(whole, grid[best])
            return [{"alpha": g, "mse": float(s), "chosen": k == best, "intercept": float(a), "w": w.tolist()} for k, (g, s) in enumerate(zip(grid, scores, strict=True))]

        return pd.Series([one(k) for k in range(len(xx))])

    fields = [F.col(f"s.{c}") for c in ("xx", "xy", "sx", "yy", "sy", "n")]  # a field of an array of structs is an array
    return all_.select(F.explode(choose(*fields)).alias("r")).select("r.*")


def global_against_sliced(df: DataFrame, idx: str, size: int, stride: int, n_rows: int, x: list[str], y: str, keys: list[str]) -> DataFrame:
    """keys, global_mse and sliced_mse: one fit over all rows against the mean of a row's window predictions, on rows that have one."""
    sliced = predictions(df, solve(window_grams(df, idx, size, stride, n_rows, x, y, keys), len(x)), idx, size, stride, n_rows, x, keys)
    mean = sliced.groupBy(*keys, idx).agg(F.avg("pred").alias("_s"))
    whole = solve(grams(df, keys, x, y), len(x)).select(*keys, "w")
    both = df.join(mean, [*keys, idx]).join(whole, keys).withColumn("_g", sum((F.col(c) * F.col("w")[k] for k, c in enumerate(x)), F.lit(0.0)))
    return both.groupBy(*keys).agg(F.avg((F.col(y) - F.col("_g")) ** 2).alias("global_mse"), F.avg((F.col(y) - F.col("_s")) ** 2).alias("sliced_mse"))


def solve_opposite(grams_: DataFrame, pairs: DataFrame, group: str, others: list[str], p: int, reg: float = 1e-6) -> DataFrame:
    """others, group, w with w of one group = - w of the other, for each pair (a, b) of groups and each of `others`.

    The two outputs share one unknown: their Grams add, with b's xy turned round, and the solution is read with its sign.
    """
    signs = pairs.select(F.col("a").alias(group), F.concat_ws("|", "a", "b").alias("_pair"), F.lit(1.0).alias("_sign")).unionAll(pairs.select(F.col("b").alias(group), F.concat_ws("|", "a", "b"), F.lit(-1.0)))
    both = grams_.join(F.broadcast(signs), group)  # pairs are a configuration
    both = both.withColumn("xy", F.transform("xy", lambda x: x * F.col("_sign")))
    solved = solve(_added(both, [*others, "_pair"], p), p, reg=reg).select(*others, "_pair", "w")
    return both.select(*others, group, "_pair", "_sign").join(solved, [*others, "_pair"]).select(*others, group, F.transform("w", lambda x: x * F.col("_sign")).alias("w"))


def window_diagnostics(w: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """window_id, mean, std, spread = std / (|mean| + 1e-8), and the greatest and number (> 1e-6) of weights where the mask is zero."""
    both = w.join(mask.where("is_zero").select(*keys, F.lit(True).alias("_z")), keys, "left")
    missed = F.when(F.col("_z"), F.abs("w"))
    out = both.groupBy("window_id").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.coalesce(F.max(missed), F.lit(0.0)).alias("worst"), F.count_if(missed > 1e-6).alias("n_missed"))
    return out.withColumn("spread", F.col("std") / (F.abs("mean") + 1e-8))


def fit_report(scores: DataFrame, group: str, item: str, items: list[str]) -> dict[str, DataFrame]:
    """Four tables for sources.write_report: summary, by_window, by_country, and mean R2 as a matrix of groups and items."""
    matrix = scores.groupBy(group).pivot(item, items).agg(F.avg("r2"))
    return {"summary": roll_up(scores, []), "by_window": roll_up(scores, ["window_id"]), "by_country": roll_up(scores, [group]), "matrix": matrix}


def predict(df: DataFrame, fit: DataFrame, x: list[str]) -> DataFrame:
    """df with pred = intercept + x . w of the chosen row of asymmetric_ridge()."""
    chosen = fit.where("chosen").select(F.col("intercept").alias("_a"), F.col("w").alias("_w"))
    return df.crossJoin(F.broadcast(chosen)).withColumn("pred", sum((F.col(c) * F.col("_w")[k] for k, c in enumerate(x)), F.col("_a"))).drop("_a", "_w")
