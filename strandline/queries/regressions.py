"""Windowed regression: daily features of line items against targets by return flag ("country") and line status ("tenor")."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import compare, constraints, postprocess, regression, windows
from ..sources import read_table, scratch, write_report
from .base import REGRESSION, WIDE, WIDE_X, Registry, panel, r, regression_rows, table, wide_rows

query = Registry()
SIZE, STRIDE = 200, 150
KEYS = ["country", "tenor"]
X2, X3 = ["x1", "x2"], ["x1", "x2", "x3"]

_WIN = f"""{REGRESSION},
win AS (SELECT w AS window_id, reg.* FROM reg, size, unnest(range(0, (n_rows - {SIZE}) // {STRIDE} + 1)) t(w) WHERE idx >= w * {STRIDE} AND idx < w * {STRIDE} + {SIZE}),
g AS (SELECT window_id, country, tenor, count(*) AS n, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22, sum(x1 * y) AS b1, sum(x2 * y) AS b2, sum(y * y) AS yy, sum(y) AS sy FROM win GROUP BY ALL),
w2 AS (SELECT *, ((g22 + 1e-6) * b1 - g12 * b2) / ((g11 + 1e-6) * (g22 + 1e-6) - g12 * g12) AS w1, ((g11 + 1e-6) * b2 - g12 * b1) / ((g11 + 1e-6) * (g22 + 1e-6) - g12 * g12) AS w2 FROM g),
wl AS (SELECT window_id, country, tenor, 'x1' AS feature, 0 AS feature_no, w1 AS w FROM w2 UNION ALL SELECT window_id, country, tenor, 'x2', 1, w2 FROM w2),
sc AS (SELECT window_id, country, tenor, n, greatest(0, yy - 2 * (w1 * b1 + w2 * b2) + w1 * w1 * g11 + 2 * w1 * w2 * g12 + w2 * w2 * g22) AS ss_res, yy - sy * sy / n AS ss_tot FROM w2)"""
_WITH = f"WITH {_WIN}"


def _grams(spark, d, x=X2):
    rows, n = regression_rows(spark, d)
    return regression.window_grams(rows, "idx", SIZE, STRIDE, n, x, "y", KEYS)


def _solved(spark, d, x=X2):
    return regression.solve(_grams(spark, d, x), len(x))


def _long(spark, d, x=X2):
    return regression.long_coefficients(_solved(spark, d, x), ["window_id", *KEYS], x)


@query(f"{_WITH} SELECT window_id, country, tenor, n, {r('g11', 4)} AS g11, {r('g12', 4)} AS g12, {r('g22', 4)} AS g22, {r('b1', 4)} AS b1, {r('b2', 4)} AS b2, {r('yy', 4)} AS yy, {r('sy', 4)} AS sy FROM g")
def reg_window_grams(spark, d):
    g = _grams(spark, d)
    parts = {"g11": g.xx[0], "g12": g.xx[1], "g22": g.xx[2], "b1": g.xy[0], "b2": g.xy[1], "yy": g.yy, "sy": g.sy}
    return g.select("window_id", *KEYS, "n", *(rounded(c, 4).alias(k) for k, c in parts.items()))


@query(f"{_WITH} SELECT window_id, country, tenor, {r('w1')} AS w1, {r('w2')} AS w2 FROM w2")
def reg_ols(spark, d):
    return _two(_solved(spark, d))


def _two(solved, digits=6):
    return solved.select("window_id", *KEYS, rounded(F.col("w")[0], digits).alias("w1"), rounded(F.col("w")[1], digits).alias("w2"))


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer() -> str:
    g = [[f"(sum(x{i} * x{j})" + (" + 1e-6)" if i == j else ")") for j in (1, 2, 3)] for i in (1, 2, 3)]
    b = [f"sum(x{i} * y)" for i in (1, 2, 3)]
    swapped = [[[b[i] if j == k else g[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    return ", ".join(f"{r(f'{_det(m)} / {_det(g)}')} AS x{k + 1}" for k, m in enumerate(swapped))


@query(f"{_WITH} SELECT window_id, country, tenor, {_cramer()} FROM win GROUP BY window_id, country, tenor")
def reg_ols_three(spark, d):
    return _solved(spark, d, X3).select("window_id", *KEYS, *(rounded(F.col("w")[k]).alias(c) for k, c in enumerate(X3)))


_RULE = "country string, tenor string, kind string, feature int, feature2 int, value double"


def _rules(spark, *rows):
    return spark.createDataFrame([(c, t, *row) for c in "ANR" for t in "FO" for row in rows], _RULE)


@query(f"{_WITH} SELECT window_id, country, tenor, 0.5::DOUBLE AS w1, {r('(b2 - g12 * 0.5) / (g22 + 1e-6)')} AS w2 FROM g")
def reg_kkt_fixed(spark, d):
    return _two(regression.solve(_grams(spark, d), 2, "kkt", rules=_rules(spark, ("fixed", 0, None, 0.5)), keys=KEYS))


@query(f"{_WITH} SELECT window_id, country, tenor, {r('(b1 - b2) / (g11 - 2 * g12 + g22 + 2e-6)')} AS w1, {r('-(b1 - b2) / (g11 - 2 * g12 + g22 + 2e-6)')} AS w2 FROM g")
def reg_kkt_offset(spark, d):
    return _two(regression.solve(_grams(spark, d), 2, "kkt", rules=_rules(spark, ("offset", 0, 1, 0.0)), keys=KEYS))


@query(f"{_WITH} SELECT window_id, country, tenor, {r('b1 / (g11 + 1e-6)')} AS w1, 0.0::DOUBLE AS w2 FROM g")
def reg_penalty_zero(spark, d):
    return _two(regression.solve(_grams(spark, d), 2, "penalty", rules=_rules(spark, ("zero", 1, None, 0.0)), keys=KEYS))


# penalties hold a rule nearly: the exact solution to three digits
@query(f"{_WITH} SELECT window_id, country, tenor, 0.5::DOUBLE AS w1, {r('(b2 - g12 * 0.5) / (g22 + 1e-6)', 3)} AS w2 FROM g")
def reg_penalty_fixed(spark, d):
    return _two(regression.solve(_grams(spark, d), 2, "penalty", rules=_rules(spark, ("fixed", 0, None, 0.5)), keys=KEYS), 3)


@query(f"{_WITH} SELECT window_id, country, tenor, {r('(b1 - b2) / (g11 - 2 * g12 + g22 + 2e-6)', 3)} AS w1, {r('-(b1 - b2) / (g11 - 2 * g12 + g22 + 2e-6)', 3)} AS w2 FROM g")
def reg_penalty_offset(spark, d):
    return _two(regression.solve(_grams(spark, d), 2, "penalty", rules=_rules(spark, ("offset", 0, 1, 0.0)), keys=KEYS), 3)


@query(f"""{_WITH} SELECT window_id, country, tenor, {r("CASE WHEN w1 >= 0 AND w2 >= 0 THEN w1 WHEN greatest(b1, 0) ** 2 / (g11 + 1e-6) >= greatest(b2, 0) ** 2 / (g22 + 1e-6) THEN greatest(b1, 0) / (g11 + 1e-6) ELSE 0 END", 5)} AS w1,
 {r("CASE WHEN w1 >= 0 AND w2 >= 0 THEN w2 WHEN greatest(b1, 0) ** 2 / (g11 + 1e-6) >= greatest(b2, 0) ** 2 / (g22 + 1e-6) THEN 0 ELSE greatest(b2, 0) / (g22 + 1e-6) END", 5)} AS w2 FROM w2""")
def reg_nonnegative(spark, d):
    out = regression.solve(_grams(spark, d), 2, "qp", rules=_rules(spark, ("nonneg", 0, None, 0.0), ("nonneg", 1, None, 0.0)), keys=KEYS)
    return out.select("window_id", *KEYS, rounded(F.col("w")[0], 5).alias("w1"), rounded(F.col("w")[1], 5).alias("w2"))


@query(f"{_WITH} SELECT window_id, country, tenor, {r('(b1 - b2 - g12 + g22 + 1e-6) / (g11 - 2 * g12 + g22 + 2e-6)', 5)} AS w1, {r('1 - (b1 - b2 - g12 + g22 + 1e-6) / (g11 - 2 * g12 + g22 + 2e-6)', 5)} AS w2 FROM g")
def reg_sum_to_one(spark, d):
    out = regression.solve(_grams(spark, d), 2, "qp", rules=_rules(spark, ("total", 0, None, 1.0)), keys=KEYS)
    return out.select("window_id", *KEYS, rounded(F.col("w")[0], 5).alias("w1"), rounded(F.col("w")[1], 5).alias("w2"))


@query()
def reg_lasso(spark, d):
    out = regression.solve(_grams(spark, d, X3), 3, "qp", rules=_rules(spark, ("nonpos", 2, None, 0.0)), keys=KEYS, l1=5.0, zero_below=1e-3)
    return out.select("window_id", *KEYS, *(rounded(F.col("w")[k], 5).alias(c) for k, c in enumerate(X3)))


def _irls(rounds: int, fit: dict[str, str], pred: str, tol: float = 1e-4) -> str:
    """SQL of solve_huber(): fit has the coefficients from sums weighted by v; one that has moved by less than tol stays."""
    select, by = ", ".join(f"{e} AS {c}" for c, e in fit.items()), "window_id, country, tenor"
    out = [f"h0 AS MATERIALIZED (SELECT {by}, {select}, false AS done FROM (SELECT *, 1.0 AS v FROM win) GROUP BY {by})"]
    for k in range(1, rounds + 1):
        rows = f"SELECT win.*, CASE WHEN abs(y - ({pred})) <= 1 THEN 1.0 ELSE 1 / abs(y - ({pred})) END AS v FROM win JOIN h{k - 1} USING ({by}) WHERE NOT done"
        out.append(f"n{k} AS MATERIALIZED (SELECT {by}, {select} FROM ({rows}) GROUP BY {by})")
        far = f"greatest({', '.join(f'abs(n{k}.{c} - h{k - 1}.{c})' for c in fit)})"
        out.append(f"h{k} AS MATERIALIZED (SELECT {by}, {', '.join(f'coalesce(n{k}.{c}, h{k - 1}.{c}) AS {c}' for c in fit)}, h{k - 1}.done OR coalesce({far} < {tol}, false) AS done FROM h{k - 1} LEFT JOIN n{k} USING ({by}))")
    return ", ".join(out)


_V = {f"{a}{b}": f"sum(v * {c} * {d})" for a, b, c, d in (("g", 11, "x1", "x1"), ("g", 12, "x1", "x2"), ("g", 22, "x2", "x2"), ("b", 1, "x1", "y"), ("b", 2, "x2", "y"))}
_VDET = f"(({_V['g11']} + 1e-6) * ({_V['g22']} + 1e-6) - {_V['g12']} * {_V['g12']})"
_HUBER = {"u1": f"(({_V['g22']} + 1e-6) * {_V['b1']} - {_V['g12']} * {_V['b2']}) / {_VDET}", "u2": f"(({_V['g11']} + 1e-6) * {_V['b2']} - {_V['g12']} * {_V['b1']}) / {_VDET}"}
_HUBER_OFFSET = {"u1": "greatest(0, sum(v * (x1 - x2) * y) / (sum(v * (x1 - x2) * (x1 - x2)) + 2e-6))"}


@query(f"{_WITH}, {_irls(20, _HUBER, 'x1 * u1 + x2 * u2')} SELECT window_id, country, tenor, {r('u1', 5)} AS w1, {r('u2', 5)} AS w2 FROM h20")
def reg_huber(spark, d):
    rows, n = regression_rows(spark, d)
    out = regression.solve_huber(windows.assign_windows(rows, "idx", SIZE, STRIDE, n), ["window_id", *KEYS], "idx", X2, "y")
    return _two(out, 5)


@query(f"{_WITH}, {_irls(20, _HUBER_OFFSET, '(x1 - x2) * u1')} SELECT window_id, country, tenor, {r('u1', 5)} AS w1, {r('-u1', 5)} AS w2 FROM h20")
def reg_huber_ruled(spark, d):
    """The Huber loss with w1 + w2 = 0 and w1 >= 0."""
    rows, n = regression_rows(spark, d)
    rules = _rules(spark, ("offset", 0, 1, 0.0), ("nonneg", 0, None, 0.0))
    out = regression.solve_huber(windows.assign_windows(rows, "idx", SIZE, STRIDE, n), ["window_id", *KEYS], "idx", X2, "y", method="qp", rules=rules, rule_keys=KEYS)
    return _two(out, 5)


# with w1 + w2 = 0 and a sum of one, w3 is one and w1 the slope of x1 - x2, not below zero
@query(f"{_WITH} SELECT window_id, country, tenor, {r('t', 5)} AS w1, {r('-t', 5)} AS w2, 1.0::DOUBLE AS w3 FROM (SELECT window_id, country, tenor, greatest(0, sum((x1 - x2) * (y - x3)) / (sum((x1 - x2) * (x1 - x2)) + 2e-6)) AS t FROM win GROUP BY ALL)")
def reg_ruled(spark, d):
    """Offset, sum and sign rules together."""
    rules = _rules(spark, ("offset", 0, 1, 0.0), ("total", 0, None, 1.0), ("nonneg", 0, None, 0.0))
    out = regression.solve(_grams(spark, d, X3), 3, "qp", rules=rules, keys=KEYS)
    return out.select("window_id", *KEYS, *(rounded(F.col("w")[k], 5).alias(f"w{k + 1}") for k in range(3)))


NORM = 1.5
_FACE = f"least({NORM}, greatest(0, (({{g}}22 + 1e-6) * {NORM} - s1 * s2 * {{g}}12 * {NORM} + b1 * s1 - b2 * s2) / ({{g}}11 - 2 * s1 * s2 * {{g}}12 + {{g}}22 + 2e-6)))".replace("{g}", "g")


@query(f"""{_WITH}, side AS (SELECT * FROM (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) t(s1, s2)),
face AS (SELECT window_id, country, tenor, s1 * a AS u1, s2 * ({NORM} - a) AS u2, g11, g12, g22, b1, b2 FROM (SELECT *, {_FACE} AS a FROM g, side)),
best AS (SELECT * FROM face QUALIFY row_number() OVER (PARTITION BY window_id, country, tenor ORDER BY ((g11 + 1e-6) * u1 * u1 + 2 * g12 * u1 * u2 + (g22 + 1e-6) * u2 * u2) / 2 - b1 * u1 - b2 * u2) = 1)
SELECT window_id, country, tenor, {r(f'CASE WHEN abs(w1) + abs(w2) <= {NORM} THEN w1 ELSE u1 END', 5)} AS w1, {r(f'CASE WHEN abs(w1) + abs(w2) <= {NORM} THEN w2 ELSE u2 END', 5)} AS w2
FROM w2 JOIN (SELECT window_id, country, tenor, u1, u2 FROM best) USING (window_id, country, tenor)""")
def reg_l1_bounded(spark, d):
    """|w1| + |w2| <= NORM."""
    return _two(regression.solve(_grams(spark, d), 2, "qp", keys=KEYS, norm=NORM), 5)


@query(f"""{_WITH} SELECT window_id, country, tenor, {r('t', 5)} AS w1, {r('-t', 5)} AS w2 FROM (SELECT *, sign(b1 - b2) * greatest(abs(b1 - b2) - 2 * 100.0, 0) / (g11 - 2 * g12 + g22 + 2e-6) AS t FROM g)""")
def reg_lasso_offset(spark, d):
    """LASSO with w1 + w2 = 0."""
    return _two(regression.solve(_grams(spark, d), 2, "qp", rules=_rules(spark, ("offset", 0, 1, 0.0)), keys=KEYS, l1=100.0), 5)


@query(f"{_WITH} SELECT window_id, country, tenor, idx, {r('x1 * w1 + x2 * w2')} AS pred FROM win JOIN w2 USING (window_id, country, tenor)")
def reg_predictions(spark, d):
    rows, n = regression_rows(spark, d)
    out = regression.predictions(rows, _solved(spark, d), "idx", SIZE, STRIDE, n, X2, KEYS)
    return out.select("window_id", *KEYS, "idx", rounded("pred").alias("pred"))


@query(f"{_WITH} SELECT window_id, country, tenor, n, {r('ss_res', 4)} AS ss_res, {r('ss_tot', 4)} AS ss_tot, {r('1 - ss_res / (ss_tot + 1e-10)')} AS r2, {r('sqrt(ss_res / n)')} AS rmse FROM sc")
def reg_scores(spark, d):
    out = regression.fit_scores(_solved(spark, d), 2, ["window_id", *KEYS])
    return out.select("window_id", *KEYS, "n", rounded("ss_res", 4).alias("ss_res"), rounded("ss_tot", 4).alias("ss_tot"), rounded("r2").alias("r2"), rounded("rmse").alias("rmse"))


_ROLL = "count(*) AS n, " + ", ".join(f"{r(e)} AS {n}" for n, e in (("mean_r2", "avg(r2)"), ("std_r2", "stddev_pop(r2)"), ("min_r2", "min(r2)"), ("max_r2", "max(r2)"), ("overall_r2", "1 - sum(ss_res) / (sum(ss_tot) + 1e-10)")))


@query(f"{_WITH}, s AS (SELECT *, 1 - ss_res / (ss_tot + 1e-10) AS r2 FROM sc) SELECT country, {_ROLL} FROM s GROUP BY country")
def reg_scores_by_country(spark, d):
    return _rolled(regression.roll_up(regression.fit_scores(_solved(spark, d), 2, ["window_id", *KEYS]), ["country"]), ["country"])


def _rolled(df, keys):
    return df.select(*keys, "n", *(rounded(c).alias(c) for c in ("mean_r2", "std_r2", "min_r2", "max_r2", "overall_r2")))


@query(f"{_WITH}, s AS (SELECT *, 1 - ss_res / (ss_tot + 1e-10) AS r2 FROM sc) SELECT window_id, {_ROLL} FROM s GROUP BY window_id")
def reg_scores_by_window(spark, d):
    return _rolled(regression.roll_up(regression.fit_scores(_solved(spark, d), 2, ["window_id", *KEYS]), ["window_id"]), ["window_id"])


@query(f"""{_WITH}, s AS (SELECT country, tenor, avg(1 - ss_res / (ss_tot + 1e-10)) AS r2 FROM sc GROUP BY ALL) SELECT country, {r("avg(r2)")} AS mean_r2, arg_min(tenor, (-r2, tenor)) AS best, arg_min(tenor, (r2, tenor)) AS worst FROM s GROUP BY country""")
def reg_best_and_worst(spark, d):
    out = regression.best_and_worst(regression.fit_scores(_solved(spark, d), 2, ["window_id", *KEYS]), ["country"], "tenor")
    return out.select("country", rounded("mean_r2").alias("mean_r2"), "best", "worst")


@query(f"""{_WITH}, t AS (SELECT *, 'ols' AS method, w1 AS u1, w2 AS u2 FROM w2 UNION ALL SELECT *, 'fixed', 1.0, (b2 - g12) / (g22 + 1e-6) FROM w2
 UNION ALL SELECT *, 'nonneg', CASE WHEN w2 >= 0 THEN w1 ELSE b1 / (g11 + 1e-6) END, greatest(w2, 0) FROM w2),
e AS (SELECT method, greatest(0, yy - 2 * (u1 * b1 + u2 * b2) + u1 * u1 * g11 + 2 * u1 * u2 * g12 + u2 * u2 * g22) AS ss_res, yy - sy * sy / n AS ss_tot FROM t),
s AS (SELECT *, 1 - ss_res / (ss_tot + 1e-10) AS r2 FROM e) SELECT method, {_ROLL} FROM s GROUP BY method""")
def reg_method_comparison(spark, d):
    """Overall R2 of each method, best first."""
    parts = None
    for name, method, rules in (("ols", "ols", None), ("fixed", "kkt", ("fixed", 0, None, 1.0)), ("nonneg", "qp", ("nonneg", 1, None, 0.0))):
        solved = regression.solve(_grams(spark, d), 2, method, rules=_rules(spark, rules) if rules else None, keys=KEYS)
        part = regression.fit_scores(solved, 2, ["window_id", *KEYS]).withColumn("method", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return _rolled(regression.roll_up(parts, ["method"]), ["method"]).orderBy(F.desc("overall_r2"), "method")


_MASK = """m AS (SELECT country, tenor, feature, avg(abs(w)) AS mean_abs FROM wl GROUP BY ALL), t AS (SELECT *, max(mean_abs) OVER (PARTITION BY country, tenor) AS top FROM m),
z AS (SELECT country, tenor, feature, any_value(mean_abs) AS mean_abs, avg((abs(w) < 0.05 OR abs(w) < 0.1 * top)::INT) AS share, any_value(top) AS top FROM wl JOIN t USING (country, tenor, feature) GROUP BY ALL),
mask AS (SELECT country, tenor, feature, mean_abs, share, (mean_abs < 0.05 OR mean_abs < 0.1 * top) AND share > 0.9 AS is_zero FROM z)"""


@query(f"{_WITH}, {_MASK} SELECT country, tenor, feature, {r('mean_abs')} AS mean_abs, {r('share')} AS share, is_zero FROM mask")
def reg_discovery(spark, d):
    out = regression.discover_zeros(_long(spark, d), KEYS)
    return out.select(*KEYS, "feature", rounded("mean_abs").alias("mean_abs"), rounded("share").alias("share"), "is_zero")


@query(f"""{_WITH}, m AS (SELECT window_id, median(abs(w)) AS m, stddev_pop(w) AS s FROM wl GROUP BY window_id)
SELECT window_id, {r("2 * 1.4826 * median(abs(abs(w) - m))")} AS mad_limit, {r("2 * any_value(s)")} AS std_limit FROM wl JOIN m USING (window_id) GROUP BY window_id""")
def reg_thresholds(spark, d):
    return regression.window_thresholds(_long(spark, d)).select("window_id", rounded("mad_limit").alias("mad_limit"), rounded("std_limit").alias("std_limit"))


@query(f"""{_WITH}, m AS (SELECT window_id, median(abs(w)) AS m FROM wl GROUP BY window_id), l AS (SELECT window_id, 2 * 1.4826 * median(abs(abs(w) - m)) AS lim FROM wl JOIN m USING (window_id) GROUP BY window_id),
s AS (SELECT country, tenor, feature, avg((abs(w) < lim)::INT) AS share FROM wl JOIN l USING (window_id) GROUP BY ALL)
SELECT country, tenor, feature, {r("share")} AS share, share >= 0.8 AS is_zero, bool_and(share >= 0.8) OVER (PARTITION BY country, feature) AS group_zero FROM s""")
def reg_group_sparsity(spark, d):
    return regression.group_sparsity(_long(spark, d), "country", "tenor").withColumn("share", rounded("share"))


def _masks(spark, d):
    w = _long(spark, d)
    a = regression.discover_zeros(w, KEYS, magnitude=1.0, consistency=0.5).select(*KEYS, "feature", "is_zero")
    b = spark.createDataFrame([(c, "F", "x2", True) for c in "ANR"], "country string, tenor string, feature string, is_zero boolean")
    return a, b


_TWO_MASKS = """t1 AS (SELECT *, max(mean_abs) OVER (PARTITION BY country, tenor) AS top FROM (SELECT country, tenor, feature, avg(abs(w)) AS mean_abs FROM wl GROUP BY ALL)),
za AS (SELECT country, tenor, feature, (any_value(mean_abs) < 1 OR any_value(mean_abs) < 0.1 * any_value(top)) AND avg((abs(w) < 1 OR abs(w) < 0.1 * top)::INT) > 0.5 AS za FROM wl JOIN t1 USING (country, tenor, feature) GROUP BY ALL),
zb AS (SELECT unnest(['A', 'N', 'R']) AS country, 'F' AS tenor, 'x2' AS feature, true AS zb),
zz AS (SELECT country, tenor, feature, coalesce(za, false) AS za, coalesce(zb, false) AS zb FROM za FULL JOIN zb USING (country, tenor, feature))"""


@query(f"{_WITH}, {_TWO_MASKS} SELECT country, tenor, feature, za OR zb AS is_zero FROM zz")
def reg_mask_union(spark, d):
    return regression.combine_masks(*_masks(spark, d), [*KEYS, "feature"])


@query(f"{_WITH}, {_TWO_MASKS} SELECT country, tenor, feature, za AND zb AS is_zero FROM zz")
def reg_mask_intersection(spark, d):
    return regression.combine_masks(*_masks(spark, d), [*KEYS, "feature"], "intersection")


@query(f"""{_WITH}, {_TWO_MASKS}, q AS (SELECT count(*) FILTER (zb AND za) AS true_pos, count(*) FILTER (NOT zb AND za) AS false_pos, count(*) FILTER (zb AND NOT za) AS false_neg FROM zz),
p AS (SELECT *, true_pos / (true_pos + false_pos + 1e-10) AS p, true_pos / (true_pos + false_neg + 1e-10) AS c FROM q)
SELECT true_pos, false_pos, false_neg, {r("p")} AS precision, {r("c")} AS recall, {r("2 * p * c / (p + c + 1e-10)")} AS f1 FROM p""")
def reg_mask_quality(spark, d):
    a, b = _masks(spark, d)
    return compare.mask_quality(b, a, [*KEYS, "feature"]).select("true_pos", "false_pos", "false_neg", *(rounded(c).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""{_WITH}, {_TWO_MASKS}, k AS (SELECT country, tenor, max((feature = 'x1' AND za)::INT) AS z1, max((feature = 'x2' AND za)::INT) AS z2 FROM zz GROUP BY ALL)
SELECT window_id, country, tenor, {r("CASE WHEN z1 = 1 THEN 0 WHEN z2 = 1 THEN b1 / (g11 + 1e-6) ELSE w1 END")} AS w1, {r("CASE WHEN z2 = 1 THEN 0 WHEN z1 = 1 THEN b2 / (g22 + 1e-6) ELSE w2 END")} AS w2 FROM w2 JOIN k USING (country, tenor)""")
def reg_two_stage(spark, d):
    """Discover zeros, then refit without them."""
    rules = regression.zero_rules(_masks(spark, d)[0], KEYS, X2)
    return _two(regression.solve(_grams(spark, d), 2, "kkt", rules=rules, keys=KEYS))


@query(f"""{_WITH}, {_TWO_MASKS} SELECT window_id, country, tenor, feature, {r("greatest(CASE WHEN za THEN 0 ELSE w END, -5)", 5)} AS w FROM wl JOIN za USING (country, tenor, feature)""")
def reg_masked_refit(spark, d):
    a, _ = _masks(spark, d)
    plain = _long(spark, d)
    tight = regression.long_coefficients(regression.solve(_grams(spark, d), 2, "penalty", rules=regression.zero_rules(a, KEYS, X2), keys=KEYS), ["window_id", *KEYS], X2)
    mask = plain.select("window_id", *KEYS, "feature").join(a, [*KEYS, "feature"])
    return postprocess.freeze_and_floor(tight, plain, mask, ["window_id", *KEYS, "feature"], -5.0).select("window_id", *KEYS, "feature", rounded("w", 5).alias("w"))


# the first layer holds w1 at 0.5, the second is plain on what the mean prediction of a row leaves
_LAYERS = """l0 AS (SELECT window_id, country, tenor, 0.5::DOUBLE AS w1, (b2 - g12 * 0.5) / (g22 + 1e-6) AS w2 FROM g),
left_ AS (SELECT country, tenor, idx, avg(x1 * w1 + x2 * w2) AS p FROM win JOIN l0 USING (window_id, country, tenor) GROUP BY ALL),
g1 AS (SELECT window_id, country, tenor, sum(x1 * x1) + 1e-6 AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) + 1e-6 AS g22, sum(x1 * (y - p)) AS b1, sum(x2 * (y - p)) AS b2 FROM win JOIN left_ USING (country, tenor, idx) GROUP BY ALL),
layers AS (SELECT 0 AS layer, window_id, country, tenor, w1, w2 FROM l0 UNION ALL SELECT 1, window_id, country, tenor, (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12), (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12) FROM g1)"""


@query(f"{_WITH}, {_LAYERS} SELECT layer, window_id, country, tenor, {r('w1')} AS w1, {r('w2')} AS w2 FROM layers")
def reg_layers(spark, d):
    rows, n = regression_rows(spark, d)
    out = regression.layered_fit(rows, "idx", SIZE, STRIDE, n, X2, "y", KEYS, 2, _rules(spark, ("fixed", 0, None, 0.5)))
    return out.select("layer", "window_id", *KEYS, rounded(F.col("w")[0]).alias("w1"), rounded(F.col("w")[1]).alias("w2"))


@query(f"""{_WITH}, {_LAYERS}, m AS (SELECT layer, country, tenor, avg(w1) AS w1, avg(w2) AS w2 FROM layers GROUP BY ALL), t AS (SELECT country, tenor, sum(w1) AS w1, sum(w2) AS w2 FROM m GROUP BY ALL)
SELECT country, tenor, 'x1' AS feature, {r("w1")} AS w FROM t UNION ALL SELECT country, tenor, 'x2', {r("w2")} FROM t""")
def reg_layer_totals(spark, d):
    rows, n = regression_rows(spark, d)
    out = regression.layered_fit(rows, "idx", SIZE, STRIDE, n, X2, "y", KEYS, 2, _rules(spark, ("fixed", 0, None, 0.5)))
    return regression.total_coefficients(out, KEYS, X2).withColumn("w", rounded("w"))


# two layers: plain fits with w2 = -w1 set after, cells under 1.2 masked, features that all outputs mask penalised and fitted again
_TIED = """{n}a AS (SELECT window_id, country, tenor, ((g22 + 1e-6) * b1 - g12 * b2) / ((g11 + 1e-6) * (g22 + 1e-6) - g12 * g12) AS p1, ((g11 + 1e-6) * b2 - g12 * b1) / ((g11 + 1e-6) * (g22 + 1e-6) - g12 * g12) AS p2, g11, g12, g22, b1, b2 FROM {g}),
{n}b AS (SELECT *, 1e6 * bool_and(abs(p1) < 1.2) OVER (PARTITION BY window_id)::INT AS f1, 1e6 * bool_and(abs(p2) < 1.2) OVER (PARTITION BY window_id)::INT AS f2 FROM {n}a),
{n} AS (SELECT window_id, country, tenor, CASE WHEN abs(p1) < 1.2 THEN ((g22 + f2) * b1 - g12 * b2) / ((g11 + f1) * (g22 + f2) - g12 * g12) ELSE p1 END AS w1,
  CASE WHEN abs(p2) < 1.2 THEN ((g11 + f1) * b2 - g12 * b1) / ((g11 + f1) * (g22 + f2) - g12 * g12) ELSE -p1 END AS w2 FROM {n}b)"""


@query(f"""{_WITH}, {_TIED.format(n='t0', g='g')},
rest AS (SELECT country, tenor, idx, avg(x1 * w1 + x2 * w2) AS p FROM win JOIN t0 USING (window_id, country, tenor) GROUP BY ALL),
gr AS (SELECT window_id, country, tenor, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22, sum(x1 * (y - p)) AS b1, sum(x2 * (y - p)) AS b2 FROM win JOIN rest USING (country, tenor, idx) GROUP BY ALL),
{_TIED.format(n='t1', g='gr')}
SELECT layer, window_id, country, tenor, {r('w1', 5)} AS w1, {r('w2', 5)} AS w2 FROM (SELECT 0 AS layer, * FROM t0 UNION ALL SELECT 1, * FROM t1)""")
def reg_tied_layers(spark, d):
    rows, n = regression_rows(spark, d)
    out = regression.tied_layers(rows, "idx", SIZE, STRIDE, n, X2, "y", KEYS, 2, ((0, 1),), 1.2, 1e6, True)
    return out.select("layer", "window_id", *KEYS, rounded(F.col("w")[0], 5).alias("w1"), rounded(F.col("w")[1], 5).alias("w2"))


@query(f"""WITH RECURSIVE {_WIN}, e AS (SELECT window_id, country, tenor, feature, w, 0.1 * w AS warm FROM wl WHERE window_id = 0
 UNION ALL SELECT wl.window_id, country, tenor, feature, wl.w, 0.9 * e.warm + 0.1 * wl.w FROM e JOIN wl USING (country, tenor, feature) WHERE wl.window_id = e.window_id + 1)
SELECT window_id, country, tenor, feature, {r("w")} AS w, {r("warm")} AS warm FROM e""")
def reg_warm_start(spark, d):
    out = regression.warm_started(_long(spark, d), KEYS)
    return out.select("window_id", *KEYS, "feature", rounded("w").alias("w"), rounded("warm").alias("warm"))


@query(f"""{_WITH}, v AS (SELECT 'zero' AS kind, abs(w2) AS m FROM w2 UNION ALL SELECT 'nonneg', greatest(0, -w1) FROM w2 UNION ALL SELECT 'offset', abs(w1 + w2) FROM w2 UNION ALL SELECT 'fixed', abs(w1 - 0.5) FROM w2)
SELECT kind, count(*) AS n, {r("max(m)")} AS max, {r("avg(m)")} AS mean, count(*) FILTER (m > 1e-6) AS n_over FROM v GROUP BY kind""")
def reg_violations(spark, d):
    rules = _rules(spark, ("zero", 1, None, 0.0), ("nonneg", 0, None, 0.0), ("offset", 0, 1, 0.0), ("fixed", 0, None, 0.5))
    return regression.violations(_long(spark, d), rules, KEYS).withColumn("max", rounded("max")).withColumn("mean", rounded("mean"))


@query(f"{_WITH} SELECT country, tenor, feature, {r('avg(w)')} AS mean, {r('stddev_pop(w)')} AS std, {r('stddev_pop(w) / (abs(avg(w)) + 1e-8)')} AS cv FROM wl GROUP BY ALL")
def reg_stability(spark, d):
    return regression.coefficient_stability(_long(spark, d), KEYS).select(*KEYS, "feature", *(rounded(c).alias(c) for c in ("mean", "std", "cv")))


def _average(spark, d):
    return _long(spark, d).groupBy(*KEYS, "feature", "feature_no").agg(F.avg("w").alias("w"))


_AVG = "av AS (SELECT country, tenor, feature, feature_no, avg(w) AS w FROM wl GROUP BY ALL)"


@query(f"{_WITH}, {_AVG} SELECT country, tenor, feature, {r('w')} AS w FROM av")
def reg_average(spark, d):
    return _average(spark, d).select(*KEYS, "feature", rounded("w").alias("w"))


@query(f"{_WITH}, {_AVG} SELECT country, tenor, count(*) FILTER (abs(w) > 1) AS n_active, {r('1 - avg((abs(w) > 1)::INT)')} AS sparsity, coalesce(array_to_string(list_sort(list(feature) FILTER (abs(w) > 1)), ','), '') AS active FROM av GROUP BY ALL")
def reg_active(spark, d):
    out = regression.active_features(_average(spark, d), KEYS, 1.0)
    return out.select(*KEYS, "n_active", rounded("sparsity").alias("sparsity"), F.array_join("active", ",").alias("active"))


@query(f"{_WITH}, {_AVG} SELECT feature, count(DISTINCT country) AS n_groups FROM av WHERE abs(w) > 1 GROUP BY feature")
def reg_usage(spark, d):
    return regression.feature_usage(_average(spark, d), "country", 1.0)


@query(f"""{_WITH}, e AS (SELECT window_id, country, tenor, (g11 + g22) / 2 AS m, sqrt(((g11 - g22) / 2) ** 2 + g12 ** 2) AS d FROM g) SELECT window_id, country, tenor, {r("(m + d) / (m - d)", 4)} AS condition FROM e""")
def reg_condition(spark, d):
    return regression.condition_numbers(_grams(spark, d), ["window_id", *KEYS], 2).withColumn("condition", rounded("condition", 4))


@query()
def reg_asymmetric_ridge(spark, d):
    rows, _ = regression_rows(spark, d)
    out = regression.asymmetric_ridge(rows.where("country = 'A' AND tenor = 'F'"), "idx", X3, "y")
    return out.select("alpha", rounded("mse").alias("mse"), "chosen", rounded("intercept").alias("intercept"), *(rounded(F.col("w")[k]).alias(c) for k, c in enumerate(X3)))


_WHOLE = "gw AS (SELECT country, tenor, sum(x1 * x1) + 1e-6 AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) + 1e-6 AS g22, sum(x1 * y) AS b1, sum(x2 * y) AS b2 FROM reg GROUP BY ALL), w0 AS (SELECT country, tenor, (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12) AS u1, (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12) AS u2 FROM gw)"


@query(f"{_WITH}, {_WHOLE} SELECT country, tenor, {r('u1')} AS w1, {r('u2')} AS w2 FROM w0")
def reg_global(spark, d):
    rows, _ = regression_rows(spark, d)
    out = regression.solve(regression.grams(rows, KEYS, X2, "y"), 2)
    return out.select(*KEYS, rounded(F.col("w")[0]).alias("w1"), rounded(F.col("w")[1]).alias("w2"))


@query(f"""{_WITH}, {_WHOLE}, p AS (SELECT idx, country, tenor, any_value(x1) AS x1, any_value(x2) AS x2, any_value(y) AS y, avg(x1 * w1 + x2 * w2) AS s FROM win JOIN w2 USING (window_id, country, tenor) GROUP BY idx, country, tenor)
SELECT country, tenor, {r("avg((y - x1 * u1 - x2 * u2) ** 2)")} AS global_mse, {r("avg((y - s) ** 2)")} AS sliced_mse FROM p JOIN w0 USING (country, tenor) GROUP BY ALL""")
def reg_global_against_sliced(spark, d):
    rows, n = regression_rows(spark, d)
    out = regression.global_against_sliced(rows, "idx", SIZE, STRIDE, n, X2, "y", KEYS)
    return out.select(*KEYS, rounded("global_mse").alias("global_mse"), rounded("sliced_mse").alias("sliced_mse"))


@query(f"""{_WITH}, c AS (SELECT window_id, tenor, sum(g11) + 1e-6 AS g11, sum(g12) AS g12, sum(g22) + 1e-6 AS g22, sum(CASE WHEN country = 'A' THEN b1 ELSE -b1 END) AS b1, sum(CASE WHEN country = 'A' THEN b2 ELSE -b2 END) AS b2 FROM g WHERE country IN ('A', 'N') GROUP BY ALL),
u AS (SELECT window_id, tenor, (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12) AS w1, (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12) AS w2 FROM c)
SELECT window_id, country, tenor, {r("w1 * s")} AS w1, {r("w2 * s")} AS w2 FROM u, (VALUES ('A', 1), ('N', -1)) v(country, s)""")
def reg_opposite_countries(spark, d):
    pairs = spark.createDataFrame([("A", "N")], "a string, b string")
    return _two(regression.solve_opposite(_grams(spark, d), pairs, "country", ["window_id", "tenor"], 2))


@query(f"""{_WITH} SELECT window_id, {r("avg(w)")} AS mean, {r("stddev_pop(w)")} AS std, {r("max(abs(w)) FILTER (feature = 'x2')")} AS worst, count(*) FILTER (feature = 'x2' AND abs(w) > 1e-6) AS n_missed, {r("stddev_pop(w) / (abs(avg(w)) + 1e-8)")} AS spread FROM wl GROUP BY window_id""")
def reg_diagnostics(spark, d):
    mask = spark.createDataFrame([("x1", False), ("x2", True)], "feature string, is_zero boolean")
    out = regression.window_diagnostics(_long(spark, d), mask, ["feature"])
    return out.select("window_id", "n_missed", *(rounded(c).alias(c) for c in ("mean", "std", "worst", "spread")))


@query(f"""{_WITH}, s AS (SELECT *, 1 - ss_res / (ss_tot + 1e-10) AS r2 FROM sc) SELECT country, {r("avg(r2) FILTER (tenor = 'F')")} AS "F", {r("avg(r2) FILTER (tenor = 'O')")} AS "O" FROM s GROUP BY country""")
def reg_report_matrix(spark, d):
    tables = regression.fit_report(regression.fit_scores(_solved(spark, d), 2, ["window_id", *KEYS]), "country", "tenor", ["F", "O"])
    return tables["matrix"].select("country", rounded("F").alias("F"), rounded("O").alias("O"))


@query()
def reg_ridge_predictions(spark, d):
    rows, _ = regression_rows(spark, d)
    rows = rows.where("country = 'A' AND tenor = 'F'")
    fit = regression.asymmetric_ridge(rows, "idx", X3, "y", alphas=[0.0, 0.5, 1.0])
    return regression.predict(rows, fit, X3).select("idx", rounded("pred").alias("pred"))


# after the fit ----------------------------------------------------------------------------------------------------------


@query(f"{_WITH}, k AS (SELECT *, row_number() OVER (PARTITION BY window_id, country, tenor ORDER BY abs(w) DESC, feature_no DESC) AS k FROM wl) SELECT window_id, country, tenor, feature, {r('CASE WHEN k = 1 THEN w ELSE 0 END')} AS w FROM k")
def post_keep_top(spark, d):
    return postprocess.keep_top(_long(spark, d), ["window_id", *KEYS], 1).select("window_id", *KEYS, "feature", rounded("w").alias("w"))


@query(f"{_WITH}, {_AVG}, t AS (SELECT *, max(abs(w)) OVER (PARTITION BY country, tenor) AS top FROM av) SELECT country, tenor, feature, abs(w) < top AS frozen FROM t")
def post_freeze(spark, d):
    return postprocess.freeze_mask(_average(spark, d), KEYS, k=1).select(*KEYS, "feature", "frozen")


@query(f"""{_WITH}, a AS (SELECT *, CASE WHEN abs(w) > 0.01 THEN w ELSE 0 END AS v FROM wl), b AS (SELECT *, CASE WHEN abs(v) > 0.2 * max(abs(v)) OVER (PARTITION BY window_id, country, tenor) THEN v ELSE 0 END AS u FROM a),
c AS (SELECT *, avg(sign(u)) OVER (PARTITION BY country, tenor, feature) AS s FROM b) SELECT window_id, country, tenor, feature, {r("CASE WHEN abs(s) < 0.5 THEN 0 ELSE u END")} AS w FROM c""")
def post_process(spark, d):
    return postprocess.post_process(_long(spark, d), KEYS, 0.01, 0.2, None, True).select("window_id", *KEYS, "feature", rounded("w").alias("w"))


@query(f"""{_WITH}, c AS (SELECT window_id, country, tenor, CASE WHEN abs(w1) > 0.01 AND abs(w1) > abs(w2) THEN w1 ELSE 0 END AS u1, CASE WHEN abs(w2) > 0.01 AND abs(w2) >= abs(w1) THEN w2 ELSE 0 END AS u2 FROM w2),
s AS (SELECT window_id, country, tenor, n, greatest(0, yy - 2 * (u1 * b1 + u2 * b2) + u1 * u1 * g11 + 2 * u1 * u2 * g12 + u2 * u2 * g22) AS ss_res, yy - sy * sy / n AS ss_tot FROM g JOIN c USING (window_id, country, tenor))
SELECT window_id, country, tenor, n, {r("ss_res", 4)} AS ss_res, {r("1 - ss_res / (ss_tot + 1e-10)")} AS r2 FROM s""")
def post_scores(spark, d):
    """Scores of the coefficients that post-processing leaves: a limit and the greatest of each output."""
    solved = _solved(spark, d)
    each = ["window_id", *KEYS]
    w = postprocess.post_process(regression.long_coefficients(solved, each, X2), KEYS, 0.01, top=1)
    out = regression.rescored(solved.drop("w"), w, 2, each)
    return out.select(*each, "n", rounded("ss_res", 4).alias("ss_res"), rounded("r2").alias("r2"))


@query(f"""{_WITH}, n AS (SELECT count(*) AS n FROM wl), k AS (SELECT *, row_number() OVER (ORDER BY abs(w) DESC) AS k FROM wl) SELECT window_id, country, tenor, feature, {r("CASE WHEN k <= floor(0.3 * n + 1e-9) THEN w ELSE 0 END")} AS w FROM k, n""")
def post_sparsity(spark, d):
    return postprocess.post_process(_long(spark, d), KEYS, 0.0, sparsity=0.7).select("window_id", *KEYS, "feature", rounded("w").alias("w"))


@query(f"{_WITH} SELECT window_id, country, tenor, feature, {r('avg(w) OVER (PARTITION BY window_id, country, tenor)')} AS equal, {r('w - avg(w) OVER (PARTITION BY window_id, country, tenor)')} AS sum_zero FROM wl")
def post_ties(spark, d):
    w, keys = _long(spark, d), ["window_id", *KEYS]
    tie = lambda kind: postprocess.tie_features(w, keys, spark.createDataFrame([(1, kind, "x1"), (1, kind, "x2")], "tie int, kind string, feature string"))
    a = tie("equal").select(*keys, "feature", rounded("w").alias("equal"))
    return a.join(tie("sum_zero").select(*keys, "feature", rounded("w").alias("sum_zero")), [*keys, "feature"])


def _curve(spark, d):
    p = panel(spark, d)
    return p.groupBy("country", "tenor").agg(F.avg("value").alias("w")).withColumn("feature", F.lit("value"))


def _asked(spark, d):
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("country"), (F.col("l_quantity") / 4).alias("tenor")).distinct()


def _interpolated(method: str, extrapolate: str = "nearest"):
    def run(spark, d):
        return postprocess.interpolate_curve(_curve(spark, d), _asked(spark, d), method, extrapolate)

    run.__name__ = f"interpolate_{method.replace('-', '_')}"
    return run


_KNOTS = """pl AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || '-' || l_linestatus AS country, CAST(floor((l_quantity - 1) / 5) + 1 AS DOUBLE) AS tenor, avg(l_discount) * 100 AS value FROM lineitem GROUP BY ALL),
c AS (SELECT country, tenor AS t0, avg(value) AS y0 FROM pl GROUP BY ALL), s AS (SELECT *, lead(t0) OVER w AS t1, lead(y0) OVER w AS y1, row_number() OVER w AS up, row_number() OVER (PARTITION BY country ORDER BY t0 DESC) AS down FROM c WINDOW w AS (PARTITION BY country ORDER BY t0)),
q AS (SELECT DISTINCT l_returnflag || '-' || l_linestatus AS country, l_quantity / 4 AS tenor FROM lineitem)"""
_SEGMENT = "JOIN s ON s.country = q.country AND ((q.tenor < t0 AND up = 1) OR (q.tenor >= t0 AND (q.tenor < t1 OR down = 1)))"
_KNOWN = "tenor IN (SELECT t0 FROM c WHERE c.country = q.country)"
query(f"WITH {_KNOTS} SELECT q.country, tenor, 'value' AS feature, {r('CASE WHEN tenor <= t0 OR down = 1 THEN y0 ELSE y0 + (y1 - y0) / (t1 - t0) * (tenor - t0) END')} AS value, tenor NOT IN (SELECT t0 FROM c WHERE c.country = q.country) AS interpolated FROM q {_SEGMENT}")(_interpolated("linear"))
query(f"WITH {_KNOTS} SELECT q.country, tenor, 'value' AS feature, {r('CASE WHEN tenor <= t0 OR down = 1 THEN y0 ELSE exp(ln(y0) + (ln(y1) - ln(y0)) / (t1 - t0) * (tenor - t0)) END')} AS value, tenor NOT IN (SELECT t0 FROM c WHERE c.country = q.country) AS interpolated FROM q {_SEGMENT}")(_interpolated("log-linear"))
query(f"WITH {_KNOTS} SELECT q.country, tenor, 'value' AS feature, {r('arg_min(y0, (abs(t0 - tenor), t0))')} AS value, false AS interpolated FROM q JOIN c ON c.country = q.country GROUP BY q.country, tenor")(_interpolated("nearest"))
# through the three nearest knots; beyond the ends along the line of the two nearest
_NEAR = f"""WITH {_KNOTS}, k AS (SELECT q.country, tenor, t0, y0, row_number() OVER (PARTITION BY q.country, tenor ORDER BY abs(t0 - tenor), t0) AS k, min(t0) OVER w AS lo, max(t0) OVER w AS hi FROM q JOIN c ON c.country = q.country WINDOW w AS (PARTITION BY q.country, tenor)),
n AS (SELECT country, tenor, any_value(lo) AS lo, any_value(hi) AS hi, {", ".join(f"max(t0) FILTER (k = {k}) AS t{k}, max(y0) FILTER (k = {k}) AS y{k}" for k in (1, 2, 3))} FROM k GROUP BY country, tenor)"""
_PARABOLA = " + ".join(f"y{a} * (tenor - t{b}) * (tenor - t{c}) / ((t{a} - t{b}) * (t{a} - t{c}))" for a, b, c in ((1, 2, 3), (2, 1, 3), (3, 1, 2)))
query(f"{_NEAR} SELECT country, tenor, 'value' AS feature, {r(f'CASE WHEN tenor < lo OR tenor > hi THEN y1 + (y2 - y1) / (t2 - t1) * (tenor - t1) ELSE {_PARABOLA} END')} AS value, tenor <> t1 AS interpolated FROM n")(_interpolated("quadratic", "linear"))
query()(_interpolated("cubic", "zero"))


@query(f"{_WITH}, {_AVG} SELECT country, tenor, string_agg(feature || '=' || printf('%.4f', w), ',' ORDER BY feature) AS hedges FROM av WHERE abs(w) > 0.5 GROUP BY ALL")
def post_hedge_table(spark, d):
    out = postprocess.hedge_table(_average(spark, d), 0.5)
    text = F.array_join(F.transform(F.map_entries("hedges"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    return out.select("country", "tenor", text.alias("hedges"))


# rule tables over nations ("countries"), market segments ("tenors") and regions ("futures") ---------------------------------


def _outputs(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("tenor")).distinct()


_OUT = "o AS (SELECT DISTINCT n_name AS country, c_mktsegment AS tenor, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {_OUT} SELECT country, tenor, 'zero' AS kind, 2 AS feature, CAST(NULL AS INT) AS feature2, 0.0::DOUBLE AS value FROM o WHERE tenor = 'BUILDING'
UNION ALL SELECT country, tenor, 'fixed', 0, NULL, 1.5 FROM o WHERE country IN ('NATION_1', 'NATION_2') UNION ALL SELECT country, tenor, 'offset', 0, 1, 0.0 FROM o""")
def rules_expanded(spark, d):
    rules = spark.createDataFrame(
        [("zero", None, ["BUILDING"], 2, None, 0.0), ("zero", None, ["BUILDING"], 2, None, 0.0), ("fixed", ["NATION_1", "NATION_2"], None, 0, None, 1.5), ("offset", None, None, 0, 1, 0.0)],
        "kind string, countries array<string>, tenors array<string>, feature int, feature2 int, value double",
    )
    return constraints.expand_rules(rules, _outputs(spark, d), 5)


def _futures(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 7")
    covers = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(F.array(F.lit("BUILDING"), F.lit("HOUSEHOLD")))
    return n.select(F.col("n_nationkey").cast("int").alias("feature"), F.col("n_name").alias("country"), covers.alias("tenors"))


def _allowed(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("country"), "n_regionkey"), n.select(F.col("n_name").alias("allowed_country"), "n_regionkey")
    return a.where("n_regionkey < 3").join(b, "n_regionkey").select("country", "allowed_country")


@query(f"""WITH {_OUT}, f AS (SELECT n_nationkey AS feature, n_regionkey AS fr FROM nation WHERE n_nationkey < 7)
SELECT country, tenor, CAST(feature AS INT) AS feature, NOT (region < 3 AND region = fr) AS is_zero FROM o, f""")
def rules_allowed(spark, d):
    return constraints.allowed_futures(_outputs(spark, d), _futures(spark, d), _allowed(spark, d))


@query(f"""WITH {_OUT}, f AS (SELECT n_nationkey AS feature, n_regionkey AS fr, CASE WHEN n_nationkey % 2 = 0 THEN ['BUILDING', 'MACHINERY'] ELSE ['BUILDING', 'HOUSEHOLD'] END AS cov FROM nation WHERE n_nationkey < 7),
c AS (SELECT country, tenor, feature, region < 3 AND region = fr AS ok, region < 3 AND region = fr AND list_contains(cov, tenor) AS cover FROM o, f),
k AS (SELECT *, sum(cover::INT) OVER (PARTITION BY country, tenor ORDER BY feature) AS rank, bool_or(cover) OVER (PARTITION BY country, tenor) AS any_cover FROM c)
SELECT country, tenor, CAST(feature AS INT) AS feature, NOT CASE WHEN any_cover THEN cover AND rank <= 2 ELSE ok AND tenor = 'FURNITURE' AND feature = 1 END AS is_zero FROM k""")
def rules_adjacent(spark, d):
    spare = spark.createDataFrame([("FURNITURE", 1)], "tenor string, feature int")
    return constraints.allowed_futures(_outputs(spark, d), _futures(spark, d), _allowed(spark, d), True, spare)


@query(f"""WITH {_OUT} SELECT country, tenor, 0 AS feature, CASE WHEN tenor = 'BUILDING' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM o WHERE country = 'NATION_3'""")
def rules_fixed_values(spark, d):
    values = spark.createDataFrame([("NATION_3", None, 0, 1.0), ("NATION_3", "BUILDING", 0, 2.0)], "country string, tenor string, feature int, value double")
    return constraints.fixed_values(_outputs(spark, d), values)


@query(f"""WITH {_OUT}, c AS (SELECT country, tenor, f AS feature, CASE WHEN f = 4 THEN 0 WHEN f < 2 AND region = 0 THEN -1 ELSE 1 END AS control FROM o, unnest(range(0, 5)) t(f))
SELECT country, tenor, 'zero' AS kind, CAST(feature AS INT) AS feature, CAST(NULL AS INT) AS feature2, 0.0::DOUBLE AS value FROM c WHERE control = 0
UNION ALL SELECT country, tenor, 'offset', CAST(min(feature) AS INT), CAST(max(feature) AS INT), 0.0 FROM c WHERE control = -1 GROUP BY country, tenor""")
def rules_control(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("country"), "n_regionkey")
    cells = _outputs(spark, d).join(n, "country").withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(4))))
    cells = cells.withColumn("control", F.when(F.col("feature") == 4, 0).when((F.col("feature") < 2) & (F.col("n_regionkey") == 0), -1).otherwise(1))
    return constraints.control_rules(cells, KEYS)


QUERIES, ORACLE_SQL = query.queries, query.sql


# the wide shape: 7 features, 168 outputs, whose sums of features are made once -------------------------------------------

X7 = list(WIDE_X)


def _wide_grams(spark, d):
    x, y, n = wide_rows(spark, d)
    return regression.shared_grams(x, y, "idx", SIZE, STRIDE, n, X7, "y", KEYS)


def _eliminated(columns: list[str]) -> str:
    """SQL of the windows' normal equations of these columns (expressions of x1 .. x7), by elimination, a table for each step: e0, e1, ... and w1, w2, ..."""
    p = len(columns)
    sums = [f"sum(({columns[i]}) * ({columns[j]})){' + 1e-6 * (' + str(1 + (columns[i].count('-'))) + ')' if i == j else ''} AS g{i}{j}" for i in range(p) for j in range(i, p)]
    out = [f"WITH {WIDE}, ww AS (SELECT w AS window_id, wide.* FROM wide, wn, unnest(range(0, (n_rows - {SIZE}) // {STRIDE} + 1)) t(w) WHERE idx >= w * {STRIDE} AND idx < w * {STRIDE} + {SIZE})"]
    out.append(f"e0 AS (SELECT window_id, country, tenor, {', '.join(sums)}, {', '.join(f'sum(({c}) * y) AS b{i}' for i, c in enumerate(columns))} FROM ww GROUP BY ALL)")
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    for k in range(p):
        rest = range(k + 1, p)
        new = [*(f"{g(i, j)} - {g(k, i)} * {g(k, j)} / g{k}{k} AS {g(i, j)}" for i in rest for j in rest if i <= j), *(f"b{i} - {g(k, i)} * b{k} / g{k}{k} AS b{i}" for i in rest)]
        done = [*(f"g{i}{j}" for i in range(k + 1) for j in range(i, p)), *(f"b{i}" for i in range(k + 1))]
        out.append(f"e{k + 1} AS (SELECT window_id, country, tenor, {', '.join([*done, *new])} FROM e{k})")
    for k in range(p - 1, -1, -1):
        left = "".join(f" - {g(k, j)} * w{j}" for j in range(k + 1, p))
        out.append(f"s{k} AS (SELECT *, (b{k}{left}) / g{k}{k} AS w{k} FROM {'e' + str(p) if k == p - 1 else 's' + str(k + 1)})")
    return ", ".join(out)


@query(f"{_eliminated(X7)} SELECT window_id, country, tenor, {', '.join(f'{r(f"w{k}", 4)} AS w{k + 1}' for k in range(7))} FROM s0")
def reg_wide(spark, d):
    out = regression.solve(_wide_grams(spark, d), 7)
    return out.select("window_id", *KEYS, *(rounded(F.col("w")[k], 4).alias(f"w{k + 1}") for k in range(7)))


# with w1 + w2 = 0 the two features are one: their difference
@query(f"{_eliminated(['x1 - x2', *X7[2:]])} SELECT window_id, country, tenor, {r('w0', 4)} AS w1, {r('-w0', 4)} AS w2, {', '.join(f'{r(f"w{k}", 4)} AS w{k + 2}' for k in range(1, 6))} FROM s0")
def reg_wide_kkt(spark, d):
    rules = spark.createDataFrame([(c, t, "offset", 0, 1, 0.0) for c in range(12) for t in range(14)], "country long, tenor long, kind string, feature int, feature2 int, value double")
    out = regression.solve(_wide_grams(spark, d), 7, "kkt", rules=rules, keys=KEYS)
    return out.select("window_id", *KEYS, *(rounded(F.col("w")[k], 4).alias(f"w{k + 1}") for k in range(7)))


@query(f"""{_eliminated(X7)} SELECT window_id, country, tenor, {r("g00 - 1e-6", 3)} AS g11, {r("g03", 3)} AS g14, {r("g66 - 1e-6", 3)} AS g77, {r("b0", 3)} AS b1, {r("b6", 3)} AS b7 FROM e0""")
def reg_wide_grams(spark, d):
    g = _wide_grams(spark, d)
    parts = {"g11": g.xx[0], "g14": g.xx[3], "g77": g.xx[27], "b1": g.xy[0], "b7": g.xy[6]}
    return g.select("window_id", *KEYS, *(rounded(c, 3).alias(k) for k, c in parts.items()))


# tables out and in --------------------------------------------------------------------------------------------------------


@query(f"{_WITH}, s AS (SELECT *, 1 - ss_res / (ss_tot + 1e-10) AS r2 FROM sc) SELECT country, {_ROLL} FROM s GROUP BY country")
def report_by_country(spark, d):
    """The fit report written as CSV folders, and its table by country read again."""
    scores = regression.fit_scores(_solved(spark, d), 2, ["window_id", *KEYS])
    path = scratch(spark)
    write_report(regression.fit_report(scores, "country", "tenor", ["F", "O"]), path)
    back = read_table(spark, f"{path}/by_country", "csv", "country string, n long, mean_r2 double, std_r2 double, min_r2 double, max_r2 double, overall_r2 double")
    return _rolled(back, ["country"])


@query(f"SELECT count(*) AS n, count(value) AS n_known, {r('sum(value)', 2)} AS total FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)")
def source_nan_to_null(spark, d):
    """A table written with NaN for every seventh value, read as one with NULL."""
    path = scratch(spark)
    table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")).write.parquet(path)
    back = read_table(spark, path)
    return back.agg(F.count("*").alias("n"), F.count("value").alias("n_known"), rounded(F.sum("value"), 2).alias("total"))
