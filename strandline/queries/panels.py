"""Cleaning, windows and smoothing over the curve and security panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import date_key, positional, rounded, seconds_of_day, time_text
from ..operators import backtest, bonds, clean, smoothing, trend, windows
from .base import PANEL, PRICES, SERIES, Registry, panel, prices, r, series, table

query = Registry()


@query("""SELECT * FROM (VALUES ('l_quantity', true), ('l_discount', true), ('l_shipdate', true), ('l_missing', false)) t(column_name, present),
LATERAL (SELECT CASE column_name WHEN 'l_quantity' THEN count(*) FILTER (l_quantity IS NULL OR isnan(l_quantity)) WHEN 'l_discount' THEN count(*) FILTER (l_discount IS NULL OR isnan(l_discount))
 WHEN 'l_shipdate' THEN count(*) FILTER (l_shipdate IS NULL) ELSE 0 END AS n_null,
 CASE column_name WHEN 'l_quantity' THEN count(*) FILTER (isinf(l_quantity)) WHEN 'l_discount' THEN count(*) FILTER (isinf(l_discount)) ELSE 0 END AS n_infinite FROM lineitem) s,
LATERAL (SELECT present AND n_null = 0 AND n_infinite = 0 AS ok) o""")
def clean_validate(spark, d):
    return clean.validate(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_shipdate", "l_missing"])


@query("""WITH k AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag, l_linestatus FROM lineitem),
c AS (SELECT count(*) AS n FROM k GROUP BY day, l_returnflag, l_linestatus)
SELECT (SELECT count(*) FROM k) AS n_rows, (SELECT count(DISTINCT day) FROM k) AS n_day, (SELECT count(DISTINCT l_returnflag) FROM k) AS n_l_returnflag,
 (SELECT count(DISTINCT l_linestatus) FROM k) AS n_l_linestatus, (SELECT min(day) FROM k) AS first_date, (SELECT max(day) FROM k) AS last_date,
 (SELECT count(*) FROM c WHERE n > 1) AS n_duplicate_keys""")
def clean_profile(spark, d):
    return clean.profile(table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate")), ["day", "l_returnflag", "l_linestatus"], "day")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n_copies FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 10""")
def clean_duplicate_keys(spark, d):
    return clean.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS country, {r("avg(l_discount)")} AS value FROM lineitem GROUP BY ALL""")
def clean_dedupe_mean(spark, d):
    rows = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("country"), F.col("l_discount").alias("value"))
    return clean.dedupe(rows, ["date", "country"], "value").withColumn("value", rounded("value"))


@query("""SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY ALL""")
def clean_dedupe_first(spark, d):
    return clean.dedupe(table(spark, d, "events"), ["user_id", "event_type"], "value", "first", "event_id")


@query("""SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def clean_dedupe_last(spark, d):
    return clean.dedupe(table(spark, d, "events"), ["user_id", "event_type"], "value", "last", "event_id")


@query("""SELECT o_orderkey, 'o_totalprice' AS name, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders""")
def clean_to_long(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return clean.to_long(o, ["o_orderkey"], ["o_totalprice", "o_custkey"])


@query(f"""WITH {SERIES} SELECT date, {", ".join(f'{r(f"avg(value) FILTER (country = {c!r})")} AS "{c}"' for c in ("A-F", "A-O", "N-F", "N-O", "R-F", "R-O"))} FROM series GROUP BY date""")
def clean_to_wide(spark, d):
    names = ["A-F", "A-O", "N-F", "N-O", "R-F", "R-O"]
    wide = clean.to_wide(series(spark, d), ["date"], "country", "value", names)
    return wide.select("date", *(rounded(F.col(f"`{c}`")).alias(c) for c in names))


def _returns(kind: str) -> str:
    formula = {"returns": "(price - q) / q", "log_returns": "ln(price) - ln(q)", "diff": "price - q"}[kind]
    return f"""WITH {PRICES}, l AS (SELECT *, lag(price) OVER (PARTITION BY asset ORDER BY day) AS q FROM prices)
SELECT asset, day, {r(f"CASE WHEN q IS NULL THEN 0 ELSE {formula} END")} AS ret FROM l"""


@query(_returns("returns"))
def clean_returns(spark, d):
    return clean.to_returns(prices(spark, d), ["asset"], ["day"], "price", "returns").select("asset", "day", rounded("ret").alias("ret"))


@query(_returns("log_returns"))
def clean_log_returns(spark, d):
    return clean.to_returns(prices(spark, d), ["asset"], ["day"], "price").select("asset", "day", rounded("ret").alias("ret"))


@query(_returns("diff"))
def clean_differences(spark, d):
    return clean.to_returns(prices(spark, d), ["asset"], ["day"], "price", "diff").select("asset", "day", rounded("ret").alias("ret"))


@query(f"""WITH {PRICES}, l AS (SELECT *, lag(price) OVER (PARTITION BY asset ORDER BY day) AS q FROM prices)
SELECT asset, day, {r("ln(price) - ln(q)")} AS ret FROM l WHERE q IS NOT NULL""")
def clean_log_returns_dropped(spark, d):
    return clean.to_returns(prices(spark, d), ["asset"], ["day"], "price", first="drop").select("asset", "day", rounded("ret").alias("ret"))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%H:%M:%S') AS s FROM events)
SELECT event_id, CAST(split_part(s, ':', 1) AS INT) * 3600 + CAST(split_part(s, ':', 2) AS INT) * 60 + CAST(split_part(s, ':', 3) AS INT) AS time_s, s AS time_text, 0 AS bad FROM t""")
def clean_time_of_day(spark, d):
    e = table(spark, d, "events").select("event_id", seconds_of_day(F.date_format("ts", "HH:mm:ss")).alias("time_s"), seconds_of_day(F.concat(F.lit("x"), F.col("event_type"))).alias("bad"))
    return e.withColumn("time_text", time_text("time_s"))


@query("""SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date_key FROM orders""")
def clean_date_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", date_key("o_orderdate").alias("date_key"))


@query("""SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS o_orderpriority_code, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INT) AS o_orderstatus_code FROM orders""")
def clean_label_encode(spark, d):
    return clean.label_encode(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "o_orderpriority_code", "o_orderstatus_code")


@query(f"""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, {r("(o_totalprice - lo) / (hi - lo)")} AS o_totalprice FROM orders, m""")
def clean_min_max(spark, d):
    return clean.min_max_scale(table(spark, d, "orders"), ["o_totalprice"], F.col("o_orderkey") % 5 != 0).select("o_orderkey", rounded("o_totalprice").alias("o_totalprice"))


@query(f"""SELECT event_id, {r("value + sin(event_id / 10000 ** (1.0 / 4))")} AS encoded FROM events""")
def clean_positional(spark, d):
    return table(spark, d, "events").select("event_id", rounded(positional("value", "event_id", 1, 4)).alias("encoded"))


@query(f"""SELECT o_orderkey, {r("(o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w")} AS scaled FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def clean_group_normalise(spark, d):
    return clean.group_normalise(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "scaled").select("o_orderkey", rounded("scaled").alias("scaled"))


@query("""SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def clean_concat(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return clean.concat([a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))])


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders""")
def window_row_number(spark, d):
    return windows.with_row_number(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "idx")


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, idx, w AS window_id FROM n, unnest(range(0, (n - 200) // 150 + 1)) t(w) WHERE w * 150 <= idx AND idx < w * 150 + 200""")
def window_membership(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return windows.assign_windows(windows.with_row_number(o, ["o_orderkey"]), "idx", 200, 150, o.count()).select("o_orderkey", "idx", "window_id")


@query(f"""WITH {SERIES}, m AS (SELECT country, date, avg(value) OVER (PARTITION BY country ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM series)
SELECT country, date, {r("last_value(a IGNORE NULLS) OVER (PARTITION BY country ORDER BY date)")} AS smooth FROM m""")
def window_moving_average(spark, d):
    return windows.moving_average(series(spark, d), ["country"], ["date"], "value", 10).select("country", "date", rounded("smooth").alias("smooth"))


@query(f"""WITH {PRICES}, e AS (SELECT asset, min(day) AS lo, max(day) AS hi FROM prices GROUP BY asset), g AS (SELECT asset, unnest(range(lo, hi + 1)) AS day FROM e)
SELECT asset, day, {r("coalesce(price, 0)", 4)} AS price FROM g LEFT JOIN prices USING (asset, day)""")
def window_densify(spark, d):
    return windows.densify(prices(spark, d), ["asset"], "day", "price").withColumn("price", rounded("price", 4))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS time_idx FROM orders) SELECT * FROM o""")
def window_counter(spark, d):
    return windows.counter(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("""WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events)
SELECT event_id, event_type, k // 100 AS chunk_id, CAST(k % 100 AS INT) AS chunk_row FROM n""")
def window_chunks(spark, d):
    return windows.chunk_ids(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], 100)


@query(f"""WITH {PRICES}, w AS (SELECT asset, day, list(price) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS x, lead(price, 3) OVER (PARTITION BY asset ORDER BY day) AS y FROM prices)
SELECT asset, day, CAST(len(x) AS INT) AS n, {r("x[1]", 4)} AS oldest, {r("x[20]", 4)} AS newest, {r("list_sum(x)", 0)} AS total, {r("y", 4)} AS y FROM w WHERE len(x) = 20 AND y IS NOT NULL""")
def window_samples(spark, d):
    out = windows.make_windows(prices(spark, d), ["asset"], ["day"], ["price"], 20, 3, "price")
    x = F.transform("x", lambda s: s["price"])
    return out.select("asset", "day", F.size(x).alias("n"), rounded(x[0], 4).alias("oldest"), rounded(x[19], 4).alias("newest"), rounded(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 0).alias("total"), rounded("y", 4).alias("y"))


@query(f"""WITH {PRICES}, w AS (SELECT asset, day, price, lag(price) OVER (PARTITION BY asset ORDER BY day) AS p, lead(price) OVER (PARTITION BY asset ORDER BY day) AS y FROM prices)
SELECT asset, day, {r("p", 4)} AS x0, {r("price", 4)} AS x1, {r("y", 4)} AS y FROM w WHERE p IS NOT NULL AND y IS NOT NULL""")
def window_next_row(spark, d):
    out = windows.make_windows(prices(spark, d), ["asset"], ["day"], ["price"], 2, 1, "price")
    return out.select("asset", "day", *(rounded(F.col("x")[k]["price"], 4).alias(f"x{k}") for k in (0, 1)), rounded("y", 4).alias("y"))


@query("""WITH w AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS c FROM events)
SELECT event_id, CAST(len(c) AS INT) AS context_length, list_concat(c, list_resize([]::DOUBLE[], 8 - len(c), 0.0::DOUBLE))[8] AS last_slot, c[1] AS first_slot FROM w""")
def window_forward_context(spark, d):
    out = windows.forward_context(table(spark, d, "events"), ["user_id"], ["event_id"], "value", 8)
    return out.select("event_id", "context_length", F.col("context")[7].alias("last_slot"), F.col("context")[0].alias("first_slot"))


@query("""SELECT event_id, coalesce(lag(value) OVER w, value) AS lag1, coalesce(lag(value, 3) OVER w, 0) AS shifted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def window_lead_lag(spark, d):
    out = windows.lead_lag_embedding(table(spark, d, "events"), ["user_id"], ["event_id"], "value")
    return windows.shifted(out, ["user_id"], ["event_id"], "value", 3).select("event_id", "lag1", "shifted")


@query(f"""WITH w AS (SELECT event_id, user_id, value, lead(event_id) OVER w - event_id AS dx, lead(value) OVER w AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, {r("(y1 - value) / dx")} AS slope, {r("y1 - (value + (y1 - value) / dx * dx)")} AS remainder FROM w WHERE y1 IS NOT NULL""")
def window_local_derivative(spark, d):
    e = table(spark, d, "events").withColumn("x", F.col("event_id").cast("double"))
    return windows.local_derivative(e, ["user_id"], ["event_id"], "x", "value").select("event_id", rounded("slope").alias("slope"), rounded("remainder").alias("remainder"))


@query(f"""WITH {PRICES} SELECT asset, day, CASE WHEN day <= (SELECT max(day) - 60 FROM prices) THEN 'train' ELSE 'validation' END AS part,
 CASE WHEN day <= (SELECT min(day) + floor((max(day) - min(day) + 1) * 0.8) - 1 FROM prices) THEN 'train' ELSE 'validation' END AS part_by_ratio FROM prices""")
def window_time_split(spark, d):
    out = windows.time_split(prices(spark, d), "day", horizon=60).withColumnRenamed("part", "p")
    return windows.time_split(out, "day", ratio=0.8).select("asset", "day", F.col("p").alias("part"), F.col("part").alias("part_by_ratio"))


@query(f"""WITH {PRICES}, f AS (SELECT unnest(range(0, (2000 - 0 - 500) // 250)) AS fold)
SELECT CAST(fold AS INT) AS fold, CASE WHEN day - fold * 250 < 500 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM prices, f WHERE day - fold * 250 BETWEEN 0 AND 749 GROUP BY ALL""")
def window_walk_forward(spark, d):
    return windows.walk_forward(prices(spark, d), "day", 500, 250, 0, 1999).groupBy("fold", "part").agg(F.count("*").alias("n"))


# smoothing ----------------------------------------------------------------------------------------------------------

_EWMA = f"""WITH RECURSIVE {SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date) AS k FROM series),
e AS (SELECT country, date, k, value AS s FROM n WHERE k = 1
 UNION ALL SELECT n.country, n.date, n.k, 0.94 * e.s + 0.06 * n.value FROM e JOIN n ON n.country = e.country AND n.k = e.k + 1)
SELECT country, date, {r("s")} AS smooth FROM e"""


@query(_EWMA)
def smooth_ewma(spark, d):
    return smoothing.smooth_time(series(spark, d), ["country"], "date", "value").select("country", "date", rounded("smooth").alias("smooth"))


@query(f"""WITH RECURSIVE {SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date) AS k FROM series),
e AS (SELECT country, date, k, value AS s, value AS z FROM n WHERE k = 1
 UNION ALL SELECT n.country, n.date, n.k, 0.94 * e.s + 0.06 * n.value, 0.94 * e.z + 0.06 * (0.94 * e.s + 0.06 * n.value) FROM e JOIN n ON n.country = e.country AND n.k = e.k + 1)
SELECT country, date, {r("z")} AS smooth FROM e""")
def smooth_double_ewma(spark, d):
    return smoothing.smooth_time(series(spark, d), ["country"], "date", "value", "double_ewma").select("country", "date", rounded("smooth").alias("smooth"))


@query(f"""WITH RECURSIVE {SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date) AS k FROM series),
e AS (SELECT country, date, k, value AS s, CAST(1.0 AS DOUBLE) AS p FROM n WHERE k = 1
 UNION ALL SELECT n.country, n.date, n.k, e.s + (e.p + 0.01) / (e.p + 0.11) * (n.value - e.s), (e.p + 0.01) * (1 - (e.p + 0.01) / (e.p + 0.11)) FROM e JOIN n ON n.country = e.country AND n.k = e.k + 1)
SELECT country, date, {r("s")} AS smooth FROM e""")
def smooth_kalman(spark, d):
    return smoothing.smooth_time(series(spark, d), ["country"], "date", "value", "kalman").select("country", "date", rounded("smooth").alias("smooth"))


def _time(method: str):
    def run(spark, d):
        return smoothing.smooth_time(series(spark, d), ["country"], "date", "value", method).select("country", "date", rounded("smooth").alias("smooth"))

    run.__name__ = f"smooth_{method}"
    return run


query()(_time("gaussian_process"))
query()(_time("hodrick_prescott"))


# the end weights of a cubic over 11 equidistant points: what least squares gives, a fixed row
def _golay() -> str:
    from ..kernels.smoothers import _last_fit

    w = _last_fit(11, 3)
    back = " + ".join(f"({w[10 - k]!r}) * lag(value, {k}) OVER w" for k in range(11)).replace("np.float64", "")
    return f"""WITH {SERIES}, n AS (SELECT *, row_number() OVER w AS k, {back} AS s, avg(value) OVER (PARTITION BY country ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM series WINDOW w AS (PARTITION BY country ORDER BY date))
SELECT country, date, {r("CASE WHEN k <= 11 THEN m ELSE s END")} AS smooth FROM n"""


query(_golay())(_time("savitzky_golay"))


def _tenor(method: str):
    def run(spark, d):
        out = smoothing.smooth_tenor(panel(spark, d), ["date", "country"], "tenor", "value", method)
        return out.select("date", "country", "tenor", rounded("smooth").alias("smooth"))

    run.__name__ = f"curve_{method}"
    return run


query()(_tenor("p_spline"))


def _projected(rows: str, by: str, basis: list[str], name: str) -> str:
    """Tables that end in `name`: rows with `fit`, the least-squares projection of v on the basis within each group.

    Columns are made orthogonal one after another, each by a pass of window sums.
    """
    out, before = f"{name}_0 AS (SELECT *, {', '.join(f'{b} AS b{k}' for k, b in enumerate(basis))}, v AS rest, 0.0::DOUBLE AS fit FROM {rows})", f"{name}_0"
    for k in range(len(basis)):
        norm = f"nullif(sum(b{k} * b{k}) OVER g, 0)"
        part = lambda c, k=k, norm=norm: f"coalesce(sum({c} * b{k}) OVER g / {norm}, 0) * b{k}"
        columns = [f"{c} - {part(c)} AS {c}" for c in (*(f"b{j}" for j in range(k + 1, len(basis))), "rest")]
        after = name if k + 1 == len(basis) else f"{name}_{k + 1}"
        out += f", {after} AS (SELECT * REPLACE ({', '.join([*columns, "fit + " + part("rest") + " AS fit"])}) FROM {before} WINDOW g AS (PARTITION BY {by}))"
        before = after
    return out


_CURVES = f"{PANEL}, pv AS (SELECT date, country, tenor, value AS v, count(*) OVER (PARTITION BY date, country) AS n FROM panel)"
_LEVEL, _HUMP = "((1 - exp(-tenor / {0})) / (tenor / {0}))", "((1 - exp(-tenor / {0})) / (tenor / {0}) - exp(-tenor / {0}))"
_BASES = {
    "nelson_siegel": ["1.0::DOUBLE", _LEVEL.format("2.0"), _HUMP.format("2.0")],
    "svensson": ["1.0::DOUBLE", _LEVEL.format("2.0"), _HUMP.format("2.0"), _HUMP.format("5.0")],
    "polynomial": [f"((tenor - 5.5) ** {k})" for k in range(5)],
    "bernstein": [f"((tenor - 5.5) ** {k})" for k in range(6)],
}


def _fitted(method: str) -> str:
    """Tables that end in `fitted` (date, country, tenor, value, smooth): no more points than columns are met exactly."""
    basis = _BASES[method]
    smooth = f"CASE WHEN n <= {len(basis)} THEN v ELSE fit END"
    if method == "bernstein":
        smooth = f"CASE WHEN n <= {len(basis)} OR max(fit) OVER c - min(fit) OVER c < 0.01 * (max(v) OVER c - min(v) OVER c) THEN v ELSE fit END"
    return f"{_projected('pv', 'date, country', basis, 'f')}, fitted AS (SELECT date, country, tenor, v AS value, {smooth} AS smooth FROM f WINDOW c AS (PARTITION BY date, country))"


for _method in _BASES:
    query(f"WITH {_CURVES}, {_fitted(_method)} SELECT date, country, tenor, {r('smooth')} AS smooth FROM fitted")(_tenor(_method))

# ridge: rows sqrt(alpha) e_k with v = 0 join each curve
_RIDGE = f"""{_CURVES}, pr AS (SELECT date, country, tenor, v, n, -1 AS k FROM pv UNION ALL SELECT DISTINCT date, country, NULL, 0.0, n, unnest(range(0, 6)) FROM pv),
{_projected('pr', 'date, country', [f"CASE WHEN k < 0 THEN tenor ** {j} WHEN k = {j} THEN sqrt(0.1) ELSE 0 END" for j in range(6)], 'f')}"""
query(f"WITH {_RIDGE} SELECT date, country, tenor, {r('CASE WHEN n < 2 THEN v ELSE fit END')} AS smooth FROM f WHERE k < 0")(_tenor("polynomial_ridge"))

# a weighted quadratic around each tenor of a curve
_LOCAL = f"""{_CURVES}, pc AS (SELECT a.date, a.country, a.tenor AS centre, b.tenor, a.n, exp((b.tenor - a.tenor) ** 2 / -100) AS root, b.v * exp((b.tenor - a.tenor) ** 2 / -100) AS v FROM pv a JOIN pv b USING (date, country)),
{_projected('pc', 'date, country, centre', [f"root * (tenor - centre) ** {j}" for j in range(3)], 'f')}"""
query(f"WITH {_LOCAL} SELECT f.date, f.country, f.tenor, {r('CASE WHEN f.n <= 3 THEN pv.v ELSE fit END')} AS smooth FROM f JOIN pv USING (date, country, tenor) WHERE centre = f.tenor")(_tenor("local_quadratic"))

_CURVE_COPY = f"WITH {PANEL} SELECT date, country, tenor, {r('value')} AS smooth FROM panel"
query(_CURVE_COPY)(_tenor("cubic_spline"))
query(_CURVE_COPY)(_tenor("monotone_spline"))


# the monotone spline: slopes at knots are weighted harmonic means of the secants beside them, three-point ones at the ends
_END = "CASE WHEN ((2 * {h0} + {h1}) * {s0} - {h0} * {s1}) / ({h0} + {h1}) * {s0} <= 0 THEN 0 WHEN {s0} * {s1} <= 0 AND abs(((2 * {h0} + {h1}) * {s0} - {h0} * {s1}) / ({h0} + {h1})) > 3 * abs({s0}) THEN 3 * {s0} ELSE ((2 * {h0} + {h1}) * {s0} - {h0} * {s1}) / ({h0} + {h1}) END"
_PCHIP = f"""WITH {PANEL}, k1 AS (SELECT date, country, tenor AS x, value AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY date, country) AS n, lead(tenor) OVER w - tenor AS h, (lead(value) OVER w - value) / (lead(tenor) OVER w - tenor) AS s FROM panel WINDOW w AS (PARTITION BY date, country ORDER BY tenor)),
k2 AS (SELECT *, lag(h) OVER w AS hb, lag(s) OVER w AS sb, lead(h) OVER w AS hn, lead(s) OVER w AS sn, lag(h, 2) OVER w AS hbb, lag(s, 2) OVER w AS sbb FROM k1 WINDOW w AS (PARTITION BY date, country ORDER BY x)),
k3 AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN coalesce(s, sb) WHEN i = 1 THEN {_END.format(h0="h", h1="hn", s0="s", s1="sn")} WHEN i = n THEN {_END.format(h0="hb", h1="hbb", s0="sb", s1="sbb")}
  WHEN sb * s > 0 THEN (3 * h + 3 * hb) / ((2 * h + hb) / sb + (h + 2 * hb) / s) ELSE 0 END AS d FROM k2),
piece AS (SELECT date, country, i, n, x, y, h, d, lead(y) OVER w AS y1, lead(d) OVER w AS d1 FROM k3 WINDOW w AS (PARTITION BY date, country ORDER BY x)),
grid AS (SELECT DISTINCT date, country, t::DOUBLE AS tenor FROM panel, unnest(range(1, 11)) g(t)),
cell AS (SELECT grid.*, value, (SELECT count(*) FROM panel p WHERE p.date = grid.date AND p.country = grid.country AND p.tenor <= grid.tenor) AS c FROM grid LEFT JOIN panel USING (date, country, tenor)),
u AS (SELECT cell.*, y, y1, h, d, d1, (cell.tenor - x) / h AS u, n FROM cell LEFT JOIN piece ON piece.date = cell.date AND piece.country = cell.country AND piece.i = least(greatest(c, 1), n - 1))
SELECT date, country, tenor, {r("coalesce(value, y * (1 + 2 * u) * (1 - u) ** 2 + h * d * u * (1 - u) ** 2 + y1 * u ** 2 * (3 - 2 * u) + h * d1 * u ** 2 * (u - 1))")} AS smooth FROM u"""


@query(_PCHIP)
def curve_gap_fill(spark, d):
    """A whole grid of tenors for each curve: missing ones by the interpolating spline."""
    p = panel(spark, d)
    grid = p.select("date", "country").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("date", "country", F.col("k").cast("double").alias("tenor"))
    full = grid.join(p, ["date", "country", "tenor"], "left")
    return smoothing.smooth_tenor(full, ["date", "country"], "tenor", "value", "monotone_spline").select("date", "country", "tenor", rounded("smooth").alias("smooth"))


def _shrink(tenors, values):
    return values.mean() + 0.5 * (values - values.mean())


@query(f"""WITH {PANEL}, c AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m FROM panel WINDOW w AS (PARTITION BY date, country))
SELECT date, country, tenor, {r("CASE WHEN n < 2 THEN value ELSE m + 0.5 * (value - m) END")} AS smooth FROM c""")
def curve_custom(spark, d):
    return smoothing.smooth_tenor(panel(spark, d), ["date", "country"], "tenor", "value", _shrink).select("date", "country", "tenor", rounded("smooth").alias("smooth"))


@query()
def panel_pipeline(spark, d):
    out = smoothing.smooth_panel(panel(spark, d), "date", "country", "tenor", "value", "bernstein", "ewma", "nelson_siegel")
    return out.select("date", "country", "tenor", rounded("value").alias("value"), rounded("smooth").alias("smooth"))


def _gap(method: str):
    def run(spark, d):
        op = lambda x: smoothing.smooth_time(x, ["country"], "date", "value", method)
        import datetime

        return smoothing.causality_gap(series(spark, d), ["country"], "date", "value", datetime.date(1999, 1, 1), op).select(F.lit(method).alias("method"), (F.col("max_gap") <= 1e-10).alias("causal"))

    return run


_CAUSAL = ("ewma", "double_ewma", "kalman", "moving_average", "savitzky_golay", "gaussian_process", "hodrick_prescott")


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, true AS causal" for m in _CAUSAL))
def smooth_causality(spark, d):
    return clean.concat([_gap(m)(spark, d) for m in _CAUSAL])


_ROUGH = f"""WITH {SERIES}, l AS (SELECT country, date, value AS v, lag(value) OVER (PARTITION BY country ORDER BY date) AS p FROM series),
q AS (SELECT *, v - p AS dv, (v - p) - lag(v - p) OVER (PARTITION BY country ORDER BY date) AS dd, avg(v) OVER (PARTITION BY country) AS m FROM l)
SELECT country, count(*) AS n_valid, {r("avg(dd * dd)")} AS roughness, {r("var_pop(v)")} AS variance, {r("avg(abs(dv))")} AS mean_abs_change,
 {r("stddev_pop(dv)")} AS volatility, {r("sqrt(avg(dd * dd))")} AS rms_second, {r("sum((v - m) * (p - m)) / (count(*) - 1) / var_pop(v)")} AS autocorr_lag1 FROM q GROUP BY country"""


@query(_ROUGH)
def score_roughness(spark, d):
    out = smoothing.roughness(series(spark, d), ["country"], ["date"], "value")
    return out.select("country", "n_valid", *(rounded(c).alias(c) for c in ("roughness", "variance", "mean_abs_change", "volatility", "rms_second", "autocorr_lag1")))


@query()
def score_smoothing_methods(spark, d):
    p = panel(spark, d)
    at = p.groupBy("date").count().orderBy(F.desc("count"), "date").first()["date"]
    day = p.where(F.col("date") == F.lit(at))
    methods = {m: smoothing.smooth_tenor(day, ["date", "country"], "tenor", "value", m) for m in ("none", "bernstein", "nelson_siegel")}
    out = smoothing.compare_smoothing(methods, "date", "country", "tenor", at)
    return out.select("method", rounded("avg_roughness").alias("avg_roughness"), rounded("avg_rmse").alias("avg_rmse"))


def _bends(rows: str, value: str) -> str:
    """SQL of the root of the mean squared second difference of each curve."""
    return f"SELECT date, country, sqrt(avg(bend * bend)) AS rms FROM (SELECT date, country, ({value} - lag({value}, 1) OVER w) - (lag({value}, 1) OVER w - lag({value}, 2) OVER w) AS bend FROM {rows} WINDOW w AS (PARTITION BY date, country ORDER BY tenor)) GROUP BY ALL"


@query(f"""WITH {_CURVES}, {_fitted("nelson_siegel")}, a AS ({_bends("fitted", "value")}), b AS ({_bends("fitted", "smooth")})
SELECT date, country, {r("a.rms")} AS original_roughness, {r("b.rms")} AS smooth_roughness, {r("CASE WHEN a.rms > 1e-9 THEN (1 - b.rms / a.rms) * 100 ELSE 0 END")} AS reduction FROM a JOIN b USING (date, country)""")
def score_smoothing_effect(spark, d):
    out = smoothing.smoothing_effect(smoothing.smooth_tenor(panel(spark, d), ["date", "country"], "tenor", "value", "nelson_siegel"), ["date", "country"], "tenor")
    return out.select("date", "country", *(rounded(c).alias(c) for c in ("original_roughness", "smooth_roughness", "reduction")))


@query()
def score_smoothing_grid(spark, d):
    out = smoothing.grid_search(panel(spark, d), ["date", "country"], "tenor", "value", "p_spline", "lam", [0.1, 1.0, 10.0])
    return out.select("parameter", *(rounded(c).alias(c) for c in ("mse", "roughness", "score")))


# trend, backtest, bonds -----------------------------------------------------------------------------------------------

_TREND = f"""WITH {SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date) AS k FROM series),
w AS (SELECT country, date, k, regr_slope(value, k) OVER f AS slope, regr_r2(value, k) OVER f AS r2, var_pop(value) OVER f AS v FROM n WINDOW f AS (PARTITION BY country ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT country, date, k - 50 AS start, k - 50 + 25 AS centre, {r("slope")} AS slope, {r("sqrt(v * 50 * (1 - r2) / 48 / (50 * 2499 / 12.0))")} AS stderr FROM w WHERE k >= 50"""


@query(_TREND)
def trend_rolling(spark, d):
    out = trend.rolling_trend(series(spark, d), ["country"], ["date"], "value")
    return out.select("country", "date", "start", "centre", rounded("slope").alias("slope"), rounded("stderr").alias("stderr"))


def _series_p(dof: int) -> str:
    """SQL of the two-sided p-value of t for an even number of degrees of freedom: a finite series in cos^2 = dof / (dof + t^2)."""
    out = "1"
    for k in range(dof // 2 - 1, 0, -1):
        out = f"(1 + {2 * k - 1}.0 / {2 * k} * (dof / (dof + t * t)) * {out})"
    return f"1 - abs(t) / sqrt(dof + t * t) * {out}".replace("dof", str(float(dof)))


@query(f"""WITH {SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date) AS k FROM series),
w AS (SELECT country, k, regr_slope(value, k) OVER f AS slope, regr_r2(value, k) OVER f AS r2, var_pop(value) OVER f AS v FROM n WINDOW f AS (PARTITION BY country ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
t AS (SELECT country, k - 25 AS centre, slope, slope / sqrt(v * 50 * (1 - r2) / 48 / (50 * 2499 / 12.0)) AS t FROM w WHERE k >= 50),
p AS (SELECT *, {_series_p(48)} AS p FROM t)
SELECT country, max(centre) AS centre, {r("arg_max(slope, centre)")} AS slope, {r("arg_max(p, centre)")} AS p FROM p WHERE p < 0.05 GROUP BY country""")
def trend_significance(spark, d):
    out = trend.rolling_trend(series(spark, d), ["country"], ["date"], "value")
    return trend.last_significant(out, ["country"]).select("country", "centre", rounded("slope").alias("slope"), rounded("p").alias("p"))


# the filter forward and the smoother backward, row by row
_LEVEL = f"""WITH RECURSIVE {SERIES}, s AS (SELECT country, date, value, row_number() OVER (PARTITION BY country ORDER BY date) AS k, count(*) OVER (PARTITION BY country) AS n FROM series),
f AS (SELECT country, date, value, k, n, value AS l, 1.0::DOUBLE AS p, 0.0::DOUBLE AS total FROM s WHERE k = 1
  UNION ALL SELECT s.country, s.date, s.value, s.k, s.n, f.l + (f.p + 0.5) / (f.p + 1.5) * (s.value - f.l), (f.p + 0.5) / (f.p + 1.5), f.total + (s.value - f.l) ** 2 / (f.p + 1.5) FROM f JOIN s ON s.country = f.country AND s.k = f.k + 1),
b AS (SELECT country, date, value, k, n, l, l AS m, p AS v FROM f WHERE k = n
  UNION ALL SELECT f.country, f.date, f.value, f.k, f.n, f.l, f.l + f.p / (f.p + 0.5) * (b.m - f.l), f.p + (f.p / (f.p + 0.5)) ** 2 * (b.v - f.p - 0.5) FROM b JOIN f ON f.country = b.country AND f.k = b.k - 1)"""


@query(f"""{_LEVEL} SELECT b.country, b.date, {r("b.l")} AS filtered, {r("b.m")} AS smoothed, {r("sqrt(b.v * e.total / (e.n - 1))")} AS stderr FROM b JOIN f e ON e.country = b.country AND e.k = e.n""")
def trend_level_fixed(spark, d):
    """The local-level model with a given variance ratio."""
    out = trend.level_series(series(spark, d), ["country"], "date", "value", 0.5)
    return out.select("country", "date", *(rounded(c).alias(c) for c in ("filtered", "smoothed", "stderr")))


@query()
def trend_level_series(spark, d):
    """The local-level model of the greatest likelihood."""
    out = trend.level_series(series(spark, d), ["country"], "date", "value")
    return out.select("country", "date", *(rounded(c).alias(c) for c in ("filtered", "smoothed", "stderr")))


@query()
def trend_stationarity(spark, d):
    out = trend.trend_report(series(spark, d), ["country"], "date", "value")
    return out.select("country", "n", *(rounded(c).alias(c) for c in ("adf", "adf_p", "kpss", "kpss_p", "level", "smoothed", "level_stderr", "last_slope")), "adf_lag", "kpss_lag", "stationary", "n_windows", "n_significant", "last_centre")


@query(f"""WITH {PRICES}, l AS (SELECT asset, day, price, lag(price) OVER (PARTITION BY asset ORDER BY day) AS q FROM prices),
b AS (SELECT asset, day, CASE WHEN q IS NULL THEN 0 ELSE (price - q) / q END AS ret, CASE WHEN q IS NULL THEN 0.2 ELSE q / (q + 200000) END AS weight FROM l),
w AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY asset ORDER BY day), 0) AS w0 FROM b)
SELECT day, {r("sum(weight * ret)")} AS gross, {r("sum(abs(weight - w0)) * 0.0002")} AS turnover_cost, {r("sum(weight * ret) - sum(abs(weight - w0)) * 0.0002")} AS net FROM w GROUP BY day""")
def backtest_portfolio(spark, d):
    out = _portfolio(spark, d)
    return out.select("day", *(rounded(c).alias(c) for c in ("gross", "turnover_cost", "net")))


def _portfolio(spark, d):
    from pyspark.sql import Window

    q = F.lag("price").over(Window.partitionBy("asset").orderBy("day"))
    rows = clean.to_returns(prices(spark, d), ["asset"], ["day"], "price", "returns").withColumn("weight", F.when(q.isNull(), 0.2).otherwise(q / (q + 200000)))
    return backtest.portfolio_returns(rows, rows, "day", "asset")


_NET = f"""{PRICES}, l AS (SELECT asset, day, price, lag(price) OVER (PARTITION BY asset ORDER BY day) AS q FROM prices),
b AS (SELECT asset, day, CASE WHEN q IS NULL THEN 0 ELSE (price - q) / q END AS ret, CASE WHEN q IS NULL THEN 0.2 ELSE q / (q + 200000) END AS weight FROM l),
w AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY asset ORDER BY day), 0) AS w0 FROM b),
net AS (SELECT day, sum(weight * ret) - sum(abs(weight - w0)) * 0.0002 AS net FROM w GROUP BY day)"""


@query(f"WITH {_NET} SELECT {r('(avg(net) - 0.0001) / (stddev_samp(net) + 1e-6)')} AS sharpe FROM net")
def backtest_sharpe(spark, d):
    return backtest.sharpe(_portfolio(spark, d), "net", 0.0001).select(rounded("sharpe").alias("sharpe"))


@query(f"""WITH {_NET}, s AS (SELECT *, net / 100 AS x FROM net) SELECT count(*) AS n, {r("exp(sum(ln(1 + x))) - 1")} AS cumulative, {r("avg(x) / (stddev_pop(x) + 1e-6) * sqrt(252)")} AS annual_sharpe FROM s""")
def backtest_summary(spark, d):
    out = backtest.backtest_summary(_portfolio(spark, d).withColumn("x", F.col("net") / 100), "x")
    return out.select("n", rounded("cumulative").alias("cumulative"), rounded("annual_sharpe").alias("annual_sharpe"))


@query(f"""WITH {_NET}, s AS (SELECT day, net, count(*) OVER f AS c, avg(net) OVER f / (stddev_samp(net) OVER f + 1e-6) AS sh FROM net WINDOW f AS (ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
t AS (SELECT day, CASE WHEN c >= 20 THEN sh ELSE 0 END AS sh, CASE WHEN c >= 20 THEN greatest(0, (1 - sh) * 20) ELSE 0 END AS ttt FROM s)
SELECT day, {r("sh")} AS rolling_sharpe, {r("ttt")} AS time_to_target, {r("0.5 * (1 - 0.1 / (1 + exp(-ttt)))")} AS scaled_weight FROM t""")
def backtest_rolling(spark, d):
    net = _portfolio(spark, d).withColumn("book", F.lit("all")).withColumn("weight", F.lit(0.5))
    out = backtest.scale_positions(backtest.rolling_sharpe(net, ["book"], ["day"], "net"), "weight")
    return out.select("day", *(rounded(c).alias(c) for c in ("rolling_sharpe", "time_to_target", "scaled_weight")))


@query(f"""WITH {PRICES}, l AS (SELECT asset, day, price, lag(price) OVER (PARTITION BY asset ORDER BY day) AS q FROM prices), e AS (SELECT *, abs(price - q) AS err FROM l WHERE q IS NOT NULL),
t AS (SELECT asset, max(err) AS top FROM e GROUP BY asset), c AS (SELECT asset, day, q, 1 - err / (top + 1e-6) AS conf FROM e JOIN t USING (asset))
SELECT asset, day, {r("conf")} AS confidence, {r("least(greatest(conf * 2, 0), 2)")} AS leverage, {r("q * least(greatest(conf * 2, 0), 2)", 3)} AS adjusted FROM c""")
def backtest_confidence(spark, d):
    from pyspark.sql import Window

    rows = prices(spark, d).withColumn("q", F.lag("price").over(Window.partitionBy("asset").orderBy("day"))).where("q IS NOT NULL")
    out = backtest.confidence(rows, "price", "q", ["asset"])
    return out.select("asset", "day", rounded("confidence").alias("confidence"), rounded("leverage").alias("leverage"), rounded("adjusted", 3).alias("adjusted"))


def _bonds(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("bond"), F.lit(0.0).alias("ts"), (F.col("p_size") + F.pmod("p_partkey", F.lit(4)) / 4).alias("te"), F.lit(2.0).alias("freq"), (F.col("p_retailprice") / 40000).alias("coupon"))


def _curve(spark, d):
    o = table(spark, d, "orders")
    bands = o.groupBy((F.floor(F.pmod("o_orderkey", F.lit(60)) / 6) * 6 + 1).cast("double").alias("t")).agg(F.avg("o_totalprice").alias("p"))
    return bands.select("t", F.exp(-F.col("t") * (0.01 + F.col("p") / 1e8)).alias("df"))


_BONDS = """bonds AS (SELECT p_partkey AS bond, p_size + (p_partkey % 4) / 4.0 AS te, p_retailprice / 40000 AS coupon FROM part),
nn AS (SELECT *, CAST(floor(te * 2 + 1e-12) AS INT) AS n FROM bonds),
times AS (SELECT bond, te, coupon, CAST(k AS INT) AS n, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE te - (n - k) / 2.0 END AS t FROM nn, unnest(range(0, n + 1)) u(k)),
sched AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY bond ORDER BY n), 0) AS accrual FROM times),
pts AS (SELECT CAST(floor((o_orderkey % 60) / 6) * 6 + 1 AS DOUBLE) AS t, avg(o_totalprice) AS p FROM orders GROUP BY 1),
curve AS (SELECT t, -t * (0.01 + p / 1e8) AS l FROM pts UNION ALL SELECT 0.0, 0.0),
seg AS (SELECT t AS t0, l AS l0, lead(t) OVER (ORDER BY t) AS t1, lead(l) OVER (ORDER BY t) AS l1, row_number() OVER (ORDER BY t DESC) AS back FROM curve),
disc AS (SELECT s.*, exp(l0 + (l1 - l0) * (s.t - t0) / (t1 - t0)) AS df FROM sched s JOIN seg ON t1 IS NOT NULL AND s.t >= t0 AND (s.t < t1 OR back = 2))"""


@query(f"WITH {_BONDS} SELECT bond, n, {r('t')} AS t, {r('accrual')} AS accrual FROM sched")
def bond_schedules(spark, d):
    return bonds.bond_schedule(_bonds(spark, d)).select("bond", "n", rounded("t").alias("t"), rounded("accrual").alias("accrual"))


@query(f"WITH {_BONDS} SELECT bond, {r('(1 - arg_max(df, n)) / (sum(df * accrual) + 1e-16)')} AS par_yield FROM disc GROUP BY bond")
def bond_par_yields(spark, d):
    return bonds.par_yields(bonds.bond_schedule(_bonds(spark, d)), _curve(spark, d)).select("bond", rounded("par_yield").alias("par_yield"))


@query(f"WITH {_BONDS} SELECT bond, {r('sum(df * coupon * accrual) + arg_max(df, n)')} AS price FROM disc GROUP BY bond")
def bond_prices(spark, d):
    b = _bonds(spark, d)
    return bonds.price_bonds(bonds.bond_schedule(b), b, _curve(spark, d)).select("bond", rounded("price").alias("price"))


QUERIES, ORACLE_SQL = query.queries, query.sql
