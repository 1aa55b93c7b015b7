"""Asynchronous ticks, order tables, lead-lag and path features over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import asof, compare, leadlag, orders, signature, windows
from .base import TICKS, Registry, r, table, ticks

query = Registry()
#: Microseconds of the slabs that one hot series is cut into.
DAY = 86400e6
SYMBOLS = ["click", "error", "purchase", "signup", "view"]


def _sides(spark, d):
    t = ticks(spark, d)
    buys = t.where("side = 'buy'").select("symbol", "t", "event_id", "price")
    sells = t.where("side = 'sell'").select("symbol", "t", F.col("price").alias("other"), F.col("event_id").alias("other_id"))
    return buys, sells


def _asof(direction: str) -> str:
    rank = {"backward": "b.t <= a.t", "forward": "b.t >= a.t", "nearest": "true"}[direction]
    return f"""WITH {TICKS}, a AS (SELECT * FROM ticks WHERE side = 'buy'), b AS (SELECT * FROM ticks WHERE side = 'sell'),
p AS (SELECT a.symbol, a.event_id, a.t, a.price, b.t AS t_match, b.price AS other, b.event_id AS other_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) AS k FROM a JOIN b ON a.symbol = b.symbol AND {rank})
SELECT symbol, event_id, t, price, t_match, other, other_id FROM p WHERE k = 1"""


def _asof_query(direction: str, **options):
    def run(spark, d):
        buys, sells = _sides(spark, d)
        return asof.asof_join(buys, sells, "t", ["symbol"], ["other", "other_id"], direction, **options)

    return run


for _d in ("backward", "forward", "nearest"):
    _f = _asof_query(_d)
    _f.__name__ = f"asof_{_d}"
    query(_asof(_d))(_f)


@query(_asof("nearest") + " AND abs(t - t_match) <= 600000000")
def asof_tolerance_slabs(spark, d):
    """Nearest within ten minutes, in slabs of a day."""
    return _asof_query("nearest", tolerance=600e6, slab=DAY)(spark, d)


@query(f"""WITH {TICKS}, a AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY event_id) AS da FROM ticks WHERE side = 'buy'),
b AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY event_id) AS db FROM ticks WHERE side = 'sell'),
p AS (SELECT a.symbol, a.event_id, da, db, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) AS k FROM a JOIN b ON a.symbol = b.symbol)
SELECT symbol, {r("sum(da * db)", 1)} AS covariance FROM p WHERE k = 1 GROUP BY symbol""")
def asof_increments(spark, d):
    """Sum of products of increments matched by nearest time."""
    from pyspark.sql import Window

    buys, sells = _sides(spark, d)
    w = Window.partitionBy("symbol")
    buys = buys.withColumn("da", F.col("price") - F.lag("price").over(w.orderBy("event_id")))
    sells = sells.withColumn("db", F.col("other") - F.lag("other").over(w.orderBy("other_id")))
    both = asof.asof_join(buys, sells, "t", ["symbol"], ["db"])
    return both.groupBy("symbol").agg(rounded(F.sum(F.col("da") * F.col("db")), 1).alias("covariance"))


_HY = f"""WITH {TICKS}, s AS (SELECT unnest([-3600000000, 0, 3600000000]) AS shift),
i AS (SELECT symbol, lag(t) OVER w AS t0, t AS t1, price - lag(price) OVER w AS dp FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY t)),
a AS (SELECT * FROM i WHERE symbol = 'click' AND t0 IS NOT NULL), b AS (SELECT * FROM i WHERE symbol = 'view' AND t0 IS NOT NULL),
c AS (SELECT shift, sum(a.dp * b.dp) AS cov FROM s, a JOIN b ON a.t1 > b.t0 + shift AND b.t1 + shift > a.t0 GROUP BY shift),
v AS (SELECT (SELECT sum(dp * dp) FROM a) AS va, (SELECT sum(dp * dp) FROM b) AS vb)
SELECT shift, {r("coalesce(cov, 0)", 3)} AS cov, {r("coalesce(cov, 0) / sqrt(va * vb)")} AS corr FROM s LEFT JOIN c USING (shift), v"""


def _pair(spark, d):
    t = ticks(spark, d).withColumn("k", F.lit(1))
    return t.where("symbol = 'click'").select("k", "t", "price"), t.where("symbol = 'view'").select("k", "t", "price")


@query(_HY)
def overlap_covariance(spark, d):
    a, b = _pair(spark, d)
    out = asof.overlap_covariance(a, b, ["k"], "t", "price", [-3600000000, 0, 3600000000], DAY)
    return out.select(F.col("shift").cast("long").alias("shift"), rounded("cov", 3).alias("cov"), rounded("corr").alias("corr"))


@query(f"SELECT shift, corr FROM ({_HY}) ORDER BY -abs(corr), shift LIMIT 1")
def overlap_best_shift(spark, d):
    a, b = _pair(spark, d)
    out = asof.overlap_covariance(a, b, ["k"], "t", "price", [-3600000000, 0, 3600000000], DAY).select(F.lit("click").alias("a"), F.lit("view").alias("b"), F.col("shift").cast("long").alias("lag"), rounded("corr").alias("score"))
    return leadlag.best_lag(out).select(F.col("lag").alias("shift"), F.col("score").alias("corr"))


# a regular hourly grid per symbol, the base of lagged work
HOUR = 3_600_000
_GRID = f"""{TICKS}, e AS (SELECT min(ms) AS lo, max(ms) AS hi FROM ticks),
last AS (SELECT symbol, (ms - lo) // {HOUR} AS slot, arg_max(price, (ms, event_id)) AS price FROM ticks, e GROUP BY ALL),
g AS (SELECT symbol, unnest(range(0, (SELECT (hi - lo) // {HOUR} FROM e) + 1)) AS slot FROM (SELECT DISTINCT symbol FROM ticks)),
grid AS (SELECT symbol, slot, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY slot), 0) AS price FROM g LEFT JOIN last USING (symbol, slot))"""


def _grid(spark, d):
    return windows.resample(ticks(spark, d), ["symbol"], "ms", "price", HOUR, tie=("event_id",)).select("symbol", "slot", "price")


@query(f"WITH {_GRID} SELECT symbol, slot, price FROM grid")
def grid_resample(spark, d):
    return _grid(spark, d)


_CORR = f"""WITH {_GRID}, l AS (SELECT unnest(range(-6, 7)) AS lag),
s AS (SELECT x.symbol AS a, y.symbol AS b, CAST(lag AS INT) AS lag, count(*) AS n, corr(x.price, y.price) AS score, sum(x.price * y.price) AS raw FROM l, grid x JOIN grid y ON x.symbol < y.symbol AND y.slot = x.slot + lag GROUP BY ALL)"""


@query(f"{_CORR} SELECT a, b, lag, n, {r('score')} AS score FROM s")
def lag_correlation(spark, d):
    return leadlag.lagged_correlation(_grid(spark, d), "symbol", "slot", "price", list(range(-6, 7))).withColumn("score", rounded("score"))


@query(f"{_CORR} SELECT a, b, arg_min(lag, (-abs(score), lag)) AS lag, {r('arg_min(score, (-abs(score), lag))')} AS score FROM s GROUP BY a, b")
def lag_best(spark, d):
    return leadlag.best_lag(leadlag.lagged_correlation(_grid(spark, d), "symbol", "slot", "price", list(range(-6, 7)))).withColumn("score", rounded("score"))


@query(f"{_CORR} SELECT a, b, lag, n, {r('raw', 2)} AS score FROM s")
def lag_raw_products(spark, d):
    return leadlag.lagged_correlation(_grid(spark, d), "symbol", "slot", "price", list(range(-6, 7)), raw=True).withColumn("score", rounded("score", 2))


@query(f"WITH {_GRID} SELECT x.symbol AS a, y.symbol AS b, x.slot, x.price AS x, y.price AS y FROM grid x JOIN grid y ON x.symbol < y.symbol AND x.slot = y.slot")
def pair_self_join(spark, d):
    return leadlag.series_pairs(_grid(spark, d), "symbol", "slot", "price")


_SIG = """p AS (SELECT *, lag(x1) OVER w - first_value(x1) OVER w AS p1, lag(x2) OVER w - first_value(x2) OVER w AS p2, x1 - lag(x1) OVER w AS d1, x2 - lag(x2) OVER w AS d2 FROM path WINDOW w AS (PARTITION BY key ORDER BY o)),
s AS (SELECT key, coalesce(sum(d1), 0) AS s1, coalesce(sum(d2), 0) AS s2, coalesce(sum(p1 * d1 + d1 * d1 / 2), 0) AS s11, coalesce(sum(p1 * d2 + d1 * d2 / 2), 0) AS s12, coalesce(sum(p2 * d1 + d2 * d1 / 2), 0) AS s21, coalesce(sum(p2 * d2 + d2 * d2 / 2), 0) AS s22 FROM p GROUP BY key)"""
_TERMS = " UNION ALL ".join(f"SELECT key AS {{key}}, '{t}' AS term, {r(v, 3)} AS value FROM s" for t, v in (("", "1.0::DOUBLE"), ("1", "s1"), ("2", "s2"), ("1,1", "s11"), ("1,2", "s12"), ("2,1", "s21"), ("2,2", "s22")))


@query(f"WITH {TICKS}, path AS (SELECT symbol AS key, event_id AS o, event_id / 1000.0::DOUBLE AS x1, price / 100 AS x2 FROM ticks), {_SIG} {_TERMS.format(key='symbol')}")
def signature_level_two(spark, d):
    t = ticks(spark, d).withColumn("x1", F.col("event_id") / 1000).withColumn("x2", F.col("price") / 100)
    return signature.signature(t, ["symbol"], ["event_id"], ["x1", "x2"], 2).withColumn("value", rounded("value", 3))


def _level_three() -> str:
    """Terms of level three as sums of the levels before each step: S(ijk) gains S(ij) d_k + S(i) d_j d_k / 2 + d_i d_j d_k / 6."""
    ch = (1, 2)
    two = ", ".join(f"coalesce(sum(p{i} * d{j} + d{i} * d{j} / 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q{i}{j}" for i in ch for j in ch)
    sums = [("", "1.0::DOUBLE"), *((f"{i}", f"sum(d{i})") for i in ch), *((f"{i},{j}", f"sum(p{i} * d{j} + d{i} * d{j} / 2)") for i in ch for j in ch)]
    sums += [(f"{i},{j},{k}", f"sum(q{i}{j} * d{k} + p{i} * d{j} * d{k} / 2 + d{i} * d{j} * d{k} / 6)") for i in ch for j in ch for k in ch]
    steps = ", ".join(f"coalesce(x{i} - lag(x{i}) OVER w, 0) AS d{i}, coalesce(lag(x{i}) OVER w - first_value(x{i}) OVER w, 0) AS p{i}" for i in ch)
    terms = " UNION ALL ".join(f"SELECT symbol, '{t}' AS term, {r(v, 1)} AS value FROM q GROUP BY symbol" for t, v in sums)
    return f"""WITH {TICKS}, path AS (SELECT symbol, event_id AS o, event_id / 10000.0::DOUBLE AS x1, price / 100 AS x2 FROM ticks),
s AS (SELECT symbol, o, {steps} FROM path WINDOW w AS (PARTITION BY symbol ORDER BY o)), q AS (SELECT *, {two} FROM s WINDOW w AS (PARTITION BY symbol ORDER BY o)) {terms}"""


@query(_level_three())
def signature_level_three(spark, d):
    t = ticks(spark, d).withColumn("x1", F.col("event_id") / 10000).withColumn("x2", F.col("price") / 100)
    return signature.signature(t, ["symbol"], ["event_id"], ["x1", "x2"], 3).withColumn("value", rounded("value", 1))


@query(f"""WITH {TICKS}, path AS (SELECT user_id AS key, event_id AS o, event_id / 1000.0::DOUBLE AS x1, value / 100 AS x2 FROM events), {_SIG}
SELECT CAST(key AS BIGINT) AS user_id, {r("s12 - s21", 3)} AS area FROM s""")
def signature_area(spark, d):
    """Signed area between time and value for each user: S(1,2) - S(2,1)."""
    e = table(spark, d, "events").withColumn("x1", F.col("event_id") / 1000).withColumn("x2", F.col("value") / 100)
    s = signature.signature(e, ["user_id"], ["event_id"], ["x1", "x2"], 2)
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("value")))
    return s.groupBy("user_id").agg(rounded(pick("1,2") - pick("2,1"), 3).alias("area"))


_CROSS = f"""WITH {_GRID}, path AS (SELECT x.symbol || '>' || y.symbol AS key, x.slot AS o, x.price / 100 AS x1, y.price / 100 AS x2 FROM grid x JOIN grid y ON x.symbol <> y.symbol AND x.slot = y.slot), {_SIG}"""


@query(f"{_CROSS} SELECT split_part(key, '>', 1) AS source, split_part(key, '>', 2) AS target, {r('s12')} AS weight FROM s WHERE s12 > 0.05")
def signature_edges(spark, d):
    g = _grid(spark, d).withColumn("price", F.col("price") / 100)
    return signature.cross_terms(g, "symbol", "slot", "price").withColumn("weight", rounded("weight"))


@query(f"""WITH {_GRID}, l AS (SELECT unnest(range(-3, 4)) AS lag),
path AS (SELECT x.symbol || '>' || y.symbol || '>' || lag AS key, x.slot AS o, x.price / 100 AS x1, y.price / 100 AS x2 FROM l, grid x JOIN grid y ON x.symbol < y.symbol AND y.slot = x.slot + lag), {_SIG}
SELECT split_part(key, '>', 1) AS a, split_part(key, '>', 2) AS b, CAST(split_part(key, '>', 3) AS INT) AS lag, {r("sqrt(1 + s1*s1 + s2*s2 + s11*s11 + s12*s12 + s21*s21 + s22*s22)")} AS score FROM s""")
def signature_lags(spark, d):
    g = _grid(spark, d).withColumn("price", F.col("price") / 100)
    return leadlag.signature_lags(g, "symbol", "slot", "price", list(range(-3, 4))).withColumn("score", rounded("score"))


def _priced(spark, d):
    return _grid(spark, d).withColumn("price", F.col("price") / 100)


_ALIGN = f"""WITH RECURSIVE {_GRID}, v AS (SELECT symbol, slot, price / 100 AS v FROM grid), n AS (SELECT count(DISTINCT slot) AS n FROM v),
pair AS (SELECT x.symbol AS a, y.symbol AS b FROM (SELECT DISTINCT symbol FROM v) x JOIN (SELECT DISTINCT symbol FROM v) y ON x.symbol < y.symbol)"""


def _dtw_sql(name: str, cost: str) -> str:
    """Row by row: the least of the cells above and above left, then along the row as a running minimum over sums of costs."""
    row = f"SELECT p.a, p.b, p.i + 1 AS i, p.j, {cost} AS c, least(p.d, lag(p.d) OVER w) AS up FROM {name} p JOIN v x ON x.symbol = p.a AND x.slot = p.i + 1 JOIN v y ON y.symbol = p.b AND y.slot = p.j WINDOW w AS (PARTITION BY p.a, p.b ORDER BY p.j)"
    return f"""{name} AS (
  SELECT a, b, 0::BIGINT AS i, y.slot AS j, sum({cost}) OVER (PARTITION BY a, b ORDER BY y.slot) AS d FROM pair JOIN v x ON x.symbol = a AND x.slot = 0 JOIN v y ON y.symbol = b
  UNION ALL SELECT a, b, i, j, t + min(up - (t - c)) OVER (PARTITION BY a, b ORDER BY j) FROM (SELECT *, sum(c) OVER (PARTITION BY a, b ORDER BY j) AS t FROM ({row})))"""


@query(f"""{_ALIGN}, {_dtw_sql("one", "abs(x.v - y.v)")}, {_dtw_sql("two", "(x.v - y.v) ** 2")}
SELECT a, b, {r("one.d", 4)} AS distance, {r("sqrt(two.d)", 4)} AS root_distance FROM one JOIN two USING (a, b, i, j), n WHERE i = n - 1 AND j = n - 1""")
def align_dtw(spark, d):
    out = leadlag.dtw_distance(_priced(spark, d), "symbol", "slot", "price")
    squared = leadlag.dtw_distance(_priced(spark, d), "symbol", "slot", "price", squared=True).withColumnRenamed("distance", "root_distance")
    return out.join(squared, ["a", "b"]).select("a", "b", rounded("distance", 4).alias("distance"), rounded("root_distance", 4).alias("root_distance"))


@query()
def align_dtw_lags(spark, d):
    return leadlag.best_lag(leadlag.dtw_lags(_priced(spark, d), "symbol", "slot", "price", list(range(-5, 6))), "least").withColumn("score", rounded("score"))


# of equal ways the first of: from the column before, the same one, the one after; t sums the columns that a path was in
_STEP = "SELECT p.*, coalesce(lag(p.d) OVER w + 1, 'inf'::DOUBLE) AS l, coalesce(lead(p.d) OVER w + 1, 'inf'::DOUBLE) AS r, lag(p.t) OVER w AS lt, lead(p.t) OVER w AS rt FROM path p WINDOW w AS (PARTITION BY p.a, p.b ORDER BY p.j)"


@query(f"""{_ALIGN}, path AS (
  SELECT a, b, 0::BIGINT AS i, y.slot AS j, (x.v - y.v) ** 2 AS d, y.slot::DOUBLE AS t FROM pair JOIN v x ON x.symbol = a AND x.slot = 0 JOIN v y ON y.symbol = b
  UNION ALL SELECT q.a, q.b, q.i + 1, q.j, (x.v - y.v) ** 2 + least(q.l, q.d, q.r), CASE WHEN q.l <= q.d AND q.l <= q.r THEN lt WHEN q.d <= q.r THEN t ELSE rt END + q.j
  FROM ({_STEP}) q JOIN v x ON x.symbol = q.a AND x.slot = q.i + 1 JOIN v y ON y.symbol = q.b AND y.slot = q.j)
SELECT a, b, CAST(least(20, greatest(-20, round_even(arg_min(t, (d, j)) / any_value(n) - (any_value(n) - 1) / 2, 0))) AS BIGINT) AS lag, {r("min(d)")} AS cost FROM path, n WHERE i = n - 1 GROUP BY a, b""")
def align_optimal_path(spark, d):
    return leadlag.optimal_paths(_priced(spark, d), "symbol", "slot", "price", 1.0, 20).withColumn("cost", rounded("cost"))


@query()
def align_thermal_path(spark, d):
    out = leadlag.thermal_paths(_priced(spark, d), "symbol", "slot", "price", 2.0)
    return out.select("a", "b", rounded("log_final").alias("log_final"), F.transform("average_path", lambda x: rounded(x)).alias("average_path"))


@query()
def align_wavelet_energy(spark, d):
    return leadlag.wavelet_energy(_grid(spark, d), ["symbol"], "slot", "price").withColumn("energy", rounded("energy", 3))


@query()
def align_wavelet_lags(spark, d):
    return leadlag.feature_lags(_priced(spark, d), "symbol", "slot", "price", list(range(-3, 4))).withColumn("score", rounded("score"))


@query()
def align_signature_correlation(spark, d):
    return leadlag.feature_lags(_priced(spark, d), "symbol", "slot", "price", list(range(-3, 4)), "signature").withColumn("score", rounded("score"))


@query()
def align_all_methods(spark, d):
    return leadlag.all_methods(_priced(spark, d), "symbol", "slot", "price", 5)


# two event tables: the events with even and odd ids ------------------------------------------------------------------


def _halves(spark, d):
    t = ticks(spark, d)
    return t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1")


_HALVES = f"{TICKS}, a AS (SELECT * FROM ticks WHERE event_id % 2 = 0), b AS (SELECT * FROM ticks WHERE event_id % 2 = 1)"


@query(f"""WITH {_HALVES}, p AS (SELECT symbol, count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY symbol), q AS (SELECT symbol, count(*) / (SELECT count(*) FROM b) AS q FROM b GROUP BY symbol)
SELECT {r("sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2")} AS tv FROM p FULL JOIN q USING (symbol)""")
def compare_tv(spark, d):
    return compare.tv_distance(*_halves(spark, d), "symbol").select(rounded("tv").alias("tv"))


def _wasserstein(by: bool) -> str:
    keys = "symbol, side, " if by else ""
    return f"""WITH {_HALVES},
l AS (SELECT 0 AS src, {keys}'price' AS column_name, price AS x FROM a UNION ALL SELECT 0, {keys}'quantity', quantity FROM a UNION ALL SELECT 1, {keys}'price', price FROM b UNION ALL SELECT 1, {keys}'quantity', quantity FROM b),
c AS (SELECT {keys}column_name, x, count(*) FILTER (src = 0) AS na, count(*) FILTER (src = 1) AS nb FROM l GROUP BY ALL),
f AS (SELECT {keys}column_name, lead(x) OVER w - x AS gap, sum(na) OVER w / sum(na) OVER t AS fa, sum(nb) OVER w / sum(nb) OVER t AS fb, sum(na) OVER t AS ta, sum(nb) OVER t AS tb FROM c
 WINDOW w AS (PARTITION BY {keys}column_name ORDER BY x), t AS (PARTITION BY {keys}column_name))
SELECT {keys}column_name, {r("CASE WHEN min(ta) > " + ("1" if by else "0") + " AND min(tb) > " + ("1" if by else "0") + " THEN sum(abs(fa - fb) * gap) END")} AS distance FROM f GROUP BY ALL"""


@query(_wasserstein(False))
def compare_wasserstein(spark, d):
    return compare.wasserstein(*_halves(spark, d), ["price", "quantity"]).withColumn("distance", rounded("distance"))


@query(_wasserstein(True))
def compare_wasserstein_by_group(spark, d):
    return compare.wasserstein(*_halves(spark, d), ["price", "quantity"], ["symbol", "side"]).withColumn("distance", rounded("distance"))


_PERSIST = "WITH {halves}, l AS (SELECT symbol, side = lag(side, 5) OVER w AS same, row_number() OVER w AS k FROM {t} WINDOW w AS (PARTITION BY symbol ORDER BY event_id)), s AS (SELECT avg(same::INT) AS v FROM l WHERE k > 5 GROUP BY symbol)"


@query(_PERSIST.format(halves=TICKS, t="ticks") + f" SELECT {r('avg(v)')} AS persistence FROM s")
def compare_persistence(spark, d):
    return compare.persistence(ticks(spark, d), ["symbol"], ["event_id"], "side").select(rounded("persistence").alias("persistence"))


@query(f"""WITH {_HALVES}, x AS (SELECT symbol, avg(ms // 1000 % 86400) AS m FROM a GROUP BY symbol), y AS (SELECT symbol, avg(ms // 1000 % 86400) AS n FROM b GROUP BY symbol)
SELECT {r("sqrt(sum((m - n) ** 2))", 4)} AS distance FROM x JOIN y USING (symbol)""")
def compare_event_times(spark, d):
    a, b = (h.withColumn("time_s", F.floor(F.col("ms") / 1000) % 86400) for h in _halves(spark, d))
    return compare.time_distance(a, b, "symbol", "time_s").select(rounded("distance", 4).alias("distance"))


@query("""WITH m AS (SELECT quality AS a, toxic AS p FROM labels), n AS (SELECT count(*) AS n, avg((a = p)::INT) AS o FROM m),
e AS (SELECT sum((SELECT count(*) FROM m WHERE a = c) * (SELECT count(*) FROM m WHERE p = c)) / (SELECT n * n FROM n) AS e FROM (SELECT unnest([0, 1]) AS c))
SELECT n, round(100 * o, 6) + 0.0 AS accuracy, round((o - e) / (1 - e), 6) + 0.0 AS kappa FROM n, e""")
def compare_classes(spark, d):
    return compare.classification_scores(table(spark, d, "labels"), "quality", "toxic").select("n", rounded("accuracy").alias("accuracy"), rounded("kappa").alias("kappa"))


def _order_rows(spark, d):
    t = ticks(spark, d)
    flag = lambda k: (F.pmod("event_id", F.lit(3)) == k).cast("int")
    return t.select("event_id", "symbol", "quantity", "price", "side", (F.floor(F.col("ms") / 1000) % 86400).cast("long").alias("time_s"), flag(0).alias("add"), flag(1).alias("modify"), flag(2).alias("delete"))


@query(f"""WITH {TICKS} SELECT event_id, ms // 1000 % 86400 AS time_s, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], symbol) AS INT) AS slot, CAST(quantity AS DOUBLE) AS quantity, price,
 CASE WHEN side = 'buy' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS side, CASE WHEN event_id % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS modify, 12 AS n FROM ticks""")
def order_encode(spark, d):
    v = orders.encode(_order_rows(spark, d), SYMBOLS)
    return v.select("event_id", F.col("vector")[0].cast("long").alias("time_s"), F.array_position(F.slice("vector", 2, 5), F.lit(1.0)).cast("int").alias("slot"), F.col("vector")[6].alias("quantity"), F.col("vector")[7].alias("price"), F.col("vector")[8].alias("side"), F.col("vector")[10].alias("modify"), F.size("vector").alias("n"))


@query(f"""WITH {TICKS} SELECT event_id, ms // 1000 % 86400 AS d_time_s, symbol AS d_symbol, quantity AS d_quantity, price AS d_price, side AS d_side, CAST(event_id % 3 = 0 AS INT) AS d_add, CAST(event_id % 3 = 1 AS INT) AS d_modify, CAST(event_id % 3 = 2 AS INT) AS d_delete FROM ticks""")
def order_decode(spark, d):
    out = orders.decode(orders.encode(_order_rows(spark, d), SYMBOLS), SYMBOLS)
    return out.select("event_id", *(f"d_{c}" for c in ("time_s", "symbol", "quantity", "price", "side", "add", "modify", "delete")))


@query()
def order_masking(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 100).cast("int").alias("security_id"), F.lit(1).alias("side_id"), "value")
    return orders.mask_fields(e, "event_id", {"security_id": 100, "side_id": 2}, ["value"])


@query()
def order_side_correction(spark, d):
    rows = _order_rows(spark, d)
    return orders.correct_sides(rows, rows, "event_id").select("event_id", "side")


def _overall() -> str:
    """The parts of the score of events with even ids against those with odd ones, each in SQL."""
    ch = (1, 2, 3)
    steps = ", ".join(f"x{i} - lag(x{i}) OVER w AS d{i}, lag(x{i}) OVER w - first_value(x{i}) OVER w AS p{i}" for i in ch)
    sums = ", ".join([*(f"sum(d{i}) AS s{i}" for i in ch), *(f"sum(p{i} * d{j} + d{i} * d{j} / 2) AS s{i}{j}" for i in ch for j in ch)])
    terms = [*(f"s{i}" for i in ch), *(f"s{i}{j}" for i in ch for j in ch)]
    area = lambda c: f"(SELECT sum(abs(fa - fb) * gap) FROM (SELECT lead(x) OVER w - x AS gap, sum(na) OVER w / (SELECT count(*) FROM o WHERE half = 0) AS fa, sum(nb) OVER w / (SELECT count(*) FROM o WHERE half = 1) AS fb FROM (SELECT {c} AS x, count(*) FILTER (half = 0) AS na, count(*) FILTER (half = 1) AS nb FROM o GROUP BY ALL) WINDOW w AS (ORDER BY x)))"
    tv = lambda c: f"(SELECT sum(abs(p - q)) / 2 FROM (SELECT {c}, count(*) FILTER (half = 0) / (SELECT count(*) FROM o WHERE half = 0) AS p, count(*) FILTER (half = 1) / (SELECT count(*) FROM o WHERE half = 1) AS q FROM o GROUP BY ALL))"
    stay = lambda h: f"(SELECT coalesce(avg(v), 0) FROM (SELECT avg(same::INT) AS v FROM (SELECT symbol, side = lag(side, 5) OVER w AS same, row_number() OVER w AS k FROM o WHERE half = {h} WINDOW w AS (PARTITION BY symbol ORDER BY event_id)) WHERE k > 5 GROUP BY symbol))"
    return f"""WITH {TICKS}, o AS (SELECT event_id, event_id % 2 AS half, symbol, side, quantity / 100 AS quantity, price / 100 AS price, (ms // 1000 % 86400) / 86400 AS time_s FROM ticks),
step AS (SELECT half, {steps} FROM (SELECT half, event_id, time_s AS x1, quantity AS x2, price AS x3 FROM o) WINDOW w AS (PARTITION BY half ORDER BY event_id)),
sig AS (SELECT half, {sums} FROM step GROUP BY half),
part AS (SELECT {area("quantity")} AS w_quantity, {area("price")} AS w_price, {tv("symbol")} AS tv_symbol, {tv("side")} AS tv_side,
  (SELECT sqrt({" + ".join(f"(a.{t} - b.{t}) ** 2" for t in terms)}) FROM sig a, sig b WHERE a.half = 0 AND b.half = 1) AS signature_l2, abs({stay(0)} - {stay(1)}) AS side_lag)
SELECT {", ".join(f"{r(c, 4)} AS {c}" for c in ("w_quantity", "w_price", "tv_symbol", "tv_side", "signature_l2", "side_lag"))}, {r("w_quantity + w_price + tv_symbol + tv_side + signature_l2 + side_lag", 4)} AS overall FROM part"""


@query(_overall())
def order_overall_score(spark, d):
    a, b = (x.withColumn("price", F.col("price") / 100).withColumn("time_s", F.col("time_s") / 86400).withColumn("quantity", F.col("quantity") / 100) for x in (_order_rows(spark, d).where(f"event_id % 2 = {k}") for k in (0, 1)))
    out = orders.overall_score(a, b, ["event_id"])
    return out.select(*(rounded(c, 4).alias(c) for c in out.columns))


@query("""WITH s AS (SELECT event_type AS experiment, user_id % 7 AS p, avg(value) AS overall FROM events GROUP BY ALL)
SELECT experiment, arg_min(p, (overall, p)) AS p, round(min(overall), 6) + 0.0 AS overall FROM s GROUP BY experiment""")
def order_best_parameters(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("experiment"), (F.col("user_id") % 7).alias("p")).agg(F.avg("value").alias("overall"))
    return orders.best_parameters(s, ["experiment"], ["p"]).withColumn("overall", rounded("overall"))


@query()
def resample_rows(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return orders.resample_rows(e, ["event_id"], 2 * e.count()).select("time", "event_id", "event_type", "value")


@query()
def resample_marginals(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    out = orders.resample_marginals(e, ["event_id"], e.count(), ["value"], [["event_type"], ["user_id"]])
    return out.select("id", rounded("value").alias("value"), "event_type", "user_id")


@query("""SELECT event_type, round(avg(value), 6) + 0.0 AS mean_seconds, round(avg(user_id), 6) + 0.0 AS mean_r2 FROM events GROUP BY event_type""")
def compare_benchmark(spark, d):
    return compare.benchmark_summary(table(spark, d, "events"), "event_type", "value", "user_id").select("event_type", rounded("mean_seconds").alias("mean_seconds"), rounded("mean_r2").alias("mean_r2"))


QUERIES, ORACLE_SQL = query.queries, query.sql
