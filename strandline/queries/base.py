"""Tables that the queries read, in Spark and as SQL common table expressions of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(expr: str, digits: int = 6) -> str:
    """SQL of functions.rounded()."""
    return f"(round({expr}, {digits}) + 0.0)"


# a curve panel: average discount in % by day, flag pair and quantity band
def panel(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(
        F.to_date("l_shipdate").alias("date"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("country"), (F.floor((F.col("l_quantity") - 1) / 5) + 1).cast("double").alias("tenor")
    ).agg((F.avg("l_discount") * 100).alias("value"))


PANEL = """panel AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || '-' || l_linestatus AS country,
  CAST(floor((l_quantity - 1) / 5) + 1 AS DOUBLE) AS tenor, avg(l_discount) * 100 AS value FROM lineitem GROUP BY ALL)"""


# one series for each flag pair: average discount by day
def series(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("date"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("country")).agg((F.avg("l_discount") * 100).alias("value"))


SERIES = """series AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || '-' || l_linestatus AS country, avg(l_discount) * 100 AS value
  FROM lineitem GROUP BY ALL)"""


# asynchronous ticks: one symbol per event type
def ticks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("event_type").alias("symbol"), us.alias("t"), F.floor(us / 1000).cast("long").alias("ms"), F.col("value").alias("price"), F.col("user_id").alias("quantity"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"))


TICKS = """ticks AS (SELECT event_id, event_type AS symbol, epoch_us(ts) AS t, epoch_us(ts) // 1000 AS ms, value AS price, user_id AS quantity,
  CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events)"""


# a security panel: average order value by day and priority
def prices(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("day"), F.col("o_orderpriority").alias("asset")).agg(F.avg("o_totalprice").alias("price"))


PRICES = """prices AS (SELECT CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS day, o_orderpriority AS asset, avg(o_totalprice) AS price
  FROM orders GROUP BY ALL)"""


# regression rows: three daily features, and a target for each return flag and line status
def regression_rows(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    from ..operators.windows import with_row_number

    li = table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    x = li.groupBy("date").agg((F.avg("l_quantity") / 10).alias("x1"), (F.avg("l_discount") * 10).alias("x2"), (F.avg("l_tax") * 10).alias("x3"))
    x = with_row_number(x, ["date"], out="idx")
    y = li.groupBy("date", F.col("l_returnflag").alias("country"), F.col("l_linestatus").alias("tenor")).agg((F.avg("l_extendedprice") / 10000).alias("y"))
    n = li.select("date").distinct().count()
    return x.join(y, "date").select("idx", "country", "tenor", "x1", "x2", "x3", "y"), n


REGRESSION = """x AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_quantity) / 10 AS x1, avg(l_discount) * 10 AS x2, avg(l_tax) * 10 AS x3 FROM lineitem GROUP BY ALL),
xi AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS idx FROM x),
yy AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS country, l_linestatus AS tenor, avg(l_extendedprice) / 10000 AS y FROM lineitem GROUP BY ALL),
reg AS (SELECT idx, country, tenor, x1, x2, x3, y FROM xi JOIN yy USING (date)),
size AS (SELECT count(*) AS n_rows FROM x)"""


# the wide shape: seven daily features and 12 x 14 outputs, each with a value for every day
WIDE_X = {"x1": "avg(l_quantity) / 10", "x2": "avg(l_discount) * 10", "x3": "avg(l_tax) * 10", "x4": "avg(l_extendedprice) / 10000", "x5": "avg(l_quantity * l_discount)", "x6": "avg(l_linenumber)", "x7": "avg(l_partkey % 7)"}


def wide_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    from ..operators.windows import with_row_number

    li = table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    x = with_row_number(li.groupBy("date").agg(*(F.expr(e).alias(c) for c, e in WIDE_X.items())), ["date"], out="idx")
    sums = li.groupBy("date", (F.col("l_suppkey") % 12).alias("country"), (F.col("l_partkey") % 14).alias("tenor")).agg((F.sum("l_quantity") / 10).alias("y"))
    cells = x.select("date", "idx").withColumn("country", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))).withColumn("tenor", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(13).cast("long"))))
    y = cells.join(sums, ["date", "country", "tenor"], "left").select("idx", "country", "tenor", F.coalesce("y", F.lit(0.0)).alias("y"))
    return x.drop("date"), y, li.select("date").distinct().count()


WIDE = f"""wx AS (SELECT CAST(l_shipdate AS DATE) AS date, {", ".join(f"{e} AS {c}" for c, e in WIDE_X.items())} FROM lineitem GROUP BY ALL),
wi AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS idx FROM wx), wn AS (SELECT count(*) AS n_rows FROM wx),
ws AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 12 AS country, l_partkey % 14 AS tenor, sum(l_quantity) / 10 AS y FROM lineitem GROUP BY ALL),
wc AS (SELECT date, idx, c.country, t.tenor, x1, x2, x3, x4, x5, x6, x7 FROM wi, (SELECT unnest(range(12)) AS country) c, (SELECT unnest(range(14)) AS tenor) t),
wide AS (SELECT wc.* EXCLUDE (date), coalesce(y, 0) AS y FROM wc LEFT JOIN ws USING (date, country, tenor))"""
