"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: str | Column) -> Column:
    """A double column with NaN as NULL: both mean missing."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def dot(weights: list[float] | list[Column], columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [w * c for w, c in zip(weights, columns, strict=True)])


def seconds_of_day(c: str | Column) -> Column:
    """Seconds since midnight of 'HH:MM:SS'; anything else, NULL included, is 0."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(F.when(c.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$"), c), ":")
    return F.coalesce(parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("int"), F.lit(0))


def time_text(seconds: str | Column) -> Column:
    """'HH:MM:SS' of seconds since midnight."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)).cast("long"))


def date_key(c: str | Column) -> Column:
    """yyyymmdd as an integer."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def positional(x: str | Column, t: str | Column, place: int, n: int) -> Column:
    """x + sin(t / 10000^(place / n))."""
    x, t = (F.col(c) if isinstance(c, str) else c for c in (x, t))
    return x + F.sin(t / F.lit(float(10000.0 ** (place / n))))


def happens(p: float, seed: int, *keys: str) -> Column:
    """True for a share p of keys, the same at every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(k).cast("string") for k in keys)), F.lit(1_000_000)) < F.lit(int(round(p * 1_000_000)))
