"""The table of registered queries and how their results are shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def shown(value, digits: int = 6):
    """A double as ``present`` shows it."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def quickly_shown(value, digits: int = 6):
    """``shown`` for very many rows: the decimal arithmetic of ``round`` only decides what lies near a half step.

    Elsewhere the nearest step is the same number of steps, and its quotient by the power of ten the same double.
    """
    steps = value.cast("double") * F.lit(float(10**digits))
    plain = (F.abs(steps) < 1e12) & (F.abs(steps - F.floor(steps) - 0.5) > 1e-3)
    return F.when(plain, F.rint(steps) / F.lit(float(10**digits)) + F.lit(0.0)).otherwise(shown(value, digits))


def present(df: DataFrame, **digits: int | None) -> DataFrame:
    """Comparable output: rounded doubles, dates as text, times as microseconds, flags as 0/1.

    ``None`` for the digits of a column: it is rounded already (``shown``).
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            places = digits.get(f.name, 6)
            c = c if places is None else shown(c, places)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, (T.BooleanType, T.IntegerType, T.ShortType)):
            c = c.cast("int").cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
