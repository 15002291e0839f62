"""Ordered operations over one entity's history without putting that history in one task.

A window partitioned by station, storm or radar alone sends a third of all rows
to a single task when one of them is that large.  Here each entity's time axis is
cut into slices, the window runs per (entity, slice), and what a slice has to know
about its neighbours travels in an edge table with ONE row per (entity, slice).
The edge table is pre-aggregated before its shuffle; it grows with the covered
time span and not with the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_SLICE = "_slice"
_MICROS = 1_000_000


def time_slice(ts: Column, seconds: float) -> Column:
    """Number of the slice of the given width that contains ``ts``; monotone in ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(float(seconds) * _MICROS))


def lookup_edges(sliced: DataFrame, by: list[str], edges: DataFrame) -> DataFrame:
    """Attach a slice's edge row to its rows; both sides meet on (entity, slice)."""
    return sliced.join(edges, [*by, _SLICE], "left")


def with_previous(
    df: DataFrame,
    by: list[str],
    order: str,
    fields: list[str],
    slice_of: Column,
    first: str | None = None,
) -> DataFrame:
    """Add ``prev_<field>`` of the entity's previous row (NULL on its first row).

    ``first`` names an optional column for the entity's smallest ``order`` value.
    ``order`` must be unique within the entity and is always among the fields.
    Fields stay separate columns: unused ones are pruned down to the scan, and
    numeric ones aggregate by hash.
    """
    fields = [order, *[f for f in fields if f != order]]
    sliced = df.withColumn(_SLICE, slice_of)
    in_slice = Window.partitionBy(*by, _SLICE).orderBy(order)
    across = Window.partitionBy(*by).orderBy(_SLICE)
    edges = (
        sliced.groupBy(*by, _SLICE)
        .agg(
            *[F.max_by(f, order).alias(f"_last_{f}") for f in fields],
            F.min(order).alias("_first"),
        )
        .select(
            *by,
            _SLICE,
            *[F.lag(f"_last_{f}").over(across).alias(f"_carry_{f}") for f in fields],
            F.min("_first").over(across).alias("_start"),
        )
    )
    lagged = sliced.select("*", *[F.lag(f).over(in_slice).alias(f"_lag_{f}") for f in fields])
    heads_slice = F.col(f"_lag_{order}").isNull()
    return lookup_edges(lagged, by, edges).select(
        *df.columns,
        *[
            F.when(heads_slice, F.col(f"_carry_{f}")).otherwise(F.col(f"_lag_{f}")).alias(f"prev_{f}")
            for f in fields
        ],
        *([F.col("_start").alias(first)] if first else []),
    )


def fill_forward(
    df: DataFrame, by: list[str], order: str, column: str, slice_of: Column, out: str
) -> DataFrame:
    """Carry the last non-NULL ``column`` forward along ``order`` within the entity."""
    sliced = df.withColumn(_SLICE, slice_of)
    in_slice = (
        Window.partitionBy(*by, _SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    before = (
        Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = (
        sliced.groupBy(*by, _SLICE)
        .agg(
            F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_last")
        )
        .select(*by, _SLICE, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    )
    return (
        lookup_edges(
            sliced.withColumn(out, F.last(column, ignorenulls=True).over(in_slice)), by, edges
        )
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .drop(_SLICE, "_carry")
    )


def running_total_before(
    df: DataFrame, by: list[str], order: str, value: str, slice_of: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over all rows of the entity that sort strictly before this one."""
    sliced = df.withColumn(_SLICE, slice_of)
    strictly_before = (Window.unboundedPreceding, -1)
    in_slice = Window.partitionBy(*by, _SLICE).orderBy(order).rowsBetween(*strictly_before)
    earlier = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(*strictly_before)
    edges = (
        sliced.groupBy(*by, _SLICE)
        .agg(F.sum(value).alias("_total"))
        .select(*by, _SLICE, F.sum("_total").over(earlier).alias("_carry"))
    )
    return (
        lookup_edges(sliced.withColumn(out, F.sum(value).over(in_slice)), by, edges)
        .withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop(_SLICE, "_carry")
    )
