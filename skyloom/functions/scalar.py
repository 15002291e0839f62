"""Parsing, unit, flag and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skyloom.constants import MAX_RANGE_DAYS, RAIN_THRESHOLD_MM, TRACK_SENTINELS

# --- fixed values: what counts as a number in the text sources ---------------
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
FLAG_SUFFIX = r"[sV*]+$"
TRACE = "T"
# ------------------------------------------------------------------------------


def number(text: Column) -> Column:
    """Text -> double, NULL unless the whole trimmed text is a number (`5d` is not)."""
    bare = F.trim(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def flagged_number(text: Column) -> Column:
    """Number with trailing quality flags; trace `T` is 0.0, blank is NULL."""
    bare = F.regexp_replace(F.trim(text), FLAG_SUFFIX, "")
    return F.when(bare == TRACE, F.lit(0.0)).otherwise(number(bare))


def sentinel_number(text: Column, sentinels: tuple[float, ...] = TRACK_SENTINELS) -> Column:
    """Number where the sentinel values mean missing."""
    value = number(text)
    return F.when(~value.isin(*sentinels), value)


def hemisphere_degrees(text: Column) -> Column:
    """`94.8W` -> -94.8; S and W are negative."""
    bare = F.trim(text)
    size = number(F.substring(bare, F.lit(1), F.length(bare) - 1))
    return F.when(F.right(bare, F.lit(1)).isin("S", "W"), -size).otherwise(size)


def first_truthy(*values: Column) -> Column:
    """First value that is neither NULL nor 0; the last one is taken as it is."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def rain_flag(precip_mm: Column) -> Column:
    """1 from the threshold up, unknown precipitation counts as dry."""
    return F.coalesce((precip_mm >= F.lit(RAIN_THRESHOLD_MM)).cast("int"), F.lit(0))


def yes_no(probability: Column, threshold: float = 0.5) -> Column:
    """Probability -> 0/1."""
    return (probability >= F.lit(threshold)).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) position on a cycle of the given length."""
    angle = value * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def local_date(ts: Column, tz: str | Column) -> Column:
    """calendar date at the station; ``tz`` may be a column."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def plus_hours(ts: Column, hours: Column) -> Column:
    """timestamp plus whole or fractional hours, exact to the microsecond."""
    return F.timestamp_micros(F.unix_micros(ts) + (hours * F.lit(3_600_000_000)).cast("long"))


def plus_minutes(ts: Column, minutes: Column) -> Column:
    """lead times are fractional minutes."""
    return F.timestamp_micros(F.unix_micros(ts) + (minutes * F.lit(60_000_000)).cast("long"))


def hours_between(later: Column, earlier: Column) -> Column:
    """Elapsed hours as a double."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def date_chunks(start: Column, end: Column, days: int = MAX_RANGE_DAYS) -> Column:
    """closed range -> array of (chunk_start, chunk_end), each at most ``days`` long."""
    starts = F.sequence(start, F.greatest(start, end), F.make_dt_interval(F.lit(days)))
    return F.transform(
        F.filter(starts, lambda s: s <= end),
        lambda s: F.struct(
            s.alias("chunk_start"), F.least(end, F.date_add(s, days - 1)).alias("chunk_end")
        ),
    )


def compact_time(ts: Column) -> Column:
    """timestamp as compact UTC text."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")
