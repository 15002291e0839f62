"""Daily track: aggregates, features, targets, splits.

The station windows below run on a table with one row per (station, date), which
``last_per_key`` enforces.  A station's group is therefore bounded by the calendar
(about 62,000 rows for 170 years), however many raw reports the station sends; the
unbounded raw reports are only ever touched by pre-aggregating group-bys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.constants import (
    DAILY_FEATURES,
    DATATYPES,
    DAY_HORIZONS,
    LOCAL_TZ,
    MIN_TRAINING_DAYS,
    PA_PER_HPA,
    SOURCE_AUTHORITY,
    SOURCE_LIVE,
)
from skyloom.functions.scalar import cyclic, local_date, rain_flag, yes_no
from skyloom.operators.merge import last_per_key

STATION_DAY = ["station_id", "date"]


def _by_day():
    return Window.partitionBy("station_id").orderBy("date")


def live_daily(observations: DataFrame, tz: str | Column = LOCAL_TZ) -> DataFrame:
    """A1: reports -> one row per station and local date."""
    return (
        observations.groupBy("station_id", local_date(F.col("timestamp"), tz).alias("date"))
        .agg(
            F.max("temperature_c").alias("temp_max_c"),
            F.min("temperature_c").alias("temp_min_c"),
            F.sum(F.coalesce("precip_last_hour_mm", F.lit(0.0))).alias("precip_mm"),
            F.avg("relative_humidity_pct").alias("humidity_pct"),
            (F.avg("barometric_pressure_pa") / PA_PER_HPA).alias("pressure_hpa"),
            F.avg("wind_speed_kmh").alias("wind_speed_kmh"),
        )
        .select(
            "station_id",
            "date",
            F.lit(SOURCE_LIVE).alias("source"),
            "temp_max_c",
            "temp_min_c",
            "precip_mm",
            rain_flag(F.col("precip_mm")).alias("rain"),
            "humidity_pct",
            "pressure_hpa",
            "wind_speed_kmh",
        )
    )


def pivot_summaries(long: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """A2: (station, date, datatype, value) -> one row per day; a repeat's last record wins.

    Filtered ``max_by`` per datatype instead of ``pivot``: one hash aggregation with
    primitive buffers, and no pass to find the distinct datatypes.
    """

    def latest(datatype: str) -> Column:
        mine = F.col("datatype") == datatype
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col(seq)))

    high, low, rain = DATATYPES
    return (
        long.groupBy(*STATION_DAY)
        .agg(
            latest(high).alias("temp_max_c"),
            latest(low).alias("temp_min_c"),
            latest(rain).alias("precip_mm"),
        )
        .select(
            *STATION_DAY,
            F.lit(SOURCE_AUTHORITY).alias("source"),
            "temp_max_c",
            "temp_min_c",
            "precip_mm",
            rain_flag(F.col("precip_mm")).alias("rain"),
        )
    )


def daily_features(daily: DataFrame, seq: str | None = None) -> DataFrame:
    """The 19 features.  One window spec, so one exchange and one sort.

    ``seq`` names the arrival order when ``daily`` may repeat a (station, date).
    """
    base = last_per_key(daily, STATION_DAY, seq) if seq else daily

    by_day = _by_day()

    def change(c: str) -> Column:
        return F.col(c) - F.lag(c).over(by_day)

    def rolling(c: str, days: int) -> Column:
        return F.avg(c).over(by_day.rowsBetween(1 - days, 0))

    month_sin, month_cos = cyclic(F.month("date"), 12)
    doy_sin, doy_cos = cyclic(F.dayofyear("date"), 365.25)
    return base.select(
        "*",
        F.lag("rain").over(by_day).alias("rain_yesterday"),
        change("temp_max_c").alias("temp_max_trend_c"),
        rolling("temp_max_c", 3).alias("temp_max_3d_mean_c"),
        rolling("temp_min_c", 3).alias("temp_min_3d_mean_c"),
        rolling("precip_mm", 3).alias("precip_3d_mean_mm"),
        rolling("precip_mm", 7).alias("precip_7d_mean_mm"),
        change("pressure_hpa").alias("pressure_delta_hpa"),
        rolling("pressure_hpa", 3).alias("pressure_3d_mean_hpa"),
        month_sin.alias("month_sin"),
        month_cos.alias("month_cos"),
        doy_sin.alias("doy_sin"),
        doy_cos.alias("doy_cos"),
    )


_TARGETS = {"rain": "rain", "temp_max": "temp_max_c", "temp_min": "temp_min_c"}


def daily_targets(
    features: DataFrame, horizons: tuple[int, ...] = DAY_HORIZONS, calendar: bool = False
) -> DataFrame:
    """Outcome columns ``rain_h1`` .. per horizon.

    Row-based by default (h rows ahead).  ``calendar=True`` takes the row h calendar
    days ahead and leaves NULL in a gap: a RANGE frame of exactly that one day.
    """
    out = [F.col("*")]
    days = F.unix_date("date")
    for h in horizons:
        for name, source in _TARGETS.items():
            if calendar:
                exact = Window.partitionBy("station_id").orderBy(days).rangeBetween(h, h)
                value = F.first(source).over(exact)
            else:
                value = F.lead(source, h).over(_by_day())
            out.append(value.alias(f"{name}_h{h}"))
    return features.select(*out)


def training_frame(features: DataFrame, horizon: int, calendar: bool = False) -> DataFrame:
    """Complete cases of the features and the horizon's three targets."""
    targets = [f"{name}_h{horizon}" for name in _TARGETS]
    return (
        daily_targets(features, (horizon,), calendar)
        .na.drop(subset=[*DAILY_FEATURES, *targets])
        .select(
            *STATION_DAY,
            *DAILY_FEATURES,
            F.col(targets[0]).cast("int").alias("y_rain"),
            F.col(targets[1]).alias("y_temp_max"),
            F.col(targets[2]).alias("y_temp_min"),
        )
    )


def chrono_split(labelled: DataFrame, test_share: float = 0.2) -> DataFrame:
    """``is_test`` marks the last max(1, floor(share * n)) days of each station."""
    whole = Window.partitionBy("station_id")
    n = F.count(F.lit(1)).over(whole)
    n_test = F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(test_share)))
    rank = F.row_number().over(_by_day())
    return labelled.select("*", (rank > n - n_test).alias("is_test"))


def latest_features(features: DataFrame) -> DataFrame:
    """Each station's most recent complete day; an aggregate, not a sort."""
    complete = features.na.drop(subset=list(DAILY_FEATURES))
    rest = [c for c in complete.columns if c != "station_id"]
    return (
        complete.groupBy("station_id")
        .agg(F.max_by(F.struct(*rest), F.col("date")).alias("_row"))
        .select("station_id", "_row.*")
    )


def horizon_rows(rows: DataFrame, horizons: tuple[int, ...], name: str) -> DataFrame:
    """One row -> one per horizon, inside the row (no join)."""
    return rows.withColumn(name, F.explode(F.array(*[F.lit(h) for h in horizons])))


def persistence_days(
    features: DataFrame,
    version: Column,
    probability: Column | None = None,
    horizons: tuple[int, ...] = DAY_HORIZONS,
) -> DataFrame:
    """Tomorrow will be like today, as stored prediction rows."""
    chance = F.col("rain").cast("double") if probability is None else probability
    return horizon_rows(features, horizons, "horizon_days").select(
        "station_id",
        F.col("date").alias("predicted_date"),
        "horizon_days",
        F.date_add("date", F.col("horizon_days")).alias("target_date"),
        chance.alias("rain_probability"),
        yes_no(chance).alias("rain_predicted"),
        F.col("temp_max_c").alias("temp_max_pred_c"),
        F.col("temp_min_c").alias("temp_min_pred_c"),
        version.alias("model_trained_at"),
    )


def history_status(daily: DataFrame, minimum: int = MIN_TRAINING_DAYS) -> DataFrame:
    """A3, A4: one row per station and source plus the station totals beside it."""
    per_source = daily.groupBy("station_id", "source").agg(
        F.count(F.lit(1)).alias("n_source"),
        F.min("date").alias("_lo"),
        F.max("date").alias("_hi"),
        F.count("pressure_hpa").alias("_enriched"),
    )
    # At most a handful of sources per station: the second level works on those rows.
    station = Window.partitionBy("station_id")
    total = F.sum("n_source").over(station)
    return per_source.select(
        "station_id",
        "source",
        "n_source",
        total.alias("n_days"),
        F.min("_lo").over(station).alias("first_date"),
        F.max("_hi").over(station).alias("last_date"),
        F.sum("_enriched").over(station).alias("n_enriched"),
        F.greatest(F.lit(0).cast("long"), F.lit(minimum) - total).alias("days_missing"),
    )


def latest_per_entity(df: DataFrame, by: str, ts: str) -> DataFrame:
    """K2, K5: newest row per entity, pre-aggregated map-side."""
    rest = [c for c in df.columns if c != by]
    return (
        df.groupBy(by)
        .agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_row"))
        .select(by, "_row.*")
        .select(*df.columns)
    )


def newest_reports(
    observations: DataFrame, start: Column, end: Column, limit: int
) -> DataFrame:
    """Reports in [start, end), newest first, at most ``limit`` per station.

    ``row_number() <= limit`` lets Spark cut each map task to ``limit`` rows per
    station before the shuffle (window group limit), so a busy station stays cheap.
    """
    newest = Window.partitionBy("station_id").orderBy(F.col("timestamp").desc())
    return (
        observations.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
    )
