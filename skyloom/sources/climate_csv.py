"""Climatological CSV with mixed hourly and daily rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyloom.constants import INHG_TO_HPA, MPH_TO_KMH
from skyloom.functions.scalar import first_truthy, flagged_number
from skyloom.sources.feeds import in_file_order

# --- fixed values: header names and the daily report type -----------------------
DAILY_REPORT = "SOD"
COLUMNS = (
    "STATION",
    "DATE",
    "REPORT_TYPE",
    "DailyAverageRelativeHumidity",
    "DailyAverageSeaLevelPressure",
    "DailyAverageStationPressure",
    "DailyAverageWindSpeed",
)
# ----------------------------------------------------------------------------------


def read_climate_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files, each read by its own header, every column as text, in their order of ``arrival``.

    Files may differ in the columns they have and in their order; a column that a file lacks is NULL.
    """
    lines = in_file_order(spark.read.text(path))
    first = F.col("arrival.block") == 0
    heads = lines.filter(first).groupBy("file").agg(
        F.min("arrival").alias("head_at"), F.min_by("value", "arrival").alias("head")
    )
    widest = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    ddl = ", ".join(f"c{k} string" for k in range(widest))

    def cells(line: Column) -> Column:
        parsed = F.from_csv(line, F.lit(ddl))
        return F.array(*[parsed[f"c{k}"] for k in range(widest)])

    heads = heads.select("file", "head_at", F.transform(cells(F.col("head")), lambda c: F.trim(c)).alias("names"))
    rows = lines.join(heads, "file").filter((F.col("arrival") != F.col("head_at")) & (F.trim("value") != ""))
    rows = rows.select("arrival", "names", cells(F.col("value")).alias("cells"))
    at = {c: F.array_position("names", c) for c in COLUMNS}
    return rows.select(
        *[F.when(at[c] > 0, F.get("cells", (at[c] - 1).cast("int"))).alias(c) for c in COLUMNS], "arrival"
    )


def parse_climate_days(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per daily report with converted units."""
    pressure = first_truthy(
        flagged_number(F.col("DailyAverageSeaLevelPressure")),
        flagged_number(F.col("DailyAverageStationPressure")),
    )
    return raw.filter(F.trim("REPORT_TYPE") == DAILY_REPORT).select(
        *keep,
        F.col("STATION").alias("station_id"),
        F.substring("DATE", 1, 10).try_cast("date").alias("date"),
        flagged_number(F.col("DailyAverageRelativeHumidity")).alias("humidity_pct"),
        (pressure * INHG_TO_HPA).alias("pressure_hpa"),
        (flagged_number(F.col("DailyAverageWindSpeed")) * MPH_TO_KMH).alias("wind_speed_kmh"),
    )


def between_dates(daily: DataFrame, start: Column, end: Column) -> DataFrame:
    """Closed date range."""
    return daily.filter(F.col("date").between(start, end))
