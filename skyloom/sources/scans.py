"""Radar scan catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyloom.operators.daily import latest_per_entity

# --- fixed values: scan file names --------------------------------------------------
SCAN_NAME = r"^[A-Z]{4}\d{8}_\d{6}_V\d+"
SIDECAR = "_MDM"
# --------------------------------------------------------------------------------------


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing text files, one object per line."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder as listing lines; the file contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.substring_index("path", "/", -1).alias("line"))


def scan_names(listing: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Last token of each line, without metadata sidecars and blank lines."""
    name = F.substring_index(F.trim(F.translate("line", "\t\r", "  ")), " ", -1)
    return listing.select(*keep, name.alias("file_name")).filter(
        (F.col("file_name") != "") & ~F.col("file_name").endswith(SIDECAR)
    )


def parse_scans(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(station, UTC time, day, key) of well-formed names, and the rejects."""
    # the pattern fixes the positions, so one match decides and substrings do the rest
    named = F.col("file_name").rlike(SCAN_NAME)
    stamp = F.when(named, F.substring("file_name", 5, 15))
    parsed = names.withColumn("station", F.when(named, F.substring("file_name", 1, 4))).withColumn(
        "timestamp", F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))
    )
    good = F.col("timestamp").isNotNull()
    scans = (
        parsed.filter(good)
        .withColumn("scan_date", F.to_date("timestamp"))
        .withColumn(
            "key",
            F.concat_ws("/", F.date_format("timestamp", "yyyy/MM/dd"), "station", "file_name"),
        )
    )
    return scans, parsed.filter(~good).select(*names.columns)


def scans_between(scans: DataFrame, start: Column, end: Column) -> DataFrame:
    """Closed UTC range; the date predicate prunes day folders."""
    return scans.filter(
        F.col("scan_date").between(F.to_date(start), F.to_date(end))
        & F.col("timestamp").between(start, end)
    )


def new_scans(scans: DataFrame, collected: DataFrame) -> DataFrame:
    """Scans whose file is not collected yet."""
    return scans.join(collected.select("file_name"), "file_name", "left_anti")


def latest_scan(scans: DataFrame, today: Column) -> DataFrame:
    """K2: newest scan of each station today, else yesterday (UTC days)."""
    recent = scans.filter(F.col("scan_date").between(F.date_sub(today, 1), today))
    return latest_per_entity(recent, "station", "timestamp")
