"""Best-track text: a header line governs the data lines after it.

Files of any basin, or of several, are read by lines in their splits; every line knows its file, the
start of its split and its place there. The header is carried forward within a split, and from split to split
by a table with one row per split, so no file and no storm has to fit into one task. Text that
already comes in blocks takes the ``parse_blocks`` route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.functions.scalar import hemisphere_degrees, sentinel_number
from skyloom.operators.sliced import fill_forward
from skyloom.sources.feeds import in_file_order

# --- fixed values ------------------------------------------------------------------
_STORM_START = r"(?m)(?=^\s*[A-Z]{2}\d{6}\s*,)"
_DATA_LINE = r"^\s*[+-]?\d+\s*,"
# ------------------------------------------------------------------------------------
_LINE_SLICE = 100_000


def read_best_track(spark: SparkSession, path: str) -> DataFrame:
    """Lines of best-track files as ``file``, ``arrival`` (place in the file) and ``line``."""
    lines = in_file_order(spark.read.text(path))
    return lines.select("file", "arrival", F.col("value").alias("line"))


def _fields(line):
    """The leading fields of a line; what follows the eighth is not needed."""
    return F.split(line, r"\s*,\s*", 9)


def _fix_columns(header, data):
    """Columns of one data line, given the fields of its header."""
    at = F.concat(F.trim(F.get(data, 0)), F.get(data, 1))
    return [
        F.trim(F.get(header, 0)).alias("storm_id"),
        F.get(header, 1).alias("name"),
        F.try_to_timestamp(at, F.lit("yyyyMMddHHmm")).alias("timestamp"),
        hemisphere_degrees(F.get(data, 4)).alias("lat"),
        hemisphere_degrees(F.get(data, 5)).alias("lon"),
        sentinel_number(F.get(data, 6)).alias("max_wind_kt"),
        sentinel_number(F.get(data, 7)).alias("min_pressure_mb"),
        F.get(data, 3).alias("status"),
    ]


def parse_blocks(blocks: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Blocks of text -> one row per fix."""
    keep = list(keep)
    storms = blocks.select(*keep, F.explode(F.split("block", _STORM_START)).alias("_storm"))
    lines = storms.select(
        *keep,
        F.filter(F.split("_storm", r"\r?\n"), lambda s: F.trim(s) != "").alias("_lines"),
    )
    header = _fields(F.get(F.col("_lines"), 0))
    return (
        lines.select(
            *keep,
            header.alias("_h"),
            F.explode(F.filter("_lines", lambda s: s.rlike(_DATA_LINE))).alias("_line"),
        )
        .select(*keep, "_h", _fields(F.col("_line")).alias("_f"))
        .select(*keep, *_fix_columns(F.col("_h"), F.col("_f")))
    )


def header_lines(lines: DataFrame, slice_lines: int = _LINE_SLICE) -> DataFrame:
    """(file, place, line) rows -> data lines with the ``header`` that governs them.

    The place is ``arrival`` of a reader, sliced at the splits of the file, or a line number ``pos``, sliced
    every ``slice_lines``. Data lines before a file's first header have none.
    """
    if "arrival" in lines.columns:
        order, slice_of = "arrival", F.col("arrival.block")
    else:
        order, slice_of = "pos", F.floor(F.col("pos") / slice_lines)
    marked = lines.filter(F.trim("line") != "").withColumn(
        "_own", F.when(~F.col("line").rlike(_DATA_LINE), F.col("line"))
    )
    carried = fill_forward(marked, ["file"], order, "_own", slice_of, "header")
    return carried.filter(F.col("_own").isNull()).drop("_own")


def parse_lines(lines: DataFrame, slice_lines: int = _LINE_SLICE, keep: list[str] = ()) -> DataFrame:
    """S6 for line-per-row input."""
    keep = list(keep)
    return (
        header_lines(lines, slice_lines)
        .select(*keep, _fields(F.col("header")).alias("_h"), _fields(F.col("line")).alias("_f"))
        .select(*keep, *_fix_columns(F.col("_h"), F.col("_f")))
    )
