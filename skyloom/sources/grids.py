"""Append-only storage of grids.

Stored grids are never merged, sorted or shuffled. What is new is found on keys alone, which are read without
their grids, and only new grids are written, by station and day. A grid that replaces a stored one is
appended with a higher version; the replaced key is listed in the table ``<path>_replaced``, which is as short as
the replacements are few. Readers leave out the versions that it names, and ``compact_grids`` rewrites the
folders that hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skyloom.sources import tables
from skyloom.sources.schemas import TABLES, Table

VERSION = "_version"
# A list of keys of at most this many rows (about 100 bytes each) is broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def _list_beside(spark: SparkSession, path: str) -> str | None:
    beside = f"{path.rstrip('/')}_replaced"
    return beside if tables.exists(spark, beside) else None


def _small(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if a count proves them few. They must be cheap to count: stored, without grids."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def read_grids(spark: SparkSession, path: str, table: Table, skip_corrupt: bool = False) -> DataFrame:
    """The newest version of every stored grid, with the partition column.

    Without replacements this is a plain scan. With them, their keys are compared with each row
    in place as long as they can be broadcast.
    """
    return _newest(spark, path, table, skip_corrupt).drop(VERSION)


def _newest(spark: SparkSession, path: str, table: Table, skip_corrupt: bool = False) -> DataFrame:
    rows = tables.stored_files(spark, path, table, skip_corrupt, f"{VERSION} BIGINT")
    beside = _list_beside(spark, path)
    if beside is None:
        return rows
    keys = list(table.keys)
    replaced = spark.read.parquet(beside)
    newest = replaced.groupBy(*keys).agg(F.max(VERSION).alias("_least"))
    if replaced.count() <= BROADCAST_ROWS:
        newest = F.broadcast(newest)
    known = F.coalesce(VERSION, F.lit(0)) >= F.coalesce("_least", F.lit(0))
    return rows.join(newest, keys, "left").filter(known).select(*rows.columns)


def store_grids(
    spark: SparkSession, path: str, table: str | Table, new: DataFrame, seq: str, replace: bool = True
) -> DataFrame:
    """Append the last grid of each key (``replace``), or the first one of each key that is not stored.

    Returns the appended rows. Rows that lack a part of the key are not stored. Running it again
    with the same rows leaves readers the same table. Of rows equal in key and ``seq`` one is taken.
    """
    table = TABLES[table] if isinstance(table, str) else table
    keys = list(table.keys)
    columns = table.schema.fieldNames()
    new, _ = tables.keyed(new, table)
    # grids are computed once, into the shared folder, before their keys are looked at
    new = tables.materialise(spark, new.select(*columns, seq).withColumn("_row", F.monotonically_increasing_id()))
    pick = F.max if replace else F.min
    chosen = new.groupBy(*keys).agg(pick(F.struct(seq, "_row"))["_row"].alias("_row"))
    version, again = 1, None
    if tables.exists(spark, path):
        stored = tables.stored_files(spark, path, table, more=f"{VERSION} BIGINT")
        stored = tables.touched(stored, new, table).select(*keys, VERSION)
        if replace:
            version += stored.agg(F.max(VERSION)).first()[0] or 0
            again = tables.materialise(spark, stored.select(*keys).distinct().join(chosen.select(*keys), keys, "left_semi"))
        else:
            chosen = chosen.join(stored.select(*keys), keys, "left_anti")
    chosen = tables.materialise(spark, chosen.select("_row"))
    fresh = new.join(_small(chosen), "_row", "left_semi").select(*columns)
    tables.append_rows(fresh.withColumn(VERSION, F.lit(version).cast("long")), path, table)
    if again is not None and not again.isEmpty():
        replaced = again.withColumn(VERSION, F.lit(version).cast("long"))
        replaced.write.mode("append").parquet(f"{path.rstrip('/')}_replaced")
    return fresh


def compact_grids(spark: SparkSession, path: str, table: str | Table) -> int:
    """Rewrite the folders that hold replaced grids without them; returns how many folders.

    For a time when nothing is written. If it is cut off, readers still see the same table.
    """
    table = TABLES[table] if isinstance(table, str) else table
    beside = _list_beside(spark, path)
    if beside is None:
        return 0
    replaced = spark.read.parquet(beside)
    folders = tables.with_partition(replaced, table).select(*table.folders).distinct()
    n = folders.count()
    rows = tables.touched(_newest(spark, path, table), replaced, table)
    rows = rows.join(_small(tables.materialise(spark, folders)), list(table.folders), "left_semi")
    # one copy of a grid that was appended twice at the same version
    keys = list(table.keys)
    once = Window.partitionBy(*keys).orderBy("_row")
    marked = tables.materialise(spark, rows.withColumn("_row", F.monotonically_increasing_id()))
    first = marked.select(*keys, "_row").withColumn("_copy", F.row_number().over(once)).filter("_copy = 1")
    kept = marked.join(_small(tables.materialise(spark, first.select("_row"))), "_row", "left_semi")
    columns = [*table.schema.fieldNames(), VERSION]
    tables._write(tables.with_partition(kept.select(*columns), table), path, table, "overwrite")
    where = spark._jvm.org.apache.hadoop.fs.Path(beside)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n
