"""Stored Parquet tables: reads, schema evolution, merging writes.

A merge rewrites only the directory partitions that the incoming rows touch.  The
merged partitions are checkpointed into the cluster's shared folder before the
overwrite, so the write never depends on files it is about to replace and a lost
executor cannot leave the table half read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skyloom.operators.merge import merge_ignore, owned_merge, table_part
from skyloom.session import workspace
from skyloom.sources import grids
from skyloom.sources.schemas import TABLES, Table


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def with_partition(df: DataFrame, table: Table) -> DataFrame:
    if table.partition is None:
        return df
    return df.withColumn(table.partition, F.expr(table.partition_expr))


def read_table(
    spark: SparkSession, path: str, table: str | Table, skip_corrupt: bool = False
) -> DataFrame:
    """The table with its declared columns; older files lacking late columns give NULL.

    ``skip_corrupt`` leaves out unreadable files and goes on (P14).

    No order is imposed; sort where rows are shown.  The partition column is kept so
    that filters on it prune directories.
    """
    spec = TABLES[table] if isinstance(table, str) else table
    if not exists(spark, path):
        return with_partition(spark.createDataFrame([], spec.schema), spec)
    if spec.grids:
        return grids.read_grids(spark, path, spec, skip_corrupt)
    return stored_files(spark, path, spec, skip_corrupt)


def stored_files(
    spark: SparkSession, path: str, spec: Table, skip_corrupt: bool = False, more: str = ""
) -> DataFrame:
    """The rows of all files, with the partition column behind the declared ones, then ``more``."""
    schema = spec.schema
    if spec.partition:
        kind = with_partition(spark.createDataFrame([], spec.schema), spec).schema[spec.partition]
        schema = schema.add(kind)
    if more:
        schema = T.StructType([*schema, *T.StructType.fromDDL(more)])
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", skip_corrupt).parquet(path)
    return rows.select(*schema.fieldNames())


def evolve(df: DataFrame, table: str | Table) -> DataFrame:
    """Bring an older table up to the declared columns, missing ones as NULL."""
    spec = TABLES[table] if isinstance(table, str) else table
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in spec.schema
        ]
    )


def append_rows(df: DataFrame, path: str, table: Table) -> None:
    """Append, one set of files per directory partition.

    Rows of a folder are brought together first (large folders in several parts): else every task writes a file into
    every folder, and their number grows with the product.
    """
    rows = with_partition(df, table)
    _write(rows.hint("rebalance", *table.folders) if table.partition else rows, path, table, "append")


def _write(df: DataFrame, path: str, table: Table, mode: str) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    if table.partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*table.folders)
    writer.parquet(path)


def only_partitions(stored: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Stored rows whose directory partition is among the values of the one-column ``wanted``.

    The distinct values are looked up first - at most one per calendar day or year - so
    the filter is a literal list and the other directories are not even listed for
    reading.  A run-time semi join would prune only where Spark judges it selective.
    """
    values = [r[0] for r in wanted.distinct().collect()]
    known = F.col(column).isin([v for v in values if v is not None])
    return stored.filter(known | F.col(column).isNull() if None in values else known)


def keyed(df: DataFrame, table: str | Table) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): rows that lack a part of the table's key cannot be stored."""
    spec = TABLES[table] if isinstance(table, str) else table
    whole = F.lit(True)
    for key in spec.keys:
        whole = whole & F.col(key).isNotNull()
    return df.filter(whole), df.filter(~whole)


BOOKKEEPING = ("ingest_seq", "arrival", "kind", "copy")


def reject(spark: SparkSession, root: str, job: str, reason: str, rows: DataFrame) -> None:
    """Keep what a job could not use, as JSON, in the table of rejects, once per job and record.

    A record is named by the hash of its values; its place of arrival does not count, so a rerun or a replayed
    batch adds nothing.
    """
    if rows.isEmpty():
        return
    record = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in BOOKKEEPING]))
    kept = rows.select(F.lit(job).alias("job"), F.lit(reason).alias("reason"), record.alias("record"))
    kept = kept.withColumn("record_id", F.sha2("record", 256)).withColumn("ingest_seq", F.lit(0))
    insert_ignore(spark, f"{root}/rejects", "rejects", kept, "ingest_seq")


def touched(stored: DataFrame, new: DataFrame, table: Table) -> DataFrame:
    """Stored rows of the directory partitions that ``new`` falls into."""
    for column in table.folders:
        stored = only_partitions(stored, column, with_partition(new, table).select(column))
    return stored


def insert_ignore(spark: SparkSession, path: str, name: str, new: DataFrame, seq: str) -> DataFrame:
    """J5 sink: append the rows whose key is not stored.  Returns the appended rows.

    Re-running a batch appends nothing, so a retried batch is harmless.  Rows that lack a part of
    the key are not stored; ``keyed`` tells them apart.
    """
    table = TABLES[name]
    if table.grids:
        return grids.store_grids(spark, path, table, new, seq, replace=False)
    new, _ = keyed(new, table)
    stored = touched(read_table(spark, path, table), new, table)
    fresh = merge_ignore(stored, new, list(table.keys), seq).select(*table.schema.fieldNames())
    fresh = materialise(spark, fresh)
    append_rows(fresh, path, table)
    return fresh


def merge_into(
    spark: SparkSession,
    path: str,
    name: str,
    new: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """J6-J9 sink: merge into the touched partitions only.  Returns the merged rows with actions.

    ``merge(stored, new)`` is one of the operators of ``skyloom.operators.merge``.  Rows that lack
    a part of the key are not stored.
    """
    table = TABLES[name]
    # kept: the incoming rows are read for their directories first and then by the merge
    new = keyed(new, table)[0].persist()
    try:
        stored = touched(read_table(spark, path, table), new, table)
        merged = materialise(spark, merge(stored.select(*table.schema.fieldNames()), new))
    finally:
        new.unpersist()
    _write(with_partition(table_part(merged), table), path, table, "overwrite")
    return merged


def replace_into(spark: SparkSession, path: str, name: str, new: DataFrame, seq: str) -> DataFrame:
    """J6 sink for the tables whose whole row is replaced.

    Tables of grids return the stored rows only, all others also what they were merged with.
    """
    table = TABLES[name]
    if table.grids:
        return grids.store_grids(spark, path, table, new, seq)
    columns = table.schema.fieldNames()
    owned = [c for c in columns if c not in table.keys]
    return merge_into(
        spark,
        path,
        name,
        new,
        lambda stored, rows: owned_merge(stored, rows, list(table.keys), owned, seq),
    )


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    if not spark.sparkContext.getCheckpointDir():
        workspace(spark, "checkpoint")
    return df.checkpoint(eager=True)
