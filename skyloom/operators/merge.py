"""Keyed merges with column ownership.

One operator covers the five merge rules; they differ only in which columns the
incoming side owns, in the guard, and in what an insert adds.  The result is the
merged table plus ``_action`` ('insert', 'update', 'skip' or 'keep') and
``_records`` (incoming records folded into the row), from which J10 counts.

Both sides are reduced to one row per key before they meet, so the join has no
repeated key on either side and cannot skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyloom.constants import SOURCE_AUTHORITY, SOURCE_ENRICH


# values that a hash aggregation cannot hold
_SORTED = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)


def last_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, the one with the largest ``seq``; pre-aggregated map-side."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def first_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, the one with the smallest ``seq``."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def owned_merge(
    stored: DataFrame,
    new: DataFrame,
    keys: list[str],
    owned: list[str],
    seq: str,
    insert_only: list[str] = (),
    insert_values: dict[str, Column] | None = None,
    guard: Column | None = None,
) -> DataFrame:
    """Merge ``new`` into ``stored``.

    owned          columns taken from the last record per key, NULLs included
    insert_only    columns taken from the first record, on insert only
    insert_values  expressions for further columns on insert
    guard          condition on stored columns (``old.<column>``); where it is not
                   true the stored row stays as it is
    """
    insert_values = insert_values or {}
    # column by column, so that all-numeric ownership aggregates by hash; other rows are sorted for it in any
    # case and go as one value, with one arrival number and not one per column
    by_hash = not any(isinstance(new.schema[c].dataType, _SORTED) for c in (*owned, *insert_only))
    if by_hash:
        picks = [F.max_by(c, seq).alias(f"_last_{c}") for c in owned]
        picks += [F.min_by(c, seq).alias(f"_first_{c}") for c in insert_only]
    else:
        picks = [F.max_by(F.struct(*owned), seq).alias("_last")] if owned else []
        picks += [F.min_by(F.struct(*insert_only), seq).alias("_first")] if insert_only else []
    last, first = ("_last_{}", "_first_{}") if by_hash else ("_last.`{}`", "_first.`{}`")
    folded = new.groupBy(*keys).agg(*picks, F.count(F.lit(1)).alias("_n"))
    old = stored.alias("old").withColumn("_stored", F.lit(True)).alias("old")
    both = old.join(folded.alias("new"), keys, "full_outer")

    is_old = F.col("old._stored").isNotNull()
    is_new = F.col("new._n").isNotNull()
    allowed = F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(bool(owned))
    insert = is_new & ~is_old
    update = is_new & is_old & allowed

    out = [F.col(k) for k in keys]
    for c in stored.columns:
        if c in keys:
            continue
        kind = stored.schema[c].dataType
        if c in owned:
            value = F.when(insert | update, F.col(last.format(c))).otherwise(F.col(f"old.{c}"))
        elif c in insert_only:
            value = F.when(insert, F.col(first.format(c))).otherwise(F.col(f"old.{c}"))
        elif c in insert_values:
            value = F.when(insert, insert_values[c]).otherwise(F.col(f"old.{c}"))
        else:
            value = F.col(f"old.{c}")
        out.append(value.cast(kind).alias(c))
    action = (
        F.when(insert, F.lit("insert"))
        .when(update, F.lit("update"))
        .when(is_new, F.lit("skip"))
        .otherwise(F.lit("keep"))
    )
    return both.select(
        *out, action.alias("_action"), F.coalesce(F.col("_n"), F.lit(0)).alias("_records")
    )


def merge_ignore(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The rows to append - first copy of every key that is not stored yet."""
    return first_per_key(new, keys, seq).join(stored.select(*keys), keys, "left_anti")


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """J5 as a whole table."""
    return stored.unionByName(merge_ignore(stored, new, keys, seq))


def insert_or_replace(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last copy wins, the whole stored row is replaced."""
    owned = [c for c in stored.columns if c not in keys]
    return owned_merge(stored, new, keys, owned, seq)


def replace_unique(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """J6 for incoming rows whose keys do not repeat: nothing to fold, and only their keys meet the stored rows."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*stored.columns))


DAILY_KEYS = ["station_id", "date"]
_MEASURED = ["temp_max_c", "temp_min_c", "precip_mm", "rain"]
_ENRICHED = ["humidity_pct", "pressure_hpa", "wind_speed_kmh"]


def merge_authoritative(stored: DataFrame, new: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Climate summaries own source, temperatures, precipitation and the rain flag."""
    return owned_merge(stored, new, DAILY_KEYS, ["source", *_MEASURED], seq)


def merge_gapfill(stored: DataFrame, new: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Live aggregates fill days that the authority has not covered; source stays."""
    return owned_merge(
        stored,
        new,
        DAILY_KEYS,
        _MEASURED,
        seq,
        insert_only=["source"],
        guard=F.col("old.source") != SOURCE_AUTHORITY,
    )


def merge_enrichment(stored: DataFrame, new: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Humidity, pressure and wind only; an unknown day becomes a bare row."""
    return owned_merge(
        stored,
        new,
        DAILY_KEYS,
        _ENRICHED,
        seq,
        insert_values={"source": F.lit(SOURCE_ENRICH)},
    )


def merge_counts(merged: DataFrame) -> DataFrame:
    """Keys and incoming records per action; 'insert' and 'update' are the changes."""
    return (
        merged.filter(F.col("_action") != "keep")
        .groupBy("_action")
        .agg(F.count(F.lit(1)).alias("n_keys"), F.sum("_records").alias("n_records"))
    )


def table_part(merged: DataFrame) -> DataFrame:
    """The merged table without the bookkeeping columns."""
    return merged.drop("_action", "_records")
