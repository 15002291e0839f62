"""T1-T4.  Every sink is an idempotent keyed merge, so a replayed micro-batch changes nothing.

Exactness comes from the stored tables and not from stream state: a duplicate is
recognised however late it arrives, and late truth still scores its forecast.  Outcome
tables (``match_outcomes``, ``match_tracks``, ``match_nowcasts``) hold one row per forecast:
whatever arrives, on either side and in any order, they end as the batch join would.  The
one join that keeps state (``match_days``) is for outcomes that are not revised; it has a
unique key on its outcome side and is bounded by its watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.constants import GRID_TOLERANCE_S, LOCAL_TZ, TRACK_TOLERANCE_S
from skyloom.functions.scalar import local_date
from skyloom.operators.daily import live_daily
from skyloom.operators.merge import last_per_key, merge_enrichment, merge_gapfill, replace_unique, table_part
from skyloom.operators.rasters import match_grids, pair_scores
from skyloom.operators.sliced import time_slice
from skyloom.operators.verify import join_fixes, join_outcomes
from skyloom.sources.scans import parse_scans, scan_names
from skyloom.sources.schemas import TABLES
from skyloom.sources.tables import (
    exists,
    insert_ignore,
    keyed,
    materialise,
    merge_into,
    only_partitions,
    read_table,
    reject,
    replace_into,
)

SEQ = "ingest_seq"


def file_stream(
    spark: SparkSession,
    path: str,
    schema,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    clean: str = "off",
    archive_dir: str | None = None,
    glob: str | None = None,
) -> DataFrame:
    """New files of a folder, each exactly once; ``clean`` deletes or archives them after use."""
    reader = spark.readStream.format(fmt).schema(schema).option("cleanSource", clean)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive_dir:
        reader = reader.option("sourceArchiveDir", archive_dir)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _run(
    stream: DataFrame,
    checkpoint: str,
    step: Callable[[DataFrame, int], None],
    trigger: dict | None,
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _without_key(batch: DataFrame, root: str, job: str, table: str) -> None:
    """Rows that cannot be stored are kept among the rejects, each once however often it is replayed."""
    reject(batch.sparkSession, root, job, f"no {' or '.join(TABLES[table].keys)}", keyed(batch, table)[1])


def ingest_observations(
    reports: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append reports whose (station, time) is not stored; the first copy wins.  Keyless ones go to the rejects."""

    def step(batch: DataFrame, _: int) -> None:
        _without_key(batch, root, "observations", "observations")
        insert_ignore(batch.sparkSession, f"{root}/observations", "observations", batch, SEQ)

    return _run(reports, checkpoint, step, trigger)


def refresh_days(spark: SparkSession, root: str, reports: DataFrame, tz: str | Column = LOCAL_TZ) -> DataFrame:
    """T2's step: re-aggregate the local days that ``reports`` touch, then J8 and J9.

    Reads only the stored UTC dates around those days, so cost follows the batch. A station's day is that of its
    zone in the table ``stations``; ``tz`` stands in for stations without one (F2).
    """
    if exists(spark, f"{root}/stations"):
        zones = read_table(spark, f"{root}/stations", "stations").groupBy("station_id").agg(F.max("tz").alias("_zone"))
        own = F.coalesce("_zone", F.lit(tz) if isinstance(tz, str) else tz)
        zoned = lambda rows: rows.join(zones, "station_id", "left").withColumn("_zone", own)
        tz = F.col("_zone")
    else:
        zoned = lambda rows: rows
    days = zoned(reports.select("station_id", "timestamp")).select(
        "station_id", local_date(F.col("timestamp"), tz).alias("_day")
    ).distinct()
    around = days.select(
        F.explode(F.array(F.date_sub("_day", 1), F.col("_day"), F.date_add("_day", 1)))
    )
    observations = read_table(spark, f"{root}/observations", "observations")
    stored = (
        zoned(only_partitions(observations, "obs_date", around))
        .withColumn("_day", local_date(F.col("timestamp"), tz))
        .join(days, ["station_id", "_day"], "left_semi")
    )
    fresh = live_daily(stored.drop("_day", "obs_date"), tz).withColumn(SEQ, F.lit(0))

    def both(old: DataFrame, new: DataFrame) -> DataFrame:
        filled = merge_gapfill(old, new)
        enriched = merge_enrichment(table_part(filled), new)
        actions = filled.select("station_id", "date", "_action", "_records")
        return table_part(enriched).join(actions, ["station_id", "date"])

    return merge_into(spark, f"{root}/daily_observations", "daily_observations", fresh, both)


def ingest_and_refresh(
    reports: DataFrame,
    root: str,
    checkpoint: str,
    tz: str | Column = LOCAL_TZ,
    trigger: dict | None = None,
) -> StreamingQuery:
    """T1 + T2: store new reports, then refresh the days they belong to."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            _without_key(batch, root, "observations", "observations")
            insert_ignore(spark, f"{root}/observations", "observations", batch, SEQ)
            refresh_days(spark, root, batch, tz)
        finally:
            batch.unpersist()

    return _run(reports, checkpoint, step, trigger)


def land_scans(
    listing: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Catalogue every listed scan once; malformed names go to the rejects folder."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        good, bad = parse_scans(scan_names(batch))
        rows = good.withColumn(SEQ, F.lit(0))
        insert_ignore(spark, f"{root}/radar_scans", "radar_scans", rows, SEQ)
        bad.write.mode("overwrite").parquet(f"{root}/radar_rejects/batch={batch_id}")

    return _run(listing, checkpoint, step, trigger)


def match_days(predictions: DataFrame, outcomes: DataFrame, delay: str = "10 days") -> DataFrame:
    """T4 for daily forecasts: stream-stream join of forecasts with their outcomes.

    (station, date) is unique among the outcomes, so a forecast meets at most one.  The
    equal event times let Spark drop state once both watermarks have passed the day;
    a forecast whose day passed without an outcome comes out with NULL truth.
    """
    left = predictions.withColumn("target_ts", F.col("target_date").cast("timestamp")).withWatermark(
        "target_ts", delay
    )
    right = (
        outcomes.filter(F.col("temp_max_c").isNotNull())
        .select(
            F.col("station_id").alias("_station"),
            F.col("date").cast("timestamp").alias("outcome_ts"),
            F.col("rain").alias("actual_rain"),
            F.col("temp_max_c").alias("actual_temp_max_c"),
            F.col("temp_min_c").alias("actual_temp_min_c"),
        )
        .withWatermark("outcome_ts", delay)
    )
    same = (F.col("station_id") == F.col("_station")) & (F.col("target_ts") == F.col("outcome_ts"))
    return (
        left.join(right, same, "left_outer")
        .withColumn("pending", F.col("actual_temp_max_c").isNull())
        .drop("_station", "outcome_ts", "target_ts")
    )


def arrivals(**streams: DataFrame) -> DataFrame:
    """One stream of several kinds of rows, ``kind`` telling them apart: one query then owns the outcome table."""
    out = None
    for kind, stream in streams.items():
        rows = stream.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _of_kind(batch: DataFrame, kind: str, table: str) -> DataFrame:
    """The rows of one kind with the columns of its table and the arrival order."""
    rows = batch.filter(F.col("kind") == kind)
    have = set(rows.columns)
    columns = [
        F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in TABLES[table].schema
    ]
    return rows.select(*columns, F.col(SEQ) if SEQ in have else F.lit(0).alias(SEQ))


def match_outcomes(
    rows: DataFrame, root: str, checkpoint: str, reach_days: int = 31, trigger: dict | None = None
) -> StreamingQuery:
    """T4 for daily forecasts with outcomes that are revised: ``arrivals(prediction=..., outcome=...)``.

    Outcomes are rows of daily observations with a ``version`` (arrival order where there is none). The highest
    version of a day counts, however late a lower one comes; the forecasts of its day are joined again, so a
    revised day is scored once, with its last value, and is pending again if it lost its high. Forecasts reach
    at most ``reach_days`` ahead; a longer one is an error.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            forecasts = _of_kind(batch, "prediction", "predictions")
            if not forecasts.filter(F.datediff("target_date", "predicted_date") > reach_days).isEmpty():
                raise ValueError(f"a forecast reaches more than {reach_days} days ahead")
            truth = _of_kind(batch, "outcome", "daily_outcomes")
            truth = truth.withColumn("version", F.coalesce("version", SEQ)).drop(SEQ)
            _without_key(forecasts, root, "daily forecasts", "predictions")
            _without_key(truth, root, "daily outcomes", "daily_outcomes")
            replace_into(spark, f"{root}/predictions", "predictions", forecasts, SEQ)
            merge_into(
                spark,
                f"{root}/daily_outcomes",
                "daily_outcomes",
                truth,
                lambda stored, new: last_per_key(stored.unionByName(new), ["station_id", "date"], "version"),
            )
            days = truth.select("station_id", F.col("date").alias("target_date")).unionByName(
                forecasts.select("station_id", "target_date")
            )
            days = materialise(spark, days.distinct())
            months = days.select(
                F.explode(F.sequence(
                    F.trunc(F.date_sub("target_date", reach_days), "MM"), F.trunc("target_date", "MM"), F.expr("INTERVAL 1 MONTH")
                ))
            )
            stored = read_table(spark, f"{root}/predictions", "predictions")
            due = only_partitions(stored, "predicted_month", months).drop("predicted_month")
            due = due.join(days, ["station_id", "target_date"], "left_semi")
            outcomes = read_table(spark, f"{root}/daily_outcomes", "daily_outcomes")
            known = only_partitions(outcomes, "obs_year", days.select(F.year("target_date")))
            matched = join_outcomes(due, known.drop("obs_year", "version")).drop("pending")
            replace_into(
                spark, f"{root}/prediction_outcomes", "prediction_outcomes", matched.withColumn(SEQ, F.lit(0)), SEQ
            )
        finally:
            batch.unpersist()

    return _run(rows, checkpoint, step, trigger)


def match_nowcasts(
    rows: DataFrame,
    root: str,
    checkpoint: str,
    tolerance_s: float = GRID_TOLERANCE_S,
    trigger: dict | None = None,
) -> StreamingQuery:
    """T4 for radar nowcasts: ``arrivals(frame=..., nowcast=...)``, either side first.

    Both are stored, then the nowcasts near what arrived are matched on keys alone. Grids are fetched only for
    nowcasts that are new, replaced, or now have a nearer frame; their scores replace the earlier ones.
    """
    if tolerance_s > _SLICE_S:
        raise ValueError(f"the tolerance must not exceed a slice of {_SLICE_S:.0f} s")
    keys = list(TABLES["radar_nowcasts"].keys)
    reach = F.make_dt_interval(secs=F.lit(float(tolerance_s)))

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            frames = _of_kind(batch, "frame", "radar_frames")
            nowcasts = _of_kind(batch, "nowcast", "radar_nowcasts")
            narrow = [c for c in batch.columns if c != "reflectivity_dbz"]
            for kind, table in (("frame", "radar_frames"), ("nowcast", "radar_nowcasts")):
                _without_key(batch.filter(F.col("kind") == kind).select(*narrow), root, f"radar {kind}s", table)
            insert_ignore(spark, f"{root}/radar_frames", "radar_frames", frames, SEQ)
            replace_into(spark, f"{root}/radar_nowcasts", "radar_nowcasts", nowcasts, SEQ)
            arrived = materialise(spark, nowcasts.select(*keys).distinct())
            moments = frames.select("station", F.col("timestamp").alias("_at")).unionByName(
                nowcasts.select("station", F.col("valid_at").alias("_at"))
            )
            # the slices that a match of what arrived can lie in, and the days of those slices
            at = F.col("_at")
            near = F.explode(F.array_distinct(F.array(*[time_slice(t, _SLICE_S) for t in (at - reach, at, at + reach)])))
            slices = materialise(spark, moments.select("station", near.alias("_slice")).distinct())
            day = F.date_from_unix_date(F.col("_slice").cast("int"))
            around = slices.select("station", F.explode(F.array(F.date_sub(day, 1), day, F.date_add(day, 1))).alias("day"))

            def within(name: str, column: str, days: DataFrame) -> DataFrame:
                stored = only_partitions(read_table(spark, f"{root}/{name}", name), column, days.select("day"))
                return only_partitions(stored, "station", slices.select("station")).drop(column)

            stored = within("radar_nowcasts", "valid_date", slices.select(day.alias("day")))
            due = stored.select(*keys).withColumn("_slice", time_slice(F.col("valid_at"), _SLICE_S))
            due = due.join(slices, ["station", "_slice"], "left_semi").drop("_slice")
            observed = within("radar_frames", "scan_date", around)
            matched = match_grids(due, observed, tolerance_s).filter(F.col("actual_at").isNotNull())
            outcomes = within("radar_nowcast_outcomes", "valid_date", slices.select(day.alias("day")))
            before = outcomes.select(*keys, F.col("actual_at").alias("_was"))
            same = F.col("_was").isNotNull() & (F.col("_was") == F.col("actual_at")) & F.col("_arrived").isNull()
            changed = (
                due.join(matched, ["station", "valid_at"])
                .join(before, keys, "left")
                .join(arrived.withColumn("_arrived", F.lit(True)), keys, "left")
                .filter(~same)
                .select(*keys, "actual_at")
            )
            changed = materialise(spark, changed)
            grids = stored.join(changed.select(*keys), keys, "left_semi")
            meant = changed.select("station", "valid_at", "actual_at").distinct()
            scores = pair_scores(grids, observed, meant)
            replace_into(
                spark,
                f"{root}/radar_nowcast_outcomes",
                "radar_nowcast_outcomes",
                scores.withColumn(SEQ, F.lit(0)),
                SEQ,
            )
        finally:
            batch.unpersist()

    return _run(rows, checkpoint, step, trigger)


_SLICE_S = 86_400.0
_MIN_SLICE_S = 600.0


def match_tracks(
    fixes: DataFrame,
    root: str,
    checkpoint: str,
    tolerance_s: float = TRACK_TOLERANCE_S,
    trigger: dict | None = None,
) -> StreamingQuery:
    """T4 for tracks: new fixes re-match the stored forecasts within their reach.

    A better (nearer) fix that arrives later replaces the earlier match, so the
    outcome table equals the batch result whatever the order of arrival.
    """
    if tolerance_s > _SLICE_S:
        raise ValueError(f"the tolerance must not exceed a slice of {_SLICE_S:.0f} s")
    width = max(float(tolerance_s), _MIN_SLICE_S)

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            _without_key(batch, root, "tracks", "hurricane_fixes")
            replace_into(spark, f"{root}/hurricane_fixes", "hurricane_fixes", batch, SEQ)
            reach = F.make_dt_interval(secs=F.lit(float(tolerance_s)))
            at = F.col("timestamp")
            # slices no wider than needed: only forecasts that a new fix can reach are matched again
            touched = batch.select(
                "storm_id",
                F.explode(
                    F.array_distinct(
                        F.array(*[time_slice(t, width) for t in (at - reach, at, at + reach)])
                    )
                ).alias("_slice"),
            ).distinct()
            # forecasts reach less than a year ahead, so the seasons beside the fixes' own suffice
            year = F.year("timestamp")
            seasons = batch.select(F.explode(F.array(year - 1, year, year + 1)))
            forecasts = read_table(spark, f"{root}/hurricane_predictions", "hurricane_predictions")
            due = (
                only_partitions(forecasts, "season", seasons)
                .withColumn("_slice", time_slice(F.col("valid_at"), width))
                .join(touched, ["storm_id", "_slice"], "left_semi")
                .drop("_slice", "season", "storm_name")
            )
            near = touched.select(
                "storm_id",
                F.explode(F.array(*[F.col("_slice") + d for d in (-1, 0, 1)])).alias("_slice"),
            ).distinct()
            known = read_table(spark, f"{root}/hurricane_fixes", "hurricane_fixes")
            truth = (
                only_partitions(known, "season", seasons)
                .withColumn("_slice", time_slice(F.col("timestamp"), width))
                .join(near, ["storm_id", "_slice"], "left_semi")
                .drop("_slice", "season")
            )
            matched = join_fixes(due, truth, tolerance_s).filter(~F.col("pending")).drop("pending")
            # the stored forecasts have unique keys and each is matched once
            merge_into(
                spark,
                f"{root}/hurricane_outcomes",
                "hurricane_outcomes",
                matched,
                lambda stored, new: replace_unique(stored, new, list(TABLES["hurricane_outcomes"].keys)),
            )
        finally:
            batch.unpersist()

    return _run(fixes, checkpoint, step, trigger)
