"""The user-level jobs, one per command of the feature list.

``root`` is the folder that holds the tables (one sub-folder each, see
``skyloom.sources.schemas``).  Every job returns a DataFrame; jobs that store
something return what they stored.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyloom.constants import (
    DAY_HORIZONS,
    DEFAULT_LEAD_MINUTES,
    LOCAL_TZ,
    MIN_TRAINING_DAYS,
    MIN_TRAINING_FIXES,
    TEST_SEASONS,
    TRACK_HORIZONS_H,
)
from skyloom.errors import NotEnoughDataError, NoUsableDataError, OutOfRadarRangeError
from skyloom.operators import daily as D, forests, rasters as R, tracks as K, verify as V
from skyloom.operators.merge import merge_authoritative, merge_enrichment
from skyloom.sources import best_track, climate_csv, feeds, scans
from skyloom.sources.tables import insert_ignore, keyed, merge_into, read_table, reject, replace_into
from skyloom.streaming.jobs import refresh_days

SEQ = "ingest_seq"


def _arrival(df: DataFrame) -> DataFrame:
    """Arrival order of records: file by file, row by row where a reader tells it."""
    if "arrival" in df.columns:
        return df.withColumnRenamed("arrival", SEQ)
    return df.withColumn(SEQ, F.monotonically_increasing_id())


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc)).cast("timestamp")


# --- tabular track ---------------------------------------------------------------------------


def ingest_observations(spark: SparkSession, root: str, feed_path: str) -> DataFrame:
    """fetch, part 1: S1, J5.  Returns the appended reports."""
    docs = _arrival(feeds.read_documents(spark, feed_path))
    reports = feeds.parse_observations(docs, keep=[SEQ], seq=SEQ)
    reject(spark, root, "observations", "no JSON", feeds.broken_documents(docs))
    reject(spark, root, "observations", "no station or time", keyed(reports, "observations")[1])
    return insert_ignore(spark, f"{root}/observations", "observations", reports, SEQ)


def refresh_live_daily(
    spark: SparkSession, root: str, reports: DataFrame | None = None, tz: str | Column = LOCAL_TZ
) -> DataFrame:
    """fetch, part 2: A1, J8, J9 for the days of ``reports`` (all stored reports by default).

    Days are those of the zones in the table ``stations``, of ``tz`` for stations without one.
    """
    if reports is None:
        reports = read_table(spark, f"{root}/observations", "observations")
    return refresh_days(spark, root, reports, tz)


def load_daily_history(spark: SparkSession, root: str, pages_path: str) -> DataFrame:
    """backfill: S4, A2, P6, J7."""
    docs = _arrival(feeds.read_documents(spark, pages_path))
    reject(spark, root, "daily history", "no JSON", feeds.broken_documents(docs))
    rows = D.pivot_summaries(feeds.parse_summaries(docs, keep=[SEQ], seq=SEQ), SEQ)
    reject(spark, root, "daily history", "no station or date", keyed(rows, "daily_observations")[1])
    return merge_into(
        spark,
        f"{root}/daily_observations",
        "daily_observations",
        rows.withColumn(SEQ, F.lit(0)),
        merge_authoritative,
    )


def load_enrichment(
    spark: SparkSession, root: str, csv_path: str, start: str, end: str
) -> DataFrame:
    """enrich: S5, P1, P4, P5, P7, J9."""
    raw = _arrival(climate_csv.read_climate_csv(spark, csv_path))
    rows = climate_csv.between_dates(
        climate_csv.parse_climate_days(raw, keep=[SEQ]), F.lit(start).cast("date"), F.lit(end).cast("date")
    )
    return merge_into(
        spark, f"{root}/daily_observations", "daily_observations", rows, merge_enrichment
    )


def _daily(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/daily_observations", "daily_observations").drop("obs_year")


def history_status(spark: SparkSession, root: str) -> DataFrame:
    """status: A3, A4."""
    return D.history_status(_daily(spark, root))


def train_daily(
    spark: SparkSession,
    root: str,
    horizons: tuple[int, ...] = DAY_HORIZONS,
    minimum: int = MIN_TRAINING_DAYS,
    trees: int | None = None,
    trained_at: str | None = None,
) -> DataFrame:
    """train: F1, W1-W4, M1, M3, M4, M6, W9, A9-A11.  Saves the bundle, returns hold-out scores."""
    daily = _daily(spark, root)
    have = daily.count()
    if have < minimum:
        raise NotEnoughDataError(f"only {have} days of history; need at least {minimum}")
    stamp = trained_at or datetime.now(timezone.utc).isoformat()
    bundle, holdout = forests.fit_days(D.daily_features(daily), stamp, horizons, minimum, trees)
    forests.save_bundle(spark, bundle, f"{root}/models/daily")
    return forests.holdout_days(holdout)


def forecast_days(spark: SparkSession, root: str, official_path: str | None = None) -> DataFrame:
    """predict: W7, M7, J12, J6, J13.  Stores the rows; official forecasts come beside them."""
    bundle = forests.load_bundle(spark, f"{root}/models/daily")
    latest = D.latest_features(D.daily_features(_daily(spark, root)))
    if latest.isEmpty():
        raise NoUsableDataError("no complete day of features to forecast from")
    rows = forests.forecast_days(bundle, latest)
    replace_into(spark, f"{root}/predictions", "predictions", rows.withColumn(SEQ, F.lit(0)), SEQ)
    if official_path is None:
        return rows
    docs = feeds.read_documents(spark, official_path)
    keys = ["station_id", "target_date"] if "station_id" in docs.columns else ["target_date"]
    if len(keys) == 1 and latest.select("station_id").distinct().count() > 1:
        raise ValueError("official forecasts of several stations need folders station_id=<id>")
    official = feeds.parse_daytime_periods(docs, len(bundle.horizons), keep=keys[:-1])
    official = official.withColumnRenamed("period_date", "target_date").select(*keys, "official_forecast")
    return rows.join(official, keys, "left")


def score_days(spark: SparkSession, root: str) -> DataFrame:
    """evaluate: J1, A5, A6, J6.  Stores and returns the scores; ``n_pending`` stays visible."""
    predictions = read_table(spark, f"{root}/predictions", "predictions").drop("predicted_month")
    scores = V.score_days(V.join_outcomes(predictions, _daily(spark, root)))
    _store_scores(spark, root, "model_performance", scores)
    return scores.orderBy("model_trained_at", "horizon_days")


def _store_scores(spark: SparkSession, root: str, table: str, scores: DataFrame) -> None:
    rows = scores.filter("n_samples > 0").select(
        _now().alias("evaluated_at"), *[c for c in scores.columns if not c.startswith("n_p")]
    )
    replace_into(spark, f"{root}/{table}", table, rows.withColumn(SEQ, F.lit(0)), SEQ)


# --- storm track --------------------------------------------------------------------------------


def load_tracks(spark: SparkSession, root: str, path: str) -> DataFrame:
    """hurricane-backfill: S6, P2, P3, W11, J6.  Files of any basin; of repeated fixes the last line counts."""
    fixes = best_track.parse_lines(best_track.read_best_track(spark, path), keep=["arrival"])
    reject(spark, root, "tracks", "no storm or time", keyed(fixes, "hurricane_fixes")[1])
    return replace_into(spark, f"{root}/hurricane_fixes", "hurricane_fixes", _arrival(fixes), SEQ)


def _fixes(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/hurricane_fixes", "hurricane_fixes").drop("season")


def train_tracks(
    spark: SparkSession,
    root: str,
    horizons: tuple[int, ...] = TRACK_HORIZONS_H,
    minimum: int = MIN_TRAINING_FIXES,
    test_seasons: int = TEST_SEASONS,
    trees: int | None = None,
    trained_at: str | None = None,
) -> DataFrame:
    """hurricane-train: W5, W6, J2, M2, M5, A12, W10.  Saves the bundle, returns hold-out scores."""
    fixes = _fixes(spark, root)
    stamp = trained_at or datetime.now(timezone.utc).isoformat()
    bundle, holdout = forests.fit_tracks(
        K.storm_motion(fixes), fixes, stamp, horizons, minimum, test_seasons, trees
    )
    forests.save_bundle(spark, bundle, f"{root}/models/tracks")
    return forests.holdout_tracks(holdout)


def forecast_storms(spark: SparkSession, root: str, feed_path: str) -> DataFrame:
    """hurricane-predict: S7, P11, P12, M8, J6."""
    bundle = forests.load_bundle(spark, f"{root}/models/tracks")
    storms = feeds.parse_active_storms(feeds.read_documents(spark, feed_path))
    live, unusable = K.live_features(storms)
    reject(spark, root, "live storms", "no position or time", unusable)
    rows = forests.forecast_storms(bundle, live)
    replace_into(
        spark, f"{root}/hurricane_predictions", "hurricane_predictions", _arrival(rows), SEQ
    )
    return rows


def score_tracks(spark: SparkSession, root: str) -> DataFrame:
    """hurricane-evaluate: J3, F3, A7, A6, J6."""
    predictions = read_table(spark, f"{root}/hurricane_predictions", "hurricane_predictions")
    scores = V.score_tracks(V.join_fixes(predictions.drop("season"), _fixes(spark, root)))
    _store_scores(spark, root, "hurricane_performance", scores)
    return scores.orderBy("horizon_hours", "model_trained_at")


# --- radar -----------------------------------------------------------------------------------------


def scan_catalog(
    spark: SparkSession, root: str, listing_path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """radar-fetch-raw, radar-backfill-raw: S8, S9, P8, J11.  Returns the newly listed scans."""
    found, unusable = scans.parse_scans(scans.scan_names(scans.read_listing(spark, listing_path)))
    reject(spark, root, "scans", "no scan name", unusable)
    if start and end:
        found = scans.scans_between(found, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return insert_ignore(
        spark, f"{root}/radar_scans", "radar_scans", found.withColumn(SEQ, F.lit(0)), SEQ
    )


def latest_scans(spark: SparkSession, root: str, today: str) -> DataFrame:
    """radar-fetch: K2 over the catalogue."""
    stored = read_table(spark, f"{root}/radar_scans", "radar_scans").drop("landed_date")
    return scans.latest_scan(stored, F.lit(today).cast("date"))


def regrid(
    spark: SparkSession,
    root: str,
    gates: DataFrame,
    sites: DataFrame,
    grid_km: float = 200.0,
    resolution_km: float = 1.0,
) -> DataFrame:
    """radar-decode-pending, radar-backfill: G9, S10.  ``sites`` gives latitude and longitude."""
    frames = R.regrid_gates(gates, grid_km, resolution_km).join(sites, "station", "left")
    return replace_into(
        spark, f"{root}/radar_frames", "radar_frames", frames.withColumn(SEQ, F.lit(0)), SEQ
    )


def _frames(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/radar_frames", "radar_frames").drop("scan_date")


def _latest_flow(spark: SparkSession, root: str, block: int, radius: int, levels: int) -> DataFrame:
    """Motion of every station's last two frames.

    The day folders that hold them are looked up first (at most one value per
    calendar day), so grids are read from those folders only.
    """
    table = read_table(spark, f"{root}/radar_frames", "radar_frames")
    keys = R.latest_keys(table, 2, keep=["scan_date"])
    dates = [r[0] for r in keys.select("scan_date").distinct().collect()]
    if not dates:
        R.require_frames(table, 2)  # no station can be used
    recent = table.filter(F.col("scan_date").isin(dates)).drop("scan_date")
    return R.block_flow(R.frame_pairs(R.latest_frames(recent, 2)), block, radius, levels)


def nowcast(
    spark: SparkSession,
    root: str,
    lead_minutes: float = DEFAULT_LEAD_MINUTES,
    block: int = 15,
    radius: int = 4,
    levels: int = 3,
) -> DataFrame:
    """radar-nowcast: K1, W12, G1-G4, S11, J6 for every station at once."""
    rows = R.nowcast(_latest_flow(spark, root, block, radius, levels), lead_minutes)
    return replace_into(
        spark, f"{root}/radar_nowcasts", "radar_nowcasts", rows.withColumn(SEQ, F.lit(0)), SEQ
    )


def score_nowcasts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """radar-nowcast-evaluate: J4, J14, A8, A6, J6.  Returns (scores, pending per method and lead)."""
    nowcasts = read_table(spark, f"{root}/radar_nowcasts", "radar_nowcasts").drop("valid_date")
    frames = _frames(spark, root)
    scores = R.score_methods(R.grid_scores(nowcasts, frames))
    rows = scores.select(_now().alias("evaluated_at"), *scores.columns).withColumn(SEQ, F.lit(0))
    replace_into(
        spark, f"{root}/radar_nowcast_performance", "radar_nowcast_performance", rows, SEQ
    )
    waiting = R.match_grids(nowcasts, frames).filter(F.col("actual_at").isNull())
    pending = (
        nowcasts.select("station", "valid_at", "method", "lead_minutes")
        .join(waiting, ["station", "valid_at"], "left_semi")
        .groupBy("method", "lead_minutes")
        .agg(F.count(F.lit(1)).alias("n_pending"))
    )
    return scores.orderBy("lead_minutes", "method"), pending


def region_product(
    spark: SparkSession,
    root: str,
    boxes: DataFrame,
    spacing: int = 20,
    block: int = 15,
    radius: int = 4,
    levels: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """radar-image: G7, F9, A14, G8 of the latest frames.  ``boxes``: point_id, station,
    point_lat, point_lon, radius_km."""
    flow = _latest_flow(spark, root, block, radius, levels)
    bounds = R.crop_bounds(flow, boxes)
    missed = bounds.filter("NOT in_range").select("point_id").distinct()
    reject(spark, root, "region product", "outside the radar grid", missed)
    inside = bounds.filter("in_range").select("point_id").distinct()
    if inside.isEmpty():
        raise OutOfRadarRangeError(f"outside the radar grid: points {[r[0] for r in missed.limit(5).collect()]}")
    return R.region_product(flow, boxes.join(inside, "point_id", "left_semi"), spacing)


def storm_check(
    spark: SparkSession,
    root: str,
    points: DataFrame,
    alerts_path: str | None = None,
    lead_minutes: float = DEFAULT_LEAD_MINUTES,
    block: int = 15,
    radius: int = 4,
    levels: int = 3,
) -> tuple[DataFrame, DataFrame | None]:
    """storm-check: S2, G5, G6.  Returns (rain check per point, active alerts)."""
    checks = R.check_points(R.nowcast(_latest_flow(spark, root, block, radius, levels), lead_minutes), points)
    alerts = feeds.parse_alerts(feeds.read_documents(spark, alerts_path)) if alerts_path else None
    return checks, alerts
