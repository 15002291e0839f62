"""Streaming jobs run to completion over files spooled from the tables.

The twins are the batch results: a stream that is replayed from files has to end in
exactly the table a batch job would build.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.carrier_sql import micros, r6, with_ctes
from catalog.carriers import c_daily, c_fixes, c_frames, c_obs, c_scans
from catalog.queries_daily import _BLEND, _JOINED, _preds_sql, c_preds
from catalog.queries_grids import _ACTUAL, _NOWCAST, _SCORES, LEAD, flow_frames
from catalog.queries_tracks import _FORECASTS, _nearest, c_track_preds
from catalog.registry import present, query
from skyloom.operators import rasters as R
from skyloom.operators.verify import score_days
from skyloom.session import workspace
from skyloom.sources.schemas import TABLES
from skyloom.sources.tables import read_table, replace_into
from skyloom.streaming import jobs as J


def spool(df, folder, parts=(None,)):
    """Write the parts one after the other, so that the file source sees them in this order."""
    for part in parts:
        rows = df if part is None else df.filter(part)
        rows.write.mode("append").parquet(folder)


def stream_of(spark, df, folder, parts=(None,)):
    """A file stream over the spooled parts, about one micro-batch per part."""
    spool(df, folder, parts)
    written = spark.read.parquet(folder)
    per_batch = -(-len(written.inputFiles()) // len(parts)) if len(parts) > 1 else None
    return J.file_stream(spark, folder, written.schema, files_per_batch=per_batch)


def _thirds(column):
    at = F.col(column)
    one, two = (F.lit(t).cast("timestamp") for t in ("2024-01-11", "2024-01-21"))
    return [at < one, (at >= one) & (at < two), at >= two]


def _finish(stream_query):
    stream_query.awaitTermination()


def _observed(spark, sf_dir):
    """Reports with all columns of the observations table."""
    reports = c_obs(spark, sf_dir)
    missing = [c for c in TABLES["observations"].schema.fieldNames() if c not in reports.columns]
    return reports.select("*", *[F.lit(None).cast("double").alias(c) for c in missing])


@query(
    "t_ingest",
    with_ctes(
        "obs",
        f"""SELECT station_id, {micros('timestamp')} AS timestamp, text_description, {r6('temperature_c')} AS temperature_c,
  {r6('precip_last_hour_mm')} AS precip_last_hour_mm, {r6('relative_humidity_pct')} AS relative_humidity_pct
FROM c_obs QUALIFY row_number() OVER (PARTITION BY station_id, c_obs.timestamp ORDER BY ingest_seq) = 1""",
    ),
)
def t_ingest(spark, sf_dir):
    root = workspace(spark, "t-ingest")
    reports = _observed(spark, sf_dir)
    stream = stream_of(spark, reports, f"{root}/spool", _thirds("timestamp"))
    _finish(J.ingest_observations(stream, root, f"{root}/checkpoint"))
    stored = read_table(spark, f"{root}/observations", "observations")
    return present(
        stored.select(
            "station_id", "timestamp", "text_description", "temperature_c", "precip_last_hour_mm",
            "relative_humidity_pct",
        )
    )


@query(
    "t_live_daily",
    with_ctes(
        "obs",
        """kept AS (SELECT * FROM c_obs
  QUALIFY row_number() OVER (PARTITION BY station_id, c_obs.timestamp ORDER BY ingest_seq) = 1)""",
        f"""SELECT station_id,
  strftime(CAST((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE), '%Y-%m-%d') AS date,
  'metar_live' AS source, {r6('max(temperature_c)')} AS temp_max_c, {r6('min(temperature_c)')} AS temp_min_c,
  {r6('sum(coalesce(precip_last_hour_mm, 0))')} AS precip_mm,
  CAST(CASE WHEN sum(coalesce(precip_last_hour_mm, 0)) >= 0.254 THEN 1 ELSE 0 END AS BIGINT) AS rain,
  {r6('avg(relative_humidity_pct)')} AS humidity_pct, {r6('avg(barometric_pressure_pa) / 100')} AS pressure_hpa,
  {r6('avg(wind_speed_kmh)')} AS wind_speed_kmh
FROM kept GROUP BY 1, 2""",
    ),
)
def t_live_daily(spark, sf_dir):
    root = workspace(spark, "t-live")
    reports = _observed(spark, sf_dir)
    stream = stream_of(spark, reports, f"{root}/spool", _thirds("timestamp"))
    _finish(J.ingest_and_refresh(stream, root, f"{root}/checkpoint"))
    return present(read_table(spark, f"{root}/daily_observations", "daily_observations").drop("obs_year"))


@query(
    "t_live_zones",
    with_ctes(
        "obs",
        """kept AS (SELECT * FROM c_obs
  QUALIFY row_number() OVER (PARTITION BY station_id, c_obs.timestamp ORDER BY ingest_seq) = 1)""",
        f"""SELECT station_id,
  strftime(CAST((timestamp AT TIME ZONE 'UTC') AT TIME ZONE CASE station_id WHEN 'ST1' THEN 'Europe/Berlin' WHEN 'ST2' THEN 'Asia/Kolkata' ELSE 'America/Chicago' END AS DATE), '%Y-%m-%d') AS date,
  'metar_live' AS source, {r6('max(temperature_c)')} AS temp_max_c, {r6('min(temperature_c)')} AS temp_min_c,
  {r6('sum(coalesce(precip_last_hour_mm, 0))')} AS precip_mm,
  CAST(CASE WHEN sum(coalesce(precip_last_hour_mm, 0)) >= 0.254 THEN 1 ELSE 0 END AS BIGINT) AS rain,
  {r6('avg(relative_humidity_pct)')} AS humidity_pct, {r6('avg(barometric_pressure_pa) / 100')} AS pressure_hpa,
  {r6('avg(wind_speed_kmh)')} AS wind_speed_kmh
FROM kept GROUP BY 1, 2""",
    ),
)
def t_live_zones(spark, sf_dir):
    """The same with stations in three zones."""
    root = workspace(spark, "t-zones")
    zones = spark.createDataFrame([("ST1", "Europe/Berlin"), ("ST2", "Asia/Kolkata")], "station_id string, tz string")
    stations = zones.select("*", *[F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")])
    replace_into(spark, f"{root}/stations", "stations", stations.withColumn("ingest_seq", F.lit(0)), "ingest_seq")
    stream = stream_of(spark, _observed(spark, sf_dir), f"{root}/spool", _thirds("timestamp"))
    _finish(J.ingest_and_refresh(stream, root, f"{root}/checkpoint"))
    return present(read_table(spark, f"{root}/daily_observations", "daily_observations").drop("obs_year"))


@query(
    "t_scan_landing",
    with_ctes(
        "scans",
        f"""SELECT DISTINCT file_name, site AS station, {micros('seen_at')} AS timestamp,
  strftime(seen_at, '%Y-%m-%d') AS scan_date, strftime(seen_at, '%Y/%m/%d') || '/' || site || '/' || file_name AS "key" FROM scans""",
    ),
)
def t_scan_landing(spark, sf_dir):
    root = workspace(spark, "t-scans")
    listing = c_scans(spark, sf_dir)
    halves = [F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1]
    stream = stream_of(spark, listing, f"{root}/spool", halves)
    _finish(J.land_scans(stream, root, f"{root}/checkpoint"))
    return present(read_table(spark, f"{root}/radar_scans", "radar_scans").drop("landed_date"))


@query(
    "t_score",
    with_ctes(
        "daily",
        _preds_sql("c_daily", _BLEND),
        _JOINED,
        f"""SELECT model_trained_at, CAST(horizon_days AS BIGINT) AS horizon_days, CAST(count(*) AS BIGINT) AS n_samples,
  {r6('avg(CASE WHEN actual_rain = rain_predicted THEN 1.0 WHEN actual_rain <> rain_predicted THEN 0.0 END)')} AS rain_accuracy,
  {r6('avg(power(actual_rain - rain_probability, 2))')} AS rain_brier,
  {r6('avg(abs(actual_temp_max_c - temp_max_pred_c))')} AS temp_max_mae,
  {r6('avg(abs(actual_temp_min_c - temp_min_pred_c))')} AS temp_min_mae
FROM joined WHERE NOT pending GROUP BY 1, 2""",
    ),
)
def t_score(spark, sf_dir):
    """Stream-stream join of forecasts and outcomes, then the scores of what matched."""
    root = workspace(spark, "t-score")
    preds = stream_of(spark, c_preds(spark, sf_dir), f"{root}/predictions")
    truth = stream_of(spark, c_daily(spark, sf_dir).drop("ingest_seq"), f"{root}/outcomes")
    writer = (
        J.match_days(preds, truth)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
    )
    _finish(writer.start(f"{root}/matched"))
    matched = spark.read.parquet(f"{root}/matched")
    scores = score_days(matched).filter("n_samples > 0")
    return present(scores.drop("n_pending", "n_rain"))


_REVISED_SCORES = f"""SELECT model_trained_at, CAST(horizon_days AS BIGINT) AS horizon_days,
  CAST(count(*) FILTER (WHERE NOT pending) AS BIGINT) AS n_samples, CAST(count(*) FILTER (WHERE pending) AS BIGINT) AS n_pending,
  {r6('avg(CASE WHEN pending THEN NULL WHEN actual_rain = rain_predicted THEN 1.0 WHEN actual_rain <> rain_predicted THEN 0.0 END)')} AS rain_accuracy,
  {r6('avg(CASE WHEN NOT pending THEN power(actual_rain - rain_probability, 2) END)')} AS rain_brier,
  {r6('avg(abs(actual_temp_max_c - temp_max_pred_c))')} AS temp_max_mae,
  {r6('avg(CASE WHEN NOT pending THEN abs(actual_temp_min_c - temp_min_pred_c) END)')} AS temp_min_mae
FROM joined GROUP BY 1, 2"""


@query("t_score_revised", with_ctes("daily", _preds_sql("c_daily", _BLEND), _JOINED, _REVISED_SCORES))
def t_score_revised(spark, sf_dir):
    """Every day gets a provisional outcome too; of odd months the final one comes first. Scored once, by the final one."""
    root = workspace(spark, "t-revised")
    final = c_daily(spark, sf_dir).drop("ingest_seq").withColumn("version", F.lit(2))
    early = final.withColumn("version", F.lit(1)).withColumns(
        {"temp_max_c": F.col("temp_max_c") + 40, "rain": F.when(F.col("rain") == 0, 1), "temp_min_c": F.lit(None).cast("double")}
    )
    outcomes = early.unionByName(final).withColumn("kind", F.lit("outcome"))
    forecasts = c_preds(spark, sf_dir).withColumn("kind", F.lit("prediction"))
    rows = outcomes.unionByName(forecasts, allowMissingColumns=True)
    odd = F.month("date") % 2 == 1
    turns = [
        (F.col("kind") == "outcome") & F.when(odd, F.col("version") == 2).otherwise(F.col("version") == 1),
        (F.col("kind") == "prediction") & (F.col("horizon_days") == 1),
        (F.col("kind") == "outcome") & F.when(odd, F.col("version") == 1).otherwise(F.col("version") == 2),
        (F.col("kind") == "prediction") & (F.col("horizon_days") != 1),
    ]
    _finish(J.match_outcomes(stream_of(spark, rows, f"{root}/spool", turns), root, f"{root}/checkpoint"))
    matched = read_table(spark, f"{root}/prediction_outcomes", "prediction_outcomes")
    scores = score_days(matched.withColumn("pending", F.col("actual_temp_max_c").isNull()))
    return present(scores.drop("n_rain"))


@query(
    "t_score_nowcasts",
    with_ctes(
        "frames cells",
        *_NOWCAST,
        _ACTUAL,
        _SCORES,
        f"""SELECT station, {micros('predicted_at')} AS predicted_at, {micros('valid_at')} AS valid_at, method,
  CAST({LEAD} AS DOUBLE) AS lead_minutes, {micros('actual_at')} AS actual_at, round(mae_dbz, 4) + 0.0 AS mae_dbz, {r6('csi')} AS csi FROM scores""",
    ),
)
def t_score_nowcasts(spark, sf_dir):
    """Frames and nowcasts come mixed, many before their truth and many after; the table ends as the batch join."""
    root = workspace(spark, "t-nowcasts")
    frames = c_frames(spark, sf_dir)
    nowcasts = R.nowcast(flow_frames(spark, sf_dir, frames), LEAD)
    rows = frames.withColumn("kind", F.lit("frame")).unionByName(
        nowcasts.withColumn("kind", F.lit("nowcast")), allowMissingColumns=True
    )
    turn = F.pmod(F.xxhash64("station", F.coalesce("timestamp", "predicted_at"), "kind"), F.lit(3))
    stream = stream_of(spark, rows, f"{root}/spool", [turn == i for i in range(3)])
    _finish(J.match_nowcasts(stream, root, f"{root}/checkpoint"))
    outcomes = read_table(spark, f"{root}/radar_nowcast_outcomes", "radar_nowcast_outcomes")
    return present(outcomes.drop("valid_date"), mae_dbz=4)


@query(
    "t_score_tracks",
    with_ctes(
        "fixes",
        *_FORECASTS,
        _nearest("forecasts", "valid_at", "later"),
        f"""SELECT storm_id, {micros('timestamp')} AS predicted_at, CAST(h AS BIGINT) AS horizon_hours,
  {micros('target_at')} AS actual_at, {r6('lat_target')} AS actual_lat, {r6('lon_target')} AS actual_lon,
  {r6('wind_target')} AS actual_wind_kt FROM matched WHERE target_at IS NOT NULL""",
    ),
)
def t_score_tracks(spark, sf_dir):
    """Fixes arrive in three batches out of order; the outcome table ends as the batch join."""
    root = workspace(spark, "t-tracks")
    preds = c_track_preds(spark, sf_dir).withColumn("ingest_seq", F.lit(0))
    replace_into(spark, f"{root}/hurricane_predictions", "hurricane_predictions", preds, "ingest_seq")
    thirds = [F.col("ingest_seq") % 3 == i for i in range(3)]
    stream = stream_of(spark, c_fixes(spark, sf_dir), f"{root}/spool", thirds)
    _finish(J.match_tracks(stream, root, f"{root}/checkpoint"))
    outcomes = read_table(spark, f"{root}/hurricane_outcomes", "hurricane_outcomes")
    return present(
        outcomes.select(
            "storm_id", "predicted_at", "horizon_hours", "actual_at", "actual_lat", "actual_lon", "actual_wind_kt"
        )
    )
