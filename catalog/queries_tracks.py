"""Storm track."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.carrier_sql import bearing, day, dest_lat, dest_lon, haversine, micros, r6, with_ctes, wrap360
from catalog.carriers import c_fixes, events
from catalog.registry import present, query
from skyloom.constants import TEST_SEASONS, TRACK_FEATURES
from skyloom.functions.geo import bearing_deg, compass, destination, haversine_km
from skyloom.functions.register import register_functions
from skyloom.operators import tracks as K, verify as V
from skyloom.sources.tables import materialise

_HOME = ("CAST(36.1245 AS DOUBLE)", "CAST(-86.6782 AS DOUBLE)")
_GEO = with_ctes(
    "events",
    """places AS (SELECT event_id, 10 + value / 20 AS lat, -80 + k * CAST(0.4 AS DOUBLE) AS lon,
  CAST(k AS DOUBLE) * CAST(3.6 AS DOUBLE) AS brg, value * 3 AS km FROM events_k)""",
    f"""SELECT event_id, {r6(haversine(*_HOME, 'lat', 'lon'))} AS km_home,
  {r6(bearing(*_HOME, 'lat', 'lon'))} AS bearing_home, {r6(dest_lat('lat', 'brg', 'km'))} AS end_lat,
  {r6(dest_lon('lat', 'lon', 'brg', 'km'))} AS end_lon,
  {r6(wrap360('degrees(atan2(sin(radians(brg)), cos(radians(brg) + 1))) + 360.0'))} AS turned FROM places""",
)


def _places(spark, sf_dir):
    k = F.col("k")
    return events(spark, sf_dir).select(
        "event_id",
        (10 + F.col("value") / 20).alias("lat"),
        (-80 + k * 0.4).alias("lon"),
        (k.cast("double") * 3.6).alias("brg"),
        (F.col("value") * 3).alias("km"),
    )


@query("q_geo", _GEO)
def q_geo(spark, sf_dir):
    home = (F.lit(36.1245), F.lit(-86.6782))
    lat, lon, brg = F.col("lat"), F.col("lon"), F.col("brg")
    end_lat, end_lon = destination(lat, lon, brg, F.col("km"))
    return present(
        _places(spark, sf_dir).select(
            "event_id",
            haversine_km(*home, lat, lon).alias("km_home"),
            bearing_deg(*home, lat, lon).alias("bearing_home"),
            end_lat.alias("end_lat"),
            end_lon.alias("end_lon"),
            compass(F.sin(F.radians(brg)), F.cos(F.radians(brg) + 1)).alias("turned"),
        )
    )


@query("q_geo_sql", _GEO)
def q_geo_sql(spark, sf_dir):
    """The same through the registered SQL functions."""
    register_functions(spark)
    return present(
        spark.sql(
            """SELECT event_id, haversine_km(36.1245D, -86.6782D, lat, lon) AS km_home,
  bearing_deg(36.1245D, -86.6782D, lat, lon) AS bearing_home, destination_lat(lat, brg, km) AS end_lat,
  destination_lon(lat, lon, brg, km) AS end_lon,
  bearing_from_sincos(sin(radians(brg)), cos(radians(brg) + 1)) AS turned FROM {places}""",
            places=_places(spark, sf_dir),
        )
    )


_PREV = ("plat", "plon", "lat", "lon")
_MOTION = f"""stepped AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
    (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / CAST(3600000000 AS DOUBLE) AS hours,
    (epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY storm_id)) / CAST(3600000000 AS DOUBLE) AS storm_age_hours
  FROM c_fixes WINDOW w AS (PARTITION BY storm_id ORDER BY timestamp)),
motion AS (SELECT storm_id, name, timestamp, lat, lon, max_wind_kt, min_pressure_mb, status, storm_age_hours,
    CASE WHEN hours > 0 THEN sin(radians({bearing(*_PREV)})) END AS motion_bearing_sin,
    CASE WHEN hours > 0 THEN cos(radians({bearing(*_PREV)})) END AS motion_bearing_cos,
    CASE WHEN hours > 0 THEN {haversine(*_PREV)} / hours END AS motion_speed_kmh,
    sin(2 * pi() * dayofyear(timestamp) / CAST(365.25 AS DOUBLE)) AS doy_sin,
    cos(2 * pi() * dayofyear(timestamp) / CAST(365.25 AS DOUBLE)) AS doy_cos
  FROM stepped)"""


def _motion(spark, sf_dir):
    return K.storm_motion(c_fixes(spark, sf_dir), seq="ingest_seq")


def _r(c):
    return f"round({c}, 3) + 0.0" if c == "motion_speed_kmh" else r6(c)


_FEATURES = ", ".join(f"{_r(c)} AS {c}" for c in TRACK_FEATURES)


@query(
    "q_storm_motion",
    with_ctes("fixes", _MOTION, f"SELECT storm_id, name, {micros('timestamp')} AS timestamp, status, {_FEATURES} FROM motion"),
)
def q_storm_motion(spark, sf_dir):
    rows = _motion(spark, sf_dir).select("storm_id", "name", "timestamp", "status", *TRACK_FEATURES)
    return present(rows, motion_speed_kmh=3)


def _nearest(left, due, tie):
    """Brute-force nearest fix: every pair of the storm within the tolerance, ranked."""
    order = "ASC" if tie == "earlier" else "DESC"
    return f"""matched AS (SELECT * EXCLUDE (rn) FROM (
  SELECT l.*, f.timestamp AS target_at, f.lat AS lat_target, f.lon AS lon_target, f.max_wind_kt AS wind_target,
    row_number() OVER (PARTITION BY l.probe ORDER BY abs(epoch_us(f.timestamp) - epoch_us(l.{due})), f.timestamp {order}) AS rn
  FROM (SELECT *, row_number() OVER () AS probe FROM {left}) l LEFT JOIN c_fixes f
    ON f.storm_id = l.storm_id AND abs(epoch_us(f.timestamp) - epoch_us(l.{due})) <= 5400000000)
  WHERE rn = 1)"""


_PROBES = """probes AS (SELECT *, make_timestamp(CAST(epoch_us(timestamp) + h * 3600000000 AS BIGINT)) AS due
  FROM (SELECT *, unnest([12, 24, 48, 72]) AS h FROM {source}))"""
_TARGETS = f"""{r6('lat_target')} AS lat_target, {r6('lon_target')} AS lon_target, {r6('wind_target')} AS wind_target"""


@query(
    "q_asof_self",
    with_ctes(
        "fixes",
        _PROBES.format(source="c_fixes"),
        _nearest("probes", "due", "earlier"),
        f"""SELECT storm_id, {micros('timestamp')} AS timestamp, CAST(h AS BIGINT) AS horizon_hours,
  {micros('target_at')} AS target_at, {_TARGETS} FROM matched""",
    ),
)
def q_asof_self(spark, sf_dir):
    fixes = c_fixes(spark, sf_dir)
    return present(K.track_targets(fixes.select("storm_id", "timestamp"), fixes))


def _wide(h):
    return ", ".join(
        f"{r6(f'max(CASE WHEN h = {h} THEN {c} END)')} AS {name}_h{h}"
        for name, c in (("lat", "lat_target"), ("lon", "lon_target"), ("wind", "wind_target"))
    )


@query(
    "q_targets_wide",
    with_ctes(
        "fixes",
        _PROBES.format(source="c_fixes"),
        _nearest("probes", "due", "earlier"),
        f"""SELECT storm_id, {micros('timestamp')} AS timestamp, {', '.join(_wide(h) for h in (12, 24, 48, 72))}
FROM matched GROUP BY storm_id, matched.timestamp""",
    ),
)
def q_targets_wide(spark, sf_dir):
    fixes = c_fixes(spark, sf_dir)
    return present(K.wide_targets(K.track_targets(fixes.select("storm_id", "timestamp"), fixes)))


_LABELLED = (
    _MOTION,
    _PROBES.format(source="motion"),
    _nearest("probes", "due", "earlier"),
    "labelled AS (SELECT * FROM matched WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in (*TRACK_FEATURES, "lat_target", "lon_target", "wind_target"))
    + ")",
    """seasons AS (SELECT *, year(timestamp) > max(year(timestamp)) OVER (PARTITION BY h) - 5 AS is_test FROM labelled)""",
)


def _training(spark, sf_dir):
    return K.track_training(_motion(spark, sf_dir), c_fixes(spark, sf_dir))


@query(
    "q_storm_training",
    with_ctes(
        "fixes",
        *_LABELLED[:-1],
        f"""SELECT storm_id, {micros('timestamp')} AS timestamp, CAST(h AS BIGINT) AS horizon_hours, {_FEATURES}, {_TARGETS}
FROM labelled""",
    ),
)
def q_storm_training(spark, sf_dir):
    return present(_training(spark, sf_dir), motion_speed_kmh=3)


@query(
    "q_season_split",
    with_ctes(
        "fixes",
        *_LABELLED,
        f"""SELECT storm_id, {micros('timestamp')} AS timestamp, CAST(h AS BIGINT) AS horizon_hours,
  CAST(is_test AS BIGINT) AS is_test FROM seasons""",
    ),
)
def q_season_split(spark, sf_dir):
    rows = K.season_split(materialise(spark, _training(spark, sf_dir).select("storm_id", "timestamp", "horizon_hours")))
    return present(rows.select("storm_id", "timestamp", "horizon_hours", "is_test"))


_BEARING = wrap360("degrees(atan2(motion_bearing_sin, motion_bearing_cos)) + 360.0")
_LINE = (
    dest_lat("lat", "course", "motion_speed_kmh * h"),
    dest_lon("lat", "lon", "course", "motion_speed_kmh * h"),
)


_BASELINE = (
    f"courses AS (SELECT *, {_BEARING} AS course FROM seasons WHERE is_test)",
    f"ends AS (SELECT *, {_LINE[0]} AS lat2, {_LINE[1]} AS lon2 FROM courses)",
    f"""SELECT CAST(h AS BIGINT) AS horizon_hours, CAST(count(*) AS BIGINT) AS n_test,
  round(avg({haversine('lat2', 'lon2', 'lat_target', 'lon_target')}), 3) AS track_baseline_error_km,
  {r6('avg(abs(wind_target - max_wind_kt))')} AS wind_baseline_mae_kt FROM ends GROUP BY h""",
)


@query("q_track_baseline", with_ctes("fixes", *_LABELLED, *_BASELINE))
def q_track_baseline(spark, sf_dir):
    return present(K.track_baseline(_training(spark, sf_dir), TEST_SEASONS), track_baseline_error_km=3)


_FORECASTS = (
    _MOTION,
    f"courses AS (SELECT *, {_BEARING} AS course FROM motion WHERE motion_speed_kmh IS NOT NULL)",
    f"""forecasts AS (SELECT storm_id, name, timestamp, h, make_timestamp(CAST(epoch_us(timestamp) + h * 3600000000 AS BIGINT)) AS valid_at,
    {_LINE[0]} AS lat_pred, {_LINE[1]} AS lon_pred, max_wind_kt AS wind_pred_kt,
    'm' || CAST(year(timestamp) % 3 AS VARCHAR) AS model_trained_at
  FROM (SELECT *, unnest([12, 24, 48, 72]) AS h FROM courses))""",
)


def c_track_preds(spark, sf_dir):
    version = F.concat(F.lit("m"), (F.year("timestamp") % 3).cast("string"))
    return K.straight_line_forecasts(_motion(spark, sf_dir), version)


@query(
    "q_track_forecasts",
    with_ctes(
        "fixes",
        *_FORECASTS,
        f"""SELECT {micros('timestamp')} AS predicted_at, storm_id, name AS storm_name, CAST(h AS BIGINT) AS horizon_hours,
  {micros('valid_at')} AS valid_at, round(lat_pred, 3) + 0.0 AS lat_pred, round(lon_pred, 3) + 0.0 AS lon_pred,
  {r6('wind_pred_kt')} AS wind_pred_kt, model_trained_at FROM forecasts""",
    ),
)
def q_track_forecasts(spark, sf_dir):
    return present(c_track_preds(spark, sf_dir), lat_pred=3, lon_pred=3)


@query(
    "q_asof_eval",
    with_ctes(
        "fixes",
        *_FORECASTS,
        _nearest("forecasts", "valid_at", "later"),
        f"""SELECT storm_id, {micros('timestamp')} AS predicted_at, CAST(h AS BIGINT) AS horizon_hours,
  {micros('target_at')} AS actual_at, {r6('lat_target')} AS actual_lat, {r6('lon_target')} AS actual_lon,
  {r6('wind_target')} AS actual_wind_kt, CAST(target_at IS NULL AS BIGINT) AS pending FROM matched""",
    ),
)
def q_asof_eval(spark, sf_dir):
    joined = V.join_fixes(c_track_preds(spark, sf_dir), c_fixes(spark, sf_dir))
    return present(
        joined.select(
            "storm_id", "predicted_at", "horizon_hours", "actual_at", "actual_lat", "actual_lon",
            "actual_wind_kt", "pending",
        )
    )


@query(
    "q_track_scores",
    with_ctes(
        "fixes",
        *_FORECASTS,
        _nearest("forecasts", "valid_at", "later"),
        f"""SELECT model_trained_at, CAST(h AS BIGINT) AS horizon_hours, CAST(count(target_at) AS BIGINT) AS n_samples,
  CAST(count(*) - count(target_at) AS BIGINT) AS n_pending,
  round(avg({haversine('lat_pred', 'lon_pred', 'lat_target', 'lon_target')}), 3) AS track_error_km,
  {r6('avg(abs(wind_pred_kt - wind_target))')} AS wind_mae_kt FROM matched GROUP BY 1, 2""",
    ),
)
def q_track_scores(spark, sf_dir):
    joined = V.join_fixes(c_track_preds(spark, sf_dir), c_fixes(spark, sf_dir))
    return present(V.score_tracks(joined), track_error_km=3)
