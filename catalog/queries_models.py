"""Forests over the whole tables.

Forests are random by nature, so the twins hold what is not: which rows are predicted, their labels
and keys, and that every prediction is a probability or lies within the values it was learnt from (a
forest's mean cannot leave them). Skill is tested in ``tests/test_operators.py``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.carrier_sql import day, micros, r6, with_ctes
from catalog.carriers import c_daily, c_fixes
from catalog.queries_daily import _LATEST, FEATURES_SQL, _labelled
from catalog.queries_sources import _STORMS, storm_docs
from catalog.queries_tracks import _BASELINE, _LABELLED
from catalog.registry import present, query
from skyloom.operators import daily as D, forests as M, tracks as K
from skyloom.session import workspace
from skyloom.sources.feeds import parse_active_storms

VERSION = "2024-02-01T00:00:00Z"


def _features(spark, sf_dir):
    return D.daily_features(c_daily(spark, sf_dir))


def _within(rows, bounds, **columns):
    """A flag per prediction: whether it lies within the least and largest value of its column in ``bounds``."""
    least = {c: (bounds.agg(F.min(c)).scalar(), bounds.agg(F.max(c)).scalar()) for c in columns.values()}
    return rows.withColumns(
        {f"{p}_within": F.coalesce(F.col(p).between(*least[c]), F.lit(False)).cast("int") for p, c in columns.items()}
    )


def _tests(columns):
    """The hold-out rows of all horizons."""
    return " UNION ALL ".join(
        f"SELECT station_id, {day('date')} AS date, CAST({h} AS BIGINT) AS horizon_days, {columns} FROM split{h} WHERE is_test"
        for h in (1, 2, 3)
    )


_SPLITS = ("daily", FEATURES_SQL, *map(_labelled, (1, 2, 3)))


@query(
    "m_rain",
    with_ctes(*_SPLITS, _tests("CAST(y_rain AS BIGINT) AS y_rain, CAST(rain AS BIGINT) AS rain, CAST(1 AS BIGINT) AS is_probability")),
)
def m_rain(spark, sf_dir):
    """M3: hold-out rain probabilities at all horizons."""
    _, holdout = M.fit_days(_features(spark, sf_dir), VERSION, targets=("rain",))
    sound = F.coalesce(F.col("rain_probability").between(0, 1), F.lit(False)).cast("int")
    return present(
        holdout.select("station_id", "date", "horizon_days", "y_rain", "rain", sound.alias("is_probability"))
    )


@query(
    "m_temp",
    with_ctes(
        *_SPLITS,
        _tests(
            f"{r6('y_temp_max')} AS y_temp_max, {r6('y_temp_min')} AS y_temp_min,"
            " CAST(1 AS BIGINT) AS temp_max_pred_c_within, CAST(1 AS BIGINT) AS temp_min_pred_c_within"
        ),
    ),
)
def m_temp(spark, sf_dir):
    """M4: hold-out high and low at all horizons."""
    _, holdout = M.fit_days(_features(spark, sf_dir), VERSION, targets=("temp_max", "temp_min"))
    rows = _within(holdout, c_daily(spark, sf_dir), temp_max_pred_c="temp_max_c", temp_min_pred_c="temp_min_c")
    return present(
        rows.select(
            "station_id", "date", "horizon_days", "y_temp_max", "y_temp_min", "temp_max_pred_c_within", "temp_min_pred_c_within"
        )
    )


def _fit_tracks(spark, sf_dir, horizons=(12, 24, 48, 72)):
    fixes = c_fixes(spark, sf_dir)
    motion = K.storm_motion(fixes, seq="ingest_seq")
    return M.fit_tracks(motion, fixes, VERSION, horizons=horizons)


@query(
    "m_track",
    with_ctes(
        "fixes",
        *_LABELLED,
        *_BASELINE[:-1],
        f"SELECT *, CAST(1 AS BIGINT) AS track_is_scored, CAST(1 AS BIGINT) AS wind_is_scored FROM ({_BASELINE[-1]})",
    ),
)
def m_track(spark, sf_dir):
    """Hold-out track and wind errors beside their baselines."""
    _, holdout = _fit_tracks(spark, sf_dir)
    scores = M.holdout_tracks(holdout)
    scored = lambda c: F.coalesce(F.col(c) > 0, F.lit(False)).cast("int")
    return present(
        scores.select(
            "horizon_hours", "n_test", "track_baseline_error_km", "wind_baseline_mae_kt",
            scored("track_error_km").alias("track_is_scored"), scored("wind_mae_kt").alias("wind_is_scored"),
        ),
        track_baseline_error_km=3,
    )


@query(
    "m_forecast_days",
    with_ctes(
        "daily",
        FEATURES_SQL,
        _LATEST,
        f"""SELECT station_id, {day('date')} AS predicted_date, CAST(h AS BIGINT) AS horizon_days,
  {day('date + CAST(h AS INTEGER)')} AS target_date, '{VERSION}' AS model_trained_at, CAST(1 AS BIGINT) AS rain_is_said,
  CAST(1 AS BIGINT) AS temp_max_pred_c_within, CAST(1 AS BIGINT) AS temp_min_pred_c_within
FROM (SELECT *, unnest([1, 2, 3]) AS h FROM latest)""",
    ),
)
def m_forecast_days(spark, sf_dir):
    """Train, save, load, forecast every station's latest day."""
    features = _features(spark, sf_dir)
    bundle, _ = M.fit_days(features, VERSION)
    path = workspace(spark, "day-models")
    M.save_bundle(spark, bundle, path)
    rows = M.forecast_days(M.load_bundle(spark, path), D.latest_features(features))
    rows = _within(rows, c_daily(spark, sf_dir), temp_max_pred_c="temp_max_c", temp_min_pred_c="temp_min_c")
    chance = F.col("rain_probability")
    said = chance.between(0, 1) & (F.col("rain_predicted") == (chance >= 0.5).cast("int"))
    return present(
        rows.select(
            "station_id", "predicted_date", "horizon_days", "target_date", "model_trained_at",
            F.coalesce(said, F.lit(False)).cast("int").alias("rain_is_said"), "temp_max_pred_c_within", "temp_min_pred_c_within",
        )
    )


@query(
    "m_forecast_storms",
    with_ctes(
        "events",
        _STORMS,
        f"""SELECT {micros('seen_at')} AS predicted_at, upper(id) AS storm_id, name AS storm_name, CAST(h AS BIGINT) AS horizon_hours,
  {micros('seen_at')} + h * 3600000000 AS valid_at, '{VERSION}' AS model_trained_at,
  CAST(1 AS BIGINT) AS lat_pred_within, CAST(1 AS BIGINT) AS lon_pred_within, CAST(1 AS BIGINT) AS wind_pred_kt_within
FROM (SELECT *, unnest([12, 24, 48, 72]) AS h FROM storms WHERE lat IS NOT NULL AND last_update <> '')""",
    ),
)
def m_forecast_storms(spark, sf_dir):
    """M8: every live storm at every horizon."""
    bundle, _ = _fit_tracks(spark, sf_dir)
    live, _ = K.live_features(parse_active_storms(storm_docs(spark, sf_dir)))
    rows = M.forecast_storms(bundle, live)
    rows = _within(rows, c_fixes(spark, sf_dir), lat_pred="lat", lon_pred="lon", wind_pred_kt="max_wind_kt")
    return present(rows.drop("lat_pred", "lon_pred", "wind_pred_kt"))


@query(
    "q_model_manifest",
    f"SELECT '{VERSION}' AS trained_at, CAST(h AS BIGINT) AS horizon, 'rain' AS target FROM (SELECT unnest([1, 2, 3]) AS h)",
)
def q_model_manifest(spark, sf_dir):
    """Manifest of a saved bundle."""
    bundle, _ = M.fit_days(_features(spark, sf_dir), VERSION, targets=("rain",))
    path = workspace(spark, "manifest")
    M.save_bundle(spark, bundle, path)
    return M.read_manifest(spark, path).select("trained_at", F.col("horizon").cast("long").alias("horizon"), "target")
