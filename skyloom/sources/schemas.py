"""Table schemas, keys and storage partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from skyloom.constants import OBSERVATION_MEASURES


@dataclass(frozen=True)
class Table:
    """One stored table: column DDL, merge key, directory partition column (if any).

    The partition value is derived on write from ``partition_expr``, so a filter on it prunes
    directories. Tables of ``grids`` also part their folders by station; their rows are only
    ever appended (see ``skyloom.sources.grids``).
    """

    name: str
    ddl: str
    keys: tuple[str, ...]
    partition: str | None = None
    partition_expr: str | None = None
    grids: bool = False

    @property
    def folders(self) -> tuple[str, ...]:
        """Directory partition columns, outermost first."""
        if self.partition is None:
            return ()
        return ("station", self.partition) if self.grids else (self.partition,)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


_MEASURES = ", ".join(f"{c} DOUBLE" for c in OBSERVATION_MEASURES.values())

TABLES = {
    t.name: t
    for t in (
        Table(
            "stations",
            "station_id STRING, tz STRING, latitude DOUBLE, longitude DOUBLE",
            ("station_id",),
        ),
        Table(
            "rejects",
            "job STRING, reason STRING, record STRING, record_id STRING",
            ("job", "record_id"),
            "of_job",
            "job",
        ),
        Table(
            "observations",
            f"station_id STRING, timestamp TIMESTAMP, text_description STRING, {_MEASURES}",
            ("station_id", "timestamp"),
            "obs_date",
            "to_date(timestamp)",
        ),
        Table(
            "daily_observations",
            "station_id STRING, date DATE, source STRING, temp_max_c DOUBLE, temp_min_c DOUBLE,"
            " precip_mm DOUBLE, rain INT, humidity_pct DOUBLE, pressure_hpa DOUBLE,"
            " wind_speed_kmh DOUBLE",
            ("station_id", "date"),
            "obs_year",
            "year(date)",
        ),
        Table(
            "predictions",
            "station_id STRING, predicted_date DATE, horizon_days INT, target_date DATE,"
            " rain_probability DOUBLE, rain_predicted INT, temp_max_pred_c DOUBLE,"
            " temp_min_pred_c DOUBLE, model_trained_at STRING",
            ("station_id", "predicted_date", "horizon_days"),
            "predicted_month",
            "trunc(predicted_date, 'MM')",
        ),
        Table(
            "model_performance",
            "evaluated_at TIMESTAMP, model_trained_at STRING, horizon_days INT, n_samples BIGINT,"
            " rain_accuracy DOUBLE, rain_brier DOUBLE, temp_max_mae DOUBLE, temp_min_mae DOUBLE",
            ("evaluated_at", "model_trained_at", "horizon_days"),
        ),
        Table(
            "hurricane_fixes",
            "storm_id STRING, name STRING, timestamp TIMESTAMP, lat DOUBLE, lon DOUBLE,"
            " max_wind_kt DOUBLE, min_pressure_mb DOUBLE, status STRING",
            ("storm_id", "timestamp"),
            "season",
            "year(timestamp)",
        ),
        Table(
            "hurricane_predictions",
            "predicted_at TIMESTAMP, storm_id STRING, storm_name STRING, horizon_hours INT,"
            " valid_at TIMESTAMP, lat_pred DOUBLE, lon_pred DOUBLE, wind_pred_kt DOUBLE,"
            " model_trained_at STRING",
            ("predicted_at", "storm_id", "horizon_hours"),
            "season",
            "year(predicted_at)",
        ),
        Table(
            "hurricane_performance",
            "evaluated_at TIMESTAMP, model_trained_at STRING, horizon_hours INT, n_samples BIGINT,"
            " track_error_km DOUBLE, wind_mae_kt DOUBLE",
            ("evaluated_at", "model_trained_at", "horizon_hours"),
        ),
        Table(
            "hurricane_outcomes",
            "predicted_at TIMESTAMP, storm_id STRING, horizon_hours INT, valid_at TIMESTAMP,"
            " lat_pred DOUBLE, lon_pred DOUBLE, wind_pred_kt DOUBLE, model_trained_at STRING,"
            " actual_at TIMESTAMP, actual_lat DOUBLE, actual_lon DOUBLE, actual_wind_kt DOUBLE",
            ("predicted_at", "storm_id", "horizon_hours"),
            "season",
            "year(predicted_at)",
        ),
        Table(
            "radar_scans",
            "file_name STRING, station STRING, timestamp TIMESTAMP, scan_date DATE, key STRING",
            ("file_name",),
            "landed_date",
            "scan_date",
        ),
        Table(
            "radar_frames",
            "station STRING, timestamp TIMESTAMP, grid_km DOUBLE, resolution_km DOUBLE,"
            " latitude DOUBLE, longitude DOUBLE, reflectivity_dbz ARRAY<FLOAT>",
            ("station", "timestamp"),
            "scan_date",
            "to_date(timestamp)",
            grids=True,
        ),
        Table(
            "radar_nowcasts",
            "predicted_at TIMESTAMP, valid_at TIMESTAMP, lead_minutes DOUBLE, method STRING,"
            " station STRING, grid_km DOUBLE, resolution_km DOUBLE, latitude DOUBLE,"
            " longitude DOUBLE, reflectivity_dbz ARRAY<FLOAT>",
            ("station", "predicted_at", "valid_at", "method"),
            "valid_date",
            "to_date(valid_at)",
            grids=True,
        ),
        Table(
            "radar_nowcast_outcomes",
            "station STRING, predicted_at TIMESTAMP, valid_at TIMESTAMP, method STRING,"
            " lead_minutes DOUBLE, actual_at TIMESTAMP, mae_dbz DOUBLE, csi DOUBLE",
            ("station", "predicted_at", "valid_at", "method"),
            "valid_date",
            "to_date(valid_at)",
        ),
        Table(
            "daily_outcomes",
            "station_id STRING, date DATE, rain INT, temp_max_c DOUBLE, temp_min_c DOUBLE, version BIGINT",
            ("station_id", "date"),
            "obs_year",
            "year(date)",
        ),
        Table(
            "prediction_outcomes",
            "station_id STRING, predicted_date DATE, horizon_days INT, target_date DATE,"
            " rain_probability DOUBLE, rain_predicted INT, temp_max_pred_c DOUBLE,"
            " temp_min_pred_c DOUBLE, model_trained_at STRING, actual_rain INT,"
            " actual_temp_max_c DOUBLE, actual_temp_min_c DOUBLE",
            ("station_id", "predicted_date", "horizon_days"),
            "target_month",
            "trunc(target_date, 'MM')",
        ),
        Table(
            "radar_nowcast_performance",
            "evaluated_at TIMESTAMP, method STRING, lead_minutes DOUBLE, n_samples BIGINT,"
            " mae_dbz DOUBLE, csi DOUBLE, csi_threshold_dbz DOUBLE",
            ("evaluated_at", "method", "lead_minutes"),
        ),
    )
}
