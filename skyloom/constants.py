"""Values that decide results.  One place, so a reader can check them at a glance."""

# --- fixed values -----------------------------------------------------------
RAIN_THRESHOLD_MM = 0.254
RAIN_THRESHOLD_DBZ = 20.0
NO_ECHO_DBZ = -32.0
DBZ_CLIP = (-30.0, 70.0)
DBZ_CLASS_EDGES = (5.0, 20.0, 30.0, 40.0, 50.0)
DBZ_CLASS_COLOURS = ("white", "blue", "green", "yellow", "orange", "red")
ARROW_MIN_DBZ = 15.0
STILL_BLOCK_PX = 1e-3

INHG_TO_HPA = 33.8639
MPH_TO_KMH = 1.60934
PA_PER_HPA = 100.0
EARTH_RADIUS_KM = 6371.0
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON_EQUATOR = 111.320

LOCAL_TZ = "America/Chicago"
DAY_HORIZONS = (1, 2, 3)
TRACK_HORIZONS_H = (12, 24, 48, 72)
TRACK_TOLERANCE_S = 5400.0
GRID_TOLERANCE_S = 150.0
DEFAULT_LEAD_MINUTES = 30.0
MIN_TRAINING_DAYS = 14
MIN_TRAINING_FIXES = 50
TEST_SEASONS = 5
MAX_RANGE_DAYS = 365
STATION_LOOKUP_LIMIT = 25
OBSERVATION_LIMIT = 500
DEFAULT_PRESSURE_MB = 1010.0
TRACK_SENTINELS = (-999.0,)

SOURCE_AUTHORITY = "ghcnd"
SOURCE_LIVE = "metar_live"
SOURCE_ENRICH = "lcd"

PERSISTENCE = "persistence"
MOTION = "optical_flow"

DATATYPES = ("TMAX", "TMIN", "PRCP")

DAILY_FEATURES = (
    "temp_max_c",
    "temp_min_c",
    "precip_mm",
    "rain",
    "rain_yesterday",
    "temp_max_trend_c",
    "temp_max_3d_mean_c",
    "temp_min_3d_mean_c",
    "precip_3d_mean_mm",
    "precip_7d_mean_mm",
    "humidity_pct",
    "pressure_hpa",
    "pressure_delta_hpa",
    "pressure_3d_mean_hpa",
    "wind_speed_kmh",
    "month_sin",
    "month_cos",
    "doy_sin",
    "doy_cos",
)

TRACK_FEATURES = (
    "lat",
    "lon",
    "max_wind_kt",
    "min_pressure_mb",
    "motion_bearing_sin",
    "motion_bearing_cos",
    "motion_speed_kmh",
    "storm_age_hours",
    "doy_sin",
    "doy_cos",
)

# feed property -> table column, for the measurements of an observation report
OBSERVATION_MEASURES = {
    "temperature": "temperature_c",
    "dewpoint": "dewpoint_c",
    "windDirection": "wind_direction_deg",
    "windSpeed": "wind_speed_kmh",
    "windGust": "wind_gust_kmh",
    "barometricPressure": "barometric_pressure_pa",
    "seaLevelPressure": "sea_level_pressure_pa",
    "visibility": "visibility_m",
    "maxTemperatureLast24Hours": "max_temp_last_24h_c",
    "minTemperatureLast24Hours": "min_temp_last_24h_c",
    "precipitationLastHour": "precip_last_hour_mm",
    "precipitationLast3Hours": "precip_last_3h_mm",
    "precipitationLast6Hours": "precip_last_6h_mm",
    "relativeHumidity": "relative_humidity_pct",
    "windChill": "wind_chill_c",
    "heatIndex": "heat_index_c",
}
# --- end of fixed values ----------------------------------------------------
