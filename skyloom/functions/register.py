"""The scalar functions under SQL names, for users who write SQL.

They are SQL-language functions: Spark inlines the expression into the query,
so no call leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "haversine_km": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        "12742D * asin(if(lat1 + lon1 + lat2 + lon2 IS NULL, NULL,"
        " least(1D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))))",
    ),
    "bearing_deg": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),"
        " cos(radians(lat1)) * sin(radians(lat2))"
        " - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360D, 360D)",
    ),
    "destination_lat": (
        "lat DOUBLE, bearing DOUBLE, km DOUBLE",
        "DOUBLE",
        "degrees(asin(if(lat + bearing + km IS NULL, NULL,"
        " greatest(-1D, least(1D, sin(radians(lat)) * cos(km / 6371D)"
        " + cos(radians(lat)) * sin(km / 6371D) * cos(radians(bearing)))))))",
    ),
    "destination_lon": (
        "lat DOUBLE, lon DOUBLE, bearing DOUBLE, km DOUBLE",
        "DOUBLE",
        "pmod(lon + degrees(atan2(sin(radians(bearing)) * sin(km / 6371D) * cos(radians(lat)),"
        " cos(km / 6371D) - sin(radians(lat)) * (sin(radians(lat)) * cos(km / 6371D)"
        " + cos(radians(lat)) * sin(km / 6371D) * cos(radians(bearing))))) + 540D, 360D) - 180D",
    ),
    "bearing_from_sincos": (
        "s DOUBLE, c DOUBLE",
        "DOUBLE",
        "pmod(degrees(atan2(s, c)) + 360D, 360D)",
    ),
    "km_east": (
        "origin_lat DOUBLE, origin_lon DOUBLE, lon DOUBLE",
        "DOUBLE",
        "(lon - origin_lon) * 111.320D * cos(radians(origin_lat))",
    ),
    "km_north": ("origin_lat DOUBLE, lat DOUBLE", "DOUBLE", "(lat - origin_lat) * 110.574D"),
    "grid_index": (
        "km DOUBLE, grid_km DOUBLE, n INT",
        "INT",
        "if(km + grid_km + n IS NULL, NULL,"
        " greatest(0, least(n - 1, CAST(rint((km + grid_km) / (2D * grid_km) * (n - 1)) AS INT))))",
    ),
    "dbz_class": (
        "dbz DOUBLE",
        "INT",
        "CASE WHEN dbz IS NULL OR isnan(dbz) OR dbz < 5 THEN 0 WHEN dbz < 20 THEN 1"
        " WHEN dbz < 30 THEN 2 WHEN dbz < 40 THEN 3 WHEN dbz < 50 THEN 4 ELSE 5 END",
    ),
    "rain_flag": ("precip_mm DOUBLE", "INT", "coalesce(CAST(precip_mm >= 0.254D AS INT), 0)"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create every function as a temporary SQL function of the session."""
    for name, (params, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}"
        )
    return list(SQL_FUNCTIONS)
