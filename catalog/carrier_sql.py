"""The carriers as DuckDB CTEs, and helpers to write the SQL twins."""

from __future__ import annotations

EVENTS = """events_k AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

OBS = """c_obs AS (
  SELECT 'ST' || CAST(user_id % 10 AS VARCHAR) AS station_id,
         date_trunc('minute', ts) AS timestamp,
         event_type AS text_description,
         CASE WHEN k % 17 <> 0 THEN value / 10 - 10 END AS temperature_c,
         CASE WHEN event_type IN ('view', 'click') THEN CAST(k AS DOUBLE) / 50 END AS precip_last_hour_mm,
         CAST(k AS DOUBLE) AS relative_humidity_pct,
         CAST(101325 + (k - 50) * 20 AS DOUBLE) AS barometric_pressure_pa,
         floor(value) % 40 AS wind_speed_kmh,
         event_id AS ingest_seq
  FROM events_k)"""

DAILY = """daily_sums AS (
  SELECT 'S' || CAST(o_custkey % 5 AS VARCHAR) AS station_id, CAST(o_orderdate AS DATE) AS date,
         max(o_totalprice) AS hi, min(o_totalprice) AS lo,
         CAST(sum(o_custkey) AS BIGINT) AS cs, CAST(sum(o_orderkey) AS BIGINT) AS os
  FROM orders GROUP BY 1, 2),
daily_raw AS (
  SELECT station_id, date,
         CASE WHEN os % 3 = 0 THEN 'ghcnd' WHEN os % 3 = 1 THEN 'metar_live' ELSE 'lcd' END AS source,
         CAST(floor(hi / 100) AS DOUBLE) / 100 AS temp_max_c,
         CAST(floor(lo / 100) AS DOUBLE) / 100 - 5 AS temp_min_c,
         CASE WHEN cs % 11 = 0 THEN NULL WHEN cs % 3 = 0 THEN CAST(cs % 50 AS DOUBLE) / 10
              ELSE CAST(0 AS DOUBLE) END AS precip_mm,
         CASE WHEN os % 13 <> 0 THEN CAST(os % 100 AS DOUBLE) END AS humidity_pct,
         CASE WHEN os % 13 <> 0 THEN 1000 + CAST(os % 400 AS DOUBLE) / 10 END AS pressure_hpa,
         CASE WHEN os % 13 <> 0 THEN CAST(cs % 40 AS DOUBLE) / 2 END AS wind_speed_kmh,
         os AS ingest_seq
  FROM daily_sums),
c_daily AS (
  SELECT *, CASE WHEN NOT (source = 'lcd' AND precip_mm IS NULL)
                 THEN CASE WHEN precip_mm >= 0.254 THEN 1 ELSE 0 END END AS rain
  FROM daily_raw)"""

LONG = """c_long AS (
  SELECT 'S' || CAST(o_custkey % 5 AS VARCHAR) AS station_id, CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderkey % 3 = 0 THEN 'TMAX' WHEN o_orderkey % 3 = 1 THEN 'TMIN' ELSE 'PRCP' END AS datatype,
         CAST(floor(o_totalprice / 100) AS DOUBLE) / 100 AS value,
         o_orderkey AS ingest_seq
  FROM orders)"""

FIXES = """c_fixes AS (
  SELECT 'AL' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS storm_id,
         'STORM' || CAST(user_id % 26 AS VARCHAR) AS name,
         make_timestamp(CAST(epoch_us(ts) - (user_id % 8) * 31536000000000 AS BIGINT)) AS timestamp,
         10 + value / 20 AS lat,
         -80 + k * CAST(0.4 AS DOUBLE) AS lon,
         CAST(20 + k AS DOUBLE) AS max_wind_kt,
         CASE WHEN k % 11 <> 0 THEN CAST(1010 - k AS DOUBLE) END AS min_pressure_mb,
         CASE WHEN k > 44 THEN 'HU' ELSE 'TS' END AS status,
         event_id AS ingest_seq
  FROM events_k)"""

CELLS = """c_cells AS (
  SELECT 'R' || CAST(label AS VARCHAR) AS station,
         make_timestamp(CAST(1704067200000000 + vec_id * 300000000 AS BIGINT)) AS timestamp,
         CAST(4 AS DOUBLE) AS grid_km,
         36 + label * CAST(0.5 AS DOUBLE) AS latitude,
         CAST(-87 + label AS DOUBLE) AS longitude,
         8 AS n,
         CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col,
         CASE WHEN CAST(v AS DOUBLE) >= -0.2 THEN CAST(20 + CAST(v AS DOUBLE) * 100 AS FLOAT) END AS dbz
  FROM (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings))"""

FRAMES = """c_frames AS (
  SELECT 'R' || CAST(label AS VARCHAR) AS station,
         make_timestamp(CAST(1704067200000000 + vec_id * 300000000 AS BIGINT)) AS timestamp,
         CAST(4 AS DOUBLE) AS grid_km,
         36 + label * CAST(0.5 AS DOUBLE) AS latitude,
         CAST(-87 + label AS DOUBLE) AS longitude,
         8 AS n
  FROM embeddings)"""

POINTS = """c_points AS (
  SELECT s_suppkey AS point_id, 'R' || CAST(s_suppkey % 10 AS VARCHAR) AS station,
         36 + (s_suppkey % 10) * CAST(0.5 AS DOUBLE) + CAST((s_suppkey * 7) % 97 - 48 AS DOUBLE) / 1000 AS point_lat,
         CAST(-87 AS DOUBLE) + (s_suppkey % 10) + CAST((s_suppkey * 13) % 89 - 44 AS DOUBLE) / 900 AS point_lon
  FROM supplier)"""

STATIONS = """c_stations AS (
  SELECT 'GHCND:' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS station_id,
         30 + CAST(s_suppkey * 37 % 1000 AS DOUBLE) / 100 AS latitude,
         -90 + CAST(s_suppkey * 53 % 1000 AS DOUBLE) / 100 AS longitude,
         s_acctbal AS datacoverage
  FROM supplier)"""

SCANS = """c_scans AS (
  SELECT event_id,
         CASE user_id % 4 WHEN 0 THEN 'KOHX' WHEN 1 THEN 'KHPX' WHEN 2 THEN 'KNQA' ELSE 'KMRX' END AS site,
         date_trunc('second', ts) AS seen_at,
         CASE WHEN k % 10 = 0 THEN '_V06_MDM' WHEN k % 23 = 1 THEN '-bad' ELSE '_V06' END AS tail
  FROM events_k),
scan_names AS (
  SELECT *, site || strftime(seen_at, '%Y%m%d_%H%M%S') || tail AS file_name
  FROM c_scans WHERE tail <> '_V06_MDM'),
scans AS (SELECT * FROM scan_names WHERE tail = '_V06')"""

PARTS = {
    "obs": [EVENTS, OBS],
    "daily": [DAILY],
    "long": [LONG],
    "fixes": [EVENTS, FIXES],
    "cells": [CELLS],
    "frames": [FRAMES],
    "points": [POINTS],
    "stations": [STATIONS],
    "scans": [EVENTS, SCANS],
    "events": [EVENTS],
}


def with_ctes(needs: str, *steps: str) -> str:
    """``WITH`` the carriers named in ``needs``, then the steps; the last step is the SELECT."""
    parts: list[str] = []
    for need in needs.split():
        for part in PARTS[need]:
            if part not in parts:
                parts.append(part)
    parts.extend(s for s in steps[:-1] if s)
    return "WITH " + ",\n".join(parts) + "\n" + steps[-1]


def r6(expr: str) -> str:
    """Six digits, without a negative zero."""
    return f"round({expr}, 6) + 0.0"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def micros(expr: str) -> str:
    return f"CAST(epoch_us({expr}) AS BIGINT)"


def unit(expr: str, low: str = "-1.0") -> str:
    """Clamp to [low, 1] that keeps NULL NULL."""
    return f"(CASE WHEN ({expr}) IS NOT NULL THEN greatest({low}, least(1.0, {expr})) END)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    root = (
        f"sqrt(power(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    )
    return f"(12742.0 * asin({unit(root)}))"


def wrap360(expr: str) -> str:
    """Positive remainder by 360."""
    return f"((({expr}) % 360.0 + 360.0) % 360.0)"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dlon = f"radians(({lon2}) - ({lon1}))"
    x = f"sin({dlon}) * cos(radians({lat2}))"
    y = (
        f"cos(radians({lat1})) * sin(radians({lat2}))"
        f" - sin(radians({lat1})) * cos(radians({lat2})) * cos({dlon})"
    )
    return wrap360(f"degrees(atan2({x}, {y})) + 360.0")


def dest_lat(lat: str, brg: str, km: str) -> str:
    arc = f"(({km}) / 6371.0)"
    sine = (
        f"sin(radians({lat})) * cos({arc})"
        f" + cos(radians({lat})) * sin({arc}) * cos(radians({brg}))"
    )
    return f"degrees(asin({unit(sine)}))"


def dest_lon(lat: str, lon: str, brg: str, km: str) -> str:
    arc = f"(({km}) / 6371.0)"
    end = f"sin(radians({dest_lat(lat, brg, km)}))"
    return (
        "("
        + wrap360(
            f"({lon}) + degrees(atan2(sin(radians({brg})) * sin({arc}) * cos(radians({lat})),"
            f" cos({arc}) - sin(radians({lat})) * {end})) + 540.0"
        )
        + " - 180.0)"
    )
