"""Feeds, CSV, best-track text, scan listings, table reads (S*, P*, K2, K4, F13, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.carrier_sql import day, micros, r6, with_ctes
from catalog.carriers import as_stored, c_daily, c_long, c_obs, c_scans, c_stations, events, load
from catalog.registry import present, query
from skyloom.functions.scalar import date_chunks, rain_flag
from skyloom.operators import daily as D, tracks as K
from skyloom.operators.merge import last_per_key
from skyloom.sources import best_track, climate_csv, feeds, scans
from skyloom.sources.tables import evolve


def _iso(ts):
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


# --- S1 -----------------------------------------------------------------------------


def observation_docs(spark, sf_dir):
    """One feed document per report; odd minutes carry a -05:00 offset, some feeds are empty."""
    obs = c_obs(spark, sf_dir)
    local = F.concat(
        F.date_format(F.col("timestamp") - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("-05:00"),
    )
    stamp = F.when(F.minute("timestamp") % 2 == 1, local).otherwise(_iso("timestamp"))

    def measure(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value")))

    properties = F.struct(
        F.col("station_id").alias("stationId"),
        stamp.alias("timestamp"),
        F.col("text_description").alias("textDescription"),
        measure("temperature_c").alias("temperature"),
        measure("precip_last_hour_mm").alias("precipitationLastHour"),
        F.struct(F.col("relative_humidity_pct").alias("value")).alias("relativeHumidity"),
        F.struct(F.col("barometric_pressure_pa").alias("value")).alias("barometricPressure"),
        F.struct(F.col("wind_speed_kmh").alias("value")).alias("windSpeed"),
    )
    features = F.array(F.struct(properties.alias("properties")))
    full = obs.select("ingest_seq", F.to_json(F.struct(features.alias("features"))).alias("doc"))
    # beside the reports come documents without any
    empty = obs.filter(F.col("ingest_seq") % 9 == 0).select("ingest_seq", F.lit('{"features":[]}').alias("doc"))
    return full.unionByName(empty)


@query(
    "q_obs_flatten",
    with_ctes(
        "obs",
        f"""SELECT ingest_seq, station_id, {micros('timestamp')} AS timestamp, text_description,
  {r6('temperature_c')} AS temperature_c, CAST(NULL AS DOUBLE) AS dewpoint_c,
  {r6('wind_speed_kmh')} AS wind_speed_kmh, {r6('barometric_pressure_pa')} AS barometric_pressure_pa,
  {r6('precip_last_hour_mm')} AS precip_last_hour_mm, {r6('relative_humidity_pct')} AS relative_humidity_pct
FROM c_obs""",
    ),
)
def q_obs_flatten(spark, sf_dir):
    rows = feeds.parse_observations(observation_docs(spark, sf_dir), keep=["ingest_seq"])
    return present(
        rows.select(
            "ingest_seq",
            "station_id",
            "timestamp",
            "text_description",
            "temperature_c",
            "dewpoint_c",
            "wind_speed_kmh",
            "barometric_pressure_pa",
            "precip_last_hour_mm",
            "relative_humidity_pct",
        )
    )


# --- S2 -----------------------------------------------------------------------------


@query(
    "q_alert_flatten",
    with_ctes(
        "events",
        """SELECT event_id, CAST(p AS BIGINT) AS feed_pos,
  'A' || CAST(event_id AS VARCHAR) || '-' || CAST(p AS VARCHAR) AS id, event_type AS event,
  CASE WHEN k % 3 = 0 THEN 'Severe' WHEN k % 3 = 1 THEN 'Moderate' ELSE 'Minor' END AS severity,
  CASE WHEN k % 7 <> 0 THEN event_type || ' at ' || CAST(user_id AS VARCHAR) END AS headline,
  'Area ' || CAST(k AS VARCHAR) AS area_desc,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS effective, CAST(NULL AS VARCHAR) AS expires
FROM (SELECT *, unnest(range(0, CAST(k % 3 AS BIGINT))) AS p FROM events_k)""",
    ),
)
def q_alert_flatten(spark, sf_dir):
    k = F.col("k")
    alert = lambda p: F.struct(
        F.struct(
            F.concat(F.lit("A"), F.col("event_id"), F.lit("-"), p).alias("id"),
            F.col("event_type").alias("event"),
            F.when(k % 3 == 0, "Severe").when(k % 3 == 1, "Moderate").otherwise("Minor").alias("severity"),
            F.when(k % 7 != 0, F.concat("event_type", F.lit(" at "), "user_id")).alias("headline"),
            F.concat(F.lit("Area "), k).alias("areaDesc"),
            _iso("ts").alias("effective"),
        ).alias("properties")
    )
    features = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), k % 3), alert)
    docs = events(spark, sf_dir).select(
        "event_id", F.to_json(F.struct(features.alias("features"))).alias("doc")
    )
    return present(feeds.parse_alerts(docs, keep=["event_id"]))


# --- S3, J13 ------------------------------------------------------------------------


def _period_docs(rows, key, first_day, shift):
    """Forecast documents of six half-day periods from ``first_day`` on."""

    def period(i):
        return F.struct(
            F.concat(F.lit("P"), i).alias("name"),
            ((i + shift) % 2 == 0).alias("isDaytime"),
            F.concat(
                F.date_format(F.date_add(first_day, F.floor(i / 2).cast("int")), "yyyy-MM-dd"),
                F.lit("T06:00:00-05:00"),
            ).alias("startTime"),
            F.concat(F.lit("outlook "), (i + shift).cast("string")).alias("detailedForecast"),
        )

    periods = F.transform(F.sequence(F.lit(0), F.lit(5)), period)
    doc = F.to_json(F.struct(F.struct(periods.alias("periods")).alias("properties")))
    return rows.select(*key, doc.alias("doc"))


@query(
    "q_daytime_topn",
    with_ctes(
        "events",
        """SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS BIGINT) AS period_pos,
  strftime(CAST(ts AS DATE) + CAST(i // 2 AS INTEGER), '%Y-%m-%d') AS period_date,
  'P' || CAST(i AS VARCHAR) || ': outlook ' || CAST(i + k AS VARCHAR) AS official_forecast
FROM (SELECT *, unnest(range(0, 6)) AS i FROM events_k)
WHERE (i + k) % 2 = 0
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY i) <= 2""",
    ),
)
def q_daytime_topn(spark, sf_dir):
    docs = _period_docs(events(spark, sf_dir), ["event_id"], F.to_date("ts"), F.col("k"))
    return present(feeds.parse_daytime_periods(docs, 2, keep=["event_id"]))


@query(
    "q_official_compare",
    with_ctes(
        "daily",
        f"""preds AS (SELECT station_id, date, h, date + CAST(h AS INTEGER) AS target_date, temp_max_c
  FROM (SELECT *, unnest([1, 2, 3]) AS h FROM c_daily))""",
        f"""SELECT station_id, {day('date')} AS predicted_date, CAST(h AS BIGINT) AS horizon_days,
  {day('target_date')} AS target_date, {r6('temp_max_c')} AS temp_max_pred_c,
  CASE WHEN h <= 2 THEN 'P' || CAST(2 * h AS VARCHAR) || ': outlook ' || CAST(2 * h AS VARCHAR) END AS official_forecast
FROM preds""",
    ),
)
def q_official_compare(spark, sf_dir):
    rows = c_daily(spark, sf_dir)
    docs = _period_docs(rows, ["station_id", "date"], F.col("date"), F.lit(0))
    official = feeds.parse_daytime_periods(docs, 3, keep=["station_id", "date"]).select(
        "station_id",
        F.col("date").alias("predicted_date"),
        F.col("period_date").alias("target_date"),
        "official_forecast",
    )
    own = D.persistence_days(rows, F.lit("v")).select(
        "station_id", "predicted_date", "horizon_days", "target_date", "temp_max_pred_c"
    )
    return present(own.join(official, ["station_id", "predicted_date", "target_date"], "left"))


# --- S7, P11, P12 -------------------------------------------------------------------


def storm_docs(spark, sf_dir):
    k, value = F.col("k"), F.col("value")
    storm = F.struct(
        F.concat(F.lit("al"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("id"),
        F.concat(F.lit("Storm "), k).alias("name"),
        F.when(k > 44, "HU").otherwise("TS").alias("classification"),
        F.when(k % 13 != 0, 10 + value / 20).alias("latitude_numeric"),
        (-80 + k * 0.4).alias("longitude_numeric"),
        F.when(k % 5 != 0, k).alias("intensity"),
        F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, 0).otherwise(1000 - k).alias("pressure"),
        ((k * 3) % 360).alias("movementDir"),
        F.when(k % 19 != 0, k % 30).alias("movementSpeed"),
        F.when(k % 17 == 0, "").otherwise(_iso("ts")).alias("lastUpdate"),
    )
    rows = events(spark, sf_dir)
    full = rows.select("event_id", F.to_json(F.struct(F.array(storm).alias("activeStorms"))).alias("doc"))
    # beside the storms come documents without any
    empty = rows.filter("event_type = 'error'").select("event_id", F.lit('{"activeStorms":[]}').alias("doc"))
    return full.unionByName(empty)


_STORMS = f"""storms AS (
  SELECT event_id, 'al' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS id, 'Storm ' || CAST(k AS VARCHAR) AS name,
    CASE WHEN k > 44 THEN 'HU' ELSE 'TS' END AS classification,
    CASE WHEN k % 13 <> 0 THEN 10 + value / 20 END AS lat, -80 + k * CAST(0.4 AS DOUBLE) AS lon,
    CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS intensity_kt,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1000 - k AS DOUBLE) END AS pressure_mb,
    CAST((k * 3) % 360 AS DOUBLE) AS movement_dir_deg,
    CASE WHEN k % 19 <> 0 THEN CAST(k % 30 AS DOUBLE) END AS movement_speed_mph,
    CASE WHEN k % 17 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS last_update,
    date_trunc('second', ts) AS seen_at
  FROM events_k)"""


@query(
    "q_active_storms",
    with_ctes(
        "events",
        _STORMS,
        f"""SELECT event_id, id, name, classification, {r6('lat')} AS lat, {r6('lon')} AS lon,
  {r6('intensity_kt')} AS intensity_kt, {r6('pressure_mb')} AS pressure_mb,
  {r6('movement_dir_deg')} AS movement_dir_deg, {r6('movement_speed_mph')} AS movement_speed_mph, last_update
FROM storms""",
    ),
)
def q_active_storms(spark, sf_dir):
    return present(feeds.parse_active_storms(storm_docs(spark, sf_dir), keep=["event_id"]))


@query(
    "q_live_features",
    with_ctes(
        "events",
        _STORMS,
        f"""SELECT upper(id) AS storm_id, name, classification, {micros('seen_at')} AS timestamp,
  {r6('lat')} AS lat, {r6('lon')} AS lon, {r6('coalesce(intensity_kt, 0)')} AS max_wind_kt,
  {r6('coalesce(nullif(pressure_mb, 0), 1010)')} AS min_pressure_mb,
  {r6('sin(radians(movement_dir_deg))')} AS motion_bearing_sin,
  {r6('cos(radians(movement_dir_deg))')} AS motion_bearing_cos,
  {r6('coalesce(movement_speed_mph, 0) * CAST(1.60934 AS DOUBLE)')} AS motion_speed_kmh,
  CAST(0 AS DOUBLE) AS storm_age_hours,
  {r6('sin(2 * pi() * dayofyear(seen_at) / CAST(365.25 AS DOUBLE))')} AS doy_sin,
  {r6('cos(2 * pi() * dayofyear(seen_at) / CAST(365.25 AS DOUBLE))')} AS doy_cos
FROM storms WHERE lat IS NOT NULL AND last_update <> ''""",
    ),
)
def q_live_features(spark, sf_dir):
    rows, _ = K.live_features(feeds.parse_active_storms(storm_docs(spark, sf_dir)))
    return present(rows)


@query(
    "q_live_rejects",
    with_ctes(
        "events",
        _STORMS,
        "SELECT event_id, id FROM storms WHERE lat IS NULL OR last_update = ''",
    ),
)
def q_live_rejects(spark, sf_dir):
    storms = feeds.parse_active_storms(storm_docs(spark, sf_dir), keep=["event_id"])
    return present(K.live_features(storms)[1].select("event_id", "id"))


# --- S5, P1, P4, P5, P7, P6 -------------------------------------------------------------


def climate_lines(spark, sf_dir):
    key = F.col("o_orderkey")
    two = F.lpad((key % 100).cast("string"), 2, "0")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("S"), F.col("o_custkey") % 5).alias("STATION"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'23:59:00").alias("DATE"),
        F.when(key % 2 == 0, "SOD  ").otherwise("FM-15").alias("REPORT_TYPE"),
        F.when(key % 7 == 0, "T")
        .when(key % 7 == 1, F.concat((key % 100).cast("string"), F.lit("s")))
        .when(key % 7 == 2, "5d")
        .when(key % 7 == 3, " ")
        .otherwise((key % 100).cast("string"))
        .alias("DailyAverageRelativeHumidity"),
        F.when(key % 5 == 0, "0.00")
        .when(key % 5 == 1, "")
        .otherwise(F.concat(F.lit("30."), two))
        .alias("DailyAverageSeaLevelPressure"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("29."), two, F.lit("s"))).alias(
            "DailyAverageStationPressure"
        ),
        F.concat((key % 40).cast("string"), F.lit(".5*")).alias("DailyAverageWindSpeed"),
    )


_CLIMATE = f"""SELECT o_orderkey, 'S' || CAST(o_custkey % 5 AS VARCHAR) AS station_id, {day('o_orderdate')} AS date,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 7 IN (2, 3) THEN NULL
       ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS humidity_pct,
  {r6('''(CASE WHEN o_orderkey % 5 IN (0, 1)
        THEN CASE WHEN o_orderkey % 11 <> 0 THEN CAST('29.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) END
        ELSE CAST('30.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) END) * CAST(33.8639 AS DOUBLE)''')} AS pressure_hpa,
  {r6('(CAST(o_orderkey % 40 AS DOUBLE) + 0.5) * CAST(1.60934 AS DOUBLE)')} AS wind_speed_kmh
FROM orders WHERE o_orderkey % 2 = 0"""


@query(
    "q_lcd_daily",
    _CLIMATE + " AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
)
def q_lcd_daily(spark, sf_dir):
    rows = climate_csv.parse_climate_days(climate_lines(spark, sf_dir), keep=["o_orderkey"])
    start, end = (F.lit(d).cast("date") for d in ("1996-01-01", "1999-12-31"))
    return present(climate_csv.between_dates(rows, start, end))


@query(
    "q_rain_flag",
    with_ctes(
        "daily",
        f"""SELECT station_id, {day('date')} AS date, {r6('precip_mm')} AS precip_mm,
  CAST(CASE WHEN precip_mm >= 0.254 THEN 1 ELSE 0 END AS BIGINT) AS rain_flag FROM c_daily""",
    ),
)
def q_rain_flag(spark, sf_dir):
    return present(
        c_daily(spark, sf_dir).select(
            "station_id", "date", "precip_mm", rain_flag(F.col("precip_mm")).alias("rain_flag")
        )
    )


# --- S6, P2, P3, F14, W11 -----------------------------------------------------------------


def _track_text(spark, sf_dir):
    """Header and data line of a fix as best-track text."""
    k, user = F.col("k"), F.col("user_id")
    number = F.lpad((user % 10000).cast("string"), 4, "0")
    header = F.concat(
        F.lit("AL"), number, F.lit("2024,            NAME"), (user % 26).cast("string"), F.lit(",   1,")
    )
    data = F.concat_ws(
        ", ",
        F.date_format("ts", "yyyyMMdd"),
        F.date_format("ts", "HHmm"),
        F.lit(" "),
        F.when(k > 44, "HU").otherwise("TS"),
        F.concat((10 + k % 50).cast("string"), F.lit("."), (user % 10).cast("string"), F.when(k % 2 == 0, "N").otherwise("S")),
        F.concat((20 + k).cast("string"), F.lit("."), (user % 10).cast("string"), F.when(k % 3 == 0, "E").otherwise("W")),
        F.when(k % 20 == 0, "-999").when(k % 21 == 0, "   ").otherwise((20 + k).cast("string")),
        F.when(k % 11 == 0, "-999").otherwise((1010 - k).cast("string")),
    )
    return events(spark, sf_dir).select("event_id", "user_id", header.alias("header"), as_stored(data).alias("data"))


_TRACK = f"""SELECT event_id, 'AL' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') || '2024' AS storm_id,
  'NAME' || CAST(user_id % 26 AS VARCHAR) AS name, {micros("date_trunc('minute', ts)")} AS timestamp,
  {r6("CAST(CAST(10 + k % 50 AS VARCHAR) || '.' || CAST(user_id % 10 AS VARCHAR) AS DOUBLE) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END")} AS lat,
  {r6("CAST(CAST(20 + k AS VARCHAR) || '.' || CAST(user_id % 10 AS VARCHAR) AS DOUBLE) * CASE WHEN k % 3 = 0 THEN 1 ELSE -1 END")} AS lon,
  CASE WHEN k % 20 = 0 OR k % 21 = 0 THEN NULL ELSE CAST(20 + k AS DOUBLE) END AS max_wind_kt,
  CASE WHEN k % 11 <> 0 THEN CAST(1010 - k AS DOUBLE) END AS min_pressure_mb,
  CASE WHEN k > 44 THEN 'HU' ELSE 'TS' END AS status
FROM events_k"""


@query("q_track_parse", with_ctes("events", _TRACK))
def q_track_parse(spark, sf_dir):
    blocks = _track_text(spark, sf_dir).select(
        "event_id", F.concat_ws("\n", "header", "data", F.lit("  "), F.lit("")).alias("block")
    )
    return present(best_track.parse_blocks(blocks, keep=["event_id"]))


@query("q_header_ffill", with_ctes("events", _TRACK))
def q_header_ffill(spark, sf_dir):
    text = _track_text(spark, sf_dir)
    base = F.col("user_id") * 1_000_000_000
    file = F.concat(F.lit("F"), F.col("user_id") % 4)
    heads = text.groupBy("user_id").agg(F.first("header").alias("line")).select(
        file.alias("file"), base.alias("pos"), "line", F.lit(None).cast("long").alias("event_id")
    )
    rows = text.select(
        file.alias("file"), (base + 1 + F.col("event_id")).alias("pos"), F.col("data").alias("line"), "event_id"
    )
    lines = heads.unionByName(rows)
    return present(best_track.parse_lines(lines, slice_lines=4000, keep=["event_id"]))


# --- S8, S9, P8, J11, K2 ---------------------------------------------------------------------


def _scans(spark, sf_dir, part=0):
    names = scans.scan_names(c_scans(spark, sf_dir), keep=["event_id"])
    return scans.parse_scans(names)[part]


_SCAN_COLS = f"""event_id, file_name, site AS station, {micros('seen_at')} AS timestamp, {day('seen_at')} AS scan_date,
  strftime(seen_at, '%Y/%m/%d') || '/' || site || '/' || file_name AS "key\""""


@query("q_scan_catalog", with_ctes("scans", f"SELECT {_SCAN_COLS} FROM scans"))
def q_scan_catalog(spark, sf_dir):
    return present(_scans(spark, sf_dir))


@query(
    "q_scan_rejects",
    with_ctes("scans", "SELECT event_id, file_name FROM scan_names WHERE tail = '-bad'"),
)
def q_scan_rejects(spark, sf_dir):
    return present(_scans(spark, sf_dir, 1))


@query(
    "q_scan_range",
    with_ctes(
        "scans",
        f"""SELECT {_SCAN_COLS} FROM scans
WHERE seen_at BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'""",
    ),
)
def q_scan_range(spark, sf_dir):
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-05 06:00:00", "2024-01-12 18:30:00"))
    return present(scans.scans_between(_scans(spark, sf_dir), start, end))


@query(
    "q_scan_new",
    with_ctes(
        "scans",
        f"""SELECT {_SCAN_COLS} FROM scans
WHERE file_name NOT IN (SELECT file_name FROM scans WHERE seen_at < TIMESTAMP '2024-01-20 00:00:00')""",
    ),
)
def q_scan_new(spark, sf_dir):
    all_scans = _scans(spark, sf_dir)
    collected = all_scans.filter(F.col("timestamp") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return present(scans.new_scans(all_scans, collected))


@query(
    "q_latest_scan",
    with_ctes(
        "scans",
        f"""SELECT site AS station, {micros('max(seen_at)')} AS timestamp, arg_max(file_name, seen_at) AS file_name FROM scans
WHERE CAST(seen_at AS DATE) BETWEEN DATE '2024-01-19' AND DATE '2024-01-20' GROUP BY site""",
    ),
)
def q_latest_scan(spark, sf_dir):
    newest = scans.latest_scan(_scans(spark, sf_dir), F.lit("2024-01-20").cast("date"))
    return present(newest.select("station", "timestamp", "file_name"))


# --- S15, K4, F13, U2, S14 --------------------------------------------------------------------


@query(
    "q_station_bbox",
    with_ctes(
        "stations",
        f"""SELECT station_id, {r6('latitude')} AS latitude, {r6('longitude')} AS longitude,
  {r6('datacoverage')} AS datacoverage FROM c_stations
WHERE latitude BETWEEN 32 AND 38 AND longitude BETWEEN -88 AND -82
ORDER BY datacoverage DESC, c_stations.station_id LIMIT 25""",
    ),
)
def q_station_bbox(spark, sf_dir):
    return present(feeds.stations_in_box(c_stations(spark, sf_dir), 35.0, -85.0, 3.0))


@query(
    "q_date_chunks",
    with_ctes(
        "daily",
        "spans AS (SELECT station_id, min(date) AS lo, max(date) AS hi FROM c_daily GROUP BY station_id)",
        """starts AS (SELECT station_id, hi, unnest(range(CAST(0 AS BIGINT), CAST(hi - lo AS BIGINT) + 1, CAST(365 AS BIGINT))) AS off, lo FROM spans)""",
        f"""SELECT station_id, {day('lo + CAST(off AS INTEGER)')} AS chunk_start,
  {day('least(hi, lo + CAST(off AS INTEGER) + 364)')} AS chunk_end FROM starts""",
    ),
)
def q_date_chunks(spark, sf_dir):
    spans = c_daily(spark, sf_dir).groupBy("station_id").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    chunks = spans.select(
        "station_id", F.inline(date_chunks(F.col("lo"), F.col("hi")))
    )
    return present(chunks)


_LIVE_SQL = """live AS (
  SELECT station_id, CAST((timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS date,
    max(temperature_c) AS temp_max_c, min(temperature_c) AS temp_min_c,
    sum(coalesce(precip_last_hour_mm, 0)) AS precip_mm, avg(relative_humidity_pct) AS humidity_pct,
    avg(barometric_pressure_pa) / 100 AS pressure_hpa, avg(wind_speed_kmh) AS wind_speed_kmh
  FROM c_obs GROUP BY 1, 2)"""

_PIVOT_SQL = """pivoted AS (
  SELECT station_id, date,
    arg_max(CASE WHEN datatype = 'TMAX' THEN value END, CASE WHEN datatype = 'TMAX' THEN ingest_seq END) AS temp_max_c,
    arg_max(CASE WHEN datatype = 'TMIN' THEN value END, CASE WHEN datatype = 'TMIN' THEN ingest_seq END) AS temp_min_c,
    arg_max(CASE WHEN datatype = 'PRCP' THEN value END, CASE WHEN datatype = 'PRCP' THEN ingest_seq END) AS precip_mm
  FROM c_long GROUP BY 1, 2)"""

_FLAG = "CAST(CASE WHEN precip_mm >= 0.254 THEN 1 ELSE 0 END AS BIGINT)"


@query(
    "q_live_daily",
    with_ctes(
        "obs",
        _LIVE_SQL,
        f"""SELECT station_id, {day('date')} AS date, 'metar_live' AS source, {r6('temp_max_c')} AS temp_max_c,
  {r6('temp_min_c')} AS temp_min_c, {r6('precip_mm')} AS precip_mm, {_FLAG} AS rain,
  {r6('humidity_pct')} AS humidity_pct, {r6('pressure_hpa')} AS pressure_hpa,
  {r6('wind_speed_kmh')} AS wind_speed_kmh FROM live""",
    ),
)
def q_live_daily(spark, sf_dir):
    return present(D.live_daily(c_obs(spark, sf_dir)))


@query(
    "q_ghcnd_pivot",
    with_ctes(
        "long",
        _PIVOT_SQL,
        f"""SELECT station_id, {day('date')} AS date, 'ghcnd' AS source, {r6('temp_max_c')} AS temp_max_c,
  {r6('temp_min_c')} AS temp_min_c, {r6('precip_mm')} AS precip_mm, {_FLAG} AS rain FROM pivoted""",
    ),
)
def q_ghcnd_pivot(spark, sf_dir):
    record = F.struct(
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00")).alias("date"),
        "datatype",
        F.col("station_id").alias("station"),
        "value",
    )
    docs = c_long(spark, sf_dir).select(
        "ingest_seq", F.to_json(F.struct(F.array(record).alias("results"))).alias("doc")
    )
    return present(D.pivot_summaries(feeds.parse_summaries(docs, keep=["ingest_seq"])))


@query(
    "q_source_union",
    with_ctes(
        "obs long",
        _LIVE_SQL,
        _PIVOT_SQL,
        f"""SELECT station_id, {day('date')} AS date, 'metar_live' AS source, {r6('temp_max_c')} AS temp_max_c,
  {r6('temp_min_c')} AS temp_min_c, {r6('precip_mm')} AS precip_mm, {_FLAG} AS rain,
  {r6('humidity_pct')} AS humidity_pct FROM live
UNION ALL
SELECT station_id, {day('date')}, 'ghcnd', {r6('temp_max_c')}, {r6('temp_min_c')}, {r6('precip_mm')}, {_FLAG},
  CAST(NULL AS DOUBLE) FROM pivoted""",
    ),
)
def q_source_union(spark, sf_dir):
    live = D.live_daily(c_obs(spark, sf_dir))
    summaries = D.pivot_summaries(c_long(spark, sf_dir))
    both = live.unionByName(summaries, allowMissingColumns=True)
    return present(both.drop("pressure_hpa", "wind_speed_kmh"))


@query(
    "q_schema_evolve",
    with_ctes(
        "daily",
        f"""SELECT station_id, {day('date')} AS date, source, {r6('temp_max_c')} AS temp_max_c,
  {r6('temp_min_c')} AS temp_min_c, {r6('precip_mm')} AS precip_mm, CAST(rain AS BIGINT) AS rain,
  CASE WHEN year(date) >= 1998 THEN {r6('humidity_pct')} END AS humidity_pct,
  CASE WHEN year(date) >= 1998 THEN {r6('pressure_hpa')} END AS pressure_hpa,
  CASE WHEN year(date) >= 1998 THEN {r6('wind_speed_kmh')} END AS wind_speed_kmh FROM c_daily""",
    ),
)
def q_schema_evolve(spark, sf_dir):
    rows = c_daily(spark, sf_dir).drop("ingest_seq")
    recent = F.year("date") >= 1998
    older = rows.filter(~recent).drop("humidity_pct", "pressure_hpa", "wind_speed_kmh")
    table = evolve(older, "daily_observations").unionByName(
        evolve(rows.filter(recent), "daily_observations")
    )
    return present(table)


# --- P16, K5, A3, A4 ----------------------------------------------------------------------------

_OBS_UNIQUE = """unique_obs AS (
  SELECT * FROM c_obs QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY ingest_seq DESC) = 1)"""


@query(
    "q_obs_range",
    with_ctes(
        "obs",
        _OBS_UNIQUE,
        f"""SELECT station_id, {micros('timestamp')} AS timestamp, {r6('temperature_c')} AS temperature_c,
  CAST(row_number() OVER (PARTITION BY station_id ORDER BY timestamp DESC) AS BIGINT) AS rank FROM unique_obs
WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-22 00:00:00'
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY unique_obs.timestamp DESC) <= 500""",
    ),
)
def q_obs_range(spark, sf_dir):
    obs = last_per_key(c_obs(spark, sf_dir), ["station_id", "timestamp"], "ingest_seq")
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-05", "2024-01-22"))
    newest = D.newest_reports(obs, start, end, 500)
    return present(newest.select("station_id", "timestamp", "temperature_c", "rank"))


@query(
    "q_latest_obs",
    with_ctes(
        "obs",
        _OBS_UNIQUE,
        f"""SELECT station_id, {micros('timestamp')} AS timestamp, {r6('temperature_c')} AS temperature_c,
  {r6('relative_humidity_pct')} AS relative_humidity_pct FROM unique_obs
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY unique_obs.timestamp DESC) = 1""",
    ),
)
def q_latest_obs(spark, sf_dir):
    obs = last_per_key(c_obs(spark, sf_dir), ["station_id", "timestamp"], "ingest_seq")
    newest = D.latest_per_entity(obs, "station_id", "timestamp")
    return present(newest.select("station_id", "timestamp", "temperature_c", "relative_humidity_pct"))


@query(
    "q_status",
    with_ctes(
        "daily",
        f"""SELECT station_id, source, CAST(count(*) AS BIGINT) AS n_source,
  CAST(sum(count(*)) OVER (PARTITION BY station_id) AS BIGINT) AS n_days,
  {day('min(min(date)) OVER (PARTITION BY station_id)')} AS first_date,
  {day('max(max(date)) OVER (PARTITION BY station_id)')} AS last_date,
  CAST(sum(count(pressure_hpa)) OVER (PARTITION BY station_id) AS BIGINT) AS n_enriched,
  CAST(greatest(0, 14 - sum(count(*)) OVER (PARTITION BY station_id)) AS BIGINT) AS days_missing
FROM c_daily GROUP BY station_id, source""",
    ),
)
def q_status(spark, sf_dir):
    return present(D.history_status(c_daily(spark, sf_dir)))
