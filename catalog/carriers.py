"""Weather-shaped views over the given tables (test input for the operators).

Each function has a twin CTE of the same name in ``carrier_sql``.  Values keep at
most two decimals, so means never fall on a rounding border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.functions.scalar import rain_flag
from skyloom.session import configure

DAY = "yyyy-MM-dd"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_stored(text):
    """A built text as if it were a stored column: filters on it are not pushed into its making."""
    return F.explode(F.array(text))


def events(spark, sf_dir) -> DataFrame:
    """Events with integer ``k`` and a UTC timestamp."""
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def c_obs(spark, sf_dir) -> DataFrame:
    """Station reports to the minute, so some (station, time) repeat."""
    k = F.col("k")
    return events(spark, sf_dir).select(
        F.concat(F.lit("ST"), (F.col("user_id") % 10).cast("string")).alias("station_id"),
        F.date_trunc("minute", "ts").alias("timestamp"),
        F.col("event_type").alias("text_description"),
        F.when(k % 17 != 0, F.col("value") / 10 - 10).alias("temperature_c"),
        F.when(F.col("event_type").isin("view", "click"), k / 50.0).alias("precip_last_hour_mm"),
        k.cast("double").alias("relative_humidity_pct"),
        (101325.0 + (k - 50) * 20).alias("barometric_pressure_pa"),
        (F.floor("value") % 40).cast("double").alias("wind_speed_kmh"),
        F.col("event_id").alias("ingest_seq"),
    )


def c_daily(spark, sf_dir) -> DataFrame:
    """One row per station and order date, with gaps, unknown values and three sources."""
    orders = load(spark, sf_dir, "orders")
    sums = orders.groupBy(
        F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("station_id"),
        F.to_date("o_orderdate").alias("date"),
    ).agg(
        F.max("o_totalprice").alias("hi"),
        F.min("o_totalprice").alias("lo"),
        F.sum("o_custkey").alias("cs"),
        F.sum("o_orderkey").alias("os"),
    )
    known = F.col("os") % 13 != 0
    rows = sums.select(
        "station_id",
        "date",
        F.when(F.col("os") % 3 == 0, "ghcnd")
        .when(F.col("os") % 3 == 1, "metar_live")
        .otherwise("lcd")
        .alias("source"),
        (F.floor(F.col("hi") / 100) / 100.0).alias("temp_max_c"),
        (F.floor(F.col("lo") / 100) / 100.0 - 5).alias("temp_min_c"),
        F.when(F.col("cs") % 11 == 0, F.lit(None))
        .when(F.col("cs") % 3 == 0, (F.col("cs") % 50) / 10.0)
        .otherwise(0.0)
        .alias("precip_mm"),
        F.when(known, (F.col("os") % 100).cast("double")).alias("humidity_pct"),
        F.when(known, 1000 + (F.col("os") % 400) / 10.0).alias("pressure_hpa"),
        F.when(known, (F.col("cs") % 40) / 2.0).alias("wind_speed_kmh"),
        F.col("os").alias("ingest_seq"),
    )
    bare = (F.col("source") == "lcd") & F.col("precip_mm").isNull()
    return rows.withColumn("rain", F.when(~bare, rain_flag(F.col("precip_mm"))))


def c_long(spark, sf_dir) -> DataFrame:
    """Long summaries (station, date, datatype, value); many keys repeat."""
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("station_id"),
        F.to_date("o_orderdate").alias("date"),
        F.when(key % 3 == 0, "TMAX").when(key % 3 == 1, "TMIN").otherwise("PRCP").alias("datatype"),
        (F.floor(F.col("o_totalprice") / 100) / 100.0).alias("value"),
        key.alias("ingest_seq"),
    )


def c_fixes(spark, sf_dir) -> DataFrame:
    """Storm fixes at irregular times, spread over eight seasons."""
    k = F.col("k")
    back = (F.col("user_id") % 8) * 31_536_000_000_000
    return events(spark, sf_dir).select(
        F.concat(F.lit("AL"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("storm_id"),
        F.concat(F.lit("STORM"), (F.col("user_id") % 26).cast("string")).alias("name"),
        F.timestamp_micros(F.unix_micros("ts") - back).alias("timestamp"),
        (10 + F.col("value") / 20).alias("lat"),
        (-80 + k * 0.4).alias("lon"),
        (20.0 + k).alias("max_wind_kt"),
        F.when(k % 11 != 0, 1010.0 - k).alias("min_pressure_mb"),
        F.when(k > 44, "HU").otherwise("TS").alias("status"),
        F.col("event_id").alias("ingest_seq"),
    )


def c_frames(spark, sf_dir) -> DataFrame:
    """8 x 8 grids of ten radars, five minutes or a multiple of it apart."""
    return load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("R"), F.col("label").cast("string")).alias("station"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("vec_id") * 300_000_000).alias(
            "timestamp"
        ),
        F.lit(4.0).alias("grid_km"),
        F.lit(1.0).alias("resolution_km"),
        (36 + F.col("label") * 0.5).alias("latitude"),
        (-87.0 + F.col("label")).alias("longitude"),
        F.transform(
            "embedding",
            lambda v: F.when(
                v.cast("double") >= -0.2, (20 + v.cast("double") * 100).cast("float")
            ),
        ).alias("reflectivity_dbz"),
    )


def c_points(spark, sf_dir) -> DataFrame:
    """Watch points around the radars, some of them out of range."""
    key = F.col("s_suppkey")
    label = key % 10
    return load(spark, sf_dir, "supplier").select(
        key.alias("point_id"),
        F.concat(F.lit("R"), label.cast("string")).alias("station"),
        (36 + label * 0.5 + ((key * 7) % 97 - 48) / 1000.0).alias("point_lat"),
        (-87.0 + label + ((key * 13) % 89 - 44) / 900.0).alias("point_lon"),
    )


def c_stations(spark, sf_dir) -> DataFrame:
    """Station list with position and data coverage."""
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("GHCND:"), F.lpad(key.cast("string"), 6, "0")).alias("station_id"),
        (30 + (key * 37 % 1000) / 100.0).alias("latitude"),
        (-90 + (key * 53 % 1000) / 100.0).alias("longitude"),
        F.col("s_acctbal").alias("datacoverage"),
    )


def c_scans(spark, sf_dir) -> DataFrame:
    """Listing lines of a scan archive: sidecars and malformed names among them."""
    site = F.element_at(
        F.array(*[F.lit(s) for s in ("KOHX", "KHPX", "KNQA", "KMRX")]),
        (F.col("user_id") % 4 + 1).cast("int"),
    )
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    tail = (
        F.when(F.col("k") % 10 == 0, "_V06_MDM").when(F.col("k") % 23 == 1, "-bad").otherwise("_V06")
    )
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("   1234567 "), site, stamp, tail
    )
    return events(spark, sf_dir).select(as_stored(line).alias("line"), "event_id")
