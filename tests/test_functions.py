import math

import pytest
from pyspark.sql import functions as F

from skyloom.functions import cells, geo, scalar
from skyloom.functions.register import register_functions


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_distance_and_bearing(spark):
    lit = F.lit
    km, east, north = one(
        spark,
        geo.haversine_km(lit(36.1245), lit(-86.6782), lit(33.6407), lit(-84.4277)),
        geo.bearing_deg(lit(0.0), lit(0.0), lit(0.0), lit(1.0)),
        geo.bearing_deg(lit(0.0), lit(0.0), lit(1.0), lit(0.0)),
    )
    assert km == pytest.approx(340, abs=15)
    assert east == pytest.approx(90, abs=0.5)
    assert north == pytest.approx(0, abs=0.5)


def test_antipodes_do_not_leave_the_domain(spark):
    (km,) = one(spark, geo.haversine_km(F.lit(12.3), F.lit(-45.0), F.lit(-12.3), F.lit(135.0)))
    assert km == pytest.approx(math.pi * 6371, rel=1e-9)


def test_destination_round_trip_and_wrap(spark):
    lat, lon = geo.destination(F.lit(25.0), F.lit(-75.0), F.lit(310.0), F.lit(500.0))
    lat2, lon2 = geo.destination(lat, lon, F.lit(310.0) - 180 - 2.2, F.lit(500.0))
    row = one(spark, lat2, lon2)
    assert row[0] == pytest.approx(25.0, abs=0.2)
    assert row[1] == pytest.approx(-75.0, abs=0.2)
    _, wrapped = geo.destination(F.lit(0.0), F.lit(179.9), F.lit(90.0), F.lit(100.0))
    assert -180 <= one(spark, wrapped)[0] < -178


@pytest.mark.parametrize(
    "text, value",
    [("12s", 12.0), ("T", 0.0), ("5d", None), ("", None), ("  ", None), (" 3.5V ", 3.5), ("7s*V", 7.0), ("x", None), ("-1.5e1", -15.0)],
)
def test_flagged_number(spark, text, value):
    assert one(spark, scalar.flagged_number(F.lit(text)))[0] == value


def test_flagged_number_of_null(spark):
    assert one(spark, scalar.flagged_number(F.lit(None).cast("string")))[0] is None


@pytest.mark.parametrize("text, value", [("-999", None), ("", None), ("80", 80.0), ("-999.0", None)])
def test_sentinel_number(spark, text, value):
    assert one(spark, scalar.sentinel_number(F.lit(text)))[0] == value


@pytest.mark.parametrize("text, value", [("94.8W", -94.8), ("28.0N", 28.0), ("5.5S", -5.5), ("10.0E", 10.0)])
def test_hemisphere(spark, text, value):
    assert one(spark, scalar.hemisphere_degrees(F.lit(text)))[0] == value


def test_first_truthy_skips_zero(spark):
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    row = one(spark, scalar.first_truthy(zero, F.lit(29.3)), scalar.first_truthy(none, none), scalar.first_truthy(F.lit(30.0), F.lit(29.0)), scalar.first_truthy(none, zero))
    assert tuple(row) == (29.3, None, 30.0, 0.0)


def test_rain_flag(spark):
    row = one(spark, *[scalar.rain_flag(F.lit(v).cast("double")) for v in (0.254, 0.253, None)])
    assert tuple(row) == (1, 0, 0)


def test_local_date_across_daylight_saving(spark):
    times = ["2026-07-01 04:30:00", "2026-07-01 05:00:00", "2026-01-01 05:30:00", "2026-01-01 06:00:00"]
    row = one(spark, *[scalar.local_date(F.lit(t).cast("timestamp"), "America/Chicago").cast("string") for t in times])
    assert tuple(row) == ("2026-06-30", "2026-07-01", "2025-12-31", "2026-01-01")


def test_date_chunks_cover_the_range_without_overlap(spark):
    chunks = one(spark, scalar.date_chunks(F.lit("2020-01-01").cast("date"), F.lit("2022-03-01").cast("date")))[0]
    assert str(chunks[0][0]) == "2020-01-01" and str(chunks[-1][1]) == "2022-03-01"
    for (_, end), (start, _) in zip(chunks, chunks[1:]):
        assert (start - end).days == 1
    assert all((e - s).days <= 364 for s, e in chunks)


def test_date_chunks_of_an_empty_range(spark):
    assert one(spark, scalar.date_chunks(F.lit("2020-01-02").cast("date"), F.lit("2020-01-01").cast("date")))[0] == []


def test_fractional_lead_is_exact(spark):
    row = one(spark, scalar.plus_minutes(F.lit("2026-01-01").cast("timestamp"), F.lit(2.5)).cast("string"))
    assert row[0] == "2026-01-01 00:02:30"


@pytest.mark.parametrize("dbz, level", [(None, 0), (float("nan"), 0), (4.99, 0), (5.0, 1), (10.0, 1), (25.0, 2), (35.0, 3), (45.0, 4), (50.0, 5), (60.0, 5)])
def test_dbz_class(spark, dbz, level):
    assert one(spark, cells.dbz_class(F.lit(dbz).cast("float")))[0] == level


def test_pixel_clips_and_truncates(spark):
    row = one(spark, *[cells.pixel(F.lit(v).cast("float")) for v in (None, -50.0, 70.0, 100.0, 20.0)])
    assert tuple(row) == (0, 0, 255, 255, 127)


def test_index_rounds_half_to_even_and_clamps(spark):
    n = F.lit(10)
    row = one(spark, *[geo.clamp_index(F.lit(v), n) for v in (2.5, 3.5, -4.0, 99.0)])
    assert tuple(row) == (2, 4, 0, 9)


def test_sql_functions_agree_with_columns(spark):
    register_functions(spark)
    row = spark.sql(
        "SELECT rain_flag(0.3D), dbz_class(45D), grid_index(0D, 100D, 101), km_north(36D, 37D), bearing_from_sincos(1D, 0D)"
    ).first()
    assert tuple(row) == (1, 4, 50, pytest.approx(110.574), 90.0)


def test_unknown_positions_stay_unknown(spark):
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    row = one(
        spark,
        geo.haversine_km(zero, zero, none, zero),
        geo.bearing_deg(zero, none, zero, zero),
        *geo.destination(none, zero, zero, zero),
        geo.clamp_index(none, F.lit(9)),
        scalar.cyclic(none, 12)[0],
    )
    assert tuple(row) == (None,) * 6
    register_functions(spark)
    sql = spark.sql("SELECT haversine_km(0D, 0D, NULL, 0D), destination_lat(NULL, 0D, 0D), grid_index(NULL, 1D, 9), bearing_deg(NULL, 0D, 0D, 0D)")
    assert tuple(sql.first()) == (None,) * 4
