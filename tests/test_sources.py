import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skyloom.sources import best_track, climate_csv, feeds, scans
from skyloom.sources.tables import evolve, insert_ignore, keyed, read_table, replace_into

HEADER = "STATION,DATE,REPORT_TYPE,DailyAverageRelativeHumidity,DailyAverageSeaLevelPressure,DailyAverageStationPressure,DailyAverageWindSpeed"
CSV = HEADER + """
S1,2019-07-04T23:59:00,FM-12,31,29.00,28.00,9.0
S1,2019-07-04T23:59:00,SOD  ,64,29.00,28.55,7.5
S1,2019-07-05T23:59:00,SOD  ,71,29.11,28.66,3.1
S1,2019-07-06T23:59:00,SOD  ,8x,0.00,28.44s,T
S1,2019-07-07T23:59:00,SOD  ,,,,
"""
TRACK = """AL031999,               FIRST,     3,
19990701, 0000,  , TS, 11.5N,  40.0W,  45,-999,
19990701, 0600,  , TS, 11.9N,  41.5W,  45,-999,
19990701, 1200,  , HU, 12.4N,  43.0W,  65, 990,

AL072004,              SECOND,     2,
20040912, 0600,  , HU, 20.0N,  60.5W, 100, 955,
20040912, 1200, L, HU, 20.8N,  61.0W, 105, 951,
"""


def test_climate_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    rows = climate_csv.parse_climate_days(climate_csv.read_climate_csv(spark, str(tmp_path))).orderBy("date").collect()
    assert len(rows) == 4
    assert rows[0]["humidity_pct"] == 64
    assert rows[0]["pressure_hpa"] == pytest.approx(29.00 * 33.8639)
    assert rows[0]["wind_speed_kmh"] == pytest.approx(7.5 * 1.60934)
    assert rows[2]["humidity_pct"] is None and rows[2]["wind_speed_kmh"] == 0.0
    assert rows[2]["pressure_hpa"] == pytest.approx(28.44 * 33.8639)
    assert tuple(rows[3])[2:] == (None, None, None)


def test_each_climate_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text(
        "DailyAverageWindSpeed,DATE,STATION,Remarks,REPORT_TYPE,DailyAverageRelativeHumidity\n"
        '4.0,2018-01-02T23:59:00,S2,"a, b",SOD,52\n'
    )
    rows = climate_csv.parse_climate_days(climate_csv.read_climate_csv(spark, str(tmp_path))).orderBy("date").collect()
    assert len(rows) == 5
    assert rows[0]["station_id"] == "S2" and rows[0]["humidity_pct"] == 52 and rows[0]["pressure_hpa"] is None
    assert rows[0]["wind_speed_kmh"] == pytest.approx(4.0 * 1.60934)


def test_feed_files_of_both_layouts_in_their_order(spark, tmp_path):
    def feed(*values):
        one = lambda v: {"properties": {"stationId": "A", "timestamp": "2020-01-01T00:00:00Z", "temperature": {"value": v}}}
        return {"features": [one(v) for v in values]}

    (tmp_path / "01.json").write_text(json.dumps(feed(1.0, 2.0, 3.0), indent=2))
    (tmp_path / "02.json").write_text("\n".join(json.dumps(feed(float(v))) for v in range(4, 400)) + "\nbroken {\n")
    docs = feeds.read_documents(spark, str(tmp_path))
    rows = feeds.parse_observations(docs, keep=["arrival"], seq="arrival")
    assert [r["temperature_c"] for r in rows.orderBy("arrival").collect()] == [float(v) for v in range(1, 400)]
    assert [r["doc"] for r in feeds.broken_documents(docs).collect()] == ["broken {"]
    first = insert_ignore(spark, f"{tmp_path}/t", "observations", rows.withColumnRenamed("arrival", "ingest_seq"), "ingest_seq")
    assert [r["temperature_c"] for r in first.collect()] == [1.0]


def test_files_of_lines_never_come_into_one_row(spark, tmp_path, monkeypatch):
    reader = type(spark.read)
    read = reader.text
    monkeypatch.setattr(reader, "text", lambda self, path, wholetext=False, **k: pytest.fail("a whole file in a row") if wholetext else read(self, path, **k))
    monkeypatch.setattr(feeds, "ROW_BYTES", 20_000)
    lines = [json.dumps({"n": i}) for i in range(300)]
    pretty = {"a": [{}, [], {"k": [1, 2]}], "b": [[1], [2, 3]], "long": list(range(900))}
    files = {
        "a=1/lines.json": "\n".join(lines),
        "a=1/odd.json": "broken {\n" + "\n\n".join(lines),
        "a=2/pretty.json": "\n \r\n" + json.dumps(pretty, indent=1).replace("\n", "\r\n"),
        "a=2/array.json": "[\n" + ",\n".join(lines) + "\n]",
        "a=2/torn.json": '{\n"x": 1,\n',
        "a=3/long.json": json.dumps(list(range(9000)), indent=1),
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        docs = feeds.read_documents(spark, str(tmp_path)).orderBy("arrival").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in docs:
        name = "/".join(r["arrival"]["file"].split("/")[-2:])
        assert name.startswith(f"a={r['a']}/")
        by_file.setdefault(name, []).append(r["doc"])
    assert by_file["a=1/lines.json"] == lines
    assert [d for d in by_file["a=1/odd.json"] if d] == ["broken {", *lines]
    assert [json.loads(d) for d in by_file["a=2/pretty.json"]] == [pretty]
    assert [json.loads(d) for d in by_file["a=2/array.json"]] == [[json.loads(x) for x in lines]]
    assert by_file["a=2/torn.json"] == ["{", '"x": 1,']
    assert by_file["a=3/long.json"] == files["a=3/long.json"].splitlines()


def test_rows_without_a_key_are_not_stored(spark, tmp_path):
    ddl = "storm_id string, name string, timestamp timestamp, lat double, lon double, max_wind_kt double, min_pressure_mb double, status string, ingest_seq long"
    for name in ("A", "B"):
        rows = spark.createDataFrame([(name, name, None, 1.0, 1.0, 1.0, 1.0, "X", 0), (name, name, dt.datetime(2000, 1, 1), 1.0, 1.0, 1.0, 1.0, "X", 1)], ddl)
        replace_into(spark, f"{tmp_path}/t", "hurricane_fixes", rows, "ingest_seq")
    assert sorted(r["storm_id"] for r in read_table(spark, f"{tmp_path}/t", "hurricane_fixes").collect()) == ["A", "B"]
    assert keyed(rows, "hurricane_fixes")[1].count() == 1


def test_climate_csv_without_optional_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("STATION,DATE,REPORT_TYPE\nX,2020-01-01T00:00:00,SOD\nX,bad,SOD\n")
    rows = climate_csv.parse_climate_days(climate_csv.read_climate_csv(spark, str(tmp_path))).collect()
    assert sorted(str(r["date"]) for r in rows) == ["2020-01-01", "None"]


EXPECTED = [
    ("AL031999", "FIRST", "1999-07-01 00:00:00", 11.5, -40.0, 45.0, None, "TS"),
    ("AL031999", "FIRST", "1999-07-01 06:00:00", 11.9, -41.5, 45.0, None, "TS"),
    ("AL031999", "FIRST", "1999-07-01 12:00:00", 12.4, -43.0, 65.0, 990.0, "HU"),
    ("AL072004", "SECOND", "2004-09-12 06:00:00", 20.0, -60.5, 100.0, 955.0, "HU"),
    ("AL072004", "SECOND", "2004-09-12 12:00:00", 20.8, -61.0, 105.0, 951.0, "HU"),
]


def _fixes(df):
    rows = df.withColumn("timestamp", F.col("timestamp").cast("string")).orderBy("timestamp").collect()
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("basins", [("AL", "AL"), ("AL", "EP"), ("EP", "EP")])
@pytest.mark.parametrize("split", [40, 100, 100_000])
def test_best_track_files_of_any_basin_and_split(spark, tmp_path, newline, basins, split):
    text = TRACK.replace("AL03", f"{basins[0]}03").replace("AL07", f"{basins[1]}07")
    (tmp_path / "t.txt").write_bytes(text.replace("\n", newline).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = best_track.read_best_track(spark, str(tmp_path))
        assert lines.select("arrival.block").distinct().count() > 1 or split > 1000
        rows = _fixes(best_track.parse_lines(lines))
        in_order = best_track.parse_lines(lines, keep=["arrival"]).orderBy("arrival").select("timestamp").collect()
        assert [str(r[0]) for r in in_order] == [r[2] for r in EXPECTED]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    of = {"AL031999": f"{basins[0]}031999", "AL072004": f"{basins[1]}072004"}
    assert rows == [(of[r[0]], *r[1:]) for r in EXPECTED]


def test_files_do_not_lend_each_other_a_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TRACK)
    (tmp_path / "b.txt").write_text("".join(TRACK.splitlines(True)[-1:]))
    rows = best_track.parse_lines(best_track.read_best_track(spark, str(tmp_path)))
    assert rows.filter("storm_id IS NULL").count() == 1 and rows.filter("storm_id IS NOT NULL").count() == 5


@pytest.mark.parametrize("width", [1, 2, 3, 100])
def test_best_track_lines_carry_their_header(spark, width):
    lines = spark.createDataFrame(
        [("f", i, t) for i, t in enumerate(TRACK.splitlines())], "file string, pos long, line string"
    )
    assert _fixes(best_track.parse_lines(lines, slice_lines=width)) == EXPECTED


def docs(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "doc string")


def test_observation_measure_forms(spark):
    feature = {
        "properties": {
            "stationId": "KBNA",
            "timestamp": "2026-01-01T00:53:00+00:00",
            "textDescription": "Clear",
            "temperature": {"value": 5.5, "unitCode": "x"},
            "dewpoint": {"value": None},
            "windSpeed": None,
        }
    }
    (row,) = feeds.parse_observations(docs(spark, {"features": [feature]}, {"features": []}, {})).collect()
    assert row["station_id"] == "KBNA" and row["temperature_c"] == 5.5
    assert row["dewpoint_c"] is None and row["wind_speed_kmh"] is None and row["heat_index_c"] is None
    assert len(row) == 19 and row["timestamp"] == dt.datetime(2026, 1, 1, 0, 53)


def test_broken_document_is_skipped_and_the_batch_goes_on(spark):
    good = json.dumps({"activeStorms": [{"id": "al012026", "name": "X"}]})
    bad = spark.createDataFrame([("{not json",), (good,)], "doc string")
    assert [r["id"] for r in feeds.parse_active_storms(bad).collect()] == ["al012026"]
    assert [r["doc"] for r in feeds.broken_documents(bad).collect()] == ["{not json"]


def test_corrupt_files_are_skipped_on_request(spark, tmp_path):
    path = tmp_path / "scans"
    names = spark.createDataFrame([("KOHX20260704_120000_V06",)], "file_name string")
    rows = scans.parse_scans(names)[0].withColumn("ingest_seq", F.lit(0))
    insert_ignore(spark, str(path), "radar_scans", rows, "ingest_seq")
    (path / "landed_date=2026-07-04" / "broken.parquet").write_bytes(b"PAR1 nonsense")
    assert read_table(spark, str(path), "radar_scans", skip_corrupt=True).count() == 1


def test_folder_as_listing(spark, tmp_path):
    for name in ("KOHX20260704_120000_V06", "KOHX20260704_120000_V06_MDM", "junk"):
        (tmp_path / name).write_bytes(b"x")
    good, bad = scans.parse_scans(scans.scan_names(scans.list_files(spark, str(tmp_path))))
    assert [r["file_name"] for r in good.collect()] == ["KOHX20260704_120000_V06"]
    assert [r["file_name"] for r in bad.collect()] == ["junk"]


def test_active_storm_fields(spark):
    storm = {
        "id": "al092021", "binNumber": "AT4", "name": "Ida", "classification": "HU", "intensity": 130,
        "pressure": 930, "latitude": "29.1N", "longitude": "90.2W", "latitude_numeric": 29.1,
        "longitude_numeric": -90.2, "movementDir": 315, "movementSpeed": 13, "lastUpdate": "2021-08-29T15:00:00.000Z",
    }
    (row,) = feeds.parse_active_storms(docs(spark, {"activeStorms": [storm]}, {"activeStorms": []})).collect()
    assert tuple(row) == ("al092021", "Ida", "HU", 29.1, -90.2, 130.0, 930.0, 315.0, 13.0, "2021-08-29T15:00:00.000Z")


def test_alerts_keep_feed_order(spark):
    feed = {"features": [{"properties": {"id": i, "event": "Flood", "areaDesc": "Davidson"}} for i in ("b", "a")]}
    rows = feeds.parse_alerts(docs(spark, feed)).orderBy("feed_pos").collect()
    assert [r["id"] for r in rows] == ["b", "a"] and rows[0]["area_desc"] == "Davidson" and rows[0]["headline"] is None


def test_daytime_periods(spark):
    periods = [
        {"name": n, "isDaytime": d, "startTime": "2026-07-04T06:00:00-05:00", "detailedForecast": "dry"}
        for n, d in (("Tonight", False), ("Sat", True), ("Sun", True), ("Mon", True))
    ]
    rows = feeds.parse_daytime_periods(docs(spark, {"properties": {"periods": periods}}), 2).collect()
    assert [r["official_forecast"] for r in rows] == ["Sat: dry", "Sun: dry"]


LISTING = """2026-07-04 12:00:10   12345678 KOHX20260704_120000_V06
2026-07-04 12:00:11       1234 KOHX20260704_120000_V06_MDM

2026-07-04 12:05:10   12345678 KOHX20260704_120500_V06
2026-07-04 12:05:12   12345678 not_a_scan
"""


def test_listing_and_names(spark, tmp_path):
    (tmp_path / "l.txt").write_text(LISTING)
    good, bad = scans.parse_scans(scans.scan_names(scans.read_listing(spark, str(tmp_path))))
    rows = good.orderBy("key").collect()
    assert [r["key"] for r in rows] == [
        "2026/07/04/KOHX/KOHX20260704_120000_V06",
        "2026/07/04/KOHX/KOHX20260704_120500_V06",
    ]
    assert rows[0]["timestamp"] == dt.datetime(2026, 7, 4, 12) and rows[0]["station"] == "KOHX"
    assert [r[0] for r in bad.collect()] == ["not_a_scan"]


def test_latest_scan_falls_back_to_yesterday(spark):
    names = spark.createDataFrame([("KOHX20260703_235500_V06",), ("KOHX20260701_000000_V06",)], "file_name string")
    good, _ = scans.parse_scans(names)
    (row,) = scans.latest_scan(good, F.lit("2026-07-04").cast("date")).collect()
    assert row["file_name"] == "KOHX20260703_235500_V06"


FIX = "storm_id string, name string, timestamp timestamp, lat double, lon double, max_wind_kt double, min_pressure_mb double, status string, ingest_seq long"


def test_replace_sink_round_trip(spark, tmp_path):
    path = str(tmp_path / "fixes")
    t = dt.datetime(2021, 8, 29, 12)
    first = spark.createDataFrame([("AL09", "IDA", t, 29.1, -90.2, 130.0, 930.0, "HU", 0)], FIX)
    again = spark.createDataFrame([("AL09", "IDA", t, 29.1, -90.2, 125.0, None, "HU", 1)], FIX)
    other = spark.createDataFrame([("AL01", "X", dt.datetime(1999, 1, 1), 1.0, 1.0, 1.0, 1.0, "TS", 0)], FIX)
    for rows in (first, other, again):
        replace_into(spark, path, "hurricane_fixes", rows, "ingest_seq")
    got = {r["storm_id"]: r for r in read_table(spark, path, "hurricane_fixes").collect()}
    assert len(got) == 2 and got["AL09"]["max_wind_kt"] == 125.0 and got["AL09"]["min_pressure_mb"] is None


def test_ignore_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "scans")
    names = spark.createDataFrame([("KOHX20260704_120000_V06",), ("KOHX20260704_120500_V06",)], "file_name string")
    rows = scans.parse_scans(names)[0].withColumn("ingest_seq", F.lit(0))
    assert insert_ignore(spark, path, "radar_scans", rows, "ingest_seq").count() == 2
    assert insert_ignore(spark, path, "radar_scans", rows, "ingest_seq").count() == 0
    assert read_table(spark, path, "radar_scans").count() == 2


def test_older_files_lack_late_columns(spark, tmp_path):
    path = str(tmp_path / "daily")
    old = spark.sql("SELECT 'A' station_id, DATE'2020-01-01' date, 'ghcnd' source, 1D temp_max_c")
    old.withColumn("obs_year", F.lit(2020)).write.partitionBy("obs_year").parquet(path)
    (row,) = read_table(spark, path, "daily_observations").collect()
    assert row["humidity_pct"] is None and row["temp_max_c"] == 1.0
    assert evolve(old, "daily_observations").columns[-1] == "wind_speed_kmh"


def test_appended_rows_of_a_folder_share_a_file(spark, tmp_path):
    from pyspark.sql import functions as F

    from skyloom.sources.schemas import TABLES
    from skyloom.sources.tables import append_rows, evolve

    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600)
    rows = spark.range(0, 96, 1, 8).select(F.lit("KOHX").alias("station"), at.alias("timestamp"), F.lit(1.0).alias("grid_km"))
    append_rows(evolve(rows.repartition(8), "radar_frames"), str(tmp_path / "frames"), TABLES["radar_frames"])
    files = list((tmp_path / "frames").rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) == 4  # every task wrote into every folder before
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 96
