"""Whole jobs on small files, streams in several batches, plan shapes, partition counts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from catalog.carriers import c_daily, c_fixes, c_obs
from catalog.queries_daily import c_preds
from catalog.queries_tracks import c_track_preds
from skyloom.errors import ModelNotTrainedError, NotEnoughDataError, OutOfRadarRangeError
from skyloom.operators import daily as D, rasters as R, tracks as K, verify as V
from skyloom.operators.merge import merge_gapfill
from skyloom.plans import jobs
from skyloom.sources.schemas import TABLES
from skyloom.sources.tables import read_table, replace_into, touched
from skyloom.streaming import jobs as streams
from test_rasters import blob, frame, frames
from test_sources import CSV, LISTING, TRACK

SF = "/root/testdata/sf0.001"


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def feed(*reports):
    return json.dumps(
        {
            "features": [
                {"properties": {"stationId": s, "timestamp": t, "temperature": {"value": v}, "precipitationLastHour": {"value": p}, "barometricPressure": {"value": 101000}}}
                for s, t, v, p in reports
            ]
        }
    )


def test_fetch_twice_then_history_takes_over(spark, tmp_path):
    root = str(tmp_path / "db")
    one = write(tmp_path / "one", "a.json", feed(("A", "2020-01-01T12:00:00Z", 5.0, 1.0), ("A", "2020-01-01T13:00:00Z", 7.0, None)))
    two = write(tmp_path / "two", "b.json", feed(("A", "2020-01-01T13:00:00Z", 99.0, 9.0), ("A", "2020-01-02T20:00:00Z", 3.0, 0.0)))
    assert jobs.ingest_observations(spark, root, one).count() == 2
    jobs.refresh_live_daily(spark, root)
    new = jobs.ingest_observations(spark, root, two)
    assert new.count() == 1
    jobs.refresh_live_daily(spark, root, new)
    rows = {str(r["date"]): r for r in read_table(spark, f"{root}/daily_observations", "daily_observations").collect()}
    assert rows["2020-01-01"]["temp_max_c"] == 7.0 and rows["2020-01-01"]["precip_mm"] == 1.0
    assert rows["2020-01-02"]["source"] == "metar_live" and rows["2020-01-02"]["pressure_hpa"] == 1010.0

    page = {"results": [{"date": "2020-01-01T00:00:00", "datatype": d, "station": "A", "value": v} for d, v in (("TMAX", 8.0), ("TMIN", 1.0), ("TMAX", 9.0))]}
    jobs.load_daily_history(spark, root, write(tmp_path / "pages", "p.json", json.dumps(page)))
    jobs.refresh_live_daily(spark, root)
    first = read_table(spark, f"{root}/daily_observations", "daily_observations").filter("date = DATE'2020-01-01'").first()
    assert (first["source"], first["temp_max_c"], first["temp_min_c"], first["precip_mm"], first["rain"]) == ("ghcnd", 9.0, 1.0, None, 0)
    assert first["pressure_hpa"] == 1010.0

    csv = write(tmp_path / "csv", "a.csv", CSV.replace("S1,2019-07-0", "A,2020-01-0").replace("01-04T", "01-01T").replace("01-05T", "01-02T").replace("01-06T", "01-03T").replace("01-07T", "01-04T"))
    jobs.load_enrichment(spark, root, csv, "2020-01-02", "2020-01-03")
    rows = {str(r["date"]): r for r in read_table(spark, f"{root}/daily_observations", "daily_observations").collect()}
    assert rows["2020-01-02"]["source"] == "metar_live" and rows["2020-01-02"]["humidity_pct"] == 71
    assert rows["2020-01-03"]["source"] == "lcd" and "2020-01-04" not in rows
    status = jobs.history_status(spark, root).collect()
    assert {r["source"]: r["n_source"] for r in status} == {"ghcnd": 1, "metar_live": 1, "lcd": 1}
    assert status[0]["days_missing"] == 11


def test_train_forecast_and_score_days(spark, tmp_path):
    root = str(tmp_path / "db")
    with pytest.raises(NotEnoughDataError):
        jobs.train_daily(spark, root)
    rng = random.Random(0)
    rows = []
    for i in range(60):
        rain = rng.random() < 0.4
        rows.append(("A", dt.date(2026, 1, 1) + dt.timedelta(days=i), "ghcnd", rng.uniform(5, 25), rng.uniform(-5, 5), 3.0 if rain else 0.0, int(rain), 50.0, rng.uniform(1003, 1023), 5.0, i))
    days = spark.createDataFrame(rows, TABLES["daily_observations"].ddl + ", ingest_seq long")
    with pytest.raises(ModelNotTrainedError):
        jobs.forecast_days(spark, root)
    past = days.filter("date < DATE'2026-02-28'")
    replace_into(spark, f"{root}/daily_observations", "daily_observations", past, "ingest_seq")
    scores = jobs.train_daily(spark, root, horizons=(1, 2), trees=5, trained_at="2026-02-28T00:00:00Z").collect()
    assert {r["horizon_days"] for r in scores} == {1, 2} and all(r["n_test"] == 11 for r in scores)
    made = jobs.forecast_days(spark, root)
    assert sorted((str(r["target_date"]), r["horizon_days"]) for r in made.collect()) == [("2026-02-28", 1), ("2026-03-01", 2)]
    replace_into(spark, f"{root}/daily_observations", "daily_observations", days.filter("date = DATE'2026-02-28'"), "ingest_seq")
    rows = {r["horizon_days"]: r for r in jobs.score_days(spark, root).collect()}
    assert (rows[1]["n_samples"], rows[1]["n_pending"], rows[2]["n_samples"], rows[2]["n_pending"]) == (1, 0, 0, 1)
    assert read_table(spark, f"{root}/model_performance", "model_performance").count() == 1


def test_tracks_from_text_to_scores(spark, tmp_path):
    root = str(tmp_path / "db")
    older = "AL031990,   OLD,  4,\n" + "".join(f"19900801, {h:02d}00,  , TS, 20.{h // 6}N, 50.{h // 6}W, 40, 1000,\n" for h in (0, 6, 12, 18))
    newer = "AL052021,   NEW,  3,\n" + "".join(f"20210801, {h:02d}00,  , TS, 22.{h // 6}N, 60.{h // 6}W, 40, 1000,\n" for h in (0, 6, 12))
    stored = jobs.load_tracks(spark, root, write(tmp_path / "t", "t.txt", older + TRACK + newer))
    assert stored.filter("_action = 'insert'").count() == 12
    assert jobs.load_tracks(spark, root, str(tmp_path / "t")).filter("_action = 'update'").count() == 12
    with pytest.raises(NotEnoughDataError):
        jobs.train_tracks(spark, root, horizons=(6,))
    jobs.train_tracks(spark, root, horizons=(6,), minimum=1, trees=2, trained_at="v1")
    storm = {"id": "al072004", "name": "Second", "latitude_numeric": 20.0, "longitude_numeric": -60.5, "intensity": 100, "pressure": 955, "movementDir": 315, "movementSpeed": 13, "lastUpdate": "2004-09-12T06:00:00Z"}
    feed_path = write(tmp_path / "s", "s.json", json.dumps({"activeStorms": [storm, {**storm, "id": "al01", "latitude_numeric": None}]}))
    assert jobs.forecast_storms(spark, root, feed_path).count() == 1
    (score,) = jobs.score_tracks(spark, root).collect()
    assert (score["n_samples"], score["n_pending"]) == (1, 0) and score["track_error_km"] > 0


def test_radar_from_listing_to_scores(spark, tmp_path):
    root = str(tmp_path / "db")
    listing = write(tmp_path / "l", "l.txt", LISTING)
    assert jobs.scan_catalog(spark, root, listing).count() == 2
    assert jobs.scan_catalog(spark, root, listing).count() == 0
    assert jobs.latest_scans(spark, root, "2026-07-05").first()["key"].endswith("120500_V06")
    store = lambda *rows: replace_into(spark, f"{root}/radar_frames", "radar_frames", frames(spark, *rows).withColumn("q", F.lit(0)), "q")
    store(frame(blob(5)), frame(blob(10), 5))
    rows = jobs.nowcast(spark, root, 5.0)
    assert {r["method"] for r in rows.collect()} == {"persistence", "optical_flow"}
    _, pending = jobs.score_nowcasts(spark, root)
    assert {r["method"]: r["n_pending"] for r in pending.collect()} == {"persistence": 1, "optical_flow": 1}
    store(frame(blob(15), 10))
    scores, pending = jobs.score_nowcasts(spark, root)
    by_method = {r["method"]: r for r in scores.collect()}
    assert by_method["optical_flow"]["mae_dbz"] < by_method["persistence"]["mae_dbz"]
    assert by_method["optical_flow"]["csi"] > by_method["persistence"]["csi"] and pending.isEmpty()
    box = spark.createDataFrame([(1, "KOHX", 36.0, -87.0, 30.0)], "point_id int, station string, point_lat double, point_lon double, radius_km double")
    cells, motion = jobs.region_product(spark, root, box)
    assert cells.count() > 0 and motion.count() > 0
    with pytest.raises(OutOfRadarRangeError):
        jobs.region_product(spark, root, box.withColumn("point_lat", F.lit(50.0)))
    checks, alerts = jobs.storm_check(spark, root, box.drop("radius_km"), write(tmp_path / "al", "a.json", json.dumps({"features": []})))
    assert checks.count() == 1 and alerts.isEmpty()


# --- streams -------------------------------------------------------------------------------------


def test_replayed_and_late_files_change_nothing(spark, tmp_path):
    root, spool = str(tmp_path / "db"), str(tmp_path / "spool")
    missing = [c for c in TABLES["observations"].schema.fieldNames() if c not in c_obs(spark, SF).columns]
    obs = c_obs(spark, SF).select("*", *[F.lit(None).cast("double").alias(c) for c in missing])

    def run(name):
        stream = streams.file_stream(spark, spool, obs.schema, files_per_batch=2)
        streams.ingest_and_refresh(stream, root, str(tmp_path / name)).awaitTermination()

    early = F.col("ingest_seq") < 500
    obs.filter(early).repartition(3).write.parquet(spool)
    run("checkpoint")
    obs.filter(~early).repartition(3).write.mode("append").parquet(spool)
    run("checkpoint")
    state = lambda: sorted(map(str, read_table(spark, f"{root}/daily_observations", "daily_observations").select(*[F.round(c, 6) if c.endswith(("_mm", "_pct", "_hpa", "_kmh")) else F.col(c) for c in TABLES["daily_observations"].schema.fieldNames()]).collect()))
    once = state()
    stored = read_table(spark, f"{root}/observations", "observations")
    assert stored.count() == obs.select("station_id", "timestamp").distinct().count()
    run("another-checkpoint")  # every file again
    assert state() == once
    want = D.live_daily(stored).count()
    assert len(once) == want


def test_day_matching_over_several_batches_with_pending(spark, tmp_path):
    preds = c_preds(spark, SF)
    daily = c_daily(spark, SF).drop("ingest_seq")
    for name, df in (("p", preds), ("d", daily)):
        df.write.parquet(str(tmp_path / name))
    source = lambda n, df: streams.file_stream(spark, str(tmp_path / n), df.schema)
    query = (
        streams.match_days(source("p", preds), source("d", daily))
        .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = V.join_outcomes(preds, daily)
    assert got.filter("NOT pending").count() == want.filter("NOT pending").count()
    assert 0 < got.filter("pending").count() <= want.filter("pending").count()


def test_clean_source_archives_landed_files(spark, tmp_path):
    spool = tmp_path / "spool" / "in"
    for i in range(3):
        write(spool, f"{i}.txt", f"x KOHX2026070{i + 1}_120000_V06\n")
        stream = streams.file_stream(spark, str(spool), "value string", "text", clean="archive", archive_dir=str(tmp_path / "old")).select(F.col("value").alias("line"))
        streams.land_scans(stream, str(tmp_path / "db"), str(tmp_path / "c")).awaitTermination()
    assert read_table(spark, str(tmp_path / "db/radar_scans"), "radar_scans").count() == 3
    assert len(list((tmp_path / "old").rglob("*.txt"))) >= 1


# --- plans ----------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_no_plan_falls_back_to_a_nested_loop(spark):
    fixes = c_fixes(spark, SF)
    frames_ = frames(spark, frame(blob(5)), frame(blob(10), 5))
    nowcasts = R.nowcast(R.block_flow(R.frame_pairs(frames_)), 5.0)
    for df in (
        K.track_targets(K.storm_motion(fixes), fixes),
        V.join_fixes(c_track_preds(spark, SF), fixes),
        V.join_outcomes(c_preds(spark, SF), c_daily(spark, SF)),
        R.grid_scores(nowcasts, frames_),
        merge_gapfill(c_daily(spark, SF).drop("ingest_seq"), c_daily(spark, SF)),
        K.season_split(K.track_training(K.storm_motion(fixes), fixes)),
    ):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_date_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = c_daily(spark, SF)
    replace_into(spark, path, "daily_observations", rows, "ingest_seq")
    text = plan(read_table(spark, path, "daily_observations").filter("obs_year = 1997 AND temp_max_c > 20").select("date"))
    assert "PartitionFilters: [isnotnull(obs_year" in text and "GreaterThan(temp_max_c,20.0)" in text
    assert "humidity_pct" not in text.split("ReadSchema:")[1]


def test_a_merge_reads_only_the_partitions_it_touches(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = c_daily(spark, SF)
    replace_into(spark, path, "daily_observations", rows, "ingest_seq")
    table = TABLES["daily_observations"]
    some = rows.filter(F.year("date").isin(1996, 1998))
    kept = touched(read_table(spark, path, table), some, table)
    assert {r[0] for r in kept.select("obs_year").distinct().collect()} == {1996, 1998}
    filters = plan(kept).split("PartitionFilters: [")[1].split("]")[0]
    assert filters.startswith("obs_year") and "1996" in filters and "1998" in filters and "1997" not in filters


def test_latest_frames_cut_before_the_shuffle_and_read_no_grids_to_rank(spark, tmp_path):
    path = str(tmp_path / "frames")
    replace_into(spark, path, "radar_frames", frames(spark, frame(blob(5)), frame(blob(6), 5)).withColumn("q", F.lit(0)), "q")
    text = plan(R.latest_frames(read_table(spark, path, "radar_frames"), 2))
    assert "WindowGroupLimit" in text
    assert any("reflectivity_dbz" not in s.split("\n")[0] for s in text.split("ReadSchema:")[1:])


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_results_do_not_depend_on_the_number_of_partitions(spark, partitions):
    from __spark_entry__ import QUERIES

    names = ["q_asof_eval", "q_storm_motion", "q_merge_gapfill", "q_roc_auc"]
    base = {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names} == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
