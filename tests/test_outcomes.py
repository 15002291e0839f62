"""Grid storage without merging and forecasts that meet their outcomes in any order."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import kernels
from skyloom.operators import rasters as R, tracks as K
from skyloom.sources import grids
from skyloom.sources.schemas import TABLES
from skyloom.sources.tables import insert_ignore, read_table, replace_into
from skyloom.streaming import jobs as streams
from test_jobs import plan
from test_rasters import SCHEMA, T0, blob, frame, frames

SF = "/root/testdata/sf0.001"


# --- stored grids --------------------------------------------------------------------------


def tiny(value, minutes=0, station="KOHX", seq=0):
    return (station, T0 + dt.timedelta(minutes=minutes), 1.0, 1.0, 36.0, -87.0, [float(value)], seq)


def stored(spark, path):
    rows = read_table(spark, path, "radar_frames").collect()
    return sorted((r["station"], (r["timestamp"] - T0).seconds // 60, r["reflectivity_dbz"][0]) for r in rows)


def tiny_frames(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA + ", q int")


@pytest.mark.parametrize("many", [0, grids.BROADCAST_ROWS])
def test_replacing_grids_and_compacting(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(grids, "BROADCAST_ROWS", many)
    path = str(tmp_path / "frames")
    first = tiny_frames(spark, tiny(1), tiny(2, 5), tiny(3, 0, "KHPX"), tiny(9, 5, seq=-1), (None, *tiny(4)[1:]))
    assert grids.store_grids(spark, path, "radar_frames", first, "q").count() == 3
    assert stored(spark, path) == [("KHPX", 0, 3.0), ("KOHX", 0, 1.0), ("KOHX", 5, 2.0)]
    again = tiny_frames(spark, tiny(7), tiny(8, 10), tiny(6, seq=-1))
    for _ in range(2):  # the second time is a retry
        replace_into(spark, path, "radar_frames", again, "q")
        assert stored(spark, path) == [("KHPX", 0, 3.0), ("KOHX", 0, 7.0), ("KOHX", 5, 2.0), ("KOHX", 10, 8.0)]
    assert spark.read.parquet(path).count() == 7
    assert grids.compact_grids(spark, path, "radar_frames") == 1
    assert stored(spark, path) == [("KHPX", 0, 3.0), ("KOHX", 0, 7.0), ("KOHX", 5, 2.0), ("KOHX", 10, 8.0)]
    assert spark.read.parquet(path).count() == 4 and grids.compact_grids(spark, path, "radar_frames") == 0


def test_first_grid_wins_on_request(spark, tmp_path):
    path = str(tmp_path / "frames")
    assert insert_ignore(spark, path, "radar_frames", tiny_frames(spark, tiny(1, seq=1), tiny(2, seq=2)), "q").count() == 1
    assert insert_ignore(spark, path, "radar_frames", tiny_frames(spark, tiny(5), tiny(6, 5)), "q").count() == 1
    assert stored(spark, path) == [("KOHX", 0, 1.0), ("KOHX", 5, 6.0)]
    assert insert_ignore(spark, path, "radar_frames", tiny_frames(spark), "q").count() == 0


def test_storing_reads_keys_only_and_reading_moves_no_grid(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "frames")
    replace_into(spark, path, "radar_frames", tiny_frames(spark, tiny(1), tiny(2, 5)), "q")
    kept = []
    real = grids.tables.materialise
    monkeypatch.setattr(grids.tables, "materialise", lambda s, df: kept.append(plan(df)) or real(s, df))
    replace_into(spark, path, "radar_frames", tiny_frames(spark, tiny(3)), "q")
    scans = [p.split("ReadSchema:")[1].split("\n")[0] for p in kept if "FileScan parquet" in p]
    assert scans and not any("reflectivity" in s for s in scans)
    text = plan(read_table(spark, path, "radar_frames"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning(station" not in text.split("FileScan")[0]


# --- pairs ------------------------------------------------------------------------------------


def test_no_grid_is_sorted_to_find_its_predecessor(spark):
    text = R.frame_pairs(frames(spark, frame(blob(5)), frame(blob(6), 5)))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    nodes = [n for n in text.split("\n\n") if n.startswith("(")]
    sorting = [n for n in nodes if n.split(") ", 1)[1].startswith(("Sort", "Window", "SortMergeJoin"))]
    assert sorting and not any("dbz" in n for n in sorting)


# --- seasons ------------------------------------------------------------------------------------


def test_baseline_of_the_latest_seasons_in_one_pass(spark):
    from catalog.queries_tracks import _training

    rows = _training(spark, SF)
    one = K.track_baseline(rows, 2)
    two = K.track_baseline(K.season_split(rows, 2).filter("is_test"))
    shown = lambda df: [tuple(round(v, 9) for v in r) for r in df.orderBy("horizon_hours").collect()]
    assert shown(one) == shown(two) and len(shown(one)) > 1
    count = lambda df: plan(df).split("== Initial Plan ==")[-1].count("Exchange")
    assert count(one) < count(two)


# --- outcomes ---------------------------------------------------------------------------------------


def run(spark, tmp_path, name, match, turns):
    """One micro-batch per turn; returns the root."""
    root = str(tmp_path / name)
    for n, rows in enumerate(turns):
        rows.coalesce(1).write.mode("append").parquet(f"{root}/spool")
        stream = streams.file_stream(spark, f"{root}/spool", rows.schema)
        match(stream, root, f"{root}/checkpoint").awaitTermination()
    return root


DAY = dt.date(2024, 3, 31)


def forecast(day, horizon, station="S1", high=20.0):
    made = day - dt.timedelta(days=horizon)
    return (station, made, horizon, day, 0.7, 1, high, 5.0, "v1", None, None, None, None, None, None, "prediction", 0)


def outcome(day, version, high, station="S1"):
    return (station, None, None, None, None, None, None, None, None, day, 1, high, 4.0, version, None, "outcome", 0)


DAYS = (
    "station_id string, predicted_date date, horizon_days int, target_date date, rain_probability double, rain_predicted int,"
    " temp_max_pred_c double, temp_min_pred_c double, model_trained_at string, date date, rain int, temp_max_c double,"
    " temp_min_c double, version long, extra string, kind string, ingest_seq int"
)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_a_revised_day_is_scored_once_with_its_last_value(spark, tmp_path, order):
    parts = [
        [forecast(DAY, 1), forecast(DAY, 3), forecast(DAY, 1, "S2"), forecast(DAY + dt.timedelta(1), 2)],
        [outcome(DAY, 1, 10.0), outcome(DAY, 1, 11.0, "S2")],
        [outcome(DAY, 2, 21.0), outcome(DAY, 2, None, "S2"), outcome(DAY, 2, 3.0, "other")],
    ]
    turns = [spark.createDataFrame(parts[i], DAYS) for i in order]
    root = run(spark, tmp_path, "days", streams.match_outcomes, turns)
    rows = read_table(spark, f"{root}/prediction_outcomes", "prediction_outcomes").collect()
    got = sorted((r["station_id"], r["target_date"].day, r["horizon_days"], r["actual_temp_max_c"]) for r in rows)
    assert got == [("S1", 1, 2, None), ("S1", 31, 1, 21.0), ("S1", 31, 3, 21.0), ("S2", 31, 1, None)]


def test_a_forecast_beyond_the_reach_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="more than 31 days ahead"):
        run(spark, tmp_path, "far", streams.match_outcomes, [spark.createDataFrame([forecast(DAY, 40)], DAYS)])


def radar_rows(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA + ", predicted_at timestamp, valid_at timestamp, lead_minutes double, method string, kind string, ingest_seq int")


def seen(value, minutes, seconds=0):
    at = T0 + dt.timedelta(minutes=minutes, seconds=seconds)
    return ("KOHX", at, 1.0, 1.0, 36.0, -87.0, [float(value)], None, None, None, None, "frame", 0)


def said(value, minutes, method="persistence"):
    at = T0 + dt.timedelta(minutes=minutes)
    return ("KOHX", None, 1.0, 1.0, 36.0, -87.0, [float(value)], at, at + dt.timedelta(minutes=30), 30.0, method, "nowcast", 0)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_nowcasts_meet_frames_in_any_order(spark, tmp_path, order):
    midnight = 12 * 60  # minutes from T0 to the next day
    parts = [
        [said(30, 0), said(25, 0, "optical_flow"), said(10, midnight - 30), said(1, midnight + 600)],
        [seen(28, 30, 100), seen(12, midnight, -60)],
        [seen(40, 30, 20), seen(50, 35), seen(15, midnight, 30)],
    ]
    turns = [radar_rows(spark, *parts[i]) for i in order]
    root = run(spark, tmp_path, "radar", streams.match_nowcasts, turns)
    path = f"{root}/radar_nowcast_outcomes"
    score = lambda: sorted((r["method"], str(r["actual_at"])[8:], r["mae_dbz"], r["csi"]) for r in read_table(spark, path, "radar_nowcast_outcomes").collect())
    assert score() == [("optical_flow", "04 12:30:20", 15.0, 1.0), ("persistence", "04 12:30:20", 10.0, 1.0), ("persistence", "05 00:00:30", 5.0, 1.0)]
    run(spark, tmp_path, "radar", streams.match_nowcasts, [radar_rows(spark, said(38, 0))])  # a nowcast made again
    assert ("persistence", "04 12:30:20", 2.0, 1.0) in score() and len(score()) == 3
    assert TABLES["radar_nowcast_outcomes"].keys == TABLES["radar_nowcasts"].keys
    nowcasts = read_table(spark, f"{root}/radar_nowcasts", "radar_nowcasts").drop("valid_date")
    batch = R.grid_scores(nowcasts, read_table(spark, f"{root}/radar_frames", "radar_frames").drop("scan_date"))
    assert sorted((r["method"], r["mae_dbz"]) for r in batch.collect()) == sorted((m, e) for m, _, e, _ in score())
    assert batch.filter(F.col("csi") < 0).isEmpty()


# --- requests by time, motion in levels --------------------------------------------------------------


def test_requests_get_one_row_each(spark):
    rows = frames(spark, *[frame(blob(k), 5 * k) for k in range(6)], frame(blob(30), 700), frame(blob(9), 2, "KHPX"))
    at = lambda m: T0 + dt.timedelta(minutes=m)
    asked = [(1, "KOHX", at(12)), (2, "KOHX", at(10)), (3, "KOHX", None), (4, "KOHX", at(-1)), (5, "KHPX", at(9000)), (6, "none", None), (2, "KOHX", at(10))]
    requests = spark.createDataFrame(asked, "point_id int, station string, at timestamp")
    got = R.for_requests(rows, requests).collect()
    assert sorted((r["point_id"], (r["timestamp"] - T0).total_seconds() / 60) for r in got) == [(1, 10.0), (2, 10.0), (2, 10.0), (3, 700.0), (5, 2.0)]
    young = R.for_requests(rows, requests, max_age_s=60.0)
    assert sorted(r["point_id"] for r in young.collect()) == [2, 2, 3]
    assert R.for_requests(rows.limit(0), requests).isEmpty() and R.for_requests(rows, requests.limit(0)).isEmpty()
    places = requests.filter("point_id < 4").selectExpr("*", "36.0 AS point_lat", "-87.0 AS point_lon", "5.0 AS radius_km")
    assert R.point_samples(rows, places).count() == 4 and R.crop_bounds(rows, places).count() == 4


def plain_levels(prev, curr, block, radius, levels):
    n = len(curr)
    side = -(-n // block)
    at = lambda g, r, c: g[r, c] if 0 <= r < n and 0 <= c < n else 0.0
    cells = {
        (i, j): [(r, c) for r in range(i * block, min(n, i * block + block)) for c in range(j * block, min(n, j * block + block))]
        for i in range(side)
        for j in range(side)
    }
    echo = [b for b in cells if sum(int(curr[r, c]) for r, c in cells[b])]
    rows, cols = {i for i, _ in echo}, {j for _, j in echo}
    found = {b: (0, 0) for b in cells}
    tries = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    for level in range(levels - 1, -1, -1):
        step = 2**level
        full = lambda g: np.pad(g, (0, -n % step)).astype(float)
        mean = lambda g, r, c: full(g)[r // step * step : r // step * step + step, c // step * step : c // step * step + step].mean()
        a, b = (np.array([[mean(g, r, c) for c in range(n)] for r in range(n)]) for g in (prev, curr))

        def alone(k, s):
            x, y = (int(v) for v in found[k])
            return sum(abs(b[r, c] - at(a, r - y - s[1] * step, c - x - s[0] * step)) for r, c in cells[k])

        costs = {(k, s): alone(k, s) if k[0] in rows and k[1] in cols else 0.0 for k in cells for s in tries}
        now = {}
        for i, j in echo:
            near = [k for k in cells if abs(k[0] - i) <= level and abs(k[1] - j) <= level]
            cost = lambda s: round(sum(costs[k, s] for k in near), 6)
            dx, dy = min(tries, key=lambda s: (cost(s), s[0] ** 2 + s[1] ** 2, s[1], s[0]))
            now[i, j] = (found[i, j][0] + dx * step, found[i, j][1] + dy * step)
        found.update(now)
    return {k: found[k] for k in echo}


def test_motion_in_levels_equals_plain_loops():
    rng = np.random.default_rng(4)
    for n, block in ((11, 4), (8, 4)):
        prev, curr = (rng.integers(0, 5, (n, n)).astype(np.uint8) * rng.integers(0, 40, (n, n)).astype(np.uint8) for _ in range(2))
        curr[:block, :block] = 0
        fx, fy = kernels.match_levels(prev.ravel(), curr.ravel(), block, 1, 2)
        side = -(-n // block)
        want = plain_levels(prev, curr, block, 1, 2)
        assert {(r, c): (fx[r * side + c], fy[r * side + c]) for r, c in want} == want
        assert fx[0] == pytest.approx(np.mean([x for x, _ in want.values()]))


def storm(cx, cy, n=180):
    """A cell of several cores."""
    y, x = np.mgrid[0:n, 0:n]
    cores = ((0, 0, 14, 200), (18, 10, 8, 140), (-14, 16, 7, 170), (6, -20, 9, 120))
    grid = sum(h * np.exp(-((x - cx - dx) ** 2 + (y - cy - dy) ** 2) / (2 * s * s)) for dx, dy, s, h in cores)
    return np.where(grid < 8, 0, np.minimum(grid, 255)).astype(np.uint8)


def test_a_far_shift_is_found_by_three_small_searches():
    prev, curr = storm(70, 90), storm(100, 90)
    fx, fy = (f.reshape(12, 12) for f in kernels.match_levels(prev.ravel(), curr.ravel(), 15, 5, 3))
    core = np.add.reduceat(np.add.reduceat(curr.astype(float), range(0, 180, 15), 0), range(0, 180, 15), 1) > 5000
    assert core.sum() > 10 and (fx[core] == 30).mean() > 0.9 and (fy[core] == 0).mean() > 0.9
    near, _ = kernels.match_blocks(prev.ravel(), curr.ravel(), 15, 8)
    assert np.abs(near).max() <= 8
    same = kernels.match_levels(prev.ravel(), curr.ravel(), 15, 3, 1)
    assert all((a == b).all() for a, b in zip(same, kernels.match_blocks(prev.ravel(), curr.ravel(), 15, 3)))


# --- rejects and zones ---------------------------------------------------------------------------------


def reports(spark, *rows):
    names = [f for f in TABLES["observations"].schema.fieldNames() if f not in ("station_id", "timestamp", "temperature_c")]
    made = spark.createDataFrame(list(rows), "station_id string, timestamp timestamp, temperature_c double")
    return made.select("*", *[F.lit(None).cast(TABLES["observations"].schema[c].dataType).alias(c) for c in names], F.lit(0).alias("ingest_seq"))


def test_keyless_rows_are_kept_once_however_often_they_come(spark, tmp_path):
    rows = reports(spark, ("A", T0, 1.0), (None, T0, 2.0), ("A", None, 3.0), (None, T0, 2.0))
    for name in ("first", "second", "first"):
        rows.write.mode("append").parquet(f"{tmp_path}/spool")
        stream = streams.file_stream(spark, f"{tmp_path}/spool", rows.schema)
        streams.ingest_observations(stream, str(tmp_path), f"{tmp_path}/{name}").awaitTermination()
    kept = read_table(spark, f"{tmp_path}/rejects", "rejects").collect()
    assert len(kept) == 2 and {r["job"] for r in kept} == {"observations"} and "3.0" in "".join(r["record"] for r in kept)
    assert read_table(spark, f"{tmp_path}/observations", "observations").count() == 1


def test_days_are_cut_at_the_midnight_of_each_station(spark, tmp_path):
    zones = spark.createDataFrame([("B", "Europe/Berlin", None, None, 0)], "station_id string, tz string, latitude double, longitude double, ingest_seq int")
    replace_into(spark, f"{tmp_path}/stations", "stations", zones, "ingest_seq")
    utc = lambda d, h: dt.datetime(2026, 3, d, h)
    # Berlin: midnight at 23 UTC before and at 22 UTC after the change on the 29th; Chicago: at 5 UTC
    rows = reports(spark, *[(s, t, float(k)) for s in "AB" for k, t in enumerate([utc(28, 22), utc(28, 23), utc(29, 4), utc(29, 21), utc(29, 22), utc(30, 5)])])
    streams.refresh_days(spark, str(tmp_path), insert_ignore(spark, f"{tmp_path}/observations", "observations", rows, "ingest_seq"))
    got = read_table(spark, f"{tmp_path}/daily_observations", "daily_observations").collect()
    days = sorted((r["station_id"], r["date"].day, r["temp_min_c"], r["temp_max_c"]) for r in got)
    assert days == [("A", 28, 0.0, 2.0), ("A", 29, 3.0, 4.0), ("A", 30, 5.0, 5.0), ("B", 28, 0.0, 0.0), ("B", 29, 1.0, 3.0), ("B", 30, 4.0, 5.0)]


# --- tracks --------------------------------------------------------------------------------


def test_a_new_fix_matches_only_forecasts_in_its_reach_again(spark, tmp_path, monkeypatch):
    root, start = str(tmp_path / "wx"), dt.datetime(2025, 12, 31)
    hour = lambda h: start + dt.timedelta(hours=h)
    made = [(hour(h - 12), "AL01", "ANA", 12, hour(h), 10.0, -80.0, 50.0, "m", 0) for h in range(48)]
    made += [(hour(h - 12), "AL02", "BOB", 12, hour(h), 10.0, -80.0, 50.0, "m", 0) for h in range(48)]
    forecasts = spark.createDataFrame(made, TABLES["hurricane_predictions"].ddl + ", ingest_seq INT")
    replace_into(spark, f"{root}/hurricane_predictions", "hurricane_predictions", forecasts, "ingest_seq")
    seen, join = [], streams.join_fixes

    def counted(due, truth, tolerance_s):
        seen.append(due.count())
        return join(due, truth, tolerance_s)

    monkeypatch.setattr(streams, "join_fixes", counted)
    fixes = TABLES["hurricane_fixes"].ddl + ", ingest_seq INT"
    rows = lambda *hours: spark.createDataFrame(
        [("AL01", "ANA", hour(h), 20.0 + h, -70.0, 60.0, 990.0, "HU", n) for n, h in enumerate(hours)], fixes
    )
    want = {}
    for turn, hours in enumerate([(6, 24), (5.25, 12), (6, 24.25)]):
        folder = str(tmp_path / "landing")
        rows(*hours).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.file_stream(spark, folder, rows(0).schema)
        streams.match_tracks(stream, root, str(tmp_path / "checkpoint")).awaitTermination()
        for h in hours:
            want[h] = 20.0 + h
    got = read_table(spark, f"{root}/hurricane_outcomes", "hurricane_outcomes").collect()
    best = {}
    for h in range(48):
        near = [(abs(f - h), -f) for f in want if abs(f - h) <= 1.5]
        if near:
            best[hour(h)] = 20.0 - min(near)[1]
    assert {r["valid_at"]: r["actual_lat"] for r in got} == best and len(got) == len(best)
    assert len(seen) == 3 and max(seen) <= 16
