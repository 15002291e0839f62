import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.constants import NO_ECHO_DBZ
from skyloom.errors import InsufficientFramesError
from skyloom.functions.kernels import match_blocks, no_gaps, pixels, sample_moved
from skyloom.operators import rasters as R

T0 = dt.datetime(2026, 7, 4, 12)
SCHEMA = (
    "station string, timestamp timestamp, grid_km double, resolution_km double, latitude double,"
    " longitude double, reflectivity_dbz array<float>"
)


def blob(x0, n=60, rows=slice(20, 35), width=15, dbz=40.0):
    grid = np.full((n, n), np.nan, dtype=np.float32)
    grid[rows, x0 : x0 + width] = dbz
    return grid


def frame(grid, minutes=0, station="KOHX", grid_km=60.0, lat=36.0, lon=-87.0):
    cells = [None if np.isnan(v) else float(v) for v in grid.ravel()]
    return (station, T0 + dt.timedelta(minutes=minutes), grid_km, 1.0, lat, lon, cells)


def frames(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_grid(cells):
    n = int(len(cells) ** 0.5)
    return np.array([np.nan if v is None else v for v in cells], dtype=float).reshape(n, n)


def nowcast_of(spark, *rows, lead=5.0):
    flow = R.block_flow(R.frame_pairs(R.latest_frames(frames(spark, *rows))), 15, 8)
    return {(r["station"], r["method"]): r for r in R.nowcast(flow, lead).collect()}


def test_motion_forecast_beats_persistence_on_a_moving_blob(spark):
    got = nowcast_of(spark, frame(blob(5)), frame(blob(10), 5))
    truth = np.nan_to_num(blob(15), nan=NO_ECHO_DBZ)
    error = {m: np.abs(as_grid(r["reflectivity_dbz"]) - truth).mean() for (_, m), r in got.items()}
    assert error["optical_flow"] < 0.25 * error["persistence"]
    assert got["KOHX", "persistence"]["valid_at"] == T0 + dt.timedelta(minutes=10)


def test_persistence_is_the_latest_frame(spark):
    grid = as_grid(nowcast_of(spark, frame(blob(5)), frame(blob(10), 5))["KOHX", "persistence"]["reflectivity_dbz"])
    assert grid[25, 15] == 40.0 and grid[0, 0] == NO_ECHO_DBZ


def test_stations_do_not_mix(spark):
    got = nowcast_of(
        spark, frame(blob(5)), frame(blob(10), 5), frame(blob(20), 1, "KHPX"), frame(blob(20), 2, "KHPX"),
        frame(blob(20), 2, "LONE"),
    )
    assert {s for s, _ in got} == {"KOHX", "KHPX"}
    still = got["KHPX", "optical_flow"]["reflectivity_dbz"]
    assert still == got["KHPX", "persistence"]["reflectivity_dbz"]


def test_lead_scales_with_the_real_interval(spark):
    ten = as_grid(nowcast_of(spark, frame(blob(5)), frame(blob(10), 10))["KOHX", "optical_flow"]["reflectivity_dbz"])
    five = as_grid(nowcast_of(spark, frame(blob(5)), frame(blob(10), 5))["KOHX", "optical_flow"]["reflectivity_dbz"])
    assert np.nanargmax(five[25] > 30) - 10 == 5 and np.nanargmax(ten[25] > 0) - 10 in (2, 3)


def test_too_few_frames(spark):
    with pytest.raises(InsufficientFramesError):
        R.require_frames(frames(spark, frame(blob(5))))
    with pytest.raises(InsufficientFramesError):
        R.require_frames(frames(spark))
    R.require_frames(frames(spark, frame(blob(5)), frame(blob(6), 5)))


def test_equal_times_make_no_pair(spark):
    assert R.frame_pairs(frames(spark, frame(blob(5)))).isEmpty()
    assert R.frame_pairs(frames(spark, frame(blob(5)), frame(blob(6)))).isEmpty()


@pytest.mark.parametrize("width", [60, 600, 10**6])
def test_pairs_across_slices(spark, width):
    rows = [frame(blob(i, 20, slice(5, 9), 3), 5 * i) for i in range(12)]
    got = R.frame_pairs(frames(spark, *rows), slice_s=width).orderBy("timestamp").collect()
    assert len(got) == 11
    for i, r in enumerate(got, start=1):
        assert np.nanargmax(as_grid(r["prev_dbz"])[6] > 0) == i - 1 and r["interval_minutes"] == 5.0


def reference_match(prev, curr, block, radius):
    """Straightforward block matching over Python loops."""
    n = prev.shape[0]
    side = -(-n // block)
    fx, fy, echo = np.zeros((side, side)), np.zeros((side, side)), np.zeros((side, side), bool)
    for br in range(side):
        for bc in range(side):
            cells = [(r, c) for r in range(br * block, min(n, (br + 1) * block)) for c in range(bc * block, min(n, (bc + 1) * block))]
            echo[br, bc] = any(curr[r, c] > 0 for r, c in cells)
            best = None
            for dy in range(-radius, radius + 1):
                for dx in range(-radius, radius + 1):
                    cost = 0
                    for r, c in cells:
                        y, x = r - dy, c - dx
                        cost += abs(int(curr[r, c]) - (int(prev[y, x]) if 0 <= y < n and 0 <= x < n else 0))
                    key = (cost, dx * dx + dy * dy, dy, dx)
                    if best is None or key < best:
                        best = key
            fx[br, bc], fy[br, bc] = best[3], best[2]
    for f in (fx, fy):
        f[~echo] = f[echo].mean() if echo.any() else 0.0
    return fx.ravel(), fy.ravel()


@pytest.mark.parametrize("n, block, share", [(12, 4, 0.5), (11, 4, 0.1), (9, 3, 0.0), (10, 15, 0.3)])
def test_block_matching_equals_plain_loops(n, block, share):
    rng = np.random.default_rng(n)
    prev = (rng.integers(0, 255, (n, n)) * (rng.random((n, n)) < share)).astype(np.uint8)
    curr = np.roll(prev, 1, axis=1)
    curr[: n // 2] = 0
    got = match_blocks(prev.ravel(), curr.ravel(), block, 2)
    want = reference_match(prev, curr, block, 2)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_sampling_equals_plain_loops():
    rng = np.random.default_rng(1)
    n, block, scale = 9, 4, 1.3
    grid = rng.uniform(0, 50, n * n).astype(np.float32)
    grid[5] = np.nan
    fx, fy = rng.uniform(-3, 3, 9), rng.uniform(-3, 3, 9)
    full = no_gaps(grid).reshape(n, n)

    def read(r, c):
        return full[r, c] if 0 <= r < n and 0 <= c < n else NO_ECHO_DBZ

    want = np.zeros((n, n))
    for r in range(n):
        for c in range(n):
            b = (r // block) * 3 + c // block
            x, y = c - fx[b] * scale, r - fy[b] * scale
            x0, y0 = int(np.floor(x)), int(np.floor(y))
            wx, wy = x - x0, y - y0
            want[r, c] = (read(y0, x0) * (1 - wx) + read(y0, x0 + 1) * wx) * (1 - wy) + (
                read(y0 + 1, x0) * (1 - wx) + read(y0 + 1, x0 + 1) * wx
            ) * wy
    assert np.allclose(sample_moved(grid, fx, fy, block, scale).reshape(n, n), want, atol=1e-4)


def test_pixels_agree_with_the_column_form(spark):
    from skyloom.functions.cells import image

    grid = np.random.default_rng(2).uniform(-60, 90, (20, 20)).astype(np.float32)
    grid[3, 3] = np.nan
    (row,) = frames(spark, frame(grid)).select(image(F.col("reflectivity_dbz")).alias("p")).collect()
    assert row["p"] == [int(v) for v in pixels(grid).ravel()]


def test_scores_and_pending(spark):
    seen = frames(spark, frame(blob(20), 30))
    said = seen.select(
        (F.col("timestamp") - F.expr("INTERVAL 5 MINUTES")).alias("predicted_at"),
        (F.col("timestamp") + F.expr("INTERVAL 150 SECONDS")).alias("valid_at"),
        F.lit(5.0).alias("lead_minutes"),
        F.lit("optical_flow").alias("method"),
        "station",
        F.transform("reflectivity_dbz", lambda v: F.coalesce(v, F.lit(NO_ECHO_DBZ).cast("float"))).alias("reflectivity_dbz"),
    )
    late = said.withColumn("valid_at", F.col("valid_at") + F.expr("INTERVAL 1 SECOND"))
    (score,) = R.score_methods(R.grid_scores(said, seen)).collect()
    assert (score["n_samples"], score["mae_dbz"], score["csi"]) == (1, pytest.approx(0, abs=1e-4), 1.0)
    assert R.grid_scores(late, seen).isEmpty()
    assert R.match_grids(late, seen).filter("actual_at IS NULL").count() == 1


def test_csi_counts_hits_misses_and_false_alarms(spark):
    seen = frames(spark, frame(np.array([[30.0, 10.0], [30.0, np.nan]]), 0, grid_km=1.0))
    said = frames(spark, frame(np.array([[30.0, 30.0], [10.0, 0.0]]), 0, grid_km=1.0)).select(
        F.col("timestamp").alias("predicted_at"), F.col("timestamp").alias("valid_at"), F.lit(0.0).alias("lead_minutes"),
        F.lit("m").alias("method"), "station", "reflectivity_dbz",
    )
    (row,) = R.grid_scores(said, seen).collect()
    assert row["csi"] == pytest.approx(1 / 3) and row["mae_dbz"] == pytest.approx((0 + 20 + 20 + 32) / 4)
    calm = frames(spark, frame(np.full((2, 2), np.nan), 0, grid_km=1.0))
    quiet = said.withColumn("reflectivity_dbz", F.transform("reflectivity_dbz", lambda v: F.lit(0).cast("float")))
    assert R.grid_scores(quiet, calm).first()["csi"] == 1.0


def points(spark, *rows):
    return spark.createDataFrame(rows, "point_id int, station string, point_lat double, point_lon double")


def test_point_samples(spark):
    n, km = 101, 100.0
    grid = np.full((n, n), -32.0, dtype=np.float32)
    grid[50, 50], grid[100, 100] = 45.0, 44.0
    edge = (36.0 + km / 110.574, -87.0 + km / (111.320 * np.cos(np.radians(36.0))))
    watch = points(spark, (1, "KOHX", 36.0, -87.0), (2, "KOHX", float(edge[0]), float(edge[1])), (3, "KOHX", 41.0, -87.0))
    got = {r["point_id"]: r for r in R.point_samples(frames(spark, frame(grid, grid_km=km)), watch).collect()}
    assert got[1]["sample_dbz"] == 45.0 and got[2]["sample_dbz"] == 44.0
    assert got[3]["in_range"] is False and got[3]["sample_dbz"] is None


def test_rain_reaches_the_point(spark):
    flow = R.block_flow(R.frame_pairs(frames(spark, frame(blob(20)), frame(blob(22), 5))), 15, 8)
    watch = points(spark, (1, "KOHX", 36.0, -87.0), (2, "KOHX", 36.0 - 50 / 110.574, -87.0))
    got = {r["point_id"]: r for r in R.check_points(R.nowcast(flow, 5.0), watch).collect()}
    assert got[1]["rain_expected"] == 1 and got[1]["sample_dbz"] > 30
    assert got[2]["rain_expected"] == 0


def test_crop_box(spark):
    at = frames(spark, frame(np.full((101, 101), np.nan), grid_km=100.0))
    boxes = points(spark, (1, "KOHX", 36.0, -87.0), (2, "KOHX", 41.0, -87.0)).withColumn("radius_km", F.lit(20.0))
    got = {r["point_id"]: r for r in R.crop_bounds(at, boxes).collect()}
    box = got[1]
    assert box["row_min"] < 50 < box["row_max"] and box["col_min"] < 50 < box["col_max"]
    assert box["row_max"] - box["row_min"] == box["col_max"] - box["col_min"]
    assert got[2]["in_range"] is False
    cells = R.crop_cells(R.crop_bounds(at, boxes))
    side = box["row_max"] - box["row_min"] + 1
    assert cells.count() == side * side and cells.agg(F.min("row"), F.max("col")).first() == (box["row_min"], box["col_max"])


def test_region_has_motion_only_where_something_moves(spark):
    flow = R.block_flow(R.frame_pairs(frames(spark, frame(blob(20)), frame(blob(22), 5))), 15, 8)
    boxes = points(spark, (1, "KOHX", 36.0, -87.0)).withColumn("radius_km", F.lit(120.0))
    cells, motion = R.region_product(flow, boxes, spacing=20)
    assert cells.count() == 3600
    rows = motion.collect()
    assert rows and all(r["max_dbz"] >= 15 and r["unit_x"] == pytest.approx(1.0) and r["fx"] == pytest.approx(2.0) for r in rows)


def test_regrid_takes_the_lowest_sweep(spark):
    gates = spark.createDataFrame(
        [("KOHX", T0, 0.5, 90.0, 3.0, 30.0), ("KOHX", T0, 1.5, 90.0, 3.0, 60.0), ("KOHX", T0, 0.5, 0.0, 3.0, 20.0), ("KOHX", T0, 0.5, 0.0, 90.0, 20.0)],
        "station string, timestamp timestamp, elevation_deg double, azimuth_deg double, range_km double, dbz double",
    )
    (row,) = R.regrid_gates(gates, 4.0, 1.0).collect()
    grid = as_grid(row["reflectivity_dbz"])
    assert grid.shape == (8, 8) and np.count_nonzero(~np.isnan(grid)) == 2
    assert grid[4, 6] == 30.0 and grid[6, 4] == 20.0


def test_frames_round_trip_through_cells(spark):
    grid = np.array([[1.0, np.nan], [3.0, 4.0]], dtype=np.float32)
    cells = {(r["row"], r["col"]): r["dbz"] for r in R.frames_to_cells(frames(spark, frame(grid))).collect()}
    assert cells == {(0, 0): 1.0, (0, 1): None, (1, 0): 3.0, (1, 1): 4.0}


def _watch(spark, n=40):
    places = [(i, 36 + (i % 9 - 4) / 20, -87 + (i % 7 - 3) / 15, 4.0 + i % 3) for i in range(n)]
    spots = spark.createDataFrame(places, "point_id int, point_lat double, point_lon double, radius_km double")
    return spots.withColumn("station", F.lit("KOHX"))


def _moving(spark, n=6):
    rows = [frame(blob(4 + k, n=24, rows=slice(6, 14), width=8), 5 * k, grid_km=24.0) for k in range(n)]
    return frames(spark, *rows).coalesce(1)


@pytest.mark.parametrize("most", [None, 15])
def test_frames_beside_places_are_dealt_by_pairs_not_by_files(spark, monkeypatch, most):
    monkeypatch.setattr(R, "_TASK_PAIRS", 10)
    if most is not None:  # too many for one broadcast
        monkeypatch.setattr(R, "_BROADCAST_PLACES", most)
    grids, spots = _moving(spark), _watch(spark)
    dealt = R._beside_places(grids, spots)
    assert dealt.rdd.getNumPartitions() >= 24  # one file held them all in one task before
    assert dealt.count() == 240
    plain = grids.join(spots, "station")
    assert sorted(map(str, dealt.select(*plain.columns).drop("reflectivity_dbz").collect())) == sorted(
        map(str, plain.drop("reflectivity_dbz").collect())
    )


def test_arrays_made_once_per_frame_are_looked_up_with_the_cells(spark):
    grids = _moving(spark, 2).withColumn("_double", F.transform("reflectivity_dbz", lambda v: v * 2))
    cells = R.crop_cells(R.crop_bounds(grids, _watch(spark)), looks={"twice": "_double"})
    assert "_double" not in cells.columns
    assert cells.filter("dbz IS NOT NULL").count() > 0
    assert cells.filter("NOT (twice <=> dbz * 2)").count() == 0


def test_crops_of_a_region_are_not_shuffled(spark):
    flow = R.block_flow(R.frame_pairs(_moving(spark)), 6, 3)
    _, motion = R.region_product(flow, _watch(spark), spacing=2)
    assert motion.count() > 0
    moved = [line for line in motion._jdf.queryExecution().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in moved if "block_row" in line]


def test_quick_rounding_is_rounding(spark):
    from catalog.registry import quickly_shown, shown

    values = [None, float("nan"), float("inf"), -0.0, 5e-7, -5e-7, 1 / 128, 1.1234565, 1e13, -1e300]
    values += [k / 128 for k in range(-500, 500)] + [(2 * k + 1) * 5e-7 for k in range(3000)] + [k / 7 for k in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (3, 6):
        assert rows.filter(~shown(F.col("x"), digits).eqNullSafe(quickly_shown(F.col("x"), digits))).count() == 0


def _plainly(frames, boxes):
    """Crops and samples of every frame beside every place, place by place."""
    at = R._beside_places(frames, boxes)
    sampled = R._sample(R._spot(at.withColumn("_n", R.grid_side(F.col("reflectivity_dbz")))), "reflectivity_dbz")
    return R.crop_cells(R.crop_bounds(frames, boxes)), sampled


def _rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("most", [None, 60])
def test_places_that_see_the_same_share_the_work(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(R, "_BROADCAST_PLACES", most)
    grids, spots = _moving(spark, 2), _watch(spark, 30)
    spots = spots.withColumn("point_lat", F.round("point_lat", 1)).unionByName(spots.filter("point_id = 2"))  # one comes twice
    spots = spots.unionByName(spots.filter("point_id = 3").withColumn("point_lat", F.lit(None).cast("double")))
    # a frame of another layout, and one without a position
    grids = grids.unionByName(grids.limit(1).withColumn("latitude", F.lit(36.1)).withColumn("timestamp", F.lit(T0 - dt.timedelta(1))))
    grids = grids.unionByName(grids.limit(1).withColumn("latitude", F.lit(None).cast("double")))
    grids = spark.createDataFrame(grids.collect(), SCHEMA).coalesce(1)
    spots = spark.createDataFrame(spots.collect(), spots.schema).coalesce(1)
    cells, sampled = _plainly(grids, spots)
    ours = R.crops(grids, spots)
    assert ours.columns == cells.columns and R.point_samples(grids, spots).columns == sampled.columns
    assert _rows(ours, cells.columns) == _rows(cells, cells.columns) and cells.count() > 0
    assert _rows(R.point_samples(grids, spots), sampled.columns) == _rows(sampled, sampled.columns)
    views = R._by_view(grids, spots, R._box)
    assert views.distinct.count() < views.named.count()
    if most is not None:
        return
    # layouts as many as frames: the plain way
    wandering = grids.withColumn("latitude", F.lit(36.0) + F.unix_micros("timestamp") % 7 / 1000.0)
    monkeypatch.setattr(R, "_FEW_LAYOUTS", 0)
    assert R._by_view(wandering, spots, R._box) is None
    assert _rows(R.crops(wandering, spots), cells.columns) == _rows(_plainly(wandering, spots)[0], cells.columns)


@pytest.mark.parametrize("twice", [False, True])
def test_block_motion_of_points_that_share_a_box(spark, twice):
    flow = R.block_flow(R.frame_pairs(_moving(spark, 3)), 6, 3)
    flow = spark.createDataFrame(flow.collect(), flow.schema).coalesce(1)
    spots = _watch(spark).withColumn("point_lat", F.round("point_lat", 1))
    if twice:  # one point, two boxes: their cells are one group
        spots = spots.unionByName(spots.filter("point_id < 3").withColumn("radius_km", F.lit(9.0)))
    frames = flow.drop("prev_dbz")
    cells = R.with_cell_flow(R.crop_cells(R.crop_bounds(frames, spots)))
    want = R.block_motion(cells, ["station", "timestamp", "point_id"], 2)
    got_cells, got = R.region_product(flow, spots, 2)
    assert got.columns == want.columns and _rows(got, want.columns) == _rows(want, want.columns) and want.count() > 0
    assert got_cells.columns == cells.columns and _rows(got_cells, cells.columns) == _rows(cells, cells.columns)
    if not twice:  # grouped by what is seen, before the points
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert all("point_id" not in line for line in plan.splitlines() if "Aggregate" in line)
        assert [r["max_dbz"] for r in R.region_product(flow, spots, 2, finish=lambda b: b.withColumn("max_dbz", F.lit(1.5)))[1].take(1)] == [1.5]
