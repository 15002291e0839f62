"""Merges, nearest join, sliced windows, daily and track operators on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from skyloom.constants import DAILY_FEATURES
from skyloom.errors import NotEnoughDataError
from skyloom.operators import daily as D, forests, merge as M, tracks as K, verify as V
from skyloom.operators.nearest import nearest_join
from skyloom.operators.sliced import fill_forward, running_total_before, time_slice, with_previous

T0 = dt.datetime(2026, 1, 1)
DAILY = (
    "station_id string, date date, source string, temp_max_c double, temp_min_c double, precip_mm double,"
    " rain int, humidity_pct double, pressure_hpa double, wind_speed_kmh double"
)
D1, D2, D3 = (dt.date(2026, 1, d) for d in (1, 2, 3))


def days(spark, *rows):
    return spark.createDataFrame(rows, DAILY)


def arriving(spark, *rows):
    return spark.createDataFrame(rows, DAILY + ", ingest_seq long")


def by_date(df):
    return {r["date"]: r for r in df.collect()}


# --- merges --------------------------------------------------------------------------------------


def test_authority_overwrites_its_columns_with_nulls_but_not_the_enrichment(spark):
    stored = days(spark, ("A", D1, "metar_live", 1.0, 0.0, 2.0, 1, 50.0, 1000.0, 9.0))
    new = arriving(spark, ("A", D1, "ghcnd", 5.0, None, None, 0, 1.0, 1.0, 1.0, 0), ("A", D2, "ghcnd", 6.0, 2.0, 0.0, 0, 1.0, 1.0, 1.0, 1))
    got = by_date(M.merge_authoritative(stored, new))
    assert tuple(got[D1])[2:] == ("ghcnd", 5.0, None, None, 0, 50.0, 1000.0, 9.0, "update", 1)
    assert tuple(got[D2])[2:] == ("ghcnd", 6.0, 2.0, 0.0, 0, None, None, None, "insert", 1)


def test_gapfill_respects_the_authority_and_keeps_the_source(spark):
    stored = days(
        spark,
        ("A", D1, "ghcnd", 1.0, 0.0, 2.0, 1, None, None, None),
        ("A", D2, "lcd", None, None, None, None, 40.0, 1001.0, 3.0),
    )
    new = arriving(spark, *[("A", d, "metar_live", 9.0, 8.0, 0.0, 0, 1.0, 1.0, 1.0, i) for i, d in enumerate((D1, D2, D3))])
    merged = M.merge_gapfill(stored, new)
    got = by_date(merged)
    assert tuple(got[D1])[2:8] == ("ghcnd", 1.0, 0.0, 2.0, 1, None) and got[D1]["_action"] == "skip"
    assert tuple(got[D2])[2:8] == ("lcd", 9.0, 8.0, 0.0, 0, 40.0) and got[D2]["_action"] == "update"
    assert tuple(got[D3])[2:8] == ("metar_live", 9.0, 8.0, 0.0, 0, None) and got[D3]["_action"] == "insert"
    counts = {r["_action"]: r["n_records"] for r in M.merge_counts(merged).collect()}
    assert counts == {"skip": 1, "update": 1, "insert": 1}


def test_enrichment_fills_its_columns_and_adds_bare_rows(spark):
    stored = days(spark, ("A", D1, "ghcnd", 1.0, 0.0, 2.0, 1, 55.0, 1010.0, 7.0))
    new = arriving(spark, *[("A", d, "x", 9.0, 9.0, 9.0, 1, None, 1005.0, 2.0, 0) for d in (D1, D2)])
    got = by_date(M.merge_enrichment(stored, new))
    assert tuple(got[D1])[2:10] == ("ghcnd", 1.0, 0.0, 2.0, 1, None, 1005.0, 2.0)
    assert tuple(got[D2])[2:10] == ("lcd", None, None, None, None, None, 1005.0, 2.0)


def test_repeats_in_a_batch_follow_arrival_order(spark):
    stored = days(spark)
    new = arriving(
        spark,
        ("A", D1, "late", 2.0, None, None, 0, None, None, None, 7),
        ("A", D1, "early", 1.0, None, None, 0, None, None, None, 3),
    )
    assert by_date(M.merge_ignore(stored, new, M.DAILY_KEYS, "ingest_seq"))[D1]["source"] == "early"
    replaced = by_date(M.insert_or_replace(stored, new, M.DAILY_KEYS, "ingest_seq"))[D1]
    assert replaced["source"] == "late" and replaced["_records"] == 2
    filled = by_date(M.merge_gapfill(stored, new))[D1]
    assert filled["source"] == "early" and filled["temp_max_c"] == 2.0


def test_stored_row_wins_over_an_ignored_one(spark):
    stored = days(spark, ("A", D1, "old", 1.0, 0.0, 2.0, 1, None, None, None))
    new = arriving(spark, ("A", D1, "new", 2.0, None, None, 0, None, None, None, 7))
    assert M.merge_ignore(stored, new, M.DAILY_KEYS, "ingest_seq").count() == 0


# --- sliced windows: one hot entity, slices of every width ---------------------------------------


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(5)
    rows, seen = [], set()
    for i in range(600):
        entity = "hot" if rng.random() < 0.5 else f"e{rng.randrange(20)}"
        at = T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 20))
        if (entity, at) not in seen:
            seen.add((entity, at))
            rows.append((entity, at, float(i), None if rng.random() < 0.7 else f"h{i}"))
    return spark.createDataFrame(rows, "entity string, at timestamp, v double, mark string").cache()


@pytest.mark.parametrize("width", [60, 3600, 86400 * 3, 10**9])
def test_sliced_results_equal_plain_windows(spark, walk, width):
    w = Window.partitionBy("entity").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = walk.select(
        "entity",
        "at",
        F.lag("v").over(w).alias("pv"),
        F.lag("mark").over(w).alias("pm"),
        F.min("at").over(Window.partitionBy("entity")).alias("born"),
        F.last("mark", ignorenulls=True).over(upto).alias("head"),
        F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("below"),
    )
    cut = time_slice(F.col("at"), width)
    prev = with_previous(walk, ["entity"], "at", ["v", "mark"], cut, first="born").select(
        "entity", "at", F.col("prev_v").alias("pv"), F.col("prev_mark").alias("pm"), "born"
    )
    head = fill_forward(walk, ["entity"], "at", "mark", cut, "head").select("entity", "at", "head")
    total = running_total_before(walk, ["entity"], "at", "v", cut, "below").select("entity", "at", "below")
    got = prev.join(head, ["entity", "at"]).join(total, ["entity", "at"]).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


# --- nearest join ------------------------------------------------------------------------------------


def brute(left, right, tolerance, tie):
    out = {}
    for i, (who, t) in enumerate(left):
        best = None
        for other, s in sorted(right, key=lambda r: r[1], reverse=tie == "later"):
            gap = abs((s - t).total_seconds())
            if other == who and gap <= tolerance and (best is None or gap < best[0]):
                best = (gap, s)
        out[i] = best[1] if best else None
    return out


@pytest.mark.parametrize("tie", ["earlier", "later"])
@pytest.mark.parametrize("slices", [1, 3, 50])
def test_nearest_join_equals_brute_force(spark, tie, slices):
    rng = random.Random(slices)
    names = ["hot"] * 5 + ["a", "b", "c"]
    moment = lambda: dt.datetime(1969, 12, 30) + dt.timedelta(minutes=10 * rng.randrange(600))
    left = [(rng.choice(names), moment()) for _ in range(250)]
    right = sorted({(rng.choice(names), moment()) for _ in range(250)})
    l_df = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "i int, who string, t timestamp")
    r_df = spark.createDataFrame(right, "who string, s timestamp")
    got = nearest_join(l_df, r_df, ["who"], "t", "s", 1800, ["s"], tie, slice_s=1800 * slices)
    assert {r["i"]: r["s"] for r in got.collect()} == brute(left, right, 1800, tie)


def test_nearest_join_forms_no_pairs(spark):
    df = spark.sql("SELECT 'a' AS who, timestamp'2026-01-01' AS t")
    other = df.withColumnRenamed("t", "s")
    plan = nearest_join(df, other, ["who"], "t", "s", 60, ["s"])._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Physical Plan ==")[1]


def test_nearest_join_sorts_once_and_carries_what_is_read(spark):
    left = spark.range(9).selectExpr("'a' AS who", "timestamp_seconds(id) AS t", "concat('not ', id, ' read') AS unread", "id")
    right = left.selectExpr("who", "t AS s", "id AS n")
    got = nearest_join(left, right, ["who"], "t", "s", 60, ["s", "n"])
    narrow = got.select("id", "n")._jdf.queryExecution()
    assert narrow.executedPlan().toString().count("Sort [") == 1
    assert "not " not in narrow.optimizedPlan().toString()
    assert {(r["id"], r["n"], r["unread"]) for r in got.collect()} == {(i, i, f"not {i} read") for i in range(9)}


def test_nearest_join_of_unknown_times_and_keys_named_like_its_helpers(spark):
    left = spark.sql("SELECT 'a' AS _slice, CAST(NULL AS timestamp) AS _t, 1 AS _side UNION ALL SELECT 'a', timestamp'2026-01-01', 2")
    right = spark.sql("SELECT 'a' AS _slice, timestamp'2026-01-01 00:00:30' AS s, CAST(NULL AS int) AS v")
    got = nearest_join(left, right, ["_slice"], "_t", "s", 60, ["s", "v"])
    assert got.columns == ["_slice", "_t", "_side", "s", "v"]
    assert sorted((r["_side"], r["s"] is None, r["v"]) for r in got.collect()) == [(1, True, None), (2, False, None)]


def test_wide_targets_bring_narrow_rows_together(spark):
    long = spark.sql("SELECT 'A' AS storm_id, timestamp'2026-01-01' AS timestamp, 12 AS horizon_hours, 1.0D AS lat_target, 2.0D AS lon_target, 3.0D AS wind_target")
    wide = K.wide_targets(long.repartition(3))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.rindex("HashAggregate")
    assert (wide.first()["lat_h12"], wide.first()["wind_h72"]) == (1.0, None)


def test_nearest_join_rejects_bad_arguments(spark):
    df = spark.sql("SELECT 'a' AS who, timestamp'2026-01-01' AS t")
    other = df.withColumnRenamed("t", "s")
    with pytest.raises(ValueError):
        nearest_join(df, other, ["who"], "t", "s", 60, ["s"], tie="both")
    with pytest.raises(ValueError):
        nearest_join(df, other, ["who"], "t", "s", 60, ["s"], slice_s=30)


# --- daily track ----------------------------------------------------------------------------------------


def history(spark, n=40, seed=0, gap=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i == gap:
            continue
        high = rng.uniform(5, 25)
        rain = rng.random() < 0.3
        rows.append(
            ("A", D1 + dt.timedelta(days=i), "ghcnd", high, high - rng.uniform(3, 10), rng.uniform(1, 10) if rain else 0.0,
             int(rain), rng.uniform(30, 90), rng.uniform(1003, 1023), rng.uniform(0, 20))
        )
    return days(spark, *rows)


@pytest.mark.parametrize("h", [1, 2, 3])
def test_labelled_rows(spark, h):
    features = D.daily_features(history(spark))
    assert features.count() == 40
    assert D.training_frame(features, h).count() == 40 - 1 - h


def test_features_of_the_first_rows(spark):
    rows = D.daily_features(history(spark)).orderBy("date").collect()
    assert rows[0]["rain_yesterday"] is None and rows[0]["temp_max_3d_mean_c"] == rows[0]["temp_max_c"]
    assert rows[2]["temp_max_3d_mean_c"] == pytest.approx(sum(r["temp_max_c"] for r in rows[:3]) / 3)
    assert rows[9]["precip_7d_mean_mm"] == pytest.approx(sum(r["precip_mm"] for r in rows[3:10]) / 7)


def test_row_targets_skip_a_gap_and_calendar_targets_do_not(spark):
    features = D.daily_features(history(spark, gap=5))
    day4 = D1 + dt.timedelta(days=4)
    rows = {r["date"]: r for r in D.daily_targets(features, (1,)).collect()}
    assert rows[day4]["temp_max_h1"] == rows[day4 + dt.timedelta(days=2)]["temp_max_c"]
    exact = {r["date"]: r for r in D.daily_targets(features, (1, 2), calendar=True).collect()}
    assert exact[day4]["temp_max_h1"] is None
    assert exact[day4]["temp_max_h2"] == exact[day4 + dt.timedelta(days=2)]["temp_max_c"]


def test_repeated_days_keep_the_last(spark):
    twice = history(spark).withColumn("seq", F.lit(1)).unionByName(
        history(spark).withColumn("temp_max_c", F.lit(99.0)).withColumn("seq", F.lit(2))
    )
    rows = D.daily_features(twice, seq="seq")
    assert rows.count() == 40 and rows.filter("temp_max_c <> 99").isEmpty()


def test_latest_row_is_complete(spark):
    rows = history(spark).withColumn(
        "pressure_hpa", F.when(F.col("date") < dt.date(2026, 2, 8), F.col("pressure_hpa"))
    )
    (row,) = D.latest_features(D.daily_features(rows)).collect()
    assert row["date"] == dt.date(2026, 2, 7)


def test_split_takes_the_last_fifth_of_each_station(spark):
    frame = D.training_frame(D.daily_features(history(spark)), 1)
    rows = D.chrono_split(frame).orderBy("date").collect()
    flags = [r["is_test"] for r in rows]
    assert flags == [False] * (38 - 7) + [True] * 7
    tiny = D.chrono_split(frame.limit(3))
    assert tiny.filter("is_test").count() == 1


def test_live_aggregate(spark):
    rng = random.Random(1)
    rows = [
        ("TEST", T0 + dt.timedelta(hours=3 * i), rng.uniform(5, 15), rng.choice([0.0, 2.0, None]), rng.uniform(30, 90),
         rng.uniform(100300, 102300), rng.uniform(0, 20))
        for i in range(16)
    ]
    obs = spark.createDataFrame(
        rows,
        "station_id string, timestamp timestamp, temperature_c double, precip_last_hour_mm double,"
        " relative_humidity_pct double, barometric_pressure_pa double, wind_speed_kmh double",
    )
    got = D.live_daily(obs).collect()
    assert len(got) >= 2
    assert all(r["source"] == "metar_live" and 900 < r["pressure_hpa"] < 1100 and r["precip_mm"] is not None for r in got)


# --- scores ------------------------------------------------------------------------------------------------


def test_scored_and_pending_days(spark):
    daily = days(spark, ("A", D2, "ghcnd", 20.0, 10.0, 0.0, 0, None, None, None), ("A", D3, "lcd", None, None, None, None, 1.0, 1.0, 1.0))
    preds = spark.createDataFrame(
        [("A", D1, 1, D2, 0.2, 0, 22.0, 9.0, "v1"), ("A", D1, 2, D3, 0.6, 1, 21.0, 9.0, "v1"), ("A", D1, 3, dt.date(2026, 1, 4), 0.6, 1, 21.0, 9.0, "v1")],
        "station_id string, predicted_date date, horizon_days int, target_date date, rain_probability double,"
        " rain_predicted int, temp_max_pred_c double, temp_min_pred_c double, model_trained_at string",
    )
    rows = {r["horizon_days"]: r for r in V.score_days(V.join_outcomes(preds, daily)).collect()}
    assert (rows[1]["n_samples"], rows[1]["rain_accuracy"], rows[1]["temp_max_mae"], rows[1]["temp_min_mae"]) == (1, 1.0, 2.0, 1.0)
    assert rows[1]["rain_brier"] == pytest.approx(0.04)
    assert [rows[h]["n_pending"] for h in (1, 2, 3)] == [0, 1, 1]


def test_auc_equals_pair_counting(spark):
    rng = random.Random(3)
    rows = [("g", rng.randrange(2), rng.randrange(20) / 20) for _ in range(200)] + [("one", 1, 0.3), ("one", 1, 0.9)]
    got = {r["g"]: r["roc_auc"] for r in V.roc_auc(spark.createDataFrame(rows, "g string, y int, s double"), ["g"], "y", F.col("s")).collect()}
    pos = [s for g, y, s in rows if g == "g" and y == 1]
    neg = [s for g, y, s in rows if g == "g" and y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["g"] == pytest.approx(wins / len(pos) / len(neg)) and got["one"] is None


# --- storm track ---------------------------------------------------------------------------------------------

FIX = "storm_id string, name string, timestamp timestamp, lat double, lon double, max_wind_kt double, min_pressure_mb double, status string"


def fix(storm, hours, lat=25.0, lon=-70.0, wind=50.0, start=T0):
    return (storm, "X", start + dt.timedelta(hours=hours), lat, lon, wind, 1000.0, "TS")


def test_motion_due_west(spark):
    rows = K.storm_motion(spark.createDataFrame([fix("S", 0), fix("S", 6, lon=-71.0)], FIX)).orderBy("timestamp").collect()
    assert rows[0]["motion_speed_kmh"] is None and rows[0]["storm_age_hours"] == 0.0
    assert rows[1]["storm_age_hours"] == 6.0 and rows[1]["motion_bearing_sin"] == pytest.approx(-1.0, abs=0.01)
    assert rows[1]["motion_speed_kmh"] == pytest.approx(100.8 / 6, rel=0.01)


def test_targets_at_irregular_cadence(spark):
    fixes = spark.createDataFrame([fix("S", h, lat=20.0 + i) for i, h in enumerate((0, 6, 9, 12, 24))], FIX)
    got = {r["timestamp"]: r for r in K.track_targets(fixes, fixes, (24,)).collect()}
    assert got[T0]["lat_target"] == 24.0
    assert got[T0 + dt.timedelta(hours=6)]["lat_target"] is None


def test_labelled_fixes(spark):
    fixes = spark.createDataFrame([fix("S", h, lon=-70.0 - h) for h in (0, 6, 12)], FIX)
    assert K.track_training(K.storm_motion(fixes), fixes, (6,)).count() == 1


def test_later_fix_wins_a_tie_when_scoring(spark):
    fixes = spark.createDataFrame([fix("S", 11, wind=10.0), fix("S", 13, wind=20.0)], FIX)
    preds = spark.createDataFrame(
        [(T0, "S", 12, T0 + dt.timedelta(hours=12), 25.0, -70.0, 15.0, "m"), (T0, "s", 12, T0 + dt.timedelta(hours=12), 25.0, -70.0, 15.0, "m")],
        "predicted_at timestamp, storm_id string, horizon_hours int, valid_at timestamp, lat_pred double, lon_pred double, wind_pred_kt double, model_trained_at string",
    )
    joined = V.join_fixes(preds, fixes)
    assert joined.filter("storm_id = 'S'").first()["actual_wind_kt"] == 20.0
    (score,) = V.score_tracks(joined).collect()
    assert (score["n_samples"], score["n_pending"], score["track_error_km"], score["wind_mae_kt"]) == (1, 1, 0.0, 5.0)


def test_live_rows_with_missing_values(spark):
    storms = spark.sql(
        """SELECT 'al012026' id, 'A' name, 'TS' classification, 20D lat, -60D lon, CAST(NULL AS DOUBLE) intensity_kt, 0D pressure_mb,
           CAST(NULL AS DOUBLE) movement_dir_deg, CAST(NULL AS DOUBLE) movement_speed_mph, '2026-08-01T00:00:00Z' last_update
           UNION ALL SELECT 'al02', 'B', 'TS', NULL, -60D, 1D, 1D, 1D, 1D, '2026-08-01T00:00:00Z'
           UNION ALL SELECT 'al03', 'C', 'TS', 1D, -60D, 1D, 1D, 1D, 1D, ''"""
    )
    live, rejects = K.live_features(storms)
    (row,) = live.collect()
    assert (row["storm_id"], row["max_wind_kt"], row["min_pressure_mb"], row["motion_speed_kmh"]) == ("AL012026", 0.0, 1010.0, 0.0)
    assert {r["id"] for r in rejects.collect()} == {"al02", "al03"}


def curving(spark):
    """Storms that turn steadily: a straight line must lose against a fitted model."""
    import math

    rng, rows = random.Random(0), []
    for year in range(2010, 2025):
        for s in range(3):
            lat, lon, course = rng.uniform(15, 20), rng.uniform(-60, -50), rng.uniform(270, 300)
            for i in range(16):
                rows.append(fix(f"AL{s:02d}{year}", 6 * i, lat, lon, 40.0 + 2 * i, dt.datetime(year, 8, 1)))
                lat += 1.2 * math.cos(math.radians(course))
                lon += 1.2 * math.sin(math.radians(course))
                course += 15
    return spark.createDataFrame(rows, FIX)


def test_track_forest_beats_the_straight_line_on_curving_storms(spark):
    fixes = curving(spark)
    bundle, holdout = forests.fit_tracks(K.storm_motion(fixes), fixes, "v1", horizons=(12, 48), minimum=50, trees=20)
    for row in forests.holdout_tracks(holdout).collect():
        assert row["track_error_km"] < row["track_baseline_error_km"]
        assert row["n_test"] > 0
    assert bundle.horizons == [12, 48]


def test_too_little_history_is_an_error(spark):
    fixes = spark.createDataFrame([fix("S", h, lon=-70.0 - h) for h in (0, 6, 12)], FIX)
    with pytest.raises(NotEnoughDataError):
        forests.fit_tracks(K.storm_motion(fixes), fixes, "v1", horizons=(6,))
    with pytest.raises(NotEnoughDataError):
        forests.fit_days(D.daily_features(history(spark, n=10)), "v1", horizons=(1,))


def test_one_class_history_gives_a_constant_forecast(spark):
    dry = history(spark).withColumn("rain", F.lit(0)).withColumn("precip_mm", F.lit(0.0))
    features = D.daily_features(dry)
    _, holdout = forests.fit_days(features, "v1", horizons=(1,), trees=3, targets=("rain",))
    assert {r["rain_probability"] for r in holdout.collect()} == {0.0}


def test_features_need_one_exchange(spark):
    plan = D.daily_features(history(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert set(DAILY_FEATURES) <= set(D.daily_features(history(spark)).columns)


def test_forests_keep_node_numbers_and_grow_many_nodes_at_a_time():
    from skyloom.operators import forests as M

    # without these a forest's work grows with the square of its trees
    assert M._COMMON["cacheNodeIds"] and M._COMMON["maxMemoryInMB"] >= 512
    assert (M.TRACK_FOREST["numTrees"], M.TEMP_FOREST["numTrees"], M.RAIN_FOREST["numTrees"]) == (300, 200, 200)


def test_forests_over_many_rows_are_grown_in_parts():
    from skyloom.operators import forests as M

    assert M.tree_counts(300, 47_610) == [300]
    for n in (468_060, 2_808_360, 10**9):
        counts = M.tree_counts(300, n)
        assert sum(counts) == 300 and min(counts) >= 2
        assert max(counts) * n <= 1.2 * M._FIT_PAIRS or max(counts) <= 3
    assert M.tree_counts(3, 10**9) == [3]
    # statistics of all nodes are shuffled by every partition
    assert M._partitions(468_060) == 2 and M._partitions(0) == 1


def test_values_of_forests_in_parts_equal_mllib(spark, monkeypatch, tmp_path):
    from skyloom.operators import forests as M

    rng = random.Random(1)
    rows = [(rng.uniform(0, 9), rng.uniform(-5, 5), float(rng.randint(0, 3))) for _ in range(600)]
    train = spark.createDataFrame([(a, b, c, a * b + c) for a, b, c in rows], "a double, b double, c double, y double").coalesce(2).persist()
    size = {"numTrees": 7, "maxDepth": 6, "minInstancesPerNode": 2}
    monkeypatch.setattr(M, "_FIT_PAIRS", 600 * 3)
    fits = M.value_fits(train, 600, ["a", "b", "c"], "y", size)
    assert len(fits) == 3
    model = M._fit_all({(1, "y"): fits})[1, "y"]
    whole = M.fit_value(train, ["a", "b", "c"], "y", size)
    M.save_bundle(spark, M.Bundle("v1", {(1, "y"): model}), str(tmp_path))
    loaded = M.load_bundle(spark, str(tmp_path)).models[1, "y"]
    for one, trees, exact in ((model, 7, 1e-9), (loaded, 7, 1e-9), (whole, 7, 0.0)):
        forests_in = [s for s in one.stages if hasattr(s, "getNumTrees")]
        assert sum(f.getNumTrees for f in forests_in) == trees
        seen = M.apply_value(one, one.transform(train), "said").collect()
        assert max(abs(r["said"] - r["prediction"]) for r in seen) <= exact
        assert "_part_0" not in M.apply_value(one, train, "said").columns
    with pytest.raises(Exception, match="unknown"):
        M.apply_value(model, spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double"), "said").collect()


def test_live_storms_are_read_once_for_all_horizons(spark):
    from skyloom.operators import forests as M

    fixes = curving(spark)
    bundle, _ = M.fit_tracks(K.storm_motion(fixes), fixes, "v1", horizons=(12, 48), minimum=50, trees=4)
    live = K.storm_motion(fixes).na.drop().limit(5)
    live = spark.createDataFrame(live.collect(), live.schema).withColumn("name", F.col("storm_id"))
    said = M.forecast_storms(bundle, live)
    assert said._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    rows = said.collect()
    assert len(rows) == 10 and {r["horizon_hours"] for r in rows} == {12, 48}
    want = {
        (h, r["storm_id"], r["timestamp"]): r["prediction"]
        for h in (12, 48) for r in bundle.models[h, "lat"].transform(live).collect()
    }
    assert all(abs(want[r["horizon_hours"], r["storm_id"], r["predicted_at"]] - r["lat_pred"]) < 1e-9 for r in rows)
