"""Radar grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.carrier_sql import micros, r6, with_ctes
from catalog.carriers import c_frames, c_points, load
from catalog.registry import present, query, quickly_shown, shown
from skyloom.constants import DBZ_CLASS_COLOURS
from skyloom.functions.cells import dbz_class, filled_grid, image
from skyloom.operators import rasters as R

BLOCK, RADIUS, LEAD = 4, 2, 30.0

# --- S10, K1, W12 -------------------------------------------------------------------------


@query(
    "q_frame_cells",
    with_ctes(
        "cells",
        f"""SELECT station, {micros('timestamp')} AS timestamp, CAST(n AS BIGINT) AS n, CAST(row AS BIGINT) AS row,
  CAST(col AS BIGINT) AS col, {r6('CAST(dbz AS DOUBLE)')} AS dbz FROM c_cells""",
    ),
)
def q_frame_cells(spark, sf_dir):
    cells = R.frames_to_cells(c_frames(spark, sf_dir))
    return present(cells.select("station", "timestamp", "n", "row", "col", "dbz"))


_LATEST = """latest AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY timestamp DESC) AS recency FROM c_frames
  QUALIFY row_number() OVER (PARTITION BY station ORDER BY timestamp DESC) <= 2
    AND count(*) OVER (PARTITION BY station) >= 2)"""


@query(
    "q_latest_frames",
    with_ctes(
        "frames cells",
        _LATEST,
        f"""SELECT l.station, {micros('l.timestamp')} AS timestamp, CAST(l.recency AS BIGINT) AS recency,
  CAST(c.row AS BIGINT) AS row, CAST(c.col AS BIGINT) AS col, {r6('CAST(c.dbz AS DOUBLE)')} AS dbz
FROM latest l JOIN c_cells c ON c.station = l.station AND c.timestamp = l.timestamp""",
    ),
)
def q_latest_frames(spark, sf_dir):
    cells = R.frames_to_cells(R.latest_frames(c_frames(spark, sf_dir), 2))
    return present(cells.select("station", "timestamp", "recency", "row", "col", "dbz"))


_PAIRS = """pairs AS (SELECT * FROM (
  SELECT *, lag(timestamp) OVER (PARTITION BY station ORDER BY timestamp) AS prev_timestamp,
    (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY station ORDER BY timestamp)) / CAST(60000000 AS DOUBLE) AS interval_minutes
  FROM c_frames) WHERE interval_minutes > 0)"""


@query(
    "q_frame_pairs",
    with_ctes(
        "frames cells",
        _PAIRS,
        f"""SELECT p.station, {micros('p.timestamp')} AS timestamp, {micros('p.prev_timestamp')} AS prev_timestamp,
  {r6('p.interval_minutes')} AS interval_minutes, CAST(c.row * 8 + c.col AS BIGINT) AS cell,
  {r6('CAST(c.dbz AS DOUBLE)')} AS dbz, {r6('CAST(o.dbz AS DOUBLE)')} AS prev_dbz
FROM pairs p JOIN c_cells c ON c.station = p.station AND c.timestamp = p.timestamp
JOIN c_cells o ON o.station = p.station AND o.timestamp = p.prev_timestamp AND o.row = c.row AND o.col = c.col""",
    ),
)
def q_frame_pairs(spark, sf_dir):
    pairs = R.frame_pairs(c_frames(spark, sf_dir))
    cells = pairs.select(
        "station",
        "timestamp",
        "prev_timestamp",
        "interval_minutes",
        "prev_dbz",
        F.posexplode("reflectivity_dbz").alias("cell", "dbz"),
    )
    return present(cells.withColumn("prev_dbz", F.get("prev_dbz", "cell")))


# --- F10, F11, F9 ---------------------------------------------------------------------------

_FLOAT = "CAST({} AS FLOAT)"
_FILLED = "coalesce({}, CAST(-32 AS FLOAT))"


def _pixel(dbz):
    clipped = f"greatest(CAST(-30 AS FLOAT), least(CAST(70 AS FLOAT), {_FILLED.format(dbz)}))"
    share = f"CAST(CAST({clipped} - CAST(-30 AS FLOAT) AS DOUBLE) / 100 AS FLOAT)"
    return f"CAST(trunc({share} * CAST(255 AS FLOAT)) AS INTEGER)"


@query(
    "q_grid_image",
    with_ctes(
        "cells",
        f"""SELECT station, {micros('timestamp')} AS timestamp, CAST(row * 8 + col AS BIGINT) AS cell,
  CAST({_pixel('dbz')} AS BIGINT) AS pixel, {r6(f"CAST({_FILLED.format('dbz')} AS DOUBLE)")} AS filled FROM c_cells""",
    ),
)
def q_grid_image(spark, sf_dir):
    frames = c_frames(spark, sf_dir).select(
        "station",
        "timestamp",
        filled_grid(F.col("reflectivity_dbz")).alias("filled"),
        F.posexplode(image(F.col("reflectivity_dbz"))).alias("cell", "pixel"),
    )
    return present(frames.withColumn("filled", F.get("filled", "cell")))


_CLASS = """CASE WHEN {0} IS NULL OR {0} < 5 THEN 0 WHEN {0} < 20 THEN 1 WHEN {0} < 30 THEN 2
    WHEN {0} < 40 THEN 3 WHEN {0} < 50 THEN 4 ELSE 5 END"""


@query(
    "q_dbz_classes",
    with_ctes(
        "cells",
        f"""SELECT station, CAST({_CLASS.format('dbz')} AS BIGINT) AS dbz_class,
  [{', '.join(f"'{c}'" for c in DBZ_CLASS_COLOURS)}][{_CLASS.format('dbz')} + 1] AS colour,
  CAST(count(*) AS BIGINT) AS n_cells FROM c_cells GROUP BY 1, 2, 3""",
    ),
)
def q_dbz_classes(spark, sf_dir):
    cells = R.frames_to_cells(c_frames(spark, sf_dir))
    classes = cells.groupBy("station", dbz_class(F.col("dbz")).alias("dbz_class")).agg(
        F.count(F.lit(1)).alias("n_cells")
    )
    colours = F.array(*[F.lit(c) for c in DBZ_CLASS_COLOURS])
    return present(classes.withColumn("colour", F.get(colours, F.col("dbz_class"))))


# --- G2 ---------------------------------------------------------------------------------------

_FLOW = (
    _PAIRS,
    f"pix AS (SELECT station, timestamp, row, col, {_pixel('dbz')} AS p FROM c_cells)",
    f"""shifts AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT unnest(range(-{RADIUS}, {RADIUS} + 1)) AS d) a,
  (SELECT unnest(range(-{RADIUS}, {RADIUS} + 1)) AS d) b)""",
    f"""costs AS (SELECT q.station, q.timestamp, c.row // {BLOCK} AS br, c.col // {BLOCK} AS bc, s.dx, s.dy,
    sum(abs(c.p - coalesce(o.p, 0))) AS cost
  FROM pairs q JOIN pix c ON c.station = q.station AND c.timestamp = q.timestamp CROSS JOIN shifts s
  LEFT JOIN pix o ON o.station = q.station AND o.timestamp = q.prev_timestamp
    AND o.row = c.row - s.dy AND o.col = c.col - s.dx
  GROUP BY ALL)""",
    """matched AS (SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY station, costs.timestamp, br, bc
    ORDER BY cost, dx * dx + dy * dy, dy, dx) = 1)""",
    f"""echo AS (SELECT station, timestamp, row // {BLOCK} AS br, col // {BLOCK} AS bc, sum(p) > 0 AS has_echo
  FROM pix GROUP BY ALL)""",
    """flow AS (SELECT m.station, m.timestamp, m.br, m.bc,
    CASE WHEN e.has_echo THEN CAST(m.dx AS DOUBLE)
      ELSE coalesce(avg(m.dx) FILTER (WHERE e.has_echo) OVER (PARTITION BY m.station, m.timestamp), 0) END AS fx,
    CASE WHEN e.has_echo THEN CAST(m.dy AS DOUBLE)
      ELSE coalesce(avg(m.dy) FILTER (WHERE e.has_echo) OVER (PARTITION BY m.station, m.timestamp), 0) END AS fy
  FROM matched m JOIN echo e USING (station, timestamp, br, bc))""",
)


def flow_frames(spark, sf_dir, frames=None):
    frames = c_frames(spark, sf_dir) if frames is None else frames
    return R.block_flow(R.frame_pairs(frames), BLOCK, RADIUS)


@query(
    "q_block_flow",
    with_ctes(
        "frames cells",
        *_FLOW,
        f"""SELECT station, {micros('f.timestamp')} AS timestamp, {r6('interval_minutes')} AS interval_minutes,
  CAST(br * 2 + bc AS BIGINT) AS block_no, {r6('fx')} AS flow_x, {r6('fy')} AS flow_y
FROM flow f JOIN pairs USING (station, timestamp)""",
    ),
)
def q_block_flow(spark, sf_dir):
    return present(R.flow_to_blocks(flow_frames(spark, sf_dir)))


# --- G1, G3, G4 -------------------------------------------------------------------------------


def _corner(dr, dc):
    return (
        f"LEFT JOIN c_cells n{dr}{dc} ON n{dr}{dc}.station = t.station AND n{dr}{dc}.timestamp = t.timestamp"
        f" AND n{dr}{dc}.row = t.y0 + {dr} AND n{dr}{dc}.col = t.x0 + {dc}"
    )


def _v(dr, dc):
    return f"coalesce(CAST(n{dr}{dc}.dbz AS DOUBLE), CAST(-32 AS DOUBLE))"


_MOVED = f"""taps AS (SELECT *, floor(x) AS x0, floor(y) AS y0, x - floor(x) AS wx, y - floor(y) AS wy FROM (
  SELECT c.station, c.timestamp, c.row, c.col, c.dbz, c.col - f.fx * (CAST({LEAD} AS DOUBLE) / q.interval_minutes) AS x,
    c.row - f.fy * (CAST({LEAD} AS DOUBLE) / q.interval_minutes) AS y
  FROM c_cells c JOIN pairs q ON q.station = c.station AND q.timestamp = c.timestamp
  JOIN flow f ON f.station = c.station AND f.timestamp = c.timestamp
    AND f.br = c.row // {BLOCK} AND f.bc = c.col // {BLOCK})),
moved AS (SELECT t.station, t.timestamp, t.row, t.col, t.dbz,
    CAST(({_v(0, 0)} * (1 - wx) + {_v(0, 1)} * wx) * (1 - wy) + ({_v(1, 0)} * (1 - wx) + {_v(1, 1)} * wx) * wy AS FLOAT) AS p
  FROM taps t {_corner(0, 0)} {_corner(0, 1)} {_corner(1, 0)} {_corner(1, 1)})"""


@query(
    "q_advect",
    with_ctes(
        "frames cells",
        *_FLOW,
        _MOVED,
        f"""SELECT station, {micros('timestamp')} AS timestamp, CAST(row * 8 + col AS BIGINT) AS cell,
  round(CAST(p AS DOUBLE), 4) + 0.0 AS moved FROM moved""",
    ),
)
def q_advect(spark, sf_dir):
    moved = R.advect(flow_frames(spark, sf_dir), F.lit(LEAD) / F.col("interval_minutes"), "moved")
    cells = moved.select("station", "timestamp", F.posexplode("moved").alias("cell", "moved"))
    return present(cells, moved=4)


_NOWCAST = (
    *_FLOW,
    _MOVED,
    f"""nowcasts AS (
  SELECT station, timestamp AS predicted_at, timestamp + INTERVAL 30 MINUTE AS valid_at, 'optical_flow' AS method, row, col, p FROM moved
  UNION ALL
  SELECT station, timestamp, timestamp + INTERVAL 30 MINUTE, 'persistence', row, col, {_FILLED.format('dbz')} FROM moved)""",
)


@query(
    "q_nowcast_rows",
    with_ctes(
        "frames cells",
        *_NOWCAST,
        f"""SELECT station, {micros('predicted_at')} AS predicted_at, {micros('valid_at')} AS valid_at, CAST({LEAD} AS DOUBLE) AS lead_minutes,
  method, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(*) FILTER (WHERE p >= 20) AS BIGINT) AS n_rain,
  round(max(CAST(p AS DOUBLE)), 4) + 0.0 AS max_dbz
FROM nowcasts n JOIN (SELECT station, max(timestamp) AS newest FROM c_frames GROUP BY station) USING (station)
WHERE predicted_at = newest GROUP BY ALL""",
    ),
)
def q_nowcast_rows(spark, sf_dir):
    latest = R.latest_frames(c_frames(spark, sf_dir), 2)
    rows = R.nowcast(flow_frames(spark, sf_dir, latest), LEAD)
    cells = rows.select(
        "station", "predicted_at", "valid_at", "lead_minutes", "method",
        F.explode("reflectivity_dbz").alias("p"),
    )
    shown = cells.groupBy("station", "predicted_at", "valid_at", "lead_minutes", "method").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("p") >= 20).alias("n_rain"),
        F.max("p").alias("max_dbz"),
    )
    return present(shown, max_dbz=4)


# --- J4, J14, A8 ------------------------------------------------------------------------------

_ACTUAL = """due AS (SELECT DISTINCT station, valid_at FROM nowcasts),
actual AS (SELECT d.station, d.valid_at, f.timestamp AS actual_at FROM due d LEFT JOIN c_frames f
  ON f.station = d.station AND abs(epoch_us(f.timestamp) - epoch_us(d.valid_at)) <= 150000000
  QUALIFY row_number() OVER (PARTITION BY d.station, d.valid_at
    ORDER BY abs(epoch_us(f.timestamp) - epoch_us(d.valid_at)), f.timestamp DESC) = 1)"""


@query(
    "q_asof_bucketed",
    with_ctes(
        "frames",
        _PAIRS,
        "nowcasts AS (SELECT station, timestamp + INTERVAL 30 MINUTE AS valid_at FROM pairs)",
        _ACTUAL,
        f"SELECT station, {micros('valid_at')} AS valid_at, {micros('actual_at')} AS actual_at FROM actual",
    ),
)
def q_asof_bucketed(spark, sf_dir):
    frames = c_frames(spark, sf_dir)
    due = R.frame_pairs(frames).select(
        "station", (F.col("timestamp") + F.expr("INTERVAL 30 MINUTES")).alias("valid_at")
    )
    return present(R.match_grids(due, frames))


_SCORES = """scores AS (SELECT n.station, n.predicted_at, n.valid_at, n.method, a.actual_at,
    avg(abs(CAST(n.p AS DOUBLE) - CAST(coalesce(c.dbz, -32) AS DOUBLE))) AS mae_dbz,
    CASE WHEN count(*) FILTER (WHERE n.p >= 20 OR coalesce(c.dbz, -32) >= 20) = 0 THEN CAST(1 AS DOUBLE)
      ELSE CAST(count(*) FILTER (WHERE n.p >= 20 AND coalesce(c.dbz, -32) >= 20) AS DOUBLE)
        / count(*) FILTER (WHERE n.p >= 20 OR coalesce(c.dbz, -32) >= 20) END AS csi
  FROM nowcasts n JOIN actual a ON a.station = n.station AND a.valid_at = n.valid_at AND a.actual_at IS NOT NULL
  JOIN c_cells c ON c.station = n.station AND c.timestamp = a.actual_at AND c.row = n.row AND c.col = n.col
  GROUP BY ALL)"""


def _scores(spark, sf_dir):
    frames = c_frames(spark, sf_dir)
    return R.grid_scores(R.nowcast(flow_frames(spark, sf_dir, frames), LEAD), frames)


@query(
    "q_grid_score",
    with_ctes(
        "frames cells",
        *_NOWCAST,
        _ACTUAL,
        _SCORES,
        f"""SELECT station, {micros('predicted_at')} AS predicted_at, {micros('valid_at')} AS valid_at, method,
  CAST({LEAD} AS DOUBLE) AS lead_minutes, {micros('actual_at')} AS actual_at, round(mae_dbz, 4) + 0.0 AS mae_dbz, {r6('csi')} AS csi FROM scores""",
    ),
)
def q_grid_score(spark, sf_dir):
    return present(_scores(spark, sf_dir), mae_dbz=4)


@query(
    "q_grid_score_methods",
    with_ctes(
        "frames cells",
        *_NOWCAST,
        _ACTUAL,
        _SCORES,
        f"""SELECT method, CAST({LEAD} AS DOUBLE) AS lead_minutes, CAST(count(*) AS BIGINT) AS n_samples,
  round(avg(mae_dbz), 4) + 0.0 AS mae_dbz, {r6('avg(csi)')} AS csi, CAST(20 AS DOUBLE) AS csi_threshold_dbz
FROM scores GROUP BY method ORDER BY lead_minutes, method""",
    ),
)
def q_grid_score_methods(spark, sf_dir):
    scores = R.score_methods(_scores(spark, sf_dir))
    return present(scores.orderBy("lead_minutes", "method"), mae_dbz=4)


# --- G5, G6 -----------------------------------------------------------------------------------

_OFFSET = """(point_lon - longitude) * CAST(111.320 AS DOUBLE) * cos(radians(latitude)) AS east,
  (point_lat - latitude) * CAST(110.574 AS DOUBLE) AS north"""


def _index(km):
    return f"greatest(0, least(7, CAST(round_even(({km} + grid_km) / (grid_km * 2) * 7, 0) AS INTEGER)))"


def _sampled(source):
    return f"""placed AS (SELECT *, {_OFFSET} FROM {source} JOIN c_points USING (station)),
indexed AS (SELECT *, abs(east) <= grid_km + 0.000001 AND abs(north) <= grid_km + 0.000001 AS in_range,
  {_index('north')} AS r, {_index('east')} AS c FROM placed)"""


@query(
    "q_point_sample",
    with_ctes(
        "frames cells points",
        _sampled("c_frames"),
        f"""SELECT i.station, {micros('i.timestamp')} AS timestamp, i.point_id, CAST(in_range AS BIGINT) AS in_range,
  CASE WHEN in_range THEN CAST(r AS BIGINT) END AS row, CASE WHEN in_range THEN CAST(c AS BIGINT) END AS col,
  CASE WHEN in_range THEN {r6('CAST(d.dbz AS DOUBLE)')} END AS sample_dbz
FROM indexed i JOIN c_cells d ON d.station = i.station AND d.timestamp = i.timestamp AND d.row = i.r AND d.col = i.c""",
    ),
)
def q_point_sample(spark, sf_dir):
    # cells are rounded once per frame, not once per point
    frames = c_frames(spark, sf_dir).withColumn("reflectivity_dbz", F.transform("reflectivity_dbz", lambda v: shown(v)))
    rows = R.point_samples(frames, c_points(spark, sf_dir))
    columns = ("station", "timestamp", "point_id", "in_range", "row", "col", "sample_dbz")
    return present(rows.select(*columns), sample_dbz=None)


@query(
    "q_home_check",
    with_ctes(
        "frames cells points",
        *_NOWCAST,
        _sampled("c_frames"),
        f"""SELECT i.station, i.point_id, {micros('n.valid_at')} AS valid_at, CAST(in_range AS BIGINT) AS in_range,
  CASE WHEN in_range THEN round(CAST(n.p AS DOUBLE), 4) + 0.0 END AS sample_dbz,
  CASE WHEN in_range THEN CAST(n.p >= 20 AS BIGINT) END AS rain_expected
FROM indexed i JOIN nowcasts n ON n.station = i.station AND n.predicted_at = i.timestamp AND n.row = i.r AND n.col = i.c
WHERE n.method = 'optical_flow'
  AND i.timestamp = (SELECT max(timestamp) FROM c_frames f WHERE f.station = i.station)""",
    ),
)
def q_home_check(spark, sf_dir):
    latest = R.latest_frames(c_frames(spark, sf_dir), 2)
    rows = R.nowcast(flow_frames(spark, sf_dir, latest), LEAD)
    checked = R.check_points(rows, c_points(spark, sf_dir))
    return present(
        checked.select("station", "point_id", "valid_at", "in_range", "sample_dbz", "rain_expected"),
        sample_dbz=4,
    )


# --- requests by time: one row each ---------------------------------------------------------------


def c_requests(spark, sf_dir):
    """Points asked for at a time each, every third for the latest frame."""
    minutes = F.make_dt_interval(mins=(F.col("point_id") * 37 % 4000).cast("int"))
    at = F.when(F.col("point_id") % 3 != 0, F.lit("2024-01-01").cast("timestamp") + minutes)
    return c_boxes(spark, sf_dir).withColumn("at", at)


_REQUESTS = """requests AS (SELECT *, CAST(1.5 AS DOUBLE) + (point_id % 3) * CAST(0.5 AS DOUBLE) AS radius_km,
    CASE WHEN point_id % 3 <> 0 THEN epoch_us(TIMESTAMP '2024-01-01') + (point_id * 37 % 4000) * 60000000 END AS at_us FROM c_points),
asked AS (SELECT r.*, (SELECT max(f.timestamp) FROM c_frames f WHERE f.station = r.station
    AND (r.at_us IS NULL OR epoch_us(f.timestamp) <= r.at_us)) AS timestamp FROM requests r),
c_asked AS (SELECT f.*, a.point_id, a.point_lat, a.point_lon, a.radius_km
  FROM asked a JOIN c_frames f ON f.station = a.station AND f.timestamp = a.timestamp)"""


@query(
    "q_point_request",
    with_ctes(
        "frames cells points",
        _REQUESTS,
        f"""indexed AS (SELECT *, abs(east) <= grid_km + 0.000001 AND abs(north) <= grid_km + 0.000001 AS in_range,
    {_index('north')} AS r, {_index('east')} AS c FROM (SELECT *, {_OFFSET} FROM c_asked))""",
        f"""SELECT i.station, {micros('i.timestamp')} AS timestamp, i.point_id, CAST(in_range AS BIGINT) AS in_range,
  CASE WHEN in_range THEN {r6('CAST(d.dbz AS DOUBLE)')} END AS sample_dbz
FROM indexed i JOIN c_cells d ON d.station = i.station AND d.timestamp = i.timestamp AND d.row = i.r AND d.col = i.c""",
    ),
)
def q_point_request(spark, sf_dir):
    rows = R.point_samples(c_frames(spark, sf_dir), c_requests(spark, sf_dir))
    return present(rows.select("station", "timestamp", "point_id", "in_range", "sample_dbz"))


# --- G7, A14, F15, G8 ---------------------------------------------------------------------------


def c_boxes(spark, sf_dir):
    """Watch boxes of 1.5 to 2.5 km around the points."""
    return c_points(spark, sf_dir).withColumn("radius_km", 1.5 + (F.col("point_id") % 3) * 0.5)


_BOXES = f"""boxed AS (SELECT *, {_OFFSET}, CAST(1.5 AS DOUBLE) + (point_id % 3) * CAST(0.5 AS DOUBLE) AS radius_km
  FROM c_frames JOIN c_points USING (station)),
centred AS (SELECT *, (east + grid_km) / (grid_km * 2) * 7 AS pc, (north + grid_km) / (grid_km * 2) * 7 AS pr,
    radius_km / grid_km * 7 / 2 AS half
  FROM boxed WHERE abs(east) - radius_km <= grid_km + 0.000001 AND abs(north) - radius_km <= grid_km + 0.000001),
bounds AS (SELECT *, greatest(0, CAST(round_even(pr - half, 0) AS INTEGER)) AS row_min,
    least(7, CAST(round_even(pr + half, 0) AS INTEGER)) AS row_max,
    greatest(0, CAST(round_even(pc - half, 0) AS INTEGER)) AS col_min,
    least(7, CAST(round_even(pc + half, 0) AS INTEGER)) AS col_max FROM centred),
crops AS (SELECT b.station, b.timestamp, b.point_id, b.row_min, b.row_max, b.col_min, b.col_max, c.row, c.col, c.dbz,
    {_CLASS.format('c.dbz')} AS dbz_class
  FROM bounds b JOIN c_cells c ON c.station = b.station AND c.timestamp = b.timestamp
    AND c.row BETWEEN b.row_min AND b.row_max AND c.col BETWEEN b.col_min AND b.col_max)"""


_ASKED_BOXES = _BOXES.replace(
    "SELECT *, " + _OFFSET + ", CAST(1.5 AS DOUBLE) + (point_id % 3) * CAST(0.5 AS DOUBLE) AS radius_km\n  FROM c_frames JOIN c_points USING (station)",
    "SELECT *, " + _OFFSET + " FROM c_asked",
)


@query(
    "q_crop_request",
    with_ctes(
        "frames cells points",
        _REQUESTS,
        _ASKED_BOXES,
        f"""SELECT station, {micros('timestamp')} AS timestamp, point_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col,
  {r6('CAST(dbz AS DOUBLE)')} AS dbz, CAST(dbz_class AS BIGINT) AS dbz_class FROM crops""",
    ),
)
def q_crop_request(spark, sf_dir):
    cells = R.crop_cells(R.crop_bounds(c_frames(spark, sf_dir), c_requests(spark, sf_dir)))
    return present(cells.select("station", "timestamp", "point_id", "row", "col", "dbz", "dbz_class"))


@query(
    "q_crop",
    with_ctes(
        "frames cells points",
        _BOXES,
        f"""SELECT station, {micros('timestamp')} AS timestamp, point_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col,
  {r6('CAST(dbz AS DOUBLE)')} AS dbz, CAST(dbz_class AS BIGINT) AS dbz_class FROM crops""",
    ),
)
def q_crop(spark, sf_dir):
    # cells are rounded once per frame, not once per box
    frames = c_frames(spark, sf_dir).withColumn("_shown", F.transform("reflectivity_dbz", lambda v: shown(v)))
    cells = R.crops(frames, c_boxes(spark, sf_dir), looks={"shown_dbz": "_shown"})
    columns = ("station", "timestamp", "point_id", "row", "col", F.col("shown_dbz").alias("dbz"), "dbz_class")
    return present(cells.select(*columns), dbz=None)


_CROP_FLOW = f"""crop_flow AS (SELECT c.*, f.fx, f.fy FROM crops c JOIN flow f ON f.station = c.station AND f.timestamp = c.timestamp
  AND f.br = c.row // {BLOCK} AND f.bc = c.col // {BLOCK})"""


@query(
    "q_block_motion",
    with_ctes(
        "frames cells points",
        *_FLOW,
        _BOXES,
        _CROP_FLOW,
        """block_means AS (SELECT station, timestamp, point_id, (row - row_min) // 2 AS block_row, (col - col_min) // 2 AS block_col,
    max(coalesce(dbz, -32)) AS max_dbz, avg(fx) AS fx, avg(fy) AS fy FROM crop_flow GROUP BY ALL)""",
        f"""SELECT station, {micros('timestamp')} AS timestamp, point_id, CAST(block_row AS BIGINT) AS block_row,
  CAST(block_col AS BIGINT) AS block_col, {r6('CAST(max_dbz AS DOUBLE)')} AS max_dbz, {r6('fx')} AS fx, {r6('fy')} AS fy,
  {r6('sqrt(fx * fx + fy * fy)')} AS speed_px, {r6('fx / sqrt(fx * fx + fy * fy)')} AS unit_x, {r6('fy / sqrt(fx * fx + fy * fy)')} AS unit_y
FROM block_means WHERE max_dbz >= 15 AND sqrt(fx * fx + fy * fy) >= 0.001""",
    ),
)
def q_block_motion(spark, sf_dir):
    # blocks are rounded once per frame and box in cells, not once per point
    values = ("max_dbz", "fx", "fy", "speed_px", "unit_x", "unit_y")
    rounded = lambda blocks: blocks.withColumns({c: quickly_shown(F.col(c)) for c in values})
    _, motion = R.region_product(flow_frames(spark, sf_dir), c_boxes(spark, sf_dir), spacing=2, finish=rounded)
    return present(motion, **dict.fromkeys(values))


@query(
    "q_region_product",
    with_ctes(
        "frames cells points",
        *_FLOW,
        _BOXES,
        _CROP_FLOW,
        f"""SELECT station, {micros('timestamp')} AS timestamp, point_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col,
  CAST(dbz_class AS BIGINT) AS dbz_class, {r6('fx')} AS fx, {r6('fy')} AS fy FROM crop_flow""",
    ),
)
def q_region_product(spark, sf_dir):
    # motion is rounded once per block of a frame, not once per cell of a box
    flows = flow_frames(spark, sf_dir).withColumns({c: F.transform(c, lambda v: shown(v)) for c in ("flow_x", "flow_y")})
    cells, _ = R.region_product(flows, c_boxes(spark, sf_dir), spacing=2)
    return present(
        cells.select("station", "timestamp", "point_id", "row", "col", "dbz_class", "fx", "fy"), fx=None, fy=None
    )


# --- G9 -----------------------------------------------------------------------------------------


def c_gates(spark, sf_dir):
    """Polar gates: eight azimuths by eight ranges, alternating between two sweeps."""
    v = F.col("v").cast("double")
    return load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("R"), F.col("label").cast("string")).alias("station"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("vec_id") * 300_000_000).alias("timestamp"),
        F.posexplode("embedding").alias("i", "v"),
    ).select(
        "station",
        "timestamp",
        (0.5 + F.col("i") % 2).alias("elevation_deg"),
        (F.floor(F.col("i") / 8) * 45 + 7).cast("double").alias("azimuth_deg"),
        ((F.col("i") % 8 + 1) * 0.6).alias("range_km"),
        F.when(v >= -0.2, 20 + v * 100).alias("dbz"),
    )


@query(
    "q_polar_grid",
    with_ctes(
        "cells",
        """gates AS (SELECT station, timestamp, i % 2 AS sweep, radians(CAST((i // 8) * 45 + 7 AS DOUBLE)) AS az,
    (i % 8 + 1) * CAST(0.6 AS DOUBLE) AS rng, CASE WHEN v >= -0.2 THEN 20 + v * 100 END AS dbz
  FROM (SELECT 'R' || CAST(label AS VARCHAR) AS station, make_timestamp(CAST(1704067200000000 + vec_id * 300000000 AS BIGINT)) AS timestamp,
      CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, 64)) AS i FROM embeddings))""",
        """placed AS (SELECT *, (rng * sin(az) + 4) / 8 * 7 AS px, (rng * cos(az) + 4) / 8 * 7 AS py
  FROM gates WHERE sweep = 0 AND dbz IS NOT NULL)""",
        """weighed AS (SELECT *, CAST(round_even(px, 0) AS INTEGER) AS col, CAST(round_even(py, 0) AS INTEGER) AS row FROM placed)""",
        f"""SELECT station, {micros('timestamp')} AS timestamp, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col,
  round(CAST(CAST(sum(dbz / (power(px - col, 2) + power(py - row, 2) + CAST(0.01 AS DOUBLE)))
    / sum(1 / (power(px - col, 2) + power(py - row, 2) + CAST(0.01 AS DOUBLE))) AS FLOAT) AS DOUBLE), 4) + 0.0 AS dbz
FROM weighed WHERE row BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7 GROUP BY station, weighed.timestamp, row, col""",
    ),
)
def q_polar_grid(spark, sf_dir):
    frames = R.regrid_gates(c_gates(spark, sf_dir), 4.0, 1.0)
    cells = R.frames_to_cells(frames).filter("dbz IS NOT NULL")
    return present(cells.select("station", "timestamp", "row", "col", "dbz"), dbz=4)
