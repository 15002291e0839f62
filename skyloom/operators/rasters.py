"""Radar grids: frames, pairs, motion, advection, nowcasts, samples, scores.

A frame is one row with a row-major ``ARRAY<FLOAT>`` of n*n cells.  Frames are
independent rows, so every kernel here is a narrow transformation; the only
shuffles are the ones that pair frames in time, and they carry keys or one grid
per slice.  Three kernels (block matching, bilinear sampling, laying out gates) need
random access into the grid and run as small numpy functions over Arrow batches; everything
else is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.constants import (
    ARROW_MIN_DBZ,
    DEFAULT_LEAD_MINUTES,
    GRID_TOLERANCE_S,
    MOTION,
    NO_ECHO_DBZ,
    PERSISTENCE,
    RAIN_THRESHOLD_DBZ,
    STILL_BLOCK_PX,
)
from skyloom.errors import InsufficientFramesError
from skyloom.functions.cells import dbz_class, filled, filled_grid, grid_side
from skyloom.functions.kernels import match_levels, pixels, sample_moved, spread_cells
from skyloom.functions.geo import clamp_index, grid_position, km_offset
from skyloom.functions.scalar import hours_between, plus_minutes
from skyloom.operators.nearest import nearest_join
from skyloom.operators.sliced import fill_forward, time_slice, with_previous
from skyloom.sources.tables import materialise

_GRID = "reflectivity_dbz"
_PLACE = ["grid_km", "resolution_km", "latitude", "longitude"]
_PAIR_SLICE_S = 6 * 3600
_EDGE_KM = 1e-6


def frames_to_cells(frames: DataFrame, grid: str = _GRID, value: str = "dbz") -> DataFrame:
    """One row per cell with ``row`` (from the south) and ``col`` (from the west)."""
    keep = [c for c in frames.columns if c != grid]
    side = F.expr(f"CAST(sqrt(size({grid})) AS INT)")
    return frames.select(
        *keep, side.alias("n"), F.posexplode(grid).alias("cell", value)
    ).select(
        *keep,
        "n",
        F.expr("cell div n").cast("int").alias("row"),
        F.expr("cell % n").cast("int").alias("col"),
        value,
    )


def latest_keys(frames: DataFrame, n: int = 2, keep: list[str] = ()) -> DataFrame:
    """Keys of the newest ``n`` frames (``recency`` 1 = newest) of stations that have n.

    Narrow columns only, and Spark cuts each map task to n rows per station before
    the shuffle (window group limit).
    """
    newest = Window.partitionBy("station").orderBy(F.col("timestamp").desc())
    keys = (
        frames.select("station", "timestamp", *keep)
        .withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") <= n)
    )
    have = F.count(F.lit(1)).over(Window.partitionBy("station"))
    return keys.withColumn("_have", have).filter(F.col("_have") == n).drop("_have")


def latest_frames(frames: DataFrame, n: int = 2) -> DataFrame:
    """K1: the newest ``n`` frames of every station that has at least ``n``."""
    return frames.join(latest_keys(frames, n), ["station", "timestamp"])


def require_frames(frames: DataFrame, n: int = 2) -> None:
    """Raise where a station lacks frames; a count per station, no grids are read."""
    short = frames.groupBy("station").agg(F.count(F.lit(1)).alias("have")).filter(F.col("have") < n)
    bad = short.limit(5).collect()
    if bad or frames.select("station").isEmpty():
        names = ", ".join(f"{r['station']} has {r['have']}" for r in bad) or "no frames at all"
        raise InsufficientFramesError(f"need at least {n} frames per station: {names}")


def frame_pairs(frames: DataFrame, slice_s: float = _PAIR_SLICE_S) -> DataFrame:
    """Every frame with its predecessor's grid and the interval in minutes (> 0).

    Predecessors are found on keys alone; then each grid is fetched once by an equality join. The joins
    hash their narrow or earlier side, so no grid is ever sorted. (station, time) pairs are unique, which
    spreads them evenly whatever station is large.
    """
    paired = with_previous(
        frames.select("station", "timestamp"), ["station"], "timestamp", [], time_slice(F.col("timestamp"), slice_s)
    )
    minutes = hours_between(F.col("timestamp"), F.col("prev_timestamp")) * 60
    keys = paired.withColumn("interval_minutes", minutes).filter(F.col("interval_minutes") > 0)
    earlier = frames.select("station", F.col("timestamp").alias("prev_timestamp"), F.col(_GRID).alias("prev_dbz"))
    return (
        frames.join(keys.hint("shuffle_hash"), ["station", "timestamp"])
        .join(earlier.hint("shuffle_hash"), ["station", "prev_timestamp"])
        .select(*frames.columns, "prev_timestamp", "prev_dbz", "interval_minutes")
    )


# --- G2: block matching ---------------------------------------------------------


def block_flow(pairs: DataFrame, block: int = 15, radius: int = 8, levels: int = 1) -> DataFrame:
    """Motion per block in cells per frame interval, as ``flow_x`` / ``flow_y``.

    Both arrays are row-major over the blocks, ceil(n / block) per side. With several ``levels`` the search goes
    from coarse to fine and reaches ``radius * (2**levels - 1)`` cells.
    """

    @F.pandas_udf("flow_x array<double>, flow_y array<double>")
    def match(prev: pd.Series, curr: pd.Series) -> pd.DataFrame:
        flows = [match_levels(pixels(p), pixels(c), block, radius, levels) for p, c in zip(prev, curr)]
        return pd.DataFrame({"flow_x": [f[0] for f in flows], "flow_y": [f[1] for f in flows]})

    return (
        pairs.withColumn("_flow", match(F.col("prev_dbz"), F.col(_GRID)))
        .select("*", "_flow.flow_x", "_flow.flow_y", F.lit(block).alias("flow_block"))
        .drop("_flow")
    )


def flow_to_blocks(flow: DataFrame) -> DataFrame:
    """The motion field as one row per block."""
    keep = ["station", "timestamp", "interval_minutes"]
    blocks = F.posexplode(F.arrays_zip("flow_x", "flow_y")).alias("block_no", "_f")
    return flow.select(*keep, blocks).select(*keep, "block_no", "_f.flow_x", "_f.flow_y")


# --- G3: advection --------------------------------------------------------------


def advect(frames: DataFrame, scale: Column, out: str, grid: str = _GRID) -> DataFrame:
    """The grid moved along its flow; ``scale`` is lead / interval."""

    @F.pandas_udf("array<float>")
    def move(
        dbz: pd.Series, fx: pd.Series, fy: pd.Series, block: pd.Series, factor: pd.Series
    ) -> pd.Series:
        return pd.Series(
            [
                sample_moved(np.asarray(g), np.asarray(u), np.asarray(v), int(b), float(s))
                for g, u, v, b, s in zip(dbz, fx, fy, block, factor)
            ]
        )

    return frames.withColumn(
        out,
        move(
            F.col(grid),
            F.col("flow_x"),
            F.col("flow_y"),
            F.col("flow_block"),
            scale.cast("double"),
        ),
    )


def nowcast(
    pairs_with_flow: DataFrame, lead_minutes: float = DEFAULT_LEAD_MINUTES
) -> DataFrame:
    """Both methods' forecast grids, one row each.

    Only the method name is unrolled, so a reader of the keys never computes a grid.
    """
    lead = F.lit(float(lead_minutes))
    moved = advect(pairs_with_flow, lead / F.col("interval_minutes"), "_moved")
    methods = F.explode(F.array(F.lit(PERSISTENCE), F.lit(MOTION)))
    grid = F.when(F.col("method") == MOTION, F.col("_moved")).otherwise(filled_grid(F.col(_GRID)))
    return moved.withColumn("method", methods).select(
        F.col("timestamp").alias("predicted_at"),
        plus_minutes(F.col("timestamp"), lead).alias("valid_at"),
        lead.alias("lead_minutes"),
        "method",
        "station",
        *_PLACE,
        grid.alias(_GRID),
    )


# --- J4, J14, A8: scoring ---------------------------------------------------------


def match_grids(
    nowcasts: DataFrame, frames: DataFrame, tolerance_s: float = GRID_TOLERANCE_S
) -> DataFrame:
    """Observed frame time nearest to ``valid_at`` per (station, valid_at).

    Works on keys only; the grids join afterwards on the matched time.
    """
    due = nowcasts.select("station", "valid_at").distinct()
    seen = frames.select("station", F.col("timestamp").alias("actual_at"))
    return nearest_join(
        due, seen, ["station"], "valid_at", "actual_at", tolerance_s, ["actual_at"], tie="later"
    )


def grid_scores(
    nowcasts: DataFrame,
    frames: DataFrame,
    tolerance_s: float = GRID_TOLERANCE_S,
    threshold: float = RAIN_THRESHOLD_DBZ,
) -> DataFrame:
    """MAE and CSI of every nowcast that has an observed frame."""
    matched = match_grids(nowcasts, frames, tolerance_s).filter(F.col("actual_at").isNotNull())
    return pair_scores(nowcasts, frames, matched, threshold)


def pair_scores(
    nowcasts: DataFrame, frames: DataFrame, matched: DataFrame, threshold: float = RAIN_THRESHOLD_DBZ
) -> DataFrame:
    """MAE and CSI of the nowcasts for which ``matched`` (station, valid_at) names the frame ``actual_at``.

    The match goes to the frames first, so a nowcast's grid is shuffled once. Cells of a pair of grids are
    unrolled and summed inside the same task (generated code, partial aggregation); what is shuffled
    after that is one row per nowcast.
    """
    observed = frames.select(
        "station", F.col("timestamp").alias("actual_at"), F.col(_GRID).alias("_actual")
    )
    truth = observed.join(matched.select("station", "valid_at", "actual_at").hint("shuffle_hash"), ["station", "actual_at"])
    pairs = nowcasts.join(truth, ["station", "valid_at"])
    keys = ["station", "predicted_at", "valid_at", "method", "lead_minutes", "actual_at"]
    cells = pairs.select(*keys, "_actual", F.posexplode(_GRID).alias("_i", "_p")).select(
        *keys, filled(F.col("_p")).alias("p"), filled(F.get("_actual", "_i")).alias("a")
    )
    said, came = F.col("p") >= threshold, F.col("a") >= threshold
    return cells.groupBy(*keys).agg(
        F.avg(F.abs(F.col("p").cast("double") - F.col("a").cast("double"))).alias("mae_dbz"),
        (
            F.when(F.count_if(said | came) == 0, F.lit(1.0)).otherwise(
                F.count_if(said & came) / F.nullif(F.count_if(said | came), F.lit(0))
            )
        ).alias("csi"),
    )


def score_methods(per_frame: DataFrame, threshold: float = RAIN_THRESHOLD_DBZ) -> DataFrame:
    """Mean of the per-frame scores per (method, lead)."""
    return per_frame.groupBy("method", "lead_minutes").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("mae_dbz").alias("mae_dbz"),
        F.avg("csi").alias("csi"),
        F.lit(float(threshold)).alias("csi_threshold_dbz"),
    )


# --- G5-G8: points and regions ------------------------------------------------------

_REQUEST_SLICE_S = 86_400


def for_requests(frames: DataFrame, requests: DataFrame, max_age_s: float | None = None) -> DataFrame:
    """One row per request: its columns beside the station's last frame at or before ``at`` (NULL: the latest).

    Frames are matched on keys alone, per station and day; a request that has no frame (or none younger than
    ``max_age_s``) has no row. Only the grids asked for are fetched, however often one is asked for.
    """
    seen = frames.select("station", F.col("timestamp").alias("_seen"))
    row = F.struct(*[F.col(c) for c in requests.columns])
    line = seen.select("station", F.struct(F.col("_seen").alias("t"), F.lit(0).alias("side")).alias("_o"), "_seen").unionByName(
        requests.filter(F.col("at").isNotNull()).select(
            "station", F.struct(F.col("at").alias("t"), F.lit(1).alias("side")).alias("_o"), row.alias("_request")
        ),
        allowMissingColumns=True,
    )
    day = time_slice(F.col("_o.t"), _REQUEST_SLICE_S)
    timed = fill_forward(line, ["station"], "_o", "_seen", day, "_frame_at").filter("_o.side = 1")
    newest = seen.groupBy("station").agg(F.max("_seen").alias("_frame_at"))
    latest = requests.filter(F.col("at").isNull()).join(newest, "station").select(*requests.columns, "_frame_at")
    matched = timed.select("_request.*", "_frame_at").unionByName(latest).filter(F.col("_frame_at").isNotNull())
    if max_age_s is not None:
        age = F.unix_micros("at") - F.unix_micros("_frame_at")
        matched = matched.filter(F.coalesce(age, F.lit(0)) <= int(max_age_s * 1_000_000))
    keys = matched.withColumnRenamed("_frame_at", "timestamp").hint("shuffle_hash")
    return frames.join(keys, ["station", "timestamp"])


# Pairs of a frame and a place in a task; a pair becomes some rows, so a task stays at some hundred thousand rows.
_TASK_PAIRS = 100_000
_MOST_TASKS = 20_000
# Places are narrow rows (about 100 bytes): up to so many, by count, are broadcast.
_BROADCAST_PLACES = 500_000


def _beside_places(frames: DataFrame, places: DataFrame) -> DataFrame:
    """Every frame beside every place of its station.

    The pairs outnumber both sides by far, so tasks are dealt by counted pairs and not by the bytes of the frames, which
    are shuffled by station and time. What can be grouped by these two afterwards needs no further shuffle. Places too
    many for one broadcast go in slices, so that no task ever holds all frames of a station.
    """
    have = frames.groupBy("station").agg(F.count(F.lit(1)).alias("_frames"))
    want = places.groupBy("station").agg(F.count(F.lit(1)).alias("_places"))
    totals = have.join(want, "station").agg(F.sum(F.col("_frames") * F.col("_places")), F.sum("_places")).first()
    tasks = min(_MOST_TASKS, max(frames.sparkSession.sparkContext.defaultParallelism, -(-(totals[0] or 0) // _TASK_PAIRS)))
    moment = [c for c in ("timestamp", "predicted_at", "valid_at") if c in frames.columns]
    dealt = frames.repartition(tasks, "station", *moment)
    slices = max(1, -(-(totals[1] or 0) // _BROADCAST_PLACES))
    if slices == 1:
        return dealt.join(F.broadcast(places), "station")
    number = F.pmod(F.xxhash64(*places.columns), F.lit(slices))
    parts = [dealt.join(F.broadcast(places.filter(number == i)), "station") for i in range(slices)]
    return reduce(DataFrame.unionByName, parts)


def _asked(frames: DataFrame, places: DataFrame | None) -> DataFrame:
    """Frames beside the places they are asked for: by request time, or all of a station's frames for each place."""
    if places is None:
        return frames
    return for_requests(frames, places) if "at" in places.columns else _beside_places(frames, places)


# What the cells of a place depend on, beside the place itself. A station that does not move has one such layout.
_LAYOUT = ["latitude", "longitude", "grid_km"]
# Layouts of a station, on the mean, up to which places are looked up once per layout and not once per frame.
_FEW_LAYOUTS = 4
_SHARED = "_shared"


class _Views(NamedTuple):
    """Places of a station by what they see of its grids (``_by_view``)."""

    places: DataFrame
    dealt: DataFrame  # frames with _n and the number of their layout
    distinct: DataFrame  # what is seen, per layout, by number
    named: DataFrame  # places with the number of what they see
    slices: int


def _by_view(
    frames: DataFrame, places: DataFrame | None, look: Callable[[DataFrame], DataFrame], grid: str = _GRID
) -> _Views | None:
    """Places that see the same cells share a view, so what is made of a frame is made once per view.

    ``look`` adds to a place beside a layout (and the grid's side ``_n``) what it sees, and that alone. None where places are
    not asked of all frames, or where layouts are as many as frames, so that the places of each layout would be too.
    """
    if places is None or "at" in places.columns:
        return None
    spark, moment = frames.sparkSession, [c for c in ("timestamp", "predicted_at", "valid_at") if c in frames.columns]
    sized = frames.withColumn("_n", grid_side(F.col(grid)))
    layouts = sized.groupBy("station", *_LAYOUT, "_n").agg(F.count(F.lit(1)).alias("_frames"))
    layouts = materialise(spark, layouts.withColumn("_layout", F.monotonically_increasing_id()))
    n_layouts, n_stations = layouts.agg(F.count(F.lit(1)), F.count_distinct("station")).first()
    if n_layouts > _FEW_LAYOUTS * max(1, n_stations):
        return None
    beside = look(layouts.join(places, "station"))
    seen = [c for c in beside.columns if c not in {*layouts.columns, *places.columns}]
    views = beside.groupBy("_layout", *seen).agg(
        F.count(F.lit(1)).alias("_places"), (F.first("_frames") * F.count(F.lit(1))).alias("_pairs")
    )
    views = materialise(spark, views.withColumn(_SHARED, F.monotonically_increasing_id()))
    n_pairs, n_places = views.agg(F.sum("_pairs"), F.sum("_places")).first()
    tasks = min(_MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-(n_pairs or 0) // _TASK_PAIRS)))
    alike = lambda one, two, columns: reduce(and_, [F.col(f"{one}.{c}").eqNullSafe(F.col(f"{two}.{c}")) for c in columns])
    dealt = sized.repartition(tasks, "station", *moment).alias("f").join(
        F.broadcast(layouts.alias("l")), alike("f", "l", ("station", *_LAYOUT, "_n"))
    )
    distinct = views.select("_layout", *seen, _SHARED)
    named = beside.alias("p").join(F.broadcast(distinct.alias("v")), alike("p", "v", ("_layout", *seen)))
    return _Views(
        places,
        dealt.select("f.*", "l._layout"),
        distinct,
        named.select(*[f"p.{c}" for c in places.columns if c != "station"], f"v.{_SHARED}"),
        max(1, -(-(n_places or 0) // _BROADCAST_PLACES)),
    )


def _beside_views(views: _Views, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on every frame beside every view of its layout, then its rows beside the places that share the view.

    The rows of one view come one after another for all its places: nothing but the place changes between them.
    """
    parts = []
    for i in range(views.slices):
        mine = F.pmod(F.xxhash64(_SHARED), F.lit(views.slices)) == i if views.slices > 1 else F.lit(True)
        made = work(views.dealt.join(F.broadcast(views.distinct.filter(mine)), "_layout").drop("_layout"))
        parts.append(made.join(F.broadcast(views.named.filter(mine)), _SHARED).drop(_SHARED))
    rows = reduce(DataFrame.unionByName, parts)
    first = [c for c in dict.fromkeys([*views.dealt.columns, *views.places.columns]) if c in rows.columns]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def _come_once(frames: DataFrame, places: DataFrame) -> bool:
    """Whether no frame and no place comes twice: then what is grouped by both can be grouped by frame and view."""
    counts = frames.groupBy("station", "timestamp").count(), places.groupBy("station", "point_id").count()
    return all(n.filter("count > 1").isEmpty() for n in counts)


def point_samples(grids: DataFrame, points: DataFrame, grid: str = _GRID) -> DataFrame:
    """Value of the cell nearest to each watch point of the same station.

    Points with a time ``at`` get one row each (``for_requests``), others one per grid of the station.
    ``in_range`` is false (and the value NULL) for points outside the grid.
    """
    views = _by_view(grids, points, _spot, grid)
    if views is not None:
        return _beside_views(views, lambda at: _sample(at, grid))
    return _sample(_spot(_asked(grids, points).withColumn("_n", grid_side(F.col(grid)))), grid)


def _spot(placed: DataFrame) -> DataFrame:
    """The cell nearest to the point."""
    east, north = km_offset(
        F.col("latitude"), F.col("longitude"), F.col("point_lat"), F.col("point_lon")
    )
    # step by step: one expression of it all is too long for the JVM to compile
    away = placed.withColumns({"_east": east, "_north": north})
    limit = F.col("grid_km") + _EDGE_KM
    inside = (F.abs("_east") <= limit) & (F.abs("_north") <= limit)
    cell = lambda km: clamp_index(grid_position(F.col(km), F.col("grid_km"), F.col("_n")), F.col("_n"))
    return away.withColumn("in_range", inside).withColumns(
        {"row": F.when(F.col("in_range"), cell("_north")), "col": F.when(F.col("in_range"), cell("_east"))}
    ).drop("_east", "_north")


def _sample(at: DataFrame, grid: str) -> DataFrame:
    value = F.get(F.col(grid), F.col("row") * F.col("_n") + F.col("col"))
    return at.withColumn("sample_dbz", F.when(F.col("in_range"), value)).drop(grid, "_n")


def check_points(
    nowcasts: DataFrame, points: DataFrame, threshold: float = RAIN_THRESHOLD_DBZ
) -> DataFrame:
    """Does the motion forecast bring rain to the point?"""
    sampled = point_samples(nowcasts.filter(F.col("method") == MOTION), points)
    return sampled.withColumn(
        "rain_expected", (F.col("sample_dbz") >= threshold).cast("int")
    )


def crop_bounds(frames: DataFrame, boxes: DataFrame | None, grid: str = _GRID) -> DataFrame:
    """Inclusive cell bounds of the box ``radius_km`` around each point.

    Boxes with a time ``at`` get one row each (``for_requests``), others one per frame; None says that the frames
    carry their boxes. ``in_range`` is false only where the box misses the grid altogether.
    """
    at = _asked(frames, boxes)
    return _box(at.withColumn("_n", grid_side(F.col(grid)))).select(*at.columns, *_BOUNDS)


_BOUNDS = ["in_range", "row_min", "row_max", "col_min", "col_max"]


def _box(at: DataFrame) -> DataFrame:
    """The bounds of the box around the point on a grid of side ``_n``."""
    east, north = km_offset(
        F.col("latitude"), F.col("longitude"), F.col("point_lat"), F.col("point_lon")
    )
    reach, n = F.col("radius_km"), F.col("_n")
    placed = at.withColumns({"_east": east, "_north": north})
    limit = F.col("grid_km") + _EDGE_KM
    centred = placed.withColumns(
        {
            "in_range": (F.abs("_east") - reach <= limit) & (F.abs("_north") - reach <= limit),
            "_half": reach / F.col("grid_km") * (n - 1) / 2,
            "_row": grid_position(F.col("_north"), F.col("grid_km"), n),
            "_col": grid_position(F.col("_east"), F.col("grid_km"), n),
        }
    )
    low = lambda p: F.greatest(F.lit(0), F.rint(F.col(p) - F.col("_half")).cast("int"))
    high = lambda p: F.least(n - 1, F.rint(F.col(p) + F.col("_half")).cast("int"))
    return centred.select(
        *at.columns,
        "in_range",
        low("_row").alias("row_min"),
        high("_row").alias("row_max"),
        low("_col").alias("col_min"),
        high("_col").alias("col_max"),
    )


def crop_cells(bounded: DataFrame, grid: str = _GRID, looks: dict[str, str] | None = None) -> DataFrame:
    """The cells inside the bounds, with class.

    Only the box is unrolled: the work follows the size of the crop, not of the grid. ``looks`` names more arrays of a
    value per cell, made once per frame, and the columns their values come out in.
    """
    looks = looks or {}
    keep = [c for c in bounded.columns if c != grid and c not in looks.values()]
    boxed = bounded.filter("in_range").select(
        *keep,
        grid,
        *looks.values(),
        F.expr(f"CAST(sqrt(size({grid})) AS INT)").alias("n"),
        (F.col("col_max") - F.col("col_min") + 1).alias("_w"),
        F.explode(
            F.expr("sequence(0, (row_max - row_min + 1) * (col_max - col_min + 1) - 1)")
        ).alias("_i"),
    )
    row, col = F.expr("int(row_min + _i div _w)"), F.expr("int(col_min + _i % _w)")
    placed = boxed.withColumns({"row": row, "col": col})
    at = F.col("row") * F.col("n") + F.col("col")
    valued = placed.withColumns({"dbz": F.get(F.col(grid), at), **{k: F.get(F.col(v), at) for k, v in looks.items()}})
    return valued.select(*keep, "n", "row", "col", "dbz", dbz_class(F.col("dbz")).alias("dbz_class"), *looks)


def crops(frames: DataFrame, boxes: DataFrame | None, grid: str = _GRID, looks: dict[str, str] | None = None) -> DataFrame:
    """``crop_cells`` of ``crop_bounds``; boxes that hold the same cells of a station's grids are cropped once."""
    views = _by_view(frames, boxes, _box, grid)
    if views is not None:
        return _beside_views(views, lambda at: crop_cells(at.drop("_n"), grid, looks))
    return crop_cells(crop_bounds(frames, boxes, grid), grid, looks)


def block_motion(
    cropped: DataFrame, keys: list[str], spacing: int = 20
) -> DataFrame:
    """Per block of the crop its strongest echo and mean motion.

    Blocks below the echo gate and blocks that stand still are left out.  Cells carry
    ``fx`` and ``fy``; the blocks count from the crop's own corner.
    """
    fx, fy = F.avg("fx"), F.avg("fy")
    return (
        cropped.groupBy(
            *keys,
            F.floor((F.col("row") - F.col("row_min")) / spacing).cast("int").alias("block_row"),
            F.floor((F.col("col") - F.col("col_min")) / spacing).cast("int").alias("block_col"),
        )
        .agg(F.max(filled(F.col("dbz"))).alias("max_dbz"), fx.alias("fx"), fy.alias("fy"))
        .withColumn("speed_px", F.hypot("fx", "fy"))
        .filter((F.col("max_dbz") >= ARROW_MIN_DBZ) & (F.col("speed_px") >= STILL_BLOCK_PX))
        .withColumn("unit_x", F.col("fx") / F.col("speed_px"))
        .withColumn("unit_y", F.col("fy") / F.col("speed_px"))
    )


def with_cell_flow(cells: DataFrame) -> DataFrame:
    """Give every cell its block's motion (arrays carried on the row)."""
    at = F.expr("int(row div flow_block) * int(ceil(n / flow_block)) + int(col div flow_block)")
    return (
        cells.withColumn("fx", F.get(F.col("flow_x"), at))
        .withColumn("fy", F.get(F.col("flow_y"), at))
        .drop("flow_x", "flow_y")
    )


def region_product(
    flow_frames: DataFrame,
    boxes: DataFrame | None,
    spacing: int = 20,
    finish: Callable[[DataFrame], DataFrame] = lambda blocks: blocks,
) -> tuple[DataFrame, DataFrame]:
    """(classified cells, block motion) of the region around every point.

    For requests by time match them to the pairs first and pass None: then motion is computed for those pairs only.
    ``finish`` changes columns of the block motion, before it is laid beside points that share it.
    """
    frames = flow_frames.drop("prev_dbz")
    keys = ["station", "timestamp", "point_id"]
    views = _by_view(frames, boxes, _box)
    if views is None:
        cells = with_cell_flow(crop_cells(crop_bounds(frames, boxes)))
        return cells, finish(block_motion(cells, keys, spacing))
    crop = lambda at: with_cell_flow(crop_cells(at.drop("_n")))
    cells = _beside_views(views, crop)
    if not _come_once(frames, boxes):
        return cells, finish(block_motion(cells, keys, spacing))
    motion = _beside_views(views, lambda at: finish(block_motion(crop(at), ["station", "timestamp", _SHARED], spacing)))
    return cells, motion.select(*keys, *[c for c in motion.columns if c not in {*keys, *boxes.columns}])


# --- G9: gates to grid ---------------------------------------------------------------


def regrid_gates(gates: DataFrame, grid_km: float, resolution_km: float) -> DataFrame:
    """Gates of the lowest sweep -> one Cartesian frame per scan.

    Each gate falls into its nearest cell; a cell is the mean of its gates weighted
    by closeness to the cell centre, NULL without gates.  Gates are summed per cell
    before any shuffle.  A sweep's cells are bounded by the grid, so gathering them
    into the frame's array is bounded too.
    """
    n = int(round(2 * grid_km / resolution_km))
    scan = ["station", "timestamp"]
    cell = F.struct((F.col("row") * n + F.col("col")).alias("k"), F.col("dbz").alias("v"))
    sweeps = (
        gate_cells(gates, grid_km, n)
        .groupBy(*scan, "elevation_deg")
        .agg(F.collect_list(F.when(F.col("dbz").isNotNull(), cell)).alias("_cells"))
    )
    lowest = sweeps.groupBy(*scan).agg(F.min_by("_cells", "elevation_deg").alias("_cells"))

    @F.pandas_udf("array<float>")
    def dense(keys: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([spread_cells(k, v, n * n) for k, v in zip(keys, values)])

    laid = dense(F.col("_cells.k"), F.col("_cells.v"))
    return lowest.select(
        *scan,
        F.lit(float(grid_km)).alias("grid_km"),
        F.lit(float(resolution_km)).alias("resolution_km"),
        F.transform(laid, lambda v: F.nanvl(v, F.lit(None).cast("float"))).alias(_GRID),
    )


def gate_cells(gates: DataFrame, grid_km: float, n: int) -> DataFrame:
    """Weighted mean per (scan, sweep, cell).  Gates without echo or outside the grid
    stay as one row of unknown cell, so that an empty lowest sweep is still the lowest."""
    azimuth = F.radians("azimuth_deg")
    x, y = F.col("range_km") * F.sin(azimuth), F.col("range_km") * F.cos(azimuth)
    half, side = F.lit(float(grid_km)), F.lit(n)
    px, py = grid_position(x, half, side), grid_position(y, half, side)
    col, row = F.rint(px).cast("int"), F.rint(py).cast("int")
    off = F.pow(px - col, F.lit(2.0)) + F.pow(py - row, F.lit(2.0))
    usable = (
        row.between(0, n - 1) & col.between(0, n - 1) & F.col("dbz").isNotNull() & ~F.isnan("dbz")
    )
    weight = F.lit(1.0) / (off + 0.01)
    return (
        gates.select(
            "station",
            "timestamp",
            "elevation_deg",
            F.when(usable, row).alias("row"),
            F.when(usable, col).alias("col"),
            F.when(usable, weight).alias("_w"),
            F.when(usable, weight * F.col("dbz")).alias("_wv"),
        )
        .groupBy("station", "timestamp", "elevation_deg", "row", "col")
        .agg((F.sum("_wv") / F.sum("_w")).alias("dbz"))
    )
