"""The numpy kernels that need random access into a grid (G2, G3, G9) or into trees (M5).

They are sent to the workers by value, so the executors need no copy of the package.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from skyloom.constants import DBZ_CLIP, NO_ECHO_DBZ

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def no_gaps(grid: np.ndarray) -> np.ndarray:
    """F11 on a whole grid; NULL cells arrive from Arrow as NaN."""
    grid = np.asarray(grid, dtype=np.float32)
    return np.where(np.isnan(grid), np.float32(NO_ECHO_DBZ), grid)


def pixels(grid: np.ndarray) -> np.ndarray:
    """F10 on a whole grid, in the same single-precision steps as ``cells.pixel``."""
    low, high = np.float32(DBZ_CLIP[0]), np.float32(DBZ_CLIP[1])
    share = (np.clip(no_gaps(grid), low, high) - low) / (high - low)
    return (share * np.float32(255)).astype(np.uint8)


def match_blocks(prev: np.ndarray, curr: np.ndarray, block: int, radius: int):
    """Displacement (x, y) of every block of ``curr`` against ``prev``, by least sum of
    absolute pixel differences.  Outside the grid counts as pixel 0.  Equal sums take
    the shortest displacement, then the smallest y, then the smallest x.  A block
    without echo takes the mean displacement of the frame's blocks that have echo, or
    stands still if none has.
    """
    n = int(round(len(curr) ** 0.5))
    side = -(-n // block)
    # sums of up to block*block pixels stay exact in this type
    kind = np.float32 if block <= 128 else np.float64
    curr = curr.reshape(n, n).astype(kind)
    padded = np.pad(prev.reshape(n, n).astype(kind), radius)
    member = (np.arange(side)[:, None] == np.arange(n)[None, :] // block).astype(kind)
    fx, fy = np.zeros((side, side)), np.zeros((side, side))
    echo = member @ curr @ member.T > 0
    if not echo.any():
        return fx.ravel(), fy.ravel()

    # only the rows and columns of blocks that hold echo have to be searched
    rows, cols = np.flatnonzero(echo.any(axis=1)), np.flatnonzero(echo.any(axis=0))
    box = (slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1))
    top, left = rows[0] * block, cols[0] * block
    bottom, right = min(n, (rows[-1] + 1) * block), min(n, (cols[-1] + 1) * block)
    seen = curr[top:bottom, left:right]
    of_row, of_col = member[box[0], top:bottom], member[box[1], left:right].T
    shifts = sorted(
        ((dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)),
        key=lambda s: (s[0] * s[0] + s[1] * s[1], s[1], s[0]),
    )
    best = np.full(echo[box].shape, np.inf)
    best_x, best_y = np.zeros(best.shape), np.zeros(best.shape)
    for dx, dy in shifts:
        r, c = radius - dy, radius - dx
        cost = of_row @ np.abs(seen - padded[r + top : r + bottom, c + left : c + right]) @ of_col
        better = cost < best
        best[better], best_x[better], best_y[better] = cost[better], dx, dy
    fx[box], fy[box] = best_x, best_y
    fx[~echo], fy[~echo] = fx[echo].mean(), fy[echo].mean()
    return fx.ravel(), fy.ravel()


def averaged(grid: np.ndarray, factor: int) -> np.ndarray:
    """Every cell of a square grid as the mean of its ``factor`` by ``factor`` tile; tiles may stick out, padded by 0."""
    n = len(grid)
    full = np.pad(grid.astype(np.float64), (0, -n % factor))
    tiles = full.reshape(len(full) // factor, factor, -1, factor).mean(axis=(1, 3))
    return np.repeat(np.repeat(tiles, factor, axis=0), factor, axis=1)[:n, :n]


def match_levels(prev: np.ndarray, curr: np.ndarray, block: int, radius: int, levels: int):
    """Displacements as of ``match_blocks``, found from coarse to fine.

    Level k looks at grids averaged over ``2**k`` cells and tries steps of as many cells around what the level before
    found for the block; it counts the differences of the block and of k neighbours on each side. The reach is ``radius * (2**levels - 1)`` cells for ``levels`` searches of one radius.
    """
    if levels <= 1:
        return match_blocks(prev, curr, block, radius)
    n = int(round(len(curr) ** 0.5))
    side = -(-n // block)
    prev, curr = prev.reshape(n, n), curr.reshape(n, n)
    member = (np.arange(side)[:, None] == np.arange(n)[None, :] // block).astype(np.float64)
    echo = member @ curr.astype(np.float64) @ member.T > 0
    fx, fy = np.zeros((side, side)), np.zeros((side, side))
    if not echo.any():
        return fx.ravel(), fy.ravel()
    shifts = sorted(
        ((dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)),
        key=lambda s: (s[0] * s[0] + s[1] * s[1], s[1], s[0]),
    )
    # only rows and columns of blocks with echo are searched
    rows = np.flatnonzero(np.repeat(echo.any(axis=1), block)[:n])
    cols = np.flatnonzero(np.repeat(echo.any(axis=0), block)[:n])
    of_row, of_col = member[:, rows], member[:, cols].T
    margin = radius * (2**levels - 1)
    for level in range(levels - 1, -1, -1):
        step = 1 << level
        old = np.pad(averaged(prev, step), margin)
        now = averaged(curr, step)[np.ix_(rows, cols)]
        from_x = cols[None, :] - fx.astype(int)[np.ix_(rows // block, cols // block)] + margin
        from_y = rows[:, None] - fy.astype(int)[np.ix_(rows // block, cols // block)] + margin
        near = (np.abs(np.arange(side)[:, None] - np.arange(side)[None, :]) <= level).astype(np.float64)
        best = np.full((side, side), np.inf)
        best_x, best_y = np.zeros((side, side)), np.zeros((side, side))
        for dx, dy in shifts:
            cost = of_row @ np.abs(now - old[from_y - dy * step, from_x - dx * step]) @ of_col
            cost = near @ cost @ near
            better = cost < best
            best[better], best_x[better], best_y[better] = cost[better], dx * step, dy * step
        fx[echo] += best_x[echo]
        fy[echo] += best_y[echo]
    fx[~echo], fy[~echo] = fx[echo].mean(), fy[echo].mean()
    return fx.ravel(), fy.ravel()


def sample_moved(grid: np.ndarray, fx: np.ndarray, fy: np.ndarray, block: int, scale: float) -> np.ndarray:
    """Sample ``grid`` at (x - fx*scale, y - fy*scale), bilinear; outside is no echo."""
    n = int(round(len(grid) ** 0.5))
    side = -(-n // block)
    axis = np.arange(n)
    of_block = axis // block
    flow_x = fx.reshape(side, side)[np.ix_(of_block, of_block)]
    flow_y = fy.reshape(side, side)[np.ix_(of_block, of_block)]
    x = axis[None, :] - flow_x * scale
    y = axis[:, None] - flow_y * scale
    x0, y0 = np.floor(x), np.floor(y)
    wx, wy = x - x0, y - y0
    # a border of no-echo cells answers every read outside the grid
    ring = np.full((n + 2, n + 2), NO_ECHO_DBZ)
    ring[1:-1, 1:-1] = no_gaps(grid).reshape(n, n)
    cx0 = np.clip(x0, -1, n).astype(np.int64) + 1
    cx1 = np.clip(x0 + 1, -1, n).astype(np.int64) + 1
    cy0 = np.clip(y0, -1, n).astype(np.int64) + 1
    cy1 = np.clip(y0 + 1, -1, n).astype(np.int64) + 1
    south = ring[cy0, cx0] * (1 - wx) + ring[cy0, cx1] * wx
    north = ring[cy1, cx0] * (1 - wx) + ring[cy1, cx1] * wx
    return (south * (1 - wy) + north * wy).astype(np.float32).ravel()


def spread_cells(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Known cells laid into a grid of ``size`` cells, NaN elsewhere."""
    grid = np.full(size, np.nan, dtype=np.float32)
    grid[np.asarray(keys, dtype=np.int64)] = np.asarray(values, dtype=np.float32)
    return grid


# Places (tree, row) looked at together: the nodes of a block of trees and these stay in a core's cache.
_WALKS = 8192


def mean_of_trees(columns: list[np.ndarray], trees: dict[str, np.ndarray]) -> np.ndarray:
    """Mean over all trees of the leaf that each row falls into.

    ``trees`` holds the nodes of all trees one after another: ``feature`` and ``threshold``, ``child`` (left and right at
    2i and 2i + 1; a leaf is its own), ``value``, and the ``roots`` and greatest ``depth``. Trees are summed in their order.
    """
    x = np.ascontiguousarray(np.stack(columns), dtype=np.float64)
    if np.isnan(x).any():
        raise ValueError("a feature of a row to be forecast is unknown")
    n = x.shape[1]
    rows, total = np.arange(n), np.zeros(n)
    step = max(1, _WALKS // max(1, n))
    for first in range(0, len(trees["roots"]), step):
        node = np.repeat(trees["roots"][first : first + step, None], n, axis=1)
        for _ in range(trees["depth"]):
            seen = x.take(trees["feature"].take(node) * n + rows)
            node = trees["child"].take(2 * node + (seen > trees["threshold"].take(node)))
        for leaf in trees["value"].take(node):
            total += leaf
    return total / len(trees["roots"])
