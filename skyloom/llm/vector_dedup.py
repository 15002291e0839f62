"""Near duplicates among embeddings, exact, by spherical k-means cells.

Vectors of one label and length are compared. Copies are one node with a weight. Labels with many
nodes get cells from spherical k-means, fitted on a bounded sample; every node is then assigned. Two
vectors with a cosine of at least ``LEAST`` lie at most ``sqrt(2 - 2 LEAST)`` apart, so a vector with a
partner beyond the bisector of its own and another cell is no farther from it than that: it visits
every such cell of a lower number, and no link is lost. Inside a cell, blocks of bounded size meet in
tasks of their own as matrix products; a task returns link counts and a spanning forest, no pairs.

Vectors without structure visit most cells: then the work is that of comparing all vectors of a
label, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skyloom.llm.common import by_value, stored, table, with_columns
from skyloom.llm.components import components

by_value(__name__)

LEAST = 0.93
CELL_ROWS = 2000  # nodes a cell is meant for
MAX_CENTROIDS = 32_768
SAMPLE_ROWS = 20_000  # bound of the k-means sample
BLOCK_ROWS = 4096
TILE = 512
ROUNDS = 8


def unit_vector(values: np.ndarray) -> bytes | None:
    """The vector at length one, in double precision; None if it has no direction."""
    x = values.astype(np.float64)
    if not len(x) or not np.isfinite(x).all() or not (scale := np.abs(x).max()):
        return None
    x = x / scale
    return (x / np.sqrt(x @ x) + 0.0).tobytes()


def directed(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, unit``; unit is null for vectors that link with nothing."""

    def make():
        def compute(column):
            units = []
            for value in column:
                units.append(unit_vector(value.values.to_numpy(zero_copy_only=False)) if value.is_valid else None)
            return [pa.array(units, pa.binary()), pa.array([len(u) // 8 if u else None for u in units], pa.int32())]

        return compute

    fields = [T.StructField("unit", T.BinaryType()), T.StructField("dim", T.IntegerType())]
    source = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return with_columns(source, ["embedding"], fields, make, keep=["vec_id", "label"])


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` unit centroids (fewer for fewer rows) from rows in a fixed order."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def fit_cells(nodes: DataFrame, cell_rows: int, sample_rows: int) -> dict:
    """Centroids by (label, dim) for the groups with more nodes than a cell is meant for."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = max(cell_rows, -(-total // MAX_CENTROIDS))
    # at most MAX_CENTROIDS groups can be larger than ``rows``
    large = {(r["label"], r["dim"]): r["n"] for r in sizes.where(F.col("n") > rows).collect()}
    if not large:
        return {}
    known = nodes.join(sizes.where(F.col("n") > rows).select("label", "dim"), ["label", "dim"])
    share = max(1, sum(large.values()) // sample_rows)
    picked = known.where(F.pmod(F.xxhash64("same"), F.lit(share)) == 0).select("label", "dim", "same", "unit")
    groups: dict = {}
    for r in sorted(picked.limit(2 * sample_rows).collect(), key=lambda r: r["same"]):
        groups.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(r["unit"]))
    return {key: spherical_kmeans(np.array(x), -(-large[key] // rows)) for key, x in groups.items()}


def placed(nodes: DataFrame, centroids: dict, least: float) -> DataFrame:
    """Each node in its own cell (home) and in the cells it visits."""
    reach = np.sqrt(2 - 2 * least) + 1e-9
    schema = T.StructType([*nodes.schema, T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType())])

    def run(batches):
        apart = {
            key: np.maximum(np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)), 1e-12) for key, c in centroids.items()
        }
        for batch in batches:
            rows, cells, homes = [], [], []
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
            units = batch.column("unit")
            for i, key in enumerate(keys):
                if key not in centroids:
                    visits, home = [0], 0
                else:
                    near = centroids[key] @ np.frombuffer(units[i].as_buffer())
                    home = int(near.argmax())
                    lead = (near[home] - near[:home]) / apart[key][home, :home]
                    visits = [home, *np.flatnonzero(lead <= reach).tolist()]
                rows += [i] * len(visits)
                cells += visits
                homes += [c == home for c in visits]
            for at in range(0, len(rows), 8192):
                part = batch.take(pa.array(rows[at : at + 8192]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cells[at : at + 8192], pa.int32()), pa.array(homes[at : at + 8192])],
                    names=schema.names,
                )

    return nodes.mapInArrow(run, schema)


def meet(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of the rows of one task: weights linked with each row, and its root in a spanning forest."""
    frame = frame.sort_values("rep", kind="stable").reset_index(drop=True)
    x = np.frombuffer(b"".join(frame["unit"]), dtype=np.float64).reshape(len(frame), -1)
    weight, home = frame["weight"].to_numpy(), frame["home"].to_numpy()
    block, rep = frame["block"].to_numpy(), frame["rep"].to_numpy()
    crossing = frame["first"].iloc[0] != frame["second"].iloc[0]
    links, root = np.zeros(len(x), dtype=np.int64), list(range(len(x)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, len(x), TILE):
        for b in range(a, len(x), TILE):
            p, q = slice(a, a + TILE), slice(b, b + TILE)
            near = x[p] @ x[q].T >= least
            near &= home[p][:, None] | home[q][None]
            if crossing:
                near &= block[p][:, None] != block[q][None]
            if a == b:
                near = np.triu(near, 1)
            if not near.any():
                continue
            links[p] += near @ weight[q]
            links[q] += near.T @ weight[p]
            left, right = near.nonzero()
            # labels spread inside the tile until they stay, then one edge a row joins the forest
            label = np.arange(len(x))
            while True:
                old = label.copy()
                low = np.minimum(label[a + left], label[b + right])
                np.minimum.at(label, a + left, low)
                np.minimum.at(label, b + right, low)
                if (label == old).all():
                    break
            for i in np.flatnonzero(label != np.arange(len(x))).tolist():
                i, j = find(i), find(int(label[i]))
                root[max(i, j)] = min(i, j)
    kept = np.flatnonzero(links)
    return pd.DataFrame(
        {
            "label": frame["label"].to_numpy()[kept],
            "dim": frame["dim"].to_numpy()[kept],
            "same": frame["same"].to_numpy()[kept],
            "rep": rep[kept],
            "links": links[kept],
            "root": rep[[find(i) for i in kept]],
        }
    )


def near_duplicates(
    vectors: DataFrame, least: float = LEAST, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Null labels and ids, and vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; so do vectors of unequal length. Copies link with each other. A repeated id is
    one node of the component graph. Other columns are not looked at.
    """
    rows = directed(vectors).withColumn("same", F.md5("unit"))
    rows = stored(rows, "vectors")
    usable = F.col("unit").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    nodes = stored(
        rows.where(usable)
        .groupBy("label", "dim", "same")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("unit").alias("unit")),
        "nodes",
    )
    cells = stored(placed(nodes, fit_cells(nodes, cell_rows, SAMPLE_ROWS), least), "cells")
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = cells.join(sizes, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("same"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    schema = T.StructType(
        [*(nodes.schema[c] for c in ("label", "dim", "same", "rep"))]
        + [T.StructField("links", T.LongType()), nodes.schema["rep"]]
    )
    schema.fields[-1] = T.StructField("root", nodes.schema["rep"].dataType)
    met = stored(
        dealt.groupBy("label", "dim", "cell", "first", "second").applyInPandas(lambda f: meet(f, least), schema), "met"
    )
    links = met.groupBy("label", "dim", "same").agg(F.sum("links").alias("links"))
    group = components(met.select("rep", "root")).withColumnsRenamed({"node": "rep", "component": "smallest"})
    known = nodes.select("label", "dim", "same", "rep", "weight").join(links, ["label", "dim", "same"], "left")
    known = known.join(group, "rep", "left").select(
        "label",
        "dim",
        "same",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("smallest", "rep").alias("component_id"),
    )
    out = rows.select("vec_id", F.when(usable, F.col("label")).alias("label"), "dim", "same")
    return out.join(known, ["label", "dim", "same"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def op3_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
      WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ok AS (SELECT * FROM u WHERE n > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {LEAST}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v
          UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
LEFT JOIN (SELECT x AS vec_id, count(*) AS n_links FROM link GROUP BY x) USING (vec_id)
"""
