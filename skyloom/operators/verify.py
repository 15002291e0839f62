"""Forecast verification: outcome joins, scores, baselines, AUC, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.constants import TRACK_TOLERANCE_S
from skyloom.functions.geo import haversine_km
from skyloom.operators.nearest import nearest_join
from skyloom.operators.sliced import running_total_before


def join_outcomes(predictions: DataFrame, daily: DataFrame) -> DataFrame:
    """Each prediction with its outcome; ``pending`` while there is no high for the day.

    (station, date) is unique on the daily side, so the join adds no rows; whether it
    broadcasts or sorts is left to the size Spark measures.
    """
    outcome = daily.select(
        "station_id",
        F.col("date").alias("target_date"),
        F.col("rain").alias("actual_rain"),
        F.col("temp_max_c").alias("actual_temp_max_c"),
        F.col("temp_min_c").alias("actual_temp_min_c"),
    )
    return predictions.join(outcome, ["station_id", "target_date"], "left").withColumn(
        "pending", F.col("actual_temp_max_c").isNull()
    )


def score_days(joined: DataFrame) -> DataFrame:
    """A5, A6 per (model version, horizon) in one aggregation.

    Metrics run over the pairs both sides know; ``n_rain`` counts those of the rain
    metrics.  ``n_samples`` and ``n_pending`` split all predictions of the group.
    """
    scored = ~F.col("pending")
    knows_rain = F.col("actual_rain").isNotNull() & F.col("rain_predicted").isNotNull()
    hit = (F.col("actual_rain") == F.col("rain_predicted")).cast("double")
    brier = F.pow(F.col("actual_rain") - F.col("rain_probability"), F.lit(2.0))
    return joined.groupBy("model_trained_at", "horizon_days").agg(
        F.count_if(scored).alias("n_samples"),
        F.count_if(F.col("pending")).alias("n_pending"),
        F.count_if(scored & knows_rain).alias("n_rain"),
        F.avg(F.when(scored, hit)).alias("rain_accuracy"),
        F.avg(F.when(scored, brier)).alias("rain_brier"),
        F.avg(F.abs(F.col("actual_temp_max_c") - F.col("temp_max_pred_c"))).alias("temp_max_mae"),
        F.avg(
            F.when(scored, F.abs(F.col("actual_temp_min_c") - F.col("temp_min_pred_c")))
        ).alias("temp_min_mae"),
    )


def join_fixes(
    predictions: DataFrame, fixes: DataFrame, tolerance_s: float = TRACK_TOLERANCE_S
) -> DataFrame:
    """Each track forecast with the nearest fix of its storm; ties take the later fix."""
    truth = fixes.select(
        "storm_id",
        F.col("timestamp").alias("actual_at"),
        F.col("lat").alias("actual_lat"),
        F.col("lon").alias("actual_lon"),
        F.col("max_wind_kt").alias("actual_wind_kt"),
    )
    return nearest_join(
        predictions,
        truth,
        ["storm_id"],
        "valid_at",
        "actual_at",
        tolerance_s,
        ["actual_at", "actual_lat", "actual_lon", "actual_wind_kt"],
        tie="later",
    ).withColumn("pending", F.col("actual_at").isNull())


def score_tracks(joined: DataFrame) -> DataFrame:
    """A7, A6 per (model version, horizon)."""
    miss = haversine_km(
        F.col("lat_pred"), F.col("lon_pred"), F.col("actual_lat"), F.col("actual_lon")
    )
    return joined.groupBy("model_trained_at", "horizon_hours").agg(
        F.count_if(~F.col("pending")).alias("n_samples"),
        F.count_if(F.col("pending")).alias("n_pending"),
        F.avg(miss).alias("track_error_km"),
        F.avg(F.abs(F.col("wind_pred_kt") - F.col("actual_wind_kt"))).alias("wind_mae_kt"),
    )


def persistence_scores(test: DataFrame) -> DataFrame:
    """How well today's values forecast the labelled test rows."""
    return test.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((F.col("y_rain") == F.col("rain")).cast("double")).alias("rain_baseline_accuracy"),
        F.avg(F.abs(F.col("y_temp_max") - F.col("temp_max_c"))).alias("temp_max_baseline_mae"),
        F.avg(F.abs(F.col("y_temp_min") - F.col("temp_min_c"))).alias("temp_min_baseline_mae"),
    )


_SCORE_SLICES = 4096


def roc_auc(df: DataFrame, by: list[str], label: str, score: Column) -> DataFrame:
    """A10: exact ROC AUC per group, NULL where a class is missing.

    Equal scores collapse to one row first, so a tie of any size is one row.  The
    rank of a score is a running count over score slices; no group is ranked whole.
    """
    points = (
        df.select(*by, F.col(label).cast("int").alias("_y"), score.alias("_score"))
        .filter(F.col("_y").isNotNull() & F.col("_score").isNotNull())
        .groupBy(*by, "_score")
        .agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    )
    ranked = running_total_before(
        points, by, "_score", "_neg", F.floor(F.col("_score") * _SCORE_SLICES), "_below"
    )
    pairs = F.sum("_pos") * F.sum("_neg")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    return ranked.groupBy(*by).agg(
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
        F.when(pairs > 0, wins / pairs).alias("roc_auc"),
    )


def class_weights(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) of every class of every group."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_class"))
    totals = counts.groupBy(*by).agg(
        F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k")
    )
    return counts.join(totals, by).select(
        *by,
        label,
        "n_class",
        (F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight"),
    )
