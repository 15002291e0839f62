"""Merges and the daily track."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.carrier_sql import day, r6, with_ctes
from catalog.carriers import c_daily, c_long
from catalog.registry import present, query
from skyloom.constants import DAILY_FEATURES
from skyloom.operators import daily as D, merge as M, verify as V

_ALL = ["source", "temp_max_c", "temp_min_c", "precip_mm", "rain", "humidity_pct", "pressure_hpa", "wind_speed_kmh"]

# --- merges: two thirds of the days are stored; the others and every second day arrive, some twice ---


def stored_days(spark, sf_dir):
    rows = c_daily(spark, sf_dir)
    return rows.filter(F.dayofyear("date") % 3 != 0).drop("ingest_seq")


def arriving_days(spark, sf_dir, source):
    rows = c_daily(spark, sf_dir).filter((F.dayofyear("date") % 2 == 0) | (F.dayofyear("date") % 3 == 0))
    copies = F.when(F.dayofyear("date") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rep = F.col("rep")
    return rows.withColumn("rep", F.explode(copies)).select(
        "station_id",
        "date",
        F.lit(source).alias("source"),
        (F.col("temp_max_c") + 1 + rep).alias("temp_max_c"),
        (F.col("temp_min_c") - 1 - rep).alias("temp_min_c"),
        F.when(F.dayofyear("date") % 5 != 0, F.col("precip_mm") + rep).alias("precip_mm"),
        F.col("rain"),
        F.when(F.dayofyear("date") % 7 != 0, F.col("humidity_pct") + rep).alias("humidity_pct"),
        (F.col("pressure_hpa") + rep).alias("pressure_hpa"),
        (F.col("wind_speed_kmh") + rep).alias("wind_speed_kmh"),
        (F.col("ingest_seq") * 2 + rep).alias("ingest_seq"),
    )


_STORED = "stored AS (SELECT * FROM c_daily WHERE dayofyear(date) % 3 <> 0)"
_ARRIVING = """arriving AS (
  SELECT station_id, date, temp_max_c + 1 + rep AS temp_max_c, temp_min_c - 1 - rep AS temp_min_c,
    CASE WHEN dayofyear(date) % 5 <> 0 THEN precip_mm + rep END AS precip_mm, rain,
    CASE WHEN dayofyear(date) % 7 <> 0 THEN humidity_pct + rep END AS humidity_pct,
    pressure_hpa + rep AS pressure_hpa, wind_speed_kmh + rep AS wind_speed_kmh,
    ingest_seq * 2 + rep AS seq
  FROM (SELECT *, unnest(CASE WHEN dayofyear(date) % 4 = 0 THEN [0, 1] ELSE [0] END) AS rep
        FROM c_daily WHERE dayofyear(date) % 2 = 0 OR dayofyear(date) % 3 = 0)),
last_new AS (SELECT * FROM arriving QUALIFY row_number() OVER (PARTITION BY station_id, date ORDER BY seq DESC) = 1),
first_new AS (SELECT * FROM arriving QUALIFY row_number() OVER (PARTITION BY station_id, date ORDER BY seq) = 1),
n_new AS (SELECT station_id, date, count(*) AS n FROM arriving GROUP BY 1, 2)"""


def _shown(prefix=""):
    floats = ", ".join(
        f"{r6(prefix + c)} AS {c}"
        for c in _ALL
        if c not in ("source", "rain")
    )
    return f"{floats}, CAST({prefix}rain AS BIGINT) AS rain"


def _merge_sql(take: dict, source: str, allowed: str = "TRUE") -> str:
    """Full-outer twin; ``take`` maps a column to 1 where the incoming side owns it."""
    cols = []
    for c in _ALL:
        if c == "source":
            cols.append(f"{source} AS source")
        elif take.get(c):
            cols.append(
                f"CASE WHEN n.seq IS NOT NULL AND (s.station_id IS NULL OR {allowed}) THEN n.{c} ELSE s.{c} END AS {c}"
            )
        else:
            cols.append(f"s.{c} AS {c}")
    action = (
        f"CASE WHEN n.seq IS NULL THEN 'keep' WHEN s.station_id IS NULL THEN 'insert'"
        f" WHEN {allowed} THEN 'update' ELSE 'skip' END"
    )
    return with_ctes(
        "daily",
        _STORED,
        _ARRIVING,
        f"""merged AS (SELECT coalesce(s.station_id, n.station_id) AS station_id, coalesce(s.date, n.date) AS date,
  {', '.join(cols)}, {action} AS _action
  FROM stored s FULL OUTER JOIN last_new n ON s.station_id = n.station_id AND s.date = n.date)""",
        f"SELECT station_id, {day('date')} AS date, source, {_shown()}, _action FROM merged",
    )


_MEASURED = {c: 1 for c in ("temp_max_c", "temp_min_c", "precip_mm", "rain")}
_ENRICHED = {c: 1 for c in ("humidity_pct", "pressure_hpa", "wind_speed_kmh")}
_NEW_SOURCE = "CASE WHEN n.seq IS NOT NULL THEN '{}' ELSE s.source END"


@query(
    "q_merge_ignore",
    with_ctes(
        "daily",
        _STORED,
        _ARRIVING,
        f"""SELECT station_id, {day('date')} AS date, source, {_shown()} FROM stored
UNION ALL
SELECT station_id, {day('date')}, 'metar_live', {_shown()} FROM first_new f
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.station_id = f.station_id AND s.date = f.date)""",
    ),
)
def q_merge_ignore(spark, sf_dir):
    new = arriving_days(spark, sf_dir, "metar_live")
    stored = stored_days(spark, sf_dir)
    fresh = M.merge_ignore(stored, new, M.DAILY_KEYS, "ingest_seq").drop("ingest_seq")
    return present(stored.unionByName(fresh))


@query("q_merge_replace", _merge_sql({**_MEASURED, **_ENRICHED}, _NEW_SOURCE.format("metar_live")))
def q_merge_replace(spark, sf_dir):
    new = arriving_days(spark, sf_dir, "metar_live")
    merged = M.insert_or_replace(stored_days(spark, sf_dir), new, M.DAILY_KEYS, "ingest_seq")
    return present(merged.drop("_records"))


@query("q_merge_authoritative", _merge_sql(_MEASURED, _NEW_SOURCE.format("ghcnd")))
def q_merge_authoritative(spark, sf_dir):
    merged = M.merge_authoritative(stored_days(spark, sf_dir), arriving_days(spark, sf_dir, "ghcnd"))
    return present(merged.drop("_records"))


_GUARD = "s.source <> 'ghcnd'"


@query("q_merge_gapfill", _merge_sql(_MEASURED, "coalesce(s.source, 'metar_live')", _GUARD))
def q_merge_gapfill(spark, sf_dir):
    merged = M.merge_gapfill(stored_days(spark, sf_dir), arriving_days(spark, sf_dir, "metar_live"))
    return present(merged.drop("_records"))


@query("q_merge_enrich", _merge_sql(_ENRICHED, "coalesce(s.source, 'lcd')"))
def q_merge_enrich(spark, sf_dir):
    merged = M.merge_enrichment(stored_days(spark, sf_dir), arriving_days(spark, sf_dir, "lcd"))
    return present(merged.drop("_records"))


@query(
    "q_merge_counts",
    with_ctes(
        "daily",
        _STORED,
        _ARRIVING,
        f"""SELECT CASE WHEN s.station_id IS NULL THEN 'insert' WHEN {_GUARD} THEN 'update' ELSE 'skip' END AS _action,
  CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(n.n) AS BIGINT) AS n_records
FROM n_new n LEFT JOIN stored s ON s.station_id = n.station_id AND s.date = n.date GROUP BY 1""",
    ),
)
def q_merge_counts(spark, sf_dir):
    merged = M.merge_gapfill(stored_days(spark, sf_dir), arriving_days(spark, sf_dir, "metar_live"))
    return present(M.merge_counts(merged))


@query(
    "q_dedup_last",
    with_ctes(
        "long",
        f"""SELECT station_id, {day('date')} AS date, datatype, {r6('value')} AS value, ingest_seq FROM c_long
QUALIFY row_number() OVER (PARTITION BY station_id, date ORDER BY ingest_seq DESC) = 1""",
    ),
)
def q_dedup_last(spark, sf_dir):
    return present(M.last_per_key(c_long(spark, sf_dir), M.DAILY_KEYS, "ingest_seq"))


# --- features ------------------------------------------------------------------------------

FEATURES_SQL = """features AS (
  SELECT *,
    lag(rain) OVER w AS rain_yesterday,
    temp_max_c - lag(temp_max_c) OVER w AS temp_max_trend_c,
    avg(temp_max_c) OVER w3 AS temp_max_3d_mean_c, avg(temp_min_c) OVER w3 AS temp_min_3d_mean_c,
    avg(precip_mm) OVER w3 AS precip_3d_mean_mm, avg(precip_mm) OVER w7 AS precip_7d_mean_mm,
    pressure_hpa - lag(pressure_hpa) OVER w AS pressure_delta_hpa,
    avg(pressure_hpa) OVER w3 AS pressure_3d_mean_hpa,
    sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
    sin(2 * pi() * dayofyear(date) / CAST(365.25 AS DOUBLE)) AS doy_sin,
    cos(2 * pi() * dayofyear(date) / CAST(365.25 AS DOUBLE)) AS doy_cos
  FROM c_daily
  WINDOW w AS (PARTITION BY station_id ORDER BY date),
         w3 AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
         w7 AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""

_INTS = ("rain", "rain_yesterday")


def _feature_list():
    return ", ".join(
        f"CAST({c} AS BIGINT) AS {c}" if c in _INTS else f"{r6(c)} AS {c}" for c in DAILY_FEATURES
    )


def _complete(*more):
    return " AND ".join(f"{c} IS NOT NULL" for c in (*DAILY_FEATURES, *more))


@query(
    "q_daily_features",
    with_ctes("daily", FEATURES_SQL, f"SELECT station_id, {day('date')} AS date, {_feature_list()} FROM features"),
)
def q_daily_features(spark, sf_dir):
    rows = D.daily_features(c_daily(spark, sf_dir))
    return present(rows.select("station_id", "date", *DAILY_FEATURES))


def _target_cols(kind):
    out = []
    for h in (1, 2, 3):
        for name, c in (("rain", "rain"), ("temp_max", "temp_max_c"), ("temp_min", "temp_min_c")):
            if kind == "rows":
                value = f"lead({c}, {h}) OVER (PARTITION BY station_id ORDER BY date)"
            else:
                value = f"(SELECT t.{c} FROM c_daily t WHERE t.station_id = d.station_id AND t.date = d.date + {h})"
            value = f"CAST({value} AS BIGINT)" if name == "rain" else r6(value)
            out.append(f"{value} AS {name}_h{h}")
    return ", ".join(out)


@query(
    "q_daily_targets",
    with_ctes("daily", f"SELECT station_id, {day('date')} AS date, {_target_cols('rows')} FROM c_daily"),
)
def q_daily_targets(spark, sf_dir):
    return present(D.daily_targets(c_daily(spark, sf_dir).select("station_id", "date", "rain", "temp_max_c", "temp_min_c")).drop("rain", "temp_max_c", "temp_min_c"))


@query(
    "q_daily_targets_calendar",
    with_ctes("daily", f"SELECT station_id, {day('date')} AS date, {_target_cols('days')} FROM c_daily d"),
)
def q_daily_targets_calendar(spark, sf_dir):
    rows = c_daily(spark, sf_dir).select("station_id", "date", "rain", "temp_max_c", "temp_min_c")
    return present(D.daily_targets(rows, calendar=True).drop("rain", "temp_max_c", "temp_min_c"))


def _labelled(h):
    return f"""labelled{h} AS (SELECT * FROM (
  SELECT *, lead(rain, {h}) OVER w AS y_rain, lead(temp_max_c, {h}) OVER w AS y_temp_max,
    lead(temp_min_c, {h}) OVER w AS y_temp_min
  FROM features WINDOW w AS (PARTITION BY station_id ORDER BY date))
  WHERE {_complete('y_rain', 'y_temp_max', 'y_temp_min')}),
split{h} AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date)
    > count(*) OVER (PARTITION BY station_id)
      - greatest(1, CAST(floor(count(*) OVER (PARTITION BY station_id) * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS is_test
  FROM labelled{h})"""


@query(
    "q_training_frame",
    with_ctes(
        "daily",
        FEATURES_SQL,
        _labelled(1),
        f"""SELECT station_id, {day('date')} AS date, {_feature_list()}, CAST(y_rain AS BIGINT) AS y_rain,
  {r6('y_temp_max')} AS y_temp_max, {r6('y_temp_min')} AS y_temp_min FROM labelled1""",
    ),
)
def q_training_frame(spark, sf_dir):
    return present(D.training_frame(D.daily_features(c_daily(spark, sf_dir)), 1))


@query(
    "q_chrono_split",
    with_ctes(
        "daily",
        FEATURES_SQL,
        _labelled(2),
        f"SELECT station_id, {day('date')} AS date, CAST(is_test AS BIGINT) AS is_test FROM split2",
    ),
)
def q_chrono_split(spark, sf_dir):
    labelled = D.training_frame(D.daily_features(c_daily(spark, sf_dir)), 2)
    return present(D.chrono_split(labelled).select("station_id", "date", "is_test"))


_LATEST = f"""latest AS (SELECT * FROM features WHERE {_complete()}
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY date DESC) = 1)"""


@query(
    "q_latest_features",
    with_ctes("daily", FEATURES_SQL, _LATEST, f"SELECT station_id, {day('date')} AS date, {_feature_list()} FROM latest"),
)
def q_latest_features(spark, sf_dir):
    rows = D.latest_features(D.daily_features(c_daily(spark, sf_dir)))
    return present(rows.select("station_id", "date", *DAILY_FEATURES))


# --- predictions and scores --------------------------------------------------------------------


def _version(date):
    return F.concat(F.lit("v"), (F.unix_date(date) % 3).cast("string"))


_PRED_COLS = """station_id, date AS predicted_date, h AS horizon_days, date + CAST(h AS INTEGER) AS target_date,
    {p} AS rain_probability, CASE WHEN {p} >= 0.5 THEN 1 WHEN {p} < 0.5 THEN 0 END AS rain_predicted,
    temp_max_c AS temp_max_pred_c, temp_min_c AS temp_min_pred_c,
    'v' || CAST((date - DATE '1970-01-01') % 3 AS VARCHAR) AS model_trained_at"""


def _preds_sql(source, p, name="preds"):
    return (
        f"{name} AS (SELECT {_PRED_COLS.format(p=p)} FROM (SELECT *, unnest([1, 2, 3]) AS h FROM {source}))"
    )


_PRED_OUT = f"""station_id, {day('predicted_date')} AS predicted_date, CAST(horizon_days AS BIGINT) AS horizon_days,
  {day('target_date')} AS target_date, {r6('rain_probability')} AS rain_probability,
  CAST(rain_predicted AS BIGINT) AS rain_predicted, {r6('temp_max_pred_c')} AS temp_max_pred_c,
  {r6('temp_min_pred_c')} AS temp_min_pred_c, model_trained_at"""

_BLEND = "(CAST(0.2 AS DOUBLE) + CAST(0.6 AS DOUBLE) * rain)"


def c_preds(spark, sf_dir):
    """Persistence rows with a blended probability, for every station and day."""
    return D.persistence_days(
        D.daily_features(c_daily(spark, sf_dir)),
        _version("date"),
        F.lit(0.2) + F.lit(0.6) * F.col("rain"),
    )


_JOINED = """joined AS (SELECT p.*, d.rain AS actual_rain, d.temp_max_c AS actual_temp_max_c,
    d.temp_min_c AS actual_temp_min_c, d.temp_max_c IS NULL AS pending
  FROM preds p LEFT JOIN c_daily d ON d.station_id = p.station_id AND d.date = p.target_date)"""


@query(
    "q_predict_rows",
    with_ctes("daily", FEATURES_SQL, _LATEST, _preds_sql("latest", "CAST(rain AS DOUBLE)"), f"SELECT {_PRED_OUT} FROM preds"),
)
def q_predict_rows(spark, sf_dir):
    rows = D.latest_features(D.daily_features(c_daily(spark, sf_dir)))
    return present(D.persistence_days(rows, _version("date")))


@query(
    "q_eval_join",
    with_ctes(
        "daily",
        _preds_sql("c_daily", _BLEND),
        _JOINED,
        f"""SELECT {_PRED_OUT}, CAST(actual_rain AS BIGINT) AS actual_rain, {r6('actual_temp_max_c')} AS actual_temp_max_c,
  {r6('actual_temp_min_c')} AS actual_temp_min_c, CAST(pending AS BIGINT) AS pending FROM joined""",
    ),
)
def q_eval_join(spark, sf_dir):
    return present(V.join_outcomes(c_preds(spark, sf_dir), c_daily(spark, sf_dir)))


@query(
    "q_eval_scores",
    with_ctes(
        "daily",
        _preds_sql("c_daily", _BLEND),
        _JOINED,
        f"""SELECT model_trained_at, CAST(horizon_days AS BIGINT) AS horizon_days, CAST(count(*) AS BIGINT) AS n_samples,
  {r6('avg(CASE WHEN actual_rain = rain_predicted THEN 1.0 WHEN actual_rain <> rain_predicted THEN 0.0 END)')} AS rain_accuracy,
  {r6('avg(power(actual_rain - rain_probability, 2))')} AS rain_brier,
  {r6('avg(abs(actual_temp_max_c - temp_max_pred_c))')} AS temp_max_mae,
  {r6('avg(abs(actual_temp_min_c - temp_min_pred_c))')} AS temp_min_mae
FROM joined WHERE NOT pending GROUP BY 1, 2 ORDER BY 1, 2""",
    ),
)
def q_eval_scores(spark, sf_dir):
    scores = V.score_days(V.join_outcomes(c_preds(spark, sf_dir), c_daily(spark, sf_dir)))
    shown = scores.filter("n_samples > 0").drop("n_pending", "n_rain")
    return present(shown.orderBy("model_trained_at", "horizon_days"))


@query(
    "q_eval_pending",
    with_ctes(
        "daily",
        _preds_sql("c_daily", _BLEND),
        _JOINED,
        """SELECT model_trained_at, CAST(horizon_days AS BIGINT) AS horizon_days,
  CAST(count(*) FILTER (WHERE pending) AS BIGINT) AS n_pending,
  CAST(count(*) FILTER (WHERE NOT pending AND actual_rain IS NOT NULL AND rain_predicted IS NOT NULL) AS BIGINT) AS n_rain
FROM joined GROUP BY 1, 2""",
    ),
)
def q_eval_pending(spark, sf_dir):
    scores = V.score_days(V.join_outcomes(c_preds(spark, sf_dir), c_daily(spark, sf_dir)))
    return present(scores.select("model_trained_at", "horizon_days", "n_pending", "n_rain"))


def _baseline_part(h):
    return f"""SELECT CAST({h} AS BIGINT) AS horizon_days, CAST(count(*) AS BIGINT) AS n_test,
  {r6('avg(CASE WHEN y_rain = rain THEN 1.0 ELSE 0.0 END)')} AS rain_baseline_accuracy,
  {r6('avg(abs(y_temp_max - temp_max_c))')} AS temp_max_baseline_mae,
  {r6('avg(abs(y_temp_min - temp_min_c))')} AS temp_min_baseline_mae FROM split{h} WHERE is_test"""


@query(
    "q_baseline_scores",
    with_ctes(
        "daily",
        FEATURES_SQL,
        *[_labelled(h) for h in (1, 2, 3)],
        "\nUNION ALL\n".join(_baseline_part(h) for h in (1, 2, 3)),
    ),
)
def q_baseline_scores(spark, sf_dir):
    features = D.daily_features(c_daily(spark, sf_dir))
    parts = [
        V.persistence_scores(
            D.chrono_split(D.training_frame(features, h)).filter("is_test")
        ).withColumn("horizon_days", F.lit(h))
        for h in (1, 2, 3)
    ]
    return present(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "q_roc_auc",
    with_ctes(
        "daily",
        FEATURES_SQL,
        _preds_sql("features", "round(CASE WHEN precip_7d_mean_mm > 5 THEN 1 ELSE precip_7d_mean_mm / 5 END, 6)"),
        _JOINED,
        """scored AS (SELECT model_trained_at, horizon_days, actual_rain AS y, rain_probability AS s
  FROM joined WHERE actual_rain IS NOT NULL AND rain_probability IS NOT NULL)""",
        """ranked AS (SELECT *, rank() OVER (PARTITION BY model_trained_at, horizon_days ORDER BY s)
    + (count(*) OVER (PARTITION BY model_trained_at, horizon_days, s) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM scored)""",
        f"""SELECT model_trained_at, CAST(horizon_days AS BIGINT) AS horizon_days, CAST(sum(y) AS BIGINT) AS n_pos,
  CAST(sum(1 - y) AS BIGINT) AS n_neg,
  {r6('''(sum(CASE WHEN y = 1 THEN avg_rank ELSE 0 END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE))
    / nullif(CAST(sum(y) AS DOUBLE) * sum(1 - y), 0)''')} AS roc_auc
FROM ranked GROUP BY 1, 2""",
    ),
)
def q_roc_auc(spark, sf_dir):
    daily = c_daily(spark, sf_dir)
    wet = F.col("precip_7d_mean_mm")
    chance = F.round(F.when(wet > 5, F.lit(1.0)).otherwise(wet / 5), 6)
    preds = D.persistence_days(D.daily_features(daily), _version("date"), chance)
    joined = V.join_outcomes(preds, daily)
    by = ["model_trained_at", "horizon_days"]
    return present(V.roc_auc(joined, by, "actual_rain", F.col("rain_probability")))


@query(
    "q_class_weights",
    with_ctes(
        "daily",
        FEATURES_SQL,
        _labelled(1),
        f"""SELECT station_id, CAST(y_rain AS BIGINT) AS y_rain, CAST(count(*) AS BIGINT) AS n_class,
  {r6('''CAST(sum(count(*)) OVER (PARTITION BY station_id) AS DOUBLE)
    / (count(*) OVER (PARTITION BY station_id) * count(*))''')} AS weight
FROM split1 WHERE NOT is_test GROUP BY station_id, y_rain""",
    ),
)
def q_class_weights(spark, sf_dir):
    split = D.chrono_split(D.training_frame(D.daily_features(c_daily(spark, sf_dir)), 1))
    return present(V.class_weights(split.filter("NOT is_test"), ["station_id"], "y_rain"))
