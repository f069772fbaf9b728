"""Model fits, metrics and batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubspark.operators import bookings, features, models
from clubspark.plans import domain as D
from clubspark.plans.booking_queries import BOOKED, _stats, training
from clubspark.plans.registry import hash_sql, query, with_views
from clubspark.plans.statistics_queries import rounded
from clubspark.session import materialize, shared_folder


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scaled (train, test) rows, read from a table written once."""
    scaled, _ = models.prepare(materialize(training(spark, sf, adjusted=True)))
    return scaled.where(F.col("split") == "train"), scaled.where(F.col("split") == "test")


def _solved(penalty: float, views: str | None = None) -> str:
    """Views up to ``solution`` (w, intercept): the normal equations of the training rows by Gauss-Jordan steps."""
    names = features.FEATURES
    columns = ", ".join(
        f"({c} - (SELECT avg({c}) FROM adjusted_complete)) / (SELECT stddev_pop({c}) FROM adjusted_complete) AS {c}"
        if c in features.SCALED
        else f"CAST({c} AS DOUBLE) AS {c}"
        for c in names
    )
    rows = ", ".join(
        "[" + ", ".join([*(f"count(*) * covar_pop({a}, {b}) + {penalty if a == b else 0}" for b in names),
                         f"count(*) * covar_pop({a}, y)"]) + "]"
        for a in names
    )
    size = len(names)
    weighed = " - ".join(["y", *(f"m[{i}][{size + 1}] * mean[{i}]" for i in range(1, size + 1))])
    views = with_views("", "adjusted_complete") if views is None else views
    return views.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, scaled AS (
  SELECT round_id, CAST(score AS DOUBLE) AS y, {hash_sql('round_id', 42)} % 10 < 8 AS train, {columns} FROM adjusted_complete
), sums AS (
  SELECT [{rows}] AS m, [{', '.join(f'avg({c})' for c in names)}] AS mean, avg(y) AS y FROM scaled WHERE train
), steps AS (
  SELECT 1 AS k, m FROM sums
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: list_transform(r, lambda v, j:
    CASE WHEN i = k THEN v / m[k][k] ELSE v - r[k] * m[k][j] / m[k][k] END)) FROM steps WHERE k <= {size}
), solution AS (
  SELECT list_transform(steps.m, lambda r: r[{size + 1}]) AS w, {weighed.replace('m[', 'steps.m[')} AS intercept
  FROM steps, sums WHERE k = {size + 1}
)
"""


def _weights_sql(penalty: float) -> str:
    listed = ", ".join(f"'{c}'" for c in features.FEATURES)
    return _solved(penalty) + f"""
SELECT feature, round(coefficient, 4) + 0.0 AS coefficient FROM (
  SELECT 'intercept' AS feature, intercept AS coefficient FROM solution
  UNION ALL SELECT unnest([{listed}]), unnest(w) FROM solution)"""


def _coefficients(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    rows = models.coefficients(models.fit(kind, _split(spark, sf)[0]))
    out = _weights(spark, rows, "coefficient")
    return out.withColumn("coefficient", F.round("coefficient", 4) + F.lit(0.0))


def _weights(spark: SparkSession, rows: list[tuple[str, float]], name: str) -> DataFrame:
    return spark.createDataFrame(rows, f"feature string, {name} double")


@query("model_linear", _weights_sql(0.0))
def model_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(spark, sf, "linear")


@query("model_ridge", _weights_sql(models.RIDGE_ALPHA))
def model_ridge(spark: SparkSession, sf: str) -> DataFrame:
    return _coefficients(spark, sf, "ridge")


@query("model_forest")
def model_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, models.importances(models.fit("forest", _split(spark, sf)[0])), "importance")


@query("model_gbt")
def model_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, models.importances(models.fit("gbt", _split(spark, sf)[0])), "importance")


@query("model_metrics")
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of the four models, in one pass over their predictions."""
    return _metrics(spark, sf, models.KINDS)


def _metrics(spark: SparkSession, sf: str, kinds: tuple[str, ...]) -> DataFrame:
    train, test = _split(spark, sf)
    scored = [
        models.fit(kind, train).transform(test).select(F.lit(kind).alias("model"), "score", "prediction")
        for kind in kinds
    ]
    both = scored[0]
    for frame in scored[1:]:
        both = both.union(frame)
    return models.metrics(both)


_LINE = " + ".join(["intercept", *(f"w[{i}] * {c}" for i, c in enumerate(features.FEATURES, 1))])


@query("actual_vs_predicted", _solved(0.0) + f"""
SELECT CAST(y AS INTEGER) AS score, CAST(round_even({_LINE}, 0) AS INTEGER) AS predicted, count(*) AS rounds
FROM scaled, solution WHERE NOT train GROUP BY 1, 2""")
def actual_vs_predicted(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    return models.actual_vs_predicted(models.fit("linear", train).transform(test))


def _quality_sql(kind: str, penalty: float) -> str:
    return f"""SELECT * FROM ({_solved(penalty)}, guessed AS (SELECT y, {_LINE} AS guess FROM scaled, solution WHERE NOT train)
SELECT '{kind}' AS model, count(*) AS rows, round(1 - avg(pow(y - guess, 2)) / var_pop(y), 6) AS r2, round(avg(pow(y - guess, 2)), 6) AS mse,
  round(sqrt(avg(pow(y - guess, 2))), 6) AS rmse, round(avg(guess), 6) AS mean_prediction FROM guessed) AS {kind}"""


@query("model_metrics_linear", _quality_sql("linear", 0.0) + "\nUNION ALL " + _quality_sql("ridge", models.RIDGE_ALPHA))
def model_metrics_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Test metrics of the two models that have a closed form."""
    return rounded(_metrics(spark, sf, ("linear", "ridge")), "r2", "mse", "rmse", "mean_prediction")


def _asked_sql() -> str:
    """A booking's model inputs, scaled as the training rows are; an unknown comparison is false."""
    engineered = {
        "wind_precip": "precipitation * wind_speed",
        "wind_cold": "wind_speed * CASE WHEN avg_temp < 15 THEN 1 ELSE 0 END",
        "bad_weather_combo": "CASE WHEN wind_speed > 15 AND precipitation > 0.5 AND avg_temp < 15 THEN 1 ELSE 0 END",
        "weekend": "CASE WHEN dow >= 5 THEN 1 ELSE 0 END",
        "day_of_week_int": "dow",
    }
    terms = ["intercept"]
    for i, c in enumerate(features.FEATURES, 1):
        value = engineered.get(c, "known_handicap" if c == "handicap" else c)
        if c in features.SCALED:
            value = f"({value} - (SELECT avg({c}) FROM adjusted_complete)) / (SELECT stddev_pop({c}) FROM adjusted_complete)"
        terms.append(f"w[{i}] * ({value})")
    return " + ".join(terms)


_BOOKING_VIEWS = with_views("", "adjusted_complete", "requests", "players", "handicaps", "rounds", "weather")


@query("score_bookings_linear", _solved(0.0, _BOOKING_VIEWS) + BOOKED + f"""
SELECT booking_id, player_id, CASE WHEN reject_reason IS NULL THEN amount END AS price_paid,
  CASE WHEN reject_reason IS NULL THEN round_even({_asked_sql()}, 0) END AS score_prediction, reject_reason
FROM judged, solution""")
def score_bookings_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Booking requests with price and predicted score from a saved and reloaded linear model."""
    return _scored_bookings(spark, sf, "linear")


@query("score_bookings")
def score_bookings(spark: SparkSession, sf: str) -> DataFrame:
    """Booking requests with price and predicted score from a saved and reloaded model."""
    return _scored_bookings(spark, sf, "gbt")


def _scored_bookings(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    path = shared_folder(spark)
    models.train_bundle(kind, materialize(training(spark, sf, adjusted=True))).save(path)
    bundle = models.ModelBundle.load(spark, path)
    asked, weather = D.booking_requests(spark, sf), D.weather_once(spark, sf)
    players, rounds = _stats(spark, sf, weather, asked)
    booked = bookings.book(asked, players, rounds, weather, predict=bundle.predict)
    return booked.select("booking_id", "player_id", "price_paid", "score_prediction", "reject_reason")
