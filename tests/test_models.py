import numpy as np
import pytest
from pyspark.sql import functions as F

from clubspark.operators import features as X
from clubspark.operators import models
from clubspark.plans.booking_queries import training


@pytest.fixture(scope="module")
def prepared(spark, sf):
    from clubspark.session import materialize

    complete = materialize(training(spark, sf, adjusted=True))
    scaled, scaler = models.prepare(complete)
    train = scaled.where(F.col("split") == "train").cache()
    return complete, scaled, scaler, train


def matrix(train):
    pdf = train.select("score", *X.FEATURES).toPandas().astype(float)
    return pdf[X.FEATURES].to_numpy(), pdf["score"].to_numpy()


def test_scaler(prepared):
    complete, scaled, scaler, _ = prepared
    pdf = complete.select(*X.SCALED).toPandas().astype(float)
    for name in X.SCALED:
        assert scaler[f"{name}_mean"] == pytest.approx(pdf[name].mean())
        assert scaler[f"{name}_sd"] == pytest.approx(pdf[name].std(ddof=0))


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(3.0,) * 5, (3.0,) * 5], ", ".join(f"{c} double" for c in X.SCALED))
    assert X.scaler_stats(df).first()["handicap_sd"] == 1.0


def test_least_squares(prepared):
    weights = dict(models.coefficients(models.fit("linear", prepared[3])))
    a, y = matrix(prepared[3])
    want = np.linalg.lstsq(np.column_stack([np.ones(len(y)), a]), y, rcond=None)[0]
    assert [weights["intercept"], *[weights[f] for f in X.FEATURES]] == pytest.approx(want.tolist(), rel=1e-4, abs=1e-4)


def test_ridge_closed_form(prepared):
    weights = dict(models.coefficients(models.fit("ridge", prepared[3])))
    a, y = matrix(prepared[3])
    centred = a - a.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + models.RIDGE_ALPHA * np.eye(a.shape[1]), centred.T @ (y - y.mean()))
    assert [weights[f] for f in X.FEATURES] == pytest.approx(want.tolist(), rel=1e-3, abs=1e-4)


def test_metrics(spark):
    df = spark.createDataFrame([(80, 81.0), (90, 88.0), (70, 71.5)], "score int, prediction double")
    row = models.metrics(df).first()
    y, p = np.array([80, 90, 70]), np.array([81.0, 88.0, 71.5])
    assert row["mse"] == pytest.approx(((y - p) ** 2).mean())
    assert row["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_bundle_round_trip(spark, prepared, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "BOOSTING_ROUNDS", 5)
    complete = prepared[0]
    bundle = models.train_bundle("gbt", complete)
    bundle.save(str(tmp_path))
    again = models.ModelBundle.load(spark, str(tmp_path))
    assert again.feature_names == X.FEATURES and again.r2 == bundle.r2
    assert again.scaler == pytest.approx(bundle.scaler)
    first = bundle.predict(complete).orderBy("round_id").limit(20).select("prediction").collect()
    assert first == again.predict(complete).orderBy("round_id").limit(20).select("prediction").collect()


def test_missing_columns_count_as_zero(prepared):
    complete, _, scaler, train = prepared
    bundle = models.ModelBundle(models.fit("linear", train), scaler, X.FEATURES, 0.0)
    frame = complete.limit(5).withColumn("extra", F.lit(1))
    assert bundle.predict(frame).where(F.col("prediction").isNotNull()).count() == 5


def test_scaler_on_training_rows_only(prepared):
    _, values = models.prepare(prepared[0], fit_scaler_on="train")
    assert values != prepared[2]
    with pytest.raises(ValueError):
        models.prepare(prepared[0], fit_scaler_on="test")


def test_boosting_learns(prepared, monkeypatch):
    monkeypatch.setattr(models, "BOOSTING_ROUNDS", 10)
    scored = models.fit("gbt", prepared[3]).transform(prepared[3])
    assert models.metrics(scored).first()["r2"] > 0.05


def test_features_with_unknown_weather(spark):
    df = spark.createDataFrame(
        [(None, 1.0, 20.0, 5), (10.0, 1.0, 20.0, 4)],
        "avg_temp double, precipitation double, wind_speed double, day_of_week_int int",
    )
    rows = X.engineer_features(df).collect()
    assert [(r["wind_precip"], r["wind_cold"], r["bad_weather_combo"], r["weekend"]) for r in rows] == [
        (20.0, 0.0, 0, True),
        (20.0, 20.0, 1, False),
    ]
    fahrenheit = df.withColumn("avg_temp", F.col("avg_temp") * 9 / 5 + 32)
    assert X.engineer_features(fahrenheit, "F").select(*X.ENGINEERED).collect() == X.engineer_features(df).select(*X.ENGINEERED).collect()


def test_split_target(spark):
    frame, target = X.split_target(spark.createDataFrame([(1, 2)], "score int, handicap int"))
    assert frame.columns == ["handicap"] and target.columns == ["score"]
    assert X.split_target(frame)[1] is None


def test_depth_bounds_the_trees(prepared):
    shallow = models.fit("gbt", prepared[3].limit(400), depth=1).stages[-1]
    assert {t.depth for t in shallow.trees} <= {0, 1}


def test_boosting_on_groups_equals_boosting_on_rows(prepared, monkeypatch):
    """Equal bins, one row: the same trees as over all rows, however often these are repeated."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    monkeypatch.setattr(models, "BOOSTING_ROUNDS", 5)
    train = prepared[3].orderBy("round_id").limit(3000).cache()
    repeated = train.crossJoin(train.sparkSession.range(3).select(F.lit(1).alias("_"))).drop("_")
    rows = VectorAssembler(inputCols=X.FEATURES, outputCol="features").transform(train)
    plain = GBTRegressor(labelCol="score", maxIter=5, stepSize=models.BOOSTING_RATE, maxDepth=models.BOOSTING_DEPTH, seed=models.SEED).fit(rows)
    want = [r[0] for r in plain.transform(rows).orderBy("round_id").select("prediction").collect()]
    for frame in (train, repeated):
        scored = models.fit("gbt", frame).transform(train)
        assert scored.columns == [*train.columns, "features", "prediction"]
        assert [r[0] for r in scored.orderBy("round_id").select("prediction").collect()] == pytest.approx(want, abs=1e-6)


def test_forest_samples_rows_of_groups(spark, prepared, monkeypatch):
    """Rows repeated 50 times are as many groups; samples hold the rows' number and mean; the forest learns and can be stored."""
    monkeypatch.setattr(models, "TREES", 6)
    train = prepared[3].limit(500).cache()
    repeated = train.crossJoin(spark.range(50).select(F.lit(1).alias("_"))).drop("_")
    stages, names = models._binning(repeated)
    groups = models._binned(train, stages, names).select(*names).distinct().count()
    drawn = models.bootstrap(models._binned(repeated, stages, names), names, 6).toPandas()
    assert len(drawn) == groups <= 500
    mean, sd = (repeated.agg(f("score")).first()[0] for f in (F.avg, F.stddev_pop))
    totals = [drawn[f"rows_{t}"].sum() for t in range(6)]
    assert len(set(totals)) > 1 and all(abs(n - 25_000) < 6 * 25_000**0.5 for n in totals)
    assert all(abs(drawn[f"sum_{t}"].sum() / totals[t] - mean) < 6 * sd / 25_000**0.5 for t in range(6))

    forest = models.fit("forest", train, depth=3)
    scored = forest.transform(train)
    assert scored.columns == [*train.columns, "features", "prediction"] and models.metrics(scored).first()["r2"] > 0.02
    assert sum(w for _, w in models.importances(forest)) == pytest.approx(1.0)


def test_cuts_are_the_trees_own():
    import pandas as pd

    cuts = models._cuts_of_feature(4)
    few = pd.DataFrame({"feature": "x", "value": [3.0, 1.0, 2.0], "count": [1, 1, 1]})
    assert cuts(few)["cuts"].iloc[0] == [1.5, 2.5]
    many = pd.DataFrame({"feature": "x", "value": [float(i) for i in range(8)], "count": [2] * 8})
    assert cuts(many)["cuts"].iloc[0] == [1.5, 3.5, 5.5]
