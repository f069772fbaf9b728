"""Score prediction with Spark ML: fits, metrics, bundles, batch scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clubspark.operators import features as X
from clubspark.session import materialize

# The estimators' settings.
RIDGE_ALPHA = 50.0
TREES = 100
BOOSTING_ROUNDS = 100
BOOSTING_RATE = 0.1
BOOSTING_DEPTH = 3
FOREST_DEPTH = 8
SEED = 42
#: Values of a feature that a tree tells apart: the estimators' ``maxBins``.
BINS = 32
#: Trees of a forest that are grown at the same time.
AT_ONCE = 6
KINDS = ("linear", "ridge", "forest", "gbt")


def _ridge(train: DataFrame) -> LinearRegression:
    """Ridge with penalty alpha * |w|^2 on the sum of squared errors.

    The estimator minimises the mean squared error of the label divided by its
    sd, so the penalty is scaled by sd / n.
    """
    row = train.agg(F.stddev_pop("score").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    return LinearRegression(standardization=False, solver="normal", regParam=RIDGE_ALPHA * row["sd"] / row["n"])


def _cuts_of_feature(bins: int):
    """(feature, value, count) of one feature to its cuts: between all neighbouring values, or nearest to even shares of the rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("value")
        values, reached = frame["value"].to_numpy(), frame["count"].cumsum().to_numpy()
        middles = (values[:-1] + values[1:]) / 2
        if len(values) > bins:
            step = target = reached[-1] / bins
            kept = []
            for i, middle in enumerate(middles):
                if abs(reached[i] - target) < abs(reached[i + 1] - target):
                    kept.append(middle)
                    target += step
            middles = np.array(kept)
        return pd.DataFrame({"feature": frame["feature"].iloc[:1], "cuts": [middles.tolist()]})

    return run


def cut_points(train: DataFrame) -> dict[str, list[float]]:
    """At most ``BINS`` - 1 cuts per feature, from the counts of its distinct values over all rows."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in X.FEATURES]
    counts = train.select(F.inline(F.array(*pairs))).where("value IS NOT NULL AND NOT isnan(value)").groupBy("feature", "value").count()
    rows = counts.groupBy("feature").applyInPandas(_cuts_of_feature(BINS), "feature string, cuts array<double>").collect()
    return {row["feature"]: row["cuts"] for row in rows}


def _binning(train: DataFrame) -> tuple[list, list[str]]:
    """(stages that give the bins of a row as vector ``features``, names of the columns in it).

    Trees compare a feature with its cuts and see no more of it, so a row's bins are all they need.  Booleans and
    features of one value stay as they are.
    """
    cuts = cut_points(train)
    cut = [c for c in X.FEATURES if cuts.get(c) and not isinstance(train.schema[c].dataType, T.BooleanType)]
    # a bin is open to the right, a branch closed: the next number after the cut begins the bin
    splits = [[-math.inf, *(math.nextafter(x, math.inf) for x in cuts[c]), math.inf] for c in cut]
    names = [f"{c}_bin" if c in cut else c for c in X.FEATURES]
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    if not cut:
        return [assembler], names
    bucketizer = Bucketizer(inputCols=cut, outputCols=[f"{c}_bin" for c in cut], splitsArray=splits, handleInvalid="keep")
    dropped = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'{c}_bin' for c in cut)}) FROM __THIS__")
    return [bucketizer, assembler, dropped], names


def _binned(train: DataFrame, stages: list, names: list[str]) -> DataFrame:
    rows = train.select("score", *X.FEATURES)
    rows = stages[0].transform(rows) if len(stages) > 1 else rows
    # the cast also drops the mark of the bins as categories: trees are to cut them in their order
    return rows.select("score", *[F.col(c).cast("double").alias(c) for c in names])


def _drawn_in_task(names: list[str], trees: int, seed: int, at_a_time: int = 256):
    """Rows of equal bins, as lists of (score, count, key), to their bootstrap samples: per tree the rows drawn and their sum of scores.

    A row is drawn as often as a Poisson number of mean 1 says, so ``count`` equal rows together as one of mean
    ``count`` says.  Draws are hashes of the key and the tree, whatever the partition.
    """

    def shares(mean: int) -> tuple[int, np.ndarray]:
        first = max(0, int(mean - 12 * math.sqrt(mean) - 12))
        logs = [k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(first, int(mean + 12 * math.sqrt(mean) + 24))]
        return first, np.cumsum(np.exp(logs))

    def uniform(keys: np.ndarray) -> np.ndarray:
        steps = np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(seed * 1000)
        z = keys[:, None] + steps[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, at_a_time):
                batch = whole.slice(at, at_a_time)
                lists = batch.column(batch.schema.get_field_index("scores"))
                cells = lists.flatten()
                score, count, key = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                draws = uniform(key.view(np.uint64))
                for n in np.unique(count).tolist():
                    if n not in known:
                        known[n] = shares(n)
                    first, reached = known[n]
                    draws[count == n] = first + np.searchsorted(reached, draws[count == n], side="right")
                begins = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())[:-1]])
                rows = np.add.reduceat(draws, begins, axis=0)
                sums = np.add.reduceat(draws * score[:, None], begins, axis=0)
                kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
                numbers = [pa.array(np.ascontiguousarray(m[:, t])) for t in range(trees) for m in (rows, sums)]
                titles = [f"{what}_{t}" for t in range(trees) for what in ("rows", "sum")]
                yield pa.RecordBatch.from_arrays([*kept, *numbers], [*names, *titles])

    return run


def bootstrap(binned: DataFrame, names: list[str], trees: int) -> DataFrame:
    """Distinct bins with, for each tree, ``rows_t`` and ``sum_t`` of a bootstrap sample of all rows."""
    cells = binned.groupBy(*names, F.col("score").cast("double").alias("score")).agg(F.count(F.lit(1)).alias("count"))
    cell = F.struct("score", "count", F.xxhash64(*names, "score").alias("key"))
    groups = cells.groupBy(*names).agg(F.collect_list(cell).alias("scores"))
    numbers = [T.StructField(f"{what}_{t}", T.DoubleType()) for t in range(trees) for what in ("rows", "sum")]
    schema = T.StructType([*(binned.schema[c] for c in names), *numbers])
    return groups.mapInArrow(_drawn_in_task(names, trees, SEED), schema)


def _forest(train: DataFrame, depth: int) -> PipelineModel:
    """Trees of bootstrap samples of the rows, all features tried at each split; the prediction is their mean."""
    stages, names = _binning(train)
    drawn = materialize(bootstrap(_binned(train, stages, names), names, TREES))
    assembler = VectorAssembler(inputCols=names, outputCol="features")

    def grow(t: int):
        sample = drawn.where(F.col(f"rows_{t}") > 0).select(*names, f"rows_{t}", (F.col(f"sum_{t}") / F.col(f"rows_{t}")).alias("score"))
        tree = DecisionTreeRegressor(labelCol="score", weightCol=f"rows_{t}", predictionCol=f"tree_{t}", maxBins=BINS, maxDepth=depth, seed=SEED)
        return tree.fit(assembler.transform(sample))

    with ThreadPool(AT_ONCE) as pool:
        trees = pool.map(inheritable_thread_target(train.sparkSession)(grow), range(TREES))
    each = [f"tree_{t}" for t in range(TREES)]
    mean = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(each)}), ({' + '.join(each)}) / {TREES} AS prediction FROM __THIS__")
    return PipelineModel([*stages, *trees, mean])


def _boosting(train: DataFrame, depth: int) -> PipelineModel:
    """Boosted trees on one weighted row per distinct bins: rows with equal bins have one prediction, so only the mean of their scores counts."""
    stages, names = _binning(train)
    groups = _binned(train, stages, names).groupBy(*names).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("rows"))
    model = GBTRegressor(
        labelCol="score", weightCol="rows", maxBins=BINS, maxIter=BOOSTING_ROUNDS, stepSize=BOOSTING_RATE, maxDepth=depth, seed=SEED
    )
    return PipelineModel([*stages, model.fit(VectorAssembler(inputCols=names, outputCol="features").transform(materialize(groups)))])


def fit(kind: str, train: DataFrame, depth: int | None = None) -> PipelineModel:
    """Fit one model on scaled features; pass a materialised frame, it is read several times.

    ``depth`` bounds the trees of a forest or of boosting, 30 at most: a tree has up to 2**depth leaves.  It defaults to
    8 for forests, 3 for boosting.  Trees are grown on the counts and sums of rows with equal bins, two passes over the
    rows and then as many groups as bins and days of weather allow, however many rows there are.
    """
    if kind == "forest":
        return _forest(train, depth or FOREST_DEPTH)
    if kind == "gbt":
        return _boosting(train, depth or BOOSTING_DEPTH)
    if kind not in KINDS:
        raise ValueError(f"unknown model kind {kind!r}")
    model = LinearRegression(solver="normal") if kind == "linear" else _ridge(train)
    assembler = VectorAssembler(inputCols=X.FEATURES, outputCol="features", handleInvalid="keep")
    fitted = model.setLabelCol("score").fit(assembler.transform(train.select("score", *X.FEATURES)))
    return PipelineModel([assembler, fitted])


def metrics(scored: DataFrame) -> DataFrame:
    """R2, MSE, RMSE and mean prediction, in one pass; grouped by model where there is such a column."""
    groups = ["model"] if "model" in scored.columns else []
    error = F.col("score") - F.col("prediction")
    mse = F.avg(error * error)
    return scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        (1 - mse / F.var_pop("score")).alias("r2"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg("prediction").alias("mean_prediction"),
    )


def actual_vs_predicted(scored: DataFrame) -> DataFrame:
    """Rounds per actual and rounded predicted score: the points of the comparison chart."""
    return scored.groupBy("score", F.bround("prediction").cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("rounds")
    )


def coefficients(model: PipelineModel) -> list[tuple[str, float]]:
    """(name, weight) of a linear model, intercept first: as many rows as features."""
    last = model.stages[-1]
    return [("intercept", float(last.intercept)), *zip(X.FEATURES, (float(w) for w in last.coefficients))]


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(name, share) of a tree model: the mean over the trees of a forest."""
    total = sum(stage.featureImportances.toArray() for stage in model.stages if hasattr(stage, "featureImportances"))
    return list(zip(X.FEATURES, (total / (total.sum() or 1.0)).tolist()))


@dataclass
class ModelBundle:
    """A fitted model with its scaler, feature order and quality."""

    model: PipelineModel
    scaler: dict[str, float]
    feature_names: list[str]
    r2: float

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        names, values = list(self.scaler), [float(v) for v in self.scaler.values()]
        row = [(names, values, self.feature_names, float(self.r2))]
        schema = "names array<string>, vals array<double>, feature_names array<string>, r2 double"
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelBundle:
        row = spark.read.parquet(f"{path}/metadata").first()
        return cls(PipelineModel.load(f"{path}/model"), dict(zip(row["names"], row["vals"])), row["feature_names"], row["r2"])

    def predict(self, frame: DataFrame) -> DataFrame:
        """Add ``prediction`` to rows of base features; columns the model knows and the frame lacks count as 0."""
        scaled = X.apply_scaler(X.engineer_features(frame), self.scaler)
        missing = {name: F.lit(0) for name in self.feature_names if name not in scaled.columns}
        return self.model.transform(scaled.withColumns(missing)).drop("features")


def prepare(complete: DataFrame, fit_scaler_on: str = "all") -> tuple[DataFrame, dict[str, float]]:
    """(scaled features with a ``split`` column, scaler values).

    The scaler sees all rows by default, as the stated procedure does, or the
    training rows only.
    """
    split = complete.withColumn("split", X.split_flag())
    if fit_scaler_on not in ("all", "train"):
        raise ValueError(f"unknown fit_scaler_on {fit_scaler_on!r}")
    seen = split if fit_scaler_on == "all" else split.where(F.col("split") == "train")
    scaler = X.scaler_stats(seen).first().asDict()
    return X.apply_scaler(split, scaler), scaler


def train_bundle(
    kind: str, complete: DataFrame, fit_scaler_on: str = "all", depth: int | None = None
) -> ModelBundle:
    scaled, scaler = prepare(complete, fit_scaler_on)
    model = fit(kind, scaled.where(F.col("split") == "train"), depth)
    test = model.transform(scaled.where(F.col("split") == "test"))
    return ModelBundle(model, scaler, list(X.FEATURES), metrics(test).first()["r2"])
