"""The four models: health, cash, failure, activity."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, RobustScaler, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.operators import forest
from tillwatch.operators.labels import expanding_folds, fold_count
from tillwatch.operators.scoring import (
    Figure,
    bounded_depletion,
    finish_record,
    formula_heads,
    newest_with_series,
    record_inputs,
)
from tillwatch.session import Stored, copy_path, remove_path, send_package, store, work_path, workspace
from tillwatch.sources.ingest import add_missing_columns

# Input columns of each model.
HEALTH_FEATURES = [
    "uptime_percentage", "error_count_7d", "maintenance_count_30d", "transaction_velocity", "days_since_maintenance",
]
CASH_FEATURES = [
    "cash_stress_indicator", "cash_consumption_rate", "days_since_replenishment", "transaction_count",
    "is_month_end", "deposit_bin_utilization", "is_salary_day", "is_holiday",
]
FAILURE_FEATURES = [
    "error_acceleration", "consecutive_downtime_mins", "health_trend_7d", "time_since_last_error",
    "error_type_diversity",
]
ACTIVITY_FEATURES = [
    "transaction_count", "peak_hour_transactions", "transaction_volatility", "weekend_vs_weekday_ratio",
]
MODEL_FEATURES = list(dict.fromkeys(HEALTH_FEATURES + CASH_FEATURES + FAILURE_FEATURES + ACTIVITY_FEATURES))
SEED = 42
FOREST_PART = 20  # trees at most of one part of a forest
FOREST_TREE_ROWS = 1 << 19  # rows times trees of such a part
FOREST_ROWS = 1 << 14  # distinct (cell, label) rows of a task that draws bags
FOREST_HELD = 1 << 20  # rows times trees of a forest that becomes Spark models, which the driver holds
FOREST_NODES = 1 << 23  # nodes of a stored forest that are loaded and broadcast at a time, 15 bytes each


@dataclass(frozen=True)
class Sizes:
    """Model sizes. The defaults are the full ones; tests train smaller models.

    Trees grow without a limit where the algorithm allows it; 30 levels are the most that Spark has.
    """

    trees: int = 200
    tree_depth: int = 30
    tree_bins: int = 32
    tree_leaf_rows: int = 1
    lasso_rounds: int = 10_000
    boosting_rounds: int = 150
    boosting_depth: int = 6
    learning_rate: float = 0.05
    subsample: float = 0.8
    lasso_alphas: int = 100
    cluster_starts: int = 10


def model_input(feats: DataFrame) -> DataFrame:
    """All model columns as doubles, absent ones and nulls as 0."""
    full = add_missing_columns(feats, MODEL_FEATURES)
    return full.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MODEL_FEATURES})


def _assembler(columns: list[str], head: str) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=f"_{head}_in")


class HealthForest(Estimator):
    """The health model's trees; the prediction is the mean over all of them.

    Each tree is grown in a task of its own (``forest``). A small forest becomes Spark models of at most ``FOREST_PART`` trees, a
    larger one a ``StoredForest``.
    """

    def __init__(self, sizes: Sizes):
        super().__init__()
        self.sizes = sizes

    def _fit(self, rows: DataFrame) -> PipelineModel:
        prepare = Pipeline(
            stages=[
                _assembler(HEALTH_FEATURES, "health"),
                StandardScaler(inputCol="_health_in", outputCol="_health_x", withMean=True, withStd=True),
            ]
        ).fit(rows)
        data = prepare.transform(rows).select(vector_to_array("_health_x").alias("x"), F.col("y_health").cast("double").alias("y"))
        lost = F.count_if(F.col("y").isNull() | F.isnan("y"))
        n_rows, bad, centre = data.agg(F.count("*"), lost, F.avg("y")).first()
        if bad or not n_rows:
            raise ValueError(f"{bad} of {n_rows} rows to fit the health forest on have no label")
        spark, sizes = rows.sparkSession, self.sizes
        send_package(spark)
        trees, held = sizes.trees, n_rows * sizes.trees <= FOREST_HELD
        each = max(1, min(FOREST_PART, FOREST_TREE_ROWS // n_rows))
        parts = [min(each, trees - first) for first in range(0, trees, each)]
        growth = forest.Growth(trees, sizes.tree_depth, sizes.tree_bins, sizes.tree_leaf_rows, SEED)
        thresholds = forest.find_thresholds(data, len(HEALTH_FEATURES), sizes.tree_bins)
        with Stored(forest.cells_of(data, thresholds, centre), "health-cells") as cells:
            grown = Stored(forest.trees_of(cells, thresholds, centre, growth, FOREST_ROWS, detail=held), "health-forest")
        if not held:
            return PipelineModel(stages=[*prepare.stages, StoredForest(grown.path, thresholds, _stored_parts(grown.frame, parts))])
        with grown as frame:
            fitted = self._held(frame, thresholds, parts)
        if len(parts) == 1:
            return PipelineModel(stages=[*prepare.stages, *fitted])
        names = [f"_health_pred_{i}" for i in range(len(parts))]
        total = " + ".join(f"{name} * {n}" for name, n in zip(names, parts))
        mean = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}), ({total}) / {trees} AS _health_pred FROM __THIS__")
        return PipelineModel(stages=[*prepare.stages, *[f.setPredictionCol(name) for f, name in zip(fitted, names)], mean])

    def _held(self, trees: DataFrame, thresholds: list[np.ndarray], parts: list[int]) -> list[RandomForestRegressionModel]:
        """Spark's own models of the trees, part by part, all written and loaded in one go."""
        spark, sizes = trees.sparkSession, self.sizes
        path, n = work_path(spark, "health-model"), sum(parts)
        own = RandomForestRegressor(
            featuresCol="_health_x", labelCol="y_health", predictionCol="_health_pred", numTrees=n, maxDepth=sizes.tree_depth,
            maxBins=sizes.tree_bins, minInstancesPerNode=sizes.tree_leaf_rows, featureSubsetStrategy="all", impurity="variance", seed=SEED,
        )
        set_ones = {p.name: v for p, v in own.extractParamMap().items() if own.isSet(p)}
        of_trees = {k: v for k, v in set_ones.items() if k not in ("numTrees", "featureSubsetStrategy")}
        metadata = lambda name, uid, params, **more: json.dumps({
            "class": f"org.apache.spark.ml.regression.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
            "paramMap": params, "defaultParamMap": {}, **more,
        })
        about = metadata("RandomForestRegressionModel", own.uid, set_ones, numFeatures=len(HEALTH_FEATURES), numTrees=n)
        each = [(i, metadata("DecisionTreeRegressionModel", f"{own.uid}_{i}", of_trees), 1.0) for i in range(n)]
        try:
            spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
            spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
            forest.spark_nodes(trees, thresholds).write.parquet(f"{path}/data")
            whole = RandomForestRegressionModel.load(path)
        finally:
            remove_path(spark, path)
        gateway, grown = spark.sparkContext._gateway, whole._java_obj.trees()
        regression, first, models = gateway.jvm.org.apache.spark.ml.regression, 0, []
        for i, n in enumerate(parts):
            some = gateway.new_array(regression.DecisionTreeRegressionModel, n)
            for k in range(n):
                some[k] = grown[first + k]
            first += n
            part = regression.RandomForestRegressionModel(f"{own.uid}_part_{i}", some, len(HEALTH_FEATURES))
            models.append(own.copy({own.numTrees: n})._copyValues(RandomForestRegressionModel(part)))
            models[-1]._transfer_params_to_java()  # the mean is over the number of trees that the model knows of
        return models


@dataclass(frozen=True)
class ForestPart:
    """Consecutive trees of a stored forest, and what is known of them without loading them."""

    first: int
    trees: int
    nodes: int
    importances: list[float]


def _stored_parts(grown: DataFrame, parts: list[int]) -> list[ForestPart]:
    trees = grown.select("tree", "nodes", "importances").orderBy("tree").collect()  # a few numbers per tree
    found, first = [], 0
    for n in parts:
        some = trees[first : first + n]
        shares = np.sum([t["importances"] for t in some], axis=0)
        shares = shares / shares.sum() if shares.any() else shares
        found.append(ForestPart(first, n, sum(t["nodes"] for t in some), [float(v) for v in shares]))
        first += n
    return found


class StoredForest(Transformer, MLReadable, MLWritable):
    """A forest whose trees stay where they are stored, as arrays. The driver and each executor's tasks load about ``FOREST_NODES``
    nodes of it, however many rows it was fitted on. A forest of more than that is scored in passes, when it is asked for and not
    later: the rows are stored, the passes add their predictions up in a stored table, and the mean is joined to the rows.
    """

    def __init__(self, path: str = "", thresholds: list[np.ndarray] = (), parts: list[ForestPart] = ()):
        super().__init__()
        self.path, self.thresholds, self.parts = path, list(thresholds), list(parts)

    def passes(self) -> list[list[ForestPart]]:
        """The parts that are loaded together."""
        found, nodes = [], 0
        for part in self.parts:
            if not found or nodes + part.nodes > FOREST_NODES:
                found.append([])
                nodes = 0
            found[-1].append(part)
            nodes += part.nodes
        return found

    def _sum(self, spark: SparkSession, some: list[ForestPart], x: Column) -> Column:
        """The sum of the predictions of some parts' trees."""
        send_package(spark)
        stored = spark.read.schema(forest.TREE).parquet(self.path)
        stored = stored.filter(F.col("tree").between(some[0].first, some[-1].first + some[-1].trees - 1))
        table = stored.select("tree", *forest.KINDS).toArrow().sort_by("tree")
        shared = spark.sparkContext.broadcast((self.thresholds, forest.unpacked(table, forest.KINDS)))

        @F.arrow_udf("double")
        def predictions(x: pa.Array) -> pa.Array:
            thresholds, trees = shared.value
            return pa.array(forest.add_predictions(trees, forest.binned(forest.matrix(x, len(thresholds)), thresholds)))

        return predictions(x)

    def _transform(self, rows: DataFrame) -> DataFrame:
        spark, passes, trees = rows.sparkSession, self.passes(), sum(part.trees for part in self.parts)
        x = vector_to_array("_health_x")
        if len(passes) == 1:
            return rows.withColumn("_health_pred", self._sum(spark, passes[0], x) / trees)
        kept = store(rows.withColumn("_health_row", F.monotonically_increasing_id()), "health-rows")
        before = Stored(kept.select("_health_row", x.alias("_health_x"), F.lit(0.0).alias("_health_sum")), "health-sums")
        for some in passes:
            total = F.col("_health_sum") + self._sum(spark, some, F.col("_health_x"))
            after = Stored(before.frame.select("_health_row", "_health_x", total.alias("_health_sum")), "health-sums")
            before.drop()
            before = after
        mean = (F.col("_health_sum") / trees).alias("_health_pred")
        return kept.join(before.frame.select("_health_row", mean), "_health_row").drop("_health_row")

    def write(self) -> MLWriter:
        return _StoredForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StoredForestReader()


class _StoredForestWriter(MLWriter):
    def __init__(self, stored: StoredForest):
        super().__init__()
        self.stored = stored

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        known = {
            "thresholds": [[float(v) for v in t] for t in self.stored.thresholds],
            "parts": [[p.first, p.trees, p.nodes, p.importances] for p in self.stored.parts],
        }
        DefaultParamsWriter.saveMetadata(self.stored, path, spark, extraMetadata=known)
        copy_path(spark, self.stored.path, f"{path}/trees")


class _StoredForestReader(MLReader):
    def load(self, path: str) -> StoredForest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        thresholds, parts = metadata["thresholds"], metadata["parts"]
        found = StoredForest(f"{path}/trees", [np.array(t) for t in thresholds], [ForestPart(*known) for known in parts])
        found._resetUid(metadata["uid"])
        return found


def health_estimator(sizes: Sizes = Sizes()) -> HealthForest:
    return HealthForest(sizes)


def failure_estimator(sizes: Sizes = Sizes()) -> Pipeline:
    booster = GBTClassifier(
        featuresCol="_failure_x", labelCol="y_failure", predictionCol="_failure_class", maxIter=sizes.boosting_rounds,
        stepSize=sizes.learning_rate, maxDepth=sizes.boosting_depth, subsamplingRate=sizes.subsample,
        featureSubsetStrategy=str(sizes.subsample), seed=SEED,
    )
    return Pipeline(
        stages=[
            _assembler(FAILURE_FEATURES, "failure"),
            StandardScaler(inputCol="_failure_in", outputCol="_failure_x", withMean=True, withStd=True),
            booster.setProbabilityCol("_failure_prob").setRawPredictionCol("_failure_raw"),
        ]
    )


# --- Lasso with its penalty chosen by cross-validation ----------------------------------


def _fold_sums(scaled: DataFrame, width: int) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
    """Per fold: row count and the sums of x, y, products. One aggregation, five small rows back."""
    x = [F.col("_x")[i] for i in range(width)] + [F.col("y_cash")]
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    rows = (
        scaled.groupBy("_fold")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)],
            *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .orderBy("_fold")
        .collect()  # one row per fold
    )
    sums = []
    for r in rows:
        p = np.zeros((width + 1, width + 1))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        sums.append((float(r["n"]), np.array([r[f"s{i}"] for i in range(width + 1)]), p))
    return sums


def _centred(n, s, p):
    c = p - np.outer(s, s) / n
    return c[:-1, :-1] / n, c[:-1, -1] / n, s / n


def _descend(gram: np.ndarray, xy: np.ndarray, alpha: float, w: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent on the normal equations of the lasso."""
    w = w.copy()
    for _ in range(rounds):
        step = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rho = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
            step = max(step, abs(new - w[j]))
            w[j] = new
        if step < 1e-10:
            break
    return w


def best_alpha(sums, n_alphas: int = 100, reach: float = 1e-3) -> float:
    """Penalty with the least mean squared error over held-out folds, from the folds' sums alone."""
    total = tuple(sum(parts[1:], parts[0]) for parts in zip(*sums))
    _, xy_all, _ = _centred(*total)
    top = float(np.abs(xy_all).max())
    if top <= 0 or len(sums) < 2:
        return 0.0
    alphas = np.geomspace(top, top * reach, n_alphas)
    errors = np.zeros(n_alphas)
    for held in sums:
        gram, xy, mean = _centred(*(t - h for t, h in zip(total, held)))
        n, s, p = held
        # Sums of the held-out rows around the means of the training rows.
        shifted = p - np.outer(s, mean) - np.outer(mean, s) + n * np.outer(mean, mean)
        w = np.zeros(len(xy))
        for k, alpha in enumerate(alphas):
            w = _descend(gram, xy, alpha, w)
            errors[k] += (shifted[-1, -1] - 2 * w @ shifted[:-1, -1] + w @ shifted[:-1, :-1] @ w) / n
    return float(alphas[int(errors.argmin())])


def fit_cash(train: DataFrame, sizes: Sizes = Sizes()) -> PipelineModel:
    """Robust scaling, then a lasso whose penalty comes from five contiguous folds.

    The penalty search needs only per-fold sums (one pass over the data); the chosen model is
    then fitted once by Spark so that it can be stored and applied like the others.
    """
    prepare = Pipeline(
        stages=[
            _assembler(CASH_FEATURES, "cash"),
            RobustScaler(inputCol="_cash_in", outputCol="_cash_x", withCentering=True, withScaling=True),
        ]
    ).fit(train)
    n = train.count()
    folds = min(5, n)
    # Contiguous folds; the first n mod k of them have one row more.
    small, longer = n // folds if folds else 1, n % folds if folds else 0
    index, bound = F.col("row_index"), longer * (small + 1)
    fold = F.when(index < bound, F.floor(index / (small + 1))).otherwise(longer + F.floor((index - bound) / max(1, small)))
    scaled = prepare.transform(train).select(fold.alias("_fold"), vector_to_array("_cash_x").alias("_x"), "y_cash")
    alpha = best_alpha(_fold_sums(scaled, len(CASH_FEATURES)), sizes.lasso_alphas)
    lasso = LinearRegression(
        featuresCol="_cash_x", labelCol="y_cash", predictionCol="_cash_pred", elasticNetParam=1.0, regParam=alpha,
        standardization=False, maxIter=sizes.lasso_rounds,
    )
    return PipelineModel(stages=[*prepare.stages, lasso.fit(prepare.transform(train).select("_cash_x", "y_cash"))])


def lasso_conditions(train: DataFrame, model: PipelineModel, tolerance: float) -> DataFrame:
    """Whether the fitted lasso meets its optimality conditions on the training rows.

    With r the residuals and p the penalty, the mean of x_j * r (centred) equals p * sign(w_j) for each
    weight that is not zero and is at most p otherwise. One row per feature; the sums are one aggregate.
    """
    lasso = model.stages[-1]
    weights, penalty = lasso.coefficients.toArray(), float(lasso.getRegParam())
    rows = model.transform(model_input(train))
    x = [vector_to_array("_cash_x")[i] for i in range(len(weights))]
    row = rows.agg(*[F.covar_pop(c, F.col("y_cash") - F.col("_cash_pred")).alias(f"c{i}") for i, c in enumerate(x)]).first()
    found = []
    for i, (name, w) in enumerate(zip(CASH_FEATURES, weights)):
        slope = float(row[f"c{i}"])
        good = abs(slope - penalty * np.sign(w)) <= tolerance if w else abs(slope) <= penalty + tolerance
        found.append((name, bool(good), slope, float(w)))
    return train.sparkSession.createDataFrame(found, "feature string, optimal boolean, slope double, weight double")


def fit_activity(train: DataFrame, sizes: Sizes = Sizes()) -> PipelineModel:
    """Three clusters, the best of several starts by within-cluster distance."""
    prepare = Pipeline(
        stages=[
            _assembler(ACTIVITY_FEATURES, "activity"),
            MinMaxScaler(inputCol="_activity_in", outputCol="_activity_x"),
        ]
    ).fit(train)
    with Stored(prepare.transform(train).select("_activity_x"), "clusters") as scaled:
        fits = [
            KMeans(featuresCol="_activity_x", predictionCol="_cluster", k=3, seed=SEED + i).fit(scaled)
            for i in range(sizes.cluster_starts)
        ]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return PipelineModel(stages=[*prepare.stages, best])


# --- training -----------------------------------------------------------------------------


@dataclass
class FleetModels:
    """Trained heads; a missing one falls back to its formula."""

    health: PipelineModel | None = None
    cash: PipelineModel | None = None
    failure: PipelineModel | None = None
    activity: PipelineModel | None = None
    metrics: dict = field(default_factory=dict)

    HEADS = ("health", "cash", "failure", "activity")

    def save(self, path: str) -> None:
        present = [head for head in self.HEADS if getattr(self, head) is not None]
        for head in present:
            getattr(self, head).write().overwrite().save(f"{path}/{head}")
        names = SparkSession.active().createDataFrame([(head,) for head in present], "head string")
        names.coalesce(1).write.mode("overwrite").text(f"{path}/heads")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FleetModels":
        present = [row[0] for row in spark.read.text(f"{path}/heads").collect()]  # at most four names
        return cls(**{head: PipelineModel.load(f"{path}/{head}") for head in present})

    def activity_names(self) -> dict[int, str]:
        """Cluster number to name, by the first coordinate of its centre."""
        centres = self.activity.stages[-1].clusterCenters()
        order = sorted(range(len(centres)), key=lambda i: centres[i][0])
        return dict(zip(order, ["Low", "Moderate", "High"]))

    def health_importances(self) -> dict[str, float]:
        stored = [part for stage in self.health.stages if isinstance(stage, StoredForest) for part in stage.parts]
        held = [stage for stage in self.health.stages if isinstance(stage, RandomForestRegressionModel)]
        each = [p.importances for p in stored] + [p.featureImportances.toArray() for p in held]
        mean = np.average(each, axis=0, weights=[p.trees for p in stored] + [p.getNumTrees for p in held])
        return dict(zip(HEALTH_FEATURES, (round(float(v), 12) for v in mean)))  # both kinds agree but for the order of sums


def r2_by_fold(folds: DataFrame, n_rows: int, sizes: Sizes = Sizes()) -> dict[int, float]:
    """Health model fitted on the rows before each test block, scored on the block."""
    evaluator = RegressionEvaluator(labelCol="y_health", predictionCol="_health_pred", metricName="r2")
    scores = {}
    for i in range(1, fold_count(n_rows) + 1):
        with workspace(folds.sparkSession):  # a fold's forest is of no use after its score
            model = health_estimator(sizes).fit(folds.filter(F.col("fold") < i))
            scores[i] = evaluator.evaluate(model.transform(folds.filter(F.col("fold") == i)))
    return scores


def train(labelled: DataFrame, sizes: Sizes = Sizes(), *, real_labels: bool = False, heads=FleetModels.HEADS,
          score: bool = True) -> FleetModels:
    """Fit the chosen heads on features with ``y_health``, ``y_cash`` and ``y_failure``.

    The columns of the chosen heads are written out once, so neither a fit nor a retried task computes
    the features again, and removed after the last fit. Nothing but model parameters and metrics
    comes back to the driver.
    """
    used = {"health": HEALTH_FEATURES, "cash": CASH_FEATURES, "failure": FAILURE_FEATURES, "activity": ACTIVITY_FEATURES}
    targets = {"health": ["y_health"], "cash": ["y_cash"], "failure": ["y_failure"], "activity": []}
    columns = dict.fromkeys(c for head in heads for c in [*used[head], *targets[head]])
    ordered = "cash" in heads or ("health" in heads and score)  # only these heads need positions or folds
    rows = model_input(labelled).select("atm_id", "record_date", *columns)
    models = FleetModels()
    with Stored(rows, "training") as rows:
        n = rows.count()
        if n == 0:
            models.metrics = {"status": "no_data"}
            return models
        models.metrics = {"rows_trained": n, "used_real_labels": real_labels}
        if not ordered:
            _fit_heads(models, rows, n, sizes, heads, score)
            return models
        with Stored(expanding_folds(rows), "training-folds") as folds:
            _fit_heads(models, folds, n, sizes, heads, score)
    return models


def _fit_heads(models: FleetModels, data: DataFrame, n: int, sizes: Sizes, heads, score: bool) -> None:
    """Fit on stored rows; each head reads its own columns."""
    if "health" in heads:
        if score:
            by_fold = r2_by_fold(data.select(*HEALTH_FEATURES, "y_health", "fold"), n, sizes)
            models.metrics["r2_by_fold"] = by_fold
            models.metrics["health_r2"] = round(sum(by_fold.values()) / len(by_fold), 4)
        models.health = health_estimator(sizes).fit(data.select(*HEALTH_FEATURES, "y_health"))
    if "cash" in heads:
        models.cash = fit_cash(data.select(*CASH_FEATURES, "y_cash", "row_index"), sizes)
    if "failure" in heads and data.select("y_failure").distinct().count() >= 2:
        models.failure = failure_estimator(sizes).fit(data.select(*FAILURE_FEATURES, "y_failure"))
    if "activity" in heads:
        models.activity = fit_activity(data.select(*ACTIVITY_FEATURES), sizes)


# --- how good a head is ---------------------------------------------------------------------


def _squares(model: PipelineModel, rows: DataFrame, label: str, prediction: str) -> float:
    """Share of the label's variance that the predictions explain."""
    left = F.pow(F.col(prediction) - F.col(label), 2)
    row = model.transform(rows).agg(F.avg(left).alias("left"), F.var_pop(label).alias("whole")).first()
    return 1 - row["left"] / row["whole"] if row["whole"] else 0.0


def _log_loss(model: PipelineModel, rows: DataFrame) -> float:
    """Share of the log loss of the label rate that the probabilities save."""
    p = F.greatest(F.least(vector_to_array("_failure_prob")[1], F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = F.when(F.col("y_failure") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    row = model.transform(rows).agg(F.avg(loss).alias("loss"), F.avg("y_failure").alias("rate")).first()
    rate = row["rate"]
    if rate is None or rate in (0, 1):
        return 0.0
    return float(1 - row["loss"] / -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate)))


def centre_distances(column: str, centres) -> list[Column]:
    """Squared distance of a vector column to each centre."""
    x = vector_to_array(column)
    return [sum((F.pow(x[i] - float(v), 2) for i, v in enumerate(centre)), F.lit(0.0)) for centre in centres]


def _clusters(model: PipelineModel, rows: DataFrame) -> tuple[float, int]:
    """Share of the squared distances from the mean that the clusters take away, and the number of rows
    that another centre is nearer to than their own."""
    found = model.transform(rows)
    near = centre_distances("_activity_x", model.stages[-1].clusterCenters())
    own = F.get(F.array(*near), F.col("_cluster"))
    x = vector_to_array("_activity_x")
    spread = sum((F.var_pop(x[i]) for i in range(len(ACTIVITY_FEATURES))), F.lit(0.0))
    astray = F.count_if(own > F.array_min(F.array(*near)) + 1e-12)
    row = found.agg(F.avg(own).alias("within"), spread.alias("whole"), astray.alias("astray")).first()
    return (1 - row["within"] / row["whole"] if row["whole"] else 0.0), row["astray"]


def skill(models: FleetModels, labelled: DataFrame, head: str) -> float:
    """What a head explains of its labelled rows: 0 for a constant, 1 at best. Clusters with stray rows count 0."""
    rows, model = model_input(labelled), getattr(models, head)
    if model is None:
        return 0.0
    if head == "health":
        with workspace(rows.sparkSession):
            return _squares(model, rows.select(*HEALTH_FEATURES, "y_health"), "y_health", "_health_pred")
    if head == "cash":
        return _squares(model, rows, "y_cash", "_cash_pred")
    if head == "failure":
        return _log_loss(model, rows)
    share, astray = _clusters(model, rows)
    return 0.0 if astray else share


# --- scoring ------------------------------------------------------------------------------


def model_heads(latest: DataFrame, models: FleetModels) -> tuple[DataFrame, dict[str, Figure]]:
    """Apply the models to the newest rows; returns the frame and the head expressions on it.

    The models read zeros for nulls; afterwards the columns get their own values back.
    """
    own = [c for c in MODEL_FEATURES if c in latest.columns]
    scored = model_input(latest.withColumns({f"_own_{c}": F.col(c) for c in own}))
    for head in FleetModels.HEADS:
        model = getattr(models, head)
        if model is not None:
            scored = model.transform(scored)
    found: dict[str, Figure] = {}
    if models.health is not None:
        found["health_score"] = (F.col("_health_pred"), 1)
    if models.cash is not None:
        found["days_to_depletion"] = bounded_depletion(F.col("_cash_pred"), latest.columns)
    if models.failure is not None:
        scored = scored.withColumn("_failure_p", vector_to_array("_failure_prob")[1])
        found["failure_probability"] = (F.col("_failure_p"), 3)
    if models.activity is not None:
        label = F
        for number, name in models.activity_names().items():
            label = label.when(F.col("_cluster") == number, name)
        found["activity_level"] = (label.otherwise("Moderate"), None)
    return scored.withColumns({c: F.col(f"_own_{c}") for c in own}).drop(*[f"_own_{c}" for c in own]), found


def predict_fleet(feats: DataFrame, as_of, models: FleetModels) -> DataFrame:
    """Prediction record per machine with the trained heads; untrained ones use their formula."""
    latest, found = model_heads(newest_with_series(record_inputs(feats, MODEL_FEATURES), as_of), models)
    return finish_record(latest, as_of, {**formula_heads(feats.columns), **found})
