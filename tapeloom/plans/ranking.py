"""Cross-sectional rankers and the morning-scan ranker (MLlib)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.ordered import percentile_ranks
from tapeloom.functions.scalar import log_target
from tapeloom.operators.scan import MORNING_FEATURES
from tapeloom.plans.training import input_columns, with_inputs


def _fit(estimator, rows: DataFrame, names: Sequence[str]) -> Model:
    return Pipeline(stages=[VectorAssembler(inputCols=input_columns(names), outputCol="inputs"), estimator]).fit(with_inputs(rows, names))


def predict(model: Model, rows: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    return model.transform(with_inputs(rows, names)).select(*rows.columns, F.col("prediction").alias(out))


def fit_boosted(rows: DataFrame, names: Sequence[str], label: str = "y_rank", seed: int = 0, max_iter: int = 300, step: float = 0.05, depth: int = 5) -> Model:
    return _fit(GBTRegressor(featuresCol="inputs", labelCol=label, maxIter=max_iter, stepSize=step, maxDepth=depth, seed=seed), rows, names)


def fit_forest(rows: DataFrame, names: Sequence[str], label: str = "y_rank", seed: int = 0, trees: int = 50) -> Model:
    return _fit(RandomForestRegressor(featuresCol="inputs", labelCol=label, numTrees=trees, seed=seed), rows, names)


def fit_morning_ranker(dataset: DataFrame, names: Sequence[str] = MORNING_FEATURES, seed: int = 7, max_iter: int = 50) -> Model:
    """Regressor on the logarithm of the realised label."""
    rows = dataset.where(F.col("label").isNotNull()).withColumn("y", log_target("label"))
    return fit_boosted(rows, names, "y", seed, max_iter, 0.1)


def yearly_models(dataset: DataFrame, years: Sequence[int], names: Sequence[str], fit: Callable[[DataFrame, Sequence[str]], Model], at_once: int = 1) -> dict[int, Model]:
    """One model per out-of-sample year, fitted on samples up to 30 November of the year before; ``at_once`` fits run side by side."""
    train = dataset.dropna(subset=["fwd_ret", "y_rank"])

    def one(year: int) -> Model:
        return fit(train.where(F.col("date") <= F.make_date(F.lit(year - 1), F.lit(11), F.lit(30))), names)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return dict(zip(years, pool.map(inheritable_thread_target(dataset.sparkSession)(one), years)))


def predict_scores(dataset: DataFrame, models: dict[int, Model], names: Sequence[str]) -> DataFrame:
    out = None
    for year, model in models.items():
        one = predict(model, dataset.where(F.year("date") == year), names, "score").select("date", "symbol", "score", "fwd_ret")
        out = one if out is None else out.unionByName(one)
    return out


def momentum_scores(dataset: DataFrame, years: Sequence[int]) -> DataFrame:
    """The baseline without a model."""
    return dataset.where(F.year("date").isin(list(years))).select("date", "symbol", F.col("mom_12_1").alias("score"), "fwd_ret")


def teacher_scores(rows: DataFrame, boosted: Model, forest: Model, names: Sequence[str], batch: Sequence[str] = ("date",)) -> DataFrame:
    """Mean of both members' percentile ranks inside each scored batch."""
    both = predict(forest, predict(boosted, rows, names, "_a"), names, "_b")
    ranked = percentile_ranks(percentile_ranks(both, "_a", batch, "_ra"), "_b", batch, "_rb")
    return ranked.select(*rows.columns, ((F.col("_ra") + F.col("_rb")) / 2.0).alias("teacher"))


def fit_student(taught: DataFrame, names: Sequence[str], alpha: float = 1.0) -> Model:
    """Ridge regression on the teacher's output, a readable linear copy.

    ``alpha`` weighs the squared coefficients against the summed squared error. The
    estimator's loss is the mean over n rows of a label in units of its deviation,
    so the same penalty is alpha / n times that deviation.
    """
    n, spread = taught.agg(F.count("teacher"), F.stddev_pop("teacher")).first()
    alpha = alpha * (spread or 1.0) / max(n, 1)
    est = LinearRegression(featuresCol="inputs", labelCol="teacher", regParam=alpha, elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="inputs"), est]).fit(taught)


def student_coefficients(student: Model, names: Sequence[str], spark) -> DataFrame:
    pairs = [(n, float(c)) for n, c in zip(names, student.stages[-1].coefficients)]
    return spark.createDataFrame(pairs, "feature string, coefficient double").orderBy("coefficient")
