"""A price-model workflow: split by hash, preprocessing, fit, calibrated interval, explanation."""

from __future__ import annotations

import json
import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemason.operators.profile import exact_quantiles, quantiles_of

LEARNERS = {"linear": LinearRegression, "forest": RandomForestRegressor, "boosted": GBTRegressor}


def split_label(key: Column, seed: int = 42, shares: tuple[tuple[str, int], ...] = (("train", 70), ("validation", 10), ("calibration", 10), ("test", 10))) -> Column:
    """A split by a hash of the key: the same for a key on every run and cluster, without a sort.

    Strata keep their shares in expectation, as every key is drawn by itself.
    """
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100))
    out, upto = None, 0
    for name, share in shares:
        upto += share
        case = draw < upto
        out = F.when(case, name) if out is None else out.when(case, name)
    return out


def impute(df: DataFrame, numbers: list[str], words: list[str], medians: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Exact medians of the given rows for missing numbers, each with an indicator; 'Unknown' for missing words."""
    medians = medians or {c: q[0] or 0.0 for c, q in quantiles_of(df, dict.fromkeys(numbers, (0.5,))).items()}
    out = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in numbers})
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in numbers} | {c: F.coalesce(c, F.lit("Unknown")) for c in words}), medians


def pipeline(numbers: list[str], words: list[str], label: str, learner: str = "linear", scale: bool = True, **params) -> Pipeline:
    index = StringIndexer(inputCols=words, outputCols=[f"{c}_i" for c in words], handleInvalid="keep", stringOrderType="frequencyDesc")
    encode = OneHotEncoder(inputCols=[f"{c}_i" for c in words], outputCols=[f"{c}_v" for c in words], handleInvalid="keep")
    gather = VectorAssembler(inputCols=[*numbers, *[f"{c}_missing" for c in numbers], *[f"{c}_v" for c in words]], outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=False, withStd=scale)
    return Pipeline(stages=[*([index, encode] if words else []), gather, scaler, LEARNERS[learner](featuresCol="features", labelCol=label, **params)])


def search(pipe: Pipeline, train: DataFrame, label: str, grid: dict[str, list], folds: int = 5, seed: int = 42):
    """Cross-validated search over parameters of the pipeline's last stage, by squared error."""
    last, build = pipe.getStages()[-1], ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(getattr(last, name), values)
    folded = train.withColumn("_fold", F.pmod(F.xxhash64(*train.columns, F.lit(seed)), F.lit(folds)).cast("int"))
    judge = RegressionEvaluator(labelCol=label, metricName="mse")
    return CrossValidator(estimator=pipe, estimatorParamMaps=build.build(), evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=2).fit(folded)


def conformal_rank(n: int, coverage: float = 0.8) -> int:
    """0-based rank of the calibration residual that gives the interval: ceil(level * (n - 1)), level = min(ceil((n + 1) * coverage) / n, 1)."""
    return math.ceil(min(math.ceil((n + 1) * coverage) / n, 1.0) * (n - 1))


def conformal_width(residuals: DataFrame, column: str, coverage: float = 0.8) -> float | None:
    """The order statistic of absolute residuals, found without a sort of all rows; None for none."""
    n = residuals.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    rank = conformal_rank(n, coverage)
    return exact_quantiles(residuals.select(F.abs(column).alias("r")), "r", (rank / (n - 1) if n > 1 else 0.0,))[0]


def with_interval(df: DataFrame, log_prediction: str, width: float) -> DataFrame:
    """estimate, lower (from 0 on) and upper on the original scale, from a log1p prediction."""
    p = F.col(log_prediction)
    return df.withColumns({"estimate": F.expm1(p), "lower": F.greatest(F.lit(0.0), F.expm1(p - width)), "upper": F.expm1(p + width)})


def impact_level(share: Column) -> Column:
    size = F.abs(share)
    return F.when(size >= 0.15, "Strong").when(size >= 0.05, "Moderate").when(size >= 0.01, "Small").otherwise("Very small")


def linear_factors(df: DataFrame, model: PipelineModel, numbers: list[str], words: list[str], means: list[float]) -> DataFrame:
    """(factor, effect) arrays of a linear model: exact additive effects beta * (x - mean), summed over a field's columns."""
    from pyspark.ml.functions import vector_to_array

    beta = [float(b) for b in model.stages[-1].coefficients]
    meta = df.schema["raw_features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", "") for group in meta.values() for a in group}
    owner = lambda i: next((f for f in [*numbers, *words] if names.get(i, "").startswith(f)), "other")
    x = vector_to_array("features")
    parts = {}
    for f in [*numbers, *words]:
        own = [i for i in range(len(beta)) if owner(i) == f]
        parts[f] = sum((F.lit(beta[i]) * (x[i] - F.lit(means[i])) for i in own), F.lit(0.0))
    factors = F.array(*[F.struct(F.lit(f).alias("factor"), e.alias("effect")) for f, e in parts.items()])
    return df.withColumn("factors", F.array_sort(factors, lambda a, b: F.when(F.abs(a["effect"]) > F.abs(b["effect"]), -1).when(F.abs(a["effect"]) < F.abs(b["effect"]), 1).otherwise(0)))


def importance(df: DataFrame) -> DataFrame:
    """(factor, mean_abs, mean_effect, share) over all rows' factors."""
    one = df.select(F.explode("factors").alias("f")).groupBy("f.factor").agg(F.avg(F.abs("f.effect")).alias("mean_abs"), F.avg("f.effect").alias("mean_effect"))
    return one.withColumn("share", F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy()))  # one row a factor


def save_model(model: PipelineModel, path: str, metadata: dict) -> None:
    """The model and, beside it, one JSON row of metadata (features, medians, width of the interval)."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])
