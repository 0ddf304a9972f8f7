"""Training, tuning, prediction and model files on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamframe.functions.arith import sentinel_to_null

NODATA = 65535


def training_table(df: DataFrame, features: Sequence[str], target: str, categories: Sequence[str] = ()) -> DataFrame:
    """Rows without a missing feature or target; features by name, categories as text."""
    columns = [sentinel_to_null(F.col(c).cast("double"), NODATA).alias(c) for c in features]
    return df.select(*columns, *[F.col(c).cast("string").alias(c) for c in categories], F.col(target)).na.drop()


def forest(features: Sequence[str], target: str, categories: Sequence[str] = (), trees: int = 200, depth: int = 6, seed: int = 190) -> Pipeline:
    """Indexed label, indexed categories, assembled features, random forest."""
    stages = [StringIndexer(inputCol=target, outputCol="label", handleInvalid="error")]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categories]
    stages.append(VectorAssembler(inputCols=[*features, *[f"{c}_index" for c in categories]], outputCol="features"))
    stages.append(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed))
    return Pipeline(stages=stages)


def boosted(features: Sequence[str], target: str, categories: Sequence[str] = (), rounds: int = 20, depth: int = 6, rate: float = 0.1, least_gain: float = 0.0, seed: int = 190) -> Pipeline:
    """Boosted trees for several classes, one against the rest.

    Spark's boosting has no L2 term on leaf weights; the least gain of a split takes its place against small splits.
    """
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, minInfoGain=least_gain, seed=seed)
    return Pipeline(stages=[*forest(features, target, categories).getStages()[:-1], OneVsRest(classifier=trees, parallelism=4)])


def tuned_boosting(df: DataFrame, pipeline: Pipeline, rates: Sequence[float] = (0.1,), depths: Sequence[int] = (6,), least_gains: Sequence[float] = (0.0,), folds: int = 3, seed: int = 190) -> tuple[PipelineModel, DataFrame]:
    """Best boosted model of a grid by cross-validated accuracy, and the grid's accuracies."""
    trees = pipeline.getStages()[-1].getClassifier()
    grid = ParamGridBuilder().addGrid(trees.stepSize, list(rates)).addGrid(trees.maxDepth, list(depths)).addGrid(trees.minInfoGain, list(least_gains)).build()
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed)
    model = search.fit(df)
    rows = [(p[trees.stepSize], p[trees.maxDepth], p[trees.minInfoGain], float(a)) for p, a in zip(grid, model.avgMetrics, strict=True)]
    return model.bestModel, df.sparkSession.createDataFrame(rows, "rate double, depth int, least_gain double, accuracy double")


def tuned(df: DataFrame, pipeline: Pipeline, trees: Sequence[int] = (50,), depths: Sequence[int] = (6,), folds: int = 3, seed: int = 190) -> tuple[PipelineModel, DataFrame]:
    """Best model of a grid by cross-validated accuracy, and the grid's accuracies."""
    rf = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths)).build()
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=seed)
    model = search.fit(df)
    rows = [(p[rf.numTrees], p[rf.maxDepth], float(a)) for p, a in zip(grid, model.avgMetrics, strict=True)]
    return model.bestModel, df.sparkSession.createDataFrame(rows, "trees int, depth int, accuracy double")


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """feature and importance, without those of importance 0, ranked."""
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    kept = sorted(((n, float(v)) for n, v in zip(names, values, strict=True) if v != 0), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(n, v, k) for k, (n, v) in enumerate(kept, 1)], "feature string, importance double, rank int")


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with the predicted label's text."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    # a fitted forest of two classes keeps its summary and with it the session, which tasks cannot take once a query has been observed; a copy has none
    out = model.copy().transform(df)
    return out.withColumn("predicted", F.get(labels, F.col("prediction").cast("int"))).drop("rawPrediction", "probability", "features", "prediction")


def save(model: PipelineModel, path: str, features: Sequence[str], title: str) -> None:
    """The model and, beside it, a JSON of its features in their order and its classes."""
    model.write().overwrite().save(f"{path}/model")
    described = {"title": title, "features": list(features), "classes": list(model.stages[0].labels)}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(described),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/descriptor")


def load(spark: SparkSession, path: str, present: Sequence[str] | None = None) -> tuple[PipelineModel, dict]:
    """A saved model and its description; features that the data lack raise."""
    described = json.loads(spark.read.text(f"{path}/descriptor").first().value)
    if present is not None and (missing := sorted(set(described["features"]) - set(present))):
        raise ValueError(f"features missing: {missing}")
    return PipelineModel.load(f"{path}/model"), described
