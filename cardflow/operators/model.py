"""Gradient-boosted trees on Spark ML: training, scoring, importances, encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from cardflow.operators import prep
from cardflow.operators.metrics import average_precision, confusion, curve, roc_auc, select_threshold
from cardflow.operators.quantiles import with_row


@dataclass(frozen=True)
class TreeConfig:
    iterations: int = 20
    depth: int = 5
    step: float = 0.1
    subsample: float = 0.8
    seed: int = 42
    validation_tolerance: float = 0.001


def train_gbt(train: DataFrame, features: Sequence[str], label: str, config: TreeConfig = TreeConfig(),
              val: DataFrame | None = None, balanced: bool = True, nominal: Sequence[str] = ()) -> PipelineModel:
    """Boosted trees with class weights from the training rows. With ``val`` training stops when
    the validation error no longer falls by the tolerance. ``nominal`` features are text columns; trees
    split them by sets of categories, and categories that training did not see are one of their own."""
    rows = train.select(*features, F.col(label).cast("double").alias(label))
    rows = prep.balanced_weights(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0))
    rows = rows.withColumn("is_validation", F.lit(False))
    tree = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=config.iterations,
                         maxDepth=config.depth, stepSize=config.step, subsamplingRate=config.subsample, seed=config.seed)
    if val is not None:
        held = val.select(*features, F.col(label).cast("double").alias(label), F.lit(1.0).alias("weight"),
                          F.lit(True).alias("is_validation"))
        rows = rows.unionByName(held)
        tree = tree.setValidationIndicatorCol("is_validation").setParams(validationTol=config.validation_tolerance)
    stages, inputs = [], [f for f in features if f not in nominal]
    if nominal:
        coded = [f"__{f}" for f in nominal]
        index = StringIndexer(inputCols=list(nominal), outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows)
        tree = tree.setMaxBins(max(tree.getMaxBins(), 2 + max(map(len, index.labelsArray))))
        stages, inputs = [index], [*inputs, *coded]
    assemble = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*stages, assemble, tree]).fit(rows)


def score(df: DataFrame, model: PipelineModel, keep: Sequence[str], name: str = "probability") -> DataFrame:
    """Probability of the positive class; works on batch and streaming tables."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias(name))


def importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def compare_encodings(train: DataFrame, val: DataFrame, test: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                      label: str, keys: Sequence[str], config: TreeConfig = TreeConfig()) -> DataFrame:
    """The same model on three encodings fitted on the training rows; threshold from the
    validation rows, metrics on the test rows."""
    encoders: Mapping[str, tuple] = {
        "label": (prep.fit_categories, lambda d, m: prep.apply_labels(d, m, categorical, unseen="next")),
        "native": (lambda d, c: None, lambda d, m: d.fillna(prep.MISSING, list(categorical))),
        "frequency": (prep.fit_frequency, lambda d, m: prep.apply_frequency(d, m, categorical)),
    }
    features, out = [*numeric, *categorical], None
    for name, (fit, apply) in encoders.items():
        encoder = fit(train, categorical)
        model = train_gbt(apply(train, encoder), features, label, config, nominal=categorical if name == "native" else ())
        threshold = select_threshold(curve(score(apply(val, encoder), model, [label]), label, "probability")).first()["threshold"]
        scored = score(apply(test, encoder), model, [*keys, label])
        points = curve(scored, label, "probability")
        row = with_row(with_row(average_precision(points), roc_auc(points)), confusion(scored, label, "probability", threshold))
        row = row.withColumn("threshold", F.lit(threshold)).withColumn("encoding", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
