"""Baselines: OLS, ridge, boosted trees and PCA with ridge by Spark's own learners, a small perceptron over counted rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scratch import cut
from tessera.operators import perceptron
from tessera.operators.splits import ridge_weights
from tessera.operators.stats import errors


def _held_out(model, rows: DataFrame, label: str, part: str, name: str) -> DataFrame:
    return errors(model.transform(rows), F.col(label), F.col("prediction"), [part]).withColumn("model", F.lit(name))


def linear(rows: DataFrame, features: list[str], label: str, part: str, alpha: float = 0.0) -> DataFrame:
    """Errors per part of OLS (alpha 0) or ridge on standardised features, fitted on the part called train.

    Means, deviations and the normal equations are one aggregation each; their size is that of the features.
    """
    known = rows.dropna(subset=[*features, label])
    train = known.filter(F.col(part) == "train")
    m = train.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_samp(f).alias(f"s_{f}") for f in features)).first()
    scaled = lambda d: d.select(part, label, *(((F.col(f) - m[f"m_{f}"]) / (m[f"s_{f}"] or 1.0)).alias(f) for f in features))
    w = ridge_weights(scaled(train), features, label, alpha) if m[f"m_{features[0]}"] is not None else [0.0] * (len(features) + 1)
    guess = sum((F.col(f) * v for f, v in zip(features, w[:-1], strict=True)), F.lit(w[-1]))
    out = scaled(known) if m[f"m_{features[0]}"] is not None else known
    return errors(out, F.col(label), guess, [part]).withColumn("model", F.lit("ridge" if alpha else "ols"))


def boosted(rows: DataFrame, features: list[str], label: str, part: str, trees: int = 200, seed: int = 0) -> DataFrame:
    """Errors per part of boosted trees.  Rows without a feature or label take no part.

    Rows of one feature vector get one prediction from every tree, so squared errors around it need their number and
    mean label only: trees are fitted on distinct vectors with these as weight and label, which gives every split the
    gain it has over the rows.  Each tree sees ``subsamplingRate`` of the vectors,
    which lie in their order, so a seed draws the same ones.  Errors count every row.
    """
    known = cut(rows.dropna(subset=[*features, label]).groupBy(part, *features, label).agg(F.count(F.lit(1)).alias("_n")))
    points = cut(known.filter(F.col(part) == "train").groupBy(*features).agg(F.sum("_n").cast("double").alias("_w"), (F.sum(F.col(label) * F.col("_n")) / F.sum("_n")).alias("_mean")).orderBy(*features))
    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), GBTRegressor(featuresCol="_x", labelCol="_mean", weightCol="_w", maxIter=trees, maxDepth=4, stepSize=0.08, subsamplingRate=0.8, seed=seed)]
    guesses = Pipeline(stages=stages).fit(points).transform(known.select(*features).distinct()).select(*features, "prediction")
    e, n = F.col("prediction") - F.col(label), F.sum("_n")
    out = known.join(guesses, features).groupBy(part).agg(n.alias("n"), (F.sum(F.abs(e) * F.col("_n")) / n).alias("mae"), F.sqrt(F.sum(e * e * F.col("_n")) / n).alias("rmse"))
    return out.withColumn("model", F.lit("boosted"))


def pca_ridge(rows: DataFrame, vector: str, label: str, part: str, k: int = 16, alpha: float = 1.0) -> DataFrame:
    """PCA of an array column, then ridge; ``alpha`` counts against the label in units of its deviation, as Spark has it."""
    v = rows.withColumn("_v", array_to_vector(F.col(vector)))
    train = v.filter(F.col(part) == "train")
    stages = [StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=k, inputCol="_s", outputCol="_x"), LinearRegression(featuresCol="_x", labelCol=label, regParam=alpha / max(1, train.count()), elasticNetParam=0.0, standardization=False)]
    return _held_out(Pipeline(stages=stages).fit(train), v, label, part, "pca_ridge")


def decisions(rows: DataFrame, features: list[str], action: str, part: str, seed: int = 0) -> DataFrame:
    """Accuracy per part of a perceptron with two hidden layers over the vocabulary of actions.

    Equal rows add up: the perceptron is fitted on distinct (features, action) with their numbers, which has the loss of
    the rows.  Rows without a feature take no part; a missing action is an action of its own, past the others.
    """
    counts = rows.groupBy(part, *features, action).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts)
    names = [r[0] for r in counts.filter(F.col(action).isNotNull()).groupBy(action).agg(F.sum("_n").alias("_n")).orderBy(F.desc("_n"), action).collect()]  # an action each
    index = F.coalesce(*(F.when(F.col(action) == v, F.lit(i)) for i, v in enumerate(names)), F.lit(len(names))).cast("bigint") if names else F.lit(0).cast("bigint")
    known = cut(counts.dropna(subset=features).select(part, *(F.col(f).cast("double").alias(f) for f in features), index.alias("_y"), "_n"))
    train = known.filter(F.col(part) == "train")
    n = F.sum("_n")
    mean = train.agg(*(F.sum(F.col(f) * F.col("_n")) / n for f in features)).first()
    if mean[0] is None:
        return known.groupBy(part).agg(n.alias("n"), F.lit(None).cast("double").alias("accuracy"))
    spread = train.agg(*(F.sqrt(F.try_divide(F.sum((F.col(f) - m) ** 2 * F.col("_n")), n - 1)) for f, m in zip(features, mean, strict=True))).first()
    mean, scale = np.array(mean, np.float64), np.array([s or 1.0 for s in spread], np.float64)
    layers = [len(features), 64, 64, len(names) + 1]
    total = float(train.agg(n).first()[0])
    loss = perceptron.summed(train.select(*features, "_y", "_n"), features, "_y", "_n", mean, scale, layers)
    weights = perceptron.descend(lambda w: tuple(v / total for v in loss(w)), perceptron.start(layers, seed), rounds=60)
    out = perceptron.predicted(known, features, mean, scale, weights, layers, "_guess")
    return out.groupBy(part).agg(n.alias("n"), (F.sum(F.when(F.col("_guess") == F.col("_y"), F.col("_n")).otherwise(0)) / n).alias("accuracy"))
