"""Grouped splits and small linear baselines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.prefix import running_sums


def group_split(df: DataFrame, group: str, seed: int = 0, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(group, part): each group wholly in train, val or test, in exact shares of the groups, by the order of a hash.

    Train and val have at least one group where there are enough (val none below three).
    """
    g = df.select(group).filter(F.col(group).isNotNull()).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")).cast("binary")))
    # Ranks without one task: the hash's first digits are the bucket, so running counts of buckets give the offset.
    g = g.withColumn("_p", F.conv(F.substring("_h", 1, 4), 16, 10).cast("long"))
    sums = running_sums(g.groupBy("_p").agg(F.count(F.lit(1)).alias("m")), [], "_p", ["m"]).select("_p", (F.col("cum_m") - F.col("m")).alias("_before"))
    ranked = g.join(F.broadcast(sums), "_p").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h")))
    n = g.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    n_train = F.greatest(F.lit(1.0), F.rint(train * F.col("_n")))
    n_val = F.when(F.col("_n") >= 3, F.greatest(F.lit(1.0), F.rint(val * F.col("_n")))).otherwise(0.0)
    n_val = F.when((n_train + n_val >= F.col("_n")) & (F.col("_n") > 1), F.greatest(F.lit(0.0), F.col("_n") - n_train - 1)).otherwise(n_val)
    last = F.least(n_train, F.col("_n") - n_val)
    part = F.when(F.col("_i") <= last, "train").when(F.col("_i") <= last + n_val, "val").otherwise("test")
    return ranked.join(F.broadcast(n)).select(group, part.alias("part"))


def ridge_weights(rows: DataFrame, features: list[str], label: str, penalty: float) -> list[float]:
    """Weights and intercept of a ridge fit; the Gram matrix is one aggregation, its size that of the features."""
    x = [*(F.col(f) for f in features), F.lit(1.0)]
    gram = rows.agg(*(F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)), *(F.sum(a * F.col(label)).alias(f"b{i}") for i, a in enumerate(x))).first()
    k = len(x)
    if gram["g0_0"] is None:
        return [0.0] * k
    g = np.array([[gram[f"g{i}_{j}"] for j in range(k)] for i in range(k)]) + penalty * np.diag([1.0] * (k - 1) + [0.0])
    return np.linalg.lstsq(g, np.array([gram[f"b{i}"] for i in range(k)]), rcond=None)[0].tolist()


def ridge_accuracy(rows: DataFrame, features: list[str], label: str, part: str, penalty: float = 0.01, threshold: float = 0.5) -> DataFrame:
    """Accuracy of the thresholded ridge fit per part; fitted on the part called train."""
    w = ridge_weights(rows.filter(F.col(part) == "train"), features, label, penalty)
    raw = sum((F.col(f) * v for f, v in zip(features, w[:-1], strict=True)), F.lit(w[-1]))
    return rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.avg(((raw >= threshold) == (F.col(label) == 1)).cast("double")).alias("accuracy"))
