"""Validation of records that lie in rows and of rule tables, and roll-ups of statuses; for nested records see ``nested``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import flags


def record_errors(rows: DataFrame, key: str, order: str, name: str, allowed: list[str]) -> DataFrame:
    """(key, errors) of records that lie in rows: names outside ``allowed``, an order that repeats or is
    no permutation of 0..n-1.  Counts and extremes tell, so a record of any length is aggregated before it is shuffled."""
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(order).alias("distinct"), F.min(order).alias("low"), F.max(order).alias("high"), F.max(F.coalesce(~F.col(name).isin(allowed), F.lit(True))).alias("odd"),
    )
    whole = (F.col("distinct") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return g.select(key, flags([("unknown_name", F.col("odd")), ("repeated", F.col("distinct") < F.col("n")), ("not_a_permutation", ~F.coalesce(whole, F.lit(False)))]).alias("errors"))


def ranking_errors(ranking: Column, candidates: Column, oracle: Column) -> Column:
    """A ranking must hold every candidate once, and start with the oracle."""
    return flags([("not_all_candidates", F.array_sort(ranking) != F.array_sort(candidates)), ("oracle_not_first", ~F.get(ranking, F.lit(0)).eqNullSafe(oracle))])


def bound_violations(long: DataFrame, rules: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Per field of a rule table (field, low, high): rows, missing values and values out of bounds.

    The rule table has a row per field, so it is broadcast; fields without a rule are left out.
    """
    joined = long.join(F.broadcast(rules), field)
    out = F.coalesce(~F.col(value).between(F.col("low"), F.col("high")), F.lit(False))
    return joined.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).isNull().cast("long")).alias("missing"), F.sum(out.cast("long")).alias("out_of_bounds"))


def statuses(metrics: DataFrame, rules: dict[str, Column], allowed: tuple[str, ...]) -> DataFrame:
    """(track, status, allowed) from one row of metrics and a rule per track."""
    rows = F.array(*(F.struct(F.lit(k).alias("track"), v.alias("status")) for k, v in rules.items()))
    return metrics.select(F.explode(rows).alias("x")).select("x.*").withColumn("allowed", F.col("status").isin(*allowed))


def analytic_inverse(intended: Column, body: Column, before: Column) -> tuple[Column, Column]:
    """Parameter change for an intended change of a measure, and the measure that is predicted."""
    return F.try_divide(intended, body), before + intended


def outcome(realized: Column, side: dict[str, Column], ok: Column) -> Column:
    """direction, magnitude, non-null side effects and status of a worker's result."""
    effects = F.filter(F.array(*(F.struct(F.lit(k).alias("region"), v.cast("double").alias("delta")) for k, v in side.items())), lambda e: e["delta"].isNotNull())
    direction = F.when(realized > 0, "increase").when(realized < 0, "decrease").when(realized == 0, "none")
    return F.struct(F.when(ok, direction).alias("direction"), F.when(ok, F.abs(realized)).alias("magnitude"), effects.alias("side_effects"), F.when(ok & realized.isNotNull(), "MEASURED").when(ok, "MISSING").otherwise("FAILED").alias("status"))


def distinct_over(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values over several columns together."""
    return df.select(F.explode(F.array(*columns)).alias("v")).filter(F.col("v").isNotNull()).agg(F.count_distinct("v").alias("n"))
