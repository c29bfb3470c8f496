"""Rule-based quality tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import flags, out_of_bounds


def missing_and_bounds(bounds: dict[str, tuple[float, float]]) -> list[tuple[str, Column]]:
    """INVALID rules: a core field is missing or cannot be."""
    return [r for f, (lo, hi) in bounds.items() for r in ((f"missing_{f}", F.col(f).isNull()), (f"impossible_{f}", out_of_bounds(f, lo, hi)))]


def classify(df: DataFrame, invalid: Sequence[tuple[str, Column]], unusual: Sequence[tuple[str, Column]], suspicious: Sequence[tuple[str, Column]], informational: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds quality_status, quality_flags and usable.

    Any invalid rule makes a row INVALID and hides the suspicious ones; else an unusual or suspicious rule makes it
    SUSPICIOUS; informational flags change nothing.  Flags are ordered by class, then by rule.
    """
    bad, odd, doubtful, notes = (flags(r) for r in (invalid, unusual, suspicious, informational))
    status = F.when(F.size("_bad") > 0, "INVALID").when((F.size("_odd") > 0) | (F.size("_doubtful") > 0), "SUSPICIOUS").otherwise("VALID")
    all_flags = F.when(F.size("_bad") > 0, F.concat("_bad", "_odd", "_notes")).otherwise(F.concat("_odd", "_doubtful", "_notes"))
    out = df.withColumns({"_bad": bad, "_odd": odd, "_doubtful": doubtful, "_notes": notes})
    out = out.withColumns({"quality_status": status, "quality_flags": all_flags}).drop("_bad", "_odd", "_doubtful", "_notes")
    return out.withColumn("usable", F.col("quality_status") != "INVALID")


def tier_table(df: DataFrame, split: str) -> DataFrame:
    return df.groupBy(split).pivot("quality_status", ["VALID", "SUSPICIOUS", "INVALID"]).count().na.fill(0)


def flag_ranking(df: DataFrame, flags_column: str = "quality_flags") -> DataFrame:
    return df.select(F.explode(flags_column).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def evidence(df: DataFrame, key: str, k: int = 5, flags_column: str = "quality_flags") -> DataFrame:
    """The first ``k`` distinct keys of each flag; every partition is cut to ``k`` a flag before a flag's keys meet."""
    cells = df.select(F.explode(flags_column).alias("flag"), F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    order = Window.partitionBy("flag").orderBy("key")
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("flag", "rank", "key")
