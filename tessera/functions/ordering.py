"""A total order over a table: every row's place, and files that follow one another in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scratch import cut, hadoop_fs, passing_shuffles, scratch_path

#: Spark's row numbers hold the partition above these bits and the row's place in it below.
_BITS = 33
#: Rows from which the ranges of parts are told.
_SAMPLED = 20_000


def with_places(df: DataFrame, order: list[str], name: str = "place", parts: int = 1, derived: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the place, from 1, of each row in ``order``, nulls first; equal rows come in some order.

    Rows are dealt into ranges and sorted there; a range's offset is the count of the ranges before it, one row per
    range.  No task holds more than a range.  ``derived`` columns are made of the others where they are needed, and
    written nowhere.

    With ``parts``, rows are first written in so many ranges and these sorted one after the other, which holds the
    shuffle of one of them at a time.  ``df`` is read three times then.  A sample tells the ranges; it decides their
    sizes only.
    """
    derived, spark = derived or {}, df.sparkSession
    if parts == 1:
        return _placed([_sorted(df, order, derived)], df.columns, name, derived)
    keys = df.withColumns(derived).select("*", F.struct(*order).alias("_key"))
    sample = keys.select("_key").sample(min(1.0, _SAMPLED / max(1, df.count())), seed=1)
    firsts = cut(sample.withColumn("r", F.ntile(parts).over(Window.orderBy("_key"))).groupBy("r").agg(F.min("_key").alias("k")).filter("r > 1").agg(F.array_sort(F.collect_list("k")).alias("_firsts")))  # a sample of a fixed size
    dealt = keys.crossJoin(F.broadcast(firsts)).select(*df.columns, F.size(F.filter("_firsts", lambda k: k <= F.col("_key"))).alias("_range"))
    path = scratch_path(spark, "ranges")
    with passing_shuffles(spark):
        dealt.write.option("compression", "zstd").partitionBy("_range").parquet(path)
    fs, at = hadoop_fs(spark, path)
    done = []
    for here in (f"{path}/_range={r}" for r in range(parts)):
        if fs.exists(at(here)):
            done.append(_sorted(spark.read.schema(df.schema).parquet(here), order, derived))
            fs.delete(at(here), True)
    return _placed(done or [_sorted(df, order, derived)], df.columns, name, derived)


def _sorted(df: DataFrame, order: list[str], derived: dict[str, Column]) -> DataFrame:
    return cut(df.withColumns(derived).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop(*derived))


def _placed(tables: list[DataFrame], columns: list[str], name: str, derived: dict[str, Column]) -> DataFrame:
    """Sorted tables that follow one another, with the places of their rows."""
    part, at = F.shiftright("_at", _BITS), F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    held = reduce(DataFrame.unionByName, (t.withColumns({"_table": F.lit(i), "_part": part}) for i, t in enumerate(tables)))
    sizes = held.groupBy("_table", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_table", "_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("_table", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = held.join(F.broadcast(offsets), ["_table", "_part"])
    return placed.withColumns(derived).select(*columns, *derived, (F.col("_before") + at + 1).alias(name))


def write_ordered(df: DataFrame, order: list[str], path: str) -> None:
    """Parquet files each sorted, and sorted among one another by their names."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
