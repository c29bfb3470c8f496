"""Running sums over an order without one task that holds everything, and exact percentiles from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average, and the bounds of the number of buckets of a table.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 50_000, 8, 4096


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def running_sums(df: DataFrame, by: list[str], order: str, values: list[str], buckets: int | None = None) -> DataFrame:
    """Adds ``cum_<v>`` for each value: the sum over rows of the same ``by`` with an ``order`` not above the row's.

    ``order`` is unique within ``by`` (aggregate first).  Rows fall into buckets between approximate quantiles; sums run
    inside a bucket, and the totals of the buckets before it are added.  The number of buckets follows the rows (which
    are counted unless ``buckets`` is given).  Cuts and offsets have a row per group of ``by``, and per bucket of one;
    the optimizer broadcasts them if their size allows.
    """
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    buckets = buckets or bucket_count(df.count())
    cuts = base.groupBy(*keys).agg(F.percentile_approx(order, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), max(10_000, 10 * buckets)).alias("_cuts"))
    placed = base.join(cuts, keys).withColumn("_bucket", F.size(F.filter("_cuts", lambda b: b < F.col(order)))).drop("_cuts")
    totals = placed.groupBy(*keys, "_bucket").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *(F.sum(v).over(inside).alias(f"_s_{v}") for v in values)).join(offsets, [*keys, "_bucket"])
    return summed.select(*df.columns, *((F.col(f"_s_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values))


def exact_percentiles(counts: DataFrame, by: list[str], value: str, n: str, shares: tuple[float, ...], names: list[str]) -> DataFrame:
    """Interpolated percentiles per group of ``by`` from a table of distinct values with their counts ``n``.

    The percentile of share p lies between the rows of places floor and ceil of p (N - 1); a value covers the places
    from its running count less its own count on, so each group needs its running sums only, not its rows.
    """
    table = counts.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.col(n).alias("_c"))
    summed = running_sums(table, by, "_v", ["_c"])
    keys = by or ["_all"]
    summed = summed if by else summed.withColumn("_all", F.lit(0))
    totals = summed.groupBy(*keys).agg(F.max("cum__c").alias("_n"))
    placed = summed.join(totals, keys)
    picks = []
    for i, p in enumerate(shares):
        place = p * (F.col("_n") - 1)
        at = lambda k: F.max(F.when((k >= F.col("cum__c") - F.col("_c")) & (k < F.col("cum__c")), F.col("_v")))
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    got = placed.groupBy(*keys).agg(*picks)
    return got.select(*by, *((F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name) for i, name in enumerate(names)))
