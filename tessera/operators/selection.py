"""Selection under quotas, ordinal tests and parameter probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scratch import cut


def spread_states(states: DataFrame, group: str, value: str, width: float, key: str, k: int) -> DataFrame:
    """``k`` states spread over (group, bin of value): the first of each bin before any second."""
    w = Window.partitionBy(group, F.floor(F.col(value) / width)).orderBy(key)
    return states.withColumn("_r", F.row_number().over(w)).orderBy("_r", group, key).limit(k).drop("_r")


def stratified_pilot(pairs: DataFrame, stratum: str, shards: list[str], key: str, size: int, shard_cap: int, forced: Column | None = None) -> DataFrame:
    """A pilot of ``size`` pairs (with ``score``) that touches at most ``shard_cap`` shards.

    Pairs that ``forced`` marks come first, the best first, as long as size and cap allow; by default these are the best
    of each stratum.  The rest is greedy: of the pairs that fit, the one with the fewest new shards, then of the stratum
    with the fewest pairs so far, then of the highest score, then of the smallest key.  A choice depends on nothing else,
    so only the best ``size`` pairs of each (stratum, shards) can ever be chosen; they are kept on the executors, and
    each round takes one minimum of them.  The driver sees one row a round.
    """
    touched = F.array_sort(F.array_distinct(F.array(*shards)))
    must = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    rows = pairs.select(F.col(key).alias("k"), F.col(stratum).alias("s"), F.col("score"), touched.alias("shards"), must.alias("must"))
    if forced is None:
        rows = rows.withColumn("must", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("score"), "k")) == 1)
    place = F.row_number().over(Window.partitionBy("s", "shards", "must").orderBy(F.desc("score"), "k"))
    pool = cut(rows.withColumn("_r", place).filter(F.col("_r") <= size).drop("_r"))
    taken: list = []
    used: list = []
    counts: dict = {}
    forced_left = True
    while len(taken) < size:
        left = pool.filter(~F.col("k").isin(taken)) if taken else pool
        new = F.size(F.array_except("shards", F.array(*map(F.lit, used)))) if used else F.size("shards")
        fits = left.filter(new + len(used) <= shard_cap)
        held = F.coalesce(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))[F.col("s")], F.lit(0)) if counts else F.lit(0)
        order = [F.desc("score"), F.col("k")] if forced_left else [new, held, F.desc("score"), F.col("k")]
        best = (fits.filter("must") if forced_left else fits).orderBy(*order).first()
        if best is None:
            if not forced_left:
                break
            forced_left = False
            continue
        taken.append(best["k"])
        used = sorted({*used, *best["shards"]})
        counts[best["s"]] = counts.get(best["s"], 0) + 1
    return pairs.filter(F.col(key).isin(taken)) if taken else pairs.limit(0)


def kendall(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Kendall's tau of each small group (a ladder's levels), and whether its order is exact."""
    x = df.select(group, F.col(order).alias("o"), F.col(value).alias("v"))
    y = df.select(F.col(group).alias("_g"), F.col(order).alias("p"), F.col(value).alias("w"))
    sign = F.signum(F.col("w") - F.col("v"))
    pairs = x.join(y, (F.col(group) == F.col("_g")) & (F.col("o") < F.col("p")))
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.avg(sign).alias("tau"), (F.min(sign) == 1).alias("exact"))


def holm(tests: DataFrame, p: str, key: str) -> DataFrame:
    """Holm-adjusted p-values; the tests are few by nature."""
    w = Window.orderBy(p, key)
    n = tests.agg(F.count(F.lit(1)).alias("_n"))
    stepped = tests.join(F.broadcast(n)).withColumn("_a", F.least(F.lit(1.0), F.col(p) * (F.col("_n") - F.row_number().over(w) + 1)))
    return stepped.withColumn("adjusted", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a", "_n")


def probe(states: DataFrame, key: str, parameter: str, measures: list[str], least: float = 0.15, cross: float = 0.5) -> DataFrame:
    """Change of each measure per unit of a parameter between a state's lowest and highest setting, and whether the
    first measure moves on its own: by ``least`` or more, the others by less than ``cross`` of it."""
    span = states.groupBy(key).agg(F.min(F.struct(parameter, *measures)).alias("a"), F.max(F.struct(parameter, *measures)).alias("b"))
    unit = F.col(f"b.{parameter}") - F.col(f"a.{parameter}")
    rate = {m: F.try_divide(F.col(f"b.{m}") - F.col(f"a.{m}"), unit) for m in measures}
    own = F.abs(rate[measures[0]])
    alone = own >= least
    for m in measures[1:]:
        alone = alone & (F.abs(rate[m]) < cross * own)
    return span.filter(unit != 0).select(key, *(r.alias(f"per_unit_{m}") for m, r in rate.items()), F.coalesce(alone, F.lit(False)).alias("independent"))
