"""Distribution, shift, quantization, ranking-quality and resampling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.prefix import exact_percentiles, running_sums
from tessera.functions.scalars import half_even, on_grid
from tessera.functions.scratch import cut

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def long_form(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    return df.unpivot([F.col(k) for k in keep], [F.col(f).cast("double").alias(f) for f in fields], "field", "value")


def value_counts(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """(field, keep..., value, n): every distinct value of each field, nulls too.  What the statistics below start from."""
    return cut(long_form(df, fields, keep).groupBy("field", *keep, "value").agg(F.count(F.lit(1)).alias("n")))


def distribution(df: DataFrame, fields: list[str], split: str) -> DataFrame:
    """Per field and split, and per field over all: count, missing, mean, sd (n - 1), min, percentiles, max."""
    counts = value_counts(df, fields, [split])
    parts = counts.withColumn("part", F.explode(F.array(F.col(split), F.lit("ALL")))).groupBy("field", "part", "value").agg(F.sum("n").alias("n"))
    parts = cut(parts)
    v, n = F.col("value"), F.col("n")
    known = F.sum(F.when(v.isNotNull(), n).otherwise(0))
    mean = parts.groupBy("field", "part").agg(known.alias("n"), F.sum(F.when(v.isNull(), n).otherwise(0)).alias("missing"), (F.sum(v * n) / known).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    spread = parts.join(mean.select("field", "part", "mean"), ["field", "part"]).groupBy("field", "part").agg(F.sqrt(F.try_divide(F.sum((v - F.col("mean")) ** 2 * n), known - 1)).alias("sd"))
    names = [f"p{round(100 * p)}" for p in PERCENTILES]
    percentiles = exact_percentiles(parts, ["field", "part"], "value", "n", PERCENTILES, names)
    out = mean.join(spread, ["field", "part"]).join(percentiles, ["field", "part"], "left")
    return out.select("field", "part", "n", "missing", "mean", "sd", "min", *names, "max")


def shift(df: DataFrame, fields: list[str], split: str, train: str = "train", held: str = "eval") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and Wasserstein-1 distance per field, by running sums of distinct values."""
    counts = cut(long_form(df, fields, [split]).filter(F.col("value").isNotNull()).groupBy("field", "value").agg(
        F.sum((F.col(split) == train).cast("long")).alias("a"), F.sum((F.col(split) == held).cast("long")).alias("b"),
    ))
    totals = counts.groupBy("field").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gaps = running_sums(counts, ["field"], "value", ["a", "b"]).join(F.broadcast(totals), "field")
    gap = F.abs(F.col("cum_a") / F.col("na") - F.col("cum_b") / F.col("nb"))
    # The distance is the integral of the gap: by parts, each value counts with the gap before it less the gap after.
    before = F.abs((F.col("cum_a") - F.col("a")) / F.col("na") - (F.col("cum_b") - F.col("b")) / F.col("nb"))
    return gaps.groupBy("field").agg(F.max(gap).alias("ks"), F.sum(F.col("value") * (before - gap)).alias("wasserstein"), F.first("na").alias("n_train"), F.first("nb").alias("n_eval"))


def top_values(df: DataFrame, value: Column | str, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` most frequent values, ties by value; per group of ``by`` if given."""
    keys = by or []
    counted = df.groupBy(*keys, (F.col(value) if isinstance(value, str) else value).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("value").isNotNull())
    if not keys:
        return counted.orderBy(F.desc("n"), "value").limit(k)
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quantization(df: DataFrame, fields: list[str], split: str) -> DataFrame:
    """Per field and split: distinct values raw and at 3, 2, 1 decimals, and the share of the most frequent 15 at 2."""
    values = value_counts(df, fields, [split]).filter(F.col("value").isNotNull())
    counts = None
    for name, v in (("raw", F.col("value")), *((f"at_{d}dp", half_even("value", d)) for d in (3, 2, 1))):
        level = values.groupBy("field", split, v.alias("v")).agg(F.sum("n").alias("n"))
        if name == "at_2dp":
            order = Window.partitionBy("field", split).orderBy(F.desc("n"), "v")
            top = level.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 15).groupBy("field", split).agg(F.sum("n").alias("top"))
        one = level.groupBy("field", split).agg(F.count(F.lit(1)).alias(name), *([F.sum("n").alias("n")] if name == "raw" else []))
        counts = one if counts is None else counts.join(one, ["field", split])
    return counts.join(top, ["field", split]).withColumn("top_share", F.col("top") / F.col("n"))


def preset_verdict(df: DataFrame, value: str) -> DataFrame:
    """Whether a ratio looks like a few preset levels: level counts, grid shares, concentration, verdict."""
    x = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("x"))
    base = x.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("n_raw"), F.count_distinct(half_even("x", 2)).alias("n_2dp"), F.count_distinct(half_even("x", 1)).alias("n_1dp"),
        F.avg((F.abs(F.rint(F.col("x") / 0.05) * 0.05 - F.col("x")) < 1e-6).cast("double")).alias("on_005"), F.avg((F.abs(F.rint(F.col("x") / 0.1) * 0.1 - F.col("x")) < 1e-6).cast("double")).alias("on_010"),
        F.sum((F.col("x") < 0).cast("long")).alias("negative"), F.sum((F.col("x") == 0).cast("long")).alias("zero"), F.sum((F.col("x") > 0).cast("long")).alias("positive"),
    )
    top2 = top_values(x, half_even("x", 2), 10).agg(F.max("n").alias("top2"), F.sum("n").alias("top2_10"))
    top1 = top_values(x, half_even("x", 1), 1).agg(F.max("n").alias("top1"))
    row = base.join(F.broadcast(top2)).join(F.broadcast(top1))
    n = F.col("n")
    quantized = (F.col("n_1dp") <= 12) | (F.col("top2") / n >= 0.15) | (F.col("top2_10") / n >= 0.45) | (F.col("top1") / n >= 0.30)
    verdict = F.when(quantized, "likely_quantized_preset_levels").when(F.col("on_010") > 0.25, "moderate_quantization_0.10_steps").otherwise("likely_continuous")
    return row.withColumn("concentration", F.col("top2_10") / n).withColumn("verdict", verdict).drop("top2", "top2_10", "top1")


def histogram(df: DataFrame, value: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n) over equal bins from the least to the greatest value."""
    edges = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_of = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    return df.filter(F.col(value).isNotNull()).join(F.broadcast(edges)).groupBy(*(by or []), bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """How large the groups of ``keys`` are: groups, rows, groups of several, percentiles, least and most."""
    sizes = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n")))
    size, n = F.col("size"), F.col("n")
    row = sizes.agg(F.sum("n").alias("groups"), F.sum(size * n).alias("rows"), F.sum(F.when(size > 1, n).otherwise(0)).alias("several"), F.min("size").alias("least"), F.max("size").alias("most"))
    return row.join(exact_percentiles(sizes, [], "size", "n", (0.5, 0.9, 0.99), ["p50", "p90", "p99"])).select("groups", "rows", "several", "least", "p50", "p90", "p99", "most")


def size_histogram(df: DataFrame, keys: list[str], first: int = 20) -> DataFrame:
    """(size, groups) of the ``first`` sizes that occur, from the smallest."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups")).orderBy("size").limit(first)


def purity(df: DataFrame, key: Column | str, label: str) -> DataFrame:
    """Mean over keys of the share of the most frequent label."""
    k = (F.col(key) if isinstance(key, str) else key).alias("_k")
    counts = df.groupBy(k, label).agg(F.count(F.lit(1)).alias("n")).groupBy("_k").agg((F.max("n") / F.sum("n")).alias("p"))
    return counts.agg(F.avg("p").alias("purity"), F.count(F.lit(1)).alias("keys"))


def auroc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """Mann-Whitney area with ties at one half; null below 8 rows or with one class."""
    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(label.cast("long")).alias("pos"), F.sum((~label).cast("long")).alias("neg"))
    summed = running_sums(counts, [], "s", ["neg"])
    row = summed.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return row.select(F.col("p").alias("positives"), F.col("n").alias("negatives"), F.when((F.col("p") + F.col("n") >= 8) & (F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auroc"))


def risk_coverage(df: DataFrame, score: str, key: str, right: Column, steps: int = 10) -> DataFrame:
    """Accuracy of what is left when the k highest scores abstain, for k in tenths; ties by ``key``, a unique number."""
    # A score's rows take the places from the number of higher ones on.  Where all of these fall into one slot, no order
    # is needed; the few scores that a cut goes through are ranked by running sums over the key, in many tasks.
    rows = df.select(F.col(score).cast("double").alias("_s"), F.col(key).alias("_k"), right.cast("double").alias("_ok"))
    counts = cut(rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_m"), F.sum("_ok").alias("_hits")))
    total = counts.agg(F.sum("_m").alias("_n"))
    above = running_sums(counts.withColumn("_neg", -F.col("_s")), [], "_neg", ["_m"]).withColumn("_above", F.col("cum__m") - F.col("_m"))
    above = above.join(F.broadcast(total)).withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_n") / steps)))
    slot = lambda place: F.floor(place / F.col("_step")).cast("int")
    above = cut(above.withColumn("whole", slot(F.col("_above")) == slot(F.col("_above") + F.col("_m") - 1)))
    whole = above.filter("whole").select(slot(F.col("_above")).alias("slot"), "_n", "_step", F.col("_hits").alias("ok"), F.col("_m").alias("m"))
    torn = running_sums(cut(rows.join(above.filter("NOT whole").select("_s", "_above", "_n", "_step"), "_s").withColumn("_one", F.lit(1))), ["_s"], "_k", ["_one"])
    torn = torn.select(slot(F.col("_above") + F.col("cum__one") - 1).alias("slot"), "_n", "_step", F.col("_ok").alias("ok"), F.lit(1).cast("long").alias("m"))
    parts = whole.unionByName(torn).groupBy("slot", "_n", "_step").agg(F.sum("ok").alias("ok"), F.sum("m").alias("m"))
    rest = Window.orderBy("slot").rowsBetween(0, Window.unboundedFollowing)  # at most steps + 1 rows are left here
    out = parts.withColumns({"kept": F.sum("m").over(rest), "hits": F.sum("ok").over(rest)})
    return out.select("slot", (F.col("kept") / F.col("_n")).alias("coverage"), (F.col("hits") / F.col("kept")).alias("selective_accuracy"), (1 - F.col("kept") / F.col("_n")).alias("abstention_rate"))


def errors(df: DataFrame, truth: Column, guess: Column, by: list[str] | None = None) -> DataFrame:
    e = guess - truth
    return df.groupBy(*(by or [])).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def sign_rate(df: DataFrame, a: Column, b: Column) -> DataFrame:
    d = a - b
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.avg((d > 0).cast("double")).alias("win_rate"), F.avg((d == 0).cast("double")).alias("tie_rate"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a rate."""
    p, z2 = F.try_divide(hits, n), z * z
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    return middle - half, middle + half


def trend(df: DataFrame, order: str, value: str, window: int = 30) -> DataFrame:
    """Slope, R2, means of the first and last rows, sd (n), range and share of rises of a metric over its order."""
    last = df.agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.orderBy(order)  # one row per shard: the metric's table is small by nature
    r = df.select(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y"), F.row_number().over(ordered).alias("i"), F.lag(value).over(ordered).alias("was")).join(F.broadcast(last))
    return r.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.avg(F.when(F.col("i") <= window, F.col("y"))).alias("first_mean"),
        F.avg(F.when(F.col("i") > F.col("_n") - window, F.col("y"))).alias("last_mean"), F.stddev_pop("y").alias("sd"), (F.max("y") - F.min("y")).alias("spread"), F.avg((F.col("y") > F.col("was")).cast("double")).alias("up_share"),
    )


def trend_verdict(df: DataFrame, order: str, value: str, window: int = 30) -> DataFrame:
    """One row: n, slope, growth (mean of the last ``window`` rows less that of the first), spread of the last ones, the share
    of them that rise, and the verdict on a metric of memory in MB; fewer rows than a window are no evidence."""
    last = df.agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.orderBy(order)  # one row per shard: the metric's table is small by nature
    r = df.select(F.col(value).cast("double").alias("y"), F.row_number().over(ordered).alias("i"), F.lag(value).over(ordered).alias("was")).join(F.broadcast(last))
    tail = F.col("i") > F.col("_n") - window
    in_tail = F.when(tail, F.col("y"))
    rises = F.when(F.col("i") > F.col("_n") - window + 1, (F.col("y") > F.col("was")).cast("double"))
    row = r.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.col("y"), F.col("i").cast("double")).alias("slope"), (F.avg(in_tail) - F.avg(F.when(F.col("i") <= window, F.col("y")))).alias("growth"),
        F.stddev_pop(in_tail).alias("last_sd"), (F.max(in_tail) - F.min(in_tail)).alias("last_spread"), F.avg(rises).alias("last_up_share"),
    )
    g, sd, spread = F.col("growth"), F.col("last_sd"), F.col("last_spread")
    # The names of the verdicts, their order, and their limits in MB.
    verdict = (
        F.when(F.col("n") < window, "INSUFFICIENT_EVIDENCE").when((g > 200) & (F.col("slope") > 0.3) & (F.col("last_up_share") > 0.6), "MONOTONIC_GROWTH").when((g > 100) & (sd < 30) & (spread < 80), "POSSIBLE_ALLOCATOR_RETENTION")
        .when((sd < 40) & (spread < 100) & (F.abs("slope") < 0.15), "STABLE_PLATEAU").when((g > 50) & (sd < 50), "POSSIBLE_ALLOCATOR_RETENTION").otherwise("INSUFFICIENT_EVIDENCE")
    )
    return row.withColumn("verdict", verdict)


def grid_share(df: DataFrame, fields: list[str], steps: list[float]) -> DataFrame:
    long = long_form(df, fields, []).filter(F.col("value").isNotNull())
    return long.groupBy("field").agg(*(F.avg(on_grid("value", s).cast("double")).alias(f"on_{s:g}".replace(".", "_")) for s in steps))


def findings(df: DataFrame, split: str, zero: str, measures: list[str], medians: list[str], shift_limit: float = 0.05, invalid_limit: float = 0.01, train: str = "train", held: str = "eval") -> DataFrame:
    """(finding, figure, found): zeros of a measure, missing rates, relative shifts of medians between splits, invalid share."""
    rows = cut(df)
    base = rows.agg(
        F.sum((F.col(zero) == 0).cast("double")).alias(f"{zero}_zero"), F.avg((F.col("quality_status") == "INVALID").cast("double")).alias("invalid_rate"),
        *(F.avg(F.col(m).isNull().cast("double")).alias(f"missing_{m}") for m in measures),
    )
    counts = value_counts(rows, medians, [split])
    middle = exact_percentiles(counts, ["field", split], "value", "n", (0.5,), ["m"]).groupBy("field").pivot(split, [train, held]).agg(F.first("m"))
    moved = middle.select(F.concat(F.lit("shift_"), "field").alias("finding"), F.try_divide(F.abs(F.col(train) - F.col(held)), F.nullif(F.abs(train), F.lit(0.0))).alias("figure"))
    moved = moved.withColumn("found", F.coalesce(F.col("figure") > shift_limit, F.lit(False)))
    limits = {f"{zero}_zero": 0.0, "invalid_rate": invalid_limit} | {f"missing_{m}": 0.0 for m in measures}
    rest = base.select(F.explode(F.array(*(F.struct(F.lit(n).alias("finding"), F.col(n).alias("figure"), (F.col(n) > v).alias("found")) for n, v in limits.items()))).alias("x")).select("x.*")
    return rest.unionByName(moved).withColumn("figure", F.round("figure", 6))
