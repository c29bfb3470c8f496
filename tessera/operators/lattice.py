"""Before/after lattices: enumeration, validation, gates, utilities, ranking, regret, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import flags
from tessera.functions.scratch import cut


def enumerate_actions(states: DataFrame, deltas: list[float], value: str, low: float, high: float) -> DataFrame:
    """Each state with each delta that keeps ``value`` inside its bounds; the list of deltas is a parameter."""
    acted = states.withColumn("delta", F.explode(F.array(*(F.lit(float(d)) for d in deltas))))
    return acted.withColumn("intended", F.col(value) + F.col("delta")).filter(F.col("intended").between(low, high))


def row_errors(before: Column, after: Column, realized: Column, source: Column, tolerance: float = 1e-9) -> Column:
    """Names of what is wrong with a transition row: copied, missing or inconsistent realised deltas."""
    return flags([
        ("missing_realized", realized.isNull()), ("copied_from_intended", source == "intended"), ("missing_before_after", before.isNull() | after.isNull()),
        ("delta_mismatch", F.abs(realized - (after - before)) > tolerance),
    ])


def lattice_summary(rows: DataFrame, keys: list[str], errors: str) -> DataFrame:
    """Rows, repeated rows by ``keys``, and rows with errors."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.size(errors) > 0).cast("long")).alias("bad"))
    return counts.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("bad").alias("failed"))


def calibration_gates(rows: DataFrame, family: str, intended: str, realized: str, side: list[str], spec: str | None = None, close: float = 0.15, near: float = 0.5, share: float = 0.35) -> DataFrame:
    """Per family: executability, accuracy, monotonicity over >= 3 levels, locality, sensitivity (as many
    distinct ``spec`` as levels but one, three at least), reproducibility, and the decision."""
    level = F.round(F.col(intended), 3)
    error = F.abs(F.col(realized) - F.col(intended))
    magnitude = F.when(F.abs(F.col(intended)) == 0, 1.0).otherwise(F.abs(F.col(intended)))
    leak = F.greatest(*(F.abs(F.col(s)) for s in side), F.lit(0.0)) > share * magnitude
    levels = rows.groupBy(family, level.alias("level")).agg(F.avg(realized).alias("mean"), F.count(F.lit(1)).alias("n"), (F.max(realized) - F.min(realized)).alias("spread"))
    order = Window.partitionBy(family).orderBy("level")
    steps = levels.withColumn("rises", F.col("mean") > F.lag("mean").over(order))
    shape = steps.groupBy(family).agg(F.count(F.lit(1)).alias("levels"), F.coalesce(F.bool_and("rises"), F.lit(False)).alias("monotone"), F.max(F.when(F.col("n") >= 3, F.col("spread"))).alias("spread"))
    base = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col(realized).isNotNull()).alias("executable"), F.max(error).alias("max_error"), F.avg(error).alias("mean_error"), F.bool_or(leak).alias("leaks"), (F.count_distinct(spec) if spec else F.lit(None).cast("bigint")).alias("specs"))
    g = base.join(shape, family)
    accuracy = F.when(F.col("max_error") < close, "PASS").when(F.col("max_error") < near, "PARTIAL").otherwise("FAIL")
    rising = F.col("monotone") & (F.col("levels") >= 3)
    sound = F.col("executable") & accuracy.isin("PASS", "PARTIAL") & rising
    repro = F.when(F.col("spread").isNull(), "NOT_RUN").when(F.col("spread") < 1e-6, "PASS").when(F.col("spread") < 0.05, "PARTIAL").otherwise("FAIL")
    return g.select(
        family, "n", "max_error", "mean_error", "levels", F.when(F.col("executable"), "PASS").otherwise("FAIL").alias("g1"), accuracy.alias("g2"), F.when(rising, "PASS").otherwise("FAIL").alias("g3"),
        F.when(F.col("leaks"), "FAIL").otherwise("PARTIAL").alias("g4"),
        F.when(F.col("specs").isNull(), "NOT_RUN").when(F.col("specs") >= F.greatest(F.lit(3), F.col("levels") - 1), "PASS").otherwise("FAIL").alias("g5"), repro.alias("g6"), F.when(sound & (accuracy == "PASS"), "GO").when(sound, "PARTIAL").otherwise("NO-GO").alias("decision"),
    )


def physical_utility(contact: Column, clearance: Column, overall: Column, edit: Column, side: Column | None = None) -> Column:
    """Linear utility of an outcome; a clearance of 0 or null falls back to the overall one; no outcome, no utility."""
    # Weights of contact, tightness, edit and side effect, and the comfortable clearance.
    chest = F.coalesce(F.nullif(clearance, F.lit(0.0)), overall, F.lit(0.0))
    tight = F.greatest(F.lit(0.0), F.lit(0.50) - chest)
    u = -25.0 * F.coalesce(contact, F.lit(0.0)) - 20.0 * tight - 0.15 * F.abs(edit) - 0.25 * F.abs(side if side is not None else F.lit(0.0))
    return F.when(contact.isNull() & clearance.isNull() & overall.isNull(), None).otherwise(u)


def ood_score(body_known: Column, material_known: Column, delta: Column, failed: Column, low: float = -3.0, high: float = 3.0) -> Column:
    # What each departure from the supported range adds.
    return F.least(F.lit(1.0), F.when(body_known, 0.0).otherwise(0.45) + F.when(material_known, 0.0).otherwise(0.35) + F.when(delta.between(low, high), 0.0).otherwise(0.40) + F.when(failed, 0.50).otherwise(0.0))


def abstention(body_known: Column, material_known: Column, action_known: Column, stable: Column, gap: Column, score: Column, min_gap: float = 0.02, limit: float = 0.55) -> Column:
    """Reasons to abstain; none means decide."""
    return flags([
        ("OOD_BODY", ~body_known), ("OOD_MATERIAL", ~material_known), ("OOD_ACTION_MAGNITUDE", ~action_known), ("SIMULATION_UNSTABLE", ~stable),
        ("AMBIGUOUS_CANDIDATES", gap < min_gap), ("OOD_DETECTOR", score >= limit),
    ])


def rank_candidates(df: DataFrame, state: list[str], utility: str, tie: str) -> DataFrame:
    """rank and recommended within each state, best utility first, ties by ``tie``; null utilities are left out."""
    w = Window.partitionBy(*state).orderBy(F.desc(utility), F.col(tie))
    return df.filter(F.col(utility).isNotNull()).withColumn("rank", F.row_number().over(w)).withColumn("recommended", F.col("rank") == 1)


def oracle_cases(candidates: DataFrame, state: list[str], targets: list[float], value: str, action: str, side: str, side_weight: float = 0.5) -> DataFrame:
    """For each state and target: the best action, its utility and the full ranking."""
    cases = candidates.withColumn("target", F.explode(F.array(*(F.lit(float(t)) for t in targets))))
    u = -(F.abs(F.col(value) - F.col("target")) + side_weight * F.abs(F.col(side)))
    entry = F.struct((-u).alias("cost"), F.col(action).alias("action"))
    grouped = cases.groupBy(*state, "target").agg(F.array_sort(F.collect_list(entry)).alias("ranking"))
    return grouped.select(*state, "target", F.col("ranking")[0]["action"].alias("oracle"), (-F.col("ranking")[0]["cost"]).alias("utility"), F.transform("ranking", lambda r: r["action"]).alias("ranking"))


def nearest(df: DataFrame, by: list[str], action: str, value: str, target: Column) -> DataFrame:
    """The action whose value is nearest to the target; ties go to the smaller action."""
    return df.groupBy(*by).agg(F.min(F.struct(F.abs(F.col(value) - target).alias("gap"), F.col(action).alias("action"))).alias("m")).select(*by, F.col("m.action").alias("action"), F.col("m.gap").alias("gap"))


def regret(cases: DataFrame, utilities: DataFrame, keys: list[str], action: str, utility: str, chosen: str, penalty: float = -10.0) -> DataFrame:
    """Oracle utility less the chosen action's; an unknown action has the penalty."""
    best = utilities.groupBy(*keys).agg(F.max(utility).alias("best"))
    picked = cases.join(utilities.select(*keys, F.col(action).alias(chosen), F.col(utility).alias("got")), [*keys, chosen], "left")
    return picked.join(best, keys).withColumn("regret", F.col("best") - F.coalesce("got", F.lit(penalty)))


def flip_rate(rows: DataFrame, state: str, condition: str, action: str, utility: str, default: str, other: str) -> DataFrame:
    """Share of states whose best action differs between two conditions, and the utility that following it gains."""
    best = rows.filter(F.col(utility).isNotNull()).groupBy(state).pivot(condition, [default, other]).agg(F.max(F.struct(F.col(utility).alias("u"), F.col(action).alias("a"))))
    pairs = best.filter(F.col(default).isNotNull() & F.col(other).isNotNull())
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col(f"{default}.a") != F.col(f"{other}.a")).cast("long")).alias("flips"), F.avg((F.col(f"{default}.a") != F.col(f"{other}.a")).cast("double")).alias("flip_rate"))


def ood_table(rows: DataFrame, parts: dict[str, Column], error: Column, side_effect: Column) -> DataFrame:
    """(part, n, mae, side_effect_rate) for conditions that may overlap; one pass, whatever their number."""
    named = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in parts.items())), lambda p: p.isNotNull())
    each = rows.select(error.alias("e"), side_effect.cast("double").alias("s"), F.explode(named).alias("part"))
    return each.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"), F.avg("s").alias("side_effect_rate"))


def disagreement(rows: DataFrame, same: list[str], condition: str, first: str, second: str, value: str, limit: float) -> DataFrame:
    """One row: over what is alike in ``same``, how far the mean ``value`` under two conditions is apart: pairs, the mean and
    largest gap, and the share of gaps over ``limit``."""
    means = rows.groupBy(*same).pivot(condition, [first, second]).agg(F.avg(value))
    gap = F.abs(F.col(first) - F.col(second))
    return means.select(gap.alias("gap")).filter("gap IS NOT NULL").agg(F.count(F.lit(1)).alias("pairs"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("largest_gap"), F.avg((F.col("gap") > limit).cast("double")).alias("disagree"))


def necessity_verdict(flips: DataFrame, accuracies: DataFrame, base: str, whole: str, least_pairs: int = 8, least_gain: float = 0.02) -> DataFrame:
    """One row from a row of ``flip_rate`` and accuracies (features, accuracy, low, high): the claim that ``whole`` is needed
    beside ``base`` stands if there are enough pairs, one flips at least, and accuracy rises with separated intervals."""
    side = lambda name, p: accuracies.filter(F.col("features") == name).select(*(F.col(c).alias(f"{p}_{c}") for c in ("accuracy", "low", "high")))
    row = flips.select("pairs", "flips").join(F.broadcast(side(base, "b"))).join(F.broadcast(side(whole, "w")))
    gain, separated = F.col("w_accuracy") - F.col("b_accuracy"), F.col("w_low") > F.col("b_high")
    few, still, flat = F.col("pairs") < least_pairs, F.col("flips") < 1, F.col("w_accuracy") <= F.col("b_accuracy") + least_gain
    reason = F.when(few, "too_few_pairs").when(still, "no_flips").when(~separated, "intervals_overlap").when(flat, "no_gain").otherwise("gain_with_separated_intervals")
    return row.select("pairs", "flips", gain.alias("gain"), separated.alias("separated"), (~few & ~still & ~flat & separated).alias("established"), reason.alias("reason"))


def ladder_acceptance(rows: DataFrame, ladder: str, level: str, invariants: list[str], target: str, levels: list[str]) -> DataFrame:
    """Per ladder: complete, controls invariant, value rises over the levels, targets unique, accepted."""
    at = [F.max(F.when(F.col(level) == v, F.col("value"))).alias(f"v{i}") for i, v in enumerate(levels)]
    g = rows.groupBy(ladder).agg(F.count_distinct(level).alias("n_levels"), F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("targets"), *(F.count_distinct(c).alias(f"i_{c}") for c in invariants), *at)
    steady = F.lit(True)
    for c in invariants:
        steady = steady & (F.col(f"i_{c}") <= 1)
    rises = F.lit(True)
    for i in range(len(levels) - 1):
        rises = rises & F.coalesce(F.col(f"v{i}") < F.col(f"v{i + 1}"), F.lit(False))
    out = g.select(ladder, (F.col("n_levels") == len(levels)).alias("complete"), steady.alias("invariant"), rises.alias("monotone"), (F.col("targets") == F.col("n")).alias("unique_targets"))
    return out.withColumn("accepted", F.col("complete") & F.col("invariant") & F.col("monotone") & F.col("unique_targets"))


def rater_agreement(votes: DataFrame, item: str, category: str) -> DataFrame:
    """Fleiss' kappa over items with equally many votes (at least two), and the mean agreement."""
    counts = votes.groupBy(item, category).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree")).filter("r > 1")
    observed = per.agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("agree") / (F.col("r") * (F.col("r") - 1))).alias("agreement"))
    shares = counts.join(per.select(item), item, "left_semi").groupBy(category).agg(F.sum("n").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))
    return observed.join(F.broadcast(shares)).withColumn("kappa", F.try_divide(F.col("agreement") - F.col("chance"), 1 - F.col("chance")))


def rater_verdicts(votes: DataFrame, item: str, category: str, reversed_: str) -> DataFrame:
    """Per item: votes, the category that more than half chose, and RESOLVED, REVERSED (it is ``reversed_``) or UNRESOLVED."""
    counts = votes.groupBy(F.col(item).alias("item"), F.col(category).alias("cat")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("item").agg(F.sum("n").alias("votes"), F.max(F.struct("n", "cat")).alias("top"))
    clear = 2 * F.col("top.n") > F.col("votes")
    status = F.when(~clear, "UNRESOLVED").when(F.col("top.cat") == reversed_, "REVERSED").otherwise("RESOLVED")
    return per.select("item", "votes", F.when(clear, F.col("top.cat")).alias("majority"), status.alias("status"))


def median_ranks(votes: DataFrame, item: str, rank: str, answer: str) -> DataFrame:
    """Per item: the median of its ranks, and whether no two raters gave the same answer."""
    counts = cut(votes.groupBy(F.col(item).alias("item"), F.col(rank).alias("r")).agg(F.count(F.lit(1)).alias("n")))
    kinds = votes.groupBy(F.col(item).alias("item")).agg(F.count_distinct(answer).alias("kinds"), F.count(F.lit(1)).alias("votes"))
    # An item has as many distinct ranks as the scale, so its running counts fit one window.
    up = Window.partitionBy("item").orderBy("r")
    placed = counts.withColumns({"c": F.sum("n").over(up), "t": F.sum("n").over(Window.partitionBy("item"))})
    at = lambda k: F.min(F.when(F.col("c") > k, F.col("r")))
    middle = placed.groupBy("item").agg(((at(F.floor((F.col("t") - 1) / 2)) + at(F.ceil((F.col("t") - 1) / 2))) / 2).alias("median_rank"))
    return middle.join(kinds, "item").select("item", "median_rank", ((F.col("votes") > 1) & (F.col("kinds") == F.col("votes"))).alias("unresolved"))
