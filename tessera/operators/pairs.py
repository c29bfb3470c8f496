"""Tiered pairs of comparable samples: limited generation per group, controls, scores, audits.

Sample rows have: id, split, shard, person, cloth, target, fingerprint (bigint bits), ease, quality_status, usable,
duplicate_* and leakage_* flags, and the measure columns named by ``Measures``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import flags, pair_id
from tessera.functions.scratch import cut
from tessera.operators.stats import purity

#: All pairs up to this group size, else neighbours, and this many of them.
ALL_PAIRS_UP_TO, NEIGHBOUR_CAP = 6, 32
FAMILY_BITS = 4
#: The leaks that take a held-out sample away, and those of a member that count against a pair.
LEAKS = ("leakage_person", "leakage_cloth", "leakage_target", "leakage_pair")
PAIR_LEAKS = LEAKS[:3]


@dataclass(frozen=True)
class Measures:
    body: tuple[str, ...]
    garment: tuple[str, ...]
    ease: str = "ease"

    @property
    def order(self) -> tuple[str, ...]:
        return (self.ease, self.garment[0], "id")


def limited_pairs(samples: DataFrame, group: list[str], order: tuple[str, ...], whole: bool = False) -> DataFrame:
    """(group..., a, b) ids of the pairs of each group: all up to six members, else at most 32 neighbours in order,
    and first with last when the neighbours do not use up the cap.  Null group keys form no group.

    With ``whole``, a and b are structs of all columns instead of ids, so that no sample has to be joined back.  The
    rule never looks past the place NEIGHBOUR_CAP + 1: places are cut there, which Spark does before it shuffles, so a
    hot group costs its task no more than others.  A member finds those it is compared with in the rows after it, where
    its group lies sorted: members are shuffled once, or not at all if they lie by a column of the group.
    """
    keyed = reduce(lambda d, g: d.filter(F.col(g).isNotNull()), group, samples)
    own, w = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(*order)
    places = keyed.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= NEIGHBOUR_CAP + 1)
    # What is left of a group tells whether it has up to six members, up to the cap, or more.
    numbered = places.withColumn("_n", F.count(F.lit(1)).over(own)).filter("_n > 1")
    member = F.struct(*(samples.columns if whole else ["id"]))
    lead = lambda k: F.lead("a", k).over(w).alias(f"b{k}")
    found = numbered.withColumn("a", member).select(*group, "a", F.col("_i").alias("i"), F.col("_n").alias("n"), *map(lead, range(1, ALL_PAIRS_UP_TO)), F.last("a").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("z"))
    every = F.array(*(f"b{k}" for k in range(1, ALL_PAIRS_UP_TO)))
    ends = F.array(F.when(F.col("i") <= NEIGHBOUR_CAP, F.col("b1")), F.when((F.col("i") == 1) & (F.col("n") - 1 < NEIGHBOUR_CAP), F.col("z")))
    met = found.select(*group, "a", F.explode(F.array_compact(F.when(F.col("n") <= ALL_PAIRS_UP_TO, every).otherwise(ends))).alias("b"))
    return met if whole else met.select(*group, F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _constant(fields: tuple[str, ...], tolerance: float = 1e-6) -> Column:
    return reduce(lambda x, y: x & y, (F.coalesce(F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) <= tolerance, F.lit(False)) for f in fields))


def _either(flag: str) -> Column:
    return F.coalesce(F.col(f"a.{flag}"), F.lit(False)) | F.coalesce(F.col(f"b.{flag}"), F.lit(False))


def pair_records(links: DataFrame, m: Measures, tier: Column) -> DataFrame:
    """Records of linked samples (structs a, b): the anchor is the one of lower ease, then bust, then id; same target or
    no changed garment measure is no pair."""
    first = F.struct(*(F.col(f"a.{c}").alias(f"k{i}") for i, c in enumerate(m.order))) <= F.struct(*(F.col(f"b.{c}").alias(f"k{i}") for i, c in enumerate(m.order)))
    p = links.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))
    varying = flags([(f, F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) > 0.01) for f in m.garment])
    same_cloth = F.col("a.cloth") == F.col("b.cloth")
    bits = F.coalesce(F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))), F.lit(64)).cast("int")
    p = p.withColumns({"varying": varying, "hamming": bits, "same_cloth": same_cloth}).filter((F.col("a.id") != F.col("b.id")) & (F.col("a.target") != F.col("b.target")) & (F.size("varying") > 0))
    p = p.withColumn("tier", tier)
    dup = _either("duplicate_target") | (F.col("tier").isin("B", "C") & _either("duplicate_cloth"))
    return p.select(
        pair_id("a.id", "b.id").alias("pair_id"), F.col("a.id").alias("anchor_id"), F.col("b.id").alias("counterfactual_id"), "tier",
        (F.col("a.person") == F.col("b.person")).alias("same_person"), "same_cloth", (~F.col("same_cloth") & (F.col("hamming") == 0)).alias("same_family"),
        (~F.col("same_cloth") & F.col("hamming").between(1, FAMILY_BITS)).alias("near_family"), "hamming", _constant(m.body).alias("body_constant"), "varying",
        (F.size("varying") == 1).alias("single_variable"), F.concat(F.lit("garment_"), F.array_join("varying", "_and_"), F.when(F.size("varying") == 1, "_only").otherwise("")).alias("intervention"),
        *((F.col(f"b.{f}") - F.col(f"a.{f}")).alias(f"delta_{f}") for f in (*m.garment, m.ease)),
        *(F.col(f"{side}.{f}").alias(f"{name}_{f}") for f in (*m.garment, m.ease, "target") for side, name in (("a", "anchor"), ("b", "counterfactual"))),
        ((F.col("a.quality_status") == "VALID") & (F.col("b.quality_status") == "VALID")).alias("both_valid"), (F.col("a.usable") & F.col("b.usable")).alias("both_usable"),
        dup.alias("contaminated"), reduce(lambda x, y: x | y, map(_either, PAIR_LEAKS)).alias("leaks"),
        (F.col("a.split") != F.col("b.split")).alias("cross_split"), F.col("a.split").alias("anchor_split"), F.col("a.shard").alias("anchor_shard"), F.col("a.quality_status").alias("anchor_quality"),
    )


def with_controls(pairs: DataFrame) -> DataFrame:
    """Adds confound_flags (fixed order), control_score in [0, 1] and a reason text."""
    t = F.col("tier")
    # The names of the confounds and their order.
    rules = [
        ("person_image_differs", ~F.col("same_person")), ("cloth_image_differs", ~F.col("same_cloth")), ("body_measurement_not_constant", ~F.col("body_constant")),
        ("no_garment_measurement_change", F.size("varying") == 0), ("multi_variable_garment_change", F.size("varying") > 1), ("cross_split_pair", F.col("cross_split")),
        ("exact_image_train_eval_overlap", F.col("leaks")), ("duplicate_image_flag", F.col("contaminated")), ("person_reuse_expected", t.isin("B", "C")), ("non_valid_quality", ~F.col("both_valid")),
        ("unusable_member", ~F.col("both_usable")), ("garment_appearance_confound", t == "C"), ("garment_family_is_near_duplicate_not_exact", F.col("near_family") & ~F.col("same_family")),
    ]
    on = lambda cond, v: F.when(cond, v).otherwise(0.0)
    # The weights of the controls.
    score = (
        on(F.col("same_person"), 0.34) + F.when(F.col("same_cloth"), 0.34).when(F.col("same_family"), 0.20).when(F.col("near_family"), 0.10).otherwise(0.0) + on(F.col("body_constant"), 0.14)
        + F.when(F.col("single_variable"), 0.10).when(F.size("varying") > 0, 0.04).otherwise(0.0) + F.lit(0.08) - on(F.col("leaks"), 0.12) - on(F.col("contaminated"), 0.06)
        - on(~F.col("both_valid"), 0.04) - on(F.col("cross_split"), 0.04) - on(~F.col("same_cloth") & (t == "C"), 0.08)
    )
    reason = F.concat_ws("; ", F.concat(F.lit("tier "), t), F.when(F.col("same_person"), "same person").otherwise("different person"), F.when(F.col("same_cloth"), "same cloth").otherwise("different cloth"), F.concat(F.lit("changes "), F.col("intervention")))
    return pairs.withColumns({"confound_flags": flags(rules), "control_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), "reason": reason})


def build_pairs(samples: DataFrame, m: Measures) -> DataFrame:
    """Tier A: same person and cloth, constant body.  Tier B / C: same person, other cloth, of one family or not.

    Each unordered pair keeps its strongest tier; A needs equal and B / C different cloths, so that needs no ranking.
    Both tiers read ``samples``; where these lie by person, neither shuffles them.
    """
    needed = ["id", "split", "shard", "person", "cloth", "target", "fingerprint", *m.body, *m.garment, m.ease, "quality_status", "usable", *(f for f in samples.columns if f.startswith(("duplicate_", "leakage_")))]
    usable = samples.filter("usable").dropna(subset=[*m.body, *m.garment, m.ease]).select(needed)
    a = pair_records(limited_pairs(usable, ["person", "cloth"], m.order, whole=True), m, F.lit("A")).filter("same_cloth AND body_constant")
    tier = F.when(F.col("hamming") <= FAMILY_BITS, "B").otherwise("C")
    bc = pair_records(limited_pairs(usable, ["person"], m.order, whole=True), m, tier).filter("same_person AND NOT same_cloth")
    return with_controls(a.unionByName(bc))


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cross_split").cast("long")).alias("cross_split"), F.avg("control_score").alias("mean_score"), F.count_distinct("intervention").alias("interventions"))


class PairError(ValueError):
    """A pair table breaks its contract."""


def required_columns(m: Measures) -> list[str]:
    """Columns of a pair table that validation reads."""
    return ["pair_id", "anchor_id", "counterfactual_id", "tier", "control_score", "anchor_target", "counterfactual_target", *(f"{side}_{f}" for f in (*m.garment, m.ease) for side in ("delta", "anchor", "counterfactual"))]


def _distinct(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """One row: how many different values ``columns`` have together, compared by 128 bits of hash.

    Counted at once, so that the shuffle of one count is gone before the next begins.
    """
    return cut(df.select(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")).distinct().agg(F.count(F.lit(1)).alias(name)))


def validate_pairs(pairs: DataFrame, m: Measures, tolerance: float = 1e-9) -> DataFrame:
    """One row of counts that must be zero in a sound pair table, and whether they are.  ``pairs`` is read three times.

    Self pairs, unordered pairs beyond their first, ids that are not those of their samples, deltas that the recorded
    measures do not give within ``tolerance`` (a missing one does not either), pairs of one target, and scores outside
    0 to 1.  An empty table is sound.  A column that is not there is a ``PairError``.
    """
    missing = [c for c in required_columns(m) if c not in pairs.columns]
    if missing:
        raise PairError(f"missing columns: {missing}")
    count = lambda broken: F.count_if(F.coalesce(broken, F.lit(True)))
    off = lambda f: F.abs(F.col(f"counterfactual_{f}") - F.col(f"anchor_{f}") - F.col(f"delta_{f}")) > tolerance
    ids = _distinct(pairs.filter(F.col("pair_id").isNotNull()), [F.col("pair_id")], "ids")
    ends = _distinct(pairs, [F.least("anchor_id", "counterfactual_id"), F.greatest("anchor_id", "counterfactual_id")], "_ends")
    checks = {
        "self_pairs": count(F.col("anchor_id") == F.col("counterfactual_id")), "wrong_ids": count(F.col("pair_id") != pair_id("anchor_id", "counterfactual_id")),
        "wrong_deltas": reduce(lambda x, y: x + y, (count(off(f)) for f in (*m.garment, m.ease))), "same_target": count(F.col("anchor_target") == F.col("counterfactual_target")), "bad_scores": count(~F.col("control_score").between(0.0, 1.0)),
    }
    row = pairs.agg(F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in checks.items())).join(F.broadcast(ids)).join(F.broadcast(ends)).withColumn("repeated_pairs", F.col("n") - F.col("_ends"))
    faults = ["self_pairs", "repeated_pairs", *(name for name in checks if name != "self_pairs")]
    return row.select("n", "ids", *faults, reduce(lambda x, y: x & y, (F.col(name) == 0 for name in faults)).alias("sound"))


def require_sound(pairs: DataFrame, m: Measures, require_rows: bool = False) -> dict:
    """The counts of ``validate_pairs``; raises a ``PairError`` if one is not zero, or if rows are required and there are none."""
    found = validate_pairs(pairs, m).first().asDict()
    if require_rows and not found["n"]:
        raise PairError("the pair table is empty")
    if not found["sound"]:
        raise PairError(f"pair table is not sound: {found}")
    return found


def shortcut_audit(pairs: DataFrame, delta: str) -> DataFrame:
    """Can the design be solved by a shortcut?  Level counts, grid share, purities, the raw verdict and the final one.

    The final verdict lets PARTIAL_CONFOUND override FAIL when nothing shares a cloth; the raw one does not.
    """
    base = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.rint(F.col(delta) * 10) / 10).alias("delta_levels_1dp"), F.avg((F.abs(F.col(delta) / 0.05 - F.rint(F.col(delta) / 0.05)) <= 1e-8).cast("double")).alias("on_005"),
        F.avg(F.col("same_person").cast("double")).alias("same_person_share"), F.avg(F.col("same_cloth").cast("double")).alias("same_cloth_share"), F.sum((F.col("tier") == "A").cast("long")).alias("tier_a"),
        F.avg(F.col("leaks").cast("double")).alias("leak_share"), F.avg(F.col("cross_split").cast("double")).alias("cross_share"), F.count_distinct("anchor_split").alias("splits"),
    )
    bin_1dp = F.rint(F.col("anchor_ease") * 10) / 10
    for name, label in (("split", "anchor_split"), ("shard", "anchor_shard"), ("quality", "anchor_quality")):
        base = base.join(F.broadcast(purity(pairs, bin_1dp, label).select(F.col("purity").alias(f"{name}_purity"))))
    preset, grid = F.col("delta_levels_1dp") <= 6, F.col("on_005") >= 0.8
    lonely = (F.col("same_cloth_share") < 0.01) & (F.col("tier_a") == 0)
    issue = preset | grid | lonely | ((F.col("split_purity") >= 0.95) & (F.col("splits") > 1)) | (F.col("shard_purity") >= 0.95) | (F.col("same_person_share") < 1)
    raw = F.when(preset | grid, "FAIL").when(issue, "PASS_WITH_CONTROLS").otherwise("PASS")
    return base.withColumns({"raw_verdict": raw, "verdict": F.when(lonely, "PARTIAL_CONFOUND").otherwise(raw)})


def controlled_ids(samples: DataFrame, flags_: tuple[str, ...] = LEAKS, held: str = "eval") -> DataFrame:
    """Held-out ids without any of the leaks."""
    leak = reduce(lambda a, b: a | b, (F.col(f) for f in flags_))
    return samples.filter((F.col("split") == held) & ~leak).select("id")
