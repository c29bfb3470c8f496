"""Structure discovery: what varies inside groups, repeated vectors, radius joins, near-duplicate clusters."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import half_even
from tessera.functions.scratch import cut


def varying_groups(df: DataFrame, keys: list[str], columns: list[str], preset: tuple[int, int] = (2, 8)) -> DataFrame:
    """Over the groups of ``keys`` with several rows: how many vary in each column, in one only, or at preset-like levels."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *(F.count_distinct(c).alias(f"d_{c}") for c in columns)).filter("size > 1")
    changed = sum((F.col(f"d_{c}") > 1).cast("int") for c in columns)
    levels = F.greatest(*(F.col(f"d_{c}") for c in columns)) if len(columns) > 1 else F.col(f"d_{columns[0]}")
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows"), *(F.coalesce(F.sum((F.col(f"d_{c}") > 1).cast("long")), F.lit(0)).alias(f"vary_{c}") for c in columns),
        F.coalesce(F.sum((changed == 1).cast("long")), F.lit(0)).alias("single_variable"), F.coalesce(F.sum(levels.between(*preset).cast("long")), F.lit(0)).alias("preset_like"), F.max("size").alias("largest"),
    )


def _differ(c: str) -> Column:
    """Whether a group has several values of ``c``: its least and greatest tell, without a set of them."""
    return F.coalesce(F.min(c) < F.max(c), F.lit(False))


def _multiple(df: DataFrame, keys: list[str], columns: list[str], **more: Column) -> DataFrame:
    """Groups of ``keys`` with several rows: ``size`` and, per column, whether it varies, ``v_<column>``; null keys are no group."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *(_differ(c).alias(f"v_{c}") for c in columns), *(c.alias(name) for name, c in more.items())).filter("size > 1")


def _totals(groups: DataFrame, marks: dict[str, Column], rows: list[str], **more: Column) -> DataFrame:
    """One row: groups, and per mark how many have it, and for those in ``rows`` how many rows these hold."""
    marked = groups.withColumns(marks)
    return marked.agg(
        F.count(F.lit(1)).alias("groups"), *(F.count_if(m).alias(m) for m in marks), *(F.coalesce(F.sum(F.when(F.col(m), F.col("size"))), F.lit(0)).alias(f"{m}_rows") for m in rows), *(c.alias(name) for name, c in more.items()),
    )


def _varies(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(f"v_{c}") for c in columns))


def person_cloth_structure(df: DataFrame, keys: list[str], body: list[str], garment: list[str], target: str, preset: tuple[int, int] = (2, 8)) -> DataFrame:
    """Same person and cloth, several rows: what differs, groups that make a tier-A comparison (target and garment differ, body
    constant) and their rows, groups in which one garment measure alone changes, and those of them at preset-like levels."""
    own = Window.partitionBy(*keys)
    several = df.dropna(subset=keys).select(*keys, *body, *garment, target, F.count(F.lit(1)).over(own).alias("_n"), *(F.coalesce(F.min(c).over(own) < F.max(c).over(own), F.lit(False)).alias(f"_v_{c}") for c in garment)).filter("_n > 1")
    changed = reduce(lambda a, b: a + b, (F.col(f"_v_{c}").cast("int") for c in garment))
    # Levels matter where one measure changes alone, so they are counted for that one only.
    alone = F.when(changed == 1, F.coalesce(*(F.when(F.col(f"_v_{c}"), F.col(c).cast("double")) for c in garment)))
    g = _multiple(several.withColumns({"_changed": changed, "_alone": alone}), keys, [*body, *garment, target], changed=F.max("_changed"), levels=F.count_distinct("_alone"))
    marks = {"different_target": F.col(f"v_{target}"), "different_garment": _varies(garment), "different_body": _varies(body)}
    marks |= {"body_constant": ~_varies(body), "tier_a": F.col(f"v_{target}") & _varies(garment) & ~_varies(body), "single_variable": F.col("changed") == 1, "preset_like": (F.col("changed") == 1) & F.col("levels").between(*preset)}
    return _totals(g, marks, ["tier_a"])


def person_structure(df: DataFrame, key: str, body: list[str], garment: list[str], ease: list[str], cloth: str, target: str) -> DataFrame:
    """Same person, several rows: body measures that contradict one another (groups, rows), what varies, groups that make a
    tier-C comparison (another cloth and target, garment varies, body constant) and their rows, and the most cloths of a person."""
    g = _multiple(df, [key], [*body, *garment, *ease, cloth, target], cloths=F.count_distinct(cloth))
    other, goal = F.col(f"v_{cloth}"), F.col(f"v_{target}")
    marks = {"inconsistent_body": _varies(body), "body_constant": ~_varies(body), "different_cloth": other, "different_target": goal, "garment_varies": _varies(garment), "ease_varies": _varies(ease), "tier_c": ~_varies(body) & other & _varies(garment) & goal}
    return _totals(g, marks, ["inconsistent_body", "tier_c"], most_cloths=F.coalesce(F.max("cloths"), F.lit(0)))


def cloth_structure(df: DataFrame, key: str, body: list[str], garment: list[str], person: str, target: str) -> DataFrame:
    """Same cloth, several rows: garment measures that contradict one another (groups, rows), other persons, targets and
    bodies, contradicting measures on different persons, and varied bodies under constant measures."""
    g = _multiple(df, [key], [*body, *garment, person, target])
    who, goal = F.col(f"v_{person}"), F.col(f"v_{target}")
    marks = {"inconsistent_garment": _varies(garment), "different_person": who, "different_target": goal, "body_varies": _varies(body), "garment_constant": ~_varies(garment)}
    marks |= {"measured_apart": _varies(garment) & who, "body_varied_alone": ~_varies(garment) & who & goal & _varies(body)}
    return _totals(g, marks, ["inconsistent_garment"])


def variation_types(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(varying, groups): which of the columns change together within the groups of ``keys``, as names joined by ``+``."""
    label = F.concat_ws("+", *(F.when(F.col(f"v_{c}"), F.lit(c)) for c in columns))
    return _multiple(df, keys, columns).filter(_varies(columns)).groupBy(label.alias("varying")).agg(F.count(F.lit(1)).alias("groups"))


def repeated_vectors(df: DataFrame, columns: list[str], decimals: int | None = None) -> DataFrame:
    """Distinct vectors, repeated ones, rows in them, greatest and mean frequency; optionally after rounding."""
    v = [half_even(c, decimals).alias(c) if decimals is not None else F.col(c) for c in columns]
    counts = df.dropna(subset=columns).groupBy(*v).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("vectors"), F.sum((F.col("n") > 1).cast("long")).alias("repeated"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_repeated"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def radius_pairs(df: DataFrame, columns: list[str], radius: float) -> DataFrame:
    """(a, b, distance) of distinct vectors within ``radius``, inclusive, each pair once.

    Vectors fall into cells of side ``radius``; each is sent to the half of the neighbouring cells that no neighbour
    sends back from, so the join is on the cell and a pair meets once.
    """
    v = df.dropna(subset=columns).select(*columns).distinct()
    point = F.struct(*columns)
    cell = [F.floor(F.col(c) / radius) for c in columns]
    home = v.select(F.array(*cell).alias("cell"), point.alias("b"))
    half = [o for o in product((-1, 0, 1), repeat=len(columns)) if o >= (0,) * len(columns)]
    sent = v.select(F.explode(F.array(*(F.array(*(x + o for x, o in zip(cell, offset, strict=True))) for offset in half))).alias("cell"), F.array(*cell).alias("own"), point.alias("a"))
    distance = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns))
    joined = sent.join(home, "cell").filter((F.col("cell") != F.col("own")) | (F.col("a") < F.col("b"))).withColumn("distance", distance)
    return joined.filter(F.col("distance") <= radius).select("a", "b", "distance")


def radius_summary(df: DataFrame, columns: list[str], radius: float, leaf: int = 32) -> DataFrame:
    """One row: ``pairs`` of distinct vectors within ``radius``, inclusive, and how many vectors are ``touched`` by one.

    Pairs are counted by cells, not formed.  Two cells whose boxes lie wholly within the radius count the product of
    their vectors, two that lie wholly beyond it nothing.  Of the cells of the pairs that are left, those with over
    ``leaf`` vectors are halved along every axis and the pairs of their parts judged in the next round, until only pairs
    of cells with up to ``leaf`` vectors are left, whose vectors meet.  So a dense cell costs its border, and one round
    serves all cells; there are as many rounds as the densest border cell needs halvings.  Rows with a null are left out.

    Boxes and vectors are measured by the same operations in the same order, which rounding keeps monotone, so a box
    decides as its vectors would.
    """
    if radius <= 0:
        raise ValueError("the radius is positive")
    v = df.dropna(subset=columns).select(*(F.col(c).cast("double").alias(c) for c in columns)).distinct()
    cell = F.array(*(F.floor(F.col(c) / radius) for c in columns))
    points = cut(v.select(*columns, F.array_join(cell.cast("array<string>"), ",").alias("node")))
    box = [F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("lo", F.min), ("hi", F.max)))]
    fields = ["node", "n", *(f"{side}_{c}" for c in columns for side in ("lo", "hi"))]
    apart = lambda c: F.greatest(F.col(f"a.lo_{c}") - F.col(f"b.hi_{c}"), F.col(f"b.lo_{c}") - F.col(f"a.hi_{c}"), F.lit(0.0))
    across = lambda c: F.greatest(F.col(f"a.hi_{c}") - F.col(f"b.lo_{c}"), F.col(f"b.hi_{c}") - F.col(f"a.lo_{c}"))
    length = lambda side: F.sqrt(sum(side(c) * side(c) for c in columns))
    same = F.col("a.node") == F.col("b.node")
    # Cells of the first round meet as the vectors of a radius join do.
    roots = cut(points.groupBy("node").agg(*box)).select(F.struct(*fields).alias("x"), F.split("node", ",").cast("array<bigint>").alias("cell"))
    half = [o for o in product((-1, 0, 1), repeat=len(columns)) if o >= (0,) * len(columns)]
    sent = roots.select(F.col("x").alias("a"), F.explode(F.array(*(F.array(*(F.col("cell")[k] + d for k, d in enumerate(o))) for o in half))).alias("cell"))
    pairs = sent.join(roots.select(F.col("x").alias("b"), "cell"), "cell").select("a", "b")
    counted, marks, leaves = [], [], []
    while True:
        judged = pairs.withColumns({"near": length(apart) <= radius, "whole": length(across) <= radius}).filter("near")
        judged = cut(judged.withColumn("small", (F.col("a.n") <= leaf) & (F.col("b.n") <= leaf)))
        inside = judged.filter("whole")
        counted.append(inside.select(F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n")).cast("bigint").alias("pairs")))
        marks.append(inside.filter(~same | (F.col("a.n") > 1)).select(F.explode(F.array("a.node", "b.node")).alias("node")))
        leaves.append(judged.filter("NOT whole AND small").select(F.col("a.node").alias("na"), F.col("b.node").alias("nb")))
        open_ = judged.filter("NOT whole AND NOT small")
        split = cut(open_.select(F.explode(F.array("a", "b")).alias("x")).select("x.*").filter(F.col("n") > leaf).dropDuplicates(["node"]))
        if split.isEmpty():
            break
        # A vector's part of its cell: one digit per axis, whether it lies over the middle of the box.
        middle = {c: (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in columns}
        over = lambda c: ((F.col(c) > middle[c]) | (middle[c] >= F.col(f"hi_{c}")) & (F.col(c) >= F.col(f"hi_{c}"))) & (F.col(f"lo_{c}") < F.col(f"hi_{c}"))
        part = F.concat("node", F.lit("/"), *(over(c).cast("int").cast("string") for c in columns))
        points = cut(points.join(split, "node", "left").select(*columns, F.col("node").alias("was"), F.when(F.col("n").isNotNull(), part).otherwise(F.col("node")).alias("node")))
        fresh = points.filter(F.col("was") != F.col("node")).groupBy("was", "node").agg(*box).select("was", F.struct(*fields).alias("x"))
        stay = open_.select(F.explode(F.array("a", "b")).alias("x")).filter(F.col("x.n") <= leaf).select(F.col("x.node").alias("was"), "x").dropDuplicates(["was"])
        below = cut(fresh.unionByName(stay))
        ends = open_.select(F.col("a.node").alias("na"), F.col("b.node").alias("nb"))
        opened = ends.join(below.select(F.col("was").alias("na"), F.col("x").alias("a")), "na").join(below.select(F.col("was").alias("nb"), F.col("x").alias("b")), "nb")
        pairs = opened.filter((F.col("na") != F.col("nb")) | (F.col("a.node") <= F.col("b.node"))).select("a", "b")
        points = points.drop("was")
    vector = F.struct(*columns)
    met = reduce(DataFrame.unionByName, leaves).join(points.select(F.col("node").alias("na"), vector.alias("a")), "na").join(points.select(F.col("node").alias("nb"), vector.alias("b")), "nb")
    distance = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns))
    met = met.filter(((F.col("na") != F.col("nb")) | (F.col("a") < F.col("b"))) & (distance <= radius))
    # What the meeting of small cells leaves: per vector, how many it has met as the first of a pair, and that it was met.
    ends = cut(met.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"), F.collect_set("b").alias("met")))
    total = reduce(DataFrame.unionByName, [*counted, ends.select("pairs")]).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    marked = reduce(DataFrame.unionByName, marks).distinct()
    steps = F.split("node", "/")
    within = points.select(vector.alias("v"), F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("node")).join(marked, "node", "left_semi").select("v")
    touched = within.unionByName(ends.select(F.col("a").alias("v"))).unionByName(ends.select(F.explode("met").alias("v"))).distinct()
    return total.join(F.broadcast(touched.agg(F.count(F.lit(1)).alias("touched"))))


def covering_masks(limit: int, width: int) -> list[int]:
    """Masks of the ``width`` low bits such that any two words that differ in ``limit`` of them agree under one.

    Each place has a non-zero vector of limit + 1 bits; a mask keeps the places whose vector has an odd product with its
    number.  ``limit`` differing places leave some number orthogonal to all of theirs.
    """
    numbers = range(1, 1 << (limit + 1))
    return [sum(1 << p for p in range(width) if (numbers[p % len(numbers)] & v).bit_count() % 2) for v in numbers]


def hamming_pairs(df: DataFrame, bits: str, limit: int, width: int = 64) -> DataFrame:
    """(a, b, distance) of distinct fingerprints with a < b that differ in at most ``limit`` bits; none is missed.

    Two such fingerprints agree under one of the covering masks at least, each of which keeps about half of the bits, so
    the join is on (mask, kept bits); a pair is taken from the first mask it agrees under.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(limit, width)]
    fps = df.filter(F.col(bits).isNotNull()).select(F.col(bits).alias("fp")).distinct()
    cells = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for i, m in enumerate(signed)))).alias("c")).select("fp", "c.*")
    joined = cells.withColumnRenamed("fp", "a").join(cells.withColumnRenamed("fp", "b"), ["mask", "kept"]).filter("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = joined.withColumn("distance", F.bit_count(x).cast("int")).filter(F.col("distance") <= limit)
    first = F.lit(len(signed))
    for i, m in reversed(list(enumerate(signed))):
        first = F.when(x.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    return near.filter(F.col("mask") == first).select("a", "b", "distance")


#: Counts of a group that are compared one with another.
SMALL_GROUP = 64


def group_distances(df: DataFrame, group: str, bits: str, other: str, near: int = 4, width: int = 60) -> DataFrame:
    """Distances of the fingerprints ``bits`` over all pairs of rows of a group: (distance, pairs, different), where
    ``different`` counts the pairs whose ``other`` differs.  Distances over ``near`` come as one row, distance ``near`` + 1.

    No pair of rows is formed: rows are counted by group, fingerprint and ``other``.  A group of up to ``SMALL_GROUP`` such
    counts compares them where it is gathered.  In a larger one equal fingerprints are counted, near ones are met as
    distinct fingerprints under covering masks within their group, and what is left of n (n - 1) / 2 is farther.  Rows
    with a null are left out.
    """
    rows = df.dropna(subset=[group, bits, other]).select(F.col(group).alias("g"), F.col(bits).alias("fp"), F.col(other).alias("o"))
    counts = cut(rows.groupBy("g", "fp", "o").agg(F.count(F.lit(1)).alias("c")).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("g"))))
    met = _small_group_distances(counts.filter(F.col("m") <= SMALL_GROUP), near)
    cells = counts.filter(F.col("m") > SMALL_GROUP).drop("m")
    if not cells.isEmpty():
        met = met.unionByName(_large_group_distances(cells, near, width))
    return met.groupBy("distance").agg(F.sum("pairs").alias("pairs"), F.sum("different").alias("different"))


def _small_group_distances(cells: DataFrame, near: int) -> DataFrame:
    """(distance, pairs, different) of cells (g, fp, o, c): each cell within itself and with those after it in its group."""
    held = cells.groupBy("g").agg(F.collect_list(F.struct("fp", "o", "c")).alias("x"))
    one = held.select(F.posexplode("x").alias("i", "a"), "x")
    met = one.select("a", F.explode(F.slice("x", F.col("i") + 1, F.size("x"))).alias("b"), "i").withColumn("own", (F.col("a.fp") == F.col("b.fp")) & (F.col("a.o") == F.col("b.o")))
    pairs = F.when(F.col("own"), F.col("a.c") * (F.col("a.c") - 1) / 2).otherwise(F.col("a.c") * F.col("b.c")).cast("long")
    distance = F.least(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))).cast("int"), F.lit(near + 1))
    met = met.select(distance.alias("distance"), pairs.alias("pairs"), F.when(F.col("a.o") != F.col("b.o"), pairs).otherwise(0).alias("different"))
    return met.groupBy("distance").agg(F.sum("pairs").alias("pairs"), F.sum("different").alias("different")).filter("pairs > 0")


def _large_group_distances(cells: DataFrame, near: int, width: int) -> DataFrame:
    """The same by counts of equal and near fingerprints."""
    two = lambda n: F.sum(n * (n - 1) / 2).cast("long")
    fps = cut(cells.groupBy("g", "fp").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("alike")))
    equal = fps.agg(two(F.col("n")).alias("pairs"), F.sum("alike").alias("alike")).select(F.lit(0).alias("distance"), "pairs", (F.col("pairs") - F.col("alike")).alias("different"))
    signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(near, width)]
    kept = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for i, m in enumerate(signed))))
    met = fps.select("g", F.col("fp").alias("a"), F.col("n").alias("na"), kept.alias("k")).join(fps.select("g", F.col("fp").alias("b"), F.col("n").alias("nb"), kept.alias("k")), ["g", "k"]).filter("a < b")
    met = met.select("g", "a", "b", "na", "nb", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int").alias("distance")).filter(F.col("distance") <= near).distinct()
    met = cut(met)
    left = cells.select("g", F.col("fp").alias("a"), "o", F.col("c").alias("ca"))
    right = cells.select("g", F.col("fp").alias("b"), "o", F.col("c").alias("cb"))
    alike = met.join(left, ["g", "a"]).join(right, ["g", "b", "o"]).groupBy("distance").agg(F.sum(F.col("ca") * F.col("cb")).alias("alike"))
    close = met.groupBy("distance").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs")).join(alike, "distance", "left").select("distance", "pairs", (F.col("pairs") - F.coalesce("alike", F.lit(0))).alias("different"))
    seen = cut(equal.unionByName(close).filter("pairs > 0"))
    alike_all = cells.groupBy("g", "o").agg(F.sum("c").alias("c")).agg(two(F.col("c")).alias("alike"))
    whole = cells.groupBy("g").agg(F.sum("c").alias("c")).agg(two(F.col("c")).alias("all")).join(F.broadcast(alike_all))
    rest = whole.join(F.broadcast(seen.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("p"), F.coalesce(F.sum("different"), F.lit(0)).alias("d"))))
    rest = rest.select(F.lit(near + 1).alias("distance"), (F.col("all") - F.col("p")).alias("pairs"), (F.col("all") - F.col("alike") - F.col("d")).alias("different"))
    return seen.unionByName(rest.filter("pairs > 0"))


def greedy_clusters(df: DataFrame, key: str, bits: str, limit: int) -> DataFrame:
    """(fp, head, n): star clusters in first-seen order - a fingerprint that no earlier head is near becomes a head,
    others join the first head near them.  The order is that of each fingerprint's smallest ``key``.

    Heads are the first maximal independent set of the near graph: in each round a fingerprint all of whose earlier
    undecided neighbours are settled is decided, the earliest of all at least.  Rounds are checkpointed and go on until
    every one is; their number is that of the longest chain of dependent decisions, not of rows.
    """
    nodes = df.filter(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("fp")).agg(F.min(key).alias("seen"), F.count(F.lit(1)).alias("n"))
    near = hamming_pairs(df, bits, limit)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    order = nodes.select(F.col("fp").alias("a"), F.col("seen").alias("sa")).join(both, "a").join(nodes.select(F.col("fp").alias("b"), F.col("seen").alias("sb")), "b")
    earlier = cut(order.filter("sb < sa").select("a", "b", "sb"))
    state = nodes.select("fp", F.lit(None).cast("boolean").alias("head"))
    while not state.filter("head IS NULL").isEmpty():
        seen = earlier.join(state.select(F.col("fp").alias("b"), F.col("head").alias("_h")), "b").groupBy("a").agg(F.coalesce(F.max(F.col("_h")), F.lit(False)).alias("covered"), F.max(F.col("_h").isNull()).alias("waiting"))
        state = cut(state.join(seen, state["fp"] == seen["a"], "left").select("fp", F.coalesce("head", F.when(F.col("covered"), False).when(~F.coalesce("waiting", F.lit(False)), True)).alias("head")))
    joins = earlier.join(state.filter("head").select(F.col("fp").alias("b")), "b").groupBy("a").agg(F.min_by("b", "sb").alias("to"))
    out = nodes.join(state, "fp").join(joins, nodes["fp"] == joins["a"], "left")
    return out.select("fp", F.when(F.col("head"), F.col("fp")).otherwise(F.col("to")).alias("head"), "n")


def unit_tiers(df: DataFrame, units: dict[str, list[str]]) -> DataFrame:
    """Per unit of comparison, strongest first (name -> keys): groups of several rows, their rows, and whether it is the
    strongest that has any."""
    parts = []
    for place, (name, keys) in enumerate(units.items()):
        several = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        parts.append(several.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows")).select(F.lit(name).alias("unit"), F.lit(place).alias("place"), "groups", "rows"))
    table = reduce(DataFrame.unionByName, parts)
    strongest = table.filter("groups > 0").agg(F.min("place").alias("_s"))
    return table.join(F.broadcast(strongest)).select("unit", "groups", "rows", F.coalesce(F.col("place") == F.col("_s"), F.lit(False)).alias("strongest"))
