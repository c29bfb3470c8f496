"""Queries: pairs, discovery, near duplicates, lattices, decisions, splits, text and scalar forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.ordering import with_places
from tessera.functions.prefix import exact_percentiles
from tessera.functions.scratch import cut
from tessera.operators import contracts as K
from tessera.operators import discovery as V
from tessera.operators import lattice as L
from tessera.operators import pairs as P
from tessera.operators import splits as G
from tessera.operators import stats as T
from tessera.plans.adapters import MANIFEST, MEASURES, SAMPLES, manifest, samples, table
from tessera.plans.audit import r6
from tessera.plans.catalog import catalog
from tessera.sources import inventory

QUERIES, SQL, query = catalog()


def _limited_sql(group: str, source: str) -> str:
    return f"""n AS (SELECT {group}, id, row_number() OVER (PARTITION BY {group} ORDER BY ease, bust, id) AS i, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
  links AS (SELECT x.{group.replace(', ', ', x.')}, x.id AS a, y.id AS b FROM n x JOIN n y ON {' AND '.join(f'x.{g} = y.{g}' for g in group.split(', '))} AND x.i < y.i
    WHERE (x.n <= 6) OR (x.n > 6 AND ((y.i = x.i + 1 AND x.i <= 32) OR (x.i = 1 AND y.i = x.n AND x.n - 1 < 32))))"""


@query("limited_pairs", "WITH " + SAMPLES + ", " + _limited_sql("person", "samples") + " SELECT person, a, b FROM links")
def limited_pairs(spark, sf_dir):
    """D5, J4."""
    return P.limited_pairs(samples(spark, sf_dir), ["person"], MEASURES.order)


def _numbered(name: str, group: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY ease, bust, id) AS i, count(*) OVER (PARTITION BY {group}) AS n FROM u)"


def _linked(name: str, group: str, kind: str) -> str:
    return f"""SELECT x AS p, y AS q, '{kind}' AS kind FROM {name} x JOIN {name} y ON {' AND '.join(f'x.{g} = y.{g}' for g in group.split(', '))} AND x.i < y.i
    WHERE (x.n <= 6) OR (x.n > 6 AND ((y.i = x.i + 1 AND x.i <= 32) OR (x.i = 1 AND y.i = x.n AND x.n - 1 < 32)))"""


_PAIRS = MANIFEST + """, u AS MATERIALIZED (SELECT * EXCLUDE (quality_flags, ease_ratio, hash) FROM manifest WHERE usable AND bust IS NOT NULL AND length IS NOT NULL AND sleeve IS NOT NULL AND ease IS NOT NULL), """ + _numbered("na", "person, cloth") + ", " + _numbered("nb", "person") + """,
  raw AS (""" + _linked("na", "person, cloth", "A") + " UNION ALL " + _linked("nb", "person", "BC") + """),
  placed AS (SELECT CASE WHEN (p.ease, p.bust, p.id) <= (q.ease, q.bust, q.id) THEN p ELSE q END AS a, CASE WHEN (p.ease, p.bust, p.id) <= (q.ease, q.bust, q.id) THEN q ELSE p END AS b, kind FROM raw),
  marked AS (SELECT a, b, kind, list_filter([CASE WHEN abs(a.bust - b.bust) > 0.01 THEN 'bust' END, CASE WHEN abs(a.length - b.length) > 0.01 THEN 'length' END, CASE WHEN abs(a.sleeve - b.sleeve) > 0.01 THEN 'sleeve' END], lambda v: v IS NOT NULL) AS varying,
    bit_count(xor(a.fingerprint, b.fingerprint)) AS hamming, a.cloth = b.cloth AS same_cloth, abs(a.body_a - b.body_a) <= 1e-6 AND abs(a.body_b - b.body_b) <= 1e-6 AS body_constant FROM placed WHERE a.target <> b.target),
  tiered2 AS (SELECT *, CASE WHEN kind = 'A' THEN 'A' WHEN hamming <= 4 THEN 'B' ELSE 'C' END AS tier FROM marked WHERE len(varying) > 0 AND CASE WHEN kind = 'A' THEN same_cloth AND body_constant ELSE NOT same_cloth END),
  pairs AS (SELECT 'cf_' || substr(sha256(least(a.id, b.id) || '|' || greatest(a.id, b.id)), 1, 24) AS pair_id, a.id AS anchor_id, b.id AS counterfactual_id, tier, same_cloth, NOT same_cloth AND hamming = 0 AS same_family, NOT same_cloth AND hamming BETWEEN 1 AND 4 AS near_family, hamming, body_constant, varying,
    len(varying) = 1 AS single_variable, 'garment_' || array_to_string(varying, '_and_') || CASE WHEN len(varying) = 1 THEN '_only' ELSE '' END AS intervention, b.bust - a.bust AS delta_bust, b.ease - a.ease AS delta_ease, a.ease AS anchor_ease,
    a.quality_status = 'VALID' AND b.quality_status = 'VALID' AS both_valid, (a.duplicate_target OR b.duplicate_target) OR (tier IN ('B', 'C') AND (a.duplicate_cloth OR b.duplicate_cloth)) AS contaminated,
    a.leakage_person OR b.leakage_person OR a.leakage_cloth OR b.leakage_cloth OR a.leakage_target OR b.leakage_target AS leaks, a.split <> b.split AS cross_split, a.split AS anchor_split, a.shard AS anchor_shard, a.quality_status AS anchor_quality FROM tiered2),
  scored AS (SELECT *, greatest(0.0, least(1.0, 0.34 + CASE WHEN same_cloth THEN 0.34 WHEN same_family THEN 0.20 WHEN near_family THEN 0.10 ELSE 0 END + CASE WHEN body_constant THEN 0.14 ELSE 0 END + CASE WHEN single_variable THEN 0.10 ELSE 0.04 END + 0.08
    - CASE WHEN leaks THEN 0.12 ELSE 0 END - CASE WHEN contaminated THEN 0.06 ELSE 0 END - CASE WHEN NOT both_valid THEN 0.04 ELSE 0 END - CASE WHEN cross_split THEN 0.04 ELSE 0 END - CASE WHEN NOT same_cloth AND tier = 'C' THEN 0.08 ELSE 0 END)) AS control_score,
    array_to_string(list_filter([CASE WHEN NOT same_cloth THEN 'cloth_image_differs' END, CASE WHEN NOT body_constant THEN 'body_measurement_not_constant' END, CASE WHEN NOT single_variable THEN 'multi_variable_garment_change' END, CASE WHEN cross_split THEN 'cross_split_pair' END,
      CASE WHEN leaks THEN 'exact_image_train_eval_overlap' END, CASE WHEN contaminated THEN 'duplicate_image_flag' END, CASE WHEN tier IN ('B', 'C') THEN 'person_reuse_expected' END, CASE WHEN NOT both_valid THEN 'non_valid_quality' END, CASE WHEN tier = 'C' THEN 'garment_appearance_confound' END,
      CASE WHEN near_family THEN 'garment_family_is_near_duplicate_not_exact' END], lambda v: v IS NOT NULL), ',') AS confounds FROM pairs)"""


_FLAGS = [*P.PAIR_LEAKS, "duplicate_target", "duplicate_cloth"]
#: Shares of the persons whose pairs are made, and ranges of the pairs that are sorted, one after the other.
_SHARES, _RANGES = 2, 4


def _pairs(spark, sf_dir):
    return P.build_pairs(manifest(spark, sf_dir, _FLAGS), MEASURES)


_REASON = "'tier ' || tier || '; same person; ' || CASE WHEN same_cloth THEN 'same cloth' ELSE 'different cloth' END || '; changes ' || intervention"


@query("tiered_pairs", "WITH " + _PAIRS + f", x AS (SELECT pair_id, anchor_id, counterfactual_id, tier, hamming, intervention, delta_bust, delta_ease, confounds, round(CAST(control_score AS DOUBLE), 6) AS control_score, {_REASON} AS reason FROM scored) SELECT row_number() OVER (ORDER BY tier, pair_id, delta_bust, delta_ease, hamming, confounds, control_score, reason, anchor_id) AS place, * FROM x")
def tiered_pairs(spark, sf_dir):
    """Pairs in their order, by tier and id; pairs of samples that repeat an id by what they differ in."""
    flagged = manifest(spark, sf_dir, _FLAGS)
    # Pairs are of one person, so persons are taken in shares, which leaves the shuffle of one share on disk at a time.
    shares = (P.build_pairs(flagged.filter(F.pmod(F.xxhash64("person"), F.lit(_SHARES)) == i), MEASURES) for i in range(_SHARES))
    wanted = lambda pairs: pairs.select("anchor_id", "counterfactual_id", "tier", F.col("hamming").cast("long").alias("hamming"), "intervention", "delta_bust", "delta_ease", F.array_join("confound_flags", ",").alias("confounds"), *r6("control_score"), "reason")
    p = reduce(DataFrame.unionByName, [cut(wanted(pairs)) for pairs in shares])
    order = ["tier", "pair_id", "delta_bust", "delta_ease", "hamming", "confounds", "control_score", "reason", "anchor_id"]
    return with_places(p, order, parts=_RANGES, derived={"pair_id": S.pair_id("anchor_id", "counterfactual_id")}).select("pair_id", *p.columns, "place")


@query("pair_summary", "WITH " + _PAIRS + " SELECT tier, count(*) AS n, CAST(count(*) FILTER (cross_split) AS BIGINT) AS cross_split, round(avg(control_score), 6) AS mean_score, count(DISTINCT intervention) AS interventions FROM scored GROUP BY tier")
def pair_summary(spark, sf_dir):
    """E23."""
    return P.pair_summary(_pairs(spark, sf_dir)).select("tier", "n", "cross_split", *r6("mean_score"), "interventions")


#: Pairs as built, and with faults by the last digit of their ids: a wrong delta, a wrong id, a pair of one sample, of one target, a repeated row.
_FAULTS = ", plain AS (SELECT right(pair_id, 1) AS d, * FROM scored), t AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS kind, {'pair_id' if not bad else "CASE WHEN d = 'b' THEN 'x' || pair_id ELSE pair_id END"} AS pair_id, anchor_id, {'counterfactual_id' if not bad else "CASE WHEN d = 'c' THEN anchor_id ELSE counterfactual_id END"} AS counterfactual_id, {'0' if not bad else "CAST(d = 'a' AS INTEGER)"} AS off, {'0' if not bad else "CAST(d = 'd' AS INTEGER)"} AS alike FROM plain{' WHERE ' + where if where else ''}"
    for name, bad, where in (("built", False, ""), ("faulty", True, ""), ("faulty", True, "d = 'e'"))
) + ")"


@query("pair_validation", "WITH " + _PAIRS + _FAULTS + """, c AS (SELECT kind, count(*) AS n, count(DISTINCT pair_id) AS ids, CAST(count(*) FILTER (anchor_id = counterfactual_id) AS BIGINT) AS self_pairs, count(*) - count(DISTINCT least(anchor_id, counterfactual_id) || ' ' || greatest(anchor_id, counterfactual_id)) AS repeated_pairs,
  CAST(count(*) FILTER (pair_id <> 'cf_' || substr(sha256(least(anchor_id, counterfactual_id) || '|' || greatest(anchor_id, counterfactual_id)), 1, 24)) AS BIGINT) AS wrong_ids, CAST(sum(off) AS BIGINT) AS wrong_deltas, CAST(sum(alike) AS BIGINT) AS same_target, CAST(0 AS BIGINT) AS bad_scores FROM t GROUP BY kind)
  SELECT *, self_pairs + repeated_pairs + wrong_ids + wrong_deltas + same_target = 0 AS sound FROM c""")
def pair_validation(spark, sf_dir):
    """Pairs as built, and the same with faults of every kind."""
    # An id is made of its pair's ends again where it is read, which takes less room than 24 digits.
    needed = [c for c in P.required_columns(MEASURES) if c != "pair_id"]
    built = cut(_pairs(spark, sf_dir).select(needed)).withColumn("pair_id", S.pair_id("anchor_id", "counterfactual_id"))
    digit = F.substring("pair_id", -1, 1)
    faulty = built.withColumn("d", digit).withColumns({
        "delta_bust": F.when(F.col("d") == "a", F.col("delta_bust") + 0.5).otherwise(F.col("delta_bust")), "pair_id": F.when(F.col("d") == "b", F.concat(F.lit("x"), "pair_id")).otherwise(F.col("pair_id")),
        "counterfactual_id": F.when(F.col("d") == "c", F.col("anchor_id")).otherwise(F.col("counterfactual_id")), "counterfactual_target": F.when(F.col("d") == "d", F.col("anchor_target")).otherwise(F.col("counterfactual_target")),
    })
    faulty = faulty.unionByName(faulty.filter("d = 'e'"))
    return P.validate_pairs(built, MEASURES).withColumn("kind", F.lit("built")).unionByName(P.validate_pairs(faulty, MEASURES).withColumn("kind", F.lit("faulty")))


def _purity_sql(label: str) -> str:
    return f"(SELECT avg(p) FROM (SELECT max(n) / sum(n) AS p FROM (SELECT round_even(anchor_ease * 10, 0) / 10 AS k, {label}, count(*) AS n FROM scored GROUP BY ALL) GROUP BY k))"


@query("shortcut_audit", "WITH " + _PAIRS + f""", x AS (SELECT count(*) AS n, count(DISTINCT round_even(delta_ease * 10, 0) / 10) AS delta_levels_1dp, avg(CAST(abs(delta_ease / 0.05 - round_even(delta_ease / 0.05, 0)) <= 1e-8 AS DOUBLE)) AS on_005, avg(CAST(same_cloth AS DOUBLE)) AS same_cloth_share, CAST(count(*) FILTER (tier = 'A') AS BIGINT) AS tier_a,
    avg(CAST(leaks AS DOUBLE)) AS leak_share, avg(CAST(cross_split AS DOUBLE)) AS cross_share, {_purity_sql('anchor_split')} AS split_purity, {_purity_sql('anchor_shard')} AS shard_purity, {_purity_sql('anchor_quality')} AS quality_purity, count(DISTINCT anchor_split) AS splits FROM scored),
  y AS (SELECT *, CASE WHEN delta_levels_1dp <= 6 OR on_005 >= 0.8 THEN 'FAIL' WHEN (same_cloth_share < 0.01 AND tier_a = 0) OR (split_purity >= 0.95 AND splits > 1) OR shard_purity >= 0.95 THEN 'PASS_WITH_CONTROLS' ELSE 'PASS' END AS raw_verdict FROM x)
  SELECT n, delta_levels_1dp, round(on_005, 6) AS on_005, round(same_cloth_share, 6) AS same_cloth_share, tier_a, round(leak_share, 6) AS leak_share, round(cross_share, 6) AS cross_share, round(split_purity, 6) AS split_purity, round(shard_purity, 6) AS shard_purity, round(quality_purity, 6) AS quality_purity, raw_verdict,
  CASE WHEN same_cloth_share < 0.01 AND tier_a = 0 THEN 'PARTIAL_CONFOUND' ELSE raw_verdict END AS verdict FROM y""")
def shortcut_audit(spark, sf_dir):
    """E25, E26, G4, with the verdict before and after the override."""
    needed = ["delta_ease", "anchor_ease", "tier", "same_person", "same_cloth", "leaks", "cross_split", "anchor_split", "anchor_shard", "anchor_quality"]
    a = P.shortcut_audit(cut(_pairs(spark, sf_dir).select(needed)), "delta_ease")
    return a.select("n", "delta_levels_1dp", *r6("on_005", "same_cloth_share"), "tier_a", *r6("leak_share", "cross_share", "split_purity", "shard_purity", "quality_purity"), "raw_verdict", "verdict")


def _varying(name: str, keys: list[str], columns: list[str], doc: str) -> None:
    d = ", ".join(f"count(DISTINCT {c}) AS d_{c}" for c in columns)
    vary = ", ".join(f"CAST(count(*) FILTER (d_{c} > 1) AS BIGINT) AS vary_{c}" for c in columns)
    one, most = " + ".join(f"CAST(d_{c} > 1 AS INTEGER)" for c in columns), "greatest(" + ", ".join(f"d_{c}" for c in columns) + ")"
    sql = f"WITH {SAMPLES}, g AS (SELECT count(*) AS size, {d} FROM samples GROUP BY {', '.join(keys)} HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(size), 0) AS BIGINT) AS rows, {vary}, CAST(count(*) FILTER ({one} = 1) AS BIGINT) AS single_variable, CAST(count(*) FILTER ({most} BETWEEN 2 AND 8) AS BIGINT) AS preset_like, max(size) AS largest FROM g"

    def f(spark, sf_dir):
        return V.varying_groups(samples(spark, sf_dir), keys, columns)

    f.__doc__ = doc
    query(name, sql)(f)


_varying("discovery_same_person_cloth", ["person", "cloth"], ["target", "bust", "length", "sleeve", "body_a"], "E15.")
_varying("discovery_same_person", ["person"], ["cloth", "ease", "body_a"], "E16.")
_varying("discovery_same_cloth", ["cloth"], ["person", "bust", "body_a"], "E18.")
_varying("discovery_same_target", ["target"], ["person", "cloth", "split"], "E19.")


_BODY, _GARMENT = ["body_a", "body_b"], ["bust", "length", "sleeve"]


def _structure_sql(keys: str, columns: list[str], marks: dict[str, str], rows: list[str], more: str = "") -> str:
    d = ", ".join(f"count(DISTINCT {c}) AS d_{c}" for c in columns)
    picked = ", ".join([f"CAST(count(*) FILTER ({m}) AS BIGINT) AS {name}" for name, m in marks.items()] + [f"CAST(coalesce(sum(size) FILTER ({marks[r]}), 0) AS BIGINT) AS {r}_rows" for r in rows])
    return f"WITH {SAMPLES}, g AS (SELECT count(*) AS size, {d} FROM samples GROUP BY {keys} HAVING count(*) > 1) SELECT count(*) AS groups, {picked}{more} FROM g"


_SQL_BODY, _SQL_GARMENT = "(d_body_a > 1 OR d_body_b > 1)", "(d_bust > 1 OR d_length > 1 OR d_sleeve > 1)"
_SQL_SINGLE = "CAST(d_bust > 1 AS INTEGER) + CAST(d_length > 1 AS INTEGER) + CAST(d_sleeve > 1 AS INTEGER) = 1"


@query("person_cloth_structure", _structure_sql("person, cloth", [*_BODY, *_GARMENT, "target"], {
    "different_target": "d_target > 1", "different_garment": _SQL_GARMENT, "different_body": _SQL_BODY, "body_constant": f"NOT {_SQL_BODY}", "tier_a": f"d_target > 1 AND {_SQL_GARMENT} AND NOT {_SQL_BODY}",
    "single_variable": _SQL_SINGLE, "preset_like": f"{_SQL_SINGLE} AND greatest(d_bust, d_length, d_sleeve) BETWEEN 2 AND 8",
}, ["tier_a"]))
def person_cloth_structure(spark, sf_dir):
    """E15 with tier-A groups."""
    return V.person_cloth_structure(samples(spark, sf_dir), ["person", "cloth"], _BODY, _GARMENT, "target")


@query("person_structure", _structure_sql("person", [*_BODY, *_GARMENT, "ease", "ease_ratio", "cloth", "target"], {
    "inconsistent_body": _SQL_BODY, "body_constant": f"NOT {_SQL_BODY}", "different_cloth": "d_cloth > 1", "different_target": "d_target > 1", "garment_varies": _SQL_GARMENT, "ease_varies": "d_ease > 1 OR d_ease_ratio > 1",
    "tier_c": f"NOT {_SQL_BODY} AND d_cloth > 1 AND d_target > 1 AND {_SQL_GARMENT}",
}, ["inconsistent_body", "tier_c"], ", max(d_cloth) AS most_cloths"))
def person_structure(spark, sf_dir):
    """E16 with consistency issues and tier-C groups."""
    return V.person_structure(samples(spark, sf_dir), "person", _BODY, _GARMENT, ["ease", "ease_ratio"], "cloth", "target")


@query("cloth_structure", _structure_sql("cloth", [*_BODY, *_GARMENT, "person", "target"], {
    "inconsistent_garment": _SQL_GARMENT, "different_person": "d_person > 1", "different_target": "d_target > 1", "body_varies": _SQL_BODY, "garment_constant": f"NOT {_SQL_GARMENT}", "measured_apart": f"{_SQL_GARMENT} AND d_person > 1",
    "body_varied_alone": f"NOT {_SQL_GARMENT} AND d_person > 1 AND d_target > 1 AND {_SQL_BODY}",
}, ["inconsistent_garment"]))
def cloth_structure(spark, sf_dir):
    """E18 with varied bodies under constant measures."""
    return V.cloth_structure(samples(spark, sf_dir), "cloth", _BODY, _GARMENT, "person", "target")


@query("variation_types", "WITH " + SAMPLES + ", g AS (SELECT count(DISTINCT bust) AS b, count(DISTINCT length) AS l, count(DISTINCT sleeve) AS s FROM samples GROUP BY target HAVING count(*) > 1) SELECT concat_ws('+', CASE WHEN b > 1 THEN 'bust' END, CASE WHEN l > 1 THEN 'length' END, CASE WHEN s > 1 THEN 'sleeve' END) AS varying, count(*) AS groups FROM g WHERE b > 1 OR l > 1 OR s > 1 GROUP BY 1")
def variation_types(spark, sf_dir):
    """Garment measures that change together, here over the rows of a target."""
    return V.variation_types(samples(spark, sf_dir), ["target"], _GARMENT)


@query("person_family", "WITH " + SAMPLES + ", r AS (SELECT person, fingerprint, target, row_number() OVER () AS r FROM samples), p AS (SELECT least(CAST(bit_count(xor(x.fingerprint, y.fingerprint)) AS INTEGER), 5) AS distance, x.target <> y.target AS diff FROM r x JOIN r y ON x.person = y.person AND x.r < y.r) SELECT distance, count(*) AS pairs, CAST(count(*) FILTER (diff) AS BIGINT) AS different FROM p GROUP BY distance")
def person_family(spark, sf_dir):
    """E17 over all pairs of each person: distances of fingerprints up to 4 bits and beyond, and whether targets differ."""
    return V.group_distances(samples(spark, sf_dir), "person", "fingerprint", "target")


@query("repeated_vectors", "WITH " + SAMPLES + ", v AS (SELECT count(*) AS n FROM samples GROUP BY bust, length, sleeve) SELECT count(*) AS vectors, CAST(count(*) FILTER (n > 1) AS BIGINT) AS repeated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_repeated, max(n) AS most, round(avg(n), 6) AS mean FROM v")
def repeated_vectors(spark, sf_dir):
    """E21."""
    return V.repeated_vectors(samples(spark, sf_dir), ["bust", "length", "sleeve"]).select("vectors", "repeated", "rows_repeated", "most", *r6("mean"))


@query("radius_summary", "WITH v AS (SELECT DISTINCT p_size AS x, floor(p_retailprice / 10) AS y FROM part), p AS (SELECT v.x AS ax, v.y AS ay, w.x AS bx, w.y AS b_y FROM v JOIN v w ON (v.x, v.y) < (w.x, w.y) AND abs(v.x - w.x) <= 2 AND (v.x - w.x) ^ 2 + (v.y - w.y) ^ 2 <= 4) SELECT (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FROM (SELECT ax, ay FROM p UNION SELECT bx, b_y FROM p)) AS touched")
def radius_summary(spark, sf_dir):
    """Distinct vectors within a radius."""
    v = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.floor(F.col("p_retailprice") / 10).cast("double").alias("y"))
    return V.radius_summary(v, ["x", "y"], 2.0)


#: A fingerprint of 24 signs, each of the sum of every 24th number: all 64 numbers of a vector count.
_SIGNS = "WITH e AS (SELECT vec_id, (" + " + ".join(f"CASE WHEN {' + '.join(f'CAST(embedding[{i + 1}] AS DOUBLE)' for i in range(b, 64, 24))} > 0 THEN {1 << b} ELSE 0 END" for b in range(24)) + ")::BIGINT AS fp FROM embeddings)"


def _signs(spark, sf_dir):
    sums = [reduce(lambda x, y: x + y, (F.col("embedding")[i].cast("double") for i in range(b, 64, 24))) for b in range(24)]
    bits = reduce(lambda x, y: x + y, (F.when(s > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint") for b, s in enumerate(sums)))
    return table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("fp"))


@query("hamming_near", _SIGNS + ", d AS (SELECT DISTINCT fp FROM e) SELECT x.fp AS a, y.fp AS b, CAST(bit_count(xor(x.fp, y.fp)) AS INTEGER) AS distance FROM d x JOIN d y ON x.fp < y.fp WHERE bit_count(xor(x.fp, y.fp)) <= 3")
def hamming_near(spark, sf_dir):
    """Fingerprints of embeddings within three bits, by covering masks."""
    return V.hamming_pairs(_signs(spark, sf_dir), "fp", 3, 24)


@query("near_clusters")
def near_clusters(spark, sf_dir):
    """Star clusters in first-seen order."""
    return V.greedy_clusters(_signs(spark, sf_dir), "vec_id", "fp", 2)


@query("parsed_pairs", "SELECT event_id, 'EVENT=' || event_id || '.000000 VALUE=' || printf('%.6f', value) AS text, CAST(event_id AS VARCHAR) || '.000000' AS event FROM events")
def parsed_pairs(spark, sf_dir):
    """key=value text and back."""
    e = table(spark, sf_dir, "events")
    text = S.serialize({"EVENT": "event_id", "VALUE": "value"})
    return e.select("event_id", text.alias("text")).withColumn("event", S.parse_pairs("text")["EVENT"])


@query("json_props", "SELECT event_type, count(*) AS n, round(avg(CAST(json_valid(props) AS DOUBLE)), 6) AS parse_rate, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    """A JSON object out of free text, its parse rate and a field."""
    e = table(spark, sf_dir, "events").select("event_type", S.json_object(F.concat(F.lit("answer: "), "props", F.lit(" done"))).alias("j"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("j").isNotNull().cast("double")), 6).alias("parse_rate"), F.round(F.avg(F.get_json_object("j", "$.k").cast("double")), 6).alias("mean_k"))


@query("stable_ids", "SELECT c_custkey, 'cust_' || substr(sha256('{\"key\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"}'), 1, 16) AS id FROM customer")
def stable_ids(spark, sf_dir):
    """B17."""
    return table(spark, sf_dir, "customer").select("c_custkey", S.stable_id("cust", {"segment": "c_mktsegment", "key": "c_custkey"}).alias("id"))


@query("sample_ids", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%s/%s/%04d', l_returnflag, l_linestatus, l_linenumber) AS id, CASE WHEN l_quantity < -2 THEN 'tight' WHEN l_quantity < 2 THEN 'close' WHEN l_quantity < 15 THEN 'regular' ELSE 'loose' END AS bin FROM lineitem")
def sample_ids(spark, sf_dir):
    """B1, B3, B18."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.sample_id("l_returnflag", "l_linestatus", "l_linenumber").alias("id"), S.ease_bin("l_quantity").alias("bin"))


_TRANS = """t AS (SELECT l_orderkey AS state, l_partkey AS cloth, l_linenumber AS action, l_suppkey AS repeat_id, l_returnflag AS family, l_quantity AS before, round_even(l_discount * 100, 0) AS intended, round_even(l_discount * 100, 0) + round_even(l_tax * 100, 0) / 100 AS realized, round_even(l_tax * 100, 0) AS side, l_suppkey % 7 AS spec FROM lineitem)"""


def _transitions(spark, sf_dir):
    """Order lines as transitions: intended change from the discount, realised with an error from the tax."""
    d, t = F.rint(F.col("l_discount") * 100), F.rint(F.col("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("state"), F.col("l_partkey").alias("cloth"), F.col("l_linenumber").alias("action"), F.col("l_suppkey").alias("repeat_id"), F.col("l_returnflag").alias("family"), F.col("l_quantity").alias("before"), d.alias("intended"), (d + t / 100).alias("realized"), t.alias("side"), (F.col("l_suppkey") % 7).alias("spec"))


@query("transition_errors", "WITH " + _TRANS + " SELECT errors, count(*) AS n FROM (SELECT CASE WHEN intended = realized THEN 'copied_from_intended' ELSE '' END AS errors FROM t) GROUP BY errors")
def transition_errors(spark, sf_dir):
    """B19, B20, C16."""
    t = _transitions(spark, sf_dir)
    source = F.when(F.col("intended") == F.col("realized"), "intended").otherwise("measured")
    after = F.col("before") + F.col("realized")
    e = L.row_errors(F.col("before"), after, F.col("realized"), source)
    return t.select(F.array_join(e, ",").alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


@query("lattice_summary", "WITH " + _TRANS + ", g AS (SELECT count(*) AS n, count(*) FILTER (intended = realized) AS bad FROM t GROUP BY state, family, intended) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(sum(bad) AS BIGINT) AS failed FROM g")
def lattice_summary(spark, sf_dir):
    """E32."""
    t = _transitions(spark, sf_dir)
    e = L.row_errors(F.col("before"), F.col("before") + F.col("realized"), F.col("realized"), F.when(F.col("intended") == F.col("realized"), "intended").otherwise("measured"))
    return L.lattice_summary(t.withColumn("errors", e), ["state", "family", "intended"], "errors")


@query("calibration_gates", "WITH " + _TRANS + """, lv AS (SELECT family, intended AS level, avg(realized) AS mean, count(*) AS n, max(realized) - min(realized) AS spread FROM t GROUP BY ALL), st AS (SELECT *, mean > lag(mean) OVER (PARTITION BY family ORDER BY level) AS rises FROM lv),
  sh AS (SELECT family, count(*) AS levels, coalesce(bool_and(rises), false) AS monotone, max(spread) FILTER (n >= 3) AS spread FROM st GROUP BY family),
  b AS (SELECT family, count(*) AS n, max(abs(realized - intended)) AS max_error, avg(abs(realized - intended)) AS mean_error, bool_or(greatest(abs(side), 0) > 0.35 * CASE WHEN intended = 0 THEN 1 ELSE abs(intended) END) AS leaks, count(DISTINCT spec) AS specs FROM t GROUP BY family),
  g AS (SELECT *, CASE WHEN max_error < 0.15 THEN 'PASS' WHEN max_error < 0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS g2, monotone AND levels >= 3 AS rising FROM b JOIN sh USING (family))
  SELECT family, n, round(max_error, 6) AS max_error, round(mean_error, 6) AS mean_error, levels, 'PASS' AS g1, g2, CASE WHEN rising THEN 'PASS' ELSE 'FAIL' END AS g3, CASE WHEN leaks THEN 'FAIL' ELSE 'PARTIAL' END AS g4, CASE WHEN specs >= greatest(3, levels - 1) THEN 'PASS' ELSE 'FAIL' END AS g5,
  CASE WHEN spread IS NULL THEN 'NOT_RUN' WHEN spread < 1e-6 THEN 'PASS' WHEN spread < 0.05 THEN 'PARTIAL' ELSE 'FAIL' END AS g6, CASE WHEN g2 = 'PASS' AND rising THEN 'GO' WHEN g2 = 'PARTIAL' AND rising THEN 'PARTIAL' ELSE 'NO-GO' END AS decision FROM g""")
def calibration_gates(spark, sf_dir):
    """E33."""
    g = L.calibration_gates(_transitions(spark, sf_dir), "family", "intended", "realized", ["side"], "spec")
    return g.select("family", "n", *r6("max_error", "mean_error"), "levels", "g1", "g2", "g3", "g4", "g5", "g6", "decision")


@query("action_lattice", "SELECT p_partkey, CAST(d AS DOUBLE) AS delta, p_size + CAST(d AS DOUBLE) AS intended FROM part, (SELECT unnest([-3, -1, 0, 1, 3]) AS d) WHERE p_size + d BETWEEN 1 AND 50")
def action_lattice(spark, sf_dir):
    """D10."""
    return L.enumerate_actions(table(spark, sf_dir, "part").select("p_partkey", "p_size"), [-3, -1, 0, 1, 3], "p_size", 1, 50).select("p_partkey", "delta", F.col("intended").cast("double").alias("intended"))


@query("candidate_ranking", "WITH " + _TRANS + ", u AS (SELECT state, action, cloth, repeat_id, -25.0 * (side / 100) - 20.0 * greatest(0, 0.5 - coalesce(nullif(realized / 10, 0), before / 100)) - 0.15 * abs(intended) - 0.25 * abs(side) AS utility FROM t) SELECT state, action, cloth, repeat_id, round(utility, 6) + 0.0 AS utility, CAST(row_number() OVER (PARTITION BY state ORDER BY round(utility, 9) DESC, action, cloth, repeat_id) AS INTEGER) AS rank, row_number() OVER (PARTITION BY state ORDER BY round(utility, 9) DESC, action, cloth, repeat_id) = 1 AS recommended FROM u")
def candidate_ranking(spark, sf_dir):
    """C12, F1."""
    t = _transitions(spark, sf_dir)
    u = F.round(L.physical_utility(F.col("side") / 100, F.col("realized") / 10, F.col("before") / 100, F.col("intended"), F.col("side")), 9)
    tie = F.struct("action", "cloth", "repeat_id")
    r = L.rank_candidates(t.withColumn("utility", u).withColumn("tie", tie), ["state"], "utility", "tie")
    return r.select("state", "action", "cloth", "repeat_id", (F.round("utility", 6) + 0.0).alias("utility"), "rank", "recommended")


@query("oracle_cases", "WITH " + _TRANS + """, c AS (SELECT state, CAST(tg AS DOUBLE) AS target, action * 1000000 + cloth AS act, -(abs(realized - tg) + 0.5 * abs(side)) AS u FROM t, (SELECT unnest([2, 5, 8]) AS tg))
  SELECT state, target, arg_min(act, (-u, act)) AS oracle, round(max(u), 6) + 0.0 AS utility, count(*) AS n FROM c GROUP BY state, target""")
def oracle_cases(spark, sf_dir):
    """F5, D10."""
    t = _transitions(spark, sf_dir).withColumn("act", F.col("action") * 1000000 + F.col("cloth"))
    return L.oracle_cases(t, ["state"], [2, 5, 8], "realized", "act", "side").select("state", "target", "oracle", (F.round("utility", 6) + 0.0).alias("utility"), F.size("ranking").cast("long").alias("n"))


@query("nearest_candidate", "WITH " + _TRANS + " SELECT state, arg_min(cloth, (abs(realized - 5), cloth)) AS action, round(min(abs(realized - 5)), 6) AS gap FROM t GROUP BY state")
def nearest_candidate(spark, sf_dir):
    """F6."""
    return L.nearest(_transitions(spark, sf_dir), ["state"], "cloth", "realized", F.lit(5.0)).select("state", "action", *r6("gap"))


@query("abstention", "WITH " + _TRANS + """, s AS (SELECT family = 'N' AS known, side <= 6 AS stable, least(1.0, CASE WHEN family = 'N' THEN 0 ELSE 0.45 END + CASE WHEN intended BETWEEN -3 AND 3 THEN 0 ELSE 0.4 END + CASE WHEN side > 6 THEN 0.5 ELSE 0 END) AS score, intended BETWEEN -3 AND 3 AS inside FROM t)
  SELECT array_to_string(list_filter([CASE WHEN NOT known THEN 'OOD_BODY' END, CASE WHEN NOT inside THEN 'OOD_ACTION_MAGNITUDE' END, CASE WHEN NOT stable THEN 'SIMULATION_UNSTABLE' END, CASE WHEN score >= 0.55 THEN 'OOD_DETECTOR' END], lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS n, round(avg(score), 6) AS mean_score FROM s GROUP BY 1""")
def abstention(spark, sf_dir):
    """C14, C15."""
    t = _transitions(spark, sf_dir)
    known, stable, inside = F.col("family") == "N", F.col("side") <= 6, F.col("intended").between(-3, 3)
    score = L.ood_score(known, F.lit(True), F.col("intended"), ~stable)
    reasons = L.abstention(known, F.lit(True), inside, stable, F.lit(None).cast("double"), score)
    return t.select(F.array_join(reasons, ",").alias("reasons"), score.alias("score")).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("decision_regret", "WITH " + _TRANS + ", u AS (SELECT state, cloth, max(-abs(realized - 5)) AS u FROM t GROUP BY state, cloth), b AS (SELECT state, max(u) AS best FROM u GROUP BY state), c AS (SELECT state, min(cloth) AS cloth FROM t GROUP BY state) SELECT count(*) AS n, round(avg(best - coalesce(u, -10)), 6) AS mean_regret FROM c JOIN b USING (state) LEFT JOIN u USING (state, cloth)")
def decision_regret(spark, sf_dir):
    """The first cloth is always chosen."""
    t = _transitions(spark, sf_dir)
    u = t.groupBy("state", "cloth").agg(F.max(-F.abs(F.col("realized") - 5)).alias("u"))
    r = L.regret(t.groupBy("state").agg(F.min("cloth").alias("pick")), u, ["state"], "cloth", "u", "pick")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("regret"), 6).alias("mean_regret"))


@query("flip_rate", "WITH " + _TRANS + ", b AS (SELECT state, family, arg_max(cloth, (-abs(realized - 5), cloth)) AS best FROM t GROUP BY state, family), p AS (SELECT x.best <> y.best AS flip FROM b x JOIN b y USING (state) WHERE x.family = 'N' AND y.family = 'R') SELECT count(*) AS pairs, CAST(count(*) FILTER (flip) AS BIGINT) AS flips, round(avg(CAST(flip AS DOUBLE)), 6) AS flip_rate FROM p")
def flip_rate(spark, sf_dir):
    """D11, E31."""
    t = _transitions(spark, sf_dir).withColumn("u", -F.abs(F.col("realized") - 5))
    return L.flip_rate(t, "state", "family", "cloth", "u", "N", "R").select("pairs", "flips", *r6("flip_rate"))


_OOD = {"iid": "family = 'N' AND intended <= 3 AND state % 5 <> 0", "unseen_body": "state % 5 = 0", "other_family": "family <> 'N'", "large_action": "intended > 3"}


@query("ood_table", "WITH " + _TRANS + ", x AS (" + " UNION ALL ".join(f"SELECT '{part}' AS part, abs(realized - intended) AS e, side > 4 AS se FROM t WHERE {where}" for part, where in _OOD.items()) + ") SELECT part, count(*) AS n, round(avg(e), 6) AS mae, round(avg(CAST(se AS DOUBLE)), 6) AS side_effect_rate FROM x GROUP BY part")
def ood_table(spark, sf_dir):
    """Errors and side effects on the training range and outside it; a row may lie outside in several ways."""
    rules = {part: F.expr(where) for part, where in _OOD.items()}
    return L.ood_table(_transitions(spark, sf_dir), rules, F.abs(F.col("realized") - F.col("intended")), F.col("side") > 4).select("part", "n", *r6("mae", "side_effect_rate"))


@query("material_disagreement", "WITH " + _TRANS + ", b AS (SELECT state, intended, family, avg(realized) AS m FROM t GROUP BY ALL), p AS (SELECT x.m - y.m AS d FROM b x JOIN b y USING (state, intended) WHERE x.family = 'N' AND y.family = 'R') SELECT count(*) AS pairs, round(avg(abs(d)), 6) AS mean_gap, round(max(abs(d)), 6) AS largest_gap, round(avg(CAST(abs(d) > 1 AS DOUBLE)), 6) AS disagree FROM p")
def material_disagreement(spark, sf_dir):
    """One action on one state under two materials, how far apart the results are."""
    return L.disagreement(_transitions(spark, sf_dir), ["state", "intended"], "family", "N", "R", "realized", 1.0).select("pairs", *r6("mean_gap", "largest_gap", "disagree"))


@query("rater_agreement", "WITH v AS (SELECT user_id AS item, event_type AS cat, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT item, sum(n) AS r, sum(n * (n - 1)) AS agree FROM v GROUP BY item HAVING sum(n) > 1), o AS (SELECT count(*) AS items, avg(agree / (r * (r - 1))) AS agreement FROM p), s AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS chance FROM (SELECT cat, CAST(sum(n) AS DOUBLE) AS n FROM v WHERE item IN (SELECT item FROM p) GROUP BY cat)) SELECT items, round(agreement, 6) AS agreement, round(chance, 6) AS chance, round((agreement - chance) / (1 - chance), 6) AS kappa FROM o, s")
def rater_agreement(spark, sf_dir):
    """E46."""
    return L.rater_agreement(table(spark, sf_dir, "events"), "user_id", "event_type").select("items", *r6("agreement", "chance", "kappa"))


@query("ladder_acceptance", """WITH r AS (SELECT o_orderkey AS ladder, l_returnflag AS level, avg(l_quantity) AS value, min(l_suppkey) AS target, any_value(o_custkey) AS inv FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_returnflag),
  g AS (SELECT ladder, count(DISTINCT level) = 3 AS complete, count(DISTINCT inv) <= 1 AS invariant, coalesce(max(value) FILTER (level = 'A') < max(value) FILTER (level = 'N'), false) AND coalesce(max(value) FILTER (level = 'N') < max(value) FILTER (level = 'R'), false) AS monotone, count(DISTINCT target) = count(*) AS unique_targets FROM r GROUP BY ladder)
  SELECT complete, invariant, monotone, unique_targets, complete AND invariant AND monotone AND unique_targets AS accepted, count(*) AS n FROM g GROUP BY ALL""")
def ladder_acceptance(spark, sf_dir):
    """E44."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = j.groupBy(F.col("o_orderkey").alias("ladder"), F.col("l_returnflag").alias("level")).agg(F.avg("l_quantity").alias("value"), F.min("l_suppkey").alias("target"), F.min("o_custkey").alias("inv"))
    a = L.ladder_acceptance(r, "ladder", "level", ["inv"], "target", ["A", "N", "R"])
    flags = ["complete", "invariant", "monotone", "unique_targets", "accepted"]
    return a.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


@query("group_split", "WITH g AS (SELECT DISTINCT l_orderkey AS person FROM lineitem), r AS (SELECT person, row_number() OVER (ORDER BY md5('7|' || person)) AS i, count(*) OVER () AS n FROM g) SELECT person, CASE WHEN i <= greatest(1, round_even(0.7 * n, 0)) THEN 'train' WHEN i <= greatest(1, round_even(0.7 * n, 0)) + greatest(1, round_even(0.15 * n, 0)) THEN 'val' ELSE 'test' END AS part FROM r")
def group_split(spark, sf_dir):
    """H1, H2."""
    return G.group_split(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("person")), "person", seed=7)


@query("median_baseline", "WITH " + SAMPLES + ", m AS (SELECT quantile_cont(ease, 0.5) AS m FROM samples WHERE split = 'train') SELECT split, count(*) AS n, round(avg(abs(ease - m)), 6) AS mae, round(sqrt(avg((ease - m) ^ 2)), 6) AS rmse FROM samples, m GROUP BY split")
def median_baseline(spark, sf_dir):
    """H3."""
    s = samples(spark, sf_dir)
    counts = s.filter(F.col("split") == "train").groupBy("ease").agg(F.count(F.lit(1)).alias("n"))
    m = exact_percentiles(counts, [], "ease", "n", (0.5,), ["m"])
    return T.errors(s.join(F.broadcast(m)), F.col("ease"), F.col("m"), ["split"]).select("split", "n", *r6("mae", "rmse"))


_ROW_HASH = "CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 15) AS BIGINT)"


@query("fingerprint_of_table", f"SELECT count(*) AS n, bit_xor({_ROW_HASH}) AS xor_hash, CAST(sum({_ROW_HASH}) AS VARCHAR) AS sum_hash, CASE WHEN count(*) >= 1000 THEN 'FROZEN' ELSE 'PARTIAL' END AS gate FROM orders")
def fingerprint_of_table(spark, sf_dir):
    """Two hashes that do not depend on the order of rows, and the gate."""
    return inventory.fingerprint(table(spark, sf_dir, "orders"), 1000, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


_CASES = "u AS (SELECT l_orderkey AS state, l_linenumber AS action, -(abs(l_quantity - 25) + 0.5 * abs(round_even(l_tax * 100, 0))) AS u FROM lineitem), o AS (SELECT state, arg_min(action, (-u, action)) AS best FROM u GROUP BY state)"


@query("ranking_contract", "WITH " + _CASES + ", r AS (SELECT state, list(action ORDER BY -u, action) AS ranking, list(action ORDER BY action) AS candidates FROM u GROUP BY state), x AS (SELECT state, CASE WHEN state % 10 = 3 THEN ranking[2:] ELSE ranking END AS ranking, candidates, CASE WHEN state % 10 = 7 THEN -1 ELSE best END AS best FROM r JOIN o USING (state)) SELECT state, array_to_string(list_filter([CASE WHEN list_sort(ranking) <> candidates THEN 'not_all_candidates' END, CASE WHEN ranking[1] IS NULL OR ranking[1] <> best THEN 'oracle_not_first' END], lambda e: e IS NOT NULL), ',') AS errors FROM x")
def ranking_contract(spark, sf_dir):
    """C17: rankings hold every candidate once and start with the oracle; some are broken on purpose."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("state"), F.col("l_linenumber").alias("action"), (F.abs(F.col("l_quantity") - 25) + 0.5 * F.abs(F.rint(F.col("l_tax") * 100))).alias("cost"))
    g = rows.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("cost", "action"))), lambda r: r["action"]).alias("ranking"), F.array_sort(F.collect_list("action")).alias("candidates"))
    broken = F.when(F.col("state") % 10 == 3, F.slice("ranking", 2, F.greatest(F.size("ranking") - 1, F.lit(0)))).otherwise(F.col("ranking"))
    oracle = F.when(F.col("state") % 10 == 7, -1).otherwise(F.get("ranking", F.lit(0)))
    e = K.ranking_errors(broken, F.col("candidates"), oracle)
    return g.select("state", F.array_join(e, ",").alias("errors"))


@query("rater_verdicts", "WITH v AS (SELECT user_id AS item, event_type AS cat, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT item, sum(n) AS votes, max(n) AS most, count(*) FILTER (n = m) AS heads, min(cat) FILTER (n = m) AS head FROM (SELECT *, max(n) OVER (PARTITION BY item) AS m FROM v) GROUP BY item) SELECT item, CAST(votes AS BIGINT) AS votes, CASE WHEN 2 * most > votes THEN head END AS majority, CASE WHEN 2 * most > votes THEN CASE WHEN head = 'error' THEN 'REVERSED' ELSE 'RESOLVED' END ELSE 'UNRESOLVED' END AS status FROM p")
def rater_verdicts(spark, sf_dir):
    """The majority of the votes on each item, and whether it stands, is reversed, or is none."""
    return L.rater_verdicts(table(spark, sf_dir, "events"), "user_id", "event_type", "error")


@query("rater_ranks", "WITH m AS (SELECT user_id AS item, quantile_cont(CAST(strlen(event_type) AS DOUBLE), 0.5) AS median, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY user_id) SELECT item, round(median, 6) AS median_rank, n > 1 AND kinds = n AS unresolved FROM m")
def rater_ranks(spark, sf_dir):
    """The median rank of each item, and whether all its ranks differ."""
    return L.median_ranks(table(spark, sf_dir, "events").withColumn("rank", F.length("event_type")), "user_id", "rank", "event_type").select("item", *r6("median_rank"), "unresolved")
