"""Queries: nested records built from the tables, and their contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import nested as N
from tessera.plans.adapters import table
from tessera.plans.catalog import catalog

QUERIES, SQL, query = catalog()

# Names of actions and statuses, and the fields of a lattice's provenance.
ACTIONS = ["bust_circumference_delta_cm", "shoulder_width_delta_cm", "sleeve_length_delta_cm"]
SIMULATION = ["NOT_RUN", "SIMULATED", "FAILED"]
RENDER = ["NOT_RUN", "RENDERED", "FAILED", "NOT_APPLICABLE"]
VERIFICATION = ["NOT_VERIFIED", "VERIFIED", "FAILED"]
PROVENANCE = ["git_sha", "environment", "seed", "source_assets", "artifact_paths"]

_TEXT = {"type": "string", "pattern": r"\S"}
_SOME = {"type": "object", "minProperties": 1}
_SHARE = {"type": ["number", "null"], "minimum": 0, "maximum": 1}


def _simulated(status: str, **then) -> dict:
    return {"if": {"properties": {"simulation_status": {"const": status}}}, "then": {"properties": then, "required": list(then)}}


#: States, candidates, outcomes, hypotheses and lattices of corrections.
CONTRACT = {
    "definitions": {
        "state": {
            "type": "object",
            "required": ["state_id", "body", "garment", "visual_assets", "material", "garment_type", "fit_intent", "region_fit_state", "provenance"],
            "properties": {
                "state_id": _TEXT, "body": _SOME, "garment": _SOME, "material": _SOME, "garment_type": _TEXT, "fit_intent": _TEXT, "region_fit_state": _SOME,
                "visual_assets": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1}},
                "provenance": {"type": "object", "minProperties": 1, "required": ["source"], "properties": {"source": {"type": "string", "minLength": 1}}},
            },
        },
        "candidate": {
            "type": "object",
            "required": ["action_family", "intended_delta_cm", "verification_status"],
            "properties": {
                "candidate_id": {"type": ["string", "null"]}, "action_family": {"enum": ACTIONS}, "intended_delta_cm": {"type": "number", "not": {"const": 0}},
                "realized_delta_cm": {"type": ["number", "null"]}, "source_pattern_parameters": {"type": "object"}, "verification_status": {"enum": VERIFICATION},
            },
        },
        "outcome": {
            "type": "object",
            "required": ["candidate_id", "region_before", "simulation_status", "render_status", "provenance"],
            "properties": {
                "candidate_id": _TEXT, "region_before": _SOME, "region_after": {"type": ["object", "null"]}, "direction": {"type": ["string", "null"]}, "magnitude": {"type": ["number", "null"]},
                "side_effects": {"type": "array"}, "confidence": _SHARE, "simulation_status": {"enum": SIMULATION}, "render_status": {"enum": RENDER}, "reproducibility": {"type": "object"},
                "hashes": {"type": "object", "additionalProperties": {"type": "string"}}, "provenance": _SOME,
            },
            "allOf": [_simulated("SIMULATED", region_after=_SOME), _simulated("NOT_RUN", region_after={"type": "null"}, render_status={"const": "NOT_RUN"})],
        },
        "hypothesis": {
            "type": "object",
            "required": ["cause", "supporting_evidence", "verification_status"],
            "properties": {"cause": _TEXT, "supporting_evidence": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1}}, "confidence": _SHARE, "verification_status": {"enum": VERIFICATION}},
        },
        "lattice": {
            "type": "object",
            "required": ["lattice_id", "state_id", "candidate_actions", "outcomes", "verification_status", "provenance"],
            "properties": {
                "lattice_id": _TEXT, "state_id": _TEXT, "verification_status": {"enum": VERIFICATION},
                "candidate_actions": {"type": "array", "minItems": 1, "items": {"allOf": [{"$ref": "#/definitions/candidate"}, {"required": ["candidate_id"], "properties": {"candidate_id": {"type": "string"}}}]}},
                "outcomes": {"type": "array", "items": {"$ref": "#/definitions/outcome"}},
                "utilities": {"type": "object", "additionalProperties": {"type": ["number", "null"]}},
                "oracle_action": {"type": ["string", "null"]}, "ranking": {"type": ["array", "null"], "items": {"type": "string"}, "uniqueItems": True},
                "provenance": {"type": "object", "required": PROVENANCE},
            },
        },
    }
}
LATTICE_RULES = [
    N.unique_by("candidate_actions", "candidate_id"), N.unique_by("outcomes", "candidate_id"),
    N.refers_to(lambda r: r["outcomes"]["candidate_id"], "outcomes", "candidate_actions", "candidate_id"), N.refers_to(lambda r: F.array(r["oracle_action"]), "oracle_action", "candidate_actions", "candidate_id"),
    N.permutation_of("ranking", "candidate_actions", "candidate_id"), N.leads("oracle_action", "ranking"),
]


def states(spark, sf_dir):
    """Customers as states: some without a segment, an address or an asset."""
    one = lambda k, v: F.create_map(F.lit(k), v)
    none = F.expr("map_from_arrays(cast(array() AS array<string>), cast(array() AS array<double>))")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.struct(
        F.when(F.col("c_custkey") % 97 == 0, " ").otherwise(F.concat(F.lit("state_"), "c_custkey")).alias("state_id"),
        F.when(F.col("c_custkey") % 31 == 0, none).otherwise(one("bust_cm", F.col("c_acctbal").cast("double"))).alias("body"), one("bust_cm", F.lit(94.0)).alias("garment"),
        F.when(F.col("c_custkey") % 11 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 13 == 0, F.array(F.lit("front.png"), F.lit(""))).otherwise(F.array(F.lit("front.png"))).alias("visual_assets"),
        one("stretch", F.lit("low")).alias("material"), F.when(F.col("c_custkey") % 17 > 0, F.lit("blazer")).alias("garment_type"), F.lit("regular").alias("fit_intent"),
        one("chest", F.lit("tight")).alias("region_fit_state"), F.when(F.col("c_custkey") % 19 == 0, one("input", F.lit("abc"))).otherwise(one("source", F.lit("table"))).alias("provenance"),
    ).alias("record"))


def lattices(spark, sf_dir):
    """Orders as lattices: their lines are candidates with outcomes, ranked by quantity; a lattice has an order's few lines."""
    run = F.col("l_linestatus") == "O"
    after = F.create_map(F.lit("chest"), F.lit("easy"))
    line = F.struct(
        F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"),
        F.struct(
            F.col("l_linenumber").cast("string").alias("candidate_id"), F.when(F.col("l_returnflag") == "N", ACTIONS[0]).when(F.col("l_returnflag") == "A", ACTIONS[1]).when(run, ACTIONS[2]).otherwise("armhole_delta_cm").alias("action_family"),
            (F.col("l_quantity") - 25).alias("intended_delta_cm"), F.when(run, F.col("l_quantity") - 25.5).alias("realized_delta_cm"), F.when(run, "VERIFIED").otherwise("NOT_VERIFIED").alias("verification_status"),
        ).alias("candidate"),
        F.struct(
            F.col("l_linenumber").cast("string").alias("candidate_id"), F.when(run, "SIMULATED").otherwise("NOT_RUN").alias("simulation_status"), F.when(run | (F.col("l_tax") > 0.07), "RENDERED").otherwise("NOT_RUN").alias("render_status"),
            F.when(run & (F.col("l_tax") > 0) | ~run & (F.col("l_discount") > 0.09), after).alias("region_after"), (F.col("l_discount") * 12).alias("confidence"),
            F.create_map(F.lit("chest"), F.lit("tight")).alias("region_before"), F.create_map(F.lit("mesh"), F.when(F.col("l_discount") > 0, F.lit("abc"))).alias("hashes"), F.create_map(F.lit("source"), F.lit("table")).alias("provenance"),
        ).alias("outcome"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line), lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["part"] - b["part"]).cast("int")).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    ranked = F.transform(F.array_sort(F.transform("lines", lambda x: F.struct((-x["quantity"]).alias("q"), x["at"].alias("at")))), lambda x: x["at"].cast("string"))
    full = F.map_from_arrays(F.array(*map(F.lit, PROVENANCE)), F.array_repeat(F.lit("x"), len(PROVENANCE)))
    return orders.select(F.col("o_orderkey").alias("key"), F.struct(
        F.concat(F.lit("lattice_"), "o_orderkey").alias("lattice_id"), F.concat(F.lit("state_"), "o_custkey").alias("state_id"), F.lit("NOT_VERIFIED").alias("verification_status"),
        F.transform("lines", lambda x: x["candidate"]).alias("candidate_actions"), F.transform("lines", lambda x: x["outcome"]).alias("outcomes"),
        F.when(F.col("o_orderstatus") == "F", F.lit("1")).when(F.col("o_orderstatus") == "O", F.get(ranked, F.lit(0))).alias("oracle_action"),
        F.when(F.col("o_orderstatus") != "P", ranked).when(F.col("o_orderpriority") == "1-URGENT", F.slice(ranked, 2, 99)).alias("ranking"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.map_filter(full, lambda k, _: ~k.isin("seed", "environment"))).otherwise(full).alias("provenance"),
    ).alias("record"))


_STATE_RULES = [
    ("state_id", "pattern", "c_custkey % 97 = 0"), ("body", "minProperties", "c_custkey % 31 = 0"), ("visual_assets", "minItems", "c_custkey % 11 = 0"), ("visual_assets[*]", "minLength", "c_custkey % 11 <> 0 AND c_custkey % 13 = 0"),
    ("garment_type", "required", "c_custkey % 17 = 0"), ("provenance.source", "required", "c_custkey % 19 = 0"),
]


@query("state_contract", " UNION ALL ".join(f"SELECT '{path}' AS path, '{rule}' AS rule, count(*) AS n, count(*) AS records, min(c_custkey) AS first FROM customer WHERE {where} HAVING count(*) > 0" for path, rule, where in _STATE_RULES))
def state_contract(spark, sf_dir):
    """C17: states."""
    s = states(spark, sf_dir)
    return N.error_counts(s.withColumn("errors", N.contract_errors(s, "record", CONTRACT, "state")), "errors", "key")


_LINE_RULES = [
    ("candidate_actions[*].action_family", "enum", "l_returnflag = 'R' AND l_linestatus = 'F'"), ("candidate_actions[*].intended_delta_cm", "not", "l_quantity = 25"),
    ("outcomes[*].confidence", "maximum", "l_discount * 12 > 1"), ("outcomes[*].region_after", "required", "l_linestatus = 'O' AND NOT l_tax > 0"), ("outcomes[*].region_after", "type", "l_linestatus <> 'O' AND l_discount > 0.09"),
    ("outcomes[*].render_status", "const", "l_linestatus <> 'O' AND l_tax > 0.07"), ("outcomes[*].hashes.mesh", "type", "NOT l_discount > 0"),
]
_LATTICE_SQL = """WITH l AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority, list(CAST(l_linenumber AS VARCHAR)) FILTER (l_linenumber IS NOT NULL) AS ids,
    list(CAST(l_linenumber AS VARCHAR) ORDER BY l_quantity DESC, l_linenumber) FILTER (l_linenumber IS NOT NULL) AS ranked
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
), r AS (
  SELECT o_orderkey AS key, coalesce(ids, []) AS ids, CASE WHEN o_orderstatus = 'F' THEN '1' WHEN o_orderstatus = 'O' THEN ranked[1] END AS oracle, o_orderpriority = '5-LOW' AS low,
    CASE WHEN o_orderstatus <> 'P' THEN coalesce(ranked, []) WHEN o_orderpriority = '1-URGENT' THEN coalesce(ranked[2:], []) END AS ranking
  FROM l
), e AS (
""" + " UNION ALL ".join(
    [f"SELECT '{path}' AS path, '{rule}' AS rule, l_orderkey AS key FROM lineitem WHERE {where}" for path, rule, where in _LINE_RULES]
    + [f"SELECT '{path}', '{rule}', key FROM r WHERE {where}" for path, rule, where in [
        ("candidate_actions", "minItems", "len(ids) = 0"), ("candidate_actions", "unique:candidate_id", "len(list_distinct(ids)) < len(ids)"), ("outcomes", "unique:candidate_id", "len(list_distinct(ids)) < len(ids)"),
        ("oracle_action", "refers:candidate_actions.candidate_id", "oracle IS NOT NULL AND NOT list_contains(ids, oracle)"), ("ranking", "permutation", "ranking IS NOT NULL AND list_sort(ranking) <> list_sort(ids)"),
        ("ranking", "uniqueItems", "len(list_distinct(ranking)) < len(ranking)"), ("oracle_action", "leads", "oracle IS NOT NULL AND (ranking IS NULL OR len(ranking) = 0 OR ranking[1] <> oracle)"),
        ("provenance.seed", "required", "low"), ("provenance.environment", "required", "low"),
    ]]
) + ") SELECT path, rule, count(*) AS n, count(DISTINCT key) AS records, min(key) AS first FROM e GROUP BY ALL"


@query("lattice_contract", _LATTICE_SQL)
def lattice_contract(spark, sf_dir):
    """C17: lattices with their candidates and outcomes, as nested records."""
    found = lattices(spark, sf_dir)
    return N.error_counts(found.withColumn("errors", N.contract_errors(found, "record", CONTRACT, "lattice", LATTICE_RULES)), "errors", "key")
