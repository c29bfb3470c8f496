"""Contracts of nested records: each keyword, the contract's own cases, and records read as JSON under it."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import nested as N
from tessera.plans.records import CONTRACT, LATTICE_RULES


def errors(spark, records, document, definition=None, rules=(), dtype=None):
    """Errors per record, which are read as JSON with the type that the contract implies."""
    dtype = dtype or N.Compiler(document).data_type({"$ref": f"#/definitions/{definition}"} if definition else document)
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, line string")
    read = rows.select("i", F.from_json("line", dtype).alias("record"))
    got = read.select("i", N.contract_errors(read, "record", document, definition, rules).alias("e")).orderBy("i").collect()
    return [sorted((e.path, e.rule) for e in r.e) for r in got]


STATE = {
    "state_id": "s", "body": {"bust_cm": "92"}, "garment": {"bust_cm": "94"}, "visual_assets": ["front.png"], "material": {"stretch": "low"}, "garment_type": "blazer", "fit_intent": "regular",
    "region_fit_state": {"chest": "tight"}, "provenance": {"source": "unit"},
}


def test_states(spark):
    changed = [{}, {"visual_assets": []}, {"visual_assets": ["a", ""]}, {"body": {}}, {"garment_type": None}, {"fit_intent": "  "}, {"provenance": {"source": ""}}, {"visual_assets": None}]
    assert errors(spark, [STATE | c for c in changed], CONTRACT, "state") == [
        [], [("visual_assets", "minItems")], [("visual_assets[1]", "minLength")], [("body", "minProperties")], [("garment_type", "required")], [("fit_intent", "pattern")],
        # A struct without any field that is there has no property left either.
        [("provenance.source", "minLength")], [("visual_assets", "required")],
    ]


OUTCOME = {"candidate_id": "c", "region_before": {"chest": "tight"}, "region_after": None, "side_effects": [], "simulation_status": "NOT_RUN", "render_status": "NOT_RUN", "reproducibility": {"status": "unit"}, "hashes": {}, "provenance": {"source": "unit"}}


def test_outcomes(spark):
    changed = [
        {}, {"simulation_status": "SIMULATED"}, {"simulation_status": "SIMULATED", "region_after": {}}, {"simulation_status": "SIMULATED", "region_after": {"chest": "easy"}, "render_status": "FAILED"}, {"region_after": {"chest": "easy"}},
        {"render_status": "RENDERED"}, {"confidence": 1.5}, {"confidence": 1}, {"simulation_status": "DONE"}, {"hashes": {"mesh": None}}, {"region_before": {}, "confidence": -0.1},
    ]
    assert errors(spark, [OUTCOME | c for c in changed], CONTRACT, "outcome") == [
        [], [("region_after", "required")], [("region_after", "minProperties")], [], [("region_after", "type")], [("render_status", "const")], [("confidence", "maximum")], [], [("simulation_status", "enum")], [("hashes.mesh", "type")],
        [("confidence", "minimum"), ("region_before", "minProperties")],
    ]


def candidate(name, **more):
    return {"candidate_id": name, "action_family": "sleeve_length_delta_cm", "intended_delta_cm": 1.0, "verification_status": "NOT_VERIFIED"} | more


def test_lattices(spark):
    base = {
        "lattice_id": "l", "state_id": "s", "candidate_actions": [candidate("a"), candidate("b")], "outcomes": [OUTCOME | {"candidate_id": "a"}, OUTCOME | {"candidate_id": "b"}], "utilities": {"a": 1.0, "b": None},
        "oracle_action": "a", "ranking": ["a", "b"], "verification_status": "NOT_VERIFIED", "provenance": dict.fromkeys(["git_sha", "environment", "seed", "source_assets", "artifact_paths"], "x"),
    }
    changed = [
        {}, {"candidate_actions": [candidate("a"), candidate("a")], "outcomes": []}, {"ranking": ["a"]}, {"oracle_action": "b"}, {"ranking": None}, {"ranking": None, "oracle_action": None}, {"oracle_action": "z"},
        {"outcomes": [OUTCOME | {"candidate_id": "z"}]}, {"candidate_actions": [candidate("a", intended_delta_cm=0), candidate("b", action_family="armhole_delta_cm")]}, {"provenance": {"seed": "1"}}, {"candidate_actions": []}, {"ranking": ["a", "a"]},
        {"candidate_actions": [candidate("a"), candidate(None)], "outcomes": [], "ranking": None, "oracle_action": None},
    ]
    got = errors(spark, [base | c for c in changed], CONTRACT, "lattice", LATTICE_RULES)
    assert got == [
        [], [("candidate_actions", "unique:candidate_id"), ("ranking", "permutation")], [("ranking", "permutation")], [("oracle_action", "leads")], [("oracle_action", "leads")], [], [("oracle_action", "leads"), ("oracle_action", "refers:candidate_actions.candidate_id")],
        [("outcomes", "refers:candidate_actions.candidate_id")], [("candidate_actions[0].intended_delta_cm", "not"), ("candidate_actions[1].action_family", "enum")],
        [(f"provenance.{k}", "required") for k in sorted(["git_sha", "environment", "source_assets", "artifact_paths"])],
        [("candidate_actions", "minItems"), ("oracle_action", "refers:candidate_actions.candidate_id"), ("outcomes", "refers:candidate_actions.candidate_id"), ("ranking", "permutation")], [("ranking", "permutation"), ("ranking", "uniqueItems")],
        [("candidate_actions[1].candidate_id", "required")],
    ]


@pytest.mark.parametrize(
    "schema, dtype, values, wanted",
    [
        ({"type": "integer", "minimum": 2, "exclusiveMaximum": 5}, "bigint", [2, 5, 1, None], [[], ["exclusiveMaximum"], ["minimum"], ["type"]]),
        ({"type": ["integer", "null"]}, "double", [2.0, 2.5, None], [[], ["type"], []]),
        ({"type": "number", "multipleOf": 0.5}, "double", [1.5, 1.25, float("nan")], [[], ["multipleOf"], ["multipleOf"]]),
        ({"anyOf": [{"maximum": 1}, {"minimum": 5}]}, "int", [0, 3, 9, None], [[], ["anyOf"], [], []]),
        ({"oneOf": [{"maximum": 4}, {"minimum": 2}]}, "int", [0, 3, 9], [[], ["oneOf"], []]),
        ({"if": {"minimum": 5}, "then": {"multipleOf": 5}, "else": {"maximum": 3}}, "int", [5, 7, 3, 4], [[], ["multipleOf"], [], ["maximum"]]),
        ({"type": "string", "maxLength": 2, "pattern": "^é"}, "string", ["é", "éaa", "x"], [[], ["maxLength"], ["pattern"]]),
        ({"type": "boolean", "const": True}, "boolean", [True, False, None], [[], ["const"], ["const", "type"]]),
        ({"type": "array", "uniqueItems": True, "maxItems": 3, "contains": {"minimum": 2}}, "array<int>", [[1, 2], [2, 2], [1], [1, 2, 3, 4]], [[], ["uniqueItems"], ["contains"], ["maxItems"]]),
        ({"type": "array", "items": {"type": ["array", "null"], "items": {"type": "integer", "maximum": 1}}}, "array<array<int>>", [[[1], None], [[1, 2], [None]]], [[], ["maximum", "type"]]),
        ({"type": "object", "additionalProperties": False, "properties": {"a": {}}, "maxProperties": 1}, "map<string,int>", [{"a": 1}, {"b": 1}, {"a": 1, "b": 2}], [[], ["additionalProperties"], ["additionalProperties", "maxProperties"]]),
        ({"type": "object", "additionalProperties": False, "properties": {"a": {"maximum": 1}}, "dependentRequired": {"a": ["b"]}}, "struct<a:int,b:int>", [(None, None), (1, None), (2, 1)], [[], ["dependentRequired"], ["additionalProperties", "maximum"]]),
        ({"enum": ["a", None]}, "string", ["a", "b", None], [[], ["enum"], []]),
        ({"enum": ["a"]}, "string", [None], [["type"]]),
        ({"type": "string"}, "int", [1], [["type"]]),
    ],
)
def test_keywords(spark, schema, dtype, values, wanted):
    rows = spark.createDataFrame([(i, (v,)) for i, v in enumerate(values)], f"i int, record struct<v:{dtype}>")
    field = rows.schema["record"].dataType["v"].dataType
    got = rows.select("i", N.Compiler(schema).errors(schema, F.col("record.v"), field, F.lit("v")).alias("e")).orderBy("i").collect()
    assert [sorted(e.rule for e in r.e) for r in got] == wanted


def test_types_references_and_refusals(spark):
    document = {"definitions": {"node": {"type": "object", "properties": {"n": {"type": "integer"}, "tags": {"type": "object", "additionalProperties": {"type": "number"}}, "xs": {"type": "array", "items": {"type": ["string", "null"]}}}}}}
    assert N.Compiler(document).data_type({"$ref": "#/definitions/node"}) == T.StructType([T.StructField("n", T.LongType()), T.StructField("tags", T.MapType(T.StringType(), T.DoubleType())), T.StructField("xs", T.ArrayType(T.StringType()))])
    for schema in ({"format": "date"}, {"$ref": "other.json"}, {"$ref": "#/definitions/a"}):
        with pytest.raises((ValueError, KeyError)):
            N.Compiler({"definitions": {"a": {"$ref": "#/definitions/a"}}}).resolve(schema)
    assert errors(spark, [{"n": 1}], document, "node") == [[]]
    empty = spark.createDataFrame([(1, None)], "i int, record struct<n:bigint>")
    assert empty.select(N.contract_errors(empty, "record", document, "node").alias("e")).first().e[0].rule == "type"


def test_counts_over_records(spark):
    rows = spark.createDataFrame([(3, [("a[0].x", "min"), ("a[12].x", "min"), ("b", "type")]), (2, [("a[1].x", "min")]), (9, [])], "k int, e array<struct<path:string,rule:string>>")
    assert sorted(tuple(r) for r in N.error_counts(rows, "e", "k").collect()) == [("a[*].x", "min", 3, 2, 2), ("b", "type", 1, 1, 3)]
