"""Contracts of nested records: a JSON Schema compiled to column expressions over structs, maps and arrays.

A record's errors are an array of (path, rule): ``path`` names the place, as ``outcomes[2].confidence``, and ``rule`` the
keyword that it breaks.  Everything is one expression per record, so a table is validated where it is read.

A struct's null field and an absent one are the same in Spark.  Such a field breaks ``required`` if it is required and
its type does not allow null; otherwise it counts as null where null is allowed, and as absent where it is not.  A map's
absent key is absent.  A keyword that says nothing about a value's type is passed over for it, as JSON Schema has it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ERROR = "array<struct<path:string,rule:string>>"
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "$defs"}
_KNOWN = {
    "$ref", "type", "enum", "const", "not", "allOf", "anyOf", "oneOf", "if", "then", "else", "required", "dependentRequired", "properties", "additionalProperties", "minProperties",
    "maxProperties", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minItems", "maxItems", "uniqueItems", "items", "contains",
}
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _none() -> Column:
    return F.array().cast(_ERROR)


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _error(path: Column, rule: str, broken: Column) -> Column:
    return F.when(broken, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(_none())


def _kinds(dtype: T.DataType) -> set[str]:
    """The JSON types that values of a Spark type can have."""
    if isinstance(dtype, _WHOLE) or isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        return {"integer", "number"}
    if isinstance(dtype, _NUMBERS):
        return {"number"}
    simple = {T.StringType: "string", T.BooleanType: "boolean", T.ArrayType: "array", T.StructType: "object", T.MapType: "object", T.NullType: "null"}
    return {simple.get(type(dtype), "string")}


class Compiler:
    """Compiles the definitions of one JSON Schema document."""

    def __init__(self, document: Mapping):
        self.document = document

    def resolve(self, schema: Mapping) -> Mapping:
        """Follow local references; keywords beside a reference hold too."""
        seen = []
        while "$ref" in schema:
            ref = schema["$ref"]
            if not ref.startswith("#/") or ref in seen:
                raise ValueError(f"not a local reference, or one to itself: {ref}")
            seen.append(ref)
            target = reduce(lambda at, key: at[key.replace("~1", "/").replace("~0", "~")], ref[2:].split("/"), self.document)
            beside = {k: v for k, v in schema.items() if k != "$ref" and k not in _NOTES}
            schema = {"allOf": [target, beside]} if beside else target
        unknown = set(schema) - _KNOWN - _NOTES
        if unknown:
            raise ValueError(f"keywords that are not compiled: {sorted(unknown)}")
        return schema

    def types(self, schema: Mapping) -> set[str] | None:
        schema = self.resolve(schema)
        named = schema.get("type")
        found = None if named is None else {named} if isinstance(named, str) else set(named)
        if found is None and "enum" in schema and None not in schema["enum"]:
            found = {"string", "number", "boolean", "object", "array"}
        for sub in schema.get("allOf", ()):
            inner = self.types(sub)
            found = inner if found is None else found if inner is None else found & inner
        return found

    def nullable(self, schema: Mapping) -> bool:
        kinds = self.types(schema)
        return kinds is None or "null" in kinds

    def errors(self, schema: Mapping, value: Column, dtype: T.DataType, path: Column) -> Column:
        """Errors of a value that is there; a null value is judged as null."""
        schema = self.resolve(schema)
        present = _all([self._keyword(k, schema, value, dtype, path) for k in schema if k not in _NOTES])
        null = [_error(path, "type", F.lit(True))] if not self.nullable(schema) else []
        if "const" in schema and schema["const"] is not None:
            null.append(_error(path, "const", F.lit(True)))
        if "not" in schema:
            null.append(_error(path, "not", F.lit(self.nullable(schema["not"]) and "const" not in schema["not"] and "enum" not in schema["not"])))
        return F.when(value.isNull(), _all(null)).otherwise(present)

    def _keyword(self, key: str, schema: Mapping, v: Column, dtype: T.DataType, path: Column) -> Column:
        rule = schema[key]
        sub = lambda s: self.errors(s, v, dtype, path)
        fails = lambda s: F.size(sub(s)) > 0
        bad = lambda broken: _error(path, key, broken)
        count = lambda items: sum((f.cast("int") for f in items), F.lit(0))
        if key == "type":
            allowed = {rule} if isinstance(rule, str) else set(rule)
            kinds = _kinds(dtype)
            if kinds & allowed:
                return _none()
            whole = "integer" in allowed and kinds == {"number"}  # a double may hold a whole number
            return bad(~(v == F.floor(v)) if whole else F.lit(True))
        if key in ("enum", "const"):
            values = [x for x in ([rule] if key == "const" else rule) if x is not None]
            same = [x for x in values if self._comparable(x, dtype)]
            return bad(~v.isin(same) if same else F.lit(True))
        if key == "not":
            return bad(F.size(sub(rule)) == 0)
        if key == "allOf":
            return _all([sub(s) for s in rule])
        if key == "anyOf":
            return bad(count([fails(s) for s in rule]) == len(rule))
        if key == "oneOf":
            return bad(count([fails(s) for s in rule]) != len(rule) - 1)
        if key == "if":
            then, other = (sub(schema[k]) if k in schema else _none() for k in ("then", "else"))
            return F.when(fails(rule), other).otherwise(then)
        if key in ("then", "else"):
            return _none()
        if isinstance(dtype, T.StringType):
            tests = {"minLength": lambda: F.char_length(v) < rule, "maxLength": lambda: F.char_length(v) > rule, "pattern": lambda: ~v.rlike(rule)}
            return bad(tests[key]()) if key in tests else _none()
        if isinstance(dtype, _NUMBERS):
            tests = {
                "minimum": lambda: v < rule, "maximum": lambda: v > rule, "exclusiveMinimum": lambda: v <= rule, "exclusiveMaximum": lambda: v >= rule,
                "multipleOf": lambda: (v / rule) != F.floor(v / rule),
            }
            # NaN is no JSON number: it is in no range.
            nan = F.isnan(v) if isinstance(dtype, (T.FloatType, T.DoubleType)) else F.lit(False)
            return bad(tests[key]() | nan) if key in tests else _none()
        if isinstance(dtype, T.ArrayType):
            return self._array(key, rule, v, dtype, path, bad)
        if isinstance(dtype, T.StructType):
            return self._struct(key, schema, v, dtype, path, bad)
        if isinstance(dtype, T.MapType):
            return self._map(key, schema, v, dtype, path, bad)
        return _none()

    @staticmethod
    def _comparable(x, dtype: T.DataType) -> bool:
        if isinstance(x, bool):
            return isinstance(dtype, T.BooleanType)
        return isinstance(dtype, T.StringType) if isinstance(x, str) else isinstance(dtype, _NUMBERS) and isinstance(x, (int, float))

    def _array(self, key: str, rule, v: Column, dtype: T.ArrayType, path: Column, bad: Callable) -> Column:
        inner = lambda x, i: self.errors(rule, x, dtype.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        if key == "items":
            return F.flatten(F.transform(v, inner))
        if key == "contains":
            return bad(~F.exists(F.transform(v, lambda x, i: F.size(inner(x, i)) == 0), lambda ok: ok))
        tests = {"minItems": lambda: F.size(v) < rule, "maxItems": lambda: F.size(v) > rule, "uniqueItems": lambda: F.lit(bool(rule)) & (F.size(F.array_distinct(v)) < F.size(v))}
        return bad(tests[key]()) if key in tests else _none()

    def _struct(self, key: str, schema: Mapping, v: Column, dtype: T.StructType, path: Column, bad: Callable) -> Column:
        fields, rule = {f.name: f.dataType for f in dtype}, schema[key]
        properties = schema.get("properties", {})
        at = lambda name: self._below(path, F.lit(name))
        there = lambda name: v[name].isNotNull() if name in fields else F.lit(False)
        if key == "required":
            needed = [n for n in rule if n not in fields or not self.nullable(properties.get(n, {}))]
            return _all([_error(at(n), "required", ~there(n)) for n in needed])
        if key == "dependentRequired":
            return _all([_error(at(n), "dependentRequired", there(given) & ~there(n)) for given, names in rule.items() for n in names])
        if key == "properties":
            judged = [(n, self.errors(s, v[n], fields[n], at(n)), self.nullable(s)) for n, s in rule.items() if n in fields]
            return _all([e if null_counts else F.when(v[n].isNotNull(), e).otherwise(_none()) for n, e, null_counts in judged])
        if key == "additionalProperties":
            more = [n for n in fields if n not in properties]
            if rule is False:
                return _all([_error(at(n), key, there(n)) for n in more])
            return _none() if rule is True else _all([F.when(v[n].isNotNull(), self.errors(rule, v[n], fields[n], at(n))).otherwise(_none()) for n in more])
        n = sum((there(name).cast("int") for name in fields), F.lit(0))
        tests = {"minProperties": lambda: n < rule, "maxProperties": lambda: n > rule}
        return bad(tests[key]()) if key in tests else _none()

    def _map(self, key: str, schema: Mapping, v: Column, dtype: T.MapType, path: Column, bad: Callable) -> Column:
        rule, properties = schema[key], schema.get("properties", {})
        has = lambda name: F.map_contains_key(v, name)
        if key == "required":
            return _all([_error(self._below(path, F.lit(n)), "required", ~has(n)) for n in rule])
        if key == "dependentRequired":
            return _all([_error(self._below(path, F.lit(n)), key, has(given) & ~has(n)) for given, names in rule.items() for n in names])
        if key == "properties":
            return _all([F.when(has(n), self.errors(s, F.try_element_at(v, F.lit(n)), dtype.valueType, self._below(path, F.lit(n)))).otherwise(_none()) for n, s in rule.items()])
        if key == "additionalProperties":
            if rule is True:
                return _none()
            more = F.filter(F.map_entries(v), lambda e: ~e["key"].isin(list(properties))) if properties else F.map_entries(v)
            one = lambda e: _error(self._below(path, e["key"]), key, F.lit(True)) if rule is False else self.errors(rule, e["value"], dtype.valueType, self._below(path, e["key"]))
            return F.flatten(F.transform(more, one))
        tests = {"minProperties": lambda: F.size(v) < rule, "maxProperties": lambda: F.size(v) > rule}
        return bad(tests[key]()) if key in tests else _none()

    @staticmethod
    def _below(path: Column, name: Column) -> Column:
        return F.concat(path, F.when(path == "", "").otherwise("."), name)

    def data_type(self, schema: Mapping) -> T.DataType:
        """The Spark type that holds records of a schema: for reading JSON under the contract, or for building a table."""
        schema = self.resolve(schema)
        if "allOf" in schema and "type" not in schema:
            return self.data_type(next(s for s in schema["allOf"] if self.types(s)))
        kinds = (self.types(schema) or {"string"}) - {"null"}
        if "object" in kinds and len(kinds) == 1:
            if schema.get("properties"):
                return T.StructType([T.StructField(n, self.data_type(s)) for n, s in schema["properties"].items()])
            more = schema.get("additionalProperties")
            return T.MapType(T.StringType(), self.data_type(more) if isinstance(more, Mapping) else T.StringType())
        if kinds == {"array"}:
            return T.ArrayType(self.data_type(schema.get("items", {})))
        simple = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
        return simple[next(iter(kinds))] if len(kinds) == 1 else T.DoubleType() if kinds == {"number", "integer"} else T.StringType()


def contract_errors(df: DataFrame, record: str, document: Mapping, definition: str | None = None, rules: list[Callable[[Column], Column]] = ()) -> Column:
    """array<struct<path, rule>> of what is wrong with the struct column ``record`` of ``df``; a null record is one error.

    ``definition`` names one of the document's definitions; ``rules`` add conditions between fields, which JSON Schema has no
    keyword for, such as those of ``unique_by``, ``refers_to`` and ``permutation_of``.
    """
    compiler = Compiler(document)
    schema = {"$ref": f"#/definitions/{definition}"} if definition else document
    value = F.col(record)
    own = compiler.errors(schema, value, df.schema[record].dataType, F.lit(""))
    more = [F.when(value.isNotNull(), rule(value)).otherwise(_none()) for rule in rules]
    return F.when(value.isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("type").alias("rule")))).otherwise(_all([own, *more]))


def unique_by(items: str, key: str) -> Callable[[Column], Column]:
    """No two items of a list share a key; nulls are not counted."""

    def rule(record: Column) -> Column:
        keys = F.filter(record[items][key], lambda k: k.isNotNull())
        return _error(F.lit(items), f"unique:{key}", F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False)))

    return rule


def refers_to(values: Callable[[Column], Column], path: str, items: str, key: str) -> Callable[[Column], Column]:
    """Every non-null element of ``values(record)`` is the key of an item."""

    def rule(record: Column) -> Column:
        outside = F.array_except(F.filter(values(record), lambda x: x.isNotNull()), F.coalesce(record[items][key], F.array().cast("array<string>")))
        return _error(F.lit(path), f"refers:{items}.{key}", F.coalesce(F.size(outside) > 0, F.lit(False)))

    return rule


def permutation_of(ranking: str, items: str, key: str) -> Callable[[Column], Column]:
    """A ranking that is there holds the key of every item once."""

    def rule(record: Column) -> Column:
        return _error(F.lit(ranking), "permutation", F.coalesce(F.array_sort(record[ranking]) != F.array_sort(record[items][key]), F.lit(False)))

    return rule


def leads(first: str, ranking: str) -> Callable[[Column], Column]:
    """A value that is there stands first in the ranking."""

    def rule(record: Column) -> Column:
        return _error(F.lit(first), "leads", record[first].isNotNull() & ~F.coalesce(F.get(record[ranking], F.lit(0)) == record[first], F.lit(False)))

    return rule


def error_counts(df: DataFrame, errors: str, key: str) -> DataFrame:
    """(path, rule, n, records, first): how often a rule is broken, in how many records, and the smallest ``key`` of those.

    Places in lists are one path, ``[*]``; a record is counted once per path and rule before anything is shuffled.
    """
    general = F.transform(errors, lambda e: F.struct(F.regexp_replace(e["path"], r"\[\d+\]", "[*]").alias("path"), e["rule"].alias("rule")))
    rows = df.select(F.col(key).alias("_key"), general.alias("all"))
    each = rows.select("_key", "all", F.explode(F.array_distinct("all")).alias("e")).withColumn("n", F.size(F.filter("all", lambda x: x == F.col("e"))))
    return each.groupBy("e.path", "e.rule").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("records"), F.min("_key").alias("first"))
