import math

from pyspark.sql import functions as F

from tessera.functions import scalars as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["_"]) if all(v is not None for v in values.values()) else spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_finite(spark):
    rows = spark.createDataFrame([("NaN",), ("Infinity",), ("-Infinity",), ("x",), ("1.5",), (None,)], "v string")
    assert [r.x for r in rows.select(S.finite("v").alias("x")).collect()] == [None, None, None, None, 1.5, None]


def test_half_even(spark):
    got = spark.createDataFrame([(0.125, 0.375, 2.5, -0.001)], ["a", "b", "c", "d"]).select(S.half_even("a", 2), S.half_even("b", 2), S.half_even("c", 0), S.half_even("d", 1)).first()
    assert list(got) == [0.12, 0.38, 2.0, 0.0] and math.copysign(1, got[3]) == 1


def test_hamming_of_unusable(spark):
    rows = spark.createDataFrame([("0", "0"), ("0", "1"), ("0", "ffffffffffffffff"), ("0", ""), ("0", "zz"), ("0", None)], "a string, b string")
    assert [r.x for r in rows.select(S.hamming_hex("a", "b").alias("x")).collect()] == [0, 1, 64, 64, 64, 64]


def test_bounds_and_bins(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (0.999,), (2.001,), (None,)], "v double")
    assert [r.x for r in rows.select(S.out_of_bounds("v", 1, 2).alias("x")).collect()] == [False, False, True, True, False]
    bins = spark.createDataFrame([(-3.0,), (0.0,), (10.0,), (15.0,), (None,)], "v double").select(S.ease_bin("v").alias("x"))
    assert [r.x for r in bins.collect()] == ["tight", "close", "regular", "loose", None]


def test_pair_ids_do_not_depend_on_order(spark):
    r = spark.createDataFrame([("a", "b")], ["a", "b"]).select(S.pair_id("a", "b").alias("x"), S.pair_id("b", "a").alias("y"), S.pair_id("a", "a").alias("z"), S.pair_key("a", F.lit(None).cast("string")).alias("n")).first()
    assert r.x == r.y and r.x.startswith("cf_") and len(r.x) == 27 and r.z is None and r.n is None


def test_text_round_trip(spark):
    d = spark.createDataFrame([(99.84, None)], "b double, r double").select(S.serialize({"BODY": "b", "REALIZED": "r"}).alias("t"))
    r = d.select("t", S.parse_pairs("t").alias("m"), S.parse_pairs(F.lit("A=1 A=2 x")).alias("last")).first()
    assert r.t == "BODY=99.840000 REALIZED=NA" and r.m == {"BODY": "99.840000", "REALIZED": "NA"} and r["last"] == {"A": "2"}


def test_json_from_free_text(spark):
    rows = spark.createDataFrame([('so {"a": {"b": 1}} ok',), ("{broken",), ("none",), (None,)], "t string")
    assert [r.x for r in rows.select(S.json_object("t").alias("x")).collect()] == ['{"a": {"b": 1}}', None, None, None]


def test_flags_are_appended_once(spark):
    r = spark.createDataFrame([(["a"],), (None,)], "f array<string>").select(S.with_flag("f", "a", F.lit(True)).alias("x"), S.with_flag("f", "b", F.lit(None).cast("boolean")).alias("y")).collect()
    assert [x.x for x in r] == [["a"], ["a"]] and [x.y for x in r] == [["a"], []]


def test_ratio_of_zero_is_null(spark):
    r = spark.createDataFrame([(1.0, 0.0)], ["a", "b"]).select(S.ratio("a", "b").alias("x"), S.difference("a", F.lit(None).cast("double")).alias("y")).first()
    assert r.x is None and r.y is None
