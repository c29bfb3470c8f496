"""Queries: contract validation, rule tables, exports, unions, text sinks, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scratch import passing_shuffles, scratch_path
from tessera.operators import contracts as K
from tessera.operators import stats as T
from tessera.plans.adapters import FIELDS, LEAKS, MANIFEST, SAMPLES, manifest, samples, table
from tessera.plans.audit import r6
from tessera.plans.catalog import catalog
from tessera.sources import inventory

QUERIES, SQL, query = catalog()


@query("conversation_contract", """WITH c AS (SELECT conv_id, list(turn) AS turns, list(role) AS roles, count(*) AS n FROM conversations GROUP BY conv_id)
  SELECT conv_id, array_to_string(list_filter([CASE WHEN len(list_filter(roles, lambda r: r NOT IN ('user', 'assistant', 'system'))) > 0 THEN 'unknown_name' END, CASE WHEN len(list_distinct(turns)) < n THEN 'repeated' END, CASE WHEN list_sort(turns) <> range(0, n) THEN 'not_a_permutation' END], lambda e: e IS NOT NULL), ',') AS errors FROM c""")
def conversation_contract(spark, sf_dir):
    """C17 on conversations: roles of a fixed set, turns a permutation."""
    c = K.record_errors(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", ["user", "assistant", "system"])
    return c.select("conv_id", F.array_join("errors", ",").alias("errors"))


@query("bound_violations", "WITH " + SAMPLES + ", l AS (UNPIVOT (SELECT bust, length, sleeve FROM samples) ON bust, length, sleeve INTO NAME field VALUE value), r AS (SELECT * FROM (VALUES ('bust', 2, 49), ('length', 0, 9), ('sleeve', 1, 8)) t(field, low, high)) SELECT field, count(*) AS n, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (value < low OR value > high) AS BIGINT) AS out_of_bounds FROM l JOIN r USING (field) GROUP BY field")
def bound_violations(spark, sf_dir):
    """B7, D13."""
    rules = spark.createDataFrame([("bust", 2.0, 49.0), ("length", 0.0, 9.0), ("sleeve", 1.0, 8.0)], "field string, low double, high double")
    return K.bound_violations(T.long_form(samples(spark, sf_dir), ["bust", "length", "sleeve"], []), rules)


_LEAK = "(leakage_person OR leakage_cloth OR leakage_target OR leakage_pair)"


@query("leakage_export", "WITH " + MANIFEST + f" SELECT 'leakage' AS kind, id, person, cloth, target, split FROM manifest WHERE split = 'eval' AND {_LEAK} UNION ALL SELECT 'duplicate', id, person, cloth, target, split FROM manifest WHERE duplicate_pair OR duplicate_record")
def leakage_export(spark, sf_dir):
    """Held-out rows with any of the four leaks, and rows that repeat a pair or a record, written as Parquet and read."""
    m = manifest(spark, sf_dir, [*LEAKS, "duplicate_pair", "duplicate_record"])
    kinds = F.array_compact(F.array(F.when((F.col("split") == "eval") & F.expr(_LEAK), "leakage"), F.when(F.expr("duplicate_pair OR duplicate_record"), "duplicate")))
    both = m.select(F.explode(kinds).alias("kind"), "id", "person", "cloth", "target", "split")
    path = scratch_path(spark, "leaks")
    with passing_shuffles(spark):
        both.write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).select(*both.columns)


@query("lattice_freeze", "SELECT family, has_side, count(*) AS n, CAST(count(*) FILTER (bad) AS BIGINT) AS failures FROM (SELECT l_returnflag AS family, l_returnflag = 'N' AS has_side, l_quantity > 45 AS bad FROM lineitem WHERE l_returnflag IN ('N', 'R')) GROUP BY ALL")
def lattice_freeze(spark, sf_dir):
    """Two tables of differing columns as one, failures beside it."""
    errors = F.when(F.col("l_quantity") > 45, F.array(F.lit("too_large"))).otherwise(F.array().cast("array<string>")).alias("errors")
    base = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_tax").alias("side"), errors)
    rows, _ = inventory.freeze([base.filter("family = 'N'"), base.filter("family = 'R'").drop("side")], "errors")
    return rows.groupBy("family", F.col("side").isNotNull().alias("has_side")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("errors") > 0).cast("long")).alias("failures"))


@query("json_lines", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def json_lines(spark, sf_dir):
    """Written as JSON lines, read with its schema."""
    e = table(spark, sf_dir, "events").select("event_type", "value")
    path = scratch_path(spark, "json")
    e.write.json(path)
    return inventory.read_json_lines(spark, path, e.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("csv_sink", "WITH " + SAMPLES + ", l AS (UNPIVOT (SELECT split, bust, length, sleeve, ease, ease_ratio FROM samples) ON bust, length, sleeve, ease, ease_ratio INTO NAME field VALUE value) SELECT field, coalesce(split, 'ALL') AS part, count(value) AS n FROM l GROUP BY GROUPING SETS ((field), (field, split))")
def csv_sink(spark, sf_dir):
    """A10: the distribution table as CSV with a header, read again."""
    path = scratch_path(spark, "csv")
    inventory.write_csv(T.distribution(samples(spark, sf_dir), FIELDS, "split").select("field", "part", "n"), path)
    return spark.read.schema("field string, part string, n bigint").option("header", True).csv(path)


@query("contract_sink", "SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS note, false AS flagged FROM orders")
def contract_sink(spark, sf_dir):
    """Conformed to a schema, written, read."""
    from pyspark.sql import types as Y

    wanted = Y.StructType([Y.StructField("id", Y.LongType()), Y.StructField("price", Y.DoubleType()), Y.StructField("note", Y.StringType()), Y.StructField("flagged", Y.BooleanType())])
    path = scratch_path(spark, "contract")
    inventory.write_contract(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), wanted, path)
    return spark.read.parquet(path)


@query("status_roll_up", "WITH " + MANIFEST + ", m AS (SELECT count(*) AS n, avg(CAST(usable AS DOUBLE)) AS u, avg(CAST(" + _LEAK + " AS DOUBLE)) AS l FROM manifest) SELECT 'ingest' AS track, CASE WHEN n > 0 THEN 'ESTABLISHED' ELSE 'NOT_RUN' END AS status, true AS allowed FROM m UNION ALL SELECT 'quality', CASE WHEN u >= 0.9 THEN 'ESTABLISHED' ELSE 'PARTIAL' END, true FROM m UNION ALL SELECT 'leakage', CASE WHEN l > 0.01 THEN 'NOT_ESTABLISHED' ELSE 'ESTABLISHED' END, true FROM m")
def status_roll_up(spark, sf_dir):
    """E48."""
    m = manifest(spark, sf_dir, LEAKS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("usable").cast("double")).alias("u"), F.avg(F.expr(_LEAK).cast("double")).alias("l"))
    rules = {
        "ingest": F.when(F.col("n") > 0, "ESTABLISHED").otherwise("NOT_RUN"), "quality": F.when(F.col("u") >= 0.9, "ESTABLISHED").otherwise("PARTIAL"),
        "leakage": F.when(F.col("l") > 0.01, "NOT_ESTABLISHED").otherwise("ESTABLISHED"),
    }
    return K.statuses(m, rules, ("ESTABLISHED", "PARTIAL", "NOT_ESTABLISHED", "NOT_RUN"))


@query("analytic_inverse", "SELECT l_returnflag, count(*) AS n, round(sum(round_even(l_discount * 100, 0) / l_quantity), 4) AS parameter, round(sum(l_quantity + round_even(l_discount * 100, 0)), 4) AS predicted FROM lineitem GROUP BY l_returnflag")
def analytic_inverse(spark, sf_dir):
    """B28."""
    parameter, predicted = K.analytic_inverse(F.rint(F.col("l_discount") * 100), F.col("l_quantity"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(parameter), 4).alias("parameter"), F.round(F.sum(predicted), 4).alias("predicted"))


@query("worker_outcomes", "SELECT status, direction, CAST(effects AS BIGINT) AS effects, count(*) AS n, round(sum(magnitude), 4) AS magnitude FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'MEASURED' ELSE 'FAILED' END AS status, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_quantity - 25 > 0 THEN 'increase' WHEN l_quantity - 25 < 0 THEN 'decrease' ELSE 'none' END END AS direction, CASE WHEN l_tax > 0 THEN 2 ELSE 1 END AS effects, CASE WHEN l_linestatus = 'O' THEN abs(l_quantity - 25) END AS magnitude FROM lineitem) GROUP BY ALL")
def worker_outcomes(spark, sf_dir):
    """B29."""
    o = K.outcome(F.col("l_quantity") - 25, {"length": F.col("l_discount"), "sleeve": F.when(F.col("l_tax") > 0, F.col("l_tax"))}, F.col("l_linestatus") == "O")
    x = table(spark, sf_dir, "lineitem").select(o.alias("o")).select("o.*")
    return x.groupBy("status", "direction", F.size("side_effects").cast("long").alias("effects")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("magnitude"), 4).alias("magnitude"))


@query("distinct_over_columns", "SELECT count(DISTINCT v) AS n FROM (SELECT l_partkey AS v FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)")
def distinct_over_columns(spark, sf_dir):
    """G4."""
    return K.distinct_over(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("split_policy", "WITH " + MANIFEST + " SELECT split, count(*) AS official, CAST(count(*) FILTER (NOT " + _LEAK + ") AS BIGINT) AS controlled, CAST(count(*) FILTER (" + _LEAK + ") AS BIGINT) AS excluded, round(avg(CAST(" + _LEAK + " AS DOUBLE)), 6) AS excluded_share FROM manifest GROUP BY split")
def split_policy(spark, sf_dir):
    """E43."""
    leak = F.expr(_LEAK)
    return manifest(spark, sf_dir, LEAKS).groupBy("split").agg(F.count(F.lit(1)).alias("official"), F.sum((~leak).cast("long")).alias("controlled"), F.sum(leak.cast("long")).alias("excluded"), F.avg(leak.cast("double")).alias("excluded_share")).select("split", "official", "controlled", "excluded", *r6("excluded_share"))
