"""The given tables as inputs of the operators, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import bits_of_hex
from tessera.operators.duplicates import annotate
from tessera.operators.pairs import Measures
from tessera.operators.quality import classify, missing_and_bounds

MEASURES = Measures(body=("body_a", "body_b"), garment=("bust", "length", "sleeve"))
FIELDS = ["bust", "length", "sleeve", "ease", "ease_ratio"]
KEYS = {"person": "person", "cloth": "cloth", "target": "target", "pair": ["person", "cloth"], "record": ["person", "cloth", "target"]}
LEAKING = ["person", "cloth", "target", "pair"]
LEAKS = [f"leakage_{name}" for name in LEAKING]
BOUNDS = {"bust": (2.0, 49.0), "length": (0.0, 10.0), "sleeve": (0.0, 8.0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with what samples take from their order and part, all of it numbers.

    The joins move nothing that can be made of numbers later, and the one by the order comes last, so lines lie by person.
    """
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select(
        F.col("l_orderkey").alias("person"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("cloth"), F.col("l_suppkey").alias("target"),
        F.col("l_quantity").alias("bust"), F.rint(F.col("l_discount") * 100).alias("length"), F.rint(F.col("l_tax") * 100).alias("sleeve"),
    )
    part = t("part").select(F.col("p_partkey").alias("cloth"), F.col("p_size").alias("size"), bits_of_hex(_short_md5("p_name")).alias("fingerprint"))
    order = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(F.col("o_orderkey").alias("person"), "o_custkey")
    return line.join(part, "cloth").join(order, "person")


def _short_md5(name: str) -> Column:
    return F.substring(F.md5(F.col(name).cast("binary")), 1, 15)


def _split() -> Column:
    return F.when((F.col("person") * 7 + F.col("line")) % 21 == 0, "eval").otherwise("train")


def _samples(rows: DataFrame) -> DataFrame:
    """Samples of ``lines``, with any further columns after their own."""
    own = ["person", "line", "cloth", "target", "bust", "length", "sleeve", "size", "fingerprint", "o_custkey"]
    ease = F.col("bust") - F.col("size")
    return rows.select(
        F.concat_ws("/", "person", "line", "cloth", "target").alias("id"), _split().alias("split"), F.concat(F.lit("shard-"), F.col("target") % 20).alias("shard"),
        "person", "cloth", "target", F.lpad(F.lower(F.hex("fingerprint")), 15, "0").alias("hash"), (F.col("o_custkey") % 60).cast("double").alias("body_a"), (F.col("person") * 13 % 40).cast("double").alias("body_b"),
        "bust", "length", "sleeve", ease.alias("ease"), F.try_divide(ease, F.col("size").cast("double")).alias("ease_ratio"), "fingerprint", *(c for c in rows.columns if c not in own),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as samples: person = order, cloth = part, target = supplier, measures from quantity, discount, tax."""
    return _samples(lines(spark, sf_dir))


def manifest(spark: SparkSession, sf_dir: str, flags: list[str] | None = None) -> DataFrame:
    """Samples with quality tiers, duplicate and leakage flags: all, or those of ``flags``."""
    rules = missing_and_bounds(BOUNDS)
    doubtful = [("extreme_ease", ~F.col("ease").between(-40.0, 40.0)), ("extreme_ease_ratio", ~F.col("ease_ratio").between(-0.9, 20.0))]
    flagged = annotate(lines(spark, sf_dir), KEYS, _split(), leaks=LEAKING, flags=flags)
    return classify(_samples(flagged), rules, [], doubtful, [("sleeveless", F.col("sleeve") == 0)])


SAMPLES = """
samples AS (
  SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 21 = 0 THEN 'eval' ELSE 'train' END AS split, 'shard-' || (l_suppkey % 20) AS shard,
    l_orderkey AS person, l_partkey AS cloth, l_suppkey AS target, substr(md5(p_name), 1, 15) AS hash, CAST(o_custkey % 60 AS DOUBLE) AS body_a, CAST(o_orderkey * 13 % 40 AS DOUBLE) AS body_b,
    l_quantity AS bust, round_even(l_discount * 100, 0) AS length, round_even(l_tax * 100, 0) AS sleeve, l_quantity - p_size AS ease, (l_quantity - p_size) / CAST(p_size AS DOUBLE) AS ease_ratio,
    CAST('0x' || substr(md5(p_name), 1, 15) AS BIGINT) AS fingerprint
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
)"""

MANIFEST = (
    SAMPLES
    + """, tiered AS (
  SELECT *,
    list_filter([CASE WHEN bust IS NULL THEN 'missing_bust' END, CASE WHEN NOT bust BETWEEN 2 AND 49 THEN 'impossible_bust' END,
      CASE WHEN length IS NULL THEN 'missing_length' END, CASE WHEN NOT length BETWEEN 0 AND 10 THEN 'impossible_length' END,
      CASE WHEN sleeve IS NULL THEN 'missing_sleeve' END, CASE WHEN NOT sleeve BETWEEN 0 AND 8 THEN 'impossible_sleeve' END], lambda x: x IS NOT NULL) AS bad,
    list_filter([CASE WHEN NOT ease BETWEEN -40 AND 40 THEN 'extreme_ease' END, CASE WHEN NOT ease_ratio BETWEEN -0.9 AND 20 THEN 'extreme_ease_ratio' END], lambda x: x IS NOT NULL) AS doubtful,
    list_filter([CASE WHEN sleeve = 0 THEN 'sleeveless' END], lambda x: x IS NOT NULL) AS notes
  FROM samples
), manifest AS MATERIALIZED (
  SELECT * EXCLUDE (bad, doubtful, notes), CASE WHEN len(bad) > 0 THEN 'INVALID' WHEN len(doubtful) > 0 THEN 'SUSPICIOUS' ELSE 'VALID' END AS quality_status,
    CASE WHEN len(bad) > 0 THEN bad || notes ELSE doubtful || notes END AS quality_flags, len(bad) = 0 AS usable,
    count(person) OVER (PARTITION BY person) > 1 AS duplicate_person, count(cloth) OVER (PARTITION BY cloth) > 1 AS duplicate_cloth, count(target) OVER (PARTITION BY target) > 1 AS duplicate_target,
    count(*) OVER (PARTITION BY person, cloth) > 1 AS duplicate_pair, count(*) OVER (PARTITION BY person, cloth, target) > 1 AS duplicate_record,
    max(split = 'train') OVER (PARTITION BY person, cloth) AND max(split = 'eval') OVER (PARTITION BY person, cloth) AS leakage_pair,
    max(split = 'train') OVER (PARTITION BY person) AND max(split = 'eval') OVER (PARTITION BY person) AS leakage_person,
    max(split = 'train') OVER (PARTITION BY cloth) AND max(split = 'eval') OVER (PARTITION BY cloth) AS leakage_cloth,
    max(split = 'train') OVER (PARTITION BY target) AND max(split = 'eval') OVER (PARTITION BY target) AS leakage_target
  FROM tiered
)"""
)
