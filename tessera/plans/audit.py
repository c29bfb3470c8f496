"""Queries: manifest, quality, duplicates and leakage, distributions, shift, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.prefix import exact_percentiles
from tessera.operators import duplicates as D
from tessera.operators import quality as Q
from tessera.operators import resampling as R
from tessera.operators import stats as T
from tessera.plans.adapters import FIELDS, KEYS, LEAKING, LEAKS, MANIFEST, SAMPLES, manifest, samples, table
from tessera.plans.catalog import catalog

QUERIES, SQL, query = catalog()


def r6(*names: str) -> list:
    """Columns rounded to six digits, so that the order of a sum does not show."""
    return [F.round(n, 6).alias(n) for n in names]


_DOC_FLAGS = ["duplicate_text", "leakage_text"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", S.finite("n_chars").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.when(F.col("doc_id") % 20 == 0, "eval").otherwise("train").alias("split")
    )
    tiers = Q.classify(docs, Q.missing_and_bounds({"n_chars": (1.0, 50_000.0)}), [], [("short", F.col("n_chars") < 200)], [("not_english", F.col("lang") != "en")])
    return D.annotate(tiers, {"text": "text_sha256"})


_DOC_SQL = """
WITH d AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS n_chars, sha256(coalesce(text, '')) AS text_sha256, CASE WHEN doc_id % 20 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents),
m AS (SELECT *, CASE WHEN n_chars IS NULL OR NOT n_chars BETWEEN 1 AND 50000 THEN 'INVALID' WHEN n_chars < 200 THEN 'SUSPICIOUS' ELSE 'VALID' END AS status,
  count(*) OVER (PARTITION BY text_sha256) > 1 AS duplicate_text, max(split = 'train') OVER (PARTITION BY text_sha256) AND max(split = 'eval') OVER (PARTITION BY text_sha256) AS leakage_text FROM d)
"""


@query("documents_manifest", _DOC_SQL + """SELECT doc_id, text_sha256, split, CASE WHEN status = 'VALID' AND (duplicate_text OR leakage_text) THEN 'SUSPICIOUS' ELSE status END AS quality_status,
  array_to_string(list_filter([CASE WHEN status = 'INVALID' AND n_chars IS NULL THEN 'missing_n_chars' END, CASE WHEN status = 'INVALID' AND n_chars IS NOT NULL THEN 'impossible_n_chars' END,
    CASE WHEN status = 'SUSPICIOUS' THEN 'short' END, CASE WHEN lang <> 'en' THEN 'not_english' END, CASE WHEN duplicate_text THEN 'possible_duplicate' END,
    CASE WHEN leakage_text THEN 'train_eval_leakage' END], lambda x: x IS NOT NULL), ',') AS quality_flags, duplicate_text, leakage_text FROM m""")  # fmt: skip
def documents_manifest(spark, sf_dir):
    """Content hashes, tiers, duplicate and leakage flags of documents."""
    m = D.downgrade(_documents(spark, sf_dir), ["text"])
    return m.select("doc_id", "text_sha256", "split", "quality_status", F.array_join("quality_flags", ",").alias("quality_flags"), *_DOC_FLAGS)


@query("documents_flag_totals", _DOC_SQL + "SELECT 'duplicate_text' AS flag, CAST(count(*) FILTER (duplicate_text) AS BIGINT) AS rows FROM m UNION ALL SELECT 'leakage_text', CAST(count(*) FILTER (leakage_text) AS BIGINT) FROM m")
def documents_flag_totals(spark, sf_dir):
    """E3."""
    return D.flag_totals(_documents(spark, sf_dir), _DOC_FLAGS)


@query("documents_content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, 'text:' || sha256(coalesce(text, '')) AS identity, source || '#text:embedded' AS ref FROM documents")
def documents_content_hash(spark, sf_dir):
    """B4, B5, B8."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("digest"), S.image_identity("text", h).alias("identity"), F.concat("source", F.lit("#text:embedded")).alias("ref"))


@query("sample_manifest", "WITH " + MANIFEST + """SELECT id, split, quality_status, array_to_string(quality_flags, ',') AS quality_flags, usable, duplicate_person, duplicate_cloth, duplicate_target, duplicate_pair, duplicate_record, leakage_person, leakage_cloth, leakage_target, leakage_pair FROM manifest""")
def sample_manifest(spark, sf_dir):
    """C1, C2, E1, E2 on samples."""
    flags = [*(f"duplicate_{k}" for k in KEYS), *(f"leakage_{k}" for k in LEAKING)]
    return manifest(spark, sf_dir).select("id", "split", "quality_status", F.array_join("quality_flags", ",").alias("quality_flags"), "usable", *flags)


@query("manifest_validation", "WITH " + SAMPLES + """SELECT count(*) AS n_rows, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS n_train, CAST(count(*) FILTER (split = 'eval') AS BIGINT) AS n_eval, count(DISTINCT id) AS unique_ids,
  CAST(count(*) FILTER (id IS NULL) AS BIGINT) AS null_ids, CAST(count(*) FILTER (hash IS NOT NULL) AS BIGINT) AS hashed_rows, count(id) - count(DISTINCT id) AS duplicate_ids, count(id) = count(DISTINCT id) AND count(*) = count(id) AS consistent FROM samples""")
def manifest_validation(spark, sf_dir):
    """E4."""
    return D.validate_manifest(samples(spark, sf_dir), "id", "split", ["hash"])


@query("split_overlap", "WITH " + SAMPLES + "SELECT person FROM samples WHERE split = 'train' INTERSECT SELECT person FROM samples WHERE split = 'eval'")
def split_overlap(spark, sf_dir):
    """D8, G1."""
    return D.split_overlap(samples(spark, sf_dir), "person")


@query("controlled_ids", "WITH " + MANIFEST + "SELECT id FROM manifest WHERE split = 'eval' AND NOT (leakage_person OR leakage_cloth OR leakage_target OR leakage_pair)")
def controlled_ids(spark, sf_dir):
    """C11, E43, G2."""
    from tessera.operators.pairs import controlled_ids as controlled

    return controlled(manifest(spark, sf_dir, LEAKS))


@query("excluded_ids", "WITH " + MANIFEST + "SELECT id FROM manifest WHERE split = 'eval' AND (leakage_person OR leakage_cloth OR leakage_target OR leakage_pair)")
def excluded_ids(spark, sf_dir):
    """Official less controlled."""
    from tessera.operators.pairs import controlled_ids as controlled

    m = manifest(spark, sf_dir, LEAKS)
    return m.filter(F.col("split") == "eval").select("id").exceptAll(controlled(m))


@query("unmatched_keys", "SELECT c_custkey AS key, 'right' AS missing_in FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'left' FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def unmatched_keys(spark, sf_dir):
    """Customers without orders and orders without customer."""
    return D.unmatched(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("quality_tiers", "WITH " + MANIFEST + "SELECT split, CAST(count(*) FILTER (quality_status = 'VALID') AS BIGINT) AS VALID, CAST(count(*) FILTER (quality_status = 'SUSPICIOUS') AS BIGINT) AS SUSPICIOUS, CAST(count(*) FILTER (quality_status = 'INVALID') AS BIGINT) AS INVALID FROM manifest GROUP BY split")
def quality_tiers(spark, sf_dir):
    """E12."""
    return Q.tier_table(manifest(spark, sf_dir, []), "split")


@query("flag_ranking", "WITH " + MANIFEST + "SELECT flag, count(*) AS n FROM (SELECT unnest(quality_flags) AS flag FROM manifest) GROUP BY flag")
def flag_ranking(spark, sf_dir):
    """E12, E13, J4."""
    return Q.flag_ranking(manifest(spark, sf_dir, []))


@query("flag_evidence", "WITH " + MANIFEST + "SELECT flag, CAST(rank AS INTEGER) AS rank, id AS key FROM (SELECT flag, id, row_number() OVER (PARTITION BY flag ORDER BY id) AS rank FROM (SELECT id, unnest(quality_flags) AS flag FROM manifest)) WHERE rank <= 5")
def flag_evidence(spark, sf_dir):
    """F3."""
    return Q.evidence(manifest(spark, sf_dir, []), "id").select("flag", "rank", "key")


@query("run_summary", "WITH " + MANIFEST + """SELECT count(*) AS n_rows, count(DISTINCT shard) AS n_shards, CAST(count(*) FILTER (quality_status = 'VALID') AS BIGINT) AS n_valid, CAST(count(*) FILTER (len(list_filter(quality_flags, lambda f: starts_with(f, 'missing_'))) > 0) AS BIGINT) AS missing_measures,
  CAST(count(*) FILTER (len(list_filter(quality_flags, lambda f: starts_with(f, 'extreme_'))) > 0) AS BIGINT) AS extreme, CAST(count(*) FILTER (duplicate_person) AS BIGINT) AS duplicate_person FROM manifest""")
def run_summary(spark, sf_dir):
    """E13, with missing images and missing measures kept apart."""
    m = manifest(spark, sf_dir, ["duplicate_person"])
    having = lambda p: F.sum(F.exists("quality_flags", lambda f: f.startswith(p)).cast("long"))
    return m.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("shard").alias("n_shards"), F.sum((F.col("quality_status") == "VALID").cast("long")).alias("n_valid"), having("missing_").alias("missing_measures"), having("extreme_").alias("extreme"), F.sum(F.col("duplicate_person").cast("long")).alias("duplicate_person"))


_LONG = SAMPLES + ", l AS (UNPIVOT (SELECT split, bust, length, sleeve, ease, ease_ratio FROM samples) ON bust, length, sleeve, ease, ease_ratio INTO NAME field VALUE value)"
_PCT = ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(100 * p)}" for p in T.PERCENTILES)


@query("distribution", "WITH " + _LONG + f"""SELECT field, coalesce(split, 'ALL') AS part, count(value) AS n, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, {_PCT}, round(max(value), 6) AS max
  FROM l GROUP BY GROUPING SETS ((field), (field, split))""")
def distribution(spark, sf_dir):
    """E5, E6."""
    d = T.distribution(samples(spark, sf_dir), FIELDS, "split")
    return d.select("field", "part", "n", "missing", *r6("mean", "sd", "min", *(f"p{round(100 * p)}" for p in T.PERCENTILES), "max"))


@query("shift", "WITH " + _LONG + """, c AS (SELECT field, value, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'eval') AS b FROM l GROUP BY field, value),
  s AS (SELECT field, value, sum(a) OVER w / sum(a) OVER (PARTITION BY field) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY field) AS fb, lead(value) OVER (PARTITION BY field ORDER BY value) AS nxt, sum(a) OVER (PARTITION BY field) AS na, sum(b) OVER (PARTITION BY field) AS nb
    FROM c WINDOW w AS (PARTITION BY field ORDER BY value))
  SELECT field, round(max(abs(fa - fb)), 6) AS ks, round(sum(abs(fa - fb) * (nxt - value)), 6) AS wasserstein, CAST(any_value(na) AS BIGINT) AS n_train, CAST(any_value(nb) AS BIGINT) AS n_eval FROM s GROUP BY field""")
def shift(spark, sf_dir):
    """E7, E8."""
    return T.shift(samples(spark, sf_dir), FIELDS, "split").select("field", *r6("ks", "wasserstein"), "n_train", "n_eval")


@query("quantization", "WITH " + _LONG + """, v AS (SELECT field, split, round_even(value * 100, 0) / 100 AS v2, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT field, split, n, row_number() OVER (PARTITION BY field, split ORDER BY n DESC, v2) AS r FROM v)
  SELECT field, split, n, raw, at_3dp, at_2dp, at_1dp, CAST(top AS BIGINT) AS top, round(top / n, 6) AS top_share FROM (SELECT field, split, count(*) AS n, count(DISTINCT value) AS raw, count(DISTINCT round_even(value * 1000, 0) / 1000) AS at_3dp, count(DISTINCT round_even(value * 100, 0) / 100) AS at_2dp, count(DISTINCT round_even(value * 10, 0) / 10) AS at_1dp FROM l GROUP BY field, split)
  JOIN (SELECT field, split, sum(n) AS top FROM t WHERE r <= 15 GROUP BY field, split) USING (field, split)""")
def quantization(spark, sf_dir):
    """E9, B12, F2."""
    q = T.quantization(samples(spark, sf_dir), FIELDS, "split")
    return q.select("field", "split", "n", "raw", "at_3dp", "at_2dp", "at_1dp", "top", *r6("top_share"))


@query("preset_verdict", "WITH " + SAMPLES + """, x AS (SELECT ease_ratio AS x FROM samples WHERE ease_ratio IS NOT NULL), a AS (SELECT count(*) AS n, count(DISTINCT x) AS n_raw, count(DISTINCT round_even(x * 100, 0) / 100) AS n_2dp, count(DISTINCT round_even(x * 10, 0) / 10) AS n_1dp,
  avg(CAST(abs(round_even(x / 0.05, 0) * 0.05 - x) < 1e-6 AS DOUBLE)) AS on_005, avg(CAST(abs(round_even(x / 0.1, 0) * 0.1 - x) < 1e-6 AS DOUBLE)) AS on_010, CAST(count(*) FILTER (x < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (x = 0) AS BIGINT) AS zero, CAST(count(*) FILTER (x > 0) AS BIGINT) AS positive FROM x),
  t AS (SELECT max(n) AS top2, sum(n) AS top10 FROM (SELECT count(*) AS n FROM x GROUP BY round_even(x * 100, 0) ORDER BY n DESC LIMIT 10)), u AS (SELECT max(n) AS top1 FROM (SELECT count(*) AS n FROM x GROUP BY round_even(x * 10, 0)))
  SELECT n, n_raw, n_2dp, n_1dp, round(on_005, 6) AS on_005, round(on_010, 6) AS on_010, negative, zero, positive, round(top10 / n, 6) AS concentration,
    CASE WHEN n_1dp <= 12 OR top2 / n >= 0.15 OR top10 / n >= 0.45 OR top1 / n >= 0.3 THEN 'likely_quantized_preset_levels' WHEN on_010 > 0.25 THEN 'moderate_quantization_0.10_steps' ELSE 'likely_continuous' END AS verdict FROM a, t, u""")
def preset_verdict(spark, sf_dir):
    """E10, B13."""
    v = T.preset_verdict(samples(spark, sf_dir), "ease_ratio")
    return v.select("n", "n_raw", "n_2dp", "n_1dp", *r6("on_005", "on_010"), "negative", "zero", "positive", *r6("concentration"), "verdict")


@query("histogram", "WITH " + SAMPLES + ", e AS (SELECT min(ease) AS lo, max(ease) AS hi FROM samples) SELECT split, CAST(least(floor((ease - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM samples, e GROUP BY 1, 2")
def histogram(spark, sf_dir):
    """A18."""
    return T.histogram(samples(spark, sf_dir), "ease", 50, ["split"])


@query("group_sizes", "WITH " + SAMPLES + ", g AS (SELECT count(*) AS size FROM samples GROUP BY person) SELECT count(*) AS groups, CAST(sum(size) AS BIGINT) AS rows, CAST(count(*) FILTER (size > 1) AS BIGINT) AS several, min(size) AS least, quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.9) AS p90, quantile_cont(size, 0.99) AS p99, max(size) AS most FROM g")
def group_sizes(spark, sf_dir):
    """E14."""
    return T.group_sizes(samples(spark, sf_dir), ["person"])


@query("size_histogram", "WITH " + SAMPLES + " SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM samples GROUP BY person) GROUP BY size ORDER BY size LIMIT 20")
def size_histogram(spark, sf_dir):
    """The first twenty sizes of groups."""
    return T.size_histogram(samples(spark, sf_dir), ["person"])


@query("rounded_counts", "WITH " + _LONG + " SELECT field, round_even(value, 1) + 0.0 AS value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2")
def rounded_counts(spark, sf_dir):
    """Counts per value of one decimal."""
    return T.long_form(samples(spark, sf_dir), FIELDS, []).filter("value IS NOT NULL").groupBy("field", (S.half_even("value", 1) + 0.0).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("tier_shares", "WITH " + MANIFEST + " SELECT split, quality_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM manifest GROUP BY split, quality_status")
def tier_shares(spark, sf_dir):
    """Shares of the tiers by split."""
    n = manifest(spark, sf_dir, []).groupBy("split", "quality_status").agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("split").agg(F.sum("n").alias("t"))
    return n.join(F.broadcast(whole), "split").select("split", "quality_status", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("findings", "WITH " + MANIFEST + """, x AS (SELECT CAST(count(*) FILTER (sleeve = 0) AS DOUBLE) AS zero, avg(CAST(quality_status = 'INVALID' AS DOUBLE)) AS invalid, quantile_cont(ease, 0.5) FILTER (split = 'train') AS a, quantile_cont(ease, 0.5) FILTER (split = 'eval') AS b, quantile_cont(body_a, 0.5) FILTER (split = 'train') AS c, quantile_cont(body_a, 0.5) FILTER (split = 'eval') AS d,
  """ + ", ".join(f"avg(CAST({f} IS NULL AS DOUBLE)) AS m_{f}" for f in ("bust", "length", "sleeve")) + """ FROM manifest), f AS (SELECT unnest([struct_pack(finding := 'sleeve_zero', figure := zero, found := zero > 0), struct_pack(finding := 'invalid_rate', figure := invalid, found := invalid > 0.01),
  struct_pack(finding := 'shift_ease', figure := abs(a - b) / nullif(abs(a), 0), found := coalesce(abs(a - b) / nullif(abs(a), 0) > 0.05, false)), struct_pack(finding := 'shift_body_a', figure := abs(c - d) / nullif(abs(c), 0), found := coalesce(abs(c - d) / nullif(abs(c), 0) > 0.05, false)), """ + ", ".join(
    f"struct_pack(finding := 'missing_{f}', figure := m_{f}, found := m_{f} > 0)" for f in ("bust", "length", "sleeve")) + "], recursive := true) FROM x) SELECT finding, round(figure, 6) AS figure, found FROM f")
def findings(spark, sf_dir):
    """Zeros, missing measures, medians that move between the splits, and the share of invalid rows."""
    m = manifest(spark, sf_dir, []).select("split", "sleeve", "bust", "length", "ease", "body_a", "quality_status")
    return T.findings(m, "split", zero="sleeve", measures=["bust", "length", "sleeve"], medians=["ease", "body_a"])


@query("top_levels", "WITH " + SAMPLES + "SELECT value, n FROM (SELECT round_even(ease_ratio * 10, 0) / 10 + 0.0 AS value, count(*) AS n FROM samples GROUP BY 1) ORDER BY n DESC, value LIMIT 20")
def top_levels(spark, sf_dir):
    """F2."""
    return T.top_values(samples(spark, sf_dir), S.half_even("ease_ratio", 1), 20)


@query("grid_share", "WITH " + _LONG + "SELECT field, " + ", ".join(f"round(avg(CAST(abs(value / {s} - round_even(value / {s}, 0)) <= 1e-8 AS DOUBLE)), 6) AS on_{str(s).replace('.', '_')}" for s in (0.05, 0.1, 0.25, 0.5)) + ", round(avg(CAST(abs(value - round_even(value, 0)) <= 1e-8 AS DOUBLE)), 6) AS on_1 FROM l GROUP BY field")
def grid_share(spark, sf_dir):
    """E20."""
    steps = [0.05, 0.1, 0.25, 0.5, 1.0]
    return T.grid_share(samples(spark, sf_dir), FIELDS, steps).select("field", *r6(*(f"on_{s:g}".replace(".", "_") for s in steps)))


@query("missing_rates", "WITH " + _LONG + "SELECT field, count(*) - count(value) AS missing, round(quantile_cont(value, 0.5), 6) AS median FROM l GROUP BY field")
def missing_rates(spark, sf_dir):
    """E27."""
    counts = T.value_counts(samples(spark, sf_dir), FIELDS, [])
    missing = counts.groupBy("field").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"))
    return missing.join(exact_percentiles(counts, ["field"], "value", "n", (0.5,), ["median"]), "field", "left").select("field", "missing", *r6("median"))


@query("readiness", "WITH " + MANIFEST + """, x AS (SELECT count(*) AS n, avg(CAST(usable AS DOUBLE)) AS usable_rate, CAST(count(*) FILTER (leakage_person OR leakage_cloth OR leakage_target OR leakage_pair) AS BIGINT) AS leaks FROM manifest)
  SELECT n, round(usable_rate, 6) AS usable_rate, leaks, CASE WHEN n >= 50000 AND usable_rate >= 0.98 THEN 'GO' WHEN n >= 50000 AND usable_rate >= 0.9 THEN 'PARTIAL' WHEN n >= 25000 AND usable_rate >= 0.85 THEN 'PARTIAL' ELSE 'NO-GO' END AS decision,
  array_to_string(list_filter([CASE WHEN n < 50000 THEN 'incomplete' END, CASE WHEN usable_rate < 0.95 THEN 'low_usable_rate' END, CASE WHEN leaks > 100 THEN 'leakage' END], lambda b: b IS NOT NULL), ',') AS blockers FROM x""")
def readiness(spark, sf_dir):
    """Decision and blockers from one row of metrics; sizes and rates are parameters."""
    leak = F.col("leakage_person") | F.col("leakage_cloth") | F.col("leakage_target") | F.col("leakage_pair")
    x = manifest(spark, sf_dir, LEAKS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("usable").cast("double")).alias("rate"), F.sum(leak.cast("long")).alias("leaks"))
    n, r = F.col("n"), F.col("rate")
    decision = F.when((n >= 50000) & (r >= 0.98), "GO").when((n >= 50000) & (r >= 0.9), "PARTIAL").when((n >= 25000) & (r >= 0.85), "PARTIAL").otherwise("NO-GO")
    blockers = S.flags([("incomplete", n < 50000), ("low_usable_rate", r < 0.95), ("leakage", F.col("leaks") > 100)])
    return x.select("n", F.round("rate", 6).alias("usable_rate"), "leaks", decision.alias("decision"), F.array_join(blockers, ",").alias("blockers"))


@query("auroc", "WITH s AS (SELECT n_chars AS s, quality = 1 AS y FROM labels JOIN documents USING (doc_id)), c AS (SELECT s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM s GROUP BY s), w AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg / 2 AS below FROM c) SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, round(sum(pos * below) / (sum(pos) * sum(neg)), 6) AS auroc FROM w")
def auroc(spark, sf_dir):
    """E35."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return T.auroc(j, "n_chars", F.col("quality") == 1).select("positives", "negatives", F.round("auroc", 6).alias("auroc"))


@query("risk_coverage", """WITH s AS (SELECT doc_id, n_chars, quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r, count(*) OVER () AS n FROM labels JOIN documents USING (doc_id)), p AS (SELECT CAST(floor(r / greatest(1, n // 10)) AS INTEGER) AS slot, n, sum(quality) AS ok, count(*) AS m FROM s GROUP BY ALL),
  q AS (SELECT slot, n, sum(m) OVER w AS kept, sum(ok) OVER w AS hits FROM p WINDOW w AS (ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT slot, round(kept / n, 6) AS coverage, round(hits / kept, 6) AS selective_accuracy, round(1 - kept / n, 6) AS abstention_rate FROM q""")
def risk_coverage(spark, sf_dir):
    """E34."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return T.risk_coverage(j, "n_chars", "doc_id", F.col("quality") == 1).select("slot", *r6("coverage", "selective_accuracy", "abstention_rate"))


@query("purity", "WITH j AS (SELECT n_chars // 500 AS k, quality AS y, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT round(avg(p), 6) AS purity, count(*) AS keys FROM (SELECT k, max(n) / sum(n) AS p FROM j GROUP BY k)")
def purity(spark, sf_dir):
    """E26."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return T.purity(j, F.floor(F.col("n_chars") / 500), "quality").select(F.round("purity", 6).alias("purity"), "keys")


@query("errors", "SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mae, round(sqrt(avg(pow(l_extendedprice - l_quantity * 1000, 2))), 4) AS rmse FROM lineitem GROUP BY l_returnflag")
def errors(spark, sf_dir):
    """E36."""
    e = T.errors(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1000, ["l_returnflag"])
    return e.select("l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("sign_rate", "SELECT count(*) AS n, round(avg(l_discount - l_tax), 6) AS mean_difference, round(avg(CAST(l_discount > l_tax AS DOUBLE)), 6) AS win_rate, round(avg(CAST(l_discount = l_tax AS DOUBLE)), 6) AS tie_rate FROM lineitem")
def sign_rate(spark, sf_dir):
    """E30."""
    return T.sign_rate(table(spark, sf_dir, "lineitem"), F.col("l_discount"), F.col("l_tax")).select("n", *r6("mean_difference", "win_rate", "tie_rate"))


@query("wilson", """WITH r AS (SELECT lang, CAST(sum(quality) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, round((h / n + 1.959963984540054 ^ 2 / (2 * n)) / (1 + 1.959963984540054 ^ 2 / n) - 1.959963984540054 * sqrt(h / n * (1 - h / n) / n + 1.959963984540054 ^ 2 / (4 * n * n)) / (1 + 1.959963984540054 ^ 2 / n), 6) AS low,
  round((h / n + 1.959963984540054 ^ 2 / (2 * n)) / (1 + 1.959963984540054 ^ 2 / n) + 1.959963984540054 * sqrt(h / n * (1 - h / n) / n + 1.959963984540054 ^ 2 / (4 * n * n)) / (1 + 1.959963984540054 ^ 2 / n), 6) AS high FROM r""")
def wilson(spark, sf_dir):
    """E45."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    r = j.groupBy("lang").agg(F.sum("quality").cast("double").alias("h"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = T.wilson(F.col("h"), F.col("n"))
    return r.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _interval_sql(rows: str, key: str, by: str, m: str, replicates: int, seed: int = 0) -> str:
    """Rows of ``rows`` (a query with a column ``x``) as the mean ``m`` (over x and w) per replicate, and its interval."""
    return (
        f"WITH b AS ({rows}), " + R.weights_sql("b", key, seed, replicates) + f", m AS (SELECT {by}, replicate, {m} AS m FROM (SELECT {by}, replicate, x, w FROM weighted UNION ALL SELECT {by}, 0, x, 1 FROM b) GROUP BY ALL) "
        f"SELECT {by}, max(n) AS n, round(max(m) FILTER (replicate = 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (replicate > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (replicate > 0), 6) AS high "
        f"FROM m JOIN (SELECT {by}, count(x) AS n FROM b GROUP BY {by}) USING ({by}) GROUP BY {by}"
    )


@query("bootstrap", _interval_sql("SELECT doc_id, lang, CAST(quality AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL", "doc_id", "lang", "sum(w * x) / sum(w)", 800))
def bootstrap(spark, sf_dir):
    """800 hashed resamples of the share of good documents per language."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return R.bootstrap(j, F.col("quality"), "doc_id", by=["lang"]).select("lang", "n", *r6("mean", "low", "high"))


_CLOSE = "SELECT o_orderkey, o_orderstatus, o_totalprice - 20000 AS x FROM orders"


@query("bootstrap_errors", f"SELECT 'mae' AS figure, * FROM ({_interval_sql(_CLOSE, 'o_orderkey', 'o_orderstatus', 'sum(w * abs(x)) / sum(w)', 800)}) UNION ALL SELECT 'rmse', * FROM ({_interval_sql(_CLOSE, 'o_orderkey', 'o_orderstatus', 'sqrt(sum(w * x * x) / sum(w))', 800)})")
def bootstrap_errors(spark, sf_dir):
    """Intervals of the mean error of a constant price per order status, and, with a statistic of our own, of its root mean square."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", (F.col("o_totalprice") - 20000).alias("e"))
    mae = R.bootstrap(rows, F.abs("e"), "o_orderkey", by=["o_orderstatus"])
    rmse = R.bootstrap(rows, F.col("e"), "o_orderkey", by=["o_orderstatus"], sums=lambda x: {"xx": x * x}, statistic=lambda: F.sqrt(F.try_divide("xx", "weight")))
    return mae.withColumn("figure", F.lit("mae")).unionByName(rmse.withColumn("figure", F.lit("rmse"))).select("figure", "o_orderstatus", "n", *r6("mean", "low", "high"))


@query("bootstrap_ladders", "WITH b AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (l_discount > l_tax) AS hits, count(l_discount > l_tax) AS rows FROM lineitem GROUP BY ALL), " + R.weights_sql("b", "l_suppkey", 0, 10_000) + """,
  m AS (SELECT l_returnflag, replicate, sum(w * hits) / sum(w * rows) AS m FROM (SELECT l_returnflag, replicate, hits, rows, w FROM weighted UNION ALL SELECT l_returnflag, 0, hits, rows, 1 FROM b) GROUP BY ALL)
  SELECT l_returnflag, (SELECT CAST(sum(rows) AS BIGINT) FROM b WHERE b.l_returnflag = m.l_returnflag) AS n, round(max(m) FILTER (replicate = 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (replicate > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (replicate > 0), 6) AS high FROM m GROUP BY l_returnflag""")
def bootstrap_ladders(spark, sf_dir):
    """10,000 resamples of whole clusters, here suppliers: their rows share a weight, and are added up before they are weighed."""
    won = (F.col("l_discount") > F.col("l_tax")).cast("double")
    clusters = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(won).alias("hits"), F.count(won).alias("rows"))
    figures = R.replicate_sums(clusters, "l_suppkey", {"hits": F.col("hits"), "rows": F.col("rows")}, 10_000, by=["l_returnflag"]).withColumn("mean", F.try_divide("hits", "rows"))
    whole = clusters.groupBy("l_returnflag").agg(F.sum("rows").alias("n"))
    return whole.join(R.intervals(figures, "mean", ["l_returnflag"]), "l_returnflag").select("l_returnflag", "n", *r6("mean", "low", "high"))


_MODEL_ROWS = "SELECT l_orderkey * 8 + l_linenumber AS k, l_quantity AS a, l_tax * 100 AS b, l_extendedprice / 1000 AS y, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM lineitem"


@query("model_ladder", "WITH r AS (" + _MODEL_ROWS + "), " + """u AS (SELECT * FROM r WHERE part = 'train'), v AS (SELECT * FROM r WHERE part = 'test'),
  tw AS (SELECT * FROM (WITH """ + R.weights_sql("u", "k", 0, 200) + """ SELECT replicate, a, b, y, w FROM weighted) UNION ALL SELECT 0, a, b, y, 1 FROM u),
  vw AS (SELECT * FROM (WITH """ + R.weights_sql("v", "k", 1, 200) + """ SELECT replicate, a, b, y, w FROM weighted) UNION ALL SELECT 0, a, b, y, 1 FROM v),
  c AS (SELECT replicate, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb, sum(w * y) / sum(w) AS my FROM tw GROUP BY 1),
  g AS (SELECT replicate, ma, mb, my, sum(w * (a - ma) * (a - ma)) AS aa, sum(w * (a - ma) * (b - mb)) AS ab, sum(w * (b - mb) * (b - mb)) AS bb, sum(w * (a - ma) * (y - my)) AS ay, sum(w * (b - mb) * (y - my)) AS b_y FROM tw JOIN c USING (replicate) GROUP BY ALL),
  s AS (SELECT replicate, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS p, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS q, ma, mb, my FROM g),
  m AS (SELECT 'identity' AS model, replicate, sum(w * abs(y - a)) / sum(w) AS m FROM vw GROUP BY replicate UNION ALL SELECT 'ols', replicate, sum(w * abs(y - my - p * (a - ma) - q * (b - mb))) / sum(w) FROM vw JOIN s USING (replicate) GROUP BY replicate)
  SELECT model, round(max(m) FILTER (replicate = 0), 6) AS mae, round(quantile_cont(m, 0.025) FILTER (replicate > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (replicate > 0), 6) AS high FROM m GROUP BY model""")
def model_ladder(spark, sf_dir):
    """The identity and least squares, refitted in every resample, with intervals of their mean error."""
    part = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("a"), (F.col("l_tax") * 100).alias("b"), (F.col("l_extendedprice") / 1000).alias("y"), part.alias("part"))
    return R.model_ladder(rows, "k", "part", F.col("y"), {"ols": {"a": F.col("a"), "b": F.col("b")}}, {"identity": F.col("a")}, 200).select("model", *r6("mae", "low", "high"))


@query("shard_trend", """WITH h AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS h, avg(value) AS v FROM events GROUP BY 1), s AS (SELECT h, v, row_number() OVER (ORDER BY h) AS i, count(*) OVER () AS n, lag(v) OVER (ORDER BY h) AS was FROM h)
  SELECT count(*) AS n, round(regr_slope(v, h), 6) AS slope, round(regr_r2(v, h), 6) AS r2, round(avg(v) FILTER (i <= 30), 6) AS first_mean, round(avg(v) FILTER (i > n - 30), 6) AS last_mean, round(stddev_pop(v), 6) AS sd, round(max(v) - min(v), 6) AS spread, round(sum(CAST(v > was AS INTEGER)) / count(was), 6) AS up_share FROM s""")
def shard_trend(spark, sf_dir):
    """Hourly means of events as the per-shard metric."""
    h = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600).alias("h")).agg(F.avg("value").alias("v"))
    return T.trend(h, "h", "v").select("n", *r6("slope", "r2", "first_mean", "last_mean", "sd", "spread", "up_share"))


@query("trend_verdict", """WITH h AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS h, avg(value) AS v FROM events GROUP BY 1), s AS (SELECT v, row_number() OVER (ORDER BY h) AS i, count(*) OVER () AS n, lag(v) OVER (ORDER BY h) AS was FROM h),
  r AS (SELECT count(*) AS n, regr_slope(v, i) AS slope, avg(v) FILTER (i > n - 30) - avg(v) FILTER (i <= 30) AS growth, stddev_pop(v) FILTER (i > n - 30) AS last_sd, max(v) FILTER (i > n - 30) - min(v) FILTER (i > n - 30) AS last_spread, avg(CAST(v > was AS DOUBLE)) FILTER (i > n - 29) AS last_up_share FROM s)
  SELECT n, round(slope, 6) AS slope, round(growth, 6) AS growth, round(last_sd, 6) AS last_sd, round(last_spread, 6) AS last_spread, round(last_up_share, 6) AS last_up_share,
    CASE WHEN n < 30 THEN 'INSUFFICIENT_EVIDENCE' WHEN growth > 200 AND slope > 0.3 AND last_up_share > 0.6 THEN 'MONOTONIC_GROWTH' WHEN growth > 100 AND last_sd < 30 AND last_spread < 80 THEN 'POSSIBLE_ALLOCATOR_RETENTION'
      WHEN last_sd < 40 AND last_spread < 100 AND abs(slope) < 0.15 THEN 'STABLE_PLATEAU' WHEN growth > 50 AND last_sd < 50 THEN 'POSSIBLE_ALLOCATOR_RETENTION' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict FROM r""")
def trend_verdict(spark, sf_dir):
    """The verdict on hourly means of events as the per-shard metric."""
    h = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600).alias("h")).agg(F.avg("value").alias("v"))
    return T.trend_verdict(h, "h", "v").select("n", *r6("slope", "growth", "last_sd", "last_spread", "last_up_share"), "verdict")


@query("rolling_mean", "WITH h AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS hour, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, hour, round(avg(v) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS rolling FROM h")
def rolling_mean(spark, sf_dir):
    """F4."""
    from pyspark.sql import Window

    h = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600).alias("hour"), "event_type").agg(F.avg("value").alias("v"))
    return h.select("event_type", "hour", F.round(F.avg("v").over(Window.partitionBy("event_type").orderBy("hour").rowsBetween(-29, 0)), 6).alias("rolling"))
