"""Queries: linear learners, whose normal equations SQL can solve too, and the verdict that rests on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scratch import cut
from tessera.operators import lattice as L
from tessera.operators import models as M
from tessera.operators import splits as G
from tessera.operators import stats as T
from tessera.plans.adapters import SAMPLES, table
from tessera.plans.audit import r6
from tessera.plans.catalog import catalog
from tessera.plans.learning import _rows
from tessera.plans.pairing import _TRANS, _transitions

QUERIES, SQL, query = catalog()


def solved(name: str, rows: str, x: list[str], y: str, penalty: float) -> str:
    """CTEs that solve the normal equations of ``y`` on ``x`` (the last, the intercept, without penalty) by elimination;
    the last one is ``name`` with the weights w0, w1, .."""
    k = len(x)
    first = [f"sum({a} * {b}){f' + {penalty}' if i == j < k - 1 else ''} AS a{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x)] + [f"sum({a} * {y}) AS a{i}_{k}" for i, a in enumerate(x)]
    steps = [f"{name}_0 AS (SELECT {', '.join(first)} FROM {rows} WHERE part = 'train')"]
    for p in range(k):
        cells = [f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i in range(k) for j in range(p + 1, k + 1)]
        steps.append(f"{name}_{p + 1} AS (SELECT {', '.join(cells)} FROM {name}_{p})")
    return ", ".join([*steps, f"{name} AS (SELECT {', '.join(f'a{i}_{k} AS w{i}' for i in range(k))} FROM {name}_{k})"])


_FEATURES = ["bust", "length", "sleeve", "body_a"]
_PARTS = SAMPLES + ", r AS (SELECT bust, length, sleeve, body_a, ease, CASE WHEN person % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM samples)"


@query("ols_baseline", "WITH " + _PARTS + ", " + solved("s", "r", [*_FEATURES, "1.0"], "ease", 0.0) + " SELECT " + ", ".join(f"round(w{i}, 5) + 0.0 AS {n}" for i, n in enumerate([*_FEATURES, "intercept"])) + " FROM s")
def ols_baseline(spark, sf_dir):
    """H4: weights of four features in closed form."""
    w = G.ridge_weights(_rows(spark, sf_dir).filter("part = 'train'"), _FEATURES, "ease", 0.0)
    return spark.createDataFrame([tuple(round(v, 5) + 0.0 for v in w)], ", ".join(f"{n} double" for n in [*_FEATURES, "intercept"]))


_Z = ", m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in _FEATURES) + " FROM r WHERE part = 'train'), z AS (SELECT " + ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in _FEATURES) + ", ease, part FROM r, m)"
_ERROR = "ease - (" + " + ".join(f"w{i} * {f}" for i, f in enumerate(_FEATURES)) + " + w4)"


@query("linear_baselines", "WITH " + _PARTS + _Z + ", " + solved("s", "z", [*_FEATURES, "1.0"], "ease", 0.0) + ", " + solved("g", "z", [*_FEATURES, "1.0"], "ease", 1.0) + " " + " UNION ALL ".join(f"SELECT part, '{n}' AS model, count(*) AS n, round(avg(abs({_ERROR})), 5) AS mae, round(sqrt(avg(({_ERROR}) ^ 2)), 5) AS rmse FROM z, {c} GROUP BY part" for c, n in (("s", "ols"), ("g", "ridge"))))
def linear_baselines(spark, sf_dir):
    """H4, H5: errors of OLS and of ridge on standardised features, per part."""
    rows = _rows(spark, sf_dir)
    both = M.linear(rows, _FEATURES, "ease", "part").unionByName(M.linear(rows, _FEATURES, "ease", "part", alpha=1.0))
    return both.select("part", "model", "n", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"))


_SETS = {"size": ["a"], "language": ["b"], "style": ["c", "d"], "all": ["a", "b", "c", "d"]}
_DOCS = "r AS (SELECT ln(1 + n_chars) AS a, CAST(lang = 'en' AS DOUBLE) AS b, ln(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', ''))) AS c, ln(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), '.', ''))) AS d, CAST(quality AS DOUBLE) AS y, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND lang IS NOT NULL)"
_FITS = "WITH " + _DOCS + ", " + ", ".join(solved(f"f_{n}", "r", [*x, "1.0"], "y", 0.01) for n, x in _SETS.items()) + ", acc AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS features, part, count(*) AS n, CAST(count(*) FILTER ((" + " + ".join(f"w{i} * {f}" for i, f in enumerate(x)) + f" + w{len(x)} >= 0.5) = (y = 1)) AS DOUBLE) AS h FROM r, f_{n} GROUP BY part" for n, x in _SETS.items()) + "), ci AS (SELECT features, part, n, h / n AS accuracy, " + ", ".join(
    f"(h / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) {s} 1.959963984540054 * sqrt(h / n * (1 - h / n) / n + 3.841458820694124 / (4.0 * n * n)) / (1 + 3.841458820694124 / n) AS {c}" for s, c in (("-", "low"), ("+", "high"))) + " FROM acc)"


def _accuracies(spark, sf_dir):
    """Accuracy and Wilson interval of the thresholded ridge fit, per set of features and part."""
    text = F.coalesce("text", F.lit(""))
    without = lambda c: F.log1p((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double"))
    docs = table(spark, sf_dir, "documents").filter("n_chars IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("a"), (F.col("lang") == "en").cast("double").alias("b"), without(" ").alias("c"), without(".").alias("d"))
    part = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    rows = cut(table(spark, sf_dir, "labels").join(docs, "doc_id").select("a", "b", "c", "d", F.col("quality").cast("double").alias("y"), part.alias("part")))
    out = None
    for name, features in _SETS.items():
        one = G.ridge_accuracy(rows, features, "y", "part", 0.01).withColumn("features", F.lit(name))
        out = one if out is None else out.unionByName(one)
    low, high = T.wilson(F.col("accuracy") * F.col("n"), F.col("n").cast("double"))
    return out.select("features", "part", "n", "accuracy", low.alias("low"), high.alias("high"))


@query("ridge_classifier", _FITS + " SELECT features, part, n, round(accuracy, 6) AS accuracy, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def ridge_classifier(spark, sf_dir):
    """H8: ridge least squares on four sets of document features, accuracy and its interval per part."""
    return _accuracies(spark, sf_dir).select("features", "part", "n", *r6("accuracy", "low", "high"))


@query("necessity_verdict", _FITS + ", " + _TRANS + """, b AS (SELECT state, family, arg_max(cloth, (-abs(realized - 5), cloth)) AS best FROM t GROUP BY state, family), p AS (SELECT count(*) AS pairs, CAST(count(*) FILTER (x.best <> y.best) AS BIGINT) AS flips FROM b x JOIN b y USING (state) WHERE x.family = 'N' AND y.family = 'R'),
  v AS (SELECT pairs, flips, s.accuracy AS base, f.accuracy AS whole, f.low > s.high AS separated FROM p, ci s, ci f WHERE s.features = 'size' AND f.features = 'all' AND s.part = 'test' AND f.part = 'test')
  SELECT pairs, flips, round(whole - base, 6) AS gain, separated, pairs >= 8 AND flips >= 1 AND whole > base + 0.02 AND separated AS established, CASE WHEN pairs < 8 THEN 'too_few_pairs' WHEN flips = 0 THEN 'no_flips' WHEN NOT separated THEN 'intervals_overlap' WHEN whole <= base + 0.02 THEN 'no_gain' ELSE 'gain_with_separated_intervals' END AS reason FROM v""")
def necessity_verdict(spark, sf_dir):
    """Do matched pairs flip, and does the whole set of features beat the base set with separated intervals?"""
    t = _transitions(spark, sf_dir).withColumn("u", -F.abs(F.col("realized") - 5))
    flips = L.flip_rate(t, "state", "family", "cloth", "u", "N", "R")
    return L.necessity_verdict(flips, _accuracies(spark, sf_dir).filter("part = 'test'"), "size", "all").select("pairs", "flips", *r6("gain"), "separated", "established", "reason")
