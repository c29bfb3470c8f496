"""Special functions against plain Python, and binomial tails against exact fractions."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions.special import binomial_upper, incomplete_beta, log_gamma


def exact(hits, n, p):
    return float(sum(Fraction(math.comb(n, k)) * p**k * (1 - p) ** (n - k) for k in range(max(hits, 0), n + 1)))


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 1e6, 1e12]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12) for r, x in zip(got, xs, strict=True))


@pytest.mark.parametrize("p", [Fraction(1, 6), Fraction(1, 2), Fraction(99, 100)])
def test_binomial_tails(spark, p):
    cases = [(0, 0), (-1, 5), (0, 5), (5, 5), (6, 5), (1, 1), (2, 3), (40, 60), (400, 600), (100, 600), (590, 600), (35, 300), (1, 1000), (1000, 1000)]
    got = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(cases)], "i int, k bigint, n bigint").select("i", binomial_upper(F.col("k"), F.col("n"), float(p)).alias("p")).orderBy("i").collect()
    for r, (k, n) in zip(got, cases, strict=True):
        assert r.p == pytest.approx(exact(k, n, p), rel=1e-9, abs=1e-300), (k, n)


def test_many_trials(spark):
    cases = [(1667, 10_000), (1800, 10_000), (1500, 10_000), (5000, 10_000)]
    got = spark.createDataFrame(cases, "k bigint, n bigint").select(binomial_upper(F.col("k"), F.col("n"), 1 / 6).alias("p")).collect()
    ln = lambda k, n: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(1 / 6) + (n - k) * math.log(5 / 6)
    for r, (k, n) in zip(got, cases, strict=True):
        assert r.p == pytest.approx(math.fsum(math.exp(ln(j, n)) for j in range(k, n + 1)), rel=1e-8)
    # A million trials: three deviations above the mean.
    n = 10**6
    k = round(n / 6 + 3 * math.sqrt(n * 5 / 36))
    r = spark.createDataFrame([(k, n)], "k bigint, n bigint").select(binomial_upper(F.col("k"), F.col("n"), 1 / 6).alias("p")).first()
    assert r.p == pytest.approx(math.fsum(math.exp(ln(j, n)) for j in range(k, k + 20_000)), rel=1e-6)


def test_nulls_and_ends(spark):
    d = spark.createDataFrame([(None, 3), (3, None), (2, 4)], "k bigint, n bigint")
    assert [r.p for r in d.select(binomial_upper(F.col("k"), F.col("n"), 0.5).alias("p")).collect()] == [None, None, pytest.approx(11 / 16)]
    x = spark.createDataFrame([(0.0,), (1.0,), (0.3,)], "x double").select(incomplete_beta(F.col("x"), F.lit(2.0), F.lit(5.0)).alias("i")).collect()
    assert [r.i for r in x] == [0.0, 1.0, pytest.approx(0.579825, abs=1e-9)]
