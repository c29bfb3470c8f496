"""Special functions as column expressions: log-gamma, the incomplete beta function, and binomial tails from it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' approximation for g = 7 with nine terms.
_G = 7.0
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5, to about 14 digits of its size."""
    z = x - 1.0
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (z + float(k))
    t = z + (_G + 0.5)
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 0.5 and 0 <= x <= 1.

    Its continued fraction is taken by Lentz's method on the side where it converges, which takes a number of steps in
    the order of the root of the larger parameter: as many are taken, whatever the parameters.  A null gives null.
    """
    left = x < (a + 1.0) / (a + b + 2.0)
    # The fraction is that of (x, a, b), or of (1 - x, b, a) beyond the turning point.
    u, p, q = F.when(left, x).otherwise(1.0 - x), F.when(left, a).otherwise(b), F.when(left, b).otherwise(a)
    away = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(s: Column, term: Column) -> Column:
        d = 1.0 / away(1.0 + term * s["d"])
        c = away(1.0 + term / s["c"])
        return state(c, d, s["h"] * (d * c))

    def step(s: Column, i: Column) -> Column:
        # Terms come in turns: odd places have the one form, even ones the other.
        m = F.floor((i + 1) / 2).cast("double")
        even = m * (q - m) * u / ((p + 2.0 * m - 1.0) * (p + 2.0 * m))
        odd = -(p + m) * (p + q + m) * u / ((p + 2.0 * m) * (p + 2.0 * m + 1.0))
        return half(s, F.when(i % 2 == 1, even).otherwise(odd))

    first = 1.0 / away(1.0 - (p + q) * u / (p + 1.0))
    steps = (F.ceil(4 * F.sqrt(F.greatest(p, q))) + 60).cast("int") * 2
    fraction = F.aggregate(F.sequence(F.lit(1), steps), state(F.lit(1.0), first, first), step, lambda s: s["h"])
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(u) + q * F.log1p(-u))
    inner = front * fraction / p
    value = F.when(left, inner).otherwise(1.0 - inner)
    return F.when(x <= 0, F.when(x.isNotNull() & a.isNotNull() & b.isNotNull(), 0.0)).when(x >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def binomial_upper(hits: Column, n: Column, p: float) -> Column:
    """P(X >= hits) of a binomial with any n: 1 for hits <= 0, 0 for hits > n, null for a null."""
    k, m = hits.cast("double"), n.cast("double")
    tail = incomplete_beta(F.lit(float(p)), F.greatest(k, F.lit(1.0)), F.greatest(m - k + 1.0, F.lit(1.0)))
    return F.when(k.isNull() | m.isNull(), None).when(k <= 0, 1.0).when(k > m, 0.0).otherwise(tail)
