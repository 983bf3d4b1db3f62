"""Statistics as Column expressions: log-gamma, incomplete beta, moderated logarithms, Fisher's exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7, n = 9.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """ln gamma for x > 0, by Lanczos' approximation of gamma(x + 1)."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (x + k)
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.ln(t) - t + F.ln(total)


def log_factorial(n: Column) -> Column:
    """F15."""
    return log_gamma(n + 1.0)


def _series(a: Column, b: Column, x: Column) -> Column:
    """For x <= (a + 1) / (a + b + 2), with as many terms as make the last one e^-40 of the first at most.

    Term k + 1 is term k by 1 - (d + k (1 - x)) / (a + 1 + k), d = a + 1 - x (a + b) > 0, so that the logarithm of term
    n is -(n d + n (n - 1) (1 - x) / 2) / (a + n) at most; n grows with the root of the counts.
    """
    front = F.exp(a * F.ln(x) + b * F.log1p(-x) - F.ln(a) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    rest = F.greatest(1 - x, F.lit(1e-9))
    half = a + 1 - x * (a + b) - rest / 2 - 40
    terms = F.ceil((F.sqrt(half * half + 80 * rest * a) - half) / rest) + 1
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), terms), zero, lambda acc, k: F.struct((acc["term"] * x * (a + b + k) / (a + 1 + k)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")), lambda acc: acc["sum"])
    return front * total


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function; 1 for a of 0 and 0 for b of 0."""
    direct = x <= (a + 1) / (a + b + 2)
    inner = F.when(direct, _series(a, b, x)).otherwise(1 - _series(b, a, 1 - x))
    return F.when(a < 1e-15, 1.0).when(b < 1e-15, 0.0).otherwise(F.least(F.greatest(inner, F.lit(0.0)), F.lit(1.0)))


def proportion_at_least(x: Column, n: Column, q: float) -> Column:
    """G1: posterior probability that a proportion is q at least, after x of n (both with priors added)."""
    return incomplete_beta(n - x, x.cast("double"), F.lit(1.0 - q))


def glog2(x: Column, moderation: float) -> Column:
    """R2: log2((x + sqrt(x^2 + 4 m^2)) / 2)."""
    return F.log2((x + F.sqrt(x * x + 4 * moderation**2)) / 2)


def fisher_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """G14 for 2x2: two-sided exact p of a table [[a, b], [c, d]]: the sum over tables of the same margins as likely or less.

    Likelihoods follow from one table to the next by their ratio and are normalised by their sum, in two passes, so
    that rounding does not grow with the totals. Only tables within 40 standard deviations and 40 of the expected one
    are visited, so that the work grows with the root of the counts; what lies beyond is below 1e-100, and so is then p,
    which is given as 0.
    """
    n = a + b + c + d
    middle = (a + b) * (a + c) / n
    reach = 40 * F.sqrt(middle * (c + d) / n * (b + d) / F.greatest(F.lit(1.0), n - 1)) + 40
    first, last = F.greatest(F.lit(0), a - d, F.floor(middle - reach)), F.least(a + b, a + c, F.ceil(middle + reach))
    every = F.sequence(first.cast("bigint"), last.cast("bigint"))

    def following(log_p, x):
        return F.when(x < last, log_p + F.ln((a + b - x) * (a + c - x) / ((x + 1.0) * (d - a + x + 1.0)))).otherwise(log_p)

    zero = F.lit(0.0)
    start = F.struct(zero.alias("at"), zero.alias("top"), zero.alias("seen"))
    scale = F.aggregate(every, start, lambda s, x: F.struct(following(s["at"], x).alias("at"), F.greatest(s["top"], s["at"]).alias("top"), F.when(x == a, s["at"]).otherwise(s["seen"]).alias("seen")))

    def add(s, x):
        p = F.exp(s["at"] - s["scale"]["top"])
        return F.struct(s["scale"].alias("scale"), following(s["at"], x).alias("at"), (s["all"] + p).alias("all"), (s["low"] + F.when(s["at"] <= s["scale"]["seen"] + 1e-6, p).otherwise(0.0)).alias("low"))

    start = F.struct(scale.alias("scale"), zero.alias("at"), zero.alias("all"), zero.alias("low"))
    return F.when(n > 0, F.when((a < first) | (a > last), 0.0).otherwise(F.aggregate(every, start, add, lambda s: s["low"] / s["all"]))).otherwise(1.0)
