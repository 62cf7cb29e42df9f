"""Densities, distribution functions and derivatives as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """log of the gamma function for x > 0, in the JVM."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (x + k)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.ln(t) - t + F.ln(total)


def log_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def log_neg_binomial(k: Column, r: Column, p: Column) -> Column:
    """log probability of ``k`` failures before ``r`` successes, success having probability 1 - p."""
    return log_choose(k + r - 1, k) + r * F.ln(1 - p) + k * F.ln(p)


def power_minus_one(x: Column, y: Column) -> Column:
    return F.expm1(y * F.ln(x))


def one_plus_power(x: Column, y: Column) -> Column:
    return F.exp(y * F.log1p(x))


# Laplace, by location and scale


def log_laplace(x: Column, loc: Column, scale: Column) -> Column:
    return -F.abs(x - loc) / scale - F.ln(scale) - math.log(2)


def laplace(x: Column, loc: Column, scale: Column) -> Column:
    return F.exp(log_laplace(x, loc, scale))


def d_log_laplace_loc(x: Column, loc: Column, scale: Column) -> Column:
    return F.signum(x - loc) / scale


def d_log_laplace_scale(x: Column, loc: Column, scale: Column) -> Column:
    return (F.abs(x - loc) / scale - 1) / scale


def d_log_laplace_log_scale(x: Column, loc: Column, scale: Column) -> Column:
    return F.abs(x - loc) / scale - 1


def d_laplace_loc(x: Column, loc: Column, scale: Column) -> Column:
    return laplace(x, loc, scale) * d_log_laplace_loc(x, loc, scale)


def d_laplace_scale(x: Column, loc: Column, scale: Column) -> Column:
    return laplace(x, loc, scale) * d_log_laplace_scale(x, loc, scale)


def d_laplace_log_scale(x: Column, loc: Column, scale: Column) -> Column:
    return laplace(x, loc, scale) * d_log_laplace_log_scale(x, loc, scale)


# logistic, location 0 and scale 1


def p_logistic(x: Column) -> Column:
    return 0.5 * (1 + F.tanh(x / 2))


def log_p_logistic(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def q_logistic(p: Column) -> Column:
    return 2 * F.atanh(2 * p - 1)


def d_logistic(x: Column) -> Column:
    p = p_logistic(x)
    return p * (1 - p)


# Weibull by shape and scale; the discrete one has the mass between x and x + 1


def log_survival_weibull(x: Column, shape: Column, scale: Column) -> Column:
    return -F.pow(x / scale, shape)


def p_weibull(x: Column, shape: Column, scale: Column) -> Column:
    return -F.expm1(log_survival_weibull(x, shape, scale))


def log_p_weibull(x: Column, shape: Column, scale: Column) -> Column:
    return F.ln(p_weibull(x, shape, scale))


def d_weibull(x: Column, shape: Column, scale: Column) -> Column:
    power = F.pow(x / scale, shape)
    return shape * power * F.exp(-power) / x


def p_discrete_weibull(x: Column, shape: Column, scale: Column) -> Column:
    return p_weibull(x + 1, shape, scale)


def log_p_discrete_weibull(x: Column, shape: Column, scale: Column) -> Column:
    return log_p_weibull(x + 1, shape, scale)


def log_survival_discrete_weibull(x: Column, shape: Column, scale: Column) -> Column:
    return log_survival_weibull(x + 1, shape, scale)


def d_discrete_weibull(x: Column, shape: Column, scale: Column) -> Column:
    return F.exp(log_survival_weibull(x, shape, scale)) - F.exp(log_survival_weibull(x + 1, shape, scale))


def discrete_weibull_mean(shape: Column, scale: Column, terms: int = 100) -> Column:
    """Mean of the discrete Weibull as the sum of its first ``terms`` survival probabilities."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, i: a + F.exp(-F.pow(i / scale, shape)))
