"""Element-wise activations as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def swish(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def elu(x: Column) -> Column:
    return F.when(x >= 0, x).otherwise(F.expm1(x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def log(x: Column) -> Column:
    return F.ln(x)


def robust_log(x: Column, p: float) -> Column:
    """log of ``x`` mixed with ``p``, so that zero stays finite."""
    return F.ln(F.lit(p) + (1 - p) * x)


def log_sum_exp(x: Column, y: Column) -> Column:
    return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))


ACTIVATIONS = {"tanh": F.tanh, "exp": F.exp, "log": log, "logistic": logistic, "swish": swish, "elu": elu, "relu": relu, "softplus": softplus}
