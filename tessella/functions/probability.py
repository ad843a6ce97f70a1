"""Normalisation, entropy and related expressions over probability columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def normalise(p: Column, *by: str | Column) -> Column:
    """``p`` over its sum within ``by``; all zeros stay zeros."""
    total = F.sum(p).over(Window.partitionBy(*by))
    return F.when(total != 0, p / total).otherwise(F.lit(0.0))


def log_normalise(logit: Column, *by: str | Column) -> Column:
    """The softmax of ``logit`` within ``by``, by way of the largest value."""
    window = Window.partitionBy(*by)
    raised = F.exp(logit - F.max(logit).over(window))
    return raised / F.sum(raised).over(window)


def entropy(p: Column) -> Column:
    """Aggregate: minus the sum of p ln p over p > 0, in nats."""
    return -F.sum(F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0)))


def powered(p: Column, exponent: Column) -> Column:
    """p ** exponent, and 0 for p = 0 whatever the exponent."""
    return F.when(p > 0, F.exp(exponent * F.ln(p))).otherwise(F.lit(0.0))


def product(p: Column) -> Column:
    """Aggregate: the product of non-negative factors, 0 if any factor is."""
    return F.when(F.max((p <= 0).cast("int")) == 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(p > 0, F.ln(p)))))


def two_class_log_normaliser(score: Column, gamma: float) -> Column:
    """-m - ln(exp(g s - m) + exp(-g s - m)) with m the larger exponent."""
    s = score * F.lit(gamma)
    m = F.abs(s)
    return -m - F.ln(F.exp(s - m) + F.exp(-s - m))
