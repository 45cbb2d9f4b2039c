"""Scores, losses and features as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """In double precision, its argument clipped to +-60."""
    z = F.greatest(F.least(x.cast("double"), F.lit(60.0)), F.lit(-60.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def finite(x: Column, bound: float = 20.0) -> Column:
    """NaN becomes 0, all else is clipped to +-bound."""
    return F.greatest(F.least(F.nanvl(x, F.lit(0.0)), F.lit(bound)), F.lit(-bound))


def log_sigmoid(x: Column) -> Column:
    """Without overflow at either side."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def weighted_bce(logit: Column, y: Column, weight: Column) -> Column:
    """Cross entropy of a logit with the positive term weighted."""
    return -(weight * y * log_sigmoid(logit) + (F.lit(1.0) - y) * log_sigmoid(-logit))


def asymmetric_loss(logit: Column, y: Column, gamma_neg: float = 4.0, gamma_pos: float = 0.0, clip: float = 0.05, eps: float = 1e-8) -> Column:
    """Focusing loss with its own exponent and margin for negatives."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    n = F.least(F.lit(1.0) - p + F.lit(clip), F.lit(1.0))
    positive = y * F.log(F.greatest(p, F.lit(eps))) * F.pow(F.lit(1.0) - p, F.lit(gamma_pos))
    negative = (F.lit(1.0) - y) * F.log(F.greatest(n, F.lit(eps))) * F.pow(F.lit(1.0) - n, F.lit(gamma_neg))
    return -(positive + negative)


def standardize(x: Column, mean: Column, deviation: Column) -> Column:
    return (x - mean) / (deviation + F.lit(1e-9))
