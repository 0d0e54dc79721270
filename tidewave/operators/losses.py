"""Losses as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def improved_mse(pred: str, target: str, peak_weight: float = 2.0) -> Column:
    """Mean squared error, each term weighted by 1 + peak_weight * |target|."""
    p, t = F.col(pred), F.col(target)
    return F.avg((p - t) * (p - t) * (1 + peak_weight * F.abs(t)))


def cross_entropy(logits: str, label: str, ignore_index: int = -100) -> Column:
    x, y = F.col(logits), F.col(label)
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))
    return F.when(y == ignore_index, 0.0).otherwise(F.log(total) + top - F.get(x, y))


def focal_loss(logits: str, label: str, alpha: float = 1.0, gamma: float = 2.0) -> Column:
    """Mean of alpha (1 - p)^gamma ce; ignored labels count as 0 but stay in the mean."""
    ce = cross_entropy(logits, label)
    return F.avg(alpha * F.pow(1 - F.exp(-ce), gamma) * ce)
