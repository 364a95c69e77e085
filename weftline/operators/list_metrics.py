"""Metrics of one recommendation list; :mod:`weftline.operators.evaluation` has them for whole tables."""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence


def hits_at_k(recommended: Sequence, actual: Collection, k: int) -> int:
    return sum(x in set(actual) for x in recommended[: max(k, 0)])


def precision_at_k(recommended: Sequence, actual: Collection, k: int) -> float:
    return hits_at_k(recommended, actual, k) / k if k > 0 else 0.0


def recall_at_k(recommended: Sequence, actual: Collection, k: int) -> float:
    return hits_at_k(recommended, actual, k) / len(actual) if actual else 0.0


def f1_at_k(recommended: Sequence, actual: Collection, k: int) -> float:
    p, r = precision_at_k(recommended, actual, k), recall_at_k(recommended, actual, k)
    return 2 * p * r / (p + r) if p + r else 0.0


def average_precision(recommended: Sequence, actual: Collection) -> float:
    """Over the whole list."""
    places = [i + 1 for i, x in enumerate(recommended) if x in set(actual)]
    return sum((h + 1) / i for h, i in enumerate(places)) / len(actual) if actual else 0.0


def ndcg_at_k(recommended: Sequence, actual: Collection, k: int) -> float:
    gain = lambda i: 1 / math.log2(i + 2)
    ideal = sum(gain(i) for i in range(min(len(actual), max(k, 0))))
    return sum(gain(i) for i, x in enumerate(recommended[: max(k, 0)]) if x in set(actual)) / ideal if ideal else 0.0


def hit_rate_at_k(recommended: Sequence, actual: Collection, k: int) -> float:
    return float(hits_at_k(recommended, actual, k) > 0)


def reciprocal_rank(recommended: Sequence, actual: Collection) -> float:
    return next((1 / (i + 1) for i, x in enumerate(recommended) if x in set(actual)), 0.0)
