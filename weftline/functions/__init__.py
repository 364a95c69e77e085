"""Column functions: rule measures and list metrics as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lift(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """How many times more often than by chance two things come together."""
    return n_ab.cast("double") * n / (n_a.cast("double") * n_b)


def pmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Pointwise mutual information in bits."""
    return F.log2(lift(n_ab, n_a, n_b, n))


def jaccard(n_ab: Column, n_a: Column, n_b: Column) -> Column:
    return n_ab / F.nullif(n_a + n_b - n_ab, F.lit(0))
