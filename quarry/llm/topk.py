"""Exact top-k search of integer vectors by tiled matrix products, partial selection per tile and tree merging.

The products are those of quarry.operators.products, whose tiles hold longs here, so scores are exact where they fit a long.
Vectors come in as whole numbers, as `scaled` makes them of real ones.

Defined results: rows without an id and vectors that are null or hold null or non-finite components take no part; vectors meet only
those of their own length; ties go to the smaller id; repeated rows are vectors of their own, and a query leaves out its own row
only; with fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.operators.products import search, tiles

__all__ = ["scaled", "search", "tiles"]


def scaled(vector: Column, by: int = 64) -> Column:
    """floor(by * x) per component; null if the vector is null or a component is null or not finite."""
    x_ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(F.forall(vector, x_ok), F.transform(vector, lambda x: F.floor(F.lit(float(by)) * x.cast("double")).cast("long")))
