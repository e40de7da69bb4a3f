"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector in double precision; the zero vector stays zero."""
    norm = l2_norm(v)
    scale = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    # The one-element array evaluates the norm once per row instead of once per element.
    return F.flatten(
        F.transform(F.array(scale), lambda s: F.transform(v, lambda x: x.cast("double") / s))
    )


def masked_mean(v: Column, mask: Column) -> Column:
    """Aggregate: mean of the vectors whose mask is set, zero vector when none is.

    ``Summarizer`` folds whole vectors map-side, so only one vector per group and map task is
    shuffled, however many rows a hot group has.
    """
    weight = mask.cast("double")
    masked = F.transform(v, lambda x: x.cast("double") * weight)
    total = Summarizer.metrics("sum").summary(array_to_vector(masked))["sum"]
    # Fixed value: the divisor is never smaller than this.
    divisor = F.greatest(F.sum(weight), F.lit(1e-9))
    return F.transform(vector_to_array(total), lambda x: x / divisor)
