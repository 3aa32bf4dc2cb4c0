"""Numbers of one row, and guarded aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 2) -> Column:
    """Half to even, as the metrics are published."""
    return F.bround(c, digits)


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """Share in percent; 0.0 where the total is 0."""
    return F.coalesce(rounded(F.try_divide(part.cast("double") * 100.0, total.cast("double")), digits), F.lit(0.0))


def ratio(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def is_complaint(flag: str = "has_complaint", sentiment: str = "sentiment") -> Column:
    """Any dissatisfaction, or net negative; a missing flag counts as none, never as null."""
    return F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(F.col(sentiment) == "negative", F.lit(False))


def rating_score(rating: Column) -> Column:
    """1..5 stars to -1..1; 0 for a missing rating."""
    return F.when(F.coalesce(rating, F.lit(0)) == 0, F.lit(0.0)).otherwise((rating - 3) / 2.0)


def blend(compound: Column, rating: Column, weight: float | Column = 0.6) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return w * compound + (F.lit(1.0) - w) * rating_score(rating)


def to_label(score: Column, positive: float | Column = 0.15, negative: float | Column = -0.15) -> Column:
    """Both thresholds belong to their class."""
    return F.when(score >= positive, "positive").when(score <= negative, "negative").otherwise("neutral")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def pearson(a: Column, b: Column) -> Column:
    """0 for fewer than two rows or a constant side."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
