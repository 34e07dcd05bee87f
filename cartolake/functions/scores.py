"""Scores and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight and mean of the prior, and what makes a favourite.
PRIOR_WEIGHT, PRIOR_MEAN = 5, 3.8
FAVOURITE_COUNT, FAVOURITE_MEAN = 5, 4.3


def bayes(total: Column, n: Column, rating: Column) -> Column:
    """Community score: the place's rating, or the prior mean, counts as PRIOR_WEIGHT votes."""
    return (F.coalesce(rating, F.lit(PRIOR_MEAN)) * PRIOR_WEIGHT + total) / (F.lit(PRIOR_WEIGHT) + n)


def is_favourite(total: Column, n: Column) -> Column:
    return (n >= FAVOURITE_COUNT) & (total / n >= FAVOURITE_MEAN)


def tenth(c: Column) -> Column:
    """Rounded half up to a tenth, as a double."""
    return F.floor(c * 10 + 0.5) / 10


def closes_at(opens: Column, closes: Column) -> Column:
    """Closing minute on the opening day's clock; at or before opening means the next day."""
    return F.when(closes <= opens, closes + 1440).otherwise(closes)


def round5(minutes: Column) -> Column:
    return (F.ceil(minutes / 5.0) * 5).cast("int")
