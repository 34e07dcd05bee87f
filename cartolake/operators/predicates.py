"""Composable place predicates. Unknown prices and opening hours are NULL and never pass for a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are asked for."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def listed(category: str | None = None, tag: str | None = None) -> Column:
    """Visible in lists; without a category, markets and places of worship stay out."""
    wanted = ~F.col("category").isin("MARKET", "WORSHIP") if category is None else (F.col("category") == category)
    return all_of(~F.col("hidden"), ~F.col("unconfirmed"), wanted, F.array_contains("tags", tag) if tag else None)


def plannable() -> Column:
    return ~F.col("hidden") & ~F.col("unconfirmed") & F.col("review").isNull() & ~F.col("inside_institution")


def fills_stop(categories: list[str], tag: str | None) -> Column:
    fits = F.col("category").isin(categories)
    return plannable() & (fits | F.array_contains("tags", tag) if tag else fits)


def search(category: str | None = None, max_cost: int | None = None, verified: bool | None = None, tag: str | None = None, indoor: bool | None = None, text: str | None = None, city_id: int | None = None) -> Column:
    """Optional filters; each is left out when its value is None."""
    return all_of(
        ~F.col("hidden"),
        F.col("category") == category if category else None,
        F.col("cost") <= max_cost if max_cost is not None else None,
        (F.col("source") == "VERIFIED") == verified if verified is not None else None,
        F.array_contains("tags", tag) if tag else None,
        F.col("indoor") == indoor if indoor is not None else None,
        F.contains(F.lower("name"), F.lit(text.lower())) if text else None,
        F.col("city_id") == city_id if city_id is not None else None,
    )
