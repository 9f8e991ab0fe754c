"""Journal ranks: scores, tiers of each system, the best of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers from best to worst, and each system's classes.
TIERS = ["S", "A", "B", "C", "D"]
QUARTILE = {"Q1": "A", "Q2": "B", "Q3": "C", "Q4": "D"}
QUALIS = {"A1": "A", "A2": "A", "A3": "B", "A4": "B", "B1": "C", "B2": "C"}
ABS = {"4*": "S", "4": "A", "3": "B", "2": "C", "1": "D"}


def sjr_number(score: Column) -> Column:
    """A score with a decimal comma or point; what isn't a number is 0."""
    return F.coalesce(F.replace(score, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def _tier(value: Column, table: dict[str, str]) -> Column:
    """Tier of a class; any other class is D, an empty or null one none."""
    out = F.lit("D")
    for k, t in table.items():
        out = F.when(value == k, F.lit(t)).otherwise(out)
    return F.when(value.isNotNull() & (value != ""), out)


def sjr_tier(quartile: Column) -> Column:
    return _tier(quartile, QUARTILE)


def qualis_tier(classification: Column) -> Column:
    return _tier(classification, QUALIS)


def abs_tier(rating: Column) -> Column:
    return _tier(rating, ABS)


def best_tier(quartile: Column, classification: Column, rating: Column) -> Column:
    """The best tier that any system gives, else ``unknown``."""
    place = lambda t: F.when(t.isNotNull(), F.array_position(F.array(*[F.lit(x) for x in TIERS]), t))
    best = F.least(place(sjr_tier(quartile)), place(qualis_tier(classification)), place(abs_tier(rating)))
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in TIERS]), (best - 1).cast("int")), F.lit("unknown"))
