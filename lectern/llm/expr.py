"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use in several places.

    A column that a lambda refers to would be evaluated for each element;
    bound as a lambda variable it is evaluated once a row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lets(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Like let(), for several values, which the body gets as fields of a struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)
