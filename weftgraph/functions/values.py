"""Constant values and contexts as columns.

A constant is a struct {top boolean, value double}, null for bottom. A context is an array of call sites, the last one on top.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value: Column) -> Column:
    return F.struct(F.lit(False).alias("top"), value.cast("double").alias("value"))


def unknown() -> Column:
    return F.struct(F.lit(True).alias("top"), F.lit(None).cast("double").alias("value"))


def join(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).when(~a["top"] & ~b["top"] & (a["value"] == b["value"]), a).otherwise(unknown())


def meet(a: Column, b: Column) -> Column:
    """Null (bottom) for two different constants."""
    return F.when(a.isNull() | b.isNull(), None).when(a["top"], b).when(b["top"] | (a["value"] == b["value"]), a)


def operate(a: Column, b: Column, how: Callable[[Column, Column], Column]) -> Column:
    """A binary statement's value: known if both operands are."""
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a["top"] | b["top"], unknown()).otherwise(constant(how(a["value"], b["value"]))))


def folded(values: Column) -> Column:
    """As an aggregate: the join of a group's values."""
    return F.when(F.min(values) == F.max(values), constant(F.min(values))).otherwise(unknown())


def push(context: Column, site: Column, limit: int) -> Column:
    """The context with a call site on top; of more than `limit` sites the oldest is forgotten."""
    longer = F.concat(context, F.array(site))
    return F.slice(longer, F.greatest(F.size(longer) - limit + 1, F.lit(1)), limit)


def matches(context: Column, site: Column) -> Column:
    """Whether a return to the site fits: it is on top, or nothing is known."""
    return (F.size(context) == 0) | (F.try_element_at(context, F.lit(-1)) == site)


def popped(context: Column) -> Column:
    return F.when(F.size(context) > 0, F.slice(context, F.lit(1), F.greatest(F.size(context) - 1, F.lit(0)))).otherwise(context)
