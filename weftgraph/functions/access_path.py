"""Access paths as columns: arrays of {index, stride} steps, relations of two paths, field objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_offset(steps: Column) -> Column:
    """The sum of index times stride over a path's steps."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s["index"].cast("long") * s["stride"].cast("long"))


def append(steps: Column, index: Column, stride: Column) -> Column:
    return F.concat(steps, F.array(F.struct(index.alias("index"), stride.alias("stride"))))


def relation(a: Column, b: Column) -> Column:
    """Paths with constant offsets denote one location each: the same one, or two apart."""
    return F.when(constant_offset(a) == constant_offset(b), "Same").otherwise("NonOverlap")


def field_of(base_field: Column, offset: Column, limit: Column) -> Column:
    """The field that lies an offset after another, modulo the object's number of fields; 0 for objects kept whole."""
    return F.when(limit <= 1, F.lit(0).cast("long")).otherwise(F.pmod(base_field + offset, limit).cast("long"))
