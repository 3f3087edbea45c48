"""Abstract states as tables: rows (keys, value); missing keys are bottom. Values are propagated along edges to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import interval
from ..plans.scratch import table

Binary = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Lattice:
    """What a value domain needs: its join, its widening and its equality, as column expressions."""

    join: Binary
    widen: Binary
    same: Binary


INTERVALS = Lattice(interval.join, interval.widen, interval.same)


def merged(a: DataFrame, b: DataFrame, keys: list[str], **how: Binary) -> DataFrame:
    """Both states on one key each: a column for every named operation on the two values."""
    both = a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), keys, "full_outer")
    return both.select(*keys, *[f(F.col("x"), F.col("y")).alias(n) for n, f in how.items()])


def propagate(edges: DataFrame, seed: DataFrame, combine: Callable[[DataFrame], DataFrame], lattice: Lattice = INTERVALS, transfer: Callable[[Column, DataFrame], Column] | None = None, widen_after: int = 64, most_rounds: int = 10_000) -> DataFrame:
    """(node, value) of the least solution of value(dst) >= transfer(value(src)) over edges (src, dst, ...) and the seed (node, value).

    combine joins a group's values: it gets (node, value) rows and gives one row a node. Only nodes whose value grew send it on.
    From round `widen_after` on, growing values are widened, so the rounds end where the domain has infinite chains.
    """
    edges, state = table(edges), table(combine(seed.select("node", "value")))
    delta = state
    for turn in range(most_rounds):
        moved = delta.withColumnRenamed("node", "src").join(edges, "src")
        value = transfer(F.col("value"), moved) if transfer else F.col("value")
        sent = combine(moved.select(F.col("dst").alias("node"), value.alias("value")).where("value is not null"))
        grow = lattice.widen if turn >= widen_after else lattice.join
        both = state.select("node", F.col("value").alias("x")).join(sent.select("node", F.col("value").alias("y")), "node", "full_outer")
        grown = table(both.select("node", F.when(F.col("y").isNull(), F.col("x")).otherwise(grow(F.col("x"), lattice.join(F.col("x"), F.col("y")))).alias("value"), "x"))
        delta = table(grown.where(~lattice.same(F.col("x"), F.col("value"))).select("node", "value"))
        state = grown.select("node", "value")
        if delta.isEmpty():
            return state
    raise RuntimeError(f"no fixpoint within {most_rounds} rounds")


def spans(rows: DataFrame) -> DataFrame:
    """combine of intervals: one row a node, from the least bound to the greatest."""
    return rows.groupBy("node").agg(F.struct(F.min("value.lb").alias("lb"), F.max("value.ub").alias("ub")).alias("value"))
