"""Dominators, dominance frontiers and phi placement on control-flow graphs (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Relations, closure, fixpoint
from ..plans.scratch import table


def dominators(flow: DataFrame, root: DataFrame) -> DataFrame:
    """(dom, node): dom is on every path from the procedure's root (node) to node, itself included.

    Found by its complement, which is monotone: (d, n) such that n is reachable without passing d. Each root is a procedure;
    procedures share no nodes, so nodes are paired within their procedure only.
    """
    flow = table(flow.select("src", "dst").distinct())
    roots = root.select(F.col("node").alias("root"), "node")
    live = table(closure(flow, root.select(F.col("node").alias("src"))).select(F.col("src").alias("root"), F.col("dst").alias("node")).unionByName(roots).distinct())
    seed = live.where("node <> root").select(F.col("node").alias("d"), F.col("root").alias("node"))

    def step(full: Relations, delta: Relations) -> Relations:
        d = delta["avoid"]
        return {"avoid": d.join(flow, d["node"] == flow["src"]).where("dst <> d").select("d", F.col("dst").alias("node"))}

    avoid = fixpoint({"avoid": seed}, step)["avoid"]
    every = live.select("root", F.col("node").alias("dom")).join(live, "root")
    return every.join(avoid.withColumnRenamed("d", "dom"), ["dom", "node"], "left_anti").select("dom", "node")


def frontier(flow: DataFrame, dom: DataFrame) -> DataFrame:
    """(node, frontier): the node dominates a predecessor of frontier but not strictly frontier itself."""
    near = flow.join(dom, flow["src"] == dom["node"]).select(dom["dom"].alias("node"), F.col("dst").alias("frontier")).distinct()
    strict = dom.where("dom <> node").select(F.col("dom").alias("node"), F.col("node").alias("frontier"))
    return near.join(strict, ["node", "frontier"], "left_anti")


def phis(frontiers: DataFrame, definitions: DataFrame) -> DataFrame:
    """(region, node) where phis are needed: the iterated frontier of each region's definitions (region, node)."""
    f = table(frontiers)

    def step(full: Relations, delta: Relations) -> Relations:
        d = delta["at"]
        return {"at": d.join(f, "node").select("region", F.col("frontier").alias("node"))}

    first = definitions.join(f, "node").select("region", F.col("frontier").alias("node"))
    return fixpoint({"at": first}, step)["at"]
