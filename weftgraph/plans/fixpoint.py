"""Least fixpoints of recursive rules, semi-naively: each round joins only what is new."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import local
from .scratch import table

#: Parts of a relation before they are written as one.
MOST_PARTS = 8
#: Links whose weak components one task finds.
MOST_LINKS = 500_000

Relations = dict[str, DataFrame]


class Relation:
    """A growing set of rows: its parts so far and the rows that are new in this round."""

    def __init__(self, seed: DataFrame):
        self.columns = seed.columns
        self.delta = table(seed.distinct())
        self.parts = [self.delta]

    @property
    def full(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, found: DataFrame | None) -> bool:
        """Take the rows that aren't there yet as the next delta; false if there are none."""
        if found is None:
            self.delta = self.delta.limit(0)
            return False
        seen = Observation()
        new = found.select(*self.columns).distinct().join(self.full, self.columns, "left_anti")
        self.delta = table(new.observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            return False
        self.parts.append(self.delta)
        if len(self.parts) > MOST_PARTS:
            self.parts = [table(self.full)]
        return True


def fixpoint(seeds: Relations, step: Callable[[Relations, Relations], Relations], most_rounds: int = 100_000) -> Relations:
    """The relations closed under `step(full, delta)`, which derives rows from at least one delta.

    Seeds need the columns of the results, null-free. Full relations already hold their deltas, so a rule with two recursive
    atoms joins delta with full on either side.
    """
    # a round's relations are written at the same time: their jobs are independent
    with ThreadPoolExecutor(len(seeds)) as pool:
        relations = dict(zip(seeds, pool.map(Relation, seeds.values()), strict=True))
        for _ in range(most_rounds):
            found = step({k: r.full for k, r in relations.items()}, {k: r.delta for k, r in relations.items()})
            grown = list(pool.map(lambda k: relations[k].add(found.get(k)), relations))
            if not any(grown):
                return {k: r.full for k, r in relations.items()}
    raise RuntimeError(f"no fixpoint within {most_rounds} rounds")


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, dst) of all non-empty paths of the edges; with start (src), of those from its nodes only.

    From chosen nodes paths grow by an edge a round; of all nodes they double, so rounds grow with the logarithm of the longest.
    """
    e = edges.select("src", "dst").distinct()
    if start is not None:
        e = table(e)
        seed = e.join(start.select("src").distinct(), "src", "left_semi")

        def grow(full: Relations, delta: Relations) -> Relations:
            return {"path": delta["path"].alias("p").join(e.alias("e"), F.col("p.dst") == F.col("e.src")).select("p.src", "e.dst")}

        return fixpoint({"path": seed}, grow)["path"]

    def double(full: Relations, delta: Relations) -> Relations:
        d, f = delta["path"], full["path"]
        one = d.alias("p").join(f.alias("q"), F.col("p.dst") == F.col("q.src")).select("p.src", "q.dst")
        two = f.alias("p").join(d.alias("q"), F.col("p.dst") == F.col("q.src")).select("p.src", "q.dst")
        return {"path": one.unionByName(two)}

    return fixpoint({"path": e}, double)["path"]


def components(nodes: DataFrame, edges: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(node, rep): the least node of each node's weak component, by alternating large and small stars; at most `most_links` links of
    numbers in one task."""
    links = table(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    if [t for _, t in links.dtypes] == ["bigint"] * 2 and 0 < links.count() <= most_links:
        rep = local.by_unit(links.withColumn("unit", F.lit(0).cast("long")), local.least_rows, "node long, rep long")
        return nodes.select("node").distinct().join(rep, "node", "left").select("node", F.coalesce("rep", "node").alias("rep"))
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = table(small.where("u <> v").distinct())
        many = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        chained = links.select(F.col("v").alias("u")).join(links.select("u"), "u", "left_semi")
        if many.unionByName(chained).isEmpty():
            break
    every = nodes.select("node").distinct().join(links.select(F.col("u").alias("node"), "v"), "node", "left")
    return every.select("node", F.coalesce("v", "node").alias("rep"))


def units(edges: DataFrame, block: Callable[[str], Column] | None = None) -> DataFrame:
    """The edges (src, dst, ...) with the column unit: edges that share a node, however many steps away, share their unit.

    block gives the block of the node in a column. Then units are weak components of blocks, which hold those of nodes whatever the
    blocks are; if few edges leave their blocks, they are found from those few. Else units are weak components of nodes.
    """
    if block is None:
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
        rep = table(components(nodes, edges.select("src", "dst")))
        return edges.join(rep.select(F.col("node").alias("src"), F.col("rep").alias("unit")), "src").select(*edges.columns, "unit")
    placed = edges.withColumn("_block", block("src"))
    across = table(placed.select(F.col("_block").alias("src"), block("dst").alias("dst")).where("src <> dst").distinct())
    if across.isEmpty():
        return placed.select(*edges.columns, F.col("_block").alias("unit"))
    rep = table(components(across.select(F.col("src").alias("node")).unionByName(across.select(F.col("dst").alias("node"))), across))
    joined = placed.join(rep.select(F.col("node").alias("_block"), "rep"), "_block", "left")
    return joined.select(*edges.columns, F.coalesce("rep", "_block").alias("unit"))


def split(edges: DataFrame, most: int, block: Callable[[str], Column] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Edges (src, dst, ...) of units of at most `most` (with the column unit), and those of larger units, None if there are none."""
    placed = table(units(edges, block))
    large = table(placed.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("unit"))
    if large.isEmpty():
        return placed, None
    rest = placed.join(large, "unit", "left_semi").select(*edges.columns)
    small = placed.join(large, "unit", "left_anti")
    if block is None:
        return small, rest
    # blocks may tie together what nodes don't
    more, rest = split(table(rest), most)
    return small.unionByName(more.withColumn("unit", -1 - F.col("unit"))), rest


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rep): the least node of each strongly connected component.

    Colouring: the least node that reaches a node is its colour; a colour's component is what reaches its root within the
    colour. Found components are peeled off and the rest is coloured again; nodes without in- or out-edges are trimmed first.
    """
    left = table(nodes.select("node").distinct())
    e = table(edges.select("src", "dst").where("src <> dst").distinct())
    done: list[DataFrame] = []
    while not left.isEmpty():
        lone = left.join(e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node"))), "node", "left_anti")
        lone = table(lone)
        if not lone.isEmpty():
            done.append(lone.select("node", F.col("node").alias("rep")))
            left = table(left.join(lone, "node", "left_anti"))
        else:
            color = table(left.select("node", F.col("node").alias("color")))
            while True:  # least ancestor
                seen = color.withColumnsRenamed({"node": "src"}).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("c"))
                nxt = table(color.join(seen, "node", "left").select("node", F.least("color", F.coalesce("c", "color")).alias("color")))
                changed = not nxt.join(color, ["node", "color"], "left_anti").isEmpty()
                color = nxt
                if not changed:
                    break
            inner = e.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").where("a = b")
            back = table(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            roots = color.where("node = color").select(F.col("node").alias("src"))
            reach = closure(back, roots).select(F.col("dst").alias("node"), F.col("src").alias("rep")).unionByName(roots.select(F.col("src").alias("node"), F.col("src").alias("rep"))).distinct()
            found = table(reach.join(color.withColumnRenamed("color", "rep"), ["node", "rep"], "left_semi"))
            done.append(found)
            left = table(left.join(found, "node", "left_anti"))
        e = table(e.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return reduce(DataFrame.unionByName, done) if done else left.select("node", F.col("node").alias("rep"))
