"""Memory SSA: versions of memory regions along control flow, and the value flow between them.

A block is one statement, which reads before it writes. Inputs: dom (dom, node) of dominators; places (region, node, writes) of the
blocks that may read or write a region; roots (root, node) says which procedure's entry a node belongs to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import local
from ..plans.fixpoint import Relations, fixpoint, split
from ..plans.scratch import table
from .dominance import dominators, frontier, phis

#: Where a version begins, in the order of a block: the procedure's entry, a phi, a write.
ENTRY, PHI, CHI = 0, 1, 2


def definitions(flow: DataFrame, dom: DataFrame, places: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, region, node, at, ver): every version and where it begins; versions of a region are numbered from 1 in a procedure.

    A region is known in a procedure that touches it: it has a version at entry, at writes and where writes' paths meet.
    """
    inside = places.join(roots, "node")
    entry = inside.select("root", "region", F.col("root").alias("node"), F.lit(ENTRY).alias("at")).distinct()
    chi = inside.where("writes").select("root", "region", "node", F.lit(CHI).alias("at")).distinct()
    # a region's name is (root, region), so that procedures stay apart
    name = F.struct("root", "region").alias("region")
    merge = phis(frontier(flow, dom), chi.select(name, "node"))
    phi = merge.select("region.root", "region.region", "node", F.lit(PHI).alias("at"))
    every = entry.unionByName(chi).unionByName(phi)
    return table(every.withColumn("ver", F.row_number().over(Window.partitionBy("root", "region").orderBy("node", "at")).cast("long")))


def reaching(dom: DataFrame, defs: DataFrame, at: DataFrame) -> DataFrame:
    """(root, region, node, ver): the version that comes into a node, for every (root, region, node) of at.

    It is the one that begins nearest above: in a strict dominator of the greatest depth, or by a phi or the entry of the node itself.
    """
    depth = dom.groupBy(F.col("node").alias("dom")).agg(F.count(F.lit(1)).alias("depth"))
    above = at.distinct().join(dom, "node").join(depth, "dom")
    own = defs.select("root", "region", F.col("node").alias("dom"), "at", "ver")
    found = above.join(own, ["root", "region", "dom"]).where((F.col("dom") != F.col("node")) | (F.col("at") < CHI))
    return found.groupBy("root", "region", "node").agg(F.max(F.struct("depth", "at", "ver")).alias("best")).select("root", "region", "node", "best.ver")


def build(flow: DataFrame, dom: DataFrame, places: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, region, node, annotation, operand, result): mu reads operand; chi makes result of operand; a phi has a row for each
    predecessor's operand; an entry makes its result of nothing (0, as is a mu's result)."""
    flow, dom, places, roots = (table(x) for x in (flow.distinct(), dom, places.join(roots.select("node"), "node", "left_semi").distinct(), roots))
    defs = definitions(flow, dom, places, roots)
    touched = places.join(roots, "node").select("root", "region", "node", "writes")
    phi = defs.where(F.col("at") == PHI)
    before = flow.join(roots.select(F.col("node").alias("src")), "src", "left_semi")
    preds = table(phi.join(before, phi["node"] == before["dst"]).select("root", "region", F.col("dst"), F.col("src").alias("node")))
    into = table(reaching(dom, defs, touched.select("root", "region", "node").unionByName(preds.select("root", "region", "node"))))
    written = defs.where(F.col("at") == CHI).select("root", "region", "node", F.col("ver").alias("own"))
    out_of = into.join(written, ["root", "region", "node"], "left").select("root", "region", "node", F.coalesce("own", "ver").alias("operand"))
    key, zero = ["root", "region", "node"], F.lit(0).cast("long")
    mu = touched.where("not writes").select(*key).distinct().join(into, key).select(*key, F.lit("mu").alias("annotation"), F.col("ver").alias("operand"), zero.alias("result"))
    chi = written.join(into, key).select(*key, F.lit("chi").alias("annotation"), F.col("ver").alias("operand"), F.col("own").alias("result"))
    entry = defs.where(F.col("at") == ENTRY).select(*key, F.lit("entry").alias("annotation"), zero.alias("operand"), F.col("ver").alias("result"))
    joins = preds.join(out_of, key).select("root", "region", F.col("dst").alias("node"), "operand").distinct()
    phi_rows = joins.join(phi.select(*key, F.col("ver").alias("result")), key).select(*key, F.lit("phi").alias("annotation"), "operand", "result")
    return table(mu.unionByName(chi).unionByName(entry).unionByName(phi_rows))


def value_flow(ssa: DataFrame) -> DataFrame:
    """(root, region, src, src_kind, dst, dst_kind): from where each version is made to where it is an operand."""
    made = ssa.where("result > 0").select("root", "region", F.col("result").alias("ver"), F.col("node").alias("src"), F.col("annotation").alias("src_kind")).distinct()
    used = ssa.where("operand > 0").select("root", "region", F.col("operand").alias("ver"), F.col("node").alias("dst"), F.col("annotation").alias("dst_kind"))
    return made.join(used, ["root", "region", "ver"]).select("root", "region", "src", "src_kind", "dst", "dst_kind").distinct()


def without_phis(edges: DataFrame) -> DataFrame:
    """The value flow with phis passed through: edges between entries, writes and reads only."""
    edges = table(edges)
    key = ["root", "region"]
    across = table(edges.where("src_kind = 'phi'").select(*key, F.col("src").alias("mid"), "dst", "dst_kind"))

    def step(full: Relations, delta: Relations) -> Relations:
        d = delta["edge"].where("dst_kind = 'phi'").select(*key, "src", "src_kind", F.col("dst").alias("mid"))
        return {"edge": d.join(across, [*key, "mid"]).select("root", "region", "src", "src_kind", "dst", "dst_kind")}

    return fixpoint({"edge": edges.where("src_kind <> 'phi'")}, step)["edge"].where("dst_kind <> 'phi'")


#: What `solved` may make: the rows of build, of value_flow of those, or of without_phis of those.
SCHEMAS = {"ssa": "root long, region long, node long, annotation string, operand long, result long"} | dict.fromkeys(("flow", "plain"), "root long, region long, src long, src_kind string, dst long, dst_kind string")


def solved(flow: DataFrame, places: DataFrame, root: DataFrame, make: str = "ssa", most_local: int = local.MOST_STATEMENTS, block: Callable[[str], Column] | None = None) -> DataFrame:
    """Rows of SCHEMAS[make] of the procedures that begin at roots (node); procedures share no nodes.

    Units (see plans.fixpoint.units, which takes block) of at most `most_local` edges, places and roots are solved in a task each, larger
    ones by rounds of joins.
    """
    zero = F.lit(0).cast("long")
    rows = [
        flow.select(F.lit("f").alias("tag"), "src", "dst", zero.alias("region"), zero.alias("writes")),
        places.select(F.lit("p"), F.col("node"), F.col("node"), F.col("region").cast("long"), F.col("writes").cast("long")),
        root.select(F.lit("r"), F.col("node"), F.col("node"), zero, zero),
    ]
    small, large = split(table(rows[0].union(rows[1]).union(rows[2]).distinct()), most_local, block)
    found = table(local.by_unit(small.select("tag", "src", "dst", "region", "writes", "unit"), lambda f: local.ssa_rows(f, make), SCHEMAS[make]))
    if large is None:
        return found
    large = table(large)
    rest, start = large.where("tag = 'f'").select("src", "dst"), large.where("tag = 'r'").select(F.col("src").alias("node"))
    dom = table(dominators(rest, start))
    within = dom.join(start.withColumnRenamed("node", "dom"), "dom").select(F.col("dom").alias("root"), "node")
    ssa = build(rest, dom, large.where("tag = 'p'").select("region", F.col("src").alias("node"), (F.col("writes") == 1).alias("writes")), within)
    more = ssa if make == "ssa" else value_flow(ssa) if make == "flow" else without_phis(value_flow(ssa))
    return found.unionByName(more)


def counts(ssa: DataFrame) -> DataFrame:
    """(root, n_entry, n_mu, n_chi, n_phi) of each procedure; a phi counts once however many operands it has."""
    once = ssa.select("root", "region", "node", "annotation").distinct()
    kinds = {f"n_{k}": F.count(F.when(F.col("annotation") == k, 1)) for k in ("entry", "mu", "chi", "phi")}
    return once.groupBy("root").agg(*[c.alias(n) for n, c in kinds.items()])


def write_text(edges: DataFrame, path: str) -> None:
    """A line for each node, `node kind id root region`, and for each edge, `edge kind id kind id root region`."""
    ends = edges.select("root", "region", F.explode(F.array(F.struct(F.col("src_kind").alias("kind"), F.col("src").alias("id")), F.struct(F.col("dst_kind").alias("kind"), F.col("dst").alias("id")))).alias("e")).distinct()
    nodes = ends.select(F.concat_ws(" ", F.lit("node"), "e.kind", "e.id", "root", "region").alias("value"))
    lines = edges.select(F.concat_ws(" ", F.lit("edge"), "src_kind", "src", "dst_kind", "dst", "root", "region").alias("value"))
    nodes.unionByName(lines).write.text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The edges of write_text; an edge whose ends have no node line is an error."""
    t = F.col("t")
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).where("t[0] in ('node', 'edge')")
    nodes = lines.where("t[0] = 'node'").select(t[3].cast("long").alias("root"), t[4].cast("long").alias("region"), t[1].alias("kind"), t[2].cast("long").alias("id"))
    edges = lines.where("t[0] = 'edge'").select(t[5].cast("long").alias("root"), t[6].cast("long").alias("region"), t[2].cast("long").alias("src"), t[1].alias("src_kind"), t[4].cast("long").alias("dst"), t[3].alias("dst_kind"))
    known = lambda e: nodes.select("root", "region", F.col("id").alias(e), F.col("kind").alias(f"{e}_kind"), F.lit(True).alias(f"{e}_known"))
    both = edges.join(known("src"), ["root", "region", "src", "src_kind"], "left").join(known("dst"), ["root", "region", "dst", "dst_kind"], "left")
    fine = F.when(F.col("src_known") & F.col("dst_known"), F.lit(True)).otherwise(F.raise_error(F.lit("an edge of an unknown node")))
    return both.where(fine).select(*edges.columns)
