"""Inclusion-based and unification-based points-to analysis over statements (kind, src, dst[, off])."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import fixpoint as fixpoints
from ..plans import local
from ..plans.fixpoint import Relations, components, fixpoint
from ..plans.scratch import table

#: The block of the node in a column (see plans.fixpoint.units); it saves work and changes no result.
Block = Callable[[str], Column] | None


def _kind(stmt: DataFrame, kind: str) -> DataFrame:
    return stmt.where(F.col("kind") == kind).select("src", "dst")


def flow(pts: DataFrame, copy: DataFrame) -> DataFrame:
    """Objects move along copy edges: (var, obj) of the edges' targets."""
    return pts.withColumnRenamed("var", "src").join(copy.select("src", "dst"), "src").select(F.col("dst").alias("var"), "obj")


def derived_copies(pts: DataFrame, load: DataFrame, store: DataFrame) -> DataFrame:
    """(src, dst) of the copies that loads and stores stand for, given what their pointers point to."""
    at = pts.select(F.col("var").alias("at"), "obj")
    loaded = at.join(load.select(F.col("src").alias("at"), "dst"), "at").select(F.col("obj").alias("src"), "dst")
    stored = at.join(store.select("src", F.col("dst").alias("at")), "at").select("src", F.col("obj").alias("dst"))
    return loaded.unionByName(stored)


def split(stmt: DataFrame, most_local: int, block: Block = None) -> tuple[DataFrame, DataFrame | None]:
    """Statements of units that a task can solve (with the column unit), and those of larger units, None if there are none.

    Every derived fact stays in its unit: an object is tied by its address statement to a variable, a pointer by its load or store
    to the other end, so units are solved apart.
    """
    if stmt.count() <= most_local:
        return stmt.withColumn("unit", F.lit(0).cast("long")), None
    return fixpoints.split(stmt, most_local, block)


def solved(rows: DataFrame) -> Relations:
    """pts (var, obj) and copy (src, dst) of rows (k, a, b) that tasks made."""
    rows = table(rows)
    return {"pts": rows.where("k = 'p'").select(F.col("a").alias("var"), F.col("b").alias("obj")), "copy": rows.where("k = 'c'").select(F.col("a").alias("src"), F.col("b").alias("dst"))}


def solve(stmt: DataFrame, pts: DataFrame | None = None, copy: DataFrame | None = None, most_local: int = local.MOST_STATEMENTS, block: Block = None) -> Relations:
    """pts (var, obj) and copy (src, dst) of the least solution of the address, copy, load and store rules.

    pts and copy: facts already known, from which the solution goes on by rounds of joins (they must follow from stmt). Without
    them, weak components of at most `most_local` statements are solved in a task each; larger ones by rounds.
    """
    stmt = table(stmt.select("kind", "src", "dst").distinct())
    if most_local and pts is None and copy is None:
        small, large = split(stmt, most_local, block)
        found = solved(local.solve(small))
        if large is None:
            return found
        rest = solve(large, most_local=0)
        return {k: found[k].unionByName(rest[k]) for k in found}
    load, store = _kind(stmt, "load"), _kind(stmt, "store")
    seed_pts = _kind(stmt, "addr").select(F.col("dst").alias("var"), F.col("src").alias("obj"))
    seed_copy = _kind(stmt, "copy")
    if pts is not None:
        seed_pts = seed_pts.unionByName(pts.select("var", "obj"))
    if copy is not None:
        seed_copy = seed_copy.unionByName(copy.select("src", "dst"))

    def step(full: Relations, delta: Relations) -> Relations:
        found = flow(delta["pts"], full["copy"]).unionByName(flow(full["pts"], delta["copy"])).distinct()
        # a second hop in the same round halves the rounds of long copy chains
        return {"pts": found.unionByName(flow(found, full["copy"])), "copy": derived_copies(delta["pts"], load, store)}

    return fixpoint({"pts": seed_pts, "copy": seed_copy}, step)


def points_to(stmt: DataFrame, block: Block = None) -> DataFrame:
    """(var, obj) of the least solution."""
    return solve(stmt, block=block)["pts"]


def points_to_fields(stmt: DataFrame, limit: int = 8, most_local: int = local.MOST_STATEMENTS) -> DataFrame:
    """(var, vfld, obj, fld) with field-sensitive `gep` statements (off): fields are taken modulo the object's limit.

    Weak components of at most `most_local` statements are solved in a task each, larger ones by rounds.
    """
    stmt = table(stmt.select("kind", "src", "dst", F.coalesce("off", F.lit(0)).cast("long").alias("off")).distinct())
    if most_local:
        small, large = split(stmt, most_local)
        found = table(local.solve_fields(small, limit))
        return found if large is None else found.unionByName(points_to_fields(large, limit, most_local=0))
    load, store = _kind(stmt, "load"), _kind(stmt, "store")
    gep = stmt.where("kind = 'gep'").select(F.col("src"), F.col("dst"), "off")
    # a location is (object, field); variables are locations with field 0, so one pair of columns names both
    seed = _kind(stmt, "addr").select(F.col("dst").alias("var"), F.lit(0).cast("long").alias("vfld"), F.col("src").alias("obj"), F.lit(0).cast("long").alias("fld"))
    zero = F.lit(0).cast("long")
    copy = _kind(stmt, "copy").select(F.col("src").alias("s"), zero.alias("sf"), F.col("dst").alias("d"), zero.alias("df"))

    def moved(p: DataFrame, c: DataFrame) -> DataFrame:
        return p.join(c, (p["var"] == c["s"]) & (p["vfld"] == c["sf"])).select(c["d"].alias("var"), c["df"].alias("vfld"), "obj", "fld")

    def step(full: Relations, delta: Relations) -> Relations:
        d = delta["pts"]
        plain = d.where("vfld = 0")
        fields = plain.join(gep, plain["var"] == gep["src"]).select(gep["dst"].alias("var"), zero.alias("vfld"), "obj", F.pmod(F.col("fld") + F.col("off"), F.lit(limit)).alias("fld"))
        loads = plain.join(load, plain["var"] == load["src"]).select(F.col("obj").alias("s"), F.col("fld").alias("sf"), load["dst"].alias("d"), zero.alias("df"))
        stores = plain.join(store, plain["var"] == store["dst"]).select(store["src"].alias("s"), zero.alias("sf"), F.col("obj").alias("d"), F.col("fld").alias("df"))
        return {"pts": moved(d, full["copy"]).unionByName(moved(full["pts"], delta["copy"])).unionByName(fields), "copy": loads.unionByName(stores)}

    return fixpoint({"pts": seed, "copy": copy}, step)["pts"]


def unify(stmt: DataFrame, most_local: int = local.MOST_STATEMENTS, block: Block = None) -> DataFrame:
    """(var, obj) by unification: copies join classes, loads and stores join classes with what they reach."""
    stmt = table(stmt.select("kind", "src", "dst").distinct())
    if most_local:
        small, large = split(stmt, most_local, block)
        found = solved(local.solve(small, both_ways=True))["pts"]
        return found if large is None else found.unionByName(unify(large, most_local=0))
    load, store = _kind(stmt, "load"), _kind(stmt, "store")
    nodes = table(stmt.select(F.col("src").alias("node")).unionByName(stmt.select(F.col("dst").alias("node"))).distinct())
    base = _kind(stmt, "addr").select(F.col("dst").alias("node"), F.col("src").alias("obj"))
    edges = table(_kind(stmt, "copy"))
    while True:
        rep = table(components(nodes, edges))
        sets = base.join(rep, "node").select("rep", "obj").distinct()
        pts = table(rep.join(sets, "rep").select(F.col("node").alias("var"), "obj"))
        more = derived_copies(pts, load, store)
        apart = more.join(rep.select(F.col("node").alias("src"), F.col("rep").alias("a")), "src").join(rep.select(F.col("node").alias("dst"), F.col("rep").alias("b")), "dst").where("a <> b")
        # a class is joined by one edge for each pair of classes, not one for each derived copy
        joins = table(apart.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        if joins.isEmpty():
            return pts
        edges = table(edges.unionByName(joins))


def demand(stmt: DataFrame, wanted: DataFrame) -> DataFrame:
    """(var, obj) of the wanted variables (var) only: a backward pass finds the variables that can matter, then the rules run on those.

    A wanted variable needs the sources of its copies and the pointers of its loads; a needed load also needs every store's
    pointer and value, as any store may write what it reads.
    """
    stmt = table(stmt)
    copy, load, store = _kind(stmt, "copy"), _kind(stmt, "load"), _kind(stmt, "store")
    through = store.select(F.col("src").alias("node")).unionByName(store.select(F.col("dst").alias("node"))).distinct()

    def step(full: Relations, delta: Relations) -> Relations:
        d = delta["need"]
        back = copy.unionByName(load)
        direct = d.join(back, d["node"] == back["dst"]).select(back["src"].alias("node"))
        reads = load.join(d, load["dst"] == d["node"], "left_semi").select(F.lit(1).alias("one")).limit(1)
        return {"need": direct.unionByName(through.join(F.broadcast(reads)).select("node"))}

    need = fixpoint({"need": wanted.select(F.col("var").alias("node"))}, step)["need"]
    useful = stmt.join(need.select(F.col("node").alias("dst")), "dst", "left_semi").where("kind in ('addr', 'copy', 'load')").unionByName(stmt.where("kind = 'store'").select("dst", *[c for c in stmt.columns if c != "dst"]))
    return solve(useful.select("kind", "src", "dst"))["pts"].join(wanted.select("var").distinct(), "var", "left_semi")
