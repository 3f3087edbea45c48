"""From statements of all kinds to constraints: addr, copy, load, store, normal and variant gep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statements that move a value are copies; comparisons, arithmetic and branches move no pointer.
COPIES = ("copy", "phi", "select", "call", "ret", "fork", "join")
KEYED_BY_SITE = ("call", "ret", "fork", "join")
KEYED_BY_OPERAND = ("phi", "select", "cmp", "binary-op")


def statements(rows: DataFrame) -> DataFrame:
    """(kind, src, dst, off, variant, cs, op_pos) without duplicates: calls, returns, forks and joins are told apart by their site,
    multi-operand statements by the operand's place, geps by their offset, all others by their ends alone."""
    kind = F.col("kind")
    key = lambda c, when: F.when(when, F.col(c))
    gep = kind == "gep"
    return rows.select("kind", "src", "dst", key("off", gep).alias("off"), key("variant", gep).alias("variant"), key("cs", kind.isin(*KEYED_BY_SITE)).alias("cs"), key("op_pos", kind.isin(*KEYED_BY_OPERAND)).alias("op_pos")).distinct()


def constraints(stmt: DataFrame) -> DataFrame:
    """(kind, src, dst, off): one edge of a kind between two nodes (geps: for each offset), none from a node to itself but geps."""
    kind = F.when(F.col("kind").isin(*COPIES), "copy").when(F.col("kind") == "gep", F.when(F.col("variant"), "variant-gep").otherwise("gep")).when(F.col("kind").isin("addr", "load", "store"), F.col("kind"))
    edges = stmt.select(kind.alias("kind"), "src", "dst", F.when(kind == "gep", F.col("off")).otherwise(0).cast("long").alias("off"))
    return edges.where((F.col("kind").isNotNull()) & ((F.col("src") != F.col("dst")) | F.col("kind").isin("gep", "variant-gep"))).distinct()


def supported_copies(pts: DataFrame, stmt: DataFrame) -> DataFrame:
    """(src, dst, reason, at_src, at_dst): every copy edge with all that justifies it: a copy statement itself, or a load or store
    (at_src, at_dst) through whose pointer it was derived. A copy whose last reason goes is to be deleted."""
    own = stmt.where("kind = 'copy'").select("src", "dst", F.lit("copy").alias("reason"), F.col("src").alias("at_src"), F.col("dst").alias("at_dst"))
    loads, stores = (stmt.where(F.col("kind") == k).select(F.col("src").alias("at_src"), F.col("dst").alias("at_dst")) for k in ("load", "store"))
    at = lambda c: pts.select(F.col("var").alias(c), "obj")
    loaded = loads.join(at("at_src"), "at_src").select(F.col("obj").alias("src"), F.col("at_dst").alias("dst"), F.lit("load").alias("reason"), "at_src", "at_dst")
    stored = stores.join(at("at_dst"), "at_dst").select(F.col("at_src").alias("src"), F.col("obj").alias("dst"), F.lit("store").alias("reason"), "at_src", "at_dst")
    return own.unionByName(loaded).unionByName(stored).distinct()


def contracted(edges: DataFrame, rep: DataFrame) -> DataFrame:
    """(src, dst, kind, flat): the edges between representatives, each with the edges it stands for, as sorted pairs."""
    a, b = rep.select(F.col("node").alias("src"), F.col("rep").alias("a")), rep.select(F.col("node").alias("dst"), F.col("rep").alias("b"))
    ends = edges.join(a, "src", "left").join(b, "dst", "left").select("kind", F.coalesce("a", "src").alias("x"), F.coalesce("b", "dst").alias("y"), F.struct("src", "dst").alias("e"))
    inside = (F.col("x") == F.col("y")) & (F.col("kind") == "copy")
    return ends.where(~inside).groupBy(F.col("x").alias("src"), F.col("y").alias("dst"), "kind").agg(F.sort_array(F.collect_set("e")).alias("flat"))
