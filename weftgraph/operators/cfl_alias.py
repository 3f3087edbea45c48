"""Aliases by CFL reachability: statements as labelled graphs whose edges run both ways, and the grammars over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cfl

#: Over two_way(): an object flows along copies, and from what is stored to what is loaded at aliases of the place.
CONSTRAINT_ALIAS = """
Start: A
Terminal: addr addrbar copy copybar load loadbar store storebar
Productions:
  A -> Pbar P;
  P -> addr | P T;
  Pbar -> addrbar | Tbar Pbar;
  T -> copy | store A load;
  Tbar -> copybar | loadbar A storebar;
"""

#: Over expressions(): V are expressions that may have one value, M those that may be one place.
EXPRESSION_ALIAS = """
Start: V
Terminal: a abar d dbar
Productions:
  M -> dbar V d;
  V -> Gbar M? G;
  G -> (a M?)*;
  Gbar -> (M? abar)*;
"""


def reversed_too(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, sym) and those against them, named with `bar`; attr is null."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat("sym", F.lit("bar")).alias("sym"))
    return edges.select("src", "dst", "sym").unionByName(back).distinct().withColumn("attr", F.lit(None).cast("long"))


def two_way(stmt: DataFrame) -> DataFrame:
    """Statements (kind, src, dst) as edges of their kind, and back."""
    return reversed_too(stmt.select("src", "dst", F.col("kind").alias("sym")))


def value(node):
    """The node of a variable's (or object's) content in expressions()."""
    return node * 3


def place(node):
    """The node of what a variable points to."""
    return node * 3 + 1


def address(node):
    """The node of an object's address."""
    return node * 3 + 2


def expressions(stmt: DataFrame) -> DataFrame:
    """Statements (kind, src, dst) as edges between expressions: `a` is assigned to, `d` has as its content; and back."""
    kind, src, dst = F.col("kind"), F.col("src"), F.col("dst")
    left = F.when(kind == "addr", address(src)).when(kind == "load", place(src)).otherwise(value(src))
    right = F.when(kind == "store", place(dst)).otherwise(value(dst))
    assigned = stmt.select(left.alias("src"), right.alias("dst"), F.lit("a").alias("sym"))
    used = stmt.where(kind.isin("load", "store")).select(F.when(kind == "load", src).otherwise(dst).alias("v"))
    followed = used.select(value(F.col("v")).alias("src"), place(F.col("v")).alias("dst"), F.lit("d").alias("sym"))
    objects = stmt.where(kind == "addr").select(address(src).alias("src"), value(src).alias("dst"), F.lit("d").alias("sym"))
    return reversed_too(assigned.unionByName(followed).unionByName(objects))


def constraint_aliases(stmt: DataFrame, width: int | None = None) -> DataFrame:
    """(a, b), a < b: variables that may point to one object. width: nodes of a module, if they are numbered by modules."""
    found = cfl.reach(two_way(stmt), cfl.parse(CONSTRAINT_ALIAS), wanted="A", block=cfl.blocks(width))
    return found.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def value_aliases(stmt: DataFrame, width: int | None = None) -> DataFrame:
    """(a, b), a < b: variables and objects' contents that may have one value, also one whose address is never taken.

    width: nodes of a module, if they are numbered by modules.
    """
    found = cfl.reach(expressions(stmt), cfl.parse(EXPRESSION_ALIAS), wanted="V", block=cfl.blocks(width and value(width)))
    both = found.where("src < dst and src % 3 = 0 and dst % 3 = 0")
    return both.select(F.expr("src div 3").alias("a"), F.expr("dst div 3").alias("b"))
