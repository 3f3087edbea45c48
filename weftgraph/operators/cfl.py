"""Context-free-language reachability: grammars as tables of binary rules, edges (src, dst, sym, attr) to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import local
from ..plans.fixpoint import Relations, fixpoint, split
from ..plans.scratch import table

#: The attribute of symbols that have none.
NONE = -1


@dataclass
class Grammar:
    """Start symbol, terminals and productions; a symbol `x_i` carries an attribute, equal for all `_i` of a production."""

    start: str
    terminals: list[str]
    productions: list[tuple[str, list[str]]] = field(default_factory=list)

    def binary(self) -> Grammar:
        """The same language with at most two symbols on a right side, without `*`, `?` and brackets."""
        out: list[tuple[str, list[str]]] = []
        made: dict[tuple[str, ...], str] = {}

        def named(symbols: tuple[str, ...], build) -> str:
            """A nonterminal for a part of a right side, made once."""
            if symbols not in made:
                made[symbols] = f"X{len(made)}" + ("_i" if any(s.endswith("_i") for s in symbols) else "")
                build(made[symbols])
            return made[symbols]

        def plain(symbols: list[str]) -> list[str]:
            flat: list[str] = []
            i = 0
            while i < len(symbols):
                s = symbols[i]
                if s == "(":
                    depth, j = 1, i + 1
                    while depth:
                        depth += {"(": 1, ")": -1}.get(symbols[j], 0)
                        j += 1
                    inner, s, i = symbols[i + 1 : j - 1], "(" + " ".join(symbols[i + 1 : j - 1]) + ")", j - 1
                else:
                    inner = [s.rstrip("*?")]
                mark = symbols[i + 1] if symbols[i] == ")" and i + 1 < len(symbols) and symbols[i + 1] in "*?" else s[-1] if s[-1] in "*?" else ""
                if symbols[i] == ")" and mark:
                    i += 1
                if mark == "*":
                    body = plain(inner)
                    s = named(("*", *inner), lambda n, body=body: (out.append((n, [])), pair(n, [n, *body])))
                    flat.append(s)
                elif mark == "?":
                    body = plain(inner)
                    s = named(("?", *inner), lambda n, body=body: (out.append((n, [])), pair(n, body)))
                    flat.append(s)
                else:
                    flat += plain(inner) if symbols[i] == ")" else [s]
                i += 1
            return flat

        def pair(left: str, right: list[str]) -> None:
            while len(right) > 2:
                first = right[:2]
                right = [named(tuple(first), lambda n, first=first: out.append((n, first))), *right[2:]]
            if (left, right) not in out:
                out.append((left, right))

        for left, right in self.productions:
            pair(left, plain(right))
        return Grammar(self.start, self.terminals, out)


def parse(text: str) -> Grammar:
    """`Start:` symbol, `Terminal:` symbols, `Productions:` `A -> B C | D ;` with `epsilon` for nothing."""
    sections: dict[str, str] = {}
    name = ""
    for line in text.splitlines():
        head, colon, rest = line.partition(":")
        if colon and head.strip() in ("Start", "Terminal", "Productions"):
            name, line = head.strip(), rest
        if name:
            sections[name] = sections.get(name, "") + " " + line
    productions = []
    for rule in filter(None, (r.strip() for r in sections.get("Productions", "").split(";"))):
        left, _, right = rule.partition("->")
        for way in right.split("|"):
            symbols = way.replace("(", " ( ").replace(")", " ) ").split()
            productions.append((left.strip(), [] if symbols in (["epsilon"], []) else symbols))
    return Grammar(sections["Start"].strip(), sections.get("Terminal", "").split(), productions)


def rules(grammar: Grammar) -> tuple[list[str], list[tuple], list[tuple]]:
    """Symbols that derive nothing; unary rules (lhs, y, keep); binary rules (lhs, y, z, take, same).

    take: whose attribute the result has (0 none, 1 left, 2 right); same: whether both attributes must agree.
    """
    has = lambda s: s.endswith("_i")
    empty = [a for a, r in grammar.productions if not r]
    unary = [(a, r[0], has(a) and has(r[0])) for a, r in grammar.productions if len(r) == 1]
    binary = [(a, r[0], r[1], (1 if has(r[0]) else 2) if has(a) else 0, has(r[0]) and has(r[1])) for a, r in grammar.productions if len(r) == 2]
    return empty, unary, binary


def rule_tables(spark: SparkSession, grammar: Grammar) -> tuple[list[str], DataFrame, DataFrame]:
    """The rules as tables."""
    empty, unary, binary = rules(grammar)
    return empty, spark.createDataFrame(unary, "lhs string, y string, keep boolean"), spark.createDataFrame(binary, "lhs string, y string, z string, take int, same boolean")


def blocks(width: int | None) -> Callable[[str], Column] | None:
    """Blocks of so many neighbouring nodes, for reach."""
    return (lambda node: F.expr(f"{node} div {width}")) if width else None


def reach(edges: DataFrame, grammar: Grammar, nodes: DataFrame | None = None, wanted: str | None = None, most_local: int = local.MOST_EDGES, block: Callable[[str], Column] | None = None) -> DataFrame:
    """All derived edges (src, dst, sym, attr), or those of the symbol wanted. Labels with an attribute are named with `_i`, like in the grammar.

    Without nodes, units (see plans.fixpoint.units, which takes block) of at most `most_local` edges are solved in a task each, larger
    ones by rounds of joins.
    """
    seed = edges.select("src", "dst", "sym", F.coalesce("attr", F.lit(NONE)).cast("long").alias("attr"))
    if most_local and nodes is None:
        empty, unary, binary = rules(grammar.binary())
        small, large = split(table(seed.distinct()), most_local, block)
        found = table(local.reach_units(small, empty, unary, binary, NONE, wanted))
        return found if large is None else found.unionByName(reach(large, grammar, wanted=wanted, most_local=0))
    spark = edges.sparkSession
    empty, unary, binary = rule_tables(spark, grammar.binary())
    every = nodes if nodes is not None else edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    every = every.select("node").distinct()
    for s in empty:
        seed = seed.unionByName(every.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(s).alias("sym"), F.lit(NONE).cast("long").alias("attr")))
    none = F.lit(NONE).cast("long")

    def paired(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.withColumnRenamed("sym", "y").join(F.broadcast(binary), "y")  # rules: as many as the grammar has
        b = right.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("sym").alias("z"), F.col("attr").alias("attr2"))
        both = a.join(b, (a["dst"] == b["mid"]) & (a["z"] == b["z"])).where(~F.col("same") | (F.col("attr") == F.col("attr2")))
        attr = F.when(F.col("take") == 1, F.col("attr")).when(F.col("take") == 2, F.col("attr2")).otherwise(none)
        return both.select("src", F.col("end").alias("dst"), F.col("lhs").alias("sym"), attr.alias("attr"))

    def step(full: Relations, delta: Relations) -> Relations:
        d, f = delta["edge"], full["edge"]
        one = d.withColumnRenamed("sym", "y").join(F.broadcast(unary), "y").select("src", "dst", F.col("lhs").alias("sym"), F.when(F.col("keep"), F.col("attr")).otherwise(none).alias("attr"))
        return {"edge": one.unionByName(paired(d, f)).unionByName(paired(f, d))}

    found = fixpoint({"edge": seed}, step)["edge"]
    return found if wanted is None else found.where(F.col("sym") == wanted)


#: Matched calls and returns around plain value flow.
VALUE_FLOW = """
Start: F
Terminal: a call_i ret_i
Productions:
  F -> a | F F | call_i ret_i | C_i ret_i;
  C_i -> call_i F;
"""
