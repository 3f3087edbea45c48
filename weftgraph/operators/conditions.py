"""Path conditions on slices, and the reports of checkers that use them.

Each branching node has one of VARS boolean variables; a condition is its truth table, the bits of one number: AND and OR are those of
bits, satisfiable is not zero, true on every path is ALL. Nothing has to be solved, and a disjunction over paths is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import table

#: Boolean variables: 2**VARS assignments are the bits of a condition.
VARS = 5
ALL = (1 << (1 << VARS)) - 1
#: The truth table of each variable.
TABLES = [sum(1 << a for a in range(1 << VARS) if a >> v & 1) for v in range(VARS)]


def guarded(flow: DataFrame) -> DataFrame:
    """(src, dst, guard): the first successor of a branch is taken if its variable (node modulo VARS) holds, the others if not."""
    w = Window.partitionBy("src")
    ways = flow.select("src", "dst").distinct().select("src", "dst", F.row_number().over(w.orderBy("dst")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    holds = F.element_at(F.array(*[F.lit(t) for t in TABLES]).cast("array<long>"), (F.pmod("src", F.lit(VARS)) + 1).cast("int"))
    guard = F.when(F.col("n") == 1, F.lit(ALL)).when(F.col("k") == 1, holds).otherwise(F.lit(ALL).bitwiseXOR(holds))
    return ways.select("src", "dst", guard.alias("guard"))


def along(edges: DataFrame, source: DataFrame) -> DataFrame:
    """(source, node, cond): under which assignments a path leads from each source (node) to the node.

    cond(dst) = OR over edges of cond(src) AND guard; only assignments that are new at a node are sent on.
    """
    edges = table(edges)
    state = table(source.select(F.col("node").alias("source"), "node", F.lit(ALL).alias("cond")).distinct())
    delta = state
    while True:
        moved = delta.join(edges, delta["node"] == edges["src"]).select("source", F.col("dst").alias("node"), F.col("cond").bitwiseAND(F.col("guard")).alias("cond"))
        sent = moved.where("cond <> 0").groupBy("source", "node").agg(F.bit_or("cond").alias("more"))
        old, more = F.coalesce("cond", F.lit(0).cast("long")), F.coalesce("more", F.lit(0).cast("long"))
        grown = table(state.join(sent, ["source", "node"], "full_outer").select("source", "node", old.bitwiseOR(more).alias("cond"), more.bitwiseAND(F.bitwise_not(old)).alias("new")))
        delta = table(grown.where("new <> 0").select("source", "node", F.col("new").alias("cond")))
        state = grown.select("source", "node", "cond")
        if delta.isEmpty():
            return state


def at_sinks(conds: DataFrame, sink: DataFrame) -> DataFrame:
    """(source, sink, cond) of the sinks (node) that a source reaches."""
    return conds.join(sink.select("node").distinct(), "node", "left_semi").select("source", F.col("node").alias("sink"), "cond")


def report(source: DataFrame, found: DataFrame, never: str = "never", partly: str = "partial", always: str = "always") -> DataFrame:
    """(source, verdict, twice): whether sinks are met on no, some or all paths; twice: two sinks on one path (jointly satisfiable)."""
    fold = F.aggregate(F.collect_list("cond"), F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice")), lambda s, c: F.struct(s["once"].bitwiseOR(c).alias("once"), s["twice"].bitwiseOR(s["once"].bitwiseAND(c)).alias("twice")))
    said = found.groupBy("source").agg(fold.alias("f"))
    every = source.select(F.col("node").alias("source")).distinct().join(said, "source", "left")
    once, twice = (F.coalesce(f"f.{n}", F.lit(0).cast("long")) for n in ("once", "twice"))
    return every.select("source", F.when(once == 0, never).when(once == ALL, always).otherwise(partly).alias("verdict"), (twice != 0).alias("twice"))


BUG = "kind string, source long, events array<struct<type:string,node:long,cond:long>>"


def bugs(reported: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, source, events): sources that leak, on all or some paths, or are released twice; events are the sinks met, in order."""
    event = F.struct(F.lit("sink").alias("type"), F.col("sink").alias("node"), F.col("cond"))
    events = found.groupBy("source").agg(F.array_sort(F.collect_list(event)).alias("events"))
    kinds = F.array_compact(F.array(F.when(F.col("verdict") == "never", "never released"), F.when(F.col("verdict") == "partial", "partly released"), F.when(F.col("twice"), "released twice")))
    some = reported.select("source", F.explode(kinds).alias("kind")).join(events, "source", "left")
    return some.select("kind", "source", F.coalesce("events", F.array().cast("array<struct<type:string,node:long,cond:long>>")).alias("events"))


def write_bugs(found: DataFrame, path: str) -> None:
    """JSON lines, one a bug, with its stack of events."""
    found.select("kind", "source", "events").write.json(path)


def read_bugs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUG).json(path)


def with_roles(sites: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Call sites (site, name) of functions that have a role; the others go. The role table is as long as the API it describes."""
    known = sites.sparkSession.createDataFrame(sorted(roles.items()), "name string, role string")
    return sites.join(F.broadcast(known), "name")


def lifted(calls: DataFrame, base: DataFrame, returns: DataFrame) -> DataFrame:
    """(site) of sources (caller, callee, site): calls of base functions (fun), and of wrappers, out of which their own calls are lifted.

    A wrapper calls a base function or a wrapper and is among those that return what they got (fun).
    """
    from .slices import spread

    up = calls.join(returns.withColumnRenamed("fun", "caller"), "caller", "left_semi").select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    gives = table(spread(up, base.select(F.col("fun").alias("node"))))
    wrapper = gives.join(base.withColumnRenamed("fun", "node"), "node", "left_anti")
    hit = calls.join(gives.withColumnRenamed("node", "callee"), "callee", "left_semi")
    return hit.join(wrapper.withColumnRenamed("node", "caller"), "caller", "left_anti").select("site").distinct()
