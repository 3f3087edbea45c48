"""All queries of the graph engine by name, with the SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..operators import cfl, concurrency, dominance, inclusion, incremental, sets, slices
from ..sources import facts
from .fixpoint import closure, components, scc
from .scratch import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _solution(both_ways: bool = False, stmt: str = "stmt", name: str = "r") -> str:
    """A recursive CTE (k, a, b): 'p' points-to and 'c' copy facts of the least solution over a statement relation."""
    back = f"UNION SELECT 'p', c.a, p.b FROM {name} p JOIN recurring.{name} c ON p.k = 'p' AND c.k = 'c' AND c.b = p.a UNION SELECT 'p', c.a, p.b FROM {name} c JOIN recurring.{name} p ON p.k = 'p' AND c.k = 'c' AND c.b = p.a" if both_ways else ""
    return f"""
{name}(k, a, b) USING KEY (k, a, b) AS (
  SELECT CASE WHEN kind = 'addr' THEN 'p' ELSE 'c' END, CASE WHEN kind = 'addr' THEN dst ELSE src END, CASE WHEN kind = 'addr' THEN src ELSE dst END
  FROM {stmt} WHERE kind IN ('addr', 'copy')
  UNION
  (SELECT 'p', c.b, p.b FROM {name} p JOIN recurring.{name} c ON p.k = 'p' AND c.k = 'c' AND c.a = p.a
   UNION SELECT 'p', c.b, p.b FROM {name} c JOIN recurring.{name} p ON p.k = 'p' AND c.k = 'c' AND c.a = p.a
   {back}
   UNION SELECT 'c', p.b, s.dst FROM {name} p JOIN {stmt} s ON p.k = 'p' AND s.kind = 'load' AND s.src = p.a
   UNION SELECT 'c', s.src, p.b FROM {name} p JOIN {stmt} s ON p.k = 'p' AND s.kind = 'store' AND s.dst = p.a))"""


WITH = f"WITH RECURSIVE {facts.STMT_SQL}"
PTS = f"{WITH}, {_solution()}, pts AS (SELECT a AS var, b AS obj FROM r WHERE k = 'p')"
CALLS = f"WITH RECURSIVE {facts.CALL_SQL}, path(src, dst) AS (SELECT caller, callee FROM call UNION SELECT p.src, c.callee FROM path p JOIN call c ON p.dst = c.caller)"


def _pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inclusion.points_to(facts.statements(spark, sf_dir), facts.block)


# ---- whole-program solvers ---------------------------------------------------------------------------------------


@query(f"{PTS} SELECT var, obj FROM pts")
def points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pts(spark, sf_dir)


flagship = points_to


@query(f"{PTS} SELECT a AS src, b AS dst FROM r WHERE k = 'c'")
def copy_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inclusion.solve(facts.statements(spark, sf_dir))["copy"]


@query(f"{WITH}, {_solution(both_ways=True)} SELECT a AS var, b AS obj FROM r WHERE k = 'p'")
def unification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inclusion.unify(facts.statements(spark, sf_dir))


GEP = """
geps AS (SELECT CASE WHEN kind = 'copy' AND (src + dst) % 3 = 0 THEN 'gep' ELSE kind END AS kind, src, dst, CASE WHEN kind = 'copy' AND (src + dst) % 3 = 0 THEN 1 + dst % 4 ELSE 0 END AS off FROM stmt)"""


def _geps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmt = facts.statements(spark, sf_dir)
    gep = F.expr("kind = 'copy' and (src + dst) % 3 = 0")
    return stmt.select(F.when(gep, "gep").otherwise(F.col("kind")).alias("kind"), "src", "dst", F.when(gep, 1 + F.col("dst") % 4).otherwise(0).alias("off"))


@query(f"""{WITH}, {GEP}, r(k, a, af, b, bf) USING KEY (k, a, af, b, bf) AS (
  SELECT CASE WHEN kind = 'addr' THEN 'p' ELSE 'c' END, CASE WHEN kind = 'addr' THEN dst ELSE src END, 0::BIGINT, CASE WHEN kind = 'addr' THEN src ELSE dst END, 0::BIGINT FROM geps WHERE kind IN ('addr', 'copy')
  UNION
  (SELECT 'p', c.b, c.bf, p.b, p.bf FROM r p JOIN recurring.r c ON p.k = 'p' AND c.k = 'c' AND c.a = p.a AND c.af = p.af
   UNION SELECT 'p', c.b, c.bf, p.b, p.bf FROM r c JOIN recurring.r p ON p.k = 'p' AND c.k = 'c' AND c.a = p.a AND c.af = p.af
   UNION SELECT 'p', g.dst, 0, p.b, (p.bf + g.off) % 2 FROM r p JOIN geps g ON p.k = 'p' AND p.af = 0 AND g.kind = 'gep' AND g.src = p.a
   UNION SELECT 'c', p.b, p.bf, s.dst, 0 FROM r p JOIN geps s ON p.k = 'p' AND p.af = 0 AND s.kind = 'load' AND s.src = p.a
   UNION SELECT 'c', s.src, 0, p.b, p.bf FROM r p JOIN geps s ON p.k = 'p' AND p.af = 0 AND s.kind = 'store' AND s.dst = p.a))
SELECT a AS var, af AS vfld, b AS obj, bf AS fld FROM r WHERE k = 'p'""")
def points_to_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inclusion.points_to_fields(_geps(spark, sf_dir), limit=2)


@query()
def points_to_eight_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inclusion.points_to_fields(_geps(spark, sf_dir), limit=8)


@query(f"{PTS} SELECT var, obj FROM pts WHERE var IN (SELECT dst FROM stmt WHERE kind = 'store')")
def demand_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmt = facts.statements(spark, sf_dir)
    wanted = stmt.where("kind = 'store'").select(F.col("dst").alias("var")).distinct()
    return inclusion.demand(stmt, wanted)


# ---- sets of objects ---------------------------------------------------------------------------------------------


@query(f"{PTS} SELECT obj, count(*) AS n_vars, min(var) AS first_var, max(var) AS last_var FROM pts GROUP BY obj")
def reverse_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.reverse(_pts(spark, sf_dir))


@query(f"{PTS} SELECT count(*) AS n_pointers, sum(n)::BIGINT AS n_facts, avg(n) AS avg_size, max(n) AS max_size FROM (SELECT count(*) AS n FROM pts GROUP BY var)")
def points_to_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.statistics(_pts(spark, sf_dir))


@query(f"{PTS} SELECT DISTINCT p.var AS a, q.var AS b FROM pts p JOIN pts q ON p.obj = q.obj AND p.var < q.var")
def alias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.aliases(_pts(spark, sf_dir))


@query(f"""{PTS} SELECT DISTINCT s.src AS a, t.dst AS b, CASE WHEN EXISTS (SELECT 1 FROM pts p JOIN pts q ON p.obj = q.obj WHERE p.var = s.src AND q.var = t.dst) THEN 'MayAlias' ELSE 'NoAlias' END AS result
FROM stmt s JOIN stmt t ON s.kind = 'load' AND t.kind = 'store' AND s.src // {facts.VARS} = t.dst // {facts.VARS}""")
def alias_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmt = table(facts.statements(spark, sf_dir))
    loads = stmt.where("kind = 'load'").select(F.col("src").alias("a"), facts.module("src").alias("k"))
    stores = stmt.where("kind = 'store'").select(F.col("dst").alias("b"), facts.module("dst").alias("k"))
    return sets.alias_query(inclusion.points_to(stmt), loads.join(stores, "k"))


@query(f"{PTS} SELECT DISTINCT var, CASE WHEN obj % 3 = 0 THEN obj - obj % 10 ELSE obj END AS obj FROM pts")
def normalised_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _pts(spark, sf_dir)
    bases = pts.select("obj").distinct().where("obj % 3 = 0").select("obj", (F.col("obj") - F.col("obj") % 10).alias("base"))
    return sets.normalise(pts, bases)


EFFECTS = f"""{PTS}, {facts.FUN_SQL}, {facts.CALL_SQL}, path(src, dst) AS (SELECT caller, callee FROM call UNION SELECT p.src, c.callee FROM path p JOIN call c ON p.dst = c.caller),
local AS (SELECT DISTINCT fun, obj, 'ref' AS effect FROM fun_of JOIN pts ON kind = 'load' AND src = var UNION SELECT DISTINCT fun, obj, 'mod' FROM fun_of JOIN pts ON kind = 'store' AND dst = var),
effects AS (SELECT fun, obj, effect FROM local UNION SELECT p.src, l.obj, l.effect FROM path p JOIN local l ON p.dst = l.fun)"""


def _local_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmt = table(facts.statements(spark, sf_dir))
    return table(sets.local_effects(facts.with_functions(stmt), inclusion.points_to(stmt, facts.block)))


@query(f"{EFFECTS} SELECT fun, effect, count(*) AS n_objs, min(obj) AS first_obj, max(obj) AS last_obj, sum(obj)::BIGINT AS sum_obj FROM effects GROUP BY fun, effect")
def function_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.effect_sizes(_local_effects(spark, sf_dir), facts.calls(spark, sf_dir))


@query(f"""{EFFECTS} SELECT DISTINCT site, c.callee, CASE WHEN m AND r THEN 'ModRef' WHEN m THEN 'Mod' WHEN r THEN 'Ref' ELSE 'NoModRef' END AS result
FROM call c LEFT JOIN (SELECT fun, bool_or(effect = 'mod') AS m, bool_or(effect = 'ref') AS r FROM effects GROUP BY fun) e ON c.callee = e.fun""")
def mod_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(facts.calls(spark, sf_dir))
    return sets.mod_ref(sets.effect_kinds(_local_effects(spark, sf_dir), calls), calls)


REGION_SETS = "member AS (SELECT DISTINCT l_partkey % 20 AS fun, l_orderkey AS set_id, l_suppkey AS obj FROM lineitem)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select((F.col("l_partkey") % 20).alias("fun"), F.col("l_orderkey").alias("set_id"), F.col("l_suppkey").alias("obj")).distinct()


@query(f"WITH {REGION_SETS} SELECT fun, min(obj) AS region, count(*) AS n_objs, max(obj) AS last_obj, any_value(len(s))::INTEGER AS n_sets FROM (SELECT fun, obj, list_sort(list(set_id)) AS s FROM member GROUP BY fun, obj) GROUP BY fun, s")
def regions_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.regions(_members(spark, sf_dir), ["fun"])


@query(f"WITH {REGION_SETS} SELECT min(obj) AS region, count(*) AS n_objs, max(obj) AS last_obj, any_value(len(s))::INTEGER AS n_sets FROM (SELECT obj, list_sort(list(DISTINCT set_id)) AS s FROM member GROUP BY obj) GROUP BY s")
def regions_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.regions(_members(spark, sf_dir), [])


@query(f"WITH {REGION_SETS} SELECT DISTINCT fun, obj AS region FROM member")
def regions_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("fun", F.col("obj").alias("region")).distinct()


NUMBERED = "numbered AS (SELECT *, CASE kind WHEN 'addr' THEN 0 WHEN 'copy' THEN 1 WHEN 'load' THEN 2 ELSE 3 END + 4 * (src * 700000001 + dst) AS id FROM stmt)"


def _numbered(stmt: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "addr", 0).when(F.col("kind") == "copy", 1).when(F.col("kind") == "load", 2).otherwise(3)
    return stmt.withColumn("id", kind + 4 * (F.col("src") * 700000001 + F.col("dst")))


@query(f"""{WITH}, {NUMBERED} SELECT DISTINCT d.id AS def, u.id AS use FROM numbered d JOIN (SELECT id, src AS v FROM numbered WHERE kind <> 'addr' UNION ALL SELECT id, dst FROM numbered WHERE kind = 'store') u ON d.kind <> 'store' AND d.dst = u.v""")
def value_flow_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.def_use(_numbered(facts.statements(spark, sf_dir)))


@query(f"""{PTS}, {NUMBERED} SELECT s.id AS store, l.id AS load, count(*) AS n_objs FROM numbered s JOIN pts p ON s.kind = 'store' AND s.dst = p.var JOIN pts q ON p.obj = q.obj JOIN numbered l ON l.kind = 'load' AND l.src = q.var GROUP BY s.id, l.id""")
def value_flow_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmt = table(_numbered(facts.statements(spark, sf_dir)))
    return sets.indirect_flow(stmt, inclusion.points_to(stmt.select("kind", "src", "dst")))


# ---- graphs ------------------------------------------------------------------------------------------------------


@query(f"{CALLS} SELECT DISTINCT src, dst FROM path")
def call_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(facts.calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("dst")))


@query(f"{CALLS}, node AS (SELECT caller AS node FROM call UNION SELECT callee FROM call) SELECT node, least(node, coalesce((SELECT min(p.dst) FROM path p JOIN path q ON p.src = q.dst AND p.dst = q.src WHERE p.src = node), node)) AS rep FROM node")
def call_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(facts.calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return scc(nodes, edges)


@query(f"""{WITH}, edge AS (SELECT src, dst FROM stmt WHERE kind = 'copy'), walk(node, seen) AS (SELECT src, src FROM edge UNION SELECT dst, dst FROM edge UNION SELECT node, other FROM walk JOIN (SELECT src AS x, dst AS other FROM edge UNION ALL SELECT dst, src FROM edge) ON seen = x)
SELECT node, min(seen) AS rep FROM walk GROUP BY node""")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(facts.statements(spark, sf_dir).where("kind = 'copy'").select("src", "dst"))
    return components(edges.select(F.col("src").alias("node")).union(edges.select("dst")), edges)


@query(f"{WITH} SELECT node, sum(n_in)::BIGINT AS n_in, sum(n_out)::BIGINT AS n_out FROM (SELECT dst AS node, 1 AS n_in, 0 AS n_out FROM stmt UNION ALL SELECT src, 0, 1 FROM stmt) GROUP BY node")
def degree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stmt = facts.statements(spark, sf_dir)
    ends = stmt.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


CFL_EDGES = """
edge AS (SELECT DISTINCT l_orderkey // 16 * 32 + l_partkey % 32 AS src, l_orderkey // 16 * 32 + (l_suppkey * 7 + l_linenumber * 13) % 32 AS dst, CASE WHEN m < 2 THEN 'a' WHEN m < 4 THEN 'call_i' ELSE 'ret_i' END AS sym, CASE WHEN m < 2 THEN -1 ELSE l_linenumber END AS attr
  FROM (SELECT *, (l_partkey + l_suppkey + l_linenumber) % 6 AS m FROM lineitem))"""


def _cfl_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("m", F.expr("(l_partkey + l_suppkey + l_linenumber) % 6"))
    sym = F.when(F.col("m") < 2, "a").when(F.col("m") < 4, "call_i").otherwise("ret_i")
    return lines.select(F.expr("l_orderkey div 16 * 32 + l_partkey % 32").alias("src"), F.expr("l_orderkey div 16 * 32 + (l_suppkey * 7 + l_linenumber * 13) % 32").alias("dst"), sym.alias("sym"), F.when(F.col("m") < 2, -1).otherwise(F.col("l_linenumber")).alias("attr")).distinct()


@query(f"""WITH RECURSIVE {CFL_EDGES}, r(s, a, b, t) USING KEY (s, a, b, t) AS (
  SELECT 'F', src, dst, -1 FROM edge WHERE sym = 'a'
  UNION SELECT 'F', c.src, e.dst, -1 FROM edge c JOIN edge e ON c.sym = 'call_i' AND e.sym = 'ret_i' AND c.dst = e.src AND c.attr = e.attr
  UNION
  (SELECT 'F', x.a, y.b, -1 FROM r x JOIN recurring.r y ON x.s = 'F' AND y.s = 'F' AND x.b = y.a
   UNION SELECT 'F', y.a, x.b, -1 FROM r x JOIN recurring.r y ON x.s = 'F' AND y.s = 'F' AND y.b = x.a
   UNION SELECT 'C', c.src, x.b, c.attr FROM r x JOIN edge c ON x.s = 'F' AND c.sym = 'call_i' AND c.dst = x.a
   UNION SELECT 'F', x.a, e.dst, -1 FROM r x JOIN edge e ON x.s = 'C' AND e.sym = 'ret_i' AND e.src = x.b AND e.attr = x.t))
SELECT DISTINCT a AS src, b AS dst FROM r WHERE s = 'F'""")
def cfl_value_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfl.reach(_cfl_edges(spark, sf_dir), cfl.parse(cfl.VALUE_FLOW), wanted="F", block=cfl.blocks(32)).select("src", "dst")


DOM = """
flow AS (SELECT DISTINCT l_orderkey AS src, l_orderkey // 16 * 16 + (l_orderkey % 16 + 1 + l_partkey % 3) % 16 AS dst FROM lineitem)"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("src"), F.expr("l_orderkey div 16 * 16 + (l_orderkey % 16 + 1 + l_partkey % 3) % 16").alias("dst")).distinct()


def _roots(flow: DataFrame) -> DataFrame:
    """The least node of each procedure: 16 nodes are one."""
    return flow.groupBy(F.expr("src div 16")).agg(F.min("src").alias("node")).select("node")


@query(f"""WITH RECURSIVE {DOM}, root AS (SELECT min(src) AS root FROM flow GROUP BY src // 16), live(node) AS (SELECT root FROM root UNION SELECT dst FROM live JOIN flow ON src = node),
avoid(d, node) AS (SELECT l.node, r.root FROM live l JOIN root r ON l.node // 16 = r.root // 16 WHERE l.node <> r.root UNION SELECT d, dst FROM avoid JOIN flow ON src = avoid.node WHERE dst <> d)
SELECT d.node AS dom, l.node AS node FROM live d JOIN live l ON d.node // 16 = l.node // 16 WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.d = d.node AND a.node = l.node)""")
def dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = table(_flow(spark, sf_dir))
    return dominance.dominators(flow, _roots(flow))


@query(f"""WITH RECURSIVE {DOM}, root AS (SELECT min(src) AS root FROM flow GROUP BY src // 16), live(node) AS (SELECT root FROM root UNION SELECT dst FROM live JOIN flow ON src = node),
avoid(d, node) AS (SELECT l.node, r.root FROM live l JOIN root r ON l.node // 16 = r.root // 16 WHERE l.node <> r.root UNION SELECT d, dst FROM avoid JOIN flow ON src = avoid.node WHERE dst <> d),
dom AS (SELECT d.node AS dom, l.node AS node FROM live d JOIN live l ON d.node // 16 = l.node // 16 WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.d = d.node AND a.node = l.node))
SELECT DISTINCT m.dom AS node, f.dst AS frontier FROM flow f JOIN dom m ON m.node = f.src WHERE NOT EXISTS (SELECT 1 FROM dom x WHERE x.dom = m.dom AND x.node = f.dst AND m.dom <> f.dst)""")
def dominance_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = table(_flow(spark, sf_dir))
    return dominance.frontier(flow, table(dominance.dominators(flow, _roots(flow))))


# ---- incremental -------------------------------------------------------------------------------------------------

# the old program lacks the statements with (src + dst) % 16 = 5; the new one lacks those with 3
OLD, NEW = "old AS (SELECT * FROM stmt WHERE (src + dst) % 16 <> 5)", "new AS (SELECT * FROM stmt WHERE (src + dst) % 16 <> 3)"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stmt = table(facts.statements(spark, sf_dir))
    return stmt.where("(src + dst) % 16 <> 5"), stmt.where("(src + dst) % 16 = 3"), stmt.where("(src + dst) % 16 = 5")


@query(f"{WITH}, {NEW}, {_solution(stmt='new')} SELECT a AS var, b AS obj FROM r WHERE k = 'p'")
def incremental_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, deleted, inserted = _versions(spark, sf_dir)
    solved = inclusion.solve(old, block=facts.block)
    return incremental.apply(old, solved["pts"], solved["copy"], deleted, inserted, block=facts.block)[1]["pts"]


@query(f"""{WITH}, {OLD}, {NEW}, {_solution(stmt='old', name='r')}, {_solution(stmt='new', name='q')}, o AS (SELECT a AS var, b AS obj FROM r WHERE k = 'p'), n AS (SELECT a AS var, b AS obj FROM q WHERE k = 'p')
SELECT '-' AS op, var, obj FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT '+', var, obj FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def points_to_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, deleted, inserted = _versions(spark, sf_dir)
    solved = inclusion.solve(old, block=facts.block)
    new = incremental.apply(old, solved["pts"], solved["copy"], deleted, inserted, block=facts.block)[1]["pts"]
    return incremental.changes(solved["pts"], new)


@query("""SELECT event_id, user_id AS path, event_id AS line FROM events e
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.user_id AND e.event_id BETWEEN o.o_orderkey AND o.o_orderkey + o.o_custkey % 90)""")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("path"), F.col("event_id").alias("line"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.col("o_orderkey")
    return incremental.changed_lines(lines, o.select(F.col("o_custkey").alias("path"), start.alias("row_start"), (start + F.col("o_custkey") % 90).alias("row_end")))


# ---- slices, threads ---------------------------------------------------------------------------------------------

SLICE = f"""{WITH}, flow AS (SELECT src, dst FROM stmt WHERE kind IN ('copy', 'load')), source AS (SELECT DISTINCT dst AS node FROM stmt WHERE kind = 'addr'), sink AS (SELECT DISTINCT src AS node FROM stmt WHERE kind = 'store'),
fwd(source, node) AS (SELECT node, node FROM source UNION SELECT source, dst FROM fwd JOIN flow ON node = src)"""


def _slice_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stmt = table(facts.statements(spark, sf_dir))
    return stmt.where("kind in ('copy', 'load')").select("src", "dst"), stmt.where("kind = 'addr'").select(F.col("dst").alias("node")).distinct(), stmt.where("kind = 'store'").select(F.col("src").alias("node")).distinct()


@query(f"{SLICE} SELECT source, f.node AS sink FROM fwd f JOIN sink s ON f.node = s.node")
def source_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow, source, sink = _slice_inputs(spark, sf_dir)
    return slices.reached(slices.forward(flow, source), sink)


@query(f"""{SLICE}, bwd(source, node) AS (SELECT source, f.node FROM fwd f JOIN sink s ON f.node = s.node UNION SELECT b.source, f.node FROM bwd b JOIN flow e ON e.dst = b.node JOIN fwd f ON f.source = b.source AND f.node = e.src)
SELECT source, count(*) AS n_nodes, min(node) AS first_node, max(node) AS last_node FROM bwd GROUP BY source""")
def source_sink_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow, source, sink = _slice_inputs(spark, sf_dir)
    both = slices.sliced(flow, source, sink)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))


@query(f"""{SLICE}, hit AS (SELECT DISTINCT source FROM fwd f JOIN sink s ON f.node = s.node), bad AS (SELECT DISTINCT source FROM fwd f WHERE NOT EXISTS (SELECT 1 FROM flow WHERE src = f.node) AND f.node NOT IN (SELECT node FROM sink))
SELECT node AS source, CASE WHEN node NOT IN (SELECT source FROM hit) THEN 'never' WHEN node IN (SELECT source FROM bad) THEN 'partial' ELSE 'always' END AS released FROM source""")
def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.leaks(*_slice_inputs(spark, sf_dir))


FORKS = """
fork AS (SELECT DISTINCT o_custkey AS parent, o_custkey + 1 + o_orderkey % 3 AS child, o_orderkey % 100 AS at FROM orders),
joined AS (SELECT DISTINCT o_custkey AS parent, o_custkey + 1 + o_orderkey % 3 AS child, 50 + o_orderkey % 50 AS at FROM orders),
access AS (SELECT DISTINCT e.user_id AS thread, e.event_id % 97 AS pos, e.event_id % 23 AS obj, e.event_type = 'purchase' AS writes, e.event_id % 7 AS lock FROM events e)"""


def _threads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    child = (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("child")
    fork = o.select(F.col("o_custkey").alias("parent"), child, (F.col("o_orderkey") % 100).alias("at")).distinct()
    joined = o.select(F.col("o_custkey").alias("parent"), child, (50 + F.col("o_orderkey") % 50).alias("at")).distinct()
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    access = e.select(F.col("user_id").alias("thread"), (F.col("event_id") % 97).alias("pos"), (F.col("event_id") % 23).alias("obj"), (F.col("event_type") == "purchase").alias("writes"), (F.col("event_id") % 7).alias("lock")).distinct()
    return access, fork, joined


@query(f"""WITH {FORKS}, alive AS (SELECT f.parent, f.child, min(f.at) AS since, min(j.at) AS until FROM fork f LEFT JOIN joined j ON j.parent = f.parent AND j.child = f.child AND j.at > f.at GROUP BY f.parent, f.child)
SELECT DISTINCT a.thread AS thread_a, a.pos AS pos_a, b.thread AS thread_b, b.pos AS pos_b, a.obj FROM access a JOIN alive v ON v.parent = a.thread AND a.pos > v.since AND (v.until IS NULL OR a.pos < v.until) JOIN access b ON b.thread = v.child AND b.obj = a.obj
WHERE (a.writes OR b.writes) AND a.lock <> b.lock""")
def race_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    access, fork, joined = _threads(spark, sf_dir)
    return concurrency.races(access, concurrency.alive(fork, joined))


@query()
def thread_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concurrency.all_races(*_threads(spark, sf_dir))


# ---- intervals ---------------------------------------------------------------------------------------------------


@query("""SELECT l_partkey AS part, min(l_quantity) AS lb, max(l_quantity) AS ub, min(l_quantity) + min(l_tax) AS sum_lb, max(l_quantity) + max(l_tax) AS sum_ub, min(l_quantity) - max(l_discount) AS diff_lb, max(l_quantity) - min(l_discount) AS diff_ub,
  least(min(l_quantity) * min(l_discount), min(l_quantity) * max(l_discount), max(l_quantity) * min(l_discount), max(l_quantity) * max(l_discount)) AS prod_lb,
  greatest(min(l_quantity) * min(l_discount), min(l_quantity) * max(l_discount), max(l_quantity) * min(l_discount), max(l_quantity) * max(l_discount)) AS prod_ub,
  CASE WHEN max(l_tax) < min(l_discount) THEN 1.0 WHEN min(l_tax) >= max(l_discount) THEN 0.0 WHEN true THEN 0.0 END::DOUBLE AS less_lb, CASE WHEN min(l_tax) >= max(l_discount) THEN 0.0 ELSE 1.0 END::DOUBLE AS less_ub FROM lineitem GROUP BY l_partkey""")
def interval_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ranges = lines.groupBy(F.col("l_partkey").alias("part")).agg(*[F.struct(F.min(c).alias("lb"), F.max(c).alias("ub")).alias(n) for c, n in (("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t"))])
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    said = ranges.select("part", "q", iv.add(q, t).alias("sum"), iv.subtract(q, d).alias("diff"), iv.multiply(q, d).alias("prod"), iv.less(t, d).alias("less"))
    ends = [F.col(f"{n}.{e}").alias(f"{n}_{e}") for n in ("sum", "diff", "prod", "less") for e in ("lb", "ub")]
    return said.select("part", F.col("q.lb").alias("lb"), F.col("q.ub").alias("ub"), *ends)


@query("""WITH a AS (SELECT l_suppkey AS supp, l_returnflag AS flag, min(l_quantity) AS lb, max(l_quantity) AS ub FROM lineitem GROUP BY ALL), x AS (SELECT * FROM a WHERE flag = 'A'), y AS (SELECT * FROM a WHERE flag = 'N')
SELECT coalesce(x.supp, y.supp) AS supp, least(x.lb, y.lb) AS join_lb, greatest(x.ub, y.ub) AS join_ub,
  CASE WHEN greatest(x.lb, y.lb) <= least(x.ub, y.ub) AND x.supp IS NOT NULL AND y.supp IS NOT NULL THEN greatest(x.lb, y.lb) END AS meet_lb, CASE WHEN greatest(x.lb, y.lb) <= least(x.ub, y.ub) AND x.supp IS NOT NULL AND y.supp IS NOT NULL THEN least(x.ub, y.ub) END AS meet_ub,
  CASE WHEN x.supp IS NULL THEN y.lb WHEN y.supp IS NULL THEN x.lb WHEN y.lb < x.lb THEN '-infinity'::DOUBLE ELSE x.lb END AS wide_lb, CASE WHEN x.supp IS NULL THEN y.ub WHEN y.supp IS NULL THEN x.ub WHEN y.ub > x.ub THEN 'infinity'::DOUBLE ELSE x.ub END AS wide_ub,
  (x.supp IS NULL OR (y.supp IS NOT NULL AND x.lb >= y.lb AND x.ub <= y.ub)) AS leq FROM x FULL JOIN y ON x.supp = y.supp""")
def interval_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lattice(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _lattice(lines: DataFrame) -> DataFrame:
    """Per supplier, the lattice operations on the quantities' intervals of return flags A and N."""
    ranges = lines.where("l_returnflag in ('A', 'N')").groupBy(F.col("l_suppkey").alias("supp")).agg(*[F.struct(F.min(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias("lb"), F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias("ub")).alias(n) for f, n in (("A", "x"), ("N", "y"))])
    some = ranges.select("supp", *[F.when(F.col(f"{n}.lb").isNotNull(), F.col(n)).alias(n) for n in ("x", "y")])
    x, y = F.col("x"), F.col("y")
    made = some.select("supp", iv.join(x, y).alias("join"), iv.meet(x, y).alias("meet"), iv.widen(x, y).alias("wide"), iv.leq(x, y).alias("leq"))
    return made.select("supp", *[F.col(f"{n}.{e}").alias(f"{n}_{e}") for n in ("join", "meet", "wide") for e in ("lb", "ub")], "leq")
