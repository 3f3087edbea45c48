"""Queries of the checkers: path conditions, release and file reports, sources out of wrappers, locks, threads, contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cfl, concurrency, conditions, slices
from ..sources import facts
from .registry import CFL_EDGES, DOM, _cfl_edges, _flow, query
from .scratch import shared_dir, table

N = 1 << conditions.VARS
# nodes are orders, 16 a procedure; lines make some of them sources or sinks
PATHS = f"""WITH RECURSIVE {DOM}, ways AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k, count(*) OVER (PARTITION BY src) AS n FROM flow),
sources AS (SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_partkey % {{a}} = 0), sinks AS (SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_suppkey % {{b}} = 1),
walk(source, node, a) AS (SELECT node, node, a FROM sources, (SELECT range AS a FROM range({N})) UNION SELECT w.source, y.dst, w.a FROM walk w JOIN ways y ON y.src = w.node WHERE y.n = 1 OR ((w.a >> (y.src % {conditions.VARS})::INT) & 1 = 1) = (y.k = 1)),
found AS (SELECT source, node AS sink, sum(1::BIGINT << a::INT)::BIGINT AS cond FROM (SELECT DISTINCT source, node, a FROM walk SEMI JOIN sinks USING (node)) GROUP BY ALL),
verdict AS (SELECT s.node AS source, coalesce(c.n, 0) AS n, coalesce(c.most, 0) > 1 AS twice FROM sources s LEFT JOIN (SELECT source, count(*) AS n, max(m) AS most FROM (SELECT source, a, count(*) AS m FROM (SELECT DISTINCT source, node, a FROM walk SEMI JOIN sinks USING (node)) GROUP BY ALL) GROUP BY source) c ON c.source = s.node)"""
MEMORY, FILES = PATHS.format(a=11, b=6), PATHS.format(a=13, b=5)


def _paths(spark: SparkSession, sf_dir: str, a: int, b: int) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("node"), "l_partkey", "l_suppkey")
    source, sink = table(lines.where(F.col("l_partkey") % a == 0).select("node").distinct()), lines.where(F.col("l_suppkey") % b == 1)
    return source, table(conditions.at_sinks(conditions.along(conditions.guarded(_flow(spark, sf_dir)), source), sink))


@query(f"{MEMORY} SELECT source, sink, cond FROM found")
def path_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, 11, 6)[1]


@query(f"{MEMORY} SELECT source, CASE WHEN n = 0 THEN 'never' WHEN n = {N} THEN 'always' ELSE 'partial' END AS verdict, twice FROM verdict")
def release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.report(*_paths(spark, sf_dir, 11, 6))


@query(f"{FILES} SELECT source, CASE WHEN n = 0 THEN 'never closed' WHEN n = {N} THEN 'closed' ELSE 'partly closed' END AS verdict FROM verdict")
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.report(*_paths(spark, sf_dir, 13, 5), "never closed", "partly closed", "closed").select("source", "verdict")


@query(f"""{MEMORY}, kinds AS (SELECT source, 'never released' AS kind FROM verdict WHERE n = 0 UNION ALL SELECT source, 'partly released' FROM verdict WHERE n > 0 AND n < {N} UNION ALL SELECT source, 'released twice' FROM verdict WHERE twice)
SELECT kind, k.source, count(sink) AS n_events, min(sink) AS first_sink, max(sink) AS last_sink FROM kinds k LEFT JOIN found f ON f.source = k.source GROUP BY ALL""")
def bug_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON to the shared folder and read back."""
    source, found = _paths(spark, sf_dir, 11, 6)
    path = f"{shared_dir(spark)}/bugs-{uuid.uuid4().hex}"
    conditions.write_bugs(conditions.bugs(conditions.report(source, found), found), path)
    events = F.transform("events", lambda e: e["node"])
    return conditions.read_bugs(spark, path).select("kind", "source", F.size("events").cast("long").alias("n_events"), F.array_min(events).alias("first_sink"), F.array_max(events).alias("last_sink"))


@query(f"""WITH RECURSIVE {facts.CALL_SQL}, gives(fun) AS (SELECT DISTINCT callee FROM call WHERE callee % 37 = 0 UNION SELECT c.caller FROM gives g JOIN call c ON c.callee = g.fun WHERE c.caller % 3 = 0)
SELECT DISTINCT site FROM call WHERE callee IN (SELECT fun FROM gives) AND (caller NOT IN (SELECT fun FROM gives) OR caller % 37 = 0 AND caller IN (SELECT callee FROM call))""")
def lifted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(facts.calls(spark, sf_dir))
    base = calls.where("callee % 37 = 0").select(F.col("callee").alias("fun")).distinct()
    return conditions.lifted(calls, base, calls.where("caller % 3 = 0").select(F.col("caller").alias("fun")).distinct())


ROLES = {"purchase": "sink", "view": "source", "click": "source", "signup": "sink"}


@query(f"""SELECT event_id AS site, event_type AS name, CASE event_type {' '.join(f"WHEN '{n}' THEN '{r}'" for n, r in ROLES.items())} END AS role FROM events WHERE event_type IN ({', '.join(f"'{n}'" for n in ROLES)})""")
def role_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return conditions.with_roles(events.select(F.col("event_id").alias("site"), F.col("event_type").alias("name")), ROLES)


LOCKS = f"""WITH RECURSIVE {DOM}, taken AS (SELECT DISTINCT l_orderkey // 16 * 3 + l_suppkey % 3 AS lock, l_orderkey AS node FROM lineitem WHERE l_partkey % 9 = 0), given AS (SELECT DISTINCT l_orderkey // 16 * 3 + l_suppkey % 3 AS lock, l_orderkey AS node FROM lineitem WHERE l_partkey % 9 = 1),
fwd(lock, node) AS (SELECT lock, dst FROM taken JOIN flow ON src = node UNION SELECT f.lock, e.dst FROM fwd f JOIN flow e ON e.src = f.node WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.lock = f.lock AND g.node = f.node)),
bwd(lock, node) AS (SELECT lock, src FROM given JOIN flow ON dst = node UNION SELECT b.lock, e.src FROM bwd b JOIN flow e ON e.dst = b.node WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.lock = b.lock AND t.node = b.node)),
held AS (SELECT lock, node FROM fwd INTERSECT SELECT lock, node FROM bwd)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = lambda k: lines.where(f"l_partkey % 9 = {k}").select(F.expr("l_orderkey div 16 * 3 + l_suppkey % 3").alias("lock"), F.col("l_orderkey").alias("node"))
    return concurrency.held(_flow(spark, sf_dir), at(0), at(1))


@query(f"{LOCKS} SELECT lock, node FROM held")
def lock_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir)


@query(f"{LOCKS} SELECT DISTINCT x.node AS a, y.node AS b FROM held x JOIN held y ON x.lock = y.lock AND x.node < y.node")
def common_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    holds = table(_held(spark, sf_dir))
    return concurrency.sharing_a_lock(holds, holds.select("node", F.expr("node div 16").alias("grp")).distinct())


FORKED = f"WITH RECURSIVE {facts.CALL_SQL}, fork AS (SELECT * FROM call WHERE site % 7 = 0), plain AS (SELECT * FROM call WHERE site % 7 <> 0)"


def _forked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = table(facts.calls(spark, sf_dir))
    return calls.where("site % 7 <> 0"), calls.where("site % 7 = 0")


@query(f"""{FORKED}, spawner(fun) AS (SELECT caller FROM fork UNION SELECT p.caller FROM spawner s JOIN plain p ON p.callee = s.fun), spawnee(fun) AS (SELECT callee FROM fork UNION SELECT p.callee FROM spawnee s JOIN plain p ON p.caller = s.fun),
follower(fun) AS (SELECT p.callee FROM plain p JOIN (SELECT caller, min(site) AS first FROM fork GROUP BY caller) f ON f.caller = p.caller AND p.site > f.first UNION SELECT p.callee FROM follower s JOIN plain p ON p.caller = s.fun)
SELECT fun, fun IN (SELECT fun FROM spawner) AS spawner, fun IN (SELECT fun FROM spawnee) AS spawnee, fun IN (SELECT fun FROM follower) AS follower FROM (SELECT caller AS fun FROM call UNION SELECT callee FROM call)""")
def procedure_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concurrency.procedures(*_forked(spark, sf_dir))


@query(f"""{FORKED}, multi(fun) AS (SELECT callee FROM fork GROUP BY caller, callee HAVING count(DISTINCT site) > 1 UNION SELECT f.callee FROM multi m JOIN fork f ON f.caller = m.fun)
SELECT callee AS thread, count(DISTINCT (caller, site)) AS n_forks, callee IN (SELECT fun FROM multi) AS multi FROM fork GROUP BY callee""")
def forked_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concurrency.threads(_forked(spark, sf_dir)[1])


@query(f"""WITH RECURSIVE {CFL_EDGES}, walk(source, node, cxt) AS (SELECT DISTINCT src, src, []::BIGINT[] FROM edge WHERE src % 8 = 0 UNION
  SELECT w.source, e.dst, CASE e.sym WHEN 'call_i' THEN list_concat(w.cxt, [e.attr::BIGINT])[-2:] WHEN 'ret_i' THEN w.cxt[:len(w.cxt) - 1] ELSE w.cxt END FROM walk w JOIN edge e ON e.src = w.node WHERE e.sym <> 'ret_i' OR len(w.cxt) = 0 OR w.cxt[-1] = e.attr)
SELECT source, node, count(*) AS n_contexts FROM walk GROUP BY source, node""")
def context_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(_cfl_edges(spark, sf_dir))
    start = edges.where("src % 8 = 0").select(F.col("src").alias("node")).distinct()
    return slices.context_counts(edges, start, 2, block=cfl.blocks(32))
