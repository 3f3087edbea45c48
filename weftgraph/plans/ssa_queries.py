"""Queries on memory SSA: versions of regions in the procedures that orders' lines make, and their value flow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory_ssa
from .registry import DOM, _flow, _roots, query
from .scratch import shared_dir, table

# nodes are orders, 16 a procedure; a line reads or writes one of four regions
SSA = f"""WITH RECURSIVE {DOM}, head AS (SELECT min(src) AS root FROM flow GROUP BY src // 16), live(node) AS (SELECT root FROM head UNION SELECT dst FROM live JOIN flow ON src = node),
avoid(d, node) AS (SELECT l.node, r.root FROM live l JOIN head r ON l.node // 16 = r.root // 16 WHERE l.node <> r.root UNION SELECT d, dst FROM avoid JOIN flow ON src = avoid.node WHERE dst <> d),
dom AS (SELECT d.node AS dom, l.node AS node FROM live d JOIN live l ON d.node // 16 = l.node // 16 WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.d = d.node AND a.node = l.node)),
depth AS (SELECT node AS dom, count(*) AS depth FROM dom GROUP BY node),
front AS (SELECT DISTINCT m.dom AS node, f.dst AS frontier FROM flow f JOIN dom m ON m.node = f.src WHERE NOT EXISTS (SELECT 1 FROM dom x WHERE x.dom = m.dom AND x.node = f.dst AND m.dom <> f.dst)),
places AS (SELECT DISTINCT r.root, l_suppkey % 4 AS region, l_orderkey AS node, (l_partkey + l_linenumber) % 3 = 0 AS writes FROM lineitem JOIN live ON live.node = l_orderkey JOIN head r ON r.root // 16 = l_orderkey // 16),
merge(root, region, node) AS (SELECT root, region, frontier FROM places p JOIN front f ON f.node = p.node WHERE writes UNION SELECT root, region, frontier FROM merge m JOIN front f ON f.node = m.node),
defs AS (SELECT *, row_number() OVER (PARTITION BY root, region ORDER BY node, pos) AS ver FROM (SELECT DISTINCT root, region, root AS node, 0 AS pos FROM places UNION SELECT root, region, node, 1 FROM merge UNION SELECT root, region, node, 2 FROM places WHERE writes)),
pred AS (SELECT d.root, d.region, f.dst, f.src AS node FROM defs d JOIN flow f ON f.dst = d.node AND d.pos = 1 JOIN live ON live.node = f.src),
wanted AS (SELECT root, region, node FROM places UNION SELECT root, region, node FROM pred),
coming AS (SELECT w.root, w.region, w.node, arg_max(e.ver, depth * 4 + e.pos) AS ver FROM wanted w JOIN dom USING (node) JOIN depth USING (dom) JOIN defs e ON e.root = w.root AND e.region = w.region AND e.node = dom.dom AND (dom.dom <> w.node OR e.pos < 2) GROUP BY ALL),
leaving AS (SELECT i.root, i.region, i.node, coalesce(d.ver, i.ver) AS ver FROM coming i LEFT JOIN defs d ON d.root = i.root AND d.region = i.region AND d.node = i.node AND d.pos = 2),
ssa AS (SELECT DISTINCT root, region, node, 'mu' AS annotation, ver AS operand, 0::BIGINT AS result FROM places JOIN coming USING (root, region, node) WHERE NOT writes
  UNION ALL SELECT root, region, node, 'chi', i.ver, d.ver FROM defs d JOIN coming i USING (root, region, node) WHERE d.pos = 2
  UNION ALL SELECT root, region, node, 'entry', 0, ver FROM defs WHERE pos = 0
  UNION ALL SELECT DISTINCT p.root, p.region, p.dst, 'phi', o.ver, d.ver FROM pred p JOIN leaving o USING (root, region, node) JOIN defs d ON d.root = p.root AND d.region = p.region AND d.node = p.dst AND d.pos = 1),
vf AS (SELECT DISTINCT a.root, a.region, a.node AS src, a.annotation AS src_kind, b.node AS dst, b.annotation AS dst_kind FROM ssa a JOIN ssa b ON a.root = b.root AND a.region = b.region AND a.result = b.operand AND a.result > 0)"""


def _ssa(spark: SparkSession, sf_dir: str, make: str = "ssa") -> DataFrame:
    flow = table(_flow(spark, sf_dir))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    places = lines.select((F.col("l_suppkey") % 4).alias("region"), F.col("l_orderkey").alias("node"), ((F.col("l_partkey") + F.col("l_linenumber")) % 3 == 0).alias("writes"))
    return memory_ssa.solved(flow, places, _roots(flow), make, block=lambda node: F.expr(f"{node} div 16"))


@query(f"{SSA} SELECT DISTINCT root, region, node FROM merge")
def memory_phis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ssa(spark, sf_dir).where("annotation = 'phi'").select("root", "region", "node").distinct()


@query(f"{SSA} SELECT root, region, node, annotation, operand, result FROM ssa")
def memory_ssa_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ssa(spark, sf_dir)


@query(f"{SSA} SELECT root, count(*) FILTER (annotation = 'entry') AS n_entry, count(*) FILTER (annotation = 'mu') AS n_mu, count(*) FILTER (annotation = 'chi') AS n_chi, count(*) FILTER (annotation = 'phi') AS n_phi FROM (SELECT DISTINCT root, region, node, annotation FROM ssa) GROUP BY root")
def memory_ssa_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_ssa.counts(_ssa(spark, sf_dir))


@query(f"{SSA} SELECT root, region, src, src_kind, dst, dst_kind FROM vf")
def memory_value_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also through the graph's text form: written to the shared folder and read back."""
    path = f"{shared_dir(spark)}/svfg-{uuid.uuid4().hex}"
    memory_ssa.write_text(_ssa(spark, sf_dir, "flow"), path)
    return memory_ssa.read_text(spark, path)


@query(f"""{SSA}, past(root, region, src, src_kind, dst, dst_kind) AS (SELECT * FROM vf WHERE src_kind <> 'phi' UNION SELECT p.root, p.region, p.src, p.src_kind, v.dst, v.dst_kind FROM past p JOIN vf v ON p.dst_kind = 'phi' AND v.src_kind = 'phi' AND v.src = p.dst AND v.root = p.root AND v.region = p.region)
SELECT * FROM past WHERE dst_kind <> 'phi'""")
def memory_value_flow_without_phis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ssa(spark, sf_dir, "plain")
