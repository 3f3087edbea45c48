"""Queries of aliases by CFL reachability. Two orders are a module of eight variables and eight objects; each line is a statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cfl_alias
from .registry import _solution, query

STMT = """
line AS (SELECT l_orderkey // 2 * 16 AS base, l_partkey % 8 AS x, (l_suppkey * 7 + l_linenumber) % 8 AS y, (l_partkey + l_linenumber) % 4 AS k FROM lineitem),
stmt AS (SELECT DISTINCT CASE k WHEN 0 THEN 'addr' WHEN 1 THEN 'copy' WHEN 2 THEN 'load' ELSE 'store' END AS kind,
         (base + x + CASE k WHEN 0 THEN 8 ELSE 0 END)::BIGINT AS src, (base + y)::BIGINT AS dst FROM line)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    base, k = F.expr("l_orderkey div 2 * 16"), (F.col("l_partkey") + F.col("l_linenumber")) % 4
    kind = F.when(k == 0, "addr").when(k == 1, "copy").when(k == 2, "load").otherwise("store")
    src = base + F.col("l_partkey") % 8 + F.when(k == 0, 8).otherwise(0)
    dst = base + (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 8
    return lines.select(kind.alias("kind"), src.cast("long").alias("src"), dst.cast("long").alias("dst")).distinct()


@query(f"""WITH RECURSIVE {STMT}, {_solution()}, pts AS (SELECT a AS var, b AS obj FROM r WHERE k = 'p' AND a % 16 < 8)
SELECT DISTINCT p.var AS a, q.var AS b FROM pts p JOIN pts q ON p.obj = q.obj AND p.var < q.var""")
def cfl_constraint_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfl_alias.constraint_aliases(_statements(spark, sf_dir), width=16)


@query(f"""WITH RECURSIVE {STMT},
a AS (SELECT CASE kind WHEN 'addr' THEN src * 3 + 2 WHEN 'load' THEN src * 3 + 1 ELSE src * 3 END AS s, CASE kind WHEN 'store' THEN dst * 3 + 1 ELSE dst * 3 END AS t FROM stmt),
d AS (SELECT src * 3 AS s, src * 3 + 1 AS t FROM stmt WHERE kind = 'load' UNION SELECT dst * 3, dst * 3 + 1 FROM stmt WHERE kind = 'store' UNION SELECT src * 3 + 2, src * 3 FROM stmt WHERE kind = 'addr'),
node AS (SELECT s AS x FROM a UNION SELECT t FROM a UNION SELECT s FROM d UNION SELECT t FROM d),
r(k, x, y) USING KEY (k, x, y) AS (
  SELECT 'G', x, x FROM node
  UNION
  (SELECT 'G', g.x, a.t FROM r g JOIN a ON g.k = 'G' AND a.s = g.y
   UNION SELECT 'G', g.x, m.y FROM r g JOIN a ON g.k = 'G' AND a.s = g.y JOIN recurring.r m ON m.k = 'M' AND m.x = a.t
   UNION SELECT 'G', g.x, m.y FROM r m JOIN a ON m.k = 'M' AND a.t = m.x JOIN recurring.r g ON g.k = 'G' AND g.y = a.s
   UNION SELECT 'H', g.y, g.x FROM r g WHERE g.k = 'G'
   UNION SELECT 'H', g.y, m.y FROM r g JOIN recurring.r m ON g.k = 'G' AND m.k = 'M' AND m.x = g.x
   UNION SELECT 'H', g.y, m.y FROM r m JOIN recurring.r g ON g.k = 'G' AND m.k = 'M' AND m.x = g.x
   UNION SELECT 'V', h.x, g.y FROM r h JOIN recurring.r g ON h.k = 'H' AND g.k = 'G' AND g.x = h.y
   UNION SELECT 'V', h.x, g.y FROM r g JOIN recurring.r h ON h.k = 'H' AND g.k = 'G' AND g.x = h.y
   UNION SELECT 'M', p.t, q.t FROM r v JOIN d p ON v.k = 'V' AND p.s = v.x JOIN d q ON q.s = v.y))
SELECT x // 3 AS a, y // 3 AS b FROM r WHERE k = 'V' AND x < y AND x % 3 = 0 AND y % 3 = 0""")
def cfl_value_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfl_alias.value_aliases(_statements(spark, sf_dir), width=16)
