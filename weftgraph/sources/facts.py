"""Program facts derived from the driver's tables, whole, the same way in Spark and in SQL.

Each lineitem is a statement. 16 orders are a module with its own variables and objects; some copies lead into the next module,
so programs grow with the table as real ones do, by modules with few links between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Objects' ids start here; variables are below.
OBJECTS = 1_000_000_000
#: Variables of a module.
VARS = 32

STMT_SQL = f"""
stmt AS (
  SELECT DISTINCT
    CASE WHEN m < 3 THEN 'addr' WHEN m < 7 THEN 'copy' WHEN m < 9 THEN 'load' ELSE 'store' END AS kind,
    CASE WHEN m < 3 THEN {OBJECTS} + u * 8 + l_suppkey % 8 ELSE u * {VARS} + l_partkey % {VARS} END AS src,
    (CASE WHEN m BETWEEN 3 AND 6 AND l_orderkey % 16 = 15 AND l_linenumber = 1 THEN u + 1 ELSE u END) * {VARS} + (l_suppkey * 3 + l_linenumber) % {VARS} AS dst
  FROM (SELECT *, (l_partkey + l_suppkey + l_linenumber) % 10 AS m, l_orderkey // 16 AS u FROM lineitem))"""

#: A call graph among as many functions as customers: who calls whom, at which site.
CALL_SQL = """
call AS (
  SELECT DISTINCT o_custkey AS caller, o_custkey // 2 + o_orderkey % 3 AS callee, o_orderkey AS site
  FROM orders)"""

#: Statements' functions: their modules.
FUN_SQL = f"fun_of AS (SELECT kind, src, dst, dst // {VARS} AS fun FROM stmt)"


def module(var: str) -> Column:
    """The module of a variable."""
    return F.expr(f"{var} div {VARS}")


def block(node: str) -> Column:
    """The module of a variable or an object."""
    return F.expr(f"if({node} < {OBJECTS}, {node} div {VARS}, ({node} - {OBJECTS}) div 8)")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, src, dst of address, copy, load and store statements."""
    m = (F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % 10
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("m", m).withColumn("u", F.expr("l_orderkey div 16"))
    kind = F.when(F.col("m") < 3, "addr").when(F.col("m") < 7, "copy").when(F.col("m") < 9, "load").otherwise("store")
    src = F.when(F.col("m") < 3, OBJECTS + F.col("u") * 8 + F.col("l_suppkey") % 8).otherwise(F.col("u") * VARS + F.col("l_partkey") % VARS)
    crosses = F.col("m").between(3, 6) & (F.col("l_orderkey") % 16 == 15) & (F.col("l_linenumber") == 1)
    dst = F.when(crosses, F.col("u") + 1).otherwise(F.col("u")) * VARS + (F.col("l_suppkey") * 3 + F.col("l_linenumber")) % VARS
    return lines.select(kind.alias("kind"), src.alias("src"), dst.alias("dst")).distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee, site."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("caller"), F.expr("o_custkey div 2 + o_orderkey % 3").alias("callee"), F.col("o_orderkey").alias("site")).distinct()


def with_functions(stmt: DataFrame) -> DataFrame:
    return stmt.withColumn("fun", module("dst"))


#: Calls through pointers: sites (orders) with arguments and receivers; functions are some of the modules' objects.
SITE_SQL = f"""
site AS (SELECT DISTINCT o_orderkey AS site, o_orderkey // 16 * {VARS} + o_custkey % {VARS} AS ptr, 1 + o_orderkey % 2 AS n_args FROM orders),
argument AS (SELECT DISTINCT o_orderkey AS site, pos, o_orderkey // 16 * {VARS} + (o_custkey * (7 + 4 * pos) + 3 * pos) % {VARS} AS var FROM orders, (SELECT range AS pos FROM range(2)) WHERE pos < 1 + o_orderkey % 2),
receiver AS (SELECT DISTINCT o_orderkey AS site, o_orderkey // 16 * {VARS} + (o_custkey * 5 + 1) % {VARS} AS var FROM orders),
fun AS (SELECT DISTINCT src AS obj, src AS fun, 1 + src % 2 AS arity, src % 8 = 2 AS allocates FROM stmt WHERE kind = 'addr' AND src % 8 < 3),
parameter AS (SELECT fun, pos, (fun - {OBJECTS}) // 8 * {VARS} + fun % 8 * 4 + pos AS var FROM fun, (SELECT range AS pos FROM range(2)) WHERE pos < arity),
result AS (SELECT fun, (fun - {OBJECTS}) // 8 * {VARS} + fun % 8 * 4 + 2 AS var FROM fun)"""


def call_facts(spark: SparkSession, sf_dir: str, stmt: DataFrame) -> dict[str, DataFrame]:
    """sites, arguments, receivers, functions, parameters, results of calls through pointers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("site"), "o_custkey", F.expr(f"o_orderkey div 16 * {VARS}").alias("base"))
    cust, two = F.col("o_custkey"), F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    sites = o.select("site", (F.col("base") + cust % VARS).alias("ptr"), (1 + F.col("site") % 2).alias("n_args")).distinct()
    arguments = o.select("site", "base", "o_custkey", F.explode(two).alias("pos")).where("pos < 1 + site % 2").select("site", "pos", (F.col("base") + (cust * (7 + 4 * F.col("pos")) + 3 * F.col("pos")) % VARS).alias("var")).distinct()
    receivers = o.select("site", (F.col("base") + (cust * 5 + 1) % VARS).alias("var")).distinct()
    functions = stmt.where("kind = 'addr' and src % 8 < 3").select(F.col("src").alias("obj"), F.col("src").alias("fun"), (1 + F.col("src") % 2).alias("arity"), (F.col("src") % 8 == 2).alias("allocates")).distinct()
    home = F.expr(f"(fun - {OBJECTS}) div 8 * {VARS} + fun % 8 * 4")
    parameters = functions.select("fun", "arity", F.explode(two).alias("pos")).where("pos < arity").select("fun", "pos", (home + F.col("pos")).alias("var"))
    return {"sites": sites, "arguments": arguments, "receivers": receivers, "functions": functions, "parameters": parameters, "results": functions.select("fun", (home + 2).alias("var"))}


#: Statements of all kinds: multi-operand ones have a row for each operand.
KIND_SQL = """
ir AS (SELECT CASE (l_partkey + l_suppkey * 3 + l_linenumber) % 15 WHEN 0 THEN 'addr' WHEN 1 THEN 'copy' WHEN 2 THEN 'store' WHEN 3 THEN 'load' WHEN 4 THEN 'call' WHEN 5 THEN 'ret' WHEN 6 THEN 'gep' WHEN 7 THEN 'phi' WHEN 8 THEN 'select' WHEN 9 THEN 'cmp' WHEN 10 THEN 'binary-op' WHEN 11 THEN 'unary-op' WHEN 12 THEN 'branch' WHEN 13 THEN 'fork' ELSE 'join' END AS kind,
  l_partkey AS src, l_partkey // 2 + l_suppkey % 5 AS dst, l_orderkey % 40 AS off, l_linenumber % 4 = 0 AS variant, l_orderkey % 11 AS cs, l_linenumber AS op_pos FROM lineitem)"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, src, dst, off, variant, cs, op_pos of statements of all fifteen kinds."""
    names = ("addr", "copy", "store", "load", "call", "ret", "gep", "phi", "select", "cmp", "binary-op", "unary-op", "branch", "fork", "join")
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), (F.expr("(l_partkey + l_suppkey * 3 + l_linenumber) % 15") + 1).cast("int"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(kind.alias("kind"), F.col("l_partkey").alias("src"), F.expr("l_partkey div 2 + l_suppkey % 5").alias("dst"), (F.col("l_orderkey") % 40).alias("off"), (F.col("l_linenumber") % 4 == 0).alias("variant"), (F.col("l_orderkey") % 11).alias("cs"), F.col("l_linenumber").alias("op_pos"))
