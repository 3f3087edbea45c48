"""Aliases by CFL reachability: small cases by hand, and SQL on the small tables."""

import os

import duckdb

from weftgraph.operators import cfl_alias
from weftgraph.plans import alias_queries, registry

SF = "/root/testdata/sf0.001"
STMT = "kind string, src long, dst long"


def pairs(df):
    return {(r.a, r.b) for r in df.collect()}


def test_constraint_aliases_of_a_swap(spark):
    stmt = [("addr", 1, 11), ("addr", 2, 12), ("addr", 3, 13), ("addr", 4, 14), ("store", 11, 13), ("store", 12, 14), ("copy", 13, 21), ("copy", 14, 22), ("load", 21, 31), ("load", 22, 32), ("store", 32, 21), ("store", 31, 22)]
    got = pairs(cfl_alias.constraint_aliases(spark.createDataFrame(stmt, STMT)))
    assert got == {(13, 21), (14, 22), (11, 31), (11, 32), (12, 31), (12, 32), (31, 32)}


def test_value_aliases_need_no_address(spark):
    stmt = spark.createDataFrame([("copy", 1, 2), ("copy", 1, 3), ("store", 5, 2), ("load", 3, 6), ("copy", 7, 8)], STMT)
    assert pairs(cfl_alias.value_aliases(stmt)) == {(1, 2), (1, 3), (2, 3), (5, 6), (7, 8)}
    assert pairs(cfl_alias.constraint_aliases(stmt)) == set()


def test_two_way_edges(spark):
    edges = cfl_alias.two_way(spark.createDataFrame([("addr", 1, 2), ("addr", 1, 2)], STMT))
    assert {tuple(r) for r in edges.select("src", "dst", "sym").collect()} == {(1, 2, "addr"), (2, 1, "addrbar")}


def test_constraint_aliases_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{os.path.join(SF, 'lineitem.parquet')}'")
    got = alias_queries.cfl_constraint_aliases(spark, SF)
    assert got.columns == ["a", "b"]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(registry.ORACLE_SQL["cfl_constraint_aliases"]).fetchall())
