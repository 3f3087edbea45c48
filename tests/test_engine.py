"""The graph engine: golden example, SQL oracles on the small tables, readers, properties."""

import glob
import os

import duckdb
import pytest

from weftgraph.operators import cfl, dominance, inclusion, incremental
from weftgraph.plans import fixpoint, registry
from weftgraph.sources import text

SF = "/root/testdata/sf0.001"
QUICK = ("points_to", "points_to_fields", "demand_points_to", "unification", "alias_query", "mod_ref", "regions_intra", "regions_inter", "call_components", "weak_components", "degree_statistics", "cfl_value_flow", "dominance_frontier", "points_to_changes", "changed_lines", "source_sink_slices", "leak_report", "race_pairs", "interval_arithmetic", "interval_lattice")

# a swap of two pointers' targets, before and after a change of its two last stores
COMMON = [("addr", 1, 11), ("addr", 2, 12), ("addr", 3, 13), ("addr", 4, 14), ("store", 11, 13), ("store", 12, 14), ("copy", 13, 21), ("copy", 14, 22), ("load", 21, 31), ("load", 22, 32)]
OLD, NEW = [("store", 32, 21), ("store", 31, 22)], [("store", 31, 21), ("store", 32, 22)]
SAME = {(11, 1), (12, 2), (13, 3), (14, 4), (21, 3), (22, 4)}
WANT_OLD = SAME | {(v, o) for v in (3, 4, 31, 32) for o in (1, 2)}
WANT_NEW = SAME | {(3, 1), (4, 2), (31, 1), (32, 2)}
STMT = "kind string, src long, dst long"


def got(df):
    return {tuple(r) for r in df.select("var", "obj").collect()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canon(rows):
    return sorted([str(round(v, 9)) if isinstance(v, float) else str(v) for v in r] for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(f"select {', '.join(cols)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert canon(tuple(r) for r in df.select(*cols).collect()) == canon(want)


def test_swap(spark):
    old = spark.createDataFrame(COMMON + OLD, STMT)
    solved = inclusion.solve(old)
    assert got(solved["pts"]) == WANT_OLD
    new, after = incremental.apply(old, solved["pts"], solved["copy"], spark.createDataFrame(OLD, STMT), spark.createDataFrame(NEW, STMT), most_local=0)
    assert got(after["pts"]) == WANT_NEW == got(inclusion.points_to(new))
    diff = {tuple(r) for r in incremental.changes(solved["pts"].select("var", "obj"), after["pts"].select("var", "obj")).collect()}
    assert diff == {("-", 3, 2), ("-", 4, 1), ("-", 31, 2), ("-", 32, 1)}


def test_rounds_of_joins_equal_one_task(spark):
    from weftgraph.sources import facts

    stmt = facts.statements(spark, SF).where("src % 3 <> 0")
    one, many = inclusion.solve(stmt), inclusion.solve(stmt, most_local=0)
    for k in one:
        assert {tuple(r) for r in one[k].collect()} == {tuple(r) for r in many[k].collect()}
    assert got(inclusion.unify(stmt)) == got(inclusion.unify(stmt, most_local=0))


def test_maintenance_equals_recomputation(spark):
    old, deleted, inserted = (df.where("dst < 640") for df in registry._versions(spark, SF))  # the first modules: a small fixture for rounds of joins
    solved = inclusion.solve(old)
    new, after = incremental.apply(old, solved["pts"], solved["copy"], deleted, inserted, most_local=0)
    assert got(after["pts"]) == got(inclusion.points_to(new))


def test_components_and_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (7, 8)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node long")
    assert {tuple(r) for r in fixpoint.scc(nodes, edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 9)}
    assert {tuple(r) for r in fixpoint.components(nodes, edges).collect()} == {*((i, 1) for i in range(1, 6)), (6, 6), (7, 7), (8, 7), (9, 9)}
    assert {tuple(r) for r in fixpoint.closure(edges, spark.createDataFrame([(7,), (4,)], "src long")).collect()} == {(7, 8), (4, 4), (4, 5)}
    assert fixpoint.closure(edges).count() == 3 * 5 + 2 * 2 + 1


def test_grammar(spark):
    g = cfl.parse("Start: S\nTerminal: a b c\nProductions:\n S -> a ( b c )* d_i ? | epsilon ;")
    assert g.start == "S" and g.productions == [("S", ["a", "(", "b", "c", ")*", "d_i", "?"]), ("S", [])] or g.productions[1] == ("S", [])
    assert all(len(r) <= 2 for _, r in cfl.parse(cfl.VALUE_FLOW).binary().productions)


def test_phis(spark):
    flow = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 4)], "src long, dst long")
    dom = dominance.dominators(flow, spark.createDataFrame([(1,)], "node long"))
    assert {tuple(r) for r in dom.where("dom <> node").collect()} == {(1, 2), (1, 3), (1, 4), (1, 5), (4, 5)}
    fr = dominance.frontier(flow, dom)
    assert {tuple(r) for r in fr.collect()} == {(2, 4), (3, 4), (5, 4), (4, 4)}
    assert {tuple(r) for r in dominance.phis(fr, spark.createDataFrame([("x", 2), ("y", 1)], "region string, node long")).collect()} == {("x", 4)}


def test_readers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("5 o\n6 v\n7 v\n5 addr 6 0\n6 gep 7 4\n")
    nodes, stmt = text.program(spark, str(tmp_path / "p.txt"))
    assert {tuple(r) for r in nodes.collect()} == {(5, "o"), (6, "v"), (7, "v")}
    assert {tuple(r) for r in stmt.collect()} == {("addr", 5, 6, 0), ("gep", 6, 7, 4)}
    (tmp_path / "bad.txt").write_text("5 q\n")
    with pytest.raises(Exception, match="not a node"):
        text.program(spark, str(tmp_path / "bad.txt"))[0].collect()
    (tmp_path / "g.tsv").write_text("1\t2\ta\n2\t3\tcall_7\n")
    assert {tuple(r) for r in text.labelled_graph(spark, str(tmp_path / "g.tsv")).collect()} == {(1, 2, "a", -1), (2, 3, "call_i", 7)}
    (tmp_path / "g.dot").write_text('digraph {\nNode0x1f -> Node0x20[color=red,label=call_7]\nNode1 -> Node2 [label=a];\n}')
    assert {tuple(r) for r in text.labelled_dot(spark, str(tmp_path / "g.dot")).collect()} == {(31, 32, "call_i", 7), (1, 2, "a", -1)}
    (tmp_path / "d.txt").write_text("diff -r old/a.c new/a.c\n4,5c4,6\n< x\n> y\n9d9\ndiff -r old/b.c new/b.c\n2a3,4\n")
    assert {tuple(r) for r in text.line_diff(spark, str(tmp_path / "d.txt")).collect()} == {(1, "new/a.c", 4, 6), (2, "new/a.c", 4, 5), (2, "new/a.c", 9, 9), (1, "new/b.c", 3, 4)}
    pts = spark.createDataFrame([(1, 5), (1, 4), (2, 5)], "var long, obj long")
    text.write_points_to(pts, str(tmp_path / "pts"))
    assert got(text.read_points_to(spark, str(tmp_path / "pts"))) == {(1, 5), (1, 4), (2, 5)}


def test_change_feed(spark, tmp_path):
    from weftgraph.streaming.changes import Maintained

    base = spark.createDataFrame(COMMON + OLD, STMT)
    kept = Maintained(base, inclusion.solve(base))
    rows = [("-", *r) for r in OLD] + [("+", *r) for r in NEW]
    spark.createDataFrame(rows, "op string, " + STMT).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("op string, " + STMT).json(str(tmp_path / "in"))
    kept.follow(stream, str(tmp_path / "at")).processAllAvailable()
    assert got(kept.pts) == WANT_NEW
