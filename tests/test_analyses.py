"""Memory SSA, conditions, locks, states, calls and files: SQL on the small tables, and small cases by hand."""

import glob
import os

import duckdb
import pytest

from weftgraph.functions import interval as iv
from weftgraph.functions import values
from weftgraph.operators import calls, concurrency, conditions, constraints, incremental, memory_ssa, slices, states
from weftgraph.plans import check_queries, registry, solve_queries, ssa_queries, state_queries  # noqa: F401
from weftgraph.sources import serial

SF = "/root/testdata/sf0.001"
QUICK = (
    "interval_bits", "interval_comparisons", "interval_states", "constant_states", "address_states", "regions_default", "role_sites", "lifted_sources", "procedure_concurrency", "forked_threads",
    "unique_statements", "constraint_graph", "release_report", "bug_reports", "memory_value_flow", "lock_spans", "versioned_points_to",
)


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


def rows(df, *names):
    return {tuple(r) for r in df.select(*names or df.columns).collect()}


def test_maintenance_runs_in_the_query(spark, monkeypatch):
    seen = []
    was = incremental._maintained
    monkeypatch.setattr(incremental, "_maintained", lambda *a: seen.append(1) or was(*a))
    assert registry.QUERIES["maintained_changes"](spark, SF).count() > 0 and seen


def test_bits_hold_every_value(spark):
    """Each operation's interval holds the result for every pair of whole numbers in its operands."""
    boxes = [(-3, 2, 1, 3), (0, 5, 2, 2), (4, 4, 3, 3), (-6, -1, 1, 4), (1, 7, 0, 2), (-2, 3, -2, 5)]
    df = spark.createDataFrame([((float(a), float(b)), (float(c), float(d))) for a, b, c, d in boxes], "a struct<lb:double,ub:double>, b struct<lb:double,ub:double>")
    by_hand = {
        "remainder": lambda x, y: abs(x) % abs(y) * (1 if x >= 0 else -1) if y else None, "shift_left": lambda x, y: x << y if y >= 0 else None, "shift_right": lambda x, y: x >> y if y >= 0 else None,
        "bit_and": lambda x, y: x & y, "bit_or": lambda x, y: x | y, "bit_xor": lambda x, y: x ^ y, "greater": lambda x, y: int(x > y), "at_least": lambda x, y: int(x >= y), "at_most": lambda x, y: int(x <= y), "unequal": lambda x, y: int(x != y),
    }
    got = df.select("a", "b", *[getattr(iv, n)(df["a"], df["b"]).alias(n) for n in by_hand]).collect()
    for r in got:
        for n, f in by_hand.items():
            for x in range(int(r.a.lb), int(r.a.ub) + 1):
                for y in range(int(r.b.lb), int(r.b.ub) + 1):
                    v = f(x, y)
                    assert v is None or r[n].lb <= v <= r[n].ub, (n, r.a, r.b, x, y, r[n])
    bottom = spark.createDataFrame([(None, (1.0, 2.0))], df.schema)
    assert bottom.select(iv.bit_and(bottom["a"], bottom["b"]).alias("v")).first().v is None


def test_growing_values_are_widened(spark):
    """A cycle that adds one has no end without widening; narrowing by a meet keeps the other bound."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 0.0)], "src long, dst long, plus double")
    seed = spark.createDataFrame([(1, (0.0, 0.0))], "node long, value struct<lb:double,ub:double>")
    out = states.propagate(edges, seed, states.spans, transfer=lambda v, r: iv.add(v, iv.interval(r["plus"], r["plus"])), widen_after=4)
    assert {r.node: (r.value.lb, r.value.ub) for r in out.collect()} == {1: (0.0, float("inf")), 2: (1.0, float("inf"))}


def test_contexts_match_calls(spark):
    """1 calls 10 at site 7, 2 calls 10 at site 8; what came from 1 must not return to 2."""
    edges = spark.createDataFrame([(1, 10, "call_i", 7), (2, 10, "call_i", 8), (10, 11, "a", -1), (11, 3, "ret_i", 7), (11, 4, "ret_i", 8)], "src long, dst long, sym string, attr long")
    start = spark.createDataFrame([(1,), (11,)], "node long")
    assert rows(slices.contexts(edges, start, 2).select("source", "node")) == {(1, 1), (1, 10), (1, 11), (1, 3), (11, 11), (11, 3), (11, 4)}
    loop = spark.createDataFrame([(1, 1, "call_i", 5)], edges.schema)
    assert slices.contexts(loop, start.limit(1), 2).count() == 3
    pushed = start.select(values.push(values.F.array(values.F.lit(1)), values.F.lit(2), 1).alias("c")).first().c
    assert pushed == [2]


def test_conditions_of_branches(spark):
    """A diamond: one arm releases (partly), both arms do (always, never twice on one path), then once more after them (twice)."""
    flow = spark.createDataFrame([(5, 6), (5, 7), (6, 8), (7, 8)], "src long, dst long")
    source = spark.createDataFrame([(5,)], "node long")
    found = conditions.along(conditions.guarded(flow), source)
    report = lambda *at: conditions.report(source, conditions.at_sinks(found, spark.createDataFrame([(a,) for a in at], "node long"))).first()
    assert (report(6).verdict, report(6).twice) == ("partial", False)
    assert (report(6, 7).verdict, report(6, 7).twice) == ("always", False)
    assert (report(6, 8).verdict, report(6, 8).twice) == ("always", True)
    assert report(99).verdict == "never"


def test_versions_of_a_loop(spark):
    """Entry 1, loop head 2, body 3 writes, exit 4 reads: the head has a phi of the entry's and the body's versions."""
    flow = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (2, 4)], "src long, dst long")
    dom = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (1, 3), (2, 3), (3, 3), (1, 4), (2, 4), (4, 4)], "dom long, node long")
    places = spark.createDataFrame([(0, 3, True), (0, 4, False)], "region long, node long, writes boolean")
    roots = spark.createDataFrame([(1, n) for n in (1, 2, 3, 4)], "root long, node long")
    ssa = memory_ssa.build(flow, dom, places, roots)
    assert rows(ssa, "node", "annotation", "operand", "result") == {(1, "entry", 0, 1), (2, "phi", 1, 2), (2, "phi", 3, 2), (3, "chi", 2, 3), (4, "mu", 2, 0)}
    edges = memory_ssa.without_phis(memory_ssa.value_flow(ssa))
    assert rows(edges, "src", "dst") == {(1, 3), (3, 3), (1, 4), (3, 4)}


def test_locks_end_where_they_are_given_back(spark):
    flow = spark.createDataFrame([(i, i + 1) for i in range(1, 6)], "src long, dst long")
    at = lambda n: spark.createDataFrame([(9, n)], "lock long, node long")
    assert rows(concurrency.held(flow, at(2), at(5))) == {(9, 3), (9, 4)}
    assert rows(concurrency.held(flow, at(2), at(1))) == set()


def test_callees_become_known_while_solving(spark):
    """The first call's callee returns a function, which the second call then calls; an allocator makes an object a site."""
    of = lambda schema, *r: spark.createDataFrame(list(r), schema)
    stmt = of("kind string, src long, dst long", ("addr", 100, 1), ("addr", 101, 50))
    solved = calls.solve(
        stmt, of("site long, ptr long, n_args long", (1, 1, 0), (2, 2, 0)), of("site long, pos long, var long", (9, 0, 9)), of("site long, var long", (1, 2), (2, 3)),
        of("obj long, fun long, arity long, allocates boolean", (100, 100, 0, False), (101, 101, 0, True), (102, 102, 5, False)), of("fun long, pos long, var long", (7, 0, 7)), of("fun long, var long", (100, 50)),
    )
    assert rows(solved["call"]) == {(1, 100), (2, 101)}
    assert rows(solved["pts"], "var", "obj") == {(1, 100), (50, 101), (2, 101), (3, calls.HEAP + 2)}


def test_reasons_of_copies(spark):
    stmt = spark.createDataFrame([("copy", 1, 2), ("load", 3, 4), ("store", 1, 3)], "kind string, src long, dst long")
    pts = spark.createDataFrame([(3, 100)], "var long, obj long")
    assert rows(constraints.supported_copies(pts, stmt)) == {(1, 2, "copy", 1, 2), (100, 4, "load", 3, 4), (1, 100, "store", 1, 3)}


def test_files_keep_results(spark, tmp_path):
    path = f"file://{tmp_path}"
    pts = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "var long, obj long")
    fields = spark.createDataFrame([(10, 4, 12)], "base long, off long, obj long")
    flags = spark.createDataFrame([(10, True), (11, False)], "obj long, insensitive boolean")
    serial.write_results(pts, fields, flags, f"{path}/r")
    back = serial.read_results(spark, f"{path}/r")
    assert [rows(x) for x in back] == [rows(x) for x in (pts, fields, flags)]
    diff = spark.createDataFrame([("+", "copy", 1, 2), ("-", "addr", 3, 4)], "op string, kind string, src long, dst long")
    serial.write_changes(diff, f"{path}/d")
    assert rows(serial.read_changes(spark, f"{path}/d")) == rows(diff)
    with pytest.raises(ValueError, match="not a table"):
        serial.write_program({"other": diff}, f"{path}/x")


def test_front_and_command_line(spark, tmp_path):
    """The analyses by name, kept results, a change of the program, options; all from a program text."""
    from weftgraph import __main__ as main
    from weftgraph import api

    (tmp_path / "p.txt").write_text("5 o\n6 v\n7 v\n8 v\n9 v\n5 addr 6 0\n6 copy 7 0\n7 copy 8 0\n")
    path = f"file://{tmp_path}/p.txt"
    args = main.parser().parse_args(["inclusion", path, "--set", "most_local=0"])
    assert rows(main.run(spark, args), "var", "obj") == {(6, 5), (7, 5), (8, 5)}
    stmt = api.program(spark, path)
    pts = api.answered("inclusion", stmt, f"file://{tmp_path}/kept")
    assert rows(api.answered("inclusion", stmt.limit(0), f"file://{tmp_path}/kept")) == rows(pts) and rows(api.points_to(pts, 8)) == {(5,)}
    pairs = spark.createDataFrame([(6, 8), (6, 9)], "a long, b long")
    assert rows(api.alias(pts, pairs)) == {(6, 8, "MayAlias"), (6, 9, "NoAlias")}
    assert rows(api.combined_alias([pts, pts.where("var <> 8")], pairs)) == {(6, 8, "NoAlias"), (6, 9, "NoAlias")}
    assert rows(api.combined_alias([pts, pts.where("var <> 8")], pairs, api.Options(alias_rule="conservative"))) == {(6, 8, "MayAlias"), (6, 9, "NoAlias")}
    (tmp_path / "d.txt").write_text("- 6 copy 7\n+ 6 copy 9\n")
    args = main.parser().parse_args(["changes", path, "--diff", f"file://{tmp_path}/d.txt"])
    assert rows(main.run(spark, args)) == {("-", 7, 5), ("-", 8, 5), ("+", 9, 5)}
    with pytest.raises(ValueError, match="unknown options: fields"):
        api.Options.of({"fields": "3"})
    with pytest.raises(ValueError, match="no analysis"):
        api.analyse("other", stmt)
