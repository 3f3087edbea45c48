"""Units solved in a task each: no rounds of joins where units are small, and the same rows as by rounds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.operators import calls, cfl, cfl_alias, dominance, inclusion, incremental, memory_ssa, sets, slices
from weftgraph.plans import alias_queries, check_queries, local, registry, solve_queries, ssa_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows(df, *names):
    got = [tuple(r) for r in df.select(*names or df.columns).collect()]
    assert len(got) == len(set(got))
    return set(got)


def no_rounds(*a, **k):
    raise AssertionError("rounds of joins over small units")


@pytest.mark.parametrize("name", ["cfl_value_aliases", "cfl_value_flow", "cfl_constraint_aliases"])
def test_reachability_takes_no_rounds(spark, monkeypatch, name):
    monkeypatch.setattr(cfl, "fixpoint", no_rounds)
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("most_local, block", [(3, None), (3, cfl.blocks(4)), (2000, cfl.blocks(4)), (2000, cfl.blocks(2))])
def test_derived_edges_equal_those_of_rounds(spark, most_local, block):
    edges = [(1, 2, "call_i", 7), (2, 3, "a", None), (3, 5, "ret_i", 7), (3, 6, "ret_i", 8), (5, 1, "a", None), (9, 10, "a", None), (10, 11, "a", None), (20, 20, "a", None)]
    edges = spark.createDataFrame(edges, "src long, dst long, sym string, attr long")
    for grammar in (cfl.VALUE_FLOW, "Start: V\nTerminal: a call_i ret_i\nProductions:\n V -> (a B_i?)* ; B_i -> call_i V ;"):
        want = rows(cfl.reach(edges, cfl.parse(grammar), most_local=0))
        assert rows(cfl.reach(edges, cfl.parse(grammar), most_local=most_local, block=block)) == want


def test_aliases_of_modules_equal_those_without(spark):
    stmt = alias_queries._statements(spark, SF).where("src < 1600")
    for found in (cfl_alias.value_aliases, cfl_alias.constraint_aliases):
        assert rows(found(stmt, width=16)) == rows(found(stmt)) != set()


@pytest.mark.parametrize("module, name", [(calls, "edges_on_the_fly"), (slices, "context_reachability"), (incremental, "maintained_changes")])
def test_small_units_take_no_rounds(spark, monkeypatch, module, name):
    monkeypatch.setattr(module, "fixpoint", no_rounds)
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_maintenance_in_a_task_equals_solving(spark):
    rng = random.Random(3)
    some = [(k, rng.randrange(100, 104) if k == "addr" else rng.randrange(8), rng.randrange(8)) for k in ("addr", "copy", "load", "store") * 8]
    for turn in range(20):
        every = set(rng.sample(some, 20))
        gone, come = (set(rng.sample(sorted(every), 3)) for _ in range(2))
        old, now = every - come, every - gone
        solved = local.solved_rows(sorted(old), False)
        facts = [("old", *r) for r in old] + [("now", *r) for r in now] + [("", *r) for r in solved]
        assert set(local.maintained_rows(facts)) == set(local.solved_rows(sorted(now), False)), turn


def test_kinds_of_effects_go_up_without_the_closure(spark, monkeypatch):
    monkeypatch.setattr(sets, "closure", no_rounds)
    effects = spark.createDataFrame([(3, 70, "mod"), (2, 5, "ref")], "fun long, obj long, effect string")
    call = spark.createDataFrame([(1, 2, 9), (2, 3, 8), (3, 1, 7)], "caller long, callee long, site long")
    assert rows(sets.effect_kinds(effects, call)) == {(f, e) for f in (1, 2, 3) for e in ("mod", "ref")}


def test_sizes_of_effects_by_words(spark):
    effects = [(f, o, "mod") for f, o in ((2, 0), (2, 63), (2, 64), (3, 63), (3, 127), (3, -1), (4, 1_000_000_007))]
    effects = spark.createDataFrame(effects, "fun long, obj long, effect string")
    call = spark.createDataFrame([(1, 2, 9), (2, 3, 8), (3, 2, 7)], "caller long, callee long, site long")
    of = {1: (0, 63, 64, 127, -1), 2: (0, 63, 64, 127, -1), 3: (0, 63, 64, 127, -1), 4: (1_000_000_007,)}
    got = rows(sets.effect_sizes(effects, call), "fun", "effect", "n_objs", "first_obj", "last_obj", "sum_obj")
    assert got == {(f, "mod", len(o), min(o), max(o), sum(o)) for f, o in of.items()}


@pytest.mark.parametrize("name", ["maintained_points_to", "maintained_changes"])
def test_maintenance_hands_on_no_solution_between_tasks(spark, monkeypatch, name):
    for module in (inclusion, incremental):
        monkeypatch.setattr(module, "solve", no_rounds)
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("most_kept", [6, 5000])
def test_solved_changes_equal_solving_both(spark, most_kept):
    rng = random.Random(8)
    some = sorted({(k, rng.randrange(100, 104) if k == "addr" else rng.randrange(9), rng.randrange(9)) for k in ("addr", "copy", "load", "store") * 9})
    far = [(k, s + 1000, d + 1000) for k, s, d in (("addr", 100, 1), ("copy", 1, 2))]
    gone, come = set(rng.sample(some, 4)), set(rng.sample(some, 4))
    old, now = {*some, *far} - come, {*some, *far} - (gone - come)
    frame = lambda x: spark.createDataFrame(sorted(x), "kind string, src long, dst long")
    a, b = ({r[1:] for r in local.solved_rows(sorted(x), False) if r[0] == "p"} for x in (old, now))
    want = {("-", *r) for r in a - b} | {("+", *r) for r in b - a}
    assert rows(incremental.solved_changes(frame(old), frame(gone), frame(come), same=False, most_kept=most_kept)) == want
    assert rows(incremental.solved_changes(frame(old), frame(gone), frame(come), most_kept=most_kept)) == want | {("=", *r) for r in a & b}


def test_tasks_hand_on_the_wanted_relations_only():
    facts = [("addr", 100, 1, 0, 0, 0), ("copy", 1, 2, 0, 0, 0), ("site", 2, 2, 7, 1, 0), ("function", 100, 100, 100, 1, 0)]
    assert local.called_rows(facts, 1000, "e") == [("e", 7, 100)]
    assert set(local.called_rows(facts, 1000, "p")) == {("p", 1, 100), ("p", 2, 100)}


@pytest.mark.parametrize("name", ["memory_value_flow", "memory_value_flow_without_phis"])
def test_memory_ssa_takes_no_rounds(spark, monkeypatch, name):
    for module in (memory_ssa, dominance):
        monkeypatch.setattr(module, "fixpoint", no_rounds)
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("make", ["ssa", "flow", "plain"])
def test_memory_ssa_in_a_task_equals_that_by_rounds(spark, make):
    rng = random.Random(2)
    flow = {(8 * p + a, 8 * p + rng.randrange(8)) for p in range(6) for a in range(8) for _ in range(2)} | {(60, 60)}
    places = {(rng.randrange(2), rng.randrange(48), rng.random() < 0.4) for _ in range(60)} | {(0, 60, True), (1, 61, False)}
    frames = spark.createDataFrame(sorted(flow), "src long, dst long"), spark.createDataFrame(sorted(places), "region long, node long, writes boolean")
    root = spark.createDataFrame([(8 * p + 1,) for p in range(6)] + [(60,)], "node long")
    got = [rows(memory_ssa.solved(*frames, root, make, most_local=most, block=cfl.blocks(8))) for most in (10, 5000)]
    assert got[0] == got[1] != set()


@pytest.mark.parametrize("grammar, syms", [(cfl.VALUE_FLOW, "a call_i:1 call_i:2 ret_i:1 ret_i:2"), (cfl_alias.CONSTRAINT_ALIAS, "addr addrbar copy copybar load loadbar store storebar"), (cfl_alias.EXPRESSION_ALIAS, "a abar d dbar")])
def test_units_at_once_equal_units_alone(grammar, syms):
    rng = random.Random(4)
    parts = cfl.rules(cfl.parse(grammar).binary())
    syms = [(s.partition(":")[0], int(s.partition(":")[2] or cfl.NONE)) for s in syms.split()]
    units = {u: {(100 * u + rng.randrange(n), 100 * u + rng.randrange(n), *rng.choice(syms)) for _ in range(2 * n)} for u, n in enumerate([3, 12, 80, 1, 9])}
    want = {r for e in units.values() for r in local.reached_rows(sorted(e), *parts, cfl.NONE, None)}
    unit, src, dst, sym, attr = zip(*((u, *e) for u, es in units.items() for e in sorted(es)), strict=True)
    made = local.reached_at_once(np.array(unit), np.array(src), np.array(dst), pa.array(sym), np.array(attr), *parts, cfl.NONE, None)
    got = [r for u, v, s, a in made for r in zip(u.tolist(), v.tolist(), s if isinstance(s, list) else [s] * len(u), np.broadcast_to(a, len(u)).tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
