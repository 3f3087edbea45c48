"""Whole results of the graph engine against brute force: fields, threads, intervals."""

import random

import duckdb
import pytest

from weftgraph.operators import concurrency, inclusion
from weftgraph.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def fields_by_brute_force(stmt, limit):
    """(var, vfld, obj, fld) by applying every rule to every fact until nothing is new."""
    pts = {(d, 0, s, 0) for k, s, d, _ in stmt if k == "addr"}
    copy = {(s, 0, d, 0) for k, s, d, _ in stmt if k == "copy"}
    while True:
        at = {}
        for v, f, o, g in pts:
            at.setdefault((v, f), set()).add((o, g))
        more, edges = set(), set()
        for s, sf, d, df in copy:
            more |= {(d, df, o, g) for o, g in at.get((s, sf), ())}
        for k, s, d, off in stmt:
            if k == "gep":
                more |= {(d, 0, o, (g + off) % limit) for o, g in at.get((s, 0), ())}
            elif k == "load":
                edges |= {(o, g, d, 0) for o, g in at.get((s, 0), ())}
            elif k == "store":
                edges |= {(s, 0, o, g) for o, g in at.get((d, 0), ())}
        if more <= pts and edges <= copy:
            return pts
        pts |= more
        copy |= edges


def test_eight_fields_equal_brute_force(spark):
    stmt = [tuple(r) for r in registry._geps(spark, SF).collect()]
    assert rows(registry.QUERIES["points_to_eight_fields"](spark, SF)) == fields_by_brute_force(stmt, 8)


@pytest.mark.parametrize("most_local", [0, 5000])
def test_fields_wrap_and_stay_apart(spark, most_local):
    stmt = [("addr", 100, 1, 0), ("gep", 1, 2, 4), ("gep", 2, 3, 5), ("gep", 1, 4, -1), ("addr", 200, 5, 0), ("store", 5, 2, 0), ("load", 4, 6, 0), ("load", 2, 7, 0), ("gep", 1, 1, 2), ("addr", 300, 8, None)]
    got = rows(inclusion.points_to_fields(spark.createDataFrame(stmt, "kind string, src long, dst long, off int"), most_local=most_local))
    assert got == fields_by_brute_force([(k, s, d, o or 0) for k, s, d, o in stmt], 8)
    assert {f for v, _, o, f in got if v == 3 and o == 100} == {1, 3, 5, 7}


def races_by_brute_force(access, fork, joined):
    """Every run of a thread is a path of forks. Two runs meet in the last thread both paths share."""
    fork = sorted(set(fork))
    until = {(p, c, at): min((j for q, d, j in joined if (q, d) == (p, c) and j > at), default=None) for p, c, at in fork}
    roots = {p for p, _, _ in fork} - {c for _, c, _ in fork}
    runs = [(r, ()) for r in roots]
    for t, path in runs:
        runs += [(f[1], (*path, f)) for f in fork if f[0] == t]

    def span(path):
        """The positions of the first fork's parent between which the last fork's child may run."""
        return path[0][2], float("inf") if any(until[f] is None for f in path) else until[path[0]]

    found = set()
    for t, p in runs:
        for u, q in runs:
            same = next((i for i, (f, g) in enumerate(zip(p, q, strict=False)) if f != g), min(len(p), len(q)))
            p1, q1 = p[same:], q[same:]
            if not q1 or same == 0 and ((p or q)[0][0] != (q or p)[0][0] or (not p and t != q[0][0])):
                continue
            (lo, hi), (lo2, hi2) = span(q1), span(p1) if p1 else (None, None)
            if p1 and not max(lo, lo2) < min(hi, hi2):
                continue
            for ta, pa, oa, wa, la in access:
                for tb, pb, ob, wb, lb in access:
                    if (ta, tb, oa) == (t, u, ob) and (wa or wb) and (la is None or la != lb) and (p1 or lo < pa < hi):
                        found.add((*min((ta, pa), (tb, pb)), *max((ta, pa), (tb, pb)), oa))
    return found


ACCESS, FORK = "thread long, pos long, obj long, writes boolean, lock long", "parent long, child long, at long"


def races_of(spark, access, fork, joined):
    return rows(concurrency.all_races(spark.createDataFrame(access, ACCESS), spark.createDataFrame(fork, FORK), spark.createDataFrame(joined, FORK)))


def test_races_of_siblings_and_grandchildren(spark):
    fork, joined = [(1, 2, 10), (1, 3, 20), (1, 4, 60), (2, 5, 5), (1, 6, 90)], [(1, 2, 50), (1, 3, 55), (1, 4, 70)]
    access = [(t, 1, 7, True, None) for t in (2, 3, 4, 5, 6)] + [(1, 5, 7, True, 1), (1, 30, 7, False, 1), (1, 2_000_000, 7, False, 2)]
    got = races_of(spark, access, fork, joined)
    assert (2, 1, 3, 1, 7) in got and (1, 30, 5, 1, 7) in got and (3, 1, 5, 1, 7) in got and (1, 2_000_000, 6, 1, 7) in got
    assert (2, 1, 4, 1, 7) not in got and (4, 1, 5, 1, 7) in got and (1, 2_000_000, 5, 1, 7) in got and (1, 2_000_000, 2, 1, 7) not in got
    assert got == races_by_brute_force(access, fork, joined)


def test_races_equal_brute_force(spark):
    rng = random.Random(5)
    for turn in range(4):
        edges = [(p, c) for c in range(2, 8) for p in rng.sample(range(1, c), min(c - 1, 1 + (rng.random() < 0.4)))] + [(20, 21), (20, 22)]
        fork = [(*e, rng.randrange(8)) for e in edges for _ in range(1 + (rng.random() < 0.3))]
        joined = [(*e, rng.randrange(2, 12)) for e in edges if rng.random() < 0.7]
        access = [(rng.choice([1, 2, 3, 4, 5, 6, 7, 20, 21, 22]), rng.randrange(14), rng.randrange(2), rng.random() < 0.5, rng.choice([None, 1, 2])) for _ in range(40)]
        access = list(set(access))
        assert races_of(spark, access, fork, joined) == races_by_brute_force(access, fork, joined), turn


def test_races_in_a_large_tree(spark):
    """More threads that access memory than one block holds, above 20,000 that do not: rows follow the accesses, not the tree's square."""
    rng = random.Random(7)
    fork = [(0, c, rng.randrange(50)) for c in range(1, 1201)]
    joined = [(0, c, rng.randrange(30, 80)) for c in range(1, 1201) if c % 3]
    deep = [(c, c + 1, 1) for c in range(1200, 21_200)]
    access = list({(rng.randrange(1201), rng.choice([None, *range(60)]), rng.randrange(40), rng.random() < 0.3, rng.choice([None, 1, 2])) for _ in range(4000)} | {(0, p, o, True, None) for p in range(60) for o in range(5)})
    span = {c: (at, min((j for _, d, j in joined if d == c and j > at), default=float("inf"))) for _, c, at in fork}
    place = lambda a: (a[0], a[1] is not None, a[1] or 0)
    want = set()
    for a in access:
        for b in access:
            if place(a) <= place(b) and a[0] != b[0] and a[2] == b[2] and (a[3] or b[3]) and (a[4] is None or a[4] != b[4]):
                lo, hi = span[b[0]]
                if a[0] == 0:
                    meet = a[1] is not None and lo < a[1] < hi
                else:
                    meet = span[a[0]][0] < hi and lo < span[a[0]][1]
                if meet:
                    want.add((*a[:2], *b[:2], a[2]))
    assert races_of(spark, access, fork + deep, joined) == want and len({t for t, *_ in access}) > 1024
    assert any(x[0] == 0 for x in want) and any(x[1] is None for x in want)


def test_lattice_of_the_whole_table(spark):
    lines = duckdb.sql(f"select l_suppkey, l_returnflag, l_quantity from '{SF}/lineitem.parquet'").fetchall()
    made = {r["supp"]: r for r in registry.QUERIES["interval_lattice"](spark, SF).collect()}
    for supp, r in made.items():
        x, y = ([q for s, f, q in lines if s == supp and f == flag] for flag in "AN")
        assert (r["join_lb"], r["join_ub"]) == (min(x + y), max(x + y))
    assert set(made) == {s for s, f, _ in lines if f in "AN"}
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    cols = sorted(next(iter(made.values())).asDict())
    want = con.sql(f"select {', '.join(cols)} from ({registry.ORACLE_SQL['interval_lattice']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in made.values())


def test_lattice_of_missing_operands(spark):
    lines = [(1, "A", 2.0), (1, "A", 5.0), (2, "N", 3.0), (3, "A", 1.0), (3, "N", 4.0), (4, "R", 9.0)]
    got = {r["supp"]: tuple(r)[1:] for r in registry._lattice(spark.createDataFrame(lines, "l_suppkey long, l_returnflag string, l_quantity double")).collect()}
    inf = float("inf")
    assert got == {1: (2, 5, None, None, 2, 5, False), 2: (3, 3, None, None, 3, 3, True), 3: (1, 4, None, None, 1, inf, False)}
