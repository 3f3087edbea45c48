"""Fingerprints, near and exact dedup against brute force."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import circulant_minhash, common, golomb_dedup, places, queries, spotsigs


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else ({tuple(w)} if w else set())


def linked(rows, n, percent):
    """Smallest reachable id of each (id, text), by comparing all pairs."""
    sets = [(d, shingles(t, n)) for d, t in rows]
    comp = {d: d for d, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {d: root(d) for d in comp}


def test_near_duplicates_match_brute_force(documents, spark, sf):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = linked(rows, 3, 85)
    got = {r.doc_id: r for r in queries.op5_circulant_minhash(spark, sf).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[d].n_shingles == len(shingles(t, 3)) and got[d].kept == (want[d] == d) for d, t in rows)


def test_large_group_with_unequal_links(spark):
    """Near copies around a base, of which many pairs are below the threshold: no link between components may be lost."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(120):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            w[at] = f"x{d}_{at}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in circulant_minhash.near_duplicates(docs, words=3, percent=85, block=16).collect()}
    assert got == linked(rows, 3, 85)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = circulant_minhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == odd.count()
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[2].kept is False
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[5].component_id == 5
    assert by[7].component_id == by[9].component_id == 7
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert circulant_minhash.near_duplicates(none).count() == 0
    kept = circulant_minhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7} and circulant_minhash.keep_one(none).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Different texts with one id: links of either count; rows are dropped one by one, never by id."""
    one, two = ([f"{x}{i}" for i in range(60)] for x in "ab")
    text = " ".join
    rows = [(1, text(one)), (1, text(two)), (2, text([*one, "x"])), (3, text([*two, "y"])), (4, "quite another text of many words here")]
    rows += [(4, "not at all like the other one with this id"), (None, text(["n", *one])), (None, "only null ids have this text at all"), (None, "only null ids have this text at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = circulant_minhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 1), (None, None)}
    assert sorted(r.kept for r in got if r.doc_id is None) == [False, False, True]
    kept = [(r.doc_id, r.text) for r in circulant_minhash.keep_one(docs).collect()]
    # ids 1 to 3 are one component through id 1, and the two texts of id 4 another
    assert collections.Counter(d for d, _ in kept) == {1: 1, 4: 1, None: 1}


def test_near_duplicates_around_a_hot_pivot(spark):
    """A third of the rows are near copies of one text, more than a pivot's share: dealt over tasks, no link is lost."""
    base = [f"b{i}" for i in range(200)]
    rows = [(d, " ".join(base[: 1 + d % 199] + [f"x{d}"] + base[2 + d % 199 :])) for d in range(700)] + [(1000 + d, f"text number {d} of its own {d * d}") for d in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in circulant_minhash.near_duplicates(docs, words=3, percent=85, block=50).collect()}
    assert all(c == (0 if d < 1000 else d) for d, c in got.items()) and len(got) == 1400


def test_exact_dedup(documents, spark, sf):
    groups = collections.defaultdict(list)
    for r in documents.collect():
        groups[r.text or ""].append(r.doc_id)
    for r in queries.op6_exact_dedup(spark, sf).collect():
        text = next(t for t in groups if r.doc_id in groups[t])
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[text]), len(groups[text]), r.doc_id == max(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_of_odd_rows(odd, none):
    rows = golomb_dedup.dedup(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    assert all(sum(x.kept for x in g) == 1 and {x.group_size for x in g} == {len(g)} for g in by.values())
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {5}
    assert golomb_dedup.dedup(none).count() == 0
    kept = golomb_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(by) and golomb_dedup.keep_one(none).count() == 0


def test_rows_by_their_place(spark, tmp_path):
    """Bitmaps over several files, in one round and in many, also where one file has more words than a round."""
    spark.range(0, 1000, 1, 5).selectExpr("id", "'x' as text").write.parquet(f"file://{tmp_path}/a")
    docs = places.Numbered(spark.read.parquet(f"file://{tmp_path}/a"))
    assert docs.total == 1000 and docs.rows.select(places.RID).distinct().count() == 1000
    wanted = docs.rows.where("id % 7 = 3")
    for most in (None, 4, 2):
        assert {r.id for r in docs.within(wanted, most_words=most).collect()} == set(range(3, 1000, 7))
        assert {r.id for r in docs.within(wanted, keep=False, most_words=most).collect()} == {i for i in range(1000) if i % 7 != 3}
    plan = docs.within(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_exact_dedup_moves_suspects_only(spark, tmp_path):
    """The shuffle of texts reads what the bitmaps let through; a sender of any partition number has room for its chunks."""
    docs = spark.createDataFrame([(i, f"text {i % 90}" if i < 100 else f"own {i}") for i in range(400)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"file://{tmp_path}/d")
    rows = golomb_dedup.dedup(spark.read.parquet(f"file://{tmp_path}/d")).collect()
    assert sum(not r.kept for r in rows) == 10 and {r.group_size for r in rows} == {1, 2}
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None], "sha": [b"a" * 32, b"b" * 32], places.RID: [5000 << 33, 7], "tie": [0, 1]})

    class Context:
        partitionId = staticmethod(lambda: 5000)

    was, golomb_dedup.TaskContext = golomb_dedup.TaskContext, type("T", (), {"get": staticmethod(lambda: Context)})
    try:
        (sent,) = golomb_dedup._send(4)(iter([batch]))
    finally:
        golomb_dedup.TaskContext = was
    own = sent.filter(pa.compute.less(sent.column("owner"), 0)).to_pylist()[0]
    assert own["src"] == 5000 << 32 and own["rids"] == [5000 << 33, 7] and own["ids"] == [1, None]


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_rice_round_trip(values):
    a = np.array(sorted(values), np.uint64)
    assert (golomb_dedup.rice_decode(golomb_dedup.rice_encode(a)) == a).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b\x0c\ré. ", max_size=30), max_size=8))
def test_words(texts):
    found = common.Words(pa.array([t.encode() for t in texts], pa.large_binary()))
    want = [words(t) for t in texts]
    assert found.lengths().tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    seen = dict(zip(flat, found.hashes.tolist(), strict=True))
    assert [seen[x] for x in flat] == found.hashes.tolist() and len(set(seen.values())) == len(seen)


def test_words_in_windows(monkeypatch):
    texts = pa.array([b"a bc def " * 50, b"x" * 300 + b" y", b""], pa.large_binary())
    whole = common.Words(texts).hashes
    monkeypatch.setattr(common, "WINDOW", 7)
    assert (common.Words(texts).hashes == whole).all()


def test_spotsigs_query(documents, spark, sf):
    rows = {r.doc_id: r.text or "" for r in documents.collect()}
    got = {r.doc_id: r for r in queries.op1_spotsigs(spark, sf).collect()}
    ids = sorted(rows, reverse=True)
    for i, d in enumerate(ids):
        text, after = rows[d], rows[ids[(i + 1) % len(ids)]]
        cut = len(text) // 3
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and (got[d].near_next == 1) == (got[d].fingerprint == got[ids[(i + 1) % len(ids)]].fingerprint)


def spots(text):
    """SpotSigs by the book: an anchor and the next two content words; runs of two where there are none."""
    w = [x[:-1] if len(x) > 1 and x[-1:] in spotsigs_marks else x for x in words(text)]
    anchors = {a.encode() for a in spotsigs.ANCHORS}
    out, content = set(), [x for x in w if x not in anchors]
    for i, x in enumerate(w):
        after = [y for y in w[i + 1 :] if y not in anchors][:2]
        if x in anchors and len(after) == 2:
            out.add((x, *after))
    run = content or w
    return out or {tuple(run[i : i + 2]) for i in range(max(1, len(run) - 1)) if run}


spotsigs_marks = {bytes([c]) for c in range(33, 128) if not chr(c).isalnum()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_against_brute_force(documents, spark, sf):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    got = {r.doc_id: r for r in queries.op1_spotsigs(spark, sf).collect()}
    ids = sorted(texts, reverse=True)
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        cut = len(text) // 3
        mine, r = spots(text), got[d]
        assert r.n_signatures == len(mine)
        assert abs(r.near_next - jaccard(mine, spots(after))) < 1e-9
        assert abs(r.near_edited - jaccard(mine, spots(text[: len(text) - cut] + after[:cut]))) < 1e-9


def test_likeness_stops_early():
    a, b = np.arange(0, 20000, dtype=np.uint64), np.arange(5000, 25000, dtype=np.uint64)
    assert spotsigs.likeness(a, b) == spotsigs.likeness(a, b, 0.5) == 0.6 and spotsigs.likeness(a, b, 0.7) == 0.0
    assert spotsigs.likeness(a, b[:10], 0.5) == 0.0


def test_spotsigs_signatures_are_chains_after_anchors():
    spots = spotsigs.Spots()
    one, two, three = spots.sets(pa.array([b"the quick dog and a big cat", b"the quick dog, and A big cat", b""], pa.large_binary()))
    # the:quick dog, and:big cat, a:big cat
    assert len(one) == 3 and (one == two).all() and len(three) == 0


def test_spotsigs_odd_rows(odd, none):
    rows = spotsigs.against_next(odd, rows_per_part=7).collect()
    assert len(rows) == odd.count()
    assert {r.fingerprint for r in rows if r.doc_id in (4, 5, 6)} == {spotsigs.show(np.zeros(0, np.uint64))}
    last = [r for r in rows if r.doc_id == 49]
    assert len(last) == 1 and last[0].n_signatures > 0
    assert spotsigs.against_next(none).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_spotsigs_join(documents, threshold):
    signed = spotsigs.signatures(documents)
    sets = {r.fingerprint: set(r.signatures) for r in signed.collect()}
    names = sorted(sets)
    want = {(a, b) for i, b in enumerate(names) for a in names[:i] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in spotsigs.similar(signed, threshold).collect()} == want
