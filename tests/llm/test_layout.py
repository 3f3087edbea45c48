"""Packing, mixing, sharding, token files and the pipeline."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import balanced_sharding, cube_mixing, ffd_packing, queries, token_output
from weftgraph.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids_of(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def packed(a):
    return zlib.crc32(np.array(a, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path):
    rng = random.Random(4)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["", "a  b", "don't I'LL 's", "Σας İx ﬁ", "a<|endoftext|> b", "\x00 \x1c", "\U0001f600 !!", "\r\n\t x  y", " \n\n b"]
    texts += ["".join(rng.choice(" \n\ta'sB1é.,!ß Σ́ ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for x in texts:
        assert np.frombuffer(Encoder.of(path).encode(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("letters", [" \t\n\r\x0b\x0cab'.,1é ß 日", "aB'sTre vdll \n", "Σσaİi'. \u0301è", "a \x1c\x00\x7f\xa0\x85.", "<|endoftext|> a", "ÀÁà aA1٣५.🙂"])
def test_batches_of_texts_encode_like_the_library(path, letters):
    r, t, encoder = random.Random(7), Tokenizer.from_file(path), Encoder(path)
    t.encode_special_tokens = True
    encoder.kept.most = 50  # less than a batch has, so pieces leave the cache
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(1200)]
    for size in (1, 7, 400):
        batches = [texts[i : i + size] for i in range(0, 400 if size == 1 else 1200, size)]
        for b in batches:
            got = encoder.encode_all([x.encode() for x in b])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in b]
    assert encoder.encode_all([]) == [] and encoder.encode_all([b"", b""]) == [b"", b""]


def check_pieces(rows, docs, capacity=2048):
    seq, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, texts in docs.items():
        want = collections.Counter()
        for t in texts:
            ids = ids_of(WORD, t, 1)
            want.update((at, min(capacity, len(ids) - at), packed(ids[at : at + capacity]), len(ids)) for at in range(0, len(ids), capacity))
        assert collections.Counter(by[d]) == want
    filled = waste = 0
    for s in seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
        filled, waste = filled + at, waste + (capacity - at if at & (at - 1) else 0)
    return waste / max(1, filled)


def test_packing(documents, spark, sf):
    docs = collections.defaultdict(list)
    for r in documents.collect():
        docs[r.doc_id].append(r.text)
    assert check_pieces(queries.op4_packing(spark, sf).collect(), docs) < 0.03


def test_packing_of_odd_rows(odd, none):
    docs = collections.defaultdict(list)
    for r in odd.collect():
        docs[r.doc_id].append(r.text)
    check_pieces(ffd_packing.pack(odd, WORD, group_docs=10).collect(), docs)
    assert ffd_packing.pack(none, WORD).count() == 0


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(2)
    lengths = -np.sort(-rng.integers(1, 101, 300))
    bins, offsets = ffd_packing.first_fit_decreasing(lengths, 100)
    room = []
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(100)
        assert (at, 100 - room[at]) == (b, o)
        room[at] -= n


def check_tokens(rows, docs, end=2):
    at = 0
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    texts = collections.defaultdict(set)
    for d, t in docs:
        texts[d].add((len(ids := ids_of(BYTE, t, end)), packed(ids)))
    for r in rows:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        at += r.n_tokens


def test_token_files(documents, spark, sf):
    check_tokens(queries.op9_token_output(spark, sf).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_token_files_of_odd_rows(odd, none, spark, tmp_path):
    path = token_output.write_tokens(odd, f"file://{tmp_path}/a", BYTE)
    check_tokens(token_output.checksums(token_output.read_tokens(spark, path)).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert token_output.read_tokens(spark, token_output.write_tokens(none, f"file://{tmp_path}/b", BYTE)).count() == 0


def test_token_metadata_is_read_without_ids(documents, spark, tmp_path):
    path = token_output.write_tokens(documents, f"file://{tmp_path}/a", BYTE)
    plan = token_output.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def check_mix(rows, aims):
    taken, size = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.target, r.source_size] += r.taken
    return taken


def test_targets_by_water_filling():
    got = cube_mixing.targets({"a": 10, "b": 100, None: 100})
    # weights 5, 2, 1 over 315 words: a stops at 20, b at 200 (of 197 it may have all), null has the rest
    assert got["a"] == 20 and abs(sum(got.values()) - 315) < 1e-9 and got["b"] <= 200 and abs(got["b"] / got[None] - 2) < 1e-9


def test_mixing(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_cube_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken, aim = collections.Counter(), collections.Counter(), {}
    for r in rows:
        source = docs[r.doc_id].source
        assert r["size"] == len((docs[r.doc_id].text or "").encode().split()) and r.taken <= 2 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r.taken
        aim[source] = r.target
    assert all(r.source_size == sizes[docs[r.doc_id].source] for r in rows)
    want = cube_mixing.targets(dict(sizes))
    assert all(abs(aim[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op7_cube_mixing(spark, sf).collect()))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, pi = rng.integers(1, 1000, 500).astype(float), np.full(500, 0.37)
    out = cube_mixing.flight(pi, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-3


def test_mixing_in_many_blocks(documents):
    rows = cube_mixing.mix(documents.withColumn('source', documents['doc_id'].cast('string').substr(1, 1)), block=8).collect()
    assert len(rows) == documents.count()
    taken = collections.Counter()
    for r in rows:
        taken[r.target] += r.taken
    # a few documents a source: the landing misses by less than a large one
    assert all(abs(t - a) <= max(r["size"] for r in rows) for a, t in taken.items())


def test_mixing_of_odd_rows(odd, none):
    rows = cube_mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r["size"] for r in rows)
    assert cube_mixing.mix(none).count() == 0 and cube_mixing.mixed(none).count() == 0
    again = cube_mixing.mixed(odd)
    assert again.columns == odd.columns and again.count() == sum(r.copies for r in rows)


def check_shards(rows, texts, shards=40):
    counts, slots, size = collections.Counter(r.shard for r in rows), collections.defaultdict(list), collections.Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.doc_id, r["size"], r.text_crc32] += 1
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1 and set(counts) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert size == collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)


def test_sharding(documents, spark, sf):
    rows = queries.op8_balanced_sharding(spark, sf).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    check_shards(rows, texts.items())
    where = collections.defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    # shards of five rows: a group may find no shard with room, but most must be whole
    groups = collections.Counter(texts.values())
    assert sum(len(where[t]) > 1 for t, n in groups.items() if n > 1) <= 1


def test_sharding_keeps_groups_whole(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    where = collections.defaultdict(set)
    for r in queries.op8_balanced_sharding(spark, sf).collect():
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_sharding_of_a_group_that_is_too_large(spark):
    docs = spark.createDataFrame([(i, "same" if i < 100 else f"t{i}") for i in range(300)], "doc_id long, text string")
    rows = balanced_sharding.shard(docs, shards=10).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 10)


def test_sharding_gathers_groups_that_are_too_large(spark):
    """Units of a group of three shards and a half, and of one of one and a half, move to their neighbours' shards."""
    texts = ["large"] * 1400 + ["larger than one"] * 600 + ["whole"] * 300 + [f"t{i}" for i in range(1700)]
    docs = list(enumerate(texts))
    random.Random(3).shuffle(docs)
    rows = balanced_sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), shards=10).collect()
    check_shards(rows, docs, 10)
    where = collections.defaultdict(collections.Counter)
    for r in rows:
        where[texts[r.doc_id]][r.shard] += 1
    assert len(where["whole"]) == 1 and len(where["large"]) <= 6 and len(where["larger than one"]) <= 4
    # pairs in one shard: spread evenly, a tenth of a group's pairs; packed as tightly as can be, 0.27 and 0.56
    share = {t: sum(n * n for n in w.values()) / sum(w.values()) ** 2 for t, w in where.items()}
    assert share["large"] > 0.2 and share["larger than one"] > 0.4


def test_sharding_of_skewed_groups(spark):
    """Groups of half a shard and more, of a quarter, and many small ones: all fit, so none is cut."""
    rng = random.Random(8)
    sizes = [130, 120, 115, 110, 105, 100, 100, 98] + [50] * 20 + [rng.randint(2, 15) for _ in range(150)]
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    texts += [f"alone {i}" for i in range(8000 - len(texts))]
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    rows = balanced_sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)
    where = collections.defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert sum(len(w) > 1 for w in where.values()) == 0


def test_sharding_of_odd_rows(odd, none):
    check_shards(balanced_sharding.shard(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert balanced_sharding.shard(none).count() == 0


def test_packing_of_copies_without_ids(spark):
    """Copies of one row without an id are dealt over groups, not gathered in one."""
    docs = spark.createDataFrame([(None, "the same few words")] * 20000, "doc_id long, text string").repartition(2)
    rows = ffd_packing.pack(docs, WORD, group_docs=1000).collect()
    assert len(rows) == 20000 and len({r.sequence_id >> 32 for r in rows}) > 2
