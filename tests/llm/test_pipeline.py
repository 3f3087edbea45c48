"""The pipeline's stages against brute force, each on its own input, and on odd and empty tables."""

import collections

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from weftgraph.llm import common, knn_quality
from tests.llm.test_pairs import linked


def near_classes(rows):
    comp = linked([(i, t) for i, (_, t) in enumerate(rows)], 5, 80)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(comp[i], []).append(d)
    return ids.values()


def test_stages_against_brute_force(spark, sf, documents):
    docs = documents
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = common.materialise(stage(spark, docs, sf), "test")
        if name == "packing":
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            t.encode_special_tokens = True
            want = collections.Counter()
            for d, text in before:
                want[d] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
            got, seen = collections.Counter(), collections.defaultdict(int)
            for r in out.collect():
                got[r.doc_id] += r.length
                seen[r.sequence_id] += r.length
            assert got == want and max(seen.values()) <= 2048
            break
        assert out.columns == documents.columns
        after = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
        if name == "quality":
            model = knn_quality.fit(docs, labels.where(common.crc_mod("doc_id", 4) != 2))
            counts = knn_quality.features(pa.array([(t or "").encode() for _, t in before], pa.large_binary()))
            good = []
            for row, x in zip(before, counts, strict=True):  # every labelled vector, sorted by cosine, one document at a time
                v = np.log1p(x) * model.idf
                v = (v / max(np.linalg.norm(v), 1e-12)) @ model.basis
                near = model.vectors @ (v / max(np.linalg.norm(v), 1e-12))
                top = sorted(range(len(near)), key=lambda i: -near[i])[: model.neighbours]
                weight = [max(float(near[i]), 1e-6) ** model.power * model.votes[i] for i in top]
                if sum(w * model.labels[i] for w, i in zip(weight, top, strict=True)) / sum(weight) >= 0.7:
                    good.append(row)
            assert sorted(after) == sorted(good) and len(good) < len(before)
        elif name == "exact_dedup":
            best = {}
            for d, text in before:
                best[text or ""] = max(best.get(text or "", d), d)
            assert sorted(d for d, _ in after) == sorted(best.values())
        elif name == "near_dedup":
            assert sorted(d for d, _ in after) == sorted(min(g) for g in near_classes(before))
        else:
            taken = collections.Counter(d for d, _ in after)
            assert max(taken.values()) <= 2 and taken.keys() <= {d for d, _ in before} and after
        docs = out


def test_odd_and_empty_tables(spark, sf, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert name == "packing" or (out.columns == docs.columns and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()})
            if docs is none:
                assert not rows


def test_workers_give_freed_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 100] * 9})
    assert [b.num_rows for b in common.batches(iter([batch]), "text", 250)] == [2, 2, 2, 2, 1] and given == [1]
    monkeypatch.undo()
    common.give_back()


def test_stages_begin_with_the_heap_handed_back(spark, sf, documents):
    """Garbage of the stage before is collected in the executors' JVMs (here the driver's) before packing starts."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    corpus_pipeline.packing(spark, documents, sf)
    assert whole() > before
