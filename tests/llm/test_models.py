"""Quality, language and LM scores: held-out accuracy, brute-force counts, odd rows."""

import collections
import math
import zlib

import numpy as np
import pandas as pd

from weftgraph.llm import deleted_interpolation, knn_quality, queries, subword_langid


def crc(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def words(text):
    return (text or "").encode().lower().split()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op2_knn_quality(spark, sf).collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (10, 0), (12, 1), (99, 0), (None, 1), (13, None)], "doc_id long, quality int")
    model = knn_quality.fit(odd, labels)
    rows = knn_quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (4, 5, 6)} == {next(r.score for r in rows if r.doc_id == 4)}
    assert knn_quality.score(none, model).count() == 0
    untaught = knn_quality.fit(odd, labels.where("doc_id < 0"))
    assert {r.score for r in knn_quality.score(odd, untaught).collect()} == {0.5}
    assert knn_quality.keep(odd, model).columns == odd.columns


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_subword_langid(spark, sf).collect()
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean(held) >= 0.97


def test_language_of_odd_rows(odd, none):
    model = subword_langid.fit(odd)
    rows = {r.doc_id: r for r in subword_langid.predict(odd, model).collect()}
    assert {rows[d].lang_pred for d in (4, 5, 6, 10, 15)} == {"und"} and {rows[d].score for d in (4, 10)} == {0.0}
    assert rows[16].lang_pred in ("de", "en") and rows[13].lang_pred == "en"
    assert subword_langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in subword_langid.predict(odd, subword_langid.fit(none)).collect()} == {"und"}


def check_lm(rows, docs):
    counts = collections.Counter()
    for d, t in docs:
        if crc("" if d is None else d, 10):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d, t in docs:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        assert any(r.train_tokens == n and r.n_tokens == len(tokens) and r.n_known == sum(counts[x] > 0 for x in tokens) and abs(r.base_score - base) <= 1e-6 * max(1, -base) and r.score <= 0 for r in by[d])


def test_lm_counts(documents, spark, sf):
    rows = queries.op10_deleted_interpolation(spark, sf).collect()
    check_lm(rows, [(r.doc_id, r.text) for r in documents.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_with_small_chunks_is_the_same(documents):
    a = {r.doc_id: r for r in deleted_interpolation.score(documents).collect()}
    b = {r.doc_id: r for r in deleted_interpolation.score(documents, chunk_tokens=2000, docs_per_owner=10).collect()}
    assert all(abs(a[d].score - b[d].score) < 1e-6 * abs(a[d].score) for d in a)


def test_em_prefers_the_better_source():
    cells = pd.DataFrame({"bucket": [5, 5], "one": [1e-3, 1e-3], "two": [0.5, 0.4], "weight": [100, 50]})
    low, high = deleted_interpolation.em(cells, 1000, 100)
    assert high[5] > 0.95 and high[0] == 0 and 0 < low < 1


def test_lm_of_odd_rows(odd, none):
    rows = deleted_interpolation.score(odd).collect()
    assert len(rows) == odd.count()
    check_lm(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert deleted_interpolation.score(none).count() == 0


def test_language_of_many(spark):
    """More languages than a fixed number: the rarest is learnt and told too."""
    names = [f"l{i:03}" for i in range(215)]
    docs = [(4 * i + j, chr(97 + i % 26) * 3 + chr(97 + i // 26) * 3 + " " + chr(97 + i // 26) * 4, x) for i, x in enumerate(names) for j in range(4 if i else 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = subword_langid.fit(df)
    assert list(model.langs) == names
    assert "l000" in {r.lang_pred for r in subword_langid.predict(df.where("lang = 'l000'"), model).collect()}


def buckets(text):
    """The subwords of a text by the book: runs of 2 to 4 bytes that have white space at one end only, or of two bytes at both."""
    b = b"".join(bytes([c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c]) for c in text)
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    b = b" " + b + b" "
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            x = b[i : i + n]
            if 32 in x[1:-1] or (n > 2 and x[0] == x[-1] == 32):
                continue
            h = n
            for c in x:
                h = (h * 0x100000001B3 + c + 1) % 2**64
            for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ h >> shift) * times % 2**64
            yield (h ^ h >> 31) >> 49


def test_language_scores_against_brute_force(documents):
    model = subword_langid.fit(documents)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in subword_langid.predict(documents, model).collect()[:40]:
        text = (texts[r.doc_id] or "").encode()
        if r.lang_pred == "und" or len(text) > 20000:
            continue
        at = list(buckets(text))
        z = [sum(float(model.logits[a][k]) for a in at) / len(at) + float(model.bias[k]) for k in range(len(model.langs))]
        p = [math.exp((x - max(z)) / model.temperature) for x in z]
        best = max(range(len(p)), key=lambda k: p[k])
        assert r.lang_pred == model.langs[best] and abs(r.score - p[best] / sum(p)) < 1e-4


def test_quality_ignores_contradicting_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (10, 0), (12, 1), (13, 1)], "doc_id long, quality int")
    assert sorted(knn_quality.fit(odd, labels).labels.tolist()) == [0.0, 1.0, 1.0]
