"""Language ID (operator 3): averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are runs of 2 to 4 bytes of the lower-cased text, words bounded by one space, hashed into buckets; a text is the
average of its subwords' embeddings. Training draws a bounded, documented sample of labelled rows (`most_rows` a language,
by hash), whole and in crops, and minimises the softmax loss by mini-batch SGD; documents set aside, of which no crop is taught, set
the temperature that calibrates scores, and the score under which a prediction is marked `rejected`.

Since the model is linear, embeddings times weights fold into one table of bucket logits: scoring is a gather and a mean.
Defined cases: null texts and texts without a letter are `und` with score 0; without training rows all are `und`; ties go
to the language that is first in code-point order; repeated rows score alike; no rows give no rows; other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
CROPS = (40, 12, 4)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def subwords(raw: np.ndarray) -> np.ndarray:
    """Buckets of a text's subwords (UTF-8 bytes): byte runs with white space only at their ends."""
    b = _FOLD[raw]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = np.concatenate([[32], b[keep], [32]]).astype(np.uint64)
    space = b == 32
    out = []
    for n in SIZES:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + b[i : i + m] + np.uint64(1)
        inside = np.ones(m, bool)
        for i in range(1, n - 1):
            inside &= ~space[i : i + m]
        if n > 2:
            inside &= ~(space[:m] & space[n - 1 :])
        out.append(common.mix(h[inside]) >> np.uint64(49))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def has_letter(text: bytes) -> bool:
    return bool(_LETTER[np.frombuffer(text, np.uint8)].any()) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


class Model:
    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, floor: float):
        self.langs, self.logits, self.bias, self.temperature, self.floor = langs, logits, bias, temperature, floor

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for i, t in enumerate(texts):
            if not t or not self.langs or not has_letter(t):
                names.append("und")
                continue
            at = subwords(np.frombuffer(t, np.uint8))
            z = sum((self.logits[at[j : j + 65536]].sum(0, dtype=np.float64) for j in range(0, len(at), 65536)), np.zeros(len(self.langs))) / max(1, len(at)) + self.bias
            z = np.exp((z - z.max()) / self.temperature)
            z /= z.sum()
            best = int(z.argmax())
            names.append(self.langs[best])
            scores[i] = z[best]
        return names, scores


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], groups: np.ndarray | None = None, dimension: int = 16, epochs: int = 12, rate: float = 20.0, batch: int = 64, seed: int = 5) -> Model:
    """SGD over (distinct buckets, counts) rows; every fifth document (groups: the rows' documents) sets temperature and rejection."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    table, weights, bias = rng.normal(0, 1 / dimension, (BUCKETS, dimension)), np.zeros((dimension, k)), np.zeros(k)
    groups = np.arange(len(rows)) if groups is None else groups
    aside = groups % 5 == 4 if len(rows) >= 20 else np.zeros(len(rows), bool)
    learn = np.flatnonzero(~aside)
    share = [c / c.sum() if len(c) else c.astype(float) for _, c in rows]
    weights[:] = rng.normal(0, 0.1, weights.shape)
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(learn)
        for i in range(0, len(learn), batch):
            pick = order[i : i + batch]
            mean = np.stack([share[j] @ table[rows[j][0]] if len(rows[j][0]) else np.zeros(dimension) for j in pick])
            z = mean @ weights + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(pick)), labels[pick]] -= 1
            z /= len(pick)
            back = z @ weights.T
            weights -= step * (mean.T @ z)
            bias -= 0.1 * step * z.sum(0)
            for j, g in zip(pick, back, strict=True):
                table[rows[j][0]] -= 10 * step * share[j][:, None] * g
    logits = (table @ weights).astype(np.float32)
    test = np.flatnonzero(aside) if aside.any() else learn
    z = np.stack([share[j] @ logits[rows[j][0]] + bias if len(rows[j][0]) else bias for j in test]) if len(test) else np.zeros((0, k))

    def told(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    if not len(test):
        return Model(langs, logits, bias, 1.0, 0.5)
    truth = labels[test]
    grid = np.geomspace(0.05, 20, 61)
    temperature = float(grid[np.argmin([-np.log(np.maximum(told(t)[np.arange(len(test)), truth], 1e-12)).mean() for t in grid])])
    p = told(temperature)
    right, top = p.argmax(1) == truth, p.max(1)
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99)
    floor = float(top[order][good[-1]]) if len(good) else float(top.max())
    return Model(langs, logits, bias, temperature, floor)


def fit(docs: DataFrame, most_rows: int = 1000, **options) -> Model:
    """Learn from rows (doc_id, text, lang): at most `most_rows` of each language, chosen by hash. Every language is learnt; each takes BUCKETS floats."""
    common.session(docs)
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    # chosen by an id hash without the texts; a share of each language first, so that no window sees a whole one
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    ids = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")).join(F.broadcast(sizes), "lang").where(F.col("h") < 2.0 * most_rows * (1 << 30) / F.col("n") + 1)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = ids.withColumn("k", rank).where(F.col("k") <= most_rows).select("doc_id").distinct()
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, "text"):
            out = []
            for doc, lang, text in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), common.utf8(b.column("text")).to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                words = text.split()
                rng = np.random.default_rng(abs(doc or 0))
                cuts = [text] + [b" ".join(words[s : s + c]) for c in CROPS if len(words) > c for s in (int(rng.integers(0, len(words) - c)),)]
                for c in cuts:
                    at, n = np.unique(subwords(np.frombuffer(c, np.uint8)), return_counts=True)
                    out.append((doc, lang, at.astype(np.int32), n.astype(np.int32)))
            if out:
                yield common.output(schema, **{f.name: list(c) for f, c in zip(schema, zip(*out, strict=True), strict=True)})

    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(count, "doc_id long, lang string, at array<int>, n array<int>").toArrow()
    table = sorted(zip(rows["doc_id"].to_pylist(), rows["lang"].to_pylist(), rows["at"].to_numpy(), rows["n"].to_numpy(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], -len(r[2])))
    index = {s: i for i, s in enumerate(langs)}
    # the documents of each language are numbered apart, so that the part set aside has a fifth of each
    numbers: dict[str, dict] = {}
    groups = np.array([numbers.setdefault(r[1], {}).setdefault(r[0], len(numbers[r[1]])) for r in table], np.int64)
    return train([(np.asarray(r[2]), np.asarray(r[3])) for r in table], np.array([index[r[1]] for r in table], np.int64), langs, groups, **options)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, rejected."""
    spark = common.session(docs)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, "text"):
            names, scores = shared.value.predict(common.utf8(b.column("text")).to_pylist())
            yield common.output(schema, doc_id=b.column("doc_id"), lang_pred=names, score=scores, rejected=scores < shared.value.floor)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
