"""Quality classifier (operator 2): nearest-neighbour voting among labelled latent-semantic vectors.

A document is described by hashed words, hashed word shapes (runs of letters, capitals, digits and marks) and repetition
marks; sublinear counts times inverse document frequencies are projected onto the leading right singular vectors of the
labelled sample (latent semantic analysis, numpy). The labelled vectors and labels are broadcast: their number is bounded by
`most_labelled` a class, a documented parameter. Every document's cosine products with all of them are computed exactly, in
blocks; its nearest `neighbours` vote with their similarity to a power, and each class is weighed back to its share of all
labelled rows (the sample takes as many of a rare class as of a common one).

Defined cases: null, empty and word-less texts have only the mark "empty" and are scored like any other; rows with labels
that aren't 0 or 1, with labels that contradict each other, or without a document, teach nothing; of repeated documents with one
id the first by hash of the text teaches; with no labelled rows every score is 0.5; ties among neighbours
go by sample order; repeated rows score alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SHAPES, MARKS = 1024, 512, 64
DIMENSIONS = WORDS + SHAPES + MARKS

#: Bytes by kind: small letters (and all of UTF-8 beyond ASCII), capitals, digits; marks stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 57


def _shapes(words: common.Words) -> np.ndarray:
    """A hash of each word's shape, in which a run of one kind is one letter."""
    kind = _KIND[words.data]
    space = common._SPACE[words.data]
    kind[space] = 32
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep |= space
    keep[words.starts] = True
    places = np.concatenate([[0], np.cumsum(keep)])
    offsets = places[words.offsets].astype(np.int64)
    data = kind[keep]
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return common.Words(array, lower=False).hashes


def _level(x: float) -> int:
    """Tenths from 0 to 10."""
    return int(min(10, max(0, 10 * x)))


def features(texts: pa.Array) -> np.ndarray:
    """A row of hashed counts for each text."""
    words = common.Words(texts)
    shape = _shapes(words)
    w, s = (words.hashes % np.uint64(WORDS)).astype(np.int64), WORDS + (shape % np.uint64(SHAPES)).astype(np.int64)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    letters = np.concatenate([[0], np.cumsum(_KIND[words.data] == 97)])
    capitals = np.concatenate([[0], np.cumsum(_KIND[words.data] == 65)])
    digits = np.concatenate([[0], np.cumsum(_KIND[words.data] == 57)])
    for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        n = hi - lo
        marks = out[i, WORDS + SHAPES :]
        if not n:
            marks[0] = 4
            continue
        out[i] += np.bincount(np.concatenate([w[lo:hi], s[lo:hi]]), minlength=DIMENSIONS)
        a, b = words.offsets[i], words.offsets[i + 1]
        h = words.hashes[lo:hi]
        distinct, often = np.unique(h, return_counts=True)
        size = float(words.ends[hi - 1] - words.starts[lo])
        said = (n / 100, (h[1:] == h[:-1]).mean() if n > 1 else 0.0, often.max() / n if n > 5 else 0.0, (letters[b] - letters[a]) / size, (capitals[b] - capitals[a]) / size, 4 * (digits[b] - digits[a]) / size)
        for k, x in enumerate(said[1:]):
            marks[1 + 11 * k + _level(x)] = 1 + n / 4  # one term a word would be too many for a long text: halved by the logarithm
        marks[56 + min(7, int(np.log2(n + 1) / 2))] = 1
    return out


class Model:
    """What is broadcast: inverse document frequencies, the projection, the labelled vectors and their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, totals: tuple[int, int], rank: int, neighbours: int, power: float):
        self.neighbours, self.power, self.labels = neighbours, power, labels.astype(np.float32)
        if not len(labels):
            return
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.2)
        x = self._weigh(counts)
        gram = x.T @ x  # right singular vectors from the small square matrix
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(rank, len(values))]).astype(np.float32)
        self.vectors = self._unit(x @ self.basis)
        each = [totals[q] / max(1, int((labels == q).sum())) for q in (0, 1)]
        self.votes = np.where(labels == 1, each[1], each[0]).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.idf)

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        out = np.zeros(len(counts))
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(counts), block):
            near = self._unit(self._weigh(counts[i : i + block]) @ self.basis) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, 1).astype(float), 1e-6) ** self.power * self.votes[top]
            out[i : i + block] = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 2000, rank: int = 64, neighbours: int = 15, power: float = 16.0) -> Model:
    """Learn from (doc_id, text) and labels (doc_id, quality): at most `most_labelled` documents of each class, chosen by hash."""
    common.session(docs)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled) for q in (0, 1)]
    chosen = picks[0].unionByName(picks[1])  # bounded: broadcast below
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # one text an id, so that what reaches the driver is bounded by the labels
    first = texts.groupBy("doc_id").agg(F.min(F.xxhash64(F.coalesce("text", F.lit("")))).alias("h"))
    texts = texts.join(F.broadcast(first), "doc_id").where(F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("h")).drop("h")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("counts", pa.binary())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, "text"):
            rows = features(common.utf8(b.column("text")))
            yield common.output(schema, doc_id=b.column("doc_id"), quality=b.column("quality"), counts=[r.tobytes() for r in rows])

    rows = texts.mapInArrow(count, "doc_id long, quality int, counts binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    seen = rows["doc_id"].to_numpy()
    rows = rows.filter(pa.array(np.diff(seen, prepend=seen[:1] - 1) != 0)) if len(seen) else rows
    counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    return Model(counts, rows["quality"].to_numpy().astype(np.float64), (sizes.get(0, 0), sizes.get(1, 0)), rank, neighbours, power)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, predicted."""
    spark = common.session(docs)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, "text"):
            got = shared.value.score(features(common.utf8(b.column("text"))))
            yield common.output(schema, doc_id=b.column("doc_id"), score=got, predicted=(got >= threshold).astype(np.int32))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier doesn't reject, all columns kept."""
    spark = common.session(docs)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, "text", common.STAGE_BYTES):
            got = shared.value.score(features(common.utf8(b.column("text"))))
            yield b.filter(pa.array(got >= threshold))

    return docs.mapInArrow(run, docs.schema)
