"""Exact dedup (operator 6): Golomb-coded fingerprint exchange, duplicate bitmaps, byte verification of suspects.

1. Each task fingerprints its texts (SHA-256, of which 64 bits are exchanged) and sends every owner (a range of
   fingerprints) its sorted distinct fingerprints, Golomb-Rice coded, next to a packed row of its documents.
2. An owner decodes the lists of all senders, finds the fingerprints that occur more than once and answers each sender with
   a bitmap over that sender's list.
3. The sender's packed row and bitmaps meet again: each document is a suspect or alone. Only fingerprints are moved so far.
4. The bitmaps are applied where the texts are read (places.Numbered.within): suspects' texts alone are shuffled. They are
   grouped by the whole text with map-side aggregation, so a copy that fills a third of the rows leaves each task once, and
   every fingerprint must stand for one text; a collision stops the job.

`keep_one` drops rows the same way, by their numbers where they are read, so no kept text is shuffled.

Defined cases: null text counts as empty; empty texts are copies of one another; the largest id stays, and of repeated rows
with that id the one whose other columns hash highest; null ids are below all others; no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, places

#: Documents of one sender; bounds the packed rows.
CHUNK_DOCS = 50_000


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as Golomb-Rice coded differences: unary quotients, then binary remainders."""
    n = len(values)
    if not n:
        return np.array([0, 0], "<u8").tobytes()
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(math.log2(max(1.0, float(values[-1]) / n))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    packed = np.packbits(unary)
    return np.array([n, k | len(packed) << 8], "<u8").tobytes() + packed.tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    n, head = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    if not n:
        return np.zeros(0, np.uint64)
    k, m = head & 255, head >> 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, m, 16)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, 16 + m))[: n * k].reshape(n, k).astype(np.uint64) if k else np.zeros((n, 0), np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + (bits << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def duplicate_bitmaps(lists: list[np.ndarray], repeated: list[np.ndarray]) -> list[np.ndarray]:
    """For each sender's list, which fingerprints another sender has too, or the sender itself more than once (repeated)."""
    every, counts = np.unique(np.concatenate(lists), return_counts=True)
    return [(counts[np.searchsorted(every, x)] > 1) | r for x, r in zip(lists, repeated, strict=True)]


def _send(owners: int):
    longs = pa.list_(pa.int64())
    schema = pa.schema([("src", pa.int64()), ("owner", pa.int32()), ("blob", pa.binary()), ("extra", pa.binary()), ("ids", longs), ("rids", longs), ("ties", longs)])

    def flush(src: int, docs: pa.Table) -> Iterator[pa.RecordBatch]:
        sha = np.frombuffer(b"".join(docs["sha"].to_pylist()), np.uint8).reshape(-1, 32)
        prints = np.ascontiguousarray(sha[:, :8]).view(">u8").ravel().astype(np.uint64)
        distinct, counts = np.unique(prints, return_counts=True)
        owner = (distinct >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
        at = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
        sent = np.flatnonzero(at[:-1] < at[1:]).tolist()
        blobs = [rice_encode(distinct[at[o] : at[o + 1]] - distinct[at[o]]) + int(distinct[at[o]]).to_bytes(8, "little") for o in sent]
        twice = [np.packbits(counts[at[o] : at[o + 1]] > 1).tobytes() for o in sent]
        # owner -1: the sender's own documents, which wait for the answers
        own = {n: pa.concat_arrays([pa.nulls(len(sent), longs), pa.ListArray.from_arrays([0, len(docs)], docs[c].combine_chunks())]) for n, c in (("ids", "doc_id"), ("rids", places.RID), ("ties", "tie"))}
        yield common.output(schema, src=[src] * (len(sent) + 1), owner=[*sent, -1], blob=[*blobs, sha.tobytes()], extra=[*twice, b""], **own)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in it:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK_DOCS:
                yield from flush(src, pa.Table.from_batches(held))
                src, held, n = src + 1, [], 0
        if n:
            yield from flush(src, pa.Table.from_batches(held))

    return send


def _answer(p: pd.DataFrame) -> pd.DataFrame:
    lists = [rice_decode(b[:-8]) + np.uint64(int.from_bytes(b[-8:], "little")) for b in p["blob"]]
    repeated = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(v)].astype(bool) for x, v in zip(p["extra"], lists, strict=True)]
    return pd.DataFrame({"src": p["src"], "owner": p["owner"], "blob": [np.packbits(m).tobytes() for m in duplicate_bitmaps(lists, repeated)]})


def _receive(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    out = []
    answers = answers.sort_values("owner")
    for ids, rids, ties, blob in zip(own["ids"], own["rids"], own["ties"], own["blob"], strict=True):
        sha = np.frombuffer(blob, np.uint8).reshape(-1, 32)
        prints = np.ascontiguousarray(sha[:, :8]).view(">u8").ravel().astype(np.uint64)
        distinct, place = np.unique(prints, return_inverse=True)
        owners = (distinct >> np.uint64(32)) * np.uint64(int(own["owners"].iloc[0])) >> np.uint64(32)
        sizes = np.unique(owners, return_counts=True)[1]
        bits = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(answers["blob"], sizes, strict=True)]
        flags = np.concatenate(bits).astype(bool)[place]
        out.append(pd.DataFrame({"doc_id": pd.array(list(ids), "Int64"), "sha": [bytes(x) for x in sha], "suspect": flags, places.RID: rids, "tie": ties}))
    return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], "Int64"), "sha": [], "suspect": [], places.RID: [], "tie": []})


def fingerprint(column: str):
    return F.unhex(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"), 256))


def suspects(docs: places.Numbered, text_col: str = "text", docs_per_owner: int = 200_000) -> DataFrame:
    """doc_id, sha, suspect, row number and tie of every row of a numbered frame with the columns doc_id and tie."""
    owners = max(4, math.ceil(docs.total / docs_per_owner))
    printed = docs.rows.select("doc_id", fingerprint(text_col).alias("sha"), places.RID, "tie")
    longs = "ids array<long>, rids array<long>, ties array<long>"
    sent = common.materialise(printed.mapInArrow(_send(owners), f"src long, owner int, blob binary, extra binary, {longs}"), "exchange")
    answers = sent.where("owner >= 0").select("src", "owner", "blob", "extra").groupBy("owner").applyInPandas(_answer, "src long, owner int, blob binary")
    own = sent.where("owner < 0").select("src", "ids", "rids", "ties", "blob", F.lit(owners).alias("owners"))
    out = own.groupBy("src").cogroup(answers.groupBy("src")).applyInPandas(_receive, f"doc_id long, sha binary, suspect boolean, {places.RID} long, tie long")
    kept = common.materialise(out, "suspects")
    common.discard(sent)
    return kept


def _decided(docs: places.Numbered) -> DataFrame:
    """Per row of a numbered frame (doc_id, text, tie): doc_id, keep_id, group_size, kept, sha and the row's number."""
    marked = suspects(docs)
    some = marked.where("suspect")
    # the bitmaps decide at the reader which texts are moved; grouping by the whole text compares the bytes
    texts = docs.within(some).select(F.coalesce("text", F.lit("")).alias("text"), fingerprint("text").alias("sha"))
    verified = texts.groupBy("sha", "text").agg(F.count(F.lit(1)).alias("rows")).groupBy("sha").agg(F.count(F.lit(1)).alias("texts"))
    stop = F.raise_error(F.lit("two texts share a SHA-256 fingerprint"))
    best = F.max(F.struct("doc_id", "tie", places.RID)).alias("keep")
    classes = some.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), best).join(verified, "sha")
    classes = common.materialise(classes.where(F.when(F.col("texts") == 1, F.lit(True)).otherwise(stop)).select("sha", "n", "keep"), "classes")
    out = common.join_hot(some, classes, "sha", "n", docs.total)
    out = out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col(places.RID) == F.col(f"keep.{places.RID}")).alias("kept"), "sha", places.RID)
    alone = marked.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", places.RID)
    return out.unionByName(alone)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    common.session(df)
    docs = places.Numbered(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), places.tie(df).alias("tie")), "texts")
    return _decided(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each text left (the one with the largest id), all columns kept.

    Rows with a null id stay only if their text has no row with one; then one of them does.
    """
    common.session(df)
    docs = places.Numbered(df, "documents")
    at = docs.scan
    texts = places.Numbered(at.select(at[id_col].cast("long").alias("doc_id"), at[text_col].cast("string").alias("text"), places.tie(at).alias("tie")))
    return docs.within(_decided(texts).where("not kept"), keep=False).drop(places.RID)
