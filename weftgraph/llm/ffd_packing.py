"""Packing (operator 4): first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Only lengths are packed: a pass over the texts tokenises each document, cuts it into pieces of at most `capacity` ids and
keeps a checksum of each, so no token crosses the network. Pieces are dealt by a seeded hash of their id, place, checksum and the
thousand of their task's rows they are among (so that neither null ids nor copies meet in one group) into groups of about
`group_docs` documents; each group is packed alone, so packing is one small shuffle of (id, start, length) rows at any size.

Defined cases: null or empty text is one piece of the end id alone; a text of any length is cut; ties in length go by id,
then start; repeated rows are packed once for each row; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rows of one task that copies of a piece may share a group with.
DEAL = 1000


class CapacityTree:
    """A tournament tree over bins that finds the first bin with enough room in O(log n)."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for the length, and the room it had; the room shrinks by the length."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < length:
                k += 1
        had = room[k]
        room[k] = had - length
        at = k - self.leaves
        while k > 1:
            k //= 2
            left, right = room[2 * k], room[2 * k + 1]
            room[k] = left if left >= right else right
        return at, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; the lengths must already decrease."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int(np.searchsorted(-lengths, -capacity, "right"))  # full pieces open a bin each
    bins[:full] = np.arange(full)
    tree = CapacityTree(len(lengths) - full, capacity)
    for i in range(full, len(lengths)):
        at, had = tree.place(int(lengths[i]))
        bins[i], offsets[i] = full + at, capacity - had
    return bins, offsets


def pieces(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, deal (the thousand of the task's rows)."""
    common.session(df)
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "deal"))])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        task, row = TaskContext.get().partitionId() << 32, 0
        for b in common.batches(it, "text", most_bytes):
            out: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode_all(common.utf8(b.column("text")).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                out += [(doc, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, task + row // DEAL) for at in range(0, n, capacity)]
                row += 1
            if out:
                yield common.output(schema, **{f.name: list(c) for f, c in zip(schema, zip(*out, strict=True), strict=True)})

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(cut, PIECES + ", deal long")


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_docs: int = 4096, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """Pieces with their sequence_id and offset. Sequence ids are unique; their order has no meaning. most_bytes: of texts encoded at once."""
    groups = max(1, math.ceil(df.count() / group_docs))
    cut = pieces(df, tokenizer, capacity, end_id, id_col, text_col, most_bytes)

    def fill(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first")
        bins, offsets = first_fit_decreasing(p["length"].to_numpy(), capacity)
        p["sequence_id"], p["offset"] = (int(p["grp"].iloc[0]) << 32) + bins, offsets
        return p.drop(columns=["grp", "deal"])

    return cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "deal", F.lit(seed)), F.lit(groups))).groupBy("grp").applyInPandas(fill, PIECES + ", sequence_id long, offset long")
