"""LM scoring (operator 10): a bigram model by deleted interpolation, learned from and applied to all documents.

P(w | h) = L2[b] * c(h w) / c(h) + (1 - L2[b]) * P(w),  P(w) = L1 * c(w) / N + (1 - L1) / (V + 1), where b is the bucket of
the context's frequency c(h). The weights come from expectation-maximisation on held-out counts: a tenth of the training
documents (the fold) is deleted from the counts while the weights are learned; the scores use all training counts.

Exact counts of billions of n-grams don't fit one machine, so they are exchanged. Documents are gathered in chunks of about
`chunk_tokens`; a chunk sends each owner (a range of n-gram hashes) its sorted distinct n-grams with their counts,
delta-coded, and keeps its documents as local word numbers. Owners add up and answer every chunk with the totals of what it
asked for, in its order, so each count crosses the network twice per chunk and no table is held whole anywhere. Held-out
probabilities reach the driver only as a histogram over a fixed grid of logarithms, over which EM runs.

Unigrams are told apart by 64-bit hashes, bigrams by 48 bits of theirs.
Defined cases: null and empty texts are the end token alone; null ids count as the empty text in the remainder; repeated rows
count each time; without training rows every probability is 1 / (V + 1) = 1; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = common.mix(np.array([0x656E64], np.uint64))[0]
START = common.mix(np.array([0x7374617274], np.uint64))[0]
#: Buckets of the context's frequency: powers of two up to this.
BUCKETS = 24
#: Steps of the EM grid for one doubling.
GRID = 4
TRAIN, FOLD, HELD = 0, 1, 2


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays, split into byte planes and compressed."""
    parts = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        parts += [len(a).to_bytes(8, "little"), a.itemsize.to_bytes(4, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unzip(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        n, size = int.from_bytes(raw[at : at + 8], "little"), int.from_bytes(raw[at + 8 : at + 12], "little")
        planes = np.frombuffer(raw, np.uint8, n * size, at + 12).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel())
        at += 12 + n * size
    return out


def _owner(keys: np.ndarray, bits: int, owners: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(owners)) >> np.uint64(32)


def _narrow(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences: without the first in 32 bits if they fit, else with it in 64."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps if gaps[1:].max(initial=0) >= 1 << 32 else gaps[1:].astype(np.uint32)


def _pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return _zip(keys[:1], _narrow(keys), counts.astype(np.uint32))


def _keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, gaps, counts = _unzip(blob)
    if gaps.itemsize == 8:
        return np.cumsum(gaps, dtype=np.uint64), counts
    return np.cumsum(np.concatenate([first, gaps.astype(np.uint64)]), dtype=np.uint64), counts


def _bigram_keys(hashes: np.ndarray, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """48-bit keys of (token before, token) for each token; begins: where documents begin."""
    h = hashes[ids]
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[begins] = START
    return common.mix(before * np.uint64(0xD6E8FEB86659FD93) + h) >> np.uint64(16)


class _Chunk:
    """Documents gathered by one task until they are enough."""

    def __init__(self, role: int):
        self.role, self.ids, self.lengths, self.tokens, self.learns, self.size = role, [], [], [], [], 0

    def add(self, doc, tokens: np.ndarray, learns: bool) -> None:
        self.ids.append(doc)
        self.lengths.append(len(tokens))
        self.tokens.append(tokens)
        self.learns.append(learns)
        self.size += len(tokens)

    def rows(self, src: int, owners: int) -> Iterator[tuple]:
        tokens, lengths = np.concatenate(self.tokens), np.array(self.lengths, np.uint32)
        begins = np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64)
        learns = np.repeat(np.array(self.learns), lengths)
        hashes, ids, often = np.unique(tokens, return_inverse=True, return_counts=True)
        for order, bits, keys, place in ((1, 64, hashes, ids), (2, 48, *np.unique(_bigram_keys(hashes, ids, begins), return_inverse=True))):
            counts = np.bincount(place[learns], minlength=len(keys))
            at = np.searchsorted(_owner(keys, bits, owners), np.arange(owners + 1, dtype=np.uint64))
            for o in np.flatnonzero(at[1:] > at[:-1]):
                yield src, "ask", order, int(o), self.role, _pack_keys(keys[at[o] : at[o + 1]], counts[at[o] : at[o + 1]]), None
        rank = np.empty(len(hashes), np.uint32)
        by = np.argsort(-often, kind="stable")
        rank[by] = np.arange(len(hashes), dtype=np.uint32)
        yield src, "docs", 0, sum(self.learns), self.role, _zip(rank[ids], by.astype(np.uint32), hashes, lengths, np.array(self.learns, np.uint8)), self.ids


SENT = pa.schema([("src", pa.int64()), ("kind", pa.string()), ("ord", pa.int32()), ("owner", pa.int32()), ("role", pa.int32()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _send(owners: int, chunk_tokens: int):
    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 32
        open_ = {TRAIN: _Chunk(TRAIN), FOLD: _Chunk(FOLD)}

        def flush(role: int) -> pa.RecordBatch:
            nonlocal src
            rows = list(open_[role].rows(src, owners))
            open_[role], src = _Chunk(role), src + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT)

        for b in common.batches(it, "text"):
            words = common.Words(common.utf8(b.column("text")))
            for doc, role, lo, hi in zip(b.column("doc_id").to_pylist(), b.column("role").to_pylist(), words.first[:-1], words.first[1:], strict=True):
                to = FOLD if role == FOLD else TRAIN
                open_[to].add(doc, np.append(words.hashes[lo:hi], END), role != HELD)
                if open_[to].size >= chunk_tokens:
                    yield flush(to)
        for role, c in open_.items():
            if c.size:
                yield flush(role)

    return send


def _answer(p: pd.DataFrame) -> pd.DataFrame:
    """The totals of an owner's n-grams: for each chunk what it asked for, and a row of sums (src -1) for unigrams."""
    asked = [_keys(b) for b in p["blob"]]
    keys, place = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    counts, fold = np.concatenate([c for _, c in asked]).astype(float), np.repeat((p["role"] == FOLD).to_numpy(), [len(k) for k, _ in asked])
    kept = np.bincount(place, counts * ~fold, len(keys)).astype(np.uint32)
    every = np.bincount(place, counts, len(keys)).astype(np.uint32)
    at, rows = 0, []
    for src, role, (k, _) in zip(p["src"], p["role"], asked, strict=True):
        mine = place[at : at + len(k)]
        at += len(k)
        rows.append((src, _zip(every[mine], kept[mine]) if role == FOLD else _zip(every[mine]), 0, 0, 0, 0))
    order = int(p["ord"].iloc[0])
    if order == 1:
        rows.append((-1, b"", int(every.sum()), int((every > 0).sum()), int(kept.sum()), int((kept > 0).sum())))
    out = pd.DataFrame(rows, columns=["src", "blob", "n", "v", "n_kept", "v_kept"])
    return out.assign(ord=order, owner=int(p["owner"].iloc[0]), role=[*p["role"], *[-1] * (len(rows) - len(p))])[["src", "ord", "owner", "role", "blob", "n", "v", "n_kept", "v_kept"]]


class _Gathered:
    """A chunk's documents with the totals of their n-grams."""

    def __init__(self, row, answers: pd.DataFrame, which: int = 0):
        rank, by, hashes, self.lengths, self.learns = _unzip(row["blob"])
        self.ids = row["ids"]
        self.tokens = by[rank].astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths[:-1])]).astype(np.int64)
        keys = _bigram_keys(hashes, self.tokens, self.begins)
        distinct, place = np.unique(keys, return_inverse=True)
        got = {o: np.concatenate([_unzip(b)[which] for b in g.sort_values("owner")["blob"]]) for o, g in answers.groupby("ord")}
        assert len(got[1]) == len(hashes) and len(got[2]) == len(distinct)
        self.one = got[1][self.tokens].astype(float)
        self.two = got[2][place].astype(float)
        self.context = np.empty(len(self.one))
        self.context[1:] = self.one[:-1]

    def contexts(self, starts: float) -> np.ndarray:
        c = self.context.copy()
        c[self.begins] = starts
        return c


def bucket(context: np.ndarray) -> np.ndarray:
    """0: an unseen context; else 1 + log2 of its frequency, BUCKETS - 1 at most."""
    return np.minimum(np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0), BUCKETS - 1).astype(np.int64)


def em(cells: pd.DataFrame, n: float, v: float, rounds: int = 60) -> tuple[float, np.ndarray]:
    """Mixture weights of (unigram, bigram by bucket) from held-out cells: bucket, one (unigram's share), two (bigram's), weight."""
    base, low, high = 1 / (v + 1), 0.9, np.full(BUCKETS, 0.5)
    b, w, p1, p2 = cells["bucket"].to_numpy(), cells["weight"].to_numpy(float), cells["one"].to_numpy(), cells["two"].to_numpy()
    seen = np.bincount(b, w, BUCKETS)
    for _ in range(rounds if len(b) else 0):
        uni = low * p1 + (1 - low) * base
        mixed = high[b] * p2 + (1 - high[b]) * uni
        take2 = w * high[b] * p2 / mixed
        rest = w - take2
        take1 = rest * low * p1 / uni
        high = np.where(seen > 0, np.bincount(b, take2, BUCKETS) / np.maximum(seen, 1e-300), high)
        low = float(take1.sum() / max(rest.sum(), 1e-300))
    high[0] = 0.0
    return min(max(low, 1e-6), 1 - 1e-6), np.clip(high, 0, 1 - 1e-6)


def score(df: DataFrame, chunk_tokens: int = 600_000, docs_per_owner: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    common.session(df)
    owners = max(8, math.ceil(df.count() / docs_per_owner))
    ten, hundred = common.crc_mod("doc_id", 10), common.crc_mod("doc_id", 100)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    docs = docs.withColumn("role", F.when(ten == 0, HELD).when(F.floor(hundred / 10) == 3, FOLD).otherwise(TRAIN))
    sent = common.materialise(docs.mapInArrow(_send(owners, chunk_tokens), "src long, kind string, ord int, owner int, role int, blob binary, ids array<long>"), "lm", by=("kind",))
    asked = sent.where("kind = 'ask'").select("src", "ord", "owner", "role", "blob")
    answers = common.materialise(asked.groupBy("ord", "owner").applyInPandas(_answer, "src long, ord int, owner int, role int, blob binary, n long, v long, n_kept long, v_kept long"), "answers")
    common.discard_part(sent, "kind=ask")
    own = sent.where("kind = 'docs'").select("src", "role", "owner", "blob", "ids")
    sums = answers.where("src = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_kept", "v_kept")]).first()
    starts = own.groupBy("role").agg(F.sum("owner").alias("n")).collect()
    starts = {r["role"]: r["n"] for r in starts}
    replies = answers.where("src >= 0").select("src", "ord", "owner", "role", "blob")

    starts_kept = float(starts.get(TRAIN, 0))

    def cells(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"bucket": [], "q1": [], "q2": [], "weight": []})
        g = _Gathered(left.iloc[0], right, 1)
        context = g.contexts(starts_kept)
        q1 = np.where(g.one > 0, np.round(GRID * np.log2(np.maximum(g.one, 1))), -1).astype(int)
        two = np.where(context > 0, g.two / np.maximum(context, 1), 0)
        q2 = np.where(two > 0, np.round(-GRID * np.log2(np.maximum(two, 1e-300))), -1).astype(int)
        t = pd.DataFrame({"bucket": bucket(context), "q1": q1, "q2": q2, "weight": 1})
        return t.groupby(["bucket", "q1", "q2"], as_index=False)["weight"].sum()

    fold = own.where(F.col("role") == FOLD).groupBy("src").cogroup(replies.where(F.col("role") == FOLD).groupBy("src"))
    found = fold.applyInPandas(cells, "bucket int, q1 int, q2 int, weight long").groupBy("bucket", "q1", "q2").agg(F.sum("weight").alias("weight"))
    t = found.toPandas()  # cells of a fixed grid
    t["one"] = np.where(t["q1"] >= 0, 2.0 ** (t["q1"] / GRID) / max(1, sums["n_kept"]), 0.0)
    t["two"] = np.where(t["q2"] >= 0, 2.0 ** (-t["q2"] / GRID), 0.0)
    low, high = em(t, sums["n_kept"], sums["v_kept"])
    n, v, begun = float(sums["n"]), float(sums["v"]), float(sum(starts.values()))

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            g = _Gathered(row, right)
            context = g.contexts(begun)
            uni = low * g.one / max(n, 1) + (1 - low) / (v + 1)
            b = high[bucket(context)]
            p = b * np.where(context > 0, g.two / np.maximum(context, 1), 0) + (1 - b) * uni
            at = g.begins
            out.append(pd.DataFrame({"doc_id": pd.array(list(g.ids), "Int64"), "held_out": g.learns == 0, "n_tokens": g.lengths.astype(np.int64), "n_known": np.add.reduceat((g.one > 0).astype(np.int64), at), "train_tokens": int(n), "base_score": np.add.reduceat(np.log10((g.one + 0.1) / (n + 0.1 * (v + 1))), at), "score": np.add.reduceat(np.log10(p), at)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    return own.groupBy("src").cogroup(replies.groupBy("src")).applyInPandas(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
