"""Mixing sources to target weights (operator 7): balanced sampling by the cube method.

Targets: sources in code-point order, null last, weigh as `weights` repeats and share `share` of all words; a target stops at
`cap` times its source's size and the excess is shared again by weight. A source with target/size = m takes each document
floor(m) times and once more with inclusion probability m - floor(m). The cube method draws those: in each block of a source,
probabilities move along the null space of the balance constraints (document total and word total) until fewer than three
are fractional; blocks' remainders meet in the next level; the last few units of a source are landed by the best of all their
assignments. Blocks have at most `block` documents, so a source with a third of all rows is spread over tasks.

Defined cases: null or empty text has size 0 and is taken 0 words; null source is a source of its own; ties and repeated rows
are ordered by (hash of id, id, size) and interchangeable; no rows give no rows; other columns are ignored. One row a source
is brought to the driver, so the number of sources must be bounded (by `most_sources`, checked).
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, places

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Each source's target: its weighted share, at most cap times its size, the excess reshared among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weigh[s] for s in open_)
        over = [s for s in order if s in open_ and unit * weigh[s] > cap * sizes[s]]
        for s in over or sorted(open_, key=order.index):
            out[s] = cap * sizes[s] if over else unit * weigh[s]
            open_.discard(s)
            left -= out[s]
    return out


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, stop: int = 2) -> np.ndarray:
    """Move probabilities to 0 or 1, three units at a time, keeping sum(pi) and sum(pi * size), until `stop` are fractional.

    Small units go first: the large ones that are left have many different sums, so landing comes near any total.
    """
    p, s = pi.tolist(), size.tolist()
    live = sorted((i for i, x in enumerate(p) if 0 < x < 1), key=lambda i: -s[i])
    draws = rng.random(len(live) + 1).tolist()
    hand, queue, left = live[-3:], live[:-3], len(live)
    while left > max(stop, 2):
        a, b, c = hand
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(hand, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(hand, u, strict=True) if v)
        step = up if draws[left] * (up + down) < down else -down
        for i, v in zip(hand, u, strict=True):
            p[i] += step * v
        rest = []
        for i in hand:
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
                left -= 1
            else:
                rest.append(i)
        hand = rest + [queue.pop() for _ in range(min(3 - len(rest), len(queue)))]
    return np.array(p, float)


def land(pi: np.ndarray, size: np.ndarray, owed: float) -> np.ndarray:
    """Decide the last fractional units: of all assignments the one whose words come nearest to owed, then whose count does."""
    live = np.flatnonzero((pi > 0) & (pi < 1))
    out = np.round(pi)
    if len(live):
        every = np.array(list(itertools.product((0.0, 1.0), repeat=len(live))))
        miss = np.abs(every @ size[live] - owed)
        count = np.abs(every.sum(1) - pi[live].sum())
        out[live] = every[np.lexsort((count, miss + 0.02 * size[live].mean() * count))[0]]
    return out


def _draw(seed: int, level: int, stop: int, last: bool):
    """A block's flight, and its landing in the last level; seeded by source and block, so reruns agree."""

    def draw(p: pd.DataFrame) -> pd.DataFrame:
        first = p.iloc[0]
        rng = np.random.default_rng([seed, level, int(first["block"]), zlib.crc32(repr(first["source"]).encode())])
        order = pd.util.hash_array(p["doc_id"].fillna(-1).to_numpy(np.int64))
        p = p.assign(_h=order).sort_values(["_h", "doc_id", "size"], kind="stable").drop(columns="_h")
        sizes = p["size"].to_numpy(float)
        pi = flight(p["pi"].to_numpy(float), sizes, rng, stop)
        if last:
            at = (pi > 0) & (pi < 1)
            pi = land(pi, sizes, float((pi[at] * sizes[at]).sum()))
        return p.assign(pi=pi)

    return draw


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 20_000, landing: int = 12, seed: int = 7, most_sources: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, copies (and the carried columns)."""
    common.session(df)
    block = max(8, block)  # each level must leave fewer units than it had
    size = F.regexp_count(F.coalesce(df[text_col].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    docs = common.materialise(df.select(df[id_col].cast("long").alias("doc_id"), df[source_col].cast("string").alias("source"), size.alias("size"), *[df[c].alias(f"carry_{c}") for c in carry]), "sizes")
    totals = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    aims = targets({r["source"]: r["size"] for r in totals}, weights, share, cap)
    spark = df.sparkSession
    rows = [(r["source"], r["size"], float(aims[r["source"]]), math.ceil(r["n"] / block)) for r in totals]
    table = spark.createDataFrame(rows, "source string, source_size long, target double, blocks int")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = docs.alias("d").join(F.broadcast(table).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    joined = joined.withColumns({"ratio": ratio, "whole": F.floor(ratio + 1e-12).cast("int")}).withColumn("pi", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    joined = joined.withColumn("pi", F.when(F.col("size") == 0, F.round("pi")).otherwise(F.col("pi")))
    open_ = joined.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"))
    done = []
    level = 0
    most = max((r[3] for r in rows), default=1)
    while True:
        last = most <= 1
        drawn = open_.groupBy("source", "block").applyInPandas(_draw(seed, level, landing if last else 2, last), open_.schema)
        if last:
            done.append(drawn)
            break
        drawn = common.materialise(drawn, "drawn")
        done.append(drawn.where("pi <= 0 or pi >= 1"))
        level += 1
        most = math.ceil(2 * most / block)
        open_ = drawn.where("pi > 0 and pi < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), F.col("blocks")).cast("int"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("pi")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def mixed(df: DataFrame, cap: float = 2.0, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it. Rows with no words are taken as often as their source's whole number says.

    Only sizes are shuffled: what the mix takes is read again by its rows' numbers, once for each number of copies up to the cap.
    """
    common.session(df)
    docs = places.Numbered(df, "documents")
    sized = docs.rows.select("doc_id", "text", "source", places.RID)
    plan = common.materialise(mix(sized, cap=cap, carry=(places.RID,), **options).select(places.RID, "copies"), "plan")
    out = docs.within(plan.where("copies >= 1"))
    for n in range(2, math.ceil(cap) + 1):
        out = out.unionByName(docs.within(plan.where(F.col("copies") >= n)))
    return out.drop(places.RID)
