"""MinHash near-dedup (operator 5): circulant MinHash, banding, exact Jaccard verification, components.

Signatures: a shingle's bin in a universe of D is moved by one permutation; coordinate k of a document is the minimum over
its shingles of a second permutation read at (place + k) mod D. Two permutations thus make all coordinates, and a
document's signature is the column-wise minimum of windows of one table.

Links: documents with equal shingle sets form a class (one fingerprint), whose node is its least row number; classes that share
a band are candidates, and every link is confirmed on the full sets. To merge a bucket of n classes without its n*n pairs, (1) every class is checked against
the bucket's pivot, the class that shares most bands with others, (2) against the pivot of a random handful of the bucket,
(3) classes still outside the bucket's main component are checked against all its others, in tiles of blocks of either. Nothing is
capped: after (3) no two classes of different components share a band and reach the threshold. Only numbers and shingle sets of
candidates are shuffled, never texts: those are read again by their rows' places.

Defined cases: null, empty and word-less texts have no shingles and no links; a text with fewer words than `words` is one
shingle; equal sets are one class; different texts with one id are linked through it; a component's id is its smallest, null if
none of its rows has one; of such a component one row is kept; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, places

UNIVERSE = 1 << 20
COORDINATES = 192


def band_rows(percent: int, coordinates: int = COORDINATES, miss: float = 1e-6) -> int:
    """The most rows a band can have so that a pair at the threshold shares no band with a chance below `miss`."""
    good = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (coordinates // r) <= miss]
    return max(good, default=1)


class Circulant:
    """The two permutations of the universe, and signatures by windows of the second."""

    _made: dict[tuple[int, int], Circulant] = {}

    def __init__(self, coordinates: int, seed: int):
        rng = np.random.default_rng(seed)
        self.first = rng.permutation(UNIVERSE).astype(np.int32)
        second = rng.permutation(UNIVERSE).astype(np.uint32)
        ring = np.concatenate([second, second[:coordinates]])
        self.windows = np.lib.stride_tricks.sliding_window_view(ring, coordinates)

    @classmethod
    def of(cls, coordinates: int = COORDINATES, seed: int = 11) -> Circulant:
        if (coordinates, seed) not in cls._made:
            cls._made[coordinates, seed] = cls(coordinates, seed)
        return cls._made[coordinates, seed]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.first[(shingles >> np.uint64(44)).astype(np.int64)]
        best = np.full(self.windows.shape[1], UNIVERSE, np.uint32)
        for i in range(0, len(places), 2048):
            np.minimum(best, self.windows[places[i : i + 2048]].min(axis=0), out=best)
        return best


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    n = len(signature) // rows
    parts = signature[: n * rows].reshape(n, rows).astype(np.uint64)
    out = np.arange(1, n + 1, dtype=np.uint64)
    for j in range(rows):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return out.view(np.int64)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = common.Words(texts)
    for lo, hi in zip(found.first[:-1], found.first[1:], strict=True):
        yield np.unique(common.ngrams(found.hashes[lo:hi], words))


def sketches(docs: DataFrame, words: int, rows: int, coordinates: int = COORDINATES) -> DataFrame:
    """rid, id, tie, n_shingles, print (of the whole set, null if empty), bands of every numbered row of (id, text, tie)."""
    longs = [(n, pa.int64()) for n in ("rid", "id", "tie", "n_shingles")]
    schema = pa.schema([*longs, ("print", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        ring = Circulant.of(coordinates)
        for b in common.batches(it, "text", common.STAGE_BYTES):
            sizes, prints, keys = [], [], []
            for s in shingle_sets(common.utf8(b.column("text")), words):
                sizes.append(len(s))
                prints.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(bands(ring.signature(s), rows) if len(s) else None)
            yield common.output(schema, rid=b.column(places.RID), id=b.column("id"), tie=b.column("tie"), n_shingles=sizes, print=prints, bands=keys)

    return docs.mapInArrow(sketch, "rid long, id long, tie long, n_shingles long, print binary, bands array<long>")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """node (the row number) and the sorted distinct shingle hashes, packed, of every numbered row of (text)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, "text", common.STAGE_BYTES):
            yield common.output(schema, node=b.column(places.RID), shingles=[s.tobytes() for s in shingle_sets(common.utf8(b.column("text")), words)])

    return docs.mapInArrow(gather, "node long, shingles binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(few) < percent * len(many) or not len(few):
        return False
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    both = int((many[at] == few).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, full: DataFrame, percent: int, share: int = 256) -> DataFrame:
    """The pairs (a: member, b: pivot) whose full sets reach the threshold.

    A pivot of very many members is dealt over as many tasks as it has shares of them; there are at most 2,000 such pivots.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            left, right = (x.column(c).to_pylist() for c in ("left", "right"))
            good = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(left, right, strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_())).cast(schema)

    pairs = common.materialise(pairs, "pairs")
    pivots = common.materialise(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "pivots")
    least = max(share, -(-pairs.count() // 2000))
    salts = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast(pivots.where(F.col("n") > least).select("b", salts.alias("salts")))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a", F.lit(41)), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    sizes = pivots.select(F.col("b").alias("node"), F.when(F.col("n") > least, salts).otherwise(F.lit(1)).alias("salts"))
    targets = full.join(sizes, "node").select(F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("shingles").alias("right"))
    one = dealt.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    return one.join(targets, ["b", "salt"]).select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node of the undirected edges (a, b), by large and small stars."""
    links = common.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each larger neighbour is linked to the smallest of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = common.materialise(small.where("u <> v").distinct(), "links")
        # done when every link goes from a node that has no other to a root that links nowhere
        many = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        chained = after.select(F.col("v").alias("u")).distinct().join(after.select("u").distinct(), "u", "left_semi").limit(1)
        common.discard(links)
        links = after
        if not many.unionByName(chained.withColumn("n", F.lit(0).cast("long"))).take(1):
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _near(size: Column, other: Column, percent: int) -> Column:
    return F.least(size, other) * 100 >= F.greatest(size, other) * percent


def _strays(rows: DataFrame, percent: int) -> DataFrame:
    """Links between a tile's strays and its others of other components; rows: key, tile, node, comp, stray, shingles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
        strays = [g for g in group if g[4]]
        others = [g for g in group if not g[4]]
        arrays = [np.frombuffer(g[5], np.uint64) for g in others]
        place = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
        values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, place = values[order], place[order]
        sizes = np.array([len(a) for a in arrays])
        comps = np.array([g[3] for g in others])
        for s in strays:
            mine = np.frombuffer(s[5], np.uint64)
            lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            span = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(int(span.sum()))
            both = np.bincount(place[at], minlength=len(arrays))
            good = np.flatnonzero((comps != s[3]) & (100 * both >= percent * (sizes + len(mine) - both)))
            seen = set()
            for i in good:
                if comps[i] not in seen:
                    seen.add(comps[i])
                    yield s[2], others[i][2]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple[int, int]] = []
        for b in it:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if group and (row[0], row[1]) != group[0][:2]:
                    found += links(group)
                    group = []
                group.append(row)
            if found:
                yield common.output(schema, a=[x for x, _ in found], b=[y for _, y in found])
                found = []
        if group:
            found += links(group)
        if found:
            yield common.output(schema, a=[x for x, _ in found], b=[y for _, y in found])

    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile").select("key", "tile", "node", "comp", "stray", "shingles").mapInArrow(run, "a long, b long")


def _linked(docs: places.Numbered, words: int, percent: int, handful: int, block: int, block_shingles: int) -> DataFrame:
    """rid, id, n_shingles, component (its smallest id), keeper (the one row of each component that stays) of numbered rows (id, text, tie)."""
    rows = band_rows(percent)
    sketched = common.materialise(sketches(docs.rows, words, rows), "sketches")
    has_set = sketched.where("print is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", "rid")).alias("first")
    classes = common.materialise(has_set.groupBy("print").agg(F.min("rid").alias("node"), first, F.count(F.lit(1)).alias("n")), "classes")
    nodes = has_set.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), "n_shingles", "bands")
    spread = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.materialise(spread.join(buckets, "key").select("key", "n", "node", F.col("n_shingles").alias("size")), "members")
    weights = common.materialise(members.groupBy("node").agg(F.sum(F.log2("n")).alias("weight")), "candidates")
    full = common.materialise(sets(docs.within(weights.select(F.col("node").alias(places.RID))), words), "sets")

    def stars(group: DataFrame, by: list[str], rank: Column) -> DataFrame:
        """Each member with its group's pivot, whose rank is the greatest."""
        ranked = group.withColumn("rank", F.struct(rank.alias("r"), F.col("node"), F.col("size")))
        pivots = ranked.groupBy(*by).agg(F.max("rank").alias("p"))
        pairs = group.join(pivots, by).where(F.col("node") != F.col("p.node")).where(_near(F.col("size"), F.col("p.size"), percent))
        return pairs.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()

    def merged(more: DataFrame, comps: DataFrame) -> DataFrame:
        """The components with more links; known ones count as a star each."""
        return common.materialise(components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))), "comps")

    # different texts with one id are linked through it
    ids = has_set.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("p"), F.max("print").alias("q")).where("p <> q")
    ids = common.materialise(ids.join(classes.select(F.col("print").alias("p"), F.col("node").alias("b")), "p").select("id", "n", "b"), "ids")
    again = common.join_hot(has_set.where("id is not null").select("id", "print"), ids, "id", "n", docs.total).select("print", "b").distinct()
    same_id = again.join(classes.select("print", F.col("node").alias("a")), "print").select("a", "b")

    edges = confirm(stars(members.join(weights, "node"), ["key"], F.col("weight")), full, percent)
    comps = common.materialise(components(edges.unionByName(same_id)), "comps")

    def open_buckets() -> DataFrame:
        """Members of buckets of three or more with more than one component; stray: not of the bucket's largest one."""
        placed = members.where("n > 2").join(comps, "node", "left").select("key", "n", "node", "size", F.coalesce("comp", "node").alias("comp"))
        each = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
        some = each.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("s").alias("all"), F.max(F.struct("c", "comp", "s")).alias("main")).where("k > 1")
        return placed.join(some, "key").select("key", "n", "node", "size", "comp", (F.col("comp") != F.col("main.comp")).alias("stray"), "all", "main")

    open_ = open_buckets().withColumn("part", F.pmod(F.xxhash64("node", F.lit(23)), F.ceil(F.col("n") / handful)))
    comps = merged(confirm(stars(open_, ["key", "part"], F.xxhash64("node", F.lit(29))), full, percent), comps)

    # tiles: blocks of a bucket's strays by blocks of all its members, each of a bounded number of classes and, on average, shingles
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / block_shingles)).cast("int")
    open_ = open_buckets().withColumns({"across": blocks(F.col("n"), F.col("all")), "down": blocks(F.col("n") - F.col("main.c"), F.col("all") - F.col("main.s"))})
    open_ = common.materialise(open_.drop("all", "main"), "open")
    column, row = F.pmod(F.xxhash64("node", F.lit(31)), F.col("across")), F.pmod(F.xxhash64("node", F.lit(37)), F.col("down"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = open_.select("key", every("down").alias("r"), column.alias("c"), "across", "node", "comp", F.lit(False).alias("stray"))
    strays = open_.where("stray").select("key", row.alias("r"), every("across").alias("c"), "across", "node", "comp", F.lit(True).alias("stray"))
    tiles = others.unionByName(strays).select("key", (F.col("r").cast("long") * F.col("across") + F.col("c")).alias("tile"), "node", "comp", "stray")
    comps = merged(_strays(tiles.join(full, "node"), percent), comps)

    # per component, then per class, its smallest id and the row that stays; rows alone in their class and component need no join
    linked = classes.join(comps, "node").select("print", "comp", "first", "n")
    named = common.materialise(linked.groupBy("comp").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("k")), "named")
    linked = common.join_hot(linked.select("print", "comp", "n"), named, "comp", "k", docs.total).select("print", "first", "n")
    whole = classes.where("n > 1").select("print", "first", "n").join(comps.join(classes, "node").select("print"), "print", "left_anti")
    special = common.materialise(linked.unionByName(whole), "special")
    out = common.join_hot(has_set.select("rid", "id", "n_shingles", "print"), special, "print", "n", docs.total, "left")
    out = out.select("rid", "id", "n_shingles", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component"), F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("keeper"))
    return out.unionByName(sketched.where("print is null").select("rid", "id", "n_shingles", F.col("id").alias("component"), F.lit(True).alias("keeper")))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"), places.tie(df).alias("tie"))


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, handful: int = 16, block: int = 1000, block_shingles: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id; of rows without any id, one of each component)."""
    common.session(df)
    out = _linked(places.Numbered(_texts(df, id_col, text_col), "texts"), words, percent, handful, block, block_shingles)
    kept = F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull() & F.col("keeper"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, handful: int = 16, block: int = 1000, block_shingles: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each component left (the smallest id's; of its rows the one whose other columns hash lowest).

    Documents without shingles all stay. All columns are kept; rows are dropped where they are read.
    """
    common.session(df)
    docs = places.Numbered(df, "documents")
    out = _linked(places.Numbered(_texts(docs.scan, id_col, text_col)), words, percent, handful, block, block_shingles)
    return docs.within(out.where("not keeper").select(F.col("rid").alias(places.RID)), keep=False).drop(places.RID)
