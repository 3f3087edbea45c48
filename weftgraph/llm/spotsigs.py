"""Document fingerprints (operator 1): SpotSigs.

A signature is an anchor (a common word) with the chain of the next `chain` content words, `distance` content words apart;
common words are skipped in chains. A document is the set of its signatures; likeness is the Jaccard similarity of sets.
The printed fingerprint is the set's size and a hash of its sorted members, so equal sets and only equal sets print alike.

Similarity joins partition documents by set length: with threshold t two sets can only be alike if their lengths differ by
less than a factor t, so length ranges of that factor meet only themselves and the next; within a pair of ranges candidates
share a signature of their prefixes (the rarest signatures, as many as the threshold demands), and Jaccard is computed with
a stop as soon as the rest can't reach the threshold.

Defined cases: null text counts as empty; a text without any anchor followed by content words is the set of its runs of
content words (or of all words); an empty text has the empty set, like itself (1) and unlike all others (0); ties and
repeated rows are neighbours in the order of (id, text hash); the last document's next is the first, a single one's is
itself; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that for it was with as on be at by this are from or an not they have had but which you were there can all has been "
    "der die das und zu den mit von ist nicht ein eine auf für im dem des sich auch als es an werden aus er hat dass sie nach bei um noch wie "
    "le la les un une et est du de que qui en dans pour pas par sur plus avec ce il au se ne sont aux ou son "
    "el los las una y por con para no lo su como más del pero sus al entre ya sin sobre este ser"
).split()

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 128) if not chr(c).isalnum()]] = True


def _hashes(words: list[str]) -> np.ndarray:
    return common.Words(common.utf8(pa.array([" ".join(words)]))).hashes


class Spots:
    """Makes signature sets; anchors are matched without punctuation around them."""

    def __init__(self, distance: int = 1, chain: int = 2, anchors: tuple[str, ...] = tuple(ANCHORS)):
        self.distance, self.chain = distance, chain
        self.anchors = np.unique(_hashes(sorted({*anchors})))

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        words = common.Words(texts)
        bare = self._bare(words)
        at = np.searchsorted(self.anchors, bare)
        at[at == len(self.anchors)] = 0
        common_word = self.anchors[at] == bare
        for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
            yield self._set(bare[lo:hi], common_word[lo:hi])

    @staticmethod
    def _bare(words: common.Words) -> np.ndarray:
        """Hashes of the words without a last mark, so that `the,` is an anchor too."""
        if not len(words.starts):
            return words.hashes
        last = words.data[words.ends - 1]
        marked = _PUNCTUATION[last] & (words.ends - words.starts > 1)
        if not marked.any():
            return words.hashes
        # the marks are blanked and the words hashed again; a run of marks keeps all but its last
        data = words.data.copy()
        data[words.ends[marked] - 1] = 32
        offsets = pa.py_buffer(words.offsets.astype(np.int64).tobytes())
        again = common.Words(pa.Array.from_buffers(pa.large_binary(), len(words.offsets) - 1, [None, offsets, pa.py_buffer(data.tobytes())]))
        return again.hashes

    def _set(self, h: np.ndarray, common_word: np.ndarray) -> np.ndarray:
        content = h[~common_word]
        reach = self.distance * (self.chain - 1) + 1
        if len(content) >= reach and common_word.any():
            at = np.flatnonzero(common_word)
            after = np.cumsum(~common_word)[at]  # content words up to each anchor: the index of the next one
            good = after + reach <= len(content)
            out, after = h[at[good]], after[good]
            for i in range(self.chain):
                out = common.mix(out * np.uint64(0xD6E8FEB86659FD93) + content[after + i * self.distance])
            if len(out):
                return np.unique(out)
        return np.unique(common.ngrams(content if len(content) else h, self.chain))


def show(signatures: np.ndarray) -> str:
    return f"{len(signatures)}-{hashlib.blake2b(signatures.tobytes(), digest_size=16).hexdigest()}"


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones. Where it can't reach `least`, 0 as soon as that is certain."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few):
        return float(len(many) == 0)
    need = least / (1 + least) * (len(a) + len(b)) - 1e-9
    both = 0
    for i in range(0, len(few), 4096):
        if both + len(few) - i < need:  # the sizes alone at first, then what is left of the smaller set
            return 0.0
        part = few[i : i + 4096]
        at = np.searchsorted(many, part)
        at[at == len(many)] = 0
        both += int((many[at] == part).sum())
    return both / (len(a) + len(b) - both)


def signatures(df: DataFrame, distance: int = 1, chain: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_signatures, fingerprint, signatures (sorted 64-bit hashes) of every row."""
    common.session(df)
    schema = pa.schema([("doc_id", pa.int64()), ("n_signatures", pa.int64()), ("fingerprint", pa.string()), ("signatures", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots(distance, chain)
        for b in common.batches(it, "text"):
            found = list(spots.sets(common.utf8(b.column("text"))))
            yield common.output(schema, doc_id=b.column("doc_id"), n_signatures=[len(s) for s in found], fingerprint=[show(s) for s in found], signatures=[s.view(np.int64) for s in found])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_signatures long, fingerprint string, signatures array<long>")


def similar(signed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity) of distinct fingerprints of signatures() that reach the threshold, a < b by fingerprint.

    Equal sets share one fingerprint, so copies aren't expanded: signed itself maps documents to fingerprints.
    """
    one = signed.where("n_signatures > 0").groupBy("fingerprint").agg(F.min("n_signatures").alias("n"), F.min_by("signatures", "doc_id").alias("s"))
    one = common.materialise(one, "classes")
    step = -math.log(threshold) if threshold < 1 else 1.0
    # a set of n needs n - ceil(t*n) + 1 of its rarest signatures as a prefix
    flat = one.select("fingerprint", "n", F.explode("s").alias("sig"))
    often = flat.groupBy("sig").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = flat.join(often, "sig", "left").groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), F.col("sig")))).alias("r"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    prefix = ranked.withColumn("r", F.slice("r", F.lit(1), keep)).select("fingerprint", "n", F.explode("r").alias("r")).where("r.f > 1")
    length = F.floor(F.log(F.col("n")) / step).cast("long")
    left = prefix.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), F.col("r.sig").alias("sig"), length.alias("part"))
    right = prefix.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), F.col("r.sig").alias("sig"), F.explode(F.array(length, length - 1, length + 1)).alias("part"))
    pairs = left.join(right, ["part", "sig"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)).select("a", "b").distinct()
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("similarity", pa.float64())])

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            got = [likeness(np.array(p, np.int64).view(np.uint64), np.array(q, np.int64).view(np.uint64), threshold) for p, q in zip(x.column("p").to_pylist(), x.column("q").to_pylist(), strict=True)]
            yield common.output(schema, a=x.column("a"), b=x.column("b"), similarity=got)

    p, q = one.select(F.col("fingerprint").alias("a"), F.col("s").alias("p")), one.select(F.col("fingerprint").alias("b"), F.col("s").alias("q"))
    return pairs.join(p, "a").join(q, "b").select("a", "b", "p", "q").mapInArrow(check, "a string, b string, similarity double").where(F.col("similarity") >= threshold - 1e-12)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


def against_next(df: DataFrame, rows_per_part: int = 4000, most_parts: int = 4096, distance: int = 1, chain: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document, descending by id.

    Edited: the last floor(n/3) code points give way to the first as many (or all) of the next text. Documents are dealt into
    ranges of (id, text hash); a range's first row is sent to the range before too, so neighbours meet without one ordered task.
    """
    spark = common.session(df)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    parts = max(1, min(-(-docs.count() // rows_per_part), most_parts))
    # any bounds are right; approximate quantiles make the ranges even
    probes = [i / parts for i in range(1, parts)]
    bounds = sorted({*(docs.select(F.percentile_approx("doc_id", probes, 10 * parts + 100)).first()[0] or [])}) if probes else []
    part = _range_of(bounds, max(1, math.isqrt(len(bounds)))) if bounds else F.lit(0)
    placed = docs.withColumn("part", part.cast("int"))
    tops = placed.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "tie")).alias("top")).orderBy("part").collect()
    seats = [r["part"] for r in tops]
    # the row after a range's last is the first of the range below; the lowest range's is the first of all
    feeds = {p: seats[i + 1] if i + 1 < len(seats) else seats[0] for i, p in enumerate(seats)}
    table = spark.createDataFrame([(r["part"], r["top"]["k"], r["top"]["tie"], feeds[r["part"]]) for r in tops], "part int, k long, top_tie long, host int")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    joined = placed.join(F.broadcast(table), "part")  # one row a range
    is_top = (key == F.col("k")) & (F.col("tie") == F.col("top_tie"))
    seat = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    sent = joined.select("doc_id", "tie", "text", F.explode(F.when(is_top, F.array(seat, guest)).otherwise(F.array(seat))).alias("to")).select("doc_id", "tie", "text", "to.*")
    dealt = sent.repartition("part").sortWithinPartitions(F.col("part"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots(distance, chain)
        held = None  # (part, id, text) that waits for its next
        for b in common.batches(it, "text"):
            texts = common.utf8(b.column("text"))
            rows = []
            own = list(zip(b.column("part").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), texts.to_pylist(), spots.sets(texts), strict=True))
            for part, guest, doc, raw, signs in own:
                if held and held[0] == part:
                    rows.append((held, (raw, signs)))
                held = None if guest else (part, doc, raw, signs)
            if rows:
                edits = [_edited(x[2], y[0]) for x, y in rows]
                made = list(spots.sets(pa.array([e for _, e in edits], pa.large_binary())))
                out = [(x[1], n, hashlib.sha256(e).hexdigest(), show(x[3]), show(m), likeness(x[3], m), likeness(x[3], y[1]), len(x[3])) for (x, y), (n, e), m in zip(rows, edits, made, strict=True)]
                yield common.output(schema, **{f.name: list(c) for f, c in zip(schema, zip(*out, strict=True), strict=True)})

    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(run, EDITED)


def _range_of(bounds: list[int], width: int):
    """How many bounds lie below doc_id (null: none), by two short searches instead of one long one."""
    heads = bounds[::width]
    lists = F.array(*[F.array(*[F.lit(int(b)) for b in bounds[i : i + width]]) for i in range(0, len(bounds), width)])
    head = F.aggregate(F.array(*[F.lit(int(b)) for b in heads]), F.lit(0), lambda n, b: n + F.coalesce((F.col("doc_id") > b).cast("int"), F.lit(0)))
    within = F.aggregate(F.element_at(lists, F.greatest(head, F.lit(1))), F.lit(0), lambda n, b: n + F.coalesce((F.col("doc_id") > b).cast("int"), F.lit(0)))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * width + within)


def _edited(text: bytes, after: bytes) -> tuple[int, bytes]:
    """Code points of the text, and its UTF-8 with the last third replaced."""
    if text.isascii() and after.isascii():
        cut = len(text) // 3
        return len(text), text[: len(text) - cut] + after[:cut]
    t, a = text.decode(), after.decode()
    cut = len(t) // 3
    return len(t), (t[: len(t) - cut] + a[:cut]).encode()
