"""Shared helpers of the training-data operators: scratch tables, Arrow batches, vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text that are hashed at once (some 40 bytes of memory each).
WINDOW = 4 << 20
#: Rows of one Arrow batch sent to Python; texts can be long, so batches stay small.
BATCH_ROWS = 1000
#: Bytes of texts that a stage of the pipeline works on at once: some hundred bytes of memory each, in every Python worker.
STAGE_BYTES = 1 << 18


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with small Arrow batches."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local session that names none gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = got.get() if got.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, name: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
    """Write the frame as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._weft_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more, and let Spark drop the shuffle files of ended jobs."""
    for t in tables:
        spark, path = t.sparkSession, t._weft_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        release(tables[0].sparkSession)


def discard_part(table: DataFrame, folder: str) -> None:
    """Delete one partition folder of a materialise(by=...) table."""
    spark = table.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table._weft_path}/{folder}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files that no live frame refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so that extra columns can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def compact(spark: SparkSession) -> None:
    """Let every executor's JVM collect its garbage and hand the emptied heap back to the system.

    A JVM keeps a heap that has grown once, so stages that follow each other would each start beside the heap of the largest so far.
    A task for each slot: free slots are dealt over the executors in turn, so each executor gets one at least.
    """
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def join_hot(rows: DataFrame, classes: DataFrame, key: str, n: str, total: int, how: str = "inner", most: int = 2000) -> DataFrame:
    """Rows joined with the one row that classes has of their key; n is the number of rows with that key.

    Keys with at least total/most rows, of which there can't be more than `most`, are broadcast, so a key that holds a third of all
    rows never lands in one task; the others are shuffled. how: "left" keeps rows whose key (never null) has no class.
    """
    least = max(1000, -(-total // most))
    hot, cold = classes.where(F.col(n) >= least), classes.where(F.col(n) < least)
    often = rows.join(F.broadcast(hot), key)
    return often.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))


def crc_mod(column: str, n: int):
    """crc32 of the column's value as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as binary with 64-bit offsets; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")


def give_back() -> None:
    """Hand memory that this process has freed back to the system: Python workers outlive their tasks and what they held once counts on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def batches(it: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20, most_rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most so many bytes of the column, one row at least; after the last, freed memory is given back."""
    for b in it:
        off = np.frombuffer(utf8(b.column(column)).buffers()[1], np.int64)[: b.num_rows + 1] if b.num_rows else np.zeros(1, np.int64)
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(off, off[i] + most_bytes, "right")) - 1
            j = min(max(j, i + 1), i + most_rows, b.num_rows)
            yield b.slice(i, j - i)
            i = j
    give_back()


# ---- vectorised words -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, kept up to 8M of them."""
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 20)
        made = []
        for base in (_R, _RINV):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if m > 8 << 20:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts, A-Z lower-cased, as 64-bit hashes.

    hashes: of all words in order; first: where each text's words begin (one entry more than texts);
    starts, ends: byte places in data.
    """

    __slots__ = ("data", "ends", "first", "hashes", "offsets", "starts")

    def __init__(self, texts: pa.Array, lower: bool = True):
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        values = texts.buffers()[2] if n else None
        data = np.frombuffer(values, np.uint8)[lo:hi] if values is not None and hi > lo else np.zeros(0, np.uint8)
        offsets = offsets - lo
        ink = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = ink.copy()
        begins[1:] &= ~ink[:-1] | edge[1:-1]
        stops = ink.copy()
        stops[:-1] &= ~ink[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        table, parts, i = _LOWER_BYTE if lower else _BYTE, [np.zeros(0, np.uint64)], 0
        while i < len(self.starts):  # a very long text is hashed in windows of whole words
            lo = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, lo + WINDOW, "right")))
            s, e, part = self.starts[i:j] - lo, self.ends[i:j] - lo, data[lo : int(self.ends[j - 1])]
            up, down = _powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * up[: len(part)], out=sums[1:])
            parts.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
            i = j
        self.hashes = np.concatenate(parts)
        self.first = np.searchsorted(self.starts, offsets)
        self.data, self.offsets = data, offsets

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n neighbours of one text's word hashes; of the whole run if it is shorter."""
    if not len(h):
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m])
    return out


def output(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
