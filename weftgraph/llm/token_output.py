"""Token-ID output (operator 9): Parquet list columns with dictionary encoding, controlled row groups and page indexes.

Files are written in ascending id order: one range exchange of the texts, then each task encodes its range and Spark's
Parquet writer stores (part, doc_id, start_in_part, n_tokens, ids). Ids are dictionary-coded (their bit width is that of the
distinct ids in the row group), row groups and pages have set sizes, and the writer's column and offset indexes let a reader
take the metadata alone or a range of documents. Global starts come from the files' own per-part totals: one row a file.

Defined cases: null or empty text is the end id alone; null ids come first; repeated ids are ordered by the text's checksum;
no rows give an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .tokens import Encoder

FILES = T.StructType([T.StructField("part", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10, page_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append the end id and write the files; gives the path back."""
    common.session(df)
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part, start = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for b in common.batches(it, "text", 4 << 20):
            coded = [ids + end for ids in encoder.encode_all(common.utf8(b.column("text")).to_pylist())]
            n = np.array([len(c) // 4 for c in coded], np.int64)
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield common.output(schema, part=np.full(len(n), part), doc_id=b.column("doc_id"), start_in_part=start + ends - n, n_tokens=n, ids=ids)
            start += int(ends[-1])

    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    # ranges by id alone: their bounds are then sampled without reading a text
    coded = docs.repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(encode, FILES)
    writer = coded.write.option("compression", "zstd").option("parquet.enable.dictionary", "true").option("parquet.block.size", str(row_group_bytes))
    writer.option("parquet.page.size", str(page_bytes)).option("parquet.page.row.count.limit", str(page_rows)).option("parquet.dictionary.page.size", str(2 << 20)).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with the global start of each document; pruned to what is selected (ids are read only if asked for)."""
    files = spark.read.schema(FILES).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # bases has one row a written file
    return files.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids as little-endian unsigned 32-bit, from read_tokens()."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column("ids")
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) * 4
            crc = [zlib.crc32(raw[at[i] : at[i + 1]]) for i in range(b.num_rows)]
            yield common.output(schema, doc_id=b.column("doc_id"), start=b.column("start"), n_tokens=b.column("n_tokens"), ids_crc32=crc)

    common.session(tokens)
    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch_path(spark: SparkSession) -> str:
    return f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
