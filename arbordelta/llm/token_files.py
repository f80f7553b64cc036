"""Token-ID output: Parquet files with a list column of ids, in ascending doc_id order.

Layout: `ids` is dictionary encoded (a document repeats few ids), the counters are delta encoded (format version 2),
row groups and pages have set sizes, and Parquet's page indexes let a reader skip to a document's pages. `shard` is the
number of the file and `shard_start` counts the ids before the document in its file, so a reader that wants only
offsets never touches `ids`.

Defined cases: null text is empty, so its only id is the end id; null doc_ids come first; repeated doc_ids follow
each other, ordered by their text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, new_path, text_or_empty
from .tokens import encoder_for

FILE_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
#: Sizes in bytes of a row group and of a page.
ROW_GROUP, PAGE = 16 << 20, 256 << 10


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, spaced: bool = False) -> DataFrame:
    """Rows of FILE_SCHEMA, one for each document, globally in ascending doc_id order."""
    tokenizer = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())  # a vocabulary: its size is fixed
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches):
        encoder, shard, start = encoder_for(tokenizer.value, spaced), TaskContext.get().partitionId(), 0
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            rows = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            n = np.fromiter((len(x) // 4 for x in rows), np.int64, len(rows))
            starts = start + np.concatenate([[0], np.cumsum(n)])
            start = int(starts[-1])
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(rows), "<i4"))
            columns = [batch.column("doc_id"), pa.array(np.full(len(rows), shard, np.int32)), pa.array(starts[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), ids)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "shard_start", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return arrow_map(ordered, encode, FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, spaced: bool = False) -> None:
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": ROW_GROUP,
        "parquet.page.size": PAGE,
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#shard_start": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "compression": "zstd",
    }
    encode_documents(docs, tokenizer_path, end_id, spaced).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Selective read: wanted columns only, and a filter on doc_id that Parquet's indexes serve."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    if doc_ids is not None:
        df = df.where(F.col("doc_id").isin(doc_ids))
    return df.select(*columns) if columns else df


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: the ids in all files before. Reads three narrow columns; one row for each file comes out."""
    ends = read_tokens(spark, path, columns=["shard", "shard_start", "n_tokens"]).groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("n"))
    return ends.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files. The broadcast side has a row for each file."""

    def crc(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(flat)).cast("B")
            crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column("doc_id"), batch.column("shard"), batch.column("shard_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    rows = arrow_map(read_tokens(spark, path, columns=["doc_id", "shard", "shard_start", "ids"]), crc, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(read_offsets(spark, path)), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int, spaced: bool = False) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, spaced)
    return token_digest(spark, path)
