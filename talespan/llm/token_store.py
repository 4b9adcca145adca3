"""Token ids on disk: bit-plane shuffled blocks with a chunk index.

Documents are range-partitioned by doc_id and encoded whole. A chunk holds whole documents, about
`chunk_ids` ids. Its ids are cut into blocks of `block_ids`; each block is transposed into byte or
bit planes and every plane is compressed with zstandard. The chunk index has, for each chunk, its
shard, its number, the documents' ids and lengths, and each block's place in the payload, so any
document can be read alone. Chunks are written by Spark's Parquet writer, whose commit protocol
outlives lost executors; the payload is this format's own.

Defined results: a null text is encoded like an empty one and has the end id alone. Rows with equal
doc_id are stored next to each other, ordered by their text's checksum; a null doc_id comes first.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from talespan.llm import planes
from talespan.llm.tokens import encoder
from talespan.llm.words import chunks
from talespan.runtime import ensure_checkpoint_dir, ship

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 18
END_ID = 2

_CHUNK = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("block_at", pa.list_(pa.int64())), ("payload", pa.binary())])
_CHUNK_TYPE = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("block_at", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])


def _chunk(shard: int, number: int, docs: list[int | None], ids: list[bytes], block_ids: int, bits: bool) -> pa.RecordBatch:
    stream = np.frombuffer(b"".join(ids), dtype="<u4")
    blocks = [planes.pack(stream[at : at + block_ids], bits) for at in range(0, len(stream), block_ids)]
    at = np.cumsum([0, *map(len, blocks[:-1])]).tolist()
    row = [[shard], [number], [len(stream)], [docs], [[len(i) // 4 for i in ids]], [at], [b"".join(blocks)]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, bits: bool = False) -> None:
    """Write the documents' ids; shards follow each other in ascending doc_id order."""
    spark = documents.sparkSession
    ship(spark)
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_, shard = encoder(tokenizer), TaskContext.get().partitionId()
        docs, ids, size, number = [], [], 0, 0
        for batch in batches:
            for rows, _ in chunks(batch):
                for doc, own in zip(rows.column(0).to_pylist(), encode_.encode(rows.column(1).to_pylist()), strict=True):
                    docs.append(doc)
                    ids.append(own + end)
                    size += len(ids[-1]) // 4
                    if size >= chunk_ids:
                        yield _chunk(shard, number, docs, ids, block_ids, bits)
                        docs, ids, size, number = [], [], 0, number + 1
        if docs:
            yield _chunk(shard, number, docs, ids, block_ids, bits)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows of one doc_id, or of none, are ordered and dealt by their text
    order = ["doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(encode, _CHUNK_TYPE).write.option("compression", "uncompressed").parquet(path)


def decode(payload: bytes, bits: bool = False) -> np.ndarray:
    out, at = [np.empty(0, np.uint32)], 0
    while at < len(payload):
        block, at = planes.unpack(payload, np.uint32, bits, at)
        out.append(block)
    return np.concatenate(out)


def read(spark: SparkSession, path: str, bits: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    ship(spark)
    stored = spark.read.parquet(path)
    # Two levels keep the running sum small: one row a shard, then the chunks of each shard.
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("all"))
    base = shards.select("shard", (F.sum("all").over(W.orderBy("shard")) - F.col("all")).alias("shard_start"))
    index = stored.select("shard", "chunk", "n_ids").withColumn("in_shard", F.sum("n_ids").over(W.partitionBy("shard").orderBy("chunk")) - F.col("n_ids"))
    starts = index.join(base, "shard").select("shard", "chunk", (F.col("shard_start") + F.col("in_shard")).alias("chunk_start"))

    def checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, docs, lengths = decode(row["payload"], bits).astype("<u4"), 0, row["doc_ids"], row["lengths"]
                crc, start = [], []
                for n in lengths:
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    start.append(at)
                    at += n
                same = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * same, pa.int32()), pa.array([row["chunk"]] * same, pa.int32()), pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["shard", "chunk", "doc_id", "at", "n_tokens", "ids_crc32"])

    schema = T.StructType().add("shard", "integer").add("chunk", "integer").add("doc_id", "long").add("at", "long").add("n_tokens", "long").add("ids_crc32", "long")
    rows = stored.select("shard", "chunk", "doc_ids", "lengths", "payload").mapInArrow(checks, schema)
    return rows.join(starts, ["shard", "chunk"]).select("doc_id", (F.col("chunk_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, tokenizer: str, **options: int) -> DataFrame:
    """Write into the shared folder and read back."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/token-store-{uuid.uuid4().hex}"
    write(documents, path, tokenizer, **options)
    return read(spark, path, bits=bool(options.get("bits", False)))
