"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A frame is the payload's length (8 bytes, little endian), the masked CRC-32 of these 8 bytes, the payload and the
masked CRC-32 of the payload. The payload is a flag byte (1: the doc_id is null; 2: ids take four bytes, else two), the
doc_id (8 bytes) and the ids. A mask rotates the checksum by 15 bits and adds 0xA282EAD8, so that files which
hold checksums don't checksum to themselves. In the file a frame's bytes 0x0A and 0x0B are escaped (0x0B 0x01 and
0x0B 0x02) and a line feed ends it, so a line feed is never part of a frame: Spark's text source writes frames through
its commit protocol, to any file system, and reads any part of a file as a stream. A task that is run
again replaces its file. The index has the place of each frame, to read it alone (`read_at`).

Files are in ascending doc_id order (nulls first; repeated doc_ids each have their record). Null or
empty text has the end id alone. An empty table gives no record. Other columns are ignored. There are as many
files as keep their texts at FILE_BYTES on average.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatspark.llm.stage import shared_dir, shuffle_cleanup, small_batches, written
from chatspark.llm.tokens import ChunkEncoder

END_ID = 2
#: Text of a file on average; its ids take about three quarters of that.
FILE_BYTES = 64 << 20
#: Rows of a table of file parts (48 MB) up to which it is broadcast.
MAX_BROADCAST_PARTS = 1_000_000
_HEAD, _ID = struct.Struct("<QI"), struct.Struct("<Bq")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its line feed."""
    payload = _ID.pack((doc_id is None) | 2 * (ids.dtype.itemsize == 4), doc_id or 0) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def stuffed(data: bytes) -> bytes:
    return data.replace(b"\x0b", b"\x0b\x02").replace(b"\n", b"\x0b\x01")


def payload_of(line: bytes) -> memoryview:
    """The checked payload of a line."""
    data = memoryview(line.replace(b"\x0b\x01", b"\n").replace(b"\x0b\x02", b"\x0b"))
    if len(data) < _HEAD.size or masked_crc(data[:8]) != _HEAD.unpack_from(data)[1]:
        raise ValueError("damaged length")
    length = _HEAD.unpack_from(data)[0]
    payload = data[12 : 12 + length]
    if len(data) != length + 16 or struct.pack("<I", masked_crc(payload)) != data[12 + length :]:
        raise ValueError("damaged record")
    return payload


def read_at(file, offset: int, size: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the record at a place of the index, from an open binary file."""
    file.seek(offset)
    return parse(payload_of(file.read(size)[:-1]))


def parse(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _ID.unpack_from(payload)
    return (None if flags & 1 else doc_id), np.frombuffer(payload[9:], "<u4" if flags & 2 else "<u2")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode the texts of `docs` and write record files in ascending doc_id order to `path`/data."""

    def run(batches):
        encoder = ChunkEncoder.load(tokenizer)
        end = np.array([end_id], encoder.dtype)
        for batch in batches:
            out, size = [], 0
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                out.append(stuffed(frame(doc_id, np.concatenate([ids, end]))))
                size += len(out[-1])
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    small_batches(spark)
    with shuffle_cleanup(spark):
        ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write.option("compression", "none").text(f"{path}/data")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(f"{path}/data")
    return lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _parsed(spark: SparkSession, path: str, schema: str, kinds: tuple, row) -> DataFrame:
    """file, block, at, size, before and row(doc_id, ids) of each record: its place among the lines of its part of the file, and the ids before it there."""
    lines = _lines(spark, path)
    names = ["file", "block", "at", "size", "before", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches):
        part, at, before = None, 0, 0
        for batch in batches:
            rows = []
            for file, block, line in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["line"]):
                if (file, block) != part:
                    part, at, before = (file, block), 0, 0
                line = line.as_buffer().to_pybytes()
                doc_id, ids = parse(payload_of(line))
                rows.append((file, block, at, len(line) + 1, before, *row(doc_id, ids)))
                at, before = at + len(line) + 1, before + len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4, *kinds))], names=names)

    return lines.mapInArrow(run, f"file string, block long, at long, size long, before long, {schema}")


def _bases(sums: DataFrame) -> DataFrame:
    """`sums` (file, block, bytes) with `base`, the bytes of the file's earlier parts."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("base", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)))


def _placed(parsed: DataFrame, bases: DataFrame) -> DataFrame:
    """`parsed` with the offset in the file: what the file's earlier parts hold, and the place in its own."""
    if bases.count() <= MAX_BROADCAST_PARTS:
        bases = F.broadcast(bases)
    return parsed.join(bases, ["file", "block"]).withColumn("offset", F.col("base") + F.col("at"))


def write_index(spark: SparkSession, path: str) -> None:
    """Read all records of `path` back, check them, and write the offset index to `path`/index."""
    small_batches(spark)
    found = _parsed(spark, path, "doc_id long, n_tokens long, ids_crc32 long", (pa.int64(),) * 3, lambda doc_id, ids: (doc_id, len(ids), ids_crc32(ids)))
    with shuffle_cleanup(spark):
        found.write.option("compression", "zstd").parquet(f"{path}/index")


_INDEX = "file string, block long, at long, size long, before long, doc_id long, n_tokens long, ids_crc32 long"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens, ids_crc32, file, offset, size of each record.

    Files follow each other by their first doc_id (nulls first), whatever their names; equal doc_ids are in one file.
    """
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    parts = index.groupBy("file", "block").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("total"), F.bool_and(F.col("doc_id").isNotNull()).alias("named"), F.min("doc_id").alias("first"))
    parts = written(parts, "parts")  # a row for each part of a file: the windows below are over these
    whole, order = Window.partitionBy("file"), Window.orderBy("named", "first", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = _bases(parts).withColumn("named", F.min("named").over(whole)).withColumn("first", F.min("first").over(whole))
    parts = written(parts.select("file", "block", "base", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("ids")), "bases")
    return _placed(index, parts).select("doc_id", (F.col("ids") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "size")


def read_records(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """doc_id and ids of the records at `places` (file, offset), in any order: each file is read once, as a stream."""
    found = _parsed(spark, path, "doc_id long, ids array<long>", (pa.int64(), pa.list_(pa.int64())), lambda doc_id, ids: (doc_id, ids.tolist()))
    sums = _lines(spark, path).groupBy("file", "block").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    return _placed(found, written(_bases(sums), "bases")).join(places.select("file", "offset").distinct(), ["file", "offset"]).select("doc_id", "ids")


def binary_output(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write `docs` as records with their index, and return the index as read back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/records"
    write_records(docs, tokenizer, path)
    write_index(spark, path)
    return read_index(spark, path)
