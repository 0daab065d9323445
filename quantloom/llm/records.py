"""Token ids in length-delimited binary record files with an offset index.

A record is an 8-byte length, the masked checksum of these 8 bytes, the payload, and its masked
checksum; checksums are CRC-32C, so common record readers take the files. The payload is a
document's id and its token ids. The index is a Parquet table of every record's file,
offset and length: a reader can take any rows of it, in any order, and fetch just these records.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.session import checkpoint_root, materialise

_POLY, _MASK = 0x82F63B78, 0xA282EAD8  # fixed values of CRC-32C and of its masking
_BLOCK = 512  # bytes of a record that are taken in step with all other blocks
_HEAD = "<BBq"  # bytes per id, whether the document has an id, the id
_READ_BYTES = 8 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC step of a byte, and of ``_BLOCK`` zero bytes for each byte of the register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLY), step >> 1).astype(np.uint32)
    register = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_BLOCK):
        register = step[register & 0xFF] ^ (register >> np.uint32(8))
    return step, register.reshape(4, 256)


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of records of at least 4 bytes, all at once.

    The start value is put into the first 4 bytes and zeros are put before the record, which
    a zero register passes unchanged. So all records are whole blocks; blocks of all records are
    stepped through together and then joined in turn.
    """
    step, jump = _tables()
    sizes = np.array([len(r) for r in records], np.int64)
    blocks = -(-sizes // _BLOCK)
    flat = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
    ends = np.cumsum(blocks) * _BLOCK
    joined = np.frombuffer(b"".join(records), np.uint8)
    shift = np.repeat(ends - np.cumsum(sizes), sizes)
    flat[np.arange(len(joined)) + shift] = joined
    for k in range(4):
        flat[ends - sizes + k] ^= 0xFF
    table = np.ascontiguousarray(flat.reshape(-1, _BLOCK).T)
    register = np.zeros(table.shape[1], np.uint32)
    for row in table:
        register = step[(register ^ row) & 0xFF] ^ (register >> np.uint32(8))
    out = np.zeros(len(records), np.uint32)
    first = np.cumsum(blocks) - blocks
    for k in range(int(blocks.max(initial=0))):
        on = np.nonzero(blocks > k)[0]
        r = out[on]
        out[on] = jump[0][r & 0xFF] ^ jump[1][r >> 8 & 0xFF] ^ jump[2][r >> 16 & 0xFF] ^ jump[3][r >> 24] ^ register[first[on] + k]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


def frame(payloads: list[bytes]) -> list[bytes]:
    """Records with their lengths and checksums."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [h + a.tobytes() + p + b.tobytes() for h, a, p, b in zip(heads, sums[0], payloads, sums[1], strict=True)]


def unframe(records: list[bytes]) -> list[bytes]:
    """Payloads of records; a wrong length or checksum raises."""
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    have = np.array([[*struct.unpack("<I", r[8:12]), *struct.unpack("<I", r[-4:])] for r in records], np.uint32).reshape(-1, 2)
    right = (have[:, 0] == masked(crc32c(heads))) & (have[:, 1] == masked(crc32c(payloads)))
    lengths = [struct.unpack("<Q", h)[0] == len(p) for h, p in zip(heads, payloads, strict=True)]
    if not right.all() or not all(lengths):
        raise ValueError("A record does not match its length or checksum")
    return payloads


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified URI; Hadoop's ``s3a`` is Arrow's ``s3``."""
    return fs.FileSystem.from_uri("s3://" + uri[len("s3a://") :] if uri.startswith("s3a://") else uri)


def _qualified(spark: SparkSession, folder: str) -> str:
    """A bare path on Hadoop's default file system, as Spark itself resolves it, never the executor's own disk."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"{default.rstrip('/')}/{folder.lstrip('/')}" if not default.startswith("file:") else f"file://{os.path.abspath(folder)}"


INDEX = "shard int, path string, record bigint, position bigint, size bigint, before bigint, n bigint"


def write_records(
    docs: DataFrame,
    tokenizer: Callable[[], Callable[[list[str]], Iterator[np.ndarray]]],
    end_id: int,
    vocabulary: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Write one record a document in ascending id order and return the stored index.

    Ids are held in 2 bytes if the vocabulary allows, else in 4. Each range partition is a file
    of its own in ``folder`` (by default the shared folder). A task writes to a new name, and
    only files of tasks that ended well are in the index, so lost executors leave at most files
    that nothing refers to. Null ids come first; equal ids go by a hash of their text, and a
    null text is empty; identical rows, however many, spread over range partitions. Bare paths
    are taken on Hadoop's default file system. An empty table makes no file.
    """
    spark = docs.sparkSession
    home = f"{_qualified(spark, folder or checkpoint_root(spark)).rstrip('/')}/records-{uuid.uuid4().hex}"
    width = 2 if vocabulary <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = tokenizer(), TaskContext.get().partitionId()
        path = f"{home}/part-{shard:06d}-{uuid.uuid4().hex}.records"
        out, position, before, record = None, 0, 0, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    system, name = _place(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name)
                payloads, counts = [], []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype(f"<u{width}")
                    payloads.append(struct.pack(_HEAD, width, doc_id is not None, doc_id or 0) + ids.tobytes())
                    counts.append(len(ids))
                framed = frame(payloads)
                out.write(b"".join(framed))
                sizes = np.array([len(f) for f in framed], np.int64)
                counts = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(sizes), pa.int32()),
                        pa.array([path] * len(sizes)),
                        pa.array(np.arange(record, record + len(sizes))),
                        pa.array(position + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array(before + np.cumsum(counts) - counts),
                        pa.array(counts),
                    ],
                    names=[f.split()[0] for f in INDEX.split(", ")],
                )
                record, position, before = record + len(sizes), position + int(sizes.sum()), before + int(counts.sum())
        finally:
            if out is not None:
                out.close()

    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        # Equal rows are interchangeable: a row number splits a repeated row over range partitions.
        .withColumn("copy", F.monotonically_increasing_id())
        .repartitionByRange("id", "tie", "copy")
        .sortWithinPartitions("id", "tie", "copy")
        .select("id", "text")
    )
    return materialise(ordered.mapInArrow(write, INDEX), "record-index")


def read_records(index: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all records before it) and ``ids`` (32-bit words) of index rows.

    ``index`` may be any rows of an index in any order; checksums are verified. ``start``
    needs a column ``start`` in the index, see ``with_starts``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True))
            at = 0
            while at < len(rows):  # rows that lie together are read together
                end, size = at + 1, rows[at][2]
                while end < len(rows) and rows[end][0] == rows[at][0] and rows[end][1] == rows[at][1] + size and size < _READ_BYTES:
                    size += rows[end][2]
                    end += 1
                system, name = _place(rows[at][0])
                with system.open_input_file(name) as source:
                    whole = source.read_at(size, rows[at][1])
                found = []
                for path, position, length, start in rows[at:end]:
                    found.append((start, whole[position - rows[at][1] : position - rows[at][1] + length]))
                payloads = unframe([f[1] for f in found])
                heads = [struct.unpack_from(_HEAD, p) for p in payloads]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h[2] if h[1] else None for h in heads], pa.int64()),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([np.frombuffer(p, f"<u{h[0]}", offset=struct.calcsize(_HEAD)).astype("<u4").tobytes() for p, h in zip(payloads, heads, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "ids"],
                )
                at = end

    return index.select("path", "position", "size", "start").mapInArrow(read, "doc_id bigint, start bigint, ids binary")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: ids of all records before, over all files in order."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, so never more than partitions were written.
    files = index.groupBy("shard").agg(F.sum("n").alias("ids"))
    base = files.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    return index.join(F.broadcast(base), "shard").select(index["*"], (F.col("base") + F.col("before")).alias("start"))
