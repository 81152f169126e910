"""Token ids on disk as patched frame-of-reference blocks, in ascending order of document id.

Each range of document ids is a shard: files of a bounded number of segments. A segment holds a header, the
documents' ids and lengths, an index of where each block starts, and blocks of 128 ids. A
block stores its minimum, a bit width chosen as a percentile of the widths its values need,
the values less the minimum packed at that width, and the outliers that need more bits as
an exception list (position, upper bits). Files are written and read by Spark's own file
sources, so a lost task is simply done again and any file system that Spark knows will do.

Defined results: a null text counts as empty; every document has at least its end id. Rows
that share an id lie side by side, ordered by a hash of their text; repeated rows each have a place.
A null id comes before all others. A document longer than a segment is one by itself. An empty
table gives files without segments and no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_blocks, partitions, rows, scratch, stored, table, utf8
from .tokenization import BYTE_BPE, encoder

BLOCK, END_ID, PERCENTILE = 128, 2, 0.9
#: Bytes of text that a segment takes (or one longer document), and segments of a file.
SEGMENT_BYTES, FILE_SEGMENTS = 4_000_000, 16
MAGIC = b"PFR1"
HEADER = struct.Struct("<4sIIQQQQ")  # magic, shard, segment, documents, ids, blocks, bytes of the body


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.uint8)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(128, blocks) values below 2**width, a column a block, to (blocks, 2 * width) words of 64 bits."""
    out = np.zeros((2 * width, values.shape[1]), dtype=np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[word] |= values[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= values[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values of (blocks, 2 * width) words."""
    words, out = np.ascontiguousarray(words.T), np.empty((BLOCK, len(words)), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= words[word + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return out.T


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, int]:
    """Index and blocks of the ids; how many blocks. The index states where each block starts; the last block is filled up with its own last id."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return b"", 0
    grid = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - len(ids))]).astype(np.uint64).reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    need = bit_lengths(grid)
    width = np.sort(need, axis=1)[:, min(BLOCK - 1, int(percentile * BLOCK))]
    outlier = need > width[:, None]
    exceptions = outlier.sum(axis=1)
    # a block: minimum u32, width u8, exceptions u8, packed words, positions u8, upper bits u32
    sizes = 6 + 16 * width.astype(np.int64) + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], dtype=np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        if len(at):
            raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(at), -1)
            sliding_window_view(out, raw.shape[1], writeable=True)[at] = raw

    put(starts[:-1], low.astype("<u4"))
    put(starts[:-1] + 4, np.stack([width, exceptions.astype(np.uint8)], axis=1))
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        put(starts[at] + 6, pack_bits(np.ascontiguousarray((grid[at] & np.uint64((1 << w) - 1)).T), w))
    block, position = np.nonzero(outlier)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = starts[block] + 6 + 16 * width[block].astype(np.int64)
    out[at + nth] = position
    if len(block):
        put(at + exceptions[block] + 4 * nth, (grid[block, position] >> width[block].astype(np.uint64)).astype("<u4"))
    return starts[:-1].astype("<u4").tobytes() + out.tobytes(), blocks


def decode_blocks(raw: memoryview, blocks: int, ids: int) -> np.ndarray:
    if not blocks:
        return np.zeros(0, "<u4")
    starts = np.frombuffer(raw, dtype="<u4", count=blocks).astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[4 * blocks :]

    def get(at: np.ndarray, n: int, kind: str) -> np.ndarray:
        return np.ascontiguousarray(sliding_window_view(data, n)[at]).view(kind)

    low, width, exceptions = get(starts, 4, "<u4")[:, 0].astype(np.uint64), data[starts + 4], data[starts + 5].astype(np.int64)
    grid = np.zeros((blocks, BLOCK), dtype=np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        grid[at] = unpack_bits(get(starts[at] + 6, 16 * w, "<u8"), w)
    block = np.repeat(np.arange(blocks), exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = starts[block] + 6 + 16 * width[block].astype(np.int64)
    if len(block):
        grid[block, data[at + nth]] |= get(at + exceptions[block] + 4 * nth, 4, "<u4")[:, 0].astype(np.uint64) << width[block].astype(np.uint64)
    return (grid + low[:, None]).reshape(-1)[:ids].astype("<u4")


def segment(shard: int, number: int, docs: list[int], ids: list[bytes]) -> bytes:
    values = np.frombuffer(b"".join(ids), dtype="<u4")
    body, blocks = encode_blocks(values)
    body = np.asarray(docs, dtype="<i8").tobytes() + np.asarray([len(x) // 4 for x in ids], dtype="<u4").tobytes() + body
    return HEADER.pack(MAGIC, shard, number, len(docs), len(values), blocks, len(body)) + body


def segments(content: bytes):
    """(shard, segment, document ids, lengths, ids) of each segment of a file. The file sink ends each with a line feed."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, shard, number, docs, ids, blocks, size = HEADER.unpack_from(content, at)
        at += HEADER.size
        if magic != MAGIC or at + size > len(content):
            raise ValueError(f"not a whole segment at byte {at}")
        names = np.frombuffer(view[at : at + 8 * docs], dtype="<i8")
        lengths = np.frombuffer(view[at + 8 * docs : at + 12 * docs], dtype="<u4").astype(np.int64)
        yield shard, number, names, lengths, decode_blocks(view[at + 12 * docs : at + size], blocks, ids)
        at += size + 1


NO_ID = -(2**63)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, end_id: int = END_ID, shards: int | None = None) -> None:
    """Writes the ids of every document to files below path, a file a shard."""
    end, segment_bytes = np.asarray([end_id], dtype="<u4").tobytes(), SEGMENT_BYTES

    def write(batches):
        encode, number, shard = encoder(vocabulary).encode_all, 0, TaskContext.get().partitionId()
        for batch in in_blocks(batches, "text", segment_bytes):
            ids = [x + end for x in encode(utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array([segment(shard, number, batch.column("id").to_pylist(), ids)], type=pa.binary())], names=["value"])
            number += 1

    spark = docs.sparkSession
    wanted = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("pick"), F.col(text_col).alias("text"))
    # rows that share an id can lie in several ranges, so an id that many rows have fills no single task
    dealt = wanted.repartitionByRange(shards or 2 * partitions(spark), "id", "pick").sortWithinPartitions("id", "pick", "text").select("id", "text")
    # bytes pass through a string column unchanged; the sink adds the line feed after each segment
    dealt.mapInArrow(write, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens and the crc32 of its ids."""
    schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                for shard, number, docs, lengths, ids in segments(content.as_py()):
                    bounds = np.concatenate([[0], np.cumsum(lengths)])
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    n = len(docs)
                    yield rows(schema, {"shard": [shard] * n, "segment": [number] * n, "doc_id": docs, "within": bounds[:-1], "n_tokens": lengths, "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = stored(files.mapInArrow(read, "shard long, segment long, doc_id long, within long, n_tokens long, ids_crc32 long"), "token-index")
    totals = found.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("n"))
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    # one row a file
    first = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    base = totals.join(first, "shard").select("shard", "segment", (F.col("first") + F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    out = found.join(base, ["shard", "segment"])
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op5(spark, sf_dir):
    """Contract op5: a row per document as read back from the files."""
    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
