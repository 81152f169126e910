"""Packing of documents into sequences by best-fit decreasing.

Overlong documents are first cut into full windows; what is left of each document is placed,
longest first, into the open window with the least room that still holds it. A segment tree
over remaining capacities finds that window. Pieces of one length are interchangeable, so the
tree works on counts of lengths: its input (at most `window` numbers) and its output (runs of
places for pieces of a length) don't grow with the corpus. Executors number the pieces of each
length and look up their places, so no task or driver ever holds the pieces.

Defined results: a null text counts as empty, and each document has at least its end id. Rows
that share an id are documents of their own. An empty table gives no pieces. Other columns are
not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_blocks, partitions, rows, stored, table, utf8
from .tokenization import WORD_BPE, encoder

WINDOW, END_ID = 2048, 1


class Tightest:
    """Segment tree over capacities 0..n: the smallest capacity of at least c that some open window has."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.has = [False] * (2 * self.size)

    def set(self, c: int, value: bool) -> None:
        i = c + self.size
        self.has[i] = value
        while i > 1:
            i //= 2
            self.has[i] = self.has[2 * i] or self.has[2 * i + 1]

    def at_least(self, c: int) -> int | None:
        i = c + self.size
        if self.has[i]:
            return c
        while i > 1:
            if i % 2 == 0 and self.has[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.has[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first window, pieces a window, offset of a window's first) that place every piece.

    The same windows result as from placing pieces one by one: when the tightest window has room
    for several pieces of the length, it stays the tightest for the next ones.
    """
    tree, open_at, windows, out = Tightest(window), {}, 0, []

    def leave(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_at.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.at_least(length)
            if capacity is None:
                each = window // length
                need = -(-left // each)
                leave(window, windows, need)
                windows += need
                capacity = window
            first, n = open_at[capacity].pop()
            if not open_at[capacity]:
                tree.set(capacity, False)
            each = min(capacity // length, left)
            full = min(n, left // each)
            out.append((length, rank, full * each, first, each, window - capacity))
            leave(capacity - each * length, first, full)
            leave(capacity, first + full, n - full)
            rank, left = rank + full * each, left - full * each
    return out


def pieces_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """A row per piece: full windows of overlong documents, and what is left of each."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encode = encoder(vocabulary).encode_all
        for batch in in_blocks(batches, "text"):
            out = {f.name: [] for f in schema}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(utf8(batch.column("text")))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    for k, v in zip(out, (doc, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n)):
                        out[k].append(v)
            yield rows(schema, out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = WORD_BPE, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    shards = 4 * partitions(spark)
    shard = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "start", "ids_crc32"), F.lit(shards)).cast("int").alias("shard")
    pieces = stored(pieces_of(docs, id_col, text_col, vocabulary, end_id, window).select("*", shard), "pieces")
    # at most shards x window counts
    by_shard = stored(pieces.groupBy("length", "shard").count(), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_shard.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `window` rows
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = by_shard.select("length", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "length").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(base, ["length", "shard"])
    runs = np.asarray(sorted(best_fit_decreasing(counts, window)) or np.zeros((0, 6)), dtype=np.int64)  # bounded by `window`, not by the pieces
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def place(batches):
        key = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:5]), pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)], schema=schema)

    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, ", ".join(f"{c} long" for c in schema.names))


def op2(spark, sf_dir):
    """Contract op2: a row per piece of every document."""
    return pack(table(spark, sf_dir, "documents"))
