"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import collected, remove, scratch, settled, shared_dir, shuffles_removed, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from all that are taken."""
    taken, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def trim() -> None:
    """Gives freed memory back, which an idle worker would keep beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


_kept: dict = {}


def kept(key, make: Callable):
    """What a worker keeps between tasks: one thing at a time, so that the operators that share a worker don't add up."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = make()
    return _kept[key]


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for; bucket counts follow it, so they grow with the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def least_count(counts: DataFrame, n: str, most: int, weight: Column | None = None) -> int:
    """The least number such that at most `most` rows (or their weight) have a count of it or more.

    Taken from a histogram of counts, a hundred steps to each doubling, so no rows are sorted or gathered.
    """
    step = F.ceil(F.log2(n) * 100).cast("int")
    found = counts.groupBy(step.alias("step")).agg(F.sum(F.lit(1) if weight is None else weight).alias("w"), F.min(n).alias("least")).orderBy(F.desc("step")).collect()
    least, total = 2**62, 0
    for r in found:
        total += r["w"]
        if total > most:
            break
        least = r["least"]
    return least


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII alone takes the fast lower(); any other goes by code point."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_zstd = pa.Codec("zstd", compression_level=3)


def squeezed(texts: list[bytes]) -> list[bytes]:
    """Each text compressed by itself, behind its length; smaller in a shuffle than what Spark's own codec makes of it."""
    return [len(x).to_bytes(8, "little") + _zstd.compress(x, asbytes=True) for x in texts]


def unsqueezed(column: pa.Array) -> list[bytes]:
    return [_zstd.decompress(memoryview(x)[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in column.to_pylist()]


def rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)


def in_blocks(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about most_bytes of the column's text, so that arrays per word stay small."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    trim()
