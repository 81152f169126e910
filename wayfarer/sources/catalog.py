"""Chunk tables and chunk files with a manifest: only chunks that changed are written again.

The manifest holds a digest and a size per chunk. Digests add up row hashes, so they need no
order and are aggregated before the shuffle. Chunks that a new build lacks keep their files;
readers go by the manifest. Each build writes a manifest of its own, named by its number, after all
that it points to; a build that ends early leaves the one before it in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["chunk_i", "chunk_j"]


def manifest(table: DataFrame) -> DataFrame:
    """chunk_i, chunk_j, rows, digest, bytes of a chunked table. digest: sums of two 64-bit row hashes."""
    cols = [c for c in sorted(table.columns) if c not in KEYS]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)"))
    digest = F.concat_ws(":", total(0), total(1))
    return table.groupBy(*KEYS).agg(F.count("*").alias("rows"), digest.alias("digest"), F.sum(F.octet_length(F.to_json(F.struct(*cols)))).alias("bytes"))


def changed_chunks(new: DataFrame, old: DataFrame | None) -> DataFrame:
    return new if old is None else new.join(old.select(*KEYS, "digest"), [*KEYS, "digest"], "left_anti")


def _files(spark: SparkSession, path: str):
    """The path's file system and the path as it names it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def _builds(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the builds whose manifests were written to their end."""
    fs, at = _files(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    names = [(s.getPath().toString(), s.getPath().getName()) for s in fs.listStatus(at)]
    return sorted(int(n.removeprefix("build-")) for p, n in names if n.startswith("build-") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    builds = _builds(spark, path)
    return spark.read.parquet(f"{path}/manifest/build-{builds[-1]:06}") if builds else None


def _publish(spark: SparkSession, new: DataFrame, path: str) -> None:
    number = max(_builds(spark, path), default=0) + 1
    new.write.mode("overwrite").parquet(f"{path}/manifest/build-{number:06}")


def write_if_changed(table: DataFrame, path: str) -> DataFrame:
    """Writes the chunks whose digest differs from the manifest's, then the manifest; returns the chunks written."""
    spark = table.sparkSession
    _, staged = _files(spark, f"{path}/staged")
    delete(spark, staged.toString())
    try:
        changed_chunks(manifest(table), latest(spark, path)).write.parquet(staged.toString())
        written = spark.read.parquet(staged.toString())
        # the planner broadcasts the changed chunks only if their table is small
        rows = table.join(written.select(*KEYS), KEYS, "left_semi").repartition(*KEYS)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{path}/chunks")
        _publish(spark, manifest(table), path)
        return spark.createDataFrame(written.select(*KEYS).toArrow())  # two numbers a chunk, as the caller is told them
    finally:
        delete(spark, staged.toString())


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the chunks in the manifest; a filter on the chunk prunes partitions."""
    return spark.read.parquet(f"{path}/chunks").join(latest(spark, path).select(*KEYS), KEYS, "left_semi")


def bytes_per_chunk(files: DataFrame) -> DataFrame:
    return files.groupBy("chunk_key").agg(F.sum("bytes").alias("bytes"))


# ---- files of chunks


def write_files(chunks: DataFrame, new: DataFrame, path: str, timestamp: str, version: int) -> DataFrame:
    """Writes the files of chunks (i, j, roads, graph) whose digests differ from the last manifest's, then the manifest; returns i, j, file of those written.

    new: i, j, chunk_key, files (file, bytes, digest). Files lie below chunks/i=../j=.. as rows (file, content).
    """
    spark = chunks.sparkSession
    told = new.select("*", F.lit(version).alias("format_version"), F.lit(timestamp).alias("extract_timestamp"))
    each = new.select("i", "j", F.explode("files").alias("f")).select("i", "j", "f.file", "f.digest")
    old = read_manifest(spark, path, version) if _builds(spark, path) else None
    if old is not None:
        each = each.join(old.select("i", "j", F.explode("files").alias("f")).select("i", "j", "f.file", "f.digest"), ["i", "j", "file", "digest"], "left_anti")
    written = spark.createDataFrame(each.select("i", "j", "file").toArrow())  # names alone; a chunk has two files
    content = F.explode(F.array(*[F.struct(F.lit(f"{c}.bin").alias("file"), F.col(c).alias("content")) for c in ("roads", "graph")]))
    rows = chunks.select("i", "j", content.alias("f")).select("i", "j", "f.file", "f.content").join(written, ["i", "j", "file"], "left_semi")
    rows.repartition("i", "j").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("i", "j", "file").parquet(f"{path}/chunks")
    _publish(spark, told, path)
    return written


def read_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The last manifest. One of another format version is refused."""
    found = latest(spark, path)
    if found is None:
        raise ValueError(f"no manifest below {path}")
    other = found.filter(F.col("format_version") != version).select("format_version").first()
    if other is not None:
        raise ValueError(f"the manifest has format version {other[0]}, not {version}")
    return found


def read_files(spark: SparkSession, path: str, version: int) -> DataFrame:
    """i, j, file, content of the chunks in the manifest."""
    return spark.read.parquet(f"{path}/chunks").join(read_manifest(spark, path, version).select("i", "j"), ["i", "j"], "left_semi")


def chunk_bytes(of: DataFrame) -> DataFrame:
    """chunk_key and bytes over all files of each chunk of a manifest."""
    return bytes_per_chunk(of.select("chunk_key", F.explode("files").alias("f")).select("chunk_key", "f.bytes"))
