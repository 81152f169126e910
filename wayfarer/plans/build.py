"""The build: an extract of ways to chunk files and their manifest, writing only what changed.

Read, clip, clean, project, split at junctions and borders, bake, compare with the manifest of the
build before, write. One lazy plan up to the write; the packed chunks are stored once beside the
build and removed at its end.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, geo
from ..operators import bake, geometry, graph, ways
from ..sources import catalog, geojson

FORMAT_VERSION = 1


@dataclass
class Build:
    """manifest: a row a chunk in order, with its files' bytes and digests. written: the chunks whose files this build wrote."""

    manifest: DataFrame
    written: DataFrame
    extract_timestamp: str


def road_points(of: DataFrame) -> DataFrame:
    """way_id, seq, node_id, x, z of ways as the readers give them."""
    points = geojson.way_points(of).withColumn("w", geo.lon_lat_to_world(F.col("lon"), F.col("lat")))
    return points.select("way_id", "seq", "node_id", "w.x", "w.z")


def baked(spark: SparkSession, of: DataFrame) -> DataFrame:
    """i, j, roads and graph of the chunks that the ways (way_id, tags, node_ids, points) give."""
    roads = ways.road_ways(of.select("way_id", "tags", F.size("points").alias("n_points")))
    points = road_points(of)
    parts = graph.chunk_pieces(graph.segments(points, roads))
    pieces = bake.placed_pieces(parts)
    styles = roads.select("way_id", "width", dims.road_height(F.col("rank")).alias("height"), dims.road_colour(F.col("surface")).alias("colour"))
    meshes = bake.meshes(pieces, styles)
    nodes = bake.local_nodes(pieces)
    edges = bake.graph_edges(pieces, nodes).join(roads.select("way_id", "cls", "width", "surface", "oneway", "lanes", "name", "bridge", "layer"), "way_id")
    return bake.packed_chunks(pieces, meshes, piece_marks(pieces, roads), edges, nodes)


def piece_marks(pieces: DataFrame, roads: DataFrame) -> DataFrame:
    """The markings of each piece in order (nth, mark), without dashes near the junctions of their chunk."""
    style = roads.withColumn("s", dims.marking_style(F.col("rank"))).filter("s.centre <> 'none' or s.edges").select("way_id", "width", dims.road_height(F.col("rank")).alias("height"), "s.centre", "s.edges")
    p = pieces.join(style, "way_id").withColumn("p", geometry.distinct_points(F.col("points")))
    pairs = F.arrays_zip(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))).alias("a"), F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))).alias("b"))
    segments = p.select("i", "j", "nth", "width", "height", "centre", "edges", F.posexplode(pairs).alias("seg", "s"))
    segments = segments.select("i", "j", "nth", "seg", "width", "height", "centre", "edges", F.col("s.a.x").alias("ax"), F.col("s.a.z").alias("az"), F.col("s.b.x").alias("bx"), F.col("s.b.z").alias("bz"))
    ends = F.explode(F.array(F.struct(F.col("from_id").alias("node_id"), F.col("points")[0].alias("p"), (2 * F.col("nth")).alias("at")), F.struct(F.col("to_id").alias("node_id"), F.element_at("points", -1).alias("p"), (2 * F.col("nth") + 1).alias("at"))))
    junctions = pieces.filter("not is_path").select("i", "j", ends.alias("e")).groupBy("i", "j", "e.node_id").agg(F.count("*").alias("degree"), F.max_by("e.p", "e.at").alias("p"))
    junctions = junctions.filter(F.col("degree") >= graph.JUNCTION_DEGREE).select("i", "j", "p.x", "p.z")
    marks = geometry.clear_of_junctions(geometry.markings(segments), junctions)
    return marks.withColumn("mark", F.struct("seg", "along"))


def manifest_of(chunks: DataFrame) -> DataFrame:
    files = [F.struct(F.lit(f"{c}.bin").alias("file"), F.octet_length(c).cast("long").alias("bytes"), F.sha2(c, 256).alias("digest")) for c in ("roads", "graph")]
    return chunks.select("i", "j", geo.chunk_key(F.col("i"), F.col("j")).alias("chunk_key"), F.array(*files).alias("files"))


def build_world(spark: SparkSession, extract: str, out: str, polygon: list[tuple[float, float]] | None = None, timestamp: str | None = None) -> Build:
    """Builds the ways of a GeoJSON text sequence into files below out. polygon: ways that reach into it are kept whole."""
    of = geojson.read_ways(spark, extract).filter(F.col("tags")["highway"].isNotNull()).withColumn("tags", F.map_filter("tags", lambda k, _: k.isin(dims.EXPORTED_TAGS)))
    if polygon:
        points = geojson.way_points(of)
        inside = ways.clip_complete_ways(points.select("way_id", "seq", "node_id"), points.select("node_id", "lon", "lat").distinct(), polygon)
        of = of.join(inside.select("way_id").distinct(), "way_id", "left_semi")
    stamp = spark.read.format("binaryFile").load(extract).agg(F.max(geojson.source_timestamp(timestamp, F.col("modificationTime")))).first()[0]
    packed = f"{out}/packed-{uuid.uuid4().hex}"
    try:
        baked(spark, of).write.parquet(packed)
        chunks = spark.read.parquet(packed)
        written = catalog.write_files(chunks, manifest_of(chunks), out, stamp, FORMAT_VERSION)
    finally:
        catalog.delete(spark, packed)
    return Build(bake.chunk_order(catalog.read_manifest(spark, out, FORMAT_VERSION)), written, stamp)
