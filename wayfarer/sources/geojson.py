"""Readers of line-delimited and whole GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

_FEATURE = "type string, geometry struct<type:string, coordinates:array<array<double>>>, properties map<string,string>"


def _ways(features: DataFrame, need_nodes: bool) -> DataFrame:
    p, at = F.col("f.properties"), lambda k: F.col("f.properties")[k]
    lines = features.filter("f.geometry.type = 'LineString'")
    nodes = F.from_json(at("@way_nodes"), "array<bigint>")
    lines = lines.filter(nodes.isNotNull()) if need_nodes else lines
    points = F.transform(F.col("f.geometry.coordinates"), lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))
    return lines.select(at("@id").cast("bigint").alias("way_id"), F.map_filter(p, lambda k, _: ~k.startswith("@")).alias("tags"), nodes.alias("node_ids"), points.alias("points"))


def read_ways(spark: SparkSession, path: str, need_nodes: bool = True) -> DataFrame:
    """way_id, tags, node_ids, points of a GeoJSON text sequence. Blank lines are skipped, a record separator before a line is dropped, a malformed line raises."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\u001e", "").alias("value")).filter(F.trim("value") != "")
    return _ways(lines.select(F.from_json("value", _FEATURE, {"mode": "FAILFAST"}).alias("f")), need_nodes)


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """The same of one document with a features array."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"features array<struct<{_struct(_FEATURE)}>>", {"mode": "FAILFAST"})["features"]).alias("f"))
    return _ways(whole, need_nodes=False)


def _struct(ddl: str) -> str:
    return ddl.replace("type string, geometry", "type:string, geometry:", 1).replace("properties map", "properties:map").replace("geometry: struct", "geometry:struct")


def way_points(ways: DataFrame) -> DataFrame:
    """way_id, seq, node_id, lon, lat: a row per point."""
    both = F.arrays_zip("node_ids", "points")
    return ways.select("way_id", F.posexplode(both).alias("seq", "p")).select("way_id", "seq", F.col("p.node_ids").alias("node_id"), "p.points.lon", "p.points.lat")


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_points from ways (way_id, node_ids) and nodes (node_id, lon, lat)."""
    return ways.select("way_id", F.posexplode("node_ids").alias("seq", "node_id")).join(nodes, "node_id").select("way_id", "seq", "node_id", "lon", "lat")


def source_timestamp(header: str | None, modified):
    """The header's time if there is one, else the file's."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lit(header).cast("string"), r"^\s+|\s+$", ""), F.lit("")), F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def block_boundary(i0: int, j0: int, i1: int, j1: int, samples: int = 8) -> list[tuple[float, float]]:
    """A closed ring (lon, lat) around a block of chunks, with samples on each side, so that it follows the grid."""
    corners = [(i0, j0), (i1 + 1, j0), (i1 + 1, j1 + 1), (i0, j1 + 1)]
    ring = [(1000.0 * (a[0] + (b[0] - a[0]) * k / samples), 1000.0 * (a[1] + (b[1] - a[1]) * k / samples)) for a, b in zip(corners, corners[1:] + corners[:1]) for k in range(samples)]
    return [geo.lon_lat_of(*p) for p in [*ring, ring[0]]]
