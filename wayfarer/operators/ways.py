"""Ways: cleaning and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, tags


def road_ways(ways: DataFrame) -> DataFrame:
    """Cleaned ways. ways: way_id, tags (map), n_points. Ways of no known class, areas and ways of one point go."""
    t = lambda k: F.col("tags")[k]
    kept = ways.filter(t("highway").isNotNull() & ~t("highway").isin(dims.DROPPED_CLASSES) & ~F.coalesce(t("area") == "yes", F.lit(False)) & (F.col("n_points") >= 2))
    joined = kept.join(dims.class_dim(ways.sparkSession), t("highway") == F.col("cls"))
    surface, bridge = dims.road_surface(t("surface"), F.col("rank")), tags.bridge(t("bridge"))
    return joined.select(
        "way_id", "cls", "rank", "is_path", tags.road_width(t("width"), F.col("class_width")).alias("width"), surface.alias("surface"), dims.road_colour(surface).alias("colour"),
        tags.oneway(t("oneway")).alias("oneway"), tags.lanes(t("lanes")).alias("lanes"), t("name").alias("name"), bridge.alias("bridge"), tags.layer(t("layer"), bridge).alias("layer"),
    )


def whitelisted(tag_map, names=tuple(dims.EXPORTED_TAGS)):
    return F.map_filter(tag_map, lambda k, _: k.isin(list(names)))


def clip_complete_ways(way_nodes: DataFrame, nodes: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Every node row of each way that reaches into the polygon (lon, lat corners, closed or not).

    A box test comes first, so the ring is tested for few nodes; the ways that reach in meet the rest by a semi join.
    """
    x, y = F.col("lon"), F.col("lat")
    corners = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:]):
        if ay != by:
            crossings = crossings + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    box = x.between(min(p[0] for p in ring), max(p[0] for p in ring)) & y.between(min(p[1] for p in ring), max(p[1] for p in ring))
    inside = nodes.filter(box).filter(crossings % 2 == 1).select("node_id")
    reaching = way_nodes.join(inside, "node_id", "left_semi").select("way_id").distinct()
    return way_nodes.join(reaching, "way_id", "left_semi")
