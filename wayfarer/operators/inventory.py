"""The inventory report: classes, tag coverage, frequent values, width percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.tags import float_prefix


def way_lengths(points: DataFrame) -> DataFrame:
    """way_id, n_points, metres, longest: great-circle lengths of points (way_id, seq, lon, lat)."""
    w = Window.partitionBy("way_id").orderBy("seq")
    d = geo.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return points.withColumn("d", d).groupBy("way_id").agg(F.count("*").alias("n_points"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("metres"), F.coalesce(F.max("d"), F.lit(0.0)).alias("longest"))


def totals(lengths: DataFrame) -> DataFrame:
    """One row: ways, coordinates, km and the longest step between two points."""
    return lengths.agg(F.count("*").alias("ways"), F.coalesce(F.sum("n_points"), F.lit(0)).alias("coordinates"), (F.coalesce(F.sum("metres"), F.lit(0.0)) / 1000).alias("km"), F.coalesce(F.max("longest"), F.lit(0.0)).alias("longest"))


def in_report_order(report: DataFrame) -> DataFrame:
    """The class report, longest classes first."""
    return report.orderBy(F.desc("km"), "cls")


def class_report(ways: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ways, kilometres, nodes, shares and metres a way of each class. ways: way_id, tags."""
    cls = F.coalesce(F.nullif(F.col("tags")["highway"], F.lit("")), F.lit("(none)"))
    by = ways.select("way_id", cls.alias("cls")).join(lengths, "way_id").groupBy("cls").agg(F.count("*").alias("ways"), (F.sum("metres") / 1000).alias("km"), F.sum("n_points").alias("nodes"))
    # the totals are over one row per class
    everything = Window.partitionBy()
    share = lambda c: F.try_divide(100 * F.col(c), F.sum(c).over(everything))
    return by.select("cls", "ways", "km", "nodes", share("ways").alias("ways_pct"), share("km").alias("km_pct"), F.try_divide(F.col("km") * 1000, F.col("ways")).alias("m_per_way"))


def tag_coverage(ways: DataFrame, tags: list[str]) -> DataFrame:
    """Ways that have each tag, empty values included."""
    counts = ways.agg(*[F.count(F.col("tags")[t]).alias(t) for t in tags])
    return counts.unpivot([], tags, "tag", "ways")


def tag_values(ways: DataFrame, tags: list[str], n: int = 8) -> DataFrame:
    """The n most frequent values of each tag, empty ones not counted; ties by the least way."""
    pairs = ways.select("way_id", F.explode(F.map_filter("tags", lambda k, v: k.isin(tags) & (v != "") & v.isNotNull())).alias("tag", "value"))
    counts = pairs.groupBy("tag", "value").agg(F.count("*").alias("ways"), F.min("way_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("ways"), "first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).select("tag", "value", "ways", "rank")


def width_percentiles(ways: DataFrame, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """n and the value at index floor(share * (n - 1)) of the sorted widths. Works on counts of distinct widths, which are few."""
    counts = ways.select(float_prefix(F.col("tags")["width"]).alias("w")).filter("w is not null").groupBy("w").count()
    order = Window.orderBy("w")
    run = counts.withColumn("upto", F.sum("count").over(order)).withColumn("n", F.sum("count").over(Window.partitionBy()))
    pick = [F.min(F.when(F.col("upto") > F.floor(s * (F.col("n") - 1)), F.col("w"))).alias(f"p{round(100 * s)}") for s in shares]
    return run.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *pick)


def class_values(ways: DataFrame, tag: str, n: int = 12) -> DataFrame:
    """The n most frequent values of a tag by class, as class:value."""
    cls = F.coalesce(F.nullif(F.col("tags")["highway"], F.lit("")), F.lit("(none)"))
    keyed = ways.filter(F.col("tags")[tag] != "").select("way_id", F.create_map(F.lit(tag), F.concat(cls, F.lit(":"), F.col("tags")[tag])).alias("tags"))
    return tag_values(keyed, [tag], n)
