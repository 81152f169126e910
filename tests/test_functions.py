from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wayfarer.functions import dims, geo, tags

PLACES = [(115.07, -8.45, 287516.5959, 9065427.3705), (114.4363, -8.1636, 217505.0297, 9096717.9358), (115.6553, -8.3364, 351926.0527, 9078260.3406), (115.0847, -8.8291, 289346.228, 9023501.3979), (115.088, -8.112, 289319.2569, 9102824.1671)]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_projection_goldens_and_inverse(spark):
    df = spark.createDataFrame(PLACES, "lon double, lat double, e double, n double").withColumn("w", geo.lon_lat_to_world(F.col("lon"), F.col("lat"))).withColumn("b", geo.world_to_lon_lat(F.col("w.x"), F.col("w.z")))
    for r in df.collect():
        assert r.w.x == pytest.approx(r.e - 287500, abs=1e-3) and r.w.z == pytest.approx(9065500 - r.n, abs=1e-3)
        assert r.b.lon == pytest.approx(r.lon, abs=1e-9) and r.b.lat == pytest.approx(r.lat, abs=1e-9)


def test_round_trip_grid(spark):
    grid = spark.range(28 * 18).select(((F.col("id") % 28) * 5000.0 - 70000).alias("x"), (F.floor(F.col("id") / 28) * 5000.0 - 45000).alias("z"))
    there = grid.withColumn("p", geo.world_to_lon_lat(F.col("x"), F.col("z"))).cache()  # else the two series become one huge expression
    back = there.withColumn("w", geo.lon_lat_to_world(F.col("p.lon"), F.col("p.lat")))
    assert back.filter((F.abs(F.col("w.x") - F.col("x")) > 1e-3) | (F.abs(F.col("w.z") - F.col("z")) > 1e-3)).count() == 0


def test_chunks(spark):
    r = one(spark, a=geo.chunk_of(F.lit(-0.5), F.lit(1000.0)), key=geo.chunk_key(F.lit(-1), F.lit(21)), p=geo.parse_chunk_key(F.lit("x-1_z21")))
    assert tuple(r.a) == (-1, 1) and r.key == "x-1_z21" and tuple(r.p) == (-1, 21)
    for bad in ("x01_z1", "x-0_z1", "x1z1", "x1_z1 "):
        with pytest.raises(Exception, match="not a chunk key"):
            one(spark, p=geo.parse_chunk_key(F.lit(bad)))


def test_tags(spark):
    cases = [("5", 5.0), ("4.5 m", 4.5), ("0.5", 3.5), ("15", 3.5), ("abc", 3.5), (None, 3.5)]
    df = spark.createDataFrame(cases, "tag string, want double").withColumn("got", tags.road_width(F.col("tag"), F.lit(3.5)))
    assert all(r.got == r.want for r in df.collect())
    r = one(spark, a=tags.lanes(F.lit("2;3")), b=tags.lanes(F.lit("0")), c=tags.layer(F.lit("x"), F.lit(True)), d=tags.layer(F.lit(None).cast("string"), F.lit(False)), e=tags.oneway(F.lit("reverse")), f=tags.bridge(F.lit(None).cast("string")))
    assert tuple(r) == (2, 1, 1, 0, -1, False)


def test_styles(spark):
    dim = {c: (w, k, p) for c, w, k, p in dims.ROAD_CLASSES}
    want = {"motorway": ("solid", True), "trunk": ("dashed", True), "primary": ("dashed", False), "tertiary": ("dashed", False), "unclassified": ("none", False), "motorway_link": ("solid", True)}
    for c, style in want.items():
        assert tuple(one(spark, s=dims.marking_style(F.lit(dim[c][1]))).s) == style
    r = one(spark, a=dims.road_surface(F.lit("cobble"), F.lit(6)), b=dims.top_speed_on(F.lit("nowhere")), c=dims.rgb(F.lit(0x5A5651)), d=dims.linear_colour(F.lit(255)))
    assert (r.a, r.b, r.c, r.d) == ("paving_stones", 15.0, [0x5A, 0x56, 0x51], 255)


def test_angles_and_distances(spark):
    r = one(spark, t=geo.shortest_turn(F.lit(1.5 * math.pi)), h=geo.heading(*map(F.lit, (0.0, 0.0, 0.0, 0.0))), e=geo.heading(*map(F.lit, (0.0, 0.0, 5.0, 0.0))), d=geo.point_to_segment(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0))), g=geo.distance_to_chunk(F.lit(1), F.lit(0), F.lit(400.0), F.lit(500.0)))
    assert r.t == pytest.approx(-math.pi / 2) and r.h == math.pi and r.e == pytest.approx(math.pi / 2) and r.d.distance == 5.0 and r.g == 600.0
