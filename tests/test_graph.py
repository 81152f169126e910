from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from wayfarer import storage
from wayfarer.operators import geometry, graph, nearest, ways
from wayfarer.sources import catalog

POINT = "way_id long, seq int, node_id long, x double, z double"


def road(spark, *rows):
    return spark.createDataFrame(list(rows), "way_id long, is_path boolean")


def test_junctions(spark):
    pts = [(w, i, n, float(n), float(w)) for w, ns in ((1, [100, 101, 102, 103]), (2, [200, 102, 201]), (3, [300, 101, 301])) for i, n in enumerate(ns)]
    got = graph.junction_edges(spark.createDataFrame(pts, POINT), road(spark, (1, False), (2, False), (3, True))).filter("way_id = 1").orderBy("edge_seq").collect()
    assert [(r.from_id, r.to_id) for r in got] == [(100, 102), (102, 103)]


def test_a_way_that_meets_itself_is_no_junction(spark):
    pts = [(1, i, n, float(i), 0.0) for i, n in enumerate([1, 2, 3, 2, 4])]
    assert graph.junction_edges(spark.createDataFrame(pts, POINT), road(spark, (1, False))).count() == 1


def parts(spark, *ends):
    rows = [(7, False, 0, k, k, k + 1, *map(float, e)) for k, e in enumerate(ends)]
    return graph.chunk_pieces(spark.createDataFrame(rows, "way_id long, is_path boolean, edge_seq int, seg int, from_id long, to_id long, ax double, az double, bx double, bz double"))


def test_border_cut(spark):
    got = graph.pieces(parts(spark, (9800, 21500, 10200, 21500))).orderBy("piece_seq").collect()
    assert [(r.i, r.j) for r in got] == [(9, 21), (10, 21)] and got[0].to_id == got[1].from_id == -(7 * 1024)


def test_corner_cut_makes_an_empty_middle(spark):
    got = graph.pieces(parts(spark, (9900, 21900, 10100, 22100))).orderBy("piece_seq").collect()
    assert [round(r.length, 6) for r in got] == [141.421356, 0.0, 141.421356]


def test_every_border_node_has_two_pieces(spark):
    p = graph.pieces(parts(spark, (9800, 21500, 11200, 21500), (11200, 21500, 9800, 22700)))
    ends = p.select(F.explode(F.array("from_id", "to_id")).alias("n")).filter("n < 0").groupBy("n").count()
    assert ends.filter("count <> 2").count() == 0 and ends.count() >= 4
    assert abs(p.agg(F.sum("length")).first()[0] - 1400 - (1400**2 + 1200**2) ** 0.5) < 1e-6


def test_dropped_ways(spark):
    rows = [(i, {"highway": h}, 2) for i, h in enumerate(["proposed", "construction", "raceway", "bus_stop", "residential"])] + [(9, {"highway": "pedestrian", "area": "yes"}, 2), (10, {"highway": "residential"}, 1), (11, {"name": "x"}, 3), (12, {"highway": "path", "bridge": "yes"}, 2)]
    got = ways.road_ways(spark.createDataFrame(rows, "way_id long, tags map<string,string>, n_points long")).select("way_id", "layer").orderBy("way_id").collect()
    assert [tuple(r) for r in got] == [(4, 0), (12, 1)]


def test_distinct_points_holds_against_the_last_kept(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.03, 0.0), (0.06, 0.0), (0.09, 0.0), (1.0, 0.0)],), ([],)], "p array<struct<x:double,z:double>>")
    assert [[q.x for q in r[0]] for r in df.select(geometry.distinct_points(F.col("p"))).collect()] == [[0.0, 0.06, 1.0], []]


def test_marks(spark):
    cols = "i int, j int, width double, height double, centre string, edges boolean, ax double, az double, bx double, bz double"
    m = geometry.markings(spark.createDataFrame([(0, 0, 6.0, 0.0, "solid", True, 0.0, 0.0, 200.0, 0.0), (0, 0, 6.0, 0.0, "dashed", False, 0.0, 50.0, 200.0, 50.0), (0, 0, 6.0, 0.0, "dashed", True, 1.0, 1.0, 1.0, 1.0)], cols))
    assert {r.kind: r["count"] for r in m.groupBy("kind").count().collect()} == {"solid": 1, "edge": 2, "dash": 50}
    assert sorted(round(r.z, 2) for r in m.filter("kind = 'edge'").collect()) == [-2.28, 2.28]
    clear = geometry.clear_of_junctions(m, spark.createDataFrame([(0, 0, 100.0, 50.0)], "i int, j int, x double, z double")).filter("kind = 'dash'")
    assert all(abs(r.x - 100) >= 6.75 for r in clear.collect()) and 0 < clear.filter("x < 100").count() and clear.filter("x > 100").count() > 0


def test_dashes_are_counted_without_a_row_each(spark):
    """As clear_of_junctions() counts them, with junctions dense, absent, at the border and beyond the raster, and roads wider than it knows."""
    rnd = random.Random(7)
    place = lambda i: i * 1000 + rnd.choice([0.0, 1000.0, rnd.uniform(0, 1000), rnd.uniform(400, 500)])
    segs = [(k, i, j, rnd.choice([3.0, 5.5, 12.0, 15.0]), place(i), place(j), place(i), place(j)) for k in range(300) for i, j in [(rnd.randint(-1, 1), rnd.randint(0, 1))]]
    joints = [(i, j, place(i), place(j)) for i, j in ((0, 0), (-1, 0), (0, 1), (-1, 1)) for _ in range(1500)] + [(-1, 1, -1100.0, 1500.0), (5, 5, 5500.0, 5500.0)]
    s = spark.createDataFrame(segs, "way_id long, i int, j int, width double, ax double, az double, bx double, bz double")
    q = spark.createDataFrame(joints, "i int, j int, x double, z double")
    marks = geometry.markings(s.selectExpr("*", "0.0D as height", "'dashed' as centre", "false as edges"))
    want = geometry.clear_of_junctions(marks, q).filter("kind = 'dash'").count()
    counts = geometry.dash_counts(s, q)
    assert 0 < want < marks.count() and counts.agg(F.sum("dashes")).first()[0] == want and counts.count() < marks.count() / 100


def test_nearest_is_exact(spark):
    segs = spark.createDataFrame([(1, 6.0, -300.0, 0.0, 300.0, 0.0), (2, 4.0, 0.0, 900.0, 10.0, 905.0), (3, 4.0, 0.0, 0.0, 5000.0, 5000.0)], "segment_id long, width double, ax double, az double, bx double, bz double")
    pts = spark.createDataFrame([(1, 50.0, 1.0), (2, 50.0, 8.0), (3, 0.0, 700.0), (4, -9000.0, 0.0), (5, 2500.0, 2530.0)], "point_id long, px double, pz double")
    got = {r.point_id: r for r in nearest.nearest(pts, segs, 800.0).collect()}
    assert 4 not in got and got[1].on_road and not got[2].on_road and got[3].segment_id == 2 and got[5].segment_id == 3
    assert round(got[2].distance, 6) == 8.0 and {r.point_id for r in nearest.nearest(pts, segs, 100.0).collect()} == {1, 2, 5}


def test_nearest_sends_no_table_to_the_driver_and_is_exact_at_every_reach(spark, monkeypatch):
    """Points inside, beside and far from dense segments, with ties and repeats, against brute force; no step may broadcast or sort the pairs of points and segments."""
    rnd = random.Random(5)
    roads = [(k, 4.0, float(a), float(b), float(a + rnd.randint(-30, 30)), float(b + rnd.randint(-30, 30))) for k in range(300) for a, b in [(rnd.randint(0, 200), rnd.randint(0, 200))]]
    roads += [(1000 + k, *r[1:]) for k, r in enumerate(roads[:60])] + [(900, 4.0, -700.0, -700.0, -700.0, -700.0)]
    places = [(k, float(rnd.randint(*span)), float(rnd.randint(*span))) for k, span in enumerate([(0, 200)] * 80 + [(-60, 260)] * 60 + [(-1100, 1100)] * 120)]
    steps, stored = [], storage.stored

    def seen(df, name):
        steps.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    for module in (storage, nearest):
        monkeypatch.setattr(module, "stored", seen)
    segs, pts = spark.createDataFrame(roads, "segment_id long, width double, ax double, az double, bx double, bz double"), spark.createDataFrame(places, "point_id long, px double, pz double")

    def distance(p, s):
        dx, dz = s[4] - s[2], s[5] - s[3]
        t = max(0.0, min(1.0, ((p[1] - s[2]) * dx + (p[2] - s[3]) * dz) / (dx * dx + dz * dz))) if dx or dz else 0.0
        x, z = p[1] - (s[2] + dx * t), p[2] - (s[3] + dz * t)
        return math.sqrt(x * x + z * z)

    for radius in (800.0, 100.0, 7.0):
        out = nearest.nearest(pts, segs, radius)
        best = {p[0]: min((distance(p, s), s[0]) for s in roads) for p in places}
        assert {r.point_id: (r.distance, r.segment_id) for r in out.collect()} == {k: v for k, v in best.items() if v[0] <= radius}
        steps.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in s for s in steps) and any("SortMergeJoin" in s for s in steps)


def test_only_changed_chunks_are_written(spark, tmp_path):
    path, make = str(tmp_path / "world"), lambda v: spark.createDataFrame([(0, 0, 1, "a"), (0, 1, 2, "b"), (0, 1, 3, v)], "chunk_i int, chunk_j int, id long, v string")
    assert catalog.write_if_changed(make("c"), path).count() == 2
    assert catalog.write_if_changed(make("c"), path).count() == 0
    assert [tuple(r) for r in catalog.write_if_changed(make("d"), path).collect()] == [(0, 1)]
    assert {r.v for r in catalog.read_chunks(spark, path).collect()} == {"a", "b", "d"}
