"""The build from an extract to chunk files, and what it is made of."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.functions import geo
from wayfarer.operators import bake, geometry, graph
from wayfarer.plans import build
from wayfarer.sources import blobs, catalog, geojson

SEGMENT = "way_id long, is_path boolean, edge_seq int, seg int, from_id long, to_id long, ax double, az double, bx double, bz double"


def way(i: int, nodes: dict[int, tuple[float, float]], **tags) -> str:
    points = [geo.lon_lat_of(*p) for p in nodes.values()]
    return json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": points}, "properties": {"@id": i, "@way_nodes": list(nodes), **tags}})


def extract(path, width="6", extra=()):
    lines = [
        way(1, {1: (9100, 21500), 2: (9500, 21500), 3: (10400, 21500)}, highway="primary", name="Long", width=width, surface="asphalt"),
        way(2, {4: (9500, 21200), 2: (9500, 21500), 5: (9500, 21800)}, highway="residential"),
        way(3, {6: (9300, 21450), 7: (9300, 21480)}, highway="footway", note="dropped tag"),
        way(4, {8: (9300, 21400), 9: (9310, 21400)}, highway="proposed"),
        way(5, {10: (50000, 50000), 11: (50010, 50000)}, highway="service"),
        *extra,
    ]
    path.write_text("\n".join("\x1e" + x for x in lines))
    return str(path)


POLYGON = [geo.lon_lat_of(*p) for p in ((9000, 21000), (11000, 21000), (11000, 22000), (9000, 22000))]


def decoded(spark, out) -> dict:
    kinds = {"roads.bin": blobs.decode_roads, "graph.bin": blobs.decode_graph}
    return {(r.i, r.j, r.file): kinds[r.file](bytes(r.content)) for r in catalog.read_files(spark, out, build.FORMAT_VERSION).collect()}


def test_build(spark, tmp_path):
    out = str(tmp_path / "world")
    first = build.build_world(spark, extract(tmp_path / "a.seq"), out, POLYGON, " 2024-05-06T07:08:09Z ")
    told = first.manifest.collect()
    assert [(r.i, r.j, r.chunk_key) for r in told] == [(9, 21, "x9_z21"), (10, 21, "x10_z21")]  # by number; by text the second came first
    assert first.extract_timestamp == "2024-05-06T07:08:09Z" and {r.extract_timestamp for r in told} == {first.extract_timestamp}
    assert sorted(map(tuple, first.written.collect())) == [(i, 21, f"{f}.bin") for i in (9, 10) for f in ("graph", "roads")]
    files = decoded(spark, out)
    graph_ = files[9, 21, "graph.bin"]
    assert [(n["id"], round(n["x"]), round(n["z"])) for n in graph_["nodes"]] == [(1, -400, 0), (2, 0, 0), (-1024, 500, 0), (4, 0, -300), (5, 0, 300)]
    assert [e["nodes"] for e in graph_["edges"]] == [[0, 1], [1, 2], [3, 1], [1, 4]] and {(e["cls"], e["name"], e["width"]) for e in graph_["edges"]} == {("primary", "Long", 6.0), ("residential", None, 3.5)}
    assert [(n["id"], round(n["x"])) for n in files[10, 21, "graph.bin"]["nodes"]] == [(-1024, -500), (3, -100)]
    roads = files[9, 21, "roads.bin"]
    assert len(roads["positions"]) == 5 * (4 + 18) and len(roads["indices"]) == 5 * (6 + 48) and roads["indices"].max() == 5 * 22 - 1
    assert roads["positions"][:4, [0, 2]].round(2).tolist() == [[-400, 3], [-400, -3], [0, 3], [0, -3]] and len({tuple(c) for c in roads["colours"].tolist()}) == 3
    near = np.hypot(roads["markings"][:, 0], roads["markings"][:, 2])
    assert len(roads["markings"]) > 100 and near.min() >= 6.75 - 1e-3  # dashes keep clear of the junction
    assert {r.chunk_key: r.bytes for r in catalog.chunk_bytes(first.manifest).collect()} == {r.chunk_key: sum(f.bytes for f in r.files) for r in told}
    # again: nothing; another width of the long way: both chunks; another way in one chunk: that one's files
    assert build.build_world(spark, extract(tmp_path / "a.seq"), out, POLYGON, "2024-05-06T07:08:09Z").written.count() == 0
    assert build.build_world(spark, extract(tmp_path / "a.seq", width="7"), out, POLYGON).written.count() == 4
    more = [way(6, {20: (10600, 21100), 21: (10700, 21100)}, highway="path")]
    assert [tuple(r) for r in build.build_world(spark, extract(tmp_path / "a.seq", "7", more), out, POLYGON).written.collect()] == [(10, 21, "roads.bin")]
    assert not [p for p in (tmp_path / "world").iterdir() if p.name not in ("chunks", "manifest")]
    assert build.build_world(spark, extract(tmp_path / "a.seq"), str(tmp_path / "all")).manifest.count() == 3  # without a polygon all ways are in
    with pytest.raises(ValueError, match="format version 1, not 2"):
        catalog.read_manifest(spark, out, 2)
    with pytest.raises(ValueError, match="no manifest"):
        catalog.read_manifest(spark, str(tmp_path / "none"), 1)


def test_an_unfinished_build_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda v: spark.createDataFrame([(0, 0, v)], "chunk_i int, chunk_j int, v string")
    assert catalog.write_if_changed(make("a"), path).count() == 1
    (tmp_path / "t/manifest/build-000002").mkdir()  # began to write its manifest and died
    assert catalog.write_if_changed(make("a"), path).count() == 0 and catalog.write_if_changed(make("b"), path).count() == 1


def mesh_of(points, width, height=0.0):
    """The same mesh by plain loops."""
    kept = []
    for p in points:
        if not kept or math.dist(p, kept[-1]) >= geometry.MERGE:
            kept.append(p)
    v, idx, h, before = [], [], width / 2, None
    for k in range(len(kept) - 1):
        (ax, az), (bx, bz) = kept[k], kept[k + 1]
        n = math.dist(kept[k], kept[k + 1])
        nx, nz, s = -(bz - az) / n * h, (bx - ax) / n * h, len(v)
        v += [(ax + nx, az + nz), (ax - nx, az - nz), (bx + nx, bz + nz), (bx - nx, bz - nz)]
        idx += [s, s + 2, s + 1, s + 1, s + 2, s + 3]
        if before is not None:
            v.append((ax, az))
            idx += [s + 4, before + 2, s, s + 4, s + 1, before + 3]
        before = s
    for x, z in kept:
        c = len(v)
        v += [(x, z), *((x + math.cos(t * math.pi / 4) * h, z + math.sin(t * math.pi / 4) * h) for t in range(8))]
        for t in range(8):
            idx += [c, c + 1 + t, c + 1 + (t + 1) % 8]
    return v, idx


def test_meshes(spark):
    r = np.random.default_rng(1)
    lines = {1: [(0, 0), (100, 0), (100, 100), (100.01, 100), (160, 40)], 2: [(5, 5), (5.01, 5.0)], 3: [tuple(p) for p in r.uniform(0, 900, (7, 2))], 4: [(700, 700), (710, 700)]}
    rows = [(w, w == 4, 0, k, 10 * w + k, 10 * w + k + 1, *map(float, (*a, *b))) for w, ps in lines.items() for k, (a, b) in enumerate(zip(ps, ps[1:]))]
    pieces = bake.placed_pieces(graph.chunk_pieces(spark.createDataFrame(rows, SEGMENT)))
    styles = spark.createDataFrame([(w, 2.0 * w, 0.1 * w, w) for w in lines], "way_id long, width double, height double, colour int")
    got = bake.meshes(pieces, styles)
    first, all_vertices = 0, []
    for m in got.orderBy("nth").collect():
        v, idx = mesh_of([(x - 500, z - 500) for x, z in lines[m.way_id]], 2.0 * m.way_id)
        assert (m.first_vertex, m.n_vertices, m.n_indices) == (first, len(v), len(idx))
        assert np.allclose([tuple(q) for q in m.vertices], v) and m.indices == [x + first for x in idx]
        first += len(v)
        all_vertices += v
    rows = bake.mesh_vertices(got).orderBy("vertex").collect()
    assert [q.vertex for q in rows] == list(range(first)) and np.allclose([(q.x, q.z) for q in rows], all_vertices)
    marks = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (3, 3, 1)], "i int, j int, k int")
    total = sum(m.n_indices for m in got.collect())
    assert {(q.i, q.j): q.triangles for q in bake.triangles(got, marks).collect()} == {(0, 0): total // 3 + 4, (3, 3): 2}


def test_local_nodes_by_first_appearance(spark):
    rows = [(1, False, 0, 0, 7, 3, 0.0, 0.0, 10.0, 0.0), (1, False, 1, 0, 3, 9, 10.0, 0.0, 20.0, 0.0), (2, True, 0, 0, 50, 51, 0.0, 5.0, 5.0, 5.0), (3, False, 0, 0, 9, 7, 20.0, 0.0, 0.0, 0.0)]
    pieces = bake.placed_pieces(graph.chunk_pieces(spark.createDataFrame(rows, SEGMENT)))
    nodes = bake.local_nodes(pieces)
    assert [(r.node, r.node_id, r.x) for r in nodes.orderBy("node").collect()] == [(0, 7, -500), (1, 3, -490), (2, 9, -480)]
    assert [(r.from_node, r.to_node) for r in bake.graph_edges(pieces, nodes).orderBy("nth").collect()] == [(0, 1), (1, 2), (2, 0)]
    assert [r.i for r in bake.chunk_order(spark.createDataFrame([(10, 1), (9, 2), (-3, 0), (9, 1)], "i int, j int")).collect()] == [-3, 9, 9, 10]


def test_source_timestamp(spark):
    stamp = lambda header: spark.range(1).select(geojson.source_timestamp(header, F.lit("2020-01-02 03:04:05").cast("timestamp"))).first()[0]
    assert stamp(" 2024-01-01T00:00:00Z\n") == "2024-01-01T00:00:00Z" and stamp("  ") == stamp(None) == "2020-01-02T03:04:05Z"
