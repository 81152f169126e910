"""A deterministic road network over the shared test tables, the same in Spark and in the SQL of the oracle.

A way is an order, its nodes are the order's line items, tags follow from the order's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import ROAD_CLASSES
from ..operators import ways as W

HIGHWAYS = [c[0] for c in ROAD_CLASSES] + ["proposed", "construction", "raceway", "corridor"]
WIDTHS = ["5", "4.5 m", "0.5", "15", "abc", None, "", "2.75"]
SURFACES = ["asphalt", "gravel", "dirt", None, "paving_stones", "cobblestone", "", "ground", "concrete", None, "unpaved"]


def _case(expr: str, values: list) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


#: Both dialects read these.
TAGS = f"""SELECT o_orderkey AS way_id, {_case('o_orderkey % 24', HIGHWAYS)} AS highway, {_case('o_orderkey % 8', WIDTHS)} AS width_tag, {_case('o_orderkey % 11', SURFACES)} AS surface_tag,
 CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN '-1' ELSE 'no' END AS oneway_tag, CASE WHEN o_orderkey % 37 = 5 THEN 'yes' END AS area_tag,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS name, CASE o_orderkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '2;3' WHEN 2 THEN '0' END AS lanes_tag,
 CASE o_orderkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS bridge_tag, CASE o_orderkey % 13 WHEN 0 THEN '2' WHEN 1 THEN 'x' END AS layer_tag FROM {{orders}}"""
NODES = """SELECT l_orderkey AS way_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS seq,
 l_partkey * 100000 + l_suppkey AS node_id FROM {lineitem}"""
PLACED = """SELECT way_id, seq, node_id, (node_id % 9973) * 0.5E0 AS x, (node_id % 9967) * 0.5E0 AS z, 115.0E0 + (node_id % 9973) * 1E-5 AS lon, -8.7E0 + (node_id % 9967) * 1E-5 AS lat FROM ({nodes})"""
SEGMENTS = """SELECT p_partkey AS segment_id, (p_partkey * 37 % 4001) * 1E0 AS ax, (p_partkey * 101 % 4003) * 1E0 AS az, (p_partkey * 37 % 4001) + (p_partkey % 61 - 30) * 1E0 AS bx, (p_partkey * 101 % 4003) + (p_partkey % 53 - 26) * 1E0 AS bz, 3E0 + p_partkey % 5 AS width,
 """ + _case("p_partkey % 11", ["asphalt", "gravel", "sand", "paved", "dirt", "cobbles", "steps", "concrete", "paving_stones", "unpaved"]) + """ AS surface, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS name FROM {part}"""
PROBES = """SELECT c_custkey AS point_id, (c_custkey * 59 % 4507) * 1E0 - 250 AS px, (c_custkey * 83 % 4513) * 1E0 - 250 AS pz FROM {customer}"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def way_tags(spark, sf_dir) -> DataFrame:
    t = spark.sql(TAGS, orders=_table(spark, sf_dir, "orders"))
    pairs = {"highway": "highway", "width": "width_tag", "surface": "surface_tag", "oneway": "oneway_tag", "area": "area_tag", "name": "name", "lanes": "lanes_tag", "bridge": "bridge_tag", "layer": "layer_tag"}
    tags = F.map_filter(F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
    return t.select("way_id", tags.alias("tags"))


def points(spark, sf_dir) -> DataFrame:
    return spark.sql(PLACED.replace("({nodes})", "{nodes}"), nodes=spark.sql(NODES, lineitem=_table(spark, sf_dir, "lineitem")))


def road_ways(spark, sf_dir) -> DataFrame:
    sizes = points(spark, sf_dir).groupBy("way_id").agg(F.count("*").alias("n_points"))
    return W.road_ways(way_tags(spark, sf_dir).join(sizes, "way_id"))


def road_segments(spark, sf_dir) -> DataFrame:
    return spark.sql(SEGMENTS, part=_table(spark, sf_dir, "part"))


def probes(spark, sf_dir) -> DataFrame:
    return spark.sql(PROBES, customer=_table(spark, sf_dir, "customer"))


def r3(c):
    """To three places, halves up: the same arithmetic in either engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1000 + 0.5) / 1000.0


# ---- the oracle's building blocks

_DIM = "(VALUES " + ", ".join(f"('{c}', {w}E0, {r}, {str(p).lower()})" for c, w, r, p in ROAD_CLASSES) + ") AS dim(cls, class_width, rank, is_path)"
_W = "TRY_CAST(regexp_extract(width_tag, '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE)"
_I = "TRY_CAST(regexp_extract({}, '^\\s*([+-]?[0-9]+)', 1) AS INT)"
_BRIDGE = "coalesce(bridge_tag <> 'no', false)"
SQL = {
    "tags": TAGS.format(orders="orders"),
    "pts": PLACED.format(nodes=NODES.format(lineitem="lineitem")),
    "roads": f"""SELECT way_id, cls, rank, is_path, CASE WHEN {_W} BETWEEN 1 AND 12 THEN {_W} ELSE class_width END AS width,
 CASE WHEN surface_tag IN ('asphalt','paved','paving_stones','concrete','unpaved','gravel','dirt','ground') THEN surface_tag WHEN rank <= 5 THEN 'asphalt' WHEN rank <= 8 THEN 'paving_stones' ELSE 'unpaved' END AS surface,
 CASE WHEN oneway_tag IN ('yes','1','true') THEN 1 WHEN oneway_tag IN ('-1','reverse') THEN -1 ELSE 0 END AS oneway, coalesce(nullif({_I.format('lanes_tag')}, 0), 1) AS lanes, name, {_BRIDGE} AS bridge,
 coalesce({_I.format('layer_tag')}, CASE WHEN {_BRIDGE} THEN 1 ELSE 0 END) AS layer
 FROM tags JOIN {_DIM} ON highway = cls JOIN (SELECT way_id, count(*) AS n FROM pts GROUP BY 1) USING (way_id) WHERE coalesce(area_tag, '') <> 'yes' AND n >= 2""",
    "uses": "SELECT node_id, count(DISTINCT way_id) AS n_ways FROM pts JOIN roads USING (way_id) WHERE NOT is_path GROUP BY 1",
    "cuts": """SELECT pts.*, is_path, coalesce(n_ways, 0) > 1 AND NOT is_path AND seq > 0 AND seq < max(seq) OVER (PARTITION BY way_id) AS cut FROM pts JOIN roads USING (way_id) LEFT JOIN uses USING (node_id)""",
    "numbered": "SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY way_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS e FROM cuts",
    "ep": "SELECT way_id, is_path, e AS edge_seq, seq, node_id, x, z FROM numbered UNION ALL SELECT way_id, is_path, e + 1, seq, node_id, x, z FROM numbered WHERE cut",
    "segs": """SELECT * FROM (SELECT way_id, is_path, edge_seq, seq AS seg, node_id AS from_id, x AS ax, z AS az, lead(node_id) OVER w AS to_id, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM ep WINDOW w AS (PARTITION BY way_id, edge_seq ORDER BY seq)) WHERE to_id IS NOT NULL""",
    "crossed": """SELECT *, list_sort(list_filter(list_concat(
 list_transform(range(floor(least(ax, bx) / 1000)::BIGINT + 1, ceil(greatest(ax, bx) / 1000)::BIGINT), lambda k: (k * 1000 - ax) / (bx - ax)),
 list_transform(range(floor(least(az, bz) / 1000)::BIGINT + 1, ceil(greatest(az, bz) / 1000)::BIGINT), lambda k: (k * 1000 - az) / (bz - az))), lambda t: t > 1e-6 AND t < 1 - 1e-6)) AS ts FROM segs""",
    "counted": """SELECT *, coalesce(sum(len(ts)) OVER (PARTITION BY way_id ORDER BY edge_seq, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
 coalesce(sum(len(ts)) OVER (PARTITION BY way_id, edge_seq ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS within, list_concat([0::DOUBLE], ts, [1::DOUBLE]) AS stops FROM crossed""",
    "opened": "SELECT *, unnest(range(0, len(ts) + 1)) AS k FROM counted",
    "parts0": """SELECT way_id, is_path, edge_seq, within + k AS piece_seq, seg, k, CASE WHEN k = 0 THEN from_id ELSE -(way_id * 1024 + before + k - 1) END AS from_id, CASE WHEN k = len(ts) THEN to_id ELSE -(way_id * 1024 + before + k) END AS to_id,
 CASE WHEN k = 0 THEN ax ELSE ax + (bx - ax) * stops[k + 1] END AS ax, CASE WHEN k = 0 THEN az ELSE az + (bz - az) * stops[k + 1] END AS az, CASE WHEN k = len(ts) THEN bx ELSE ax + (bx - ax) * stops[k + 2] END AS bx, CASE WHEN k = len(ts) THEN bz ELSE az + (bz - az) * stops[k + 2] END AS bz FROM opened""",
    "parts": """SELECT *, row_number() OVER w AS part, floor((first_value(ax) OVER w + first_value(bx) OVER w) / 2 / 1000)::INT AS i, floor((first_value(az) OVER w + first_value(bz) OVER w) / 2 / 1000)::INT AS j FROM parts0 WINDOW w AS (PARTITION BY way_id, edge_seq, piece_seq ORDER BY seg, k)""",
    "pieces": """SELECT way_id, is_path, edge_seq, piece_seq, i, j, arg_min(from_id, part) AS from_id, arg_max(to_id, part) AS to_id, arg_min(ax, part) AS sx, arg_min(az, part) AS sz, arg_max(bx, part) AS ex, arg_max(bz, part) AS ez, count(*) + 1 AS n_points, sum(sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az))) AS length FROM parts GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY way_id, is_path, edge_seq, piece_seq, i, j"),
    "ends": "SELECT i, j, from_id AS node_id, sx AS x, sz AS z, way_id, edge_seq, piece_seq, 0 AS e FROM pieces WHERE NOT is_path UNION ALL SELECT i, j, to_id, ex, ez, way_id, edge_seq, piece_seq, 1 FROM pieces WHERE NOT is_path",
    "cnodes": "SELECT i, j, node_id, count(*) AS degree, arg_min(x, (way_id, edge_seq, piece_seq, e)) AS x, arg_min(z, (way_id, edge_seq, piece_seq, e)) AS z FROM ends GROUP BY 1, 2, 3",
    "rsegs": SEGMENTS.format(part="part"),
    "probes": PROBES.format(customer="customer"),
}


def oracle(select: str, *upto: str) -> str:
    """select over the building blocks, as far as the last one named."""
    names = list(SQL)
    graph = names[: max(names.index(u) for u in upto) + 1]
    keep = graph if upto[-1] not in ("rsegs", "probes") else ["rsegs", "probes"]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in keep) + "\n" + select
