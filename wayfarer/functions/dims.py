"""Small dimension tables. They must equal the published ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: class, default width in metres, rank, whether a path
ROAD_CLASSES = [
    ("motorway", 12.0, 0, False), ("motorway_link", 7.0, 0, False), ("trunk", 8.0, 1, False), ("trunk_link", 6.0, 1, False),
    ("primary", 6.0, 2, False), ("primary_link", 5.0, 2, False), ("secondary", 5.5, 3, False), ("secondary_link", 4.5, 3, False),
    ("tertiary", 4.5, 4, False), ("tertiary_link", 4.0, 4, False), ("unclassified", 4.0, 5, False), ("residential", 3.5, 6, False),
    ("living_street", 2.2, 7, False), ("service", 2.5, 8, False), ("track", 2.5, 9, False), ("pedestrian", 3.0, 10, True),
    ("cycleway", 1.5, 11, True), ("path", 1.5, 12, True), ("footway", 1.2, 13, True), ("steps", 1.2, 14, True),
]
DROPPED_CLASSES = ["proposed", "construction", "raceway"]
#: surface, packed RGB
PALETTE = [("asphalt", 0x5A5651), ("paved", 0x6A6660), ("paving_stones", 0x8A8478), ("concrete", 0x8D8A82), ("unpaved", 0x9C8560), ("gravel", 0x9A9184), ("dirt", 0x8E7350), ("ground", 0x8E7350)]
#: surface, share of top speed, wobble
RIDE_SURFACES = [
    ("asphalt", 1.0, 0.0), ("paved", 1.0, 0.0), ("concrete", 1.0, 0.0), ("paving_stones", 0.85, 0.05), ("gravel", 0.6, 0.14),
    ("unpaved", 0.6, 0.12), ("dirt", 0.6, 0.12), ("ground", 0.6, 0.12), ("grass", 0.35, 0.1), ("paddy", 0.35, 0.16),
    ("sand", 0.25, 0.4), ("steps", 0.06, 0.35), ("shallow_water", 0.04, 0.08),
]
FALLBACK_SURFACE = "unpaved"
EXPORTED_TAGS = ["highway", "name", "surface", "oneway", "lanes", "width", "bridge", "tunnel", "layer", "junction", "area", "ref"]
INVENTORY_TAGS = ["name", "surface", "oneway", "lanes", "width", "maxspeed", "bridge", "tunnel", "lit", "access", "motorcycle", "motor_vehicle", "junction", "smoothness", "layer", "ref"]
#: What the inventory's export keeps beside them: eighteen tags in all.
EXTRA_TAGS = ["maxspeed", "lit", "access", "motorcycle", "motor_vehicle", "smoothness"]
#: The ride model, in metres, seconds and radians. Motion:
TOP_SPEED, REVERSE_SPEED, WALK, TICK = 25.0, 1.5, 1.5, 0.05
DRIVE, REVERSE_DRIVE, BRAKES, HARD_BRAKES = 5.0, 2.0, 12.0, 20.0
CORNERING, TIGHTEST, GRAVITY, MOST_LEAN, LEAN_LAG, WOBBLE_RATE = 6.0, 1.6, 9.81, 0.6, 6.0, 9.0
#: Camera:
BOOM, BOOM_PULL, BOOM_HEIGHT, BOOM_TILT, FOV, FOV_PULL = 6.0, 2.5, 2.5, -0.13, 60.0, 14.0
CAMERA_LAG, BOOM_LAG, LOOK_LAG, SHAKE_LAG = 7.0, 3.5, 4.0, 4.0
ROLL_SHARE, SHAKE_RATE, SHAKE_ROLL, SHAKE_LIFT = 0.35, 34.0, 0.09, 0.25
#: Roads and chunks:
ROAD_REACH, RESET_REACH, ROAD_MARGIN, DEFAULT_LAND = 40.0, 800.0, 1.5, "grass"
CHUNK, REBASE, BYTE_BUDGET = 1000, 2000.0, 300_000_000


def class_dim(spark: SparkSession) -> DataFrame:
    """Twenty rows, so it may be broadcast at any size of the data."""
    return F.broadcast(spark.createDataFrame(ROAD_CLASSES, "cls string, class_width double, rank int, is_path boolean"))


def lookup(pairs, key: Column) -> Column:
    """The value of a key in a short fixed list, null if it has none."""
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[key]


def road_surface(tag: Column, rank: Column) -> Column:
    """A known surface as tagged, else one by the rank of the class."""
    by_rank = F.when(rank <= 5, "asphalt").when(rank <= 8, "paving_stones").otherwise("unpaved")
    return F.when(tag.isin([s for s, _ in PALETTE]), tag).otherwise(by_rank)


def road_colour(surface: Column) -> Column:
    return lookup(PALETTE, surface)


def rgb(colour: Column) -> Column:
    return F.array(*[F.shiftright(colour, s).bitwiseAND(255) for s in (16, 8, 0)])


def linear_colour(byte: Column) -> Column:
    """A channel of sRGB in linear light, again as a byte."""
    c = byte / 255.0
    return F.round(255.0 * F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))).cast("int")


def road_height(rank: Column) -> Column:
    """Metres above ground; lesser classes lie lower, so overlaps don't flicker."""
    return F.lit(0.02) + (F.lit(14) - rank) * 0.004


def marking_style(rank: Column) -> Column:
    """centre (solid, dashed, none) and edges, by rank, so that links look like their parents."""
    centre = F.when(rank > 4, "none").when(rank == 0, "solid").otherwise("dashed")
    return F.struct(centre.alias("centre"), (rank <= 1).alias("edges"))


def surface_of(name: Column) -> Column:
    """cap and wobble; an unknown surface rides like the fallback."""
    known = F.when(name.isin([s for s, _, _ in RIDE_SURFACES]), name).otherwise(FALLBACK_SURFACE)
    return F.struct(lookup([(s, c) for s, c, _ in RIDE_SURFACES], known).alias("cap"), lookup([(s, w) for s, _, w in RIDE_SURFACES], known).alias("wobble"))


def top_speed_on(name: Column) -> Column:
    return surface_of(name)["cap"] * TOP_SPEED
