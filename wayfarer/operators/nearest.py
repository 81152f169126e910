"""Exact nearest segment within a radius, in stages of growing reach.

A stage knows the segments by small cells and the points by blocks of such cells, a block being as
wide as the reach, so nine blocks hold all that a point may find. The occupied cells alone bound how
far the nearest segment can lie; the segments of the cells within that bound give the distance, and
those at that very distance the least segment. A point that finds none goes on to the next stage.
What is read more than once is stored, and nothing else: no plan holds another stage's, the driver
plans few of them, and no table is sent to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import collected, remove, stored

SHOULDER = 1.5
#: Cells to a block's side at most; more than rounding can move a point, in metres.
FINE, SLACK = 16, 1e-6


def covering(segments: DataFrame, cell: float) -> DataFrame:
    """Segments by each cell that their bounding box touches; holds where they surely have a point in it. Long ones are cut for indexing alone, so a diagonal doesn't fill its box; a cell may come twice."""
    length = geo.hypot(F.col("bx") - F.col("ax"), F.col("bz") - F.col("az"))
    n = F.greatest(F.lit(1), F.ceil(length / cell)).cast("int")
    part = segments.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    lo = lambda a, b: geo.cell_of(F.least(at(a, b, F.col("_k")), at(a, b, F.col("_k") + 1)) - SLACK, cell)
    hi = lambda a, b: geo.cell_of(F.greatest(at(a, b, F.col("_k")), at(a, b, F.col("_k") + 1)) + SLACK, cell)
    cells = part.withColumn("ci", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("cj", F.explode(F.sequence(lo("az", "bz"), hi("az", "bz"))))
    begins = lambda a, b: geo.cell_of(at(a, b, F.col("_k")), cell)
    return cells.withColumn("holds", (F.col("ci") == begins("ax", "bx")) & (F.col("cj") == begins("az", "bz"))).drop("_n", "_k")


def _gap(p: str, c: str, cell: float) -> Column:
    """How far a point is outside a cell, along one axis."""
    return F.greatest(F.col(c) * cell - F.col(p), F.lit(0.0), F.col(p) - (F.col(c) + 1) * cell)


def _across(p: str, c: str, cell: float) -> Column:
    """How far the cell's other side is."""
    return F.greatest(F.abs(F.col(p) - F.col(c) * cell), F.abs((F.col(c) + 1) * cell - F.col(p)))


def _around(points: DataFrame, width: float, names: tuple[str, str]) -> DataFrame:
    """points by the nine squares around each."""
    for p, c in zip(("px", "pz"), names):
        points = points.withColumn(c, F.explode(F.expr(f"transform(array(-1, 0, 1), d -> cast(floor({p} / {width}D) + d as int))")))
    return points


def _cells(points: DataFrame, occupied: DataFrame | None, cell: float, block: int) -> DataFrame:
    """points by the occupied cells, or all cells where they are as wide as the reach, that begin within each point's limit."""
    if occupied is None:
        near = _around(points, cell, ("ci", "cj"))
    else:
        near = _around(points, cell * block, ("gi", "gj")).join(occupied.hint("merge"), ["gi", "gj"]).drop("gi", "gj")
    return near.filter(geo.hypot(_gap("px", "ci", cell), _gap("pz", "cj", cell)) <= F.col("limit") + SLACK)


def _stage(points: DataFrame, segments: DataFrame, reach: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """points, stored, with the distance of the nearest segment within reach as limit, null where there is none; the results of those that have one."""
    block, known = math.ceil(reach / cell), covering(segments, cell)
    limited, occupied = points.withColumn("limit", F.lit(float(reach))), None
    if block > 1:
        occupied = known.groupBy("ci", "cj").agg(F.max("holds").alias("holds"))
        occupied = stored(occupied.withColumns({"gi": F.floor(F.col("ci") / block).cast("int"), "gj": F.floor(F.col("cj") / block).cast("int")}), "cells")
        most = F.min(F.when(F.col("holds"), geo.hypot(_across("px", "ci", cell), _across("pz", "cj", cell))))
        bound = _cells(limited, occupied, cell, block).groupBy("point_id").agg(F.least(F.lit(float(reach)), most).alias("limit"))
        limited, occupied = points.join(bound.hint("merge"), "point_id"), occupied.drop("holds")
    known = known.drop("holds")
    d = geo.point_to_segment(*(F.col(c) for c in ("px", "pz", "ax", "az", "bx", "bz")))
    met = lambda of: _cells(of, occupied, cell, block).join(known.hint("merge"), ["ci", "cj"]).withColumn("d", d)
    # the distance by itself first: one number a point, so that pairs are neither sorted nor spilled
    best = met(limited).filter(F.col("d.distance") <= reach).groupBy("point_id").agg(F.min("d.distance").alias("limit"))
    reached = stored(points.join(best.hint("merge"), "point_id", "left"), "reached")
    at_best = met(reached.filter("limit is not null")).filter(F.col("d.distance") <= F.col("limit"))
    s = at_best.groupBy("point_id").agg(F.min_by(F.struct("segment_id", "width", "d", "ax", "az", "bx", "bz"), "segment_id").alias("s"))
    return reached, s.select("point_id", "s.segment_id", "s.d.distance", "s.d.x", "s.d.z", geo.heading(F.col("s.ax"), F.col("s.az"), F.col("s.bx"), F.col("s.bz")).alias("heading"), (F.col("s.d.distance") <= F.col("s.width") / 2 + SHOULDER).alias("on_road"))


def nearest(points: DataFrame, segments: DataFrame, radius: float, stages: tuple[float, ...] = (10.0, 40.0, 160.0, 800.0)) -> DataFrame:
    """point_id, segment_id, distance, x, z, heading, on_road of the nearest segment within radius; ties go to the least segment_id.

    points: point_id, px, pz. segments: segment_id, width, ax, az, bx, bz.
    """
    spark, segments = points.sparkSession, segments.select("segment_id", "width", "ax", "az", "bx", "bz")
    out, left, scratch, reaches = None, points.select("point_id", "px", "pz"), [], [*(s for s in stages if s < radius), radius]
    for reach in reaches:
        with collected() as made:
            reached, found = _stage(left, segments, reach, max(reaches[0], reach / FINE))
        found = stored(found, "nearest")
        out = found if out is None else out.unionByName(found)
        remove(spark, [*scratch, *made[:-1]])
        left, scratch = reached.filter("limit is null").drop("limit"), made[-1:]  # reached is the last that the stage stores
        if reach < radius and left.isEmpty():
            break
    remove(spark, scratch)
    return out
