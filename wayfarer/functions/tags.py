"""Tag values as numbers and flags. Numbers are read from the front of the text, as in "4.5 m"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_prefix(tag: Column) -> Column:
    return F.regexp_extract(tag, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def int_prefix(tag: Column) -> Column:
    return F.regexp_extract(tag, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def oneway(tag: Column) -> Column:
    return F.when(tag.isin("yes", "1", "true"), 1).when(tag.isin("-1", "reverse"), -1).otherwise(0)


def bridge(tag: Column) -> Column:
    return F.coalesce(tag != "no", F.lit(False))


def layer(tag: Column, is_bridge: Column) -> Column:
    return F.coalesce(int_prefix(tag), F.when(is_bridge, 1).otherwise(0))


def lanes(tag: Column) -> Column:
    return F.coalesce(F.nullif(int_prefix(tag), F.lit(0)), F.lit(1))


def road_width(tag: Column, class_width: Column) -> Column:
    """The tagged width if it is plausible (1 to 12 metres), else the class's."""
    w = float_prefix(tag)
    return F.when(w.between(1, 12), w).otherwise(class_width)
