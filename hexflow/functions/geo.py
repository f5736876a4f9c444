"""Geography as column expressions: degrees, haversine and a hexagonal grid.

The grid is a local equirectangular projection around the city centre with pointy-top hexagons in
axial coordinates; a cell's id is ``r<resolution>:<q>:<r>``.  Its ids are its own, not those of any
global grid.  Every level up or down changes the cell area by a factor of seven.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
CENTRE = (29.0729, -110.9559)
KM_PER_DEGREE_LON = 97.0
AREA_KM2 = 0.737
BASE_RESOLUTION = 8


def cell_area_km2(resolution: int = BASE_RESOLUTION) -> float:
    return AREA_KM2 * 7.0 ** (BASE_RESOLUTION - resolution)


def edge_km(resolution: int = BASE_RESOLUTION) -> float:
    """Edge of a hexagon of the level's area, to four digits."""
    return round(math.sqrt(2 * cell_area_km2(resolution) / (3 * math.sqrt(3))), 4)


def km_to_degrees_lat(km: Column) -> Column:
    return km / F.lit(KM_PER_DEGREE)


def km_to_degrees_lon(km: Column, lat: Column) -> Column:
    return km / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, 0.0 * a + 1.0)))  # against a plain 1 a null would be 1


def _round(v: Column) -> Column:
    return F.floor(v + 0.5)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the optimiser would write it out at every place that names it."""
    return F.transform(F.array(value), body)[0]


def hex_cell(lat: Column, lon: Column, resolution: int = BASE_RESOLUTION) -> Column:
    """Id of the cell that holds a point; null for a null coordinate."""
    s = F.lit(edge_km(resolution))
    x = (lon - F.lit(CENTRE[1])) * KM_PER_DEGREE_LON
    y = (lat - F.lit(CENTRE[0])) * KM_PER_DEGREE
    axial = F.struct(((F.lit(math.sqrt(3) / 3) * x - y / 3.0) / s).alias("qf"), ((F.lit(2.0 / 3.0) * y) / s).alias("rf"))

    def rounded(p: Column) -> Column:
        q, r, z = _round(p["qf"]), _round(p["rf"]), _round(-p["qf"] - p["rf"])  # "dz" in this order of additions decides points on an edge
        return F.struct(q.alias("q"), r.alias("r"), z.alias("z"), F.abs(q - p["qf"]).alias("dq"), F.abs(r - p["rf"]).alias("dr"), F.abs(z + p["qf"] + p["rf"]).alias("dz"))

    def named(c: Column) -> Column:
        q_off = (c["dq"] > c["dr"]) & (c["dq"] > c["dz"])
        q = F.when(q_off, -c["r"] - c["z"]).otherwise(c["q"])
        r = F.when(~q_off & (c["dr"] > c["dz"]), -c["q"] - c["z"]).otherwise(c["r"])
        return F.concat(F.lit(f"r{resolution}:"), q.cast("long").cast("string"), F.lit(":"), r.cast("long").cast("string"))

    return _let(_let(axial, rounded), named)


def hex_centroid(cell: Column) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre, from its id alone."""
    parts = F.split(cell, ":")
    q, r = parts[1].cast("double"), parts[2].cast("double")
    level = F.substring(parts[0], 2, 2).cast("int")
    s = F.element_at(F.array(*[F.lit(edge_km(k)) for k in range(16)]), level + 1)
    x, y = s * F.lit(math.sqrt(3)) * (q + r / 2.0), F.lit(1.5) * s * r
    return F.lit(CENTRE[0]) + y / KM_PER_DEGREE, F.lit(CENTRE[1]) + x / KM_PER_DEGREE_LON
