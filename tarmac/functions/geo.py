"""WGS84 geodesics and local metres as column expressions.

The inverse problem is solved by a fixed number of iterations for the difference
in longitude on the auxiliary sphere, folded over a sequence so that the state
is bound once a step. Antipodal pairs, which don't occur on roads, are not handled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, B = 6378137.0, 6356752.314245179
FLATTENING = 1 / 298.257223563
EARTH_RADIUS = 6371000.0
METRES_LON, METRES_LAT = 111320.0, 110540.0
ITERATIONS = 12


def _sphere(lam: Column, v: Column) -> dict[str, Column]:
    cu = v["cu1"] * v["cu2"]
    sin_s = F.sqrt(F.pow(v["cu2"] * F.sin(lam), 2) + F.pow(v["cu1"] * v["su2"] - v["su1"] * v["cu2"] * F.cos(lam), 2))
    cos_s = v["su1"] * v["su2"] + cu * F.cos(lam)
    sin_a = F.coalesce(F.try_divide(cu * F.sin(lam), sin_s), F.lit(0.0))
    return {"sin_s": sin_s, "cos_s": cos_s, "sin_a": sin_a}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct of distance (metres) and azimuth (radians clockwise from north, in [-pi, pi]); 0 and 0 for one point."""
    f = FLATTENING
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2)))
    start = F.struct(
        F.sin(u1).alias("su1"), F.cos(u1).alias("cu1"), F.sin(u2).alias("su2"), F.cos(u2).alias("cu2"),
        (F.radians(lon2) - F.radians(lon1)).alias("l"),
    )

    def step(lam: Column, v: Column) -> Column:
        s = F.struct(*(c.alias(k) for k, c in _sphere(lam, v).items()))

        def next_lam(s: Column) -> Column:
            sigma = F.atan2(s["sin_s"], s["cos_s"])
            cos2a = 1 - s["sin_a"] * s["sin_a"]
            cos2m = F.coalesce(s["cos_s"] - F.try_divide(2 * v["su1"] * v["su2"], cos2a), F.lit(0.0))
            c = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
            return v["l"] + (1 - c) * f * s["sin_a"] * (sigma + c * s["sin_s"] * (cos2m + c * s["cos_s"] * (2 * cos2m * cos2m - 1)))

        return _let(s, next_lam)

    def solved(v: Column) -> Column:
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), v["l"], lambda x, _: step(x, v))

        def result(lam: Column) -> Column:
            s = F.struct(*(c.alias(k) for k, c in _sphere(lam, v).items()))

            def distance(s: Column) -> Column:
                sigma = F.atan2(s["sin_s"], s["cos_s"])
                cos2a = 1 - s["sin_a"] * s["sin_a"]
                cos2m = F.coalesce(s["cos_s"] - F.try_divide(2 * v["su1"] * v["su2"], cos2a), F.lit(0.0))
                uu = cos2a * ((A * A - B * B) / (B * B))
                big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
                big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
                first = s["cos_s"] * (2 * cos2m * cos2m - 1)
                second = big_b / 6 * cos2m * (4 * s["sin_s"] * s["sin_s"] - 3) * (4 * cos2m * cos2m - 3)
                correction = big_b * s["sin_s"] * (cos2m + big_b / 4 * (first - second))
                azimuth = F.atan2(v["cu2"] * F.sin(lam), v["cu1"] * v["su2"] - v["su1"] * v["cu2"] * F.cos(lam))
                return F.struct((B * big_a * (sigma - correction)).alias("distance"), azimuth.alias("azimuth"))

            return _let(s, distance)

        return _let(lam, result)

    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    same = (lat1 == lat2) & (lon1 == lon2)
    zero = F.struct(F.lit(0.0).alias("distance"), F.lit(0.0).alias("azimuth"))
    return F.when(known & same, zero).when(known, _let(start, solved))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return inverse(lat1, lon1, lat2, lon2)["distance"]


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return inverse(lat1, lon1, lat2, lon2)["azimuth"]


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere, the meridian's scale taken at the second point."""
    north = F.radians(lat2 - lat1)
    east = F.radians(lon2 - lon1) * F.cos(F.radians(lat2))
    return EARTH_RADIUS * F.sqrt(north * north + east * east)


def local_scale(lat: Column, lon: Column) -> Column:
    """Struct of metres per degree north and east at a point, from geodesics of 1e-4 degrees."""
    d = 1e-4
    return F.struct((distance(lat, lon, lat + d, lon) / d).alias("north"), (distance(lat, lon, lat, lon + d) / d).alias("east"))


def segment(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Struct of distance (metres) from a point to a segment and the nearest point's fraction along it."""
    mx, my = METRES_LON * F.cos(F.radians(lat)), F.lit(METRES_LAT)
    v = F.struct(((lon1 - lon) * mx).alias("x1"), ((lat1 - lat) * my).alias("y1"), ((lon2 - lon1) * mx).alias("dx"), ((lat2 - lat1) * my).alias("dy"))

    def foot(v: Column) -> Column:
        f = F.coalesce(F.try_divide(-(v["x1"] * v["dx"] + v["y1"] * v["dy"]), v["dx"] * v["dx"] + v["dy"] * v["dy"]), F.lit(0.0))
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))
        return _let(clipped, lambda t: F.struct(F.hypot(v["x1"] + t * v["dx"], v["y1"] + t * v["dy"]).alias("distance"), t.alias("fraction")))

    return _let(v, foot)


def padded_box(south: Column, west: Column, north: Column, east: Column, km: float) -> tuple[Column, Column, Column, Column]:
    """A box widened by ``km`` on every side, 111.32 km to the degree."""
    dlat = km / 111.32
    dlon = F.try_divide(F.lit(dlat), F.greatest(F.cos(F.radians((south + north) / 2)), F.lit(math.cos(math.radians(89.9)))))
    return south - dlat, west - dlon, north + dlat, east + dlon


def box_contains(box: tuple, lat: Column, lon: Column) -> Column:
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def boxes_meet(a: tuple, b: tuple) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
