"""Column expressions: distances, search boxes, curves, projection, raster arithmetic, flow codes.

All are built-in functions, so they stay inside code generation and cost no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of a degree, and the ellipsoid and polynomial of the Equal Earth projection.
METRES_LAT, METRES_LON = 110_540.0, 111_320.0
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563
EQUAL_EARTH = (1.340264, -0.081106, 0.000893, 0.003796)
#: The largest longitude and latitude of the globe.
LIMITS = (180.0, 90.0)
#: Flow directions by name: (row step, column step); north is one row up.
STEPS = {"E": (0, 1), "SE": (1, 1), "S": (1, 0), "SW": (1, -1), "W": (0, -1), "NW": (-1, -1), "N": (-1, 0), "NE": (-1, 1)}
#: Codes of each encoding. GRASS counts counter-clockwise from north-east.
ENCODINGS = {
    "esri": {1: "E", 2: "SE", 4: "S", 8: "SW", 16: "W", 32: "NW", 64: "N", 128: "NE"},
    "taudem": {1: "E", 2: "NE", 3: "N", 4: "NW", 5: "W", 6: "SW", 7: "S", 8: "SE"},
    "grass": {1: "NE", 2: "N", 3: "NW", 4: "W", 5: "SW", 6: "S", 7: "SE", 8: "E"},
}


def search_bbox(lon: Column, lat: Column, radius_m: float | Column, limits: tuple[float, float] = LIMITS) -> Column:
    """Struct of 32-bit bounds around a point, cut at ``limits`` (of longitude and latitude); no wrap at the antimeridian."""
    radius = F.lit(radius_m) if isinstance(radius_m, float | int) else radius_m
    dlat = radius / F.lit(METRES_LAT)
    dlon = radius / (F.lit(METRES_LON) * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-10)))
    clamp = lambda v, most: F.greatest(F.least(v, F.lit(most)), F.lit(-most)).cast("float")
    return F.struct(
        clamp(lon - dlon, limits[0]).alias("xmin"), clamp(lat - dlat, limits[1]).alias("ymin"), clamp(lon + dlon, limits[0]).alias("xmax"), clamp(lat + dlat, limits[1]).alias("ymax")
    )


def local_metres(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Equirectangular distance at the mean latitude."""
    dx = (lon_b - lon_a) * F.lit(METRES_LON) * F.cos(F.radians((lat_a + lat_b) / 2))
    dy = (lat_b - lat_a) * F.lit(METRES_LAT)
    return F.sqrt(dx * dx + dy * dy)


def nearest_on_line(x: Column, y: Column, points: Column) -> Column:
    """Struct (x, y): the point of a line (array of structs x, y; one element is a point) that is nearest in plane degrees; null of none."""
    first = F.get(points, F.lit(0))
    start = F.struct(F.lit(float("inf")).alias("d"), first["x"].alias("x"), first["y"].alias("y"))

    def step(best: Column, i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length2 = dx * dx + dy * dy
        part = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / length2))).otherwise(F.lit(0.0))
        px, py = a["x"] + part * dx, a["y"] + part * dy
        d = (px - x) * (px - x) + (py - y) * (py - y)
        return F.when(d < best["d"], F.struct(d.alias("d"), px.alias("x"), py.alias("y"))).otherwise(best)

    segments = F.when(F.size(points) > 1, F.sequence(F.lit(1), F.size(points) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(points) > 0, F.aggregate(segments, start, step, lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"))))


def bbox_intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Inclusive overlap of two rectangles given as xmin, ymin, xmax, ymax."""
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def _quantize(value: Column, low: float, high: float) -> Column:
    part = (F.greatest(F.least(value, F.lit(high)), F.lit(low)) - F.lit(low)) / F.lit(high - low)
    return F.floor(part * 65535.0 + 0.5).cast("long")


def _spread(v: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_key(x: Column, y: Column, wrap: bool = False) -> Column:
    """16 bits an axis, both axes scaled as (v + 180) / 360. What lies off the globe is put on its edge, or with ``wrap`` keeps the low 16 bits of its place."""
    if wrap:
        place = lambda v: F.floor((v + F.lit(180.0)) / F.lit(360.0) * 65535.0 + 0.5).cast("long").bitwiseAND(F.lit(0xFFFF).cast("long"))
    else:
        place = lambda v: _quantize(v, -180.0, 180.0)
    return _spread(place(x)).bitwiseOR(F.shiftleft(_spread(place(y)), 1))


def hilbert_index(lon: Column, lat: Column) -> Column:
    """16 bits an axis over the whole globe; quadrants are visited south-west, north-west, north-east, south-east."""
    start = F.struct(_quantize(lon, -180.0, 180.0).alias("x"), _quantize(lat, -90.0, 90.0).alias("y"), F.lit(0).cast("long").alias("i"))

    def step(s: Column, half: Column) -> Column:
        west, south = s["x"] < half, s["y"] < half
        x, y = s["x"], s["y"]
        area = half * half
        return F.struct(
            F.when(west & south, y).when(west, x).when(~south, x - half).otherwise(half - 1 - y).alias("x"),
            F.when(west & south, x).when(west, y - half).when(~south, y - half).otherwise(half - 1 - (x - half)).alias("y"),
            (s["i"] + F.when(west & south, F.lit(0)).when(west, area).when(~south, 2 * area).otherwise(3 * area)).cast("long").alias("i"),
        )

    halves = F.array(*[F.lit(1 << b).cast("long") for b in range(15, -1, -1)])
    return F.aggregate(halves, start, step, lambda s: s["i"])


def _authalic_q(sin_phi: Column | float) -> Column:
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    s = sin_phi
    return F.lit(1 - e2) * (s / (F.lit(1.0) - F.lit(e2) * s * s) + F.atanh(F.lit(e) * s) / F.lit(e))


def _q_pole() -> float:
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    return (1 - e2) * (1 / (1 - e2) + math.atanh(e) / e)


def equal_earth(lon: Column, lat: Column) -> Column:
    """Struct (x, y) in metres of the Equal Earth projection on WGS 84."""
    a1, a2, a3, a4 = EQUAL_EARTH
    m, radius = math.sqrt(3) / 2, SEMI_MAJOR * math.sqrt(_q_pole() / 2)
    ratio = _authalic_q(F.sin(F.radians(lat))) / F.lit(_q_pole())
    theta = F.asin(F.lit(m) * F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0)))
    t2 = theta * theta
    t6 = t2 * t2 * t2
    slope = F.lit(a1) + F.lit(3 * a2) * t2 + t6 * (F.lit(7 * a3) + F.lit(9 * a4) * t2)
    x = F.lit(radius) * F.radians(lon) * F.cos(theta) / (F.lit(m) * slope)
    y = F.lit(radius) * theta * (F.lit(a1) + F.lit(a2) * t2 + t6 * (F.lit(a3) + F.lit(a4) * t2))
    return F.struct(x.alias("x"), y.alias("y"))


def equal_earth_inverse(x: Column, y: Column) -> Column:
    """Struct (lon, lat) in degrees, by Newton's method; null outside the projection's domain."""
    a1, a2, a3, a4 = EQUAL_EARTH
    m, q_pole = math.sqrt(3) / 2, _q_pole()
    radius = SEMI_MAJOR * math.sqrt(q_pole / 2)
    top = math.pi / 3
    y_most = radius * top * (a1 + a2 * top**2 + top**6 * (a3 + a4 * top**2))
    target = y / F.lit(radius)

    def refine(t: Column, _: Column) -> Column:
        t2 = t * t
        t6 = t2 * t2 * t2
        value = t * (F.lit(a1) + F.lit(a2) * t2 + t6 * (F.lit(a3) + F.lit(a4) * t2)) - target
        return t - value / (F.lit(a1) + F.lit(3 * a2) * t2 + t6 * (F.lit(7 * a3) + F.lit(9 * a4) * t2))

    turns = F.sequence(F.lit(1), F.lit(12))
    theta = F.aggregate(turns, target / F.lit(a1), refine)
    sine = F.greatest(F.least(F.sin(theta) / F.lit(m), F.lit(1.0)), F.lit(-1.0))
    e2 = FLATTENING * (2 - FLATTENING)

    def latitude(phi: Column, _: Column) -> Column:
        s = F.sin(phi)
        residual = _authalic_q(s) - F.lit(q_pole) * sine
        den = F.lit(1.0) - F.lit(e2) * s * s
        return F.when(F.abs(F.cos(phi)) < 1e-12, phi).otherwise(phi - residual * den * den / (F.lit(2 * (1 - e2)) * F.cos(phi)))

    phi = F.aggregate(turns, F.asin(sine), latitude)
    t2 = theta * theta
    t6 = t2 * t2 * t2
    slope = F.lit(a1) + F.lit(3 * a2) * t2 + t6 * (F.lit(7 * a3) + F.lit(9 * a4) * t2)
    lam = F.lit(m / radius) * x * slope / F.cos(theta)
    inside = (F.abs(y) <= F.lit(y_most)) & (F.abs(lam) <= F.lit(math.pi + 1e-9))
    bounded = F.greatest(F.least(lam, F.lit(math.pi)), F.lit(-math.pi))
    return F.when(inside, F.struct(F.degrees(bounded).alias("lon"), F.degrees(phi).alias("lat")))


def outward_float(value: Column, up: bool) -> Column:
    """The nearest 32-bit float at or beyond ``value`` upwards (or downwards)."""
    near = value.cast("float").cast("double")
    # towards zero from a power of two steps are half as wide
    size = F.greatest(F.abs(near), F.lit(2.0**-126))
    power = F.pow(F.lit(2.0), F.floor(F.log2(size)))
    power = F.when(power > size, power / 2).when(power * 2 <= size, power * 2).otherwise(power)  # log2 rounds
    step = power * F.lit(2.0**-23)
    inward = (near > 0) if not up else (near < 0)
    step = F.when(inward & (power == F.abs(near)) & (power > F.lit(2.0**-126)), step / 2).otherwise(step)
    beyond = (near + step if up else near - step).cast("float")
    return F.when(near >= value if up else near <= value, near.cast("float")).otherwise(beyond)


def flow_code(direction: Column, encoding: str) -> Column:
    """The code of a flow direction's name in ``encoding``; 0 for a null one, null for a name that is none."""
    codes = F.create_map(*[F.lit(x) for code, name in ENCODINGS[encoding].items() for x in (name, code)])
    return F.when(direction.isNull(), F.lit(0)).otherwise(F.element_at(codes, direction))


def direction_of_nodata(nodata: int | None, encoding: str) -> str | None:
    """The direction that a declared nodata byte stands for, if it does: such a grid can't be told from its holes."""
    return None if nodata is None else ENCODINGS[encoding].get(nodata)


def flow_direction(code: Column, encoding: str) -> Column:
    """Name of a flow direction; null for terminal cells (0, and GRASS codes -8 to -1) and unknown codes."""
    table = ENCODINGS[encoding]
    out = F.lit(None).cast("string")
    for value, name in table.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def flow_code_kind(code: Column, encoding: str) -> Column:
    """``direction``, ``terminal`` or ``invalid`` for a byte's code (GRASS reads it as signed)."""
    signed = F.when(code > 127, code - 256).otherwise(code)
    terminal = signed.between(-8, 0) if encoding == "grass" else code == 0
    return F.when(terminal, F.lit("terminal")).when(code.isin(*ENCODINGS[encoding]), F.lit("direction")).otherwise(F.lit("invalid"))


def pixel_of(x: Column, origin: float | Column, size: float | Column) -> Column:
    """Row or column of a coordinate on a north-up grid."""
    o, s = (F.lit(v) if isinstance(v, float | int) else v for v in (origin, size))
    return F.floor((x - o) / s).cast("long")


def pixel_centre(i: Column, origin: float | Column, size: float | Column) -> Column:
    o, s = (F.lit(v) if isinstance(v, float | int) else v for v in (origin, size))
    return o + (i + F.lit(0.5)) * s


def tile_window(low: Column, high: Column, origin: float, size: float, cells: int) -> Column:
    """Struct (offset, length) of the pixels that low..high covers, one more on each side, within the raster."""
    ends = [(low - F.lit(origin)) / F.lit(size), (high - F.lit(origin)) / F.lit(size)]
    first = F.least(F.greatest(F.floor(F.least(*ends)) - 1, F.lit(0)), F.lit(cells))
    last = F.least(F.greatest(F.ceil(F.greatest(*ends)) + 1, F.lit(0)), F.lit(cells))
    return F.struct(first.cast("long").alias("offset"), (last - first).cast("long").alias("length"))


def point_in_edges(x: Column, y: Column, edges: Column) -> Column:
    """1 inside, 0 on the border, -1 outside of rings given as array<struct<x0,y0,x1,y1>> (even-odd)."""

    def step(acc: Column, e: Column) -> Column:
        cross = (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])
        on = (cross == 0) & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))
        spans = (e["y0"] > y) != (e["y1"] > y)
        crosses = spans & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / F.when(spans, e["y1"] - e["y0"]).otherwise(F.lit(1.0)) + e["x0"])
        return F.struct((acc["odd"] != crosses).alias("odd"), (acc["on"] | on).alias("on"))

    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))
    return F.aggregate(edges, start, step, lambda a: F.when(a["on"], F.lit(0)).when(a["odd"], F.lit(1)).otherwise(F.lit(-1)))


def rectangle_edges(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Edges of a rectangle's ring, counter-clockwise."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)]
    return F.array(*[F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)])
