"""Dissolving, measuring and writing watershed polygons.

A fabric's cells share borders, so the union of cells is found by cancelling edges: every ring
becomes directed edges, edges with another piece's vertex on them are parted there, edges that
meet their opposite disappear by a groupBy, and the rest are the union's border, all on the
executors. One small kernel per watershed then stitches the border into rings; Karney's area and
WKB are vectorised over those rings.
"""

from __future__ import annotations

import json
import struct
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.tables import group_numbers, whole_groups, written

#: Coordinates are compared as integers of this many decimals.
DECIMALS = 7
#: WGS 84.
A, FLAT = 6_378_137.0, 1 / 298.257223563


_ENDS = ("x0", "y0", "x1", "y1")


def _cancelled(each: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1, times, piece): directed edges (key, x0, y0, x1, y1, times, piece) less those that meet their opposite."""
    forward = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") < F.col("y1")))
    ends = {"ax": ("x0", "x1"), "ay": ("y0", "y1"), "bx": ("x1", "x0"), "by": ("y1", "y0")}
    sided = each.select(key, "piece", *[F.when(forward, F.col(f)).otherwise(F.col(b)).alias(n) for n, (f, b) in ends.items()], F.when(forward, F.col("times")).otherwise(-F.col("times")).alias("way"))
    net = sided.groupBy(key, "ax", "ay", "bx", "by").agg(F.sum("way").alias("net"), F.min("piece").alias("piece")).filter("net <> 0")
    plus = F.col("net") > 0
    out = {"x0": ("ax", "bx"), "y0": ("ay", "by"), "x1": ("bx", "ax"), "y1": ("by", "ay")}
    return net.select(key, *[F.when(plus, F.col(f)).otherwise(F.col(b)).alias(n) for n, (f, b) in out.items()], F.abs("net").alias("times"), "piece")


def _meetings(edges: DataFrame, key: str, own: bool = False) -> DataFrame:
    """(key, x0, y0, x1, y1, points, crossed): edges that an edge of another piece, or with ``own`` of any, ends on, with the places, or crosses."""
    pairs = _meeting_pairs(edges, key, own)
    return pairs.groupBy(key, *_ENDS).agg(F.sort_array(F.collect_set("place")).alias("points"), F.bool_or("crosses").alias("crossed"))


def _meeting_pairs(edges: DataFrame, key: str, own: bool = False, single: bool = False) -> DataFrame:
    """(key, x0, y0, x1, y1, place, crosses, ox0, oy0, ox1, oy1): edges and one that ends on them, with the place, or crosses them.

    Edges are put in cells by their length: an edge lies in a few cells of its class. Others ask in the cells of
    each class of the key: with the whole edge where it is no longer, else with its first vertex. Only cells that several
    pieces touch matter, so pieces that lie apart cost one aggregate. ``single``: the key has one value.
    """
    spans = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.lit(1))
    sized = edges.withColumn("class", F.ceil(F.log2(spans.cast("double"))).cast("int"))
    classes = sized.groupBy(key).agg(F.collect_set("class").alias("classes"))
    classes = F.broadcast(classes) if single else classes

    def celled(df: DataFrame, of: str) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col(of))
        cell = lambda c: F.floor(c / width).cast("long")
        # of cells too small for the edge it asks for those of its first vertex alone, which may lie on a shorter edge
        ends = [(F.col(f"{c}0"), F.when(F.col(of) < F.col("class"), F.col(f"{c}0")).otherwise(F.col(f"{c}1"))) for c in "xy"]
        across = [F.sequence(cell(F.least(a, b) - 1), cell(F.greatest(a, b) + 1)) for a, b in ends]
        return df.withColumn("cx", F.explode(across[0])).withColumn("cy", F.explode(across[1]))

    asking = celled(sized.join(classes, key).withColumn("of", F.explode("classes")).drop("classes"), "of")
    several = F.lit(True) if own else F.col("one") != F.col("another")
    shared = asking.groupBy(key, "of", "cx", "cy").agg(F.min("piece").alias("one"), F.max("piece").alias("another")).filter(several).select(key, "of", "cx", "cy")
    shared = written(shared)
    held = celled(sized.withColumn("of", F.col("class")), "of").join(shared, [key, "of", "cx", "cy"], "left_semi")
    other = asking.join(shared, [key, "of", "cx", "cy"], "left_semi").select(key, "of", "cx", "cy", F.col("piece").alias("their"), *[F.col(c).alias(f"o{c}") for c in _ENDS])
    met = held.join(other, [key, "of", "cx", "cy"])
    met = met if own else met.filter("piece <> their")
    # what can't meet goes before the exact products: a vertex away from the edge or at an end of it, edges apart or with a common end
    low, high = lambda c, o="": F.least(f"{o}{c}0", f"{o}{c}1"), lambda c, o="": F.greatest(f"{o}{c}0", f"{o}{c}1")
    same = lambda o, e: (F.col(f"ox{o}") == F.col(f"x{e}")) & (F.col(f"oy{o}") == F.col(f"y{e}"))
    vertex = F.col("ox0").between(low("x") - 1, high("x") + 1) & F.col("oy0").between(low("y") - 1, high("y") + 1) & ~same(0, 0) & ~same(0, 1)
    overlap = (low("x", "o") <= high("x")) & (high("x", "o") >= low("x")) & (low("y", "o") <= high("y")) & (high("y", "o") >= low("y"))
    met = met.filter(vertex | (overlap & ~same(0, 0) & ~same(0, 1) & ~same(1, 0) & ~same(1, 1)))
    exact = lambda c: c.cast("decimal(20,0)")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def side(x: str, y: str):
        return exact(dx) * exact(F.col(y) - F.col("y0")) - exact(dy) * exact(F.col(x) - F.col("x0"))

    def along(x: str, y: str):
        return exact(dx) * exact(F.col(x) - F.col("x0")) + exact(dy) * exact(F.col(y) - F.col("y0"))

    length2 = exact(dx) * exact(dx) + exact(dy) * exact(dy)
    ends_on = (F.abs(side("ox0", "oy0")) <= F.greatest(F.abs(dx), F.abs(dy))) & (along("ox0", "oy0") > 0) & (along("ox0", "oy0") < length2)
    odx, ody = F.col("ox1") - F.col("ox0"), F.col("oy1") - F.col("oy0")
    their_side = lambda x, y: exact(odx) * exact(F.col(y) - F.col("oy0")) - exact(ody) * exact(F.col(x) - F.col("ox0"))
    touch = F.greatest(F.abs(dx), F.abs(dy), F.abs(odx), F.abs(ody))
    apart = lambda a, b: ((a > touch) & (b < -touch)) | ((a < -touch) & (b > touch))
    crosses = apart(side("ox0", "oy0"), side("ox1", "oy1")) & apart(their_side("x0", "y0"), their_side("x1", "y1"))
    place = F.when(ends_on, F.struct(along("ox0", "oy0").alias("t"), F.col("ox0").alias("x"), F.col("oy0").alias("y")))
    judged = met.select(key, *_ENDS, place.alias("place"), crosses.alias("crosses"), *[f"o{c}" for c in _ENDS])
    return judged.filter("place IS NOT NULL OR crosses")


def border_edges(pieces: DataFrame, key: str, edges: str = "edges", among: DataFrame | None = None) -> DataFrame:
    """(key, x0, y0, x1, y1, times, crossed): directed edges of a key's union, in units of 10**-DECIMALS degrees.

    ``pieces`` has a row for each polygon and its ring edges (exteriors counter-clockwise, holes
    clockwise). Edges that two pieces share in opposite directions cancel; then edges on which
    another piece has a vertex (within one unit) are parted there, and cancel again. ``times`` above 1 are edges
    that pieces share in the same direction, ``crossed`` those that cross another piece's: there pieces overlap.
    ``among`` (with ``edges``) has all pieces, each once: where many keys share them, what meets at all is found there once.
    """
    return merged_border(piece_edges(pieces, key, edges), key, among if among is None else meeting_edges(among, edges))


_SIDES = ("ax", "ay", "bx", "by")


def _sides(edges: DataFrame) -> DataFrame:
    """Adds an edge's ends without its direction: ax, ay, bx, by."""
    forward = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") < F.col("y1")))
    return edges.withColumns({n: F.when(forward, F.col(f)).otherwise(F.col(b)) for n, f, b in (("ax", "x0", "x1"), ("ay", "y0", "y1"), ("bx", "x1", "x0"), ("by", "y1", "y0"))})


def meeting_edges(pieces: DataFrame, edges: str = "edges") -> DataFrame:
    """(ax, ay, bx, by): the edges of ``pieces``, without direction, that may meet another piece's elsewhere than at common ends.

    Two edges that :func:`_meeting_pairs` has of any choice of the pieces are both there.
    """
    each = written(piece_edges(pieces.withColumn("all", F.lit(0)), "all", edges))
    pairs = written(_meeting_pairs(each, "all", single=True).select(*_ENDS, *[f"o{c}" for c in _ENDS]))
    return written(_sides(pairs.select(*_ENDS).union(pairs.select(*[F.col(f"o{c}").alias(c) for c in _ENDS]))).select(*_SIDES).distinct())


def piece_edges(pieces: DataFrame, key: str, edges: str = "edges") -> DataFrame:
    """(key, piece, times, x0, y0, x1, y1): the edges of ``pieces`` in whole units, each with a number that stands for its piece."""
    scale = 10**DECIMALS
    whole = lambda c: F.floor(F.col(f"e.{c}") * scale + 0.5).cast("long").alias(c)
    each = pieces.select(key, F.xxhash64(edges).alias("piece"), F.explode(edges).alias("e")).select(key, "piece", F.lit(1).cast("long").alias("times"), *[whole(c) for c in _ENDS])
    return each.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


def merged_border(each: DataFrame, key: str, meeting: DataFrame | None = None) -> DataFrame:
    """:func:`border_edges` of edges as :func:`piece_edges` gives them; if ``meeting`` (of :func:`meeting_edges`) is given, others don't meet."""
    if meeting is not None and not meeting.take(1):
        return _cancelled(each, key).drop("piece").withColumn("crossed", F.lit(False))
    first = written(_cancelled(each, key))
    suspects = first if meeting is None else written(_sides(first).join(meeting, [*_SIDES], "left_semi").select(*first.columns))
    met = first.join(_meetings(suspects, key), [key, *_ENDS], "left")
    stops = F.concat(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))), F.transform(F.coalesce("points", F.array()), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    steps = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda i: F.struct(F.get("stops", i - 1).alias("a"), F.get("stops", i).alias("b")))
    parted = met.withColumn("stops", stops).select(key, "piece", "times", F.coalesce("crossed", F.lit(False)).alias("crossed"), F.explode(steps).alias("s"))
    parted = written(parted.select(key, "piece", "times", "crossed", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1")))
    faulty = parted.filter("crossed").select(key).distinct().withColumn("crossed", F.lit(True))
    return _cancelled(parted.drop("crossed"), key).drop("piece").join(faulty, key, "left").withColumn("crossed", F.coalesce("crossed", F.lit(False)))


def simple_shapes(shapes: DataFrame, key: str, edges: str = "edges") -> DataFrame:
    """(key, is_simple): whether no two edges of a shape cross each other; touching isn't crossing. Shapes without edges aren't there."""
    each = piece_edges(shapes, key, edges)
    crossed = _meetings(each, key, own=True).filter("crossed").select(key).distinct().withColumn("crossed", F.lit(True))
    return each.select(key).distinct().join(crossed, key, "left").select(key, F.col("crossed").isNull().alias("is_simple"))


def fits_together(border: DataFrame, key: str) -> DataFrame:
    """(key, is_clean): whether edges cancelled to a border that every vertex leaves as often as it is entered,
    no edge twice, and no edges cross. False where pieces overlap: such pieces need a general union first.
    (A piece within another is seen by :func:`dissolved`.)"""
    ends = border.select(key, F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(1).alias("d"), "times", "crossed").union(border.select(key, "x1", "y1", F.lit(-1), "times", "crossed"))
    vertices = ends.groupBy(key, "x", "y").agg(F.sum(F.col("d") * F.col("times")).alias("d"), F.max("times").alias("times"), F.max("crossed").alias("crossed"))
    return vertices.groupBy(key).agg(F.bool_and((F.col("d") == 0) & (F.col("times") == 1) & ~F.col("crossed")).alias("is_clean"))


def _vertex_codes(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number of each edge's (n, 4) first and last vertex, in the order of x and y; coordinates may be of any size."""
    xs, ys = np.unique(edges[:, [0, 2]]), np.unique(edges[:, [1, 3]])
    code = lambda x, y: np.searchsorted(xs, x) * len(ys) + np.searchsorted(ys, y)
    return code(edges[:, 0], edges[:, 1]), code(edges[:, 2], edges[:, 3])


def stitch(edges: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed edges (n, 4). At a vertex of several ways out the sharpest left turn is taken,
    so polygons that touch at a point stay apart; straight runs keep their first and last vertex alone.
    Edges that lead nowhere are left out, and so are those that lead into a ring from outside of it."""
    e = edges[np.lexsort((edges[:, 3], edges[:, 2], edges[:, 1], edges[:, 0]))].astype(np.int64)
    starts, ends = _vertex_codes(e)
    low, high = np.searchsorted(starts, ends, "left"), np.searchsorted(starts, ends, "right")
    after = np.where(high > low, low, -1)
    for i in np.flatnonzero(high - low > 1):
        back = np.arctan2(e[i, 1] - e[i, 3], e[i, 0] - e[i, 2])
        ways = e[low[i] : high[i]]
        turn = (back - np.arctan2(ways[:, 3] - ways[:, 1], ways[:, 2] - ways[:, 0])) % (2 * np.pi)
        after[i] = low[i] + int(np.argmin(turn))
    following, walk, rings = after.tolist(), [-1] * len(e), []
    for first in range(len(e)):
        path, at = [], first
        while at >= 0 and walk[at] < 0:
            walk[at] = first
            path.append(at)
            at = following[at]
        if at >= 0 and walk[at] == first:
            p = e[path[path.index(at) :], :2]
            d1, d2 = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
            p = p[d1[:, 0] * d2[:, 1] != d1[:, 1] * d2[:, 0]]
            if len(p) > 2:
                rings.append(p)
    return rings


def planar_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0].astype(float), ring[:, 1].astype(float)
    x, y = x - x[0], y - y[0]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _holds(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring.astype(float), np.roll(ring, -1, axis=0).astype(float)
    spans = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool(np.count_nonzero(spans & (point[0] < at)) % 2)


def _within(inner: list[np.ndarray], outer: list[np.ndarray]) -> list[list[int]]:
    """For each ring of ``inner`` the numbers of the rings of ``outer`` that hold it, another one each; bounds are compared first."""
    if not inner or not outer:
        return [[] for _ in inner]
    low, high = (np.array([f(r, axis=0) for r in outer]) for f in (np.min, np.max))
    found = []
    for ring in inner:
        near = np.flatnonzero((low <= ring.min(axis=0)).all(axis=1) & (high >= ring.max(axis=0)).all(axis=1))
        found.append([int(i) for i in near if outer[i] is not ring and _holds(outer[i], (ring[0] + ring[1]) / 2)])
    return found


def overlapping(rings: list[np.ndarray]) -> bool:
    """Whether an exterior lies in more exteriors than holes around it: then two pieces cover it."""
    areas = [planar_area(r) for r in rings]
    outer, holes = [r for r, a in zip(rings, areas, strict=True) if a > 0], [r for r, a in zip(rings, areas, strict=True) if a < 0]
    around = _within(outer, outer)
    nested = [i for i, x in enumerate(around) if x]
    return any(len(around[i]) > len(h) for i, h in zip(nested, _within([outer[i] for i in nested], holes), strict=True))


def polygons(rings: list[np.ndarray], least_hole: float | None = None) -> list[list[np.ndarray]]:
    """Polygons of rings: exteriors (counter-clockwise) first, then the holes in them.

    Holes are dropped, and what lies in a dropped hole with them, or only those of a planar area
    below ``least_hole`` (square degrees).
    """
    areas = [planar_area(r) for r in rings]
    outer = [r for r, a in zip(rings, areas, strict=True) if a > 0]
    holes = [r for r, a in zip(rings, areas, strict=True) if a < 0]
    kept = [] if least_hole is None else [h for h in holes if -planar_area(h) / 10.0 ** (2 * DECIMALS) >= least_hole]
    # an island stays if each exterior around it has a hole around the island too
    around = _within(outer, outer)
    nested = [i for i, x in enumerate(around) if x]
    gone = {i for i, h in zip(nested, _within([outer[i] for i in nested], kept), strict=True) if len(h) < len(around[i])}
    out = {i: [r] for i, r in enumerate(outer) if i not in gone}
    for hole, inside in zip(kept, _within(kept, outer), strict=True):
        inside = [i for i in inside if i in out]
        if inside:
            out[min(inside, key=lambda i: planar_area(outer[i]))].append(hole)
    return list(out.values())


def largest_polygon(shape: list[list[np.ndarray]]) -> list[np.ndarray] | None:
    """The polygon of the largest planar area, holes taken off; null of none."""
    return max(shape, key=lambda p: abs(planar_area(p[0])) - sum(abs(planar_area(h)) for h in p[1:]), default=None)


def canonical(shape: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Closed rings of degrees to six decimals, begun at their least vertex, holes and polygons in order."""

    def ring(r: np.ndarray, left: bool) -> np.ndarray:
        p = np.round((r if (planar_area(r) > 0) == left else r[::-1]) / 10.0**DECIMALS, 6) + 0.0
        p = np.roll(p, -int(np.lexsort((p[:, 1], p[:, 0]))[0]), axis=0)
        return np.concatenate([p, p[:1]])

    place = lambda r: (*r[0], len(r), r.tobytes())
    return sorted(([ring(p[0], True), *sorted((ring(h, False) for h in p[1:]), key=place)] for p in shape), key=lambda p: place(p[0]))


def to_wkb(shape) -> bytes:
    """Little-endian 2-D MultiPolygon."""
    out = [struct.pack("<BII", 1, 6, len(shape))]
    for polygon in shape:
        out.append(struct.pack("<BII", 1, 3, len(polygon)))
        for ring in polygon:
            out.append(struct.pack("<I", len(ring)) + np.ascontiguousarray(ring, "<f8").tobytes())
    return b"".join(out)


def wkb_polygons(data: bytes) -> list[list[np.ndarray]]:
    """Rings (n, 2) of the polygons of a WKB Polygon or MultiPolygon of either byte order; ValueError for anything else."""
    at = 0

    def head() -> tuple[str, int, int]:
        nonlocal at
        if len(data) < at + 9:
            raise ValueError("WKB ends too soon")
        order = "<" if data[at] == 1 else ">"
        kind, n = struct.unpack_from(order + "II", data, at + 1)
        at += 9
        return order, kind, n

    def polygon(order: str, n: int):
        nonlocal at
        rings = []
        for _ in range(n):
            if len(data) < at + 4:
                raise ValueError("WKB ends too soon")
            (points,) = struct.unpack_from(order + "I", data, at)
            rings.append(np.frombuffer(data, order + "f8", 2 * points, at + 4).reshape(-1, 2).astype(float))
            at += 4 + 16 * points
        return rings

    order, kind, n = head()
    if kind == 3:
        return [polygon(order, n)]
    if kind != 6:
        raise ValueError(f"WKB type {kind} is neither Polygon nor MultiPolygon")
    out = []
    for _ in range(n):
        order, _, rings = head()
        out.append(polygon(order, rings))
    return out


def from_wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """:func:`wkb_polygons` as lists of pairs."""
    return [[[(x, y) for x, y in r.tolist()] for r in p] for p in wkb_polygons(data)]


def geodesic_area_km2(shape) -> float:
    """Area on WGS 84 with geodesic edges (Karney 2013: S12 of each edge, equation 59 by quadrature)."""
    rings = [np.radians(np.asarray(r, float)) for polygon in shape for r in polygon]
    if not rings:
        return 0.0
    outer = [i == 0 for polygon in shape for i in range(len(polygon))]
    ends = [np.concatenate([r[k] for r in rings]) for k in (slice(None, -1), slice(1, None))]
    begins = np.cumsum([0, *[len(r) - 1 for r in rings[:-1]]])
    each = np.concatenate([_under(ends[0][i : i + 50_000], ends[1][i : i + 50_000]) for i in range(0, len(ends[0]), 50_000)])
    areas = np.abs(np.add.reduceat(each, begins))
    return float(np.where(outer, areas, -areas).sum()) / 1e6


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def _auxiliary(lon: np.ndarray, lat1: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Vincenty's iteration: reduced latitudes, longitude and arc on the auxiliary sphere, azimuth at the equator."""
    b1, b2 = np.arctan((1 - FLAT) * np.tan(lat1)), np.arctan((1 - FLAT) * np.tan(lat2))
    omega = lon.copy()
    sigma, sin_a0, cos2, mid = (np.zeros(len(lon)) for _ in range(4))
    at = np.arange(len(lon))  # those that still move: what one comes to doesn't depend on the others
    for _ in range(100):
        p, q, o = b1[at], b2[at], omega[at]
        s, c = np.sin(o), np.cos(o)
        sin_sigma = np.hypot(np.cos(q) * s, np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * c)
        cos_sigma = np.sin(p) * np.sin(q) + np.cos(p) * np.cos(q) * c
        arc = np.arctan2(sin_sigma, cos_sigma)
        sine = np.cos(p) * np.cos(q) * s / np.where(sin_sigma == 0, 1, sin_sigma)
        square = np.maximum(1 - sine**2, 0)
        middle = np.where(square > 1e-15, cos_sigma - 2 * np.sin(p) * np.sin(q) / np.where(square > 1e-15, square, 1), 0.0)
        k = FLAT / 16 * square * (4 + FLAT * (4 - 3 * square))
        after = lon[at] + (1 - k) * FLAT * sine * (arc + k * sin_sigma * (middle + k * cos_sigma * (2 * middle**2 - 1)))
        omega[at], sigma[at], sin_a0[at], cos2[at], mid[at] = after, arc, sine, square, middle
        at = at[~(np.abs(after - o) < 1e-14)]
        if not len(at):
            break
    return b1, b2, omega, sigma, sin_a0, cos2, mid


def geodesic_distance_m(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres along the geodesic of points in degrees; not for nearly antipodal ones, where the iteration may not settle."""
    x1, y1, x2, y2 = (np.radians(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    _, _, _, sigma, _, cos2, mid = _auxiliary((x2 - x1 + np.pi) % (2 * np.pi) - np.pi, y1, y2)
    b = A * (1 - FLAT)
    u = cos2 * (A * A - b * b) / (b * b)
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    s, c = np.sin(sigma), np.cos(sigma)
    change = small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
    return b * big * (sigma - change)


def _under(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square metres between each geodesic edge and the equator, signed by its direction."""
    out = np.zeros(len(p))
    lat1, lat2 = p[:, 1], q[:, 1]
    lon = (q[:, 0] - p[:, 0] + np.pi) % (2 * np.pi) - np.pi
    some = (lon != 0) & ((lat1 != 0) | (lat2 != 0))  # along meridians and the equator nothing is enclosed
    lon, lat1, lat2 = lon[some], lat1[some], lat2[some]
    if not len(lon):
        return out
    b = A * (1 - FLAT)
    e2 = FLAT * (2 - FLAT)
    ep2 = e2 / (1 - e2)
    b1, b2, omega, sigma, sin_a0, cos2, _ = _auxiliary(lon, lat1, lat2)
    az1 = np.arctan2(np.cos(b2) * np.sin(omega), np.cos(b1) * np.sin(b2) - np.sin(b1) * np.cos(b2) * np.cos(omega))
    sigma1 = np.arctan2(np.sin(b1), np.cos(az1) * np.cos(b1))
    sigma2 = sigma1 + sigma
    turn = 2 * np.arctan(np.tan(omega / 2) * np.sin((b1 + b2) / 2) / np.cos((b2 - b1) / 2))
    cos_a0 = np.sqrt(np.maximum(cos2, 0))
    k2 = ep2 * cos2
    c2 = A * A / 2 + b * b / 2 * np.arctanh(np.sqrt(e2)) / np.sqrt(e2)

    def t(x):
        root = np.sqrt(x)
        return x + np.sqrt(1 / x + 1) * np.arcsinh(root)

    half, centre = (sigma2 - sigma1) / 2, (sigma2 + sigma1) / 2
    angles = centre[:, None] + half[:, None] * _NODES
    x = np.maximum(k2[:, None] * np.sin(angles) ** 2, 1e-30)
    apart = ep2 - x
    at_pole = 1 + 1 / (2 * ep2) - np.arcsinh(np.sqrt(ep2)) / (2 * ep2 * ep2 * np.sqrt(1 / ep2 + 1))  # the quotient's limit, t'(ep2)
    integrand = np.where(apart == 0, at_pole, (t(ep2) - t(x)) / np.where(apart == 0, 1, apart)) * np.sin(angles) / 2
    integral = (integrand * _WEIGHTS).sum(axis=1) * half
    # equation 59 integrates from the next equator crossing backwards: its sign is negative
    out[some] = c2 * turn - e2 * A * A * cos_a0 * sin_a0 * integral
    return out


SHAPE = T.StructType(
    [T.StructField("geometry", T.BinaryType()), T.StructField("area_km2", T.DoubleType()), T.StructField("parts", T.IntegerType()), T.StructField("is_clean", T.BooleanType())]
)


def dissolved(border: DataFrame, key: str, least_hole: float | None = None) -> DataFrame:
    """(key, geometry, area_km2, parts, is_clean): the canonical WKB MultiPolygon of each key's border edges.

    A border is far smaller than its pieces; each key's is stitched by one task, which takes many keys at once. ``is_clean`` is
    false where pieces overlap, that is where :func:`fits_together` is false or a piece lies
    within another; geometry, area and parts are null then, since no union was made.
    """
    schema = T.StructType([border.schema[key], *SHAPE.fields])
    dealt = border.select(key, *_ENDS, "times", "crossed").repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(whole_groups(key, partial(_dissolve, key=key, least_hole=least_hole), DISSOLVED_ROWS), schema)


#: Edges that one task dissolves at once, more where a single border has more; and rings of a border that are compared pair by pair.
DISSOLVED_ROWS, MOST_RINGS = 1 << 18, 64


def _shape(edges: np.ndarray, least_hole: float | None) -> tuple[bytes | None, float | None, int | None]:
    """WKB, area and number of polygons of one balanced border of any form; nulls where pieces overlap."""
    rings = stitch(edges)
    if not sum(map(len, rings)) or overlapping(rings):
        return None, None, None
    shape = canonical(polygons(rings, least_hole))
    return to_wkb(shape), geodesic_area_km2(shape), len(shape)


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from those before them."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _following(e: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The edge that follows each one of balanced borders, by the rule of :func:`stitch`; ``e`` is in the order of group and coordinates."""
    new = _first_of_runs(group, e[:, 0], e[:, 1])
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.diff(np.append(begin, len(e)))
    into = np.lexsort((e[:, 3], e[:, 2], group))  # vertices are entered as often as they are left: the k-th way in meets the k-th way out
    vertex = np.empty(len(e), np.int64)
    vertex[into] = run
    after = begin[vertex]
    several = np.flatnonzero(size[vertex] > 1)
    if len(several):
        many = size[vertex[several]]
        i = np.repeat(several, many)
        way = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + begin[vertex[i]]
        back = np.arctan2(e[i, 1] - e[i, 3], e[i, 0] - e[i, 2])
        turn = (back - np.arctan2(e[way, 3] - e[way, 1], e[way, 2] - e[way, 0])) % (2 * np.pi)
        order = np.lexsort((way, turn, i))
        order = order[_first_of_runs(i[order])]
        after[i[order]] = way[order]
    return after


def _rings(after: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges ring by ring, each begun at its least edge, and their rings by number, for a permutation ``after`` without rings above ``longest``."""
    n, rounds = len(after), max(int(longest).bit_length(), 1)
    least, to = np.arange(n), after
    for _ in range(rounds):
        least, to = np.minimum(least, least[to]), to[to]
    last = after == least  # the edge before a ring's least one ends it
    ahead, to = np.where(last, 0, 1), np.where(last, np.arange(n), after)
    for _ in range(rounds):
        ahead, to = ahead + ahead[to], to[to]
    order = np.lexsort((-ahead, least))
    return order, np.cumsum(_first_of_runs(least[order])) - 1


def _dissolve(table: pa.Table, key: str, least_hole: float | None) -> pa.Table:
    """:func:`dissolved` of the borders in ``table``. Those of rings that lie apart, without holes, are made all at once, others one by one."""
    first, group = group_numbers(table, key)
    n = len(first)
    e = np.column_stack([table[c].to_numpy() for c in _ENDS]).astype(np.int64)
    faulty = (table["times"].to_numpy() != 1) | table["crossed"].to_numpy().astype(bool)
    out, into = (np.lexsort((e[:, b], e[:, a], group)) for a, b in ((0, 1), (2, 3)))
    faulty |= (e[out, 0] != e[into, 2]) | (e[out, 1] != e[into, 3])  # of the same group: both are in their order
    clean = np.bincount(group, weights=faulty, minlength=n) == 0
    order = np.lexsort((e[:, 3], e[:, 2], e[:, 1], e[:, 0], group))
    order = order[clean[group[order]]]
    e, group = e[order], group[order]
    edge_first = np.searchsorted(group, np.arange(n + 1))
    after = _following(e, group)
    single = np.ones(n, bool)  # borders that are left to _shape lose this
    single[group[np.bincount(after, minlength=len(e)) != 1]] = False

    some = np.flatnonzero(single[group])
    place = np.full(len(e), -1)
    place[some] = np.arange(len(some))
    walk, ring = _rings(place[after[some]], int(np.diff(edge_first).max(initial=1)))
    walk = some[walk]
    p, of = e[walk, :2], group[walk]

    def ends(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where rings begin, and the rows before and after each within its ring."""
        begin = np.flatnonzero(_first_of_runs(ring))
        before, beyond = np.arange(len(ring)) - 1, np.arange(len(ring)) + 1
        last = np.append(begin, len(ring))[1:] - 1
        before[begin], beyond[last] = last, begin
        return begin, before, beyond

    _, before, beyond = ends(ring)
    d1, d2 = p - p[before], p[beyond] - p
    bent = d1[:, 0] * d2[:, 1] != d1[:, 1] * d2[:, 0]
    p, ring, of = p[bent], ring[bent], of[bent]
    begin, _, _ = ends(ring)
    wide = np.repeat(np.diff(np.append(begin, len(ring))), np.diff(np.append(begin, len(ring)))) > 2
    p, ring, of = p[wide], ring[wide], of[wide]
    begin, before, beyond = ends(ring)
    size, owner = np.diff(np.append(begin, len(ring))), of[begin]
    ring = np.cumsum(_first_of_runs(ring)) - 1
    local = (p - p[begin][ring]).astype(float)
    area = np.bincount(ring, weights=local[:, 0] * local[beyond, 1] - local[beyond, 0] * local[:, 1], minlength=len(begin))
    single[owner[area <= 0]] = False
    rings = np.bincount(owner, minlength=n)
    single[rings > MOST_RINGS] = False
    if len(begin):
        low, high = np.minimum.reduceat(p, begin), np.maximum.reduceat(p, begin)
        to_compare = np.flatnonzero((rings[owner] > 1) & single[owner])
        a = np.repeat(to_compare, rings[owner[to_compare]])
        ring_first = np.searchsorted(owner, np.arange(n))
        b = np.arange(len(a)) - np.repeat(np.cumsum(rings[owner[to_compare]]) - rings[owner[to_compare]], rings[owner[to_compare]]) + ring_first[owner[a]]
        within = (a != b) & (low[b] <= low[a]).all(axis=1) & (high[b] >= high[a]).all(axis=1)
        single[owner[a[within]]] = False

    q = np.round(p / 10.0**DECIMALS, 6) + 0.0
    least = np.lexsort((q[:, 1], q[:, 0], ring))
    least = least[_first_of_runs(ring[least])]
    turned = begin[ring] + (np.arange(len(q)) - begin[ring] + (least - begin)[ring]) % size[ring]
    q = q[turned]
    start = q[begin]
    in_order = np.lexsort((size, start[:, 1], start[:, 0], owner))
    tied = ~_first_of_runs(owner[in_order], start[in_order, 0], start[in_order, 1], size[in_order])
    single[owner[in_order[tied]]] = False
    kept = in_order[single[owner[in_order]]]
    # closed rings, one after the other
    closed = size[kept] + 1
    at = np.concatenate([[0], np.cumsum(closed)]).astype(np.int64)
    which = np.repeat(np.arange(len(kept)), closed)
    step = np.arange(at[-1]) - at[which]
    points = q[begin[kept][which] + step % size[kept][which]]
    mine = owner[kept]
    parts = np.bincount(mine, minlength=n)
    made = parts > 0
    line = np.flatnonzero(step < closed[which] - 1)
    under = [_under(np.radians(points[line[i : i + 50_000]]), np.radians(points[line[i : i + 50_000] + 1])) for i in range(0, len(line), 50_000)]
    square = np.abs(np.bincount(which[line], weights=np.concatenate(under), minlength=len(kept))) if len(line) else np.zeros(0)
    km2 = np.bincount(mine, weights=square, minlength=n) / 1e6
    data, starts = _wkb_of_rings(points, closed, mine, n)

    wkb: list[bytes | None] = [data[a:b] if m else None for a, b, m in zip(starts[:-1].tolist(), starts[1:].tolist(), made.tolist(), strict=True)]
    areas, counts = [a if m else None for a, m in zip(km2.tolist(), made.tolist(), strict=True)], [c or None for c in parts.tolist()]
    for i in np.flatnonzero(clean & ~single):
        wkb[i], areas[i], counts[i] = _shape(e[edge_first[i] : edge_first[i + 1]], least_hole)
    columns = [table[key].combine_chunks().take(pa.array(first)), pa.array(wkb, pa.binary()), pa.array(areas, pa.float64()), pa.array(counts, pa.int32()), pa.array([w is not None for w in wkb])]
    return pa.table(columns, [key, *SHAPE.names])


def _wkb_of_rings(points: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int) -> tuple[bytes, np.ndarray]:
    """:func:`to_wkb` of ``n`` shapes whose polygons are single closed rings, in the order of shapes: all bytes, and where each shape's begin and the last one's end."""
    parts = np.bincount(owner, minlength=n)
    length = np.bincount(owner, weights=13 + 16 * sizes, minlength=n).astype(np.int64) + np.where(parts > 0, 9, 0)
    starts = np.concatenate([[0], np.cumsum(length)])
    data = np.zeros(starts[-1], np.uint8)

    def put(at: np.ndarray, values: np.ndarray, dtype: str) -> None:
        if not len(at):
            return
        raw = np.ascontiguousarray(values, dtype).view(np.uint8).reshape(len(at), -1)
        data[at[:, None] + np.arange(raw.shape[1])] = raw

    some = np.flatnonzero(parts)
    first = starts[some]
    data[first] = 1
    put(first + 1, np.full(len(some), 6), "<u4")
    put(first + 5, parts[some], "<u4")
    each = 13 + 16 * sizes
    ring = 9 + starts[owner] + np.cumsum(each) - each - (np.concatenate([[0], np.cumsum(each)])[np.searchsorted(owner, owner)])
    data[ring] = 1
    put(ring + 1, np.full(len(ring), 3), "<u4")
    put(ring + 5, np.ones(len(ring)), "<u4")
    put(ring + 9, sizes, "<u4")
    before = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(sizes)), sizes)
    put(ring[which] + 13 + 16 * (np.arange(len(points)) - before[which]), points, "<f8")
    return data.tobytes(), starts


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax", "cx", "cy")]))
def wkb_facts(wkb: pd.Series) -> pd.DataFrame:
    """Bounds and area-weighted planar centroid of WKB polygons; nulls for null or empty ones."""

    def facts(data) -> tuple[float | None, ...]:
        shape = [] if data is None else from_wkb(bytes(data))
        if not shape:
            return (None,) * 6
        points = np.concatenate([np.array(p[0]) for p in shape])
        total, moment = 0.0, np.zeros(2)
        for polygon in shape:
            for i, ring in enumerate(polygon):
                p = np.array(ring) - points[0]
                cross = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
                sign = (1 if i == 0 else -1) * np.sign(cross.sum())
                total += sign * cross.sum() / 2
                moment += sign * ((p[:-1] + p[1:]) * cross[:, None]).sum(axis=0) / 6
        centre = points[0] + moment / total if total else points.mean(axis=0)
        return (*points.min(axis=0), *points.max(axis=0), *centre)

    return pd.DataFrame([facts(b) for b in wkb], columns=["xmin", "ymin", "xmax", "ymax", "cx", "cy"], dtype=float)


@F.pandas_udf(T.StringType())
def geojson_geometry(wkb: pd.Series) -> pd.Series:
    """GeoJSON text of WKB polygons; null stays null."""
    return wkb.map(lambda b: None if b is None else json.dumps({"type": "MultiPolygon", "coordinates": from_wkb(bytes(b))}, separators=(",", ":")))
