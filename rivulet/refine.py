"""Terminal refinement on D8 grids: only the part of a terminal unit that drains to the outlet is kept.

Mask, snap, trace and outline are the table operators of ``rivulet.raster``, so all terminals of a
batch are refined together; terminals of few cells are snapped, traced and outlined whole, many at once in one task. The result never leaves the terminal's polygon: directions and
accumulations outside of it are absent.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import DatasetError
from rivulet.expressions import direction_of_nodata, equal_earth, equal_earth_inverse, pixel_centre
from rivulet.fabric import D8Declarations
from rivulet.geometry import DECIMALS, border_edges
from rivulet.raster import downstream, is_stream, outline_edges, rasterized, snapped, traced
from rivulet.tables import group_numbers, whole_groups, written

MODES = ("disabled", "best-effort", "require")
THRESHOLD = 1000.0


@dataclass(frozen=True)
class Grid:
    """A north-up D8 grid: cells (row, col, dir, acc), its place, and what its codes and units mean."""

    cells: DataFrame
    origin_x: float
    origin_y: float
    width: float
    height: float
    rows: int
    cols: int
    encoding: str = "esri"
    units: str = "cells"
    crs: str = "EPSG:4326"
    nodata: int | None = None

    def __post_init__(self):
        if self.height >= 0 or self.width <= 0:
            raise DatasetError("geo_transform", "a grid is north-up: its pixel height is below 0 and its width above")
        if self.crs not in ("EPSG:4326", "EPSG:8857"):
            raise DatasetError("crs", f"grids in {self.crs} aren't supported")
        if direction_of_nodata(self.nodata, self.encoding):
            raise DatasetError("directional_nodata", f"nodata {self.nodata} is a direction in {self.encoding}")
        if self.units == "km2" and self.crs == "EPSG:4326":
            raise DatasetError("units", "km2 accumulation needs a projected grid")

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax in the grid's own coordinates."""
        return self.origin_x, self.origin_y + self.rows * self.height, self.origin_x + self.cols * self.width, self.origin_y

    def cells_at(self, threshold: float) -> float:
        """The threshold, given in cells, in the grid's own unit."""
        return threshold * abs(self.width * self.height) / 1e6 if self.units == "km2" else threshold


#: Cells within the bounds of a terminal that one task may cut by itself, and of several that it cuts at once.
WHOLE_CELLS = CHUNK_CELLS = 1 << 18


def _cut_in_tables(terminals: DataFrame, known: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """(terminal_id, masked, n_cells, pour_row, pour_col, refined) of terminals of any size that have cells, by joins and aggregates."""
    place = (grid.origin_x, grid.origin_y, grid.width, grid.height)
    mask = rasterized(terminals, *place, grid.rows, grid.cols, key="terminal_id")
    held = mask.join(known, ["row", "col"]).withColumnRenamed("terminal_id", "grid_id")
    pours = snapped(held, terminals.select(F.col("terminal_id").alias("point_id"), F.col("terminal_id").alias("grid_id"), "prow", "pcol"), grid.cells_at(threshold))
    cells = traced(held, pours.select(F.col("point_id").alias("pour_id"), "grid_id", "row", "col"), grid.encoding)
    counts = cells.groupBy(F.col("grid_id").alias("terminal_id")).agg(F.count(F.lit(1)).alias("n_cells"))
    border = border_edges(outline_edges(cells.withColumnRenamed("grid_id", "terminal_id"), "terminal_id", *place), "terminal_id")
    scale = float(10**DECIMALS)
    ring = F.struct(*[(F.col(c) / scale).alias(c) for c in ("x0", "y0", "x1", "y1")])
    edges = border.groupBy("terminal_id").agg(F.collect_list(ring).alias("refined"))  # one unit's outline
    joined = mask.select("terminal_id", F.lit(True).alias("masked")).distinct().join(counts, "terminal_id", "left").join(edges, "terminal_id", "left")
    pours = pours.select(F.col("point_id").alias("terminal_id"), F.col("row").alias("pour_row"), F.col("col").alias("pour_col"))
    return joined.join(pours, "terminal_id", "left").select("terminal_id", "masked", "n_cells", "pour_row", "pour_col", "refined")


def _cut_whole(terminals: DataFrame, known: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """As :func:`_cut_in_tables`, of terminals of few cells: all cells of a terminal are dealt to one task, which cuts many at once."""
    place = (grid.origin_x, grid.origin_y, grid.width, grid.height)
    keyed = terminals.select(F.struct("terminal_id", "prow", "pcol").alias("key"), "edges")
    mask = rasterized(keyed, *place, grid.rows, grid.cols, key="key")
    moved = downstream(known, grid.encoding).select("row", "col", ((F.col("to_row") - F.col("row") + 1) * 3 + F.col("to_col") - F.col("col") + 1).cast("byte").alias("step"), "acc")
    moved = moved.select("row", "col", "step", F.when(is_stream(grid.cells_at(threshold)), F.col("acc").cast("double")).alias("acc"), F.lit(True).alias("there"))
    held = mask.join(moved, ["row", "col"], "left").select("key.*", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "step", "acc", F.coalesce("there", F.lit(False)).alias("there"))
    schema = T.StructType([held.schema["terminal_id"], *CUT.fields])
    return held.repartition("terminal_id").sortWithinPartitions("terminal_id", "row", "col").mapInArrow(whole_groups("terminal_id", partial(_cut, place=place), CHUNK_CELLS), schema)


_RING = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]))
CUT = T.StructType([T.StructField(n, t) for n, t in (("masked", T.BooleanType()), ("n_cells", T.LongType()), ("pour_row", T.LongType()), ("pour_col", T.LongType()), ("refined", _RING))])


def _cut(table: pa.Table, place: tuple[float, float, float, float]) -> pa.Table:
    """A row (terminal_id, *CUT) for each terminal of ``table``: its pour cell, the nearest stream cell, and what drains there within it.

    Cells step on by doubling; a pour cell steps to itself, so what drains there, on a cycle or not, ends there.
    """
    first, grid = group_numbers(table, "terminal_id")
    n, there = len(first), table["there"].to_numpy()
    row, col, prow, pcol, acc, step = (table[c].to_numpy() for c in ("row", "col", "prow", "pcol", "acc", "step"))
    low = [np.minimum.reduceat(v, first) for v in (row, col)]
    grid, row, col, prow, pcol, acc, step = (v[there] for v in (grid, row, col, prow, pcol, acc, step))
    tall, wide = (int((v - w[grid]).max(initial=0)) + 3 for v, w in ((row, low[0]), (col, low[1])))
    key = (grid * tall + row - low[0][grid] + 1) * wide + col - low[1][grid] + 1  # ascending

    dr, dc = row + 0.5 - prow, col + 0.5 - pcol
    far = dr * dr + dc * dc
    asked = np.flatnonzero(~np.isnan(acc.astype(float)) & ~np.isnan(far.astype(float)))
    asked = asked[np.lexsort((key[asked], -acc[asked], far[asked], grid[asked]))]
    pour = np.full(n, -1)
    nearest = asked[np.diff(grid[asked], prepend=-1) != 0]
    pour[grid[nearest]] = nearest

    to, at = np.arange(len(key)), np.flatnonzero(~np.isnan(step.astype(float)))
    goal = key[at] + (step[at].astype(np.int64) // 3 - 1) * wide + step[at].astype(np.int64) % 3 - 1
    found = np.minimum(np.searchsorted(key, goal), max(len(key) - 1, 0))
    to[at] = np.where(key[found] == goal, found, at)
    to[pour[pour >= 0]] = pour[pour >= 0]
    for _ in range(int(np.bincount(grid, minlength=1).max()).bit_length()):
        to = to[to]
    reached = np.flatnonzero((pour[grid] >= 0) & (to == pour[grid]))

    x0, y0, width, height = place
    mine, k = grid[reached], key[reached]
    west, east, north, south = (np.floor((o + v * s) * 10**DECIMALS + 0.5) for o, v, s in ((x0, col[reached], width), (x0, col[reached] + 1, width), (y0, row[reached], height), (y0, row[reached] + 1, height)))
    sides = []
    for beyond, ends in ((wide, (west, south, east, south)), (1, (east, south, east, north)), (-wide, (east, north, west, north)), (-1, (west, north, west, south))):
        beside = k + beyond
        open_ = k[np.minimum(np.searchsorted(k, beside), max(len(k) - 1, 0))] != beside
        sides.append([mine[open_], *[v[open_] / float(10**DECIMALS) for v in ends]])
    owner, *ends = (np.concatenate(v) for v in zip(*sides, strict=True))
    order = np.argsort(owner, kind="stable")
    struct = pa.StructArray.from_arrays([pa.array(v[order]) for v in ends], ["x0", "y0", "x1", "y1"])
    none = pour < 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32())
    count = lambda v: pa.array(np.where(none, 0, v).astype(np.int64), mask=none)
    poured = lambda v: count(v[pour] if len(v) else pour)
    columns = [table["terminal_id"].take(pa.array(first)), pa.array(np.ones(n, bool)), count(np.bincount(mine, minlength=n)), poured(row), poured(col), pa.ListArray.from_arrays(offsets, struct, mask=pa.array(none))]
    return pa.table(columns, ["terminal_id", *CUT.names])


def refine(terminals: DataFrame, grid: Grid, threshold: float = THRESHOLD, mode: str = "best-effort", whole_cells: int = 0) -> DataFrame:
    """(terminal_id, unit_id, status, reason, n_cells, pour_row, pour_col, edges) of each terminal.

    ``terminals`` has (terminal_id, unit_id, lon, lat, edges) in the grid's coordinates. Status is
    ``applied``, ``skipped`` with a reason (``empty_mask``: no cell centre in the polygon;
    ``no_stream``: none of its cells reaches the threshold) or ``disabled``; then ``edges`` is null.
    Mode ``require`` raises instead of skipping. Terminals whose bounds hold ``whole_cells`` cells at most
    (WHOLE_CELLS is a good bound) are cut by one task each, many at once; joins cut the others, of any size.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    if mode == "disabled":
        none = {"n_cells": "long", "pour_row": "long", "pour_col": "long", "edges": "array<struct<x0:double,y0:double,x1:double,y1:double>>"}
        return terminals.select("terminal_id", "unit_id", F.lit("disabled").alias("status"), F.lit(None).cast("string").alias("reason"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    # terminals of one shape and outlet have one result
    led = terminals.select("terminal_id", "unit_id", "lon", "lat", "edges").withColumn("lead", F.min("terminal_id").over(Window.partitionBy("edges", "lon", "lat")))
    led = written(led.withColumn("edges", F.when(F.col("terminal_id") == F.col("lead"), F.col("edges"))))
    across = lambda c, size: (F.array_max(F.concat(_values(f"{c}0"), _values(f"{c}1"))) - F.array_min(F.concat(_values(f"{c}0"), _values(f"{c}1")))) / F.lit(size) + 1
    most = whole_cells if min(grid.width, -grid.height) * 10**DECIMALS >= 2 else 0
    whole = F.coalesce(across("x", grid.width) * across("y", -grid.height) <= most, F.lit(True))
    terminals = led.filter("terminal_id = lead").withColumns(
        {"prow": (F.col("lat") - grid.origin_y) / F.lit(grid.height), "pcol": (F.col("lon") - grid.origin_x) / F.lit(grid.width), "whole": whole}
    )
    known = grid.cells if grid.nodata is None else grid.cells.filter(F.col("dir") != grid.nodata)
    known = known.select(F.col("row").cast("long"), F.col("col").cast("long"), "dir", "acc")
    cut = _cut_whole(terminals.filter("whole"), known, grid, threshold)
    large = terminals.filter("NOT whole")
    if large.take(1):
        cut = cut.union(_cut_in_tables(large, known, grid, threshold))
    cut = written(cut) if mode == "require" else cut
    joined = terminals.select("terminal_id").join(cut.hint("merge"), "terminal_id", "left")
    reason = F.when(F.col("masked").isNull(), F.lit("empty_mask")).when(F.col("pour_row").isNull(), F.lit("no_stream"))
    out = joined.select(F.col("terminal_id").alias("lead"), F.when(reason.isNull(), F.lit("applied")).otherwise(F.lit("skipped")).alias("status"), reason.alias("reason"), "n_cells", "pour_row", "pour_col", F.col("refined").alias("edges"))
    out = led.select("terminal_id", "unit_id", "lead").join(out, "lead").drop("lead")
    if mode == "require":
        failed = out.filter("status = 'skipped'").limit(1).collect()
        if failed:
            raise DatasetError(failed[0]["reason"], f"terminal {failed[0]['terminal_id']} can't be refined")
    return out


#: Why a terminal wasn't refined -> what kind of reason that is.
CATEGORIES = {
    "no_d8_declared": "availability",
    "no_grid_provided": "availability",
    "spans_tiles": "availability",
    "no_covering_tile": "availability",
    "unreadable_d8_declared": "mis-declaration",
    "no_edges": "data-geometry-integrity",
    "empty_mask": "data-geometry-integrity",
    "no_stream": "data-geometry-integrity",
}


def projected(edges: DataFrame, crs: str) -> DataFrame:
    """``edges`` and ``lon``, ``lat`` of each row in the coordinates of ``crs``."""
    if crs == "EPSG:4326":
        return edges
    at = equal_earth(F.col("lon"), F.col("lat"))
    a, b = lambda e: equal_earth(e["x0"], e["y0"]), lambda e: equal_earth(e["x1"], e["y1"])
    ring = F.transform("edges", lambda e: F.struct(a(e)["x"].alias("x0"), a(e)["y"].alias("y0"), b(e)["x"].alias("x1"), b(e)["y"].alias("y1")))
    return edges.withColumns({"edges": ring, "lon": at["x"], "lat": at["y"]})


def _values(name: str) -> Column:
    return F.transform("edges", lambda e: e[name])


def _unprojected(edges, crs: str):
    if crs == "EPSG:4326":
        return edges
    a, b = lambda e: equal_earth_inverse(e["x0"], e["y0"]), lambda e: equal_earth_inverse(e["x1"], e["y1"])
    return F.transform(edges, lambda e: F.struct(a(e)["lon"].alias("x0"), a(e)["lat"].alias("y0"), b(e)["lon"].alias("x1"), b(e)["lat"].alias("y1")))


def refine_on_grids(terminals: DataFrame, grids: tuple[Grid, ...], declared: D8Declarations | None = None, threshold: float = THRESHOLD, mode: str = "best-effort") -> DataFrame:
    """(outlet_id, terminal_id, status, category, reason, pour_lon, pour_lat, edges) of each outlet's terminal.

    ``terminals`` has (outlet_id, terminal_id, lon, lat, edges) in degrees; each is refined on the
    first grid whose extent holds it, in that grid's coordinates. Status is ``applied``,
    ``skipped`` with a reason and its category, or ``disabled``; a skipped outlet doesn't stop others.
    """
    keys = terminals.select("outlet_id", "terminal_id")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("pour_lon", "double"), ("pour_lat", "double"), ("edges", "array<struct<x0:double,y0:double,x1:double,y1:double>>"))]

    def settled(rows: DataFrame, status: str, reason) -> DataFrame:
        return rows.select("outlet_id", "terminal_id", F.lit(status).alias("status"), reason.cast("string").alias("reason"), *none)

    declared = declared or D8Declarations(len(grids))
    if mode == "disabled":
        out = settled(keys, "disabled", F.lit(None))
    elif not grids and not declared.readable:
        out = settled(keys, "skipped", F.lit("unreadable_d8_declared" if declared.unreadable else "no_d8_declared"))
    elif not grids:
        out = settled(keys, "skipped", F.lit("no_grid_provided"))
    else:
        met = None
        for i, grid in enumerate(grids):
            ends = [f(_values(f"{c}0")).alias(f"{c}{n}") for c in "xy" for f, n in ((F.array_min, "min"), (F.array_max, "max"))]
            box = projected(terminals, grid.crs).select("outlet_id", *ends)  # rings are closed: all their vertices begin an edge
            xmin, ymin, xmax, ymax = map(F.lit, grid.extent)
            holds = (F.col("xmin") >= xmin) & (F.col("xmax") <= xmax) & (F.col("ymin") >= ymin) & (F.col("ymax") <= ymax)
            touches = (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
            part = box.select("outlet_id", F.when(holds, F.lit(i)).alias("held_by"), touches.alias("touches"))
            met = part if met is None else met.union(part)
        picks = met.groupBy("outlet_id").agg(F.min("held_by").alias("grid"), F.count_if("touches").alias("touching"), F.count("touches").alias("known"))
        picked = written(terminals.join(picks, "outlet_id"))
        reason = F.when(F.col("known") == 0, F.lit("no_edges")).when(F.col("touching") > 1, F.lit("spans_tiles")).otherwise(F.lit("no_covering_tile"))
        out = settled(picked.filter("grid IS NULL"), "skipped", reason)
        for i, grid in enumerate(grids):
            own = projected(picked.filter(F.col("grid") == i), grid.crs)
            asked = own.select(F.col("outlet_id").alias("terminal_id"), F.col("terminal_id").alias("unit_id"), "lon", "lat", "edges")
            got = refine(asked, grid, threshold, "best-effort", WHOLE_CELLS)
            x, y = pixel_centre(F.col("pour_col"), grid.origin_x, grid.width), pixel_centre(F.col("pour_row"), grid.origin_y, grid.height)
            if grid.crs != "EPSG:4326":
                x, y = equal_earth_inverse(x, y)["lon"], equal_earth_inverse(x, y)["lat"]
            out = out.union(got.select(F.col("terminal_id").alias("outlet_id"), F.col("unit_id").alias("terminal_id"), "status", "reason", x.alias("pour_lon"), y.alias("pour_lat"), _unprojected(F.col("edges"), grid.crs).alias("edges")))
    kinds = F.create_map(*[F.lit(v) for pair in CATEGORIES.items() for v in pair])
    return out.withColumn("category", F.when(F.col("status") == "skipped", F.element_at(kinds, F.col("reason"))))
