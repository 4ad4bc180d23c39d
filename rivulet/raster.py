"""D8 rasters as tables of cells: masks, pour-point snapping, tracing and outlines as joins and aggregates.

Cells are rows (grid_id, row, col, dir, acc); a grid may be far larger than one task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.closure import closed_forest, cycle_members
from rivulet.expressions import STEPS, flow_code_kind, flow_direction, pixel_centre
from rivulet.tables import written

#: Cells that a block spans each way in the first round of a search.
BLOCK = 8


def decoded(cells: DataFrame, encoding: str = "esri") -> DataFrame:
    """Adds ``flow`` (name of the direction, null at terminals) and ``kind`` of the ``dir`` byte."""
    code = F.col("dir").cast("int")
    return cells.withColumns({"flow": flow_direction(code, encoding), "kind": flow_code_kind(code, encoding)})


def downstream(cells: DataFrame, encoding: str = "esri") -> DataFrame:
    """Adds ``to_row``, ``to_col``: the cell that each cell drains to, null at terminals."""
    flow = flow_direction(F.col("dir").cast("int"), encoding)
    step = lambda axis: F.element_at(F.create_map(*[x for n, s in STEPS.items() for x in (F.lit(n), F.lit(s[axis]))]), flow)
    return cells.withColumns({"to_row": F.col("row") + step(0), "to_col": F.col("col") + step(1)})


def masked(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells inside ``mask`` (grid_id, row, col) keep their values; others get dir 255 and a null acc."""
    inside = mask.select("grid_id", "row", "col", F.lit(True).alias("_in")).distinct()
    joined = cells.join(inside, ["grid_id", "row", "col"], "left")
    return joined.withColumns({"dir": F.when(F.col("_in"), F.col("dir")).otherwise(F.lit(255)), "acc": F.when(F.col("_in"), F.col("acc"))}).drop("_in")


def is_stream(threshold: float) -> Column:
    """Whether a cell's accumulation is a number of at least ``threshold``."""
    return F.col("acc").isNotNull() & ~F.isnan(F.col("acc").cast("double")) & (F.col("acc") >= threshold)


def stream_cells(cells: DataFrame, threshold: float) -> DataFrame:
    """Cells whose accumulation is a number of at least ``threshold``."""
    return cells.filter(is_stream(threshold))


def snapped(cells: DataFrame, points: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(point_id, grid_id, row, col, acc): the nearest stream cell of each point's grid.

    Points are (point_id, grid_id, prow, pcol) in fractional pixels. Distance is from pixel
    centres; ties go to the larger accumulation, then to the first cell in row-major order.
    A point meets the cells of the nine blocks around it by an equi-join, and is done if the best is
    no farther than a block is wide; the others go on with blocks twice as wide, until those span the grid.
    """
    streams = stream_cells(cells, threshold).select("grid_id", "row", "col", "acc")
    spans = streams.groupBy("grid_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for f, n in ((F.min, "least"), (F.max, "most"))])
    near = points.hint("merge").join(spans, "grid_id")
    # as wide as from the point to the farthest end of its grid's stream cells: then nothing is outside
    reach = F.greatest(*[F.abs(F.col(p) - F.col(f"{n}_{c}")) for p, c in (("prow", "row"), ("pcol", "col")) for n in ("least", "most")])
    waiting = written(near.select("point_id", "grid_id", "prow", "pcol", (reach + 1).alias("reach")))
    done, width = None, float(block)
    while True:
        at = lambda c: F.floor(c / F.lit(width)).cast("long")
        around = F.explode(F.array(*[F.struct((at(F.col("prow")) + i).alias("br"), (at(F.col("pcol")) + j).alias("bc")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        asked = waiting.withColumn("b", around).select("*", "b.br", "b.bc").drop("b")
        placed = streams.withColumns({"br": at(F.col("row") + 0.5), "bc": at(F.col("col") + 0.5)})
        dr, dc = F.col("row") + 0.5 - F.col("prow"), F.col("col") + 0.5 - F.col("pcol")
        order = F.struct((dr * dr + dc * dc).alias("d"), (-F.col("acc")).alias("a"), F.col("row").alias("row"), F.col("col").alias("col"))
        met = asked.join(placed, ["grid_id", "br", "bc"]).groupBy("point_id", "grid_id").agg(F.min(order).alias("best"))
        found = written(waiting.join(met, ["point_id", "grid_id"], "left").withColumn("sure", F.coalesce(F.col("best.d") <= width * width, F.lit(False)) | (F.col("reach") <= width)))
        sure = found.filter("sure AND best IS NOT NULL").select("point_id", "grid_id", F.col("best.row").alias("row"), F.col("best.col").alias("col"), (-F.col("best.a")).alias("acc"))
        done = sure if done is None else done.union(sure)
        waiting = found.filter("NOT sure").drop("best", "sure")
        if not waiting.take(1):
            return done
        width *= 2


def traced(cells: DataFrame, pours: DataFrame, encoding: str = "esri") -> DataFrame:
    """(pour_id, grid_id, row, col): all cells that drain to each pour cell (pour_id, grid_id, row, col), itself included.

    A cell drains to one other, so this is the closure of a forest once the links of flow cycles are
    taken out; a pour cell on a cycle has all of the cycle and what drains to it.
    """
    key = lambda r, c: F.struct(F.col("grid_id").alias("g"), F.col(r).cast("long").alias("r"), F.col(c).cast("long").alias("c"))
    there = cells.select(key("row", "col").alias("to_id"))
    flows = downstream(cells, encoding).filter("to_row IS NOT NULL").select(key("row", "col").alias("id"), key("to_row", "to_col").alias("to_id"))
    flows = written(flows.hint("merge").join(there, "to_id", "left_semi").select("id", "to_id"))
    largest = flows.groupBy(F.col("id.g")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]  # no walk leaves its grid
    cycles = written(cycle_members(flows, largest or 0))
    starts = pours.select("pour_id", key("row", "col").alias("id")).join(cycles, "id", "left")
    whole = starts.filter("cycle_id IS NOT NULL").select("pour_id", "cycle_id").join(cycles, "cycle_id").select("pour_id", "id")
    starts = starts.filter("cycle_id IS NULL").select("pour_id", "id").union(whole)
    links = flows.join(cycles.select("id"), "id", "left_anti").select(F.col("to_id").alias("id"), F.col("id").alias("upstream_id"))
    reached = closed_forest(starts.select(F.col("pour_id").alias("terminal_id"), F.col("id").alias("unit_id")), links)
    return reached.select(F.col("terminal_id").alias("pour_id"), F.col("unit_id.g").alias("grid_id"), F.col("unit_id.r").alias("row"), F.col("unit_id.c").alias("col"))


def rasterized(shapes: DataFrame, origin_x: float, origin_y: float, width: float, height: float, rows: int, cols: int, key: str = "id") -> DataFrame:
    """(key, row, col): cells whose centre is inside the rings of ``edges`` (even-odd).

    Each edge meets the scanlines that it spans once; sorted crossings of a scanline pair up, and a
    pair covers the centres from its first crossing on up to, not including, its second. ``height`` is negative.
    """
    e = shapes.select(key, F.explode("edges").alias("e")).select(key, *[((F.col(f"e.{c}") - o) / s).alias(c) for c, o, s in (("x0", origin_x, width), ("y0", origin_y, height), ("x1", origin_x, width), ("y1", origin_y, height))])
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5) - 1, F.lit(rows - 1))
    lines = e.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    at = F.col("x0") + (F.col("row") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    line = Window.partitionBy(key, "row").orderBy("x")
    crossings = lines.select(key, "row", at.alias("x"))
    spans = crossings.withColumns({"n": F.row_number().over(line), "to": F.lead("x").over(line)}).filter("n % 2 = 1 AND to IS NOT NULL")
    a, b = F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)), F.least(F.ceil(F.col("to") - 0.5) - 1, F.lit(cols - 1))
    return spans.filter(a <= b).select(key, "row", F.explode(F.sequence(a, b)).alias("col"))


def outline_edges(cells: DataFrame, key: str, origin_x: float, origin_y: float, width: float, height: float) -> DataFrame:
    """Each cell of a mask (key, row, col) as the four edges of its square, for ``geometry.border_edges``."""
    x = lambda c: F.lit(origin_x) + c * F.lit(width)
    y = lambda r: F.lit(origin_y) + r * F.lit(height)
    west, east, north, south = x(F.col("col")), x(F.col("col") + 1), y(F.col("row")), y(F.col("row") + 1)
    corners: list[tuple[Column, Column]] = [(west, south), (east, south), (east, north), (west, north)]
    edges = [F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)]
    return cells.select(key, F.array(*edges).alias("edges"))


def cell_centres(cells: DataFrame, origin_x: float, origin_y: float, width: float, height: float) -> DataFrame:
    """Adds ``x``, ``y`` of each cell's centre."""
    return cells.withColumns({"x": pixel_centre(F.col("col"), origin_x, width), "y": pixel_centre(F.col("row"), origin_y, height)})
