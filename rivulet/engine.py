"""Batch delineation: outlets in, watersheds out, stage by stage or in one call.

A batch of outlets is a DataFrame and each stage is a join or an aggregate over it, so outlets
that share units read and close them once. A single outlet is a batch of one row.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.closure import closure_faults, upstream_closure
from rivulet.errors import DatasetError, ResolutionError, RivuletError
from rivulet.fabric import Fabric
from rivulet.geometry import border_edges, dissolved, merged_border, piece_edges
from rivulet.refine import MODES, THRESHOLD, Grid, refine_on_grids
from rivulet.resolve import RADIUS_M, TOLERANCE_M, method_label, resolve_by_containment, resolve_by_snap
from rivulet.tables import written
from rivulet.validate import valid_coordinate

#: Different sets of options that one batch may ask for.
MOST_KINDS = 64


@dataclass(frozen=True)
class Options:
    """What a delineation may be asked for; ``least_hole`` None fills all holes, ``use_snap`` None snaps if the fabric has snap targets."""

    use_snap: bool | None = None
    search_radius_m: float = RADIUS_M
    strategy: str = "weight-first"
    tolerance_m: float = TOLERANCE_M
    level: int | None = None
    least_hole: float | None = None
    refinement: str = "best-effort"
    threshold: float = THRESHOLD

    def __post_init__(self):
        if not 0 < self.search_radius_m < float("inf"):
            raise ResolutionError("search_radius", "the search radius must be finite and above 0")
        if not 0 <= self.tolerance_m < float("inf"):
            raise ResolutionError("tolerance", "the tolerance must be finite and not below 0")
        if self.refinement not in MODES:
            raise ResolutionError("refinement", f"refinement {self.refinement!r} is none of {', '.join(MODES)}")

    @classmethod
    def of(cls, **given) -> Options:
        """Options from keyword arguments; an unknown one is named with the nearest that exists."""
        known = [f.name for f in fields(cls)]
        for name in given:
            if name not in known:
                near = difflib.get_close_matches(name, known, 1)
                raise ValueError(f"unknown option {name!r}" + (f"; did you mean {near[0]!r}?" if near else f"; options are {', '.join(known)}"))
        return cls(**given)


class Engine:
    """Delineates outlets over one fabric; ``grids`` are the D8 grids that terminal units are refined on, in the order they are declared."""

    def __init__(self, fabric: Fabric, grids: tuple[Grid, ...] = ()):
        self.fabric, self.grids = fabric, tuple(grids)

    # stages

    def select_level(self, level: int | None = None) -> int:
        """The given level, or the finest."""
        found = self.fabric.units.agg(F.max("level").alias("finest"), F.bool_or(F.col("level") == F.lit(-1 if level is None else level)).alias("there")).first()
        if found["finest"] is None:
            raise DatasetError("empty", "the fabric has no units")
        if level is not None and not found["there"]:
            raise DatasetError("unknown_level", f"no unit is on level {level}")
        return found["finest"] if level is None else level

    def units_at(self, level: int) -> DataFrame:
        return self.fabric.units.filter(F.col("level") == level)

    def snaps(self, options: Options) -> bool:
        return self.fabric.has_snaps if options.use_snap is None else options.use_snap

    def resolve_outlets(self, outlets: DataFrame, level: int, options: Options = Options()) -> DataFrame:
        """(outlet_id, unit_id, method, problem, ...) of the outlets that resolve; snapping never falls back to containment.

        ``outlet_id`` must be there and be unique: :meth:`delineate` puts a row number there.
        """
        if self.snaps(options):
            levels = self.fabric.units.select(F.col("id").alias("unit_id"), F.col("level").alias("unit_level"))
            targets = self.fabric.snaps.join(levels, "unit_id", "left")
            return method_label(resolve_by_snap(outlets, targets, options.search_radius_m, options.strategy, options.tolerance_m, F.col("unit_level") == level, self.fabric.limits))
        return method_label(resolve_by_containment(outlets, self.units_at(level), self.fabric.limits))

    def traverse(self, resolved: DataFrame) -> DataFrame:
        """(terminal_id, unit_id) for every distinct terminal."""
        return upstream_closure(resolved.filter("unit_id IS NOT NULL"), self.fabric.links, self.fabric.topology)

    def faults(self, closure: DataFrame) -> DataFrame:
        """(terminal_id, fault, faulty_unit) of terminals with a unit that is missing or on another level."""
        return closure_faults(closure, self.fabric.units)

    def pre_merge_units(self, closure: DataFrame, level: int) -> DataFrame:
        """The whole units of each terminal before they are merged, terminals included; see :meth:`faults` for those that aren't there."""
        return closure.join(self.units_at(level).withColumnRenamed("id", "unit_id"), "unit_id")

    def measure(self, units: DataFrame) -> DataFrame:
        """(terminal_id, n_units, unit_area_km2, xmin, ymin, xmax, ymax) without any geometry work."""
        return units.groupBy("terminal_id").agg(
            F.count(F.lit(1)).alias("n_units"), F.sum("area_km2").alias("unit_area_km2"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")
        )

    def refine(self, resolved: DataFrame, level: int, options: Options = Options()) -> DataFrame:
        """(outlet_id, terminal_id, status, category, reason, pour_lon, pour_lat, edges) of each resolved outlet
        (outlet_id, terminal_id, lon, lat): its terminal unit, cut to what drains to it."""
        units = self.units_at(level).select(F.col("id").alias("terminal_id"), "edges")
        return refine_on_grids(resolved.join(units, "terminal_id"), self.grids, self.fabric.d8_schemas, options.threshold, options.refinement)

    def border(self, units: DataFrame, level: int, key: str = "terminal_id") -> DataFrame:
        """:func:`border_edges` of whole units (key, edges) of ``level``."""
        return border_edges(units, key, among=self.units_at(level).filter("edges IS NOT NULL"))

    def dissolve(self, units: DataFrame, options: Options = Options(), refined: DataFrame | None = None, level: int | None = None) -> DataFrame:
        """(terminal_id, geometry, area_km2, parts, is_clean). ``refined`` (terminal_id, unit_id, edges)
        replaces the geometry of terminal units. Units of ``level`` that are whole meet where they meet in the fabric."""
        if refined is None and level is not None:
            return dissolved(self.border(units, level), "terminal_id", options.least_hole)
        if refined is not None:
            other = refined.select("terminal_id", "unit_id", F.col("edges").alias("_refined"))
            units = units.join(other, ["terminal_id", "unit_id"], "left").withColumn("edges", F.coalesce("_refined", "edges"))
        return dissolved(border_edges(units, "terminal_id"), "terminal_id", options.least_hole)

    def dissolve_refined(self, units: DataFrame, refined: DataFrame, options: Options = Options()) -> DataFrame:
        """(outlet_id, geometry, area_km2, parts, is_clean) of outlets with their own refined terminal (outlet_id,
        terminal_id, edges): the border of a terminal's other units is found once and met by each different refined shape."""
        led = written(refined.select("outlet_id", "terminal_id", "edges").withColumn("lead", F.min("outlet_id").over(Window.partitionBy("terminal_id", "edges"))))
        refined = led.filter("outlet_id = lead").drop("lead")
        others = border_edges(units.filter("unit_id <> terminal_id").join(refined.select("terminal_id").distinct(), "terminal_id", "left_semi"), "terminal_id")
        theirs = others.join(refined.select("terminal_id", "outlet_id"), "terminal_id").select("outlet_id", F.lit(0).cast("long").alias("piece"), "times", "x0", "y0", "x1", "y1", "crossed")
        own = piece_edges(refined.select("outlet_id", "edges"), "outlet_id").withColumn("crossed", F.lit(False))
        crossed = theirs.filter("crossed").select("outlet_id").distinct().withColumn("before", F.lit(True))
        border = merged_border(theirs.union(own.select(*theirs.columns)).drop("crossed"), "outlet_id").join(crossed, "outlet_id", "left")
        shapes = dissolved(border.withColumn("crossed", F.col("crossed") | F.coalesce("before", F.lit(False))).drop("before"), "outlet_id", options.least_hole)
        return led.select("outlet_id", "lead").join(shapes.withColumnRenamed("outlet_id", "lead"), "lead").drop("lead")

    # one call

    def delineate(self, outlets: DataFrame, options: Options = Options(), geometry: bool = True) -> DataFrame:
        """One row per outlet: where it resolved, its watershed's size and bounds, and, if asked for,
        the dissolved geometry with its geodesic area and how its terminal unit was refined; or ``error`` and nulls.

        ``outlets`` has lon and lat; its other columns, ids that are null or repeat among them, come
        back as they are, except those named like a result, which are replaced. ``outlet_index``
        ascends in the order of the input and is taken from the input if it is there (it must be unique then).
        Outlets with bad coordinates, without a unit, or whose units are missing, on another level,
        without geometry or overlapping get an error each and don't stop the others.
        """
        level = self.select_level(options.level)
        if "outlet_index" not in outlets.columns:
            outlets = outlets.withColumn("outlet_index", F.monotonically_increasing_id())
        asked = written(outlets)
        good = asked.filter(valid_coordinate(self.fabric.limits)).select(F.col("outlet_index").alias("outlet_id"), "lon", "lat")
        found = self.resolve_outlets(good, level, options)
        if "lon" not in found.columns:
            found = found.join(good, "outlet_id")
        resolved = written(found.select("outlet_id", F.col("unit_id").alias("terminal_id"), "method", "problem", "lon", "lat"))
        there = resolved.filter("terminal_id IS NOT NULL")
        closure = written(self.traverse(there.select(F.col("terminal_id").alias("unit_id"))))
        faults = written(self.faults(closure))
        sound = closure.join(faults, "terminal_id", "left_anti")
        units = self.pre_merge_units(sound, level)
        sizes = self.measure(units)
        done = resolved.join(faults.select("terminal_id", "fault"), "terminal_id", "left").join(sizes, "terminal_id", "left")
        error = F.coalesce(F.col("problem"), F.col("fault"))
        columns = ["terminal_id", "method", "resolved_lon", "resolved_lat", "n_units", "unit_area_km2", "xmin", "ymin", "xmax", "ymax"]
        if geometry:
            refined = written(self.refine(there.join(faults, "terminal_id", "left_anti"), level, options))
            applied = refined.filter("status = 'applied'")
            lacking = units.filter("edges IS NULL").groupBy("terminal_id").agg(F.bool_or(F.col("unit_id") != F.col("terminal_id")).alias("other_lacks"), F.lit(True).alias("lacks"))
            done = done.join(refined.drop("terminal_id", "edges"), "outlet_id", "left").join(lacking, "terminal_id", "left")
            if self.grids and options.refinement != "disabled":
                whole = units.join(refined.filter("status <> 'applied'").select("terminal_id").distinct(), "terminal_id", "left_semi")
                shapes = self.dissolve(whole, options, level=level).select("terminal_id", *[F.col(c).alias(f"whole_{c}") for c in SHAPE])
                own = self.dissolve_refined(units, applied, options).select("outlet_id", F.lit(True).alias("cut"), *SHAPE)
                cut = F.coalesce("cut", F.lit(False))
                done = done.join(shapes, "terminal_id", "left").join(own, "outlet_id", "left")
                done = done.withColumns({c: F.when(cut, F.col(c)).otherwise(F.col(f"whole_{c}")) for c in SHAPE})
            else:
                cut, done = F.lit(False), done.join(self.dissolve(units, options, level=level), "terminal_id", "left")
            broken = F.coalesce(F.when(cut, F.col("other_lacks")).otherwise(F.col("lacks")), F.lit(False))
            required = F.when((F.lit(options.refinement) == "require") & (F.col("refinement") != "applied"), F.concat(F.lit("refinement_"), F.col("refinement_reason")))
            error = F.coalesce(error, required, F.when(broken, F.lit("unit_without_geometry")), F.when(~F.coalesce("is_clean", F.lit(True)), F.lit("overlapping_units")))
            columns += [*SHAPE, "refinement", "refinement_category", "refinement_reason", "pour_lon", "pour_lat"]
            done = done.withColumnsRenamed({"status": "refinement", "category": "refinement_category", "reason": "refinement_reason"})
        done = done.withColumnsRenamed({"lon": "resolved_lon", "lat": "resolved_lat", "outlet_id": "outlet_index"}).withColumn("failed", error)
        kept = [F.when(F.col("failed").isNull(), F.col(c)).alias(c) for c in columns]
        missing = "no_snap_candidate" if self.snaps(options) else "outside_all_units"
        rest = asked.drop(*[c for c in (*columns, "error") if c in asked.columns])
        out = rest.join(done.select("outlet_index", F.lit(True).alias("met"), "failed", *kept), "outlet_index", "left")
        error = F.when(~valid_coordinate(self.fabric.limits), F.lit("invalid_coordinate")).when(F.col("met").isNull(), F.lit(missing)).otherwise(F.col("failed"))
        return out.withColumn("error", error).drop("met", "failed")

    def delineate_each(self, outlets: DataFrame, geometry: bool = True) -> DataFrame:
        """:meth:`delineate` with options by row: columns of ``outlets`` named like fields of :class:`Options`
        (null: the default). At most MOST_KINDS different sets of options."""
        names = [f.name for f in fields(Options) if f.name in outlets.columns]
        if "outlet_index" not in outlets.columns:
            outlets = outlets.withColumn("outlet_index", F.monotonically_increasing_id())
        outlets = written(outlets)
        kinds = outlets.select(*names).distinct().limit(MOST_KINDS + 1).collect() if names else []
        if len(kinds) > MOST_KINDS:
            raise ResolutionError("options", f"more than {MOST_KINDS} different sets of options in one batch")
        out = None
        for kind in kinds or [None]:
            given = {} if kind is None else {n: v for n, v in kind.asDict().items() if v is not None}
            rows = outlets
            for n in names:
                rows = rows.filter(F.col(n).eqNullSafe(F.lit(kind[n])))
            part = self.delineate(rows.drop(*names), Options(**given), geometry)
            out = part if out is None else out.unionByName(part)
        return out

    def delineate_stream(self, outlets: DataFrame, sink, options: Options = Options(), checkpoint: str | None = None):
        """Start a streaming query: each micro-batch of outlets is delineated and given to ``sink(results, batch_id)``.

        With a ``checkpoint`` folder the query goes on where it stopped; a batch may then come to the sink again.
        """
        writer = outlets.writeStream.foreachBatch(lambda batch, batch_id: sink(self.delineate(batch, options), batch_id))
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


#: Columns of a dissolved geometry.
SHAPE = ("geometry", "area_km2", "parts", "is_clean")


def raise_first_error(results: DataFrame) -> DataFrame:
    """``results`` if no outlet failed; else the error of the first in the order of the input."""
    first = results.filter("error IS NOT NULL").agg(F.min(F.struct("outlet_index", "error")).alias("f")).first()["f"]
    if first is not None:
        raise RivuletError(first["error"], f"outlet {first['outlet_index']} can't be delineated")
    return results
