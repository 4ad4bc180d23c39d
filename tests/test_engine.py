import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rivulet import closure, dataset, engine, errors, export, fabric, geometry, refine, resolve, tables
from rivulet import expressions as X

SF = "/root/testdata/sf0.001"


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def test_geodesic_area_goldens():
    # 5 x 3 and 5 x 5 degree rectangles south of the equator
    assert math.isclose(geometry.geodesic_area_km2([box(0, -3, 5, 0)]), 184671.66225785605, rel_tol=1e-9)
    assert math.isclose(geometry.geodesic_area_km2([box(0, -5, 5, 0)]), 307541.81354758184, rel_tol=1e-9)
    whole = geometry.geodesic_area_km2([box(10, 40, 12, 41)])
    assert math.isclose(whole, geometry.geodesic_area_km2([box(10, 40, 11, 41)]) + geometry.geodesic_area_km2([box(11, 40, 12, 41)]), rel_tol=1e-4)
    holed = [[*box(0, 0, 4, 4), [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]]]
    assert math.isclose(geometry.geodesic_area_km2(holed), geometry.geodesic_area_km2([box(0, 0, 4, 4)]) - geometry.geodesic_area_km2([box(1, 1, 2, 2)]), rel_tol=1e-9)


def test_geodesic_distance():
    # a quarter of the equator and a meridian quadrant of WGS 84
    got = geometry.geodesic_distance_m([0, 0, 10], [0, 0, 50], [90, 0, 10], [0, 90, 50])
    assert np.allclose(got, [10018754.171394622, 10001965.729312, 0.0], atol=1e-3)


def test_wkb_facts(spark):
    shape = [[*box(0, 0, 4, 4), [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]], box(10, 0, 12, 2)]
    row = spark.createDataFrame([(geometry.to_wkb(shape),)], "g binary").select(geometry.wkb_facts("g").alias("f")).first().f
    assert (row.xmin, row.ymin, row.xmax, row.ymax) == (0, 0, 12, 4) and math.isclose(row.cx, (2 * 12 + 11 * 4) / 16) and math.isclose(row.cy, (2 * 12 + 1 * 4) / 16)


def test_wkb_round_trip():
    shape = [box(0, 0, 1, 1), [*box(2, 2, 5, 5), [(3.0, 3.0), (3.0, 4.0), (4.0, 4.0), (3.0, 3.0)]]]
    assert geometry.from_wkb(geometry.to_wkb(shape)) == [[[tuple(map(float, p)) for p in r] for r in s] for s in shape]


def test_stitch_holes_and_touching_corners():
    cells = [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (1, 2), (2, 2), (3, 3)]  # a ring with a hole, and a cell at its corner
    sides = {}
    for x, y in cells:
        for a, b in (((x, y), (x + 1, y)), ((x + 1, y), (x + 1, y + 1)), ((x + 1, y + 1), (x, y + 1)), ((x, y + 1), (x, y))):
            if (b, a) in sides:
                del sides[b, a]
            else:
                sides[a, b] = 1
    rings = geometry.stitch(np.array([[*a, *b] for a, b in sides]))
    assert sorted(geometry.planar_area(r) for r in rings) == [-1, 1, 9]
    assert len(geometry.polygons(rings)) == 2
    assert [len(p) for p in geometry.polygons(rings, 0.0)] in ([1, 2], [2, 1])


def test_dissolve_does_not_depend_on_order(spark):
    f = fabric.synthetic_fabric(spark, SF)
    units = f.units.filter("id % 2 = 1 OR id < 90").withColumn("terminal_id", F.lit(1))
    e = engine.Engine(f)
    a, b = (e.dissolve(u).select(F.hex("geometry"), "area_km2", "is_clean").collect() for u in (units, units.orderBy(F.rand(3)).repartition(5)))
    assert a == b and a[0].is_clean


def boxes(spark, rows):
    """(k, edges) of boxes (k, x0, y0, x1, y1)."""
    df = spark.createDataFrame([(k, *map(float, r)) for k, *r in rows], "k int, a double, b double, c double, d double")
    return df.select("k", X.rectangle_edges(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("edges"))


def test_t_junctions_dissolve(spark):
    rows = [(1, 0, 0, 2, 1), (1, 0, 1, 1, 2), (1, 1, 1, 2, 2), (2, 0, 0, 3, 3), (2, 3, 1, 4, 2), (2, 3, 0, 4, 1), (2, 3, 2, 5, 3), (2, 4, 0, 5, 2)]
    rows += [(3, x, 0, x + 5, 1) for x in (0, 5)] + [(3, x, 1, x + 2, 2) for x in range(0, 10, 2)]  # each side has vertices on the other's
    got = {r.k: r for r in geometry.dissolved(geometry.border_edges(boxes(spark, rows), "k"), "k").collect()}
    for k, (w, h) in {1: (2, 2), 2: (5, 3), 3: (10, 2)}.items():
        assert got[k].is_clean and got[k].parts == 1
        assert geometry.from_wkb(bytes(got[k].geometry)) == [[[(0.0, 0.0), (w, 0.0), (w, h), (0.0, h), (0.0, 0.0)]]]
    # a slanted border whose middle vertex, rounded to the grid, lies beside the long edge
    slant = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0)], [(0.0, 0.0), (3.0, 1.0), (0.0, 1.0)], [(1.0000000, 1 / 3), (0.0, 0.0), (1.0, 0.0)]
    lower = [[(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1 / 3)]]
    pieces = [[*lower[0]], list(slant[1])]
    rings = [(1, [dict(x0=a[0], y0=a[1], x1=b[0], y1=b[1]) for a, b in zip(r, [*r[1:], r[0]], strict=True)]) for r in pieces]
    df = spark.createDataFrame(rings, "k int, edges array<struct<x0:double,y0:double,x1:double,y1:double>>")
    row = geometry.dissolved(geometry.border_edges(df, "k"), "k").first()
    assert row.is_clean and row.parts == 1 and len(geometry.from_wkb(bytes(row.geometry))[0][0]) == 5


@pytest.mark.parametrize("rows", [[(1, 0, 0, 1, 1), (1, 0.5, 0, 1.5, 1)], [(1, 0, 0, 1, 1), (1, 0.5, 0.5, 1.5, 1.5)], [(1, 0, 0, 1, 1)] * 2, [(1, 0, 0, 3, 3), (1, 1, 1, 2, 2)], [(1, 0, 1, 3, 2), (1, 1, 0, 2, 3)]])
def test_overlaps_are_no_geometry(spark, rows):
    row = geometry.dissolved(geometry.border_edges(boxes(spark, rows), "k"), "k").first()
    assert not row.is_clean and row.geometry is None and row.area_km2 is None and row.parts is None


def test_islands_and_holes():
    def ring(x0, y0, x1, y1, left=True):
        p = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]) * 10**geometry.DECIMALS
        return p if left else p[::-1]

    rings = [ring(0, 0, 9, 9), ring(1, 1, 8, 8, False), ring(2, 2, 7, 7), ring(3, 3, 4, 4, False)]
    assert not geometry.overlapping(rings) and geometry.overlapping([rings[0], rings[2]])
    assert [len(p) for p in geometry.polygons(rings)] == [1]  # all holes filled: the island with them
    assert [len(p) for p in geometry.polygons(rings, 0.0)] == [2, 2]
    assert [len(p) for p in geometry.polygons(rings, 10.0)] == [2, 1]
    assert geometry.planar_area(geometry.largest_polygon([[rings[2]], [rings[0]]])[0]) == 81 * 10 ** (2 * geometry.DECIMALS)


def test_closures_agree_and_report_faults(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "id long, upstream_id long")
    start = spark.createDataFrame([(0,), (290,)], "unit_id long")
    want = {(0, i) for i in range(301)} | {(290, i) for i in range(290, 301)}
    assert {tuple(r) for r in closure.upstream_closure(start, chain).collect()} == want
    diamond = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)], "id long, upstream_id long")
    got = [tuple(r) for r in closure.upstream_closure(start.limit(1), diamond, "dag").collect()]
    assert sorted(got) == [(0, i) for i in range(5)]
    with pytest.raises(errors.TraversalError, match="cycle"):
        closure.upstream_closure(start, spark.createDataFrame([(0, 1), (1, 0)], "id long, upstream_id long"))
    units = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, level int")
    with pytest.raises(errors.TraversalError, match="level_crossing"):
        closure.check_closure(spark.createDataFrame([(0, 1), (0, 2)], "terminal_id long, unit_id long"), units)
    with pytest.raises(errors.TraversalError, match="dangling"):
        closure.check_closure(spark.createDataFrame([(0, 9)], "terminal_id long, unit_id long"), units)


def test_equal_earth_controls(spark):
    row = spark.range(1).select(X.equal_earth(F.lit(23.5), F.lit(-17.25)).alias("p"), X.equal_earth(F.lit(0.0), F.lit(15.0)).alias("q")).first()
    assert abs(row.p.x - 2203165.970658505) < 1e-6 and abs(row.p.y + 2199534.790026376) < 1e-6 and abs(row.q.y - 1916239.6896184457) < 1e-6
    out = spark.range(1).select(X.equal_earth_inverse(F.lit(0.0), F.lit(9e6)).alias("p")).first()
    assert out.p is None


def test_outward_float(spark):
    values = [0.1, -0.1, 0.5, 1e-3, 179.99999999, -89.123456789, 1 - 1e-9, 1 + 1e-9, -1 + 1e-9, -1 - 1e-9, 0.25 - 1e-12, 64 - 1e-7, -0.125 - 1e-11]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.outward_float(F.col("v"), True).cast("double").alias("u"), X.outward_float(F.col("v"), False).cast("double").alias("d"))
    for r in rows.collect():
        near = float(np.float32(r.v))
        assert r.u == (near if near >= r.v else float(np.nextafter(np.float32(r.v), np.float32(np.inf))))
        assert r.d == (near if near <= r.v else float(np.nextafter(np.float32(r.v), np.float32(-np.inf))))


def test_stages_equal_one_call(spark):
    f = fabric.synthetic_fabric(spark, SF)
    e, outlets = engine.Engine(f), fabric.synthetic_outlets(spark, SF).filter("outlet_id < 40")
    level = e.select_level()
    resolved = e.resolve_outlets(outlets, level)
    units = e.pre_merge_units(e.traverse(resolved), level)
    staged = {r.terminal_id: (bytes(r.geometry), r.area_km2) for r in e.dissolve(units).collect()}
    whole = e.delineate(outlets).collect()
    assert len(whole) == 40 and all(r.error is None for r in whole)
    assert all((bytes(r.geometry), r.area_km2) == staged[r.terminal_id] for r in whole)
    assert all(r.error == "no_snap_candidate" for r in e.delineate(outlets, engine.Options(use_snap=True, search_radius_m=0.001), geometry=False).collect())


def small_fabric(spark, bad=()):
    """Three units in a row, 2 and 3 upstream of 1; ``bad`` ones have no geometry."""
    rows = [(i, 0, 1.0, None, i - 1.0, 0.0, float(i), 1.0) for i in (1, 2, 3)]
    units = spark.createDataFrame(rows, "id long, level smallint, area_km2 double, up_area_km2 double, xmin double, ymin double, xmax double, ymax double")
    edges = X.rectangle_edges(*map(F.col, ("xmin", "ymin", "xmax", "ymax")))
    units = units.withColumn("edges", F.when(~F.col("id").isin(*bad, -1), edges))
    links = spark.createDataFrame([(1, 2), (2, 3)], "id long, upstream_id long")
    return fabric.Fabric(units, links, spark.createDataFrame([], "snap_id long, unit_id long, weight double, stem_role string, lon double, lat double"))


def test_ids_may_be_null_and_repeat(spark):
    outlets = spark.createDataFrame([(None, 0.5, 0.5), (None, 2.5, 0.5), ("a", 1.5, 0.5), ("a", 0.5, 0.5), ("b", 99.0, 0.5), ("b", None, 0.5)], "outlet_id string, lon double, lat double").coalesce(1)
    rows = engine.Engine(small_fabric(spark)).delineate(outlets).orderBy("outlet_index").collect()
    assert [(r.outlet_id, r.terminal_id, r.n_units, r.parts, r.error) for r in rows] == [
        (None, 1, 3, 1, None), (None, 3, 1, 1, None), ("a", 2, 2, 1, None), ("a", 1, 3, 1, None), ("b", None, None, None, "outside_all_units"), ("b", None, None, None, "invalid_coordinate")
    ]
    assert {r.refinement_reason for r in rows[:4]} == {"no_d8_declared"}
    with pytest.raises(errors.RivuletError, match="outside_all_units"):
        engine.raise_first_error(engine.Engine(small_fabric(spark)).delineate(outlets, geometry=False))


def test_lost_units_and_geometries_are_errors(spark):
    outlets = spark.createDataFrame([(i, i - 0.5, 0.5) for i in (1, 2, 3)], "outlet_id long, lon double, lat double")
    f = small_fabric(spark)
    lost = engine.Engine(fabric.Fabric(f.units.filter("id <> 3"), f.links, f.snaps)).delineate(outlets).orderBy("outlet_id").collect()
    assert [(r.error, r.n_units) for r in lost] == [("dangling_upstream_reference", None)] * 2 + [("outside_all_units", None)]
    torn = engine.Engine(small_fabric(spark, bad=(2,))).delineate(outlets).orderBy("outlet_id").collect()
    assert [(r.error, r.parts) for r in torn] == [("unit_without_geometry", None), ("all_geometries_corrupt", None), (None, 1)]
    wide = f.units.withColumn("edges", X.rectangle_edges(F.col("xmin"), F.col("ymin"), F.when(F.col("id") == 2, 2.4).otherwise(F.col("xmax")), F.col("ymax")))
    over = engine.Engine(fabric.Fabric(wide, f.links, f.snaps)).delineate(outlets).orderBy("outlet_id").collect()
    assert [r.error for r in over] == ["overlapping_units"] * 2 + [None]


def test_options_by_row(spark):
    outlets = spark.createDataFrame([(1, 0.5, 0.5, None), (2, 0.5, 0.5, True), (3, 2.5, 0.5, False)], "outlet_id long, lon double, lat double, use_snap boolean")
    rows = engine.Engine(small_fabric(spark)).delineate_each(outlets, geometry=False).orderBy("outlet_id").collect()
    assert [(r.terminal_id, r.error) for r in rows] == [(1, None), (None, "no_snap_candidate"), (3, None)]


def test_delineate_refines_each_outlets_terminal(spark):
    # 2 x 2 cells a unit: all drain east along their row, and the first column's cells are streams
    cells = spark.createDataFrame([(r, c, 1 if c % 2 == 0 else 0, 500.0 if c % 2 else 1.0) for r in range(2) for c in range(6)], "row int, col int, dir int, acc double")
    grid = refine.Grid(cells, 0.0, 1.0, 0.5, -0.5, 2, 6)
    outlets = spark.createDataFrame([(1, 0.9, 0.9), (2, 0.9, 0.1), (3, 2.9, 0.9)], "outlet_id long, lon double, lat double")
    e = engine.Engine(small_fabric(spark), (grid,))
    rows = e.delineate(outlets, engine.Options(threshold=400.0)).orderBy("outlet_id").collect()
    upper, lower, alone = ([[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]] for x0, y0, x1, y1 in ((1, 0, 3, 1), (1, 0, 3, 1), (2, 0.5, 3, 1)))
    assert [r.refinement for r in rows] == ["applied"] * 3 and [(r.pour_lon, r.pour_lat) for r in rows] == [(0.75, 0.75), (0.75, 0.25), (2.75, 0.75)]
    assert geometry.from_wkb(bytes(rows[0].geometry)) == [[[(0.0, 0.5), (1.0, 0.5), (1.0, 0.0), (3.0, 0.0), (3.0, 1.0), (0.0, 1.0), (0.0, 0.5)]]]
    assert geometry.from_wkb(bytes(rows[1].geometry)) == [[[(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 0.5), (0.0, 0.5), (0.0, 0.0)]]]
    assert geometry.from_wkb(bytes(rows[2].geometry)) == [[[(2.0, 0.5), (3.0, 0.5), (3.0, 1.0), (2.0, 1.0), (2.0, 0.5)]]]
    skipped = e.delineate(outlets, engine.Options(threshold=4000.0)).collect()
    assert {(r.refinement, r.refinement_category, r.refinement_reason, r.error) for r in skipped} == {("skipped", "data-geometry-integrity", "no_stream", None)}
    assert {r.error for r in e.delineate(outlets, engine.Options(threshold=4000.0, refinement="require")).collect()} == {"refinement_no_stream"}
    assert {r.refinement for r in e.delineate(outlets, engine.Options(refinement="disabled")).collect()} == {"disabled"}
    small = refine.Grid(cells, 0.0, 1.0, 0.3, -0.3, 2, 6)
    assert {r.refinement_reason for r in engine.Engine(small_fabric(spark), (small,)).delineate(outlets).collect()} == {"no_covering_tile"}
    declared = fabric.Fabric(*(getattr(small_fabric(spark), n) for n in ("units", "links", "snaps")), d8_schemas=fabric.D8Declarations(0, "hfx.aux.d8_raster.v1"))
    assert {r.refinement_category for r in engine.Engine(declared).delineate(outlets).collect()} == {"mis-declaration"}


def test_snap_geometries(spark, tmp_path):
    import struct

    point, line = struct.pack("<BIdd", 1, 1, 0.5, 0.5), struct.pack("<BII4d", 1, 2, 2, 0.0, 0.2, 1.0, 0.2)
    near = {"xmin": 1.4, "ymin": 0.4, "xmax": 1.6, "ymax": 0.6}
    rows = [(1, 1, 1.0, "mainstem", None, point), (2, 1, 2.0, None, None, line), (3, 2, 1.0, None, near, geometry.to_wkb([box(0, 0, 1, 1)])), (4, 2, 1.0, None, None, b"xx"), (5, 2, 1.0, None, None, None)]
    spark.createDataFrame(rows, "id long, unit_id long, weight float, stem_role string, bbox struct<xmin:float,ymin:float,xmax:float,ymax:float>, geometry binary").write.parquet(f"{tmp_path}/snap.parquet")
    raw = spark.read.parquet(f"{tmp_path}/snap.parquet").withColumnRenamed("bbox", "box")
    snaps = raw.mapInArrow(dataset._shapes, dataset.SHAPES).withColumnRenamed("id", "snap_id")
    assert [r.problem for r in snaps.orderBy("snap_id").collect()] == [None, None, "unsupported_snap_geometry", "corrupt_snap_geometry", "null_snap_geometry"]
    f = small_fabric(spark)
    e = engine.Engine(fabric.Fabric(f.units, f.links, snaps, has_snaps=True))
    outlets = spark.createDataFrame([(1, 0.6, 0.25), (2, 1.5, 0.5), (3, 2.9, 0.9)], "outlet_id long, lon double, lat double")
    got = e.delineate(outlets, engine.Options(search_radius_m=40_000.0), geometry=False).orderBy("outlet_id").collect()
    assert (got[0].terminal_id, got[0].resolved_lon, got[0].resolved_lat) == (1, 0.6, 0.2) and "weight=Weight(2.0), mainstem=None, candidates=2" in got[0].method
    assert [r.error for r in got] == [None, "unsupported_snap_geometry", "no_snap_candidate"]


def test_corrupt_unit_geometries_are_null(spark):
    shapes = [(1, geometry.to_wkb([box(0, 0, 1, 1)])), (2, b"\x01\x03"), (3, None), (4, geometry.to_wkb([box(0, 0, 1, float("nan"))]))]
    got = spark.createDataFrame(shapes, "id long, geometry binary").mapInArrow(dataset._edges, f"id long, edges {dataset.EDGES}").collect()
    assert {r.id: r.edges is None for r in got} == {1: False, 2: True, 3: True, 4: True}


def test_refined_terminal_replaces_geometry(spark):
    f = fabric.synthetic_fabric(spark, SF)
    e = engine.Engine(f)
    units = f.units.filter("id IN (1, 2)").withColumnRenamed("id", "unit_id").withColumn("terminal_id", F.lit(1).cast("long"))
    half = f.units.filter("id = 1").select(F.lit(1).cast("long").alias("terminal_id"), F.col("id").alias("unit_id"), X.rectangle_edges(*map(F.col, ("xmin", "ymin", "xmax", "ymax"))).alias("e"))
    half = half.select("terminal_id", "unit_id", F.transform("e", lambda s: F.struct(s["x0"].alias("x0"), F.least(s["y0"], F.lit(-9.95)).alias("y0"), s["x1"].alias("x1"), F.least(s["y1"], F.lit(-9.95)).alias("y1"))).alias("edges"))
    assert e.dissolve(units, refined=half).first().area_km2 < e.dissolve(units).first().area_km2


def test_options_are_checked():
    with pytest.raises(ValueError, match="search_radius_m"):
        engine.Options.of(search_radius=5)
    for bad in ({"search_radius_m": 0.0}, {"search_radius_m": float("nan")}, {"tolerance_m": -1.0}):
        with pytest.raises(errors.ResolutionError):
            engine.Options(**bad)


def test_unknown_level(spark):
    e = engine.Engine(fabric.synthetic_fabric(spark, SF))
    with pytest.raises(errors.DatasetError, match="unknown_level"):
        e.select_level(3)


def test_export_checks_and_geoparquet(spark, tmp_path):
    f = fabric.synthetic_fabric(spark, SF)
    e = engine.Engine(f)
    units = e.pre_merge_units(e.traverse(f.units.filter("id <= 9").select(F.col("id").alias("unit_id"))), 0)
    rows = e.measure(units).join(e.dissolve(units), "terminal_id").withColumns({"cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2})
    out = export.basin_rows(rows, export.delineation_label("synthetic", "1", "no-refine"))
    export.check_exportable(out)
    with pytest.raises(errors.ExportError, match="duplicate"):
        export.check_exportable(out.union(out))
    with pytest.raises(errors.ExportError, match="empty"):
        export.check_exportable(out.limit(0))
    with pytest.raises(errors.ExportError, match="missing_version"):
        export.delineation_label("f", None, "no-refine")
    export.write_geoparquet(out, f"{tmp_path}/basins", file_rows=3)
    assert len(list((tmp_path / "basins").glob("*.parquet"))) == 3
    assert export.write_geoparquet(out, f"{tmp_path}/basins") == 9  # again, with fewer files: nothing of the first stays
    files = sorted((tmp_path / "basins").glob("*.parquet"))
    assert len(files) == 1 and not list(tmp_path.glob("*.staging*"))
    table = pq.read_table(files[0])
    geo = json.loads(table.schema.metadata[b"geo"])
    assert geo["version"] == "1.1.0" and geo["columns"]["geometry"]["geometry_types"] == ["MultiPolygon"]
    assert geo["columns"]["geometry"]["bbox"] == list(rows.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first())
    assert "hilbert" not in table.column_names
    order = {r.basin_id: i for i, r in enumerate(out.collect())}
    assert [order[b] for b in table["basin_id"].to_pylist()] == sorted(order.values())


def test_row_groups_of_a_large_export(spark, tmp_path):
    shape = geometry.to_wkb([box(0, 0, 1, 1)])
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("basin_id"), F.lit("d").alias("delineation"), F.lit(shape).alias("geometry"), F.col("id").alias("hilbert"), *[F.lit(float(i)).alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))])
    assert export.write_geoparquet(rows, f"{tmp_path}/many") == 20_000
    meta = pq.ParquetFile(next((tmp_path / "many").glob("*.parquet"))).metadata
    sizes = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(sizes) == 20_000 and all(export.LEAST_GROUP <= n <= export.MOST_GROUP for n in sizes)


def test_unit_bundle_and_collisions(spark, tmp_path):
    shape = geometry.to_wkb([box(0, 0, 2, 1)])
    units = spark.createDataFrame([(1, 1, 0, 2.0, None, 0.5, 0.5, shape), (1, 2, 0, 2.0, 3.0, 0.5, 0.5, shape)], "terminal_id long, unit_id long, level smallint, area_km2 double, up_area_km2 double, outlet_lon double, outlet_lat double, geometry binary")
    status = spark.createDataFrame([(1, "applied")], "terminal_id long, status string")
    table = export.unit_table(units, "f/1/no-refine", status)
    assert export.write_geoparquet(table, f"{tmp_path}/units", ("hilbert", "unit_id", "delineation")) == 2
    back = pq.read_table(next((tmp_path / "units").glob("*.parquet")))
    assert back["unit_id"].to_pylist() == [1, 2] and set(back["refinement_status"].to_pylist()) == {"applied"} and back["bbox_maxx"].to_pylist() == [2.0, 2.0]
    two = spark.createDataFrame([("7", "d", 0.0, 0.0), ("7", "d", 1.0, 0.0)], "basin_id string, delineation string, _lon double, _lat double")
    with pytest.raises(errors.ExportError, match="default_id_collision"):
        export.check_exportable(two)


def manifest(**change):
    base = {"format_version": "0.3.0", "fabric_name": "f", "crs": "EPSG:4326", "topology": "tree", "bbox": [0, 0, 1, 1], "unit_count": 3, "created_at": "now", "adapter_version": "1"}
    return json.dumps({k: v for k, v in (base | change).items() if v is not None})


@pytest.mark.parametrize(
    ("change", "kind"),
    [({"format_version": "9", "crs": None}, "format_version"), ({"crs": "EPSG:3857"}, "crs"), ({"topology": "ring"}, "topology"), ({"bbox": [0, 0, 0, 1]}, "bbox"), ({"fabric_name": None}, "missing_field"),
     ({"auxiliary": [{"schema": "x", "artifacts": {"a": "../b"}}]}, "path_escape"), ({"auxiliary": [{"schema": "x", "artifacts": {}}]}, "auxiliary"), ({"bbox": [0, 0, "a", 1]}, "bbox"), ({"unit_count": "3"}, "unit_count"),
     ({"auxiliary": [{"schema": "hfx.aux.d8_raster.v2", "artifacts": {"flow_dir": "a", "flow_acc": "b"}, "metadata": {"crs": "EPSG:3857", "flow_dir_encoding": "esri", "flow_acc_units": "cells"}}]}, "d8_metadata"),
     ({"auxiliary": [{"schema": "hfx.aux.snap.v2", "artifacts": {"snap": "a"}, "metadata": {"name": "n", "description": "d", "weight_semantics": "w", "references_levels": [-1]}}]}, "snap_metadata")],
)
def test_manifest_errors(change, kind):
    with pytest.raises(errors.DatasetError) as found:
        dataset.parse_manifest(manifest(**change))
    assert found.value.kind == kind


def test_auxiliary_declarations():
    snap = lambda name, path, levels: {"schema": "hfx.aux.snap.v2", "artifacts": {"snap": path}, "metadata": {"name": name, "description": "d", "weight_semantics": "w", "references_levels": levels}}
    found = dataset.parse_manifest(manifest(auxiliary=[snap("b", "x", [0, 1]), snap("a", "z", [1]), snap("a", "y", [1]), {"schema": "hfx.aux.d8_raster.v1"}, {"schema": "com.other.v1", "artifacts": {"a": "b"}}]))
    assert found.snap_for(1)["artifacts"]["snap"] == "y" and found.snap_for(0)["artifacts"]["snap"] == "x" and found.snap_for(2) is None
    assert found.d8 == fabric.D8Declarations(0, "hfx.aux.d8_raster.v1") and len(found.of_kind("generic")) == 1
    with pytest.raises(errors.DatasetError, match="object"):
        dataset.parse_manifest("[]")


def test_open_dataset(spark, tmp_path):
    rows = [(i, 0, 1.0, {"xmin": 0.5 * i, "ymin": 0.0, "xmax": 0.5 * i + 0.5, "ymax": 0.5}, geometry.to_wkb([box(0.5 * i, 0, 0.5 * i + 0.5, 0.5)])) for i in range(3)]
    spark.createDataFrame(rows, "id long, level smallint, area_km2 float, bbox struct<xmin:float,ymin:float,xmax:float,ymax:float>, geometry binary").write.parquet(f"{tmp_path}/catchments.parquet")
    spark.createDataFrame([(0, 0, []), (1, 0, [0]), (2, 0, [1])], "id long, level smallint, upstream_ids array<bigint>").write.parquet(f"{tmp_path}/graph.parquet")
    (tmp_path / "manifest.json").write_text(manifest())
    opened, f = dataset.open_dataset(spark, str(tmp_path))
    outlets = spark.createDataFrame([("a", 1.2, 0.2), ("b", 9.0, 9.0)], "outlet_id string, lon double, lat double")
    got = {r.outlet_id: r for r in engine.Engine(f).delineate(outlets).collect()}
    assert got["a"].n_units == 3 and got["a"].parts == 1 and got["b"].error == "outside_all_units"
    assert math.isclose(got["a"].area_km2, geometry.geodesic_area_km2([box(0, 0, 1.5, 0.5)]), rel_tol=1e-6)
    (tmp_path / "manifest.json").write_text(manifest(unit_count=4))
    with pytest.raises(errors.DatasetError, match="unit_count"):
        dataset.open_dataset(spark, str(tmp_path))


def test_outlets_from_csv(spark, tmp_path):
    (tmp_path / "o.csv").write_text("id,lat,lon\n1,2.5,3.5\n,x,4\n")
    rows = dataset.read_outlets(spark, f"{tmp_path}/o.csv").collect()
    assert [tuple(r) for r in rows] == [("1", None, 3.5, 2.5), (None, None, 4.0, None)]
    (tmp_path / "p.csv").write_text("id,lat\n1,2\n")
    with pytest.raises(errors.DatasetError, match="lon"):
        dataset.read_outlets(spark, f"{tmp_path}/p.csv")


def test_latitudes_without_limit(spark):
    """The synthetic fabric goes on past 90 degrees from 100,000 parts on; its SQL cuts nothing there."""
    units = spark.createDataFrame([(1, 0, 5.0, None, -15.0, 95.0, -14.9, 95.1)], "id long, level short, area_km2 double, up_area_km2 double, xmin double, ymin double, xmax double, ymax double")
    units = units.withColumn("edges", X.rectangle_edges(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
    snaps = spark.createDataFrame([(7, 1, 2.0, "mainstem", -14.96, 95.06)], "snap_id long, unit_id long, weight double, stem_role string, lon double, lat double")
    f = fabric.Fabric(units, spark.createDataFrame([], "id long, upstream_id long"), snaps, limits=fabric.UNBOUNDED)
    outlets = spark.createDataFrame([("in", -14.95, 95.05), ("far", 200.0, 95.05), ("nan", -14.95, float("nan"))], "outlet_id string, lon double, lat double")
    got = {r.outlet_id: r for r in engine.Engine(f).delineate(outlets, geometry=False).collect()}
    assert (got["in"].terminal_id, got["in"].error) == (1, None)
    assert {got[k].error for k in ("far", "nan")} == {"invalid_coordinate"}
    near = {r.outlet_id: r for r in engine.Engine(f).delineate(outlets, engine.Options(use_snap=True, search_radius_m=5000.0), geometry=False).collect()}
    assert (near["in"].terminal_id, near["in"].error) == (1, None)
    on_globe = engine.Engine(fabric.Fabric(f.units, f.links, f.snaps)).delineate(outlets, geometry=False)
    assert {r.error for r in on_globe.collect()} == {"invalid_coordinate"}
    free = outlets.filter("outlet_id = 'in'").select(X.search_bbox(F.col("lon"), F.col("lat"), 1000.0, (math.inf, math.inf)).alias("b")).first().b
    assert free.ymin < 95.05 < free.ymax


def test_morton_keys_off_the_globe(spark):
    rows = spark.createDataFrame([(10.0, 250.0), (10.0, -400.0), (10.0, 20.0)], "x double, y double")
    for r in rows.select("x", "y", X.morton_key(F.col("x"), F.col("y"), wrap=True).alias("m"), X.morton_key(F.col("x"), F.col("y")).alias("cut")).collect():
        xi, yi = (math.floor((v + 180.0) / 360.0 * 65535.0 + 0.5) for v in (r.x, r.y))
        assert r.m == sum((xi >> b & 1) << 2 * b | (yi >> b & 1) << 2 * b + 1 for b in range(16))
        assert (r.m == r.cut) == (r.y == 20.0)


def test_borders_of_keys_that_share_pieces(spark):
    """With the table of all pieces, borders are those found key by key: cells that fit, corners on longer sides, crossings, one shape twice."""
    boxes = {1: (0, 0, 1, 1), 2: (1, 0, 2, 1), 3: (0, 1, 2, 2), 4: (2, 0, 4, 2), 5: (-1, 0.4, 5, 0.6), 6: (7, 7, 8, 8), 7: (8, 7, 9, 8)}
    rows = spark.createDataFrame([(i, *map(float, b)) for i, b in boxes.items()], "unit long, x0 double, y0 double, x1 double, y1 double")
    pieces = rows.select("unit", X.rectangle_edges(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("edges"))
    keys = [(1, [1, 2]), (2, [1, 2, 3]), (3, [3, 4]), (4, [1, 5]), (5, [6, 7]), (6, [6]), (7, [1, 2, 3, 4]), (8, [1, 1, 2])]
    held = spark.createDataFrame([(k, u) for k, us in keys for u in us], "key long, unit long").join(pieces, "unit")
    plain = lambda df: sorted(map(tuple, df.select("key", "x0", "y0", "x1", "y1", "times", "crossed").collect()))
    want = plain(geometry.border_edges(held, "key"))
    assert plain(geometry.border_edges(held, "key", among=pieces)) == want
    assert {r[0] for r in want if r[6]} == {4}
    fitting = held.filter("unit > 5")
    assert plain(geometry.border_edges(fitting, "key", among=pieces.filter("unit > 5"))) == [r for r in want if r[0] in (5, 6)]
    assert not geometry.meeting_edges(pieces.filter("unit > 5")).take(1) and geometry.meeting_edges(pieces).take(1)


def test_scratch_tables_pass_no_rows_through_the_driver(spark):
    from rivulet.tables import written

    a, b = (written(spark.range(50).withColumn(c, F.col("id"))) for c in "ab")
    plan = a.join(b.filter("b > 3").groupBy("id").agg(F.max("b")), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    nodes = spark.range(40).select((F.col("id") + 1).alias("id"))
    links = nodes.filter("id > 1").select(F.expr("id div 2").alias("id"), F.col("id").alias("upstream_id"))
    for kind in ("tree", "dag"):
        reached = closure.upstream_closure(nodes.withColumnRenamed("id", "unit_id"), links, kind)
        joined = reached.join(nodes.withColumnRenamed("id", "unit_id"), "unit_id")
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_dag_rounds_do_not_read_what_is_closed(spark, monkeypatch):
    monkeypatch.setattr(closure, "TERMINALS", 800, raising=False)
    links = sorted({(i // k, i) for i in range(2, 2000) for k in (2, 3) if i // k})
    above = {i: {i} for i in range(1, 2001)}
    for a, b in reversed(links):
        above[a] |= above[b]
    start = spark.createDataFrame([(i,) for i in range(1, 2001)], "unit_id long")  # 2000 has no link
    store = spark._jsparkSession.sharedState().statusStore()
    since = store.executionsList().size()
    rows = closure.upstream_closure(start, spark.createDataFrame(links * 2, "id long, upstream_id long"), "dag").collect()
    want = sorted((t, u) for t, us in above.items() for u in us)
    assert sorted((r.terminal_id, r.unit_id) for r in rows) == want
    read, executions = 0, store.executionsList()
    for i in range(since, executions.size()):
        key = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size() if node.name().startswith("Scan parquet") else 0)):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    read += int(values.apply(m.accumulatorId()).replace(",", ""))
    assert 0 < read < 2 * len(want), (read, len(want))


def test_a_cycle_in_a_dag_is_closed_once(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "id long, upstream_id long")
    start = spark.createDataFrame([(0,), (3,)], "unit_id long")
    assert sorted(tuple(r) for r in closure.upstream_closure(start, links, "dag").collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (3, 3)]


def test_row_group_table_deals_out_its_blocks(spark):
    ns = [1, 4095, 4096, 8192, 8193, 10**8, 10**8 + 8191]  # the last ones have 12,208 groups each
    plans = spark.createDataFrame([(n,) for n in [0, -1, None, *ns]], "n long").coalesce(1)
    got = export.row_group_table(plans)
    tasks = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("rows")).collect()
    assert len(tasks) > 1 and max(t.rows for t in tasks) < 24_000
    want = plans.select("n", F.posexplode(export.row_groups(F.col("n"))).alias("g", "size")).select("n", F.col("g") + 1, "size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_snap_meets_targets_once_for_outlets_at_one_place(spark, monkeypatch):
    seen = []
    join = resolve.cell_join
    monkeypatch.setattr(resolve, "cell_join", lambda left, right, *a: seen.append(left.count()) or join(left, right, *a))
    outlets = spark.range(1000).select(F.col("id").alias("outlet_id"), (F.col("id") % 3 / 10.0).alias("lon"), F.lit(5.0).alias("lat"))
    line = lambda x: [(x, 5.0), (x + 0.01, 5.01)]
    rows = [(1, 10, 2.0, "tributary", line(0.001)), (2, 20, 2.0, "mainstem", line(0.002)), (3, 30, None, "mainstem", line(0.0)), (4, 40, 9.0, None, line(0.05)), (5, 50, None, "mainstem", line(0.1)), (6, 60, None, "mainstem", line(0.1))]
    snaps = spark.createDataFrame(rows, "snap_id long, unit_id long, weight double, stem_role string, points array<struct<x:double,y:double>>")
    got = resolve.resolve_by_snap(outlets, snaps, 2000.0).collect()
    assert sorted({(round(r.outlet_id % 3 / 10.0, 1), r.unit_id, r.weight, r.candidates) for r in got}) == [(0.0, 20, 2.0, 3), (0.1, 50, None, 2)]
    near = resolve.resolve_by_snap(outlets, snaps, 2000.0, "distance-first", 150.0).filter("outlet_id = 0").first()
    assert (near.unit_id, near.candidates, near.distance_m > 100) == (10, 3, True)
    assert len(got) == 334 + 333 and seen == [3, 3]


def _cell_borders():
    """Borders (k, x0, y0, x1, y1, times, crossed) of random sets of cells, some far north, crossed or with an edge too many."""
    rng, rows = np.random.default_rng(3), []
    for k in range(300):
        wide, north = int(rng.integers(1, 9)), 0 if k % 2 else 50
        sides = set()
        for x, y in {(int(x), int(y)) for x, y in rng.integers(0, wide + 1, (int(rng.integers(1, 30)), 2))}:
            for a, b in (((x, y), (x + 1, y)), ((x + 1, y), (x + 1, y + 1)), ((x + 1, y + 1), (x, y + 1)), ((x, y + 1), (x, y))):
                sides.symmetric_difference_update({(b, a)} if (b, a) in sides else {(a, b)})
        rows += [(k, *(10**6 * v for v in (a[0], a[1] + north, b[0], b[1] + north)), 1, k % 50 == 7) for a, b in sorted(sides)]
        if k % 60 == 5:
            rows.append((k, 0, 0, 10**6, 0, 1, False))
    return rows


def test_borders_are_dissolved_many_at_once(monkeypatch):
    rows, one_by_one, alone = _cell_borders(), geometry._shape, []
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("k", "x0", "y0", "x1", "y1", "times", "crossed"))})
    monkeypatch.setattr(geometry, "_shape", lambda e, hole: alone.append(1) or one_by_one(e, hole))
    for hole in (None, 0.0):
        alone.clear()
        for r in geometry._dissolve(table, "k", hole).to_pylist():
            mine = [x for x in rows if x[0] == r["k"]]
            e = np.array([x[1:5] for x in mine])
            sound = sorted(map(tuple, e[:, :2])) == sorted(map(tuple, e[:, 2:])) and not mine[0][6]
            wkb, area, parts = one_by_one(e, hole) if sound else (None, None, None)
            assert (r["geometry"], r["parts"], r["is_clean"]) == (wkb, parts, wkb is not None)
            assert r["area_km2"] == area or math.isclose(r["area_km2"], area, rel_tol=1e-12)
        unsound = geometry._dissolve(table.filter(table["crossed"]), "k", hole).to_pylist()
        assert unsound and not any(r["is_clean"] or r["geometry"] for r in unsound)
        assert 0 < len(alone) < 200  # those with holes or pieces within others' bounds


def test_groups_go_on_over_batches():
    batches = pa.table({"k": ["a"] * 3 + ["b"] * 8 + [None] * 2 + ["c"]}).to_batches(2)
    seen = []
    list(tables.whole_groups("k", lambda t: seen.append(t["k"].to_pylist()) or t, 4)(iter(batches)))
    assert sum(seen, []) == ["a"] * 3 + ["b"] * 8 + [None] * 2 + ["c"]
    assert all(sum(k in part for part in seen) == 1 for k in ("a", "b", None, "c")) and len(seen) > 1


def test_rings_of_coordinates_beyond_32_bits():
    """Rows of the synthetic fabric go on past 7,000 degrees."""
    y, s = 7 * 10**10, 10**6
    e = np.array([(0, y, s, y), (s, y, s, y + s), (s, y + s, 0, y + s), (0, y + s, 0, y), (0, 0, s, 0), (s, 0, s, s), (s, s, 0, s), (0, s, 0, 0), (-s, 2**32, 0, 2**32), (0, 2**32, 0, 2**33), (0, 2**33, -s, 2**33), (-s, 2**33, -s, 2**32)])
    assert sorted(r[:, 1].min() for r in geometry.stitch(e)) == [0, 2**32, y]


def test_area_with_an_edge_on_the_pole():
    cap = geometry.geodesic_area_km2([box(0, 80, 20, 90)])
    near = geometry.geodesic_area_km2([box(0, 80, 20, 89.9999999)])
    assert cap > 0 and math.isclose(cap, near, rel_tol=1e-9)


def test_pairs_that_cannot_meet_are_left_out_before_exact_products(spark):
    """In a grid of boxes neighbours share ends alone; parted, crossed and nearly touched edges are still found."""
    def ring(x0, y0, x1, y1):
        p = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        return [(*a, *b) for a, b in zip(p, [*p[1:], p[0]], strict=True)]

    schema = "k int, edges array<struct<x0:double,y0:double,x1:double,y1:double>>"
    grid = spark.createDataFrame([(1, ring(float(x), float(y), x + 1.0, y + 1.0)) for x in range(4) for y in range(4)], schema)
    joins = geometry._meeting_pairs(geometry.piece_edges(grid, "k"), "k")
    plan = joins._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count() == 0 and "Join Inner, " in plan
    condition = next(line for line in plan.splitlines() if "Join Inner, " in line and "decimal" in line)
    assert condition.index("(ox0") < condition.index("decimal")  # cheap comparisons come first
    odd = [ring(0.0, 0.0, 2.0, 2.0), ring(2.0, 0.5, 3.0, 1.0), ring(1.0, 1.5, 1.5, 2.5), ring(0.5, 2.0000001, 0.7, 3.0)]
    got = geometry._meeting_pairs(geometry.piece_edges(spark.createDataFrame([(1, r) for r in odd], schema), "k"), "k").collect()
    places = {(r.place.x, r.place.y) for r in got if r.place}
    assert places == {(20000000, 5000000), (20000000, 10000000), (5000000, 20000001), (7000000, 20000001)} and sum(r.crosses for r in got) == 2  # seen from the longer edge
