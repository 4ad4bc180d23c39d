import json

import pytest
from pyspark.sql import functions as F

from rivulet import cli, errors, geometry, raster, refine
from rivulet import expressions as X


def grid(spark, **given):
    """5 x 5: rows 0 to 2 drain down and inwards to (2, 2), rows 3 and 4 run off to the south."""
    rows = []
    for r in range(5):
        for c in range(5):
            if r > 2:
                d = 4
            elif (r, c) == (2, 2):
                d = 0
            elif c < 2:
                d = 1
            elif c > 2:
                d = 16
            else:
                d = 4
            rows.append((r, c, d, 800.0 if (r, c) == (2, 2) else 1.0))
    return refine.Grid(spark.createDataFrame(rows, "row int, col int, dir int, acc double"), 0.0, 0.0, 1.0, -1.0, 5, 5, **given)


def terminals(spark, lon=2.5, lat=-2.5, x0=0.0, y0=-5.0, x1=5.0, y1=0.0):
    df = spark.createDataFrame([(1, 1, lon, lat)], "terminal_id long, unit_id long, lon double, lat double")
    return df.withColumn("edges", X.rectangle_edges(*map(F.lit, (x0, y0, x1, y1))))


def test_carves_the_part_that_drains_to_the_outlet(spark):
    got = refine.refine(terminals(spark), grid(spark), 500.0)
    row = got.first()
    assert (row.status, row.n_cells, row.pour_row, row.pour_col) == ("applied", 15, 2, 2)
    shape = geometry.dissolved(geometry.border_edges(got, "terminal_id"), "terminal_id").first()
    assert geometry.from_wkb(bytes(shape.geometry)) == [[[(0.0, -3.0), (5.0, -3.0), (5.0, 0.0), (0.0, 0.0), (0.0, -3.0)]]]
    assert abs(shape.area_km2 - 184671.66225785605) < 1e-4


def test_stays_inside_the_polygon(spark):
    assert refine.refine(terminals(spark, y0=-3.0, x0=1.0, x1=4.0), grid(spark), 500.0).first().n_cells == 9


def test_modes(spark):
    far = terminals(spark, x0=100.0, x1=101.0)
    assert refine.refine(far, grid(spark), 500.0).first().reason == "empty_mask"
    assert refine.refine(terminals(spark), grid(spark), 5000.0).first().reason == "no_stream"
    assert refine.refine(terminals(spark), grid(spark), mode="disabled").first().status == "disabled"
    with pytest.raises(errors.DatasetError, match="no_stream"):
        refine.refine(terminals(spark), grid(spark), 5000.0, "require")
    with pytest.raises(errors.DatasetError, match="units"):
        grid(spark, units="km2")
    assert grid(spark, units="km2", crs="EPSG:8857").cells_at(1000.0) == 0.001


def test_masks_and_codes(spark):
    cells = grid(spark).cells.withColumn("grid_id", F.lit(0))
    inside = cells.filter("row = 1").select("grid_id", "row", "col")
    got = {(r.row, r.col): (r.dir, r.acc) for r in raster.masked(cells, inside).collect()}
    assert got[1, 0] == (1, 1.0) and got[0, 0] == (255, None) and len(got) == 25
    with pytest.raises(errors.DatasetError, match="directional_nodata"):
        grid(spark, nodata=128)
    assert X.direction_of_nodata(255, "esri") is None and X.direction_of_nodata(None, "grass") is None


def test_traces_go_around_cycles(spark):
    # a cycle of four cells, one cell that drains into it, and a pour beside it
    rows = [(0, 0, 1), (0, 1, 4), (1, 1, 16), (1, 0, 64), (2, 0, 64), (2, 1, 0), (2, 2, 16)]
    cells = spark.createDataFrame([(0, *r) for r in rows], "grid_id int, row int, col int, dir int")
    pours = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 2, 1), (3, 0, 2, 0)], "pour_id int, grid_id int, row int, col int")
    got = {}
    for r in raster.traced(cells, pours).collect():
        got.setdefault(r.pour_id, set()).add((r.row, r.col))
    assert got == {1: {(0, 0), (0, 1), (1, 1), (1, 0), (2, 0)}, 2: {(2, 1), (2, 2)}, 3: {(2, 0)}}


def test_cli(spark, tmp_path, capsys):
    box = [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]
    bbox = {"xmin": 0.0, "ymin": 0.0, "xmax": 1.0, "ymax": 1.0}
    spark.createDataFrame([(1, 0, 1.0, bbox, geometry.to_wkb([box]))], "id long, level smallint, area_km2 float, bbox struct<xmin:float,ymin:float,xmax:float,ymax:float>, geometry binary").write.parquet(f"{tmp_path}/catchments.parquet")
    spark.createDataFrame([(1, 0, [])], "id long, level smallint, upstream_ids array<bigint>").write.parquet(f"{tmp_path}/graph.parquet")
    text = {"format_version": "0.3.0", "fabric_name": "f", "fabric_version": "2", "crs": "EPSG:4326", "topology": "tree", "bbox": [0, 0, 1, 1], "unit_count": 1, "created_at": "now", "adapter_version": "1"}
    (tmp_path / "manifest.json").write_text(json.dumps(text))
    (tmp_path / "outlets.csv").write_text("id,lat,lon\na,0.5,0.5\nb,50,50\n")
    call = ["delineate", "--dataset", str(tmp_path), "--outlets", f"{tmp_path}/outlets.csv", "--out", f"{tmp_path}/out"]
    assert cli.main(call) == 1
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (said["total"], said["succeeded"], said["failed"]) == (2, 1, 1)
    features = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert features[0]["geometry"]["type"] == "MultiPolygon" and features[0]["properties"]["terminal_unit_id"] == 1
    assert cli.main([*call[:-1], f"{tmp_path}/parquet", "--format", "geoparquet"]) == 1
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 1
    (tmp_path / "manifest.json").write_text("{}")
    assert cli.main(call) == 2


def test_terminals_alike_are_traced_once(spark, monkeypatch):
    """Terminals of one shape and outlet share a trace, and flow cycles are looked for no longer than the largest grid's walks."""
    asked = []
    find = raster.cycle_members
    monkeypatch.setattr(raster, "cycle_members", lambda flows, most=None: asked.append((flows.count(), most)) or find(flows, most))
    one = terminals(spark)
    many = one.select(F.explode(F.sequence(F.lit(11).cast("long"), F.lit(14).cast("long"))).alias("terminal_id"), "unit_id", "lon", "lat", "edges")
    other = terminals(spark, y0=-3.0, x0=1.0, x1=4.0).withColumn("terminal_id", F.lit(20).cast("long"))
    got = {r.terminal_id: r for r in refine.refine(many.union(other.select(*many.columns)), grid(spark), 500.0).collect()}
    assert {k: r.n_cells for k, r in got.items()} == {11: 15, 12: 15, 13: 15, 14: 15, 20: 9}
    assert {r.status for r in got.values()} == {"applied"} and all(r.edges for r in got.values())
    flows, most = asked[0]
    assert flows < 40 and most < flows  # five terminals' masks have 109 cells


def _many(spark):
    """A grid of 40 x 30 cells with cycles, gaps and few streams, and 200 boxes over it and beyond its ends."""
    rows = [(r, c, (1, 2, 4, 8, 16, 32, 64, 128, 0)[(r * 31 + c * 17 + r * c) % 9], float((r * 13 + c * 7) % 50)) for r in range(40) for c in range(30) if (r * 7 + c) % 23]
    cells = spark.createDataFrame(rows, "row int, col int, dir int, acc double")
    k = F.col("terminal_id")
    x, y = (k * 37 % 30).cast("double"), -(k * 53 % 44).cast("double")
    boxes = spark.range(200).select(F.col("id").alias("terminal_id")).select(k, k.alias("unit_id"), (x + 3).alias("lon"), (y - 2).alias("lat"), X.rectangle_edges(x, y - k % 8, x + 3 + k % 5, y).alias("edges"))
    return refine.Grid(cells, 0.0, 0.0, 1.0, -1.0, 40, 30), boxes


def test_small_terminals_are_cut_whole_as_in_tables(spark, monkeypatch):
    grid_, boxes = _many(spark)
    plain = lambda df: sorted((r.terminal_id, r.status, r.reason, r.n_cells, r.pour_row, r.pour_col, sorted(map(tuple, r.edges or []))) for r in df.collect())
    traced = refine.traced
    monkeypatch.setattr(refine, "traced", lambda *a: pytest.fail("small terminals went through the joins of large ones"))
    monkeypatch.setattr(refine, "CHUNK_CELLS", 100, raising=False)
    got = plain(refine.refine(boxes, grid_, 45.0, whole_cells=refine.WHOLE_CELLS))
    monkeypatch.setattr(refine, "traced", traced)
    assert {r[1:3] for r in got} == {("applied", None), ("skipped", "empty_mask"), ("skipped", "no_stream")}
    assert max(r[3] or 0 for r in got) > 5
    assert got == plain(refine.refine(boxes, grid_, 45.0, whole_cells=20))  # some of each
    assert got == plain(refine.refine(boxes, grid_, 45.0))
