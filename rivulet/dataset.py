"""Opening a hydrofabric dataset: a manifest, its tables, and the rules they must keep."""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import DatasetError
from rivulet.fabric import D8Declarations, Fabric
from rivulet.validate import violations

# Fixed values of the dataset format.
FORMAT_VERSION, CRS = "0.3.0", "EPSG:4326"
D8_FAMILY, D8_SCHEMA, SNAP_SCHEMA = "hfx.aux.d8_raster.", "hfx.aux.d8_raster.v2", "hfx.aux.snap.v2"
D8_ENCODINGS, D8_UNITS, D8_CRS = ("esri", "taudem", "grass"), ("cells", "km2"), ("EPSG:4326", "EPSG:8857")

BBOX = T.StructType([T.StructField(c, T.FloatType()) for c in ("xmin", "ymin", "xmax", "ymax")])
UNITS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("level", T.ShortType()), T.StructField("parent_id", T.LongType()), T.StructField("area_km2", T.FloatType()), T.StructField("up_area_km2", T.FloatType()),
     T.StructField("outlet_lon", T.DoubleType()), T.StructField("outlet_lat", T.DoubleType()), T.StructField("bbox", BBOX), T.StructField("geometry", T.BinaryType())]
)
GRAPH = T.StructType([T.StructField("id", T.LongType()), T.StructField("level", T.ShortType()), T.StructField("upstream_ids", T.ArrayType(T.LongType()))])
SNAPS = T.StructType([T.StructField("id", T.LongType()), T.StructField("unit_id", T.LongType()), T.StructField("weight", T.FloatType()), T.StructField("stem_role", T.StringType()), T.StructField("bbox", BBOX), T.StructField("geometry", T.BinaryType())])
SHAPES = "id long, unit_id long, weight float, stem_role string, box struct<xmin:float,ymin:float,xmax:float,ymax:float>, points array<struct<x:double,y:double>>, problem string"
EDGES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


@dataclass(frozen=True)
class Manifest:
    fabric_name: str
    topology: str
    bbox: tuple[float, ...]
    unit_count: int
    created_at: str
    adapter_version: str
    fabric_version: str | None = None
    auxiliary: tuple[dict, ...] = field(default=())

    def of_kind(self, kind: str) -> list[dict]:
        """Auxiliary declarations of a kind (see :func:`aux_kind`), in the order of the manifest."""
        return [a for a in self.auxiliary if aux_kind(a["schema"]) == kind]

    def snap_for(self, level: int) -> dict | None:
        """The snap declaration for a level: of those that name it the first by name, then path."""
        fitting = [a for a in self.of_kind("snap") if level in a["metadata"]["references_levels"]]
        return min(fitting, key=lambda a: (a["metadata"]["name"], a["artifacts"]["snap"]), default=None)

    @property
    def d8(self) -> D8Declarations:
        family = [a["schema"] for a in self.of_kind("unreadable") if a["schema"].startswith(D8_FAMILY)]
        return D8Declarations(len(self.of_kind("d8")), family[0] if family else None)


def aux_kind(schema: str) -> str:
    """``d8`` or ``snap`` for the schemas that are read, ``unreadable`` for others of their families, else ``generic``."""
    return {D8_SCHEMA: "d8", SNAP_SCHEMA: "snap"}.get(schema, "unreadable" if schema.startswith("hfx.aux.") else "generic")


def _check_aux(aux: object) -> None:
    """Raise for an auxiliary declaration that breaks the rules of its kind."""
    if not isinstance(aux, dict) or not isinstance(aux.get("schema"), str):
        raise DatasetError("auxiliary", "an auxiliary entry has no schema")
    schema, kind, artifacts, meta = aux["schema"], aux_kind(aux["schema"]), aux.get("artifacts"), aux.get("metadata") or {}
    if kind == "unreadable":
        return
    if not artifacts or not isinstance(artifacts, dict):
        raise DatasetError("auxiliary", f"{schema} has no artifacts")
    for path in artifacts.values():
        flat = posixpath.normpath(path)
        if flat.startswith("..") or posixpath.isabs(flat):
            raise DatasetError("path_escape", path)
    lacking = [n for n in {"d8": ("flow_dir", "flow_acc"), "snap": ("snap",)}.get(kind, ()) if n not in artifacts]
    if lacking:
        raise DatasetError("auxiliary", f"{schema} has no artifact {lacking[0]!r}")
    if kind == "d8":
        allowed = {"crs": D8_CRS, "flow_dir_encoding": D8_ENCODINGS, "flow_acc_units": D8_UNITS}
        for name in [*meta, *allowed]:
            if name not in allowed or meta.get(name) not in allowed[name]:
                raise DatasetError("d8_metadata", f"{name} {meta.get(name)!r}")
    if kind == "snap":
        for name in ("name", "description", "weight_semantics"):
            if not isinstance(meta.get(name), str) or not meta[name]:
                raise DatasetError("snap_metadata", f"{name} must be a text that isn't empty")
        levels = meta.get("references_levels")
        if not isinstance(levels, list) or not levels or not all(isinstance(n, int) and not isinstance(n, bool) and 0 <= n <= 32767 for n in levels):
            raise DatasetError("snap_metadata", "references_levels must be whole numbers from 0 to 32767")


def parse_manifest(text: str) -> Manifest:
    """A manifest of this format; the version is judged before anything else."""
    try:
        raw = json.loads(text)
    except ValueError as error:
        raise DatasetError("manifest_json", str(error)) from error
    if not isinstance(raw, dict):
        raise DatasetError("manifest_json", "a manifest is a JSON object")
    if raw.get("format_version") != FORMAT_VERSION:
        raise DatasetError("format_version", f"{raw.get('format_version')!r} isn't {FORMAT_VERSION}")
    for name in ("fabric_name", "crs", "topology", "bbox", "unit_count", "created_at", "adapter_version"):
        if raw.get(name) is None:
            raise DatasetError("missing_field", name)
    if raw["crs"] != CRS:
        raise DatasetError("crs", f"{raw['crs']!r} isn't {CRS}")
    if raw["topology"] not in ("tree", "dag"):
        raise DatasetError("topology", f"{raw['topology']!r} is neither tree nor dag")
    box = raw["bbox"]
    if not isinstance(box, list) or len(box) != 4 or not all(isinstance(v, int | float) for v in box) or not (box[0] < box[2] and box[1] < box[3]):
        raise DatasetError("bbox", f"{box!r} isn't a box")
    if not isinstance(raw["unit_count"], int) or raw["unit_count"] < 0:
        raise DatasetError("unit_count", f"{raw['unit_count']!r} isn't a count")
    for aux in raw.get("auxiliary") or []:
        _check_aux(aux)
    return Manifest(raw["fabric_name"], raw["topology"], tuple(box), raw["unit_count"], raw["created_at"], raw["adapter_version"], raw.get("fabric_version"), tuple(raw.get("auxiliary") or []))


def _edges(batches):
    """(id, edges): ring edges of WKB polygons, exteriors counter-clockwise and holes clockwise; null for what can't be read."""
    import numpy as np
    import pyarrow as pa

    from rivulet.geometry import wkb_polygons

    for batch in batches:
        begins, ends, sizes, valid = [], [], [], []
        for value in batch.column("geometry"):
            rings = []
            try:
                rings = [(r, i == 0) for p in wkb_polygons(value.as_py()) for i, r in enumerate(p)] if value.is_valid else []
                if not all(len(r) > 2 and np.isfinite(r).all() for r, _ in rings):
                    rings = []
            except ValueError:
                pass
            for r, left in rings:
                x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
                counter = (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() > 0
                r = r if counter == left else r[::-1]
                begins.append(r[:-1])
                ends.append(r[1:])
            sizes.append(sum(len(r) - 1 for r, _ in rings))
            valid.append(bool(rings))
        a, b = (np.concatenate([np.zeros((0, 2)), *e]) for e in (begins, ends))
        flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (a[:, 0], a[:, 1], b[:, 0], b[:, 1])], ["x0", "y0", "x1", "y1"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat, mask=pa.array([not v for v in valid], pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "edges"])


def _shapes(batches):
    """Snap targets with the ``points`` of their WKB points or lines, or the ``problem`` with them."""
    import struct

    import numpy as np
    import pyarrow as pa

    kept = ("id", "unit_id", "weight", "stem_role", "box")
    for batch in batches:
        points, problems = [], []
        for value in batch.column("geometry"):
            data, found, problem = value.as_py(), None, None
            try:
                if data is None:
                    problem = "null_snap_geometry"
                else:
                    order = "<" if data[0] == 1 else ">"
                    (kind,) = struct.unpack_from(order + "I", data, 1)
                    if kind == 1:
                        found = [struct.unpack_from(order + "dd", data, 5)]
                    elif kind == 2:
                        (n,) = struct.unpack_from(order + "I", data, 5)
                        found = np.frombuffer(data, order + "f8", 2 * n, 9).reshape(-1, 2).tolist()
                    else:
                        problem = "unsupported_snap_geometry"
                    if found is not None and not (found and np.isfinite(found).all()):
                        found, problem = None, "corrupt_snap_geometry"
            except (ValueError, IndexError, struct.error):
                problem = "corrupt_snap_geometry"
            points.append(None if found is None else [{"x": x, "y": y} for x, y in found])
            problems.append(problem)
        lists = pa.array(points, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists, pa.array(problems, pa.string())], [*kept, "points", "problem"])


def _required(df: DataFrame, schema: T.StructType, optional: tuple[str, ...], table: str) -> DataFrame:
    """``df`` cast to ``schema``; missing optional columns are null, missing others an error."""
    for f in schema.fields:
        if f.name not in df.columns and f.name not in optional:
            raise DatasetError("missing_column", f"{table}.{f.name}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def open_dataset(spark: SparkSession, root: str, snap_path: str | None = None, validate: bool = True, level: int | None = None) -> tuple[Manifest, Fabric]:
    """The manifest and lazy tables under ``root`` (any path that Spark reads); raises on the first broken rule.

    Snap targets are those of ``snap_path``, else those that the manifest declares for ``level`` (by
    default the finest); where there are any, outlets are snapped unless options say otherwise.
    Geometries are read when a query needs them: a corrupt one is null there and fails only what needs it.
    """
    root = root.rstrip("/")
    if _exists(spark, f"{root}/graph.arrow"):
        raise DatasetError("legacy_graph", "graph.arrow is of an older format: graph.parquet is read")
    for name in ("manifest.json", "catchments.parquet", "graph.parquet"):
        if not _exists(spark, f"{root}/{name}"):
            raise DatasetError("missing_artifact", name)
    manifest = parse_manifest("\n".join(r.value for r in spark.read.text(f"{root}/manifest.json", wholetext=True).collect()))
    for kind in ("d8", "snap"):
        for path in [p for a in manifest.of_kind(kind) for p in a["artifacts"].values()]:
            if not _exists(spark, f"{root}/{path}"):
                raise DatasetError("missing_artifact", path)
    units = _required(spark.read.parquet(f"{root}/catchments.parquet"), UNITS, ("level", "parent_id", "up_area_km2", "outlet_lon", "outlet_lat"), "catchments")
    graph = _required(spark.read.parquet(f"{root}/graph.parquet"), GRAPH, (), "graph")
    units = units.withColumn("level", F.coalesce("level", F.lit(0).cast("smallint")))
    shapes = units.select("id", "geometry").mapInArrow(_edges, f"id long, edges {EDGES}")
    middle = lambda c, axis: F.coalesce(c, (F.col(f"bbox.{axis}min").cast("double") + F.col(f"bbox.{axis}max").cast("double")) / 2)
    flat = units.select("id", "level", F.col("area_km2").cast("double").alias("area_km2"), F.col("up_area_km2").cast("double").alias("up_area_km2"), *[F.col(f"bbox.{c}").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
                        middle("outlet_lon", "x").alias("outlet_lon"), middle("outlet_lat", "y").alias("outlet_lat"))
    links = graph.select("id", F.explode("upstream_ids").alias("upstream_id"))
    levels: tuple[int, ...] = ()
    if snap_path is None and manifest.of_kind("snap"):
        finest = flat.agg(F.max("level")).first()[0] if level is None else level
        if declared := manifest.snap_for(finest):
            snap_path, levels = declared["artifacts"]["snap"], tuple(declared["metadata"]["references_levels"])
    if snap_path:
        given = _required(spark.read.parquet(f"{root}/{snap_path}"), SNAPS, ("stem_role", "bbox"), "snap").withColumnRenamed("bbox", "box")
        snaps = given.mapInArrow(_shapes, SHAPES).select(F.col("id").alias("snap_id"), "unit_id", F.col("weight").cast("double").alias("weight"), "stem_role", "box", "points", "problem")
        refs = given.select(F.col("id").alias("snap_id"), "unit_id", "weight", "stem_role")
    else:
        snaps = refs = spark.createDataFrame([], "snap_id long, unit_id long, weight double, stem_role string, lon double, lat double")
    if validate:
        counted = flat.count()
        if counted != manifest.unit_count:
            raise DatasetError("unit_count", f"the manifest says {manifest.unit_count}, there are {counted}")
        if (rows := graph.count()) != counted:
            raise DatasetError("graph_count", f"there are {counted} units, but {rows} rows of the graph")
        broken = violations(flat, graph, refs, levels).filter("n > 0").orderBy("check_name").collect()
        if broken:
            raise DatasetError(broken[0]["check_name"], f"{broken[0]['n']} rows")
    return manifest, Fabric(flat.join(shapes, "id", "left"), links, snaps, manifest.topology, manifest.fabric_name, manifest.fabric_version, bool(snap_path), manifest.d8)


def read_outlets(spark: SparkSession, path: str) -> DataFrame:
    """(outlet_id, name, lon, lat) of a CSV with lat and lon columns and perhaps id and name; one without rows is an error."""
    raw = spark.read.csv(path, header=True)
    for c in ("lat", "lon"):
        if c not in raw.columns:
            raise DatasetError("missing_column", c)
    if not raw.take(1):
        raise DatasetError("no_outlets", path)
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(has("id").alias("outlet_id"), has("name").alias("name"), F.expr("try_cast(lon AS double)").alias("lon"), F.expr("try_cast(lat AS double)").alias("lat"))


def covering_rasters(terminals: DataFrame, rasters: DataFrame) -> DataFrame:
    """(terminal_id, raster_index, n_covering, problem): the first declared raster whose extent holds each terminal's box.

    Terminals and rasters have xmin, ymin, xmax, ymax; rasters are declarations, as few as a
    manifest lists. ``problem`` is ``spans_tiles`` where several only touch the box, else ``no_covering_tile``.
    """
    t, r = terminals.alias("t"), rasters.alias("r")
    touches = (F.col("t.xmin") <= F.col("r.xmax")) & (F.col("t.xmax") >= F.col("r.xmin")) & (F.col("t.ymin") <= F.col("r.ymax")) & (F.col("t.ymax") >= F.col("r.ymin"))
    holds = (F.col("t.xmin") >= F.col("r.xmin")) & (F.col("t.xmax") <= F.col("r.xmax")) & (F.col("t.ymin") >= F.col("r.ymin")) & (F.col("t.ymax") <= F.col("r.ymax"))
    met = t.join(r, touches, "left").groupBy("t.terminal_id").agg(
        F.min(F.when(holds, F.col("r.raster_index"))).alias("raster_index"), F.count_if(holds).alias("n_covering"), F.count("r.raster_index").alias("touching")
    )
    problem = F.when(F.col("n_covering") == 0, F.when(F.col("touching") > 1, F.lit("spans_tiles")).otherwise(F.lit("no_covering_tile")))
    return met.select("terminal_id", "raster_index", "n_covering", problem.alias("problem"))
