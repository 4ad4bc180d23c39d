"""``python -m rivulet.cli delineate``: outlets of a CSV over a dataset, to GeoParquet or GeoJSON lines."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.dataset import open_dataset, read_outlets
from rivulet.engine import Engine, Options
from rivulet.errors import RivuletError
from rivulet.export import METHODS, basin_table, batch_summary, check_exportable, delineation_label, geojson_features, write_geoparquet
from rivulet.tables import written


def main(argv: list[str] | None = None) -> int:
    """0 if all outlets were delineated, 1 if some failed (the others are written), 2 for a bad call or dataset.

    The last line of standard output is a JSON object: total, succeeded, failed, seconds, and the
    folder of ``failures``, where each outlet that failed is a line with its error.
    """
    parser = argparse.ArgumentParser(prog="rivulet")
    run = parser.add_subparsers(dest="command", required=True).add_parser("delineate")
    run.add_argument("--dataset", required=True)
    run.add_argument("--outlets", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--format", choices=("geoparquet", "geojson"), default="geojson")
    run.add_argument("--snap", metavar="PATH", help="snap table under the dataset, instead of the one that it declares")
    run.add_argument("--no-snap", action="store_true", help="resolve outlets by containment alone")
    run.add_argument("--radius", type=float, default=Options.search_radius_m)
    run.add_argument("--strategy", default=Options.strategy)
    run.add_argument("--minimal", action="store_true", help="GeoParquet without provenance columns")
    run.add_argument("--by-outlet", action="store_true", help="GeoParquet basins are named by the outlets' ids, not by their terminal units")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    began = time.time()
    try:
        manifest, fabric = open_dataset(spark, given.dataset, given.snap)
        options = Options(use_snap=False if given.no_snap else None, search_radius_m=given.radius, strategy=given.strategy)
        results = written(Engine(fabric).delineate(read_outlets(spark, given.outlets), options))
        good = results.filter("error IS NULL")
        if given.format == "geojson":
            named = good.withColumns(
                {"id": F.col("outlet_id"), "terminal_unit_id": F.col("terminal_id"), "input_lat": F.col("lat"), "input_lon": F.col("lon"), "upstream_unit_count": F.col("n_units"), "resolution_method": F.col("method")}
            )
            properties = ["id", "name", "area_km2", "terminal_unit_id", "input_lat", "input_lon", "resolved_lat", "resolved_lon", "upstream_unit_count", "resolution_method", "refinement", "refinement_reason"]
            geojson_features(named, properties).orderBy("outlet_index").select("feature").write.mode("overwrite").text(given.out)
        elif good.take(1):
            label = delineation_label(manifest.fabric_name, manifest.fabric_version, METHODS[options.refinement])
            table = written(basin_table(good.withColumn("basin_id", F.col("outlet_id")) if given.by_outlet else good, label, manifest.adapter_version, given.minimal))
            check_exportable(table)
            write_geoparquet(table, given.out)
        failures = f"{given.out.rstrip('/')}.failures"
        failed = results.filter("error IS NOT NULL").orderBy("outlet_index").select(F.to_json(F.struct(F.col("outlet_id").alias("id"), "lat", "lon", "error")).alias("line"))
        failed.write.mode("overwrite").text(failures)
        summary = batch_summary(results).first().asDict()
    except (RivuletError, ValueError) as error:
        print(json.dumps({"error": str(error)}), file=sys.stderr)
        return 2
    print(json.dumps(summary | {"failures": failures, "seconds": round(time.time() - began, 3)}))
    return int(summary["failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
