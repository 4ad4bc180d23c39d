"""Integrity of a fabric: every rule is a join or an aggregate, and all come back as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.expressions import LIMITS

#: Stem roles that snap targets may have.
STEM_ROLES = ("mainstem", "tributary", "distributary", "unknown")


def violations(units: DataFrame, graph: DataFrame, snaps: DataFrame, snap_levels: tuple[int, ...] = (0,)) -> DataFrame:
    """(check_name, n): how often each rule is broken; without ``snap_levels`` targets may be on any level.

    ``graph`` is (id, level, upstream_ids); its counterpart row is found by id, its links by explode.
    """
    u, g = units.select("id", F.col("level").alias("unit_level")), graph.select("id", F.col("level").alias("graph_level"))
    both = u.join(g, "id", "full_outer")
    sides = both.select(
        F.count_if(F.col("graph_level").isNull()).alias("unit_without_graph_row"),
        F.count_if(F.col("unit_level").isNull()).alias("graph_row_without_unit"),
        F.count_if(F.col("graph_level") != F.col("unit_level")).alias("level_mismatch"),
    )
    links = graph.select("id", "level", F.explode("upstream_ids").alias("upstream_id"))
    ends = links.join(units.select(F.col("id").alias("upstream_id"), F.col("level").alias("upstream_level")), "upstream_id", "left")
    edges = ends.select(F.count_if(F.col("upstream_level").isNull()).alias("dangling_upstream"), F.count_if(F.col("upstream_level") != F.col("level")).alias("link_across_levels"))
    twice = graph.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_graph_id"))
    targets = snaps.join(u.withColumnRenamed("id", "unit_id"), "unit_id", "left").select(
        F.count_if(F.col("unit_level").isNull()).alias("snap_without_unit"),
        (F.count_if(~F.col("unit_level").isin(*snap_levels)) if snap_levels else F.lit(0).cast("long")).alias("snap_on_other_level"),
        F.count_if(F.col("stem_role").isNotNull() & ~F.col("stem_role").isin(*STEM_ROLES)).alias("unknown_stem_role"),
    )
    lacks = lambda df, columns: df.select(F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns if c in df.columns], F.lit(False))).alias("n"))
    required = lacks(units, ("id", "level", "area_km2", "xmin", "ymin", "xmax", "ymax")).union(lacks(graph, ("id", "level", "upstream_ids"))).union(lacks(snaps, ("snap_id", "unit_id", "weight")))
    nulls = required.agg(F.sum("n").alias("null_required_cell"))
    tables = [sides, edges, twice, targets, nulls]
    rows = [t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n")) for c in t.columns])).alias("r")).select("r.*") for t in tables]
    return reduce(DataFrame.union, rows)


def valid_coordinate(limits: tuple[float, float] = LIMITS) -> Column:
    """Whether ``lat`` and ``lon`` are numbers within ``limits`` (of longitude and latitude)."""
    good = F.col("lat").between(-limits[1], limits[1]) & F.col("lon").between(-limits[0], limits[0]) & ~F.isnan("lat") & ~F.isnan("lon")
    return F.coalesce(good, F.lit(False))


def invalid_coordinates(outlets: DataFrame) -> DataFrame:
    """Outlets whose coordinates are null, not numbers or out of range."""
    return outlets.filter(~valid_coordinate())
