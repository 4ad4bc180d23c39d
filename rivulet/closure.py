"""Upstream closure of terminal units over the drainage graph.

Trees are closed by doubling: after k rounds every terminal has its units up to 2**k steps away,
from tables of exact 2**k-step links that never outgrow the graph (each unit has one downstream
unit). Those tables come first, so a cycle is found before anything is closed. DAGs are closed in
the order of their units' heights (steps of the longest way up), highest first: when a height's turn
comes, all that leads to its units has been walked, so diamonds are walked once and no round reads
what earlier ones have closed. Graphs with cycles that are declared DAGs are closed by
frontier rounds, where a unit already seen from a terminal is dropped. Terminals are closed once however many outlets
share one, and each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.errors import TraversalError
from rivulet.tables import new_path, written

#: Terminals of which a unit's array may hold each once.
TERMINALS = 1 << 20


def upstream_closure(terminals: DataFrame, links: DataFrame, topology: str = "tree") -> DataFrame:
    """(terminal_id, unit_id), terminals included, for the distinct ``unit_id`` of ``terminals``."""
    start = terminals.select(F.col("unit_id").alias("terminal_id")).distinct().withColumn("unit_id", F.col("terminal_id"))
    return (closed_forest(start, links) if topology == "tree" else _closed_dag(start, links)).hint("merge")


def closed_forest(start: DataFrame, links: DataFrame) -> DataFrame:
    """``start`` (terminal_id, unit_id) and all that is upstream of its units, where each unit has one downstream at most."""
    jumps = links.select(F.col("id").alias("from_id"), F.col("upstream_id").alias("to_id")).hint("merge")
    most, steps, tables = links.count(), 1, []
    while True:
        tables.append(jumps)
        half = jumps.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
        jumps = written(half.join(jumps, half["b"] == jumps["from_id"]).select(F.col("a").alias("from_id"), "to_id"))
        if not jumps.take(1):
            break
        steps *= 2
        if steps > most:
            raise TraversalError("cycle", "the graph is declared a tree but a unit is upstream of itself")
    reached = written(start)
    for jumps in tables:
        further = reached.join(jumps, reached["unit_id"] == jumps["from_id"]).select("terminal_id", F.col("to_id").alias("unit_id"))
        reached = reached.union(written(further))
    return reached


def cycle_members(flows: DataFrame, most: int | None = None) -> DataFrame:
    """(id, cycle_id) of what lies on a cycle of ``flows`` (id, to_id), in which each id has one row at most.

    ``most`` is how many ids a walk can meet, all of ``flows`` if it isn't given. After as many steps every walk that hasn't ended is on its cycle, and every
    member of a cycle is where one such walk is. ``cycle_id`` is the cycle's least id.
    """
    jumps = flows.select("id", "to_id").hint("merge")
    most, steps = flows.count() if most is None else most, 1
    while steps <= most:
        half = jumps.select("id", F.col("to_id").alias("middle"))
        jumps = written(half.join(jumps.withColumnRenamed("id", "middle"), "middle").select("id", "to_id"))
        if not jumps.take(1):
            break
        steps *= 2
    on = written(jumps.select(F.col("to_id").alias("id")).distinct())
    around = on.join(flows, "id").select("id", "to_id", F.least("id", "to_id").alias("cycle_id"))
    members, seen = on.count(), 1
    while members and seen < members:  # each id learns the least of the next 2, 4, 8, ... around its cycle
        ahead = around.select(F.col("id").alias("to_id"), F.col("to_id").alias("further"), F.col("cycle_id").alias("theirs"))
        around = written(around.join(ahead, "to_id").select("id", F.col("further").alias("to_id"), F.least("cycle_id", "theirs").alias("cycle_id")))
        seen *= 2
    return around.select("id", "cycle_id")


def _heights(links: DataFrame) -> DataFrame | None:
    """(id, height) of the units that have others upstream, height being the steps of the longest way up; None if there is a cycle.

    Round k keeps the links whose upper end has k links above it. Each is among those of the round before, so a round that loses none has met a cycle.
    """
    spark, path = links.sparkSession, new_path(links.sparkSession)
    left, height, before = links.select("id", "upstream_id").distinct(), 0, -1
    schema = left.schema
    while True:
        left.write.parquet(f"{path}/height={height}")
        left = spark.read.schema(schema).parquet(f"{path}/height={height}").hint("merge")
        count = left.count()
        if count == before:
            return None
        if not count:
            break
        above = left.select(F.col("id").alias("upstream_id")).distinct()
        left, height, before = left.join(above, "upstream_id", "left_semi").select("id", "upstream_id"), height + 1, count
    rounds = spark.read.schema(T.StructType([*schema, T.StructField("height", T.IntegerType())])).parquet(path)
    return written(rounds.groupBy("id").agg((F.max("height") + 1).alias("height")))


def _closed_dag(start: DataFrame, links: DataFrame) -> DataFrame:
    """``start`` and all that is upstream of its units.

    What leads to a unit waits, by the unit's height, as arrays of terminals, whose union goes on to the units above at that height's turn.
    Terminals are dealt to parts of about TERMINALS, and no array is longer.
    """
    heights = _heights(links)
    if heights is None:
        return _frontier(start, links)
    spark, path, by_height = start.sparkSession, new_path(start.sparkSession), new_path(start.sparkSession)
    upper = heights.select(F.col("id").alias("upstream_id"), F.col("height").alias("upstream_height"))
    graph = links.select("id", "upstream_id").distinct().join(heights, "id").join(upper, "upstream_id", "left").withColumn("upstream_height", F.coalesce("upstream_height", F.lit(0)))
    graph.write.partitionBy("height").parquet(by_height)
    graph = spark.read.schema(graph.schema).parquet(by_height).hint("merge")
    start = written(start)
    part = F.pmod(F.xxhash64("terminal_id"), F.lit(1 + start.count() // TERMINALS)).cast("int").alias("part")
    waiting = start.join(heights.withColumnRenamed("id", "unit_id"), "unit_id", "left")
    waiting = waiting.select("unit_id", part, F.array("terminal_id").alias("terminals"), F.coalesce("height", F.lit(0)).alias("height"))
    schema = waiting.schema
    waiting.write.partitionBy("height").parquet(path)
    union = F.array_distinct(F.flatten(F.collect_list("terminals"))).alias("terminals")
    for height in range(heights.agg(F.max("height")).first()[0] or 0, 0, -1):
        now = spark.read.schema(schema).parquet(path).filter(F.col("height") == height)
        now = now.repartition("unit_id").groupBy("unit_id", "part").agg(union)  # the join finds them dealt by unit
        further = graph.filter(F.col("height") == height).select(F.col("id").alias("unit_id"), "upstream_id", "upstream_height")
        step = now.join(further, "unit_id").select(F.col("upstream_id").alias("unit_id"), "part", "terminals", F.col("upstream_height").alias("height"))
        step.write.mode("append").partitionBy("height").parquet(path)
    return spark.read.schema(schema).parquet(path).groupBy("unit_id", "part").agg(union).select(F.explode("terminals").alias("terminal_id"), "unit_id")


def _frontier(start: DataFrame, links: DataFrame) -> DataFrame:
    spark = start.sparkSession
    path, turn = new_path(spark), 0
    frontier = start
    schema = start.schema
    while True:
        frontier.write.parquet(f"{path}/turn={turn}")
        frontier = spark.read.schema(schema).parquet(f"{path}/turn={turn}").hint("merge")
        reached = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).hint("merge")
        if not frontier.take(1):
            return reached
        step = frontier.join(links, frontier["unit_id"] == links["id"]).select("terminal_id", F.col("upstream_id").alias("unit_id")).distinct()
        frontier, turn = step.join(reached, ["terminal_id", "unit_id"], "left_anti"), turn + 1


def closure_faults(closure: DataFrame, units: DataFrame) -> DataFrame:
    """(terminal_id, fault, faulty_unit) of each terminal whose closure can't be used: a unit of it isn't in ``units``
    (``terminal_not_found``, ``dangling_upstream_reference``) or lies on another level than it (``level_crossing``)."""
    levels = units.select(F.col("id").alias("unit_id"), "level")
    own = units.select(F.col("id").alias("terminal_id"), F.col("level").alias("terminal_level"))
    met = closure.join(levels, "unit_id", "left").join(own, "terminal_id", "left")
    fault = (
        F.when(F.col("terminal_level").isNull(), F.lit("terminal_not_found"))
        .when(F.col("level").isNull(), F.lit("dangling_upstream_reference"))
        .when(F.col("level") != F.col("terminal_level"), F.lit("level_crossing"))
    )
    bad = met.select("terminal_id", "unit_id", fault.alias("fault")).filter("fault IS NOT NULL")
    return bad.groupBy("terminal_id").agg(F.min(F.struct("fault", "unit_id")).alias("f")).select("terminal_id", "f.fault", F.col("f.unit_id").alias("faulty_unit"))


def check_closure(closure: DataFrame, units: DataFrame) -> None:
    """Raise if a terminal or an upstream unit isn't in ``units``, or a closure crosses levels."""
    bad = closure_faults(closure, units).limit(1).collect()
    if bad:
        raise TraversalError(bad[0]["fault"], f"unit {bad[0]['faulty_unit']} upstream of {bad[0]['terminal_id']}")
