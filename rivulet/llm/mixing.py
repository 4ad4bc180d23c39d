"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / size copies. Documents are put in an order
(by size, then hash), their expected copies are prefix-summed, one random offset for the source
is added, and a document is emitted once for each whole number its interval crosses. Size order
makes each stretch of the order give its share, so the words taken stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import CELL_ROWS, checked_broadcast, materialize, rank_within, text_or_empty

#: Weights that sources, in the order of their names' code points (null last), take in turn.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Sizes under this have buckets of their own; beyond, a bucket spans 1/64 of a power of two.
FINE = 1024


def words_in(text: str | Column) -> Column:
    """Runs of characters besides space and U+0009 to U+000D; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def size_bucket(size: Column) -> Column:
    """Ascending in size; the number of buckets is bounded whatever the sizes are."""
    power = F.floor(F.log2(F.greatest(size, F.lit(FINE)).cast("double"))).cast("int")
    step = F.floor(size / F.pow(F.lit(2.0), (power - 6).cast("double"))) - 64
    return F.when(size < FINE, size).otherwise(FINE + (power - 10) * 64 + step).cast("long")


def draw(*parts: Column) -> Column:
    """0 <= long < 2**60, from the first 15 hex digits of an MD5, so that any SQL engine agrees."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``target`` for each row of (source, source_size): weights share out ``share`` of all sizes, by
    water-filling: a source is full at ``most`` times its size, what it can't take is reshared by weight."""
    named = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(named) - 1) % len(weights)
    weighted = totals.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    # sources in the order in which the rising level fills them
    fills = Window.orderBy(F.col("source_size") * F.lit(most) / F.col("_w"), F.col("source").isNull(), "source")
    whole, upto = Window.partitionBy(), fills.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.lit(most) * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0))
    )
    levels = weighted.withColumn("_level", level)
    # full sources come first, so the level of the first that isn't full holds for all after it
    full = F.col("source_size") * F.lit(most) <= F.col("_w") * F.col("_level")
    settled = levels.withColumn("_at", F.when(~full, F.col("_level")))
    common = F.first("_at", ignorenulls=True).over(fills.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(full, F.col("source_size") * F.lit(float(most))).otherwise(F.col("_w") * common)
    return settled.withColumn("target", target.cast("double")).drop("_w", "_level", "_at")


def _keyed(docs: DataFrame, source_column: str, text_column: str, id_column: str, seed: int) -> DataFrame:
    size = words_in(text_column)
    key = F.struct(F.col(source_column).isNull().alias("none"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("name"))
    row = draw(F.lit(str(seed)), F.col(id_column).cast("string"), F.md5(text_or_empty(text_column)))
    return docs.withColumn("_size", size).withColumn("_source", F.to_json(key)).withColumn("_draw", row).withColumn("_bucket", size_bucket(F.col("_size")))


def mixed(
    docs: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id", payload: tuple[str, ...] | None = None, seed: int = 7
) -> DataFrame:
    """Each row of ``docs`` (its ``payload`` columns, by default all) with ``_size``, ``_source_size``, ``_target``, ``_copies``.

    Size is the number of words, targets are those of :func:`source_targets`; within a source all
    documents expect the same number of copies, and each gets that number rounded down or up.
    The same rows give the same result whatever their order or partitions. Null texts have size 0,
    null sources are one source that comes last. Sources without words have target 0 and documents
    of theirs no copies. Repeated rows are drawn each. An empty table gives an empty table.
    """
    payload = tuple(docs.columns) if payload is None else payload
    narrow = materialize(_keyed(docs, source_column, text_column, id_column, seed).select("_source", F.col(source_column).cast("string").alias("source"), id_column, "_size", "_draw", "_bucket"))
    buckets = narrow.groupBy("_source", "source", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    buckets = materialize(buckets)
    totals = buckets.groupBy("_source", "source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(totals).withColumn("_offset", draw(F.lit(f"{seed}:offset"), F.col("_source")) / F.lit(float(1 << 60)))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_parts", F.ceil(F.col("_n") / CELL_ROWS)).drop("source", "_words", "_n")
    all_docs = buckets.groupBy("_source").agg(F.sum("_n").alias("_docs"))
    # of a source's documents each expects target / source_size copies
    plan = placed.join(targets.drop("source").join(all_docs, "_source"), "_source")
    plan = materialize(plan.select("_source", "_bucket", "_ahead", "_parts", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_offset"))
    part = F.pmod(F.col("_draw"), F.col("_parts"))
    wide = narrow if set(payload) <= {id_column} else _keyed(docs, source_column, text_column, id_column, seed)
    kept = [*payload, "_source", "_bucket", "_size", "_draw"] + ([] if id_column in payload else [id_column])
    known = checked_broadcast(plan)
    ranked = rank_within(
        wide.select(*kept).join(known, ["_source", "_bucket"]), ["_source", "_bucket"], part, ["_draw", id_column], "_rank", narrow=narrow.join(known, ["_source", "_bucket"])
    )
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(each * n + F.col("_offset"))
    rank = F.col("_ahead") + F.col("_rank")
    copies = F.least(upto(rank.cast("double")) - upto((rank - 1).cast("double")), F.ceil(each)).cast("long")
    return ranked.select(*payload, "_size", "_source_size", "_target", copies.alias("_copies"))


def mix(docs: DataFrame, source_column: str = "source", text_column: str = "text", id_column: str = "doc_id", seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as :func:`mixed` says, columns as they were, whatever their names.

    Null texts and empty ones have no words, but are drawn as their source's other rows are; null
    sources are one source, null ids are drawn by their text alone; repeated rows are drawn each;
    an empty table gives an empty one.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    drawn = mixed(docs.toDF(*names.values()), names[source_column], names[text_column], names[id_column], seed=seed)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return drawn.withColumn("_copy", copies).select(*[F.col(short).alias(c) for c, short in names.items()])


#: ``op3_mixing`` in DuckDB SQL.
ORACLE = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS draw
  FROM documents),
bucketed AS (
  SELECT *, CASE WHEN size < {FINE} THEN size ELSE {FINE} + (floor(log2(size::DOUBLE)) - 10) * 64
                 + floor(size / pow(2.0::DOUBLE, floor(log2(size::DOUBLE)) - 6)) - 64 END::BIGINT AS bucket FROM docs),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM totals),
levels AS (
  SELECT *, row_number() OVER f AS turn,
    (1.5::DOUBLE * sum(source_size) OVER () - 2::DOUBLE * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM weighted WINDOW f AS (ORDER BY source_size * 2 / w::DOUBLE, source IS NULL, source)),
common AS (SELECT arg_min(level, turn) AS level FROM levels WHERE source_size * 2 > w * level),
targets AS (
  SELECT l.source, source_size, CASE WHEN source_size * 2 <= w * l.level THEN source_size * 2::DOUBLE ELSE w * c.level END AS target,
    ('0x' || substr(md5('7:offset:' || CASE WHEN l.source IS NULL THEN '{{"none":true,"name":""}}' ELSE '{{"none":false,"name":"' || l.source || '"}}' END), 1, 15))::BIGINT
      / 1152921504606846976::DOUBLE AS off
  FROM levels l CROSS JOIN common c),
parts AS (SELECT source, bucket, ceil(count(*) / {CELL_ROWS}::DOUBLE)::BIGINT AS n FROM bucketed GROUP BY source, bucket),
ranked AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.off,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
    row_number() OVER (PARTITION BY b.source ORDER BY b.bucket, b.draw % p.n, b.draw, b.doc_id) AS rank
  FROM bucketed b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source AND b.bucket = p.bucket
  JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * least(floor(each * rank + off) - floor(each * (rank - 1) + off), ceil(each)))::BIGINT AS taken
FROM ranked
"""
