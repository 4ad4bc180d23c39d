"""Line deduplication by a log-template tree.

A line falls through a tree of fixed depth: first by its number of tokens, then by its leading
tokens, to a leaf; tokens with a digit are variable from the start. Of the tokens that enough of
the leaf's lines hold at their place, whatever the leaf's size, a line's most frequent ones are
its template, as many as the constant part of its tokens; so lines that differ in their fields
alone get one template. A line whose template doesn't recur is tried one level deeper: among the
lines that share its rarest such token, counted anew. Templates that recur across documents are
boilerplate, and so are lines that recur as they are; both are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import checked_broadcast, free_name, materialize, text_key, text_or_empty

#: Leading tokens of a leaf, least tokens of a line that a template may drop, documents a line must recur in.
LEADING, LEAST_TOKENS, LEAST_DOCS = 3, 4, 4
#: Part of a template's tokens that must be constant.
CONSTANT = 0.6
VARIABLE = "<*>"


def tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def _leaf(parts: Column) -> Column:
    leading = F.array_join(F.transform(F.slice(parts, 1, LEADING), masked), " ")
    # a line too short for a template is dropped as it is alone, so its leaf holds its very tokens
    short = F.when(F.exists(parts, lambda token: token != ""), F.xxhash64(F.size(parts), F.array_join(parts, " ")))
    return F.when(F.size(parts) >= LEAST_TOKENS, F.xxhash64(F.size(parts), leading)).otherwise(short)


def _leaves(lines: Column) -> Column:
    """Each line's leaf; the inner transform parts a line into tokens once."""
    return F.transform(F.transform(lines, tokens), _leaf)


def _templates(placed: DataFrame, group: str, least_docs: int) -> DataFrame:
    """(hash, template): each line's most frequent cells of its ``group``, if it has as many frequent ones as a template needs."""
    frequent = placed.groupBy(group, "cell").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs)
    order = Window.partitionBy("hash").orderBy(F.desc("n"), "cell")
    first = placed.join(frequent, [group, "cell"]).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("need"))
    whole = first.groupBy("hash", group, "need").agg(F.count(F.lit(1)).alias("kept"), F.bit_xor("cell").alias("cells")).filter("kept = need")
    return whole.select("hash", F.xxhash64(group, "cells").alias("template"))


def _in_recurring(templates: DataFrame, held: DataFrame, least_docs: int) -> DataFrame:
    """(hash) of the lines whose template ``least_docs`` rows hold."""
    in_docs = held.select("row", "hash").join(templates, "hash").select("row", "template").distinct()
    recurring = in_docs.groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs)
    return templates.join(recurring, "template", "left_semi").select("hash")


def drop_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with ``text`` less its recurring lines, ``n_lines`` before and ``n_dropped``.

    Lines are parted by a newline; blank ones always stay. A line goes if ``least_docs`` rows hold
    it, however short it is, or hold lines of its template, if it has LEAST_TOKENS blank-parted
    tokens. Null texts stay null and have no lines, empty ones have one; a text may become empty.
    Repeated rows count and come back each. Columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    lines = F.split(text_or_empty(text_column), "\n", -1)
    leaves = F.array_compact(F.array_distinct(_leaves(lines)))
    frequent = docs.select(F.explode(leaves).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("leaf_docs")).filter(F.col("leaf_docs") >= least_docs).select("leaf")
    frequent = checked_broadcast(materialize(frequent))

    # each document's different lines in leaves that could hold a recurring template
    # (a row's number and digest are computed below the generator: beside it they would be computed for every line)
    parted = docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(id_column), text_key(text_column)).alias("doc"), F.array_distinct(lines).alias("line"))
    exploded = parted.select("row", "doc", F.arrays_zip("line", _leaves(F.col("line")).alias("leaf")).alias("each")).select("row", "doc", F.inline("each"))
    held = exploded.join(frequent, "leaf").select("row", "doc", "leaf", "line", F.xxhash64("line").alias("hash"))
    held = materialize(held)
    kinds = materialize(held.groupBy("hash", "leaf", "line").agg(F.count(F.lit(1)).alias("docs")))

    # a leaf's tokens by place: those that enough lines hold may be constant, the others are variable
    gone = materialize(kinds.filter(F.col("docs") >= least_docs).select("hash"))
    parts = F.size(tokens(F.col("line")))
    long = kinds.filter(parts >= LEAST_TOKENS).withColumn("need", F.ceil(parts * CONSTANT).cast("int"))
    placed = long.select("hash", "leaf", "docs", "need", F.posexplode(tokens(F.col("line"))).alias("at", "token")).filter(~F.col("token").rlike("[0-9]"))
    placed = placed.select("hash", "leaf", "docs", "need", F.xxhash64("leaf", "at", "token").alias("cell"))
    counts = placed.groupBy("cell").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs)
    placed = materialize(placed.join(counts, "cell"))
    found = materialize(_in_recurring(_templates(placed.drop("n"), "leaf", least_docs), held, least_docs))

    # one level deeper: fields that are frequent in the leaf are variable among the lines of a rare token
    rest = placed.join(gone.union(found), "hash", "left_anti")
    rarest = F.min(F.struct("n", "cell")).over(Window.partitionBy("hash"))["cell"]
    deeper = materialize(rest.withColumn("pivot", rarest).drop("n"))
    gone = gone.union(found).union(_in_recurring(_templates(deeper, "pivot", least_docs), held, least_docs)).distinct()
    of_doc, hashes = free_name(docs, "of_doc"), free_name(docs, "gone_hashes")
    drops = held.select("doc", "hash").join(gone, "hash").groupBy("doc").agg(F.collect_set("hash").alias(hashes))
    drops = materialize(drops.withColumnRenamed("doc", of_doc))  # grows with the documents: joined by shuffle at any size

    rest = docs.drop(*[c for c in ("n_lines", "n_dropped") if c in docs.columns])
    joined = rest.join(drops, F.xxhash64(F.col(id_column), text_key(text_column)) == F.col(of_doc), "left")
    stay = F.when(F.col(hashes).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(hashes), F.xxhash64(x))))
    n_lines = F.when(F.col(text_column).isNull(), F.lit(0)).otherwise(F.size(lines))
    return joined.select(
        *[F.when(F.col(c).isNotNull(), F.array_join(stay, "\n")).alias(c) if c == text_column else F.col(c) for c in rest.columns],
        n_lines.alias("n_lines"),
        F.when(F.col(text_column).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(stay)).alias("n_dropped"),
    )
