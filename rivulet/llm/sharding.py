"""Sharding by vector bin packing.

Bytes, tokens and rows are balanced jointly. Heavy groups of equal texts (bounded in number,
whatever the input's size) are packed first, largest first, each whole into the shard where its
dot product with the residual capacity is highest among those that it fits; a group that fits
none is cut by a hash of id into the fewest pieces that do. All other texts are folded by
their hash into a bounded number of parcels, which level the shards' bytes; rows
then look up their parcel's shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import CELL_ROWS, materialize, rank_within, text_key, text_or_empty
from rivulet.llm.mixing import words_in

SHARDS = 16
#: Parcels by hash, and the part of a shard (one in so many) above which a group is a parcel of its own.
PARCELS, PIECES = 8192, 256
#: Salts that the pieces of a group share out.
SALTS = 1 << 20


#: How much bytes, tokens and rows count in the dot product: the law is about bytes.
WEIGHTS = (4, 1, 1)


def _scaled(loads: np.ndarray, total: np.ndarray, shards: int) -> np.ndarray:
    """Loads (bytes, tokens, rows), so that a shard's capacity is its weight's root in each dimension."""
    return loads / np.maximum(total, 1) * shards * np.sqrt(np.array(WEIGHTS))


def _largest_first(scaled: np.ndarray) -> np.ndarray:
    return np.lexsort((np.arange(len(scaled)), -scaled.max(axis=1), -scaled[:, 0]))


def spread(groups: np.ndarray, total: np.ndarray, shards: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each heavy group its pieces' shards and parts of it: one piece wherever any shard can take it whole."""
    scaled = _scaled(groups, total, shards)
    residual = np.ones((shards, 3)) * np.sqrt(np.array(WEIGHTS))
    chosen = [(np.zeros(0, np.int64), np.zeros(0))] * len(groups)
    for i in _largest_first(scaled):
        room = np.maximum(residual / np.maximum(scaled[i], 1e-12), 0).min(axis=1)  # how much of the group fits each shard
        whole = room >= 1 - 1e-9
        if whole.any():
            at, part = np.array([np.argmax(np.where(whole, residual @ scaled[i], -np.inf))]), np.ones(1)
        else:
            part = room + max(0, 1 - room.sum()) / shards
            at = np.argsort(-part, kind="stable")
            before = np.cumsum(part[at]) - part[at]
            at = at[before < 1 - 1e-9]
            part = np.minimum(part[at], 1 - before[: len(at)])
        chosen[i] = at, part
        residual[at] -= part[:, None] * scaled[i]
    return chosen


def pack(loads: np.ndarray, fixed: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each parcel; loads has a row (bytes, tokens, rows) for each, fixed its shard or -1 where it is free.

    Free parcels go only where their bytes fit, as long as there is such a shard: the law is about
    bytes. Of those the dot product with the residual's direction chooses, so that a shard full of
    rows gets long texts.
    """
    scaled = _scaled(loads, loads.sum(axis=0), shards)
    residual = np.ones((shards, loads.shape[1])) * np.sqrt(np.array(WEIGHTS))
    chosen = fixed.copy()
    np.subtract.at(residual, fixed[fixed >= 0], scaled[fixed >= 0])
    for i in _largest_first(scaled):
        if fixed[i] < 0:
            bytes_fit = residual[:, 0] >= scaled[i, 0]
            room = np.maximum(residual, 0)
            alike = room @ scaled[i] / np.maximum(np.linalg.norm(room, axis=1), 1e-12)
            worth = np.where(bytes_fit, alike, -np.inf) if bytes_fit.any() else residual[:, 0]
            chosen[i] = int(np.argmax(worth))
            residual[chosen[i]] -= scaled[i]
    return chosen


def shard(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", payload: tuple[str, ...] | None = None
) -> DataFrame:
    """``payload`` columns (by default all) with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Law ``bytes``: the shards' sums of size (UTF-8 bytes plus 1) are near equal, and so are their
    tokens and rows as far as that allows. Rows of equal text share a shard unless their group
    fits no shard's residual capacity; then it is cut by a hash of id into the fewest pieces. Slots number a shard's rows
    from 0 without gaps. Null texts count as empty. Repeated rows are placed each. An empty table
    gives an empty one. Payload columns named like a result column come back under ``payload_`` names.
    """
    spark = docs.sparkSession
    payload = tuple(docs.columns) if payload is None else payload
    results = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = text_or_empty(text_column)
    measures = [
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(F.encode(text, "UTF-8")).alias("_crc"),
        text_key(text_column).alias("_key"),
        F.xxhash64(F.col(id_column)).alias("_id_hash"),
        F.col(id_column).alias("_id"),
    ]
    narrow = materialize(docs.select(words_in(text_column).alias("_tokens"), *measures))
    total = [x or 0 for x in narrow.agg(F.sum("_size"), F.sum("_tokens"), F.count(F.lit(1))).first()]
    limit = max(1, total[0] // (shards * PIECES))
    heavy = narrow.groupBy("_key").agg(F.sum("_size").alias("_bytes"), F.sum("_tokens"), F.count(F.lit(1)).alias("_rows")).filter((F.col("_bytes") > limit) & (F.col("_rows") > 1))
    groups = heavy.orderBy("_key").collect()  # fewer than shards * PIECES, since each holds more than that part of all bytes
    pieces = spread(np.array([r[1:] for r in groups], np.float64).reshape(-1, 3), np.array(total, np.float64), shards)
    starts = np.cumsum([PARCELS, *(len(at) for at, _ in pieces)])
    bounds = [[int(x) for x in np.cumsum(part)[:-1] * SALTS] for _, part in pieces]
    heavy = spark.createDataFrame([(r[0], int(n), b) for r, n, b in zip(groups, starts, bounds, strict=False)], "_key binary, _first long, _bounds array<int>")
    homes = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in pieces)])

    def parcelled(rows: DataFrame) -> DataFrame:
        light = F.pmod(F.xxhash64("_key"), F.lit(PARCELS))
        piece = F.col("_first") + F.size(F.filter("_bounds", lambda b: b <= F.pmod(F.col("_id_hash"), F.lit(SALTS))))
        return rows.join(F.broadcast(heavy), "_key", "left").withColumn("_parcel", F.coalesce(piece, light)).drop("_bounds", "_first")

    sums = parcelled(narrow).groupBy("_parcel").agg(F.sum("_size"), F.sum("_tokens"), F.count(F.lit(1))).orderBy("_parcel").collect()
    fixed = np.array([homes[r[0] - PARCELS] if r[0] >= PARCELS else -1 for r in sums], np.int64)
    chosen = pack(np.array([r[1:] for r in sums], np.float64).reshape(-1, 3), fixed, shards)
    # a parcel's rows are ranked in cells that a task can sort, however heavy the parcel is
    cells = [max(1, -(-r[3] // CELL_ROWS), -(-r[1] // limit) if r[0] >= PARCELS else 1) for r in sums]
    firsts = np.cumsum([0, *cells])
    places = spark.createDataFrame([(int(r[0]), int(c), int(f), int(n)) for r, c, f, n in zip(sums, chosen, firsts, cells, strict=False)], "_parcel long, _shard int, _cells_from long, _cells long")
    cell = F.col("_cells_from") + F.pmod(F.xxhash64("_id_hash"), F.col("_cells"))

    def placed(rows: DataFrame) -> DataFrame:
        return parcelled(rows).join(F.broadcast(places), "_parcel")

    columns = [F.col(c).alias(f"payload_{c}" if c in results else c) for c in payload]
    wide = docs.select(*columns, *measures) if set(payload) - {id_column} else narrow.select(*[F.col("_id").alias(c) for c in payload], *[c for c in narrow.columns if c != "_tokens"])
    ranked = rank_within(placed(wide), ["_shard"], cell, ["_id", "_crc", "_key"], "_rank", narrow=placed(narrow))
    return ranked.select(
        *[f"payload_{c}" if c in results else c for c in payload],
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
