"""Benchmark decontamination by greedy string tiling.

Texts are compared as sequences of lower-cased words. A document and a benchmark item are a
candidate pair if they share a run of SEED words; the item is then tiled with the document:
running Karp-Rabin hashing finds the longest common runs of unmarked words, from long search
lengths down to SEED, the longest non-overlapping ones are marked in both, and so on. Tiles may
come in any order, so rearranged passages count. A document is contaminated by an item if tiles
cover at least THRESHOLD of the item's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import free_name, materialize, normal_words, powers, string_slices, window_hashes, word_hashes

#: Words of the shortest tile, and the part of an item's words that tiles must cover.
SEED, THRESHOLD = 5, 0.6
#: Words of benchmark items broadcast at once; a larger benchmark is taken block by block.
BLOCK_WORDS = 500_000
#: Blocks that are broadcast for one scan of the documents.
BLOCKS_AT_ONCE = 8
#: Bits of the filter that seeds must pass before their exact look-up.
FILTER_BITS = 20


class _Windows:
    """Hashes of any run of a word sequence, from prefix sums (Karp-Rabin)."""

    def __init__(self, words: np.ndarray):
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(len(words)), out=self.total[1:])
        self.back = powers(len(words) + 1, inverse=True)

    def runs(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.total[at + length] - self.total[at]) * self.back[at]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs of ``length`` without a mark."""
    if len(marked) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[length:] == sums[:-length])


def tile(document: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (document start, item start, words) of two hashed word sequences.

    Longest first; of equal ones that at the smaller item start, then document start.
    """
    marked_d, marked_i = np.zeros(len(document), bool), np.zeros(len(item), bool)
    win_d, win_i = _Windows(document), _Windows(item)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(item), len(document))
    while length >= least:
        free_i, free_d = _free(marked_i, length), _free(marked_d, length)
        hash_i, hash_d = win_i.runs(free_i, length), win_d.runs(free_d, length)
        hit = np.isin(hash_d, hash_i)
        found: list[tuple[int, int, int]] = []
        if hit.any():
            places: dict[int, list[int]] = {}
            for h, at in zip(hash_i.tolist(), free_i.tolist(), strict=True):
                places.setdefault(h, []).append(at)
            ends: dict[int, int] = {}  # by diagonal: where the last run on it ended
            for h, d in zip(hash_d[hit].tolist(), free_d[hit].tolist(), strict=True):
                for i in places[h]:
                    if d < ends.get(d - i, 0):
                        continue
                    n = 0
                    while d + n < len(document) and i + n < len(item) and document[d + n] == item[i + n] and not marked_d[d + n] and not marked_i[i + n]:
                        n += 1
                    if n >= length:
                        found.append((n, i, d))
                        ends[d - i] = d + n - length + 1
        for n, i, d in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            if not marked_d[d : d + n].any() and not marked_i[i : i + n].any():
                marked_d[d : d + n] = True
                marked_i[i : i + n] = True
                tiles.append((d, i, n))
        if not found:  # nothing of this length is left anywhere
            if length == least:
                break
            length = max(least, length // 2)
    return tiles


class Items:
    """Benchmark items (hashed words) and the sorted seeds that look them up."""

    def __init__(self, ids: list, words: list[np.ndarray], last: bool = True):
        self.ids, self.words, self.last = ids, words, last
        seeds, item, at = [], [], []
        for i, w in enumerate(words):
            h = window_hashes(w, SEED)
            seeds.append(h)
            item.append(np.full(len(h), i))
            at.append(np.arange(len(h)))
        seeds, item, at = (np.concatenate([*x, np.zeros(0, d)]).astype(d) for x, d in ((seeds, np.uint64), (item, np.int64), (at, np.int64)))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.at = seeds[order], item[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def pairs(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, tiles) of the space-parted texts that items' tiles cover enough of."""
        words, begin = word_hashes(data, offsets)
        hashes = window_hashes(words, SEED)
        some = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(self.seeds, hashes[some], "left")
        sure = low < np.searchsorted(self.seeds, hashes[some], "right")
        some, low = some[sure], low[sure]
        text = np.searchsorted(begin, some, side="right") - 1
        inside = some + SEED <= begin[text + 1]
        some, low, text = some[inside], low[inside], text[inside]
        for t in np.unique(text):
            hits = np.unique(low[text == t])
            stops = np.searchsorted(self.seeds, self.seeds[hits], "right")
            places = np.concatenate([np.arange(a, b) for a, b in zip(hits, stops, strict=True)])
            for i in np.unique(self.item[places]):
                item = self.words[i]
                touched = np.zeros(len(item), bool)
                starts = self.at[places[self.item[places] == i]]
                touched[(starts[:, None] + np.arange(SEED)).ravel()] = True
                if touched.sum() < threshold * len(item):
                    continue  # tiles can't cover more than shared seeds do
                tiles = tile(words[begin[t] : begin[t + 1]], item)
                if sum(n for _, _, n in tiles) >= threshold * len(item):
                    yield int(t), int(i), tiles


def item_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of about BLOCK_WORDS words, collected when they are asked for: the driver holds one at a time.

    Items that can't be in a pair, of fewer than SEED words, are left out; without any other there is one empty block.
    """
    words = benchmark.select(F.col(id_column).alias("id"), normal_words(text_column).alias("words"))
    size = F.size(F.split("words", " "))
    words = materialize(words.filter(size >= SEED).withColumn("size", size))
    total = words.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    for b in range(blocks):
        rows = words.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).orderBy("id", "words").collect()
        hashed = [(r["id"], word_hashes(d := np.frombuffer(r["words"].encode(), np.uint8), np.array([0, len(d)]))[0]) for r in rows]
        yield Items([h[0] for h in hashed], [h[1] for h in hashed], b + 1 == blocks)


def _find(items, threshold: float, schema):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        held, id_type = items.value, to_arrow_type(schema["item_id"].dataType)
        for batch in batches:
            row, item, tiles = [], [], []
            for first, data, offsets in string_slices(batch.column("words")):
                for t, i, found in held.pairs(data, offsets, threshold):
                    row.append(first + t)
                    item.append(i)
                    tiles.append(found)
            part = batch.take(pa.array(row, pa.int64()))
            ids = pa.array([held.ids[i] for i in item], id_type)
            sizes = pa.array([len(held.words[i]) for i in item], pa.int64())
            covered = pa.array([sum(n for _, _, n in x) for x in tiles], pa.int64())
            text = pa.array([",".join(f"{d}:{i}:{n}" for d, i, n in sorted(x)) for x in tiles], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), ids, sizes, covered, text], names=schema.names)

    return run


def _drop(items, threshold: float):
    def run(batches) -> Iterator:
        import pyarrow as pa

        held = items.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, data, offsets in string_slices(batch.column(batch.num_columns - 1)):
                for t, _, _ in held.pairs(data, offsets, threshold):
                    keep[first + t] = False
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, tiles) of every contaminated pair.

    ``tiles`` are ``document word:item word:words``, comma-joined. Null and empty texts and items
    of fewer than SEED words are in no pair; repeated rows of either side are in pairs each; ids may
    have any type and null ones stay null; other columns are ignored; empty tables give no pairs.
    """
    out, spark = None, docs.sparkSession
    pairs = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("item_id", benchmark.schema[item_column].dataType)])
    schema = pairs.add("item_words", "long").add("covered_words", "long").add("tiles", "string")
    words = docs.select(F.col(id_column).alias("doc_id"), normal_words(text_column).alias("words"))
    for items in item_blocks(benchmark, item_column, item_text_column):
        held = spark.sparkContext.broadcast(items)
        found = words.mapInArrow(_find(held, threshold, schema), schema)
        if items.last:
            out = found if out is None else out.union(found)
        else:  # done with before the next block is collected
            found = materialize(found)
            held.unpersist()
            out = found if out is None else out.union(found)
    return out.select("doc_id", "item_id", "item_words", "covered_words", (F.col("covered_words") / F.col("item_words")).alias("coverage"), "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without its contaminated rows, columns as they were (nothing is shuffled).

    Rows are judged by their texts alone: null and empty ones stay, repeated ones go together, ids
    and other columns don't matter. An empty table, or an empty benchmark, drops nothing.
    """
    words = free_name(docs, "words")
    for turn, items in enumerate(item_blocks(benchmark, item_column, item_text_column)):
        if turn and turn % BLOCKS_AT_ONCE == 0:
            docs = materialize(docs)
        held = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.withColumn(words, normal_words(text_column)).mapInArrow(_drop(held, threshold), docs.schema)
    return docs
