"""Near-duplicate documents by DartMinHash.

A text's multiset of five-word shingles is a weighted set: a shingle's weight is how often it
occurs. Darts fall on the plane (element, weight) x rank as a Poisson process of rate 1 that
depends on hashes alone, so two texts see the same darts wherever their weighted regions
overlap. The plane is cut into unit cells; a text throws the darts of its own cells for ranks
below theta = t / weight, about t darts however long it is, each dart falls into one of k
coordinates, and each coordinate keeps its earliest dart. Two signatures agree in a coordinate
with the probability of their weighted Jaccard similarity. Coordinates are joined in bands;
what meets in a band is verified exactly on the 64-bit hashes of all its shingles.

Bands aren't expanded into pairs at first: a round verifies every member of a band against one
pivot only (the member that meets most others), links are contracted to components, and only
bands whose members still lie in different components go on. After PIVOT_ROUNDS of them small
bands compare the pairs that are left, and in larger ones texts meet once more by the rarest
elements of their sketches, which two texts of the similarity asked for must share. So every two
texts that meet in a band are joined by verified links, compared, or proven not to be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import GOLDEN, checked_broadcast, free_name, materialize, mix, normal_words, release, string_slices, text_key, text_or_empty, window_hashes, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 6
#: Bytes of texts whose darts are thrown at once.
SLICE = 1 << 18
#: Rounds of one pivot a band, texts of a band whose remaining pairs are all compared, and what rounding may cost.
PIVOT_ROUNDS, SMALL_BAND, SLACK = 3, 16, 1e-6
#: Cells of element hashes whose counts order elements by rarity (a power of two); a byte of each reaches the tasks.
RARITY_CELLS = 1 << 18


def unit_elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (shingle, occurrence) of space-parted texts, and where each text's begin.

    A text of one to four words is one shingle of all its words; one of none has no shingle.
    """
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    texts = len(counts)
    long = counts >= SHINGLE_WORDS
    sizes = np.where(long, counts - SHINGLE_WORDS + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(texts + 1, np.int64)
    np.cumsum(sizes, out=begin[1:])
    owner = np.repeat(np.arange(texts), sizes)
    source = at[:-1][owner] + np.arange(begin[-1]) - begin[:-1][owner]
    shingles = np.zeros(begin[-1], np.uint64)
    windows = window_hashes(words, SHINGLE_WORDS)
    whole = long[owner]
    shingles[whole] = windows[source[whole]]
    for i in np.flatnonzero(~long & (counts > 0)):
        shingles[begin[i]] = window_hashes(words[at[i] : at[i + 1]], int(counts[i]))[0] + np.uint64(counts[i])
    order = np.lexsort((shingles, owner))
    shingles = shingles[order]
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    occurrence = np.arange(len(shingles)) - np.repeat(first, np.diff(np.append(first, len(shingles))))
    again = occurrence > 0
    shingles[again] = mix(shingles[again] + occurrence[again].astype(np.uint64) * GOLDEN)
    return shingles, begin


#: P(Poisson(1) <= j) as 64-bit thresholds: a hash above the j-th has more than j darts.
_POISSON: list[int] = []
_p = _sum = float(np.exp(-1.0))
for _j in range(1, 18):
    _POISSON.append(min(int(_sum * 2.0**64), (1 << 64) - 1))
    _p /= _j
    _sum += _p


def _throw(elements: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, signature: np.ndarray) -> None:
    """Darts with ranks from low to high (whole or fractional, by text) into signature, which keeps the least rank."""
    cells = np.ceil(high).astype(np.int64) - np.floor(low).astype(np.int64)
    times = cells[owner]
    which = np.repeat(np.arange(len(elements)), times)
    if not len(which):
        return
    starts = np.cumsum(times) - times
    cell = np.arange(len(which)) - np.repeat(starts, times) + np.floor(low).astype(np.int64)[owner[which]]
    region = mix(elements[which] + (cell.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    text = owner[which]
    for j, threshold in enumerate(_POISSON):
        hit = np.flatnonzero(region > np.uint64(threshold))
        if not len(hit):
            break
        region, cell, text = region[hit], cell[hit], text[hit]
        dart = mix(region ^ np.uint64((j + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        fraction = dart >> np.uint64(24)  # 40 bits
        rank = cell.astype(np.uint64) << np.uint64(40) | fraction
        value = cell + fraction.astype(np.float64) / 2.0**40
        good = (value >= low[text]) & (value < high[text])
        coordinate = (mix(dart + GOLDEN) % np.uint64(k)).astype(np.int64)
        np.minimum.at(signature, text[good] * k + coordinate[good], rank[good])


def dart_signatures(elements: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """A row of k coordinates for each text that has elements; texts without stay at the maximum."""
    texts = len(begin) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full(texts * k, empty, np.uint64)
    weight = np.diff(begin)
    owner = np.repeat(np.arange(texts), weight)
    darts = k * (np.log(k) + 2)
    high = np.where(weight > 0, darts / np.maximum(weight, 1), 0.0)
    low = np.zeros(texts)
    while True:
        _throw(elements, owner, low, high, k, signature)
        lacking = (signature.reshape(texts, k) == empty).any(axis=1) & (weight > 0)
        if not lacking.any():
            return signature.reshape(texts, k)
        keep = lacking[owner]
        elements, owner = elements[keep], owner[keep]
        low, high = np.where(lacking, high, 0.0), np.where(lacking, 2 * high, 0.0)


def _bands(bands: int, rows: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row, data, offsets in string_slices(batch.column("words"), SLICE):
                elements, begin = unit_elements(data, offsets)
                signature = dart_signatures(elements, begin, bands * rows)
                n = len(begin) - 1
                keys = np.zeros((n, bands), np.uint64)
                for i in range(rows):
                    keys += signature[:, i::rows] * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
                keys = mix(mix(keys.ravel()) + np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, n)).view(np.int64)
                some = np.diff(begin) > 0
                flat = keys.reshape(n, bands)[some].ravel()
                stops = np.append(0, np.cumsum(some * bands)).astype(np.int32)
                part = batch.slice(row, n)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                arrays = [*columns, pa.array(np.diff(begin), pa.int64()), pa.ListArray.from_arrays(stops, pa.array(flat))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], "size", "bands"])

    return run


def _sketches(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for row, data, offsets in string_slices(batch.column("words"), SLICE):
            elements, begin = unit_elements(data, offsets)
            part = batch.slice(row, len(begin) - 1)
            longs = pa.array(elements.view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(begin.astype(np.int32), longs)], names=["node", "sketch"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Large-star and small-star rounds of Kiveris et al.; each round's table is written to the
    shared folder, so nothing of it passes through the driver.
    """

    def links(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = links(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def digest(e: DataFrame):
        row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        return row[0], row[1]

    now = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    seen = digest(now)
    while seen[0]:
        after = materialize(star(star(now, large=True), large=False))
        is_now = digest(after)
        release(now)
        now = after
        if is_now == seen:
            break
        seen = is_now
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialize(roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).distinct())


def _sizes_allow(a: str, b: str, similarity: float) -> Column:
    """Whether sets of these sizes can have ``similarity``."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(SLACK)


def _pairs(split: DataFrame, similarity: float) -> DataFrame:
    """(a, b): texts of different roots and like sizes that meet in a band (band, node, size, root), each pair once."""
    names = {"node": "b", "root": "other_root", "size": "other_size"}
    other = split.select("band", *[F.col(c).alias(n) for c, n in names.items()])
    met = split.withColumnRenamed("node", "a").join(other, "band").filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("other_root")))
    return met.filter(_sizes_allow("size", "other_size", similarity)).select("a", "b").distinct()


def _rarity(elements: DataFrame) -> np.ndarray:
    """A code for each of RARITY_CELLS cells of elements (root, element): 0 where all are of one root's texts, else higher the more there are."""
    cells = elements.groupBy(F.col("element").bitwiseAND(RARITY_CELLS - 1).cast("int").alias("cell"))
    counts = cells.agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    found = counts.select("cell", (1 + F.floor(8 * F.log2("n"))).cast("short").alias("code")).toArrow()
    codes = np.zeros(RARITY_CELLS, np.uint8)
    codes[found.column("cell").to_numpy()] = np.minimum(found.column("code").to_numpy(), 255)
    return codes


def _prefixes(codes: np.ndarray, similarity: float):
    """Of rows (node, root, sketch) the first (1 - similarity) * size + 1 elements by (code, element), but those of code 0, and how many those are."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            row, sketch = 0, batch.column("sketch")
            offsets = sketch.offsets.to_numpy().astype(np.int64)
            values = sketch.values.to_numpy(zero_copy_only=False)
            while row < len(sketch):
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
                begin, elements = offsets[row : end + 1] - offsets[row], values[offsets[row] : offsets[end]]
                held = np.diff(begin)
                owner = np.repeat(np.arange(len(held)), held)
                code = codes[elements & (RARITY_CELLS - 1)]
                order = np.lexsort((elements, code, owner))  # owners stay where they are
                elements, code = elements[order], code[order]
                length = held - np.ceil(held * similarity - SLACK).astype(np.int64) + 1
                kept = (np.arange(len(owner)) - begin[owner] < length[owner]) & (code > 0)
                stops = np.append(0, np.cumsum(np.bincount(owner[kept], minlength=len(held)))).astype(np.int32)
                skipped = np.bincount(owner[code == 0], minlength=len(held))
                part = batch.slice(row, end - row)
                prefix = pa.ListArray.from_arrays(stops, pa.array(elements[kept]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(skipped, pa.int64()), prefix], names=["node", "root", "skipped", "prefix"])
                row = end

    return run


def _prefix_pairs(split: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs of :func:`_pairs` that may be similar enough, found without forming the others.

    A sketch's elements are put in one order for all texts, about that of their rarity among these
    (any order is exact): by how many elements fall into a cell of their hash, so that the order is
    a small array and the elements themselves aren't joined with counts. Two sketches of
    ``similarity`` s share one of the first (1 - s) * size + 1 elements of both, and the elements
    after the first shared one must suffice for the overlap that s asks for. So texts meet in
    (band, element) of such a prefix, and only where sizes and places leave enough. Elements that
    one root's texts alone hold make no pair; cells of such come first and aren't made rows.
    """
    held = materialize(split.select("node", "root").distinct().join(sketches, "node").select("node", "root", "sketch"))
    codes = _rarity(held.select("root", F.explode("sketch").alias("element")))
    prefixes = held.mapInArrow(_prefixes(codes, similarity), "node long, root long, skipped long, prefix array<long>")
    prefixes = materialize(prefixes.select("node", "root", "skipped", F.posexplode("prefix").alias("place", "element")))
    met = prefixes.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    prefixes = prefixes.join(met.select("element"), "element").select("node", "element", (F.col("skipped") + F.col("place") + 1).alias("at"))
    prefix = materialize(split.join(prefixes, "node"))
    names = {"node": "b", "root": "other_root", "size": "other_size", "at": "other_at"}
    other = prefix.select("band", "element", *[F.col(c).alias(n) for c, n in names.items()])
    met = prefix.withColumnRenamed("node", "a").join(other, ["band", "element"]).filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("other_root")))
    most = 1 + F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))
    need = (F.col("size") + F.col("other_size")) * F.lit(similarity / (1 + similarity)) - F.lit(SLACK)
    return met.filter(most >= need).select("a", "b").distinct()


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: its id, ``text_key``, ``class_id``, ``class_size`` and ``is_kept``.

    Rows are in one class if a chain of links joins them: equal texts, or texts whose weighted
    Jaccard similarity over five-word shingles (lower-cased words; repeated shingles count as
    often as they occur) is at least ``similarity``. ``class_id`` is the least id of the class.
    ``is_kept`` marks one row of each class: least id, then least text key (null ids last).
    Texts without a word are linked to equal texts alone. Null and empty texts are never linked:
    each row is its own class with its own id (null if that is null) and is kept. Texts of one to four words are one shingle. Repeated
    rows fall into one class and one of them is kept. Columns besides id and text are ignored.
    """
    id_type = docs.schema[id_column].dataType
    base = docs.select(F.col(id_column).alias("id"), text_key(text_column).alias("key"), normal_words(text_column).alias("words"))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    rows = materialize(base.mapInArrow(_bands(BANDS, BAND_ROWS), schema).withColumn("row", F.monotonically_increasing_id()))
    wordy = rows.filter("size > 0")
    filled = F.col("key") != text_key(F.lit(""))  # neither null nor empty, with words or without
    same = rows.filter(filled).groupBy("key", "id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("least")
    texts = same.groupBy("key").agg(F.min("row").alias("node"), F.sum("n").alias("copies"), least)
    texts = materialize(texts.select("key", "node", "copies", F.col("least.id").alias("least_id"), (F.col("least.n") > 1).alias("again")))

    # bands in which different texts meet
    reps = wordy.join(texts.select("key", "node"), "key").filter(F.col("row") == F.col("node"))
    entries = reps.select("node", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(entries.join(shared, "band").select("band", "node", "n"))
    # the text that meets most others is the likeliest to be what the rest were copied from
    weights = met.groupBy("node").agg(F.sum("n").alias("weight")).join(reps.select("node", "size"), "node")
    still = members = materialize(met.join(weights, "node").select("band", "node", "size", "weight", F.col("node").alias("root")))

    # what verifies them: the (shingle, occurrence) hashes of every text that meets another
    involved = materialize(members.select("node").distinct().join(texts.select("node", "key", "least_id", "again"), "node"))

    def words_of(some: DataFrame) -> DataFrame:
        return base.join(some, (base["key"] == some["key"]) & base["id"].eqNullSafe(some["least_id"])).select("node", "words")

    # texts whose rows repeat are few in most corpora; their sketches must not be there as often
    repeated = words_of(checked_broadcast(materialize(involved.filter("again")))).dropDuplicates(["node"])
    wanted = words_of(involved.filter("NOT again").hint("merge")).union(repeated)  # grows with the documents: by shuffle at every size
    sketches = materialize(wanted.mapInArrow(_sketches, "node long, sketch array<long>"))

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        alike = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - F.lit(SLACK)
        return pairs.join(left, "a").join(right, "b").filter(alike).select("a", "b")

    def components(roots: DataFrame | None, links: DataFrame) -> DataFrame:
        return connected_components(links if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))

    def split(members: DataFrame, roots: DataFrame) -> DataFrame:
        """The members of bands that still lie in several components, and how many each such band has."""
        labelled = members.drop("root", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
        return materialize(labelled.join(apart.select("band", "n"), "band"))

    roots, tried = None, None
    for _ in range(PIVOT_ROUNDS):
        waiting = still if tried is None else still.join(tried, ["band", "node"], "left_anti")
        central = F.max(F.struct("weight", "node", "size", "root")).alias("p")
        pivots = materialize(waiting.groupBy("band").agg(central).select("band", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("node", "size", "root")]).withColumnRenamed("pivot_node", "pivot"))
        pairs = still.join(pivots, "band").filter((F.col("root") != F.col("pivot_root")) & _sizes_allow("size", "pivot_size", similarity))
        links = materialize(verified(pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()))
        tried = pivots.select("band", F.col("pivot").alias("node")) if tried is None else tried.union(pivots.select("band", F.col("pivot").alias("node")))
        roots = components(roots, links)
        still = split(still, roots)
    small, large = (still.filter(c).select("band", "node", "size", "root") for c in (F.col("n") <= SMALL_BAND, F.col("n") > SMALL_BAND))
    links = materialize(verified(_pairs(small, similarity).union(_prefix_pairs(large, sketches, similarity)).distinct()))
    roots = components(roots, links)

    labelled = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "key"))
    classes = labelled.groupBy("root").agg(first.alias("first"), F.sum("copies").alias("class_size"))
    by_text = labelled.select("key", "root").join(classes, "root").select("key", F.col("first.least_id").alias("class_id"), "class_size", F.col("first.key").alias("kept_key"))
    found = rows.select("id", "key", "row").join(by_text, "key", "left")
    alone = ~filled
    at_first = (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("class_id"))
    return found.select(
        F.col("id").alias(id_column),
        F.col("key").alias("text_key"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | F.coalesce(at_first, F.lit(False))).alias("is_kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each class of :func:`near_classes`, all columns as they were.

    Null and empty texts all stay. Of rows that agree in id and text one stays, whichever: those
    are made distinct before they meet. An empty table gives an empty one; extra columns don't matter.
    """
    key, row_id, again = (free_name(docs, c) for c in ("near_key", "near_id", "near_again"))
    kept = near_classes(docs, id_column, text_column).filter("is_kept").groupBy(F.col("text_key").alias(key), F.col(id_column).alias(row_id)).agg((F.count(F.lit(1)) > 1).alias(again))
    kept = kept.withColumn(again, F.col(again) & (F.col(key) != text_key(F.lit(""))))
    kept, left = materialize(kept), docs.withColumn(f"{key}_of_row", text_key(text_column))

    def met(some: DataFrame) -> DataFrame:
        return left.join(some, (F.col(f"{key}_of_row") == F.col(key)) & left[id_column].eqNullSafe(F.col(row_id)))

    repeated = checked_broadcast(materialize(kept.filter(again)))
    several = met(repeated).dropDuplicates([key, row_id])
    return met(kept.filter(~F.col(again))).select(*docs.columns).union(several.select(*docs.columns))
