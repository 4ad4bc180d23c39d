"""Pieces the corpus operators share: scratch tables, word hashing, ranks without a hot task."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Odd multipliers (golden ratio and the two finalizer constants of splitmix64).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes of text hashed at once.
LONG_TEXT = 1 << 22
#: Rows of a narrow table that may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows that a cell of ``rank_within`` aims at.
CELL_ROWS = 20_000

_local_folder: list[str] = []
#: Scratch tables that are there.
_made: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a local one only where it is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_folder:
        folder = tempfile.TemporaryDirectory(prefix="rivulet-")
        atexit.register(folder.cleanup)
        _local_folder.append("file://" + folder.name)
    return _local_folder[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts lineage, survives lost executors, and lets several readers use one computation. The
    tables stay until :func:`sweep`, since what an operator returns reads them.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/rivulet-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete scratch tables of :func:`materialize` that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = next((p for p in _made if file.startswith(p) or p.rsplit("/", 1)[1] in file), None)
            if folder is not None:
                _delete(df.sparkSession, folder)
                _made.remove(folder)


def sweep(spark: SparkSession, *kept: DataFrame) -> None:
    """Delete this process's scratch tables but those that ``kept`` read: for when the results of operators have been written."""
    names = {f.rsplit("/", 2)[-2] for df in kept for f in df.inputFiles()}
    for path in [p for p in _made if p.rsplit("/", 1)[1] not in names]:
        _delete(spark, path)
        _made.remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def normal_words(column: str | Column) -> Column:
    """Lower-cased runs of letters, marks and digits, parted by single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(column)), r"[^\p{L}\p{M}\p{N}]+", " "))


def text_key(column: str | Column) -> Column:
    """16 bytes that stand for a whole text."""
    return F.unhex(F.md5(text_or_empty(column)))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, elementwise; ``x`` is uint64 and is overwritten."""
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of BASE (or of its inverse) modulo 2**64."""
    name, base = ("down", BASE_INVERSE) if inverse else ("up", BASE)
    if len(_powers[name]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def string_slices(values, limit: int = 1 << 19) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """Whole strings of an Arrow string array in slices of about ``limit`` bytes.

    Yields (first row, bytes as uint8, offsets); a string over the limit is a slice of its own.
    """
    import pyarrow as pa

    if values.type == pa.string():
        values = values.cast(pa.large_string())
    if values.null_count:
        values = values.fill_null("")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(values):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(values))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()  # a worker lives long: what Arrow holds in reserve goes back


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the space-parted words of texts, and where each text's words begin.

    A word's hash is its polynomial in BASE, shifted to begin at power 0, then mixed.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if n > LONG_TEXT and len(offsets) == 2:  # one very long text, in parts that end with a word
        parts, at = [], 0
        while at < n:
            stop = min(n, at + LONG_TEXT)
            while stop < n and data[stop] != 32:
                stop += 1
            parts.append(word_hashes(data[at:stop], np.array([0, 0, stop - at]))[0])
            at = stop
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = data != 32
    edge = np.diff(inside)
    # a text's end parts words too
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    if len(both):
        starts = np.sort(np.concatenate([starts, both]))
        ends = np.sort(np.concatenate([ends, both]))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    hashes = (total[ends] - total[starts]) * powers(n + 1, inverse=True)[starts]
    hashes += (ends - starts).astype(np.uint64) * GOLDEN
    return mix(hashes), np.searchsorted(starts, offsets).astype(np.int64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words (across text borders too: callers mask those)."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    factor = 1
    for i in range(n):
        out += words[i : i + count] * np.uint64(factor)
        factor = factor * BASE % (1 << 64)
    return mix(out)


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast of a materialized table only if it has at most BROADCAST_ROWS rows; else Spark joins by shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rank_within(
    df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[str | Column], rank: str, narrow: DataFrame | None = None
) -> DataFrame:
    """Add ``rank``: 1, 2, ... within ``keys`` (never null) in the order (cell, order), no key in one task.

    ``cell`` cuts each key's rows into parts in rank order; parts are counted first, their
    running sums joined back, and only a part is ever sorted by one task. ``narrow`` may name
    a table with the same keys and cells to count, if that is cheaper to read than ``df``.
    """
    cells = (df if narrow is None else narrow).withColumn("_cell", cell).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_cell").orderBy(*order)
    joined = df.withColumn("_cell", cell).join(checked_broadcast(materialize(cells)), [*keys, "_cell"])
    return joined.withColumn(rank, F.col("_before") + F.row_number().over(within)).drop("_cell", "_before")
