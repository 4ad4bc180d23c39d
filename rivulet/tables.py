"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder of this machine only where it is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        folder = tempfile.TemporaryDirectory(prefix="rivulet-")
        atexit.register(folder.cleanup)
        _local.append("file://" + folder.name)
    return _local[0]


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/fabric-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: lineage ends there, and a lost executor costs no recomputation of it.

    Joins with it go by shuffle at every size: its rows take many times its file's bytes, and a broadcast passes them
    through the driver.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def group_numbers(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each run of equal keys, and each row's run by number."""
    ids = table[key].combine_chunks()
    a, b = ids.slice(1), ids.slice(0, max(len(ids) - 1, 0))
    changed = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False).astype(bool)
    number = np.concatenate([np.zeros(min(len(ids), 1), np.int64), np.cumsum(changed)])
    return np.flatnonzero(np.diff(number, prepend=-1)), number


def whole_groups(key: str, run: Callable[[pa.Table], pa.Table], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over rows in the order of ``key``: ``run`` gets tables of whole groups, of about ``rows`` rows where groups are smaller."""

    def each(batches):
        waiting, n, least = [], 0, rows
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            n += batch.num_rows
            if n < least:
                continue
            table = pa.Table.from_batches(waiting)
            first, _ = group_numbers(table, key)
            if len(first) > 1:  # the last one may go on
                yield from run(table.slice(0, first[-1]).combine_chunks()).to_batches()
                table = table.slice(first[-1])
            waiting, n = table.to_batches(), table.num_rows
            least = max(rows, 2 * n)
        if n:
            yield from run(pa.Table.from_batches(waiting).combine_chunks()).to_batches()

    return each
