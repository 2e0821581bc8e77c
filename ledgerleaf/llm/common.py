"""Shared helpers: Arrow batches in bounded slices, tables that cut lineage, joins that spread hot keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of text, that a Python task holds at once; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20
#: Hot keys that ``spread_join`` sends to all tasks at most.
MOST_HOT = 4096
#: Rows of a key up to which it is never split.
LEAST_HOT = 256
#: Rows of a join that one task joins in no time, hot keys or not.
SMALL = 10_000


_stores: dict[str, dict] = {}


def word_store(owner: str) -> dict:
    """What a Python worker keeps by word for one operator. Workers live on from stage to stage, so the others' stores are emptied."""
    for name, store in _stores.items():
        if name != owner and store:
            store.clear()
    return _stores.setdefault(owner, {})


def shared_dir(df: DataFrame) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Without either it raises: a folder of the driver's own is not seen by the executors of a cluster.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    given = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given.get()


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so later steps don't recompute it.

    Whoever owns the folder clears it after the job, as with checkpoints: results read from these tables.
    """
    path = f"{shared_dir(df).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from stage to stage beside the JVM, which needs it."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and ``size`` bytes of strings and binaries, at least a row each."""
    held = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(held)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] + size, "right")) - 1
        end = min(batch.num_rows, at + rows, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def by_slices(fn: Callable[[dict], dict], schema: pa.Schema, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """An Arrow mapper that calls ``fn`` with dicts of Python lists, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, size):
                made = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    return run


def spread_join(rows: DataFrame, table: DataFrame, key: str, deal_by: str | Column, n: str = "n_rows", total: int | None = None) -> DataFrame:
    """``rows`` inner joined with ``table``, which has one row a key and in ``n`` the number of its rows.

    A key of more than LEAST_HOT rows and of more than a MOST_HOT-th of all is dealt over as many tasks as it has such
    shares, by a hash of ``deal_by``, its row of ``table`` going to each. No more than MOST_HOT keys can be so
    large, which bounds what is broadcast. ``n`` is dropped. ``total``: the sum of ``n`` where the caller knows it.
    """
    if total is None:
        total = table.agg(F.sum(n)).first()[0] or 0
    share = max(LEAST_HOT, total // MOST_HOT)
    if total <= SMALL:
        return rows.join(table.drop(n), key)
    parts = F.ceil(F.col(n) / share).cast("int")
    hot = table.where(F.col(n) > share).select(key, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(deal_by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > share, parts - 1).otherwise(0)))).drop(n)
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
