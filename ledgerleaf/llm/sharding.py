"""Shards of near-equal bytes by longest-processing-time scheduling.

Rows of equal text form a group that stays together; a null text counts as the empty text. Sorted by
size, each group goes to the least loaded shard, kept in a heap. Groups of one size are interchangeable, so the
driver sees only the histogram of group sizes: D sizes, where D * D / 2 is at most the bytes of the table, and some
thousands in practice as most groups are single rows. Groups of a size are scheduled one by one through the heap, or,
where they are many times the shards, in one step that gives what the heap would: all places under a common
level, then the places at it. The groups of a size are then numbered in parts and dealt by those counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.llm.common import saved, spread_join

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Groups of one size per shard, from which on they are scheduled in one step.
AT_ONCE = 8
#: Rows of a shard, or groups of a size, that one task numbers, about.
SLOT_ROWS = 20_000


def _level(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal items each shard gets, least loaded first, ties to the lower shard."""
    under = lambda level: sum(max(0, -((x - level) // size)) for x in loads)  # noqa: E731  items that start below a level
    low, high = min(loads), max(loads) + size * count
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if under(middle) <= count else (low, middle)
    taken = [max(0, -((x - low) // size)) for x in loads]
    left = count - sum(taken)
    # the next starts of all shards that lie at the level
    for s, x in enumerate(loads):
        if left and x + taken[s] * size == low:
            taken[s] += 1
            left -= 1
    return taken


def lpt(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """``{size: [(shard, groups)]}`` for ``(size, groups)``: largest first, each group to the least loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out: dict[int, list[tuple[int, int]]] = {}
    for size, count in sorted(sizes, reverse=True):
        if count > AT_ONCE * shards:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            taken = _level(loads, size, count)
            heap = [(loads[s] + n * size, s) for s, n in enumerate(taken)]
            heapq.heapify(heap)
            out[size] = [(s, n) for s, n in enumerate(taken) if n]
            continue
        got: dict[int, int] = {}
        for _ in range(count):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] = got.get(s, 0) + 1
        out[size] = sorted(got.items())
    return out


def numbered(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``, gapless from 0 within each value of ``by``, in no stated order.

    Values are numbered in parts (by a hash of ``order``) whose sizes are summed up first, so that no task
    holds all rows of one. Rows equal in ``order`` are interchangeable.
    """
    rows = saved(df)
    parts = max(8, rows.count() // SLOT_ROWS)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = rows.groupBy(by, "_part").count()
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(by, "_part").orderBy(*order)
    return rows.withColumn("_row", F.row_number().over(within)).join(offsets, [by, "_part"]).withColumn(name, F.col("_offset") + F.col("_row") - 1).drop("_part", "_row", "_offset")


def assign(df: DataFrame, shards: int = 40, text_col: str = "text") -> DataFrame:
    """Add ``size`` (UTF-8 bytes of the text and ROW_BYTES), ``text_crc32`` and ``shard`` to the rows.

    ``text_col`` is dropped; other columns stay. An empty table gives an empty result; repeated rows fall into one
    group and so one shard. Columns ``size``, ``text_crc32`` and ``shard`` of ``df`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(
        df.withColumns({"size": F.octet_length(text).cast("long") + F.lit(ROW_BYTES), "text_crc32": F.crc32(text), "_key": F.unhex(F.sha2(text, 256))}).drop(text_col, "shard")
    )
    groups = saved(rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("n_rows")))
    histogram = groups.groupBy("_bytes").count().collect()
    placed = lpt([(r[0], r[1]) for r in histogram], shards)
    runs = []
    for size, parts in placed.items():
        at = 0
        bounds = []
        for s, n in parts:
            at += n
            bounds.append((s, at))
        runs.append((size, bounds, at))
    table = df.sparkSession.createDataFrame(runs, "_bytes long, _runs array<struct<shard:int,upto:long>>, n_groups long")
    # the groups of a size in their order: the first run goes to the first shard, and so on
    places = spread_join(numbered(groups, "_bytes", ["_key"], "_nth"), saved(table), "_bytes", "_key", "n_groups")
    shard = F.element_at(F.filter("_runs", lambda r: F.col("_nth") < r["upto"]), 1)["shard"]
    return spread_join(rows, saved(places.select("_key", shard.alias("shard"), "n_rows")), "_key", F.monotonically_increasing_id()).drop("_key")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` by the law of near-equal bytes.

    Null texts count as empty, equal texts (also empty ones) stay together, rows that repeat an id are rows of their
    own. An empty table gives an empty result. Other columns are not read.
    """
    placed = numbered(assign(docs.select("doc_id", "text"), shards), "shard", ["doc_id", "size", "text_crc32"], "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
