"""Structured Streaming jobs: the live catalogue, scores on arrival, staging outcomes, request limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ledgerleaf.operators.scoring import score_reports
from ledgerleaf.sources.buckets import count_buckets, read_buckets, upsert_buckets

LIMIT_SCHEMA = "key string, ts timestamp, seq bigint, allowed boolean, remaining int, reset_ms bigint"


def _start(df: DataFrame, fn, checkpoint: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_id(df: DataFrame, id_col: str = "report_id", order: str = "created_at") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc_nulls_last(order)))
    return df.withColumn("nth", nth).where("nth = 1").drop("nth")


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a streamed catalogue after its last batch."""
    return read_buckets(spark, path, schema)


def read_live_count(spark: SparkSession, path: str) -> DataFrame:
    """``n``: the number of reports after the last batch, from its manifest."""
    return spark.createDataFrame([(count_buckets(spark, path),)], "n long")


def stream_catalogue(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest record of each id in a table of buckets, whose manifest has the live count.

    A batch reads the buckets of ids that it touches and no others; ``compact_buckets`` removes folders that later batches replaced.
    """

    def upsert(batch: DataFrame, n: int) -> None:
        upsert_buckets(batch, path, ["report_id"], n, lambda old, new: latest_per_id(old.unionByName(new, allowMissingColumns=True)))

    return _start(records, upsert, checkpoint)


SCORE_KEYS = ["version", "report_id"]


def stream_scores(documents: DataFrame, path: str, checkpoint: str, first: int = 0) -> StreamingQuery:
    """Scores of new documents, whole texts, into the table that ``write_scores`` writes; a document that comes again replaces its scores.

    The table's batches are the stream's from ``first`` on, so a batch that runs again after a restart leaves the same table.
    """

    def score(batch: DataFrame, n: int) -> None:
        upsert_buckets(score_reports(batch.select("report_id", "text")), path, SCORE_KEYS, first + n)

    return _start(documents, score, checkpoint)


def stream_dedupe_uploads(uploads: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first upload of each hash within the watermark."""
    return uploads.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["sha256"])


def staging_outcomes(staged: DataFrame, finals: DataFrame, hours: int = 2) -> DataFrame:
    """``token, created_at, outcome``: finalized if the finalization comes by the expiry, else expired.

    ``staged``: ``token, created_at``; ``finals``: ``token, finalized_at``. Runs on tables and on streams; on
    streams an outcome is known once the watermarks have passed the expiry.
    """
    a, b = staged, finals.withColumnRenamed("token", "final_token")
    if staged.isStreaming:
        a, b = a.withWatermark("created_at", "10 minutes"), b.withWatermark("finalized_at", "10 minutes")
    within = F.expr(f"token = final_token AND finalized_at >= created_at AND finalized_at <= created_at + INTERVAL {hours} HOURS")
    joined = a.join(b, within, "left_outer")
    return joined.select("token", "created_at", "finalized_at", F.when(F.col("final_token").isNull(), "expired").otherwise("finalized").alias("outcome"))


def _admit(times: list[int], kept: list[int], window_ms: int, most: int) -> Iterator[tuple[bool, int, int]]:
    """Decision for each time in order; ``kept`` holds admitted times only and is updated in place."""
    for now in times:
        kept[:] = [t for t in kept if t > now - window_ms]
        if len(kept) >= most:
            yield False, 0, kept[0] + window_ms - now
        else:
            kept.append(now)
            yield True, most - len(kept), window_ms


def trailing_limit(events: DataFrame, window_ms: int, most: int) -> DataFrame:
    """``key, ts, seq, allowed, remaining, reset_ms`` of events ``key, ts, seq``, in time order (``seq`` breaks ties).

    A decision depends on those before, as refused events leave no trace, so a key is one sequence; its rows
    stream through in sorted Arrow batches and the state is the last ``most`` admitted times.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), "ts", F.col("seq").cast("long").alias("seq"))
    dealt = rows.repartition("key").sortWithinPartitions("key", "ts", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, []
        for frame in frames:
            made = []
            ms = frame["ts"].astype("datetime64[ms]").astype("int64").tolist()
            for key, t in zip(frame["key"], ms, strict=True):
                if key != current:
                    current, kept = key, []
                made += _admit([t], kept, window_ms, most)
            yield frame.assign(allowed=[m[0] for m in made], remaining=pd.Series([m[1] for m in made], dtype="int32"), reset_ms=[m[2] for m in made])

    return dealt.mapInPandas(run, LIMIT_SCHEMA)


class _Limiter(StatefulProcessor):
    """The same decisions on a stream: the admitted times of a key are its state."""

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", T.StructType([T.StructField("t", T.LongType())]), ttlDurationMs=None)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        kept = [r[0] for r in self.times.get()] if self.times.exists() else []
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
        ms = frame["ts"].astype("datetime64[ms]").astype("int64").tolist()
        made = list(_admit(ms, kept, self.window_ms, self.most))
        self.times.put([(t,) for t in kept]) if kept else self.times.clear()
        yield frame.assign(allowed=[m[0] for m in made], remaining=pd.Series([m[1] for m in made], dtype="int32", index=frame.index), reset_ms=[m[2] for m in made])[["key", "ts", "seq", "allowed", "remaining", "reset_ms"]]

    def close(self) -> None:
        pass


def stream_trailing_limit(events: DataFrame, window_ms: int, most: int) -> DataFrame:
    """``trailing_limit`` of a stream; needs the RocksDB state store."""
    rows = events.select(F.col("key").cast("string").alias("key"), "ts", F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("key").transformWithStateInPandas(_Limiter(window_ms, most), LIMIT_SCHEMA, "append", "None")


def trailing_counts(events: DataFrame, window_ms: int) -> DataFrame:
    """Add ``n``: the events of the key in the trailing window, this one and its equals in time included."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("key").orderBy("us").rangeBetween(-(window_ms * 1000) + 1, 0)
    return events.withColumn("us", us).withColumn("n", F.count("*").over(w)).drop("us")
