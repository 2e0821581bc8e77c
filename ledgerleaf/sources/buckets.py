"""Keyed tables of immutable bucket folders and a manifest for each batch.

A batch writes the buckets that its keys fall into, merged with what they held, as ``data/batch=N/bucket=B``, and then one
manifest: for every bucket the batch that wrote it last and its number of rows. Readers take the newest complete manifest, so a batch is seen whole or
not at all. A batch looks at manifests of earlier batches only: run again, also after a crash half-way, it leaves the same table. It reads the
buckets it touches and no others; the number of rows follows from the manifest by differences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.sources.tables import written

#: Buckets of a table.
BUCKETS = 64
#: Files of a bucket that a batch writes at most.
FILES = 4

Manifest = dict[int, tuple[int, int]]


def _folders(spark: SparkSession, path: str) -> dict[str, object]:
    """Names and paths of the folders below ``path``, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName(): (fs, s.getPath()) for s in fs.listStatus(at) if s.isDirectory()} if fs.exists(at) else {}


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Batches whose manifest is complete, ascending."""
    jvm, found = spark.sparkContext._jvm, []
    for name, (fs, at) in _folders(spark, f"{path}/manifest").items():
        if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            found.append(int(name.removeprefix("batch=")))
    return sorted(found)


def manifest(spark: SparkSession, path: str, before: int | None = None) -> Manifest:
    """``bucket -> (batch, rows)`` of the newest batch, of those ``before`` one if given; empty where there is none."""
    known = [b for b in _batches(spark, path) if before is None or b < before]
    rows = spark.read.schema("bucket int, batch int, n long").json(f"{path}/manifest/batch={known[-1]}").collect() if known else []
    return {r["bucket"]: (r["batch"], r["n"]) for r in rows}  # a row a bucket


def _read(spark: SparkSession, path: str, held: Manifest, schema: T.StructType) -> DataFrame:
    """The rows with all columns that were ever written, those of ``schema`` first."""
    folders = [f"{path}/data/batch={batch}/bucket={bucket}" for bucket, (batch, n) in held.items() if n]
    none = spark.createDataFrame([], schema)
    return none if not folders else none.unionByName(spark.read.option("mergeSchema", True).parquet(*folders), allowMissingColumns=True)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the table as the newest batch left it, in the columns of ``schema``; none where there is no batch."""
    rows = _read(spark, path, manifest(spark, path), schema)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    cell = lambda f: F.col(f"`{f.name}`") if kinds[f.name] == f.dataType.simpleString() else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
    return rows.select(*map(cell, schema))


def count_buckets(spark: SparkSession, path: str) -> int:
    return sum(n for _, n in manifest(spark, path).values())


def replaced(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merging by which new rows replace those of their keys; of new rows of one key a fixed one stays."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in new.columns])
        one = new.groupBy(*keys).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
        return old.join(one.select(*keys), keys, "left_anti").unionByName(one, allowMissingColumns=True)

    return merge


def upsert_buckets(rows: DataFrame, path: str, keys: list[str], batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
    """Merge ``rows`` into the table at ``path`` as batch ``batch``; returns the number of rows of the table.

    ``merge(old, new)`` sees the touched buckets only; by default new rows replace those of their keys. Keys that are null are keys as others, but for joins.
    """
    spark, merge = rows.sparkSession, merge or replaced(keys)
    before = manifest(spark, path, batch)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    new = written(rows.withColumn("bucket", bucket))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
    old = _read(spark, path, {b: before[b] for b in touched if b in before}, rows.schema)
    merged = merge(old, new.drop("bucket"))
    kinds = T.StructType([*merged.schema.fields, T.StructField("bucket", T.IntegerType())])
    merged = merged.withColumn("bucket", bucket)
    target = f"{path}/data/batch={batch}"
    merged.repartition("bucket", F.pmod(F.xxhash64(F.lit("file"), *keys), F.lit(FILES))).write.mode("overwrite").partitionBy("bucket").parquet(target)
    made = {}
    if touched:
        counts = spark.read.schema(kinds).parquet(target).groupBy("bucket").count().collect()
        made = {r["bucket"]: (batch, r["count"]) for r in counts}
    whole = before | {b: made.get(b, (batch, 0)) for b in touched}
    lines = spark.createDataFrame([(b, at, n) for b, (at, n) in sorted(whole.items())], "bucket int, batch int, n long")
    lines.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch={batch}")  # a row a bucket, in one file that appears at once
    return sum(n for _, n in whole.values())


def next_batch(spark: SparkSession, path: str) -> int:
    return max(_batches(spark, path), default=-1) + 1


def compact_buckets(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete bucket folders that none of the ``keep`` newest manifests names, and older manifests; returns the number of folders deleted.

    Readers and running batches that hold an older state must have finished.
    """
    known, deleted = _batches(spark, path), 0
    needed = {(at, b) for n in known[-keep:] for b, (at, _) in manifest(spark, path, n + 1).items()}
    for name, (fs, at) in _folders(spark, f"{path}/data").items():
        batch = int(name.removeprefix("batch="))
        if known and batch <= known[-1]:
            below = {n: f for n, f in _folders(spark, at.toString()).items() if n.startswith("bucket=")}
            old = [f for n, f in below.items() if (batch, int(n.removeprefix("bucket="))) not in needed]
            for _, folder in old:
                fs.delete(folder, True)
            deleted += len(old)
            if len(old) == len(below):
                fs.delete(at, True)
    for name, (fs, at) in _folders(spark, f"{path}/manifest").items():
        if int(name.removeprefix("batch=")) in known[:-keep]:
            fs.delete(at, True)
    return deleted
