"""Sources and sinks with explicit schemas."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerleaf.functions.blocks import SLICE_BYTES, SLICE_ROWS, slices
from ledgerleaf.sources.buckets import next_batch, upsert_buckets
from ledgerleaf.sources.tables import written

CORRUPT = "_corrupt_record"

INDEX_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in ("id", "c", "ct", "s", "i", "k")] + [T.StructField("y", T.IntegerType())] + [T.StructField(k, T.StringType()) for k in ("ss", "si")])

UPLOAD_SCHEMA = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("createdAt", T.StringType()), T.StructField("stageToken", T.StringType()),
    T.StructField("report", T.StructType([T.StructField(k, T.StringType()) for k in ("id", "slug", "company", "country", "sector", "industry", "sourceSector", "sourceIndustry", "reportKey", "reportUrl", "createdAt")] + [T.StructField(k, T.IntegerType()) for k in ("pageStart", "pageEnd", "publishedYear")])),
    T.StructField("file", T.StructType([T.StructField("name", T.StringType()), T.StructField("contentType", T.StringType()), T.StructField("originalBytes", T.LongType()), T.StructField("storedBytes", T.LongType()), T.StructField("sha256", T.StringType())])),
    T.StructField(CORRUPT, T.StringType()),
])

PAGE_SCHEMA = "k string, local_path string, year int, slug string, report_id string, company string, country string, sector string, industry_group string, page int, text string, text_chars int"
CHUNK_SCHEMA = "k string, report_id string, company string, country string, sector string, industry_group string, year int, page int, chunk_in_page int, text string, token_count int"

#: Files of a folder at most, so that folders are listed by many tasks.
FOLDER_FILES = 1024
#: Bytes of small files that a task reads, about.
TASK_BYTES = 16 << 20

CSV_COLUMNS = ["report_id", "company", "country", "sector", "industry", "year", "score", "band", "completeness", "consistency", "assurance", "transparency", "report_key"]


def read_report_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array; those without a key are dropped, the last row of each key wins."""
    rows = spark.read.schema(INDEX_SCHEMA).json(path, multiLine=True).where("k is not null and k <> ''")
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    last = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("pos")))
    return rows.withColumn("nth", last).where("nth = 1").drop("nth")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _projected(df: DataFrame) -> DataFrame:
    r = "report"
    rows = df.where(F.col(CORRUPT).isNull()).select(
        F.col(f"{r}.id").alias("report_id"), F.col(f"{r}.slug").alias("slug"), F.col(f"{r}.company").alias("company"), F.col(f"{r}.country").alias("country"),
        F.col(f"{r}.sector").alias("sector"), F.col(f"{r}.industry").alias("industry"), F.col(f"{r}.publishedYear").alias("year"), F.col(f"{r}.reportKey").alias("report_key"),
        F.coalesce(F.col("createdAt"), F.col(f"{r}.createdAt")).try_cast("timestamp").alias("created_at"), F.col("file.sha256").alias("sha256"),
    )
    return rows.where("report_id is not null and slug is not null and report_key is not null")


def read_upload_records(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """One JSON file a report, or an array of them; files that don't parse are skipped; id, slug and key are required."""
    raw = spark.read.schema(UPLOAD_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", glob).json(folder, multiLine=True)
    return _projected(raw)


def _in_tasks(rows: DataFrame) -> DataFrame:
    """Rows of small files in tasks of about TASK_BYTES, but some for every core: Spark's own partitions count each file as megabytes, down to a task a file."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.coalesce(max(4 * rows.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))


def _seen(path: str) -> bool:
    """Whether Spark's readers take a file or folder of this name."""
    name = path.rpartition("/")[2]
    return name.startswith(("_common_metadata", "_metadata")) or not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _uri(path: str) -> str:
    """A path as Spark's metadata of a file have it: what a URI doesn't allow is quoted, other letters stay."""
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=/@\x80-\U0010ffff]|\s", lambda m: quote(m[0]), path)


def _folder(spark: SparkSession, folder: str) -> tuple[fs.FileSystem, str, str] | None:
    """The file system of a folder, its path there and its name in Spark; None for what only Spark's readers open (other stores, patterns, single files)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    named = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    try:
        files, root = fs.FileSystem.from_uri(named.toUri().toString())
        return (files, root, named.toString()) if files.get_file_info(root).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError):
        return None


def _files_below(spark: SparkSession, files: fs.FileSystem, root: str, glob: str) -> DataFrame:
    """``path, size`` of the files below a folder that are not empty, listed by tasks, a level of folders at a time: the driver holds no names."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = [x for x in files.get_file_info(fs.FileSelector(path)) if _seen(x.path)]
                sizes = [x.size if x.is_file else None for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in found], pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    tasks, levels = 4 * spark.sparkContext.defaultParallelism, []
    folders = spark.createDataFrame([(root,)], "path string")
    while not folders.isEmpty():
        levels.append(written(folders.mapInArrow(look, "path string, size long")))
        folders = levels[-1].where("size is null").select("path").repartition(tasks)
    named = f"(?s)^(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()})$"
    return reduce(DataFrame.unionByName, levels).where(F.col("size") > 0).where(F.substring_index("path", "/", -1).rlike(named))


def _read_in_tasks(found: DataFrame, read: Callable[[str], tuple], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """``read(path)`` of each file of ``_files_below``, in tasks of about TASK_BYTES, but some for every core."""
    spark = found.sparkSession
    size = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for part in _parts_of(batch):
                made = [read(path) for path in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], names=names)

    return found.select("path", "size").repartition(max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)).mapInArrow(rows, schema)


def _parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Files of SLICE_ROWS and SLICE_BYTES at most, a larger one by itself."""
    start, held = 0, 0
    for i, size in enumerate(batch.column(1).to_pylist()):
        if i > start and (i - start >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def read_markdown_corpus(spark: SparkSession, folder: str, prefix: str = "", extension: str = "md") -> DataFrame:
    """``report_key, text``: a text file a report, its key from its path below ``folder``.

    Tasks list the folder and read its files; what only Spark's readers open is listed by the driver.
    """
    if place := _folder(spark, folder):
        files, root, named = place

        def read(path: str) -> tuple[str, bytes]:
            with files.open_input_stream(path, compression=None) as text:
                return _uri(named + path[len(root) :]), text.read()

        rows = _read_in_tasks(_files_below(spark, files, root, f"*.{extension}"), read, [pa.string(), pa.binary()], "file_path string, value binary")
        rows = rows.select(F.col("value").cast("string").alias("value"), "file_path", F.substring_index("file_path", "/", -1).alias("file_name"))
    else:
        rows = _in_tasks(spark.read.option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_name"))
    below = F.regexp_extract("file_path", rf"(reports/.*)\.{extension}$", 1)
    key = F.when(below != "", F.concat(F.lit(prefix), below, F.lit(".pdf"))).otherwise(F.regexp_replace("file_name", rf"\.{extension}$", ".pdf"))
    return rows.select(key.alias("report_key"), F.col("value").alias("text"))


def inventory_binaries(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, size, sha256, has_signature`` of each file.

    Tasks list the folder and read its files, a piece at a time; what only Spark's readers open is listed by the driver.
    """
    if place := _folder(spark, folder):
        files, root, named = place

        def read(path: str) -> tuple[str, int, str, bool]:
            digest, size, first = hashlib.sha256(), 0, b""
            with files.open_input_stream(path, compression=None) as stream:
                while piece := stream.read(SLICE_BYTES):
                    first = first if size else piece[:5]
                    digest.update(piece)
                    size += len(piece)
            return named + path[len(root) :], size, digest.hexdigest(), first == b"%PDF-"

        return _read_in_tasks(_files_below(spark, files, root, glob), read, [pa.string(), pa.int64(), pa.string(), pa.bool_()], "path string, size long, sha256 string, has_signature boolean")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return _in_tasks(rows).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("has_signature"))


def write_text_files(rows: DataFrame, folder: str) -> int:
    """A file for each row of ``name, text`` in ``folder``, which all executors see: ``N/name.K.txt``, K being the row's number and N that of some FOLDER_FILES rows. Returns how many.

    Executors write the files where the rows are. A file appears whole under its name, and a task that runs again writes the same files; so nothing is left to be moved at the end.
    """
    numbered = rows.select("name", "text", F.monotonically_increasing_id().alias("row"))
    files, root = fs.FileSystem.from_uri(folder if ":" in folder else os.path.abspath(folder))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            for part in slices(batch, 1):
                for name, text, row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    below = f"{root}/{row // FOLDER_FILES:x}"
                    if below != made:
                        files.create_dir(below)
                        made = below
                    hidden = f"{below}/.{uuid.uuid4().hex}"
                    with files.open_output_stream(hidden) as out:
                        out.write((text or "").encode())
                    files.move(hidden, f"{below}/{name}.{row}.txt")
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])], names=["n"])

    return numbered.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_scores(scores: DataFrame, path: str, batch: int | None = None) -> int:
    """The scores' (version, report) keys replaced in the table at ``path``; returns its number of rows. The same batch written again leaves the same table; by default it is a new one."""
    return upsert_buckets(scores, path, ["version", "report_id"], next_batch(scores.sparkSession, path) if batch is None else batch)


def write_entities(entities: DataFrame, path: str, batch: int | None = None) -> int:
    """All entities of the (version, report) keys replaced by those given, in the table at ``path``."""
    keys = ["version", "report_id"]
    whole = lambda old, new: old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    return upsert_buckets(entities, path, keys, next_batch(entities.sparkSession, path) if batch is None else batch, whole)


def scored_csv_rows(df: DataFrame) -> DataFrame:
    """The 13 columns as text: companies quoted, scores rounded half up, nulls empty."""
    rounded = {"score", "completeness", "consistency", "assurance", "transparency"}
    cell = lambda c: F.when(F.col(c).isNotNull(), F.floor(F.col(c) + 0.5).cast("string")) if c in rounded else F.col(c).cast("string")
    return df.select(*[F.coalesce(cell(c), F.lit("")).alias(c) for c in CSV_COLUMNS]).withColumn("company", F.concat(F.lit('"'), F.replace("company", F.lit('"'), F.lit('""')), F.lit('"')))


def export_scored_csv(df: DataFrame, path: str) -> None:
    """The rows of ``scored_csv_rows`` as files of lines, each under a header, written where the rows are."""
    names, rows = ",".join(CSV_COLUMNS), scored_csv_rows(df)
    quoted = [F.when(F.col(c).rlike('[",\\n]') & (F.lit(c) != "company"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c)) for c in CSV_COLUMNS]
    # one column named as the header, whose text is a finished line: nothing is quoted again
    line = rows.select(F.concat_ws(",", *quoted).alias(names))
    line.write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\u0001").option("emptyValue", "").csv(path)


def scored_json_rows(df: DataFrame) -> DataFrame:
    return df.select("report_id", "company", "country", "sector", "industry", "year", "report_key", "score", "band", F.struct("completeness", "consistency", "assurance", "transparency").alias("subscores"))


def export_scored_json(df: DataFrame, path: str) -> None:
    scored_json_rows(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_run_log(df: DataFrame, path: str) -> None:
    """``t, report_id, report_key, ok, score, error`` rows appended as JSON lines."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def summary_lookup_rows(summary: DataFrame, index: DataFrame) -> DataFrame:
    """``report_id, report_key, pillar_share, top_issues``, reports of the index only."""
    share = F.map_from_arrays(F.array(F.lit("E"), F.lit("S"), F.lit("G")), F.array("share_e", "share_s", "share_g"))
    return summary.join(index.select("k", F.col("id").alias("report_id")), "k").select("report_id", F.col("k").alias("report_key"), share.alias("pillar_share"), "top_issues")


def export_summary_lookup(summary: DataFrame, index: DataFrame, path: str) -> None:
    summary_lookup_rows(summary, index).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def stream_upload_records(spark: SparkSession, folder: str) -> DataFrame:
    """Upload records as their files arrive."""
    raw = spark.readStream.schema(UPLOAD_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder)
    return _projected(raw)
