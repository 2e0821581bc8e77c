"""Vector retrieval within a report's namespace, with an injected embedder."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerleaf.functions.blocks import slices
from ledgerleaf.functions.text import fnv1a, trim_space
from ledgerleaf.operators.segment import char_chunks
from ledgerleaf.sources.tables import written

TEXT_CHARS, CONTEXT_CHARS = 1500, 18_000


def vector_records(pages: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 24) -> DataFrame:
    """``id, namespace, values, page, chunk, text`` of ``report_id, page, text``; pages without a number get ``md`` ids.

    Empty vectors are dropped; the embedder is called on the executors with up to ``batch`` texts at a time.
    """
    rows = pages.select(F.col("report_id").cast("string").alias("namespace"), "page", F.posexplode(char_chunks(F.col("text"))).alias("chunk", "text"))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, at)):
            # only a slice's texts and vectors are Python objects at a time
            texts = part.column(at).to_pylist()
            made: list = []
            for start in range(0, len(texts), batch):
                made += embedder([t[:TEXT_CHARS] for t in texts[start : start + batch]])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fnv1a(texts), pa.string()), pa.array(made, pa.list_(pa.float32()))], names=[*part.schema.names, "hash", "values"])

    made = rows.mapInArrow(run, T.StructType([*rows.schema, *T.StructType.fromDDL("hash string, values array<float>")])).where(F.size("values") > 0)
    middle = F.when(F.col("page").isNotNull(), F.col("page").cast("string")).otherwise(F.concat(F.lit("md:"), F.col("chunk").cast("string")))
    return made.select(F.concat_ws(":", "namespace", middle, "hash").alias("id"), "namespace", "values", "page", "chunk", F.substring("text", 1, TEXT_CHARS).alias("text"))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """New records replace old ones of their id; of several new ones the last chunk's stays."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("chunk")))
    fresh = new.withColumn("nth", last).where("nth = 1").drop("nth")
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


#: Pivots of a namespace at most, how far rounding may move a bound, queries of a block about, and numbers of a matrix in a task at most.
PIVOTS, SLACK, QUERIES, MATRIX = 64, 1e-5, 4096, 4_000_000


def _unit(c: str) -> Column:
    """The vector over its length; null where it has none that is a finite number above zero."""
    size = F.sqrt(dot(F.col(c), F.col(c)))
    each = F.zip_with(F.col(c), F.array_repeat(size, F.size(c)), lambda x, n: x.cast("double") / n)  # the length once a row, not once a number
    return F.when((size > 0) & (size < float("inf")), each)


def _cells(v: DataFrame, per_task: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors with the cell of their nearest pivot, the cells with their least and greatest angle to it, and the pivots of each namespace."""
    sizes = v.groupBy("namespace").agg(F.least(F.lit(PIVOTS), F.ceil(F.sqrt(F.count("*")))).cast("int").alias("n_pivots"))
    nth = F.row_number().over(Window.partitionBy("namespace").orderBy(F.xxhash64("id"), "id"))
    few = v.withColumn("nth", nth).where(F.col("nth") <= PIVOTS).join(sizes, "namespace").where("nth <= n_pivots")
    pivots = written(few.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct(F.col("nth").alias("cell"), F.col("u").alias("p")))).alias("pivots")))
    nearest = F.array_max(F.transform("pivots", lambda p: F.struct(F.round(dot(p["p"], F.col("u")), 12).alias("near"), p["cell"].alias("cell"))))
    placed = v.join(pivots, "namespace").withColumn("at", nearest).select("namespace", "id", "u", F.col("at.cell").alias("cell"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("at.near")))).alias("angle"))
    placed = written(placed)
    cells = placed.groupBy("namespace", "cell").agg(F.min("angle").alias("inner"), F.max("angle").alias("outer"), F.count("*").alias("n"))
    return placed, written(cells.withColumn("salts", F.ceil(F.col("n") / per_task).cast("int"))), pivots


def _ranked(pairs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    order = [F.desc_nulls_last("similarity"), "id"]
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _best(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of the held vectors for each query, ties by id, by matrix products; none below a query's ``floor``."""
    if asked.num_rows == 0 or held.num_rows == 0:
        return pa.table({"query_id": asked["query_id"].slice(0, 0), "id": held["id"].slice(0, 0), "similarity": pa.array([], pa.float64())})
    matrix = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    held = held.sort_by("id")
    q, u = matrix(asked, "q"), matrix(held, "u")
    floor = asked["floor"].to_pandas().fillna(-2.0).to_numpy(dtype=float)
    step, made = max(1, MATRIX // len(u)), []
    for at in range(0, len(q), step):
        near = np.round(q[at : at + step] @ u.T, 9)
        least = floor[at : at + step]
        if len(u) > k:
            least = np.maximum(least, -np.partition(-near, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(near >= least[:, None])
        value = near[row, col]
        order = np.lexsort((col, -value, row))
        row, col, value = row[order], col[order], value[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        made.append((row[nth < k] + at, col[nth < k], value[nth < k]))
    row, col, value = (np.concatenate(x) for x in zip(*made, strict=True))
    return pa.table({"query_id": asked["query_id"].take(pa.array(row)), "id": held["id"].take(pa.array(col)), "similarity": pa.array(value)})


def top_k_chunks(queries: DataFrame, vectors: DataFrame, k: int = 8, per_task: int = 20_000) -> DataFrame:
    """``query_id, rank, id, similarity``: the ``k`` nearest vectors of a query's namespace by cosine, ties by id.

    Vectors stand in cells around pivots. A query reads the cells nearest to it until they hold ``k`` vectors; the k-th similarity found there
    rules out every cell whose angles to its pivot can't, by the triangle inequality, hold a better one. The other cells are read whole, so nothing is missed.
    A cell meets its queries in blocks, of about ``per_task`` vectors and ``QUERIES`` queries each, by matrix products; a block gives only its ``k`` best of each query.
    Vectors and queries of no finite length have a null similarity and come last, by id. The vectors of a namespace and their queries have one number of dimensions.
    """
    v = written(vectors.select("namespace", "id", _unit("values").alias("u")))
    placed, cells, pivots = _cells(v.where("u is not null"), per_task)
    q = written(queries.select("query_id", "namespace", _unit("values").alias("q")))
    blocks = q.groupBy("namespace").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    cells = written(cells.join(blocks, "namespace"))
    # the cells of each query's namespace, by the angle to their pivots: a row a query and cell
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(dot(F.col("q"), F.col("pivot.p")), 12))))
    seen = q.where("q is not null").join(pivots, "namespace").select("query_id", "namespace", "q", F.explode("pivots").alias("pivot")).select("query_id", "namespace", F.col("pivot.cell").alias("cell"), angle.alias("theta"))
    near = Window.partitionBy("query_id", "namespace").orderBy("theta", "cell").rowsBetween(Window.unboundedPreceding, -1)
    looks = written(seen.join(cells, ["namespace", "cell"]).withColumn("first", F.coalesce(F.sum("n").over(near), F.lit(0)) < k))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["namespace", "cell", "salt", "block"]
    dealt = placed.join(cells.select("namespace", "cell", "salts", "blocks"), ["namespace", "cell"]).select("namespace", "cell", part("id", "salts").alias("salt"), every("blocks").alias("block"), "id", "u")
    kinds = {c: f.dataType.simpleString() for c, f in (("query_id", q.schema["query_id"]), ("id", v.schema["id"]))}

    def read(some: DataFrame) -> DataFrame:
        asked = some.join(q, ["query_id", "namespace"]).select("namespace", "cell", every("salts").alias("salt"), part("query_id", "blocks").alias("block"), "query_id", "q", "floor")
        met = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys))
        return met.applyInArrow(lambda a, b: _best(a, b, k), f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")

    first = written(read(looks.where("first").withColumn("floor", F.lit(None).cast("double"))))
    floor = _ranked(first, k, ["query_id"]).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("similarity")).alias("floor"))
    between = F.greatest(F.lit(0.0), F.col("theta") - F.col("outer"), F.col("inner") - F.col("theta"))
    able = F.col("floor").isNull() | (F.cos(F.least(between, F.lit(math.pi))) + SLACK >= F.col("floor"))
    second = read(looks.where(~F.col("first")).join(floor, "query_id", "left").where(able))
    # those without a similarity: the least ids of a namespace are enough
    rest = F.lit(None).cast("double").alias("similarity")
    flat = lambda rows: rows.withColumn("nth", F.row_number().over(Window.partitionBy("namespace").orderBy("id"))).where(F.col("nth") <= k).select("namespace", "id")
    blank = q.join(flat(v.where("u is null")), "namespace").where("q is not null").select("query_id", "id", rest).unionByName(q.where("q is null").join(flat(v), "namespace").select("query_id", "id", rest))
    return _ranked(first.unionByName(second).unionByName(blank), k, ["query_id"]).select("query_id", "rank", "id", "similarity")


def retrieved_context(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """``query_id, context``: the hits' texts in rank order with their page, cut with a mark."""
    rows = hits.join(vectors.select("id", "page", "text"), "id").where(trim_space(F.col("text")) != "")
    line = F.concat(F.when(F.col("page").isNotNull() & (F.col("page") != 0), F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "))).otherwise(F.lit("")), trim_space(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    joined = F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n")
    out = rows.groupBy("query_id").agg(joined.alias("context"))
    cut = F.concat(F.substring("context", 1, CONTEXT_CHARS), F.lit("\n\n[Retrieved context truncated]"))
    return out.withColumn("context", F.when(F.length("context") > CONTEXT_CHARS, cut).otherwise(F.col("context")))


def pending_index(reports: DataFrame, markers: DataFrame) -> DataFrame:
    """Reports without any marker; an error marker counts as done."""
    return reports.join(markers.select("report_id").distinct(), "report_id", "left_anti")
