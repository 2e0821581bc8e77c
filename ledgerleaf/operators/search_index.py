"""A stored index of trigrams for the catalogue's search: the same rows as the scan of ``catalog.search_reports``, without reading them all.

A folded text holds only letters a to z, digits and spaces, so there are at most 37 ** 3 trigrams; the table of their counts may
be broadcast, however large the catalogue is. Postings are rows, not lists, so a trigram that every report has is no group that must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions.folding import search_fold
from ledgerleaf.sources.tables import written

#: Partitions of the postings, trigrams of a word that are looked up at most, and postings of a trigram that one task joins about.
PARTS, LOOKED_UP, PER_TASK = 256, 3, 1_000_000


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def _grams(text: Column) -> Column:
    """The distinct trigrams at all places of a folded text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?=(...))"), F.lit(1)))


def _postings(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/rows").schema["id"].dataType.simpleString()
    return spark.read.schema(f"gram string, id {kind}, part int").parquet(f"{path}/postings")  # an empty table states no schema


def index_reports(df: DataFrame, path: str, fields: list[str], id_col: str = "report_id") -> None:
    """Write ``rows`` (id and folded text of the fields), ``postings`` by partitions of trigrams, and ``counts`` of the trigrams below ``path``.

    The text is padded by two spaces, so that a trigram begins at each of its places and words of one or two letters are found
    by the trigrams they begin; every row has the empty trigram too, which finds all. Ids are unique; rows without one are left out.
    """
    spark = df.sparkSession
    blob = search_fold(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in fields]))
    df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), blob.alias("blob")).write.mode("overwrite").parquet(f"{path}/rows")
    grams = F.array_append(_grams(F.concat("blob", F.lit("  "))), F.lit(""))
    rows = spark.read.parquet(f"{path}/rows").select("id", F.explode(grams).alias("gram")).withColumn("part", _part(F.col("gram")))
    # by ranges of trigram and id, so that one that all rows have is dealt over tasks
    dealt = rows.repartitionByRange("part", "gram", "id").sortWithinPartitions("part", "gram", "id")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    _postings(spark, path).groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def _looked_up(words: DataFrame, counts: DataFrame) -> DataFrame:
    """``query_id, gram, n, needed``: the trigrams of the word of each query with the least postings; ``needed`` of them a row must have.

    A word of three letters or more needs its rarest trigrams, all of them; a shorter one needs any of those it begins.
    A word that no row can hold leaves its query without trigrams.
    """
    size = F.char_length("word")
    by_query = Window.partitionBy("query_id")
    exact = words.where((size >= 3) | (size == 0)).select("query_id", "word", F.explode(F.when(size == 0, F.array(F.lit(""))).otherwise(_grams(F.col("word")))).alias("gram"))
    exact = exact.join(F.broadcast(counts), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("query_id", "word").orderBy("n", "gram"))
    exact = exact.withColumn("nth", nth).where(F.col("nth") <= LOOKED_UP)
    exact = exact.groupBy("query_id", "word").agg(F.collect_list(F.struct("gram", "n")).alias("grams"), F.min("n").alias("cost"), F.count("*").alias("needed"))
    begun = counts.where(F.col("gram") != "").select(F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("word"), "gram", "n")
    begun = begun.groupBy("word").agg(F.collect_list(F.struct("gram", "n")).alias("grams"), F.sum("n").alias("cost"))
    short = words.where((size == 1) | (size == 2)).join(F.broadcast(begun), "word", "left")
    short = short.select("query_id", "word", "grams", F.coalesce("cost", F.lit(0)).alias("cost"), F.lit(1).cast("bigint").alias("needed"))
    chosen = exact.unionByName(short).withColumn("nth", F.row_number().over(by_query.orderBy("cost", "word"))).where("nth = 1 and cost > 0")
    return chosen.select("query_id", F.inline("grams"), "needed")


def search_indexed(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """``query_id, id`` of the rows whose text holds every word of the folded ``query``, as in ``catalog.search_reports``; ``queries`` has ``query_id, query``.

    Only the partitions of the trigrams looked up are read; the rows they name are verified. A null query counts as empty, and an
    empty one finds all rows. A trigram of many postings meets its queries in parts, each in a task of its own.
    """
    asked = written(queries.select("query_id", F.split(search_fold(F.col("query")), " ").alias("words")))
    counts = spark.read.parquet(f"{path}/counts")
    looked = written(_looked_up(asked.select("query_id", F.explode(F.array_distinct("words")).alias("word")), counts))
    parts = [r["part"] for r in looked.select(_part(F.col("gram")).alias("part")).distinct().collect()]  # at most PARTS
    salts = F.ceil(F.col("n") / PER_TASK).cast("int")
    sought = looked.select("query_id", "gram", "needed", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    postings = _postings(spark, path).where(F.col("part").isin(parts))
    postings = postings.join(F.broadcast(counts), "gram").select("gram", "id", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    # the stored postings are few bytes and Spark would read them in one task; how many pairs they make is known
    pairs = looked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    postings = postings.repartition(max(1, -(-pairs // PER_TASK)), "gram", F.xxhash64("id"))
    met = sought.join(postings, ["gram", "salt"]).groupBy("query_id", "id").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    rows = met.where("n >= needed").select("query_id", "id").join(spark.read.parquet(f"{path}/rows"), "id").join(asked, "query_id")
    return rows.where(F.forall("words", lambda w: F.col("blob").contains(w))).select("query_id", "id")
