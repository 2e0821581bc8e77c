"""A corpus pipeline of five ``llm`` operators: rate, drop near copies, redact, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import bpe, minhash, mixing, ordinal, pii
from ledgerleaf.llm.common import saved
from ledgerleaf.llm.queries import PATTERN, RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is high enough; texts without a word go."""
    model = ordinal.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return ordinal.rate(docs.select(row, "text"), model, ["row"]).where("kept").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 80 % or more.

    One row of each id stays. Rows without an id go by their text, with ids above all others, so that they are near copies too.
    Null and empty texts are near copies of nothing: they stay wherever they have an id. Columns of any name keep their values; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    of_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), of_text).alias("id"), row)
    found = minhash.near_duplicates(keyed.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), 5, 80)
    ids = saved(found.groupBy(F.col("doc_id").alias("id")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    single = keyed.join(ids.select("id"), "id", "left_anti").select("row.*")
    repeated = keyed.join(ids.where("kept").select("id"), "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row.*")
    return single.unionByName(repeated)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; all rows stay, repeated ones too. A null text stays null; an empty table stays empty."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them.

    Null texts and texts without a word weigh nothing and are not taken; a null source is a source; repeated rows are drawn one by one;
    an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every row, as digests, and of the bytes decoded from them; a null text counts as empty, repeated rows stay."""
    return bpe.digests(docs, RANKS, PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", one_of_each_group),
    ("PII", redacted),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE", tokens),
]

#: The stages' models and searches can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
