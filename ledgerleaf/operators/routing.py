"""Chunk classification around an injected scorer: routing, issue totals, report profiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerleaf.functions.blocks import slices
from ledgerleaf.functions.dimensions import CATEGORY_TO_PILLAR, ISSUE_TO_PILLAR
from ledgerleaf.functions.text import truncate_for_classifier
from ledgerleaf.sources.tables import written

ROUTE_FROM_ENTITIES, ROUTE_FROM_EVIDENCE = 0.3, 0.25
SCORES = "array<struct<label:string,score:double>>"


def lookup(table: dict[str, str | None], key: Column) -> Column:
    """A value of a small fixed table as a map literal; null where there is none."""
    pairs = [F.lit(x) for k, v in table.items() if v is not None for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), key)


def classify_chunks(chunks: DataFrame, scorer: Callable[[list[str]], list[list[tuple[str, float]]]], batch: int = 16) -> DataFrame:
    """Add ``scores``: the scorer's labels for each text, cut for it; null, with the reason in ``failure``, where the scorer fails on a batch.

    The scorer is called on the executors with up to ``batch`` texts at a time; a null text is scored as an empty one.
    """
    rows = chunks.withColumn("text", truncate_for_classifier(F.col("text")))
    at = rows.columns.index("text")
    scored, kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())])), T.StructType.fromDDL(f"scores {SCORES}, failure string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, at)):
            # only a slice's texts and scores are Python objects at a time
            made: list = []
            reasons: list = []
            for start in range(0, part.num_rows, batch):
                texts = ["" if t is None else t for t in part.column(at).slice(start, batch).to_pylist()]
                try:
                    made += [[{"label": k, "score": float(v)} for k, v in row] for row in scorer(texts)]
                    reasons += [None] * len(texts)
                except Exception as e:  # noqa: BLE001  any failure of the model leaves the batch without scores
                    made += [None] * len(texts)
                    reasons += [f"{type(e).__name__}: {e}"] * len(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, scored), pa.array(reasons, pa.string())], names=[*part.schema.names, "scores", "failure"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, *kind]))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def argmax(scores: Column) -> Column:
    """The struct of the highest score; the first in order on ties."""
    start = F.struct(F.lit("Non-ESG").alias("label"), F.lit(0.0).alias("score"))
    return F.aggregate(scores, start, lambda best, s: F.when(s["score"] > best["score"], F.struct(s["label"].alias("label"), s["score"].alias("score"))).otherwise(best))


def route_chunks(preds: DataFrame, min_score: float = ROUTE_FROM_ENTITIES) -> DataFrame:
    """Add ``category, pillar, score, is_esg``: a weak or Non-ESG best label isn't routed; a missing prediction is, as Unknown."""
    rows = preds.withColumn("best", argmax(F.col("scores")))
    weak = (F.col("best.label") == "Non-ESG") | (F.col("best.score") < min_score)
    missing = F.col("scores").isNull()
    return rows.withColumns({
        "category": F.when(missing, "Unknown").when(weak, "Non-ESG").otherwise(F.col("best.label")),
        "pillar": F.when(~missing & ~weak, lookup(CATEGORY_TO_PILLAR, F.col("best.label"))),
        "score": F.when(missing, 0.0).otherwise(F.col("best.score")),
        "is_esg": missing | ~weak,
    }).drop("best")


def routing_summary(routed: DataFrame) -> DataFrame:
    """Per report: chunks in all, routed, skipped, by pillar, by category, and the percentage skipped."""
    pillars = [F.count_if(F.col("is_esg") & (F.col("pillar") == p)).alias(f"pillar_{p.lower()}") for p in "ESG"]
    totals = routed.groupBy("report_id").agg(F.count("*").alias("total_chunks"), F.count_if("is_esg").alias("routed_chunks"), *pillars)
    by = routed.where("is_esg").groupBy("report_id", "category").agg(F.count("*").alias("n"))
    maps = by.groupBy("report_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    rows = totals.join(maps, "report_id", "left").withColumn("skipped_chunks", F.col("total_chunks") - F.col("routed_chunks"))
    return rows.withColumn("skipped_pct", F.floor(F.col("skipped_chunks") / F.col("total_chunks") * 100 + 0.5).cast("int"))


def issue_totals(preds: DataFrame) -> DataFrame:
    """``k, issue, score_sum`` over chunk predictions ``k, issue, score``."""
    return preds.groupBy("k", "issue").agg(F.sum("score").alias("score_sum"))


def pillar_totals(preds: DataFrame) -> DataFrame:
    """``k, pillar, score_sum``; issues without a pillar are left out."""
    rows = preds.withColumn("pillar", lookup(ISSUE_TO_PILLAR, F.col("issue"))).where("pillar is not null")
    return rows.groupBy("k", "pillar").agg(F.sum("score").alias("score_sum"))


def pillar_shares(totals: DataFrame) -> DataFrame:
    """``k, share_e, share_s, share_g`` of pillar totals; null for all where their sum is 0."""
    whole = F.sum("score_sum")
    share = lambda p: F.try_divide(F.coalesce(F.sum(F.when(F.col("pillar") == p, F.col("score_sum"))), F.lit(0.0)), F.when(whole > 0, whole))
    return totals.groupBy("k").agg(*[share(p).alias(f"share_{p.lower()}") for p in "ESG"])


def top_issues(totals: DataFrame, n: int) -> DataFrame:
    """``k, rank, issue, score, pillar``: the ``n`` highest issues of a report, ties by name."""
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score_sum"), "issue"))
    return totals.withColumn("rank", rank).where(F.col("rank") <= n).select("k", "rank", "issue", F.col("score_sum").alias("score"), lookup(ISSUE_TO_PILLAR, F.col("issue")).alias("pillar"))


def report_issue_summary(issues: DataFrame, pillars: DataFrame, index: DataFrame, n: int = 5) -> DataFrame:
    """Per report its pillar shares, top issues and metadata; reports not in the index stay, without metadata."""
    top = top_issues(issues, n).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "issue", "score", "pillar"))), lambda x: F.struct(x["issue"].alias("issue"), x["score"].alias("score"), x["pillar"].alias("pillar"))).alias("top_issues"))
    return top.join(pillar_shares(pillars), "k", "left").join(index, "k", "left")


def export_issue_summary(issues: DataFrame, index: DataFrame, n: int = 7) -> DataFrame:
    """As above with shares from the current mapping, 0 where there are none, only reports of the index."""
    pillars = issues.withColumn("pillar", lookup(ISSUE_TO_PILLAR, F.col("issue"))).where("pillar is not null").groupBy("k", "pillar").agg(F.sum("score_sum").alias("score_sum"))
    rows = report_issue_summary(issues, pillars, index.withColumn("known", F.lit(True)), n).where("known").drop("known")
    return rows.fillna({"share_e": 0.0, "share_s": 0.0, "share_g": 0.0})


def pseudo_label_split(preds: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """E, S and G rows with ``label_id`` and ``split``: all rows of a report fall into one part, ``ceil(ratio * n)`` reports (one at least) into eval."""
    rows = preds.where(F.col("pillar").isin("E", "S", "G")).withColumn("label_id", F.array_position(F.array(*map(F.lit, "ESG")), F.col("pillar")).cast("int") - 1)
    # the reports of the least hashes: whole buckets of hashes, and of the bucket at the cut the first in order
    reports = written(rows.select("k").distinct().withColumn("h", F.xxhash64("k", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("h", 48), F.lit(1 << 16))))
    sizes = reports.groupBy("bucket").agg(F.count("*").alias("n"))  # 65,536 rows at most
    n_eval = max(1, math.ceil(reports.count() * ratio))
    upto = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "k"))
    split = reports.withColumn("nth", within).join(upto, "bucket").select("k", F.when(F.col("before") + F.col("nth") <= n_eval, "eval").otherwise("train").alias("split"))
    return rows.join(split, "k")


def classification_metrics(df: DataFrame, classes: int = 3) -> DataFrame:
    """``accuracy, macro_f1`` of ``label_id`` against ``pred_id``; 0 where a denominator is 0."""
    n = lambda cond: F.count_if(cond)
    f1 = []
    for c in range(classes):
        tp = n((F.col("label_id") == c) & (F.col("pred_id") == c))
        fp = n((F.col("label_id") != c) & (F.col("pred_id") == c))
        fn = n((F.col("label_id") == c) & (F.col("pred_id") != c))
        precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
        recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
        f1.append(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    hits = F.coalesce(F.try_divide(n(F.col("label_id") == F.col("pred_id")), F.count("*")), F.lit(0.0))
    return df.agg(hits.alias("accuracy"), (reduce(lambda a, b: a + b, f1) / classes).alias("macro_f1"))


def page_profile(pages: DataFrame) -> DataFrame:
    """Pages and characters per report, company and year."""
    return pages.groupBy("report_id", "company", "year").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def dimension(spark: SparkSession, table: dict[str, str | None], key: str, value: str) -> DataFrame:
    """A fixed table as a DataFrame."""
    return spark.createDataFrame(list(table.items()), f"{key} string, {value} string")
