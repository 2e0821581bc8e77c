"""Corpus analytics over scored reports."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions.dimensions import DISPLAY_CATEGORIES, EVIDENCE_CATEGORIES
from ledgerleaf.functions.text import feature_label

SUBSCORES = ["completeness", "consistency", "assurance", "transparency"]
UNKNOWN = "Unknown"


def scored_rows(reports: DataFrame, scores: DataFrame) -> DataFrame:
    """Catalogue rows with a finite score."""
    finite = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")) & (F.abs(F.col("score").cast("double")) != float("inf"))
    return reports.join(scores.where(finite), "report_id")


def _bands() -> list[Column]:
    band = F.coalesce("band", F.lit("low"))
    return [F.count_if(band == "high").alias("n_high"), F.count_if(band == "medium").alias("n_medium"), F.count_if(~band.isin("high", "medium")).alias("n_low")]


def _middle() -> list[Column]:
    return [F.avg("score").alias("mean_score"), F.percentile("score", 0.5).alias("median_score")]


def _means() -> list[Column]:
    return [F.avg(c).alias(f"mean_{c}") for c in SUBSCORES]


def corpus_overview(scored: DataFrame, n_reports: DataFrame) -> DataFrame:
    """One row: coverage in %, mean, median, bands and mean subscores; ``n_reports`` is the catalogue."""
    total = n_reports.agg(F.count("*").alias("n_reports"))
    rows = scored.agg(F.count("*").alias("n_scored"), *_middle(), *_bands(), *_means())
    return rows.join(F.broadcast(total), how="cross").withColumn("coverage_pct", F.coalesce(F.floor(F.try_divide(F.col("n_scored") * 100.0, F.col("n_reports")) + 0.5), F.lit(0)))


def score_histogram(scored: DataFrame) -> DataFrame:
    """``bin, n``: ten bins of ten, empty ones too."""
    bins = scored.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    counts = scored.groupBy(F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("score") / 10))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").fillna({"n": 0})


def source_breakdown(rows: DataFrame, col: str = "origin") -> DataFrame:
    return rows.groupBy(col).agg(F.count("*").alias("n"))


def status_breakdown(rows: DataFrame, states: list[str]) -> DataFrame:
    """``status, n`` for every state, idle where a row has none."""
    names = rows.sparkSession.createDataFrame([(s,) for s in states], "status string")
    counts = rows.groupBy(F.coalesce("status", F.lit("idle")).alias("status")).agg(F.count("*").alias("n"))
    return names.join(counts, "status", "left").fillna({"n": 0})


def sector_benchmarks(scored: DataFrame) -> DataFrame:
    """Per sector, by falling mean: count, mean, median, extremes and mean subscores."""
    rows = scored.withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN)))
    out = rows.groupBy("sector").agg(F.count("*").alias("n"), *_middle(), F.min("score").alias("min_score"), F.max("score").alias("max_score"), *_means())
    return out.orderBy(F.desc("mean_score"), "sector")


def sector_bands(scored: DataFrame) -> DataFrame:
    """Mean, median and band mix per sector."""
    rows = scored.withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN)))
    return rows.groupBy("sector").agg(F.count("*").alias("n"), *_middle(), *_bands()).orderBy(F.desc("mean_score"), "sector")


def country_buckets(scored: DataFrame) -> DataFrame:
    rows = scored.withColumn("country", F.coalesce("country", F.lit(UNKNOWN)))
    return rows.groupBy("country").agg(F.count("*").alias("n"), *_middle()).orderBy(F.desc("mean_score"), "country")


def year_trends(scored: DataFrame) -> DataFrame:
    return scored.groupBy("year").agg(F.count("*").alias("n"), *_middle(), *_bands()).orderBy("year")


def year_deltas(trends: DataFrame) -> DataFrame:
    """Add ``delta``: the mean less that of the year listed before."""
    return trends.withColumn("delta", F.col("mean_score") - F.lag("mean_score").over(Window.orderBy("year")))


def feature_coverage(hits: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Per feature: hits, hit rate in %, occurrences and pages per hit; ``n_rows`` are the detailed rows."""
    total = n_rows.agg(F.count("*").alias("n_rows"))
    rows = hits.where("found").groupBy("feature_key").agg(F.count("*").alias("hits"), F.sum("occurrences").alias("occurrences"), F.sum("pages").alias("pages"))
    rows = rows.join(F.broadcast(total), how="cross")
    return rows.select(
        "feature_key", "hits", F.floor(F.try_divide(F.col("hits") * 100.0, F.col("n_rows")) + 0.5).alias("hit_rate_pct"),
        F.try_divide("occurrences", "hits").alias("occurrences_per_hit"), F.try_divide("pages", "hits").alias("pages_per_hit"),
    ).orderBy(F.desc("hits"), "feature_key")


def top_performers(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("score"), "report_id").limit(n)


def bottom_performers(scored: DataFrame, n: int = 10) -> DataFrame:
    return scored.orderBy("score", "report_id").limit(n)


def subscore_correlations(scored: DataFrame) -> DataFrame:
    """``pair, r``: Pearson's r of the six pairs; none under three rows, 0 where a variance is 0."""
    pairs = [(a, b) for i, a in enumerate(SUBSCORES) for b in SUBSCORES[i + 1 :]]
    r = lambda a, b: F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))
    row = scored.agg(F.count("*").alias("n"), *[r(a, b).alias(f"{a}~{b}") for a, b in pairs]).where("n >= 3")
    return row.select(F.inline(F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(f"`{a}~{b}`").alias("r")) for a, b in pairs])))


def summary_cards(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n"), F.count("completeness").alias("n_detail"), F.stddev_pop("score").alias("score_sd"),
        F.count_distinct("sector").alias("sectors"), F.count_distinct("country").alias("countries"), F.count_distinct("year").alias("years"),
    )


def rule_depth_rows(hits: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per report and feature: label, found, occurrences, pages and quotes, of features with any."""
    counts = quotes.groupBy("report_id", "feature_key").agg(F.count("*").alias("quotes"))
    rows = hits.join(counts, ["report_id", "feature_key"], "full_outer").fillna({"found": False, "occurrences": 0, "pages": 0, "quotes": 0})
    rows = rows.where("found or occurrences > 0 or pages > 0 or quotes > 0").withColumn("label", feature_label(F.col("feature_key")))
    return rows.orderBy("report_id", F.desc("found"), F.desc("occurrences"), F.desc("pages"), F.desc("quotes"), "label")


def provenance_rows(hits: DataFrame, quotes: DataFrame, most: int = 6) -> DataFrame:
    """Per report and feature up to six quotes, with occurrences and pages that fall back on the quotes."""
    texts = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda q: q["text"]), 1, most)
    kept = quotes.groupBy("report_id", "feature_key").agg(texts.alias("quotes"), F.count("*").alias("quote_count"), F.count_distinct("page").alias("quote_pages"))
    rows = hits.join(kept, ["report_id", "feature_key"], "full_outer")
    rows = rows.withColumns({
        "found": F.coalesce("found", F.col("quote_count") > 0), "occurrences": F.coalesce("occurrences", "quote_count"),
        "pages": F.coalesce("pages", "quote_pages"), "quotes": F.coalesce("quotes", F.array().cast("array<string>")), "quote_count": F.coalesce("quote_count", F.lit(0)),
        "label": feature_label(F.col("feature_key")),
    }).drop("quote_pages")
    return rows.orderBy("report_id", F.desc("found"), F.desc("occurrences"), F.desc("quote_count"), "label")


def category_of(table: dict[str, dict[str, str]]) -> Column:
    """``array<struct<category, position, label>>`` of a feature's entries in a table of categories."""
    entries = [F.when(F.col("feature_key") == k, F.struct(F.lit(c).alias("category"), F.lit(i).alias("position"), F.lit(label).alias("label"))) for i, (c, rules) in enumerate(table.items()) for k, label in rules.items()]
    return F.array_compact(F.array(*entries))


def depth_tier(pages: Column) -> Column:
    return F.when(pages >= 5, "deep").when(pages >= 3, "medium").when(pages >= 1, "light").otherwise("none")


def category_coverage(hits: DataFrame) -> DataFrame:
    """Per report and display category: found of total rules in %, and how many are deep, medium and light."""
    sizes = F.create_map(*[x for c, r in DISPLAY_CATEGORIES.items() for x in (F.lit(c), F.lit(len(r)))])
    rows = hits.where("found").select("report_id", "pages", F.inline(category_of(DISPLAY_CATEGORIES)))
    tiers = [F.count_if(depth_tier(F.col("pages")) == t).alias(t) for t in ("deep", "medium", "light")]
    out = rows.groupBy("report_id", "category", "position").agg(F.count("*").alias("found"), *tiers).withColumn("total", F.element_at(sizes, F.col("category")))
    return out.withColumn("coverage_pct", F.floor(F.col("found") * 100.0 / F.col("total") + 0.5))


def evidence_by_category(quotes: DataFrame, most: int = 3) -> DataFrame:
    """Per report, category and rule up to three quotes, in category order."""
    rows = quotes.where(F.col("rank") <= most).select("report_id", "feature_key", "rank", "text", F.inline(category_of(EVIDENCE_CATEGORIES)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda q: q["text"])
    return rows.groupBy("report_id", "position", "category", "feature_key", "label").agg(texts.alias("quotes"))
