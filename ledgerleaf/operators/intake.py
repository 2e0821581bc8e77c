"""Intake: is an upload a report of this kind, on which pages, and is it new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions.blocks import rows_with_hits
from ledgerleaf.functions.rules import once
from ledgerleaf.functions.text import collapse_whitespace
from ledgerleaf.sources.tables import written

# Signs of a sustainability report with their weights, and of a financial one.
POSITIVE = {
    "sustainability": (r"\bsustainab(?:ility|le)\b", 5), "esg": (r"\besg\b", 4), "csrd_esrs": (r"\b(?:csrd|esrs|efrag)\b", 4),
    "gri_tcfd_issb": (r"\b(?:gri|tcfd|issb|ifrs\s*s[12])\b", 3), "taxonomy": (r"\b(?:eu\s+taxonomy|taxonomy[-\s]+aligned|taxonomy[-\s]+eligible)\b", 3),
    "materiality": (r"\b(?:double\s+materiality|materiality|iro)\b", 3), "ghg": (r"\b(?:scope\s*[123]|ghg|co2e?|tco2e?|emissions?)\b", 3),
    "climate": (r"\b(?:climate|net[\s-]*zero|decarboni[sz]ation|sbti)\b", 3), "environment": (r"\b(?:energy|renewable|water|waste|biodiversity|circular)\b", 2),
    "social_governance": (r"\b(?:human\s+rights|diversity|workforce|safety|anti[\s-]*corruption|governance)\b", 2),
    "assurance": (r"\b(?:limited\s+assurance|reasonable\s+assurance|isae\s*3000|independent\s+assurance)\b", 3),
}
NEGATIVE = (
    (r"\bconsolidated\s+financial\s+statements?\b", 5), (r"\bnotes?\s+to\s+the\s+consolidated\s+financial\s+statements?\b", 4),
    (r"\b(?:income\s+statement|statement\s+of\s+profit|balance\s+sheet|cash\s+flow\s+statement)\b", 3),
    (r"\b(?:earnings\s+per\s+share|dividend|share\s+capital|ifrs\s+accounts?)\b", 2),
)
# What a page counts at most for one sign, the characters of a page that are read, limits of an upload.
POSITIVE_CAP, NEGATIVE_CAP, PAGE_CHARS = 20, 15, 12_000
MOST_BYTES, LEAST_BYTES, LEAST_TEXT = 80 * 1024 * 1024, 1024, 300
#: Range partitions for numbering: rows per partition, about.
SORT_ROWS = 50_000
#: Parts of a hot hash, or year and company, whose least keys are found apart.
SALTS = 64


def score_pages(pages: DataFrame, page_chars: int | None = None) -> DataFrame:
    """``report_id, page, score, positive, negative, is_candidate, hit_keys, snippet`` of each page; of its first ``page_chars`` characters, if given (a request reads PAGE_CHARS)."""
    lower = F.lower("text" if page_chars is None else F.substring("text", 1, page_chars))
    signs = [*((k, p, POSITIVE_CAP, w, 0) for k, (p, w) in POSITIVE.items()), *((f"_negative_{i}", p, NEGATIVE_CAP, 0, w) for i, (p, w) in enumerate(NEGATIVE))]
    rows = pages.select("report_id", "page", lower.alias("head"), F.substring(collapse_whitespace(F.col("text")), 1, 420).alias("snippet"))
    rows = rows_with_hits(rows, {k: (p, True) for k, p, *_ in signs}, "head", all_rows=True).drop("head")
    of_key = F.create_map(*[x for k, _, cap, w, v in signs for x in (F.lit(k), F.struct(F.lit(cap).alias("cap"), F.lit(w).alias("w"), F.lit(v).alias("v")))])
    points = lambda side: F.aggregate("hits", F.lit(0), lambda a, h: a + F.least(h["n"], of_key[h["part"]]["cap"]) * of_key[h["part"]][side])
    rows = once(rows, {"positive": points("w"), "negative": points("v")}).withColumn("score", F.col("positive") - F.col("negative"))
    keys = F.transform(F.filter("hits", lambda h: ~h["part"].startswith("_")), lambda h: h["part"])
    return rows.select(
        "report_id", "page", "score", "positive", "negative", ((F.col("score") >= 8) | (F.col("positive") >= 12)).alias("is_candidate"),
        keys.alias("hit_keys"), "snippet",
    )


def candidate_spans(scores: DataFrame) -> DataFrame:
    """``report_id, start, end, pages, score, rank``: runs of candidate pages with gaps of one page at most."""
    w = Window.partitionBy("report_id").orderBy("page")
    rows = scores.where("is_candidate").withColumn("gap", (F.col("page") > F.lag("page").over(w) + 2).cast("int"))
    rows = rows.withColumn("span", F.sum(F.coalesce("gap", F.lit(0))).over(w))
    spans = rows.groupBy("report_id", "span").agg(F.min("page").alias("start"), F.max("page").alias("end"), F.count("*").alias("pages"), F.sum("score").alias("score"))
    return spans.select("report_id", "start", "end", "pages", "score", (F.col("score") + 2 * F.col("pages")).alias("rank"))


def primary_span(spans: DataFrame) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("rank"), "start"))
    return spans.withColumn("nth", best).where("nth = 1").drop("nth")


def intake_verdict(scores: DataFrame, spans: DataFrame) -> DataFrame:
    """Totals of a report, the heuristic's verdict, and whether the report is of this kind throughout."""
    totals = scores.groupBy("report_id").agg(
        F.count("*").alias("total_pages"), F.sum("positive").alias("total_positive"), F.sum("negative").alias("total_negative"),
        F.count_if("is_candidate").alias("candidate_pages"), F.size(F.array_distinct(F.flatten(F.collect_set("hit_keys")))).alias("hit_breadth"),
    )
    first = primary_span(spans).select("report_id", "start", "end", F.col("pages").alias("span_pages"))
    rows = totals.join(first, "report_id", "left").withColumn("raw_score", F.col("total_positive") - F.col("total_negative"))
    pages = F.greatest(F.lit(1), F.col("total_pages"))
    enough = F.greatest(F.lit(3), F.floor(F.col("total_pages") * 0.06))
    return rows.withColumns({
        "is_sustainability": (F.col("raw_score") >= 80) & (F.col("hit_breadth") >= 5) & (F.col("candidate_pages") >= enough),
        "is_only": F.coalesce((F.col("span_pages") / pages >= 0.72) & (F.col("candidate_pages") / pages >= 0.6), F.lit(False)),
    })


def _ranks(scores: DataFrame) -> DataFrame:
    by = Window.partitionBy("report_id")
    return scores.withColumns({
        "from_start": F.row_number().over(by.orderBy("page")), "from_end": F.row_number().over(by.orderBy(F.desc("page"))),
        "by_score": F.row_number().over(by.orderBy(F.desc("score"), "page")),
    })


def review_pages(scores: DataFrame) -> DataFrame:
    """The first five pages, the eighteen of the highest scores and the last three, each once."""
    return _ranks(scores).where("from_start <= 5 or by_score <= 18 or from_end <= 3").drop("from_start", "from_end", "by_score")


def metadata_snippets(pages: DataFrame, scores: DataFrame, chars: int = 450) -> DataFrame:
    """``report_id, page, snippet``: the first eight pages, then the eight best that are not among them."""
    nth = F.row_number().over(Window.partitionBy("report_id").orderBy("page"))
    first = pages.withColumn("nth", nth).where("nth <= 8").select("report_id", "page", F.substring(collapse_whitespace(F.col("text")), 1, chars).alias("snippet")).where("snippet <> ''")
    best = _ranks(scores).where("by_score <= 8").select("report_id", "page", F.substring("snippet", 1, chars).alias("snippet")).where("snippet <> ''")
    return first.unionByName(best.join(first.select("report_id", "page"), ["report_id", "page"], "left_anti"))


def combine_verdict(heuristic: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``accepted``, ``range_start``, ``range_end`` and ``full_upload``.

    ``model``: ``report_id, model_yes, confidence, model_start, model_end, model_only``. The heuristic's yes
    is enough; else the model's, unless its confidence is under 0.55. The range is the model's where both ends
    lie in the document, else the span, else the whole.
    """
    rows = heuristic.join(model, "report_id", "left")
    inside = lambda c: F.when(F.col(c).between(1, F.col("total_pages")), F.col(c))
    start, end = F.coalesce(inside("model_start"), "start", F.lit(1)), F.coalesce(inside("model_end"), "end", "total_pages")
    accepted = F.col("is_sustainability") | (F.coalesce("model_yes", F.lit(False)) & (F.col("confidence").isNull() | (F.col("confidence") >= 0.55)))
    return rows.withColumns({
        "accepted": accepted, "range_start": F.least(start, end), "range_end": F.greatest(start, end),
        "full_upload": ~(F.col("is_only") | F.coalesce("model_only", F.lit(False))),
    })


def decide_range(staged: DataFrame, options: DataFrame) -> DataFrame:
    """Add the pages to keep: the user's range over the suggested one, extracted only from a full report and if short enough."""
    rows = staged.join(options, "token", "left")
    start, end = F.coalesce("user_start", "suggested_start", F.lit(1)), F.coalesce("user_end", "suggested_end", "total_pages")
    rows = rows.withColumns({"page_start": F.least(start, end), "page_end": F.greatest(start, end)})
    short = F.col("page_end") - F.col("page_start") + 1 < F.floor(F.col("total_pages") * 0.92)
    return rows.withColumn("extract", F.coalesce("full_upload", F.lit(False)) & short)


def validate_uploads(files: DataFrame, most_pages: int = 600) -> DataFrame:
    """Add ``rejected``: the first reason, null if there is none."""
    lower = F.lower(F.coalesce("name", F.lit("")))
    reason = (
        F.when(~lower.endswith(".pdf"), "extension")
        .when(~F.coalesce("content_type", F.lit("")).isin("application/pdf", "application/x-pdf", "application/octet-stream", ""), "type")
        .when(F.coalesce("size", F.lit(0)) < LEAST_BYTES, "too_small")
        .when(F.col("size") > MOST_BYTES, "too_large")
        .when(~F.coalesce("has_signature", F.lit(False)), "signature")
        .when(F.coalesce("page_count", F.lit(0)) > most_pages, "too_many_pages")
        .when(F.coalesce("text_chars", F.lit(0)) < LEAST_TEXT, "too_little_text")
    )
    return files.withColumn("rejected", reason)


def _least_keys(existing: DataFrame, by: list[str], name: str, n: int = 3) -> DataFrame:
    """One row a value of ``by`` with its ``n`` least report keys: each task drops all but ``n`` of a value before they are shuffled, and salts meet in a second step."""
    rows = existing.dropna(subset=by).select(*by, "report_key").distinct().withColumn("salt", F.pmod(F.xxhash64("report_key"), F.lit(SALTS)))
    for keys in ([*by, "salt"], by):
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("report_key"))).where(F.col("nth") <= n)
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("report_key")).alias(name))


def find_duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Add to ``new`` (``upload_id, sha256, year, company_slug``) ``same_hash``, ``same_company_year`` and up to three example keys.

    Null and empty hashes and slugs and null years match nothing. An upload meets one row a side, the three least keys of its hash and of its year and
    company, as no more are needed for the examples; ``examples`` is null without any. Rows that repeat an upload repeat its answer.
    """
    blank = lambda df, *names: df.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in names})
    existing = blank(existing.where("report_key is not null"), "sha256", "company_slug")
    by_hash = _least_keys(existing, ["sha256"], "_by_hash").withColumnRenamed("sha256", "_hash")
    by_name = _least_keys(existing, ["year", "company_slug"], "_by_name").withColumnsRenamed({"year": "_year", "company_slug": "_slug"})
    met = new.join(by_hash, F.col("sha256") == F.col("_hash"), "left").join(by_name, (F.col("year") == F.col("_year")) & (F.col("company_slug") == F.col("_slug")), "left")
    none = F.array().cast("array<string>")
    both = F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce("_by_hash", none), F.coalesce("_by_name", none)))), 1, 3)
    return met.select(*[new[c] for c in new.columns], F.col("_by_hash").isNotNull().alias("same_hash"), F.col("_by_name").isNotNull().alias("same_company_year"), F.when(F.size(both) > 0, both).alias("examples"))


def accepted_uploads(new: DataFrame, existing: DataFrame) -> DataFrame:
    found = find_duplicates(new, existing)
    return new.join(found.where("same_hash or same_company_year").select("upload_id"), "upload_id", "left_anti")


def allocate_report_ids(new: DataFrame, existing: DataFrame, floor: int = 10_000, order: str = "upload_id") -> DataFrame:
    """Add ``report_id``: the next numbers above ``floor - 1`` and all existing non-legacy ids, in upload order.

    The batch is dealt by ranges of ``order``, counted per range and numbered from the range's offset.
    """
    number = F.regexp_extract("report_id", r"^report-(\d+)$", 1).try_cast("bigint")
    top = existing.select(F.greatest(F.lit(floor - 1), F.coalesce(F.max(F.when(number < 1_000_000, number)), F.lit(0))).alias("top"))
    ordered = new.repartitionByRange(max(1, new.count() // SORT_ROWS), order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    held = written(ordered.withColumn("_part", F.shiftright("_at", 33)))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = held.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    nth = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = held.join(F.broadcast(offsets), "_part").join(F.broadcast(top), how="cross")
    return rows.withColumn("report_id", F.concat(F.lit("report-"), (F.col("top") + nth).cast("string"))).select(*new.columns, "report_id")


def purge_reports(ids: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the ids, and ``table, removed`` counts. ``tables``: name to (frame, its id column)."""
    left, counts = {}, []
    for name, (df, col) in tables.items():
        gone = ids.select(F.col("report_id").alias(col)).distinct()
        left[name] = df.join(gone, col, "left_anti")
        counts.append(df.join(gone, col, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("removed")))
    return left, reduce(DataFrame.unionByName, counts)


