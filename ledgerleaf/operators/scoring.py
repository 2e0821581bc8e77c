"""Scores of a report from its feature vector and quantitative profile.

Each subscore is a sum of additive terms with caps, in one projection over the joined row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.functions.text import sample_head_tail
from ledgerleaf.operators.features import (
    corpus_stats,
    counted_reports,
    counted_vector,
    feature_hits,
    feature_vector,
    quantitative_profile,
)
from ledgerleaf.operators.segment import MOST_BLOCKS, assemble_corpus, evidence_blocks
from ledgerleaf.sources.tables import written

METHOD_KIND = "rules-evidence"

# Weights of the subscores, bands, and the rules that packages count.
WEIGHTS = (("completeness", 0.35), ("consistency", 0.25), ("assurance", 0.20), ("transparency", 0.20))
HIGH_FROM, MEDIUM_FROM = 75, 50
FRAMEWORKS = ["framework_esrs", "framework_csrd", "framework_gri", "framework_sasb", "framework_tcfd", "framework_issb", "framework_ifrs_s1", "framework_ifrs_s2", "framework_eu_taxonomy", "framework_tnfd", "framework_cdp", "framework_sdgs"]
CLIMATE_PACKAGE = ["scope_1", "scope_2", "scope_3", "ghg_protocol", "base_year", "emissions_numbers", "scope2_method", "scope3_categories"]
SOCIAL_PACKAGE = ["workforce", "safety", "diversity", "human_rights", "training", "employee_turnover", "health_wellbeing", "living_wage"]
GOVERNANCE_PACKAGE = ["board_oversight", "audit_committee", "sustainability_committee", "risk_management", "internal_control", "esg_remuneration", "whistleblower", "anti_corruption", "data_privacy"]
ENVIRONMENT_PACKAGE = ["energy", "water", "waste", "renewable_energy", "biodiversity", "circular_economy", "pollution"]
# Flat points of the transparency score.
TRANSPARENCY_POINTS = {
    "forward_looking": 12, "transition_plan": 3, "limitations": 10, "restatement": 5, "named_assurance_provider": 8, "methodology": 8,
    "data_quality": 2, "stakeholder_engagement": 8, "scope3_categories": 7, "reporting_period": 4, "boundary": 5, "quantitative_targets": 5,
    "target_progress": 3, "connectivity_financial": 5, "iro_analysis": 3, "materiality_matrix": 2, "esrs_datapoints": 5, "gri_content_index": 3,
}


def _any(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n) for n in names])


def _count(names: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in names])


def _steps(*cases: tuple[Column, int]) -> Column:
    """Points of the first case that holds, else none."""
    first, *rest = cases
    return reduce(lambda w, c: w.when(c[0], c[1]), rest, F.when(first[0], first[1])).otherwise(0)


def _total(*terms: Column) -> Column:
    return F.least(F.lit(100), reduce(lambda a, b: a + b, terms))


def package_counts(vector: DataFrame) -> DataFrame:
    """Add the counts and flags that the scores share."""
    depth = F.col("framework_esrs_pages") + F.col("framework_gri_pages") + F.col("framework_tcfd_pages")
    return vector.withColumns({
        "framework_count": _count(FRAMEWORKS),
        "any_framework": _any("framework_efrag", *FRAMEWORKS),
        "framework_depth": F.least(F.lit(5), F.floor(depth / 3).cast("int")),
        "climate_count": _count(CLIMATE_PACKAGE),
        "social_count": _count(SOCIAL_PACKAGE),
        "governance_count": _count(GOVERNANCE_PACKAGE),
        "has_governance": _any("board_oversight", "audit_committee", "sustainability_committee"),
        "has_targets": _any("targets", "net_zero", "sbti", "transition_plan"),
        "has_social": _any("workforce", "safety", "diversity"),
        "has_climate_strategy": _any("climate_scenario", "paris_agreement", "carbon_pricing"),
    })


def completeness() -> Column:
    c, n = F.col, F.col("framework_count")
    frameworks = F.least(F.lit(18), _steps((n >= 5, 14), (n >= 3, 12), (n >= 2, 10), (F.lit(True), 8)) + F.least(F.lit(4), c("framework_depth")))
    material = _any("double_materiality", "materiality_assessment")
    return _total(
        F.when(c("any_framework"), frameworks).otherwise(0),
        _steps((c("double_materiality"), 8), (material, 5)) + _steps((material & c("materiality_matrix"), 2)),
        _steps((c("governance_count") >= 5, 8), (c("governance_count") >= 3, 6), (c("has_governance"), 4)),
        _steps((c("scope_1") & c("scope_2"), 8), (c("scope_1") | c("scope_2"), 5)),
        _steps((c("scope_3") & c("scope3_categories"), 8), (c("scope_3"), 5)),
        _steps((c("emissions_numbers"), 3)),
        _steps((c("scope2_method"), 1)),
        _steps((c("emissions_intensity"), 2)),
        _steps((c("has_targets") & c("sbti"), 7), (c("has_targets"), 5)),
        _steps((c("has_climate_strategy"), 3)),
        F.least(F.lit(8), 2 * _count(ENVIRONMENT_PACKAGE)),
        _steps((c("social_count") >= 5, 10), (c("social_count") >= 3, 7), (c("has_social"), 4)),
        _steps((_any("value_chain", "supply_chain"), 2)),
        _steps((c("framework_eu_taxonomy") & (c("framework_eu_taxonomy_pages") >= 3), 4), (c("framework_eu_taxonomy"), 2)),
        _steps((c("sector_specific"), 2)),
    )


def consistency() -> Column:
    c, years = F.col, F.col("distinct_years")
    tenth = lambda name, per: F.least(F.lit(5), F.floor(c(name) / per).cast("int"))
    return _total(
        _steps((c("methodology") & c("boundary"), 18), (c("methodology"), 10), (c("boundary"), 8)),
        _steps((c("data_quality"), 2)),
        _steps((c("ghg_protocol"), 7)),
        _steps((c("base_year"), 3)),
        _steps((c("reporting_period"), 5)),
        _steps((years >= 4, 18), (years >= 3, 15), (years >= 2, 12)),
        F.least(F.lit(15), tenth("percentage_count", 10) + tenth("table_rows", 5) + tenth("kpi_numbers", 8)),
        _steps((c("restatement"), 10), (c("limitations"), 7)),
        F.least(F.lit(8), 3 * _count(["internal_control", "risk_management", "audit_committee"])),
        _steps((c("tco2e_units") | c("has_units"), 5)),
        _steps((c("data_tables") & (c("table_rows") >= 10), 4), (c("data_tables"), 2)),
        _steps((c("quantitative_targets"), 5)),
    )


def assurance() -> Column:
    c = F.col
    base = _steps(
        (c("assurance_negative") & ~c("assurance_any"), 0), (c("assurance_reasonable") & c("assurance_limited"), 90),
        (c("assurance_reasonable"), 82), (c("assurance_limited"), 60), (c("assurance_any"), 38),
    )
    bonuses = [(_any("assurance_isae", "assurance_aa1000"), 6), (c("named_assurance_provider"), 5), (c("assurance_scope"), 4), (c("assurance_any_pages") >= 5, 3)]
    return reduce(lambda s, b: F.when((s > 0) & b[0], F.least(F.lit(100), s + b[1])).otherwise(s), bonuses, base)


def transparency() -> Column:
    return _total(*[_steps((F.col(k), n)) for k, n in TRANSPARENCY_POINTS.items()])


def overall_score() -> Column:
    """Weighted subscores, rounded half up; the terms keep their order, so doubles agree."""
    return F.floor(reduce(lambda a, b: a + b, [F.lit(w) * F.col(k) for k, w in WEIGHTS]) + 0.5).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "high").when(score >= MEDIUM_FROM, "medium").otherwise("low")


def recommendations() -> Column:
    """Up to six texts, in the order of the rule slots."""
    c = F.col
    slots = [
        F.when(~c("scope_3"), "Disclose Scope 3 emissions with category breakdown").when(~c("scope3_categories"), "Break down Scope 3 by upstream/downstream categories"),
        F.when(~c("double_materiality"), "Conduct and disclose double materiality assessment"),
        F.when(~c("assurance_any"), "Obtain external assurance (limited or reasonable)").when(~c("assurance_reasonable"), "Upgrade from limited to reasonable assurance"),
        F.when(~c("quantitative_targets"), "Set quantitative targets with timelines").when(~c("target_progress"), "Report progress against quantitative targets"),
        F.when(~c("transition_plan"), "Publish a climate transition plan/roadmap"),
        F.when(~c("methodology"), "Disclose calculation methodologies for key metrics"),
        F.when(~c("boundary"), "Clarify organizational and operational boundaries"),
        F.when(~c("base_year"), "Define and disclose a base year for emissions tracking"),
        F.when(~c("forward_looking"), "Include forward-looking statements and strategic outlook"),
        F.when(c("framework_count") < 3, "Align with additional reporting frameworks (ESRS, GRI, TCFD)"),
    ]
    return F.slice(F.array_compact(F.array(*slots)), 1, 6)


def scored(vector: DataFrame) -> DataFrame:
    """Add the four subscores, ``score``, ``band`` and ``recommendations`` to rows of vector and profile."""
    rows = package_counts(vector).withColumns({
        "completeness": completeness(), "consistency": consistency(), "assurance": assurance(), "transparency": transparency(),
    })
    return rows.withColumn("score", overall_score()).withColumn("band", band(F.col("score"))).withColumn("recommendations", recommendations())


def score_blocks(blocks: DataFrame) -> DataFrame:
    """``report_id, score, band``, subscores, profile and recommendations from evidence blocks."""
    corpus = assemble_corpus(blocks)
    hits = feature_hits(blocks, corpus)
    profile = quantitative_profile(corpus).join(corpus_stats(blocks), "report_id", "left")
    vector = feature_vector(hits)
    flags = {f.name: False if isinstance(f.dataType, T.BooleanType) else 0 for f in vector.schema if f.name != "report_id"}
    return scored(profile.join(vector, "report_id", "left").fillna(flags))


def _score_whole(documents: DataFrame) -> DataFrame:
    """``score_blocks`` of all blocks of whole texts and ``corpus_sampled``; nulls where a report has no blocks."""
    # rows of a few numbers a report, written so that no plan above holds the terms of all rules and scores again
    vector = written(counted_vector(counted_reports(documents)))
    made = [*SUMMARY[1:], "recommendations"]
    rows = scored(vector).withColumns({c: F.when(F.col("blocks").isNotNull(), F.col(c)) for c in made})
    return written(rows.select(*SUMMARY, "recommendations", *PROFILE, F.when(~F.col("without_text"), False).alias("corpus_sampled")))


PROFILE = ["percentage_count", "table_rows", "kpi_numbers", "distinct_years", "numeric_density", "corpus_chars", "pages_detected", "blocks"]
SUMMARY = ["report_id", "score", "band", "completeness", "consistency", "assurance", "transparency"]


def score_reports(documents: DataFrame, max_chars: int | None = None, most_blocks: int | None = None, version: int = 1) -> DataFrame:
    """One score record a report of ``report_id, text``. A text without blocks scores 0 in the band low.

    Whole texts and all blocks are read; ``max_chars`` and ``most_blocks`` set limits as for a request (350,000 and MOST_BLOCKS).
    """
    whole, long = F.col("text"), F.length("text")
    text, cut = (whole, long < 0) if max_chars is None else (sample_head_tail(whole, max_chars), long > max_chars)
    sampled = documents.select("report_id", text.alias("text"), cut.alias("corpus_sampled"))
    if max_chars is None and most_blocks is None:
        out = _score_whole(documents)
    else:
        rows = score_blocks(written(evidence_blocks(sampled, "text", most_blocks)))
        out = sampled.select("report_id", "corpus_sampled").join(rows, "report_id", "left")
    zeros = {k: 0 for k in ("score", "completeness", "consistency", "assurance", "transparency", "blocks", "corpus_chars", "percentage_count", "table_rows", "kpi_numbers", "distinct_years")}
    out = out.fillna(zeros | {"band": "low", "numeric_density": 0.0})
    return out.select(
        *SUMMARY, "recommendations", "percentage_count", "table_rows", "kpi_numbers", "distinct_years", "numeric_density",
        "corpus_chars", "corpus_sampled", "pages_detected", "blocks", F.lit(METHOD_KIND).alias("method_kind"), F.lit(version).alias("version"),
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """The compact form of a record."""
    return scores.select("version", *SUMMARY)


_NUMBERS = ["completeness", "consistency", "assurance", "transparency"]
_LOOSE = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("score", T.StringType()), T.StructField("band", T.StringType()),
    T.StructField("report", T.StructType([T.StructField(k, T.StringType()) for k in ("id", "key", "company", "year")])),
    T.StructField("subscores", T.StructType([T.StructField(k, T.StringType()) for k in _NUMBERS])),
])


def parse_score_json(df: DataFrame, catalogue: DataFrame | None = None, json_col: str = "json") -> DataFrame:
    """``report_id, score, band, subscores``: tolerant of numbers in strings and of missing parts.

    Partial subscores become null as a whole; rows without a score, band and subscores are dropped. Company
    and year that the record lacks come from the catalogue row.
    """
    rows = df.withColumn("rec", F.from_json(json_col, _LOOSE))
    number = lambda c: c.try_cast("double")
    subs = [number(F.col(f"rec.subscores.{k}")) for k in _NUMBERS]
    full = reduce(lambda a, b: a & b, [s.isNotNull() for s in subs])
    out = rows.select(
        F.coalesce("rec.report.id", "report_id").alias("report_id"),
        number(F.col("rec.score")).alias("score"), F.col("rec.band").alias("band"),
        F.when(full, F.struct(*[s.alias(k) for s, k in zip(subs, _NUMBERS, strict=True)])).alias("subscores"),
        F.col("rec.report.company").alias("company"), F.col("rec.report.year").try_cast("int").alias("year"),
    ).where("score is not null or band is not null or subscores is not null")
    if catalogue is None:
        return out
    known = catalogue.select("report_id", F.col("company").alias("known_company"), F.col("year").alias("known_year"))
    return out.join(known, "report_id", "left").withColumns({"company": F.coalesce("company", "known_company"), "year": F.coalesce("year", "known_year")}).drop("known_company", "known_year")


def fetch_scores(ids: DataFrame, scores: DataFrame) -> DataFrame:
    """Per requested id the record's fields, ``status`` being ok, missing, or error where the JSON is broken."""
    rows = ids.join(scores, "report_id", "left")
    broken = F.col("json").isNotNull() & F.from_json("json", _LOOSE, {"mode": "PERMISSIVE"}).isNull()
    status = F.when(F.col("json").isNull(), "missing").when(broken | ~F.col("json").rlike(r"^\s*\{"), "error").otherwise("ok")
    return rows.withColumn("status", status)


def pending_scores(reports: DataFrame, scores: DataFrame, year: int | None = None, start: int = 0, limit: int | None = None, force: bool = False) -> DataFrame:
    """Reports with an id and a key, of a year if given, from ``start`` on in key order, that have no score yet."""
    rows = reports.where("report_id is not null and report_key is not null and report_key <> ''")
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if start or limit is not None:
        rows = rows.orderBy("report_key", "report_id").offset(start)
        rows = rows if limit is None else rows.limit(limit)
    return rows if force else rows.join(scores.select("report_id").distinct(), "report_id", "left_anti")


def stale_scores(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """Records of another method, or of none, are scored again where the text is there; ``migrated_from`` names the old one.

    A report without a text keeps its old record, as it gets no new one; reports of several old records are scored once, under the least of their names.
    """
    old = scores.where(~F.col("method_kind").eqNullSafe(METHOD_KIND)).groupBy("report_id").agg(F.min("method_kind").alias("migrated_from"))
    fresh = score_reports(documents.where("text is not null").join(old.select("report_id"), "report_id", "left_semi"))
    return fresh.join(old, "report_id")
