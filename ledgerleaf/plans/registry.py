"""The registered queries over the driver's tables, and their SQL counterparts for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text as tx
from ledgerleaf.functions.dimensions import CATEGORY_TO_PILLAR, ISSUE_TO_PILLAR
from ledgerleaf.functions.folding import search_fold, slugify_company
from ledgerleaf.functions.rules import RULES, SCOPE3_PATTERNS
from ledgerleaf.operators import (
    analytics,
    catalog,
    conversations,
    entities,
    features,
    intake,
    retrieval,
    routing,
    scoring,
    segment,
)
from ledgerleaf.plans import corpus
from ledgerleaf.plans.corpus import (
    CATALOGUE_SQL,
    ENTITIES_SQL,
    PHRASE_PAGES_SQL,
    PREDICTIONS_SQL,
    SCORED_SQL,
    UPLOADS_SQL,
)
from ledgerleaf.sources.tables import written
from ledgerleaf.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CATALOGUE = f"WITH catalogue AS ({CATALOGUE_SQL})"
_SCORED = f"{_CATALOGUE}, scored AS ({SCORED_SQL})"
_UPLOADS = f"{_CATALOGUE}, uploads AS ({UPLOADS_SQL})"
_PAGES = f"WITH pages0 AS ({PHRASE_PAGES_SQL})"
_PREDICTIONS = f"WITH predictions AS ({PREDICTIONS_SQL})"
_ENTITIES = f"WITH entities AS ({ENTITIES_SQL})"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle if SQL can say it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Scoring and evidence over the seeded corpus


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and band mix of disclosure quality per sector."""
    scores = scoring.score_reports(corpus.seeded_reports(spark, sf_dir), None, None)
    reports = corpus.catalogue(spark, sf_dir).select("report_id", "sector", "country", "year")
    return analytics.sector_bands(analytics.scored_rows(reports, scores))


QUERIES["sector_quality"] = flagship


@query()
def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_reports(corpus.seeded_reports(spark, sf_dir), None, None).withColumn("recommendations", F.array_join("recommendations", "; "))


@query()
def ranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ranked_quotes(corpus.seeded_reports(spark, sf_dir))


@query()
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.evidence_blocks(corpus.seeded_reports(spark, sf_dir), most=None)


def _plain(pattern: str) -> str:
    return pattern.replace("'", "''")


_PARTS_SQL = ", ".join(
    f"{{'feature_key': '{k}', 'n': len(regexp_extract_all(text, '{'' if k == 'data_tables' else '(?i)'}{_plain(p)}'))}}" for k, p in RULES.items()
)


@query(f"""{_PAGES}, hits AS (SELECT report_id, page, unnest([{_PARTS_SQL}]) AS h FROM pages0)
SELECT report_id, h.feature_key AS feature_key, sum(h.n)::BIGINT AS occurrences, count(*)::BIGINT AS pages FROM hits WHERE h.n > 0 GROUP BY 1, 2""")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.count_features(_whole_blocks(spark, sf_dir)).where("feature_key <> 'scope3_categories'").select("report_id", "feature_key", "occurrences", "pages")


_S3 = [f"len(regexp_extract_all(text, '(?i){_plain(p)}'))" for p in SCOPE3_PATTERNS]


@query(f"""{_PAGES} SELECT report_id, 'scope3_categories' AS feature_key, sum({_S3[2]})::BIGINT AS occurrences, count(*) FILTER ({_S3[3]} > 0)::BIGINT AS pages
FROM pages0 GROUP BY 1 HAVING sum({_S3[0]} + {_S3[1]}) > 0""")
def scope3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.count_features(_whole_blocks(spark, sf_dir)).where("feature_key = 'scope3_categories'").select("report_id", "feature_key", "occurrences", "pages")


# The same under their names of the round before; all read whole texts, and the canned pages are for tests


def _whole_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(segment.evidence_blocks(corpus.seeded_reports(spark, sf_dir), most=None))


@query()
def whole_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.count_features(_whole_blocks(spark, sf_dir)).where("feature_key <> 'scope3_categories'").select("report_id", "feature_key", "occurrences", "pages")


@query()
def whole_scope3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.count_features(_whole_blocks(spark, sf_dir)).where("feature_key = 'scope3_categories'").select("report_id", "feature_key", "occurrences", "pages")


# Text functions and segmentation


@query(r"""SELECT doc_id, ceil(length(text) / 4.0)::INT AS tokens, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed, CASE WHEN length(text) <= 500 THEN text ELSE concat(regexp_replace(substr(text, 1, 500), '\s+$', ''), chr(10), chr(10), '[Truncated]', chr(10)) END AS cut FROM documents""")
def text_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(t).alias("tokens"), tx.collapse_whitespace(t).alias("collapsed"), tx.truncate_end(t, 500).alias("cut"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(coalesce(text, ''), 'ß', ' '))), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents""")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB's accents take a sharp s apart, the reference's form has none, so SQL puts a blank in its place."""
    return _read(spark, sf_dir, "documents").select("doc_id", search_fold(F.col("text")).alias("folded"))


@query(r"""WITH f AS (SELECT doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN 'Éclair & Sons_' ELSE 'Nord-' END, (2015 + doc_id % 9)::VARCHAR, '-sustainability report-FY', (2016 + doc_id % 9)::VARCHAR, '.pdf') AS name FROM documents)
SELECT doc_id, NULLIF((2015 + doc_id % 9), CASE WHEN doc_id % 2 = 0 THEN (2015 + doc_id % 9) ELSE 0 END)::INT AS year, lower(regexp_replace(trim(regexp_replace(lower(strip_accents(replace(name, '&', ' and '))), '[^a-z0-9]+', ' ', 'g')), ' ', '-', 'g')) AS slug FROM f""")
def filename_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.when(d % 2 == 0, "Éclair & Sons_").otherwise("Nord-"), (2015 + d % 9).cast("string"), F.lit("-sustainability report-FY"), (2016 + d % 9).cast("string"), F.lit(".pdf"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", tx.year_from_filename(F.col("name")).alias("year"), slugify_company(F.col("name")).alias("slug"))


@query("""WITH base AS (SELECT doc_id, concat('company-', (doc_id % 50)::VARCHAR, '-', (2018 + doc_id % 7)::VARCHAR) AS b FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS nth FROM base)
SELECT doc_id, CASE WHEN nth = 1 THEN b ELSE concat(b, '-', nth::VARCHAR) END AS slug FROM n""")
def report_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.catalogue(spark, sf_dir).select("doc_id", "company", "year")
    return tx.assign_slugs(rows, F.concat_ws("-", slugify_company(F.col("company")), F.coalesce(F.col("year"), F.lit(0)).cast("string")), ["doc_id"]).select("doc_id", "slug")


@query(r"""WITH paras AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS para FROM documents),
toks AS (SELECT doc_id, para, regexp_extract_all(p, '\S+') AS t FROM paras),
wins AS (SELECT doc_id, para, t, unnest(generate_series(0, greatest(1, ceil((len(t) - 64) / 48.0)::BIGINT + 1) - 1)) AS w FROM toks WHERE len(t) > 0),
parts AS (SELECT doc_id, para, w, list_slice(t, w * 48 + 1, w * 48 + 64) AS x FROM wins)
SELECT concat('report-', doc_id::VARCHAR) AS report_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para, w) - 1)::INT AS chunk_in_page, array_to_string(x, ' ') AS text, len(x)::INT AS token_count FROM parts WHERE len(x) >= 8 AND length(array_to_string(x, ' ')) >= 40""")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "documents").select(F.concat(F.lit("report-"), F.col("doc_id").cast("string")).alias("report_id"), F.lit(1).alias("page"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return segment.token_chunks(pages, 64, 16, 8, 40).select("report_id", "chunk_in_page", "text", "token_count")


@query()
def retrieval_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.char_chunks(F.col("text"))).alias("chunk", "text"))
    return rows.select("doc_id", "chunk", F.length("text").alias("n_chars"), tx.fnv1a_hex(F.col("text")).alias("hash"))


# Intake


_POS_SQL = ", ".join(f"{{'key': '{k}', 'n': least(len(regexp_extract_all(lower(text), '(?i){_plain(p)}')), 20), 'w': {w}}}" for k, (p, w) in intake.POSITIVE.items())
_NEG_SQL = " + ".join(f"least(len(regexp_extract_all(lower(text), '(?i){_plain(p)}')), 15) * {w}" for p, w in intake.NEGATIVE)
_PAGE_SCORES = f"""{_PAGES}, hits AS (SELECT report_id, page, [{_POS_SQL}] AS h, {_NEG_SQL} AS negative FROM pages0),
page_scores AS (SELECT *, positive - negative AS score, (positive - negative >= 8 OR positive >= 12) AS is_candidate FROM (SELECT report_id, page, list_sum(list_transform(h, lambda x: x.n * x.w))::INT AS positive, negative::INT AS negative, list_transform(list_filter(h, lambda x: x.n > 0), lambda x: x.key) AS hit_keys FROM hits))"""


@query(f"{_PAGE_SCORES} SELECT report_id, page, score, positive, negative, is_candidate, array_to_string(hit_keys, ',') AS hit_keys FROM page_scores")
def intake_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _whole_scores(spark, sf_dir)
    return scores.withColumn("hit_keys", F.array_join("hit_keys", ",")).drop("snippet")


_SPANS = f"""{_PAGE_SCORES}, marked AS (SELECT *, CASE WHEN page > lag(page) OVER w + 2 THEN 1 ELSE 0 END AS gap FROM page_scores WHERE is_candidate WINDOW w AS (PARTITION BY report_id ORDER BY page)),
islands AS (SELECT *, sum(gap) OVER (PARTITION BY report_id ORDER BY page) AS span FROM marked),
spans AS (SELECT report_id, min(page) AS "start", max(page) AS "end", count(*) AS pages, sum(score)::BIGINT AS score, (sum(score) + 2 * count(*))::BIGINT AS rank FROM islands GROUP BY report_id, span)"""


@query(f"{_SPANS} SELECT * FROM spans")
def intake_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.candidate_spans(_whole_scores(spark, sf_dir))


@query(f"""{_SPANS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY rank DESC, "start") AS nth FROM spans) WHERE nth = 1),
totals AS (SELECT report_id, count(*) AS total_pages, sum(positive)::BIGINT AS total_positive, sum(negative)::BIGINT AS total_negative, count(*) FILTER (is_candidate) AS candidate_pages, len(list_distinct(flatten(list(hit_keys))))::INT AS hit_breadth FROM page_scores GROUP BY 1)
SELECT t.*, "start", "end", pages AS span_pages, total_positive - total_negative AS raw_score, (total_positive - total_negative >= 80 AND hit_breadth >= 5 AND candidate_pages >= greatest(3, floor(total_pages * 0.06))) AS is_sustainability,
coalesce(pages / greatest(1, total_pages) >= 0.72 AND candidate_pages / greatest(1, total_pages) >= 0.6, false) AS is_only FROM totals t LEFT JOIN best b USING (report_id)""")
def intake_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = written(_whole_scores(spark, sf_dir).drop("snippet"))
    return intake.intake_verdict(scores, intake.candidate_spans(scores))


def _whole_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.score_pages(segment.split_pages_intake(corpus.seeded_reports(spark, sf_dir)), None)


@query()
def whole_intake_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_scores(spark, sf_dir).withColumn("hit_keys", F.array_join("hit_keys", ",")).drop("snippet")


@query()
def whole_intake_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.candidate_spans(_whole_scores(spark, sf_dir))


@query()
def whole_intake_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = written(_whole_scores(spark, sf_dir).drop("snippet"))
    return intake.intake_verdict(scores, intake.candidate_spans(scores))


@query("""WITH e AS (SELECT doc_id, sha256(text) AS sha256, concat('reports/', doc_id::VARCHAR, '.pdf') AS k FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 1)
SELECT n.doc_id AS upload_id, count(e.k) > 0 AS same_hash FROM n LEFT JOIN e USING (sha256) GROUP BY 1""")
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("sha256", F.sha2("text", 256)).withColumn("company_slug", F.lit(None).cast("string")).withColumn("year", F.lit(None).cast("int"))
    existing = docs.where("doc_id % 2 = 0").select("sha256", "year", "company_slug", F.concat(F.lit("reports/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("report_key"))
    new = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("upload_id"), "sha256", "year", "company_slug")
    return intake.find_duplicates(new, existing).select("upload_id", "same_hash")


@query(f"""{_CATALOGUE} SELECT doc_id AS upload_id, concat('report-', (greatest(9999, (SELECT max(doc_id) FROM catalogue)) + row_number() OVER (ORDER BY doc_id))::VARCHAR) AS report_id FROM catalogue""")
def allocated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.catalogue(spark, sf_dir)
    return intake.allocate_report_ids(known.select(F.col("doc_id").alias("upload_id")), known).select("upload_id", "report_id")


# Routing, totals and entities

_CATEGORIES = list(CATEGORY_TO_PILLAR)
_ISSUES = list(ISSUE_TO_PILLAR)
_CAT_SQL = ", ".join(f"({i}, '{c}', {'NULL' if p is None else repr(p)})" for i, (c, p) in enumerate(CATEGORY_TO_PILLAR.items()))
_ISSUE_SQL = ", ".join(f"({i}, '{c}', '{p}')" for i, (c, p) in enumerate(ISSUE_TO_PILLAR.items()))
_ISSUED = f"{_PREDICTIONS}, issues AS (SELECT * FROM (VALUES {_ISSUE_SQL}) AS t(issue_no, issue, pillar)), preds AS (SELECT k, issue, pillar, score FROM predictions JOIN issues USING (issue_no))"


def _issue_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(i) for i in _ISSUES])
    return corpus.predictions(spark, sf_dir).select("k", F.get(names, F.col("issue_no").cast("int")).alias("issue"), "score")


@query(f"""{_PREDICTIONS}, cats AS (SELECT * FROM (VALUES {_CAT_SQL}) AS t(no, category, pillar)),
routed AS (SELECT k, chunk, CASE WHEN chunk = 3 THEN 'Unknown' WHEN category = 'Non-ESG' OR score < 0.3 THEN 'Non-ESG' ELSE category END AS category, CASE WHEN chunk = 3 OR category = 'Non-ESG' OR score < 0.3 THEN NULL ELSE pillar END AS pillar, (chunk = 3 OR NOT (category = 'Non-ESG' OR score < 0.3)) AS is_esg FROM predictions JOIN cats ON no = issue_no % 9)
SELECT k AS report_id, count(*) AS total_chunks, count(*) FILTER (is_esg) AS routed_chunks, count(*) FILTER (is_esg AND pillar = 'E') AS pillar_e, count(*) FILTER (is_esg AND pillar = 'S') AS pillar_s, count(*) FILTER (is_esg AND pillar = 'G') AS pillar_g, count(*) FILTER (NOT is_esg) AS skipped_chunks, floor(count(*) FILTER (NOT is_esg) / count(*) * 100 + 0.5)::INT AS skipped_pct FROM routed GROUP BY 1""")
def routing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in _CATEGORIES])
    one = F.array(F.struct(F.get(names, (F.col("issue_no") % 9).cast("int")).alias("label"), F.col("score").cast("double").alias("score")), F.struct(F.lit("Non-ESG").alias("label"), F.lit(0.0).alias("score")))
    preds = corpus.predictions(spark, sf_dir).select(F.col("k").alias("report_id"), F.col("chunk").alias("chunk_index"), F.when(F.col("chunk") != 3, one).alias("scores"))
    return routing.routing_summary(routing.route_chunks(preds)).drop("by_category")


@query(f"{_ISSUED} SELECT k, issue, sum(score) AS score_sum FROM preds GROUP BY 1, 2")
def issue_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.issue_totals(_issue_preds(spark, sf_dir))


@query(f"""{_ISSUED}, t AS (SELECT k, issue, pillar, sum(score) AS s FROM preds GROUP BY 1, 2, 3)
SELECT k, rank, issue, s AS score, pillar FROM (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY s DESC, issue))::INT AS rank FROM t) WHERE rank <= 5""")
def report_top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.top_issues(routing.issue_totals(_issue_preds(spark, sf_dir)), 5)


@query(f"""{_ISSUED} SELECT k, round(coalesce(sum(score) FILTER (pillar = 'E'), 0) / nullif(sum(score), 0), 6) AS share_e, round(coalesce(sum(score) FILTER (pillar = 'S'), 0) / nullif(sum(score), 0), 6) AS share_s, round(coalesce(sum(score) FILTER (pillar = 'G'), 0) / nullif(sum(score), 0), 6) AS share_g FROM preds GROUP BY 1""")
def report_pillar_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(routing.pillar_shares(routing.pillar_totals(_issue_preds(spark, sf_dir))), "share_e", "share_s", "share_g")


@query(f"""{_ENTITIES}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id, extraction_class, lower(trim(extraction_text)) ORDER BY chunk_index, position) AS nth FROM entities) WHERE nth = 1)
SELECT report_id, count(*) AS total_entities, count(*) FILTER (pillar = 'E') AS n_e, count(*) FILTER (pillar = 'S') AS n_s, count(*) FILTER (pillar = 'G') AS n_g, floor(count(*) FILTER (pillar = 'E') / count(*) * 100 + 0.5) / 100 AS share_e, floor(count(*) FILTER (pillar = 'S') / count(*) * 100 + 0.5) / 100 AS share_s, floor(count(*) FILTER (pillar = 'G') / count(*) * 100 + 0.5) / 100 AS share_g FROM d GROUP BY 1""")
def entity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entity_summary(entities.dedupe_entities(corpus.entities(spark, sf_dir))).drop("by_class")


@query(f"""{_ISSUED}, ents AS ({ENTITIES_SQL}), a AS (SELECT k, coalesce(sum(score) FILTER (pillar = 'E'), 0) / nullif(sum(score), 0) AS e, coalesce(sum(score) FILTER (pillar = 'S'), 0) / nullif(sum(score), 0) AS s, coalesce(sum(score) FILTER (pillar = 'G'), 0) / nullif(sum(score), 0) AS g FROM preds GROUP BY 1),
b AS (SELECT report_id AS k, count(*) FILTER (pillar = 'E') / count(*) AS e, count(*) FILTER (pillar = 'S') / count(*) AS s, count(*) FILTER (pillar = 'G') / count(*) AS g FROM ents GROUP BY 1)
SELECT k AS report_id, round(greatest(0, least(1, 1 - 0.5 * (abs(a.e - b.e) + abs(a.s - b.s) + abs(a.g - b.g)))), 6) AS agreement FROM a JOIN b USING (k)""")
def pillar_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = routing.pillar_shares(routing.pillar_totals(_issue_preds(spark, sf_dir))).withColumnRenamed("k", "report_id")
    ents = corpus.entities(spark, sf_dir).groupBy("report_id").agg(*[(F.count_if(F.col("pillar") == p) / F.count("*")).alias(f"share_{p.lower()}") for p in "ESG"])
    return _rounded(entities.pillar_agreement(shares, ents), "agreement")


@query()
def grounded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.grounded_quotes(corpus.seeded_reports(spark, sf_dir))


# Retrieval and conversations


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id::VARCHAR AS id, round(list_sum(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(v.e, lambda x: x * x)))), 9) AS similarity FROM q JOIN v USING (label))
SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id))::INT AS rank FROM s) WHERE rank <= 8""")
def nearest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("vec_id").cast("string").alias("id"), F.col("label").alias("namespace"), F.col("embedding").alias("values"))
    return _rounded(retrieval.top_k_chunks(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, 8), "similarity")


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN length(trim(text)) <= 10000 THEN trim(text) ELSE NULL END AS text FROM conversations WHERE trim(text) <> ''""")
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.normalize_messages(_read(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, trim(arg_max(text, turn)) AS text FROM conversations WHERE (role = 'user' OR role IS NULL) AND trim(text) <> '' GROUP BY 1""")
def last_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.last_user_message(_read(spark, sf_dir, "conversations"))


@query("""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) WHERE nth <= 4) SELECT conv_id, (ceil(sum(ceil(length(text) / 4.0) + 12) * 115 / 100) + 24)::BIGINT AS tokens FROM r GROUP BY 1""")
def history_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_tokens(conversations.recent_history(_read(spark, sf_dir, "conversations"), 4))


@query()
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = conversations.normalize_messages(_read(spark, sf_dir, "conversations"))
    offered = messages.groupBy("conv_id").agg((F.max("turn") * 2500).cast("int").alias("viewer_chars"), (F.count("*") * 1500).cast("int").alias("retrieved_chars"))
    return conversations.fit_context(messages, offered, 4096)


# Catalogue

_CAT_COLUMNS = "report_id, company, sector, country, year, report_key"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.catalogue(spark, sf_dir).select(*_CAT_COLUMNS.split(", "))


@query(f"""{_UPLOADS}, i AS (SELECT {_CAT_COLUMNS} FROM catalogue) SELECT coalesce(u.report_id, i.report_id) AS report_id, CASE WHEN u.report_id IS NOT NULL THEN u.company ELSE i.company END AS company, CASE WHEN u.report_id IS NOT NULL THEN u.sector ELSE i.sector END AS sector, CASE WHEN u.report_id IS NOT NULL THEN u.country ELSE i.country END AS country, CASE WHEN u.report_id IS NOT NULL THEN u.year ELSE i.year END AS year, CASE WHEN u.report_id IS NOT NULL THEN u.report_key ELSE i.report_key END AS report_key,
CASE WHEN i.report_id IS NULL THEN 'uploaded' WHEN u.report_id IS NULL THEN 'index' ELSE 'merged' END AS origin, u.report_id IS NOT NULL AS can_delete FROM i FULL OUTER JOIN uploads u ON u.report_id = i.report_id""")
def merged_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merge_catalogue(_index(spark, sf_dir), corpus.uploads(spark, sf_dir))


@query(f"{_UPLOADS} SELECT {_CAT_COLUMNS} FROM catalogue WHERE report_id NOT IN (SELECT report_id FROM uploads) UNION ALL SELECT {_CAT_COLUMNS} FROM uploads")
def public_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.public_catalogue(_index(spark, sf_dir), corpus.uploads(spark, sf_dir))


@query(f"""{_CATALOGUE} SELECT 'country' AS facet, country AS value, count(*) AS n FROM catalogue WHERE country <> '' GROUP BY 2 UNION ALL SELECT 'sector', sector, count(*) FROM catalogue WHERE sector <> '' GROUP BY 2 UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM catalogue WHERE year IS NOT NULL GROUP BY 2""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.facet_values(_index(spark, sf_dir))


@query(f"""{_UPLOADS}, n AS (SELECT count(DISTINCT report_id) AS n FROM (SELECT report_id FROM catalogue UNION ALL SELECT report_id FROM uploads)) SELECT n, CASE WHEN n < 50 THEN n::VARCHAR ELSE concat((floor(n / 50) * 50)::BIGINT::VARCHAR, '+') END AS label FROM n""")
def report_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.live_count(_index(spark, sf_dir), corpus.uploads(spark, sf_dir))


@query(f"""{_SCORED}, e AS (SELECT DISTINCT concat('report-', doc_id::VARCHAR) AS report_id FROM documents WHERE doc_id % 4 = 0) SELECT c.report_id, s.score, s.report_id IS NOT NULL AS scored, e.report_id IS NOT NULL AS entities_done FROM catalogue c LEFT JOIN scored s USING (report_id) LEFT JOIN e ON e.report_id = c.report_id""")
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _index(spark, sf_dir).select("report_id")
    done = corpus.catalogue(spark, sf_dir).where("doc_id % 4 = 0").select("report_id")
    return catalog.status_board(reports, corpus.scored_rows(spark, sf_dir), done)


@query(f"""{_CATALOGUE} SELECT {_CAT_COLUMNS} FROM catalogue WHERE lower(company) LIKE '%company%' AND concat_ws(' ', lower(company), lower(sector), country, year::VARCHAR) LIKE '%2020%' AND country IN ('src0', 'src1', 'src2')""")
def searched_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search_reports(_index(spark, sf_dir), "Cómpany 2020", ["company", "sector", "country", "year"])
    return catalog.filter_reports(found, countries=["src0", "src1", "src2"])


@query(f"""{_CATALOGUE} SELECT report_id, report_key FROM catalogue WHERE report_key > 'reports/2020' ORDER BY report_key LIMIT 40""")
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.key_page(_index(spark, sf_dir).select("report_id", "report_key"), "report_key", "reports/2020", 40)


@query(f"{_SCORED} SELECT c.report_id FROM catalogue c LEFT JOIN scored s USING (report_id) WHERE s.report_id IS NULL AND c.year = 2019")
def reports_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pending_scores(_index(spark, sf_dir), corpus.scored_rows(spark, sf_dir), year=2019).select("report_id")


# Analytics

_MIDDLE = "round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score"
_BANDS = "count(*) FILTER (band = 'high') AS n_high, count(*) FILTER (band = 'medium') AS n_medium, count(*) FILTER (band = 'low') AS n_low"
_MEANS = ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in analytics.SUBSCORES)
_MEAN_NAMES = [f"mean_{c}" for c in analytics.SUBSCORES]


@query(f"{_SCORED} SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS n, {_MIDDLE}, min(score) AS min_score, max(score) AS max_score, {_MEANS} FROM scored GROUP BY 1")
def sector_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analytics.sector_benchmarks(corpus.scored_rows(spark, sf_dir)), "mean_score", "median_score", *_MEAN_NAMES)


@query(f"{_SCORED} SELECT country, count(*) AS n, {_MIDDLE} FROM scored GROUP BY 1")
def country_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analytics.country_buckets(corpus.scored_rows(spark, sf_dir)), "mean_score", "median_score")


@query(f"{_SCORED}, t AS (SELECT year, count(*) AS n, avg(score) AS m, {_MIDDLE}, {_BANDS} FROM scored GROUP BY 1) SELECT * EXCLUDE (m), round(m - lag(m) OVER (ORDER BY year), 6) AS delta FROM t")
def year_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analytics.year_deltas(analytics.year_trends(corpus.scored_rows(spark, sf_dir))), "mean_score", "median_score", "delta")


@query(f"{_SCORED} SELECT b::INT AS bin, count(s.score) AS n FROM range(10) t(b) LEFT JOIN scored s ON least(9, floor(s.score / 10)) = b GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.score_histogram(corpus.scored_rows(spark, sf_dir))


@query(f"{_SCORED} SELECT count(*) AS n_scored, {_MIDDLE}, {_BANDS}, {_MEANS}, (SELECT count(*) FROM catalogue) AS n_reports, floor(count(*) * 100.0 / (SELECT count(*) FROM catalogue) + 0.5)::BIGINT AS coverage_pct FROM scored")
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analytics.corpus_overview(corpus.scored_rows(spark, sf_dir), _index(spark, sf_dir)), "mean_score", "median_score", *_MEAN_NAMES)


@query(f"{_SCORED} SELECT count(*) AS n, count(completeness) AS n_detail, round(stddev_pop(score), 6) AS score_sd, count(DISTINCT sector) AS sectors, count(DISTINCT country) AS countries, count(DISTINCT year) AS years FROM scored")
def summary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analytics.summary_cards(corpus.scored_rows(spark, sf_dir)), "score_sd")


_PAIRS = [(a, b) for i, a in enumerate(analytics.SUBSCORES) for b in analytics.SUBSCORES[i + 1 :]]


@query(f"{_SCORED} " + " UNION ALL ".join(f"SELECT '{a}~{b}' AS pair, round(corr({a}, {b}), 6) AS r FROM scored" for a, b in _PAIRS))
def subscore_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analytics.subscore_correlations(corpus.scored_rows(spark, sf_dir)), "r")


@query(f"{_SCORED} (SELECT report_id, score, 'top' AS side FROM scored ORDER BY score DESC, report_id LIMIT 10) UNION ALL (SELECT report_id, score, 'bottom' FROM scored ORDER BY score, report_id LIMIT 10)")
def performers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.scored_rows(spark, sf_dir)
    pick = lambda df, side: df.select("report_id", "score", F.lit(side).alias("side"))
    return pick(analytics.top_performers(rows), "top").unionByName(pick(analytics.bottom_performers(rows), "bottom"))


_HITS_SQL = f"{_PAGES}, hits AS (SELECT report_id, page, unnest([{_PARTS_SQL}]) AS h FROM pages0), f AS (SELECT report_id, h.feature_key AS feature_key, sum(h.n) AS occurrences, count(*) AS pages FROM hits WHERE h.n > 0 GROUP BY 1, 2)"


@query(f"{_HITS_SQL} SELECT feature_key, count(*) AS hits, floor(count(*) * 100.0 / (SELECT count(*) FROM documents) + 0.5)::BIGINT AS hit_rate_pct, round(sum(occurrences) / count(*), 6) AS occurrences_per_hit, round(sum(pages) / count(*), 6) AS pages_per_hit FROM f GROUP BY 1")
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = features.count_features(_whole_blocks(spark, sf_dir)).where("feature_key <> 'scope3_categories'")
    return _rounded(analytics.feature_coverage(hits, _index(spark, sf_dir)), "occurrences_per_hit", "pages_per_hit")


@query()
def whole_feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = features.count_features(_whole_blocks(spark, sf_dir)).where("feature_key <> 'scope3_categories'")
    return _rounded(analytics.feature_coverage(hits, _index(spark, sf_dir)), "occurrences_per_hit", "pages_per_hit")


# Streams' batch forms


@query("""SELECT event_id, user_id AS key, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events""")
def trailing_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return jobs.trailing_counts(rows, 6 * 3600 * 1000)


@query()
def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return jobs.trailing_limit(rows, 24 * 3600 * 1000, 2)


@query("""WITH s AS (SELECT event_id AS token, ts AS created_at FROM events WHERE event_id % 2 = 0), f AS (SELECT event_id - 1 AS token, ts AS finalized_at FROM events WHERE event_id % 4 = 1)
SELECT s.token, created_at, f.finalized_at, CASE WHEN f.token IS NULL THEN 'expired' ELSE 'finalized' END AS outcome FROM s LEFT JOIN f ON s.token = f.token AND finalized_at >= created_at AND finalized_at <= created_at + INTERVAL 2 HOURS""")
def staged_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    staged = e.where("event_id % 2 = 0").select(F.col("event_id").alias("token"), F.col("ts").alias("created_at"))
    finals = e.where("event_id % 4 = 1").select((F.col("event_id") - 1).alias("token"), F.col("ts").alias("finalized_at"))
    return jobs.staging_outcomes(staged, finals)
