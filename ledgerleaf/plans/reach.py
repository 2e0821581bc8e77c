"""Registered queries of further operators: text forms, ids, intake choices, entities, catalogue, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text as tx
from ledgerleaf.functions.dimensions import (
    COMPANY_TO_GROUP,
    DISPLAY_CATEGORIES,
    ENTITY_TO_PILLAR,
    EVIDENCE_CATEGORIES,
    INDUSTRY_GROUPS,
    INDUSTRY_TO_GROUP,
    ISSUE_TO_ENTITIES,
    ISSUE_TO_PILLAR,
    SECTORS,
)
from ledgerleaf.functions.folding import repair_mojibake
from ledgerleaf.functions.rules import RULE_KEYS, once
from ledgerleaf.operators import analytics, catalog, entities, features, intake, retrieval, routing, scoring, segment
from ledgerleaf.plans import corpus
from ledgerleaf.plans.corpus import CATALOGUE_SQL, ENTITIES_SQL, PREDICTIONS_SQL, SCORED_SQL, UPLOADS_SQL
from ledgerleaf.plans.registry import _CATALOGUE, _ENTITIES, _ISSUED, _PAGE_SCORES, _SCORED, _SPANS, _UPLOADS, _index, _issue_preds, _plain, _read, _rounded, _whole_scores, query
from ledgerleaf.sources import buckets, io
from ledgerleaf.sources.tables import shared_folder, written
from ledgerleaf.streaming import jobs


def _fresh(df: DataFrame, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# Text forms, in DuckDB's patterns: flags without d, groups by backslash


def _sql_all(col: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        flags = pattern.replace("(?dm)", "(?m)").replace("(?idm)", "(?im)")
        col = f"regexp_replace({col}, '{_plain(flags)}', '{to.replace('$', chr(92))}', 'g')"
    return col


def _sql_trim(col: str) -> str:
    return _sql_all(col, (rf"^{tx.SPACE}+|{tx.SPACE}+$", ""))


def _sql_collapse(col: str) -> str:
    return _sql_all(col, (rf"{tx.SPACE}+", " "), ("^ | $", ""))


_LINE_ENDS = (("\r\n?", "\n"), (tx.NBSP, " "))
_UNICODE = ((f"{tx.INVISIBLE}|{tx.SOFT_HYPHEN}", ""), *tx.LIGATURES.items(), (tx.SYMBOLS, ""), (tx.ARROWS, " - "))
_MARKDOWN = (
    (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\(\s*\)", "$1"), (r"(?m)^\s*#{1,6}\s*$", ""), (r"(?m)^[\s|]*[-:]{3,}(?:\s*\|\s*[-:]{3,})+[\s|]*$", ""), (r"(?m)^\s*\|[\s|]*$", ""),
    (r"(?m)^\s*\|\s+", ""), (r"(?m)\s+\|\s*$", ""), (r"\|{2,}", " | "), (r"(?m)^-{3,}\s*$", ""),
)
_BLANK = ((rf"{tx.BLANKS}+", " "), (r" *\n", "\n"), (r"\n{3,}", "\n\n"))


def sql_normalize_for_evidence(col: str) -> str:
    return _sql_trim(_sql_all(col, *_LINE_ENDS, (r"(?im)^\s*\[\.\.\.snipped\.\.\.\]\s*$", ""), *_UNICODE, *_MARKDOWN, *_BLANK))


_DISPLAY = _sql_all(
    _sql_trim(_sql_all("t", *_LINE_ENDS, (r"(?im)^\s*#{1,6}\s*page\s+\d+.*$", ""), (r"(?im)^\s*-{3}\s*page\s+\d+\s*-{3}\s*$", ""), (r"(?i)\[\.\.\.(?:snipped|truncated)\.\.\.\]|\[truncated\]", ""), *_UNICODE, *_MARKDOWN, *_BLANK)),
    (r"\s*(?:\.\.\.|…)\s*$", ""),
)
_EXTRACTION = _sql_trim(_sql_all("t", *_LINE_ENDS, *_MARKDOWN[:2], *_BLANK))
_PAGE_TEXT = _sql_trim(_sql_all("t", *_LINE_ENDS, (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")))
_MATCH = _sql_collapse(_sql_all(f"lower({_sql_all('t', (tx.NBSP, ' '), (f'{tx.INVISIBLE}|{tx.SOFT_HYPHEN}', ''))})", (r"[`*_>#|]", " ")))
#: Texts with marks of every kind in front of them.
_MARKED = "### Page 3 Title\n[link]( ) ![pic](a.png) eﬃcient co­op ■ x → y\n| a | b |\n|---|---|\n[Truncated] \n\n\n\n"
_MARKED_SQL = f"SELECT doc_id, concat('{_MARKED}', coalesce(text, ''), ' ...') AS t FROM documents"


@query(f"""WITH m AS ({_MARKED_SQL}), f AS (SELECT doc_id, t, {_MATCH} AS matched, {_sql_collapse("t")} AS c FROM m)
SELECT doc_id, {sql_normalize_for_evidence("t")} AS evidence, {_sql_trim(_DISPLAY)} AS display, {_EXTRACTION} AS extraction, {_PAGE_TEXT} AS page_text, matched,
array_to_string(list_filter(string_split_regex(matched, '[^a-z0-9%]+'), lambda p: length(p) >= 3 OR regexp_matches(p, '[0-9]'))[1:14], ' ') AS tokens,
substr(coalesce(nullif(c, ''), 'none'), 1, 40) AS field,
CASE WHEN length(t) <= 300 THEN t ELSE concat({_sql_all("substr(t, 1, 120)", (rf"{tx.SPACE}+$", ""))}, chr(10), chr(10), '[...truncated...]', chr(10), chr(10), {_sql_all("right(t, 148)", (rf"^{tx.SPACE}+", ""))}) END AS head_tail,
CASE WHEN length(c) <= 200 THEN c WHEN length(regexp_extract(substr(c, 1, 202), '^(.*[.]) ', 1)) - 1 > 120 THEN regexp_extract(substr(c, 1, 202), '^(.*[.]) ', 1) ELSE substr(c, 1, 200) END AS for_classifier FROM f""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(_MARKED), F.coalesce("text", F.lit("")), F.lit(" ...")).alias("t"))
    rows = once(rows, {"matched": tx.normalize_for_match(t)})
    return rows.select(
        "doc_id", tx.normalize_for_evidence(t).alias("evidence"), tx.clean_evidence_display(t).alias("display"), tx.normalize_for_extraction(t).alias("extraction"), tx.normalize_page_text(t).alias("page_text"),
        "matched", F.array_join(tx.tokens_of(F.col("matched")), " ").alias("tokens"), tx.meta_field(t, "none", 40).alias("field"), tx.truncate_head_tail(t, 300, 1600).alias("head_tail"),
        tx.truncate_for_classifier(t, 200).alias("for_classifier"),
    )


_NAMES = """SELECT doc_id, concat('/', report_key) AS k, concat(' ACME-', cast(doc_id % 9 AS string), CASE WHEN doc_id % 3 = 0 THEN '-u12345 ' ELSE ' ' END) AS slug,
CASE WHEN doc_id % 5 = 0 THEN concat('x', report_id) WHEN doc_id % 5 = 1 THEN concat(report_id, '0000000') ELSE report_id END AS rid,
concat('Group_', cast(doc_id % 9 AS string), '_annual-report 2021.pdf') AS name, concat('framework_', CASE WHEN doc_id % 2 = 0 THEN 'efragRule' ELSE 'gri-index' END) AS feature, CASE WHEN doc_id % 4 = 0 THEN ' energy ' WHEN doc_id % 4 = 1 THEN 'HEALTH  care' ELSE 'other thing' END AS sector_name, year AS y FROM catalogue"""


@query(rf"""{_CATALOGUE}, n AS ({_NAMES.replace("AS string)", "AS VARCHAR)")}), s AS (SELECT * FROM (VALUES {_values([(s,) for s in SECTORS])}) AS v(sector))
SELECT doc_id, CASE WHEN regexp_matches(substr(k, 2), '^[A-Za-z0-9/_.\-&(),''+ ]+$') THEN substr(k, 2) ELSE '' END AS report_key, regexp_replace(lower(trim(n.slug)), '-u[0-9]{{4,}}$', '') AS canonical,
regexp_matches(rid, '^report-[0-9]+$') AS valid, CASE WHEN try_cast(nullif(regexp_extract(rid, '^report-([0-9]+)$', 1), '') AS BIGINT) < 1000000 THEN try_cast(nullif(regexp_extract(rid, '^report-([0-9]+)$', 1), '') AS BIGINT) END AS number,
try_cast(string_split(substr(k, 2), '/')[2] AS INT) AS path_year, string_split(substr(k, 2), '/')[3] AS path_slug, concat('Group ', (doc_id % 9)::VARCHAR, ' annual') AS company,
CASE WHEN doc_id % 2 = 0 THEN 'Framework Efrag Rule' ELSE 'Framework Gri Index' END AS label, coalesce(s.sector, 'Unknown') AS sector, CASE WHEN y = 2019 THEN 2030 ELSE y END AS y, coalesce(y = 2019, false) AS changed
FROM n LEFT JOIN s ON lower(s.sector) = lower(trim(regexp_replace(sector_name, '\s+', ' ', 'g')))""")
def id_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.catalogue(spark, sf_dir).createOrReplaceTempView("catalogue")
    rows = spark.sql(_NAMES)
    key = tx.normalize_report_key(F.col("k"))
    path = tx.parse_report_path(key)
    made = rows.select(
        "doc_id", key.alias("report_key"), tx.canonical_slug(F.col("slug")).alias("canonical"), tx.is_report_id(F.col("rid")).alias("valid"), tx.report_number(F.col("rid")).alias("number"),
        path["year"].alias("path_year"), path["slug"].alias("path_slug"), tx.company_from_filename(F.col("name")).alias("company"), tx.feature_label(F.col("feature")).alias("label"),
        tx.choose_vocab(F.col("sector_name"), SECTORS, "Unknown").alias("sector"), "y",
    )
    return tx.reclassify_year(made, 2019, 2030)


@query("""SELECT * FROM (SELECT concat('report-', (doc_id % 40)::VARCHAR) AS id, min(doc_id) AS pos FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1) ORDER BY pos LIMIT 25""")
def first_report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ids = F.when(d % 3 == 0, F.concat(F.lit("rep-"), d.cast("string"))).otherwise(F.concat(F.lit(" report-"), (d % 40).cast("string"), F.lit(" ")))
    return tx.dedupe_report_ids(_read(spark, sf_dir, "documents").select(ids.alias("id"), d.alias("pos")), 25)


_INDUSTRIES = sorted(INDUSTRY_TO_GROUP)
_LABELS = [*_INDUSTRIES, "Basket Weaving", INDUSTRY_GROUPS[0]]
_INDUSTRY_SQL = f"""labels AS (SELECT * FROM (VALUES {_values([(i, x) for i, x in enumerate(_LABELS)])}) AS v(no, label)),
walk AS (SELECT * FROM (VALUES {_values([(k, s, g) for k, (s, g) in INDUSTRY_TO_GROUP.items()])}) AS v(label, s, i)), own AS (SELECT * FROM (VALUES {_values([(k, s, g) for k, (s, g) in COMPANY_TO_GROUP.items()])}) AS v(c, s, i)),
rows0 AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '{next(iter(COMPANY_TO_GROUP))}' ELSE concat('Company ', (doc_id % 50)::VARCHAR) END AS c, CASE WHEN label = '{INDUSTRY_GROUPS[0]}' THEN '{SECTORS[0]}' ELSE 'Old sector' END AS s, label AS i FROM documents JOIN labels ON no = doc_id % {len(_LABELS)}),
std AS (SELECT r.doc_id, r.c, r.i = '{INDUSTRY_GROUPS[0]}' AS done, r.s AS s0, r.i AS i0, coalesce(own.s, walk.s, 'Unknown') AS s1, coalesce(own.i, walk.i, 'Unknown') AS i1 FROM rows0 r LEFT JOIN walk USING (label) LEFT JOIN own USING (c))""".replace("LEFT JOIN walk USING (label)", "LEFT JOIN walk ON walk.label = r.i").replace("LEFT JOIN own USING (c)", "LEFT JOIN own ON own.c = r.c")


def _industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    label = F.get(F.array(*map(F.lit, _LABELS)), (d % len(_LABELS)).cast("int"))
    company = F.when(d % 11 == 0, next(iter(COMPANY_TO_GROUP))).otherwise(F.concat(F.lit("Company "), (d % 50).cast("string")))
    none = F.lit(None).cast("string")
    return _read(spark, sf_dir, "documents").select("doc_id", company.alias("c"), F.when(label == INDUSTRY_GROUPS[0], SECTORS[0]).otherwise("Old sector").alias("s"), label.alias("i"), none.alias("ss"), none.alias("si"))


@query(f"WITH {_INDUSTRY_SQL} SELECT doc_id, c, CASE WHEN done THEN s0 ELSE s1 END AS s, CASE WHEN done THEN i0 ELSE i1 END AS i, CASE WHEN done THEN NULL ELSE s0 END AS ss, CASE WHEN done THEN NULL ELSE i0 END AS si FROM std")
def industry_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.to_industry_standard(_industries(spark, sf_dir))


@query(f"WITH {_INDUSTRY_SQL} SELECT i0 AS industry, count(*) AS n FROM std WHERE NOT done AND s1 = 'Unknown' GROUP BY 1")
def industries_without_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unmapped_industries(_industries(spark, sf_dir))


# Pages of whole texts. The woven reports in DuckDB

_PHRASE_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in corpus.PHRASES) + "]"
SEEDED_SQL = f"""SELECT concat('report-', doc_id::VARCHAR) AS report_id, doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(
  CASE WHEN doc_id % 17 <> 0 AND (i - 1) % 4 = 0 THEN concat('### Page ', ((i - 1) // 4 + 1)::VARCHAR, chr(10)) ELSE '' END, CASE WHEN doc_id % 2 = 0 AND (i - 1) % 4 = 0 THEN concat('ANNUAL REPORT OF THE GROUP', chr(10)) ELSE '' END,
  x, chr(10), chr(10), {_PHRASE_LIST}[((7 * doc_id + 3 * (i - 1)) % {len(corpus.PHRASES)})::BIGINT + 1], chr(10))), '') AS text FROM documents"""
_LINES_SQL = f"""reports AS ({SEEDED_SQL}), lines AS (SELECT report_id, unnest(string_split({_sql_all("text", *_LINE_ENDS)}, chr(10))) AS line, generate_subscripts(string_split({_sql_all("text", *_LINE_ENDS)}, chr(10)), 1) - 1 AS line_no FROM reports)"""
_TEXT_OF_PAGE = _sql_trim("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_start), '')")
_INTAKE_PAGES_SQL = rf"""{_LINES_SQL}, marked AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(line, '(?i)^\s*#{{1,6}}\s*Page\s+(\d+)\b.*$', 1), '') AS INT), try_cast(nullif(regexp_extract(trim(line), '(?i)^\s*---\s*Page\s+(\d+)\s*---\s*$', 1), '') AS INT), try_cast(nullif(regexp_extract(trim(line), '(?i)^\s*Page\s+(\d+)\s*:\s*$', 1), '') AS INT)) AS number FROM lines),
seqs AS (SELECT *, number IS NOT NULL AS is_start, sum((number IS NOT NULL)::INT) OVER (PARTITION BY report_id ORDER BY line_no) AS page_seq FROM marked),
made AS (SELECT report_id, page_seq, max(number) AS page, {_TEXT_OF_PAGE} AS text FROM seqs GROUP BY 1, 2),
counted AS (SELECT *, max(page_seq) OVER (PARTITION BY report_id) AS n_marked FROM made),
intake AS (SELECT report_id, page_seq, CASE WHEN n_marked = 0 THEN 1 ELSE page END AS page, CASE WHEN n_marked = 0 THEN {_sql_collapse("text")} ELSE text END AS text, n_marked FROM counted WHERE page_seq > 0 OR n_marked = 0),
intake_pages AS (SELECT report_id, page_seq::INT AS page_seq, page, text FROM intake WHERE n_marked > 0 OR text <> '')"""


@query(f"WITH {_INTAKE_PAGES_SQL} SELECT * FROM intake_pages")
def intake_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_pages_intake(corpus.seeded_reports(spark, sf_dir)).withColumn("page_seq", F.col("page_seq").cast("int"))


_GROUND_SQL = rf"""{_LINES_SQL}, heads AS (SELECT *, regexp_extract(line, '^\s*#{{1,6}}\s*Page\s+(\d+)\s*(.*)$', 1) AS h, coalesce(nullif(regexp_extract(trim(line), '^\s*---\s*Page\s+(\d+)\s*---\s*$', 1), ''), regexp_extract(trim(line), '^\s*Page\s+(\d+)\s*:\s*$', 1)) AS o FROM lines),
seqs AS (SELECT *, (h <> '' OR o <> '') AS is_start, sum((h <> '' OR o <> '')::INT) OVER (PARTITION BY report_id ORDER BY line_no) AS page_seq FROM heads),
made AS (SELECT report_id, page_seq, max(try_cast(coalesce(nullif(h, ''), nullif(o, '')) AS INT)) AS page, max(CASE WHEN h <> '' THEN nullif({_sql_trim("regexp_extract(line, '^\\s*#{1,6}\\s*Page\\s+(\\d+)\\s*(.*)$', 2)")}, '') END) AS title, {_TEXT_OF_PAGE} AS text FROM seqs GROUP BY 1, 2)"""


@query(f"WITH {_GROUND_SQL} SELECT report_id, page_seq::INT AS page_seq, page, title, text FROM made WHERE text <> ''")
def grounding_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_pages_grounding(corpus.seeded_reports(spark, sf_dir)).withColumn("page_seq", F.col("page_seq").cast("int"))


_MATCH_OF = lambda col: _MATCH.replace("regexp_replace(t,", f"regexp_replace({col},")
#: Every line of the documents as an entity of its report, the odd reports' from the last line on; a fifth of them stands on no page as it is.
_LINE_ENTITIES_SQL = """each AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents),
ents AS (SELECT concat('report-', doc_id::VARCHAR) AS report_id, CASE WHEN doc_id % 2 = 0 THEN i ELSE n - 1 - i END AS chunk_index, CASE WHEN i % 5 = 4 THEN concat('Unseen ', line) ELSE translate(line, 'aeiou', 'AEIOU') END AS extraction_text FROM each)"""


def _line_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n"), F.posexplode(lines).alias("i", "line"))
    text = F.when(F.col("i") % 5 == 4, F.concat(F.lit("Unseen "), "line")).otherwise(F.translate("line", "aeiou", "AEIOU"))
    order = F.when(F.col("doc_id") % 2 == 0, F.col("i")).otherwise(F.col("n") - 1 - F.col("i"))
    return rows.select(F.concat(F.lit("report-"), F.col("doc_id").cast("string")).alias("report_id"), order.alias("chunk_index"), F.lit(0).alias("position"), text.alias("extraction_text"))


_LINE_HITS_SQL = f"""{_GROUND_SQL}, sides AS (SELECT report_id, page_seq, page, title, {_MATCH_OF("text")} AS search FROM made WHERE text <> ''), {_LINE_ENTITIES_SQL},
looked AS (SELECT *, {_MATCH_OF("extraction_text")} AS needle FROM ents),
hits AS (SELECT report_id, needle, list(page_seq ORDER BY page_seq) AS hits FROM (SELECT DISTINCT report_id, needle FROM looked WHERE needle <> '') JOIN sides USING (report_id) WHERE contains(search, needle) GROUP BY 1, 2)"""


@query(f"WITH {_LINE_HITS_SQL} SELECT report_id, needle, array_to_string(hits, ' ') AS hits FROM hits")
def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages on which every line of the documents stands."""
    pages = once(segment.split_pages_grounding(corpus.seeded_reports(spark, sf_dir)), {"search": tx.normalize_for_match(F.col("text"))}, "search <> ''").select("report_id", "page_seq", "search")
    needles = written(_line_entities(spark, sf_dir).select("report_id", tx.normalize_for_match(F.col("extraction_text")).alias("needle")))
    needles = needles.select("report_id", F.col("needle").alias("key"), "needle")
    hits = entities.needle_hits(needles, entities.page_cells(pages))
    return hits.select("report_id", F.col("key").alias("needle"), F.array_join(F.col("hits").cast("array<string>"), " ").alias("hits"))


@query(f"""WITH RECURSIVE {_LINE_HITS_SQL},
turns AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY chunk_index) AS nth, list_filter(string_split_regex(needle, '[^a-z0-9%]+'), lambda p: length(p) >= 3 OR regexp_matches(p, '[0-9]'))[1:14] AS toks FROM looked),
near AS (SELECT report_id, nth, arg_min(page_seq, (-n, page_seq)) AS page_seq FROM (
  SELECT t.report_id, t.nth, s.page_seq, len(toks) AS most, list_sum(list_transform(toks, lambda w: contains(search, w)::INT)) AS n FROM turns t JOIN sides s USING (report_id) WHERE length(needle) >= 8 AND len(toks) >= 2 AND (report_id, needle) NOT IN (SELECT (report_id, needle) FROM hits))
  WHERE n >= least(3, greatest(2, ceil(most * 0.35))) GROUP BY 1, 2),
ready AS (SELECT t.report_id, nth, chunk_index, extraction_text, CASE WHEN length(needle) >= 8 THEN hits END AS hits, page_seq AS close FROM turns t LEFT JOIN hits USING (report_id, needle) LEFT JOIN near USING (report_id, nth)),
walk(report_id, nth, place, found) AS (SELECT DISTINCT report_id, 0::BIGINT, -1::HUGEINT, NULL::HUGEINT FROM ready UNION ALL
  SELECT report_id, nth, coalesce(found, place), found FROM (SELECT r.report_id, r.nth, w.place, coalesce(list_filter(hits, lambda h: h >= w.place)[1], hits[1], close)::HUGEINT AS found FROM walk w JOIN ready r ON r.report_id = w.report_id AND r.nth = w.nth + 1))
SELECT r.report_id, chunk_index::INT AS chunk_index, extraction_text, page, title AS heading FROM ready r JOIN walk w ON w.report_id = r.report_id AND w.nth = r.nth LEFT JOIN sides s ON s.report_id = w.report_id AND s.page_seq = w.found""")
def grounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents, changed or not, grounded on the pages of its report."""
    pages = segment.split_pages_grounding(corpus.seeded_reports(spark, sf_dir))
    return entities.ground_entities(_line_entities(spark, sf_dir), pages).drop("position")



@query(f"WITH {_GROUND_SQL}, kept AS (SELECT * FROM made WHERE text <> '' AND page IS NOT NULL) SELECT report_id, count(DISTINCT page) AS pages_detected FROM kept GROUP BY 1")
def detected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.pages_detected(segment.split_pages_grounding(corpus.seeded_reports(spark, sf_dir)).where("page is not null"))


def _span_sql(mark: str) -> str:
    return f"array_to_string(list_transform(list(struct_pack(page := page, text := text) ORDER BY page), lambda p: concat('{mark}', p.page::VARCHAR, '{{}}', p.text)), chr(10) || chr(10))"


@query(f"""WITH {_INTAKE_PAGES_SQL} SELECT report_id, {_span_sql("--- Page ").replace("'{}'", "' ---' || chr(10)")} AS text, count(*)::INT AS page_count FROM intake_pages GROUP BY 1""")
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.merge_pages(segment.split_pages_intake(corpus.seeded_reports(spark, sf_dir)).drop("page_seq"))


@query(f"""WITH {_INTAKE_PAGES_SQL} SELECT report_id, {_span_sql("### Page ").replace("'{}'", "chr(10)")} AS text FROM intake_pages WHERE page BETWEEN 2 AND 4 AND text <> '' GROUP BY 1""")
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.restrict_pages(segment.split_pages_intake(corpus.seeded_reports(spark, sf_dir)), 2, 4)


@query("""WITH t AS (SELECT doc_id, string_split(concat('before', chr(10), 'Page 1:', chr(10), replace(coalesce(text, ''), chr(10), concat(chr(10), 'Page 2:', chr(10)))), concat(chr(10), 'Page ')) AS parts FROM documents),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS seq FROM t)
SELECT doc_id, seq::INT AS seq, left(part, 1)::INT AS page, regexp_replace(substr(part, 4), '^\\s+|\\s+$', '', 'g') AS text FROM p WHERE seq > 0""".replace("\\\\", "\\"))
def context_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("before\nPage 1:\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\nPage 2:\n")))
    rows = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), text.alias("text"))
    return segment.split_context_pages(rows).withColumnRenamed("report_id", "doc_id")


# Intake choices


@query(f"""{_PAGE_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page) AS a, row_number() OVER (PARTITION BY report_id ORDER BY page DESC) AS z, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, page) AS s FROM page_scores)
SELECT report_id, page, score FROM r WHERE a <= 5 OR s <= 18 OR z <= 3""")
def pages_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.review_pages(written(_whole_scores(spark, sf_dir))).select("report_id", "page", "score")


@query(f"""{_PAGE_SCORES}, r AS (SELECT p.report_id, p.page, substr({_sql_collapse("text")}, 1, 450) AS long, substr({_sql_collapse("text")}, 1, 420) AS short, row_number() OVER (PARTITION BY p.report_id ORDER BY p.page) AS a, row_number() OVER (PARTITION BY p.report_id ORDER BY score DESC, p.page) AS s FROM page_scores p JOIN pages0 t USING (report_id, page))
SELECT report_id, page, CASE WHEN a <= 8 THEN long ELSE short END AS snippet FROM r WHERE a <= 8 OR s <= 8""")
def snippets_for_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = written(segment.split_pages_intake(corpus.seeded_reports(spark, sf_dir)).drop("page_seq"))
    return intake.metadata_snippets(pages, written(intake.score_pages(pages)))


_HEURISTIC = f"""{_SPANS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY rank DESC, "start") AS nth FROM spans) WHERE nth = 1),
totals AS (SELECT report_id, count(*) AS total_pages, sum(positive) - sum(negative) AS raw, count(*) FILTER (is_candidate) AS candidates, len(list_distinct(flatten(list(hit_keys)))) AS breadth FROM page_scores GROUP BY 1),
heuristic AS (SELECT t.report_id, total_pages, "start", "end", (raw >= 80 AND breadth >= 5 AND candidates >= greatest(3, floor(total_pages * 0.06))) AS yes, coalesce(pages / greatest(1, total_pages) >= 0.72 AND candidates / greatest(1, total_pages) >= 0.6, false) AS is_only FROM totals t LEFT JOIN best b USING (report_id)),
model AS (SELECT concat('report-', doc_id::VARCHAR) AS report_id, doc_id % 2 = 0 AS model_yes, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 10) / 10.0 END AS confidence, (doc_id % 15)::INT AS model_start, (doc_id % 7)::INT AS model_end, doc_id % 8 = 0 AS model_only FROM documents WHERE doc_id % 5 <> 0),
pick AS (SELECT h.*, m.model_yes, m.confidence, m.model_only, coalesce(CASE WHEN model_start BETWEEN 1 AND total_pages THEN model_start END, "start", 1) AS s, coalesce(CASE WHEN model_end BETWEEN 1 AND total_pages THEN model_end END, "end", total_pages) AS e FROM heuristic h LEFT JOIN model m USING (report_id)),
verdicts AS (SELECT report_id, total_pages, yes OR (coalesce(model_yes, false) AND (confidence IS NULL OR confidence >= 0.55)) AS accepted, least(s, e)::BIGINT AS range_start, greatest(s, e)::BIGINT AS range_end, NOT (is_only OR coalesce(model_only, false)) AS full_upload FROM pick)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = written(_whole_scores(spark, sf_dir).drop("snippet"))
    d = F.col("doc_id")
    model = _read(spark, sf_dir, "documents").where(d % 5 != 0).select(
        F.concat(F.lit("report-"), d.cast("string")).alias("report_id"), (d % 2 == 0).alias("model_yes"), F.when(d % 3 != 0, (d % 10) / 10.0).alias("confidence"),
        (d % 15).cast("int").alias("model_start"), (d % 7).cast("int").alias("model_end"), (d % 8 == 0).alias("model_only"),
    )
    rows = intake.combine_verdict(intake.intake_verdict(scores, intake.candidate_spans(scores)), model)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("range_start", "range_end")})


@query(f"{_HEURISTIC} SELECT * FROM verdicts")
def combined_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("report_id", "total_pages", "accepted", "range_start", "range_end", "full_upload")


@query(f"""{_HEURISTIC}, u AS (SELECT concat('report-', doc_id::VARCHAR) AS report_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 12 + 1 END AS us, CASE WHEN doc_id % 6 = 0 THEN doc_id % 9 + 1 END AS ue FROM documents WHERE doc_id % 2 = 0),
x AS (SELECT v.report_id AS token, total_pages, full_upload, coalesce(us, range_start, 1) AS s, coalesce(ue, range_end, total_pages) AS e FROM verdicts v LEFT JOIN u USING (report_id))
SELECT token, least(s, e) AS page_start, greatest(s, e) AS page_end, full_upload AND greatest(s, e) - least(s, e) + 1 < floor(total_pages * 0.92) AS extract FROM x""")
def upload_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _verdicts(spark, sf_dir).select(F.col("report_id").alias("token"), "total_pages", "full_upload", F.col("range_start").alias("suggested_start"), F.col("range_end").alias("suggested_end"))
    d = F.col("doc_id")
    options = _read(spark, sf_dir, "documents").where(d % 2 == 0).select(F.concat(F.lit("report-"), d.cast("string")).alias("token"), F.when(d % 4 == 0, d % 12 + 1).alias("user_start"), F.when(d % 6 == 0, d % 9 + 1).alias("user_end"))
    return intake.decide_range(staged, options).select("token", "page_start", "page_end", "extract")


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'extension' WHEN doc_id % 11 = 0 THEN 'type' WHEN n_chars < 1024 THEN 'too_small' WHEN doc_id % 7 = 0 THEN 'signature' WHEN doc_id % 700 > 600 THEN 'too_many_pages' WHEN length(coalesce(text, '')) < 3000 THEN 'too_little_text' END AS rejected FROM documents""".replace("< 3000", "< 300"))
def rejected_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    files = _read(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 13 == 0, "a.txt").otherwise("A.PDF").alias("name"), F.when(d % 11 == 0, "text/html").otherwise("application/pdf").alias("content_type"), F.col("n_chars").alias("size"),
        (d % 7 != 0).alias("has_signature"), (d % 700).alias("page_count"), F.length(F.coalesce("text", F.lit(""))).alias("text_chars"),
    )
    return intake.validate_uploads(files).select("doc_id", "rejected")


@query("""SELECT 'catalogue' AS "table", count(*) FILTER (doc_id % 6 = 0) AS removed FROM documents UNION ALL SELECT 'chunks', 4 * count(*) FILTER (doc_id % 6 = 0) FROM documents""")
def purged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = corpus.catalogue(spark, sf_dir).where("doc_id % 6 = 0").select("report_id")
    _, counts = intake.purge_reports(gone, {"catalogue": (_index(spark, sf_dir), "report_id"), "chunks": (corpus.predictions(spark, sf_dir), "k")})
    return counts


@query(f"{_CATALOGUE} SELECT report_id FROM catalogue WHERE doc_id % 6 <> 0")
def left_after_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = corpus.catalogue(spark, sf_dir).where("doc_id % 6 = 0").select("report_id")
    left, _ = intake.purge_reports(gone, {"catalogue": (_index(spark, sf_dir), "report_id")})
    return left["catalogue"].select("report_id")


# Issues, chunks and entities


_SHARE = {p: f"coalesce(sum(score_sum) FILTER (pillar = '{p}'), 0) / nullif(sum(score_sum), 0)" for p in "ESG"}
_SUMMARY_SQL = f"""{_ISSUED}, sums AS (SELECT k, issue, pillar, sum(score) AS score_sum FROM preds GROUP BY 1, 2, 3),
shares AS (SELECT k, {", ".join(f"{s} AS {p.lower()}" for p, s in _SHARE.items())} FROM sums GROUP BY 1),
tops AS (SELECT k, string_agg(concat(issue, '=', pillar), ',' ORDER BY score_sum DESC, issue) AS issues FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score_sum DESC, issue) AS nth FROM sums) WHERE nth <= {{n}} GROUP BY 1),
cat AS (SELECT doc_id, concat('report-', doc_id::VARCHAR) AS k, concat('Company ', (doc_id % 50)::VARCHAR) AS company FROM documents WHERE doc_id % 7 <> 0)"""


def _issue_line() -> Column:
    return F.array_join(F.transform("top_issues", lambda x: F.concat(x["issue"], F.lit("="), x["pillar"])), ",").alias("issues")


def _partial_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.catalogue(spark, sf_dir).where("doc_id % 7 <> 0").select(F.col("report_id").alias("k"), F.col("doc_id").cast("string").alias("id"), "company")


@query(f"{_SUMMARY_SQL.replace('{n}', '5')} SELECT k, issues, round(e, 6) AS share_e, round(s, 6) AS share_s, round(g, 6) AS share_g, company FROM tops JOIN shares USING (k) LEFT JOIN cat USING (k)")
def issue_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = _issue_preds(spark, sf_dir)
    made = routing.report_issue_summary(routing.issue_totals(preds), routing.pillar_totals(preds), _partial_index(spark, sf_dir).drop("id"))
    return _rounded(made.select("k", _issue_line(), "share_e", "share_s", "share_g", "company"), "share_e", "share_s", "share_g")


@query(f"{_SUMMARY_SQL.replace('{n}', '7')} SELECT doc_id::VARCHAR AS report_id, k AS report_key, round(coalesce(e, 0), 6) AS share_e, round(coalesce(s, 0), 6) AS share_s, issues FROM tops JOIN shares USING (k) JOIN cat USING (k)")
def exported_issue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup written as JSON lines and read back."""
    index = _partial_index(spark, sf_dir)
    made = routing.export_issue_summary(routing.issue_totals(_issue_preds(spark, sf_dir)), index.select("k", "company"))
    path = _fresh(made, "lookup")
    io.export_summary_lookup(made, index.select("k", "id"), path)
    back = io.read_jsonl(spark, path, "report_id string, report_key string, pillar_share map<string,double>, top_issues array<struct<issue:string,score:double,pillar:string>>")
    share = lambda p: F.round(F.col("pillar_share")[p], 6).alias(f"share_{p.lower()}")
    return back.select("report_id", "report_key", share("E"), share("S"), _issue_line())


_CLASS_NAMES = sorted(ENTITY_TO_PILLAR)
_CLASS_SQL = f"classes AS (SELECT * FROM (VALUES {_values([(i, c, ENTITY_TO_PILLAR[c]) for i, c in enumerate(_CLASS_NAMES)])}) AS v(no, class, pillar))"


@query(f"""WITH {_CLASS_SQL}, r AS (SELECT concat('report-', doc_id::VARCHAR) AS report_id, doc_id, unnest([0, 1, 2]) AS position FROM documents WHERE doc_id % 9 <> 8)
SELECT report_id, (doc_id % 4)::INT AS chunk_index, position, class AS extraction_class, concat('item ', doc_id::VARCHAR, '-', position::VARCHAR) AS extraction_text, pillar, (doc_id % 100)::VARCHAR AS amount
FROM r JOIN classes ON no = (doc_id + position) % {len(_CLASS_NAMES)} WHERE position < 2 OR doc_id % 2 = 0""")
def parsed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, bare and broken responses made from every document's id."""
    d = F.col("doc_id")
    classes = F.array(*map(F.lit, _CLASS_NAMES))

    def item(k: int) -> Column:
        name = F.get(classes, ((d + k) % len(_CLASS_NAMES)).cast("int"))
        name = F.when((d % 2 == 0) | F.lit(k < 2), name).otherwise("no such class")
        return F.concat(F.lit('{"class": "'), name, F.lit('", "text": "item '), d.cast("string"), F.lit(f'-{k}", "attrs": {{"amount": '), (d % 100).cast("string"), F.lit("}}"))

    body = F.concat(F.lit("["), F.concat_ws(", ", item(0), item(1), item(2)), F.lit("]"))
    answer = F.when(d % 9 == 8, F.concat(F.lit("no list: "), F.col("lang"))).when(d % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(d % 3 == 1, F.concat(F.lit("Sure, "), body, F.lit(" that is all"))).otherwise(body)
    responses = _read(spark, sf_dir, "documents").select(F.concat(F.lit("report-"), d.cast("string")).alias("report_id"), (d % 4).cast("int").alias("chunk_index"), answer.alias("response"))
    return entities.parse_entities(responses).withColumn("amount", F.col("attributes")["amount"]).drop("attributes")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE doc_id % 100 END AS score, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS band FROM documents""")
def parsed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    obj = F.concat(F.lit('{"score": '), (d % 100).cast("string"), F.lit(', "band": "'), F.when(d % 2 == 0, "high").otherwise("low"), F.lit('"}'))
    text = F.when(d % 5 == 0, obj).when(d % 5 == 1, F.concat(F.lit("x ```json\n"), obj, F.lit("\n``` y"))).when(d % 5 == 2, F.concat(F.lit("I think "), obj, F.lit(" fits"))).when(d % 5 == 3, F.concat(F.lit(" "), obj, F.lit("\n"))).otherwise(F.col("text"))
    found = _read(spark, sf_dir, "documents").select("doc_id", entities.parse_json_object(F.when(d % 5 == 4, F.concat(F.lit("none: "), F.coalesce("lang", F.lit("")))).otherwise(text), "score bigint, band string").alias("o"))
    return found.select("doc_id", "o.score", "o.band")


@query(f"""{_ENTITIES}, p AS (SELECT k AS report_id, chunk AS chunk_index, CASE WHEN chunk % 2 = 0 THEN 'E' ELSE 'S' END AS rp, round(score, 6) AS rs FROM ({PREDICTIONS_SQL.replace("0E0", "0E0").replace("AS string", "AS VARCHAR")}))
SELECT e.report_id, e.chunk_index, e.position, e.extraction_text, rp AS routed_pillar, rs AS route_score, company, year FROM entities e LEFT JOIN p USING (report_id, chunk_index) LEFT JOIN (SELECT report_id, company, year FROM ({CATALOGUE_SQL}) WHERE doc_id % 4 <> 0) USING (report_id)""")
def routed_entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = corpus.predictions(spark, sf_dir).select(F.col("k").alias("report_id"), F.col("chunk").cast("int").alias("chunk_index"), F.when(F.col("chunk") % 2 == 0, "E").otherwise("S").alias("pillar"), F.lit("c").alias("category"), "score")
    known = corpus.catalogue(spark, sf_dir).where("doc_id % 4 <> 0").select("report_id", "company", "year")
    rows = entities.entity_rows(entities.attach_route(corpus.entities(spark, sf_dir), preds), known)
    return _rounded(rows.select("report_id", "chunk_index", "position", "extraction_text", "routed_pillar", "route_score", "company", "year"), "route_score")


@query(f"{_CATALOGUE} SELECT report_id, doc_id % 4 = 1 AS done FROM catalogue")
def entity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.catalogue(spark, sf_dir)
    done = corpus.entities(spark, sf_dir).join(known.where("doc_id % 4 = 1").select("report_id"), "report_id")
    return entities.entity_status(known.select("report_id"), done)


@query(f"{_ENTITIES} SELECT report_id, chunk_index, extraction_text FROM entities WHERE pillar = 'E' AND extraction_class = 'water' AND contains(lower(concat(extraction_class, ' ', extraction_text)), 'figure 3')")
def found_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.filter_entities(corpus.entities(spark, sf_dir), "E", "water", " Figure 3").select("report_id", "chunk_index", "extraction_text")


_SUPPORT = [(i, c) for i, cs in ISSUE_TO_ENTITIES.items() for c in cs]


@query(f"""{_ISSUED}, ents AS ({ENTITIES_SQL}), of_issue AS (SELECT * FROM (VALUES {_values(_SUPPORT)}) AS v(issue, extraction_class)),
t AS (SELECT * FROM (SELECT k, issue, row_number() OVER (PARTITION BY k ORDER BY sum(score) DESC, issue) AS rank FROM preds GROUP BY 1, 2) WHERE rank <= 7), n AS (SELECT report_id AS k, extraction_class, count(*) AS n FROM ents GROUP BY 1, 2)
SELECT k, rank::INT AS rank, issue, coalesce(sum(n), 0)::BIGINT AS support FROM t LEFT JOIN of_issue USING (issue) LEFT JOIN n USING (k, extraction_class) GROUP BY 1, 2, 3""")
def supported_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.issue_support(routing.issue_totals(_issue_preds(spark, sf_dir)), corpus.entities(spark, sf_dir))


@query(f"""{_ISSUED}, r AS (SELECT count(DISTINCT k) AS n, count(*) AS m FROM preds WHERE pillar IN ('E', 'S', 'G')) SELECT greatest(1, ceil(n * 0.1))::BIGINT AS eval_reports, n - greatest(1, ceil(n * 0.1))::BIGINT AS train_reports, m AS rows, 0 AS reports_in_both FROM r""")
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.pseudo_label_split(_issue_preds(spark, sf_dir).withColumn("pillar", routing.lookup(ISSUE_TO_PILLAR, F.col("issue"))))
    by = rows.groupBy("k").agg(F.max((F.col("split") == "eval").cast("int")).alias("e"), F.max((F.col("split") == "train").cast("int")).alias("t"), F.count("*").alias("n"))
    return by.agg(F.sum("e").alias("eval_reports"), F.sum("t").alias("train_reports"), F.sum("n").alias("rows"), F.sum(F.col("e") * F.col("t")).cast("int").alias("reports_in_both"))


_F1 = ", ".join(f"coalesce(2e0 * count(*) FILTER (a = {c} AND b = {c}) / nullif(count(*) FILTER (a = {c}) + count(*) FILTER (b = {c}), 0), 0) AS f{c}" for c in range(3))


@query(f"SELECT round(acc, 6) AS accuracy, round((f0 + f1 + f2) / 3, 6) AS macro_f1 FROM (SELECT count(*) FILTER (a = b) / count(*) AS acc, {_F1} FROM (SELECT doc_id % 3 AS a, (doc_id * 7 // 5) % 3 AS b FROM documents))")
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return _rounded(routing.classification_metrics(_read(spark, sf_dir, "documents").select((d % 3).alias("label_id"), (F.floor(d * 7 / 5) % 3).alias("pred_id"))), "accuracy", "macro_f1")


def _word_scorer(texts: list[str]) -> list[list[tuple[str, float]]]:
    """Stands for a model: scores from the lengths of text and first word."""
    return [[("Climate Change", (len(t) % 97) / 97), ("Human Capital", (len(t.split(" ")[0]) % 7) / 7)] for t in texts]


@query(rf"""WITH c AS (SELECT doc_id, {_sql_collapse("coalesce(text, '')")} AS c FROM documents), t AS (SELECT doc_id, CASE WHEN length(c) <= 1200 THEN c WHEN length(regexp_extract(substr(c, 1, 1202), '^(.*[.]) ', 1)) - 1 > 720 THEN regexp_extract(substr(c, 1, 1202), '^(.*[.]) ', 1) ELSE substr(c, 1, 1200) END AS t FROM c),
s AS (SELECT doc_id, (length(t) % 97) / 97 AS a, (length(string_split(t, ' ')[1]) % 7) / 7 AS b FROM t)
SELECT doc_id, round(a, 6) AS climate, round(b, 6) AS human, round(exp(a) / (exp(a) + exp(b)), 6) AS climate_share, CASE WHEN b > a THEN 'Human Capital' WHEN a > 0 THEN 'Climate Change' ELSE 'Non-ESG' END AS best FROM s""")
def classified_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routing.classify_chunks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _word_scorer)
    score = lambda i: F.get("scores", F.lit(i))["score"]
    made = rows.select("doc_id", score(0).alias("climate"), score(1).alias("human"), F.get(routing.softmax(F.transform("scores", lambda s: s["score"])), F.lit(0)).alias("climate_share"), routing.argmax(F.col("scores"))["label"].alias("best"))
    return _rounded(made, "climate", "human", "climate_share")


@query(f"""WITH {_INTAKE_PAGES_SQL} SELECT report_id, 'c' AS company, 2020 AS year, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM intake_pages GROUP BY 1""")
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = segment.split_pages_intake(corpus.seeded_reports(spark, sf_dir))
    return routing.page_profile(pages.withColumns({"company": F.lit("c"), "year": F.lit(2020)}))


# Retrieval


@query("""SELECT query_id, string_agg(concat('Page ', page::VARCHAR, ': ', t), chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT vec_id - vec_id % 50 AS query_id, vec_id % 50 + 1 AS rank, vec_id % 7 + 1 AS page, concat('chunk ', vec_id::VARCHAR, ' of ', label::VARCHAR) AS t FROM embeddings WHERE vec_id % 50 < 6) GROUP BY 1""")
def query_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    rows = _read(spark, sf_dir, "embeddings")
    text = F.concat(F.lit(" chunk "), v.cast("string"), F.lit(" of "), F.col("label").cast("string"))
    vectors = rows.select(v.cast("string").alias("id"), (v % 7 + 1).alias("page"), text.alias("text"))
    hits = rows.where("vec_id % 50 < 6").select((v - v % 50).alias("query_id"), (v % 50 + 1).alias("rank"), v.cast("string").alias("id"))
    return retrieval.retrieved_context(hits, vectors)


@query("SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 0 END AS chunk FROM embeddings UNION ALL SELECT concat('new-', vec_id::VARCHAR), 2 FROM embeddings WHERE vec_id % 3 = 0")
def upserted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("vec_id").cast("string").alias("id"))
    some = v.where("vec_id % 3 = 0")
    new = some.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("chunk")).unionByName(some.select(F.concat(F.lit("new-"), "id").alias("id"), F.lit(2).alias("chunk")))
    return retrieval.upsert_vectors(v.select("id", F.lit(0).alias("chunk")), new)


@query(f"{_CATALOGUE} SELECT report_id FROM catalogue WHERE doc_id % 5 >= 2")
def reports_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.catalogue(spark, sf_dir)
    markers = known.where("doc_id % 5 < 2").select("report_id", F.when(F.col("doc_id") % 5 == 0, "done").otherwise("error").alias("status"))
    return retrieval.pending_index(known.select("report_id"), markers)


def _length_embedder(texts: list[str]) -> list[list[float]]:
    """Stands for a model: no vector for texts that begin with a small vowel."""
    return [[] if t[:1] in "aeiou" else [float(len(t)), 1.0] for t in texts]


# Catalogue


@query(f"{_CATALOGUE}, r AS (SELECT concat('report-', (doc_id % 300)::VARCHAR) AS report_id, doc_id, doc_id % 1000 AS created_at FROM catalogue) SELECT report_id, arg_max(doc_id, created_at * 1000000 + doc_id) AS doc_id, max(created_at * 1000000 + doc_id) AS created_at FROM r GROUP BY 1")
def newest_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = corpus.catalogue(spark, sf_dir).select(F.concat(F.lit("report-"), (d % 300).cast("string")).alias("report_id"), "doc_id", (d % 1000 * 1_000_000 + d).alias("created_at"))
    return catalog.latest_uploads(rows)


_SORTED = f"{_SCORED}, j AS (SELECT c.report_id, c.company, c.year, s.score FROM catalogue c LEFT JOIN scored s USING (report_id))"


def _sortable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("report_id", "company", "year").join(corpus.scored_rows(spark, sf_dir).select("report_id", "score"), "report_id", "left")


@query(f"{_SORTED} SELECT * FROM j ORDER BY coalesce(score, -1) DESC, year DESC NULLS LAST, lower(company), report_id LIMIT 100")
def sorted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred rows in a sort order."""
    return catalog.sort_reports(_sortable(spark, sf_dir), "score", True).limit(100)


@query(f"{_SORTED} SELECT * FROM j ORDER BY report_id LIMIT 50 OFFSET 100")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_of(_sortable(spark, sf_dir), [F.col("report_id")], 3, 50)


@query(f"{_CATALOGUE} SELECT report_id FROM catalogue WHERE doc_id % 50 = 7 AND year = 2019")
def reports_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.catalogue(spark, sf_dir).select("report_id", F.concat(F.lit("Company-"), (F.col("doc_id") % 50).cast("string"), F.lit("-"), F.col("year").cast("string"), F.when(F.col("doc_id") % 2 == 0, "-u12345").otherwise("")).alias("slug"))
    return catalog.find_by_slug(rows, "company-7-2019-u99999").select("report_id")


@query(f"{_CATALOGUE} SELECT report_id FROM catalogue WHERE doc_id % 3 = 1 ORDER BY report_id LIMIT 120")
def scoped_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.catalogue(spark, sf_dir)
    return catalog.run_scope(known.select("report_id"), known.where("doc_id % 3 = 1")).select("report_id")


@query(f"{_UPLOADS}, m AS (SELECT CASE WHEN i.report_id IS NULL THEN 'uploaded' WHEN u.report_id IS NULL THEN 'index' ELSE 'merged' END AS origin FROM catalogue i FULL OUTER JOIN uploads u ON u.report_id = i.report_id) SELECT origin, count(*) AS n FROM m GROUP BY 1")
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.source_breakdown(catalog.merge_catalogue(_index(spark, sf_dir), corpus.uploads(spark, sf_dir)))


_STATES = ["idle", "queued", "running", "success", "error"]


@query("SELECT s AS status, count(d.doc_id) AS n FROM (VALUES ('idle'), ('queued'), ('running'), ('success'), ('error')) AS t(s) LEFT JOIN (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'success' WHEN 2 THEN 'error' ELSE 'idle' END AS st FROM documents) d ON d.st = s GROUP BY 1")
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 4
    return analytics.status_breakdown(_read(spark, sf_dir, "documents").select(F.when(d == 0, "queued").when(d == 1, "success").when(d == 2, "error").alias("status")), _STATES)


# Depth and evidence by category, on hits and quotes made from ids

_DISPLAY = [(c, k, i, len(rules)) for i, (c, rules) in enumerate(DISPLAY_CATEGORIES.items()) for k in rules]
_KEYS = sorted({k for _, k, _, _ in _DISPLAY})
_HITS = f"""keys AS (SELECT * FROM (VALUES {_values(list(enumerate(_KEYS)))}) AS v(no, feature_key)), hits AS (SELECT concat('report-', doc_id::VARCHAR) AS report_id, feature_key, (doc_id + no) % 3 <> 0 AS found, (doc_id * 5 + no) % 40 AS occurrences, (doc_id + 2 * no) % 9 AS pages FROM documents JOIN keys ON (doc_id + no) % 4 = 0)"""
_QUOTES = """quotes AS (SELECT concat('report-', doc_id::VARCHAR) AS report_id, feature_key, rank, doc_id % 9 AS page, concat('Heading ', (doc_id % 3)::VARCHAR) AS heading, concat('quote ', rank::VARCHAR, ' of ', doc_id::VARCHAR, ': ', left(coalesce(text, ''), 80)) AS text FROM documents JOIN keys ON (doc_id + no) % 5 = 0 JOIN (VALUES (1), (2), (3), (4)) AS r(rank) ON rank <= 1 + (doc_id + no) % 4)"""


def _keyed(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    d, no = F.col("doc_id"), F.col("no")
    keys = F.explode(F.transform(F.array(*map(F.lit, _KEYS)), lambda k, i: F.struct(i.alias("no"), k.alias("feature_key"))))
    return _read(spark, sf_dir, "documents").select("doc_id", "text", keys.alias("k")).select("doc_id", "text", "k.*").where((d + no) % step == 0).withColumn("report_id", F.concat(F.lit("report-"), d.cast("string")))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, no = F.col("doc_id"), F.col("no")
    return _keyed(spark, sf_dir, 4).select("report_id", "feature_key", ((d + no) % 3 != 0).alias("found"), ((d * 5 + no) % 40).alias("occurrences"), ((d + 2 * no) % 9).alias("pages"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, no = F.col("doc_id"), F.col("no")
    ranks = _keyed(spark, sf_dir, 5).withColumn("rank", F.explode(F.sequence(F.lit(1), (1 + (d + no) % 4).cast("int"))))
    text = F.concat(F.lit("quote "), F.col("rank").cast("string"), F.lit(" of "), d.cast("string"), F.lit(": "), F.left(F.coalesce("text", F.lit("")), F.lit(80)))
    return ranks.select("report_id", "feature_key", "rank", (d % 9).alias("page"), F.concat(F.lit("Heading "), (d % 3).cast("string")).alias("heading"), text.alias("text"))


_TIERS = {"deep": "pages >= 5", "medium": "pages >= 3 AND pages < 5", "light": "pages >= 1 AND pages < 3"}


@query(f"""WITH {_HITS}, cats AS (SELECT * FROM (VALUES {_values(_DISPLAY)}) AS v(category, feature_key, position, total))
SELECT report_id, category, position, count(*) AS found, {", ".join(f"count(*) FILTER ({t}) AS {k}" for k, t in _TIERS.items())}, total, floor(count(*) * 100.0 / total + 0.5)::BIGINT AS coverage_pct FROM hits JOIN cats USING (feature_key) WHERE found GROUP BY report_id, category, position, total""")
def category_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.category_coverage(_hits(spark, sf_dir))


_EVIDENCE = [(c, k, i, label) for i, (c, rules) in enumerate(EVIDENCE_CATEGORIES.items()) for k, label in rules.items()]


@query(f"""WITH {_HITS}, {_QUOTES}, cats AS (SELECT * FROM (VALUES {_values(_EVIDENCE)}) AS v(category, feature_key, position, label))
SELECT report_id, position, category, feature_key, label, string_agg(text, '|' ORDER BY rank) AS quotes FROM quotes JOIN cats USING (feature_key) WHERE rank <= 3 GROUP BY 1, 2, 3, 4, 5""")
def category_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.evidence_by_category(_quotes(spark, sf_dir)).withColumn("quotes", F.array_join("quotes", "|"))


@query(f"""WITH {_HITS}, {_QUOTES}, n AS (SELECT report_id, feature_key, count(*) AS quotes FROM quotes GROUP BY 1, 2)
SELECT report_id, feature_key, coalesce(found, false) AS found, coalesce(occurrences, 0) AS occurrences, coalesce(pages, 0) AS pages, coalesce(quotes, 0) AS quotes FROM hits FULL OUTER JOIN n USING (report_id, feature_key) WHERE found OR occurrences > 0 OR pages > 0 OR quotes > 0""")
def rule_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.rule_depth_rows(_hits(spark, sf_dir), _quotes(spark, sf_dir)).drop("label")


@query(f"""WITH {_HITS}, {_QUOTES}, n AS (SELECT report_id, feature_key, count(*) AS c, count(DISTINCT page) AS p, string_agg(text, '|' ORDER BY rank) FILTER (rank <= 6) AS q FROM quotes GROUP BY 1, 2)
SELECT report_id, feature_key, coalesce(found, c > 0) AS found, coalesce(occurrences, c) AS occurrences, coalesce(pages, p) AS pages, coalesce(q, '') AS quotes, coalesce(c, 0) AS quote_count FROM hits FULL OUTER JOIN n USING (report_id, feature_key)""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.provenance_rows(_hits(spark, sf_dir), _quotes(spark, sf_dir)).withColumn("quotes", F.array_join("quotes", "|")).drop("label")


# Scores


@query(f"""{_SCORED} SELECT report_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE score::DOUBLE END AS score, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE band END AS band, CASE WHEN doc_id % 6 IN (4, 5) THEN NULL ELSE completeness::DOUBLE END AS completeness, company, year FROM scored WHERE doc_id % 6 <> 5""")
def parsed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scoring.parse_score_json(_score_json(spark, sf_dir), _index(spark, sf_dir))
    return made.select("report_id", "score", "band", F.col("subscores.completeness").alias("completeness"), "company", "year")


def _score_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as stored: numbers as strings, parts missing, some broken."""
    d = F.col("doc_id")
    subs = F.struct(*[F.col(c).cast("string").alias(c) for c in ("completeness", "consistency", "assurance")], F.when(d % 6 != 4, F.col("transparency").cast("string")).alias("transparency"))
    record = F.to_json(F.struct(F.col("score").cast("string").alias("score"), "band", subs.alias("subscores"), F.struct(F.col("report_id").alias("id")).alias("report")))
    return corpus.scored_rows(spark, sf_dir).select("report_id", F.when(d % 6 == 5, "broken").otherwise(record).alias("json"))


@query(f"{_SCORED} SELECT c.report_id, CASE WHEN s.report_id IS NULL THEN 'missing' WHEN c.doc_id % 6 = 5 THEN 'error' ELSE 'ok' END AS status FROM catalogue c LEFT JOIN scored s USING (report_id)")
def fetched_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fetch_scores(_index(spark, sf_dir).select("report_id"), _score_json(spark, sf_dir)).select("report_id", "status")


@query(f"{_SCORED} SELECT 1 AS version, report_id, score, band, completeness, consistency, assurance, transparency FROM scored")
def score_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_summary(corpus.scored_rows(spark, sf_dir).withColumn("version", F.lit(1)))


# Sources and sinks: written to the shared folder and read back


@query("SELECT doc_id, text, lang, source FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = _fresh(docs, "jsonl")
    io.write_jsonl(docs, path)
    return io.read_jsonl(spark, path, docs.schema)


def _array_files(rows: DataFrame, path: str) -> None:
    """``g, doc_id, json``: a JSON array of the rows of each ``g`` as one file."""
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "json"))), lambda x: x["json"]), ","), F.lit("]"))
    rows.groupBy("g").agg(body.alias("value")).write.partitionBy("g").option("compression", "none").text(path)


@query(f"{_CATALOGUE} SELECT report_key AS k, report_id AS id, company AS c, year AS y FROM catalogue WHERE doc_id % 7 <> 0")
def report_index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index files of a hundred rows and a repeated key each; rows without a key are dropped."""
    known = corpus.catalogue(spark, sf_dir)
    key = F.when(F.col("doc_id") % 7 != 0, F.col("report_key"))
    row = lambda c: F.to_json(F.struct(F.col("report_id").alias("id"), c.alias("c"), key.alias("k"), F.col("year").alias("y")))
    twice = F.concat(row(F.lit("older")), F.lit(","), row(F.col("company")))
    path = _fresh(known, "index")
    _array_files(known.select("doc_id", F.floor(F.col("doc_id") / 100).alias("g"), twice.alias("json")), path)
    return io.read_report_index(spark, path).select("k", "id", "c", "y")


@query(f"{_CATALOGUE} SELECT report_id, company, year, report_key, CASE WHEN doc_id % 2 = 0 THEN 'abc' END AS sha256 FROM catalogue WHERE doc_id % 5 <> 0")
def upload_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files; records without a slug are left out."""
    known = corpus.catalogue(spark, sf_dir)
    d = F.col("doc_id")
    report = F.struct(F.col("report_id").alias("id"), F.when(d % 5 != 0, "slug").alias("slug"), "company", F.col("year").alias("publishedYear"), F.col("report_key").alias("reportKey"))
    record = F.to_json(F.struct(F.lit("2024-01-02T03:04:05Z").alias("createdAt"), report.alias("report"), F.struct(F.when(d % 2 == 0, "abc").alias("sha256")).alias("file")))
    path = _fresh(known, "uploads")
    body = F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]"))
    known.select(F.floor(d / 100).alias("g"), record.alias("json")).groupBy("g").agg(body.alias("value")).write.partitionBy("g").option("compression", "none").text(path)
    return io.read_upload_records(spark, path, "*.txt").select("report_id", "company", "year", "report_key", "sha256")


@query(f"{_SCORED} SELECT report_id, CASE WHEN doc_id % 4 = 0 THEN score + 1 ELSE score END AS score, 1 AS version FROM scored UNION ALL SELECT report_id, score, 2 FROM scored WHERE doc_id % 10 = 0")
def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two versions, some keys replaced, as written by the second call."""
    rows = corpus.scored_rows(spark, sf_dir).select("doc_id", "report_id", "score", F.lit(1).alias("version"))
    path = _fresh(rows, "scores")
    rows = written(rows)
    io.write_scores(rows.select("report_id", "score", "version"), path)
    changed = rows.where("doc_id % 4 = 0").withColumn("score", F.col("score") + 1).unionByName(rows.where("doc_id % 10 = 0").withColumn("version", F.lit(2)))
    changed = changed.select("report_id", "score", "version")
    for _ in range(2):  # a batch that is written again leaves the same table
        io.write_scores(changed, path, 1)
    return buckets.read_buckets(spark, path, changed.schema)


@query(f"{_ENTITIES} SELECT report_id, chunk_index, CASE WHEN CAST(replace(report_id, 'report-', '') AS BIGINT) % 4 = 0 THEN 'new' ELSE extraction_text END AS extraction_text, 1 AS version FROM entities")
def stored_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.entities(spark, sf_dir).select("report_id", "chunk_index", "extraction_text", F.lit(1).alias("version"))
    path = _fresh(rows, "entities")
    io.write_entities(rows, path)
    changed = rows.where("cast(replace(report_id, 'report-', '') as bigint) % 4 = 0").withColumn("extraction_text", F.lit("new"))
    io.write_entities(changed, path)
    return buckets.read_buckets(spark, path, rows.schema)


_EXPORT = [*"report_id company country sector industry year report_key score band completeness consistency assurance transparency".split()]


def _exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.scored_rows(spark, sf_dir).withColumns({"industry": F.lit(None).cast("string"), "company": F.concat("company", F.lit(' "X", Ltd'))}).select(*_EXPORT)


@query(f"""{_SCORED} SELECT report_id, concat(company, ' "X", Ltd') AS company, country, coalesce(sector, '') AS sector, '' AS industry, year::VARCHAR AS year, score::VARCHAR AS score, band, completeness::VARCHAR AS completeness, consistency::VARCHAR AS consistency, assurance::VARCHAR AS assurance, transparency::VARCHAR AS transparency, report_key FROM scored""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _exportable(spark, sf_dir)
    path = _fresh(rows, "csv")
    io.export_scored_csv(rows, path)
    back = spark.read.csv(path, header=True, quote='"', escape='"', nullValue="\u0000", emptyValue="")
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in io.CSV_COLUMNS])


@query(f"""{_SCORED} SELECT report_id, concat(company, ' "X", Ltd') AS company, sector, score, completeness, transparency FROM scored""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _exportable(spark, sf_dir)
    path = _fresh(rows, "json")
    io.export_scored_json(rows, path)
    kinds = "report_id string, company string, sector string, score int, subscores struct<completeness:int,transparency:int>"
    return io.read_jsonl(spark, path, kinds).select("report_id", "company", "sector", "score", "subscores.completeness", "subscores.transparency")


@query(f"{_SCORED} SELECT report_id, run, true AS ok, score FROM scored JOIN (VALUES (1), (2)) AS r(run) ON run = 1 OR doc_id % 2 = 0")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.scored_rows(spark, sf_dir).select("doc_id", "report_id", F.lit(True).alias("ok"), "score")
    path = _fresh(rows, "log")
    io.append_run_log(rows.withColumn("run", F.lit(1)).drop("doc_id"), path)
    io.append_run_log(rows.where("doc_id % 2 = 0").withColumn("run", F.lit(2)).drop("doc_id"), path)
    return io.read_jsonl(spark, path, "report_id string, run int, ok boolean, score int")


@query("SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND false UNION ALL SELECT doc_id, trim(regexp_replace(concat('Café Ñandú ', doc_id::VARCHAR), '\\s+', ' ', 'g')) FROM documents".replace("\\\\", "\\"))
def mended_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names read as Latin-1 by mistake, mended."""
    name = F.concat(F.lit("Café  Ñandú ".encode().decode("latin-1")), F.col("doc_id").cast("string"))
    return _read(spark, sf_dir, "documents").select("doc_id", repair_mojibake(name).alias("text"))


# Quotes for an outside rewrite


_ORDERED = [(k, i) for i, k in enumerate(RULE_KEYS) if k in set(_KEYS)]


@query(f"""WITH {_HITS}, {_QUOTES}, pos AS (SELECT * FROM (VALUES {_values(_ORDERED)}) AS v(feature_key, position)), n AS (SELECT q.*, dense_rank() OVER (PARTITION BY report_id ORDER BY position) AS nth FROM quotes q JOIN pos USING (feature_key))
SELECT report_id, feature_key, rank, page, left(text, 60) AS text FROM n WHERE nth <= 5 AND rank <= 2""")
def quote_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.quote_batch(_quotes(spark, sf_dir), 5, 2, 60)


@query(f"""WITH {_HITS}, {_QUOTES}, new AS (SELECT report_id, feature_key, rank, concat('rewritten ', text) AS text, page, heading FROM quotes WHERE rank <= 2 AND page % 2 = 0), has AS (SELECT DISTINCT report_id, feature_key FROM new)
SELECT report_id, feature_key, rank, page, heading, text, false AS refined FROM quotes WHERE (report_id, feature_key) NOT IN (SELECT (report_id, feature_key) FROM has) UNION ALL SELECT report_id, feature_key, rank, page, heading, text, true FROM new""")
def refined_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = _quotes(spark, sf_dir)
    none = F.lit(None)
    new = quotes.where("rank <= 2 and page % 2 = 0").withColumns({"text": F.concat(F.lit("rewritten "), "text"), "page": none.cast("bigint"), "heading": none.cast("string")})
    short = quotes.where("page % 2 = 1").withColumn("text", F.lit("short"))
    return features.merge_refined_quotes(quotes, new.unionByName(short))


# Streams over files, run to their end


def _stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of 300 reports that are written over and over, as files of a folder that is read as a stream."""
    d = F.col("doc_id")
    # event times grow with the id within hours whatever the number of rows, so that no row is later than a watermark of a day in any order of files
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + d)
    rows = corpus.catalogue(spark, sf_dir).select(F.concat(F.lit("report-"), (d % 300).cast("string")).alias("report_id"), "doc_id", at.alias("created_at"), F.concat(F.lit("hash-"), (d % 200).cast("string")).alias("sha256"), (d % 200).alias("upload_id"))
    path = _fresh(rows, "arrivals")
    rows.repartition(6, "doc_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("SELECT concat('report-', (doc_id % 300)::VARCHAR) AS report_id, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def live_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as the stream leaves it, batch after batch."""
    records = _stream_source(spark, sf_dir)
    path = _fresh(records, "catalogue")
    jobs.stream_catalogue(records, path, _fresh(records, "state")).awaitTermination()
    return jobs.read_catalogue(spark, path, records.schema).select("report_id", "doc_id")


@query("SELECT count(DISTINCT doc_id % 300) AS n FROM documents")
def live_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of reports beside the streamed catalogue."""
    records = _stream_source(spark, sf_dir)
    path = _fresh(records, "catalogue")
    jobs.stream_catalogue(records, path, _fresh(records, "state")).awaitTermination()
    return jobs.read_live_count(spark, path)


@query("SELECT DISTINCT concat('hash-', (doc_id % 200)::VARCHAR) AS sha256, doc_id % 200 AS upload_id FROM documents")
def uploads_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated files dropped within a day, far more than the records span."""
    records = _stream_source(spark, sf_dir)
    path, state = _fresh(records, "kept"), _fresh(records, "state")
    kept = jobs.stream_dedupe_uploads(records, "created_at").select("sha256", "upload_id")
    kept.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(kept.schema).parquet(path)
