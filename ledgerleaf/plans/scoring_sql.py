"""DuckDB SQL of the scoring chain: pages, boilerplate, blocks, rule counts, profile and scores of the woven reports."""

from __future__ import annotations

from functools import reduce

from ledgerleaf.functions import text as tx
from ledgerleaf.functions.rules import QUOTES, QUOTES_DEFAULT, RULE_KEYS, RULES, SCOPE3_PATTERNS, SCOPE3_RULE
from ledgerleaf.operators import segment as sg
from ledgerleaf.operators.features import CONTEXT_CHARS, NEIGHBOUR_CHARS, PREFIX_CHARS, QUOTE_CHARS
from ledgerleaf.plans.corpus import CATALOGUE_SQL
from ledgerleaf.plans.reach import _INTAKE_PAGES_SQL, _LINES_SQL, _sql_all, _sql_collapse, _sql_trim, sql_normalize_for_evidence
from ledgerleaf.plans.registry import _PAGES, ORACLES, _plain


def _spaced(col: str) -> str:
    letters = sg._LETTER
    return _sql_trim(_sql_all(col, (rf"([0-9])([{letters}])", "$1 $2"), (rf"([{letters}])([0-9])", "$1 $2"), (rf"{tx.BLANKS}+", " ")))


def _key(spaced: str) -> str:
    return _sql_trim(_sql_all(f"lower({spaced})", (r"\d+", "#"), ("#+", "#")))


def _n(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, '{_plain(pattern)}'))"


_HEAD, _ITEM = _plain(sg._HEADING), _plain(sg._ITEM)
_WRAPPED = _sql_trim(_sql_all("joined", ("-\x01([a-zà-öø-ÿ])", "$1"), ("\x01", " ")))
_PIECE = _sql_trim(_sql_all("coalesce(item, line)", (rf"{tx.BLANKS}+", " ")))
_LOUD = f"(letters >= {sg._CAPITALS[0]} AND share >= {sg._CAPITALS[1]}) OR (letters >= {sg._CAPITALS_AND_DIGITS[0]} AND share >= {sg._CAPITALS_AND_DIGITS[1]} AND digits >= {sg._CAPITALS_AND_DIGITS[2]}) OR (digits >= {sg._DIGITS[0]} AND length(example) <= {sg._DIGITS[1]})"

BLOCKS_SQL = f"""{_LINES_SQL},
marks AS (SELECT *, {_sql_trim("line")} AS trimmed, regexp_extract(line, '{_plain(sg._HEADING_PAGE)}', 1) AS h, regexp_extract(line, '{_plain(sg._VIEWER_PAGE)}', 1) AS v, regexp_extract(line, '{_plain(sg._HEADING_PAGE)}', 2) AS t FROM lines),
starts AS (SELECT *, regexp_matches(trimmed, '{_plain(sg._SNIP)}') OR h <> '' OR v <> '' AS is_start FROM marks),
seqs AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY report_id ORDER BY line_no) AS page_seq FROM starts),
paged AS (SELECT report_id, line_no, line, trimmed, is_start, page_seq, max(CASE WHEN is_start THEN try_cast(coalesce(nullif(h, ''), nullif(v, '')) AS INT) END) OVER p AS page, max(CASE WHEN is_start AND h <> '' THEN nullif({_sql_trim("t")}, '') END) OVER p AS title,
  bool_or(NOT is_start AND trimmed <> '') OVER p AS has_text FROM seqs WINDOW p AS (PARTITION BY report_id, page_seq)),
pages1 AS (SELECT * FROM paged WHERE NOT is_start AND has_text),
sizes AS (SELECT report_id, count(DISTINCT page_seq) AS n_pages FROM pages1 GROUP BY 1),
forms AS (SELECT p.*, n_pages, {_spaced("trimmed")} AS spaced FROM pages1 p JOIN sizes USING (report_id)),
cands AS (SELECT *, row_number() OVER (PARTITION BY report_id, page_seq ORDER BY line_no) AS a, row_number() OVER (PARTITION BY report_id, page_seq ORDER BY line_no DESC) AS z FROM forms
  WHERE n_pages >= {sg._LEAST_PAGES} AND length(spaced) BETWEEN {sg._CANDIDATE_CHARS[0]} AND {sg._CANDIDATE_CHARS[1]} AND NOT regexp_matches(spaced, '{_plain(sg._NO_CANDIDATE)}')),
picked AS (SELECT report_id, n_pages, page_seq, spaced, a AS nth FROM cands WHERE a <= {sg._EDGE_LINES} UNION ALL SELECT report_id, n_pages, page_seq, spaced, z + {sg._EDGE_LINES} FROM cands WHERE z <= {sg._EDGE_LINES}),
met AS (SELECT report_id, {_key("spaced")} AS key, count(*) AS n, arg_min(spaced, page_seq * 100 + nth) AS example, max(n_pages) AS n_pages FROM picked GROUP BY 1, 2),
looks AS (SELECT *, {_n("example", f"[{sg._LETTER}]")} AS letters, {_n("example", "[A-ZÀ-ÖØ-Þ]")} AS capitals, {_n("example", "[0-9]")} AS digits FROM met WHERE key <> '' AND n >= greatest({sg._LEAST_PAGES}, ceil(n_pages * {sg._PAGE_SHARE}))),
bkeys AS (SELECT report_id, key FROM (SELECT *, coalesce(capitals / nullif(letters, 0), 0) AS share FROM looks) WHERE regexp_matches(example, '{_plain(sg._REPORT_NAME)}') OR {_LOUD}),
stripped AS (SELECT f.*, b.key IS NOT NULL AS is_boilerplate FROM (SELECT *, {_key("spaced")} AS key FROM forms) f LEFT JOIN bkeys b ON b.report_id = f.report_id AND b.key = f.key),
fence AS (SELECT *, NOT is_boilerplate AND trimmed <> '' AS plain, NOT is_boilerplate AND trimmed <> '' AND regexp_matches(line, '{_plain(sg._FENCE)}') AS is_fence FROM stripped),
fenced AS (SELECT *, sum(is_fence::INT) OVER (PARTITION BY report_id, page_seq ORDER BY line_no) AS fences FROM fence),
live AS (SELECT *, plain AND NOT is_fence AND fences % 2 = 0 AS live FROM fenced),
parts AS (SELECT *, live AND regexp_matches(line, '{_HEAD}') AS is_head, CASE WHEN live THEN nullif({_sql_trim(f"regexp_extract(line, '{_HEAD}', 1)")}, '') END AS head, CASE WHEN live AND NOT regexp_matches(line, '{_HEAD}') THEN nullif(regexp_extract(line, '{_ITEM}', 1), '') END AS item, live AND regexp_matches(trimmed, '{_plain(sg._PAGE_WORD)}') AS is_mark FROM live),
texts AS (SELECT *, live AND NOT is_head AND item IS NULL AND NOT is_mark AS is_text FROM parts),
paras AS (SELECT *, sum((NOT is_text AND NOT (plain AND NOT is_fence AND fences % 2 = 1))::INT) OVER w AS para, coalesce({_sql_collapse("last_value(head IGNORE NULLS) OVER w")}, {_sql_collapse("title")}) AS heading FROM texts WINDOW w AS (PARTITION BY report_id, page_seq ORDER BY line_no)),
groups1 AS (SELECT report_id, page_seq, para, item IS NOT NULL AS is_item, min(line_no) AS line_no, max(page) AS page, max(heading) AS heading, string_agg({_PIECE}, chr(1) ORDER BY line_no) AS joined FROM paras WHERE is_text OR item IS NOT NULL GROUP BY 1, 2, 3, 4),
cleaned AS (SELECT *, {sql_normalize_for_evidence(_WRAPPED)} AS clean FROM groups1),
blocks AS (SELECT report_id, (row_number() OVER (PARTITION BY report_id ORDER BY page_seq, line_no) - 1)::INT AS block_idx, CASE WHEN is_item THEN 'list' ELSE 'paragraph' END AS kind, page_seq::BIGINT AS page_seq, page, heading, CASE WHEN is_item THEN concat('- ', clean) ELSE clean END AS text FROM cleaned WHERE length(clean) >= CASE WHEN is_item THEN 6 ELSE 8 END)"""

_PARTS = {**RULES, **{f"_scope3_{i}": p for i, p in enumerate(SCOPE3_PATTERNS)}}
_COUNTS = ", ".join(f"{{'part': '{k}', 'n': {_n('text', ('' if k == 'data_tables' else '(?i)') + p)}}}" for k, p in _PARTS.items())
COUNTS_SQL = f"""{BLOCKS_SQL},
hit AS (SELECT report_id, coalesce(page::VARCHAR, concat('block-', block_idx::VARCHAR)) AS page_key, {sql_normalize_for_evidence("text")} <> '' AS quotable, unnest([{_COUNTS}]) AS h FROM blocks),
by_page AS (SELECT report_id, h.part AS part, page_key, sum(h.n) AS n, bool_or(quotable) AS found FROM hit WHERE h.n > 0 GROUP BY 1, 2, 3),
by_part AS (SELECT report_id, part, sum(n)::BIGINT AS occurrences, count(*) AS pages, bool_or(found) AS found FROM by_page GROUP BY 1, 2),
composite AS (SELECT report_id, coalesce(bool_or(found) FILTER (part IN ('_scope3_0', '_scope3_1')), false) AS found, coalesce(max(occurrences) FILTER (part = '_scope3_2'), 0) AS occurrences, coalesce(max(pages) FILTER (part = '_scope3_3'), 0) AS pages,
  coalesce(sum(occurrences) FILTER (part IN ('_scope3_0', '_scope3_1')), 0) AS n FROM by_part WHERE part LIKE '\\_scope3%' ESCAPE '\\' GROUP BY 1),
counts AS (SELECT report_id, part AS feature_key, found, occurrences, pages FROM by_part WHERE part NOT LIKE '\\_scope3%' ESCAPE '\\' UNION ALL SELECT report_id, '{SCOPE3_RULE}', found, occurrences, pages FROM composite WHERE n > 0)"""

# Quotes: rules of every block, its neighbours, the clipped text and its points. A long block's part around the match is found by its sentence ends.
_QUOTE_RULES = [*((k, RULES.get(k, SCOPE3_PATTERNS[0]), QUOTES.get(k, QUOTES_DEFAULT)) for k in RULE_KEYS), ("_second", SCOPE3_PATTERNS[1], QUOTES_DEFAULT)]
_FLAGGED = {k: ("" if k == "data_tables" else "(?i)") + p for k, p, _ in _QUOTE_RULES}
_FOUND = ", ".join(f"CASE WHEN regexp_matches(text, '{_plain(p)}') THEN '{k}' END" for k, p in _FLAGGED.items())
_RULE_ROWS = ", ".join(f"('{k}', '{_plain(_FLAGGED[k])}', {n})" for k, _, n in _QUOTE_RULES)


def _clip(text: str, most: int) -> str:
    """The text up to ``most`` characters, by whole paragraphs, else to a sentence end or a space. ``text`` is a column's name."""
    parts = f"list_filter(list_transform(string_split_regex({text}, '\\n{{2,}}'), lambda p: {_sql_trim('p')}), lambda p: p <> '')"
    upto = lambda k: f"array_to_string(({parts})[1:{k}], chr(10) || chr(10))"
    kept = f"coalesce(list_max(list_filter([1, 2, 3], lambda k: k <= len({parts}) AND length({upto('k')}) <= {most})), 0)"
    out = f"substr({text}, 1, {most})"
    stop, space, bare = f"regexp_extract({out}, '(?s)^(.*[.!?]) ', 1)", f"regexp_extract({out}, '(?s)^(.*) ', 1)", lambda x: _sql_all(x, (rf"{tx.SPACE}+$", ""))
    by_sentence = f"CASE WHEN length({stop}) - 1 > {int(most * 0.55)} THEN {stop} WHEN length({space}) > {int(most * 0.6)} THEN {bare(space)} ELSE {bare(out)} END"
    by_parts = f"concat({upto(kept)}, CASE WHEN length({upto(kept)}) < length({text}) THEN concat(chr(10), chr(10), '[...truncated...]') ELSE '' END)"
    return f"CASE WHEN length({text}) <= {most} THEN {text} WHEN len({parts}) > 1 AND {kept} > 0 THEN {by_parts} ELSE concat({by_sentence}, ' ...') END"


_LIKE = lambda side: f"{side}.kind = b.kind AND {side}.page IS NOT DISTINCT FROM b.page AND coalesce({side}.heading, '') = coalesce(b.heading, '') AND length({side}.text) <= {NEIGHBOUR_CHARS}"
_POINTS_OF = [(r"\d+[\.,]?\d*\s*%", 3), (r"\b\d{1,3}[\.,]\d{3}\b", 3), (r"\b(tco2e?|mwh|kwh|gj|tonnes?|tons?|kg)\b", 3), (r"\b20[2-3]\d\b", 1), (r"\btarget|\bgoal|\bcommit", 1), (r"\bscope\s*[123]\b", 1), (r"\|[^|]+\|", 2)]
_QUALITY = " + ".join([*(f"{n} * regexp_matches(quote, '(?i){_plain(p)}')::INT" for p, n in _POINTS_OF), "(page IS NOT NULL)::INT", "(length(quote) > 80)::INT", "(length(quote) > 200)::INT"])
QUOTES_SQL = f"""{BLOCKS_SQL},
rules(feature_key, pattern, quotes) AS (VALUES {_RULE_ROWS}),
wide AS (SELECT b.*, array_to_string(list_filter([CASE WHEN {_LIKE("p")} THEN p.text END, b.text, CASE WHEN {_LIKE("n")} THEN n.text END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS context
  FROM blocks b LEFT JOIN blocks p ON p.report_id = b.report_id AND p.block_idx = b.block_idx - 1 LEFT JOIN blocks n ON n.report_id = b.report_id AND n.block_idx = b.block_idx + 1),
found AS (SELECT * FROM (SELECT *, list_filter([{_FOUND}], lambda k: k IS NOT NULL) AS keys FROM wide) WHERE len(keys) > 0),
shorts AS (SELECT report_id, block_idx, page, heading, keys, {_clip("norm", QUOTE_CHARS)} AS quote FROM (SELECT *, {sql_normalize_for_evidence("context")} AS norm FROM found WHERE length(text) <= {2 * QUOTE_CHARS})),
longs AS (SELECT f.*, k.feature_key, length(regexp_extract(text, concat('(?s)^(.*?)', CASE WHEN starts_with(pattern, '(?i)') THEN concat('(?i:', substr(pattern, 5), ')') ELSE concat('(?:', pattern, ')') END), 1)) AS a, length(regexp_extract(text, pattern)) AS size,
  list_concat([0], list_filter(range(1, length(text)), lambda i: contains('.!?' || chr(10), text[i])), [length(text)]) AS stops FROM (SELECT * FROM found WHERE length(text) > {2 * QUOTE_CHARS}) f, unnest(f.keys) AS k(feature_key) JOIN rules r ON r.feature_key = k.feature_key),
bounds AS (SELECT *, least(length(text), a + size) AS e, list_max(list_filter(stops, lambda s: s <= greatest(0, list_max(list_filter(stops, lambda s: s <= a)) - 1))) AS b0 FROM longs),
ends AS (SELECT *, coalesce(list_min(list_filter(stops, lambda s: s > least(length(text), coalesce(list_min(list_filter(stops, lambda s: s > e)), length(text)) + 1))), length(text)) AS b1 FROM bounds),
cuts AS (SELECT *, CASE WHEN b1 - b0 > {3 * QUOTE_CHARS} THEN greatest(0, a - {CONTEXT_CHARS}) ELSE b0 END AS c0, CASE WHEN b1 - b0 > {3 * QUOTE_CHARS} THEN least(length(text), e + {CONTEXT_CHARS}) ELSE b1 END AS c1 FROM ends),
parts2 AS (SELECT report_id, block_idx, page, heading, feature_key, {_clip("norm", QUOTE_CHARS)} AS quote FROM (SELECT *, {sql_normalize_for_evidence("substr(text, c0 + 1, c1 - c0)")} AS norm FROM cuts)),
quoted AS (SELECT report_id, block_idx, page, heading, unnest(keys) AS feature_key, quote FROM shorts UNION ALL SELECT report_id, block_idx, page, heading, feature_key, quote FROM parts2),
firsts AS (SELECT *, row_number() OVER (PARTITION BY report_id, feature_key, substr({_sql_collapse("quote")}, 1, {PREFIX_CHARS}) ORDER BY block_idx) AS repeat FROM quoted WHERE quote <> ''),
capped AS (SELECT *, row_number() OVER (PARTITION BY report_id, feature_key ORDER BY block_idx) AS nth FROM firsts WHERE repeat = 1),
kept AS (SELECT c.*, quotes, bool_or(feature_key = '{SCOPE3_RULE}') OVER (PARTITION BY report_id) AS has_first FROM capped c JOIN rules USING (feature_key) WHERE nth <= 3 * quotes),
rated AS (SELECT report_id, CASE WHEN feature_key = '_second' THEN '{SCOPE3_RULE}' ELSE feature_key END AS feature_key, block_idx, page, heading, quote AS text, {_QUALITY} AS quality, quotes FROM kept WHERE feature_key <> '_second' OR NOT has_first),
ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id, feature_key ORDER BY quality DESC, block_idx) AS rank FROM rated)"""

_KPI = r"\b\d{1,3}(?:[,.\s]\d{3})+\b|\b\d+[\.,]\d+\s*(?:%|tco2e?|mwh|kwh|gj|tonnes?|kg|m3|litres?)\b"
_YEARS = " + ".join(f"({_n('lower(corpus)', rf'\b{y}\b')} >= 4)::INT" for y in range(2018, 2027))
_DEEP = ["framework_esrs", "framework_gri", "framework_tcfd", "framework_eu_taxonomy", "assurance_any"]
PROFILE_SQL = f"""{COUNTS_SQL},
joined AS (SELECT report_id, {sql_normalize_for_evidence("string_agg(text, chr(10) || chr(10) ORDER BY block_idx)")} AS corpus, max(page) AS pages_detected, count(*) AS blocks FROM blocks GROUP BY 1),
profile AS (SELECT report_id, pages_detected, blocks, {_n("corpus", r"\d+[\.,]?\d*\s*%")} AS percentage_count, {_n("corpus", r"\|[^|\n]+\|[^|\n]+\|")} AS table_rows, {_n("corpus", f"(?i){_KPI}")} AS kpi_numbers, {_YEARS} AS distinct_years,
  floor({_n("corpus", r"\b\d[\d,.\s]*\d\b|\b\d+\s*%")}::DOUBLE / greatest(1, length(corpus)) * 1000 * 100 + 0.5) / 100 AS numeric_density, contains(corpus, '%') OR regexp_matches(corpus, '(?i)\\b(mwh|kwh|gj|m3)\\b') AS has_units, regexp_matches(corpus, '\\|[^|]+\\|[^|]+\\|') AS has_table, length(corpus) AS corpus_chars FROM joined),
vector AS (SELECT p.*, {", ".join(f"coalesce(bool_or(found) FILTER (feature_key = '{k}'{' AND has_table' if k == 'data_tables' else ''}), false) AS {k}" for k in RULE_KEYS)}, {", ".join(f"coalesce(max(c.pages) FILTER (feature_key = '{k}'), 0) AS {k}_pages" for k in _DEEP)} FROM profile p LEFT JOIN counts c USING (report_id) GROUP BY ALL)"""


def _sum(*terms: str) -> str:
    return f"least(100, {' + '.join(terms)})"


def _when(*cases: tuple[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n in cases) + " ELSE 0 END"


def _how_many(names: str) -> str:
    return "(" + " + ".join(f"{n}::INT" for n in names.split()) + ")"


_FRAMES = _how_many(" ".join(f"framework_{x}" for x in "esrs csrd gri sasb tcfd issb ifrs_s1 ifrs_s2 eu_taxonomy tnfd cdp sdgs".split()))
_SOCIAL = _how_many("workforce safety diversity human_rights training employee_turnover health_wellbeing living_wage")
_GOVERN = _how_many("board_oversight audit_committee sustainability_committee risk_management internal_control esg_remuneration whistleblower anti_corruption data_privacy")
_GREEN = _how_many("energy water waste renewable_energy biodiversity circular_economy pollution")
_DEPTH = "least(5, floor((framework_esrs_pages + framework_gri_pages + framework_tcfd_pages) / 3))::INT"
_COMPLETE = _sum(
    f"CASE WHEN framework_efrag OR {_FRAMES} > 0 THEN least(18, {_when((f'{_FRAMES} >= 5', 14), (f'{_FRAMES} >= 3', 12), (f'{_FRAMES} >= 2', 10), ('true', 8))} + least(4, {_DEPTH})) ELSE 0 END",
    _when(("double_materiality", 8), ("materiality_assessment", 5)), _when(("(double_materiality OR materiality_assessment) AND materiality_matrix", 2)),
    _when((f"{_GOVERN} >= 5", 8), (f"{_GOVERN} >= 3", 6), ("board_oversight OR audit_committee OR sustainability_committee", 4)),
    _when(("scope_1 AND scope_2", 8), ("scope_1 OR scope_2", 5)), _when(("scope_3 AND scope3_categories", 8), ("scope_3", 5)), _when(("emissions_numbers", 3)), _when(("scope2_method", 1)), _when(("emissions_intensity", 2)),
    _when(("(targets OR net_zero OR sbti OR transition_plan) AND sbti", 7), ("targets OR net_zero OR sbti OR transition_plan", 5)), _when(("climate_scenario OR paris_agreement OR carbon_pricing", 3)), f"least(8, 2 * {_GREEN})",
    _when((f"{_SOCIAL} >= 5", 10), (f"{_SOCIAL} >= 3", 7), ("workforce OR safety OR diversity", 4)), _when(("value_chain OR supply_chain", 2)),
    _when(("framework_eu_taxonomy AND framework_eu_taxonomy_pages >= 3", 4), ("framework_eu_taxonomy", 2)), _when(("sector_specific", 2)),
)
_CONSISTENT = _sum(
    _when(("methodology AND boundary", 18), ("methodology", 10), ("boundary", 8)), _when(("data_quality", 2)), _when(("ghg_protocol", 7)), _when(("base_year", 3)), _when(("reporting_period", 5)),
    _when(("distinct_years >= 4", 18), ("distinct_years >= 3", 15), ("distinct_years >= 2", 12)), "least(15, least(5, percentage_count // 10) + least(5, table_rows // 5) + least(5, kpi_numbers // 8))",
    _when(("restatement", 10), ("limitations", 7)), f"least(8, 3 * {_how_many('internal_control risk_management audit_committee')})", _when(("tco2e_units OR has_units", 5)),
    _when(("data_tables AND table_rows >= 10", 4), ("data_tables", 2)), _when(("quantitative_targets", 5)),
)
_BASE = _when(("assurance_negative AND NOT assurance_any", 0), ("assurance_reasonable AND assurance_limited", 90), ("assurance_reasonable", 82), ("assurance_limited", 60), ("assurance_any", 38))
_ASSURED = reduce(
    lambda s, b: f"(CASE WHEN {s} > 0 AND ({b[0]}) THEN least(100, {s} + {b[1]}) ELSE {s} END)",
    [("assurance_isae OR assurance_aa1000", 6), ("named_assurance_provider", 5), ("assurance_scope", 4), ("assurance_any_pages >= 5", 3)], f"({_BASE})",
)
_POINTS = "forward_looking=12 transition_plan=3 limitations=10 restatement=5 named_assurance_provider=8 methodology=8 data_quality=2 stakeholder_engagement=8 scope3_categories=7 reporting_period=4 boundary=5 quantitative_targets=5 target_progress=3 connectivity_financial=5 iro_analysis=3 materiality_matrix=2 esrs_datapoints=5 gri_content_index=3"
_CLEAR = _sum(*[f"{p.split('=')[1]} * {p.split('=')[0]}::INT" for p in _POINTS.split()])
_ADVICE = ", ".join([
    "CASE WHEN NOT scope_3 THEN 'Disclose Scope 3 emissions with category breakdown' WHEN NOT scope3_categories THEN 'Break down Scope 3 by upstream/downstream categories' END",
    "CASE WHEN NOT double_materiality THEN 'Conduct and disclose double materiality assessment' END",
    "CASE WHEN NOT assurance_any THEN 'Obtain external assurance (limited or reasonable)' WHEN NOT assurance_reasonable THEN 'Upgrade from limited to reasonable assurance' END",
    "CASE WHEN NOT quantitative_targets THEN 'Set quantitative targets with timelines' WHEN NOT target_progress THEN 'Report progress against quantitative targets' END",
    "CASE WHEN NOT transition_plan THEN 'Publish a climate transition plan/roadmap' END", "CASE WHEN NOT methodology THEN 'Disclose calculation methodologies for key metrics' END",
    "CASE WHEN NOT boundary THEN 'Clarify organizational and operational boundaries' END", "CASE WHEN NOT base_year THEN 'Define and disclose a base year for emissions tracking' END",
    "CASE WHEN NOT forward_looking THEN 'Include forward-looking statements and strategic outlook' END", f"CASE WHEN {_FRAMES} < 3 THEN 'Align with additional reporting frameworks (ESRS, GRI, TCFD)' END",
])
RECORDS_SQL = f"""{PROFILE_SQL},
subs AS (SELECT *, {_COMPLETE} AS completeness, {_CONSISTENT} AS consistency, {_ASSURED} AS assurance, {_CLEAR} AS transparency, array_to_string(list_filter([{_ADVICE}], lambda x: x IS NOT NULL)[1:6], '; ') AS recommendations FROM vector),
records AS (SELECT r.report_id, coalesce(floor(0.35e0 * completeness + 0.25e0 * consistency + 0.2e0 * assurance + 0.2e0 * transparency + 0.5e0), 0)::INT AS score, coalesce(completeness, 0)::INT AS completeness, coalesce(consistency, 0)::INT AS consistency, coalesce(assurance, 0)::INT AS assurance, coalesce(transparency, 0)::INT AS transparency,
  recommendations, coalesce(percentage_count, 0)::INT AS percentage_count, coalesce(table_rows, 0)::INT AS table_rows, coalesce(kpi_numbers, 0)::INT AS kpi_numbers, coalesce(distinct_years, 0)::INT AS distinct_years, coalesce(numeric_density, 0) AS numeric_density, coalesce(corpus_chars, 0)::INT AS corpus_chars, pages_detected, coalesce(blocks, 0) AS blocks FROM reports r LEFT JOIN subs USING (report_id)),
banded AS (SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS band FROM records)"""

ORACLES["evidence_blocks"] = f"WITH {BLOCKS_SQL} SELECT * FROM blocks"
ORACLES["ranked_evidence"] = f"WITH {QUOTES_SQL} SELECT * EXCLUDE (quotes) FROM ranked WHERE rank <= quotes"
ORACLES["whole_rule_counts"] = f"WITH {COUNTS_SQL} SELECT report_id, feature_key, occurrences, pages FROM counts WHERE feature_key <> '{SCOPE3_RULE}'"
ORACLES["whole_scope3_counts"] = f"WITH {COUNTS_SQL} SELECT report_id, feature_key, occurrences, pages FROM counts WHERE feature_key = '{SCOPE3_RULE}'"
ORACLES["score_records"] = f"WITH {RECORDS_SQL} SELECT *, false AS corpus_sampled, 'rules-evidence' AS method_kind, 1 AS version FROM banded"
ORACLES["sector_quality"] = f"""WITH catalogue AS ({CATALOGUE_SQL.replace("AS string", "AS VARCHAR")}), {RECORDS_SQL} SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS n, avg(score) AS mean_score, median(score) AS median_score,
count(*) FILTER (band = 'high') AS n_high, count(*) FILTER (band = 'medium') AS n_medium, count(*) FILTER (band = 'low') AS n_low FROM banded JOIN catalogue USING (report_id) GROUP BY 1"""

# The intake queries over whole texts: the same SQL on the pages of the woven reports
_WHOLE_PAGES = f"WITH {_INTAKE_PAGES_SQL.replace("marked AS", "numbered AS").replace("FROM marked)", "FROM numbered)")}, pages0 AS (SELECT report_id, page, text FROM intake_pages)"
for _name in ("intake_pages", "intake_spans", "intake_verdicts"):
    ORACLES[f"whole_{_name}"] = ORACLES[_name].replace(_PAGES, _WHOLE_PAGES)
ORACLES["whole_feature_coverage"] = f"""WITH {COUNTS_SQL}, f AS (SELECT * FROM counts WHERE found AND feature_key <> '{SCOPE3_RULE}')
SELECT feature_key, count(*) AS hits, floor(count(*) * 100.0 / (SELECT count(*) FROM documents) + 0.5)::BIGINT AS hit_rate_pct, round(sum(occurrences) / count(*), 6) AS occurrences_per_hit, round(sum(pages) / count(*), 6) AS pages_per_hit FROM f GROUP BY 1"""
for _name in ("rule_counts", "scope3_counts", "intake_pages", "intake_spans", "intake_verdicts", "feature_coverage"):
    ORACLES[_name] = ORACLES[f"whole_{_name}"]
for _name in ("pages_to_review", "snippets_for_metadata", "combined_verdicts", "upload_ranges"):
    ORACLES[_name] = ORACLES[_name].replace(_PAGES, _WHOLE_PAGES)
