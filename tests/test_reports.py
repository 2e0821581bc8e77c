"""Text, segmentation, rules, scores, entities and retrieval on small inline tables."""

import hashlib
import math
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerleaf.functions import dimensions, folding, rules, text
from ledgerleaf.functions import text as tx
from ledgerleaf.functions.blocks import rule_finder
from ledgerleaf.operators import analytics, catalog, conversations, entities, features, intake, retrieval, routing, scoring, search_index, segment
from ledgerleaf.plans import flows, registry
from ledgerleaf.sources.tables import written


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


# text


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a\r\nb c", "a\nb c"), ("efﬁcient co­op ■x → y", "efficient coop x - y"), ("![alt](u.png)text [link]( )", "text link"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n1 | 2"), ("x\n\n\n\ny   z", "x\n\ny z"), ("a\n[...SNIPPED...]\nb", "a\n\nb"), ("", ""),
    ],
)
def test_evidence_cleaning(spark, raw, clean):
    assert one(spark, raw, text.normalize_for_evidence) == clean


def test_display_and_match_forms(spark):
    assert one(spark, "### Page 3\nText here ...", text.clean_evidence_display) == "Text here"
    assert one(spark, "**Net-Zero**​  by\n2040", text.normalize_for_match) == "net-zero by 2040"
    assert one(spark, "We cut CO2 by 30% in 7 of 12 sites", text.match_tokens) == ["cut", "co2", "30%", "7", "12", "sites"]


def test_ids_and_keys(spark):
    assert one(spark, "report-12", text.report_number) == 12 and one(spark, "report-1000000", text.report_number) is None
    assert one(spark, "/reports/2020/a/b.pdf", text.normalize_report_key) == "reports/2020/a/b.pdf" and one(spark, "reports/../x", text.normalize_report_key) == ""
    assert one(spark, "reports/2021/acme/x.pdf", text.parse_report_path) == (2021, "acme")
    assert one(spark, "abc", text.fnv1a_hex) == "1a47e90b" and one(spark, "Acme-U12345 ", text.canonical_slug) == "acme"
    assert one(spark, "emissions_perUnit", text.feature_label) == "Emissions Per Unit"
    assert one(spark, "ACME_annual-report_2021_FY2020.pdf", text.year_from_filename) is None
    assert one(spark, "ACME annual report 2021.pdf", text.year_from_filename) == 2021 and one(spark, "ACME annual report 2021.pdf", text.company_from_filename) == "ACME"
    assert one(spark, " banks ", lambda c: text.choose_vocab(c, dimensions.INDUSTRY_GROUPS, "Other")) == "Banks"
    ids = spark.createDataFrame([(" report-2", 0), ("x", 1), ("report-1", 2), ("report-2", 3)], "id string, pos int")
    assert [r.id for r in text.dedupe_report_ids(ids, 5).collect()] == ["report-2", "report-1"]


def test_truncation(spark):
    assert one(spark, "x" * 30, lambda c: text.truncate_end(c, 10)) == "x" * 10 + "\n\n[Truncated]\n"
    assert one(spark, "a" * 50 + "b" * 50, lambda c: text.truncate_head_tail(c, 60)) == "a" * 24 + "\n\n[...truncated...]\n\n" + "b" * 4
    sampled = one(spark, "a" * 200 + "b" * 200, lambda c: text.sample_head_tail(c, 100))
    assert sampled == "a" * 60 + "\n\n[...snipped...]\n\n"
    assert one(spark, "One. " * 300, lambda c: text.truncate_for_classifier(c, 100)) == ("One. " * 20).strip()
    assert one(spark, "para one\n\n" + "y" * 200, lambda c: text.clip_snippet(c, 100)) == "para one\n\n[...truncated...]"
    assert one(spark, "A b. " * 40, lambda c: text.clip_snippet(c, 100)) == ("A b. " * 20).strip() + " ..."


def test_folding(spark):
    assert one(spark, "Société Générale & Co.", folding.search_fold) == "societe generale co" and one(spark, "A&B", folding.slugify_company) == "a-and-b"
    broken = "Nestlé".encode().decode("latin-1")
    assert one(spark, broken, folding.repair_mojibake) == "Nestlé" and one(spark, "Nestlé", folding.repair_mojibake) == "Nestlé"


def test_word_boundaries_agree_with_duckdb(spark):
    samples = ["éesg report", "ESG", "esgé x", "scope 1 ésg", "x-esg-y", "prescope 2", "Scope 3"]
    for key in ("framework_esrs", "scope_1", "targets"):
        for s in [*samples, "ésrs ESRS éESRS", "targetsé target"]:
            mine = one(spark, s, lambda c, k=key: rules.matches(c, rules.RULES[k]))
            theirs = duckdb.execute(f"SELECT len(regexp_extract_all(?, '(?i){rules.RULES[key]}'))", [s]).fetchone()[0]
            assert mine == theirs, (key, s)


def test_needed_words_are_in_every_match():
    import re

    samples = {"net_zero": "net zero", "scope_1": "Scope 1", "energy": "GJ", "water": "water stress", "sbti": "science-based target", "diversity": "DI&I", "training": "skill development"}
    for key, s in samples.items():
        assert re.search(rules.RULES[key], s, re.I) and any(w in s.lower() for w in rules.needed_words(rules.RULES[key])), key
    assert rules.needed_words(rules.RULES["data_tables"]) == ["|"] and rules.needed_words(rules.RULES["esrs_datapoints"]) is None
    assert len(rules.RULE_KEYS) == 87 and len(rules.RULES) + len(rules.SCOPE3_PATTERNS) == 90


# segmentation

REPORT = "\n".join([
    "intro line before pages", "### Page 1 Overview", "ANNUAL REPORT OF THE GROUP 2021", "We cut emis-", "sions by 30 % in", "two years.", "", "- first item here", "- b", "## Climate",
    "```", "## not a heading", "code", "```", "After the fence we go on.", "### Page 2", "ANNUAL REPORT OF THE GROUP 2022", "Second page text.", "Page 3:", "ANNUAL REPORT OF THE GROUP 2023", "Third page text.",
])


def test_blocks(spark):
    docs = spark.createDataFrame([("r", REPORT), ("e", "   \n"), ("p", "only one plain paragraph")], "report_id string, text string")
    rows = [(r.report_id, r.block_idx, r.kind, r.page, r.heading, r.text) for r in segment.evidence_blocks(docs).orderBy("report_id", "block_idx").collect()]
    assert rows == [
        ("p", 0, "paragraph", None, None, "only one plain paragraph"),
        ("r", 0, "paragraph", None, None, "intro line before pages"),
        ("r", 1, "paragraph", 1, "Overview", "We cut emissions by 30 % in two years."),
        ("r", 2, "list", 1, "Overview", "- first item here"),
        ("r", 3, "paragraph", 1, "Climate", "After the fence we go on."),
        ("r", 4, "paragraph", 2, None, "Second page text."),
        ("r", 5, "paragraph", 3, None, "Third page text."),
    ]
    capped = segment.evidence_blocks(docs, most=2).where("report_id = 'r'")
    assert capped.count() == 4  # up to the page on which two are reached
    corpus = segment.assemble_corpus(segment.evidence_blocks(docs)).where("report_id = 'r'").first().corpus
    assert corpus.startswith("intro line before pages\n\nWe cut") and corpus.endswith("Third page text.")


def test_page_splitters(spark):
    docs = spark.createDataFrame([("r", "pre\n# page 1\nA\n--- Page 2 ---\n\nPage 3 :\nC"), ("n", "no  marks\nhere")], "report_id string, text string")
    got = {(r.report_id, r.page, r.text) for r in segment.split_pages_intake(docs).collect()}
    assert got == {("r", 1, "A"), ("r", 2, ""), ("r", 3, "C"), ("n", 1, "no marks here")}
    got = {(r.report_id, r.page, r.title, r.text) for r in segment.split_pages_grounding(docs).collect()}
    assert got == {("r", None, None, "pre\n# page 1\nA"), ("r", 3, None, "C"), ("n", None, None, "no  marks\nhere")}
    inline = spark.createDataFrame([("r", "pre\nPage 1:\nA b\nPage 2:\nC")], "report_id string, text string")
    assert [(r.page, r.text) for r in segment.split_context_pages(inline).orderBy("seq").collect()] == [(1, "A b"), (2, "C")]


def brute_pieces(s, size, overlap, marks):
    out, start = [], 0
    while start < len(s):
        end = min(len(s), start + size)
        for mark, share, keep in marks:
            at = max((i for i in range(end + 1) if s.startswith(mark, i)), default=-1)
            if at > start + int(size * share):
                end = at + keep
                break
        if s[start:end].strip():
            out.append(s[start:end].strip())
        if end >= len(s):
            break
        start = max(end - overlap, start + 1)
    return out


def test_chunks(spark):
    words = " ".join(f"word{i}" for i in range(60))
    assert one(spark, words, lambda c: segment.char_chunks(c, 100, 20)) == brute_pieces(words, 100, 20, ((" ", 0.6, 0),))
    sections = "\n\n".join(f"Part {i}. It has text. " * 3 for i in range(12))
    assert one(spark, sections, lambda c: segment.section_chunks(c, 150, 30, 5)) == brute_pieces(sections.strip(), 150, 30, (("\n\n", 0.5, 0), (". ", 0.6, 1)))[:5]
    pages = spark.createDataFrame([("r", 1, "a b c d e f g\n\nx y"), ("r", 2, None)], "report_id string, page int, text string")
    made = segment.token_chunks(pages, 4, 1, 2, 1).orderBy("page", "chunk_in_page").collect()
    assert [(r.chunk_in_page, r.text) for r in made] == [(0, "a b c d"), (1, "d e f g"), (2, "x y")]


def test_merging_pages(spark):
    pages = spark.createDataFrame([("r", 2, "B", "x"), ("r", 1, "A", "y")], "report_id string, page int, text string, company string")
    assert segment.merge_pages(pages).first().asDict() == {"report_id": "r", "company": "y", "text": "--- Page 1 ---\nA\n\n--- Page 2 ---\nB", "page_count": 2}
    assert segment.restrict_pages(pages, 2, 3).first().text == "### Page 2\nB"


# rules and scores


def blocks_of(spark, *texts):
    return spark.createDataFrame([("r", i, "paragraph", 1, i // 2 + 1, None, t) for i, t in enumerate(texts)], "report_id string, block_idx int, kind string, page_seq int, page int, heading string, text string")


def test_counts_and_quotes(spark):
    blocks = blocks_of(spark, "Scope 1 and scope 1 again.", "Our scope 1 target is 30 % by 2030, 12,400 tCO2e.", "Scope 3 category 4 upstream transport.", "Plain words only here.")
    counts = {r.feature_key: (r.found, r.occurrences, r.pages) for r in features.count_features(blocks).collect()}
    assert counts["scope_1"] == (True, 3, 1) and counts["scope3_categories"] == (True, 1, 1) and counts["quantitative_targets"] == (True, 1, 1)
    quotes = [r for r in features.top_quotes(features.quote_candidates(blocks)).where("feature_key = 'scope_1'").orderBy("rank").collect()]
    # both blocks give the same quote, which counts once
    assert len(quotes) == 1 and quotes[0].quality == 13 and "Scope 1 and scope 1 again.\n\nOur scope 1" in quotes[0].text
    top = features.top_quotes(features.quote_candidates(blocks))
    assert features.quote_batch(top).count() <= 60 and features.topic_sample(top, 3).count() == 3
    new = spark.createDataFrame([("r", "scope_1", 1, "A rewritten quote.", None, None), ("r", "targets", 1, "short", None, None)], "report_id string, feature_key string, rank int, text string, page int, heading string")
    merged = features.merge_refined_quotes(top, new)
    assert [(r.text, r.page) for r in merged.where("refined").collect()] == [("A rewritten quote.", 1)] and merged.where("feature_key = 'targets' and not refined").count() == 1


def test_long_block_snippet(spark):
    body = "First one. " * 200 + "The scope 1 figure is here. " + "Last one. " * 200
    at = body.index("scope 1")
    got = spark.createDataFrame([(body, at)], "t string, a int").select(features.long_block_snippet(F.col("t"), F.col("a"), F.lit(7)).alias("q")).first().q
    assert "scope 1 figure" in got and len(got) < 200


def vector(spark, **on):
    names = rules.RULE_KEYS
    base = {k: False for k in names} | {f"{k}_pages": 0 for k in ("framework_esrs", "framework_gri", "framework_tcfd", "framework_eu_taxonomy", "assurance_any")}
    base |= {"percentage_count": 0, "table_rows": 0, "kpi_numbers": 0, "distinct_years": 0, "has_units": False} | on
    return scoring.scored(spark.createDataFrame([base])).first()


def test_score_terms(spark):
    r = vector(spark)
    assert (r.completeness, r.consistency, r.assurance, r.transparency, r.score, r.band) == (0, 0, 0, 0, 0, "low") and len(r.recommendations) == 6
    r = vector(spark, framework_esrs=True, framework_gri=True, framework_esrs_pages=7, framework_gri_pages=5, double_materiality=True, scope_1=True, scope_2=True, scope_3=True, scope3_categories=True, sbti=True)
    assert r.completeness == 14 + 8 + 8 + 8 + 7
    r = vector(spark, assurance_any=True, assurance_limited=True, assurance_reasonable=True, assurance_isae=True, named_assurance_provider=True, assurance_scope=True, assurance_any_pages=9)
    assert r.assurance == 100
    r = vector(spark, assurance_negative=True, assurance_isae=True)
    assert r.assurance == 0
    r = vector(spark, methodology=True, boundary=True, percentage_count=55, table_rows=12, kpi_numbers=99, distinct_years=3, data_tables=True, internal_control=True, risk_management=True, audit_committee=True)
    assert r.consistency == 18 + 15 + (5 + 2 + 5) + 8 + 4
    everything = vector(spark, **{k: True for k in rules.RULE_KEYS}, percentage_count=99, table_rows=99, kpi_numbers=99, distinct_years=5, has_units=True, assurance_any_pages=9)
    assert everything.score <= 100 and everything.band == "high" and everything.recommendations == []
    assert vector(spark, forward_looking=True, boundary=True).transparency == 17


def test_score_json(spark):
    rows = [("report-1", '{"score": "71", "band": "medium", "subscores": {"completeness": 1, "consistency": "2", "assurance": 3, "transparency": 4}, "report": {"id": "report-1"}}'), ("report-2", '{"subscores": {"completeness": 1}}'), ("report-3", '{"score": 5, "subscores": {"completeness": 1}}')]
    df = spark.createDataFrame(rows, "report_id string, json string")
    known = spark.createDataFrame([("report-3", "Acme", 2020)], "report_id string, company string, year int")
    got = {r.report_id: r for r in scoring.parse_score_json(df, known).collect()}
    assert set(got) == {"report-1", "report-3"} and got["report-1"].score == 71 and got["report-1"].subscores.consistency == 2
    assert got["report-3"].subscores is None and (got["report-3"].company, got["report-3"].year) == ("Acme", 2020)
    ids = spark.createDataFrame([("report-1",), ("report-9",), ("report-8",)], "report_id string")
    broken = df.unionByName(spark.createDataFrame([("report-8", "oops")], df.schema))
    assert {r.report_id: r.status for r in scoring.fetch_scores(ids, broken).collect()} == {"report-1": "ok", "report-9": "missing", "report-8": "error"}


# intake, routing, entities


def test_intake_decisions(spark):
    files = spark.createDataFrame([("a.pdf", "application/pdf", 2000, True, 3, 500), ("a.doc", "application/pdf", 2000, True, 3, 500), ("b.pdf", "application/pdf", 10, True, 3, 500), ("c.pdf", "application/pdf", 2000, False, 3, 500), ("d.pdf", "application/pdf", 2000, True, 3, 5)], "name string, content_type string, size long, has_signature boolean, page_count int, text_chars int")
    assert [r.rejected for r in intake.validate_uploads(files).orderBy("name").collect()] == ["extension", None, "too_small", "signature", "too_little_text"]
    staged = spark.createDataFrame([("t", 10, 2, 100, True), ("u", 1, 95, 100, True)], "token string, suggested_end int, suggested_start int, total_pages int, full_upload boolean")
    options = spark.createDataFrame([("t", None, None)], "token string, user_start int, user_end int")
    assert {r.token: (r.page_start, r.page_end, r.extract) for r in intake.decide_range(staged, options).collect()} == {"t": (2, 10, True), "u": (1, 95, False)}
    new = spark.createDataFrame([("1", "h", 2020, "acme"), ("2", None, 2020, "beta"), ("3", "", None, "acme")], "upload_id string, sha256 string, year int, company_slug string")
    old = spark.createDataFrame([("h", 2019, "x", "k1"), (None, 2020, "beta", "k2"), ("", None, "acme", "k3")], "sha256 string, year int, company_slug string, report_key string")
    assert {r.upload_id: (r.same_hash, r.same_company_year) for r in intake.find_duplicates(new, old).collect()} == {"1": (True, False), "2": (False, True), "3": (False, False)}
    assert [r.upload_id for r in intake.accepted_uploads(new, old).collect()] == ["3"]
    left, counts = intake.purge_reports(spark.createDataFrame([("a",)], "report_id string"), {"x": (spark.createDataFrame([("a",), ("b",)], "id string"), "id")})
    assert left["x"].count() == 1 and counts.first().removed == 1


def test_routing(spark):
    scores = [("r", 0, [("Climate Change", 0.8)]), ("r", 1, [("Climate Change", 0.2)]), ("r", 2, [("Non-ESG", 0.9)]), ("r", 3, None)]
    preds = spark.createDataFrame(scores, f"report_id string, chunk_index int, scores {routing.SCORES}")
    assert [(r.category, r.pillar, r.is_esg) for r in routing.route_chunks(preds).orderBy("chunk_index").collect()] == [("Climate Change", "E", True), ("Non-ESG", None, False), ("Non-ESG", None, False), ("Unknown", None, True)]
    chunks = spark.createDataFrame([("r", 0, "good"), ("r", 1, "bad")], "report_id string, chunk_index int, text string").coalesce(1)

    def scorer(texts):
        if "bad" in texts:
            raise ValueError
        return [[("Human Capital", 0.5)] for _ in texts]

    assert [r.scores is None for r in routing.classify_chunks(chunks, scorer, 1).orderBy("chunk_index").collect()] == [False, True]
    soft = spark.range(1).select(routing.softmax(F.array(F.lit(1.0), F.lit(2.0))).alias("p")).first().p
    assert soft[1] == pytest.approx(math.e / (1 + math.e))
    rows = spark.createDataFrame([(f"r{i % 20}", "ESG"[i % 3]) for i in range(200)], "k string, pillar string")
    split = routing.pseudo_label_split(rows, 0.25).groupBy("k").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in split) and sum(r.s == "eval" for r in split) == 5
    scored = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2)], "label_id int, pred_id int")
    m = routing.classification_metrics(scored).first()
    assert m.accuracy == 0.75 and m.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 1) / 3)


def test_entities(spark):
    body = '```json\n[{"class": "energy", "text": "5,200 MWh of energy", "attrs": {"v": 1, "n": {"a": 2}}}, {"class": "nope", "text": "x"}, {"class": "water"}]\n```'
    rows = spark.createDataFrame([("r", 0, body), ("r", 1, "no json"), ("r", 2, '[{"class": "energy", "text": " 5,200 MWH of energy "}]')], "report_id string, chunk_index int, response string")
    parsed = entities.parse_entities(rows)
    first = parsed.where("chunk_index = 0").first()
    assert (first.extraction_class, first.pillar, first.attributes["v"], first.attributes["n"]) == ("energy", "E", "1", '{"a":2}') and parsed.count() == 2
    assert entities.dedupe_entities(parsed).count() == 1
    kind = "a int"
    for raw, want in (('{"a": 1}', 1), ('x ```json\n{"a": 2}\n``` y', 2), ('say {"a": 3} ok', 3), ("none", None), (None, None)):
        got = spark.createDataFrame([(raw,)], "x string").select(entities.parse_json_object(F.col("x"), kind).alias("o")).first().o
        assert (got and got.a) == want, raw


def test_grounding(spark):
    pages = spark.createDataFrame([("r", 0, 1, "One", "energy use fell in plants"), ("r", 1, 2, "Two", "water withdrawal fell sharply in 2023"), ("r", 2, 3, None, "energy use fell in plants and offices")], "report_id string, page_seq int, page int, title string, text string")
    texts = ["Water withdrawal fell", "energy use fell in", "withdrawal of water was sharply lower in 2023", "tiny", "nothing matches this at all"]
    ents = spark.createDataFrame([("r", i, 0, "energy", t, "E") for i, t in enumerate(texts)] + [("q", 0, 0, "energy", "some entity text", "E")], "report_id string, chunk_index int, position int, extraction_class string, extraction_text string, pillar string")
    got = [(r.page, r.heading) for r in entities.ground_entities(ents, pages).where("report_id = 'r'").orderBy("chunk_index").collect()]
    assert got == [(2, "Two"), (3, None), (2, "Two"), (None, None), (None, None)]
    assert entities.pages_detected(pages).first().pages_detected == 3


def place(needles, tokens, pages):
    """The page of each entity by reading every page for every needle, from the page of the last hit on."""
    cursor, out = 0, []
    for needle, toks in zip(needles, tokens, strict=True):
        found = None
        if len(needle) >= entities.LEAST_NEEDLE:
            found = next((i for i in [*range(cursor, len(pages)), *range(cursor)] if needle in pages[i]), None)
            hits = [sum(t in p for t in toks) for p in pages]
            if found is None and len(toks) >= 2 and pages and max(hits) >= min(3, max(2, -(-len(toks) * 35 // 100))):
                found = hits.index(max(hits))
        cursor = cursor if found is None else found
        out.append(found)
    return out


def test_nearest_chunks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    point = lambda: [round(c + rng.gauss(0, 0.05), 3) for c in rng.choice(centres)]
    rows = [(f"v{i:03d}", "hot" if i % 3 else f"n{i % 4}", point()) for i in range(240)]
    rows += [(f"w{i}", "hot", rows[1][2]) for i in range(20)] + [(f"z{i}", "hot", [0.0] * 6) for i in range(3)] + [("y0", "few", [0.0] * 6), ("y1", "few", point()), ("y2", None, point())]
    asked = [(i, *rows[i][1:]) for i in range(0, 240, 16)] + [(900, "hot", [0.0] * 6), (901, "few", point()), (902, "absent", point())]
    vectors, queries = spark.createDataFrame(rows, "id string, namespace string, values array<double>"), spark.createDataFrame(asked, "query_id int, namespace string, values array<double>")
    size = lambda v: math.sqrt(sum(x * x for x in v))

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (size(a) * size(b)), 9) if size(a) and size(b) else None

    for per_task in (20_000, 7):
        made = {}
        for r in retrieval.top_k_chunks(queries, vectors, 8, per_task).orderBy("query_id", "rank").collect():
            made.setdefault(r.query_id, []).append((r.id, r.similarity))
        for query, namespace, values in asked:
            found = [(i, cosine(values, v)) for i, n, v in rows if n == namespace]
            best = sorted(found, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:8]
            mine = made.get(query, [])
            assert [s for _, s in mine] == pytest.approx([s for _, s in best], abs=2e-9), query
            assert {i for i, s in mine if s != best[-1][1]} == {i for i, s in best if s != best[-1][1]}


def test_search_by_stored_trigrams_equals_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "PER_TASK", 7)
    rng = random.Random(12)
    words = ["Société", "Générale", "ACME", "ac", "me", "x", "7", "2020", "Co.", "&", "energy", "ENERGÍA", "é", "a-b"]
    rows = [(f"r{i}", " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([None, "S 1", "Sector 12"]), rng.choice([None, 2019, 2020])) for i in range(120)]
    rows += [("empty", "", None, None), ("long", "acme energy " * 3000 + "zq", None, None), (None, "acme", None, None)]
    df = spark.createDataFrame(rows, "report_id string, company string, blob string, year int").withColumn("gram", F.lit("x"))
    fields, path = ["company", "blob", "year"], str(tmp_path / "index")
    search_index.index_reports(df, path, fields)
    asked = ["", None, "  ", "acme", "me", "e", "zq", "energ 20", "ENERGÍA 7", "société générale", "acme x 2020", "qqq", "acme qq", "q", "y a", "s 1", "ector 12 019", "& é", "me me me", "acme energy", "ergia"]
    made = {}
    for r in search_index.search_indexed(spark, path, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).collect():
        made.setdefault(r.query_id, []).append(r.id)
    blobs = {i: folding.fold(" ".join(str(x) for x in rest if x is not None)) for i, *rest in rows if i is not None}
    for n, query in enumerate(asked):
        want = [i for i, blob in blobs.items() if all(w in blob for w in folding.fold(query or "").split(" "))]
        assert sorted(made.get(n, [])) == sorted(want), query
        if query is not None:
            assert sorted(want) == sorted(r.report_id for r in catalog.search_reports(df, query, fields).collect() if r.report_id is not None), query
    # a search of one word reads the partitions of its rarest trigrams
    one = search_index.search_indexed(spark, path, spark.createDataFrame([(0, "energia")], "query_id int, query string"))
    listed = re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN \(([^)]*)\)", one._jdf.queryExecution().executedPlan().toString())
    assert listed and len(listed[1].split(",")) <= search_index.LOOKED_UP
    search_index.index_reports(df.limit(0), path + "-none", fields)
    assert search_index.search_indexed(spark, path + "-none", spark.createDataFrame([(0, "acme"), (1, "")], "query_id int, query string")).count() == 0


def test_best_of_a_block_keeps_ties_by_id_and_the_floor(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "MATRIX", 7)
    rng = random.Random(4)
    spots = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [-1.0, 0.0]]
    held = [(f"v{i:02d}", rng.choice(spots)) for i in range(30)]
    asked = [(i, spots[i % 4], [None, 0.6, 1.1][i % 3]) for i in range(12)]
    tables = [pa.table({"query_id": [a for a, _, _ in asked], "q": [b for _, b, _ in asked], "floor": pa.array([c for _, _, c in asked], pa.float64())}), pa.table({"id": [a for a, _ in held], "u": [b for _, b in held]})]
    for k in (1, 5, 40):
        made = {}
        for r in retrieval._best(*tables, k).to_pylist():
            made.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
        for query, q, floor in asked:
            near = [(i, round(q[0] * u[0] + q[1] * u[1], 9)) for i, u in held]
            assert made.get(query, []) == sorted([x for x in near if floor is None or x[1] >= floor], key=lambda x: (-x[1], x[0]))[:k]
    assert retrieval._best(tables[0], tables[1].slice(0, 0), 5).num_rows == 0


def test_grounding_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(entities, "CELL_PAGES", 3)
    monkeypatch.setattr(entities, "CELL_NEEDLES", 4)
    monkeypatch.setattr(entities, "LONG_PAGE", 120)
    rng = random.Random(3)
    words = ["energy", "water", "fell", "2023", "plants", "é", "waste", "in", "all"]
    texts = {r: [" ".join(rng.choices(words, k=rng.choice([1, 6, 12, 40]))) for _ in range(rng.randint(0, 14))] for r in ("a", "b", "c")}
    rows = []
    for r, pages in texts.items():
        for i in range(40):
            whole = rng.choice(pages) if pages else "energy water fell"
            a = rng.randrange(max(1, len(whole) - 12))
            rows.append((r, i // 4, i % 4, whole[a : a + rng.randint(6, 30)] if i % 3 else " ".join(rng.choices([*words, "unseen"], k=4))))
    frame = spark.createDataFrame([(*x, {"k": "v"}) for x in rows] + [(None, 0, 0, "energy water fell", None)], "report_id string, chunk_index int, position int, extraction_text string, attributes map<string,string>")
    pages = spark.createDataFrame([(r, i * 2, i + 1, f"T{i}", t) for r, ts in texts.items() for i, t in enumerate(ts)], "report_id string, page_seq long, page int, title string, text string")
    made = {(x.report_id, x.chunk_index, x.position): (x.page, x.heading, x.attributes) for x in entities.ground_entities(frame.repartition(3), pages).collect()}
    assert len(made) == len(rows) + 1 and made[(None, 0, 0)] == (None, None, None)
    form = lambda t: " ".join(t.split()).lower()
    for r, ts in texts.items():
        mine = [x for x in rows if x[0] == r]
        tokens = [[p for p in re.split(r"[^a-z0-9%]+", form(x[3])) if len(p) >= 3 or re.search("[0-9]", p)][:14] for x in mine]
        for x, at in zip(mine, place([form(x[3]) for x in mine], tokens, [form(t) for t in ts]), strict=True):
            assert made[x[:3]][:2] == ((None, None) if at is None else (at + 1, f"T{at}")), x


def test_long_reports_by_ranges_equal_short_ones(spark, monkeypatch):
    rng = random.Random(4)
    parts = ["### Page {n} Title {n}", "ANNUAL REPORT OF THE GROUP", "", "Plain words of a paragraph no {n}", "that goes on-", "ward with water", "- an item of a list {n}", "## Heading {n}", "```", "| a | b |", "Page {n}:", "  ", "[...snipped...]"]
    reports = [(f"r{k}", "\n".join(rng.choice(parts).format(n=i) for i in range(n))) for k, n in enumerate([0, 1, 7, 40, 90, 200])] + [("null", None)]
    docs = spark.createDataFrame(reports, "report_id string, text string")
    show = lambda df: sorted(map(str, df.collect()))
    made = {}
    for lines in (20_000, 4):
        monkeypatch.setattr(segment, "RANGE_LINES", lines)
        made[lines] = [show(segment.evidence_blocks(docs, most=None)), show(segment.split_pages_grounding(docs)), show(segment.split_pages_intake(docs))]
    assert made[4] == made[20_000] and len(made[4][0]) > 50
    monkeypatch.setattr(segment, "RANGE_LINES", 50)
    spread = segment.lines(docs.where("report_id = 'r5'"), ranged=True).groupBy("part").count().collect()
    assert sorted(r.part for r in spread) == [0, 1, 2, 3]


def test_a_block_is_read_once_for_all_keywords(spark):
    patterns = [*rules.RULES.values(), *rules.SCOPE3_PATTERNS]
    words = sorted({w for p in patterns for w in rules.needed_words(p) or ()})
    rng = random.Random(5)
    texts = ["".join(rng.choices([*words, " ", "x", "é"], k=12)) for _ in range(300)] + ["", "data", "datadatabase", "sustainabilitysustainab"]
    for text, known in spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.keywords(F.col("t"), patterns)).collect():
        found = known.split("/")[1:]
        assert [w for w in words if w in text] == [w for w in words if any(f.startswith(w) for f in found)]
    counts = spark.createDataFrame([(t,) for t in texts], "text string").select(F.lit("r").alias("report_id"), F.monotonically_increasing_id().alias("block_idx"), F.lit(1).alias("page"), "text")
    hits = features.block_counts(counts).select(F.inline("hits")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    brute = {k: sum(len(re.findall(p, t, 0 if k == "data_tables" else re.I | re.A)) for t in texts) for k, p in rules.RULES.items()}
    assert {r.part: r.n for r in hits if not r.part.startswith("_")} == {k: n for k, n in brute.items() if n}


def test_duplicates_of_hot_keys_meet_three_least_keys(spark):
    existing = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "h").otherwise(F.col("id").cast("string")).alias("sha256"), F.when(F.col("id") % 3 > 0, 2020).alias("year"), F.lit("acme").alias("company_slug"), F.format_string("k%05d", F.col("id")).alias("report_key"))
    new = spark.createDataFrame([(i, "h", 2020, "acme") for i in range(500)] + [(900, "1", None, ""), (901, "", 2020, None), (902, "none", 1999, "acme")], "upload_id long, sha256 string, year int, company_slug string")
    made = intake.find_duplicates(new, existing)
    rows = {r.upload_id: (r.same_hash, r.same_company_year, r.examples) for r in made.collect()}
    assert made.count() == 503 and {v for k, v in map(lambda x: (x, str(rows[x])), range(500))} == {str((True, True, ["k00000", "k00001", "k00002"]))}
    assert rows[900] == (True, False, ["k00001"]) and rows[901] == rows[902] == (False, False, None)
    assert intake.find_duplicates(new.limit(0), existing).count() == 0 and intake.find_duplicates(new, existing.limit(0)).where("same_hash or same_company_year").count() == 0


def test_agreement_and_support(spark):
    shares = lambda *v: spark.createDataFrame([("r", *v)], "report_id string, share_e double, share_s double, share_g double")
    assert entities.pillar_agreement(shares(1.0, 0.0, 0.0), shares(0.5, 0.5, 0.0)).first().agreement == pytest.approx(0.5)
    assert entities.pillar_agreement(shares(0.0, 0.0, 0.0), shares(1.0, 0.0, 0.0)).first().agreement is None
    totals = spark.createDataFrame([("r", "GHG_Emissions", 3.0), ("r", "Supply_Chain_Management", 2.0)], "k string, issue string, score_sum double")
    ents = spark.createDataFrame([("r", "ghg_emissions"), ("r", "social_metric"), ("r", "governance_policy")], "report_id string, extraction_class string")
    assert {r.issue: r.support for r in entities.issue_support(totals, ents).collect()} == {"GHG_Emissions": 1, "Supply_Chain_Management": 2}


# retrieval, conversations, catalogue


def test_retrieval(spark):
    pages = spark.createDataFrame([("r", 1, "some text " * 200), ("r", None, "other text")], "report_id string, page int, text string")
    records = retrieval.vector_records(pages, lambda texts: [[float(len(t)), 1.0] if "other" not in t else [] for t in texts])
    rows = records.collect()
    assert rows and all(r.namespace == "r" and len(r.text) <= 1500 for r in rows)
    assert retrieval.upsert_vectors(records, records).count() == len(rows)
    context = retrieval.retrieved_context(spark.createDataFrame([("q", 1, rows[0].id)], "query_id string, rank int, id string"), records).first().context
    assert context.startswith("Page 1: some text")
    markers = spark.createDataFrame([("a", "error")], "report_id string, status string")
    assert [r.report_id for r in retrieval.pending_index(spark.createDataFrame([("a",), ("b",)], "report_id string"), markers).collect()] == ["b"]


def test_ladder():
    rungs = conversations.ladder()
    assert [r[1] for r in rungs[:5]] == [12000, 9000, 6750, 5062, 4000] and [r[2] for r in rungs[4:10]] == [8000, 6000, 4500, 3375, 2531, 2000]
    assert [r[3] for r in rungs[9:13]] == [12, 9, 6, 4] and rungs[13][1:4] == (0, 0, 4)


def test_catalogue(spark):
    rows = spark.createDataFrame([("1", "Acme", "E-Commerce", None, None), ("2", "Adyen", "E-Commerce", None, None), ("3", "Beta", "Odd", None, None), ("4", "Bank", "Banks", None, None)], "id string, c string, i string, ss string, si string").withColumn("s", F.when(F.col("id") == "4", "Financials").otherwise("Services"))
    got = {r.id: (r.s, r.i, r.si) for r in catalog.to_industry_standard(rows).collect()}
    assert got == {"1": ("Consumer Discretionary", "Consumer Discretionary Distribution & Retail", "E-Commerce"), "2": ("Financials", "Financial Services", "E-Commerce"), "3": ("Unknown", "Unknown", "Odd"), "4": ("Financials", "Banks", None)}
    assert [tuple(r) for r in catalog.unmapped_industries(rows).collect()] == [("Odd", 1)]
    reports = spark.createDataFrame([("a", "Zeta", 2020, 5), ("b", "alpha", 2021, None), ("c", "Beta", 2021, 9)], "report_id string, company string, year int, score int")
    assert [r.report_id for r in catalog.sort_reports(reports).collect()] == ["b", "c", "a"] and [r.report_id for r in catalog.sort_reports(reports, "score").collect()] == ["b", "a", "c"]
    assert [r.report_id for r in catalog.page_of(reports, [F.col("report_id")], 9, 2).collect()] == ["c"]
    assert catalog.run_scope(reports, reports.where("report_id = 'b'")).count() == 1 and catalog.run_scope(reports, None, 2).count() == 2
    slugs = text.assign_slugs(reports.withColumn("pos", F.col("score")), F.lit("x"), ["report_id"])
    assert [r.slug for r in slugs.orderBy("report_id").collect()] == ["x", "x-2", "x-3"]


def test_display_tables(spark):
    hits = spark.createDataFrame([("r", "framework_esrs", True, 9, 6), ("r", "framework_gri", True, 1, 1), ("r", "scope_1", False, 0, 0)], "report_id string, feature_key string, found boolean, occurrences long, pages long")
    quotes = spark.createDataFrame([("r", "framework_esrs", 1, "text", 2), ("r", "water", 1, "late", 3)], "report_id string, feature_key string, rank int, text string, page int")
    row = analytics.category_coverage(hits).first()
    assert (row.category, row.found, row.deep, row.light, row.coverage_pct) == ("Frameworks & Standards", 2, 1, 1, 18)
    assert [r.feature_key for r in analytics.rule_depth_rows(hits, quotes).collect()] == ["framework_esrs", "framework_gri", "water"]
    assert {r.feature_key: (r.found, r.pages) for r in analytics.provenance_rows(hits, quotes).collect()}["water"] == (True, 1)
    assert [r.category for r in analytics.evidence_by_category(quotes).orderBy("position").collect()] == ["Frameworks", "Climate & Environment"]
    flat = spark.createDataFrame([(1, 2, 3, 4)] * 3, "completeness int, consistency int, assurance int, transparency int")
    assert {r.r for r in analytics.subscore_correlations(flat).collect()} == {0.0}


# entry module


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and sum(r.n for r in rows) == 200 and set(registry.ORACLES) <= set(registry.QUERIES)


#: Those of the scoring chain over whole texts and of streams take long; they are compared with DuckDB outside the tests.
SLOW = ("whole_", "score_records", "sector_quality", "rule_counts", "scope3_counts", "feature_coverage", "rescored_records")
FAST = sorted(n for n in registry.ORACLES if not n.startswith(SLOW))


def rows_of(frame):
    names = sorted(frame.columns)
    show = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "events", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, theirs = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(mine) == len(theirs)
    for c in mine.columns:  # one type a column before the rows are compared as text
        if mine[c].dtype != theirs[c].dtype:
            mine[c], theirs[c] = (x[c].astype("float64") if x[c].dtype.kind in "iuf" else x[c] for x in (mine, theirs))
    assert rows_of(mine) == rows_of(theirs)


# whole texts


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """Documents of every kind that a query might leave out: ids of all remainders, all languages and none, empty, null and long texts."""
    own = "Our own line: Scope 2 emissions were 7,310 tCO2e and the living wage is paid to all of the workforce of the group"
    rows = [(i, f"{own} in place {i}\nSecond line Größe Ü{i}", ("en", "de", None, "fr")[i % 4]) for i in range(40)]
    rows += [(95, "", "en"), (97, None, "en"), (98, "\n".join(f"Line {k} of a long text says that climate risk no {k} was reviewed." for k in range(3500)) + "\nThe end speaks of biodiversity offsets near site Omega.", "en")]
    folder = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, t, lang, "src1", len(t or "")) for i, t, lang in rows], DOCUMENT).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_every_document_is_woven(spark, whole):
    texts = {r.doc_id: r.text for r in registry.corpus.seeded_reports(spark, whole).collect()}
    assert len(texts) == 43 and [i for i in range(40) if f"in place {i}\n" not in texts[i]] == []


def test_all_quotes_are_grounded_whole(spark, whole):
    quotes = registry.QUERIES["ranked_evidence"](spark, whole).select("report_id", "text").collect()
    made = registry.QUERIES["grounded_entities"](spark, whole).select("report_id", "extraction_text").collect()
    assert max(len(r.text) for r in quotes) > 60 and sorted(map(tuple, made)) == sorted(map(tuple, quotes))


def test_long_reports_are_read_to_the_end(spark, whole):
    blocks = registry.QUERIES["evidence_blocks"](spark, whole).where("report_id = 'report-98'").select("text").collect()
    joined = "\n".join(r.text for r in blocks)
    woven = next(r.text for r in registry.corpus.seeded_reports(spark, whole).where("doc_id = 98").collect())
    assert "```" in woven and "words in a fence" not in joined  # woven fences are closed and hide nothing else
    assert len(blocks) > segment.MOST_BLOCKS and [k for k in range(3500) if f"risk no {k} was" not in joined] == []
    assert "site Omega" in joined
    row = registry.QUERIES["score_records"](spark, whole).where("report_id = 'report-98'").first()
    assert row.corpus_chars > 350_000 and row.blocks == len(blocks) and row.corpus_sampled is False


def test_rules_and_intake_read_whole_texts(spark, whole):
    counts = {(r.report_id, r.feature_key): r.occurrences for r in registry.QUERIES["whole_rule_counts"](spark, whole).where("feature_key in ('living_wage', 'climate_scenario', 'scope_2', 'biodiversity')").collect()}
    assert [i for i in range(40) if counts.get((f"report-{i}", "living_wage"), 0) < 1 or counts.get((f"report-{i}", "scope_2"), 0) < 1] == []
    texts = {f"report-{r.doc_id}": r.text for r in registry.corpus.seeded_reports(spark, whole).collect()}
    rows = registry.QUERIES["whole_intake_pages"](spark, whole).collect()
    for r in rows:
        if r.report_id in ("report-0", "report-17"):  # one page each, as they have no page marks
            low = texts[r.report_id].lower()
            brute = sum(min(20, len(re.findall(p, low))) * w for p, w in intake.POSITIVE.values())
            assert (r.positive, r.negative) == (brute, sum(min(15, len(re.findall(p, low))) * w for p, w in intake.NEGATIVE))
    assert {r.report_id for r in rows} >= {f"report-{i}" for i in range(40)} and sum(r.report_id == "report-98" for r in rows) == 876


def test_pages_are_scored_to_their_end(spark):
    pages = spark.createDataFrame([("r", 1, "word " * 3000 + "esg biodiversity")], "report_id string, page int, text string")
    assert [intake.score_pages(pages, *limit).first().positive for limit in ((), (intake.PAGE_CHARS,))] == [6, 0]


def test_every_language_is_folded(spark, whole):
    made = {r.doc_id: r.folded for r in registry.QUERIES["folded_text"](spark, whole).where("doc_id < 40").collect()}
    assert len(made) == 40 and all(made[i].endswith(f"in place {i} second line gro e u{i}") for i in made)


def test_ids_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(intake, "SORT_ROWS", 7)
    new = spark.range(100).select((F.col("id") * 37 % 101).alias("upload_id"), F.lit("x").alias("n"))
    known = spark.createDataFrame([("report-10004",), ("report-2000000",), (None,)], "report_id string")
    made = intake.allocate_report_ids(new, known)
    assert [(r.upload_id, r.report_id) for r in made.orderBy("upload_id").collect()] == [(u, f"report-{10005 + i}") for i, u in enumerate(sorted(k * 37 % 101 for k in range(100)))]
    assert made.columns == ["upload_id", "n", "report_id"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and plan.count("Window") <= 2  # offsets only


def test_odd_lines_give_the_same_blocks_in_one_reading_as_line_by_line(spark, monkeypatch):
    rng = random.Random(9)
    parts = ["# Page {n}", "###  Page  00{n}  A title ", "Page {n}:\u0085", "# Page 99999999999 far", "[...SNIPPED...]\u0085", " [...snipped...] ", "#  ", "# He ad", "- ", "- item {n}", "1.  item", "12. Straße-", "über |a|b|", "```x", "page 3:", "a\u0001b  c\td", "ﬁne­ print​ {n}", "ANNUAL REPORT 2024", "İstanbul Annual Report 2{n}", "line\r", "x\r\ny", "--- Page 4 ---", "　", "\U00010400 letters and 123456 digits", "Words of a paragraph {n}"]
    reports = [(f"r{k}", "\n".join(rng.choice(parts).format(n=i % 5) for i in range(rng.randrange(60)))) for k in range(60)]
    docs = spark.createDataFrame(reports, "report_id string, text string")
    made = []
    for lines in (20_000, 3):
        monkeypatch.setattr(segment, "RANGE_LINES", lines)
        made.append(sorted(map(str, segment.evidence_blocks(docs, most=None).collect())))
    assert made[0] == made[1] and len(made[0]) > 300


def test_evidence_blocks_shuffle_texts_and_no_lines(spark):
    docs = spark.createDataFrame([("r", "# Page 1\nWords of a paragraph")], "report_id string, text string")
    plan = segment.evidence_blocks(docs, most=None)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") <= 1


def test_years_that_stand_four_times_count(spark):
    corpus = spark.createDataFrame([("r", "2019 2019 2019,2019 12020 2020 2021 2021 2021 2021 é2021 2022x")], "report_id string, corpus string")
    assert features.quantitative_profile(corpus).first().distinct_years == 2


def test_pages_are_read_once_for_all_signs(spark):
    texts = ["ESG and esg, CO2e; scope 1, Scope  3", "notes to the consolidated financial statements. Dividend " * 20, "", None, "énergie energy WATER " * 15, "esgé Kelvin K ifrs s1"]
    pages = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "report_id string, page int, text string")
    scores = intake.score_pages(pages)
    assert "MapInArrow" in scores._jdf.queryExecution().executedPlan().toString()
    for r in scores.collect():
        hits = {k: min(20, len(re.findall(p, (texts[r.page] or "").lower(), re.A))) for k, (p, _) in intake.POSITIVE.items()}
        assert r.positive == sum(n * intake.POSITIVE[k][1] for k, n in hits.items()) and r.hit_keys == [k for k, n in hits.items() if n]
        assert r.negative == sum(min(15, len(re.findall(p, (texts[r.page] or "").lower(), re.A))) * w for p, w in intake.NEGATIVE)


def test_folding_holds_a_slice_of_texts(spark, monkeypatch):
    texts = ["Éclair", None, "Straße", "ñ" * 10] * 300
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    made = [r.f for r in rows.select("i", folding.search_fold(F.col("t")).alias("f")).orderBy("i").collect()]
    assert made == [folding.fold(t or "") for t in texts]
    held = []
    monkeypatch.setattr(folding, "fold", lambda t: held.append(t) or t)
    monkeypatch.setattr(folding, "slices", lambda batch, at: [held.append("|") or batch.slice(i, 1) for i in range(batch.num_rows)])
    assert folding._fold.func(pa.array(["a", None])).to_pylist() == ["a", None] and held == ["|", "|", "a"]


def test_odd_lines_give_the_same_grounding_pages_in_one_reading_as_line_by_line(spark):
    rng = random.Random(12)
    parts = ["# Page {n}", "###  Page  00{n}  A title ", "Page {n}:\u0085", "Page {n} :\u2028", "\u3000--- Page {n} ---\u00a0", "---Page {n}---\u0085x", "# Page 99999999999 far", "# Page 3 one\u2028two", "##Page 2147483648", "page 3:", "#  ", "word\r", "x\r\ny", "", "\u3000", "\ufeff text \u0085", "Words {n}"]
    reports = [(f"r{k}", "\n".join(rng.choice(parts).format(n=i % 5) for i in range(rng.randrange(30)))) for k in range(80)] + [("empty", ""), ("null", None), (None, "# Page 1\nx")]
    docs = spark.createDataFrame(reports, "report_id string, text string")
    both = segment.split_pages_grounding(docs), segment._grounding_pages(segment.lines(docs))
    made = [sorted(map(str, rows.select("report_id", "page_seq", "page", "title", "text").collect())) for rows in both]
    assert made[0] == made[1] and len(made[0]) > 150


def test_grounding_pages_shuffle_nothing(spark):
    docs = spark.createDataFrame([("r", "# Page 1\nWords")], "report_id string, text string")
    plan = segment.split_pages_grounding(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_form_of_the_search_on_odd_texts(spark):
    texts = ["A\u00a0b*_c", "`x` |  y#>", "co\u00adop \u200bzero\ufeff", "\u3000\t* \n", "", None, "\u039f\u0394\u039f\u03a3`x \u0130", "plain  text ", "\u00ac\u00ae \u2028x_"]
    old = lambda c: tx.collapse_whitespace(F.regexp_replace(F.lower(F.regexp_replace(F.translate(c, tx.NBSP, " "), f"{tx.INVISIBLE}|{tx.SOFT_HYPHEN}", "")), r"[`*_>#|]", " "))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.normalize_for_match(F.col("t")).alias("made"), old(F.col("t")).alias("want")).collect()
    assert [r.made for r in rows] == [r.want for r in rows] and rows[0].made == "a b c"


def test_text_forms_make_the_search_form_once(spark, sf):
    plan = registry.QUERIES["text_forms"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_classes_that_fail_early_find_the_same(spark):
    texts = ["a  b \t c  d ", "■□ ☒ x ✀✩❋ ← ⟷ ▴", "~\x7f!\x1f \x0b.", "", None]
    old = lambda c: F.btrim(F.regexp_replace(c, f"{tx.SPACE}+", " "))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.collapse_whitespace(F.col("t")).alias("a"), old(F.col("t")).alias("b"), tx._unicode_cleanup(F.col("t")).alias("c"), F.regexp_replace(F.regexp_replace("t", tx.SYMBOLS, ""), tx.ARROWS, " - ").alias("d"))
    for r in rows.collect():
        assert r.a == r.b and r.c == r.d


def test_scored_chunks_come_in_slices(spark):
    chunks = spark.range(600).coalesce(1).select("id", F.when(F.col("id") != 9, F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    made = routing.classify_chunks(chunks, lambda texts: [[("n", len(texts)), ("c", len(t))] for t in texts], 100)
    assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    rows = made.orderBy("id").collect()
    assert [len(r.text or "") for r in rows] == [r.scores[1].score for r in rows] and max(r.scores[0].score for r in rows) == 100 and all(r.failure is None for r in rows)


def plain_fnv1a(value):
    h = 2166136261
    for c in value:
        h = ((h ^ ord(c)) * 16777619) % (1 << 32)
    return f"{h:08x}"


def test_hashes_of_texts_go_in_step(spark):
    rng = random.Random(21)
    texts = ["", "a", "é", "\U0001f600", "a\U0001f600b\ud7ff\ue000", "x\x00y", "\U0010ffff", "日本語" * 900] + ["".join(rng.choices("aé日\U0001f600 ", k=rng.randrange(90))) for _ in range(500)]
    want = list(map(plain_fnv1a, texts))
    assert text.fnv1a(texts) == want and text.fnv1a([]) == [] and text.fnv1a(texts[:9]) == want[:9] and text.fnv1a(["x" * 50] * 20) == [plain_fnv1a("x" * 50)] * 20
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").coalesce(1).select("i", text.fnv1a_hex(F.col("t")).alias("h"))
    assert "aggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.h for r in rows.orderBy("i").collect()] == [None, *want]


def test_vector_records_in_slices_equal_a_plain_reading(spark):
    texts = ["", None, " \n", "short é", "\U0001f600 " * 700, "x" * 3000, *(" ".join(f"w{i * j % 97}" for i in range(j)) for j in range(0, 900, 3))]
    pages = spark.createDataFrame([(None if i == 8 else f"r{i}", None if i % 3 == 0 else i, t) for i, t in enumerate(texts)], "report_id string, page bigint, text string").coalesce(1)
    model = lambda found: [[] if len(t) % 5 == 0 else None if len(t) % 7 == 0 else [len(found), len(t) / 3] for t in found]
    records = retrieval.vector_records(pages, model)
    assert "MapInPandas" not in records._jdf.queryExecution().executedPlan().toString()
    assert records.dtypes == [("id", "string"), ("namespace", "string"), ("values", "array<float>"), ("page", "bigint"), ("chunk", "int"), ("text", "string")]
    want = []
    for i, t in enumerate(texts):
        collapsed = " ".join((t or "").split())
        pieces = segment.cut_points(collapsed, 1200, 150, ((" ", 0.6, 0),)) if len(collapsed) > 1200 else [collapsed] * bool(collapsed)
        for k, piece in enumerate(pieces):
            name, page = None if i == 8 else f"r{i}", None if i % 3 == 0 else i
            if len(piece) % 5 and len(piece) % 7:
                want.append((":".join([*([name] if name else []), f"md:{k}" if page is None else str(page), plain_fnv1a(piece)]), name, page, k, piece))
    rows = records.collect()
    assert sorted(map(str, want)) == sorted(str((r.id, r.namespace, r.page, r.chunk, r.text)) for r in rows) and len(rows) > 400
    assert max(r["values"][0] for r in rows) == 24 and all(r["values"][1] == pytest.approx(len(r.text) / 3) for r in rows)


def test_a_worker_keeps_the_hashes_of_words(monkeypatch):
    made = []
    monkeypatch.setattr(flows, "_word_hash", lambda w, f=flows._word_hash: made.append(w) or f(w))
    monkeypatch.setattr(flows, "_HASH_OF", flows._Hashes())
    monkeypatch.setattr(flows._Hashes, "most", 3)
    md5 = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
    texts = ["a b  a", "b a", "", "é " + "x" * 65, "x" * 65, "c d a"]
    for t, row in zip(texts, flows.hashed_vectors(texts), strict=True):
        assert row == [float(sum(md5(w) % flows.DIMENSIONS == i for w in t.split())) for i in range(flows.DIMENSIONS)]
    # kept until three are held, a long word never
    assert made == ["a", "b", "é", "x" * 65, "x" * 65, "c", "d", "a"] and len(flows._HASH_OF) <= 3
    assert flows.hashed_scores(["d a d"]) == [[("Climate Change", sum(md5(w) % 7 - 3 for w in "dad") / 3), ("Human Capital", sum(md5(w) // 7 % 5 - 2 for w in "dad") / 3)]] and made[8:] == []


def odd_reports(spark):
    rng = random.Random(11)
    parts = ["# Page {n}", "Page {n}: ", "ANNUAL REPORT 202{n}", "## Climate", "Scope 1 emissions were 12,40{n} tCO2e in 2023.", "Scope 3 category {n} upstream transport", "Upstream scope 3 and category 1{n} of 2021", "| KPI | 202{n} | 2023 |", "- ESRS E1-{n} water stress, net-zero", "Our target é is to cut 30 % by 203{n}", "ﬁne­ energy 5,200 MWh  und 1.5 °C", "![x](y) [assurance]( ) covers ghg", "--- | ---", "İstanbul Energy consumption K 1.234,5 kwh", "", "", "plain words of the group", "Größe 2018 2019 2018 2018 2018", ("Materiality of the board of directors and 4 % more. " * 9).strip(), "\U00010400 gri"]
    texts = ["\n".join(rng.choice(parts).format(n=i % 5) for i in range(rng.randrange(60))) for _ in range(80)]
    texts += [" ".join(rng.choice(parts[3:]).format(n=i % 5) for i in range(n)) for n in (60, 200)] + ["\n".join([" ".join(parts[4:9])] * 8) + "\n\nPage 2:\n" + "waste management " * 300, "", None, "short"]
    return spark.createDataFrame([(f"r{k}", t) for k, t in enumerate(texts)], "report_id string, text string").repartition(3)


def test_quotes_of_a_report_stay_together(spark):
    docs = odd_reports(spark)
    made = features.ranked_quotes(docs)
    blocks = written(segment.evidence_blocks(docs, most=None))
    show = lambda df: sorted(map(str, df.select("report_id", "feature_key", "block_idx", "page", "heading", "text", "quality", "rank").collect()))
    assert show(made) == show(features.top_quotes(features.quote_candidates(blocks))) and made.where("feature_key = 'scope3_categories'").count() > 5
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the texts, no blocks or quotes
    assert blocks.where("length(text) > 2800").count() > 1


def test_scores_read_a_report_once(spark, monkeypatch):
    docs = odd_reports(spark)
    counted = features.counted_reports(docs)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    names = [*scoring.SUMMARY, "recommendations", "percentage_count", "table_rows", "kpi_numbers", "distinct_years", "numeric_density", "corpus_chars", "pages_detected", "blocks"]
    show = lambda df: sorted(map(str, df.select(*names).collect()))
    made = scoring.score_reports(docs)
    by_rows = scoring.score_blocks(written(segment.evidence_blocks(docs, most=None)))
    assert show(made.where("blocks > 0")) == show(by_rows) and made.where("blocks > 0").count() > 70
    assert {r.report_id: (r.score, r.band, r.blocks, r.numeric_density, r.recommendations, r.corpus_sampled) for r in made.where("blocks = 0").collect()}.items() >= {"r83": (0, "low", 0, 0.0, None, False), "r84": (0, "low", 0, 0.0, None, None)}.items()
    one_way = sorted(map(str, made.collect()))
    monkeypatch.setattr(segment, "RANGE_LINES", 4)
    assert sorted(map(str, scoring.score_reports(docs).collect())) == one_way


def test_cleaning_in_python_equals_the_column(spark):
    rng = random.Random(12)
    signs = ["a", "B ", " ", "  ", "\t", "\n", "\n\n", "\r", "\r\n", " ", "|", "| ", " |", "||", "#", "## ", "---", "-", ":-- | --", "[", "](", ")", "![", "]", "[...snipped...]", "​", "­", "ﬁ", "■", "→", " ", "\x0b", "é", "\U00010400"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(3000)]
    for t, c in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_for_evidence(F.col("t"))).collect():
        assert text.evidence_form(t) == c, repr(t)
        assert text.is_unclean(t) or text.evidence_form(t.strip(text.SPACES)) == t.strip(text.SPACES)


def test_matches_from_the_words_that_they_begin_with():
    kinds = {**rules.RULES, **{f"s{i}": p for i, p in enumerate(rules.SCOPE3_PATTERNS)}}
    find = rule_finder({k: (p, k != "data_tables") for k, p in kinds.items()})
    words = sorted({w for p in kinds.values() for w in [*(rules.leading_words(p) or ()), *(rules.needed_words(p) or ())]}) + ["scope 3", "category 4", "2030", "e1 - 2", "İ", "K", "é", "1", "%", ".", "|", "_"]
    rng = random.Random(13)
    for _ in range(3000):
        t = "".join(rng.choice([w, w.upper()]) + rng.choice(["", " ", " ", "-", "s "]) for w in rng.choices(words, k=12))
        assert find(t) == [(k, n) for k, p in kinds.items() if (n := sum(1 for _ in re.finditer(p, t, re.A if k == "data_tables" else re.A | re.I)))], t
    assert rules.leading_words(r"\b1\.5\s*°?|\bab?c\b") is None and rules.leading_words(r"\b(?:ey\b|sgs)|di&i") == ["di", "ey", "sgs"]


def test_quotes_are_grounded_where_their_report_is_read(spark, monkeypatch):
    docs = odd_reports(spark)
    made = entities.grounded_quotes(docs)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the texts, no quotes or pages
    names = ["report_id", "chunk_index", "position", "extraction_class", "extraction_text", "pillar", "page", "heading"]
    show = lambda df: sorted(map(str, df.select(*names).collect()))
    by_rows = entities.ground_entities(entities._quote_entities(features.ranked_quotes(docs)), segment.split_pages_grounding(docs))
    one_way = show(made)
    assert one_way == show(by_rows) and len({(r.page, r.heading) for r in made.collect()}) > 5
    monkeypatch.setattr(segment, "RANGE_LINES", 4)
    assert show(entities.grounded_quotes(docs)) == one_way


def test_places_of_texts_against_brute_force(spark):
    rng = random.Random(14)
    words = ["water use", "energy", "é", "12 %", "scope", "ab", "the board of", "x1"]
    pages = [("r", i, i % 4 or None, f"t{i}", " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(200)] + ["", "none of these", "Energy | energy"]
    ents = spark.createDataFrame([("r", i, 0, t) for i, t in enumerate(texts)], "report_id string, chunk_index int, position int, extraction_text string")
    table = spark.createDataFrame(pages, "report_id string, page_seq int, page int, title string, text string")
    want = {r.chunk_index: (r.page, r.heading) for r in entities.ground_entities(ents, table).collect()}
    held = [{"page": p, "title": title, "search": text.search_form(body)} for _, _, p, title, body in pages]
    places = entities._places(held, texts)
    assert {i: (None, None) if k is None else (held[k]["page"], held[k]["title"]) for i, k in enumerate(places)} == want and entities._places([], texts) == [None] * len(texts)


def test_search_form_in_python_equals_the_column(spark):
    rng = random.Random(15)
    signs = ["a", "B", " ", "  ", "\t", "\n", "\x1c", "\x85", " ", " ", "﻿", "​", "­", "|", "*", "_", ">", "#", "`", "İ", "Σ", "ΑΣ ", "é", "%", "12", "-x", "ﬁ", "\U00010400"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(3000)]
    t = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(t, text.normalize_for_match(t).alias("m"), text.tokens_of(text.normalize_for_match(t)).alias("k"), text.collapse_whitespace(t).alias("c"))
    for r in rows.collect():
        assert text.search_form(r.t) == r.m and text.search_tokens(r.m) == r.k and text.collapsed(r.t) == r.c, repr(r.t)
