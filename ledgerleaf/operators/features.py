"""Rule detection and ranked evidence over blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerleaf.functions.blocks import rows_with_hits, rule_finder, slices
from ledgerleaf.functions.rules import (
    QUOTES,
    QUOTES_DEFAULT,
    RULE_KEYS,
    RULES,
    SCOPE3_PATTERNS,
    SCOPE3_RULE,
    count_in,
    java,
    leading_words,
    let,
    once,
    plain_words,
)
from ledgerleaf.functions.text import clip_snippet, clipped, collapse_whitespace, collapsed, evidence_form, normalize_for_evidence
from ledgerleaf.operators.segment import assemble_corpus, blocks_of, by_report
from ledgerleaf.sources.tables import written

QUOTE_CHARS = 1400
NEIGHBOUR_CHARS = 800
PREFIX_CHARS = 260
CONTEXT_CHARS = 280

_DIGITS = re.compile("[0-9]+")


def feature_rules() -> list[tuple[str, str, int]]:
    """``(key, pattern, max_quotes)`` of all rules; the composite rule has its first pattern."""
    return [(k, RULES.get(k, SCOPE3_PATTERNS[0]), QUOTES.get(k, QUOTES_DEFAULT)) for k in RULE_KEYS]


#: Rules whose number of pages the scores use.
_DEEP = ["framework_esrs", "framework_gri", "framework_tcfd", "framework_eu_taxonomy", "assurance_any"]

_PARTS = {**{k: p for k, p in RULES.items()}, **{f"_scope3_{i}": p for i, p in enumerate(SCOPE3_PATTERNS)}}


def block_counts(blocks: DataFrame) -> DataFrame:
    """``report_id, block_idx, page_key, hits array<part, n>, quotable`` of blocks with a match.

    A block is read once for the keywords of all patterns; only patterns with a keyword in it are matched. Only parts that match are kept.
    """
    page_key = F.coalesce(F.col("page").cast("string"), F.concat(F.lit("block-"), F.col("block_idx").cast("string")))
    rows = rows_with_hits(blocks.select("report_id", "block_idx", page_key.alias("page_key"), "text"), {k: (p, k != "data_tables") for k, p in _PARTS.items()})
    return rows.select("report_id", "block_idx", "page_key", "hits", (normalize_for_evidence(F.col("text")) != "").alias("quotable"))


def count_features(blocks: DataFrame) -> DataFrame:
    """``report_id, feature_key, found, occurrences, pages`` of the rules with a match; sums per page first, then per report.

    Found means that a quote survives, which it does if a matching block has text after cleaning once more.
    """
    by_part = written(_part_counts(blocks))
    plain = by_part.where(~F.col("part").startswith("_scope3")).withColumnRenamed("part", "feature_key")
    return plain.unionByName(scope3_feature(by_part)).select("report_id", "feature_key", "found", F.col("occurrences").cast("long"), F.col("pages").cast("long"))


def _part_counts(blocks: DataFrame) -> DataFrame:
    """``report_id, part, occurrences, pages, found`` of the parts with a match."""
    hits = block_counts(blocks).select("report_id", "page_key", "quotable", F.inline("hits"))
    by_page = hits.groupBy("report_id", "part", "page_key").agg(F.sum("n").alias("n"), F.max("quotable").alias("found"))
    return by_page.groupBy("report_id", "part").agg(F.sum("n").alias("occurrences"), F.count("*").alias("pages"), F.max("found").alias("found"))


def scope3_feature(by_part: DataFrame) -> DataFrame:
    """The composite rule: found by its first or second pattern, depth of the third, pages of the fourth."""
    of = lambda i, c: F.coalesce(F.max(F.when(F.col("part") == f"_scope3_{i}", F.col(c))), F.lit(0))
    parts = by_part.where(F.col("part").startswith("_scope3")).groupBy("report_id").agg(
        F.coalesce(F.bool_or(F.when(F.col("part").isin("_scope3_0", "_scope3_1"), F.col("found"))), F.lit(False)).alias("found"), (of(0, "occurrences") + of(1, "occurrences")).alias("n"), of(2, "occurrences").alias("occurrences"), of(3, "pages").alias("pages")
    )
    return parts.where("n > 0").select("report_id", F.lit(SCOPE3_RULE).alias("feature_key"), "found", "occurrences", "pages")


def _sentence_bounds(text: str, start: int, end: int) -> tuple[int, int]:
    """Two sentence starts back, two sentence ends on."""
    stops = [0, *[m.end() for m in re.finditer(r"[.!?\n]", text)], len(text)]
    before = lambda at: max(s for s in stops if s <= at)
    after = lambda at: min((s for s in stops if s > at), default=len(text))
    return before(max(0, before(start) - 1)), after(min(len(text), after(end) + 1))


def _around_match(text: str, start: int, length: int, top: int, wide: int) -> str:
    end = min(len(text), start + length)
    a, b = text.rfind("\n\n", 0, start + 2), text.find("\n\n", end)
    para = text[a + 2 if a >= 0 else 0 : b if b >= 0 else len(text)].strip()
    if (a >= 0 or b >= 0) and para and len(para) <= 2 * top:
        return para
    a, b = _sentence_bounds(text, start, end)
    if b - a > 3 * top:
        a, b = max(0, start - wide), min(len(text), end + wide)
    return text[a:b].strip()


@F.pandas_udf(T.StringType())
def _around(texts: pd.Series, starts: pd.Series, lengths: pd.Series, most: pd.Series, context: pd.Series) -> pd.Series:
    out = []
    for text, start, length, top, wide in zip(texts, starts, lengths, most, context, strict=True):
        if max(text, default="") > "\uffff":  # places are given in UTF-16 units
            start = len(text.encode("utf-16-le")[: 2 * start].decode("utf-16-le", "ignore"))
        out.append(_around_match(text, start, length, top, wide))
    return pd.Series(out)


def long_block_snippet(text, start, length, most: int = QUOTE_CHARS, context: int = CONTEXT_CHARS):
    """Around a match (0-based start): its paragraph, else two sentences either side, else ``context`` characters."""
    return clip_snippet(_around(text, start, length, F.lit(most), F.lit(context)), most)


def quote_quality(quote, page):
    """0 to 17 points for figures, units, years, targets, scopes, tables, a page and length."""

    def points(t):
        has = lambda pattern: t.rlike("(?id)" + pattern)
        rated = [
            (has(r"\d+[\.,]?\d*\s*%"), 3), (has(r"\b\d{1,3}[\.,]\d{3}\b"), 3), (has(r"\b(tco2e?|mwh|kwh|gj|tonnes?|tons?|kg)\b"), 3),
            (has(r"\b20[2-3]\d\b"), 1), (has(r"\btarget|\bgoal|\bcommit"), 1), (has(r"\bscope\s*[123]\b"), 1),
            (has(r"\|[^|]+\|"), 2), (page.isNotNull(), 1), (F.length(t) > 80, 1), (F.length(t) > 200, 1),
        ]
        return sum((F.when(c, n).otherwise(0) for c, n in rated), F.lit(0))

    return let(plain_words(quote), points)


_AT_DIGITS = [re.compile(p, re.A) for p in (r"\d+[\.,]?\d*\s*%", r"\b\d{1,3}[\.,]\d{3}\b", r"\b20[2-3]\d\b")]
_AT_WORDS = [(re.compile(p, re.A | re.I), leading_words(p)) for p in (r"\b(tco2e?|mwh|kwh|gj|tonnes?|tons?|kg)\b", r"\btarget|\bgoal|\bcommit", r"\bscope\s*[123]\b")]
_BARS = re.compile(r"\|[^|]+\|")


def _stands(pattern: re.Pattern, words: list[str], text: str, low: str) -> bool:
    """Whether a pattern that begins with one of the words matches; ``low`` is the text in small letters."""
    if len(low) != len(text):
        return bool(pattern.search(text))
    for word in words:
        at = low.find(word)
        while at >= 0:
            if pattern.match(text, at):
                return True
            at = low.find(word, at + 1)
    return False


def _quality_of(quote: str, page: int | None) -> int:
    """``quote_quality`` of one quote; patterns are tried where a run of digits or a word begins with which they begin."""
    low, starts = quote.lower(), [m.start() for m in _DIGITS.finditer(quote)]
    percent, thousands, year = (any(p.match(quote, at) for at in starts) for p in _AT_DIGITS)
    unit, aim, scope = (_stands(p, words, quote, low) for p, words in _AT_WORDS)
    return 3 * (percent + thousands + unit) + year + aim + scope + 2 * bool(quote.count("|") > 1 and _BARS.search(quote)) + (page is not None) + (len(quote) > 80) + (len(quote) > 200)


def _prefix_of(quote: str) -> str:
    """The beginning by which quotes are told apart; mostly a little more than its length decides."""
    head = collapsed(quote[: 2 * PREFIX_CHARS])
    return (head if len(head) > PREFIX_CHARS or len(quote) <= 2 * PREFIX_CHARS else collapsed(quote))[:PREFIX_CHARS]


def quote_candidates(blocks: DataFrame) -> DataFrame:
    """``report_id, feature_key, block_idx, page, heading, text, quality``: quotes in document order.

    A quote is the matching block with its like neighbours, clipped; equal beginnings count once; at most
    three times the rule's quotes are kept, before they are ranked. Where a match stands is looked for in blocks of
    more than two quotes only, as it decides only there.
    """
    w = Window.partitionBy("report_id").orderBy("block_idx")
    same = lambda side: (
        (F.col(f"{side}.kind") == F.col("kind")) & F.col(f"{side}.page").eqNullSafe(F.col("page")) & F.coalesce(F.col(f"{side}.heading"), F.lit("")).eqNullSafe(F.coalesce("heading", F.lit("")))
        & (F.length(F.col(f"{side}.text")) <= NEIGHBOUR_CHARS)
    )
    packed = F.struct("kind", "page", "heading", "text")
    wide = blocks.withColumns({"before": F.lag(packed).over(w), "after": F.lead(packed).over(w)})
    context = F.array_join(F.array_compact(F.array(F.when(same("before"), F.col("before.text")), F.col("text"), F.when(same("after"), F.col("after.text")))), "\n\n")

    rules = [*feature_rules(), ("_second", SCOPE3_PATTERNS[1], QUOTES_DEFAULT)]
    caps = F.create_map(*[x for k, _, quotes in rules for x in (F.lit(k), F.lit(3 * quotes))])
    found = F.transform("hits", lambda h: F.struct(h["part"].alias("feature_key"), caps[h["part"]].alias("cap")))
    by_rule = {k: (p, k != "data_tables") for k, p, _ in rules}
    # a block's quote is the same for every rule it matches, unless the block is long
    is_long = F.length("text") > 2 * QUOTE_CHARS
    names = ["report_id", "block_idx", "page", "heading"]
    short = rows_with_hits(wide.where(~is_long).select(*names, "text", context.alias("context")), by_rule)
    short = once(short, {"quote": clip_snippet(F.col("context"), QUOTE_CHARS, 3)}, "quote <> ''").select(*names, "quote", F.inline(found))
    pattern = F.element_at(F.create_map(*[x for k, p, _ in rules for x in (F.lit(k), F.lit(java(p, k != "data_tables")))]), F.col("feature_key"))
    long = rows_with_hits(blocks.where(is_long).select(*names, "text"), by_rule).select(*names, "text", F.inline(found)).withColumn("pattern", pattern)
    at, size = F.regexp_instr("text", F.col("pattern")) - 1, F.length(F.regexp_substr("text", F.col("pattern")))
    long = long.withColumn("quote", long_block_snippet(F.col("text"), at, size)).where("quote <> ''").select(*short.columns)
    prefix = F.substring(collapse_whitespace(F.col("quote")), 1, PREFIX_CHARS).alias("prefix")
    first = F.min_by(F.struct("block_idx", "page", "heading", "quote", "cap"), F.col("block_idx")).alias("first")
    quotes = short.unionByName(long).groupBy("report_id", "feature_key", prefix).agg(first).select("report_id", "feature_key", "first.*")
    order = F.row_number().over(Window.partitionBy("report_id", "feature_key").orderBy("block_idx"))
    kept = quotes.withColumn("nth", order).where((F.col("nth") <= 3 * max(QUOTES.values())) & (F.col("nth") <= F.col("cap")))
    # the second pattern of the composite rule counts where the first has no match in the report; few rows of a report are left here
    firsts = F.max((F.col("feature_key") == SCOPE3_RULE).cast("int")).over(Window.partitionBy("report_id"))
    kept = kept.withColumn("has_first", firsts).where("feature_key <> '_second' or has_first = 0")
    key = F.when(F.col("feature_key") == "_second", SCOPE3_RULE).otherwise(F.col("feature_key")).alias("feature_key")
    return kept.select("report_id", key, "block_idx", "page", "heading", F.col("quote").alias("text"), quote_quality(F.col("quote"), F.col("page")).alias("quality"))


def top_quotes(candidates: DataFrame) -> DataFrame:
    """The best quotes of each rule by quality, ties in document order, with their ``rank`` from 1."""
    most = F.coalesce(*[F.when(F.col("feature_key") == k, n) for k, n in QUOTES.items()], F.lit(QUOTES_DEFAULT))
    rank = F.row_number().over(Window.partitionBy("report_id", "feature_key").orderBy(F.desc("quality"), "block_idx"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= most)


# The same for reports that are read in one go


_RULE_CAPS = {k: 3 * quotes for k, _, quotes in feature_rules()} | {"_second": 3 * QUOTES_DEFAULT}
_MATCHED = "block_idx int, page int, heading string, context string, keys array<string>"
_PICKED = "report_id string, feature_key string, block_idx int, page int, heading string, text string, quality int, rank int"


def _matched_blocks(text: str, find, patterns: dict[str, re.Pattern]) -> list[tuple]:
    """Blocks of one report with a match, in order: rows of _MATCHED. The context is the block with its like neighbours, of a long block what stands around each rule's first match, a row a rule."""
    made, blocks = [], blocks_of(text)
    for i, (kind, _, page, heading, body, marked) in enumerate(blocks):
        hits = [k for k, _ in find(body)]
        if not hits:
            continue
        if len(body) > 2 * QUOTE_CHARS:
            for key in hits:
                at = patterns[key].search(body)
                made.append((i, page, heading, evidence_form(_around_match(body, at.start(), at.end() - at.start(), QUOTE_CHARS, CONTEXT_CHARS)), [key]))
            continue
        near = lambda j, k=kind, p=page, h=heading: 0 <= j < len(blocks) and blocks[j][0] == k and blocks[j][2] == p and (blocks[j][3] or "") == (h or "") and len(blocks[j][4]) <= NEIGHBOUR_CHARS
        held = [b for j, b in ((i - 1, None), (i, None), (i + 1, None)) if j == i or near(j) for b in (blocks[j],)]
        context = "\n\n".join(b[4] for b in held)
        made.append((i, page, heading, evidence_form(context) if any(b[5] for b in held) else context, hits))
    return made


def _picked(rows: list[tuple]) -> list[tuple]:
    """The best quotes of each rule of one report from rows ``block_idx, page, heading, quote, keys`` in order: ``feature_key, block_idx, page, heading, quote, quality, rank``."""
    found: dict[str, dict[str, tuple]] = {}
    for block_idx, page, heading, quote, keys in rows:
        prefix = _prefix_of(quote)
        row = None
        for key in keys:
            kept = found.setdefault(key, {})
            if len(kept) < _RULE_CAPS[key] and prefix not in kept:
                row = row or (block_idx, page, heading, quote, _quality_of(quote, page))
                kept[prefix] = row
    second = found.pop("_second", None)
    if second and SCOPE3_RULE not in found:
        found[SCOPE3_RULE] = second
    best = {key: sorted(kept.values(), key=lambda q: (-q[4], q[0]))[: QUOTES.get(key, QUOTES_DEFAULT)] for key, kept in found.items()}
    return [(key, *q, rank) for key in RULE_KEYS if key in best for rank, q in enumerate(best[key], 1)]


def quotes_of_reports(reports: DataFrame, held: Callable[[str], list[tuple]], held_kind: pa.DataType, held_schema: str, make: Callable[[list[tuple], list[tuple]], list[tuple]], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """``make(held(text), quotes)`` of each of the dealt reports, the quotes being the rows of ``_picked``: what a report holds and its quotes stay together, so that nothing is shuffled.

    ``held`` gives rows of ``held_schema``; ``schema`` begins with the ``report_id``, which ``make`` leaves out.
    """
    rules = {k: (p, k != "data_tables") for k, p, _ in [*feature_rules(), ("_second", SCOPE3_PATTERNS[1], QUOTES_DEFAULT)]}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, patterns = rule_finder(rules), {k: re.compile(p, re.A | re.I if fold else re.A) for k, (p, fold) in rules.items()}
        columns = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(held_kind)]
        for batch in batches:
            for part in slices(batch, 1):
                of_row = []
                for t in part.column(1).to_pylist():
                    rows = _matched_blocks(t, find, patterns) if t else []
                    of_row.append([(*r, held(t) if i == 0 else None) for i, r in enumerate(rows)])
                at = pa.array([i for i, rows in enumerate(of_row) for _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *(pa.array([r[i] for rows in of_row for r in rows], kind) for i, kind in enumerate(columns))], names=["report_id", *(c.split()[0] for c in _MATCHED.split(", ")), "held"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        report, kept, rows = None, [], []

        def done(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for part in slices(batch, 4):
                out = []
                for r, *row, more in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if r != report or more is not None:
                        out += [(report, *x) for x in make(kept, _picked(rows))]
                        report, kept, rows = r, more or [], []
                    if row[3]:
                        rows.append(row)
                yield done(out)
        yield done([(report, *x) for x in make(kept, _picked(rows))])

    found = reports.mapInArrow(match, f"report_id string, {_MATCHED}, held array<struct<{held_schema}>>")
    return found.select("report_id", "block_idx", "page", "heading", clipped(F.col("context"), QUOTE_CHARS, 3).alias("quote"), "keys", "held").mapInArrow(pick, schema)


def _short_quotes(reports: DataFrame) -> DataFrame:
    """``ranked_quotes`` of dealt reports."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    return quotes_of_reports(reports, lambda _: [], pa.struct([("none", pa.bool_())]), "none:boolean", lambda _, quotes: quotes, kinds, _PICKED)


def ranked_quotes(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """``top_quotes`` of the ``quote_candidates`` of all evidence blocks of whole reports. A ``report_id`` is one row.

    Reports of up to RANGE_LINES lines keep their blocks and quotes together, so only texts are shuffled; the blocks of longer ones are rows.
    """
    return by_report(reports, text_col, _short_quotes, lambda _, blocks: top_quotes(quote_candidates(blocks)))


# Figures that the profile counts.
_YEAR, _YEARS, _UNIT = r"\b(20(?:1[89]|2[0-6]))\b", range(2018, 2027), r"\b(mwh|kwh|gj|m3)\b"
_PERCENTAGE, _TABLE_ROW, _NUMBER = r"\d+[\.,]?\d*\s*%", r"\|[^|\n]+\|[^|\n]+\|", r"\b\d[\d,.\s]*\d\b|\b\d+\s*%"
_KPI = r"\b\d{1,3}(?:[,.\s]\d{3})+\b|\b\d+[\.,]\d+\s*(?:%|tco2e?|mwh|kwh|gj|tonnes?|kg|m3|litres?)\b"


def _density(numbers: Column, chars: Column) -> Column:
    return F.floor(numbers / F.greatest(F.lit(1), chars) * 1000 * 100 + 0.5) / 100


def quantitative_profile(corpus: DataFrame) -> DataFrame:
    """Counts of figures in each corpus, and figures per 1000 characters."""
    c, plain = F.col("corpus"), F.col("plain")
    rows = once(corpus, {"plain": plain_words(c)})
    rows = once(rows, {"found": F.regexp_extract_all(plain, F.lit(_YEAR), F.lit(1))})
    often = lambda year: F.size(F.filter("found", lambda x: x == year)) >= 4
    years = [F.when(often(str(y)), 1).otherwise(0) for y in _YEARS]
    numbers = count_in(plain, _NUMBER, False)
    return rows.select(
        "report_id",
        count_in(plain, _PERCENTAGE, False).alias("percentage_count"),
        count_in(plain, _TABLE_ROW, False).alias("table_rows"),
        count_in(plain, _KPI).alias("kpi_numbers"),
        sum(years, F.lit(0)).alias("distinct_years"),
        _density(numbers, F.length(c)).alias("numeric_density"),
        (c.contains("%") | (count_in(plain, _UNIT) > 0)).alias("has_units"),
        c.rlike(RULES["data_tables"]).alias("has_table"),
        F.length(c).alias("corpus_chars"),
    )


_OF_DIGITS = [re.compile(p, re.A | flag) for p, flag in ((_PERCENTAGE, 0), (_KPI, re.I), (_NUMBER, 0))]
_ROW, _UNITS, _TABLE, _SOME_YEAR = re.compile(_TABLE_ROW), re.compile(_UNIT, re.A | re.I), re.compile(RULES["data_tables"]), re.compile(_YEAR, re.A)


def _figures(corpus: str) -> tuple:
    """``quantitative_profile`` of one corpus: percentages, table rows, kpi numbers, years, numbers, units, tables, characters. A match that begins with a digit begins a run of digits."""
    starts, counts = [m.start() for m in _DIGITS.finditer(corpus)], []
    has_percent, has_table = "%" in corpus, corpus.count("|") > 2
    for pattern in _OF_DIGITS:
        n, end = 0, 0
        for at in starts if has_percent or pattern is not _OF_DIGITS[0] else ():
            if at >= end and (m := pattern.match(corpus, at)):
                n, end = n + 1, m.end()
        counts.append(n)
    years = [m[0] for at in starts if corpus.startswith("20", at) and (m := _SOME_YEAR.match(corpus, at))]
    often = sum(years.count(str(y)) >= 4 for y in _YEARS)
    return counts[0], len(_ROW.findall(corpus)) if has_table else 0, counts[1], often, counts[2], has_percent or bool(_UNITS.search(corpus)), has_table and bool(_TABLE.search(corpus)), len(corpus)


_COUNTED = "report_id string, without_text boolean, hits array<struct<part:string,n:long,pages:long,found:boolean>>, pages_detected int, blocks long, percentage_count int, table_rows int, kpi_numbers int, distinct_years int, numbers int, has_units boolean, has_table boolean, corpus_chars int"


def _counted(text: str, find) -> tuple | None:
    """``hits, pages_detected, blocks`` and the figures of one report; None if it has no blocks."""
    blocks, parts = blocks_of(text), {}
    if not blocks:
        return None
    for i, (_, _, page, _, body, marked) in enumerate(blocks):
        hits = find(body)
        found = bool(hits) and (not marked or evidence_form(body) != "")
        for part, n in hits:
            of_part = parts.setdefault(part, [0, set(), False])
            of_part[0] += n
            of_part[1].add(f"block-{i}" if page is None else page)
            of_part[2] |= found
    corpus = "\n\n".join(b[4] for b in blocks)
    figures = _figures(evidence_form(corpus) if any(b[5] for b in blocks) else corpus)
    return [{"part": k, "n": n, "pages": len(pages), "found": found} for k, (n, pages, found) in parts.items()], max((b[2] for b in blocks if b[2] is not None), default=None), len(blocks), *figures


def _short_counts(reports: DataFrame) -> DataFrame:
    """Rows of _COUNTED of dealt reports, each from one reading of its text; reports without blocks have nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = rule_finder({k: (p, k != "data_tables") for k, p in _PARTS.items()})
        hit = pa.struct([("part", pa.string()), ("n", pa.int64()), ("pages", pa.int64()), ("found", pa.bool_())])
        kinds = [pa.list_(hit), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.bool_(), pa.bool_(), pa.int32()]
        names = [c.split()[0] for c in _COUNTED.split(", ")]
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(_counted(t, find) if t else None) or [None] * len(kinds) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).is_null(), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=names)

    return reports.mapInArrow(count, _COUNTED).withColumn("numeric_density", _density(F.col("numbers"), F.col("corpus_chars"))).drop("numbers")


def counted_blocks(blocks: DataFrame, corpus: DataFrame) -> DataFrame:
    """``report_id, hits, pages_detected, blocks`` and the profile from blocks as rows and their corpus."""
    hits = _part_counts(blocks).groupBy("report_id").agg(F.collect_list(F.struct("part", F.col("occurrences").alias("n"), "pages", "found")).alias("hits"))
    return quantitative_profile(corpus).join(corpus_stats(blocks), "report_id").join(hits, "report_id", "left")


def counted_reports(reports: DataFrame, text_col: str = "text") -> DataFrame:
    """``report_id, without_text, hits array<part, n, pages, found>, pages_detected, blocks`` and the columns of ``quantitative_profile`` from whole texts; nulls where a report has no blocks. A ``report_id`` is one row.

    A report of up to RANGE_LINES lines is read once for its blocks, the rules and its figures; only texts are shuffled. The blocks of longer ones are rows.
    """
    names = ["report_id", "without_text", "hits", "pages_detected", "blocks", "percentage_count", "table_rows", "kpi_numbers", "distinct_years", "numeric_density", "has_units", "has_table", "corpus_chars"]
    long = lambda _, blocks: counted_blocks(blocks, assemble_corpus(blocks)).withColumn("without_text", F.lit(False)).select(*names)
    return by_report(reports, text_col, lambda rows: _short_counts(rows).select(*names), long)


def counted_vector(counted: DataFrame) -> DataFrame:
    """Add the columns of ``feature_vector`` to rows with ``hits`` and ``has_table``."""
    of_part = F.map_from_arrays(F.transform("hits", lambda h: h["part"]), F.col("hits"))
    rows = counted.withColumn("_of", F.coalesce(of_part, F.create_map().cast("map<string,struct<part:string,n:bigint,pages:bigint,found:boolean>>")))
    part = lambda k: F.try_element_at("_of", F.lit(k))
    is_found = lambda k: F.coalesce(part(k)["found"], F.lit(False))
    found = {k: is_found(k) for k in RULE_KEYS} | {SCOPE3_RULE: is_found("_scope3_0") | is_found("_scope3_1")}
    found["data_tables"] &= F.coalesce("has_table", F.lit(False))
    return rows.withColumns(found | {f"{k}_pages": F.coalesce(part(k)["pages"], F.lit(0)) for k in _DEEP}).drop("_of", "hits")


def corpus_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("report_id").agg(F.max("page").alias("pages_detected"), F.count("*").alias("blocks"))


def feature_hits(blocks: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``count_features``; with a corpus, table rows count only where it still has one after its second cleaning."""
    counts = count_features(blocks)
    if corpus is None:
        return counts
    tables = corpus.select("report_id", F.col("corpus").rlike(r"\|[^|]+\|[^|]+\|").alias("has_table"))
    return counts.join(tables, "report_id", "left").where("feature_key <> 'data_tables' or has_table").drop("has_table")


def feature_vector(hits: DataFrame) -> DataFrame:
    """A row a report: a boolean a rule, and the pages of the rules whose depth the scores use."""
    found = [F.coalesce(F.max(F.when(F.col("feature_key") == k, F.col("found"))), F.lit(False)).alias(k) for k in RULE_KEYS]
    pages = [F.coalesce(F.max(F.when(F.col("feature_key") == k, F.col("pages"))), F.lit(0)).alias(f"{k}_pages") for k in _DEEP]
    return hits.groupBy("report_id").agg(*found, *pages)


def quote_batch(quotes: DataFrame, features: int = 20, each: int = 3, chars: int = 600) -> DataFrame:
    """The first ``each`` quotes of the first ``features`` rules of a report, cut, as input for an outside rewrite."""
    position = F.element_at(F.create_map(*[x for i, k in enumerate(RULE_KEYS) for x in (F.lit(k), F.lit(i))]), F.col("feature_key"))
    rows = quotes.withColumn("position", position)
    nth = F.dense_rank().over(Window.partitionBy("report_id").orderBy("position"))
    return rows.withColumn("nth", nth).where((F.col("nth") <= features) & (F.col("rank") <= each)).select("report_id", "feature_key", "rank", "page", F.substring("text", 1, chars).alias("text"))


def merge_refined_quotes(quotes: DataFrame, refined: DataFrame) -> DataFrame:
    """A rule's quotes replaced by rewritten ones of ten characters or more; page and heading default to the first original's.

    ``refined``: ``report_id, feature_key, rank, text, page, heading``. ``refined`` marks replaced rules.
    """
    new = refined.where(F.length(F.trim("text")) >= 10)
    first = quotes.where("rank = 1").select("report_id", "feature_key", F.col("page").alias("page0"), F.col("heading").alias("heading0"))
    made = new.join(first, ["report_id", "feature_key"]).select("report_id", "feature_key", "rank", F.coalesce("page", "page0").alias("page"), F.coalesce("heading", "heading0").alias("heading"), "text", F.lit(True).alias("refined"))
    kept = quotes.join(made.select("report_id", "feature_key").distinct(), ["report_id", "feature_key"], "left_anti")
    return kept.select("report_id", "feature_key", "rank", "page", "heading", "text", F.lit(False).alias("refined")).unionByName(made)


def topic_sample(quotes: DataFrame, n: int | None = 20, least: int = 30) -> DataFrame:
    """The first ``n`` quotes (all if None) of a report longer than ``least`` characters, in rule order."""
    position = F.element_at(F.create_map(*[x for i, k in enumerate(RULE_KEYS) for x in (F.lit(k), F.lit(i))]), F.col("feature_key"))
    rows = quotes.where(F.length("text") > least).withColumn("position", position)
    nth = F.row_number().over(Window.partitionBy("report_id").orderBy("position", "rank"))
    rows = rows.withColumn("nth", nth)
    return (rows if n is None else rows.where(F.col("nth") <= n)).select("report_id", "nth", "feature_key", "text")
