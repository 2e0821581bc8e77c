"""Segmentation of report text: pages, boilerplate, evidence blocks, chunks.

Lines are dealt by ``report_id`` once; windows and aggregates below are keyed by the report or by report
and page, so they keep that partitioning. Evidence blocks of reports of up to RANGE_LINES lines need no lines as
rows: a report's lines are marked and joined in one reading (``blocks_of``). Longer reports of more than RANGE_LINES lines go another way: their lines are dealt by ranges and every
window is keyed by the range, so that one report spreads over tasks. What a range must know of those before it (the open page, open
fences, the heading, breaks passed) is a prefix sum over rows of one a range (``_carried``), joined to the range's lines. These steps are
written one by one, for long reports only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerleaf.functions.blocks import line_pattern, slices
from ledgerleaf.functions.rules import once
from ledgerleaf.functions.text import (
    BLANKS,
    SPACES,
    collapse_whitespace,
    evidence_form,
    is_unclean,
    line_ends,
    normalize_for_evidence,
    single_blanks,
    trim_space,
)
from ledgerleaf.sources.tables import written

# Lines that mark pages.
_SNIP = r"(?i)^\[\.\.\.snipped\.\.\.\]$"
_HEADING_PAGE = r"^\s*#{1,6}\s*Page\s+(\d+)\s*(.*)$"
_VIEWER_PAGE = r"^\s*Page\s+(\d+):\s*$"
_DASH_PAGE = r"^\s*---\s*Page\s+(\d+)\s*---\s*$"
_LOOSE_HEADING = r"(?i)^\s*#{1,6}\s*Page\s+(\d+)(?!\w).*$"
_LOOSE_VIEWER = r"^\s*Page\s+(\d+)\s*:\s*$"
# Lines of a page that are headings, items, fences or page words.
_HEADING, _ITEM, _FENCE, _PAGE_WORD = r"^\s*#{1,6}\s+(.+)$", r"^\s*(?:[-*•]|\d+\.)\s+(.+)$", r"^\s*```", r"(?i)^\s*Page\s+\d+:\s*$"
# Lines that cannot be boilerplate, and signs and shares of those that are.
_NO_CANDIDATE = r"(?i)^\s*#{1,6}\s+|^\s*(?:[-*•]|\d+\.)\s+|^\s*\||^\s*\[\.\.\.snipped\.\.\.\]\s*$|^\s*page\s+\d+:?\s*$"
_REPORT_NAME = r"(?i)universal\s+registration\s+document|registration\s+document|annual\s+report|sustainability\s+statement|sustainability\s+report|integrated\s+report"
_CANDIDATE_CHARS, _EDGE_LINES, _LEAST_PAGES, _PAGE_SHARE = (8, 200), 5, 3, 0.25
_CAPITALS, _CAPITALS_AND_DIGITS, _DIGITS = (10, 0.82), (6, 0.68, 3), (6, 80)
#: Bytes of report text that a partition of lines holds, about; the work on a line is far heavier than its bytes.
_PARTITION_BYTES = 16 << 20
#: From here on a size is Spark's guess for an input that states none.
_UNKNOWN_SIZE = 1 << 55
#: A page's blocks stop the report once it has so many, after that page.
MOST_BLOCKS = 800
#: Joins a paragraph's lines until hyphens at line ends are dealt with.
_WRAP = "\u0001"


#: Lines of a range; a report of more lines is dealt over several tasks.
RANGE_LINES = 20_000


def lines(df: DataFrame, text_col: str = "text", ranged: bool = False) -> DataFrame:
    """``report_id, line_no, line``; dealt by report over partitions whose number follows from the size of the input.

    A report's lines stay together from here on, as windows and aggregates below are keyed by it. With ``ranged`` there is a range ``part``, and the lines of a range stay together.
    """
    rows = df.select("report_id", F.posexplode(F.split(line_ends(F.col(text_col)), "\n")).alias("line_no", "line"))
    if ranged:
        rows = rows.withColumn("part", F.floor(F.col("line_no") / RANGE_LINES).cast("int"))
    return rows.repartition(_partitions(df), *_keys(rows))


def _partitions(df: DataFrame) -> int:
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // _PARTITION_BYTES if size < _UNKNOWN_SIZE else 0)


def _by_length(df: DataFrame, text_col: str, make: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``make(reports, ranged)`` of the reports of up to RANGE_LINES lines, and with ``ranged`` of the others, if there are any."""
    text = F.col(text_col)
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + F.length(text) - F.length(F.replace(text, F.lit("\r")))
    is_long = F.coalesce((F.length(text) >= RANGE_LINES) & (breaks >= RANGE_LINES), F.lit(False))
    long = written(df.where(is_long).select("report_id", text_col))
    short = make(df.where(~is_long), False)
    return short if long.isEmpty() else short.unionByName(make(long, True))


def _keys(rows: DataFrame) -> list[str]:
    return ["report_id", "part"] if "part" in rows.columns else ["report_id"]


def _carried(rows: DataFrame, key: str | None, sums: dict[str, Column], lasts: dict[str, Column] | None = None, backwards: bool = False) -> DataFrame:
    """For each range in which a report (or its page, the ``key``) goes on: sums and last values of its ranges before (after it, if ``backwards``).

    At most one page goes on in a range, and one goes on after it, so a range has one row at most: ``report_id, part, at_page, <name>_before``.
    """
    keys, lasts = ["report_id", *([key] if key else [])], lasts or {}
    last = {n: F.max_by(c, F.when(c.isNotNull(), F.col("line_no"))) for n, c in lasts.items()}
    totals = rows.groupBy(*keys, "part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in last.items()])
    order = Window.partitionBy(*keys).orderBy(F.desc("part") if backwards else F.col("part"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = totals.select(*keys, "part", F.row_number().over(order).alias("nth"), *[F.sum(n).over(before).alias(f"{n}_before") for n in sums], *[F.last(n, ignorenulls=True).over(before).alias(f"{n}_before") for n in lasts])
    found = found.where("nth > 1").drop("nth")
    return found.withColumnRenamed(key, "at_page") if key else found


def _running(rows: DataFrame, key: str | None, sums: dict[str, Column], lasts: dict[str, Column] | None = None, backwards: bool = False) -> DataFrame:
    """``rows`` with sums and last values up to each line of its report, or of its page with ``key``; from the end on if ``backwards``."""
    lasts = lasts or {}
    order = Window.partitionBy(*_keys(rows), *([key] if key else [])).orderBy(F.desc("line_no") if backwards else F.col("line_no"))
    made = {n: F.sum(c).over(order) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(order) for n, c in lasts.items()}
    if "part" not in rows.columns:
        return rows.withColumns(made)
    rows = written(rows)
    goes_on = F.col("page_seq") == F.col("at_page") if key else F.lit(True)
    joined = rows.withColumns(made).join(_carried(rows, key, sums, lasts, backwards), ["report_id", "part"], "left")
    whole = {n: F.col(n) + F.coalesce(F.when(goes_on, F.col(f"{n}_before")), F.lit(0)) for n in sums} | {n: F.coalesce(n, F.when(goes_on, F.col(f"{n}_before"))) for n in lasts}
    return joined.withColumns(whole).drop("at_page", *[f"{n}_before" for n in made])


def _pages_by(rows: DataFrame, start: Column, number: Column, title: Column) -> DataFrame:
    """Lines that follow a marker get its number and title; ``page_seq`` counts markers passed."""
    rows = rows.withColumn("is_start", start).withColumn("marked", F.when(F.col("is_start"), F.struct(number.alias("page"), title.alias("title"))))
    paged = _running(rows, None, {"page_seq": F.col("is_start").cast("long")}, {"mark": F.col("marked")})
    return paged.select(*_keys(rows), "line_no", "line", "is_start", "page_seq", F.col("mark.page").alias("page"), F.col("mark.title").alias("title"))


def split_pages(df: DataFrame, text_col: str = "text", ranged: bool = False) -> DataFrame:
    """Lines of evidence pages: ``report_id, page_seq, page, title, line_no, line``, and ``part`` of reports dealt by ranges.

    ``# Page N title`` and ``Page N:`` start a page, a snip mark starts one without a number; pages of blank
    lines only are dropped. A text without markers is one page without a number.
    """
    line = F.col("line")
    heading = F.regexp_extract(line, _HEADING_PAGE, 1)
    viewer = F.regexp_extract(line, _VIEWER_PAGE, 1)
    snip = trim_space(line).rlike(_SNIP)
    number = F.coalesce(F.nullif(heading, F.lit("")), F.nullif(viewer, F.lit(""))).try_cast("int")
    title = F.nullif(trim_space(F.regexp_extract(line, _HEADING_PAGE, 2)), F.lit(""))
    paged = _pages_by(lines(df, text_col, ranged), snip | (heading != "") | (viewer != ""), F.when(~snip, number), F.when(~snip & (heading != ""), title))
    body = paged.where(~F.col("is_start")).withColumn("filled", (trim_space(F.col("line")) != "").cast("long"))
    names = [*_keys(body), "page_seq", "page", "title", "line_no", "line"]
    if not ranged:
        return body.withColumn("some", F.max("filled").over(Window.partitionBy("report_id", "page_seq"))).where("some = 1").select(*names)
    filled = F.col("filled")
    return _running(_running(body, "page_seq", {"upto": filled}), "page_seq", {"onward": filled}, backwards=True).where("upto + onward > 0").select(*names)


def _joined_pages(paged: DataFrame) -> DataFrame:
    body = F.array_sort(F.collect_list(F.when(~F.col("is_start"), F.struct("line_no", "line"))))
    text = trim_space(F.array_join(F.transform(body, lambda x: x["line"]), "\n"))
    return paged.groupBy("report_id", "page_seq").agg(F.first("page").alias("page"), F.first("title").alias("title"), text.alias("text"))


def split_pages_grounding(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``report_id, page_seq, page, title, text``: as ``split_pages``, with dashed markers, texts joined and trimmed. A ``report_id`` is one row.

    Reports of up to RANGE_LINES lines are read in one go, where they are; only longer ones go line by line.
    """
    return _by_length(df, text_col, lambda some, ranged: _grounding_pages(lines(some, text_col, ranged)) if ranged else _short_pages(some, text_col))


def _grounding_pages(rows: DataFrame) -> DataFrame:
    line, trimmed = F.col("line"), trim_space(F.col("line"))
    heading = F.regexp_extract(line, _HEADING_PAGE, 1)
    other = F.coalesce(F.nullif(F.regexp_extract(trimmed, _DASH_PAGE, 1), F.lit("")), F.regexp_extract(trimmed, _LOOSE_VIEWER, 1))
    number = F.coalesce(F.nullif(heading, F.lit("")), F.nullif(other, F.lit(""))).try_cast("int")
    title = F.when(heading != "", F.nullif(trim_space(F.regexp_extract(line, _HEADING_PAGE, 2)), F.lit("")))
    pages = _joined_pages(_pages_by(rows, (heading != "") | (other != ""), number, title))
    return pages.where("text <> ''")


def split_pages_intake(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``report_id, page_seq, page, text``: three markers in any case; text before the first is dropped, empty pages stay.

    A text without markers is page 1 with its white space collapsed.
    """
    return _by_length(df, text_col, lambda some, ranged: _intake_pages(lines(some, text_col, ranged)))


def _intake_pages(rows: DataFrame) -> DataFrame:
    line, trimmed = F.col("line"), trim_space(F.col("line"))
    number = F.coalesce(
        F.nullif(F.regexp_extract(line, _LOOSE_HEADING, 1), F.lit("")),
        F.nullif(F.regexp_extract(trimmed, f"(?i){_DASH_PAGE}", 1), F.lit("")),
        F.nullif(F.regexp_extract(trimmed, f"(?i){_LOOSE_VIEWER}", 1), F.lit("")),
    ).try_cast("int")
    pages = _joined_pages(_pages_by(rows, number.isNotNull(), number, F.lit(None).cast("string")))
    marked = Window.partitionBy("report_id")
    pages = pages.withColumn("n_marked", F.max("page_seq").over(marked))
    whole = F.when(F.col("n_marked") == 0, collapse_whitespace(F.col("text"))).otherwise(F.col("text"))
    kept = pages.where("page_seq > 0 or n_marked = 0").withColumn("text", whole).withColumn("page", F.when(F.col("n_marked") == 0, 1).otherwise(F.col("page")))
    return kept.where("n_marked > 0 or text <> ''").select("report_id", "page_seq", "page", "text")


def split_context_pages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``report_id, seq, page, text`` from inline ``Page N:`` markers; text before the first is dropped."""
    parts = F.split(line_ends(F.col(text_col)), r"(?=(?:(?<=\n)|\A)Page \d+:\n)")
    rows = df.select("report_id", F.posexplode(parts).alias("seq", "part"))
    page = F.regexp_extract("part", r"^Page (\d+):\n", 1).try_cast("int")
    return rows.select("report_id", "seq", page.alias("page"), trim_space(F.regexp_replace("part", r"^Page \d+:\n", "")).alias("text")).where("page is not null")


# Boilerplate

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


def line_for_key(line: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(line, rf"([0-9])([{_LETTER}])", "$1 $2"), rf"([{_LETTER}])([0-9])", "$1 $2")
    return trim_space(F.regexp_replace(spaced, rf"{BLANKS}+", " "))


def _key_of(spaced: Column) -> Column:
    return trim_space(F.regexp_replace(F.regexp_replace(F.lower(spaced), r"\d+", "#"), "#+", "#"))


def boilerplate_key(line: Column) -> Column:
    return _key_of(line_for_key(line))


def is_candidate_line(spaced: Column) -> Column:
    """Of a line in the form of ``line_for_key``."""
    return F.length(spaced).between(*_CANDIDATE_CHARS) & ~spaced.rlike(_NO_CANDIDATE)


def looks_like_boilerplate(spaced: Column) -> Column:
    """Of a line in the form of ``line_for_key``."""
    letters = F.regexp_count(spaced, F.lit(f"[{_LETTER}]"))
    capitals = F.regexp_count(spaced, F.lit("[A-ZÀ-ÖØ-Þ]"))
    digits = F.regexp_count(spaced, F.lit(r"\d"))
    share = F.coalesce(F.try_divide(capitals.cast("double"), letters.cast("double")), F.lit(0.0))
    loud = (letters >= _CAPITALS[0]) & (share >= _CAPITALS[1])
    mixed = (letters >= _CAPITALS_AND_DIGITS[0]) & (share >= _CAPITALS_AND_DIGITS[1]) & (digits >= _CAPITALS_AND_DIGITS[2])
    return spaced.rlike(_REPORT_NAME) | loud | mixed | ((digits >= _DIGITS[0]) & (F.length(spaced) <= _DIGITS[1]))


def boilerplate_keys(pages: DataFrame) -> DataFrame:
    """``report_id, key``: keys among the first and last five candidate lines of pages that recur enough and look like boilerplate."""
    if "part" in pages.columns:
        rows = pages.join(pages.groupBy("report_id").agg(F.count_distinct("page_seq").cast("int").alias("n_pages")), "report_id")
    else:
        rows = pages.withColumn("n_pages", F.size(F.collect_set("page_seq").over(Window.partitionBy("report_id"))))
    rows = rows.where(F.col("n_pages") >= _LEAST_PAGES)
    # a line with more signs than a candidate has characters is none, whatever its blanks
    rows = rows.where(F.length(F.translate("line", " \t\f\x0b", "")) <= _CANDIDATE_CHARS[1])
    rows = once(rows, {"spaced": line_for_key(trim_space(F.col("line")))}, (F.col("spaced") != "") & is_candidate_line(F.col("spaced"))).drop("line", "title", "page")
    rows = _running(_running(rows, "page_seq", {"from_top": F.lit(1)}), "page_seq", {"from_end": F.lit(1)}, backwards=True).withColumns({n: F.col(n).cast("int") for n in ("from_top", "from_end")})
    # a line among both counts twice, as an example it comes in the order top lines, end lines backwards
    sides = F.array(F.when(F.col("from_top") <= _EDGE_LINES, F.col("from_top")), F.when(F.col("from_end") <= _EDGE_LINES, F.col("from_end") + _EDGE_LINES))
    picked = rows.where((F.col("from_top") <= _EDGE_LINES) | (F.col("from_end") <= _EDGE_LINES)).withColumn("nth", F.explode(F.array_compact(sides)))
    picked = once(picked, {"key": _key_of(F.col("spaced"))}, "key <> ''")
    keys = picked.groupBy("report_id", "key").agg(F.count("*").alias("n"), F.min_by("spaced", F.struct("page_seq", "nth")).alias("example"), F.first("n_pages").alias("n_pages"))
    return keys.where(F.col("n") >= F.greatest(F.lit(_LEAST_PAGES), F.ceil(F.col("n_pages") * _PAGE_SHARE))).where(looks_like_boilerplate(F.col("example"))).select("report_id", "key")


def strip_boilerplate(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``is_boilerplate``; such lines break paragraphs and are dropped by ``build_blocks``.

    A report has forty keys at most, as each takes a fortieth of the lines that are looked at; only lines of reports with
    keys are put in the form of a key.
    """
    of_report = keys.groupBy("report_id").agg(F.collect_set("key").alias("keys"))
    rows = pages.join(of_report, "report_id", "left")
    return rows.withColumn("is_boilerplate", F.coalesce(F.when(F.col("keys").isNotNull(), F.array_contains("keys", boilerplate_key(trim_space(F.col("line"))))), F.lit(False))).drop("keys")


def join_wrapped(wrapped: Column) -> Column:
    """Lines joined by the sentinel become one: a hyphen before a small letter is a broken word, else a space."""
    return trim_space(F.regexp_replace(F.regexp_replace(wrapped, rf"-{_WRAP}(?=[a-zà-öø-ÿ])", ""), _WRAP, " "))


def build_blocks(pages: DataFrame) -> DataFrame:
    """``report_id, block_idx, kind, page_seq, page, heading, text`` from marked lines."""
    line = F.col("line")
    # forms of a line once, and in a window only what the next step needs
    rows = once(pages, {"trimmed": trim_space(line), "fenced": line.rlike(_FENCE)})
    plain = ~F.col("is_boilerplate") & (F.col("trimmed") != "")
    rows = _running(rows.withColumn("is_fence", plain & F.col("fenced")), "page_seq", {"fences": F.col("is_fence").cast("long")})
    live = plain & ~F.col("is_fence") & (F.col("fences") % 2 == 0)
    rows = once(rows.withColumn("live", live), {
        "head": F.when(F.col("live"), F.regexp_extract(line, _HEADING, 1)),
        "item": F.when(F.col("live"), F.regexp_extract(line, _ITEM, 1)),
        "is_mark": F.col("live") & F.col("trimmed").rlike(_PAGE_WORD),
    })
    is_head = F.col("live") & (F.col("head") != "")
    rows = (
        rows.withColumn("item", F.when(~is_head, F.nullif("item", F.lit(""))))
        .withColumn("is_text", F.col("live") & ~is_head & F.col("item").isNull() & ~F.col("is_mark"))
        # lines inside a fence neither break a paragraph nor belong to one; the fence has closed it
        .withColumn("breaks", (~F.col("is_text") & ~(plain & ~F.col("is_fence") & (F.col("fences") % 2 == 1))).cast("long"))
        .withColumn("head", F.nullif(trim_space(F.col("head")), F.lit("")))
    )
    rows = (
        _running(rows, "page_seq", {"para": F.col("breaks")}, {"under": F.col("head")})
        .where("is_text or item is not null")
        .withColumn("heading", F.coalesce(collapse_whitespace(F.col("under")), collapse_whitespace(F.col("title"))))
    )
    # an item is a group of its own, a paragraph the text lines between two breaks
    piece = trim_space(F.regexp_replace(F.coalesce("item", line), rf"{BLANKS}+", " "))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"])
    groups = (
        rows.withColumn("piece", piece).withColumn("is_item", F.col("item").isNotNull())
        .groupBy("report_id", "page_seq", "para", "is_item")
        .agg(F.min("line_no").alias("line_no"), F.first("page").alias("page"), F.min_by("heading", "line_no").alias("heading"), F.array_join(ordered, _WRAP).alias("joined"))
    )
    least = F.when(F.col("is_item"), 6).otherwise(8)
    cleaned = once(groups, {"clean": normalize_for_evidence(join_wrapped(F.col("joined")))}, F.length("clean") >= least)
    kinds = cleaned.select("report_id", "page_seq", "page", "line_no", "heading", F.when(F.col("is_item"), "list").otherwise("paragraph").alias("kind"), F.when(F.col("is_item"), F.concat(F.lit("- "), "clean")).otherwise(F.col("clean")).alias("text"))
    if "part" in rows.columns:
        kinds = kinds.withColumn("part", F.floor(F.col("line_no") / RANGE_LINES).cast("int"))
    numbered = _running(kinds, None, {"nth": F.lit(1)}).withColumn("block_idx", (F.col("nth") - 1).cast("int"))
    return numbered.select("report_id", "block_idx", "kind", "page_seq", "page", "heading", "text")


def cap_blocks(blocks: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """Blocks up to and with the page on which the report reaches ``most``; the text of later pages is dropped."""
    first = F.min("block_idx").over(Window.partitionBy("report_id", "page_seq"))
    return blocks.withColumn("earlier", first).where(F.col("earlier") < most).drop("earlier")


# The same marks on the lines of one report in turn


_AT = {n: line_pattern(p) for n, p in (("snip", _SNIP), ("heading_page", _HEADING_PAGE), ("viewer_page", _VIEWER_PAGE), ("dash_page", _DASH_PAGE), ("loose_viewer", _LOOSE_VIEWER), ("heading", _HEADING), ("item", _ITEM), ("fence", _FENCE), ("page_word", _PAGE_WORD), ("no_candidate", _NO_CANDIDATE), ("report_name", _REPORT_NAME))}
_DIGIT_LETTER, _LETTER_DIGIT, _DIGIT_RUN = re.compile(rf"([0-9])([{_LETTER}])"), re.compile(rf"([{_LETTER}])([0-9])"), re.compile("[0-9]+")
_LETTERS, _CAPITAL_LETTERS, _SPACE_RUN, _BROKEN = re.compile(f"[{_LETTER}]"), re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile(f"[{SPACES}]+"), re.compile(f"-{_WRAP}(?=[a-zà-öø-ÿ])")


def _page_number(digits: str) -> int | None:
    """None beyond what an integer holds."""
    number = int(digits) if len(digits.lstrip("0")) <= 10 else 1 << 31
    return number if number < 1 << 31 else None


def _marked_page(line: str) -> tuple[int | None, str | None] | None:
    """Number and title of a page that the line starts; None if it starts none."""
    if "age" not in line and "[" not in line:
        return None
    if _AT["snip"].match(line.strip(SPACES)):
        return None, None
    heading = _AT["heading_page"].match(line)
    found = heading or _AT["viewer_page"].match(line)
    if not found:
        return None
    return _page_number(found[1]), heading[2].strip(SPACES) or None if heading else None


def _key_forms(line: str) -> tuple[str, str]:
    """A line in the forms of ``line_for_key`` and ``boilerplate_key``."""
    spaced = line.strip(SPACES)
    has_digits = _DIGIT_RUN.search(spaced)
    if has_digits:
        spaced = _LETTER_DIGIT.sub(r"\1 \2", _DIGIT_LETTER.sub(r"\1 \2", spaced))
    spaced = single_blanks(spaced).strip(SPACES)
    key = _DIGIT_RUN.sub("#", spaced.lower()) if has_digits else spaced.lower()
    return spaced, (re.sub("#+", "#", key) if "##" in key else key).strip(SPACES)


def _is_short(line: str) -> bool:
    """Whether a line has no more signs than a candidate's characters, blanks aside."""
    return len(line) <= _CANDIDATE_CHARS[1] or len(line) - sum(map(line.count, " \t\f\x0b")) <= _CANDIDATE_CHARS[1]


def _is_loud(spaced: str) -> bool:
    """``looks_like_boilerplate`` of one line."""
    letters, capitals, digits = len(_LETTERS.findall(spaced)), len(_CAPITAL_LETTERS.findall(spaced)), len(re.findall("[0-9]", spaced))
    share = capitals / letters if letters else 0.0
    mixed = letters >= _CAPITALS_AND_DIGITS[0] and share >= _CAPITALS_AND_DIGITS[1] and digits >= _CAPITALS_AND_DIGITS[2]
    return bool(_AT["report_name"].search(spaced)) or (letters >= _CAPITALS[0] and share >= _CAPITALS[1]) or mixed or (digits >= _DIGITS[0] and len(spaced) <= _DIGITS[1])


def _repeated(pages: list[list[str]]) -> set[str]:
    """``boilerplate_keys`` of one report."""
    if len(pages) < _LEAST_PAGES:
        return set()
    times, example = Counter(), {}
    for page in pages:
        # a candidate is wanted at either end only, so the lines between are not looked at
        picked = []
        for order in (page, reversed(page)):
            side = []
            for line in order:
                if _is_short(line):
                    spaced, key = _key_forms(line)
                    if _CANDIDATE_CHARS[0] <= len(spaced) <= _CANDIDATE_CHARS[1] and not _AT["no_candidate"].match(spaced):
                        side.append((spaced, key))
                        if len(side) == _EDGE_LINES:
                            break
            picked += side
        for spaced, key in picked:
            if key:
                times[key] += 1
                example.setdefault(key, spaced)
    least = max(_LEAST_PAGES, math.ceil(len(pages) * _PAGE_SHARE))
    return {k for k, n in times.items() if n >= least and _is_loud(example[k])}


def blocks_of(text: str) -> list[tuple]:
    """The evidence blocks of one report in order: ``kind, page_seq, page, heading, text`` and whether the text still has marks for a further cleaning."""
    pages, page, head = [], [], (None, None)
    seq = 0
    for line in (re.sub("\r\n?", "\n", text) if "\r" in text else text).replace("\u00a0", " ").split("\n"):
        mark = _marked_page(line)
        if mark is None:
            page.append(line)
            continue
        pages.append((seq, *head, page))
        page, head, seq = [], mark, seq + 1
    pages.append((seq, *head, page))
    pages = [p for p in pages if any(line.strip(SPACES) for line in p[3])]
    repeated = _repeated([p[3] for p in pages])
    # a key begins as its line does, as far as these are letters of ASCII
    starts = {k[:4] for k in repeated}
    made = []

    def add(is_item: bool, number: int, name: int | None, heading: str | None, lines: list[str]) -> None:
        joined = _WRAP.join([single_blanks(x).strip(SPACES) for x in lines])
        if len(lines) > 1 or _WRAP in joined:
            joined = (_BROKEN.sub("", joined) if f"-{_WRAP}" in joined else joined).replace(_WRAP, " ")
        whole, marked = joined.strip(SPACES), False
        if is_unclean(whole):
            whole = evidence_form(whole)
            marked = is_unclean(whole)
        if len(whole) >= (6 if is_item else 8):
            made.append(("list" if is_item else "paragraph", number, name, heading, f"- {whole}" if is_item else whole, marked))

    for number, name, title, body in pages:
        heading = _SPACE_RUN.sub(" ", title).strip(SPACES) if title else None
        fenced, para = False, []
        for line in body:
            trimmed = line.strip(SPACES)
            plain = trimmed != ""
            if plain and repeated:
                start = trimmed[:4]
                plain = (len(start) == 4 and start.isascii() and start.isalpha() and start.lower() not in starts) or _key_forms(line)[1] not in repeated
            is_fence = plain and "```" in line and bool(_AT["fence"].match(line))
            fenced ^= is_fence
            if plain and not is_fence and fenced:
                continue
            live = plain and not is_fence
            # an item begins with a mark or a digit, a heading with a hash
            first = trimmed[:1]
            under = live and first == "#" and _AT["heading"].match(line)
            item = live and not under and (first in "-*•" or "0" <= first <= "9") and _AT["item"].match(line)
            if live and not under and not item and not (first in "pP" and _AT["page_word"].match(trimmed)):
                para.append(line)
                continue
            if para:
                add(False, number, name, heading, para)
                para = []
            if under:
                heading = _SPACE_RUN.sub(" ", under[1]).strip(SPACES) or heading
            elif item:
                add(True, number, name, heading, [item[1]])
        if para:
            add(False, number, name, heading, para)
    return made


def _grounding_mark(line: str) -> tuple[int | None, str | None] | None:
    """Number and title of a page for grounding that the line starts; None if it starts none."""
    if "Page" not in line:
        return None
    heading = _AT["heading_page"].match(line)
    trimmed = line.strip(SPACES)
    found = heading or _AT["dash_page"].match(trimmed) or _AT["loose_viewer"].match(trimmed)
    if not found:
        return None
    return _page_number(found[1]), heading[2].strip(SPACES) or None if heading else None


def grounding_texts(text: str) -> list[tuple]:
    """``page_seq, page, title, text`` of one report."""
    pages, body, head = [], [], (None, None)
    for line in re.sub("\r\n?", "\n", text).replace("\u00a0", " ").split("\n"):
        mark = _grounding_mark(line)
        if mark is None:
            body.append(line)
            continue
        pages.append((*head, body))
        head, body = mark, []
    pages.append((*head, body))
    joined = ((i, page, title, "\n".join(body).strip(SPACES)) for i, (page, title, body) in enumerate(pages))
    return [p for p in joined if p[3]]


def _short_pages(df: DataFrame, text_col: str) -> DataFrame:
    """``_grounding_pages`` of reports that are read in one go: no line is a row and nothing is shuffled."""
    rows = df.select("report_id", text_col)
    kind = T.StructType([rows.schema["report_id"], *(T.StructField(n, t()) for n, t in (("page_seq", T.LongType), ("page", T.IntegerType), ("title", T.StringType), ("text", T.StringType)))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                of_row = [grounding_texts(t) if t else [] for t in part.column(1).to_pylist()]
                at = pa.array([i for i, pages in enumerate(of_row) for _ in pages], pa.int64())
                columns = [pa.array([p[i] for pages in of_row for p in pages], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *columns], names=kind.names)

    return rows.mapInArrow(split, kind)


def dealt(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``report_id`` and the text of reports that are read in one go: texts are shuffled once, over partitions by the input's size."""
    return df.select("report_id", text_col).repartition(_partitions(df), "report_id")


def _short_blocks(df: DataFrame, text_col: str) -> DataFrame:
    """``build_blocks`` of reports that are read in one go: no line is a row."""
    rows = dealt(df, text_col)
    kind = T.StructType([rows.schema["report_id"], *(T.StructField(n, t()) for n, t in (("block_idx", T.IntegerType), ("kind", T.StringType), ("page_seq", T.LongType), ("page", T.IntegerType), ("heading", T.StringType), ("text", T.StringType)))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                of_row = [blocks_of(t) if t else [] for t in part.column(1).to_pylist()]
                at = pa.array([i for i, blocks in enumerate(of_row) for _ in blocks], pa.int64())
                number = pa.array([k for blocks in of_row for k in range(len(blocks))], pa.int32())
                columns = [pa.array([b[i] for blocks in of_row for b in blocks], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), number, *columns], names=kind.names)

    return rows.mapInArrow(read, kind)


def by_report(df: DataFrame, text_col: str, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``short(reports)`` of the dealt reports of up to RANGE_LINES lines, and ``long(reports, blocks)`` of longer ones and their written blocks, if there are any."""
    return _by_length(df, text_col, lambda some, ranged: long(some, written(_ranged_blocks(some, text_col))) if ranged else short(dealt(some, text_col)))


def _ranged_blocks(df: DataFrame, text_col: str) -> DataFrame:
    pages = written(split_pages(df, text_col, True))
    return build_blocks(strip_boilerplate(pages, boilerplate_keys(pages)))


def evidence_blocks(df: DataFrame, text_col: str = "text", most: int | None = MOST_BLOCKS) -> DataFrame:
    """Pages, boilerplate and blocks in one go; all blocks where ``most`` is None. A ``report_id`` is one row."""
    blocks = _by_length(df, text_col, lambda some, ranged: _ranged_blocks(some, text_col) if ranged else _short_blocks(some, text_col))
    return blocks if most is None else cap_blocks(blocks, most)


def assemble_corpus(blocks: DataFrame) -> DataFrame:
    """``report_id, corpus``: the blocks' texts with blank lines between, cleaned again."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"])
    return blocks.groupBy("report_id").agg(normalize_for_evidence(F.array_join(ordered, "\n\n")).alias("corpus"))


# Chunks


def split_paragraphs(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, r"\n\s*\n"), trim_space), lambda p: p != "")


def token_chunks(pages: DataFrame, size: int = 384, overlap: int = 64, least_tokens: int = 24, least_chars: int = 80, token: str = r"\S+") -> DataFrame:
    """Windows of at most ``size`` tokens over each paragraph of a page, numbered within the page.

    ``pages`` has ``report_id, page, text`` and any metadata, which stay. Short windows are dropped.
    """
    step = size - overlap
    rows = pages.withColumn("pages_text", F.col("text")).select("*", F.posexplode(split_paragraphs(F.col("pages_text"))).alias("para", "paragraph")).drop("pages_text", "text")
    tokens = F.regexp_extract_all("paragraph", F.lit(f"({token})"), 1)
    n = F.size("tokens")
    windows = F.greatest(F.lit(1), F.ceil((n - size) / step).cast("int") + 1)
    rows = rows.withColumn("tokens", tokens).where(n > 0).withColumn("w", F.explode(F.sequence(F.lit(0), windows - 1)))
    rows = rows.withColumn("part", F.slice("tokens", F.col("w") * step + 1, F.lit(size))).withColumn("text", F.array_join("part", " ")).withColumn("token_count", F.size("part"))
    rows = rows.where((F.col("token_count") >= least_tokens) & (F.length("text") >= least_chars))
    nth = F.row_number().over(Window.partitionBy("report_id", "page").orderBy("para", "w")) - 1
    return rows.withColumn("chunk_in_page", nth).drop("para", "paragraph", "tokens", "w", "part")


def cut_points(text: str, size: int, overlap: int, marks: tuple[tuple[str, float, int], ...]) -> list[str]:
    """Overlapping pieces: each ends at the last mark that lies far enough, else at ``size``."""
    pieces, start, n = [], 0, len(text)
    while start < n:
        end = min(n, start + size)
        for mark, share, keep in marks:
            at = text.rfind(mark, 0, end + len(mark))
            if at > start + int(size * share):
                end = at + keep
                break
        if piece := text[start:end].strip():
            pieces.append(piece)
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return pieces


@F.pandas_udf(T.ArrayType(T.StringType()))
def _char_pieces(texts: pd.Series, sizes: pd.Series, overlaps: pd.Series) -> pd.Series:
    made = []
    for t, size, overlap in zip(texts, sizes, overlaps, strict=True):
        t = " ".join((t or "").split())
        made.append([t] if t and len(t) <= size else cut_points(t, size, overlap, ((" ", 0.6, 0),)) if t else [])
    return pd.Series(made)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _section_pieces(texts: pd.Series, sizes: pd.Series, overlaps: pd.Series) -> pd.Series:
    made = []
    for t, size, overlap in zip(texts, sizes, overlaps, strict=True):
        t = (t or "").strip()
        made.append([t] if t and len(t) <= size else cut_points(t, size, overlap, (("\n\n", 0.5, 0), (". ", 0.6, 1))) if t else [])
    return pd.Series(made)


def char_chunks(col: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Pieces of the collapsed text, each cut at the last space beyond 60 % of the size. Each starts where the one before ended, so Python finds them."""
    return _char_pieces(col, F.lit(size), F.lit(overlap))


def section_chunks(col: Column, size: int = 12000, overlap: int = 600, most: int | None = None) -> Column:
    """Pieces cut at a paragraph, else at a sentence end; only the first ``most``, if given (a request takes 15)."""
    pieces = _section_pieces(col, F.lit(size), F.lit(overlap))
    return pieces if most is None else F.slice(pieces, 1, most)


def merge_pages(pages: DataFrame) -> DataFrame:
    """Per report the pages' texts under ``--- Page N ---`` lines, their number, and the first page's metadata."""
    other = [c for c in pages.columns if c not in ("report_id", "page", "text")]
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"])), "\n\n")
    return pages.groupBy("report_id").agg(*[F.min_by(c, "page").alias(c) for c in other], text.alias("text"), F.count("*").cast("int").alias("page_count"))


def restrict_pages(pages: DataFrame, start: int, end: int) -> DataFrame:
    """``report_id, text``: the pages of a span under ``### Page N`` lines."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("### Page "), p["page"].cast("string"), F.lit("\n"), trim_space(p["text"]))), "\n\n")
    return pages.where(F.col("page").between(start, end) & (trim_space(F.col("text")) != "")).groupBy("report_id").agg(text.alias("text"))
