"""Scalar text and id functions: columns in, columns out."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerleaf.functions.blocks import slices
from ledgerleaf.functions.rules import java, let

NBSP = "\u00a0"
#: Characters that count as blanks besides line ends.
BLANKS = r"[ \t\f\x0B]"
#: What trimming and collapsing take as white space: ASCII blanks and the Unicode spaces.
SPACE = "[\\s\\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff]"
SOFT_HYPHEN = "\u00ad"
#: Both; a class is tested from the left, and most signs lie before the first of them.
_UNSEEN = f"[[^\\x00-\u00ac]&&[{SOFT_HYPHEN}{INVISIBLE[1:-1]}]]"

# Ornaments that cleaning drops, arrows that become dashes, ligatures that it spells out.
SYMBOLS = (
    "[\u25a0\u25a1\u25aa\u25ab\u25cf\u25cb\u25c6\u25c7\u25ba\u25b8\u25b6\u25c0\u25be\u25bc\u25b2\u25b3\u25b7\u25c1\u2605\u2606"
    "\u2726\u2727\u2729-\u274b\u2b1b\u2b1c\u2610-\u2612]"
)
ARROWS = "[\u2190-\u21ff\u27f5-\u27f7]"
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl", "\ufb00": "ff", "\ufb03": "ffi", "\ufb04": "ffl"}


def _all(col: Column, *steps: tuple[str, str]) -> Column:
    return functools.reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


def trim_space(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def _single_blanks(col: Column, blank: str, words: str = "!-~") -> Column:
    """Runs of blanks as one space each; a lone space, by far the most frequent, is not replaced by itself. Signs of the range ``words``, no blanks, are told apart by one look."""
    others = blank.replace("[ ", "[").replace("[\\s", "[\\t-\\r")
    return F.regexp_replace(col, rf"[[^{words}]&&{others}]{blank}*| {blank}+", " ")


def collapse_whitespace(col: Column) -> Column:
    return F.btrim(_single_blanks(col, SPACE))


def line_ends(col: Column) -> Column:
    """Line feeds only, and no-break spaces as spaces."""
    return F.replace(F.regexp_replace(col, r"\r\n?", "\n"), F.lit(NBSP), F.lit(" "))


def _unicode_cleanup(col: Column) -> Column:
    col = F.regexp_replace(col, _UNSEEN, "")
    for glyph, letters in LIGATURES.items():
        col = F.replace(col, F.lit(glyph), F.lit(letters))
    return _all(col, (f"[[^\\x00-\u259f]&&{SYMBOLS}]", ""), (ARROWS, " - "))


#: Images, links without a target, and marks of headings, tables and rules, each with a sign that it can't do without.
_MARKDOWN = (
    (r"!\[[^\]]*\]\([^)]*\)", "", "!["),
    (r"\[([^\]]*)\]\(\s*\)", "$1", "]("),
    (r"(?dm)^\s*#{1,6}\s*$", "", "#"),
    (r"(?dm)^[\s|]*[-:]{3,}(?:\s*\|\s*[-:]{3,})+[\s|]*$", "", "-"),
    (r"(?dm)^\s*\|[\s|]*$", "", "|"),
    (r"(?dm)^\s*\|\s+", "", "|"),
    (r"(?dm)\s+\|\s*$", "", "|"),
    (r"\|{2,}", " | ", "||"),
    (r"(?dm)^-{3,}\s*$", "", "---"),
)


def _markdown_cleanup(col: Column) -> Column:
    return _all(col, *((pattern, new) for pattern, new, _ in _MARKDOWN))


def _blank_cleanup(col: Column) -> Column:
    lines = let(_single_blanks(col, BLANKS), lambda c: F.when(c.contains("\n"), _all(c, (r" *\n", "\n"), (r"\n{3,}", "\n\n"))).otherwise(c))
    return trim_space(lines)


#: A text without any of these has nothing for the cleaning of signs, or of marks.
_ODD = "".join(x.strip("[]") for x in (INVISIBLE, SOFT_HYPHEN, *LIGATURES, SYMBOLS, ARROWS))
#: Tested from the left: most signs lie before the first of them.
_ODD_SIGNS = f"[[^\\x00-\u00ac]&&[{_ODD}]]"
_MARKS = r"[|#\[]|---"
#: A joined paragraph of trimmed lines without any of these is clean.
_UNCLEAN_SIGNS = rf"[{_ODD}\t\n\x0b\f\r{NBSP}|#\[]"
UNCLEAN = rf"{_UNCLEAN_SIGNS}|---|  "


def normalize_for_evidence(col: Column) -> Column:
    """The cleaning that evidence and the corpus go through, in fixed order. Most texts have little to clean, so one look decides for several steps."""
    col = let(line_ends(col), lambda c: F.when(c.contains("[..."), F.regexp_replace(c, r"(?idm)^\s*\[\.\.\.snipped\.\.\.\]\s*$", "")).otherwise(c))
    col = let(col, lambda c: F.when(c.rlike(_ODD_SIGNS), _unicode_cleanup(c)).otherwise(c))
    return _blank_cleanup(let(col, lambda c: F.when(c.rlike(_MARKS), _markdown_cleanup(c)).otherwise(c)))


_UNCLEAN_SIGN, _ODD_SIGN, _MARK, _BLANK_RUNS, _LINE_END = re.compile(_UNCLEAN_SIGNS), re.compile(f"[{_ODD}]"), re.compile(_MARKS), re.compile(f"{BLANKS}+"), re.compile("\r\n?")
_SNIPPED = re.compile(r"^\s*\[\.\.\.snipped\.\.\.\]\s*$", re.A | re.I | re.M)
_MARKDOWN_STEPS = [(re.compile(p.removeprefix("(?dm)"), re.A | (re.M if p.startswith("(?dm)") else 0)), new.replace("$1", r"\1"), sign) for p, new, sign in _MARKDOWN]
_SYMBOL_SIGN, _ARROW_SIGN, _UNSEEN_SIGN = re.compile(SYMBOLS), re.compile(ARROWS), re.compile(f"[{SOFT_HYPHEN}{INVISIBLE[1:-1]}]")


def is_unclean(text: str) -> bool:
    """Whether a trimmed text has anything for ``evidence_form``; paragraphs that have nothing, joined by blank lines, have nothing either."""
    return bool(_UNCLEAN_SIGN.search(text)) or "---" in text or "  " in text


def single_blanks(text: str) -> str:
    """Runs of BLANKS as one space each."""
    return _BLANK_RUNS.sub(" ", text) if "  " in text or "\t" in text or "\f" in text or "\x0b" in text else text


def evidence_form(text: str) -> str:
    """``normalize_for_evidence`` of one text, for texts that Python reads anyway; a step is taken where a sign that it needs is there."""
    text = (_LINE_END.sub("\n", text) if "\r" in text else text).replace(NBSP, " ")
    if "[..." in text:
        text = _SNIPPED.sub("", text)
    if not text.isascii() and _ODD_SIGN.search(text):
        text = _UNSEEN_SIGN.sub("", text)
        for glyph, letters in LIGATURES.items():
            text = text.replace(glyph, letters)
        text = _ARROW_SIGN.sub(" - ", _SYMBOL_SIGN.sub("", text))
    if _MARK.search(text):
        for pattern, new, sign in _MARKDOWN_STEPS:
            if sign in text:
                text = pattern.sub(new, text)
    text = single_blanks(text)
    if "\n" in text:
        text = re.sub("\n{3,}", "\n\n", re.sub(" +\n", "\n", text) if " \n" in text else text)
    return text.strip(SPACES)


def clean_evidence_display(col: Column) -> Column:
    """The display form: also without page markers, truncation marks and a closing ellipsis."""
    col = _all(
        line_ends(col),
        (r"(?idm)^\s*#{1,6}\s*page\s+\d+.*$", ""),
        (r"(?idm)^\s*-{3}\s*page\s+\d+\s*-{3}\s*$", ""),
        (r"(?i)\[\.\.\.(?:snipped|truncated)\.\.\.\]|\[truncated\]", ""),
    )
    col = _blank_cleanup(_markdown_cleanup(_unicode_cleanup(col)))
    return trim_space(F.regexp_replace(col, r"\s*(?:\.\.\.|…)\s*$", ""))


def normalize_for_extraction(col: Column) -> Column:
    return _blank_cleanup(_all(line_ends(col), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\(\s*\)", "$1")))


def normalize_page_text(col: Column) -> Column:
    return trim_space(_all(line_ends(col), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")))


def normalize_for_match(col: Column) -> Column:
    """The form in which entity texts are looked up on pages: marks count as blanks."""
    col = F.lower(F.regexp_replace(F.replace(col, F.lit(NBSP), F.lit(" ")), _UNSEEN, ""))
    return F.btrim(_single_blanks(col, SPACE.replace("[\\s", "[\\s`*_>#|"), "a-z"))


#: Signs at which Python splits and the reference doesn't, and one at which it is the other way round.
_OTHER_BLANKS, _SPACE_RUN = re.compile("[\x1c-\x1f\x85\ufeff]"), re.compile(f"[{SPACES}]+")
_MATCH_MARKS = "`*_>#|"
_MATCH_RUNS, _WORD_GAPS = re.compile(f"[{SPACES}{_MATCH_MARKS}]+"), re.compile("[^a-z0-9%]+")


def collapsed(text: str) -> str:
    """``collapse_whitespace`` of one text."""
    return _SPACE_RUN.sub(" ", text).strip(" ") if _OTHER_BLANKS.search(text) else " ".join(text.split())


def search_form(text: str) -> str:
    """``normalize_for_match`` of one text."""
    if not text.isascii():
        text = _UNSEEN_SIGN.sub("", text.replace(NBSP, " "))
    text = text.lower()
    if _OTHER_BLANKS.search(text):
        return _MATCH_RUNS.sub(" ", text).strip(" ")
    for mark in _MATCH_MARKS:
        text = text.replace(mark, " ")
    return " ".join(text.split())


def search_tokens(matched: str, n: int = 14) -> list[str]:
    """``tokens_of`` one text."""
    return [p for p in _WORD_GAPS.split(matched) if len(p) >= 3 or any("0" <= c <= "9" for c in p)][:n]


def match_tokens(col: Column, n: int = 14) -> Column:
    return tokens_of(normalize_for_match(col), n)


def tokens_of(matched: Column, n: int = 14) -> Column:
    """``match_tokens`` of a text in the form of ``normalize_for_match``."""
    parts = F.split(matched, r"[^a-z0-9%]+")
    return F.slice(F.filter(parts, lambda p: (F.length(p) >= 3) | p.rlike("[0-9]")), 1, n)


def canonical_slug(col: Column) -> Column:
    return F.regexp_replace(F.lower(trim_space(col)), r"-u\d{4,}$", "")


def meta_field(col: Column, fallback: str = "", max_len: int = 200) -> Column:
    return F.substring(F.coalesce(F.nullif(collapse_whitespace(col), F.lit("")), F.lit(fallback)), 1, max_len)


def is_report_id(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^report-\d+$"), F.lit(False))


def normalize_report_key(col: Column) -> Column:
    """A key without leading slashes; empty if it leaves the report folder or its alphabet."""
    key = F.regexp_replace(trim_space(F.coalesce(col, F.lit(""))), "^/+", "")
    return F.when(key.startswith("reports/") & ~key.contains("..") & key.rlike(r"^[A-Za-z0-9/_.\-&(),'+ ]+$"), key).otherwise("")


def dedupe_report_ids(df: DataFrame, n: int, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """Valid ids once, in order of first occurrence, the first ``n``."""
    rows = df.select(trim_space(F.col(id_col)).alias(id_col), pos_col).where(is_report_id(F.col(id_col)))
    return rows.groupBy(id_col).agg(F.min(pos_col).alias(pos_col)).orderBy(pos_col).limit(n)


def report_number(col: Column) -> Column:
    """Number of an id; null for legacy ids of a million or more."""
    number = F.regexp_extract(col, r"^report-(\d+)$", 1).try_cast("bigint")
    return F.when(number < 1_000_000, number)


def parse_report_path(col: Column) -> Column:
    """``struct<year, slug>`` of keys with four parts or more."""
    parts = F.split(col, "/")
    deep = F.size(parts) >= 4
    return F.struct(F.when(deep, F.get(parts, F.lit(1)).try_cast("int")).alias("year"), F.when(deep, F.get(parts, F.lit(2))).alias("slug"))


def sample_head_tail(col: Column, max_chars: int = 350_000, head_chars: int = 200_000) -> Column:
    head = max(0, min(head_chars, max_chars * 6 // 10))
    tail = max(0, max_chars - head - 48)
    return F.when(F.length(col) <= max_chars, col).otherwise(F.concat(F.substring(col, 1, head), F.lit("\n\n[...snipped...]\n\n"), F.right(col, F.lit(tail))))


def truncate_end(col: Column, max_chars: int) -> Column:
    if max_chars <= 0:
        return F.lit("")
    cut = F.regexp_replace(F.substring(col, 1, max_chars), rf"{SPACE}+$", "")
    return F.when(F.length(col) <= max_chars, col).otherwise(F.concat(cut, F.lit("\n\n[Truncated]\n")))


def truncate_head_tail(col: Column, max_chars: int, head_chars: int = 1600) -> Column:
    if max_chars <= 0:
        return F.lit("")
    head = max(0, min(head_chars, max_chars * 4 // 10))
    tail = max(0, max_chars - head - 32)
    first = F.regexp_replace(F.substring(col, 1, head), rf"{SPACE}+$", "")
    last = F.regexp_replace(F.right(col, F.lit(tail)), rf"^{SPACE}+", "")
    return F.when(F.length(col) <= max_chars, col).otherwise(F.concat(first, F.lit("\n\n[...truncated...]\n\n"), last))


def truncate_for_classifier(col: Column, max_chars: int = 1200) -> Column:
    """Collapsed text, cut after the last full stop with a space from 60 % of the limit on, else hard."""
    return let(collapse_whitespace(col), lambda text: _cut_at_stop(text, max_chars))


def _cut_at_stop(text: Column, max_chars: int) -> Column:
    to_stop = F.regexp_extract(F.substring(text, 1, max_chars + 2), r"^(.*\.) ", 1)
    return F.when(F.length(text) <= max_chars, text).when(F.length(to_stop) - 1 > F.lit(max_chars * 0.6), to_stop).otherwise(F.substring(text, 1, max_chars))


def clip_snippet(col: Column, max_chars: int = 1200, max_paragraphs: int = 3) -> Column:
    """At most ``max_chars``: whole paragraphs with a mark, else up to a sentence end or space, with dots."""
    return let(normalize_for_evidence(col), lambda text: clipped(text, max_chars, max_paragraphs))


def clipped(text: Column, max_chars: int, max_paragraphs: int) -> Column:
    """``clip_snippet`` of a text that is cleaned already."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), trim_space), lambda p: p != "")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(acc: Column, p: Column) -> Column:
        joined = F.when(acc["n"] == 0, p).otherwise(F.concat(acc["kept"], F.lit("\n\n"), p))
        fits = acc["open"] & (acc["n"] < max_paragraphs) & (F.length(joined) <= max_chars)
        return F.struct(F.when(fits, joined).otherwise(acc["kept"]).alias("kept"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    whole = F.aggregate(paragraphs, start, add)
    by_paragraph = F.concat(whole["kept"], F.when(F.length(whole["kept"]) < F.length(text), F.lit("\n\n[...truncated...]")).otherwise(F.lit("")))
    out = F.substring(text, 1, max_chars)
    to_stop = F.regexp_extract(out, r"(?s)^(.*[.!?]) ", 1)
    to_space = F.regexp_extract(out, r"(?s)^(.*) ", 1)
    by_sentence = (
        F.when(F.length(to_stop) - 1 > int(max_chars * 0.55), to_stop)
        .when(F.length(to_space) > int(max_chars * 0.6), F.regexp_replace(to_space, rf"{SPACE}+$", ""))
        .otherwise(F.regexp_replace(out, rf"{SPACE}+$", ""))
    )
    return (
        F.when(F.length(text) <= max_chars, text)
        .when((F.size(paragraphs) > 1) & (whole["n"] > 0), by_paragraph)
        .otherwise(F.concat(by_sentence, F.lit(" ...")))
    )


def estimate_tokens(col: Column) -> Column:
    return F.ceil(F.length(F.coalesce(col, F.lit(""))) / 4).cast("int")


_FNV_START, _FNV_PRIME, _FNV_FEW = 2166136261, 16777619, 16


def fnv1a(texts: list[str]) -> list[str]:
    """32-bit FNV-1a over the characters of each text, eight hex digits. The texts go in step, one character of each at a time; the last few that are longer than all others go by themselves."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-sizes, kind="stable")
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.dtype("<u4"))
    at = (np.cumsum(sizes) - sizes)[order]
    # how many texts have an i-th character: those before a place of ``order``
    left = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left").tolist()
    h, i = np.full(len(texts), _FNV_START, np.uint32), 0
    for i, n in enumerate([*left, 0]):  # noqa: B007
        if n < _FNV_FEW:
            break
        some = h[:n]
        some ^= codes[at[:n]]
        some *= np.uint32(_FNV_PRIME)
        at[:n] += 1
    made = [0] * len(texts)
    for k, x in zip(order.tolist(), h.tolist(), strict=True):
        for c in map(ord, texts[k][i:]):
            x = ((x ^ c) * _FNV_PRIME) & 0xFFFFFFFF
        made[k] = x
    return [f"{x:08x}" for x in made]


@F.arrow_udf(T.StringType())
def fnv1a_hex(texts: pa.Array) -> pa.Array:
    """``fnv1a`` of a column; null stays null."""
    made = []
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
        known = part.column(0).drop_null().to_pylist()
        hashes = iter(fnv1a(known))
        made.append(pa.array([next(hashes) if v else None for v in part.column(0).is_valid().to_pylist()], pa.string()))
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def feature_label(col: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(col, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-]+", " ")
    return F.array_join(F.transform(F.split(collapse_whitespace(words), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def year_from_filename(col: Column) -> Column:
    years = F.transform(F.regexp_extract_all(col, F.lit(java(r"\b((?:19|20)\d{2})\b")), 1), lambda y: y.cast("int"))
    return F.array_min(F.filter(years, lambda y: y.between(2000, 2100)))


def company_from_filename(col: Column) -> Column:
    base = F.regexp_replace(col, r"(?i)\.pdf$", "")
    bare = F.regexp_replace(base, java(r"\b(annual|sustainability|integrated|report|esg|statement|fy\d{2,4}|20\d{2})\b"), " ")
    name = collapse_whitespace(F.regexp_replace(bare, r"[_\-]+", " "))
    return F.when(name == "", "Unknown Company").otherwise(name)


def choose_vocab(col: Column, vocab: list[str], fallback: str) -> Column:
    """The entry of ``vocab`` equal to the collapsed value but for case, else ``fallback``."""
    table = F.create_map(*[F.lit(x) for v in reversed(vocab) for x in (v.lower(), v)]) if len({v.lower() for v in vocab}) == len(vocab) else None
    value = F.lower(collapse_whitespace(col))
    if table is not None:
        return F.coalesce(F.try_element_at(table, value), F.lit(fallback))
    return F.coalesce(*[F.when(value == v.lower(), v) for v in vocab], F.lit(fallback))


def assign_slugs(df: DataFrame, base: Column, order: list[str]) -> DataFrame:
    """Add ``slug``: the base, with ``-2``, ``-3`` ... from its second occurrence in order."""
    nth = F.row_number().over(Window.partitionBy("slug_base").orderBy(*order))
    rows = df.withColumn("slug_base", base).withColumn("nth", nth)
    return rows.withColumn("slug", F.when(F.col("nth") == 1, F.col("slug_base")).otherwise(F.concat_ws("-", "slug_base", "nth"))).drop("slug_base", "nth")


def reclassify_year(df: DataFrame, old: int, new: int, col: str = "y") -> DataFrame:
    """The year replaced; ``changed`` marks the rows, whose number is ``count_if(changed)``."""
    hit = F.coalesce(F.col(col) == old, F.lit(False))
    return df.withColumn("changed", hit).withColumn(col, F.when(hit, new).otherwise(F.col(col)))
