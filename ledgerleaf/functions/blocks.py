"""Patterns on Arrow batches: slices of a batch, patterns of lines, and the rules that match a text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerleaf.functions.rules import leading_words, needed_words

SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows and SLICE_BYTES bytes in column ``text``, a longer text being a part of its own."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if i > start and (i - start >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def line_pattern(pattern: str) -> re.Pattern:
    """A pattern in Java's dialect for single lines without line feeds; there ``.`` and ``$`` also know U+0085, U+2028 and U+2029."""
    dots = re.sub(r"(?<!\\)\.(?=[*+])", "[^\\\\n\\\\r\\\\x85\\\\u2028\\\\u2029]", pattern)
    return re.compile(re.sub(r"(?<!\\)\$", r"(?=[\\x85\\u2028\\u2029]?\\Z)", dots), re.A)


def rule_finder(rules: dict[str, tuple[str, bool]]) -> Callable[[str], list[tuple[str, int]]]:
    """A function from a text to ``(key, matches)`` of the rules that match it; ``rules`` gives pattern and whether case is ignored.

    A text is read once for the keywords of all rules; only rules with a keyword in it are matched, and where each match begins with a keyword, only from there.
    """
    patterns = [(k, re.compile(p, re.A | re.I if fold else re.A)) for k, (p, fold) in rules.items()]
    of_word: dict[str, list[list[int]]] = defaultdict(lambda: [[], []])
    always = []
    for i, (pattern, _) in enumerate(rules.values()):
        first = leading_words(pattern)
        words = needed_words(pattern) if first is None else first
        always += [i] if words is None else []
        for w in words or ():
            of_word[w][first is not None].append(i)
    known = ahocorasick.Automaton()
    for word, (within, first) in of_word.items():
        known.add_word(word, (len(word), within, first))
    known.make_automaton()

    def count(pattern: re.Pattern, text: str, starts: list[int]) -> int:
        n, end = 0, 0
        for at in sorted(starts):
            if at >= end and (m := pattern.match(text, at)):
                n, end = n + 1, m.end()
        return n

    def find(text: str) -> list[tuple[str, int]]:
        low = text.lower()
        places: dict[int, list[int] | None] = dict.fromkeys(always)
        for end, (size, within, first) in known.iter(low):
            for i in within:
                places[i] = None
            for i in first:
                places.setdefault(i, []).append(end - size + 1)
        if len(low) != len(text):  # places are those of the small letters
            places = dict.fromkeys(places)
        counts = ((i, len(patterns[i][1].findall(text)) if at is None else count(patterns[i][1], text, at)) for i, at in sorted(places.items()))
        return [(patterns[i][0], n) for i, n in counts if n]

    return find


def with_hits(batch: pa.RecordBatch, text: int, find: Callable[[str], list[tuple[str, int]]]) -> pa.RecordBatch:
    """The rows with a last column ``hits array<part, n>``."""
    found = [find(t) if t else [] for t in batch.column(text).to_pylist()]
    ends = [0]
    for f in found:
        ends.append(ends[-1] + len(f))
    parts = pa.array([k for f in found for k, _ in f], pa.string()), pa.array([n for f in found for _, n in f], pa.int32())
    hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["part", "n"]))
    return pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, "hits"])


def rows_with_hits(rows: DataFrame, rules: dict[str, tuple[str, bool]], column: str = "text", all_rows: bool = False) -> DataFrame:
    """Rows with a last column ``hits array<part, n>`` of the rules that match the text of a column; unless ``all_rows``, those with a hit only."""
    at = rows.columns.index(column)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = rule_finder(rules)
        for batch in batches:
            for part in slices(batch, at):
                found = with_hits(part, at, of_text)
                yield found if all_rows else found.filter(pc.greater(pc.list_value_length(found.column("hits")), 0))

    hits = T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("n", T.IntegerType())]))
    return rows.mapInArrow(find, T.StructType([*rows.schema, T.StructField("hits", hits)]))
