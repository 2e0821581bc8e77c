"""Ranked lexical search of all documents for a set of items by exact blocked matrix products.

Items are cut into tiles. A tile has a compact vocabulary, the terms of its items only, and a matrix items x terms of
integer weights. A task turns its documents, some hundred at a time, into a matrix terms x documents of integer impacts over that vocabulary
and multiplies the two in float64. Every product and every partial sum is a whole number below 2^53, whatever the order of adding,
so the scores are exact; an item whose weights could pass that bound has its terms cut into several products, added as 64-bit integers.
The best of each item are kept while a task goes through its documents, equal scores by document id, and
merged over tasks in two levels.

Statistics come from one pass before: each task adds up its document frequencies and emits them once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import saved, slices

#: Bytes that are no part of a term become blanks, capital letters small ones; all bytes from 128 on belong to terms.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Items of a tile, documents and most terms of a product.
ITEMS, DOCUMENTS, TERMS = 64, 256, 4_096
#: Terms of all tiles that one pass over the documents serves; more items take more passes.
MOST_TERMS = 100_000
#: Every impact is at most IMPACT; sums stay below EXACT.
IMPACT, EXACT = 1_000_000, 1 << 53
#: Parts of an item's candidates that are cut to the best before they meet.
PARTS = 64


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of UTF-8 text: runs of letters and digits and of everything beyond ASCII, A-Z made small."""
    return text.translate(_TABLE).split() if text else []


@dataclass(frozen=True)
class Tile:
    """Some items, and their vocabulary in parts of (numbers of its terms, items x terms weights)."""

    items: tuple[int, ...]
    parts: tuple[tuple[np.ndarray, np.ndarray], ...]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """``(10^9 tf) div (1000 tf + 20 m)`` with ``m = 50 + (50 n N) div L``, in 64-bit integers; where these could overflow, in Python's."""
    if int(n_terms.max(initial=0)) * n_docs * 50 < 1 << 63:
        m = 50 + (50 * n_terms * n_docs) // max(total, 1)
    else:
        m = np.array([50 + (50 * int(n) * n_docs) // max(total, 1) for n in n_terms], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def tile(items: list[tuple[int, list[int]]], weights: dict[int, int]) -> Tile:
    """A tile of ``(item, numbers of its terms)``: parts of at most TERMS terms whose weights times the largest impact stay exact."""
    cuts, held = [[]], 0
    for t in sorted({t for _, ts in items for t in ts}):
        if len(cuts[-1]) == TERMS or (held + weights[t]) * IMPACT >= EXACT:
            cuts.append([])
            held = 0
        cuts[-1].append(t)
        held += weights[t]
    parts = []
    for terms in filter(None, cuts):
        at = {t: i for i, t in enumerate(terms)}
        w = np.zeros((len(items), len(terms)))
        for row, (_, ts) in enumerate(items):
            for t in ts:
                if t in at:
                    w[row, at[t]] = weights[t]
        parts.append((np.array(terms, np.int64), w))
    return Tile(tuple(i for i, _ in items), tuple(parts))


class Best:
    """The best ``k`` documents of each item so far: by score, equal ones by ascending id, a null id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * items
        self.ids = [np.zeros(0, np.int64)] * items
        self.floor = np.zeros(items, np.int64)  # score below which nothing can enter

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of items ``first``, ``first + 1``, ... by document; only those above 0 count."""
        for row in np.flatnonzero(scores.max(1, initial=0) >= np.maximum(self.floor[first : first + len(scores)], 1)).tolist():
            i = first + row
            new = np.flatnonzero(scores[row] >= max(self.floor[i], 1))
            s, d = np.concatenate([self.scores[i], scores[row, new]]), np.concatenate([self.ids[i], ids[new]])
            order = np.lexsort((d, -s))[: self.k]
            self.scores[i], self.ids[i] = s[order], d[order]
            if len(order) == self.k:
                self.floor[i] = s[order[-1]]


_NO_ID = np.iinfo(np.int64).max


def _counted(batch: pa.RecordBatch, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each row, and (row, number of the term, occurrences) of the vocabulary's terms in it."""
    sizes, rows, terms, tf = [], [], [], []
    for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
        found = terms_of(text)
        sizes.append(len(found))
        for t, n in Counter(found).items():
            number = vocabulary.get(t)
            if number is not None:
                rows.append(row)
                terms.append(number)
                tf.append(n)
    return np.array(sizes, np.int64), np.array(rows, np.int64), np.array(terms, np.int64), np.array(tf, np.int64)


def statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all documents, and document frequency of each of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value) + 2, np.int64)
        for batch in batches:
            for part in slices(batch):
                sizes, _, terms, _ = _counted(part, shared.value)
                df[:-2] += np.bincount(terms, minlength=len(df) - 2)
                df[-2:] += [int((sizes > 0).sum()), int(sizes.sum())]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], names=["term", "n"])

    sums = docs.mapInArrow(fn, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most MOST_TERMS and two
    found = {r.term: r.n for r in sums}
    return found.get(len(vocabulary), 0), found.get(len(vocabulary) + 1, 0), found


def _passes(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with their distinct terms, in passes of at most MOST_TERMS of these together; one item with more is a pass."""
    held, n = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        ts = sorted(set(terms_of(bytes(r.text))))
        if held and n + len(ts) > MOST_TERMS:
            yield held
            held, n = [], 0
        held.append((r.item, ts))
        n += len(ts)
    if held:
        yield held


def _one_pass(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    n_docs, total, df = statistics(docs, vocabulary)
    weights = {i: weight(n_docs, df.get(i, 0)) for i in vocabulary.values()}
    numbered = [(item, [vocabulary[t] for t in ts]) for item, ts in items]
    tiles = [tile(numbered[i : i + ITEMS], weights) for i in range(0, len(numbered), ITEMS)]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, tiles))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tiles = shared.value
        best = Best(sum(len(t.items) for t in tiles), k)
        for batch in batches:
            for part in slices(batch, rows=DOCUMENTS):
                sizes, rows, terms, tf = _counted(part, vocabulary)
                if not len(rows):
                    continue
                ids = part.column(0).fill_null(_NO_ID).to_numpy()
                value = impacts(tf, sizes[rows], n_docs, total).astype(np.float64)
                first = 0
                for t in tiles:
                    scores = np.zeros((len(t.items), part.num_rows), np.int64)
                    for held, w in t.parts:
                        at = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                        mine = np.flatnonzero(held[at] == terms)
                        if len(mine):
                            dense = np.zeros((len(held), part.num_rows))
                            dense[at[mine], rows[mine]] = value[mine]
                            scores += (w @ dense).astype(np.int64)
                    best.add(first, scores, ids)
                    first += len(t.items)
        names = np.array([i for t in tiles for i in t.items], np.int64)
        sizes = list(map(len, best.ids))
        found = np.concatenate([np.zeros(0, np.int64), *best.ids])
        arrays = [pa.array(np.repeat(names, sizes), pa.int64()), pa.array(found, pa.int64(), mask=found == _NO_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *best.scores]), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    return docs.mapInArrow(fn, "item long, doc_id long, score long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` the ``k`` highest-scoring documents above 0, equal scores by ascending id.

    Documents: ``doc_id, text``; null and empty texts have no terms and are found for nothing. A repeated document is found as often as
    it is there; a document without an id comes after those of equal score and keeps its null. Items: ``item_id, text``; one without terms finds nothing, repeated rows of
    an id with one text are one item (ids must not have several texts), a null id stays null. Empty tables give an empty result; other columns are not read.
    """
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    distinct = items.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    asked = saved(distinct.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    made = None
    for some in _passes(asked.select("item", "text")):
        found = _one_pass(given, some, k)
        made = found if made is None else made.unionByName(found)
    if made is None:
        made = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long, part int")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "part"], ["item"]):
        made = made.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return made.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
