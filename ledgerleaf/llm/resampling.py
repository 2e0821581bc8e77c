"""Importance resampling towards a target distribution of hashed word runs.

Features of a text are its runs of one to three words; a feature's bucket is its CRC-32 modulo BUCKETS. No run is ever hashed
as a whole: the distinct words of a slice of texts, each between two delimiters, are the keys of an Aho-Corasick automaton. Scanning a text
emits its words' payloads in order, the CRC and the length of each, and neighbouring payloads compose: the CRC of two joined strings is the
first one's, moved on by as many zero bytes as the second is long (a linear map over bits, four table look-ups), exclusive-or the second one's.

Gains of buckets come from the counts of all documents and of all target texts. A document's weight is the sum of its features' gains; with
Gumbel noise fixed by its id added, the highest scores are a sample without replacement in proportion to the exponentials of the weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import saved, slices

BUCKETS = 10_000
#: Words of the longest run.
RUN = 3
#: Words below which a document is not drawn.
LEAST_WORDS = 20
#: Rows and bytes of text that one automaton serves.
SLICE_ROWS, SLICE_BYTES = 1_024, 2 << 20
#: Longer words move a CRC bit by bit instead of by tables.
LONGEST = 64
#: Bytes that are no part of a word become blanks, capital letters small ones; all bytes from 128 on belong to words.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=1)
def _zero_byte() -> np.ndarray:
    """What one zero byte makes of each bit of a CRC-32 register."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return byte[bits & 0xFF] ^ (bits >> 8)


def _applied(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map whose images of single bits are ``columns``, applied to all values."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & 1, columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """``[length, byte place, byte]``: what ``length`` zero bytes make of that byte of a register."""
    bytes_ = np.arange(256, dtype=np.uint32)
    tables, columns = [], np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(LONGEST + 1):
        tables.append([_applied(columns, bytes_ << np.uint32(8 * place)) for place in range(4)])
        columns = _applied(_zero_byte(), columns)
    return np.array(tables, np.uint32)


def moved(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC registers after that many zero bytes each."""
    table, short = _moves(), np.minimum(zeros, LONGEST)
    out = table[short, 0, crc & 0xFF]
    for place in (1, 2, 3):
        out = out ^ table[short, place, crc >> np.uint32(8 * place) & 0xFF]
    for at in np.flatnonzero(zeros > LONGEST).tolist():  # by squaring, for the rest of the length
        left, columns, value = int(zeros[at]) - LONGEST, _zero_byte(), out[at : at + 1]
        while left:
            if left & 1:
                value = _applied(columns, value)
            columns, left = _applied(columns, columns), left >> 1
        out[at] = value[0]
    return out


class Dictionary:
    """The distinct words of some texts as keys of an automaton, with payloads."""

    def __init__(self, texts: list[str]):
        words = list(set().union(*(t.split(" ") for t in texts)) - {""})
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w} ", i)
        if words:
            self.automaton.make_automaton()
        raw = [w.encode(errors="surrogateescape") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.alone = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
        self.after = moved(np.full(len(raw), zlib.crc32(b" "), np.uint32), length) ^ self.alone  # with the blank before it
        self.length = length + 1

    def scan(self, texts: list[str]) -> np.ndarray:
        """Numbers of the words of all texts in order; one reading."""
        joined = " ".join(filter(None, texts))
        if not joined:
            return np.zeros(0, np.int64)
        return np.fromiter(chain.from_iterable(self.automaton.iter(f" {joined} ")), np.int64)[1::2]  # of (place, number)

    def buckets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and of all runs of up to RUN words the text's place and the bucket."""
        sizes = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), np.int64, len(texts))
        words, text = self.scan(texts), np.repeat(np.arange(len(texts)), sizes)
        start, crc = np.arange(len(words)), self.alone[words]
        texts_of, found = [text], [crc]
        for n in range(1, RUN):  # runs of n + 1 words: those of n with the word after them, if it is of the same text
            goes_on = start + n < len(words)
            goes_on[goes_on] = text[start[goes_on] + n] == text[start[goes_on]]
            start = start[goes_on]
            following = words[start + n]
            crc = moved(crc[goes_on], self.length[following]) ^ self.after[following]
            texts_of.append(text[start])
            found.append(crc)
        return sizes, np.concatenate(texts_of), np.concatenate(found) % np.uint32(BUCKETS)


def plain(text: bytes | None) -> str:
    """Small letters, one blank between words."""
    return b" ".join(text.translate(_TABLE).split()).decode(errors="surrogateescape") if text else ""


def _bucketed(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for part in slices(batch, SLICE_ROWS, SLICE_BYTES):
        texts = list(map(plain, part.column(column).cast(pa.binary()).to_pylist()))
        yield part, *Dictionary(texts).buckets(texts)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n``: features of all texts by bucket; each task adds up before it sends at most BUCKETS rows."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, buckets in _bucketed(batch, 0):
                counts += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], names=["bucket", "n"])

    return texts.select("text").mapInArrow(fn, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS))))`` of every bucket."""
    t_all, s_all = int(target.sum()) + BUCKETS, int(source.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((int(t) + 1) * s_all / ((int(s) + 1) * t_all))) for t, s in zip(target, source, strict=True)], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: str = "42") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sizes, text, buckets in _bucketed(batch, 1):
                ids, n = part.column(0).to_pylist(), part.num_rows
                weights = np.bincount(text, shared.value[buckets], n).astype(np.int64)  # whole numbers far below 2^53
                scores = weights + np.fromiter((noise(i, seed) for i in ids), np.int64, n)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, sizes, np.bincount(text, minlength=n), weights, scores)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(fn, ", ".join(f"{n} long" for n in names))


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` (of a written table) with ``rank``: 1, 2, 3, ... by score, equal scores by ascending id, null after ``drawn``.

    Rows are dealt by ranges of (score, id) and numbered within each as they are written; a range's numbers go on where the ones before it end. A
    number of each row's own keeps a row that is repeated very often from being one range.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_nth")]
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(dealt.drop("_nth").withColumn("_at", F.monotonically_increasing_id()))  # partition << 33 | place
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    ends = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a shuffle partition
    starts, so_far = [], 0
    for r in ends:
        starts.append((r["_part"], so_far))
        so_far += r["n"]
    table = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    number = (F.col("_start") + place + 1).alias("rank")
    numbered = placed.withColumn("_part", part).join(F.broadcast(table), "_part").select(*rows.columns, number)
    return numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: str = "42") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where it isn't drawn.

    Of the N documents with at least LEAST_WORDS words the ``floor(percent N / 100)`` of highest score are drawn. Null and empty texts have no
    features and weigh 0. Repeated rows are drawn one by one, next to each other; a row without an id has noise of its own kind and comes after
    those of equal score. Without target texts all gains follow from the documents alone; empty tables give an empty result; other columns are not read.
    """
    counts = []
    for texts in (target, docs):
        found = np.zeros(BUCKETS, np.int64)
        for r in bucket_counts(texts).collect():  # at most BUCKETS rows
            found[r["bucket"]] = r["n"]
        counts.append(found)
    rows = saved(scored(docs, gains(*counts), seed))
    able = F.coalesce(F.col("n_words"), F.lit(0)) >= LEAST_WORDS
    long_enough = rows.where(able)
    return ranked(long_enough, percent * long_enough.count() // 100).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
