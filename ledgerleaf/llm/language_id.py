"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound as the product of its letters'
vectors, the first rotated by two places and the second by one; a text bundles (sums) its trigrams.
A language prototype is the sum of its texts' vectors, so that it can be added up in parts on all
training rows. A text takes the language whose centred prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import slices

#: Places of a vector, letters told apart (others share by their code), seed of the vectors.
PLACES, LETTERS, SEED = 512, 4096, 20240
#: Prototypes are sent to all tasks; more languages than this are refused, which bounds their size.
MOST_LANGUAGES = 4096
#: Characters whose trigrams are counted at a time; longer texts are counted in several steps.
STEP_CHARS = 1 << 20
#: Sharpness of the score, the softmax of the cosines.
SHARPNESS = 20.0


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """(3, LETTERS, PLACES): the letters' vectors rotated by two, one and no places. Letter 0 is the gap between words."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, PLACES))
    return np.stack([np.roll(base, 2, 1), np.roll(base, 1, 1), base])


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    """Letter number of each code point: 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    table[letters] = 1 + (letters - np.where(letters < 0x10000, 97, 0)) % (LETTERS - 1)
    return table


def letters_of(text: str) -> np.ndarray:
    """Letter numbers of a lower-cased text with one gap between words and at either end."""
    codes = _code_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = codes == 0
    codes = codes[~(gap & np.concatenate([[True], gap[:-1]]))] if len(codes) else codes
    return np.concatenate([[0], codes, [0]]).astype(np.int64)


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the whole text, as numbers, and their counts; none if it has no letter."""
    codes = letters_of(text or "")
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for at in range(0, max(1, len(codes) - 2), STEP_CHARS):
        c = codes[at : at + STEP_CHARS + 2]
        parts.append(np.unique((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], return_counts=True))
    if len(parts) == 1:
        return parts[0]
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    first, second, third = letter_vectors()
    return first[keys // (LETTERS * LETTERS)] * second[keys // LETTERS % LETTERS] * third[keys % LETTERS]


def bundle(texts: list[str | None]) -> np.ndarray:
    """A row a text: the sum of its trigrams' vectors."""
    found = [trigram_counts(t) for t in texts]
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    vectors = trigram_vectors(keys).astype(np.float32)
    out, at = np.zeros((len(texts), PLACES), np.float32), 0
    for i, (k, n) in enumerate(found):
        if len(k):
            out[i] = n.astype(np.float32) @ vectors[back[at : at + len(k)]]
            at += len(k)
    return out


def prototypes(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Sum of the unit-length vectors of each language's texts, over all rows; null languages and texts without letters don't count."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                made = bundle(part.column(1).to_pylist())
                made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
                for lang, v in zip(part.column(0).to_pylist(), made, strict=True):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * PLACES), pa.array(range(PLACES), pa.int32()), pa.array(v)], names=["lang", "place", "v"])

    parts = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(fn, "lang string, place int, v double")
    # rounded, so that the order of addition doesn't show
    sums = parts.groupBy("lang", "place").agg(F.sum(F.round("v", 6).cast("decimal(28,6)")).cast("double").alias("v"))
    packed = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(packed) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = {r["lang"]: np.array([x["v"] for x in r["v"]]) for r in packed}
    return {k: found[k] for k in sorted(found) if np.any(found[k])}


def predict(rows: DataFrame, learned: dict[str, np.ndarray], keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Columns in ``keep``, ``lang_pred`` and ``score`` for every whole text.

    ``und`` with score 0 for a null text, a text without letters, or when nothing was learned. Ties go to
    the language first in order. Repeated rows and other columns don't matter; an empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    names = list(learned)
    unit = np.stack([v / np.linalg.norm(v) for v in learned.values()]) if names else np.zeros((0, PLACES))
    centre = unit.mean(0) if len(names) > 1 else np.zeros(PLACES)
    table = unit - centre
    table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    centre = centre.astype(np.float32)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = bundle(part.column(len(keep)).to_pylist())
                length = np.linalg.norm(made, axis=1, keepdims=True)
                some = (length[:, 0] > 0) & bool(names)
                made = made / np.maximum(length, 1e-9) - centre
                made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
                cosine = np.round(made @ table.T, 5) if names else np.zeros((len(made), 1))
                best = cosine.argmax(1)
                spread = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
                score = np.where(some, np.round(1 / spread.sum(1), 6), 0.0)
                lang = [names[b] if ok else "und" for b, ok in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, F.col(text_col).alias("_text")).mapInArrow(fn, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn from documents that are not held out, predict all."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    learned = prototypes(rows.where(~F.col("held_out")).select("lang", "text"))
    return predict(rows, learned, ["doc_id", "held_out"])
