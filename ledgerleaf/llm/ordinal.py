"""Quality classifier: cumulative-link (ordinal) regression on graded ratings over hashed text.

One weight vector over hashed words and coarse shape features gives a document's score ``z``;
ordered thresholds ``t0 < t1 < ...`` shared by all documents give ``P(grade <= k) = logistic(t_k - z)``. From
these follow the expected grade and the tail probability of the top grade, by which documents are
selected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import by_slices, slices, word_store

#: Hashed features, and the labelled rows that the fit uses at most (those of the smallest id hashes).
BUCKETS, MOST_LABELLED = 1 << 18, 12_000
#: A feature counts in the fit if at least so many labelled documents have it.
LEAST_DOCS = 20
EPOCHS, BATCH, RATE, LASSO, START = 20, 256, 0.5, 5e-4, 1e-3
GRADES = 3
#: A document is kept if its probability of the top grade is at least this.
KEEP_FROM = 0.8
WORDS_KEPT = 150_000

_WORD = re.compile(r"\w+")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
_SYMBOLS = "#*$%&|<>"


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % BUCKETS


def _step(x: float, of: float) -> int:
    """Share in steps that double, 0 for none to 10 for all."""
    return 0 if not x else max(1, 10 + int(np.floor(np.log2(min(1.0, x / max(of, 1)) + 1e-9))))


def features(text: str | None) -> list[int]:
    """Buckets of the distinct lower-cased words of the whole text and of its shape; empty if it has no word."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return []
    distinct = set(words)
    kept: dict[str, int] = word_store("ordinal")
    if len(kept) > WORDS_KEPT:
        kept.clear()
    out = set()
    for w in distinct:
        h = kept.get(w)
        if h is None:
            h = kept[w] = _bucket(w)
        out.add(h)
    n, chars = len(words), len(text)
    lines = text.split("\n")
    shape = {
        "symbols": _step(sum(map(text.count, _SYMBOLS)), chars), "capitals": _step(len(_CAPITALS.findall(text)), chars),
        "exclamations": _step(text.count("!"), n), "bars": _step(text.count("|"), n), "distinct": _step(len(distinct), n),
        "lines": _step(len(set(lines)), len(lines)), "length": min(14, n.bit_length()), "digits": _step(sum(map(text.count, "0123456789")), chars),
        "beside": _step(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
    }
    out.update(_bucket(f"\0{k}={v}") for k, v in shape.items())
    return sorted(out)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, z: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade <= k)."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))

    def score(self, found: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(f) for f in found])
        flat = np.fromiter((b for f in found for b in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        return np.bincount(owner, self.weights[flat], len(found))


def fit_rows(found: list[np.ndarray], grade: np.ndarray, grades: int = GRADES) -> Model:
    """Maximum likelihood by AdaGrad in small batches; weights are drawn to 0 by a constant step (lasso)."""
    if len(found):
        common = np.bincount(np.concatenate(found), minlength=BUCKETS) >= LEAST_DOCS
        found = [f[common[f]] for f in found]
    w, size = np.zeros(BUCKETS), np.full(BUCKETS, START)
    start = np.clip(np.array([(grade <= k).mean() if len(grade) else 0.5 for k in range(grades - 1)]), 0.01, 0.99)
    t = np.log(start / (1 - start)) + np.arange(grades - 1) * 1e-3
    t_size = np.full(grades - 1, 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS if len(found) else 0):
        order = rng.permutation(len(found))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            sizes = np.array([len(found[r]) for r in rows])
            flat = np.concatenate([found[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            z = np.bincount(owner, w[flat], len(rows))
            y = grade[rows]
            below = 1 / (1 + np.exp(-np.clip(t[None, :] - z[:, None], -30, 30)))
            full = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], 1)
            upper, lower = full[np.arange(len(rows)), y + 1], full[np.arange(len(rows)), y]
            p = np.maximum(upper - lower, 1e-9)
            slope = (upper + lower - 1) / len(rows)  # of the log-likelihood in z
            touched, back = np.unique(flat, return_inverse=True)
            g = np.bincount(back, np.repeat(slope, sizes))
            size[touched] += g * g
            step = RATE / np.sqrt(size[touched])
            moved = w[touched] + step * g
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
            gate = np.zeros(grades - 1)
            for k in range(grades - 1):
                d = below[:, k] * (1 - below[:, k])
                gate[k] = (np.where(y == k, d / p, 0) - np.where(y == k + 1, d / p, 0)).mean()
            t_size += gate * gate
            t = t + RATE * gate / np.sqrt(t_size)
            t = np.maximum.accumulate(t + np.arange(grades - 1) * 1e-6)
    return Model(w, t)


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 low quality, 1 toxic, 2 good; of several labels of a document the worst counts, nulls don't."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .select("doc_id", F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2).alias("grade"))
    )


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` rows of labelled documents: the ids, and then their rows, of the least hashes, so that reruns agree.

    Null texts and texts without a word don't count. No labels, or an empty table, give a model of weights 0.
    """
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def fn(x: dict) -> dict:
        return {"order": x["order"], "grade": x["grade"], "found": [features(t) for t in x["text"]]}

    schema = pa.schema([("order", pa.int64()), ("grade", pa.int32()), ("found", pa.list_(pa.int32()))])
    # at most `most` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    made = rows.select(F.xxhash64("doc_id", "text").alias("order"), "grade", "text")
    held = made.mapInArrow(by_slices(fn, schema), "order bigint, grade int, found array<int>")
    table = held.orderBy("order", "grade").limit(most).toArrow()  # rows that repeat an id count, within the bound
    rows = sorted(zip(table["order"].to_pylist(), table["grade"].to_pylist(), range(table.num_rows), strict=True))
    whole = table["found"].combine_chunks()
    offsets, values = whole.offsets.to_numpy(), whole.values.to_numpy()
    picked = [k for _, _, k in rows if offsets[k + 1] > offsets[k]]
    grades = table["grade"].to_numpy()
    return fit_rows([values[offsets[k] : offsets[k + 1]] for k in picked], grades[picked].astype(int))


def rate(docs: DataFrame, model: Model, keep: list[str] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Columns in ``keep`` with ``expected_grade``, ``p_top`` and ``kept`` of every whole text.

    A text without a word (null, empty) has grade 0 and is not kept. Where nothing was labelled all weights
    are 0 and the thresholds undecided, so every text with a word is kept. Repeated rows are rated alike; an empty
    table gives an empty result. Columns of ``docs`` that are not in ``keep`` are not read, whatever their names.
    """
    keep = keep or ["doc_id"]
    trained = bool(np.any(model.weights))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [features(t) for t in part.column(len(keep)).to_pylist()]
                some = np.array([bool(f) for f in found])
                below = model.below(model.score(found))
                top = np.where(some, 1 - below[:, -1], 0.0)
                expected = np.where(some, (1 - below).sum(1), 0.0)
                kept = some & ((top >= keep_from) | (not trained))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], pa.array(np.round(expected, 6)), pa.array(np.round(top, 6)), pa.array(kept)],
                    names=[*keep, "expected_grade", "p_top", "kept"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"{kinds}, expected_grade double, p_top double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, expected_grade, p_top, kept`` of every document."""
    return rate(docs, fit(docs, labels))
