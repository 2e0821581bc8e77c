"""Quality rules whose cutoffs carry a guarantee on false rejection.

Every rule has a score, higher being worse, and a fixed grid of cutoffs. Labelled documents that pass the base rules
are halved by a hash of their text, a text that repeats in a stratum counting as one draw. Per stratum:

1. The first half orders the (rule, cutoff) pairs into one nested path of rule sets: a pair comes the earlier the smaller
   the share of good documents above its cutoff, so that every step rejects what the steps before it reject and more.
   Pairs that reject no further bad document are left out.
2. The second half tests the steps from the most lenient on (fixed-sequence testing). A step holds if the exact
   binomial tail shows, at level ``delta`` divided by the number of strata, that the rule set up to it rejects less
   than ``alpha`` of good documents; the first step that doesn't hold ends the sequence.
3. Among the steps that hold, the one that rejects most bad documents for the good ones it costs is taken.

So with probability ``1 - delta`` the rules together falsely reject less than ``alpha`` of the good documents of every
stratum. The bound can hold from ``log(delta / strata) / log(1 - alpha)`` good texts in the second half on (77 for four
strata); a stratum with fewer rejects by the base rules alone.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import by_slices, saved

#: Score columns and their grids of cutoffs; a document is rejected if its score is above the cutoff.
RULES: dict[str, list[float]] = {
    "symbols_per_1000": [400, 300, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 15, 10],
    "capitals_per_1000": [950, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100],
    "exclamations_per_1000": [300, 200, 150, 100, 80, 60, 40, 30, 20, 10],
    "dup_lines_per_1000": [950, 900, 800, 700, 600, 500, 400, 300, 200, 100],
    "repeats_per_1000": [950, 900, 800, 700, 600, 500, 400, 300, 200, 100],
    "bars_per_1000_words": [900, 700, 500, 300, 200, 150, 100, 50, 20],
    "same_word_per_1000": [900, 700, 500, 300, 200, 150, 100, 80, 60, 40],
    "mean_word_length": [40, 30, 25, 20, 16, 14, 12, 11, 10, 9],
    "missing_words": [95, 90, 80, 70, 60, 50, 40, 30, 20, 10],
}
#: Share of good documents of a stratum that may be rejected at most, and the chance that this fails.
ALPHA, DELTA = 0.05, 0.1
#: What a good document rejected outweighs, in bad documents rejected, when a cutoff is chosen.
GOOD_WEIGHT = 10

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")


def measure(text: str | None) -> dict[str, int]:
    """Counts of one whole text; null counts as no text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    seen, dup_lines, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        met, twice = set(), set()
        for w in windows:
            (twice if w in met else met).add(w)
        covered = -1  # the last word counted
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    per = lambda x, of, k=1000: x * k // max(of, 1)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "symbols_per_1000": per(symbols, chars),
        "capitals_per_1000": per(len(_CAPITALS.findall(text)), chars),
        "exclamations_per_1000": per(text.count("!"), chars),
        "dup_lines_per_1000": per(dup_lines, lines),
        "repeats_per_1000": per(repeated, n),
        "bars_per_1000_words": per(text.count("|"), n),
        "same_word_per_1000": per(same, n),
        "mean_word_length": per(chars, n, 1),
        "missing_words": max(0, 100 - n),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURES = COUNTS + list(RULES)


def measures(docs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum, text_key`` and the counts and scores of every whole text."""

    def fn(x: dict) -> dict:
        found = [measure(t) for t in x["text"]]
        return {"doc_id": x["doc_id"], "stratum": x["stratum"], "text_key": x["text_key"]} | {k: [f[k] for f in found] for k in _MEASURES}

    schema = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), ("text_key", pa.int64()), *[(k, pa.int64()) for k in _MEASURES]])
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(by_slices(fn, schema), "doc_id bigint, stratum string, text_key bigint, " + ", ".join(f"{k} bigint" for k in _MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: np.ndarray, n: int, p: float) -> np.ndarray:
    """P(X <= k) of a binomial of ``n`` draws at rate ``p``, from the exact terms."""
    most = int(np.max(k, initial=0))
    if n <= 0:
        return np.ones(len(k))
    i = np.arange(min(most, n))
    steps = np.log((n - i) / (i + 1.0)) + np.log(p / (1 - p))
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    tail = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    return tail[np.minimum(k, len(tail) - 1)]


def ordered_steps(cells: pd.DataFrame) -> list[tuple[str, float]]:
    """The path of one stratum, ``(rule, cutoff)`` from lenient to strict, from its first half.

    ``cells``: ``rule, above, good, bad``, the texts whose score is above so many of the rule's cutoffs.
    """
    steps = []
    for at, (rule, grid) in enumerate(RULES.items()):
        mine = cells[cells["rule"] == rule]
        good, bad = np.zeros(len(grid) + 1, np.int64), np.zeros(len(grid) + 1, np.int64)
        np.add.at(good, mine["above"].to_numpy(), mine["good"].to_numpy())
        np.add.at(bad, mine["above"].to_numpy(), mine["bad"].to_numpy())
        # a falling grid: a score above grid[j] is above all later ones, so it has `above` >= len - j
        good_over, bad_over = np.cumsum(good[::-1]), np.cumsum(bad[::-1])
        most = 0
        for j in range(len(grid)):
            if bad_over[j] > most:
                most = bad_over[j]
                steps.append((int(good_over[j]), at, j, rule, float(grid[j])))
    return [(rule, cut) for _, _, _, rule, cut in sorted(steps)]


def last_step(good: np.ndarray, bad: np.ndarray, n_good: int, alpha: float, level: float) -> int:
    """How many steps of a path are taken. ``good[j]`` and ``bad[j]``: texts of the second half that step j is the first to reject."""
    over_good, over_bad = np.cumsum(good), np.cumsum(bad)
    holds = binomial_tail(over_good, n_good, alpha) <= level
    valid = len(good) if holds.all() else int(np.argmin(holds))
    if not valid:
        return 0
    gain = over_bad[:valid] - GOOD_WEIGHT * over_good[:valid]
    best = int(np.argmax(gain))
    return best + 1 if gain[best] > 0 else 0


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum``, a cutoff column a rule (null: never rejects), and ``n_good``, ``n_steps``, ``n_taken`` of the test.

    Labels with null id or quality don't count; of several labels of a document, or of a text, the lowest counts.
    Tasks see counts only: at most a row a (stratum, rule, grid cell), or a row a step of a stratum's path.
    """
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    of_text = measured.where(~base_failed()).join(judged, "doc_id").groupBy("stratum", "text_key").agg((F.min("quality") > 0).alias("good"), *[F.first(r).alias(r) for r in RULES])
    held = saved(of_text.withColumn("second", F.pmod(F.xxhash64("text_key", F.lit("half")), F.lit(2)) == 1))
    n_good, n_bad = F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    bins = [F.struct(F.lit(rule).alias("rule"), sum((F.col(rule) > F.lit(c)).cast("int") for c in grid).alias("above")) for rule, grid in RULES.items()]
    cells = held.where("not second").select("stratum", "good", F.inline(F.array(*bins))).groupBy("stratum", "rule", "above").agg(n_good, n_bad)
    order = list(RULES)

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = ordered_steps(pdf)
        return pd.DataFrame({"stratum": [pdf["stratum"].iat[0]], "steps": [[{"rule": order.index(r), "cutoff": c, "step": k} for k, (r, c) in enumerate(steps)]]})

    paths = saved(cells.groupBy("stratum").applyInPandas(path, "stratum string, steps array<struct<rule:int,cutoff:double,step:int>>"))
    scores = F.array(*[F.col(r).cast("double") for r in RULES])
    first = F.array_min(F.transform(F.filter("steps", lambda s: F.get("scores", s["rule"]) > s["cutoff"]), lambda s: s["step"]))
    tested = held.where("second").withColumn("scores", scores).join(paths, "stratum").withColumn("step", F.coalesce(first, F.lit(-1)))
    counts = saved(tested.groupBy("stratum", "step").agg(n_good, n_bad))
    strata = max(1, counts.select("stratum").distinct().count())

    def take(pdf: pd.DataFrame) -> pd.DataFrame:  # a row a step that is the first to reject some text, and -1 for the texts that stay
        size = int(pdf["n_steps"].iat[0])
        good, bad = np.zeros(size, np.int64), np.zeros(size, np.int64)
        some = pdf[pdf["step"] >= 0]
        good[some["step"].to_numpy()], bad[some["step"].to_numpy()] = some["good"].to_numpy(), some["bad"].to_numpy()
        n = int(pdf["good"].sum())
        taken = last_step(good, bad, n, alpha, delta / strata) if size else 0
        return pd.DataFrame({"stratum": [pdf["stratum"].iat[0]], "n_good": [n], "n_steps": [size], "n_taken": [taken]})

    sizes = counts.join(paths.select("stratum", F.size("steps").alias("n_steps")), "stratum")
    taken = sizes.groupBy("stratum").applyInPandas(take, "stratum string, n_good bigint, n_steps bigint, n_taken bigint")
    used = F.filter("steps", lambda s: s["step"] < F.col("n_taken"))

    def strictest(k: int) -> Column:
        return F.array_min(F.transform(F.filter("used", lambda s: s["rule"] == k), lambda s: s["cutoff"]))

    each = [strictest(k).alias(f"{rule}_cutoff") for k, rule in enumerate(order)]
    return paths.join(taken, "stratum").withColumn("used", used).select("stratum", *each, "n_good", "n_steps", "n_taken")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the rules that reject, a row a document.

    A null or empty text has no words and fails the base rules. A stratum without labels (and an empty
    table of labels) rejects by the base rules alone; a null stratum is one of its own. Repeated rows are judged
    alike. An empty table gives an empty result. ``doc_id`` is a whole number. Other columns of ``docs`` are not read.
    """
    measured = saved(measures(docs, stratum_col))
    cuts = saved(cutoffs(measured, labels, alpha, delta))
    rejects = F.array_compact(F.array(*[F.when(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(rule)) for rule in RULES]))
    return (
        measured.join(cuts, "stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", rejects)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .select("doc_id", *COUNTS, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))
    )
