"""Token counts at every prefix by dynamic programming over byte-pair merges.

A sequence of tokens is what the merges make of its bytes exactly if every two neighbours in it stay apart when they are merged
by themselves. So the last token of a prefix is the one token that ends there and stays apart from the last token of the
prefix before it, and the count of a prefix is that prefix's count plus one: one step a byte, without merging a
word once. The vocabulary marks word ends, so each prefix of a word has two states: as the beginning of a longer word
(last token without the mark), from which the steps go on, and as a whole word (last token with it), which is what a text cut there has.

The table of a text answers every question about cuts and budgets: the tokens of any prefix, and the longest prefix within a budget.
Normalisation and word splitting are those of the tokenizer's file, done by the public library; ids are never made.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import by_slices, word_store

#: White space as the tokenizer's pattern has it. No token spans it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A stretch between white space, with one white space after it.
STRETCH = re.compile(f"[^{SPACE}]+[{SPACE}]?|[{SPACE}]+")
BARE, BREAK = re.compile(f"[^{SPACE}]*"), re.compile(f"[{SPACE}]")
#: Words as the tokenizer's pattern has them, and white space, in lower-case text of the first 256 code points; such texts are looked up word by word.
WORD, WIDE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff{SPACE}]+|[{SPACE}]+"), re.compile(r"[^\x00-\xff]")
#: Words and stretches whose tokens a worker keeps, in each of two generations; their longest; pairs of tokens whose verdict it keeps.
WORDS_KEPT, CHARS_KEPT, PAIRS_KEPT = 200_000, 48, 200_000
#: Code points of a text that are in work at once.
BLOCK = 1 << 20
#: In a table: a place where no prefix ends, as the code points around it become one when normalised. Between white space where
#: normalisation changes the number of code points, every place before a code point that can combine with the one before counts as such.
NO_CUT = np.iinfo(np.int32).max


class Merges:
    """Tokens of a vocabulary with word-end marks, and which of them stay apart."""

    def __init__(self, vocab: dict[str, int], merges: list, mark: str):
        self.k = max(vocab.values()) + 1
        self.rank: dict[int, tuple[int, int]] = {}
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        body = {}
        for token, i in vocab.items():
            if len(token) == 1:
                self.inner[token], body[i] = i, token
            elif len(token) == 1 + len(mark) and token.endswith(mark):
                self.final[token[0]], body[i] = i, token[0]
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        born: dict[int, int] = {}
        for at, pair in enumerate(merges):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = vocab["".join(pair if not isinstance(pair, str) else pair.split(" "))]
            if made in born or at <= born.get(a, -1) or at <= born.get(b, -1) or a not in body or b not in body:
                raise ValueError("merges must come after those that make their parts, one for each token")
            born[made], self.rank[a * self.k + b], self.parts[made] = at, (at, made), (a, b, at)
            body[made] = body[a] + body[b]
            (self.final if self.final.get(body[b]) == b else self.inner)[body[made]] = made
        self.apart_kept: dict[int, bool] = {}
        unsound = set()  # tokens that merging their own bytes doesn't give: no prefix ends in them
        for token, (a, b, rank) in self.parts.items():
            if a in unsound or b in unsound or self._crossing(a, b) != [rank]:
                unsound.add(token)
        self.inner, self.final = ({t: i for t, i in tokens.items() if i not in unsound} for tokens in (self.inner, self.final))
        self.lengths = [self._lengths(t) for t in (self.inner, self.final)]

    @staticmethod
    def _lengths(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """Last symbols, up to three -> lengths of the tokens that end there, longest first."""
        found: dict[str, set[int]] = {}
        for t in tokens:
            found.setdefault(t[-3:], set()).add(len(t))
        for end, lengths in found.items():
            lengths.update(n for n in (1, 2) if n < len(end) and end[-n:] in tokens)
        return {e: tuple(sorted(n, reverse=True)) for e, n in found.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one edge of ``token`` while it is made, each with the rank of the merge that ends it."""
        out: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.parts:
            rank = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, rank))
        return out

    def _crossing(self, a: int, b: int) -> list[int]:
        """Ranks of merges that would join an edge of ``a`` with an edge of ``b`` while both are there; of equal ranks the left one goes first."""
        found = []
        for x, x_ends in self._edge(a, 1):
            for y, y_ends in self._edge(b, 0):
                at = self.rank.get(x * self.k + y)
                if at is not None and at[0] < x_ends and at[0] <= y_ends:
                    found.append(at[0])
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b``, side by side, stay as they are."""
        key = a * self.k + b
        known = self.apart_kept.get(key)
        if known is None:
            if len(self.apart_kept) >= PAIRS_KEPT:
                self.apart_kept.clear()
            known = self.apart_kept[key] = not self._crossing(a, b)
        return known

    def all_counts(self, words: Iterable[str], every: bool = True) -> Iterator[list[int]]:
        """For each word, in ascending order: tokens of its first 1, 2, ... symbols as words of their own, or of the whole word only.

        Steps over the symbols that a word shares with the one before it are not repeated.
        """
        inner, final, (inner_lengths, final_lengths), kept, k = self.inner, self.final, self.lengths, self.apart_kept, self.k
        before, last, count, whole = "", [-1], [0], []
        for word in words:
            n, same = len(word), 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :], whole[same:]
            for i in range(len(last), n):
                for size in inner_lengths.get(word[i - 3 if i > 3 else 0 : i]) or inner_lengths.get(word[i - 2 : i]) or (1,):
                    if size <= i and (token := inner.get(word[i - size : i])) is not None:
                        if size < i:
                            a = last[i - size]
                            free = kept.get(a * k + token)
                            if not (self.apart(a, token) if free is None else free):
                                continue
                        last.append(token)
                        count.append(count[i - size] + 1)
                        break
            if not every:
                whole = []
            for i in range(len(whole) + 1 if every else n, n + 1):
                for size in final_lengths.get(word[i - 3 if i > 3 else 0 : i]) or final_lengths.get(word[i - 2 : i]) or (1,):
                    if size <= i and (token := final.get(word[i - size : i])) is not None:
                        if size < i:
                            a = last[i - size]
                            free = kept.get(a * k + token)
                            if not (self.apart(a, token) if free is None else free):
                                continue
                        whole.append(count[i - size] + 1)
                        break
            before = word
            yield whole

    def whole_counts(self, word: str) -> list[int]:
        return next(self.all_counts([word]))


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Code points that canonical composition may join to the one before them though they are no marks."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    found = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(found | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


def _combines(c: str) -> bool:
    return unicodedata.combining(c) != 0 or c in _seconds()


class Prefixes:
    """Tables of prefix counts under one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        whole = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.one = lru_cache(maxsize=50_000)(self.normalizer.normalize_str)
        self.own = f"tokens:{path}"
        self.store: dict[str, int] = word_store(self.own)
        self.older: dict[str, int] = {}

    def _words(self, text: str) -> list[tuple[str, str]]:
        """Words of normalised text: as written and in the vocabulary's symbols, one a byte."""
        if text.isascii() and text.isalpha():
            return [(text, text)]
        return [(text[a:b], symbols) for symbols, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _normalised(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text and, where code points changed in number, how many of the given ones each prefix of it takes (0: not a prefix)."""
        if text.isascii():
            return text.lower(), None
        made = self.normalizer.normalize_str(text)
        if len(made) == len(text) and all(self.one(a) == b for a, b in zip(text, made, strict=True)):
            return made, None
        parts = [text[a:b] for a, b in pairwise([0, *(i for i in range(1, len(text)) if not _combines(text[i])), len(text)])]
        forms = list(map(self.one, parts))
        if "".join(forms) != made:
            return made, [0] * (len(made) - 1) + [len(text)]
        places = [0] * len(made)
        for chars, taken in zip(accumulate(map(len, forms)), accumulate(map(len, parts)), strict=True):
            places[chars - 1] = taken
        return made, places

    def _total(self, text: str) -> int:
        return sum(self.merges.whole_counts(s)[-1] for _, s in self._words(text))

    def _word(self, word: str, symbols: str) -> list[int]:
        """Counts at every code point of a word."""
        ends = list(accumulate(len(c.encode()) for c in word)) if len(symbols) != len(word) else list(range(1, len(word) + 1))
        counts = []
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a cut of 're is two words
            counts = [self._total(word[:n]) for n in range(1, len(word))]
            ends = ends[-1:]
        whole = self.merges.whole_counts(symbols)
        return counts + [whole[e - 1] for e in ends]

    def _kept(self, key: str) -> int | None:
        known = self.older.get(key)
        if known is not None:
            self._keep(key, known)
        return known

    def _keep(self, key: str, tokens: int) -> None:
        if len(key) <= CHARS_KEPT:
            if len(self.store) >= WORDS_KEPT:
                self.older = dict(self.store)
                self.store.clear()
            self.store[key] = tokens

    def learn(self, texts: Iterable[str | None]) -> None:
        """Keeps the tokens of the texts' words of plain letters not met before, counted in their order, in which neighbours begin alike."""
        self.store = word_store(self.own)
        met: set[str] = set()
        for t in texts:
            if t and len(t) <= BLOCK and self._is_plain(t):
                met.update(set(WORD.findall(t.lower())).difference(self.store))
        new = sorted(w for w in met if w.isascii() and w.isalpha() and len(w) <= CHARS_KEPT and w not in self.older)
        for w, counts in zip(new, self.merges.all_counts(new, every=False), strict=True):
            self._keep(w, counts[-1])

    def _plain(self, text: str, before: int, out: list[int]) -> str:
        """Appends the counts of the prefixes of a stretch without special tokens; returns its last word."""
        made, places = self._normalised(text)
        counts, word = [], ""
        for word, symbols in self._words(made):
            counts += [before + n for n in self._word(word, symbols)]
            before = counts[-1]
        if places is not None:
            at = np.full(len(text) + 1, NO_CUT, np.int64)
            at[places] = counts
            counts = at[1:].tolist()
        out += counts
        return word

    def stretch(self, text: str) -> list[int]:
        """Counts at every prefix of one stretch."""
        bare = BARE.match(text).group()
        out: list[int] = []
        word = ""
        for nth, part in enumerate(self.special.split(bare)):
            if nth % 2:  # a special token; cut within, it is ordinary text that goes on from the word before it
                upto = out[-1] if out else 0
                start = upto - (self._total(word) if word else 0)
                out += [start + self._total(word + part[:n].lower()) for n in range(1, len(part))]
                out.append(upto + 1)
                word = ""
            elif part:
                word = self._plain(part, out[-1] if out else 0, out)
        return out + [out[-1] if out else 0] * (len(text) - len(bare))

    def _is_plain(self, text: str) -> bool:
        return WIDE.search(text) is None and self.special.search(text) is None

    def blocks(self, text: str) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words or stretches of the text and the tokens up to the end of each, a block of the text at a time."""
        store = self.store = word_store(self.own)
        plain = self._is_plain(text)
        before = at = 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                cut = BREAK.search(text, end)
                end = cut.end() if cut else len(text)
            found = WORD.findall(text[at:end].lower()) if plain else STRETCH.findall(text, at, min(end, len(text)))
            tokens = list(map(store.get, found))
            if None in tokens:
                for i, t in enumerate(tokens):
                    if t is None:
                        t = store.get(found[i])
                        if t is None:
                            t = self._kept(found[i])
                        if t is None:
                            t = self.stretch(found[i])[-1]
                            self._keep(found[i], t)
                        tokens[i] = t
            upto = before + np.cumsum(np.array(tokens, np.int64))
            yield found, upto
            before = int(upto[-1])
            at = end

    def table(self, text: str) -> np.ndarray:
        """Entry ``p - 1``: tokens of the first ``p`` code points, NO_CUT where they don't end a prefix."""
        made = [np.zeros(0, np.int64)]
        before = 0
        for found, upto in self.blocks(text):
            for part, end in zip(found, upto.tolist(), strict=True):
                counts = np.array(self.stretch(part), np.int64)
                made.append(np.where(counts == NO_CUT, NO_CUT, counts + before))
                before = end
        return np.concatenate(made)

    def answer(self, text: str | None, budget: int) -> tuple[int, int, int]:
        """Tokens of the text, code points of its longest prefix within the budget, and that prefix's tokens.

        The counts up to each word's end find the word that the budget cuts; the counts at that word's own prefixes find the place.
        """
        total = fit = fit_tokens = 0
        for found, upto in self.blocks(text or ""):
            if total <= budget:
                whole = int(np.searchsorted(upto, budget, "right"))
                fit += sum(map(len, found[:whole]))
                fit_tokens = int(upto[whole - 1]) if whole else total
                if whole < len(found):
                    counts = self.stretch(found[whole])
                    within = [i for i, c in enumerate(counts) if fit_tokens + c <= budget]
                    if within:
                        fit, fit_tokens = fit + within[-1] + 1, fit_tokens + counts[within[-1]]
            total = int(upto[-1])
        return total, fit, fit_tokens


@lru_cache(maxsize=2)
def prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def count(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars, fit_tokens``: tokens of every whole text and its longest prefix within ``budget``.

    Only byte-pair files with word-end marks. A null text counts as empty: no bytes, no tokens, not over the limit. Repeated rows
    give equal results; a null id stays null; an empty table gives an empty result; other columns are not read.
    """

    def fn(x: dict) -> dict:
        known = prefixes(path)
        known.learn(x["text"])
        found = [known.answer(t, budget) for t in x["text"]]
        return {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], "n_tokens": [a for a, _, _ in found], "over_limit": [a > budget for a, _, _ in found], "fit_chars": [b for _, b, _ in found], "fit_tokens": [c for _, _, c in found]}

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    long = pa.int64()
    arrow = pa.schema([("doc_id", long), ("n_bytes", long), ("n_tokens", long), ("over_limit", pa.bool_()), ("fit_chars", long), ("fit_tokens", long)])
    return given.mapInArrow(by_slices(fn, arrow), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint, fit_tokens bigint")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, counts``: for every prefix of the text, by code points, its exact number of tokens; null where a prefix cuts what normalises to one.

    Written once, the table answers any later budget through ``tokens_of`` and ``longest_within``. A null or empty text has no prefixes.
    """

    def fn(x: dict) -> dict:
        made = []
        for t in x["text"]:
            counts = prefixes(path).table(t or "")
            made.append(pa.array(counts, pa.int32(), mask=counts == NO_CUT))
        offsets = np.cumsum([0, *map(len, made)])
        flat = pa.concat_arrays(made) if made else pa.array([], pa.int32())
        return {"doc_id": x["doc_id"], "counts": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)}

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return given.mapInArrow(by_slices(fn, pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))])), "doc_id bigint, counts array<int>")


def tokens_of(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points; of all where there are fewer."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts))
    return F.when(at < 1, F.lit(0)).otherwise(F.try_element_at(counts, at))


def longest_within(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens; 0 where none has so few."""
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i + 1))), F.lit(0))
