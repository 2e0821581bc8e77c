"""Byte-level BPE with a segment tree over byte positions.

Each leaf stands for the byte position at which a live token starts and holds the rank of
the pair formed with the next live token, joined with the position, so that the minimum at the root is
the leftmost pair of lowest rank (an id is its rank). A merge touches at most three leaves, each a walk to the root:
n merges of a word cost O(n log n), also for words of many thousand bytes. Short words that a batch
meets for the first time are merged in step with numpy, each in its own tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerleaf.llm.common import SLICE_ROWS, by_slices, word_store

#: Distinct words whose ids a worker keeps; beyond it the store starts anew.
WORDS_KEPT = 200_000
#: Longer words are not kept.
WORD_BYTES_KEPT = 64


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: repeatedly merge the leftmost adjacent pair of lowest rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    size = 1 << (n - 1).bit_length()
    none = len(ranks) * n + n  # above every rank * n + position
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # end[i]: where the live token that starts at i ends
    start = list(range(-1, n))  # start[e]: where the live token that ends at e starts

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while (top := tree[1]) != none:
        i = top % n
        j = end[i]
        e = end[j]
        end[i] = e
        start[e] = i
        put(j, none)
        r = ranks.get(word[i : end[e]]) if e < n else None
        put(i, none if r is None else r * n + i)
        if i:
            h = start[i]
            r = ranks.get(word[h:e])
            put(h, none if r is None else r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder over one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.digits_of = {v: str(v) for v in self.bytes_of}
        self.words = regex.compile(pattern)
        self.own = f"bpe:{path}:{pattern}"
        self.kept: dict[str, tuple[int, ...]] = word_store(self.own)
        self.base = max(self.bytes_of) + 1
        self.numbers = list(range(self.base))  # one object an id, however many words have it
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                a, b = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)

    def _pair(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], np.int32(none))

    def merge_words(self, words: list[bytes], size: int) -> list[tuple[int, ...]]:
        """``merge_word`` for many words of at most ``size`` bytes (a power of two) in step, one tree a word."""
        count, wide = len(words), size + 1
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(count, size)
        length = np.fromiter(map(len, words), np.int64, count)
        ids = np.full((count, wide), -1, np.int32)
        ids[:, :size] = np.where(np.arange(size) < length[:, None], self.byte_ids[raw], np.int32(-1))
        none = self.base * size  # of 64 bytes at most: within 32 bits
        tree = np.full((count, 2 * size), none, np.int32)
        rank = self._pair(ids[:, : size - 1], ids[:, 1:size], self.base)
        tree[:, size : 2 * size - 1] = np.where(rank < self.base, rank * size + np.arange(size - 1), none)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), (count, 1))
        after[:, size] = size
        before = np.tile(np.arange(-1, size, dtype=np.int32), (count, 1))
        tree, flat_ids, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        row = np.arange(count)
        while len(row := row[tree[row * 2 * size + 1] < none]):
            root, line = row * 2 * size, row * wide
            top = tree[root + 1]
            i = top % size
            j = after[line + i]
            k = after[line + j]
            flat_ids[line + i] = top // size
            flat_ids[line + j] = -1
            after[line + i] = k
            before[line + k] = i
            h = before[line + i]
            mine = flat_ids[line + i]
            right = self._pair(mine, flat_ids[line + k], self.base)
            left = self._pair(np.where(h < 0, -1, flat_ids[line + np.maximum(h, 0)]), mine, self.base)
            tree[root + size + j] = none
            tree[root + size + i] = np.where(right < self.base, right * size + i, none)
            h_leaf = np.where(h < 0, j, h)
            tree[root + size + h_leaf] = np.where(left < self.base, left * size + h_leaf, none)
            for leaf in (j, i, h_leaf):
                at = size + leaf
                while at[0] > 1:  # all leaves are at one depth
                    at = at >> 1
                    tree[root + at] = np.minimum(tree[root + 2 * at], tree[root + 2 * at + 1])
        live = ids >= 0
        values, ends = list(map(self.numbers.__getitem__, ids[live].tolist())), np.cumsum(live.sum(1)).tolist()
        return [tuple(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, new: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words not met before; those of at most WORD_BYTES_KEPT bytes are kept."""
        kept, once, sizes = self.kept, {}, {}
        for w in new:
            b = w.encode()
            if (whole := self.ranks.get(b)) is not None:
                kept[w] = (whole,)
            elif len(b) <= WORD_BYTES_KEPT:
                sizes.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append((w, b))
            else:
                once[w] = tuple(merge_word(b, self.ranks))
        for size, found in sizes.items():
            for w, x in zip(found, self.merge_words([b for _, b in found], size), strict=True):
                kept[w[0]] = x
        return once

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        out = []
        self.kept = word_store(self.own)
        for at in range(0, len(texts), SLICE_ROWS):
            words = [self.words.findall(t or "") for t in texts[at : at + SLICE_ROWS]]
            new = set().union(*words)
            if len(self.kept) + len(new) > WORDS_KEPT:
                self.kept.clear()
            new = {w for w in new if w not in self.kept}
            once = self._learn(new) if new else {}
            get = (lambda w: once.get(w) or self.kept[w]) if once else self.kept.__getitem__
            out += [list(chain.from_iterable(map(get, x))) for x in words]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return " ".join(map(self.digits_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _mapped(df: DataFrame, columns: list, schema: str, arrow: list, fn) -> DataFrame:
    return df.select(*columns).mapInArrow(by_slices(fn, pa.schema(arrow)), schema)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row; null and empty texts get no ids.

    Every match of ``pattern`` is encoded by itself; special tokens are not known. Repeated rows give
    repeated results. Only the two named columns are read.
    """

    def fn(x: dict) -> dict:
        c = codec(path, pattern)
        return {"id": x["id"], "ids": c.encode_batch(x["text"])}

    kind = df.schema[id_col].dataType.simpleString()
    arrow = [("id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("ids", pa.list_(pa.int32()))]
    return _mapped(df, [df[id_col].alias("id"), df[text_col].alias("text")], f"id {kind}, ids array<int>", arrow, fn).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, decoded binary)``: the bytes of the ids; null ids decode to no bytes, unknown ids raise."""

    def fn(x: dict) -> dict:
        c = codec(path, pattern)
        return {"id": x["id"], "decoded": [c.decode(i or []) for i in x["ids"]]}

    kind = df.schema[id_col].dataType.simpleString()
    arrow = [("id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("decoded", pa.binary())]
    return _mapped(df, [df[id_col].alias("id"), df[ids_col].alias("ids")], f"id {kind}, decoded binary", arrow, fn).withColumnRenamed("id", id_col)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, and digest of the bytes decoded from the ids.

    A null text counts as empty and has no ids. Repeated rows give equal results; an empty table gives an empty result.
    ``doc_id`` is a whole number; other columns are not read.
    """

    def fn(x: dict) -> dict:
        c = codec(path, pattern)
        out = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in c.encode_batch(x["text"]):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(c.joined(ids).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
        return out

    arrow = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _mapped(df, [df["doc_id"].cast("bigint").alias("doc_id"), "text"], "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", arrow, fn)
