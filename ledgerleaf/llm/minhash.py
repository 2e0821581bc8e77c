"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first scatters a shingle over PLACES places, the second,
shifted round by k places, ranks it for coordinate k. Documents with one set of shingles form a class,
and classes that agree in a band of coordinates share a bucket. Links are confirmed on full sets:

1. Stars: every class is compared with the least class of each of its buckets by sketch (a byte of every coordinate),
   and verified against the one that agrees most. This is linear in the bucket and joins the bulk of a large group.
2. Rest: in buckets whose classes still lie in more than one component, classes of different components are
   compared by sketch in blocks of bounded size (never within the largest component), and those that
   may reach the threshold are verified in blocks by their full sets. A pair is looked at in the first
   band it shares only. A block passes on a spanning forest of its links, not all pairs.

Both bounds are exact in the binomial model: the number of bands follows from the threshold, so that a pair at it
shares no bucket with probability MISSED at most, and so does the number of coordinates that must agree. Coordinates of
circulant MinHash are not independent, but their agreement varies less than that of independent ones (Li and
Li, C-MinHash, 2021), so the model errs on the safe side. Bytes of a sketch agree whenever the coordinates do.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import by_slices, saved, slices, spread_join, word_store

PLACES = 1 << 20
BAND_ROWS = 5
MISSED = 1e-7
#: Classes of a block; a task compares two blocks at a time.
BLOCK = 128
#: Word hashes that a worker keeps, shingles whose coordinates are made at once, set members multiplied at once.
WORDS_KEPT, STEP_SHINGLES, STEP_MEMBERS = 150_000, 2048, 8192

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** BAND_ROWS))


@lru_cache(maxsize=8)
def least_agreement(width: int, percent: int) -> int:
    """Coordinates of ``width`` in which a pair at the threshold agrees, but for a chance of MISSED."""
    p, total = percent / 100, 0.0
    for k in range(width + 1):
        total += math.comb(width, k) * p**k * (1 - p) ** (width - k)
        if total > MISSED:
            return k
    return width


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    kept: dict[bytes, int] = word_store("minhash")
    if len(kept) > WORDS_KEPT:
        kept.clear()
    for w in set(words):
        if w not in kept:
            kept[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = mixed * np.uint64(0x9DDFEA08EB382D69) + (h[i : len(h) - n + 1 + i] ^ np.uint64(i)) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@lru_cache(maxsize=4)
def _shifts(width: int) -> np.ndarray:
    """Row p: the second permutation at places p, p + 1, ..., p + width - 1, going round."""
    order = np.random.default_rng(7).permutation(PLACES).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:width]]), width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    place = (shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
    least = np.full(width, PLACES, np.int32)
    for at in range(0, len(place), STEP_SHINGLES):
        np.minimum(least, _shifts(width)[place[at : at + STEP_SHINGLES]].min(0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key a band, of the band's number and coordinates."""
    part = sig.reshape(-1, BAND_ROWS).astype(np.uint64)
    key = np.arange(1, len(part) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND_ROWS):
        key = (key ^ part[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def shingled(docs: DataFrame, size: int, width: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sketch``; the last three are null for an empty set."""

    def fn(x: dict) -> dict:
        sets = [shingle_set(t, size) for t in x["text"]]
        sigs = [signature(s, width) if len(s) else None for s in sets]
        return {
            "doc_id": x["doc_id"],
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets],
            "bands": [None if s is None else band_keys(s) for s in sigs],
            "sketch": [None if s is None else s.astype(np.uint8).tobytes() for s in sigs],
        }

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(by_slices(fn, schema), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch binary")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, members array<long>`` for the documents whose ids are in ``nodes``."""

    def fn(x: dict) -> dict:
        return {"node": x["doc_id"], "members": [shingle_set(t, size).view(np.int64) for t in x["text"]]}

    schema = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])
    wanted = docs.select(F.col("doc_id").cast("bigint"), "text").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return wanted.mapInArrow(by_slices(fn, schema, 64), "node bigint, members array<long>")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) of the nodes of ``links(a, b)``.

    Large-star and small-star rounds, each in joins and minima, until the links no longer change; every
    round is written. A node with very many neighbours (the centre of a large group) is dealt over several tasks.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state, total = None, edges.count()
    while total:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n_rows")).select("u", F.least("low", "u").alias("m"), "n_rows")
        large = spread_join(both.where("v > u"), least, "u", "v", total=2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = saved(small.where("u <> v").distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        state, total = seen, seen[0]
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _enough(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (bucket, i, j) from batches sorted by it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = np.stack([table[c].to_numpy() for c in ("bucket", "i", "j")])
        cuts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    offsets, values = whole.offsets.to_numpy(), whole.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, width) bytes of sketches of one length."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(column), -1)


def _close(a, b, percent: int):
    """Sizes of sets that can reach the threshold."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def plausible(sketch: np.ndarray, comp: np.ndarray, n: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Which rows may be linked with a row of another component, in no band before this one."""
    need = least_agreement(sketch.shape[1], percent)
    hit = np.zeros(len(sketch), bool)
    _, back, count = np.unique(comp, return_inverse=True, return_counts=True)
    for i in np.nonzero(back != count.argmax())[0]:
        at = np.nonzero((comp != comp[i]) & _close(n, n[i], percent))[0]
        same = sketch[at] == sketch[i]
        ok = np.count_nonzero(same, 1) >= need
        if band and ok.any():
            ok &= ~same[:, : band * BAND_ROWS].reshape(len(at), band, BAND_ROWS).all(2).any(1)
        if ok.any():
            hit[at[ok]] = True
            hit[i] = True
    return hit


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, from exact sizes of all intersections."""
    n = np.array([len(s) for s in sets])
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    inter = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    for low in range(0, int(member[-1]) + 1, STEP_MEMBERS):
        a, b = np.searchsorted(member, [low, low + STEP_MEMBERS])
        part = np.zeros((len(sets), STEP_MEMBERS), np.float32)
        part[owner[a:b], member[a:b] - low] = 1
        inter += part @ part.T
    linked = _enough(inter, n[:, None], n[None, :], percent)
    links, free = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if free[start]:
            free[start], todo = False, [start]
            while todo:
                x = todo.pop()
                new = np.nonzero(linked[x] & free)[0].tolist()
                free[new] = False
                links += [(x, y) for y in new]
                todo += new
    return links


def _blocked(members: DataFrame) -> DataFrame:
    """Rows of ``bucket, node, comp, ...`` repeated for each pair of blocks (i, j) that they belong to.

    Members of a bucket's largest component and all others lie in different blocks; two blocks of the
    largest component never meet.
    """
    by_comp = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    shape = by_comp.groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max("k").alias("n_main"), F.sum("k").alias("n_rows"), F.count("*").alias("n_comps")).where("n_comps > 1")
    shape = saved(shape.withColumn("n_all", F.col("n_rows")))
    few = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int")
    many = F.ceil(F.col("n_main") / BLOCK).cast("int")
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, many).otherwise(few)).cast("int") + F.when(is_main, few).otherwise(0)
    others = F.sequence(F.lit(0), F.when(is_main, few).otherwise(few + many) - 1)
    return (
        spread_join(members, shape, "bucket", "node")
        .withColumn("own", own)
        .withColumn("other", F.explode(others))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("main", "n_main", "n_all", "n_comps", "own", "other")
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are lower-cased in A-Z and split at ASCII white space; a text of fewer than ``size`` words has one
    shingle, a null or blank text none and no links. Documents are linked if the Jaccard similarity of their
    sets is ``percent`` or more; ``component_id`` is the smallest id reachable and ``kept`` marks it. Rows
    that repeat an id count as one document with the links of them all. A row without an id is linked with
    nothing, has no ``component_id`` and is kept. An empty table gives an empty result. Only ``doc_id`` (a whole
    number) and ``text`` are read.
    """
    width = bands_for(percent) * BAND_ROWS
    base = saved(shingled(docs, size, width))
    usable = base.where("doc_id is not null and digest is not null")
    classes = saved(
        usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    rows = classes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = saved(rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n_rows")).where("n_rows > 1"))
    members = saved(spread_join(rows, shared, "bucket", "node"))

    # 1. stars
    stars = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("n").alias("n_b")).distinct()
    of_b = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    centres = stars.groupBy("a").agg(F.count("*").alias("n_rows")).join(classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x")), "a")
    need = least_agreement(width, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in slices(batch, 4096):
                close = _close(g["n_a"].to_numpy(), g["n_b"].to_numpy(), percent)
                same = np.count_nonzero(_sketches(g["x"]) == _sketches(g["y"]), 1)
                ok = close & (same >= need)
                yield pa.RecordBatch.from_arrays([g["a"].filter(pa.array(ok)), g["b"].filter(pa.array(ok)), pa.array(same[ok].astype(np.int32))], names=["a", "b", "same"])

    paired = spread_join(stars.join(of_b, ["b", "n_b"]), saved(centres), "a", "b")
    likely = paired.mapInArrow(compare, "a bigint, b bigint, same int")
    best = saved(likely.groupBy("b").agg(F.max(F.struct("same", "a")).alias("best")).select("b", F.col("best.a").alias("a")))
    centre_sets = best.groupBy("a").agg(F.count("*").alias("n_rows"))
    nodes = best.select(F.col("b").alias("node")).unionByName(best.select(F.col("a").alias("node")))
    sets = saved(full_sets(docs, saved(nodes.distinct()), size))
    of_a = saved(sets.select(F.col("node").alias("a"), F.col("members").alias("x")).join(centre_sets, "a"))
    inter = F.size(F.array_intersect("x", "y"))
    verified = (
        spread_join(best.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b"), of_a, "a", "b")
        .where(_enough(inter, F.size("x"), F.size("y"), percent))
        .select("a", "b")
    )
    # ids that repeat with different texts link the texts' classes
    keyed = usable.select("doc_id", F.xxhash64("digest").alias("key"))
    several = keyed.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id", "low")
    of_key = classes.select(F.xxhash64("digest").alias("key"), "node")
    same_id = keyed.join(several, "doc_id").join(of_key.withColumnRenamed("node", "b"), "key").select("low", "b").join(of_key.select(F.col("key").alias("low"), F.col("node").alias("a")), "low").select("a", "b")
    found = saved(components(verified.unionByName(same_id)))

    # 2. rest
    placed = saved(members.drop("first").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
    blocked = _blocked(placed).join(classes.select("node", "n", "sketch"), ["node", "n"])
    by_key = ["bucket", "i", "j"]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            hit = plausible(_sketches(g["sketch"]), g["comp"].to_numpy(), g["n"].to_numpy(), g["band"][0].as_py(), percent)
            if hit.any():
                yield from g.select([*by_key, "node", "comp"]).filter(pa.array(hit)).to_batches()

    screened = saved(blocked.repartition(*by_key).sortWithinPartitions(*by_key).mapInArrow(screen, "bucket bigint, i int, j int, node bigint, comp bigint"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            comp = g["comp"].to_numpy()
            pairs = np.array(forest(_lists(g["members"]), percent), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(comp[pairs[:, 0]], pa.int64()), pa.array(comp[pairs[:, 1]], pa.int64())], names=["a", "b"])

    more_sets = full_sets(docs, saved(screened.select("node").distinct()), size)
    more = screened.join(more_sets, "node").repartition(*by_key).sortWithinPartitions(*by_key).mapInArrow(verify, "a bigint, b bigint")
    merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    labels = (
        classes.select("digest", "node", "n_rows")
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(merged, "component", "left")
        .select("digest", F.coalesce("whole", "component").alias("component_id"), "n_rows")
    )
    placed_rows = spread_join(usable.select("doc_id", "n_shingles", "digest"), saved(labels), "digest", "doc_id").drop("digest")
    alone = base.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = placed_rows.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
