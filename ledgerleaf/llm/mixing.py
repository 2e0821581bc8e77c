"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document's wanted copies are ``rate * preference``, at most MOST; the rate of a source makes the expected words meet
the source's target. Whole copies are certain. What is left of a document's wanted copies is its
inclusion probability ``p``: with a uniform ``u`` fixed by the id and the seed, documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` and taken from the smallest on until the words that the whole copies
leave of the target are reached. The sample is fixed in words, not in rows, as the target is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes.
SHARE = 1.5
#: Copies that no document and no source exceeds.
MOST = 2
#: Bins of the ranking over all documents of a source; only one bin of a source is ordered row by row.
BINS = 2_048


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_size() -> Column:
    """The usual preference: the number of bits of a document's size, so that longer documents are more often included."""
    return F.length(F.bin("size")).cast("long")


def uniform(key: Column, seed: str, nth: Column | None = None) -> Column:
    """A number strictly between 0 and 1 from 52 bits of the md5 of the key, the seed and, from 1 on, ``nth``."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    if nth is not None:
        text = F.concat(text, F.when(nth > 0, F.concat(F.lit(":"), nth.cast("string"))).otherwise(""))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, ..., target``: shares by weight, none above ``most`` times its source's size.

    ``sizes`` has one row a source. Sources are capped in the order of size per weight; the level of the
    others follows from what the capped ones leave, so one pass over the sorted sources is enough. One task sees
    all sources, a row each.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (order % len(weights)).cast("int") + 1)
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / F.sum("weight").over(onward)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("fill", F.row_number().over(by_fill))
        .withColumn("open", F.col("level") * F.col("weight") < F.lit(most) * F.col("source_size"))
    )
    # the first source that its level does not fill: it and all after it share that level
    first = F.min(F.when(F.col("open"), F.struct("fill", "level"))).over(everything)
    capped = F.col("first").isNull() | (F.col("fill") < F.col("first.fill"))
    return (
        ranked.withColumn("first", first)
        .withColumn("target", F.when(capped, (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.col("first.level") * F.col("weight")))
        .drop("weight", "level", "fill", "open", "first")
    )


def _copies(levels: DataFrame, most: int) -> DataFrame:
    """Add ``wanted`` copies to ``of, preference, words, target``, a row a source and preference.

    Preferences whose rate would exceed ``most`` are held there, the highest first; the rate of the others follows
    from what these leave of the target.
    """
    falling = Window.partitionBy("of").orderBy(F.desc("preference"))
    held = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = F.sum(F.col("preference") * F.col("words")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    rate = F.coalesce(F.try_divide(F.col("target") - F.lit(most) * held, weighed), F.lit(0.0))
    rates = levels.withColumn("rate", rate)
    open_ = F.when(F.col("rate") * F.col("preference") < most, F.struct("preference", "rate"))
    first = F.max(open_).over(Window.partitionBy("of"))
    under = F.col("preference") <= F.col("first.preference")
    wanted = F.when(under, F.col("first.rate") * F.col("preference")).otherwise(F.lit(float(most)))
    return rates.withColumn("first", first).withColumn("wanted", F.coalesce(F.greatest(wanted, F.lit(0.0)), F.lit(float(most)))).drop("first", "rate", "words")


def _nth_of_id(df: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Add ``nth``: 0, and for rows whose ids repeat (null ids too) a number among the rows of one id, source and size.

    These rows are numbered in the parts in which they lie, so that a row repeated very often is no one task's. Rows
    of one id, source and size are interchangeable.
    """
    if repeated is None:
        return df.withColumn("nth", F.lit(0).cast("long"))
    marked = df.withColumns({"_id": F.struct("doc_id"), "_at": F.spark_partition_id()}).join(repeated, "_id", "left")
    single = marked.where("_many is null").withColumn("nth", F.lit(0).cast("long")).drop("_id", "_at", "_many")
    many = marked.where("_many").drop("_many")
    group = ["_id", "source", "size"]
    counts = many.groupBy(*group, "_at").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.struct(*group, "_at").alias("_key"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_at").orderBy(F.lit(0))
    numbered = many.withColumn("_row", F.row_number().over(within)).withColumn("_key", F.struct(*group, "_at")).join(offsets, "_key")
    return single.unionByName(numbered.withColumn("nth", F.col("_offset") + F.col("_row") - 1).drop("_id", "_at", "_row", "_key", "_offset"))


def _ranked(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Add ``whole`` copies and the rank ``q`` (null where nothing is left to chance) with its ``bin``."""
    u = uniform(F.col("doc_id"), seed, F.col("nth"))
    return (
        rows.withColumn("of", F.struct("source"))
        .join(plan, ["of", "preference"])
        .withColumn("whole", F.floor("wanted"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("wanted") - F.col("whole")).otherwise(0.0))
        .withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS))
        .drop("wanted", "p")
    )


def _cuts(ranked: DataFrame) -> DataFrame:
    """Per source the bin in which its target is reached, and the last row that is taken of that bin."""
    certain = ranked.groupBy("of").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"))
    bins = ranked.where("q is not null").groupBy("of", "bin").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bins.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(certain, "of")
        .where("before <= left")
        .groupBy("of")
        .agg(F.max("bin").alias("cut_bin"), F.max_by("before", "bin").alias("cut_before"), F.first("left").alias("left"))
    )
    cut = saved(cut)
    upto = Window.partitionBy("of").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        ranked.join(cut, "of")
        .where("bin = cut_bin")
        .withColumn("so_far", F.col("cut_before") + F.sum("size").over(upto))
        .where(F.col("so_far") - F.col("size") / 2.0 <= F.col("left"))
        .groupBy("of")
        .agg(F.max(F.struct("q", "doc_id", "size")).alias("last"))
    )
    return cut.select("of", "cut_bin").join(last, "of", "left")


def take(docs: DataFrame, seed: str = "mix", keep: list[str] | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, preference: Column | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` and the columns named in ``keep``, a row a document.

    ``preference``: whole numbers above 0 of few values, in terms of ``size`` (and ``doc_id``, ``source``); ``by_size()``
    if none is given. Within a source the inclusion is in proportion to it.
    Sources are compared by code point, null being a source of its own and the last. A null or empty text
    has size 0 and takes nothing. Repeated rows, and rows without an id, are drawn one by one. An empty table gives an
    empty result. The mix depends on ids, sizes and sources alone, so reruns agree.

    Sums, bins and cuts are found on ids, sources and sizes; the tables of a row a source (and preference) are written, so
    that Spark sees their size before it chooses how to join them. ``keep`` columns pass through one map.
    """
    keep = keep or []
    wide = docs.select("doc_id", "source", words(F.col("text")).alias("size"), *keep)
    rows = saved(wide.select("doc_id", "source", "size"))
    repeated = saved(rows.groupBy("doc_id").count().where("count > 1").select(F.struct("doc_id").alias("_id"), F.lit(True).alias("_many")))
    some = None if repeated.isEmpty() else repeated
    prefer = by_size() if preference is None else preference
    levels = rows.groupBy("source", prefer.alias("preference")).agg(F.sum("size").alias("words"))
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = sizes.select(F.struct("source").alias("of"), "source_size", "target")
    plan = saved(_copies(levels.select(F.struct("source").alias("of"), "preference", "words").join(goals, "of"), most))
    cuts = saved(_cuts(_ranked(_nth_of_id(rows, some).withColumn("preference", prefer), plan, seed)))
    drawn = _ranked(_nth_of_id(wide if keep else rows, some).withColumn("preference", prefer), plan, seed).join(cuts, "of", "left")
    at_cut = (F.col("bin") == F.col("cut_bin")) & (F.struct("q", "doc_id", "size") <= F.col("last"))
    extra = F.coalesce((F.col("bin") < F.col("cut_bin")) | at_cut, F.lit(False)).cast("long")
    copies = (F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0)).cast("long")
    return drawn.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def mixed_rows(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, rows of 0 words left out, columns unchanged.

    Nulls, repeated rows and empty tables as in ``take``; columns of other names pass through, whatever they are called.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = take(docs.select("doc_id", "source", "text", row), seed, ["row"], **options)
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return taken.where("copies > 0").select("row", each).select("row.*")
