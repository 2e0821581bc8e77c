"""The report catalogue: merging, searching, filtering, sorting and paging."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions.dimensions import (
    COMPANY_TO_GROUP,
    INDUSTRY_GROUPS,
    INDUSTRY_TO_GROUP,
    SECTORS,
)
from ledgerleaf.functions.folding import search_fold
from ledgerleaf.functions.text import canonical_slug, collapse_whitespace


def merge_catalogue(index: DataFrame, uploads: DataFrame, id_col: str = "report_id") -> DataFrame:
    """Full outer by id: ``origin`` is index, uploaded or merged; an uploaded row's values win, null ones too."""
    names = [c for c in index.columns if c != id_col]
    a = index.select(id_col, F.struct(*names).alias("a"))
    b = uploads.select(id_col, F.struct(*names).alias("b"))
    origin = F.when(F.col("a").isNull(), "uploaded").when(F.col("b").isNull(), "index").otherwise("merged")
    picked = [F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in names]
    return a.join(b, id_col, "full_outer").select(id_col, *picked, origin.alias("origin"), F.col("b").isNotNull().alias("can_delete"))


def public_catalogue(index: DataFrame, uploads: DataFrame, id_col: str = "report_id") -> DataFrame:
    """Uploaded rows replace index rows whole."""
    return index.join(uploads.select(id_col), id_col, "left_anti").unionByName(uploads.select(*index.columns))


def latest_uploads(records: DataFrame, id_col: str = "report_id", order: str = "created_at") -> DataFrame:
    """The last row of each id, newest first."""
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc_nulls_last(order)))
    return records.withColumn("nth", nth).where("nth = 1").drop("nth").orderBy(F.desc_nulls_last(order), id_col)


def facet_values(df: DataFrame) -> DataFrame:
    """``facet, value, n``: values of country, sector, industry and year in one pass."""
    facets = [c for c in ("country", "sector", "industry", "year") if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets])
    return df.select(F.inline(pairs)).where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def search_reports(df: DataFrame, query: str, fields: list[str] | None = None) -> DataFrame:
    """Public search: the folded company or slug contains the folded query; with ``fields`` every token must be in their folded text."""
    needle = search_fold(F.lit(query))
    if fields is None:
        return df.where(search_fold(F.col("company")).contains(needle) | search_fold(F.col("slug")).contains(needle))
    blob = search_fold(F.concat_ws(" ", *[F.col(c).cast("string") for c in fields]))
    rows = df.withColumn("_blob", blob).withColumn("_tokens", F.split(needle, " "))
    return rows.where(F.forall("_tokens", lambda t: F.col("_blob").contains(t))).drop("_blob", "_tokens")


def filter_reports(df: DataFrame, countries: list | None = None, sectors: list | None = None, industries: list | None = None, years: list | None = None, scored: bool | None = None, entities: bool | None = None) -> DataFrame:
    """Value lists, and states of which a missing one counts as no."""
    lists = (("country", countries), ("sector", sectors), ("industry", industries), ("year", years))
    flags = (("scored", scored), ("entities_done", entities))
    tests = [F.col(c).isin(v) for c, v in lists if v] + [F.coalesce(F.col(c), F.lit(False)) == v for c, v in flags if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


#: Sort keys: missing scores are -1, missing states idle; entity states done, none, unknown.
def sort_key(field: str) -> Column:
    keys = {
        "score": lambda: F.coalesce("score", F.lit(-1)),
        "status": lambda: F.coalesce("status", F.lit("idle")),
        "entities": lambda: F.when(F.col("entities_done"), 2).when(~F.col("entities_done"), 1).otherwise(0),
        "year": lambda: F.coalesce("year", F.lit(0)),
        "created_at": lambda: F.col("created_at"),
    }
    return keys.get(field, lambda: F.lower(F.coalesce(F.col(field).cast("string"), F.lit(""))))()


def sort_reports(df: DataFrame, field: str | None = None, descending: bool = False) -> DataFrame:
    """By a key, then newest year, company and id; without a key newest first."""
    tail = [F.desc_nulls_last("year"), F.lower("company"), F.col("report_id")]
    if field is None:
        first = [F.desc_nulls_last("created_at")] if "created_at" in df.columns else []
        return df.orderBy(*first, *tail)
    key = sort_key(field)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *tail)


def page_of(df: DataFrame, order: list[Column], n: int, size: int) -> DataFrame:
    """Page ``n`` from 1, clamped to the last one, of the rows in a total order."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, n), last) - 1) * size).limit(size)


def key_page(records: DataFrame, key: str, cursor: str | None, limit: int) -> DataFrame:
    """The ``limit`` rows after the cursor in key order; the last row's key is the next cursor."""
    rows = records if cursor is None else records.where(F.col(key) > cursor)
    return rows.orderBy(key).limit(limit)


def find_by_slug(df: DataFrame, slug: str) -> DataFrame:
    return df.where(canonical_slug(F.col("slug")) == canonical_slug(F.lit(slug)))


def live_count(index: DataFrame, uploads: DataFrame, id_col: str = "report_id", step: int = 50) -> DataFrame:
    """``n, label``: distinct ids of both, and their number rounded down, with a plus."""
    n = F.count_distinct(id_col)
    rounded = (F.floor(n / step) * step).cast("bigint")
    label = F.when(n < step, n.cast("string")).otherwise(F.concat(rounded.cast("string"), F.lit("+")))
    return index.select(id_col).union(uploads.select(id_col)).agg(n.alias("n"), label.alias("label"))


def status_board(reports: DataFrame, scores: DataFrame, entities: DataFrame) -> DataFrame:
    """Add ``score, scored, entities_done``."""
    s = scores.select("report_id", "score").withColumn("scored", F.lit(True))
    e = entities.select("report_id").distinct().withColumn("entities_done", F.lit(True))
    return reports.join(s, "report_id", "left").join(e, "report_id", "left").fillna({"scored": False, "entities_done": False})


def run_scope(filtered: DataFrame, selected: DataFrame | None, limit: int = 120) -> DataFrame:
    """The selected rows if there are any, else the filtered ones; the first 1 to 2000."""
    rows = filtered
    if selected is not None and not selected.isEmpty():
        rows = filtered.join(selected.select("report_id").distinct(), "report_id", "left_semi")
    return rows.orderBy("report_id").limit(max(1, min(2000, limit)))


def to_industry_standard(df: DataFrame) -> DataFrame:
    """``s`` and ``i`` as standard sector and group: company override, then source industry, else Unknown.

    The source labels are kept once in ``ss`` and ``si``; rows already standard and without source labels stay.
    """
    pair = lambda table: F.create_map(*chain.from_iterable((F.lit(k), F.struct(F.lit(s).alias("s"), F.lit(g).alias("i"))) for k, (s, g) in table.items()))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    done = (empty("si") == "") & F.col("s").isin(SECTORS) & F.col("i").isin(INDUSTRY_GROUPS)
    source = F.when(empty("si") != "", F.col("si")).otherwise(empty("i"))
    found = F.coalesce(F.try_element_at(pair(COMPANY_TO_GROUP), empty("c")), F.try_element_at(pair(INDUSTRY_TO_GROUP), collapse_whitespace(source)))
    rows = df.withColumns({"_done": F.coalesce(done, F.lit(False)), "_source": source, "_found": found})
    keep = lambda new, old: F.when(F.col("_done"), F.col(old)).otherwise(new)
    return rows.withColumns({
        "ss": keep(F.coalesce("ss", empty("s")), "ss"), "si": keep(F.coalesce("si", F.col("_source")), "si"),
        "s": keep(F.coalesce("_found.s", F.lit("Unknown")), "s"), "i": keep(F.coalesce("_found.i", F.lit("Unknown")), "i"),
    }).drop("_done", "_source", "_found")


def unmapped_industries(df: DataFrame) -> DataFrame:
    """``industry, n`` of the source industries that ``to_industry_standard`` leaves Unknown."""
    rows = to_industry_standard(df).where("s = 'Unknown'")
    return rows.groupBy(collapse_whitespace(F.col("si")).alias("industry")).agg(F.count("*").alias("n")).orderBy("industry")
