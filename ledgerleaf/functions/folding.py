"""Accent folding, mojibake repair and slugs: the few text functions that need Python, on Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.functions.blocks import slices
from ledgerleaf.functions.text import collapse_whitespace

_MARKS = re.compile("[̀-ͯ]")
#: What UTF-8 read as Latin-1 looks like.
MOJIBAKE = "[\u0080-\u009f]|[À-ÿ][\u0080-¿]"


def fold(text: str) -> str:
    """Without accents, lower case, everything else than letters and digits as one space."""
    bare = _MARKS.sub("", unicodedata.normalize("NFD", text)).lower()
    return re.sub("[^a-z0-9]+", " ", bare).strip()


def _penalty(text: str) -> int:
    return sum(5 * ("\u0080" <= c <= "\u009f") + 8 * (c == "�") + 2 * (c in "ÃÂâÄÅ") for c in text)


def repaired(text: str) -> str:
    decoded = " ".join(bytes(ord(c) & 0xFF for c in text).decode("utf-8", "replace").split())
    return decoded if decoded and _penalty(decoded) < _penalty(text) else text


@F.arrow_udf(T.StringType())
def _fold(texts: pa.Array) -> pa.Array:
    # only a slice's texts are Python strings at a time, not a batch's
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    made = [pa.array([None if t is None else fold(t) for t in part.column(0).to_pylist()], pa.string()) for part in slices(batch, 0)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(repaired, na_action="ignore")


def search_fold(col: Column, repair: bool = False) -> Column:
    """The form in which names are searched; ``repair`` mends mojibake first. Null gives the empty string.

    Plain ASCII values are folded without Python.
    """
    value = F.coalesce(repair_mojibake(col) if repair else col, F.lit(""))
    ascii_fold = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))
    return F.when(value.rlike(r"^\p{ASCII}*$"), ascii_fold).otherwise(_fold(value))


def repair_mojibake(col: Column) -> Column:
    """Collapsed text; where it looks like UTF-8 read as Latin-1 it is decoded again, if that has less oddities."""
    text = collapse_whitespace(col)
    return F.when(text.rlike(MOJIBAKE), _repair(text)).otherwise(text)


def slugify(col: Column) -> Column:
    return F.replace(search_fold(col), F.lit(" "), F.lit("-"))


def slugify_company(col: Column) -> Column:
    return slugify(F.replace(col, F.lit("&"), F.lit(" and ")))
