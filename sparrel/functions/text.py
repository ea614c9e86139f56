"""String functions as columns. White space is Unicode's, as opposed to what ``trim`` takes off."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a caption: special marks, English contractions, runs of letters, single digits, other runs (fixed pattern).
TOKEN = r"(?i)<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def nonblank(c: Column) -> Column:
    """The stripped string, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def token_split(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(collapse(c)), F.lit(TOKEN), F.lit(0))


def caption_id(video_id: Column, number: Column) -> Column:
    return F.concat_ws("::", video_id, F.lit("caption"), number.cast("string"))


def unescape(c: Column) -> Column:
    """HTML entities resolved twice, ends stripped. Repair of wrongly decoded text is left out: it needs a library that is not there."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(html.unescape(t)).strip())

    return F.pandas_udf(run, T.StringType())(c)
