"""Scalar text functions: cleaning, word counts, compressed length, percents."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: character class kept by clean_text, and word separators ---
KEEP_CHARS = r"[^().,a-zA-Z ]"
# Python str.split() separators: Unicode whitespace plus \x1c-\x1f.
WORD_SEP = r"(?U)[\s\x1c-\x1f]+"


def clean_text(c: Column) -> Column:
    """Delete every character outside ( ) . , a-z A-Z and space; collapse
    space runs; trim.  Tabs and newlines are deleted, so words can merge."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, KEEP_CHARS, ""), " +", " "))


# a run of letters, digits and marks, or any other visible character by itself
TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\p{Z}\p{Cc}]"


def token_array(c: Column) -> Column:
    """Tokens of the whole raw text, lower-cased; white space and control
    characters separate.  NULL for a NULL text."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    """Whitespace word count, as Python's str.split() counts words."""
    return F.size(F.filter(F.split(c, WORD_SEP), lambda t: t != F.lit("")))


@F.pandas_udf(T.IntegerType())
def compressed_length(texts: pd.Series) -> pd.Series:
    """Byte length of the zlib-compressed (default level) UTF-8 text.

    Spark has no compression function among its built-ins, so this is the one
    vectorised Python step; it runs per Arrow batch, next to the scan.
    """
    return texts.map(lambda t: len(zlib.compress(t.encode("utf-8"))) if t is not None else None)


def format_percent(c: Column) -> Column:
    """Python's f"{x:.1%}": half-even on the exact binary value."""
    return F.concat(F.regexp_replace(F.format_number(c * F.lit(100.0), 1), ",", ""), F.lit("%"))


def parse_percent(c: Column) -> Column:
    return F.regexp_replace(c, "%$", "").cast("double")
